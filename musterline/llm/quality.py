"""Compression classifier: dictionaries of good and bad text, size difference, calibration.

Each class gives Zstandard dictionaries built from its labelled texts. A text compresses
better with the dictionary of its own class; the difference of the two sizes, normalised by
the larger, is turned into a probability by a logistic curve that also knows the text's
length and how far it compresses at all.

Defined cases: null and empty texts score like a text of no bytes (the curve at length zero);
repeated rows score alike; a training sample that lacks a class gives the constant 0.5, and so
does an empty one; extra columns are ignored; very long texts are compressed whole, in pieces.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from musterline.llm.common import by_value, free_name, quoted, send
from musterline.llm.samples import agreed, class_weights, labelled

DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
# Rows of each class that may reach the driver, and the longest text among them.
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 65_536
SPLITS = 2
PIECE = 1 << 20

by_value(sys.modules[__name__])


@dataclass
class QualityModel:
    """Pairs of dictionaries (bad, good) and the weights of the logistic curve."""

    dictionaries: list[tuple[bytes, bytes]]
    weights: np.ndarray


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of distinct texts cut into pieces; raw content if too few to train on."""
    pieces = [t[i : i + 4096] for t in texts for i in range(0, len(t), 4096)]
    pieces = [piece for piece in pieces if len(piece) >= 8]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:].rjust(8, b" ")


def compressors(model: QualityModel) -> list[zstandard.ZstdCompressor]:
    out = []
    for pair in model.dictionaries:
        for content in pair:
            shared = zstandard.ZstdCompressionDict(content)
            shared.precompute_compress(level=LEVEL)
            out.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False
                )
            )
    return out


def compressed(compressor: zstandard.ZstdCompressor, content: bytes) -> int:
    """Compressed size of the whole content; long ones go through a stream in pieces."""
    if len(content) <= PIECE:
        return len(compressor.compress(content))
    stream = compressor.compressobj()
    size = 0
    for at in range(0, len(content), PIECE):
        size += len(stream.compress(content[at : at + PIECE]))
    return size + len(stream.flush())


def features(tools: list[zstandard.ZstdCompressor], texts: list[str | None]) -> np.ndarray:
    """Differences and ratios of compressed sizes, averaged over the pairs."""
    contents = [(text or "").encode("utf-8", "replace") for text in texts]
    sizes = np.array([[compressed(t, c) for t in tools] for c in contents], float)
    sizes = sizes.reshape(len(texts), -1, 2)
    length = np.array([len(c) + 1.0 for c in contents])
    bad, good = sizes[:, :, 0], sizes[:, :, 1]
    difference = ((bad - good) / np.maximum(bad, good)).mean(1)
    per_byte = ((bad - good).mean(1)) / length
    ratio = np.log(np.minimum(bad, good).mean(1) / length)
    long = np.log(length)
    return np.column_stack(
        (
            np.ones(len(texts)),
            difference,
            per_byte,
            ratio,
            long,
            difference * long,
            difference * ratio,
            per_byte * long,
            ratio * ratio,
            ratio * long,
            long * long,
        )
    )


def logistic(
    x: np.ndarray,
    y: np.ndarray,
    damping: float = 1e-2,
    steps: int = 80,
    rows: np.ndarray | float = 1.0,
) -> np.ndarray:
    """Newton steps on the damped logistic loss; `rows` is what each row stands for."""
    weights = np.zeros(x.shape[1])
    rows = np.broadcast_to(rows, y.shape)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6) * rows
        slope = x.T @ ((p - y) * rows) + damping * weights
        move = np.linalg.solve((x * curve[:, None]).T @ x + damping * np.eye(x.shape[1]), slope)
        weights -= move * min(1.0, 3 / max(np.abs(move).max(), 1e-12))
    return weights


def fit_texts(
    rows: list[tuple[str, int]], stands_for: tuple[float, float] = (1.0, 1.0)
) -> QualityModel:
    """Fit on (text, label) rows: `SPLITS` parts give dictionaries, one part calibrates.

    `stands_for` weights the calibration rows of class 0 and 1.
    """
    by_class: list[list[bytes]] = [[], []]
    for text, label in rows:
        by_class[label].append(text.encode("utf-8", "replace"))
    distinct = [list(dict.fromkeys(texts)) for texts in by_class]
    if min(map(len, distinct)) < 2 * (SPLITS + 1):
        return QualityModel([], np.zeros(1))
    parts = SPLITS + 1
    model = QualityModel(
        [tuple(dictionary(texts[k::parts]) for texts in distinct) for k in range(SPLITS)],
        np.zeros(1),
    )
    held = [[t.decode("utf-8", "replace") for t in texts[SPLITS::parts]] for texts in distinct]
    x = features(compressors(model), held[0] + held[1])
    y = np.array([0.0] * len(held[0]) + [1.0] * len(held[1]))
    model.weights = logistic(x, y, rows=np.array(stands_for)[y.astype(int)])
    return model


def scores_of(model: QualityModel, tools: list, texts: list[str | None]) -> np.ndarray:
    if not model.dictionaries:
        return np.full(len(texts), 0.5)
    if not texts:
        return np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(features(tools, texts) @ model.weights, -30, 30)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 5,
    held_out: int = 0,
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """Fit on at most `sample_rows` labelled texts per class, none of the held-out fold.

    The curve is fitted to the true shares of the classes, counted over all labels.
    """
    rows = labelled(docs, labels, label, folds, held_out, sample_rows, SAMPLE_CHARS)
    ids = agreed(labels, label, folds, held_out)
    return fit_texts(rows, class_weights(ids, [value for _, value in rows]))


def score(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and `score`, the probability of label 1, for every row.

    A kept column named score comes out as `score_input`.

    A scan and one pass of Python over Arrow batches; nothing is shuffled. The model
    (dictionaries of at most 64 KB each) is sent once per executor.
    """
    shared = send(docs.sparkSession, model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = pickle.loads(shared.value)
        ready = compressors(fitted)
        for batch in batches:
            yield pd.Series(scores_of(fitted, ready, batch.tolist()))

    own = [quoted(name).alias(free_name(name, ["score"])) for name in keep]
    return docs.select(*own, scored(quoted(text)).alias("score"))

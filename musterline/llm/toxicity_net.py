"""Convolutional text classifier in numpy: hashed embeddings, several widths, max pooling.

A word is the sum of the embeddings of its hash and of the hashes of its first four and
five bytes, so inflected forms share a part. Filters of every width slide over the words; the
best position of each filter enters a logistic layer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

BUCKETS = 1 << 15
PARTS = 3
WIDTHS = (1, 2, 3)
FILTERS = 8
DIMENSIONS = 12

_KEEP = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: letters, digits and all characters beyond ASCII."""
    return (text or "").lower().encode("utf-8", "replace").translate(_KEEP).split()


def buckets_of(text: str | None) -> np.ndarray:
    """Bucket numbers of each word and of its two prefixes; bucket 0 is the padding."""
    words = words_of(text)
    if not words:
        return np.zeros((1, PARTS), np.int32)
    sums = np.empty((len(words), PARTS), np.uint32)
    sums[:, 0] = list(map(zlib.crc32, words))
    sums[:, 1] = [zlib.crc32(word[:4], 4) for word in words]
    sums[:, 2] = [zlib.crc32(word[:5], 5) for word in words]
    return (1 + sums % (BUCKETS - 1)).astype(np.int32)


@dataclass
class Net:
    """Weights; `scale` and `shift` turn the raw output into a calibrated probability."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def table(self) -> np.ndarray:
        """Embeddings times every filter position: one row of numbers per bucket."""
        columns = [self.embedding @ self.filters[k][o] for k in WIDTHS for o in range(k)]
        return np.ascontiguousarray(np.hstack(columns), dtype=np.float32)

    def raw(self, documents: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        """Logits of documents given as arrays of bucket numbers."""
        pad = np.zeros((max(WIDTHS) - 1, PARTS), np.int32)
        sizes = np.array([len(d) for d in documents])
        flat = np.concatenate([x for d in documents for x in (d, pad)])
        starts = np.concatenate(([0], np.cumsum(sizes + len(pad))[:-1]))
        edges = np.column_stack((starts, starts + sizes)).ravel()
        at_words = table[flat[:, 0]]
        for part in range(1, PARTS):
            at_words += table[flat[:, part]]
        pooled, column = [], 0
        reach = len(flat) - len(pad)
        for k in WIDTHS:
            # One more row keeps the last edge, one past the windows, a valid index.
            window = np.empty((reach + 1, FILTERS), np.float32)
            window[reach] = -np.inf
            window[:reach] = at_words[:reach, column : column + FILTERS]
            for o in range(1, k):
                at = column + o * FILTERS
                window[:reach] += at_words[o : reach + o, at : at + FILTERS]
            best = np.maximum.reduceat(window, edges, axis=0)[::2]
            pooled.append(np.maximum(best + self.biases[k], 0))
            column += k * FILTERS
        return np.hstack(pooled) @ self.out + self.bias

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30)))


def start(documents: list[np.ndarray], labels: np.ndarray, seed: int) -> Net:
    """Small random weights; dimension 0 starts at each bucket's log odds of the classes."""
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    seen = np.zeros((2, BUCKETS), np.float64)
    for row, label in zip(documents, labels):
        seen[int(label), np.unique(row)] += 1
    totals = np.maximum([np.sum(labels == 0), np.sum(labels == 1)], 1)
    rate = (seen + 0.5) / (totals[:, None] + 1)
    weight = seen.sum(0) / (seen.sum(0) + 3)
    embedding[:, 0] = (np.log(rate[1] / rate[0]) * weight / 3).astype(np.float32)
    embedding[0] = 0
    filters = {
        k: random.normal(0, 0.2, (k, DIMENSIONS, FILTERS)).astype(np.float32) for k in WIDTHS
    }
    for k in WIDTHS:
        filters[k][:, 0, : FILTERS // 2] = 1 / k
    biases = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
    out = random.normal(0.1, 0.05, len(WIDTHS) * FILTERS).astype(np.float32)
    return Net(embedding, filters, biases, out, -1.0)


def fit(
    documents: list[np.ndarray],
    labels: np.ndarray,
    epochs: int = 6,
    batch: int = 64,
    rate: float = 0.05,
    seed: int = 7,
) -> Net:
    """Train by Adagrad on the logistic loss, both classes weighing the same in all."""
    net = start(documents, labels, seed)
    random = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    squares: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        total = squares.setdefault(name, np.full(value.shape, 1e-2, np.float32))
        total += gradient**2
        value -= rate * gradient / np.sqrt(total)

    energy = np.full(BUCKETS, 1e-2, np.float32)
    bias = np.array([net.bias], np.float32)
    pad = np.zeros((max(WIDTHS) - 1, PARTS), np.int32)
    for _ in range(epochs):
        order = random.permutation(len(documents))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            flat = np.vstack([x for i in chosen for x in (documents[i], pad)])
            sizes = np.array([len(documents[i]) for i in chosen])
            starts = np.concatenate(([0], np.cumsum(sizes + len(pad))[:-1]))
            vectors = net.embedding[flat].sum(1)
            pooled, places = [], {}
            for k in WIDTHS:
                reach = len(flat) - k + 1
                conv = sum(vectors[o : reach + o] @ net.filters[k][o] for o in range(k))
                places[k] = np.array(
                    [s + conv[s : s + n].argmax(0) for s, n in zip(starts, sizes)]
                )
                best = np.take_along_axis(conv, places[k], 0) + net.biases[k]
                pooled.append(best)
            hidden = np.hstack(pooled)
            active = np.maximum(hidden, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ net.out + bias[0], -30, 30)))
            error = ((p - labels[chosen]) * weights[chosen] / len(chosen)).astype(np.float32)
            back = error[:, None] * net.out[None, :] * (hidden > 0)
            step("out", net.out, active.T @ error)
            step("bias", bias, np.array([error.sum()], np.float32))
            touched, pulls = [], []
            for j, k in enumerate(WIDTHS):
                g = back[:, j * FILTERS : (j + 1) * FILTERS]
                gradient = np.zeros_like(net.filters[k])
                for o in range(k):
                    position = places[k] + o
                    at_best = vectors[position]
                    gradient[o] = np.einsum("bfd,bf->df", at_best, g)
                    touched.append(position.ravel())
                    pulls.append((g[:, :, None] * net.filters[k][o].T[None]).reshape(-1, DIMENSIONS))
                step(f"filters{k}", net.filters[k], gradient)
                step(f"biases{k}", net.biases[k], g.sum(0))
            rows, pull = flat[np.concatenate(touched)], np.vstack(pulls)
            buckets, inverse = np.unique(rows, return_inverse=True)
            total = np.zeros((len(buckets), DIMENSIONS), np.float32)
            np.add.at(total, inverse.reshape(rows.shape), pull[:, None, :])
            energy[buckets] += (total**2).mean(1)
            net.embedding[buckets] -= rate * total / np.sqrt(energy[buckets])[:, None]
            net.embedding[0] = 0
    net.bias = float(bias[0])
    return net


def platt(
    raw: np.ndarray,
    labels: np.ndarray,
    steps: int = 50,
    stands_for: tuple[float, float] = (1.0, 1.0),
) -> tuple[float, float]:
    """Scale and shift of a logistic curve fitted to raw outputs, a little damped.

    `stands_for` weights the rows of class 0 and 1.
    """
    high, low = (labels == 1).sum(), (labels == 0).sum()
    if high == 0 or low == 0:
        return 1.0, 0.0
    target = np.where(labels == 1, (high + 1) / (high + 2), 1 / (low + 2))
    rows = np.where(labels == 1, stands_for[1], stands_for[0])
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9) * rows
        miss = (p - target) * rows
        g = np.array([(miss * raw).sum() + 1e-3 * a, miss.sum()])
        h = np.array(
            [[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]]
        )
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def raw_of(
    net: Net, table: np.ndarray, documents: Iterable[np.ndarray], slice_words: int = 50_000
) -> np.ndarray:
    """Logits of documents, a slice of words at a time to bound memory."""
    out, held, size = [np.zeros(0)], [], 0
    for document in documents:
        held.append(document)
        size += len(document)
        if size >= slice_words:
            out.append(net.raw(held, table))
            held, size = [], 0
    if held:
        out.append(net.raw(held, table))
    return np.concatenate(out)


def scores_of(net: Net, table: np.ndarray, texts: Iterable[str | None]) -> np.ndarray:
    """Calibrated scores of whole texts."""
    return net.scores(raw_of(net, table, map(buckets_of, texts)))

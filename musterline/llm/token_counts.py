"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is cut into pre-tokens; a token count belongs to each. Blocks of pre-tokens are the leaves
of a segment tree whose nodes hold sums of characters and tokens. An edit finds its
leaf by descending the character sums, cuts and encodes anew only from a boundary shortly before
the edit to the first old boundary that the new cut meets again, and updates the sums
above the leaves it touched.

Each document is worked off alone inside a task; documents are never gathered. Counts of known
pre-tokens are kept in a cache of fixed size per task. The vocabulary file is read on the
driver, from a path that is a parameter, and broadcast (about 1 MB).

Defined cases: null and empty texts have no tokens, and edits on them can only insert; null edits
are none; edits of a text must lie inside it, in order, without overlap, else an error is
raised; repeated rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import pickle
import sys
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from musterline.llm.common import by_value, free_name, quoted, send

# Fixed value: the pattern that goes with the vocabulary.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 256
CACHE = 100_000
# No alternative of the pattern looks farther than this past its end.
CONTEXT = 4
RESULT = (
    "n_chars long, n_pretokens long, n_tokens long, n_edits long, edited_chars long,"
    " edited_tokens long, reencoded long"
)

by_value(sys.modules[__name__])


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Counter:
    """Pre-tokens of a text and the number of tokens in each."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.cut = regex.compile(PATTERN).findall
        self.encoding = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={}
        )
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = []
        for piece in pieces:
            n = known.get(piece)
            if n is None:
                if len(known) >= CACHE:
                    known.clear()
                n = len(self.encoding.encode_ordinary(piece))
                if len(piece) <= 64:
                    known[piece] = n
            out.append(n)
        return out


class Tree:
    """Segment tree over blocks of (pieces, counts); node 1 is the root."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.cut(text)
        counts = counter.counts(pieces)
        self.leaves = [
            (pieces[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(pieces), BLOCK)
        ] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for number in range(len(self.leaves)):
            self._measure(number)
        for node in range(self.width - 1, 0, -1):
            self._add(node)
        self.reencoded = 0

    def _measure(self, leaf: int) -> None:
        pieces, counts = self.leaves[leaf]
        self.chars[self.width + leaf] = sum(map(len, pieces))
        self.tokens[self.width + leaf] = sum(counts)

    def _add(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _update(self, leaf: int) -> None:
        self._measure(leaf)
        node = (self.width + leaf) // 2
        while node:
            self._add(node)
            node //= 2

    def _locate(self, position: int) -> tuple[int, int, int]:
        """(leaf, index of the piece, its start) of the piece that holds `position`."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if position >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        leaf = node - self.width
        if leaf >= len(self.leaves):
            leaf = len(self.leaves) - 1
            start = self.chars[1] - self.chars[self.width + leaf]
        index = 0
        pieces = self.leaves[leaf][0]
        while index < len(pieces) and start + len(pieces[index]) <= position:
            start += len(pieces[index])
            index += 1
        return leaf, index, start

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters from `start` to `end` by `text`."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError(f"edit {start}-{end} is outside a text of {self.chars[1]} characters")
        leaf, index, at = self._locate(max(0, start - CONTEXT))
        # Old pieces from there on, as many as it takes to meet an old boundary again.
        held: list[str] = []
        ends: list[int] = []
        place, follow, reach, wanted = leaf, index, at, 8
        while True:
            beyond = sum(1 for e in ends if e > end + CONTEXT)
            while beyond < wanted and place < len(self.leaves):
                pieces = self.leaves[place][0]
                if follow >= len(pieces):
                    place, follow = place + 1, 0
                    continue
                held.append(pieces[follow])
                reach += len(pieces[follow])
                ends.append(reach)
                beyond += reach > end + CONTEXT
                follow += 1
            finished = reach == self.chars[1]
            old = "".join(held)
            new = old[: start - at] + text + old[end - at :]
            shift = len(text) - (end - start)
            limit = len(new) if finished else len(new) - CONTEXT
            boundaries = {e + shift - at: k for k, e in enumerate(ends) if e >= end}
            pieces, size, replaced = [], 0, None
            for piece in self.counter.cut(new):
                pieces.append(piece)
                size += len(piece)
                if size <= limit and size >= start - at + len(text) and size in boundaries:
                    replaced = boundaries[size] + 1
                    break
            if replaced is None and finished:
                replaced = len(held)
            if replaced is not None:
                break
            wanted *= 2
        self._replace(leaf, index, replaced, pieces)

    def _replace(self, leaf: int, index: int, replaced: int, pieces: list[str]) -> None:
        counts = self.counter.counts(pieces)
        self.reencoded += len(pieces)
        first = leaf
        while replaced:
            own, numbers = self.leaves[leaf]
            here = min(replaced, len(own) - index)
            del own[index : index + here], numbers[index : index + here]
            replaced -= here
            if leaf != first:
                self._update(leaf)
            if replaced:
                leaf, index = leaf + 1, 0
                if leaf - 1 == first:
                    cut = len(self.leaves[first][0])
        own, numbers = self.leaves[first]
        at = index if leaf == first else cut
        own[at:at], numbers[at:at] = pieces, counts
        self._update(first)

    def text(self) -> str:
        return "".join(piece for pieces, _ in self.leaves for piece in pieces)


def count_one(text: str | None, edits: list | None, counter: Counter) -> tuple:
    """Figures of one document before and after its edits."""
    tree = Tree(text or "", counter)
    chars, tokens = tree.chars[1], tree.tokens[1]
    pretokens = sum(len(pieces) for pieces, _ in tree.leaves)
    edits = [] if edits is None else list(edits)
    last = 0
    for edit in edits:
        if edit["start"] < last:
            raise ValueError("edits overlap or are out of order")
        last = edit["end"]
    # From the last to the first, so that places before an edit stay what they were.
    for edit in reversed(edits):
        tree.edit(edit["start"], edit["end"], edit["text"] or "")
    return chars, pretokens, tokens, len(edits), tree.chars[1], tree.tokens[1], tree.reencoded


def counts(
    docs: DataFrame, edits: Column, keep: list[str], vocabulary: dict[bytes, int]
) -> DataFrame:
    """The columns `keep` and token counts before and after `edits` for every row.

    `edits` is an array of struct(start, end, text) in characters of the text as it stands. A
    kept column named like a count comes out with `_input` after its name.
    """
    shared = send(docs.sparkSession, vocabulary)

    @F.pandas_udf(RESULT)
    def counted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        counter = Counter(pickle.loads(shared.value))
        names = [column.split()[0] for column in RESULT.split(", ")]
        for texts, changes in batches:
            rows = [count_one(t, e, counter) for t, e in zip(texts.tolist(), changes.tolist())]
            yield pd.DataFrame(rows, columns=names)

    made = [column.split()[0] for column in RESULT.split(", ")]
    own = [quoted(name).alias(free_name(name, made)) for name in keep]
    return docs.select(F.struct(*own).alias("own"), counted(F.col("text"), edits).alias("c")).select(
        "own.*", "c.*"
    )


def spread_edits(text: Column) -> Column:
    """Three edits at the quarters of a text: a cut, an insertion and a replacement.

    A text under 48 characters gets the insertion in its middle only.
    """
    n = F.coalesce(F.length(text), F.lit(0))

    def edit(start: Column, end: Column, content: str) -> Column:
        return F.struct(
            start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(content).alias("text")
        )

    quarter, middle, last = F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4)
    insertion = edit(middle, middle, " [one more note] ")
    return F.when(
        n >= 48,
        F.array(
            edit(quarter, quarter + 12, ""), insertion, edit(last, last + 6, "their own words")
        ),
    ).otherwise(F.array(insertion))

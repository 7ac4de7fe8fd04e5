"""A linear-chain conditional random field over the words of a text, in numpy.

Labels are languages. A word's score for a language is the sum of the weights of its features: affixes
of one to four letters, n-grams of two and three letters with word boundaries, the word
itself, and the set of languages whose lexicon holds it. Features are hashed into
`BUCKETS`. Learned transitions join neighbouring words; forward-backward gives the probability of each
language for each word.

Texts are worked off as lanes of at most `LANE` words, many at once. A text of several lanes is
exact all the same: the product of a lane's transitions says what it passes on to its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np

WORD = re.compile(r"[^\W\d_]{1,24}")
BUCKETS = 1 << 16
LANE = 128
# Lanes of one pass, words of one group of texts, words kept in the cache.
LANES = 2048
GROUP_WORDS = 200_000
CACHE_WORDS = 400_000
LONG_TEXT = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with marks for both ends, one row per word, and the lengths with marks."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.zeros((len(words), int(sizes.max(initial=2))), np.uint64)
    codes[np.arange(codes.shape[1])[None, :] < sizes[:, None]] = flat
    return codes, sizes


def _bucket(values: np.ndarray, kind: int) -> np.ndarray:
    mixed = (values + np.uint64(kind)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIX) >> np.uint64(48)).astype(np.int32)


def word_hashes(words: list[str]) -> np.ndarray:
    codes, sizes = _codes(words)
    total = np.zeros(len(words), np.uint64)
    for at in range(codes.shape[1]):
        total = np.where(at < sizes, (total ^ codes[:, at]) * _STEP + _MIX, total)
    return total


def features(words: list[str], lexicon: "Lexicon") -> np.ndarray:
    """Buckets of every word; places without a feature hold `BUCKETS`, whose weights are zero."""
    codes, sizes = _codes(words)
    width, columns = codes.shape[1], []
    inner = sizes - 2

    def add(values: np.ndarray, kind: int, there: np.ndarray) -> None:
        columns.append(np.where(there, _bucket(values, kind), BUCKETS))

    for n in (2, 3):
        gram = np.zeros((len(words), max(0, width - n + 1)), np.uint64)
        for k in range(n):
            gram = gram * _STEP + codes[:, k : k + gram.shape[1]]
        there = np.arange(gram.shape[1])[None, :] + n <= sizes[:, None]
        columns.append(np.where(there, _bucket(gram, n), BUCKETS))
    rows = np.arange(len(words))
    head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for n in range(1, 5):
        there = inner >= n
        head = head * _STEP + codes[:, min(n, width - 1)]
        tail = tail * _STEP + codes[rows, np.maximum(sizes - 1 - n, 0)]
        add(head, 16 + n, there)
        add(tail, 32 + n, there)
    every = np.ones(len(words), bool)
    whole = word_hashes(words)
    add(whole, 48, every)
    add(lexicon.sets_of(whole), 64, every)
    return np.column_stack(columns).astype(np.int32)


@dataclass
class Lexicon:
    """Sorted hashes of words, and for each a hash of the set of languages that use it."""

    known: np.ndarray
    sets: np.ndarray

    def sets_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.uint64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.sets[at], 0).astype(np.uint64)


def lexicon_of(runs: list[tuple[list[str], int]], least: int = 2) -> Lexicon:
    """Words that a language has in at least `least` of the runs (words, language)."""
    seen: dict[tuple[str, int], int] = {}
    for words, language in runs:
        for word in set(words):
            seen[word, language] = seen.get((word, language), 0) + 1
    sets: dict[str, int] = {}
    for (word, language), number in sorted(seen.items()):
        if number >= least:
            sets[word] = (sets.get(word, 0) * 1_000_003 + language + 1) % (1 << 61)
    if not sets:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    known = word_hashes(list(sets))
    order = np.argsort(known)
    return Lexicon(known[order], np.array(list(sets.values()), np.uint64)[order])


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + 1, languages)
    transitions: np.ndarray
    start: np.ndarray
    lexicon: Lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the scores of every language, the best of a word scaled to 1."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), 4096):
            part = [w.lower()[:24] for w in words[at : at + 4096]]
            scores = self.weights[features(part, self.lexicon)].sum(1)
            out[at : at + 4096] = np.exp(scores - scores.max(1, keepdims=True))
        return np.maximum(out, 1e-30)


def _scaled(vector: np.ndarray) -> np.ndarray:
    return vector / vector.sum(-1, keepdims=True)


def log_likelihood(
    emissions: np.ndarray, labels: np.ndarray, transitions: np.ndarray, start: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of equally long sequences (steps, sequences, languages): its value and its gradients.

    `emissions` are scores. Gradients are of the emissions, the transitions and the start.
    """
    steps, number, kinds = emissions.shape
    top = emissions.max(2, keepdims=True)
    local, chain = np.exp(emissions - top), np.exp(transitions)
    alpha, scale = np.empty_like(local), np.empty((steps, number, 1))
    now = np.exp(start) * local[0]
    for t in range(steps):
        if t:
            now = (alpha[t - 1] @ chain) * local[t]
        scale[t] = now.sum(1, keepdims=True)
        alpha[t] = now / scale[t]
    beta = np.ones((number, kinds))
    marginal, pairs = np.empty_like(local), np.zeros((kinds, kinds))
    for t in range(steps - 1, -1, -1):
        marginal[t] = alpha[t] * beta
        if t:
            ahead = local[t] * beta / scale[t]
            pairs += alpha[t - 1].T @ ahead
            beta = ahead @ chain.T
    pairs *= chain
    given = np.eye(kinds)[labels]
    path = (emissions * given).sum() + transitions[labels[:-1], labels[1:]].sum() + start[labels[0]].sum()
    value = path - (np.log(scale) + top).sum()
    seen = np.zeros((kinds, kinds))
    np.add.at(seen, (labels[:-1].ravel(), labels[1:].ravel()), 1)
    return value, given - marginal, seen - pairs, (given[0] - marginal[0]).sum(0)


def train(
    runs: list[tuple[list[str], int]],
    languages: list[str],
    epochs: int = 3,
    length: int = 64,
    batch: int = 64,
    stay: int = 12,
    rate: float = 0.2,
    decay: float = 1e-5,
    seed: int = 11,
) -> Crf:
    """Fit on runs of words of one language each, put together to code-switched sequences.

    Stretches of about `stay` words follow each other, each of a random language. Every other
    run feeds the lexicon only, so the field learns how far a lexicon can be trusted on
    texts that did not make it.
    """
    kinds = len(languages)
    lexicon = lexicon_of(runs[::2] or runs)
    weights = np.zeros((BUCKETS + 1, kinds))
    transitions, start = np.zeros((kinds, kinds)), np.zeros(kinds)
    used = runs[1::2] or runs
    by_language = [[words for words, own in used if own == k] or [w for w, own in runs if own == k] for k in range(kinds)]
    vocabulary: dict[str, int] = {}
    ids = [
        [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]) for words in own]
        for own in by_language
    ]
    if kinds < 2:
        return Crf(languages, weights.astype(np.float32), transitions, start, lexicon)
    table = features(list(vocabulary), lexicon)
    random = np.random.default_rng(seed)
    total = sum(len(run) for own in ids for run in own)
    rounds = max(20, epochs * total // (length * batch))
    # Adagrad: sums of squared gradients.
    moved = [np.full(x.shape, 1e-6) for x in (weights, transitions, start)]
    for _ in range(rounds):
        words = np.empty((length, batch), np.int64)
        labels = np.empty((length, batch), np.int64)
        for row in range(batch):
            at = 0
            while at < length:
                kind = int(random.integers(kinds))
                run = ids[kind][int(random.integers(len(ids[kind])))]
                size = min(int(random.geometric(1 / stay)), length - at, len(run))
                first = int(random.integers(len(run) - size + 1))
                words[at : at + size, row] = run[first : first + size]
                labels[at : at + size, row] = kind
                at += size
        found = table[words.ravel()]
        scores = weights[found].sum(1).reshape(length, batch, kinds)
        _, by_word, by_pair, by_start = log_likelihood(scores, labels, transitions, start)
        flat, width = found.ravel(), found.shape[1]
        by_word = by_word.reshape(-1, kinds)
        gradient = np.column_stack(
            [np.bincount(flat, np.repeat(by_word[:, k], width), BUCKETS + 1) for k in range(kinds)]
        )
        gradient[BUCKETS] = 0
        steps = (gradient - decay * batch * weights, by_pair - transitions, by_start - start)
        for value, step, past in zip((weights, transitions, start), steps, moved):
            past += step * step
            value += rate * step / np.sqrt(past)
        weights[BUCKETS] = 0
    return Crf(languages, weights.astype(np.float32), transitions, start, lexicon)


class Words(dict):
    """Numbers of words; a new word takes the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _numbers(text: str, known: Words) -> np.ndarray:
    if len(text) <= LONG_TEXT:
        found = WORD.findall(text)
        return np.fromiter(map(known.__getitem__, found), np.int32, len(found))
    matches, parts = WORD.finditer(text), []
    while part := [known[m.group()] for m in islice(matches, 100_000)]:
        parts.append(np.array(part, np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Lanes:
    """Texts of the given numbers of words, cut into lanes of at most `LANE` words."""

    def __init__(self, sizes: np.ndarray):
        self.count = -(-sizes // LANE)
        self.text = np.repeat(np.arange(len(sizes)), self.count)
        self.first = np.cumsum(self.count) - self.count
        self.turn = np.arange(len(self.text)) - self.first[self.text]
        self.begin = (np.cumsum(sizes) - sizes)[self.text] + self.turn * LANE
        self.size = np.minimum(sizes[self.text] - self.turn * LANE, LANE)

    def slabs(self, lanes: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Lanes, longest first, with the number of those longer than 0, 1, 2 ... words."""
        order = lanes[np.argsort(-self.size[lanes], kind="stable")]
        for at in range(0, len(order), LANES):
            slab = order[at : at + LANES]
            down = -self.size[slab]
            yield slab, np.searchsorted(down, -np.arange(self.size[slab[0]]), "left").tolist()


def posteriors(
    lanes: Lanes, words: np.ndarray, table: np.ndarray, transitions: np.ndarray, start: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Forward-backward over the lanes; yields (lanes, places in `words`, probabilities).

    `words` are the word numbers of all texts in a row, `table` the emissions of a word number.
    """
    kinds, begin = table.shape[1], lanes.begin
    chain = np.exp(transitions)
    # The first lane of a text is entered by the start, later ones by a transition.
    enter = np.where((lanes.turn == 0)[:, None, None], np.eye(kinds), chain)
    # What a lane of a longer text makes of the probabilities that enter it.
    several = np.flatnonzero(lanes.count[lanes.text] > 1)
    product = np.empty((len(several), kinds, kinds))
    slot = np.full(len(lanes.text), -1)
    slot[several] = np.arange(len(several))
    for slab, active in lanes.slabs(several):
        now = enter[slab] * table[words[begin[slab]]][:, None, :]
        for t, n in enumerate(active[1:], 1):
            step = (now[:n] @ chain) * table[words[begin[slab[:n]] + t]][:, None, :]
            now[:n] = step / step.sum((1, 2), keepdims=True)
        product[slot[slab]] = now / now.sum((1, 2), keepdims=True)
    entering = np.tile(_scaled(np.exp(start)), (len(lanes.text), 1))
    leaving = np.ones((len(lanes.text), kinds))
    most = int(lanes.count.max(initial=0))
    for r in range(1, most):
        own = lanes.first[lanes.count > r] + r
        entering[own] = _scaled(np.einsum("ni,nij->nj", entering[own - 1], product[slot[own - 1]]))
    for r in range(most - 1, 0, -1):
        own = lanes.first[lanes.count > r] + r
        leaving[own - 1] = _scaled(np.einsum("nij,nj->ni", product[slot[own]], leaving[own]))

    for slab, active in lanes.slabs(np.arange(len(lanes.text))):
        forward, local = [], []
        now = np.einsum("ni,nij->nj", entering[slab], enter[slab])
        for t, n in enumerate(active):
            now = now[:n] @ chain if t else now
            local.append(table[words[begin[slab[:n]] + t]])
            now = _scaled(now * local[t])
            forward.append(now)
        back = leaving[slab]
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if t + 1 < len(active):
                more = active[t + 1]
                back[:more] = _scaled((local[t + 1] * back[:more]) @ chain.T)
            yield slab[:n], begin[slab[:n]] + t, _scaled(forward[t] * back[:n])


class Labeller:
    """Labels texts with a field; keeps the emissions of words it has met, up to a bound."""

    def __init__(self, field: Crf):
        self.field = field
        self._forget()

    def _forget(self) -> None:
        self.known = Words()
        self.table = np.zeros((0, len(self.field.languages)), np.float32)
        self.letters = np.zeros(0, np.int32)

    def _learn(self) -> None:
        new = list(islice(self.known, len(self.table), None))
        if new:
            self.table = np.concatenate((self.table, self.field.emissions(new)))
            letters = np.array([sum(map(str.isalpha, w)) for w in new], np.int32)
            self.letters = np.concatenate((self.letters, letters))

    def _groups(self, texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(number of the first text, word numbers of some texts); words without letters left out."""
        first, held, words = 0, [], 0
        for number, text in enumerate(texts):
            held.append(_numbers(text, self.known) if text else np.zeros(0, np.int32))
            words += len(held[-1])
            if words >= GROUP_WORDS or number + 1 == len(texts):
                self._learn()
                yield first, [t[self.letters[t] > 0] for t in held]
                first, held, words = number + 1, [], 0
                if len(self.known) > CACHE_WORDS:
                    self._forget()

    def _labelled(self, group: list[np.ndarray]):
        lanes, words = Lanes(np.array([len(t) for t in group])), np.concatenate(group)
        field = self.field
        return lanes, words, posteriors(lanes, words, self.table, field.transitions, field.start)

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Per text the mean probability of every language over its letters; no letters: zeros."""
        out = np.zeros((len(texts), len(self.field.languages)))
        for first, group in self._groups(texts):
            lanes, words, found = self._labelled(group)
            sums = np.zeros((len(lanes.text), out.shape[1]))
            for lane, place, here in found:
                sums[lane] += here * self.letters[words[place], None]
            own = out[first : first + len(group)]
            np.add.at(own, lanes.text, sums)
            total = own.sum(1, keepdims=True)
            np.divide(own, total, out=own, where=total > 0)
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """Per text its stretches of one likeliest language: (start, end, language, mean probability)."""
        out = []
        for first, group in self._groups(texts):
            lanes, words, found = self._labelled(group)
            best, sure = np.zeros(len(words), int), np.zeros(len(words))
            for _, place, here in found:
                best[place] = here.argmax(1)
                sure[place] = here.max(1)
            at = 0
            for number, own in enumerate(group):
                stretches: list[list] = []
                matches = (m for m in WORD.finditer(texts[first + number] or "") if any(map(str.isalpha, m.group())))
                for match, kind, score in zip(matches, best[at : at + len(own)], sure[at : at + len(own)]):
                    if stretches and stretches[-1][2] == kind:
                        stretches[-1][1] = match.end()
                        stretches[-1][3].append(score)
                    else:
                        stretches.append([match.start(), match.end(), kind, [score]])
                at += len(own)
                out.append(
                    [(s, e, self.field.languages[k], float(np.mean(p))) for s, e, k, p in stretches]
                )
        return out

"""A cover tree for inner products, over points lifted to equal norms.

With M the largest norm, a point x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0). All
lifted points have norm M, so the squared distance is |q|^2 + M^2 - 2 qx: near means a high
inner product. A node holds a centre and its covering radius; by the triangle inequality every
product under it lies between those of distances d - r and d + r.

A node is split by farthest-first centres until each of its points is within 1 / `BASE` of its
radius, or `FANOUT` centres are there; centres are farther apart than the radius they reach.
Stored radii are the true ones. A node of at most `LEAF` points is a leaf.

Products are compared as whole numbers: by floating point where all sums are below 2**53 and thus
exact, by 64-bit numbers below 2**63, by Python's numbers beyond.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

BASE = 1.3
FANOUT = 32
LEAF = 256


def exact_kind(points: np.ndarray, query_most: int = 0) -> np.ndarray:
    """`points` (whole numbers) in the fastest type that keeps inner products exact."""
    most = max(int(abs(points).max()) if points.size else 0, query_most)
    bound = most * most * max(1, points.shape[1])
    if bound < 1 << 53:
        return points.astype(np.float64)
    return points.astype(np.int64 if bound < 1 << 63 else object)


def distances(points: np.ndarray, norm2: float, centre: np.ndarray) -> np.ndarray:
    """Between lifted points (rows that include the lift) and one lifted centre."""
    return np.sqrt(np.maximum(2 * norm2 - 2 * (points @ centre), 0))


def lifted(points: np.ndarray, norm2: float | None = None) -> tuple[np.ndarray, float]:
    """The points with their further component, and M^2."""
    plain = points.astype(np.float64)
    own = (plain * plain).sum(1)
    norm2 = float(own.max(initial=0)) if norm2 is None else norm2
    return np.column_stack((plain, np.sqrt(np.maximum(norm2 - own, 0)))), norm2


@dataclass
class CoverTree:
    norm2: float
    # Per node: centre, covering radius, its children (first, end), its points (first, end).
    centres: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    span: np.ndarray
    # Points in the order of the leaves: row numbers, and exact components.
    order: np.ndarray
    points: np.ndarray

    def bounds(self, query: np.ndarray, own: float, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product of the query with anything under these nodes."""
        whole = own + self.norm2
        away = np.sqrt(np.maximum(whole - 2 * (self.centres[first:end] @ query), 0))
        slack = 1e-6 * (1 + np.sqrt(whole))
        radius = self.radius[first:end] + slack
        low = (whole - (away + radius) ** 2) / 2
        return low, (whole - np.maximum(away - radius, 0) ** 2) / 2


def build(points: np.ndarray, query_most: int = 0) -> CoverTree:
    """The tree over rows of whole numbers; `query_most` bounds the components of queries."""
    high, norm2 = lifted(points)
    every = np.arange(len(points))
    centres, radius, children, span = [0], [0.0], [(0, 0)], [(0, 0)]
    if len(points):
        radius[0] = float(distances(high, norm2, high[0]).max())
    order = np.empty(len(points), np.int64)
    # Node and its points; points of a node are a stretch of the final order.
    waiting = [(0, every, 0)]
    while waiting:
        node, own, start = waiting.pop()
        span[node] = (start, start + len(own))
        order[start : start + len(own)] = own
        if len(own) <= LEAF or radius[node] <= 1e-6 * (1 + np.sqrt(norm2)):
            continue
        rows = high[own]
        away, owner, chosen = distances(rows, norm2, high[centres[node]]), np.zeros(len(own), int), [centres[node]]
        while len(chosen) < FANOUT and away.max() > radius[node] / BASE:
            chosen.append(own[int(away.argmax())])
            nearer = distances(rows, norm2, high[chosen[-1]])
            owner[nearer < away] = len(chosen) - 1
            away = np.minimum(away, nearer)
        first = len(centres)
        for number, centre in enumerate(chosen):
            held = owner == number
            if not held.any():
                continue
            part = own[held]
            waiting.append((len(centres), part, start))
            start += len(part)
            centres.append(centre)
            radius.append(float(away[held].max()))
            children.append((0, 0))
            span.append((0, 0))
        children[node] = (first, len(centres))
        if len(centres) - first < 2:
            # Equal up to rounding: a leaf.
            children[node] = (0, 0)
            waiting = [w for w in waiting if w[0] < first]
    plain = points.astype(np.float64)
    return CoverTree(
        norm2,
        plain[centres] if len(points) else plain,
        np.array(radius),
        np.array(children),
        np.array(span),
        order,
        exact_kind(points, query_most)[order],
    )


def search(
    tree: CoverTree,
    query: np.ndarray,
    allowed: np.ndarray,
    ids: list,
    skip: object,
    windows: list[tuple],
    take: int,
) -> list[list[tuple[int, object]]]:
    """Per window (low, high), the first `take` (score, id) with low <= score <= high.

    Higher scores first, then smaller ids. `allowed` marks the rows that count, `ids` has the ids of
    a row in ascending order, `skip` is an id that does not count. Nodes are opened in the order of
    their upper bounds; one is left unopened only if it lies outside every window, or under
    the last score of every window that is full.
    """
    found: list[list] = [[] for _ in windows]
    if not len(tree.order):
        return found
    exact = query.astype(tree.points.dtype)
    plain = query.astype(np.float64)
    own = float(plain @ plain)
    # The least score that still counts, per window; Python's numbers, which are exact.
    floor = [low for low, _ in windows]
    top = max(high for _, high in windows)
    low, up = tree.bounds(plain, own, 0, 1)
    heap = [(-up[0], 0, low[0])]
    while heap:
        up, node, low = heapq.heappop(heap)
        lowest = min(floor)
        if -up < lowest:
            break
        if not any(-up >= least and low <= high for least, (_, high) in zip(floor, windows)):
            continue
        first, end = tree.children[node]
        if end > first:
            lows, ups = tree.bounds(plain, own, first, end)
            for at in np.flatnonzero((ups >= lowest) & (lows <= top)).tolist():
                heapq.heappush(heap, (-ups[at], first + at, lows[at]))
            continue
        start, stop = tree.span[node]
        rows = tree.order[start:stop]
        scores = tree.points[start:stop] @ exact
        good = np.flatnonzero(allowed[rows] & (scores >= lowest) & (scores <= top))
        if not len(good):
            continue
        reached = [(int(scores[g]), int(rows[g])) for g in good.tolist()]
        for number, (_, most) in enumerate(windows):
            least = floor[number]
            more = [
                (-score, own_id)
                for score, row in reached
                if least <= score <= most
                for own_id in ids[row]
                if own_id != skip
            ]
            if more:
                found[number] = heapq.nsmallest(take, found[number] + more)
                if len(found[number]) == take:
                    floor[number] = max(least, -found[number][-1][0])
    return [[(-score, own_id) for score, own_id in best] for best in found]

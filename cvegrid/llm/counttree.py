"""A packed R-tree over count vectors, and linking of token sets with its help.

Tokens fall into GROUPS by hash; a set's point is how many of its tokens each group has.  Two
sets share at most the sum, over groups, of the smaller count.  A tree node keeps the largest
count of its points in each group, so the same sum bounds what any of them shares with a query.
"""

from __future__ import annotations

import numpy as np

GROUPS = 64
FANOUT = 16
# Query-node pairs whose bounds are computed at once, in GROUPS groups.
AT_ONCE = 1 << 14
# Candidates that are checked before looking whether their components have met.
FIRST_CHECKED = 8


class CountTree:
    """Points packed by size and by their first groups, 16 to a node, level upon level."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.sizes = points.sum(axis=1)
        many = len(points)
        # Slices by size, then by the counts of the first group, keep nodes tight.
        order = np.argsort(self.sizes, kind="stable")
        slice_ = max(FANOUT, int(np.sqrt(many * FANOUT)))
        parts = [order[k : k + slice_] for k in range(0, many, slice_)]
        self.order = np.concatenate([p[np.lexsort(points[p][:, :3].T)] for p in parts])
        self.levels = [points[self.order]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FANOUT), axis=0))

    def near(self, queries: np.ndarray, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose sets may have the given Jaccard similarity, in hundredths."""
        size = queries.sum(axis=1)
        # Overlap must reach h / (100 + h) of both sizes together, and h / 100 of the larger one.
        at_once = max(1, AT_ONCE * GROUPS // self.points.shape[1])
        asked = np.arange(len(queries))
        nodes = np.zeros(len(queries), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            kept_asked, kept_nodes = [], []
            for start in range(0, len(asked), at_once):
                a, n = asked[start : start + at_once], nodes[start : start + at_once]
                shared = np.minimum(queries[a], self.levels[level][n]).sum(axis=1)
                if level:
                    # A point below can be no smaller than what it shares.
                    fit = 100 * shared >= hundredths * size[a]
                else:
                    other = self.sizes[self.order[n]]
                    fit = (100 + hundredths) * shared >= hundredths * (size[a] + other)
                kept_asked.append(a[fit])
                kept_nodes.append(n[fit])
            asked, nodes = np.concatenate(kept_asked), np.concatenate(kept_nodes)
            if level:
                below = len(self.levels[level - 1])
                children = nodes[:, None] * FANOUT + np.arange(FANOUT)
                exist = children < below
                asked, nodes = np.repeat(asked, FANOUT).reshape(children.shape)[exist], children[exist]
        return asked, self.order[nodes]


def points_of(sets: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    """Group counts of sets of hashed tokens; the number of groups is a power of two."""
    sizes = np.array([len(s) for s in sets])
    group = (np.concatenate(sets) & np.uint64(groups - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    counts = np.bincount(owner * groups + group, minlength=len(sets) * groups)
    return counts.reshape(len(sets), groups).astype(np.int32)


class Components:
    """Smallest label of joined labels."""

    def __init__(self, labels: list[int]) -> None:
        self.up = {label: label for label in labels}

    def root(self, label: int) -> int:
        while self.up[label] != label:
            self.up[label] = self.up[self.up[label]]
            label = self.up[label]
        return label

    def join(self, one: int, other: int) -> None:
        one, other = self.root(one), self.root(other)
        self.up[max(one, other)] = min(one, other)


def _pairs(tree: CountTree, points: np.ndarray, hundredths: int, side: np.ndarray | None):
    """Pairs that the tree leaves, each once, for some queries at a time."""
    for start in range(0, len(points), 256):
        asked, other = tree.near(points[start : start + 256], hundredths)
        asked = asked + start
        keep = asked < other if side is None else side[asked] < side[other]
        yield asked[keep], other[keep]


def _merged(least: np.ndarray, one: np.ndarray, other: np.ndarray) -> None:
    """Join points in place; each names the least point of its cluster."""
    while True:
        a, b = least[one], least[other]
        apart = a != b
        if not apart.any():
            return
        one, other, a, b = one[apart], other[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least[:] = least[least]


def possible(points: np.ndarray, labels: list[int], hundredths: int, sides: list[int] | None = None) -> np.ndarray:
    """Of each point the least one of its cluster, -1 if it is in none.

    Clusters are joined by pairs of different labels whose sets may be similar enough.
    """
    side = None if sides is None else np.array(sides)
    number, least, met = np.array(labels), np.arange(len(points)), np.zeros(len(points), bool)
    for asked, other in _pairs(CountTree(points), points, hundredths, side):
        apart = number[asked] != number[other]
        one, two = asked[apart], other[apart]
        met[one] = met[two] = True
        _merged(least, one, two)
    return np.where(met, least, -1)


def linked(
    sets: list[np.ndarray], labels: list[int], hundredths: int, sides: list[int] | None = None
) -> Components:
    """Join the labels of all sets that are similar enough; pairs that have met are not checked.

    With sides, only sets of different sides are compared.
    """
    found = Components(labels)
    if len(sets) < 2:
        return found
    points = points_of(sets)
    tree = CountTree(points)
    # Numbers for the tokens, so that a query's tokens are marked once for all its candidates.
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    marked = np.zeros(len(tokens), np.int32)
    side = None if sides is None else np.array(sides)
    for asked, other in _pairs(tree, points, hundredths, side):
        turn = np.argsort(asked, kind="stable")
        asked, other = asked[turn], other[turn]
        for query in np.unique(asked).tolist():
            candidates = other[np.searchsorted(asked, query) : np.searchsorted(asked, query, "right")]
            own = flat[ends[query] - sizes[query] : ends[query]]
            marked[own] = 1
            step = FIRST_CHECKED
            while len(candidates):
                root = found.root(labels[query])
                apart = np.array([found.root(labels[c]) != root for c in candidates.tolist()])
                candidates = candidates[apart]
                part, candidates = candidates[:step], candidates[step:]
                step *= 4
                if not len(part):
                    break
                at = np.repeat(ends[part] - np.cumsum(sizes[part]), sizes[part]) + np.arange(int(sizes[part].sum()))
                shared = np.add.reduceat(marked[flat[at]], np.cumsum(sizes[part]) - sizes[part])
                near = (100 + hundredths) * shared >= hundredths * (sizes[part] + sizes[query])
                for c in part[near].tolist():
                    found.join(labels[query], labels[c])
            marked[own] = 0
    return found

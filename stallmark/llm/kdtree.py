"""K-d trees over vectors of small counts, searched by many queries at once within an L1 distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class KdTree:
    """Halves points along their most varied dimension until at most ``most`` are left, or all are equal.

    A node's box bounds its points or, with ``tight=False``, the whole region that its splits leave (so that points
    which the tree was not built of can be placed). ``leaves`` are arrays of points, or of positions of them.
    """

    def __init__(self, points: np.ndarray, most: int, tight: bool = True):
        d = points.shape[1]
        top = np.iinfo(np.int32).max // 4
        self.low, self.high, self.axis, self.cut, self.children, self.leaf = [], [], [], [], [], []
        self.leaves: list[np.ndarray] = []
        stack = [(np.arange(len(points)), np.zeros(d, np.int32), np.full(d, top, np.int32), -1)]
        while stack:
            own, low, high, above = stack.pop()
            here = points[own]
            node = len(self.low)
            if above >= 0:
                self.children[above].append(node)
            self.low.append(here.min(axis=0) if tight and len(own) else low)
            self.high.append(here.max(axis=0) if tight and len(own) else high)
            self.children.append([])
            axis = int(here.var(axis=0).argmax()) if len(own) > most else 0
            values = here[:, axis]
            if len(own) <= most or (least := values.min()) == values.max():
                self.axis.append(-1)
                self.cut.append(0)
                self.leaf.append(len(self.leaves))
                self.leaves.append(own)
                continue
            # At most the cut goes left. Of the two cuts beside the median, the one that halves more evenly.
            median = int(np.median(values))
            cut = min((c for c in {median, median - 1} if least <= c < values.max()),
                      key=lambda c: abs(2 * int((values <= c).sum()) - len(own)))
            self.axis.append(axis)
            self.cut.append(cut)
            self.leaf.append(-1)
            left = values <= cut
            for side, lows, highs in ((left, low, high), (~left, low, high)):
                lows, highs = lows.copy(), highs.copy()
                if side is left:
                    highs[axis] = cut
                else:
                    lows[axis] = cut + 1
                stack.append((own[side], lows, highs, node))

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point belongs to."""
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, own = stack.pop()
            if self.leaf[node] >= 0:
                out[own] = self.leaf[node]
                continue
            # The stack of the build is last in, first out: the right child came first.
            right, left = self.children[node]
            inside = points[own, self.axis[node]] <= self.cut[node]
            stack += [(left, own[inside]), (right, own[~inside])]
        return out

    def reached(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves whose box comes within the radius of queries, with these queries; other boxes are not entered."""
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, own = stack.pop()
            here = queries[own]
            apart = np.maximum(self.low[node] - here, 0) + np.maximum(here - self.high[node], 0)
            own = own[apart.sum(axis=1) <= radius]
            if len(own):
                if self.leaf[node] >= 0:
                    yield self.leaf[node], own
                else:
                    stack += [(child, own) for child in self.children[node]]

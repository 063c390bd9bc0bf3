"""Sparse matrices as three arrays (compressed rows), and their product row by row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Products summed at once.
AT_ONCE = 1 << 20


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers from each start on, as many as its count, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


@dataclass(frozen=True)
class Csr:
    """Row i has the columns ``indices[indptr[i]:indptr[i + 1]]``, ascending, with the values ``data`` at these places."""
    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int

    @staticmethod
    def of(rows: np.ndarray, columns: np.ndarray, data: np.ndarray, shape: tuple[int, int]) -> Csr:
        """From triples; triples of one place add up."""
        keys, data = summed(rows * shape[1] + columns, data)
        counts = np.bincount(keys // max(1, shape[1]), minlength=shape[0])
        return Csr(np.append(0, np.cumsum(counts)), keys % max(1, shape[1]), data, shape[1])

    @property
    def height(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.height), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.width)
        return Csr(np.append(0, np.cumsum(counts)), self.rows()[order], self.data[order], self.height)

    def times(self, other: Csr) -> Csr:
        """The product: a row is the sum of those rows of ``other`` that its columns name, each times its value.

        Rows are taken in blocks, so memory follows the block and the result, not the number of products.
        """
        each = np.diff(other.indptr)[self.indices]
        ends = np.append(0, np.cumsum(each))[self.indptr]
        parts, at = [], 0
        while at < self.height:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, "right")) - 1)
            own = slice(self.indptr[at], self.indptr[to])
            counts = each[own]
            place = spread(other.indptr[self.indices[own]], counts)
            row = np.repeat(np.repeat(np.arange(at, to), np.diff(self.indptr[at:to + 1])), counts)
            parts.append(summed(row * other.width + other.indices[place], np.repeat(self.data[own], counts) * other.data[place]))
            at = to
        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.int64)
        data = np.concatenate([d for _, d in parts]) if parts else np.zeros(0, np.int64)
        counts = np.bincount(keys // max(1, other.width), minlength=self.height)
        return Csr(np.append(0, np.cumsum(counts)), keys % max(1, other.width), data, other.width)

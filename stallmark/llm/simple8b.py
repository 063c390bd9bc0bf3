"""Simple-8b: unsigned integers packed into 64-bit words, several to a word.

The upper 4 bits of a word are its selector: how many values it holds and how wide each is. The first value lies in the
lowest bits. A value of more than 60 bits is an escape: its word is empty, the value itself stands in a list after all
words, in order. A packed block begins with a header and, for each frame of FRAME words, the number of values and of
escapes before it; so a part of a block is unpacked without the rest.

Packing takes the densest selector that fits at each place; unpacking handles all words of a selector at once.
"""

from __future__ import annotations

import struct

import numpy as np

# Values in a word by selector, the escape first; their widths in bits follow.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, *(60 // COUNTS[1:])])
MAGIC = b"S8B1"
#: Magic, number of values, words and escapes.
HEADER = struct.Struct("<4sQQQ")
FRAME = 512
_LIMITS = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)
_SHIFTS = [np.arange(c, dtype=np.uint64) * np.uint64(w) for c, w in zip(COUNTS, WIDTHS)]
_TOP = np.uint64(60)


def _selectors(values: np.ndarray) -> np.ndarray:
    """The densest selector that fits from each value on."""
    n = len(values)
    # Selector of the narrowest width for each value; one beyond the last is an escape.
    need = np.searchsorted(_LIMITS, values, "right") + 1
    chosen = np.where(need > 14, 0, 14)
    for selector in range(13, int(need.min(initial=14)) - 1, -1):
        count = int(COUNTS[selector])
        if count <= n:
            wider = np.append(0, np.cumsum(need > selector))
            fits = np.flatnonzero(wider[count:] == wider[:n - count + 1])
            if not len(fits):
                break
            chosen[fits] = selector
    return chosen


def words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words and the escapes of unsigned ``values``."""
    values = np.ascontiguousarray(values, np.uint64)
    chosen = _selectors(values)
    steps, starts, at = COUNTS[chosen].tolist(), [], 0
    while at < len(steps):
        starts.append(at)
        at += steps[at]
    first = np.array(starts, np.int64)
    selector = chosen[first] if len(first) else np.zeros(0, np.int64)
    out = selector.astype(np.uint64) << _TOP
    for s in np.unique(selector[selector > 0]):
        own = np.flatnonzero(selector == s)
        parts = values[first[own][:, None] + np.arange(COUNTS[s])] << _SHIFTS[s]
        out[own] |= np.bitwise_or.reduce(parts, axis=1)
    return out, values[first[selector == 0]]


def values(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """What ``words`` and ``escapes`` hold."""
    selector = (words >> _TOP).astype(np.int64)
    ends = np.cumsum(COUNTS[selector])
    first = ends - COUNTS[selector]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            out[first[own][:, None] + np.arange(COUNTS[s])] = (words[own][:, None] >> _SHIFTS[s]) & mask
        else:
            out[first[own]] = escapes
    return out


def pack(found: np.ndarray) -> bytes:
    """One block of unsigned integers, of any number."""
    packed, escapes = words(found)
    selector = (packed >> _TOP).astype(np.int64)
    before = np.stack([np.append(0, np.cumsum(COUNTS[selector]))[:-1], np.append(0, np.cumsum(selector == 0))[:-1]], axis=1)
    return b"".join([HEADER.pack(MAGIC, len(found), len(packed), len(escapes)), before[::FRAME].astype("<u8").tobytes(),
                     packed.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def unpack(block: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The values of a block, or those from ``start`` up to ``stop``: only the frames that hold them are read."""
    magic, n, n_words, n_escapes = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a packed block")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint64)
    frames = -(-n_words // FRAME)
    index = np.frombuffer(block, "<u8", 2 * frames, HEADER.size).reshape(-1, 2).astype(np.int64)
    at = HEADER.size + 16 * frames
    packed = np.frombuffer(block, "<u8", n_words, at)
    escapes = np.frombuffer(block, "<u8", n_escapes, at + 8 * n_words)
    low = int(np.searchsorted(index[:, 0], start, "right")) - 1
    high = int(np.searchsorted(index[:, 0], stop, "left"))
    last = int(index[high, 1]) if high < frames else n_escapes
    found = values(packed[low * FRAME:high * FRAME], escapes[index[low, 1]:last])
    base = int(index[low, 0])
    return found[start - base:stop - base]

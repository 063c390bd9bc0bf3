"""The dynamic programme over prefixes for many pre-tokens at once, as arrays.

All pre-tokens go ahead one byte at a time. The automaton's state is the longest end of the prefix that begins a token; it names
the longest token that ends there, and each token names the next shorter one. The first that is compatible with the last token
of the prefix before it is kept. Going back from the ends gives the ids.
"""

from __future__ import annotations

import numpy as np

#: Log of the number of remembered pairs.
PAIR_BITS = 18
#: Bytes of pre-tokens handled at once.
BLOCK = 1 << 18
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` would stand in the sorted ``keys``, and whether it does. ``keys`` end with one above all that is wanted."""
    at = np.searchsorted(keys, wanted)
    return at, keys[at] == wanted


class Prefixes:
    """Ids of pre-tokens by automaton and pair test. Tokens must each come of one merge at most, and be ids below 2 ** 31."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[int, int], whole: frozenset[int], pair_bits: int = PAIR_BITS):
        n = max(tokens.values()) + 1
        self.size = np.zeros(n, np.int32)
        self._automaton({t: i for t, i in tokens.items() if i in whole}, n)
        low, never = (1 << 32) - 1, np.iinfo(np.int64).max
        pairs = np.fromiter(merges, np.int64, len(merges))
        found = np.fromiter(merges.values(), np.int64, len(merges))
        order = np.argsort(pairs)
        self.pairs, self.rank = np.append(pairs[order], never), np.append(found[order] >> 32, never)
        # Rank of the merge that makes each token, -1 if none, and what it merges.
        self.made, self.left, self.right = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        made = found & low
        self.made[made], self.left[made], self.right[made] = found >> 32, pairs >> 32, pairs & low
        self.shift = np.uint64(64 - pair_bits)
        self.asked, self.answer = np.full(1 << pair_bits, -1), np.zeros(1 << pair_bits, bool)

    def _automaton(self, tokens: dict[bytes, int], n: int) -> None:
        """States are prefixes of tokens, shorter ones first; state k > 0 is made by edge k - 1: state before << 8 | byte."""
        data = np.frombuffer(b"".join(tokens), np.uint8)
        ids = np.fromiter(tokens.values(), np.int64, len(tokens))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.size[ids] = sizes
        starts, at = np.cumsum(sizes) - sizes, np.zeros(len(ids), np.int64)
        none = np.zeros(0, np.int64)
        self.edges, self.fails, self.ends = none, np.zeros(1, np.int32), np.full(1, -1, np.int32)
        #: The longest shorter token that each token ends with.
        self.shorter = np.full(n, -1, np.int32)
        for depth in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > depth)
            edges, place = np.unique(at[live] << 8 | data[starts[live] + depth], return_inverse=True)
            before = len(self.edges)
            at[live] = place + before + 1
            fails = self._step(self.fails[edges >> 8], edges & 255) if depth else np.zeros(len(edges), np.int32)
            self.edges = np.concatenate([self.edges, edges])
            ends, done = self.ends[fails], live[sizes[live] == depth + 1]
            own = at[done] - before - 1
            self.shorter[ids[done]] = ends[own]
            ends[own] = ids[done]
            self.fails, self.ends = np.append(self.fails, fails), np.append(self.ends, ends)
        self.edges = np.append(self.edges, np.iinfo(np.int64).max)
        # Most steps stand in a table: those from states that begin a token with a byte or two.
        near = int(np.searchsorted(self.edges, 257 << 8))
        self.first = np.zeros((min(near, 256) + 1) << 8, np.int32)
        self.first[:] = self._step(np.repeat(np.arange(len(self.first) >> 8), 256), np.tile(np.arange(256), len(self.first) >> 8))

    def _step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The states after one byte more."""
        out = np.zeros(len(states), np.int32)
        open_, states, data = np.arange(len(states)), states.astype(np.int64), data.astype(np.int64)
        while len(open_):
            wanted = states << 8 | data
            at = np.searchsorted(self.edges, wanted)
            hit = self.edges[np.minimum(at, len(self.edges) - 1)] == wanted
            out[open_[hit]] = at[hit] + 1
            rest = ~hit & (states > 0)
            open_, states, data = open_[rest], self.fails[states[rest]].astype(np.int64), data[rest]
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two tokens side by side stay apart, for pairs of tokens.

        Going back in time, the one made later is undone. What then lies at the border must not have a merge that comes before
        the one undone; of equal merges the left one comes first.
        """
        out = np.zeros(len(left), bool)
        open_, limit = np.arange(len(left)), np.full(len(left), np.iinfo(np.int64).max)
        while len(open_):
            at, hit = _find(self.pairs, left << 32 | right)
            stays = ~hit | (self.rank[at] >= limit)
            open_, left, right = open_[stays], left[stays], right[stays]
            before, after = self.made[left], self.made[right]
            whole = (before < 0) & (after < 0)
            out[open_[whole]] = True
            undone = ~whole
            open_, left, right, before, after = (x[undone] for x in (open_, left, right, before, after))
            later = before > after
            limit = np.where(later, before, after + 1)
            left, right = np.where(later, self.right[left], left), np.where(later, right, self.left[right])
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits``, remembered: a new pair takes the place of an old one."""
        pair = left.astype(np.int64) << 32 | right
        place = (pair.view(np.uint64) * SPREAD >> self.shift).view(np.int64)
        missing = np.flatnonzero(self.asked[place] != pair)
        out = self.answer[place]
        if len(missing):
            new, index = np.unique(pair[missing], return_inverse=True)
            found = self.fits(new >> 32, new & ((1 << 32) - 1))
            out[missing] = found[index]
            slot = place[missing]
            # Of pairs for one place the last stays, in both arrays.
            self.asked[slot] = pair[missing]
            mine = self.asked[slot] == pair[missing]
            self.answer[slot[mine]] = found[index][mine]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """32-bit ids of each pre-token."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        out: list[bytes] = [b""] * len(pieces)
        ends, at = np.cumsum(sizes[order]), 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            own = order[at:to]
            places = own.tolist()
            for place, ids in zip(places, self._block(b"".join([pieces[k] for k in places]), sizes[own])):
                out[place] = ids
            at = to
        return out

    def _block(self, joined: bytes, sizes: np.ndarray) -> list[bytes]:
        """Of pieces one after the other, longest first."""
        data = np.frombuffer(joined, np.uint8)
        starts, last = np.cumsum(sizes) - sizes, np.zeros(len(data), np.int32)
        state = np.zeros(len(sizes), np.int32)
        lives = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left").tolist()
        for done, live in enumerate(lives):
            place = starts[:live] + done
            wanted = state[:live].astype(np.int64) << 8 | data[place]
            deep = np.flatnonzero(wanted >= len(self.first))
            wanted_deep = wanted[deep]
            wanted[deep] = 0
            state = self.first[wanted]
            if len(deep):
                state[deep] = self._step(wanted_deep >> 8, wanted_deep & 255)
            token = self.ends[state]
            # Tokens that are not the whole prefix must be compatible with the last token before them.
            open_ = np.flatnonzero(self.size[token] <= done)
            while len(open_):
                tried = token[open_]
                fit = self.compatible(last[place[open_] - self.size[tried]], tried)
                open_ = open_[~fit]
                token[open_] = self.shorter[token[open_]]
                if len(open_) and token[open_].min() < 0:
                    raise ValueError("a byte is no token of the vocabulary")
            last[place] = token
        # Back from the ends: the last tokens of the prefixes that the encoding goes through.
        some = sizes > 0
        through, at, left = np.zeros(len(data), bool), (starts + sizes - 1)[some], sizes[some]
        while len(at):
            through[at] = True
            step = self.size[last[at]]
            left = left - step
            at, left = (at - step)[left > 0], left[left > 0]
        ids = last[through].tobytes()
        edges = (4 * np.append(0, np.cumsum(through))[np.append(starts, len(data))]).tolist()
        return [ids[x:y] for x, y in zip(edges, edges[1:])]

"""Texts as chunks between spaces: most chunks occur often, so what is found out about one is remembered."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Give freed memory back to the system: a worker that waits for its next task would hold the most it has ever used."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


#: What this worker has built from vocabularies, with all that it remembers, for later tasks of the same kind.
BUILT: dict[tuple, object] = {}


def forget() -> None:
    BUILT.clear()
    give_back()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], built: bool = False):
    """``run`` over the batches of a task, after which the worker gives back what it has freed. Unless the task works with what
    was ``built``, that of tasks before it goes first."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            forget()
        yield from run(batches)
        give_back()

    return wrapped


class Memory:
    """Values of keys, computed many at once.

    Two generations stay, each of at most ``most`` units (a key weighs its length and a fixed part); what is asked for
    again moves on to the younger one, so frequent keys are never lost. Results do not depend on what is remembered.
    """

    def __init__(self, compute: Callable[[list], Iterable], most: int = 24 << 20, fixed: int = 100):
        self.compute, self.most, self.fixed = compute, most, fixed
        self.young: dict = {}
        self.old: dict = {}
        self.weight = 0

    def ready(self, keys: set) -> dict:
        """A mapping with at least ``keys``."""
        if self.weight > self.most:
            self.old, self.young, self.weight = self.young, {}, 0
        missing = keys.difference(self.young)
        if missing:
            new = missing.difference(self.old)
            if len(new) < len(missing):
                self.young.update((k, self.old[k]) for k in missing - new)
            self.weight += sum(map(len, missing)) + self.fixed * len(missing)
            listed = list(new)
            self.young.update(zip(listed, self.compute(listed)))
        return self.young


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches of about ``most`` bytes of text (one row at least), with the texts in UTF-8; null is empty."""
    for batch in batches:
        texts = batch[text].cast(pa.binary())
        at, n = 0, len(texts)
        while at < n:
            out, size = [], 0
            while at + len(out) < n and size < most:
                value = texts[at + len(out)].as_py() or b""
                size += len(value)
                out.append(value)
            yield batch.slice(at, len(out)), out
            at += len(out)


#: Letters of ASCII and Latin-1, which are letters for every Unicode version and composed, and ASCII marks after them.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

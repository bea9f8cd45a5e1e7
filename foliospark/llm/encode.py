"""Words of whole texts as codes, batch by batch, with Arrow's own kernels: no Python object for a word or a text."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are encoded at once; a longer text is encoded by itself.
CHUNK = 2 << 20


#: What empties the caches that a worker keeps from task to task, by their owner.
CACHES: dict[str, Callable[[], object]] = {}


def tidy(run, owner: str = ""):
    """``run`` over batches, in a worker that other tasks have used and will use.

    Caches of other owners are emptied first; at the end the memory that was
    set free is given back.
    """

    def inner(batches):
        for name, empty in CACHES.items():
            if name != owner:
                empty()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return inner


class Encoded(NamedTuple):
    """Rows ``first`` to ``first + len(ends)`` of a batch: the code of each word in ``words``, and where each row's words end."""

    first: int
    codes: np.ndarray
    ends: np.ndarray
    words: pa.Array

    @property
    def rows(self) -> np.ndarray:
        """The row of each word, from 0."""
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def places(self, of: pa.Array) -> np.ndarray:
        """Where each of ``words`` stands in ``of``, or -1."""
        return np.asarray(pc.fill_null(pc.index_in(self.words, value_set=of), -1)).astype(np.int64)


def blank_words(texts: pa.Array) -> pa.Array:
    """Lists of the runs of anything but ASCII white space, A-Z lower-cased; some may be empty."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def letter_words(texts: pa.Array) -> pa.Array:
    """Lists of the runs of letters, lower-cased; some may be empty."""
    return pc.split_pattern_regex(pc.utf8_lower(texts), pattern=r"\PL+")


def encoded(texts: pa.Array, split) -> Iterator[Encoded]:
    """``texts`` in pieces of about CHUNK bytes; a null text has no words."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        lists = split(texts.slice(first, last - first))
        flat, until = lists.flatten(), np.cumsum(np.asarray(pc.list_value_length(lists)).astype(np.int64))
        some = np.asarray(pc.greater(pc.binary_length(flat), 0))
        if not some.all():
            flat, until = flat.filter(pa.array(some)), np.append(0, np.cumsum(some))[until]
        d = flat.dictionary_encode()
        yield Encoded(first, np.asarray(d.indices).astype(np.int64), until, d.dictionary)
        first = last


class Tally:
    """Sums by integer keys, merged whenever many have come together."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> None:
        self.parts.append((keys, n if n is not None else np.ones(len(keys), np.int64)))
        self.size += len(keys)
        if self.size > self.most:
            keys, n = self.sums()
            self.parts, self.size = [(keys, n)], 0

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(n[order], first) if len(keys) else n

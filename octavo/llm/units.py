"""Texts of an Arrow batch as units between white space, each distinct unit encoded once.

A unit is a run of non-space bytes up to a sign that ends a word, with a single space before it where the tokenizer
attaches that space, or what else a run of white space holds. Tokenizers never merge
across units, so a text's ids are those of its units in order. Cutting, dictionary
encoding and gathering are vectorised; only units not met before reach an encoder.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: bounds a worker's memory whatever the batch holds.
SLICE = 1 << 20
#: Bytes of what a worker remembers, with what Python adds to each entry, and the longest unit remembered.
REMEMBERED, ENTRY, LONGEST = 80 << 20, 130, 64

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Letters and digits of ASCII, and the signs that end a word after them in every pre-tokenizer here (not the
#: apostrophe of contractions, nor what special tokens are written with).
WORD, SIGN, LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
SIGN[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = True
LOWER[65:91] += 32


def tidy(run: Callable) -> Callable:
    """run over a task's batches, which then gives back what the allocators hold: an idle worker lives on beside the next stages."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return tidied


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a binary column: first row, bytes, and row offsets from 0 into them; null is empty."""
    column = pa.chunked_array([column]).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    if column.null_count:  # a null's bytes are not defined
        lens = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        data = np.concatenate([data[a : a + k] for a, k in zip(offsets[:-1], lens, strict=True)] or [data[:0]])
        offsets = np.concatenate(([0], np.cumsum(lens)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def cut(data: np.ndarray, offsets: np.ndarray, attach: bool) -> np.ndarray:
    """Where units begin. attach: a single space belongs to the unit after it, else white space is cut off (and left in units of its own)."""
    if not len(data):
        return np.zeros(0, np.int64)
    white = WHITE[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty_like(white)  # the byte before is white space
    after[1:], after[0] = white[:-1], False
    begins = first | (white & ~after)
    begins[1:] |= SIGN[data[1:]] & WORD[data[:-1]]
    if attach:
        last = np.empty_like(white)  # a non-space byte of the same text follows
        last[:-1], last[-1] = ~white[1:] & ~first[1:], False
        begins |= white & last
        begins[1:] |= after[1:] & ~white[1:] & (data[:-1] != 32)
    else:
        begins |= after & ~white
    return np.flatnonzero(begins)


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The parts flat[starts[i]:starts[i] + lens[i]] for i in take, one after another."""
    n = lens[take]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts[take] - (ends - n), n) + np.arange(ends[-1])]


class Memory:
    """What was made of bytes before: of two generations, so that what is in use outlives a full one."""

    def __init__(self, most: int = REMEMBERED // 2):
        self.most, self.young, self.old, self.size = most, {}, {}, 0

    def look(self, keys: list[bytes]) -> list:
        """The values, None where unknown."""
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        for i, x in enumerate(found):
            if x is None and (y := old.get(keys[i])) is not None:
                found[i] = y
                self.keep(keys[i], y)
        return found

    def keep(self, key: bytes, value) -> None:
        if len(key) <= LONGEST:
            self.young[key] = value
            self.size += ENTRY + len(key) + len(value) * (1 if isinstance(value, bytes) else 8)

    def turn(self) -> None:
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0


class Codec:
    """Encodes slices by their distinct units. encode: from new units to the ids of each. fold: A-Z read as a-z, but where a special token may stand."""

    def __init__(self, encode: Callable[[list[bytes]], list], attach: bool, fold: bool = False):
        self.encode, self.attach, self.fold, self.known = encode, attach, fold, Memory()

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the texts' offsets into them."""
        begins = cut(data, offsets, self.attach)
        if self.fold and not ((data[:-1] == 60) & (data[1:] == 124)).any():
            data = LOWER[data]
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if not self.attach:  # a unit takes the white space after it along, so that offsets stay contiguous
            begins = begins[~WHITE[data[begins]]]
            if not len(begins):
                return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lead = begins[0]
        spans = (np.append(begins, len(data)) - lead).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(data[lead:]))]).dictionary_encode()
        codes, units = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if not self.attach:
            units = [u.rstrip(b" \t\n\r\x0b\x0c") for u in units]
        self.known.turn()
        found = self.known.look(units)
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            for i, ids in zip(new, self.encode([units[i] for i in new]), strict=True):
                found[i] = made = np.asarray(ids, np.uint32).tobytes()
                self.known.keep(units[i], made)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        ids = ragged(flat, np.cumsum(lens) - lens, lens, codes)
        before = np.concatenate(([0], np.cumsum(lens[codes])))
        return ids, before[np.searchsorted(begins, offsets)]

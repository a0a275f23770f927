"""LZ77 steps (literals, length, offset) of chunks, by hash chains, greedy or lazy.

Chunks are parsed apart, so the steps are valid but not those of one parse of the whole. What a position's search finds doesn't
depend on the parse, so the search runs in numpy over all positions of some chunks at once: positions sorted by their first three
bytes have their chains before them. Work per position is bounded by the chain's depth. Arrow batches are handled in slices of
whole chunks: beyond a batch, a worker holds a slice's arrays, or a chunk's if that is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, LONGEST, SHORTEST = 32768, 258, 3
#: Depth of the chains searched, the length that ends a search, and the offset beyond which a match of three is not worth it.
DEPTH, NICE, NEAR = 16, 64, 4096
#: Bytes of chunks parsed at once, or replayed before they are handed on.
SLICE = 1 << 18
NAMES = ("literals", "length", "offset")
STEPS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in NAMES]))


def common(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths, up to most, of what is alike from positions a and b on; words has the eight bytes from each position on."""
    differ = words[a] ^ words[b]
    # The bits below the lowest one set, or all 64.
    length = (np.bitwise_count(~differ & (differ - np.uint64(1))) >> 3).astype(np.int64)
    left = np.flatnonzero(differ == 0)
    while len(left := left[length[left] < most[left]]):
        at = length[left]
        differ = words[a[left] + at] ^ words[b[left] + at]
        length[left] += np.bitwise_count(~differ & (differ - np.uint64(1))) >> 3
        left = left[differ == 0]
    return np.minimum(length, most)


def found(data: np.ndarray, ends: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the chunks that end there, length and offset of its best match, or zeros. Of equal lengths the nearest one."""
    size = len(data)
    lengths, offsets = np.zeros(size, np.int64), np.zeros(size, np.int64)
    data = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(data, 8)[:size].copy().view("<u8").ravel()
    sizes = np.diff(ends, prepend=0)
    chunk, left = np.repeat(np.arange(len(ends)), sizes), np.repeat(ends, sizes) - np.arange(size)
    at = np.flatnonzero(left >= SHORTEST)
    # Three bytes above the position: one sort puts each chain in a row, nearest last.
    order = np.sort((words[at] & np.uint64(0xFFFFFF)).astype(np.int64) << 32 | at)
    key, at = order >> 32, order & 0xFFFFFFFF
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (chunk[at[1:]] != chunk[at[:-1]]))) if len(at) else at
    before = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    most, best, far = np.minimum(left[at], LONGEST), np.full(len(at), SHORTEST - 1), np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for k in range(1, depth + 1):
        live = live[before[live] >= k]
        i = at[live]
        gap = i - at[live - k]
        if size > WINDOW and not (near := gap <= WINDOW).all():
            live, i, gap = live[near], i[near], gap[near]
        if not len(live):
            break
        end = i + best[live]
        longer = np.flatnonzero(data[end] == data[end - gap])  # else it is no longer than what is found
        j, i, gap = live[longer], i[longer], gap[longer]
        n = common(words, i, i - gap, most[j])
        more = n > best[j]
        j, n = j[more], n[more]
        best[j], far[j] = n, gap[more]
        before[j[(n >= NICE) | (n == most[j])]] = 0
    good = (best > SHORTEST) | (far > 0) & (far <= NEAR)
    lengths[at[good]], offsets[at[good]] = best[good], far[good]
    return lengths, offsets


def plans(data: np.ndarray, ends: np.ndarray, lazy: bool = True, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The steps of the chunks that end there, as rows of three, and how many each chunk has."""
    size = len(data)
    lengths, offsets = found(data, ends, depth)
    take = lengths > 0
    if lazy:
        bits = np.frexp(offsets)[1]
        take[:-1] &= (lengths[:-1] >= NICE) | (lengths[1:] == 0) | (4 * (lengths[1:] - lengths[:-1]) + bits[:-1] - bits[1:] <= 2)
    starts = np.flatnonzero(take)
    after = np.searchsorted(starts, starts + lengths[starts]).tolist()
    used, i, n = [], 0, len(after)
    while i < n:
        used.append(i)
        i = after[i]
    starts = starts[used]
    # A match never passes its chunk's end; what is left there is a step of literals.
    stops = starts + lengths[starts]
    owner = np.searchsorted(ends, starts, "right")
    last = np.searchsorted(starts, ends)
    reached = np.where(last > 0, stops[last - 1], 0) if len(stops) else np.zeros(len(ends), np.int64)
    begins = np.append(0, ends)[:-1]
    rest = ends - np.maximum(reached, begins)
    steps = np.stack((starts - np.maximum(np.append(0, stops)[:-1], begins[owner]), lengths[starts], offsets[starts]), 1)
    tail = rest > 0
    made = np.insert(steps, last[tail], np.stack((rest[tail], rest[tail] * 0, rest[tail] * 0), 1), 0)
    return made, np.bincount(owner, minlength=len(ends)) + tail


def steps(data: bytes, lazy: bool = True, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    made, _ = plans(np.frombuffer(data, np.uint8), np.array([len(data)]), lazy, depth)
    return list(zip(*made.T.tolist(), strict=True))


def slices(data: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Some rows of a binary column, their bytes and where each row ends in them; null is empty."""
    total = np.cumsum(pc.binary_length(data).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = done = 0
    while at < len(data):
        to = max(at + 1, int(np.searchsorted(total, done + SLICE, "right")))
        some = data.slice(at, to - at)
        yield some, np.frombuffer(b"".join(x for x in some.to_pylist() if x), np.uint8), total[at:to] - done
        at, done = to, int(total[to - 1])


@F.arrow_udf(STEPS)
def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for some, data, ends in slices(batch):
            made, n = plans(data, ends)
            items = pa.StructArray.from_arrays([pa.array(made[:, i].astype(np.int32)) for i in range(3)], NAMES)
            yield pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), items, mask=some.is_null())


def match_counts(df: DataFrame, content: str) -> DataFrame:
    """length, matches, literals: how many steps of the chunks match that much, and the literals before them. A length recurs, once a batch at most."""

    def run(batches):
        for batch in batches:
            n = np.zeros((2, LONGEST + 1), np.int64)
            for _, data, ends in slices(batch.column(0)):
                made, _ = plans(data, ends)
                for row, weights in zip(n, (None, made[:, 0]), strict=True):
                    row += np.bincount(made[:, 1], weights, LONGEST + 1).astype(np.int64)
            n[:, 0] = 0  # steps without a match
            some = np.flatnonzero(n[0])
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *map(pa.array, n[:, some])], ["length", "matches", "literals"])

    return df.select(content).mapInArrow(run, "length int, matches long, literals long")


def replay(literals: np.ndarray, steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the steps of some chunks, rows of three and so many a chunk, make of their literals alone."""
    stops = np.cumsum(steps[:, 0] + steps[:, 1])
    behind = stops - steps[:, 1] - np.repeat(np.append(0, stops)[np.cumsum(counts) - counts], counts)
    if ((steps[:, 1] > 0) & ((steps[:, 2] < 1) | (steps[:, 2] > behind))).any():
        raise ValueError("an offset reaches before its chunk")
    literal = is_literal(steps)
    # Each byte's source, then that one's, until all are literals: twice as far back each time.
    source, left = np.arange(len(literal)), np.flatnonzero(~literal)
    source[left] -= np.repeat(steps[:, 2], steps[:, 1])
    while len(left := left[~literal[source[left]]]):
        source[left] = source[source[left]]
    out = np.zeros(len(literal), np.uint8)
    out[literal] = literals
    return out[source]


def is_literal(steps: np.ndarray) -> np.ndarray:
    return np.repeat(np.tile([True, False], len(steps)), steps[:, :2].ravel())


@F.arrow_udf(T.BinaryType())
def replayed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The bytes that the steps make of the literals alone."""
    for batch, made in batches:
        at = 0
        for some, _, _ in slices(batch):
            plan = made.slice(at, len(some))
            at += len(some)
            valid = pc.and_(some.is_valid(), plan.is_valid())
            plan = plan.filter(valid)
            counts = pc.list_value_length(plan).to_numpy(zero_copy_only=False).astype(np.int64)
            items = plan.flatten()
            steps = np.stack([items.field(n).to_numpy(zero_copy_only=False) for n in NAMES], 1).astype(np.int64)
            sizes = np.diff(np.append(0, np.cumsum(steps[:, 0] + steps[:, 1]))[np.append(0, np.cumsum(counts))])
            raw = some.filter(valid)
            if (sizes != pc.binary_length(raw).to_numpy(zero_copy_only=False)).any():
                raise ValueError("steps of another size than their chunk")
            literals = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)[is_literal(steps)]
            out, ends = replay(literals, steps, counts).tobytes(), iter(np.cumsum(sizes).tolist())
            begin, back = 0, []
            for ok in valid.to_pylist():
                end = next(ends) if ok else begin
                back.append(out[begin:end] if ok else None)
                begin = end
            yield pa.array(back, pa.binary())

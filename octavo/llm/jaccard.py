"""Near-dedup by the Jaccard similarity of word shingles: operator 8's method proposes, whole shingle sets decide.

Two texts are linked if the sets of their shingles have a Jaccard similarity of `least` or
more; groups are the connected components of links. Candidates are found by SimHash and
segment-popcount embedding (`simhash.similar_links`): 256 majority bits of the shingle hashes, grids over groups
of the 128 two-bit counts, Manhattan filter, Hamming distance. Op 8's 64 bits can't stand for
0.8: such pairs differ in ten bits or so, where no grid of simhash prunes anything.

A pair of similarity 0.8 shares no cell with probability 1e-4 by formula (over 0.85, 2e-7); beyond 72 of
256 bits, or 26 of the first 64, it isn't a candidate (39 and 10 are expected at 0.8; texts of under ten shingles stray further).
Candidates' components hold every link found, so each is split exactly by its texts' shingle sets, as 64-bit hashes.

Scale: equal shingle sets are one node, equal fingerprints one point of the search. A cell ties each
of its members to one other at most, never all pairs. A component of candidates is read by one task, a set a node;
from one of its texts all that are similar are taken away at once, so a group of near copies costs a few passes.
Links, labels and fingerprints stay in written tables; whole texts move only where they are candidates.

Defined cases: null, empty and blank texts share one shingle and are copies of each other;
fewer words than a shingle: the whole sequence is one shingle; repeated rows are rows of one
group; null ids lose against any id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash, units
from .common import Workspace, name, packed
from .components import connected_components

WORDS, LEAST, SEED = 5, 0.8, 42
#: Rows of numbers up to which a table is sent to all tasks rather than whole texts to it.
FEW = 1 << 20
#: A word's hash is a polynomial of random numbers for its bytes; bytes handled at once, and the powers of its base and of its inverse.
BYTES = 1 << 18
_TABLE = np.random.default_rng(SEED + 1).integers(0, 1 << 64, 256, np.uint64)[units.LOWER]
_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSE = (np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(BYTES - 1, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (those of simhash, A-Z as a-z), and each text's first of them."""
    dark = ~units.WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(dark & (edge[:-1] | np.concatenate(([True], ~dark[:-1]))))
    ends = np.flatnonzero(dark & (edge[1:] | np.concatenate((~dark[1:], [True])))) + 1
    made, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BYTES, "right")))
        if (n := ends[to - 1] - low) > BYTES:  # one very long word
            made[at] = xxhash.xxh64_intdigest(data[low : ends[at]].tobytes().lower(), SEED)
        else:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data[low : low + n]] * _POWERS[:n])))
            a, b = starts[at:to] - low, ends[at:to] - low
            made[at:to] = _spread((sums[b] - sums[a]) * _INVERSE[a] ^ (b - a).astype(np.uint64))
        at = to
    return made, np.searchsorted(starts, offsets)


def sets_of(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text: the sorted distinct hashes of its shingles, made of the hashes of their words in order."""
    hashes, cuts = hashed_words(data, offsets)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = hashes[a:b]
        n = max(1, len(own) - words + 1)
        made = np.full(n, np.uint64(min(len(own), words)))
        for k in range(min(len(own), words)):
            made = _spread(made ^ own[k : k + n])
        yield np.unique(made)


def shingles(data: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of one text's shingles."""
    data = np.frombuffer(data or b"", np.uint8)
    return next(sets_of(data, np.array([0, len(data)], np.int64), words))


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def _numbers(x: list | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _base(df: DataFrame, text: str, id: str, words: int) -> DataFrame:
    """row, id, rid, key (of the shingle set), node (of the fingerprint), the fingerprint's parts."""

    def run(batches):
        for batch in batches:
            for at, data, offsets in units.slices(batch.column("data")):
                keys, fps = [], []
                for found in sets_of(data, offsets, words):
                    keys.append(xxhash.xxh3_64_intdigest(found.tobytes(), SEED))
                    fps.append(simhash.wide_fingerprint(found))
                fp = np.stack(fps)
                made = [_numbers(keys), _numbers(simhash.wide_node(fp)), *(_numbers(np.ascontiguousarray(x)) for x in fp.T)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(keys)), batch.column("id").slice(at, len(keys)), *made], ["row", "id", "key", "node", *simhash.WIDE])

    given = df.select(packed(df).alias("row"), name(id).alias("id"), name(text).cast("binary").alias("data"))
    kind = {f.name: f.dataType.simpleString() for f in given.select("row", "id").schema}
    made = ", ".join(f"{x} long" for x in ["key", "node", *simhash.WIDE])
    return given.mapInArrow(units.tidy(run), f"row {kind['row']}, id {kind['id']}, {made}").withColumn("rid", F.monotonically_increasing_id())


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """From part, key, data: part, key, set."""

    def run(batches):
        for batch in batches:
            for at, data, offsets in units.slices(batch.column("data")):
                made = list(sets_of(data, offsets, words))
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(at, len(made)), batch.column("key").slice(at, len(made)), _arrays(made)], ["part", "key", "set"])

    return docs.select("part", "key", "data").mapInArrow(units.tidy(run), "part long, key long, set array<long>")


def components_of(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Of each set: the first set that it reaches over pairs as similar as `least`. Exact."""
    sizes, root = np.array(list(map(len, sets))), np.arange(len(sets))
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    mark = np.zeros(1 + max(int(x.max()) for x in codes), bool)

    def gather(rest):
        return rest, np.concatenate([codes[k] for k in rest.tolist()]), np.concatenate(([0], np.cumsum(sizes[rest])[:-1])), np.ones(len(rest), bool)

    left, held, starts, alive = gather(np.arange(len(sets)))
    while alive.any():
        at = int(alive.argmax())
        alive[at] = False
        own, front = left[at], [left[at]]
        while front and alive.any():
            x = front.pop()
            if 2 * alive.sum() < len(left):
                left, held, starts, alive = gather(left[alive])
            mark[codes[x]] = True
            both = np.add.reduceat(mark[held], starts, dtype=np.int64)
            mark[codes[x]] = False
            near = alive & (both / (sizes[x] + sizes[left] - both) >= least)
            root[left[near]] = own
            front.extend(left[near])
            alive &= ~near
    return root


def _decided(sets: DataFrame, least: float) -> DataFrame:
    """From part, key, set: key, comp (one of its keys) of all sets, each part split by its links."""

    def split(keys, found):
        return np.array(keys, np.int64), np.array(keys, np.int64)[components_of(found, least)]

    def run(batches):
        now, keys, found = None, [], []
        for batch in batches:
            parts, own = batch.column("part").to_pylist(), batch.column("key").to_pylist()
            ends, data = batch.column("set").offsets.to_numpy(), batch.column("set").values.to_numpy().view(np.uint64)
            for part, key, a, b in zip(parts, own, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if part != now and keys:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in split(keys, found)], ["key", "comp"])
                    keys, found = [], []
                now = part
                keys.append(key)
                found.append(data[a:b].copy())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in split(keys, found)], ["key", "comp"])

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.repartition(n, "part").sortWithinPartitions("part").mapInArrow(units.tidy(run), "key long, comp long")


def _sent(t: DataFrame) -> DataFrame:
    return F.broadcast(t) if t.count() <= FEW else t


def lost_rows(base: DataFrame, space: Workspace, text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """rid of the rows that are copies of one that stays."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    keys = base.groupBy("key").agg(F.first("node").alias("node"), *[F.first(x).alias(x) for x in simhash.WIDE], first.alias("best"), F.count(F.lit(1)).alias("n"))
    keys = space.write(keys, "keys")
    points = space.write(keys.select("node", *simhash.WIDE).dropDuplicates(["node"]), "points")
    links = space.write(simhash.similar_links(points, points.count(), least).distinct(), "candidates")
    labels = connected_components(links, space).select(F.col("node").alias("m"), "root")
    parts = keys.join(labels, F.col("node") == F.col("m"), "left").select("key", "best", "n", F.coalesce("root", "node").alias("part"))
    parts = space.write(parts, "parts")
    several = parts.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("part").alias("p"))
    several = space.write(parts.join(several, F.col("part") == F.col("p"), "left_semi"), "several")
    chosen = several.select("part", "key", F.col("best.rid").alias("r"))
    docs = base.select("rid", F.col("row").getField(text).cast("binary").alias("data")).join(_sent(chosen), F.col("rid") == F.col("r"))
    comps = space.write(_decided(_sets(docs, words), least), "components")
    comps = comps.select(F.col("key").alias("c"), "comp").where("c != comp")
    comps = space.write(comps.unionByName(comps.select(F.col("comp").alias("c"), "comp").distinct()), "joined")
    of = several.join(comps, F.col("key") == F.col("c")).select("key", "best", "comp")
    least_of = of.groupBy("comp").agg(F.min("best").alias("kept")).withColumnRenamed("comp", "c")
    stays = of.join(least_of, F.col("comp") == F.col("c")).select("key", F.col("kept.rid").alias("keep"))
    alone = parts.where("n > 1").join(comps, F.col("key") == F.col("c"), "left_anti").select("key", F.col("best.rid").alias("keep"))
    stays = space.write(stays.unionByName(alone).withColumnRenamed("key", "k"), "stays")
    return space.write(base.select("rid", "key").join(stays, F.col("key") == F.col("k")).where("rid != keep").select(F.col("rid").alias("lost")), "lost")


def deduplicate(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, with the input's columns."""
    space = Workspace(df.sparkSession)
    base = space.write(_base(df, text, id, words), "fingerprints")
    lost = lost_rows(base, space, text, words, least)
    return base.join(_sent(lost), F.col("rid") == F.col("lost"), "left_anti").select("row.*")

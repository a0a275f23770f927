"""SimHash near-dedup by segment-popcount embedding.

Fingerprint: 64 majority bits of XXH64 (seed 42) over word shingles, repeats included.
Embedding: a fingerprint's 32 segments of two bits become their bit counts (0, 1 or 2).
The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. Counts are held in unary (00, 01, 11), so that Manhattan distance is the
popcount of an exclusive or.

Grid range join: the 32 coordinates form six groups. If the Manhattan distance is at
most 4, at least two groups agree entirely, so each of the 15 pairs of groups is a grid
and two fingerprints within range share a cell of at least one of them. Fingerprints of
a cell are filtered by the Manhattan bound, and what passes is verified by Hamming distance.

Similarity in place of bits: a Jaccard similarity of 0.8 is an angle at which some 15 % of the bits differ,
too many for 64 bits and for pigeonholes. `similar_links` searches fingerprints of PARTS times 64 bits in the same
way: embedding, grids of coordinate groups, Manhattan filter, Hamming distance. Its groups come from
random orders of the coordinates, as many as let a pair at the threshold share no cell with probability MISS;
what it finds are candidates, which `jaccard` decides on whole shingle sets. Groups widen with the table, so that a
cell holds some CROWD fingerprints at most on average.

Scale: equal fingerprints are one node before the join (map-side partial sums). A cell
over HOT fingerprints is cut again by the same rule within its other coordinates; what
is still over HOT then is dealt to pairs of blocks, so no task holds more than two
blocks of a cell at once. A cell yields a spanning forest of its links, never all pairs.
Links, labels and fingerprints stay in written tables.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other;
fewer words than a shingle: the whole sequence is one shingle; repeated rows are rows of
one node; null ids are ignored by the minimum (component_id is null if there is no other);
an empty table gives an empty result; the input's columns travel in the struct `row`.
Long texts are fingerprinted whole; a task holds one text's shingles beside its batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import units
from .common import Workspace, name, packed
from .components import connected_components

WORDS, RADIUS, HOT, SEED = 4, 4, 8192, 42
#: Hashes summed at once: bounds the memory of a very long text.
BLOCK = 1 << 16
LOW = np.uint64(0x5555555555555555)
#: Two-bit segments of each coordinate group.
GROUPS = (6, 6, 5, 5, 5, 5)
#: Of the search by similarity: 64-bit parts of a fingerprint, most bits that differ in all and in the first part, the chance to share no cell, the narrowest group, and a cell's mean size.
PARTS, FAR, FAR_FIRST, MISS, NARROW, CROWD = 4, 72, 26, 1e-4, 6, 16384
WIDE = [f"f{k}" for k in range(PARTS)]
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, PARTS, np.uint64)


def fingerprint(data: bytes | None, words: int = WORDS) -> int:
    """As an unsigned 64-bit integer."""
    tokens = (data or b"").lower().split()  # of bytes: A-Z only, and white space is \t \n \v \f \r and space
    if not tokens:
        return 0
    text = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = WORDS, columns: list[str] | None = None) -> DataFrame:
    """row, id, rid, fp (the bits as a signed long)."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column("data")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(found.view(np.int64))], ["row", "id", "fp"])

    given = df.select(packed(df, columns).alias("row"), name(id).alias("id"), name(text).cast("binary").alias("data"))
    kind = {f.name: f.dataType.simpleString() for f in given.select("row", "id").schema}
    return given.mapInArrow(run, f"row {kind['row']}, id {kind['id']}, fp long").withColumn("rid", F.monotonically_increasing_id())


def unary(x: np.ndarray) -> np.ndarray:
    """The embedding: both bits of each segment, sorted."""
    y = x >> np.uint64(1)
    return ((x | y) & LOW) | (((x & y) & LOW) << np.uint64(1))


def unary_column(fp: Column) -> Column:
    low, y = F.lit(int(LOW)), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(y).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(y).bitwiseAND(low), 1))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grids(segments: list[int]) -> list[tuple[int, list[int]]]:
    """For each pair of six groups of the segments: the mask of its bits, and the segments outside it."""
    cuts = np.cumsum([0, *GROUPS]) * len(segments) // 32
    groups = [segments[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    found = []
    for pair in combinations(range(6), 2):
        inside = {s for g in pair for s in groups[g]}
        found.append((sum(3 << (2 * s) for s in inside), [s for s in segments if s not in inside]))
    return found


def _cells(t: DataFrame) -> DataFrame:
    made = [F.struct(F.lit(k).alias("grid"), F.xxhash64(F.lit(k), F.col("un").bitwiseAND(F.lit(signed(mask)))).alias("cell")) for k, (mask, _) in enumerate(grids(list(range(32))))]
    return t.select("fp", "un", F.explode(F.array(*made)).alias("c")).select("fp", "un", "c.*")


def _finer(t: DataFrame) -> DataFrame:
    """Cells within hot cells: those of the coordinates that the hot cell leaves open."""
    made = []
    for k, (_, rest) in enumerate(grids(list(range(32)))):
        inner = [F.xxhash64(F.col("cell"), F.lit(j), F.col("un").bitwiseAND(F.lit(signed(mask)))) for j, (mask, _) in enumerate(grids(rest))]
        made.append(F.when(F.col("grid") == k, F.array(*inner)))
    return t.select("fp", "un", F.explode(F.coalesce(*made)).alias("cell"))


def _links(fp: np.ndarray, un: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links of one cell's fingerprints."""
    left, out = np.arange(len(fp)), []
    if len(fp) > 64:  # those without a link go first, block by block
        linked = np.zeros(len(fp), bool)
        step = max(1, (1 << 20) // len(fp))
        for at in range(0, len(fp), step):
            near = np.bitwise_count(un[at : at + step, None] ^ un[None]) <= radius
            near &= np.bitwise_count(fp[at : at + step, None] ^ fp[None]) <= radius
            linked[at : at + step] = near.sum(axis=1) > 1
        left = left[linked]
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = (np.bitwise_count(un[left] ^ un[x]) <= radius) & (np.bitwise_count(fp[left] ^ fp[x]) <= radius)
            if near.any():
                new = left[near]
                out.append((np.full(len(new), fp[x]), fp[new]))
                front.extend(new)
                left = left[~near]
    return out


def link_cells(cells: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From (cell, fp, un): the links a, b found within cells."""

    def of(cell, fp, un):
        out, n = [], len(cell)
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sizes = np.diff(np.append(starts, n))
        small = np.repeat(sizes <= 8, sizes)
        for k in range(1, 8):
            at = np.flatnonzero(small[k:] & (cell[k:] == cell[:-k]))
            at = at[np.bitwise_count(un[at] ^ un[at + k]) <= radius]
            at = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= radius]
            if len(at):
                out.append((fp[at], fp[at + k]))
        for a, b in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
            out += _links(fp[a : a + b], un[a : a + b], radius)
        return out

    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush(parts):
            a, b = ([np.concatenate(x) for x in zip(*out, strict=True)] if (out := of(*parts)) else [np.zeros(0, np.uint64)] * 2)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            parts = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            parts = [parts[0], parts[1].view(np.uint64), parts[2].view(np.uint64)]
            if not len(parts[0]):
                continue
            held.append(parts)
            if parts[0][-1] == held[0][0][0]:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
            yield flush([x[:cut] for x in whole])
            held = [[x[cut:] for x in whole]]
        if held and sum(len(x[0]) for x in held):
            yield flush([np.concatenate(x) for x in zip(*held, strict=True)])

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.select("cell", "fp", "un").repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def link_blocks(cells: DataFrame, counts: DataFrame, hot: int, radius: int = RADIUS) -> DataFrame:
    """Links of cells over `hot`: each pair of blocks of half that size is a cell of its own."""
    t = cells.join(counts.select(F.col("cell").alias("c"), F.ceil(F.col("n") * 2 / hot).cast("int").alias("k")), F.col("cell") == F.col("c"))
    t = t.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return link_cells(t.select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "fp", "un"), radius)


def near_links(nodes: DataFrame, space: Workspace, hot: int = HOT) -> DataFrame:
    """From distinct fingerprints fp: links a, b whose closure is that of all pairs within RADIUS bits."""
    t = nodes.select("fp", unary_column(F.col("fp")).alias("un"))
    counts = lambda cells, of: space.write(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), of)
    cells = _cells(t)
    crowded = counts(cells, "crowded")
    if crowded.isEmpty():
        return link_cells(cells)
    held = crowded.select(F.col("cell").alias("c"))
    links = link_cells(cells.join(held, F.col("cell") == F.col("c"), "left_anti"))
    finer = space.write(_finer(cells.join(held, F.col("cell") == F.col("c"), "left_semi")), "finer")
    crowded = counts(finer, "crowded2")
    held = crowded.select(F.col("cell").alias("c"))
    links = links.unionByName(link_cells(finer.join(held, F.col("cell") == F.col("c"), "left_anti")))
    return links if crowded.isEmpty() else links.unionByName(link_blocks(finer, crowded, hot))


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = WORDS, columns: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """One row per input row: row (struct of `columns`), id, rid, fp, component_id, kept (one row of each component)."""
    space = Workspace(df.sparkSession)
    base = space.write(fingerprints(df, text, id, words, columns), "fingerprints")
    nodes = base.groupBy("fp").agg(F.min("id").alias("least"), F.coalesce(F.min_by("rid", "id"), F.min("rid")).alias("first"))
    nodes = space.write(nodes, "nodes")
    labels = connected_components(near_links(nodes, space, hot), space)
    rooted = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", "first", F.coalesce("root", "fp").alias("root"))
    rooted = space.write(rooted, "rooted")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.coalesce(F.min_by("first", "least"), F.min("first")).alias("keep"), F.count(F.lit(1)).alias("n"))
    best = space.write(best.where("n > 1").drop("n").withColumnRenamed("root", "r"), "best")
    found = rooted.join(best, F.col("root") == F.col("r"), "left")
    found = found.select(F.col("fp").alias("f"), F.when(F.col("r").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("keep", "first").alias("keep"))
    found = space.write(found, "found")
    return base.join(found, F.col("fp") == F.col("f")).select("row", "id", "rid", "fp", "component_id", (F.col("rid") == F.col("keep")).alias("kept"))


def deduplicate(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One document of each group of near copies, that with the smallest id, with the input's columns."""
    return near_duplicates(df, text, id).where("kept").select("row.*")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """PARTS times 64 majority bits of shingle hashes."""
    total = np.zeros(64 * PARTS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = _mixed(hashes[at : at + BLOCK, None] ^ _SALTS)
        total += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)


def wide_node(fp: np.ndarray) -> np.ndarray:
    """A number for each row of fingerprint parts. Two that share it by chance become candidates, no more."""
    found = np.zeros(len(fp), np.uint64)
    for k in range(PARTS):
        found = _mixed(found ^ fp[:, k]) + np.uint64(k + 1)
    return found


def wide_grids(n: int, least: float) -> np.ndarray:
    """Of each grid for n fingerprints: the masks of its coordinate group, a row of PARTS."""
    differ = math.acos(2 * least / (1 + least)) / math.pi
    agree = (1 - differ) ** 2 + differ**2 / 2  # both bits of a segment, or both the other way round
    wide = min(32 * PARTS, max(NARROW, math.ceil(math.log(max(n, 1) / CROWD) / math.log(8 / 3))))  # random segments agree in 3 of 8
    grids = math.ceil(math.log(MISS) / math.log1p(-(agree**wide)))
    rng, groups = np.random.default_rng(SEED), []
    while len(groups) < grids:
        order = rng.permutation(32 * PARTS)
        groups += [order[at : at + wide] for at in range(0, len(order) - wide + 1, wide)]
    masks = np.zeros((grids, PARTS), np.uint64)
    for k, group in enumerate(groups[:grids]):
        for x in group.tolist():
            masks[k, x // 32] |= np.uint64(3 << (2 * (x % 32)))
    return masks


def wide_cells(fp: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Each fingerprint's cell of each grid."""
    un, found = unary(fp), np.empty((len(fp), len(masks)), np.uint64)
    for k, mask in enumerate(masks):
        cell = np.full(len(fp), k + 1, np.uint64)
        for part in np.flatnonzero(mask):
            cell = _mixed(cell ^ (un[:, part] & mask[part])) + np.uint64(part)
        found[:, k] = cell
    return found


def _near(fp: np.ndarray, un: np.ndarray, i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
    near = np.bitwise_count(un[i] ^ un[j]).sum(axis=1, dtype=np.int64) <= FAR
    return near & (np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= FAR)


def wide_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one cell's fingerprints: each row i that reaches a smaller row over pairs in range, and the smallest such row."""
    un, first, n = unary(fp), fp[:, 0].copy(), len(fp)
    linked, root, pairs, many, step = np.zeros(n, bool), np.arange(n), [], 0, max(1, (1 << 18) // n)
    for at in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(first[at : at + step, None] ^ first[None, at:]) <= FAR_FIRST)
        i, j = i[i < j] + at, j[i < j] + at
        near = _near(fp, un, i, j)
        i, j = i[near], j[near]
        linked[i] = linked[j] = True
        if (many := many + len(i)) <= 2 * n:
            pairs += zip(i.tolist(), j.tolist(), strict=True)
    if many <= 2 * n:
        up: dict[int, int] = {}
        for pair in pairs:
            a, b = pair
            while a in up:
                a = up[a]
            while b in up:
                b = up[b]
            if a != b:
                up[max(a, b)] = min(a, b)
        for x in sorted(up):
            root[x] = root[up[x]]
    else:
        left = np.flatnonzero(linked)
        while len(left):
            own, front, left = left[0], [left[0]], left[1:]
            while front and len(left):
                near = _near(fp, un, left, front.pop())
                if near.any():
                    root[left[near]] = own
                    front.extend(left[near])
                    left = left[~near]
    i = np.flatnonzero(root != np.arange(n))
    return i, root[i]


def _whole_cells(batches) -> Iterator[list[np.ndarray]]:
    """From batches sorted by their first column: their columns, whole cells at once."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(batch.num_columns)])
        if held[-1][0][-1] == held[0][0][0]:
            continue
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
        yield [x[:cut] for x in whole]
        held = [[x[cut:] for x in whole]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def similar_links(nodes: DataFrame, n: int, least: float) -> DataFrame:
    """From n distinct fingerprints f0, f1, ...: links a, b of their node numbers, candidates for a similarity of `least` or more."""
    masks = wide_grids(n, least)

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fp = np.stack([part.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(PARTS)], axis=1)
                made = [wide_cells(fp, masks).ravel(), *np.repeat(fp, len(masks), axis=0).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in made], ["cell", *WIDE])

    def link(batches):
        for cell, *parts in _whole_cells(batches):
            fp, out = np.stack(parts, axis=1), []
            node = wide_node(fp).view(np.int64)
            order = np.lexsort((node, cell))  # cells that share members then mostly share their smallest, and links repeat
            cell, fp, node = cell[order], fp[order], node[order]
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    i, j = wide_links(fp[a:b])
                    if len(i):
                        out.append((i + a, j + a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(x)]) for x in zip(*out, strict=True)], ["a", "b"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = nodes.select(*WIDE).mapInArrow(units.tidy(deal), ", ".join(f"{x} long" for x in ["cell", *WIDE]))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(units.tidy(link), "a long, b long")

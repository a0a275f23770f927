"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words and pairs of neighbours, in BUCKETS buckets): the raw one, from all documents, with additive
smoothing, and the target's, from documents labelled good, mixed with the raw one (an n-gram that the target lacks is
evidence of log(1 - MIX), however rare it is: languages with few labels don't lose by that). A document's log importance weight is the sum over its n-grams of
log p_target - log p_raw. Gumbel top-k draws k documents without replacement in proportion to the
weights: a document's key is its weight plus Gumbel noise, which comes from a hash of its id, its text, its number among rows equal in both, and the seed (so the draw doesn't depend on partitions), and the k
largest keys are kept. k is SHARE of the documents.

With `length` the weight is divided by the number of n-grams plus PRIOR and multiplied by that length, as if all documents were of it:
then long documents don't win or lose by length alone, and a few words don't decide short ones.

Scale: raw counts are of all documents, summed per task before one small shuffle. The target takes at most LABELLED labelled
documents, chosen by a hash. Models are arrays of BUCKETS doubles. The k-th key is found by
radix selection on 16-bit digits: counts only, no sort, no limit; ties are broken by a further hash.

Defined cases: a text of any length is counted whole, in the memory of a few dozen bytes a word of the longest; null and blank texts have weight 0; labels without a document or without a
quality are ignored, and of a document's several labels the best counts; without labels all weights are 0 and the draw is uniform; repeated rows
are drawn apart; an empty table gives an empty result; other columns stay in `row`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import units
from .common import Workspace, name, packed

BUCKETS, SMOOTHING, MIX, LENGTH, PRIOR, SHARE, SEED = 1 << 17, 0.1, 0.5, 300.0, 30, 0.85, 17
#: The most labelled documents that the target model is fitted on.
LABELLED = 20_000


class Grams:
    """Hashed n-grams of texts: each distinct word is hashed once a worker."""

    def __init__(self):
        self.codec = units.Codec(lambda new: [np.array([xxhash.xxh32_intdigest(u.lower(), 1)], np.uint32) for u in new], attach=False)

    def buckets(self, data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and text of each n-gram."""
        words, cuts = self.codec.ids(data, offsets)
        text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        h = words.astype(np.uint64)
        pairs = np.flatnonzero(text[1:] == text[:-1])
        mixed = (h[pairs] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[pairs + 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        single = h * np.uint64(0xD6E8FEB86659FD93)
        both = np.concatenate((single, mixed)) >> np.uint64(33)
        return (both % np.uint64(buckets)).astype(np.int64), np.concatenate((text, text[pairs]))


_grams = Grams()


def counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all texts."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in units.slices(batch.column(0)):
                total += np.bincount(_grams.buckets(data, offsets, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return df.select(name(text).cast("binary")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def model(df: DataFrame, text: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log probabilities: an array of `buckets` doubles, whatever the input's size."""
    found = counts(df, text, buckets).toPandas()
    n = np.full(buckets, smoothing)
    n[found["bucket"].to_numpy(np.int64)] += found["n"].to_numpy(float)
    return np.log(n / n.sum())


def weights(df: DataFrame, ratio: np.ndarray, text: str = "text", id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """row, id, n_grams, log_weight (summed over the n-grams)."""
    given = df.select(packed(df, columns).alias("row"), name(id).alias("id"), name(text).cast("binary").alias("data"), F.xxhash64(name(text).cast("string")).alias("hash"))

    def run(batches):
        for batch in batches:
            for at, data, offsets in units.slices(batch.column("data")):
                n = len(offsets) - 1
                bucket, of = _grams.buckets(data, offsets, len(ratio))
                size, total = np.bincount(of, minlength=n), np.bincount(of, ratio[bucket], n)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, n), batch.column("id").slice(at, n), batch.column("hash").slice(at, n), pa.array(size.astype(np.int64)), pa.array(total)], ["row", "id", "hash", "n_grams", "log_weight"])

    kind = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(run, f"row {kind['row']}, id {kind['id']}, hash long, n_grams long, log_weight double")


def numbered(t: DataFrame, space: Workspace, salts: int = 64) -> DataFrame:
    """Adds nth: 0, 1, ... among the rows of equal id and hash, whatever the partitions. Only rows that repeat are shuffled, each group in `salts` parts."""
    same = space.write(t.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("i"), F.col("hash").alias("h")), "repeated")
    if same.isEmpty():
        return t.withColumn("nth", F.lit(0).cast("long"))
    d = t.join(same, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).select("rid", "id", "hash", F.pmod(F.xxhash64("rid"), F.lit(salts)).alias("salt"))
    own = Window.partitionBy("id", "hash", "salt")
    d = d.withColumn("nth", F.row_number().over(own.orderBy("rid")) - 1)
    parts = d.groupBy("id", "hash", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("id", "hash").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("id").alias("i"), F.col("hash").alias("h"), F.col("salt").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
    d = d.join(parts, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s")))
    d = space.write(d.select(F.col("rid").alias("r"), (F.col("nth") + F.col("before")).cast("long").alias("nth")), "numbers")
    return t.join(d, F.col("rid") == F.col("r"), "left").drop("r").withColumn("nth", F.coalesce("nth", F.lit(0)))


def top_k(t: DataFrame, key: str, k: int) -> DataFrame:
    """Adds kept: whether the row's key (a long) is among the k largest. Keys are distinct, or all rows of the k-th key are kept."""
    if k <= 0:
        return t.withColumn("kept", F.lit(False))
    low, left = 0, k  # bits of the k-th key found so far, from the top; the sign is flipped so that order is unsigned
    flipped = F.col(key).bitwiseXOR(F.lit(-(2**63)))
    for shift in (48, 32, 16, 0):
        own = t.select(F.shiftrightunsigned(flipped, shift).alias("d"))
        digits = own.where(F.shiftrightunsigned(F.col("d"), 16) == (low >> 16 if shift == 48 else low)) if shift != 48 else own
        by = digits.groupBy(F.col("d").bitwiseAND(F.lit(0xFFFF)).alias("x")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("x")).collect()  # at most 65,536 rows
        x = 0
        for r in by:
            x = r.x
            if r.n >= left:
                break
            left -= r.n
        low = low << 16 | x
    kth = low ^ (1 << 63)
    return t.withColumn("kept", F.col(key) >= F.lit(kth - (1 << 64) if kth >> 63 else kth))


def ordered(x):
    """A long that orders as the double does, to 2^-20 units."""
    return F.round(x * (1 << 20)).cast("long")


def resample(
    df: DataFrame, good: DataFrame, text: str = "text", id: str = "doc_id", share: float = SHARE, columns: list[str] | None = None, labelled: int = LABELLED, seed: int = SEED, length: float | None = LENGTH
) -> DataFrame:
    """good: ids of the target's documents. One row per input row: row, n_grams, log_weight (the log importance ratio), score (what is drawn by), gumbel_key, kept (drawn)."""
    space = Workspace(df.sparkSession)
    chosen = good.select(name(id).alias("_g")).where("_g is not null").distinct().withColumn("_o", F.xxhash64("_g", F.lit(seed))).orderBy("_o", "_g").limit(labelled).select("_g")
    target = df.select(name(id).alias("_i"), name(text).alias("_t")).join(F.broadcast(chosen), F.col("_i") == F.col("_g"), "left_semi")  # at most LABELLED ids
    known, raw = model(target, "_t"), model(df, text)
    ratio = np.log(MIX * np.exp(known - raw) + 1 - MIX) if (known != known[0]).any() else np.zeros(BUCKETS)
    t = space.write(weights(df, ratio, text, id, columns).withColumn("rid", F.monotonically_increasing_id()), "weights")
    t = numbered(t, space)
    score = F.col("log_weight") if length is None else F.col("log_weight") / (F.col("n_grams") + PRIOR) * length
    uniform = (F.shiftrightunsigned(F.xxhash64("id", "hash", "nth", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    t = t.withColumn("score", score).withColumn("gumbel_key", F.col("score") - F.log(-F.log(uniform)))
    t = t.withColumn("_k", F.shiftleft(ordered(F.col("gumbel_key")), 20).bitwiseOR(F.shiftrightunsigned(F.xxhash64("id", "hash", "nth"), 44)))
    t = space.write(t, "keys")
    n = t.count()
    return top_k(t, "_k", round(share * n)).select("row", "n_grams", "log_weight", "score", "gumbel_key", "kept")


def good_labels(labels: DataFrame) -> DataFrame:
    """Ids labelled of good quality and not toxic."""
    return labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.coalesce(F.max("toxic"), F.lit(0)).alias("t")).where("q = 1 and t = 0").select("doc_id")

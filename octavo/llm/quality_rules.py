"""Quality rules: base rules, and robust multivariate outliers by minimum covariance determinant.

Statistics of each whole text come from string and array functions alone. Six of them,
as transformed ratios in fixed point, form a vector. Per language and source, MCD looks for the half of the
vectors whose covariance has the least determinant: from three starts (median and MAD; the covariance of spatial signs; that of
tanh scores), concentration steps keep the SHARE of vectors with the smallest Mahalanobis distance and take their
mean and covariance again; of the starts that with the least determinant goes on until two more steps are done. Distances are made
consistent with a normal sample by CONSISTENCY. A pool's cutoff comes from its own distances: cube roots of chi-square
values are nearly normal (Wilson and Hilferty), so the median and the lower quartile of the cube roots, which
outliers reach last, give a centre and a deviation, and what lies DEVIATIONS beyond is rejected (never below
LEAST_CUTOFF, which one normal row in a million passes).

All native: no Python runs on the executors. Scale: texts are read once; steps read the
written vectors only. A step is one aggregation with map-side partial sums by
group and distance bucket (at most a few hundred a group), so a group with a third of all
rows is a few hundred rows a task, and estimates are a row a group. Sums are of integers:
results don't depend on the order of rows. The subset is whole buckets of distance (3 % wide): the first that reach SHARE.

Groups under SMALLEST rows are pooled by language, then all together; a pool under
SMALLEST gives no verdict (kept unless a base rule fails).

Defined cases: a null text has no words (base_failed); a text of any length is read whole, within the memory of a few copies of it; a null language or source is a
group of its own; repeated rows count each time; empty tables give an empty result; the input's columns stay in the struct `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Workspace, name, packed, text_of

LEAST_WORDS, REPEATED_PERCENT = 50, 50
SHARE, STEPS, MORE_STEPS, STARTS, SMALLEST = 0.5, 3, 2, 3, 50
#: Of a normal sample's half with the least distances in six dimensions, the covariance is the sample's divided by this: SHARE over the chi-square distribution with eight degrees of freedom at the median of that with six.
CONSISTENCY = 1.785
DEVIATIONS, QUARTILE, LEAST_CUTOFF = 5.0, 0.6745, 38.26
#: Fixed point of the vectors, and the least deviation of a coordinate in those units: ratios of clean texts vary by less only by chance.
UNIT, FLOOR = 1024, 100
BUCKETS = 32
#: Fixed point of products of scores, which are at most 1.
FINE = 1 << 20
#: Rows of estimates that may be broadcast.
BROADCAST = 20_000
WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, n: Column) -> Column:
    """Words within 3-word windows that occur twice or more. Windows are compared by XXH64 of their three words."""
    grams = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), n - 2)

    def covered(p: Column) -> Column:
        m = F.size(p)
        gaps = F.zip_with(F.slice(p, F.lit(1), m - 1), F.slice(p, F.lit(2), m - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.when(m > 0, F.aggregate(gaps, F.lit(3), lambda a, b: a + b)).otherwise(0)

    def places(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        equal = lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when(a.x == b.x, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(let(ordered, equal))))

    found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(places(g), covered)))
    return F.when(n < 3, F.lit(0)).otherwise(found)


def statistics(df: DataFrame, text: str = "text", keep: list[Column] = ()) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and n_lines, n_upper, n_marks for the vectors."""
    t = df.select(*keep, text_of(text).alias("_text"))
    t = t.withColumn("_trim", F.btrim(F.col("_text"), F.lit(WHITE)))
    t = t.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPACE)))
    t = t.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    n, long = F.size("_words"), lambda c: c.cast("long")
    return t.select(
        *[c for c in t.columns if not c.startswith("_")],
        long(n).alias("n_words"),
        long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        long(F.regexp_count("_text", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("_words"), n)).alias("n_repeat_words"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.regexp_count("_text", F.lit(r"\p{Lu}"))).alias("n_upper"),
        long(F.regexp_count("_text", F.lit(r"[!?.,;:]"))).alias("n_marks"),
    )


#: Coordinates of a vector, and the names of what is kept by coordinate or by pair of them.
P = 6
XS, MEANS, PAIRS = [f"x{i}" for i in range(P)], [f"m{i}" for i in range(P)], [(i, j) for i in range(P) for j in range(i + 1)]


def vector() -> list[Column]:
    """The transformed statistics: logarithms of ratios, in fixed point."""
    c = F.col
    ratio = lambda a, b, k: F.log1p(k * c(a) / (c(b) + 10))
    made = [F.log((c("word_chars") + 10) / (c("n_words") + 2)), ratio("n_symbols", "word_chars", 30), ratio("n_dup_lines", "n_lines", 3), ratio("n_repeat_words", "n_words", 3), ratio("n_upper", "word_chars", 10), ratio("n_marks", "word_chars", 10)]
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(made)]


def _distance(t: DataFrame) -> DataFrame:
    """Adds d2 from x0.., m0.. and the lower triangle l_i_j."""
    z = [f"(x{i} - m{i}{''.join(f' - l_{i}_{k} * z{k}' for k in range(i))}) / l_{i}_{i} as z{i}" for i in range(P)]
    return t.selectExpr("*", *z, " + ".join(f"z{i} * z{i}" for i in range(P)) + " as d2")


def _triangle(t: DataFrame, kept: list[str]) -> DataFrame:
    """kept, and Cholesky's factor of the covariance v_i_j, with FLOOR squared on the diagonal."""
    made = []
    for i, j in PAIRS:
        rest = f"v_{i}_{j}{f' + {FLOOR**2}' if i == j else ''}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
        made.append(f"sqrt(greatest({rest}, 1d)) as l_{i}_{j}" if i == j else f"({rest}) / l_{j}_{j} as l_{i}_{j}")
    return t.selectExpr(*kept, *MEANS, *made)


def _sized(small: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows (each of a few hundred bytes at most); else joins shuffle, and AQE splits skewed pools."""
    return F.broadcast(small) if small.count() <= BROADCAST else small


def _joined(vectors: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    return vectors.join(_sized(estimate.withColumnRenamed("pool", "p")), F.col("pool") == F.col("p"), how).drop("p")


def _starts(vectors: DataFrame, space: Workspace, smallest: int) -> DataFrame:
    """pool, start, MEANS, the triangle: three starts a pool."""
    middle = vectors.groupBy("pool").agg(F.expr("count(1) as n"), *[F.expr(f"median({x}) as m{i}") for i, x in enumerate(XS)]).where(f"n >= {smallest}")
    middle = space.write(middle.drop("n"), "medians")
    spread = _joined(vectors, middle).groupBy("pool").agg(*[F.expr(f"first({m}) as {m}") for m in MEANS], *[F.expr(f"greatest({FLOOR}d, 1.4826 * median(abs({x} - m{i}))) as s{i}") for i, x in enumerate(XS)])
    spread = space.write(spread, "deviations")
    t = _joined(vectors, spread).selectExpr("pool", *[f"({x} - m{i}) / s{i} as z{i}" for i, x in enumerate(XS)])
    t = t.selectExpr("*", "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(P)) + ") as far")
    t = t.selectExpr("pool", *[f"if(far > 0, z{i} / far, 0d) as a{i}" for i in range(P)], *[f"tanh(z{i}) as b{i}" for i in range(P)])
    fine = "sum(cast(round({0}{1} * {0}{2} * " + str(FINE) + ") as long)) / (count(1) * " + str(FINE) + ")"
    t = t.groupBy("pool").agg(*[F.expr(f"{P} * {fine.format('a', i, j)} as v1_{i}_{j}") for i, j in PAIRS], *[F.expr(f"{fine.format('b', i, j)} as v2_{i}_{j}") for i, j in PAIRS])
    t = spread.join(t.withColumnRenamed("pool", "p"), F.expr("pool = p")).drop("p")
    share = lambda k, i, j: f"v{k}_{i}_{j}" if k else "1d" if i == j else "0d"
    made = [f"named_struct('start', {k}, " + ", ".join(f"'v_{i}_{j}', {share(k, i, j)} * s{i} * s{j}" for i, j in PAIRS) + ")" for k in range(STARTS)]
    t = t.selectExpr("pool", *MEANS, f"inline(array({', '.join(made)}))")
    return space.write(_triangle(t, ["pool", "start"]), "starts")


def _buckets(vectors: DataFrame, now: DataFrame, space: Workspace, sums: bool) -> DataFrame:
    """Per pool, start and bucket of distance: n, the sums of its vectors, and how many come before it and in all."""
    t = _distance(_joined(vectors, now)).selectExpr("pool", "start", *XS, f"cast(floor(ln(1 + d2) * {BUCKETS}) as int) as bucket")
    more = [f"sum({x}) as s_{x}" for x in XS] + [f"sum(x{i} * x{j}) as q_{i}_{j}" for i, j in PAIRS] if sums else []
    t = space.write(t.groupBy("pool", "start", "bucket").agg(F.expr("count(1) as n"), *map(F.expr, more)), "buckets")
    before = "coalesce(sum(n) over (partition by pool, start order by bucket rows between unbounded preceding and 1 preceding), 0)"
    return t.selectExpr("*", f"{before} as before", "sum(n) over (partition by pool, start) as all")


def _concentrated(vectors: DataFrame, now: DataFrame, space: Workspace, share: float) -> DataFrame:
    """The mean and covariance of the nearest share, and the logarithm of the determinant."""
    t = _buckets(vectors, now, space, True).where(f"before < ceil((all + {P + 1}) * {share}d)")
    t = t.groupBy("pool", "start").agg(*map(F.expr, ["sum(n) as n", *[f"sum(s_{x}) as s_{x}" for x in XS], *[f"sum(q_{i}_{j}) as q_{i}_{j}" for i, j in PAIRS]]))
    t = t.selectExpr("pool", "start", *[f"s_x{i} / n as m{i}" for i in range(P)], *[f"q_{i}_{j} / n - s_x{i} / n * (s_x{j} / n) as v_{i}_{j}" for i, j in PAIRS])
    t = _triangle(t, ["pool", "start"]).selectExpr("*", " + ".join(f"2 * ln(l_{i}_{i})" for i in range(P)) + " as log_det")
    return space.write(t, "step")


def estimates(vectors: DataFrame, space: Workspace, share: float = SHARE, steps: int = STEPS, smallest: int = SMALLEST, deviations: float = DEVIATIONS) -> DataFrame:
    """From (pool, x0..): a row a pool of at least `smallest` rows with m0.., l_i_j, log_det, scale and cutoff of the squared distances."""
    now = _starts(vectors, space, smallest)
    for _ in range(steps):
        now = _concentrated(vectors, now.drop("log_det"), space, share)
    least = now.groupBy("pool").agg(F.min(F.struct("log_det", "start")).alias("best"))
    now = space.write(now.join(least.select(F.col("pool").alias("p"), F.col("best.start").alias("s")), (F.col("pool") == F.col("p")) & (F.col("start") == F.col("s"))).drop("p", "s"), "best")
    for _ in range(MORE_STEPS):
        now = _concentrated(vectors, now.drop("log_det"), space, share)
    t = _buckets(vectors, now, space, False)
    root = f"cbrt((exp((bucket + 0.5) / {BUCKETS}) - 1) / {CONSISTENCY})"
    t = t.groupBy("pool").agg(F.expr(f"max(if(before < 0.25 * all, {root}, null)) as low"), F.expr(f"max(if(before < 0.5 * all, {root}, null)) as mid"))
    t = t.selectExpr("pool as p", f"greatest({LEAST_CUTOFF}, pow(mid + {deviations / QUARTILE} * (mid - low), 3)) as cutoff")
    return space.write(now.join(t, F.expr("pool = p")).drop("p", "start").withColumn("scale", F.lit(CONSISTENCY)), "estimates")


def _pools(t: DataFrame, smallest: int, space: Workspace) -> DataFrame:
    """lang and source to a pool: their own, that of small sources of a language, or that of what is still small."""
    sizes = t.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    of = space.write(sizes.withColumn("level", F.when(F.col("n") >= smallest, 0).otherwise(1)), "sizes")
    small = of.where("level = 1").groupBy("lang").agg(F.sum("n").alias("m")).where(F.col("m") < smallest).select(F.col("lang").alias("few"))
    of = of.join(small, F.col("lang") == F.col("few"), "left").withColumn("level", F.when((F.col("level") == 1) & F.col("few").isNotNull(), 2).otherwise(F.col("level")))
    pool = F.when(F.col("level") == 0, F.to_json(F.array("lang", "source"))).when(F.col("level") == 1, F.to_json(F.array("lang"))).otherwise("[]")
    return space.write(of.select(F.col("lang").alias("l"), F.col("source").alias("s"), pool.alias("pool")), "pools")


def judged(df: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", source: str = "source", columns: list[str] | None = None, deviations: float = DEVIATIONS, smallest: int = SMALLEST) -> DataFrame:
    """One row per input row: row (struct of `columns`), the statistics, base_failed, d2 and its pool's cutoff (null without a verdict), kept."""
    space = Workspace(df.sparkSession)
    key = lambda c, as_: F.coalesce(F.concat(F.lit("="), name(c).cast("string")), F.lit("")).alias(as_)
    t = statistics(df, text, [packed(df, columns).alias("row"), key(lang, "lang"), key(source, "source")])
    t = space.write(t.select("*", *vector()), "statistics")
    pools = _pools(t, smallest, space)
    t = t.join(_sized(pools), (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s"))).drop("l", "s")
    found = estimates(t.select("pool", *XS), space, smallest=smallest, deviations=deviations)
    out = _distance(_joined(t, found, "left"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    d2 = F.col("d2") / F.col("scale")
    return out.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), d2.alias("d2"), "cutoff", (~failed & F.coalesce(d2 <= F.col("cutoff"), F.lit(True))).alias("kept"))


def clean(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents that no rule rejects, with the input's columns."""
    return judged(df, text, id).where("kept").select("row.*")

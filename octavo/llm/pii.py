"""Personal data by bootstrapped contextual extraction.

Base patterns (email, ip, card, phone; checked for parts, Luhn and digit counts) give spans and
are the seeds, as are secrets: keys of known forms, and what is assigned to a name like token or password. The two words
before a seed are a lexical pattern (quotes separate words like white space, and = is a word of its own). A graph joins patterns and
instances (identifier-shaped tokens, base or not). In each round
  a pattern's confidence in a kind is the sum of its instances' scores over all places where its two words stand, if at least SUPPORT instances speak for it;
  an instance's score is the noisy-or of its patterns' confidences (a seed's is 1).
Tokens that no seed covers, of the kind's shape, after a pattern of confidence PATTERN or with a
score of INSTANCE become spans too. Base spans always stay.

All native: regexes give matches, and the text between them gives positions; no Python on the executors.

Scale: texts are read once for matches, and once more to count the words before places, if any pattern has support: word
pairs that miss a bit set of the patterns' hashes (at most BITS bits, whatever the corpus) are dropped as soon as they are made, and
the rest is summed per task before one shuffle of a row a pair; the set's false hits vanish in the join with the patterns. The
graph holds matches only, pre-aggregated by (pattern, instance); hot patterns and instances are
sums with map-side partials, and joins are with small tables of scores (broadcast by size, else AQE splits). Windows go by text.

Matching is linear in the text: patterns start where a run of their characters starts, and repetitions don't backtrack,
which leaves the same leftmost matches. A match's words are looked for in the NEAR characters before it, then in FAR, then in all.

Defined cases: null is the empty text; a text of any length is scanned whole, and words may be of any length; equal spans of several rows are
found row by row; an empty table gives an empty result; the input's columns stay in the struct `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Workspace, packed, text_of

KINDS = ["email", "ip", "card", "phone"]
#: As the contract's patterns, but never retried within a run: \G is where the last match ended.
PATTERNS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: A further kind, which has no base pattern: seeds are access keys of two public forms, and values assigned to a name of NAMES.
SECRET = len(KINDS)
NAMES = r"(?i:token|password|passwd|secret|api_?key|access_?key)[\"']?[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?"
SECRETS = NAMES + r"[0-9A-Za-z_/+.-]{12,}+|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36,}+"
#: A token that might identify: runs without white space that hold an @ or a digit.
CANDIDATE = SECRET + 1
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What goes before the identifier in a token: a name and =, quotes and brackets.
HEAD = r"^(?:.*=(?=[^=]*[0-9@]))?[^0-9A-Za-z@+]*"
BEFORE = r"[\x20\x09-\x0D]([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++$"
#: Characters before a match in which its two words are looked for, before all are.
NEAR, FAR = 128, 4096
ROUNDS, SUPPORT, PATTERN, INSTANCE = 3, 3, 0.5, 0.8
#: The most bits of the set that word pairs are held against (a power of two); more patterns than that only make it less selective.
BITS = 1 << 19


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: int, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == 1:  # a part of any length, zeros before it not counting
        return F.forall(F.split(x, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^(?:|[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == 2:
        return n.between(12, 19) & F.call_function("luhn_check", _digits(x))
    if kind == SECRET:
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    return n.between(9, 15) if kind == 3 else F.lit(True)


def _shaped(kind: Column, x: Column) -> Column:
    """Whether a token could be of the kind, though the base pattern missed it."""
    n = F.length(_digits(x))
    return (
        F.when(kind == 0, x.contains("@")).when(kind == 1, x.rlike(r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){2,}$") & (n > 0)).when(kind == 2, n.between(8, 19) & ~x.contains("@"))
        .when(kind == 3, n.between(6, 15) & ~x.contains("@")).otherwise(x.rlike("^[0-9A-Za-z_/+-]{8,}$") & x.rlike("[A-Za-z]") & (n > 0))
    )


def _worded(text: Column) -> Column:
    """The text with its words between white space."""
    return F.regexp_replace(F.translate(text, "\"'", "  "), "=", " = ")


def _context(parts: Column, gap: Column, i: Column, head: Column) -> Column:
    """The two words before match i of parts (each the text from the end of a match to that of the next one), or null."""
    near = F.right(F.concat(F.coalesce(F.right(F.get(parts, i - 2), F.lit(NEAR)), F.lit("")), F.coalesce(F.right(F.get(parts, i - 1), F.lit(NEAR)), F.lit("")), F.right(gap, F.lit(NEAR)), head), F.lit(NEAR))
    whole = F.concat(F.lit(" "), F.array_join(F.slice(parts, F.lit(1), i), ""), gap, head)
    found = lambda x: F.nullif(F.regexp_extract(_worded(x), BEFORE, 0), F.lit(""))
    ctx = F.when(near.rlike("[\\x20\\x09-\\x0D\"'=]$"), F.coalesce(found(near), found(F.right(whole, F.lit(FAR))), found(whole)))
    return F.lower(F.regexp_replace(F.btrim(ctx, F.lit(" \t\n\x0b\x0c\r")), SPACE, " "))


def _steps(kind: int):
    """From the struct of a text's gaps, values and parts to the matches of a kind."""

    def steps(x: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            gap = F.get(x["gaps"], i)
            named = F.regexp_extract(value, "^" + NAMES, 0) if kind == SECRET else F.regexp_extract(value, "^.*=(?=[^=]*[0-9@])", 0) if kind == CANDIDATE else F.lit("")
            head = F.length(named) if kind == SECRET else F.length(F.regexp_extract(value, HEAD, 0)) if kind == CANDIDATE else F.lit(0)
            tail = F.length(F.regexp_extract(value, r"[^0-9A-Za-z]*$", 0)) if kind == CANDIDATE else F.lit(0)
            own = F.substring(value, head + 1, F.length(value) - head - tail) if kind >= SECRET else value
            return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(gap).alias("gap"), head.alias("head"), (F.length(value) - tail).alias("long"), tail.alias("rest"), own.alias("value"), _context(x["parts"], gap, i, named).alias("ctx"))

        return F.transform(x["values"], one)

    return steps


def _matches(docs: DataFrame) -> DataFrame:
    """From (rid, text): rid, kind (CANDIDATE: a token), start, end, value, ctx (the two words before, or null) of valid matches."""
    arrays, text = [], F.col("text")
    gates = {0: text.contains("@"), 3: text.contains("+"), SECRET: text.contains("=") | text.contains(":") | text.contains("AKIA") | text.contains("_")}
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,head:int,long:int,rest:int,value:string,ctx:string>>")
    for kind, pattern in enumerate([*PATTERNS, SECRETS, TOKEN]):
        gaps, values = F.split(text, pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        parts = F.struct(gaps.alias("gaps"), values.alias("values"), F.zip_with(gaps, values, lambda g, v: F.concat(g, v)).alias("parts"))
        arrays.append(F.when(gates.get(kind, F.lit(True)) & text.rlike(pattern), F.transform(F.array(parts), _steps(kind))[0]).otherwise(none))
    d = docs.select("rid", F.explode(F.concat(*arrays)).alias("s")).select("rid", "s.*")
    d = d.repartition("rid")
    passed = F.sum(F.col("gap").cast("long") + F.col("long") + F.col("rest")).over(Window.partitionBy("rid", "kind").orderBy("i"))
    d = d.withColumn("end", passed - F.col("rest"))
    valid = F.when(F.col("kind") == CANDIDATE, F.lit(True))
    for kind in range(CANDIDATE):
        valid = valid.when(F.col("kind") == kind, _valid(kind, F.col("value")))
    return d.select("rid", "kind", (F.col("end") - F.col("long") + F.col("head")).alias("start"), "end", "value", "ctx", valid.alias("valid")).where("valid and end > start").drop("valid")


def _uncovered(m: DataFrame) -> DataFrame:
    """Seeds, and the tokens that overlap none, in one order by text."""
    token = F.col("kind") == CANDIDATE
    by = Window.partitionBy("rid").orderBy("start", "end", "kind")
    ends = F.max(F.when(~token, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = F.min(F.when(~token, F.col("start"))).over(Window.partitionBy("rid").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    m = m.withColumn("_e", ends).withColumn("_s", starts)
    return m.where(~token | ((F.coalesce("_e", F.lit(-1)) <= F.col("start")) & (F.coalesce("_s", F.col("end")) >= F.col("end")))).drop("_e", "_s")


def _bit_set(known: DataFrame, n: int) -> tuple[Column, int]:
    """The hashes h of known as a literal array of longs, and the hash bits that choose one of them. At most BITS / 64 rows reach the driver."""
    longs = max(64, min(BITS, 1 << (32 * n - 1).bit_length()) // 64)
    of, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(longs - 1)), F.expr("shiftleft(1L, cast(h & 63 as int))")
    held = {r.x: r.bits for r in known.groupBy(of.alias("x")).agg(F.bit_or(bit).alias("bits")).collect()}
    return F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(longs))), ",").cast("array<bigint>"), longs


def _places(docs: DataFrame, patterns: DataFrame, space: Workspace) -> DataFrame:
    """ctx, places: how often the two words of each pattern stand before another word."""
    known = space.write(patterns.select("ctx", F.xxhash64(F.split_part("ctx", F.lit(" "), F.lit(1)), F.split_part("ctx", F.lit(" "), F.lit(2))).alias("h")), "supported")
    bits, longs = _bit_set(known, known.count())
    words = F.transform(F.split(F.btrim(_worded(F.col("text")), F.lit(" \t\n\x0b\x0c\r")), SPACE), lambda w: F.lower(w))
    t = docs.select(words.alias("words")).where(F.size("words") > 2)
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1)))
    held = lambda h: F.getbit(F.get(bits, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(longs - 1)).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    counts = t.select(F.explode(pairs).alias("h")).where(held(F.col("h"))).groupBy("h").agg(F.count(F.lit(1)).alias("places"))
    return space.write(counts.join(known, "h").select("ctx", "places"), "places")


def discovered(docs: DataFrame, m: DataFrame, space: Workspace, rounds: int = ROUNDS, support: int = SUPPORT, pattern: float = PATTERN, instance: float = INSTANCE) -> DataFrame | None:
    """rid, kind, start, end of the spans that patterns add; None if no pattern has support."""
    edges = m.where(F.col("ctx").isNotNull()).groupBy("ctx", "kind", F.lower("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    edges = space.write(edges, "graph")
    seeds = edges.where(F.col("kind") < CANDIDATE)
    patterns = seeds.groupBy("ctx").agg(F.count_distinct("value").alias("d")).where(F.col("d") >= support).select("ctx")
    patterns = space.write(patterns, "patterns")
    if patterns.isEmpty():
        return None
    places = _places(docs, patterns, space)
    edges = space.write(edges.join(places, "ctx"), "edges")
    # What a token might be: one row for each kind whose shape it has.
    kinds = F.explode(F.array(*[F.lit(k) for k in range(CANDIDATE)]))
    tokens = edges.where(F.col("kind") == CANDIDATE).drop("kind").withColumn("kind", kinds).where(_shaped(F.col("kind"), F.col("value")))
    seeds = edges.where(F.col("kind") < CANDIDATE).withColumn("score", F.lit(1.0))
    scores = None
    for _ in range(rounds):
        own = tokens.withColumn("score", F.lit(0.0)) if scores is None else tokens.join(scores, ["kind", "value"], "left").fillna(0.0, ["score"])
        graph = seeds.select("ctx", "kind", "value", "n", "places", "score").unionByName(own.select("ctx", "kind", "value", "n", "places", "score"))
        sure = graph.groupBy("ctx", "kind").agg(F.least(F.lit(0.999), F.sum(F.col("n") * F.col("score")) / F.greatest(F.max("places"), F.lit(1))).alias("conf"), F.sum(F.when(F.col("score") >= instance, 1).otherwise(0)).alias("d"))
        sure = space.write(sure.where((F.col("d") >= support) & (F.col("conf") >= pattern)).select("ctx", "kind", "conf"), "confidence")
        scores = tokens.join(sure, ["ctx", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        scores = space.write(scores, "scores")
    t = m.where(F.col("kind") == CANDIDATE).drop("kind").withColumn("value", F.lower("value")).withColumn("kind", kinds).where(_shaped(F.col("kind"), F.col("value")))
    t = t.join(sure, ["ctx", "kind"], "left").join(scores, ["kind", "value"], "left").where(F.col("conf").isNotNull() | (F.col("score") >= instance))
    # Of several kinds the likeliest, and the first listed of equals.
    return t.groupBy("rid", "start", "end").agg(F.min_by("kind", F.struct(-F.coalesce("score", F.lit(0.0)), "kind")).alias("kind"))


def find(df: DataFrame, text: str = "text", columns: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Two tables: rid, row of each input row; and rid, kind (a number of KINDS, or SECRET), start, end, base of each span."""
    space = Workspace(df.sparkSession)
    docs = df.select(packed(df, columns).alias("row"), text_of(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    if columns is None or text in columns:
        docs = space.write(docs.select("row", "rid"), "documents").withColumn("text", F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")))
    else:
        docs = space.write(docs, "documents")
    m = space.write(_uncovered(_matches(docs.select("rid", "text"))), "matches")
    spans = m.where(F.col("kind") < CANDIDATE).select("rid", "kind", "start", "end", (F.col("kind") < SECRET).alias("base"))
    more = discovered(docs.select("text"), m, space, **options)
    if more is not None:
        spans = spans.unionByName(more.select("rid", "kind", "start", "end", F.lit(False).alias("base")))
    return docs, spans


def _named(kind: Column, form: str = "{}") -> Column:
    return F.element_at(F.array(*[F.lit(form.format(k)) for k in [*KINDS, "secret"]]), kind + 1)


def digests(df: DataFrame, text: str = "text", columns: list[str] | None = None, **options) -> DataFrame:
    """One row per input row: row, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of these kinds, written kind:start:end), secrets (start:end), n_spans (with secrets)."""
    docs, spans = find(df, text, columns, **options)
    secret = F.col("kind") == SECRET
    one = F.struct("start", "kind", "end", F.when(secret, F.concat_ws(":", "start", "end")).otherwise(F.concat_ws(":", _named(F.col("kind")), "start", "end")).alias("s"), "base")
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{x}") for k, x in enumerate(KINDS)]
    by = spans.groupBy("rid").agg(*counts, F.count(F.lit(1)).alias("n_spans"), F.array_sort(F.collect_list(one)).alias("all")).withColumnRenamed("rid", "r")
    written = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: x.s), ","), F.lit(""))
    t = docs.select("row", "rid").join(by, F.col("rid") == F.col("r"), "left")
    base = written(F.filter("all", lambda x: x.base))
    return t.select(
        "row", *[F.coalesce(f"n_{x}", F.lit(0)).cast("long").alias(f"n_{x}") for x in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.filter("all", lambda x: x.kind != SECRET)).alias("spans"),
        written(F.filter("all", lambda x: x.kind == SECRET)).alias("secrets"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )


def redact(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The input's rows and columns, with each span (overlapping ones as one) replaced by its kind in angle brackets, like <email>."""
    docs, spans = find(df, text, **options)
    by = Window.partitionBy("rid").orderBy("start", "end", "kind")
    far = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    t = spans.withColumn("new", F.coalesce(F.col("start") >= far, F.lit(True)).cast("int"))
    t = t.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.groupBy("rid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    t = t.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", _named(F.col("kind"), "<{}>").alias("mark")))).alias("cuts")).withColumnRenamed("rid", "r")
    t = docs.join(t, F.col("rid") == F.col("r"), "left")
    body, cuts = F.col("text"), F.col("cuts")
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda c: c.end))
    tos = F.concat(F.transform(cuts, lambda c: F.struct(c.start.alias("to"), c.mark.alias("mark"))), F.array(F.struct(F.length(body).cast("long").alias("to"), F.lit("").alias("mark"))))
    made = F.array_join(F.zip_with(froms, tos, lambda a, b: F.concat(F.substring(body, (a + 1).cast("int"), (b.to - a).cast("int")), b.mark)), "")
    fields = [F.when(cuts.isNull(), F.col("row").getField(c)).otherwise(made).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns]
    return t.select(*fields)

"""License scans with ordered signature rules.

Rules come from tables of licences, their names and versions, times the wordings in which
they are invoked: some hundreds of regexes over a text's words. A rule is gated by a keyword: only texts that
hold the keyword meet its regex. Rules have a priority by wording; a detection whose words lie within
those of a detection of higher priority (or of the same, if longer or listed earlier) is suppressed.

All native: no Python on the executors. A text becomes its words joined by single spaces; the words of a
keyword are looked up by one alternation, and only texts with a keyword are joined to the rules,
a table of fixed size made here, so that broadcasting it is bounded.

Base phrases are counted on every text by themselves and never suppressed.

Scale: one pass over the texts; (text, rule) pairs exist only for keywords met. Detections go by text, of
which each holds at most its own; suppression takes one sort and running maxima, not pairs.

Defined cases: null is the empty text (no words, score 0); repeated rows are scanned row by row;
empty tables give empty results; the input's columns stay in the struct `row`. Long texts are scanned
whole; a text's words and its own detections are what one task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, packed, text_of

#: What parts words: ASCII but for letters and digits. Matching ignores the case of A-Z alone.
PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrase, label. Words are single.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licences: label, keyword (a word each of its rules holds), names as words, versions (empty: unversioned).
LICENSES = [
    ("apache", "apache", ["apache", "apache software"], ["", "1 0", "1 1", "2 0", "2"]),
    ("mit", "mit", ["mit", "mit x11", "massachusetts institute of technology mit"], [""]),
    ("bsd", "bsd", ["bsd", "new bsd", "modified bsd", "simplified bsd", "original bsd", "freebsd bsd", "bsd style"], ["", "2 clause", "3 clause", "4 clause"]),
    ("isc", "isc", ["isc", "internet systems consortium isc"], [""]),
    ("gpl", "gpl", ["gpl", "gnu gpl"], ["", "1", "2", "3", "1 0", "2 0", "3 0"]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl"], ["", "2", "3", "2 0", "2 1", "3 0"]),
    ("agpl", "agpl", ["agpl", "gnu agpl"], ["", "3", "3 0"]),
    ("gpl", "general", ["gnu general public"], ["", "1", "2", "2 1", "3"]),
    ("lgpl", "lesser", ["gnu lesser general public", "lesser general public"], ["", "2 1", "3", "3 0"]),
    ("lgpl", "library", ["gnu library general public", "library general public"], ["", "2", "2 0"]),
    ("agpl", "affero", ["gnu affero general public", "affero general public"], ["", "3", "3 0"]),
    ("mpl", "mozilla", ["mozilla public"], ["", "1 0", "1 1", "2 0"]),
    ("mpl", "mpl", ["mpl"], ["", "1 0", "1 1", "2 0"]),
    ("epl", "eclipse", ["eclipse public"], ["", "1 0", "2 0"]),
    ("epl", "epl", ["epl"], ["", "1 0", "2 0"]),
    ("cddl", "cddl", ["cddl"], ["", "1 0", "1 1"]),
    ("cddl", "cddl", ["common development and distribution license cddl"], ["", "1 0"]),
    ("artistic", "artistic", ["artistic", "perl artistic"], ["", "1 0", "2 0"]),
    ("boost", "boost", ["boost software", "boost"], ["", "1 0"]),
    ("zlib", "zlib", ["zlib", "zlib libpng"], [""]),
    ("unlicense", "unlicense", ["unlicense", "the unlicense"], [""]),
    ("wtfpl", "wtfpl", ["wtfpl"], ["", "2"]),
    ("eupl", "eupl", ["eupl", "european union public eupl"], ["", "1 0", "1 1", "1 2"]),
    ("python", "python", ["python software foundation", "python"], ["", "2"]),
    ("php", "php", ["php"], ["", "3 0", "3 01"]),
    ("openssl", "openssl", ["openssl"], [""]),
    ("sil-ofl", "ofl", ["ofl", "sil ofl", "sil open font license ofl"], ["", "1 0", "1 1"]),
    ("odbl", "odbl", ["odbl", "open database license odbl"], ["", "1 0"]),
    ("cc0", "cc0", ["cc0", "creative commons cc0"], ["", "1 0"]),
    ("cc", "commons", ["creative commons", "creative commons attribution", "creative commons attribution sharealike", "creative commons attribution share alike", "creative commons attribution noncommercial", "creative commons attribution non commercial", "creative commons attribution noderivatives", "creative commons attribution no derivatives"], ["", "1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", "cc", ["cc by", "cc by sa", "cc by nc", "cc by nd", "cc by nc sa", "cc by nc nd"], ["", "1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("ms-pl", "microsoft", ["microsoft public", "microsoft reciprocal", "microsoft limited public"], [""]),
    ("proprietary", "proprietary", ["proprietary", "proprietary and confidential"], [""]),
]

#: Wordings from the strongest on: pattern around {n} (name) and {v} (version), priority, confidence.
WORDINGS = [
    (r"spdx license identifier {n}(?: {v})?(?: only| or later)?", 90, 0.99),
    (r"(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?{n}(?: license| licence)?(?: version| v)? ?{v}(?: license| licence)?", 80, 0.95),
    (r"(?:the )?{n} (?:license|licence)(?: version| v)? ?{v}", 70, 0.9),
    (r"(?:license|licence) (?:the )?{n}(?: version| v)? ?{v}", 60, 0.85),
]

#: Rules of their own: label, keyword, pattern, priority, confidence.
SINGLE = [
    ("public-domain", "domain", r"(?:released|dedicated|placed|put|is) (?:in|into|to) the public domain", 75, 0.9),
    ("public-domain", "domain", r"public domain", 30, 0.5),
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy", 95, 0.99),
    ("mit", "warranty", r"the software is provided as is without warranty of any kind", 50, 0.8),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 95, 0.99),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 95, 0.98),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 95, 0.99),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license", 96, 0.99),
    ("apache", "apache", r"you may obtain a copy of the license at(?: https?)? www apache org licenses license 2 0", 95, 0.99),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 95, 0.99),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 40, 0.6),
    ("copyright", "copyright", r"copyright(?: c)?(?: by)? [0-9a-z]+", 20, 0.4),
    ("reserved", "reserved", r"(?:all|some) rights (?:are )?reserved(?: worldwide)?", 45, 0.8),
    ("reserved", "reserved", r"no rights reserved", 45, 0.6),
    ("license-notice", "license", r"see (?:the )?(?:file )?license (?:file )?for (?:more )?(?:details|information)", 65, 0.7),
    ("license-notice", "license", r"(?:subject to|under) the terms of (?:the|this) license", 35, 0.5),
    ("license-notice", "terms", r"terms and conditions (?:apply|of use)", 25, 0.4),
]

#: Names joined with their versions, as single words: label, keyword, names. The further numbers of a version may follow as words.
JOINED = [
    *[(name, f"{name}{v}", [f"{name}{v}", f"gnu {name}{v}"]) for name, majors in (("gpl", "123"), ("lgpl", "23"), ("agpl", "3")) for n in majors for v in (f"v{n}", n)],
    *[("apache", w, [w]) for w in ("apachev2", "apache2", "asl2")],
    ("mpl", "mplv2", ["mplv2"]), ("mpl", "mpl2", ["mpl2"]), ("epl", "eplv2", ["eplv2"]), ("epl", "epl2", ["epl2"]),
]

RULE = "rule int, keyword string, label string, pattern string, priority int, confidence double"


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """In order; a pattern starts after and ends before a space. Versions of a name are one alternation; a version-less name ends without one."""
    made = []
    for label, keyword, names, versions in LICENSES:
        exact = "|".join(sorted((v for v in versions if v), key=len, reverse=True))
        for words in names:
            for wording, priority, confidence in WORDINGS:
                if exact:
                    made.append((keyword, label, wording.replace("{n}", words).replace("(?: {v})?", " {v}").replace("{v}", f"(?:{exact})").replace(" ?(?:", " (?:"), priority + 5, confidence))
                if "" in versions:
                    made.append((keyword, label, wording.replace("{n}", words).replace("(?: {v})?", "").replace(" ?{v}", ""), priority, confidence))
            if len(words) > 3 or " " in words:
                made.append((keyword, label, f"{words}(?: v)? (?:{exact})" if exact else words, 15 if exact else 10, 0.5))
    for label, keyword, names in JOINED:
        for words in names:
            for wording, priority, confidence in WORDINGS:
                made.append((keyword, label, wording.replace("{n}", f"{words}(?: [0-9])?").replace("(?: {v})?", "").replace(" ?{v}", ""), priority + 5, confidence))
            made.append((keyword, label, f"{words}(?: [0-9])?", 15, 0.5))
    made += SINGLE_AS_RULES
    return [(i, k, label, rf"(?i)(?<= )(?:{p})(?= )", priority, c) for i, (k, label, p, priority, c) in enumerate(made)]


SINGLE_AS_RULES = [(keyword, label, pattern, priority, confidence) for label, keyword, pattern, priority, confidence in SINGLE]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), RULE)


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def scan(df: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """One row per input row: row, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (rule, label, first and end word, confidence)."""
    spark, space = df.sparkSession, Workspace(df.sparkSession)
    t = df.select(packed(df, columns).alias("row"), F.monotonically_increasing_id().alias("rid"), F.regexp_replace(text_of(text), PARTING, " ").alias("w"))
    t = t.withColumn("w", F.concat(F.lit(" "), F.btrim("w", F.lit(" ")), F.lit(" ")))
    n = F.when(F.col("w") == "  ", 0).otherwise(spaces(F.col("w")) - 1).cast("long")
    t = t.select("row", "rid", "w", n.alias("n_words"))
    found = []
    for phrase, label in BASE.items():
        long = len(phrase.split())
        # Pieces between the places: what stands before the first and after the last gives their words.
        parts = F.when(F.lower("w").contains(phrase), F.split("w", rf"(?i)(?<= ){phrase}(?= )", -1))
        t = t.withColumn("_p", F.coalesce(parts, F.array(F.lit("")))).withColumn("_n", (F.size("_p") - 1).cast("long"))
        t = t.withColumn(f"_b{len(found)}", F.when(F.col("_n") > 0, F.struct(F.col("_n").alias("n"), (spaces(F.element_at("_p", 1)) - 1).cast("long").alias("first"), (F.col("n_words") - (spaces(F.element_at("_p", -1)) - 1) - long).cast("long").alias("last")))).drop("_p", "_n")
        found.append((f"_b{len(found)}", label))
    least = lambda how, field: how(*[F.col(f"{b}.{field}") for b, _ in found])
    keywords = sorted({r[1] for r in rules()})
    hit = F.array_distinct(F.regexp_extract_all(F.col("w"), F.lit(rf"(?i)(?<= )({'|'.join(keywords)})(?= )"), F.lit(1)))
    t = t.select(
        "row", "rid", "n_words", sum((F.coalesce(f"{b}.n", F.lit(0)) for b, _ in found), F.lit(0)).cast("long").alias("n_base"),
        least(F.least, "first").alias("first_word"), least(F.greatest, "last").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*[F.when(F.col(b).isNotNull(), F.lit(label)) for b, label in found]))).alias("base"),
        F.array_distinct(F.transform(hit, lambda x: F.lower(x))).alias("hit"), "w",
    )
    t = t.withColumn("w", F.when(F.size("hit") > 0, F.col("w")))
    t = space.write(t, "words")
    detections = space.write(suppressed(detected(t, rule_table(spark))), "detections")
    by = detections.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("first", "end", "rule", "label", "confidence"))).alias("detections"),
        F.array_sort(F.collect_set("label")).alias("found"),
    ).withColumnRenamed("rid", "r")
    t = t.drop("w", "hit").join(by, F.col("rid") == F.col("r"), "left")
    none = F.array().cast("array<string>")
    sure = F.aggregate(F.transform("found", lambda x: F.array_max(F.transform(F.filter("detections", lambda d: d.label == x), lambda d: d.confidence))), F.lit(1.0), lambda a, c: a * (1 - c))
    base = F.when(F.size("base") > 0, F.lit(0.2)).otherwise(F.lit(1.0))
    return t.select(
        "row", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.round(1 - F.coalesce(sure, F.lit(1.0)) * base, 6).alias("score"), "detections",
    )


def detected(t: DataFrame, table: DataFrame) -> DataFrame:
    """From (rid, w, hit): rid, rule, label, priority, confidence, first, end (words), for each place of a rule whose keyword the text holds."""
    pairs = t.where(F.size("hit") > 0).select("rid", "w", F.explode("hit").alias("k")).join(F.broadcast(table), F.col("k") == F.col("keyword"))
    pairs = pairs.where(F.expr("w rlike pattern")).select("rid", "rule", "label", "priority", "confidence", F.split("w", F.col("pattern"), F.lit(-1)).alias("parts"), F.regexp_extract_all("w", F.col("pattern"), F.lit(0)).alias("places"))
    # Words before the i-th place: spaces of the parts and places before it. All windows here and later go by text, after one shuffle.
    steps = F.zip_with(F.slice("parts", F.lit(1), F.size("places")), "places", lambda a, b: F.struct(spaces(a).alias("gap"), (spaces(b) + 1).alias("long")))
    d = pairs.repartition("rid").select("rid", "rule", "label", "priority", "confidence", F.posexplode(steps).alias("i", "d"))
    passed = F.sum(F.col("d.gap") + F.col("d.long") - 1).over(Window.partitionBy("rid", "rule").orderBy("i"))
    d = d.withColumn("end", passed.cast("int"))
    return d.select("rid", "rule", "label", "priority", "confidence", (F.col("end") - F.col("d.long")).alias("first"), "end")


def suppressed(d: DataFrame) -> DataFrame:
    """Without the detections contained in one that ranks before: by priority, then length, then order of the rules.

    One sort by rank tells, for each detection, whether an earlier-ranked one starts no later and ends no earlier. Priorities are few
    and fixed, so that is a running maximum of ends per priority in order of starts.
    """
    levels = sorted({r[4] for r in rules()}, reverse=True)
    order = [F.col("first"), F.col("end").desc(), F.col("priority").desc(), F.col("rule")]
    w = Window.partitionBy("rid").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("rid", "priority").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for p in levels:
        d = d.withColumn(f"_e{p}", F.max(F.when(F.col("priority") == p, F.col("end"))).over(before))
        # Of equal start and end, one of a lower priority may sort before; it never contains by rank.
    higher = F.greatest(*[F.when(F.col("priority") < p, F.col(f"_e{p}")) for p in levels], F.lit(-1))
    d = d.withColumn("_higher", higher).withColumn("_same", F.coalesce(F.max("end").over(same), F.lit(-1)))
    return d.where((F.col("_higher") < F.col("end")) & (F.col("_same") < F.col("end"))).select("rid", "rule", "label", "confidence", "first", "end")

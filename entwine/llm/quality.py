"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each document gets counts (words, symbols, repeated lines and words, shouting).
Mergeable quantile sketches per language and source replace fixed cutoffs. A
sketch of a ratio counts its values in log-linear cells, whose width is at most a
64th of the value, whatever its range: quantiles are right to that relative error,
and sketches merge by adding counts, in any order, to the same sketch. So Spark
builds them with map-side combining and hot sources cost no more than cold ones; a
language's sketch is the sum of its sources', and all languages' the sum of those.
A small group's quartiles lean on the merged sketch above it, the more the smaller
it is. Thresholds are Tukey fences; documents are joined with their
group's fences and filtered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import disguised, durable, row_keys, words_of

#: Ratios count in this part of one; cells are exact below 2 * STEPS and then STEPS to each doubling.
UNIT, STEPS = 10_000, 64


@dataclass(frozen=True)
class Rule:
    """A ratio num / den in parts of UNIT, and the least spread its fence assumes."""

    name: str
    num: str
    den: str
    least_spread: int
    below: bool = False


#: The spread floors keep groups in which nearly all documents agree from rejecting slight deviations.
RULES = (
    Rule("symbols", "n_symbols", "word_chars", 100),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1000),
    Rule("repeats", "n_repeat_words", "n_words", 600),
    Rule("shouting", "n_shouts", "word_chars", 400),
    Rule("word_length", "word_chars", "n_words", 3000, below=True),
)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of each whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_shouts.

    Windows of three words are compared by a 64-bit hash: they are sorted by it,
    those with an equal neighbour occur twice or more, and the words they cover
    are counted from their sorted positions; n log n in the words of a text.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    first = docs.withColumns({"_w": words_of(text), "_l": lines, "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"), "n_shouts": F.regexp_count(text, F.lit("[\\p{Lu}!]")).cast("long")})
    second = first.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_s": F.expr("CASE WHEN size(_w) < 3 THEN cast(array() AS array<struct<h:bigint,p:int>>) ELSE sort_array(transform(sequence(0, size(_w) - 3), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) AS h, i AS p))) END"),
    }).drop("_w", "_l")
    twice = F.expr("sort_array(transform(filter(_s, (x, j) -> (j > 0 AND _s[greatest(j - 1, 0)].h = x.h) OR (j < size(_s) - 1 AND _s[least(j + 1, size(_s) - 1)].h = x.h)), x -> x.p))")
    return second.withColumn("_p", twice).drop("_s").withColumn("n_repeat_words", F.expr("aggregate(_p, struct(0L AS c, -3 AS last), (a, p) -> struct(a.c + least(3, p - a.last) AS c, p AS last), a -> a.c)")).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(rule: Rule) -> Column:
    """The rule's ratio in parts of UNIT, without a bound; 0 if there is nothing to divide by."""
    return F.expr(f"CASE WHEN {rule.den} > 0 THEN ({UNIT} * {rule.num}) div greatest({rule.den}, 1) ELSE 0L END")


def cell(value: Column) -> Column:
    """The sketch's cell of a whole number from 0 on."""
    e = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return (F.lit(STEPS).cast("long") * e + F.call_function("shiftright", value, e)).cast("int")


def least_of(c: Column) -> Column:
    """The least value of a cell, which stands for it."""
    e = F.greatest(F.floor(c / STEPS) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (c - STEPS * e).cast("long"), e)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, cell, n): the sketches of all groups, from documents that pass the base rule."""
    values = F.array(*(F.struct(F.lit(r.name).alias("rule"), cell(F.col(f"value_{r.name}")).alias("cell")) for r in RULES))
    return measured.where(~F.col("base_failed")).select("lang", "source", F.inline(values)).groupBy("lang", "source", "rule", "cell").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, n, q1, q3) of the sketch merged over all but the keys."""
    merged = sketch.groupBy(*keys, "rule", "cell").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rule")
    ranked = merged.select(*keys, "rule", "cell", F.sum("n").over(w.orderBy("cell")).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda q: least_of(F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("cell"))))
    return ranked.groupBy(*keys, "rule").agg(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def fences(measured: DataFrame, min_rows: int, reach: int) -> DataFrame:
    """One row per (lang, source): the fences of every rule.

    A quartile is the mean of the group's own, weighted by its documents, and of
    the language's, weighted as `min_rows` documents; likewise the language's and all languages'.
    """
    sketch = durable(sketches(measured))
    wide = lambda q, keys, name: q.groupBy(*keys).agg(*(F.max(F.when(F.col("rule") == r.name, F.col(x))).alias(f"{name}_{r.name}_{x}") for r in RULES for x in ("n", "q1", "q3")))
    groups = measured.select("lang", "source").distinct()
    for name, keys in (("group", ["lang", "source"]), ("lang", ["lang"])):
        table = wide(quartiles(sketch, keys), keys, name).withColumnsRenamed({k: f"_{k}" for k in keys})
        groups = groups.join(table, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
    total = {r.rule: r for r in quartiles(sketch, []).collect()}  # one row per rule
    out = [F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source")]
    for r in RULES:
        q = {}
        for x in ("q1", "q3"):
            value = F.lit(int(total[r.name][x]) if r.name in total else None).cast("long")
            for level in ("lang", "group"):
                n = F.coalesce(F.col(f"{level}_{r.name}_n"), F.lit(0))
                own = F.coalesce(F.col(f"{level}_{r.name}_{x}"), F.lit(0))
                value = F.call_function("div", n * own + min_rows * value, n + min_rows)
            q[x] = value
        spread = F.greatest(q["q3"] - q["q1"], F.lit(r.least_spread))
        out.append((q["q3"] + reach * spread).alias(f"{r.name}_hi"))
        if r.below:
            out.append((q["q1"] - reach * spread).alias(f"{r.name}_lo"))
    return groups.select(*out)


def assess(docs: DataFrame, min_rows: int = 50, reach: int = 3) -> DataFrame:
    """Per row of `docs` (doc_id, text, lang, source): the counts, base_failed, failed (names of the fences crossed), kept.

    Also `k1` and `k2`, the hashes of these four with which decisions can be
    joined back to the texts. A null text counts as empty and fails the base rule; null languages and
    sources are groups of their own; texts of any length are counted whole; ties lie inside the fence (only values
    beyond it fail); repeated rows are counted and judged one by one; columns
    other than the four are left out, whatever their names; an empty table gives an empty one. The
    fences come from the documents that pass the base rule; without any there are none.
    """
    k1, k2 = row_keys("doc_id", "lang", "source", "text")
    measured = durable(
        counts(docs.select("doc_id", "text", "lang", "source", k1.alias("k1"), k2.alias("k2"))).drop("text")
        .withColumn("base_failed", base_failed())
        .withColumns({f"value_{r.name}": ratio(r) for r in RULES})
    )
    judged = measured.join(fences(measured, min_rows, reach), F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source")), "left")
    tests = []
    for r in RULES:
        out = F.col(f"value_{r.name}") > F.col(f"{r.name}_hi")
        if r.below:
            out = out | (F.col(f"value_{r.name}") < F.col(f"{r.name}_lo"))
        tests.append(F.when(out, F.lit(r.name)))
    failed = F.array_compact(F.array(*tests))
    return judged.select(
        "doc_id", "lang", "source", "k1", "k2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts",
        "base_failed", failed.alias("failed"), (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"), *(f"value_{r.name}" for r in RULES),
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns as they are, whatever their names.

    Decisions are joined by a hash of id, language, source and text, which
    settle a row's decision; rows equal in these have the same one. Empty and
    null texts fail the base rule; an empty table gives an empty one.
    """
    judged = assess(docs, **options).where("kept").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    rows, name = disguised(docs)
    k1, k2 = row_keys(*(name[c] for c in ("doc_id", "lang", "source", "text")))
    kept = rows.withColumns({"_1": k1, "_2": k2}).join(judged, (F.col("_1") == F.col("_k1")) & (F.col("_2") == F.col("_k2")), "left_semi")
    return kept.select(*rows.columns).toDF(*docs.columns)

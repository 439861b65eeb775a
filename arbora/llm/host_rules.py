"""Quality rules by document and by host, with shrunken host rates. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import SPACES, stored, text_or_empty
from arbora.runtime import lookup

# A document fails with fewer words, or more per cent of words in repeated windows.
LEAST_WORDS = 50
REPEAT_PERCENT = 50
# Further rules that count for the host only: symbols per 100 words, per cent of lines.
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
# A host is bad if its shrunken failure rate is above this.
HOST_LIMIT = 0.5
# Bounds of the prior's weight, in documents.
PRIOR_BOUNDS = (2.0, 10_000.0)


# How many words lie in a window of three that occurs twice or more: windows are hashed to
# 64 bits and sorted with their places; equal neighbours repeat; the places found, sorted,
# cover min(3, distance to the one before) words each. Three projections, so that none is
# computed twice.
def sorted_windows(words: Column) -> Column:
    """Array of (hash, place) of all windows of three words, sorted."""
    n = F.size(words)
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(
                F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
            ),
        ),
    )
    return F.coalesce(F.sort_array(windows), F.array().cast("array<struct<h:bigint,i:int>>"))


def places_repeated(windows: Column) -> Column:
    """Places, ascending, of windows whose hash a neighbour shares."""
    same = F.filter(
        windows,
        lambda w, i: F.coalesce(F.get(windows, i + 1)["h"] == w["h"], F.lit(False))
        | ((i > 0) & F.coalesce(F.get(windows, i - 1)["h"] == w["h"], F.lit(False))),
    )
    return F.sort_array(F.transform(same, lambda w: w["i"]))


def words_covered(places: Column) -> Column:
    """Words that windows of three at these places cover."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    rule_failed)`` per row. A null text has no words; a null host is a host of its own."""
    t = F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(F.col(id).alias("doc"), F.col(host).alias("host"), text_or_empty(text).alias("t"))
    step = step.select(
        "doc", "host",
        F.filter(F.split(t, SPACES + "+"), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace(t, SPACES, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]", "")).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
    )
    step = step.select(
        "doc", "host", "word_chars", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        sorted_windows(F.col("words")).alias("windows"),
    )
    step = step.withColumn("places", places_repeated(F.col("windows"))).drop("windows")
    step = step.withColumn("n_repeat_words", words_covered(F.col("places"))).drop("places")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    step = step.withColumn("base_failed", base)
    rule = (
        F.col("base_failed")
        | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"))
    )
    return step.withColumn("rule_failed", rule).drop("n_lines")


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``(host, host_docs, host_failed, host_rate, host_bad)`` from ``measures``.

    Rates are shrunk to a beta prior fitted to all hosts by their mean and variance:
    ``(failed + a) / (docs + a + b)``.
    """
    hosts = rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("rule_failed").cast("bigint")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    mean, var = mean or 0.0, var or 0.0
    low, high = PRIOR_BOUNDS
    weight = min(high, max(low, mean * (1 - mean) / var - 1)) if var > 0 else high
    shrunk = (F.col("host_failed") + mean * weight) / (F.col("host_docs") + weight)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_bad", shrunk > limit)


def host_rules(
    docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT
) -> DataFrame:
    """Measures of every row of ``docs`` with ``host_docs``, ``host_failed``, ``host_bad`` and ``kept``.

    A row is kept if it passes the base rules and its host isn't bad. Measures are taken
    once and written; hosts are joined back, by broadcast while they are counted to be few.
    """
    rows = stored(measures(docs, id, text, host))
    hosts = stored(host_verdicts(rows, limit).drop("host_rate"))
    # null hosts join as a value of their own
    named = rows.withColumn("__host", F.concat(F.lit("="), F.col("host").cast("string")))
    named = named.withColumn("__host", F.coalesce("__host", F.lit("")))
    keyed = hosts.withColumn("__h", F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit("")))
    joined = lookup(named, "__host", keyed.drop("host"), "__h", hosts.count(), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad")).drop("__host").withColumnRenamed("doc", id)

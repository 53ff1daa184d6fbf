"""Quality rules: counts within a text, and line frequency across the documents of a host.

Normalised lines are hashed, distinct documents are counted per host and line, lines above
the limit are removed, and documents that lose too much are rejected. DataFrame functions
only. Documents with equal texts count once for a line, so copies alone condemn nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

SPACE, NOT_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """host_docs and host_percent: a line in more distinct texts of one host than host_docs, and
    than that share of the host's distinct texts, is removed. left_words and lost_percent: a
    document is depleted with fewer words left, or more words lost."""

    min_words: int = 20
    repeat_percent: int = 30
    host_docs: int = 10
    host_percent: int = 5
    left_words: int = 20
    lost_percent: int = 80


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def normal_line(line: Column) -> Column:
    """A-Z in lower case, digits as 0, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(line, UPPER, LOWER), "[0-9]", "0"), SPACE, " "))


def _covered(places: Column) -> Column:
    """Words covered by 8-word windows at the sorted places."""
    n = F.size(places)
    gaps = F.zip_with(F.slice(places, 2, n), F.slice(places, 1, n - 1), lambda b, a: F.least(b - a, F.lit(8)))
    return F.when(n > 0, F.aggregate(gaps, F.lit(8), lambda total, x: total + x)).otherwise(F.lit(0))


def counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; null text
    counts as empty."""
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    out = out.withColumn("_words", words_of(F.col("_text"))).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE))
    )
    n = F.size("_words")
    # all below refer to _words more than once, so it is computed once and kept
    out = out.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 8, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice("_words", i, 8)))).otherwise(
            F.array().cast("array<bigint>")
        ).alias("_h"),
    ).drop("_words", "_lines", "_text")
    placed = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed)).drop("_h")
    again = F.filter("_s", lambda e, i: e["x"].eqNullSafe(F.get("_s", i - 1)["x"]) | e["x"].eqNullSafe(F.get("_s", i + 1)["x"]))
    out = out.withColumn("_places", F.array_sort(F.transform(again, lambda e: e["i"]))).drop("_s")
    out = out.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_places")), F.lit(0)).cast("long")).drop("_places")
    # a filter on the counts must not be pushed below this point: it would take the steps
    # apart and work out the words again for each of them
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = out.withColumn("_counts", F.explode_outer(F.array(F.struct(*names)))).drop(*names)
    return out.select(*[c for c in out.columns if c != "_counts"], "_counts.*")


def _keys(docs: DataFrame) -> DataFrame:
    """docs with the host and a hash of the text as keys; null hosts are one host."""
    return docs.withColumn("_host", F.coalesce("source", F.lit(""))).withColumn("_th", F.xxhash64("text"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("source", "string"))))


def line_counts(docs: DataFrame) -> DataFrame:
    """(host, text hash, line hash, w): words of a line in all copies of a text in a host.
    A row without a line hash holds the number of copies."""
    lines = _keys(docs).select("_host", "_th", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.split("text", "\n"))).alias("line"))
    lines = lines.select(
        "_host", "_th",
        F.when(F.col("line").isNull(), 1).otherwise(F.size(words_of(F.col("line")))).alias("w"),
        F.when(F.col("line").isNotNull(), F.xxhash64(normal_line(F.col("line")))).alias("_lh"),
    )
    return lines.where("w > 0").groupBy("_host", "_th", "_lh").agg(F.sum("w").alias("w"))


def frequent_lines(per_text: DataFrame, s: Settings) -> DataFrame:
    """The rows of line_counts whose lines are above the limits of their host."""
    often = per_text.where("_lh is not null").groupBy("_host", "_lh").agg(F.count("*").alias("n")).where(F.col("n") > s.host_docs)
    texts = per_text.where("_lh is null").groupBy("_host").agg(F.count("*").alias("texts"))
    often = often.join(texts, "_host").where(100 * F.col("n") > s.host_percent * F.col("texts"))
    return per_text.join(often.select("_host", "_lh"), ["_host", "_lh"])


def judge(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, lost_words for each row of docs(doc_id, text, source).

    base_failed: too few words, or too many in repeated 8-word windows. kept: not
    base_failed and not depleted. Null and blank texts have no words, so they fail.
    Repeated rows are judged alike. Other columns are not read; an empty table gives an
    empty one.
    """
    rows = _rows(docs)
    return _judged(rows, store.written(line_counts(rows), "lines"), settings).drop("_host", "_th", "text")


def _judged(rows: DataFrame, per_text: DataFrame, s: Settings) -> DataFrame:
    copies = per_text.where("_lh is null").select("_host", "_th", F.col("w").alias("copies"))
    lost = frequent_lines(per_text, s).groupBy("_host", "_th").agg(F.sum("w").alias("w"))
    lost = lost.join(copies, ["_host", "_th"]).select("_host", "_th", F.expr("w div copies").alias("lost_words"))
    base = (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > s.repeat_percent * F.col("n_words"))
    depleted = (F.col("lost_words") > 0) & (
        (F.col("n_words") - F.col("lost_words") < s.left_words) | (100 * F.col("lost_words") > s.lost_percent * F.col("n_words"))
    )
    out = counts(_keys(rows)).join(lost, ["_host", "_th"], "left")
    return out.withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long")).select(
        "_host", "_th", "text", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~depleted).alias("kept"), "lost_words",
    )


def filtered(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, without the lines
    above the limit; n_chars, where present, follows the text."""
    s, key = settings, ["_host", "_th"]
    # written before it is filtered: a filter pushed down would take the counts apart again
    per_text = store.written(line_counts(_rows(docs)), "lines")
    verdict = store.written(_judged(_rows(docs), per_text, s).select(*key, "kept", (F.col("lost_words") > 0).alias("_cut")), "verdict")
    verdict = verdict.where("kept").select(*key, "_cut").distinct()
    often = frequent_lines(per_text, s).select(*key, "_lh").join(verdict.where("_cut"), key, "left_semi")
    # the user's columns travel as one, so that none has the name of one of these
    text = F.col("_own.text").cast("string")
    keyed = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"), F.xxhash64(F.col("text").cast("string")).alias("_th"), F.struct(*docs.columns).alias("_own"))
    # the texts that lose lines, each once, taken apart and put together without them
    cut = keyed.join(verdict.where("_cut").select(*key), key, "left_semi").groupBy(*key).agg(F.max(text).alias("text"))
    lines = cut.select("_host", "_th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("_lh", F.xxhash64(normal_line(F.col("line"))))
    left = lines.join(often, ["_host", "_th", "_lh"], "left_anti").groupBy("_host", "_th").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("_left")
    )
    out = keyed.join(verdict, key).join(left, key, "left").withColumn("_new", F.coalesce("_left", text))
    named = {c: F.col("_own").getField(c) for c in docs.columns} | {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.when(F.col("_cut"), F.length("_new")).otherwise(F.col("_own.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(c.alias(n) for n, c in named.items()))

"""Phrases of any length found in texts, by an equal join on the rarest word of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, drop


def tokens(text: Column) -> Column:
    """Runs of letters and digits, A-Z in lower case."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


def occurrences(texts: DataFrame, phrases: DataFrame, words: Column | None = None) -> DataFrame:
    """(id, phrase, at): where (from 0, in words) texts(id, words) hold phrases(phrase, words).

    The words of the phrases are counted in the texts, and each phrase is looked for where
    its rarest word is; there the other words are compared by place. A phrase without
    words is nowhere. Rows of one id are read as one text. Nothing meets every text.
    """
    asked = cut(phrases.where("size(words) > 0").select("phrase", F.col("words").alias("wanted")).distinct())
    needed = asked.select(F.explode("wanted").alias("word")).distinct()
    rows = texts.select("id", F.col("words"))
    placed = rows.select("id", F.posexplode("words").alias("at", "word")).join(needed, "word", "left_semi")
    placed = cut(placed)
    often = needed.join(placed.groupBy("word").agg(F.count("*").alias("n")), "word", "left").na.fill(0, ["n"])
    each = asked.select("phrase", "wanted", F.posexplode("wanted").alias("k", "word")).join(often, "word")
    rare = each.groupBy("phrase", "wanted").agg(F.min(F.struct("n", "k", "word")).alias("r")).where("r.n > 0").select("phrase", "wanted", F.col("r.k").alias("k"), F.col("r.word").alias("word"))
    start = F.col("at") - F.col("k")
    may = placed.join(rare, "word").where(start >= 0).select("id", "phrase", "wanted", start.alias("at"))
    # one word is found already; for the others the places in the text are compared
    sure = may.where("size(wanted) = 1").select("id", "phrase", "at")
    open_ = may.where("size(wanted) > 1").select("id", "phrase", "at", F.size("wanted").alias("n"), F.posexplode("wanted").alias("i", "word"))
    met = open_.withColumn("place", F.col("at") + F.col("i")).join(placed.select("id", F.col("at").alias("place"), "word").distinct(), ["id", "place", "word"])
    found = met.groupBy("id", "phrase", "at", "n").agg(F.count_distinct("i").alias("m")).where("m = n").select("id", "phrase", "at")
    out = cut(sure.distinct().unionByName(found))
    drop(asked, placed)
    return out

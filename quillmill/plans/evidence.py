"""How well findings meet what is known of a corpus: metrics of each rule, and what became of
each attempt that is known to be damaged or whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relations


def _share(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing to share."""
    return F.when(whole > 0, part / whole)


def rule_metrics(expected: DataFrame, found: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """(code, tp, fp, fn, precision, recall) of expected(doc, code) and found(doc, code): a pair
    counts once on either side. measured(code): the rules to tell, also those that neither
    side has; without it, those of either side. Null documents are one document."""
    key = ["doc", "code"]
    a, b = (df.select(*key).distinct().withColumn(name, F.lit(1)) for df, name in ((expected, "_e"), (found, "_f")))
    named = b.withColumnsRenamed({"doc": "_doc", "code": "_code"})
    both = a.join(named, a["doc"].eqNullSafe(named["_doc"]) & (a["code"] == named["_code"]), "full_outer").select(F.coalesce("code", "_code").alias("code"), "_e", "_f")
    e, f = F.col("_e").isNotNull(), F.col("_f").isNotNull()
    out = both.groupBy("code").agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"))
    if measured is not None:
        out = measured.select("code").distinct().join(out, "code", "left").na.fill(0, ["tp", "fp", "fn"])
    tp = F.col("tp")
    return out.select("code", "tp", "fp", "fn", _share(tp, tp + F.col("fp")).alias("precision"), _share(tp, tp + F.col("fn")).alias("recall"))


def outcome(damaged: Column, reported: Column) -> Column:
    """What became of an attempt: null where it isn't known whether it is damaged."""
    return F.when(damaged & reported, "detected").when(damaged, "missed").when(~damaged & reported, "false alarm").when(~damaged, "clean")


def attempts(rows: DataFrame, findings: DataFrame, by: list[str], least_rank: int = 3) -> DataFrame:
    """by, detected, missed, false_alarm, clean, unknown, total: what became of rows(doc, damaged,
    and by); an attempt is reported if it has a finding of least_rank or more."""
    told = findings.where(F.col("severity_rank") >= least_rank).select("doc").distinct().withColumn("_told", F.lit(True))
    what = outcome(F.col("damaged"), F.coalesce("_told", F.lit(False)))
    out = rows.join(told, "doc", "left").withColumn("_what", F.coalesce(what, F.lit("unknown")))
    kinds = ["detected", "missed", "false alarm", "clean", "unknown"]
    return out.groupBy(*by).agg(*(F.count_if(F.col("_what") == k).alias(k.replace(" ", "_")) for k in kinds), F.count("*").alias("total"))


def corpus_groups(files: DataFrame, findings: DataFrame, examples: int = 3) -> DataFrame:
    """(code, suffix, severity, n, files, examples): for each rule, kind of file and severity the
    number of findings and of files, and the first few files by name."""
    by = ["code", "suffix", "severity"]
    suffix = F.lower(F.regexp_extract("doc", r"([.][^./]*)$", 1))
    rows = findings.join(files.select("doc").distinct(), "doc").withColumn("suffix", suffix)
    per_file = rows.groupBy(*by, "doc").agg(F.count("*").alias("m"))
    sums = per_file.groupBy(*by).agg(F.sum("m").alias("n"), F.count("*").alias("files"))
    # ranked, so that a group's names are never all in one list
    first = relations.topk(per_file, by, [F.col("doc")], examples).groupBy(*by).agg(F.sort_array(F.collect_list("doc")).alias("examples"))
    return sums.join(first, by)

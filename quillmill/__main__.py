"""python -m quillmill check FILE... | compare SOURCE EDITED | compare --pairs LIST: findings as
text, JSON or SARIF.

check --against SOURCE tells only what the source doesn't have, check --coverage also what was
looked at. LIST is a CSV file with the columns source and edited.

Exit 0: nothing reaches the failing severity; 1: something does; 2: wrong usage. Files may be
globs or folders' patterns that Spark reads, so one call checks a whole collection.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import relations
from .plans import comparison, coverage, decks, document_rules, policy
from .sources import packages


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillmill", description=__doc__.split("\n")[0])
    sub = out.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check")
    check.add_argument("files", nargs="+")
    compare = sub.add_parser("compare")
    check.add_argument("--against", help="the file that the one checked was made from")
    check.add_argument("--coverage", action="store_true", help="tell each surface that was or wasn't looked at")
    compare.add_argument("source", nargs="?")
    compare.add_argument("edited", nargs="?")
    compare.add_argument("--pairs", help="a CSV file of sources and edits")
    for p in (check, compare):
        p.add_argument("--config", help="a policy (TOML)")
        p.add_argument("--baseline", help="findings that were there already (JSON)")
        p.add_argument("--write-baseline", help="write one and report nothing")
        p.add_argument("--expect", action="append", default=[], help="CODE or CODE:key=value,...")
        p.add_argument("--fail-on", choices=list(document_rules.RANK), help="the least severity that fails")
        p.add_argument("--format", choices=["text", "json", "sarif"], default="text")
    return out


DECK = r"(?i)[.](pptx|pptm|potx|potm|ppsx|ppsm)$"


def checked(rows: DataFrame) -> DataFrame:
    """Findings on packages(doc, content) by the rules of their kind."""
    return document_rules.check(rows.where(~F.col("doc").rlike(DECK))).unionByName(decks.check(rows.where(F.col("doc").rlike(DECK))))


def findings_of(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """The findings and the files (doc) that they are about."""
    if args.command == "check":
        rows = packages.load(spark, args.files)
        found = checked(rows)
        if args.against:
            named = lambda df: df.withColumn("doc", F.lit(args.files[0]))
            of_source = checked(packages.load(spark, [args.against]))
            found = policy.introduced(named(found), named(of_source)).where("level = 'new'").drop("level")
            return found, spark.createDataFrame([(args.files[0],)], "doc string")
        return found, rows.select("doc")
    if args.pairs:
        listed = spark.read.csv(args.pairs, header=True).select("source", "edited").distinct()
        paths = sorted({x for r in listed.toLocalIterator() for x in r if x})
        files = packages.load(spark, paths).withColumn("path", F.regexp_replace("doc", "^file:/*", "/"))
        of = lambda c: files.select(F.col("path").alias(c), F.col("content").alias(f"{c}_content"))
        pairs = listed.select("edited", *(F.regexp_replace(c, "^file:/*", "/").alias(f"_{c}") for c in ("source", "edited")))
        pairs = pairs.join(of("_source"), "_source", "left").join(of("_edited"), "_edited", "left")
        pairs = pairs.select(F.concat_ws(" <- ", "edited", "_source").alias("pair"), F.col("_source_content").alias("source"), F.col("_edited_content").alias("edited"))
        return comparison.compare(pairs), pairs.select(F.col("pair").alias("doc"))
    source, edited = (packages.load(spark, [p]).select(F.col("content").alias(c)) for p, c in ((args.source, "source"), (args.edited, "edited")))
    pair = F.lit(args.edited).alias("pair")
    # one file on either side
    pairs = source.limit(1).join(edited.limit(1), F.lit(True)).select(pair, "source", "edited")
    return comparison.compare(pairs), pairs.select(F.col("pair").alias("doc"))


def looked_at(spark: SparkSession, args: argparse.Namespace, found: DataFrame) -> DataFrame:
    """(doc, surface, status, reason, n) of the documents that are no decks."""
    rows = packages.load(spark, args.files).where(~F.col("doc").rlike(DECK))
    return coverage.coverage(document_rules.facts(rows), found)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        rules = policy.load(Path(args.config).read_text()) if args.config else policy.Policy()
        if args.command == "compare" and bool(args.pairs) == bool(args.source and args.edited):
            raise ValueError("compare takes a source and its edit, or --pairs")
        if args.command == "check" and args.against and len(args.files) != 1:
            raise ValueError("--against takes one file to check")
        wanted = (*rules.expectations, *map(policy.parse_expectation, args.expect))
    except SystemExit as e:
        return int(e.code or 0)
    except (OSError, ValueError) as e:
        print(f"quillmill: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("quillmill").getOrCreate()
    try:
        found, files = findings_of(spark, args)
    except ValueError as e:  # a pattern without files
        print(f"quillmill: {e}", file=sys.stderr)
        return 2
    found = relations.cut(found)
    if args.write_baseline:
        Path(args.write_baseline).write_text(policy.baseline_json(policy.make_baseline(found)))
        return 0
    out = policy.expect(found, wanted, files).where("expected is null").drop("expected")
    if args.baseline:
        try:
            out = policy.apply_baseline(out, policy.read_baseline(spark, Path(args.baseline).read_text()))
        except (OSError, ValueError) as e:
            print(f"quillmill: {e}", file=sys.stderr)
            return 2
    out = relations.cut(policy.apply_policy(out, rules))
    left = out.where("suppressed is null")
    if args.format == "sarif":
        print(policy.sarif_log(out))
    elif args.format == "json":
        for r in policy.json_report(left).orderBy("doc").toLocalIterator():
            print(r["report"])
    else:
        for r in policy.human_report(left).toLocalIterator():
            print(f"{r['doc']}: {r['line']}")
    if args.command == "check" and args.coverage:
        rows = looked_at(spark, args, found).orderBy("doc", "surface")
        for r in (rows.select(F.to_json(F.struct("*")).alias("x")) if args.format == "json" else rows.select(F.concat_ws("  ", F.concat("doc", F.lit(":")), "surface", "status", "reason").alias("x"))).toLocalIterator():
            print(r["x"], file=sys.stdout if args.format != "sarif" else sys.stderr)
    return int(policy.fails(out, args.fail_on or rules.fail_on).first()["failed"])


if __name__ == "__main__":
    sys.exit(main())

"""Importance resampling against a plain count of every feature."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.llm import resampling
from tests.llm.helpers import documents, frame


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, n):
    ws = words(text)
    return [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def plain(rows, target, s):
    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    have, want = (Counter(bucket(f) for t in x for f in grams(t, s.grams)) for x in ([t for _, t, *_ in rows], target))
    all_, aim = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1.0) * (all_ + s.buckets) / ((have[b] + 1.0) * (aim + s.buckets))))
    out = []
    for doc_id, text, *_ in rows:
        fs = grams(text, s.grams)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(fs), weight, score, None, len(words(text))])
    able = sorted((r for r in out if r[5] >= s.min_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    for k, r in enumerate(able[: s.percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()), key=repr)


def corpus():
    r = random.Random(8)
    long = "é" * 40  # 80 bytes: looked up by digest
    rows = documents() + [(700 + k, " ".join(r.choice(["the", "THE", "a-b", "x1", long, f"rare{k}", "of"]) for _ in range(30)), "s0") for k in range(60)]
    return rows, ["the of x1 quick", "alpha1 beta2 gamma3 " + long, None, ""]


@pytest.mark.parametrize(("grams_", "hot"), [(1, 20_000), (1, 3), (1, 0), (2, 5), (3, 40)])
def test_resampling(spark, grams_, hot):
    rows, target = corpus()
    s = resampling.Settings(grams=grams_, buckets=97, percent=30, hot=hot)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    named = frame(spark, rows).withColumns({c: F.lit("x") for c in ("row", "keys", "counts", "known", "weight", "rank", "feature", "n", "bucket", "_total", "_place", "_part")})
    assert rows_of(resampling.resample(named, aim, s)) == plain(rows, target, s)


def test_ties_empty_tables_and_empty_targets(spark):
    aim = spark.createDataFrame([], "text string")
    assert resampling.resample(frame(spark, []), aim).count() == 0
    rows = [(3, "w " * 25, "s")] * 7 + [(k, None, "s") for k in range(5)] + [(9, "v " * 19, "s"), (None, "w " * 30, "s")]
    for percent in (0, 50, 100):
        s = resampling.Settings(percent=percent)
        assert rows_of(resampling.resample(frame(spark, rows, False), aim, s)) == plain(rows, [], s)

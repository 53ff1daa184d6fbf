"""New names for words, and phrases in texts."""

import random
import re

from pyspark.sql import functions as F

from quillmill.operators import names, phrases


def shape(word):
    return "".join("d" if c.isdecimal() else "U" if c.isupper() else "l" for c in word)


def check(words, rows):
    got = {r["word"]: r for r in rows}
    assert set(got) == set(words) - {""} and len(rows) == len(got)
    clear = [r["name"] for r in rows if not r["collides"]]
    assert len(set(clear)) == len(clear)
    for w, r in got.items():
        assert len(r["name"]) == len(w) and shape(r["name"]) == shape(w) and r["name"].isascii()
        assert len(w) < 4 or r["collides"] or r["name"] not in got
    return got


def test_names_of_all_words_are_new_and_distinct(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).where("not word rlike '[\\\\p{N}&&[^\\\\p{Nd}]]'")
    seen = {r["word"] for r in words.distinct().collect()}
    rows = names.renamed(words, "a").collect()
    first = check(seen, rows)
    assert not any(r["collides"] for w, r in first.items() if len(w) >= 4)
    # the same again, others for another secret
    again = {r["word"]: r["name"] for r in names.renamed(words.repartition(7), "a").collect()}
    assert again == {w: r["name"] for w, r in first.items()}
    other = {r["word"]: r["name"] for r in names.renamed(words, "b").collect()}
    assert sum(other[w] != again[w] for w in again) > 0.9 * len(again)


def test_used_up_shapes_collide(spark):
    words = [chr(0x4E00 + k) for k in range(60)] + list("abc") + [f"{k:04}" for k in range(10_000)] + ["", "x" * 70]
    rows = names.renamed(spark.createDataFrame([(w,) for w in words], "word string"), "k").collect()
    got = check(words, rows)
    assert sum(got[chr(0x4E00 + k)]["collides"] for k in range(60)) + sum(got[c]["collides"] for c in "abc") == 63 - 26
    assert all(got[f"{k:04}"]["collides"] for k in range(10_000))
    assert names.renamed(spark.createDataFrame([], "word string"), "k").count() == 0


def test_phrases_are_those_of_a_plain_search(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["the"] * 8
    texts = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 80)))) for k in range(80)] + [(0, "the w1 w2"), (900, "")]
    asked = [(k, " ".join(r.choice(words) for _ in range(1 + k % 5))) for k in range(60)] + [(70, ""), (71, "unknown w1"), (72, "the the the"), (5, "w3")]
    df = spark.createDataFrame(texts, "id int, text string").select("id", phrases.tokens(F.col("text")).alias("words"))
    ph = spark.createDataFrame(asked, "phrase int, text string").select("phrase", phrases.tokens(F.col("text")).alias("words"))
    want = set()
    for i, text in texts:
        ws = re.findall(r"\w+", text)
        for p, q in asked:
            qs = re.findall(r"\w+", q)
            want |= {(i, p, at) for at in range(len(ws) - len(qs) + 1) if qs and ws[at : at + len(qs)] == qs}
    got = {tuple(x) for x in phrases.occurrences(df, ph).select("id", "phrase", "at").collect()}
    # texts with one id share their places, so a phrase may be put together from both
    assert got >= want and {x for x in got if x[0] != 0} == {x for x in want if x[0] != 0}


def test_names_of_one_shape_are_tried_in_many_tasks(spark):
    per = spark.createDataFrame([("llllll", 26**6, 131, 5, 95_000)], "shape string, size long, factor long, shift long, tried long")
    tried = names.attempts(per)
    assert tried.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert tried.select("front").distinct().count() == 95_000

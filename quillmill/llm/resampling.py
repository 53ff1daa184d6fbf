"""Importance resampling to a target distribution, with a dictionary of distinct features.

Features are word n-grams. Their strings are counted over all documents, each distinct
string is hashed once, and counts are summed by bucket; a bucket's gain is the logarithm of
its share in the target over its share in the documents. Gains go back by the strings to the
feature counts of each document. A random draw without replacement follows by adding a
Gumbel variate to each document's mean gain and taking the highest.

The most frequent strings (a bounded number) go to every task, so no hot string is a join
key; the others are joined by shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays, prefix, store

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text.
SEPARATOR = np.ones(256, bool)
for _range in (range(48, 58), range(97, 123), range(128, 256)):
    SEPARATOR[list(_range)] = False
#: Bytes of text whose features are counted together.
CHUNK = 1 << 23
#: Strings of so many bytes or more are looked up by their digest.
LONG = 64


@dataclass(frozen=True)
class Settings:
    """grams: features are runs of 1 to so many words. percent of the documents with at
    least min_words words are drawn. hot: strings that go to every task."""

    grams: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: str = "2024"
    hot: int = 20_000


def features(data: np.ndarray, offsets: np.ndarray, grams: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The n-grams of a chunk for each n, and the number of the text each is in."""
    data = arrays.ASCII_LOWER[data]
    starts, ends, first = arrays.words(data, offsets, SEPARATOR)
    edges = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data[~SEPARATOR[data]]))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    yield words, text
    for n in range(2, grams + 1):
        size = max(0, len(words) - n + 1)
        inside = text[:size] == text[len(text) - size :]
        joined = pc.binary_join_element_wise(*(words.slice(k, size) for k in range(n)), pa.scalar(" ", words.type))
        yield joined.filter(pa.array(inside)), text[:size][inside]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def dictionary(docs: DataFrame, s: Settings) -> DataFrame:
    """(feature, n, bucket), written: every distinct string with its count and its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in arrays.chunks(batch.column(0), CHUNK):
                for found, _ in features(data, offsets, s.grams):
                    counts = pc.value_counts(found)
                    yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["feature", "n"])

    counts = _texts(docs).mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    bucket = (F.crc32(F.col("feature").cast("binary")) % s.buckets).cast("int")
    return store.written(counts.withColumn("bucket", bucket), "dictionary")


def gains(source: DataFrame, target: DataFrame, s: Settings) -> DataFrame:
    """(bucket, gain) of every bucket of the dictionary `source`: a row a bucket at most."""
    sums = source.groupBy("bucket").agg(F.sum("n").alias("s"))
    wanted = target.groupBy("bucket").agg(F.sum("n").alias("t"))
    total, aim = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (source, target))
    both = sums.join(wanted, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"))
    up = (F.col("t") + 1).cast("double") * F.lit(float(total + s.buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(aim + s.buckets))
    return store.written(both.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain")), "gains")


def key(feature: str) -> str:
    return feature if len(feature.encode()) < LONG else hashlib.sha256(feature.encode()).hexdigest()


def counted(docs: DataFrame, hot: dict[str, int], s: Settings) -> DataFrame:
    """(row, doc_id, n_words, n_features, known, keys, counts), written: per row of docs the
    gains of hot features summed, and the other ones with their counts."""
    names, worth = pa.array(list(hot), pa.large_string()), np.array([*hot.values(), 0], np.int64)

    def looked_up(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Keys of the strings, and their places in `names` (its length: none)."""
        long = np.flatnonzero(pc.binary_length(distinct).to_numpy(zero_copy_only=False) >= LONG)
        if len(long):
            mask = np.zeros(len(distinct), bool)
            mask[long] = True
            distinct = pc.replace_with_mask(distinct, pa.array(mask), pa.array([key(x) for x in distinct.take(pa.array(long)).to_pylist()], distinct.type))
        at = pc.fill_null(pc.index_in(distinct, names), len(names))
        return distinct, at.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in arrays.chunks(batch.column(1), CHUNK):
                n = len(offsets) - 1
                known, total, words = np.zeros(n, np.int64), np.zeros(n, np.int64), None
                pairs: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
                for found, text in features(data, offsets, s.grams):
                    total += np.bincount(text, minlength=n)
                    words = total.copy() if words is None else words
                    coded = found.dictionary_encode()
                    size = max(1, len(coded.dictionary))
                    pair, count = np.unique(text * size + coded.indices.to_numpy(), return_counts=True)
                    owner, code = pair // size, pair % size
                    strings, places = looked_up(coded.dictionary)
                    place = places[code] if len(places) else np.zeros(0, np.int64)
                    hit = place < len(names)
                    np.add.at(known, owner[hit], worth[place[hit]] * count[hit])
                    pairs.append((owner[~hit], strings.take(pa.array(code[~hit])), count[~hit]))
                owner = np.concatenate([p[0] for p in pairs])
                order = np.argsort(owner, kind="stable")
                keys = pa.concat_arrays([p[1] for p in pairs]).take(pa.array(order)).cast(pa.string())
                counts = pa.array(np.concatenate([p[2] for p in pairs])[order], pa.int64())
                edges = pa.array(np.searchsorted(owner[order], np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n), pa.array(words), pa.array(total), pa.array(known),
                        pa.ListArray.from_arrays(edges, keys), pa.ListArray.from_arrays(edges, counts),
                    ],
                    names=["doc_id", "n_words", "n_features", "known", "keys", "counts"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, known long, keys array<string>, counts array<long>")
    return store.written(out.withColumn("row", F.monotonically_increasing_id()), "features", codec="zstd")


def weights(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_features, weight), written: for each row of docs(doc_id, text) the
    floored mean of the gains of its features against those of target(text)."""
    s = settings
    source, aim = dictionary(docs, s), dictionary(target, s)
    gain = gains(source, aim, s)
    store.drop(aim)
    by_key = F.when(F.octet_length("feature") < LONG, F.col("feature")).otherwise(F.sha2(F.col("feature").cast("binary"), 256))
    named = source.join(F.broadcast(gain), "bucket").select(by_key.alias("key"), "n", "gain")  # a row a bucket
    hot = {r["key"]: r["gain"] for r in named.orderBy(F.desc("n"), "key").limit(s.hot).collect()}  # keys have LONG bytes at most
    rows = counted(docs, hot, s)
    rest = rows.select("row", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("counts").alias("m"))))
    tail = rest.join(named.select("key", "gain"), "key").groupBy("row").agg(F.sum(F.col("gain") * F.col("m")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    mean = F.when(F.col("n_features") > 0, F.expr("(_total - pmod(_total, n_features)) div n_features")).otherwise(0)
    out = rows.drop("keys", "counts").join(tail, "row", "left").withColumn("_total", total)
    out = store.written(out.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight")), "weights")
    store.drop(rows, source, gain)
    return out


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words), all long, for each row of
    docs(doc_id, text): rank counts the drawn ones from the highest score on, null for the
    others. Ties go to the smaller doc_id, nulls first, then fewer features and weight.

    Null and empty texts have no features and weight 0; a null doc_id has no digits where
    ids are hashed. Repeated rows count, and are drawn, each. An empty target pulls
    towards the even distribution of buckets. Other columns are not read; an empty table
    gives an empty one.
    """
    s = settings
    digits = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    weighted = weights(docs, target, s)
    rows = store.written(weighted.withColumn("score", score), "scores")
    store.drop(weighted)
    names = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    able = rows.where(F.col("n_words") >= s.min_words)
    drawn = s.percent * able.count() // 100
    none = F.lit(None).cast("long")
    if not drawn:
        return rows.withColumn("rank", none).select(*names)
    # scores are whole numbers within some 10**5, so this histogram is small at every size
    levels = able.groupBy("score").agg(F.count("*").alias("n"))
    levels = levels.select("score", F.sum("n").over(Window.orderBy(F.desc("score"))).alias("n"))
    lowest = levels.where(F.col("n") >= drawn).agg(F.max("score")).first()[0]
    high = (F.col("n_words") >= s.min_words) & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = prefix.numbered(rows.where(high), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.select(*names).unionByName(rows.where(~high).withColumn("rank", none).select(*names))

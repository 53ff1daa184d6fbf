"""Long exact repeats: every byte of a string of `length` bytes that also starts elsewhere.

Suffixes are sampled by content: the suffix that begins a window's smallest k-gram stands
for all windows that share it, so equal windows meet at equal samples, wherever they lie.
Samples are named by hashes, names are refined (whole context, then aligned blocks of
windows, then single windows), and at each level a name that is alone or held twice
settles all its windows; only the rest goes on. See the README for why the samples are
not residues of a difference cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, bloom, store

U64 = np.uint64
#: Bits of a place that break ties between equal k-grams (the leftmost wins).
PLACE = U64((1 << 28) - 1)


@dataclass(frozen=True)
class Settings:
    """length: bytes of a repeat. gram: bytes of the k-grams that samples begin with.
    block: windows settled together on the second level."""

    length: int = 400
    gram: int = 100
    block: int = 16


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w neighbours (van Herk)."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(U64).max, U64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def samples(raw: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(text, low, high, sample, name, context) for each sample of a chunk: windows start
    at low..high, name is the hash of its k-gram, context that of all its windows' bytes.
    Places are those of the chunk. No window crosses from one text to the next."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    valid = np.zeros(max(0, n - s.length + 1), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= s.length:
            valid[a : b - s.length + 1] = True
    windows = np.flatnonzero(valid)
    if not len(windows):
        return none, none, none, none, none.astype(U64), none.astype(U64)
    sums = arrays.prefix(raw)
    at = np.arange(n - s.gram + 1)
    grams = arrays.weak_hash(sums, at, at + s.gram)  # contexts tell equal names apart
    keyed = (grams & ~PLACE) | (at.astype(U64) & PLACE)
    least = _least(keyed, s.length - s.gram + 1)[windows]
    sample = windows + (((least & PLACE).astype(np.int64) - windows) & int(PLACE))
    cut = np.ones(len(windows), bool)
    cut[1:] = (sample[1:] != sample[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(cut)
    low, high, sample = windows[first], windows[np.append(first[1:], len(windows)) - 1], sample[first]
    text = np.searchsorted(offsets, low, "right") - 1
    return text, low, high, sample, grams[sample], arrays.substring_hash(sums, low, high + s.length)


def _find(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, th = batch.column(0), batch.column(1)
        for at, raw, offsets in arrays.chunks(batch.column(2)):
            text, low, high, sample, name, context = samples(raw, offsets, s)
            base = offsets[text]
            take = pa.array(text + at)
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), th.take(take), *(pa.array(x) for x in (low - base, high - base, sample - base, name.view(np.int64), context.view(np.int64)))],
                names=["doc_id", "th", "low", "high", "sample", "name", "context"],
            )


def _contexts(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a text is asked for."""
    for batch in batches:
        rows = []
        for doc_id, th, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
            raw = text.encode()
            rows += [(doc_id, th, w["low"], w["high"], w["sample"], w["name"], w["n"], raw[w["low"] : w["high"] + s.length]) for w in wanted]
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = ["doc_id", "th", "low", "high", "sample", "name", "n", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _blocks(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Blocks of windows, aligned to the sample. core: hash of the bytes that all windows
    of the block have; full: of the bytes of all its windows, null at the edges."""
    for batch in batches:
        low, high, sample = (batch.column(k).to_numpy() for k in (2, 3, 4))
        parts = []
        for k in range(batch.num_rows):
            first = low[k] + (sample[k] - low[k]) % s.block - (s.block if (sample[k] - low[k]) % s.block else 0)
            begin = np.arange(first, high[k] + 1, s.block)
            sums = arrays.prefix(np.frombuffer(batch.column(7)[k].as_buffer(), np.uint8))
            at, end = begin - low[k], len(sums) - 1
            core = arrays.substring_hash(sums, at + s.block - 1, at + s.length)
            whole = (at >= 0) & (at + s.block - 1 + s.length <= end)
            full = arrays.substring_hash(sums, np.where(whole, at, 0), np.where(whole, at + s.block - 1 + s.length, 0))
            parts.append((np.full(len(begin), k), begin, sample[k] - begin, core, full, whole))
        if not parts:
            continue
        row, begin, offset, core, full, whole = (np.concatenate(x) for x in zip(*parts))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(take) for k in (0, 1, 2, 5, 6)), pa.array(begin), pa.array(offset), pa.array(core.view(np.int64)), pa.array(full.view(np.int64), mask=~whole)],
            names=["doc_id", "th", "low", "name", "n", "begin", "shift", "core", "full"],
        )


def _windows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Hashes of the single windows of the blocks asked for."""
    for batch in batches:
        low, high = (batch.column(k).to_numpy() for k in (2, 3))
        parts = []
        for k, begins in enumerate(batch.column(6).to_pylist()):
            at = (np.array([b["begin"] for b in begins])[:, None] + np.arange(s.block)).ravel()
            n = np.repeat([b["n"] for b in begins], s.block)
            inside = (at >= low[k]) & (at <= high[k])
            at, n = at[inside], n[inside]
            sums = arrays.prefix(np.frombuffer(batch.column(5)[k].as_buffer(), np.uint8))
            parts.append((np.full(len(at), k), at, n, arrays.substring_hash(sums, at - low[k], at - low[k] + s.length)))
        if not parts:
            continue
        row, at, n, name = (np.concatenate(x) for x in zip(*parts))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(take) for k in (0, 1, 4)), pa.array(n), pa.array(at), pa.array(name.view(np.int64))],
            names=["doc_id", "th", "name", "n", "at", "window"],
        )


def repeated_spans(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, th, spans) of the texts with a repeat: spans of bytes (low, end) that cover
    them, in no order and overlapping; th is xxhash64 of the text."""
    key = ["doc_id", "th"]
    found = store.written(
        docs.select("doc_id", "th", "text").mapInArrow(lambda it: _find(it, s), "doc_id long, th long, low long, high long, sample long, name long, context long"),
        "samples",
    )
    classes = store.written(
        found.groupBy("name", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "low", "high", "sample")).alias("at")), "contexts"
    )
    settled = found.join(classes.where("n > 1").select("name", "context"), ["name", "context"], "left_semi")
    settled = settled.select(*key, F.struct(F.col("low"), (F.col("high") + s.length).alias("end")).alias("span"))

    # names with several contexts: one context of each goes on, with its count
    several = classes.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name")
    going = classes.join(several, "name", "left_semi").select("at.*", "name", "n")
    wanted = store.written(going.groupBy(*key).agg(F.collect_list(F.struct("low", "high", "sample", "name", "n")).alias("wanted")), "wanted")
    texts = bloom.candidates(docs.select("doc_id", "th", "text"), wanted.select(*key), key)
    named = wanted.withColumnsRenamed({"doc_id": "w_id", "th": "w_th"})
    texts = texts.join(named, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).dropDuplicates(key)
    contexts = store.written(
        texts.select("doc_id", "th", "text", "wanted").mapInArrow(lambda it: _contexts(it, s), "doc_id long, th long, low long, high long, sample long, name long, n long, bytes binary"),
        "context-bytes",
    )
    order = contexts.select("doc_id", "th", "low", "high", "sample", "name", "n", "bytes")
    blocks = store.written(
        order.mapInArrow(lambda it: _blocks(it, s), "doc_id long, th long, low long, name long, n long, begin long, shift long, core long, full long"), "blocks"
    )
    core = ["name", "shift", "core"]
    place = F.struct(*key, "low", "begin")
    whole = blocks.where("full is not null").groupBy(*core, "full").agg(F.sum("n").alias("n_full"), F.count("*").alias("rows_full"), F.min(place).alias("first"))
    whole = whole.where("n_full > 1")
    settled_rows = whole.groupBy(*core).agg(F.sum("rows_full").alias("rows_settled"))
    shared = blocks.groupBy(*core).agg(F.count("*").alias("rows")).where("rows > 1").join(settled_rows, core, "left")
    shared = shared.select(*core, (F.col("rows") > F.coalesce("rows_settled", F.lit(0))).alias("some_open"))
    rated = blocks.join(shared, core).join(whole, [*core, "full"], "left")
    rated = store.written(
        rated.select(*key, "low", "begin", "n_full", "n", "some_open", place.eqNullSafe(F.col("first")).alias("is_first")), "rated"
    )
    yes = rated.where("n_full is not null").select(*key, F.struct(F.col("begin").alias("low"), (F.col("begin") + (s.block - 1 + s.length)).alias("end")).alias("span"))

    # a settled block may be the other occurrence of a window at an edge: one of each goes on
    begins = rated.where("n_full is null or (some_open and is_first)").groupBy(*key, "low").agg(
        F.collect_list(F.struct("begin", F.coalesce("n_full", "n").alias("n"))).alias("begins")
    )
    begins = begins.withColumnsRenamed({"doc_id": "b_id", "th": "b_th", "low": "b_low"})
    open_ = contexts.join(begins, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("th") == F.col("b_th")) & (F.col("low") == F.col("b_low")))
    single = store.written(
        open_.select("doc_id", "th", "low", "high", "name", "bytes", "begins").mapInArrow(lambda it: _windows(it, s), "doc_id long, th long, name long, n long, at long, window long"),
        "windows",
    )
    twice = single.groupBy("name", "window").agg(F.sum("n").alias("n")).where("n > 1").select("name", "window")
    last = single.join(twice, ["name", "window"], "left_semi").select(*key, F.struct(F.col("at").alias("low"), (F.col("at") + s.length).alias("end")).alias("span"))
    spans = settled.unionAll(yes).unionAll(last)
    return spans.groupBy(*key).agg(F.collect_list("span").alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, kept_text, runs = [], [], [], []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode()
            hit = np.zeros(len(raw) + 1, np.int32)
            np.add.at(hit, [x["low"] for x in spans], 1)
            np.add.at(hit, [x["end"] for x in spans], -1)
            gone = np.cumsum(hit)[:-1] > 0
            left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            n.append(int(gone.sum()))
            runs.append([{"low": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            digest.append(hashlib.sha256(left).hexdigest())
            kept_text.append(left.decode("utf-8", "ignore") if keep else None)
        kinds = pa.list_(pa.struct([("low", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in range(2, batch.num_columns)), pa.array(n, pa.int64()), pa.array(runs, kinds), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
            names=[*batch.schema.names[2:], "n_removed", "runs", "kept_sha256", "kept_text"],
        )


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, runs, kept_sha256, kept_text) for each row of
    docs(doc_id, text).

    runs: the maximal runs of removed bytes (low, end). kept_sha256: of the remaining bytes.
    kept_text: those bytes as text if keep_text, without the pieces of a character that a
    cut leaves; else null. Null is the empty text. Two rows are two documents even if doc_id
    and text are equal, so both lose all. Texts under `length` bytes lose nothing. Other
    columns are not read. An empty table gives an empty one.
    """
    s = settings
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    spans = store.written(repeated_spans(rows, s), "spans")
    # only texts that may have spans are shuffled; what the others give is known here
    out = bloom.marked(rows, spans.select("doc_id", "th"), ["doc_id", "th"]).select(
        "doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(~F.col("hit"), F.sha2(F.col("text").cast("binary"), 256)).alias("whole"),
        F.when(F.col("hit") | F.lit(keep_text), F.col("text")).alias("text"),
    )
    spans = spans.withColumnsRenamed({"doc_id": "s_id", "th": "s_th"})
    out = out.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left")
    kind = "array<struct<low: long, end: long>>"
    out = out.select("text", F.coalesce("spans", F.array().cast(kind)).alias("spans"), "doc_id", "n_bytes", "whole")
    cut = out.mapInArrow(lambda it: _cut(it, keep_text), f"doc_id long, n_bytes long, whole string, n_removed long, runs {kind}, kept_sha256 string, kept_text string")
    return cut.select("doc_id", "n_bytes", "n_removed", "runs", F.coalesce("whole", "kept_sha256").alias("kept_sha256"), "kept_text")

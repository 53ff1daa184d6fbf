"""Benchmark decontamination with an FM-index for each training shard.

A shard is a batch of whole documents. Words outside of the benchmark's vocabulary can be
in no window, so a shard's string holds the runs of words inside it, as symbols; runs
shorter than the shortest window are left out. Windows are found by backward search,
located by sampled suffix places, and merged into removal spans.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, store
from .fmindex import FMIndex

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
SEPARATORS = np.ones(256, bool)
SEPARATORS[48:58] = SEPARATORS[97:123] = SEPARATORS[128:] = False

SPAN = "array<struct<first: long, end: long, from_byte: long, to_byte: long>>"


@dataclass(frozen=True)
class Settings:
    """window: words of a window. block_items: a larger benchmark is searched in blocks
    of about this many items, so that what goes to a task stays bounded."""

    window: int = 10
    block_items: int = 50_000


@dataclass
class Windows:
    """The distinct windows of a block: for each length the patterns (symbols from 1) and
    the items that have each; vocabulary: sorted word hashes, symbol = place + 1."""

    vocabulary: np.ndarray
    patterns: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: first text, word hashes, starts and ends of words (bytes from the
    start of their text), and the number of the first word of each text and of the end."""
    for at, raw, offsets in arrays.chunks(column):
        data = arrays.ASCII_LOWER[raw]
        starts, ends, first = arrays.words(data, offsets, SEPARATORS)
        base = np.repeat(offsets[:-1], np.diff(first))
        yield at, arrays.substring_hash(arrays.prefix(data), starts, ends), starts - base, ends - base, first


def windows_of(items: list[tuple[object, str | None]], size: int) -> Windows:
    """Of (item_id, text) rows. Null texts and texts without words have no window; rows
    with one item_id are one item; items without an id give hits but no item."""
    texts = pa.array([t for _, t in items], pa.string())
    found: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for at, hashes, _, _, first in word_hashes(texts):
        for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            n, own = min(size, hi - lo), items[at + k][0]
            words = hashes[lo:hi].tolist()
            for p in range(hi - lo - n + 1 if n else 0):
                found[n][tuple(words[p : p + n])].update([] if own is None else [str(own)])
    vocabulary = np.array(sorted({w for rows in found.values() for row in rows for w in row}), np.uint64)
    patterns = {n: np.searchsorted(vocabulary, np.array(list(rows), np.uint64)) + 1 for n, rows in found.items()}
    return Windows(vocabulary, patterns, {n: [sorted(x) for x in rows.values()] for n, rows in found.items()})


def search_shard(column: pa.Array, w: Windows) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, set[str]], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """n_words of each text; of texts with hits: the hit words, the items, and the byte
    starts and ends of all words."""
    n_words = np.zeros(len(column), np.int64)
    shortest = min(w.patterns, default=1)
    symbols, owners, places, kept = [], [], [], {}
    for at, hashes, starts, ends, first in word_hashes(column):
        sizes = np.diff(first)
        n_words[at : at + len(sizes)] = sizes
        if not len(hashes) or not len(w.vocabulary):
            continue
        symbol = np.searchsorted(w.vocabulary, hashes)
        symbol = np.where(w.vocabulary[np.minimum(symbol, len(w.vocabulary) - 1)] == hashes, symbol + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        cut = np.ones(len(symbol), bool)  # a run begins here
        cut[1:] = (symbol[1:] == 0) | (symbol[:-1] == 0) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(symbol)))
        good = (symbol[begin] > 0) & (length >= shortest)
        begin, length = begin[good], length[good]
        if not len(begin):
            continue
        index = np.arange(int((length + 1).sum())) - np.repeat(np.cumsum(length + 1) - length - 1, length + 1)
        gap = index == np.repeat(length, length + 1)
        source = np.minimum(np.repeat(begin, length + 1) + index, len(symbol) - 1)
        symbols.append(np.where(gap, 0, symbol[source]))
        owners.append(owner[source] + at)
        places.append(source - first[owner[source]])
        for k in np.unique(owner[begin]).tolist():
            kept[at + k] = (starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])
    hits: dict[int, np.ndarray] = {}
    items: dict[int, set[str]] = defaultdict(set)
    if symbols:
        owner, place = np.concatenate(owners), np.concatenate(places)
        index = FMIndex(np.concatenate(symbols))
        for n, patterns in w.patterns.items():
            low, high = index.search(patterns)
            some = np.flatnonzero(high > low)
            size = (high - low)[some]
            rows = np.repeat(low[some] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            at = index.locate(rows)
            for k, p in zip(np.repeat(some, size).tolist(), at.tolist()):
                text, word = int(owner[p]), int(place[p])
                if text not in hits:
                    hits[text] = np.zeros(int(n_words[text]), bool)
                hits[text][word : word + n] = True
                items[text].update(w.items[n][k])
    return n_words, hits, items, {k: kept[k] for k in hits}


def _mark(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        n_words, hits, items, bytes_ = search_shard(batch.column(names.index("text")), w)
        spans, found = (batch.column(names.index(c)).to_pylist() for c in ("spans", "items"))
        for text, hit in hits.items():
            for s in spans[text]:
                hit[s["first"] : s["end"]] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            starts, ends = bytes_[text]
            spans[text] = [
                {"first": a, "end": b, "from_byte": int(starts[a]), "to_byte": int(ends[b - 1])}
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())
            ]
            found[text] = sorted({*found[text], *items[text]})
        new = {"n_words": pa.array(n_words), "spans": pa.array(spans, batch.schema.field("spans").type), "items": pa.array(found, pa.list_(pa.string()))}
        yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k)) for k, c in enumerate(names)], names=names)


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with n_words, spans and items.

    spans: merged runs of hit words (first, end) and their bytes; items: ids (as text,
    sorted) of the items of benchmark(item_id, text) with an occurring window. Null and
    empty texts have no words. Columns of docs of those names are replaced. An empty
    benchmark hits nothing; an empty table gives an empty one. Repeated rows are alike.
    """
    s = settings
    bench = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = max(1, math.ceil(bench.count() / s.block_items))
    out = docs.withColumns(
        {"text": F.col("text").cast("string"), "n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPAN), "items": F.array().cast("array<string>")}
    )
    for k in range(blocks):
        block = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        w = windows_of([(r["item_id"], r["text"]) for r in block.collect()], s.window)
        out = out.mapInArrow(lambda it, w=w: _mark(it, w), out.schema)
    return out


def removed(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with the spans cut out of their texts, columns as they were; n_chars, where
    present, follows the text. Nothing but hit words and what stands between two of one
    span goes."""
    # the user's columns travel as one, so that none has the name of one that find() adds
    sized = "n_chars" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1), batch.column(2)
            hit = np.flatnonzero(pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False) > 0).tolist()
            size = np.full(batch.num_rows, -1, np.int64)
            if hit:
                new = texts.to_pylist()
                for k in hit:
                    raw, parts, at = new[k].encode(), [], 0
                    for span in spans[k].as_py():
                        parts.append(raw[at : span["from_byte"]])
                        at = span["to_byte"]
                    new[k] = b"".join([*parts, raw[at:]]).decode()
                    size[k] = len(new[k])
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(size)], names=["own", "text", "size"])

    packed = docs.select(F.struct(*docs.columns).alias("own"), F.col("text").cast("string").alias("text"))
    found = find(packed, benchmark, settings).select("own", "text", "spans")
    out = found.mapInArrow(cut, T.StructType([*packed.schema.fields, T.StructField("size", T.LongType())]))
    named = {c: F.col("own").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if sized:
        named["n_chars"] = F.when(F.col("size") >= 0, F.col("size")).otherwise(F.col("own.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(c.alias(n) for n, c in named.items()))

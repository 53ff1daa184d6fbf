"""Packing by concatenate and cut: documents as one stream of tokens, cut into fixed windows.

Pass one tokenises each partition once, writes the ids, and counts as it goes. A prefix sum
over the partitions' totals gives each its place in the stream. Pass two cuts at the windows;
only windows at the borders of what a task reads are put together by a shuffle.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, prefix, store

#: Bytes of an id: little-endian unsigned 32-bit numbers.
ID = 4
# Fixed value: how byte-level tokenizers of this kind split a text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Settings:
    """tokenizer: file for the tokenizers library. end_id follows each document. segment:
    ids of a stored row; a longer document is cut there, too."""

    tokenizer: str
    length: int = 2048
    end_id: int = 1
    segment: int = 32_768


def ranks_of(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The ranks of the tokens of a plain byte-level tokenizer, whose merges are in the order
    of their ids, and its added tokens; None for any other kind."""
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not (plain and level) or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte[c] for c in token): rank for token, rank in model["vocab"].items() if token not in special}
    made = [model["vocab"].get("".join(m) if not isinstance(m, str) else m.replace(" ", "")) for m in model["merges"]]
    if None in made or made != sorted(set(made)) or len(ranks) != 256 + len(made) or sorted(map(len, ranks))[:256] != [1] * 256:
        return None
    return ranks, special


class Encoder:
    """Token ids of texts. A plain byte-level tokenizer file is run as ranks, which gives
    the same ids several times faster; any other kind by the tokenizers library."""

    def __init__(self, s: Settings):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(s.tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        found = ranks_of(json.loads(self.tokenizer.to_str()))
        self.ranks = None
        if found is not None:
            import tiktoken

            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=found[0], special_tokens=found[1])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ranked(t) for t in texts] if self.ranks is not None else self.plain(texts)

    def ranked(self, text: str) -> np.ndarray:
        try:
            return self.ranks.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a run of blanks so long that the pattern's stack is full
            return self.plain([text])[0]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoded(docs: DataFrame, s: Settings) -> DataFrame:
    """(part, ahead, doc_id, start, length, doc_tokens, ids), written: each document's ids
    and the end id, in rows of at most `segment` ids; ahead: ids before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, ahead = Encoder(s), TaskContext.get().partitionId(), 0
        end = np.array([s.end_id], np.uint32)
        for batch in batches:
            for at, n in arrays.stretches(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(at, n).to_pylist()]
                each = [x for ids in encoder.ids(texts) for x in (ids, end)]
                ids = np.concatenate(each).astype("<u4")
                sizes = np.fromiter((len(x) + 1 for x in each[::2]), np.int64, n)
                rows = -(-sizes // s.segment)
                doc = np.repeat(np.arange(len(sizes)), rows)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)) * s.segment
                length = np.minimum(s.segment, sizes[doc] - start)
                edges = np.append(0, np.cumsum(length))
                for k in range(0, len(doc), 1024):
                    e = edges[k : k + 1025]
                    m = len(e) - 1
                    cut = pa.py_buffer(ids[e[0] : e[-1]].tobytes())
                    binary = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(((e - e[0]) * ID).astype(np.int32)), cut])
                    these = slice(k, k + m)
                    columns = [
                        pa.array(np.full(m, part), pa.int64()), pa.array(ahead + e[:-1], pa.int64()),
                        batch.column(0).take(pa.array(at + doc[these])), pa.array(start[these], pa.int64()),
                        pa.array(length[these], pa.int64()), pa.array(sizes[doc[these]], pa.int64()), binary,
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "ahead", "doc_id", "start", "length", "doc_tokens", "ids"])
                ahead += int(edges[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "part long, ahead long, doc_id long, start long, length long, doc_tokens long, ids binary"
    return store.written(rows.mapInArrow(run, schema), "tokens", codec="zstd")


def placed(tokens: DataFrame) -> DataFrame:
    """encoded() rows with at: the place of their first id in the whole stream."""
    # written, so that its size is known: a row a part is sent to the tasks while it is small
    bases = store.written(prefix.before(tokens.groupBy("part").agg(F.sum("length").alias("n"))).select("part", "base"), "bases", 1)
    return tokens.join(bases, "part").withColumn("at", F.col("base") + F.col("ahead")).drop("part", "base", "ahead")


def pack(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of each row
    of docs(doc_id, text), start counted in the document and offset in the sequence.

    Every sequence but the last has `length` ids without gaps. A null or empty text is
    the end id alone. Repeated rows are documents of their own, null ids are kept, other
    columns are not read, and an empty table gives an empty one. Which sequence a
    document is in follows the order of the files; a document may be cut at any id.
    """
    return pieces(placed(encoded(docs, settings)), settings)


def pieces(stream: DataFrame, s: Settings) -> DataFrame:
    last = F.expr(f"(at + length - 1) div {s.length}")

    def piece(w):
        low, high = F.greatest(w * s.length, F.col("at")), F.least((w + 1) * s.length, F.col("at") + F.col("length"))
        skip = low - F.col("at")
        ids = F.substring(F.col("ids"), (skip * ID + 1).cast("int"), ((high - low) * ID).cast("int"))
        return F.struct(
            (F.col("start") + skip).alias("start"), (high - low).alias("length"), w.alias("sequence_id"),
            (low - w * s.length).alias("offset"), ids.alias("ids"),
        )

    cut = F.transform(F.sequence(F.expr(f"at div {s.length}"), last), piece)
    out = stream.select("doc_id", "doc_tokens", F.explode(cut).alias("p"))
    return out.select("doc_id", "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset", "p.ids")


def sequences(docs: DataFrame, settings: Settings) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, ids as little-endian unsigned
    32-bit numbers, not padded; the last may be short. A task puts together what it reads in
    a row; fragments at its borders are joined by sequence, a window of ids at most."""
    size = settings.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = b"", 0  # ids held, and the place of the first of them

        def cut(all_: bool) -> pa.RecordBatch:
            nonlocal held, first
            rows, at = [], 0
            while at * ID < len(held):
                n = min(size - (first + at) % size, len(held) // ID - at)
                if not all_ and (first + at + n) % size:
                    break
                rows.append(((first + at) // size, (first + at) % size, held[at * ID : (at + n) * ID]))
                at += n
            held, first = held[at * ID :], first + at
            columns = list(zip(*rows)) or [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                names=["sequence_id", "offset", "ids"],
            )

        for batch in batches:
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != first + len(held) // ID:
                    if held:
                        yield cut(True)
                    held, first = b"", at
                held += ids
                if len(held) >= 64 * size * ID:
                    yield cut(False)
        if held:
            yield cut(True)

    stream = placed(encoded(docs, settings)).select("at", "ids")
    found = stream.mapInArrow(run, "sequence_id long, offset long, ids binary")
    whole = F.length("ids") == size * ID
    border = found.where(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    joined = border.select("sequence_id", F.aggregate("x.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
    return found.where(whole).select("sequence_id", "ids").unionByName(joined)

"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gets its j-th block released at floor(j / w) and due at
ceil((j + 1) / w); the earliest deadline among released blocks takes each slot. After t
slots every source has t * w blocks, give or take less than one. Weights are whole numbers
over their sum, so this holds for the whole stream. One task deals the slots: it holds the
sources, not the blocks, and takes a step for each block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store


@dataclass(frozen=True)
class Settings:
    """block_rows: rows of a block. slots: length of a period of shares(); mix() has no
    period. power: without given weights a source of n rows gets a weight in proportion to
    n ** power. bucket_rows: rows that are ranked together."""

    block_rows: int = 32
    slots: int = 1000
    power: float = 0.7
    bucket_rows: int = 20_000


def shares(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Slots of a period for each source: the largest remainders round up, none gets 0."""
    if len(weights) > slots:
        raise ValueError(f"{len(weights)} sources need a period of as many slots, not {slots}")
    total = sum(map(Fraction, weights.values()))
    ideal = {k: Fraction(w) / total * slots for k, w in weights.items()}
    out = {k: max(1, int(x)) for k, x in ideal.items()}
    order = sorted(ideal, key=lambda k: (out[k] - ideal[k], k))
    for k in order[: max(0, slots - sum(out.values()))]:
        out[k] += 1
    while sum(out.values()) > slots:
        out[max((k for k in out if out[k] > 1), key=lambda k: (out[k] - ideal[k], k))] -= 1
    return out


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the exact proportions of the weights."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError(f"weights must be above 0: {sorted(k for k, w in exact.items() if w <= 0)[:10]}")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {k: int(w * scale) for k, w in exact.items()}


def schedule(weight: dict[str, int]) -> Iterator[tuple[str, int]]:
    """The source and the number of its block for each slot, without end, by earliest
    deadline among released blocks."""
    total = sum(weight.values())
    waiting = [(0, k, 0) for k in weight]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weight[k]), k, j))
        due, k, j = heapq.heappop(ready)
        assert due > t, "a block missed its deadline"
        yield k, j
        t += 1
        heapq.heappush(waiting, (max(t, (j + 1) * total // weight[k]), k, j + 1))


def period(share: dict[str, int]) -> list[str]:
    """The source of each slot of a period."""
    return [k for k, _ in islice(schedule(share), sum(share.values()))]


def dealt(sizes: DataFrame, weights: dict[str, float] | None, s: Settings, batch_slots: int = 65_536) -> DataFrame:
    """(_k, _block, epoch, slot) until every block of sizes(k, n) has been used once."""
    names = ["_k", "_block", "epoch", "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {r["k"]: r["n"] for batch in batches for r in batch.to_pylist()}
        if not rows:
            return
        weight = whole({k: weights[k] if weights is not None else n**s.power for k, n in rows.items()})
        blocks = {k: -(-n // s.block_rows) for k, n in rows.items()}
        slots = schedule({k: weight[k] for k in sorted(weight)})
        unused, at = len(blocks), 0
        while unused:
            out: list[tuple[str, int, int, int]] = []
            while unused and len(out) < batch_slots:
                k, j = next(slots)
                epoch, block = divmod(j, blocks[k])
                out.append((k, block, epoch, at))
                at += 1
                unused -= j + 1 == blocks[k]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return sizes.coalesce(1).mapInArrow(run, "_k string, _block long, epoch long, slot long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, settings: Settings = Settings()) -> DataFrame:
    """docs with epoch, slot and place (long): the stream is ordered by slot, place.

    Rows of a source are put in the order of a hash of doc_id and cut into blocks. The
    stream ends when every row has been used once; a source that runs out before begins
    again (epoch 1, 2, ...), so no row is lost and the weights hold all along. A null
    source is the source "". Sources without a given weight above 0 raise ValueError. Repeated
    rows are rows of their own. Columns of those names are replaced. An empty table
    gives an empty one.
    """
    s = settings
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    new = ("epoch", "slot", "place")
    empty = docs.limit(0).withColumns({c: F.lit(0).cast("long") for c in new})
    sizes = store.written(docs.groupBy(source.alias("k")).agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return empty
    if weights is not None:
        given = docs.sparkSession.createDataFrame([(k,) for k, w in weights.items() if w > 0], "k string")
        unknown = [r["k"] for r in sizes.join(given, "k", "left_anti").orderBy("k").limit(10).collect()]
        if unknown:
            raise ValueError(f"no weight above 0 for {unknown}")
    plan = store.written(dealt(sizes, weights, s), "plan")
    # buckets are ranges of the hash, so the order doesn't depend on their number
    bits = max(0, (total // s.bucket_rows).bit_length())
    # the user's columns travel as one, so that none has the name of one of these
    rows = docs.select(source.alias("_k"), F.xxhash64(F.col("doc_id").cast("string")).alias("_hash"), F.struct(*docs.columns).alias("_own"))
    rows = rows.withColumn("_bucket", F.shiftright("_hash", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy("_k", "_bucket").agg(F.count("*").alias("n"))
    before = counts.select("_k", "_bucket", (F.sum("n").over(Window.partitionBy("_k").orderBy("_bucket")) - F.col("n")).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_k", "_bucket").orderBy("_hash", "_own.doc_id")) - 1)
    ranked = ranked.join(before, ["_k", "_bucket"]).withColumn("_row", F.col("_before") + F.col("_rank"))
    ranked = ranked.withColumn("_block", F.expr(f"_row div {s.block_rows}"))
    out = ranked.join(plan, ["_k", "_block"]).withColumn("place", F.col("_row") % s.block_rows)
    return out.select(*(F.col(c) if c in new else F.col("_own").getField(c).alias(c) for c in empty.columns))

"""A bit set of hashed keys, to leave rows out of a shuffle that will find no partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits at most, so at most 8 MiB are broadcast, however many keys there are.
MOST_BITS = 1 << 26


def marked(rows: DataFrame, keys: DataFrame, on: list[str], name: str = "hit") -> DataFrame:
    """rows with a boolean column: false only if keys has no row that equals in `on`."""
    size = min(MOST_BITS, 1 << max(15, (16 * keys.count()).bit_length()))
    bit = F.pmod(F.xxhash64(*on), F.lit(size)) + 1  # buckets count from 1
    bits = keys.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits")
    )
    out = rows.withColumn("_bit", bit).withColumns({"_at": F.bitmap_bit_position("_bit"), "_bucket": F.bitmap_bucket_number("_bit")})
    out = out.join(F.broadcast(bits), "_bucket", "left")  # at most MOST_BITS bits
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_at div 8) + 1, 1)")), 16, 10).cast("int")
    test = F.call_function("shiftright", byte, (F.col("_at") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return out.withColumn(name, F.coalesce(test, F.lit(False))).drop("_bit", "_at", "_bucket", "_bits")


def candidates(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows without most of those whose `on` columns no row of keys equals."""
    return marked(rows, keys, on, "_hit").where("_hit").drop("_hit")

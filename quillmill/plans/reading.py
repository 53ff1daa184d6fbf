"""How the nodes of a document read as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Revisions of text and the order in which new ones are reported.
REVISIONS = {"w:ins": "insertion", "w:del": "deletion", "w:moveFrom": "move-from", "w:moveTo": "move-to"}
INSERTED, REMOVED = ["w:ins", "w:moveTo"], ["w:del", "w:moveFrom"]
CHARACTERS = ["w:tab", "w:ptab", "w:br", "w:cr", "w:noBreakHyphen", "w:softHyphen", "w:sym"]


def under(*tags: str) -> Column:
    """Any ancestor has one of the tags."""
    return F.arrays_overlap("anc_tags", F.array(*map(F.lit, tags)))


def owner(tag: str) -> Column:
    """The id of the nearest ancestor with the tag."""
    return F.get("anc_ids", F.array_position("anc_tags", tag).cast("int") - 1)


def symbol(code: Column) -> Column:
    """The character of a hexadecimal code point; empty for what is none."""
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), "^0+(?=.)", "")
    value = F.conv(F.when(digits.rlike("^[0-9A-Fa-f]{1,6}$"), digits), 16, 10).cast("int")
    good = value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")).otherwise("")


def shown() -> Column:
    """What an element of a run reads as; null for all others. A tab of a tab list is none."""
    tag, parent = F.col("tag"), F.get("anc_tags", F.lit(0))
    return (
        F.when(tag.isin("w:t", "w:delText"), F.coalesce("text", F.lit("")))
        .when((tag == "w:ptab") | ((tag == "w:tab") & ~parent.eqNullSafe("w:tabs")), "\t").when(tag.isin("w:br", "w:cr"), "\n")
        .when(tag == "w:noBreakHyphen", "-").when(tag == "w:softHyphen", "").when(tag == "w:sym", symbol(F.col("attrs")["w:char"]))
    )


def pieces(nodes: DataFrame) -> DataFrame:
    """The nodes that read as text, with `shown`, their paragraph `p` and the two views."""
    rows = nodes.where(F.col("tag").isin("w:t", "w:delText", *CHARACTERS)).withColumn("shown", shown()).where("shown is not null")
    return rows.withColumns({
        "p": owner("w:p"),
        "is_current": ~((F.col("tag") == "w:delText") | (F.col("tag").isin(*CHARACTERS) & under("w:del"))),
        "is_original": ~under(*INSERTED),
    })


def joined(rows: DataFrame, keys: list[str], keep: str, name: str) -> DataFrame:
    """keys and the text of rows in reading order; a paragraph's end reads as a blank."""
    told = rows.where(keep).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", "p", "shown"))).alias("t"))
    apart = F.transform("t", lambda x, i: F.concat(F.when((i > 0) & x["p"].eqNullSafe(F.get("t", i - 1)["p"]), "").otherwise("\n"), x["shown"]))
    return told.select(*keys, T.squeezed(F.array_join(apart, "")).alias(name))

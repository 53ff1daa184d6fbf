"""Small expressions over lists and measures that reports and layouts share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: English metric units of a point.
EMU = 12_700


def points(emu: Column) -> Column:
    return emu / F.lit(float(EMU))


def emus(points_: Column) -> Column:
    """Whole units; a half goes to the even neighbour."""
    return F.bround(points_ * EMU).cast("long")


def overflow_ratio(need: Column, box: Column) -> Column:
    """By how much need is over box, as a part of box; infinite if there is no box."""
    none = F.when(need > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.when(box <= 0, none).otherwise(F.greatest(F.lit(0.0), (need - box) / box))


def off_slide(x: Column, y: Column, cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """'outside' if nothing of a shape is on the slide, 'over' if an edge is off it, else null."""
    outside = (x >= width) | (y >= height) | (x + cx <= 0) | (y + cy <= 0)
    return F.when(outside, "outside").when((x < 0) | (y < 0) | (x + cx > width) | (y + cy > height), "over")


def names_and_more(names: Column, k: int = 5) -> Column:
    """The first k names, and how many more there are."""
    more = F.size(names) - k
    return F.concat(F.array_join(F.slice(names, 1, k), ", "), F.when(more > 0, F.concat(F.lit(" and "), more, F.lit(" more"))).otherwise(""))


def folded(values: Column) -> Column:
    """One value for a list whose items are all equal, else its distinct items in brackets."""
    one = F.array_distinct(values)
    return F.when(F.size(one) == 1, F.get(one, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]")))


def blank_edges(rows: Column) -> Column:
    """(above, below): blank rows before the first and after the last row that isn't blank;
    all rows are above if none is."""
    full = F.transform(rows, lambda r: F.trim(r) != "")
    first = F.array_position(full, F.lit(True)).cast("int")
    last = F.array_position(F.reverse(full), F.lit(True)).cast("int")
    none = first == 0
    return F.struct(F.when(none, F.size(rows)).otherwise(first - 1).alias("above"), F.when(none, 0).otherwise(last - 1).alias("below"))

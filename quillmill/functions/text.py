"""Text expressions whose exact meaning the rules depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z only: names of parts compare so, whatever else Unicode would fold."""
    return F.translate(c, UPPER, LOWER)


def squeezed(c: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def unescaped(c: Column) -> Column:
    """Percent escapes decoded; a plus stays a plus; null where an escape is broken."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def part_key(c: Column) -> Column:
    return ascii_lower(F.regexp_replace(F.coalesce(unescaped(c), c), "^/", ""))


def media_type(c: Column) -> Column:
    return F.trim(ascii_lower(F.substring_index(c, ";", 1)))


def occurrences(c: Column, piece: Column) -> Column:
    """Non-overlapping occurrences of a piece; 0 for an empty piece."""
    cut = (F.length(c) - F.length(F.replace(c, piece, F.lit("")))) / F.length(piece)
    return F.when(F.length(piece) > 0, cut).otherwise(0).cast("long")


def snippet(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading items of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n)).cast("int")


def edge_space(c: Column) -> Column:
    """Blank, tab, carriage return or line feed at an end; no other white space counts."""
    return F.coalesce(c.rlike(r"^[ \t\r\n]") | c.rlike(r"[ \t\r\n]$"), F.lit(False))


def glob_regex(pattern: str) -> str:
    """An anchored regex of a path pattern: `*`, `?` and `[..]` within a segment, `**` across;
    a last `**` takes one segment at least."""
    import re

    parts = pattern.strip("/").split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:[^/]+/)*"
            continue
        for piece in re.findall(r"\[!?\]?[^\]]*\]|.", part):
            if len(piece) > 1:
                body = piece[1:-1].replace("\\", "\\\\").replace("[", "\\[")
                out += "[" + ("^/" + body[1:] if body.startswith("!") else body) + "]"
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(piece) or re.escape(piece)
        out += "" if last else "/"
    return f"^{out}$"

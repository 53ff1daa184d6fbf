"""One-to-one choices that depend on order."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_free(pairs: DataFrame, keys: list[str], left: str = "s_ord", right: str = "e_ord") -> DataFrame:
    """Of pairs(keys, left, right): each left in order takes the first right that no earlier
    one took. A group is one document's open items, so it is small."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        rows = []
        for _, own in frame.sort_values([left, right]).groupby(left, sort=True):
            free = own[~own[right].isin(taken)]
            if len(free):
                rows.append(free.iloc[0])
                taken.add(free.iloc[0][right])
        return pd.DataFrame(rows, columns=frame.columns)

    chosen = pairs.select(*keys, left, right).distinct()
    return chosen.groupBy(*keys).applyInPandas(run, chosen.schema)


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising run of the values, in order."""
    ends: list[int] = []  # the least value that ends a run of each length
    at: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        n = bisect_left(ends, v)
        before.append(at[n - 1] if n else -1)
        if n == len(ends):
            ends.append(v)
            at.append(k)
        else:
            ends[n], at[n] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def rising(values: Column) -> Column:
    """The places (from 0) of as many values of an array as rise from left to right."""
    return F.pandas_udf(lambda s: pd.Series([_rising(list(v)) for v in s]), "array<int>")(values)

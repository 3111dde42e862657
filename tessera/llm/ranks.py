"""Ranks and running sums inside groups of any size.

A window function over a group puts the whole group into one task. Here each group is first dealt into chunks: the sums
of the chunks (few rows) are added up before it, and the window then runs inside one chunk only. A group that holds a
third of all rows is thus ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a chunk should hold.
CHUNK_ROWS = 4096


def spread(order_hash: Column, rows: int) -> Column:
    """A chunk number that rises with a 32-bit ``order_hash``, so that chunks are ranges of the hash order."""
    return F.floor(order_hash * F.lit(float(max(1, -(-rows // CHUNK_ROWS)))) / F.lit(float(2**32))).cast("long")


def running(df: DataFrame, group: list[str], chunk: str, order: list[Column | str], sums: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds, for each ``{name: (value, kind)}``, the sum of value over the rows of the group that stand before the row.

    Rows stand in order of ``chunk`` and then of ``order``. Groups that are null are groups of their own.
    """
    totals = df.groupBy(*group, chunk).agg(*[F.sum(value).alias(f"__t_{name}") for name, (value, _) in sums.items()])
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"__g_{c}") for c in (*group, chunk)], *[F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__s_{name}") for name in sums])
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(f"__l_{name}") for name, (value, _) in sums.items()])
    for_each = [(F.col(f"__l_{name}") + F.col(f"__s_{name}")).cast(kind).alias(name) for name, (_, kind) in sums.items()]
    same = F.lit(True)
    for c in (*group, chunk):
        same = same & local[c].eqNullSafe(F.col(f"__g_{c}"))
    return local.join(starts, same).select(*df.columns, *for_each)


def beside(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, where null equals null; the result has the columns of left, then the others of right."""
    named = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(named, same, how).drop(*[f"__r_{c}" for c in on])

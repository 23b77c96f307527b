"""Deep pages of a ranking without sorting what stands in front of them.

The place of a page is found by counting. Rows are counted by ranges of the leading key, the range
that holds the page's first row is counted again in finer ranges, and so on through the keys, until
few enough rows are left to sort. Each round is one aggregation of the rows of one range; only the
rows of the last range or two are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that one round counts, and rows that are few enough to sort.
RANGES, FEW = 256, 10_000


def _before(column: Column, low, high) -> Column:
    """Whether a value lies in (low, high]; None is no border."""
    out = column.isNotNull()
    if low is not None:
        out = out & (column > F.lit(low))
    return out & (column <= F.lit(high)) if high is not None else out


def _counted(rows: DataFrame, name: str, descending: bool) -> list[tuple[Column, int, bool]]:
    """Ranges of a key in order: a condition, its rows, and whether all of them are alike in it."""
    column = F.col(name)
    if isinstance(rows.schema[name].dataType, T.NumericType):
        borders = rows.agg(F.percentile_approx(column, [i / RANGES for i in range(1, RANGES + 1)], 100 * RANGES).alias("b")).first().b or []
        # A border that many rows share gets a range of its own.
        marks = sorted(set(borders))
        place = F.size(F.filter(F.array(*[F.lit(b).cast(rows.schema[name].dataType) for b in marks]), lambda b: b < column))
        found = rows.where(column.isNotNull()).groupBy(place.alias("i")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        ranges = [(_before(column, None, None) & (column >= F.lit(r.low)) & (column <= F.lit(r.high)), r.n, r.low == r.high) for r in sorted(found, key=lambda r: r.low)]
    else:
        # Strings: ranges begin with the same letters, one more than all rows have in common.
        ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
        shared = next((i for i, (a, b) in enumerate(zip(ends.low or "", ends.high or "", strict=False)) if a != b), min(len(ends.low or ""), len(ends.high or "")))
        head = F.substring(column, 1, shared + 1)
        found = rows.where(column.isNotNull()).groupBy(head.alias("h")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        ranges = [(head == F.lit(r.h), r.n, r.low == r.high) for r in sorted(found, key=lambda r: r.low.encode())]
    if descending:
        ranges.reverse()
    nulls = rows.where(column.isNull()).count()
    return [*ranges, *([(column.isNull(), nulls, True)] if nulls else [])]


def page_by_key(rows: DataFrame, order: Sequence[tuple[str, bool]], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of rows in an order of (column, descending), nulls last; the order must end in a unique key.

    Columns are numbers or strings. What a page holds is that of a full sort with offset and limit.
    """
    if number < 1 or size < 1:
        raise ValueError("pages and their size count from 1")
    skip, left, fixed = (number - 1) * size, [], rows
    keys = list(order)
    while keys:
        ranges = _counted(fixed, *keys[0])
        at = 0
        while at < len(ranges) and skip >= ranges[at][1]:
            skip -= ranges[at][1]
            at += 1
        if at == len(ranges):
            break
        condition, n, alike = ranges[at]
        # Later ranges that the page reaches into come along, sorted by themselves.
        rest, more = [], size - (n - skip)
        for later, m, _ in ranges[at + 1 :]:
            if more <= 0:
                break
            rest.append(fixed.where(later))
            more -= m
        left = [*rest, *left]
        fixed = fixed.where(condition)
        if n <= max(FEW, size) or (not alike and len(ranges) == 1):
            break
        if alike:
            keys = keys[1:]
    by = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in order]
    if keys and at == len(ranges):
        fixed = fixed.limit(0)
    whole = fixed
    for part in left:
        whole = whole.unionByName(part)
    return whole.orderBy(*by).offset(skip).limit(size)

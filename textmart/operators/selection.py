"""The k-th largest value and exact quantiles, from histograms: no value is sorted, and none shuffled but a few at the end."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 1 << 10

# So many rows of a bracket, at most, are counted value by value.
FEW = 1 << 12


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a whole-number column (nulls aside); None if there are fewer.

    Each pass over `df`, which should be cheap to read, counts the values that are left in at most STEPS equal
    ranges and goes on with the range that holds the k-th. A 64-bit column takes seven passes at most.
    """
    low, high, count = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if count < k:
        return None
    while low < high:
        width = -(-(high - low + 1) // STEPS)
        step = F.call_function("div", F.col(column) - F.lit(low), F.lit(width).cast("long"))
        held = df.where(F.col(column).between(low, high)).groupBy(step.alias("step")).count().collect()  # STEPS rows at most
        for step, n in sorted(((r["step"], r["count"]) for r in held), reverse=True):
            if n >= k:
                low, high = low + step * width, min(high, low + (step + 1) * width - 1)
                break
            k -= n
    return low


def _step(value: Column, low: float, high: float) -> Column:
    """The range of [low, high], of STEPS equal ones, that `value` is in: larger values are never in a lower one."""
    if math.isfinite(low) and math.isfinite(high):
        # Halves, so that the width is finite, too.
        share = (value / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
        return F.least(F.floor(share * STEPS), F.lit(STEPS - 1)).cast("int")
    return F.when(value == F.lit(-math.inf), 0).when(F.isnan(value), 3).when(value == F.lit(math.inf), 2).otherwise(1)


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """For each number column its quantiles: the smallest value whose rank is at least that share of all values.

    Every quantile has a bracket, at first from the smallest to the largest value. A pass over `df` counts the values of all
    open brackets in STEPS ranges each, with the smallest and largest value of each range, and the range that holds the rank
    becomes the bracket. A bracket of one value is done; one of at most FEW rows is counted value by value. Two passes are
    usual, very uneven values take more. What is collected is bounded by the number of quantiles. Each column is read by itself,
    so `df` should be cheap to read.

    Nulls are left out; NaN is larger than all numbers.
    """
    cells = {c: F.col(f"`{c}`").cast("double") for c in columns}
    ends = df.agg(*[f(cell) for cell in cells.values() for f in (F.min, F.max, F.count)]).first()
    result: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    # Open brackets: (column, low, high, rows) to the quantiles in them with their ranks inside.
    brackets: dict[tuple, list[tuple[int, int]]] = {}
    for at, c in enumerate(columns):
        low, high, count = ends[3 * at:3 * at + 3]
        if count:
            brackets[c, low, high, count] = [(i, max(1, math.ceil(Fraction(str(s)) * count))) for i, s in enumerate(shares)]
    while brackets:
        for key in [k for k in brackets if k[1] == k[2] or math.isnan(k[1])]:
            for i, _ in brackets.pop(key):
                result[key[0]][i] = key[1]
        if not brackets:
            break
        opened, parts = list(brackets), []
        for c in dict.fromkeys(key[0] for key in opened):
            # Brackets of a column share no value: a cell is in one of them at most.
            value, bracket, step, single = F.col("value"), F.lit(None), F.lit(-1), F.lit(None).cast("double")
            for at, (column, low, high, count) in enumerate(opened):
                if column == c:
                    inside = value.between(F.lit(low), F.lit(high))
                    bracket = F.when(inside, F.lit(at)).otherwise(bracket)
                    if count > FEW:
                        step = F.when(inside, _step(value, low, high)).otherwise(step)
                    else:
                        single = F.when(inside, value).otherwise(single)
            parts.append(df.select(cells[c].alias("value")).select(
                bracket.alias("bracket"), step.alias("step"), single.alias("single"), "value").where("bracket IS NOT NULL"))
        held = reduce(DataFrame.unionAll, parts).groupBy("bracket", "step", "single").agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        ranges = defaultdict(list)
        for r in held.collect():  # for each bracket at most STEPS or FEW rows
            ranges[r["bracket"]].append((r["step"], math.isnan(r["low"]), r["low"], r["high"], r["n"]))
        narrowed = defaultdict(list)
        for at, key in enumerate(opened):
            listed = sorted(ranges[at], key=lambda r: (r[0], r[1], 0.0 if r[1] else r[2]))
            for i, rank in brackets[key]:
                for _, _, low, high, n in listed:
                    if rank <= n:
                        narrowed[key[0], low, high, n].append((i, rank))
                        break
                    rank -= n
        brackets = dict(narrowed)
    return result

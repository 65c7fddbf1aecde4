"""Exact interpolated percentiles without holding all values in one task.

The built-in exact percentile keeps every distinct value in one buffer, which is right for up to LIMIT values. Above that,
mergeable sketches bracket the wanted ranks; the rows of a bracket are counted exactly, and brackets are narrowed until they
hold at most LIMIT rows or one value. Only those rows are ordered. Values are compared, never divided into widths, so
infinite values and any spread of magnitudes are ranks like others.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LIMIT = 1_000_000
_ACCURACY = 10_000


def _within(x: Column, span: tuple) -> Column:
    low, high = span[:2]
    return x.isNotNull() if low is None else x.between(F.lit(low), F.lit(high))


def _values_at(values: DataFrame, n: int, ranks: list[int], limit: int) -> dict[int, float]:
    """Value of column x at each 0-based rank of its order. Two passes narrow every bracket about 2,500-fold."""
    x = F.col("x")
    spans = {r: (None, None, 0, n) for r in ranks}  # bounds, rows below, rows within
    margin = dict.fromkeys(ranks, 2 / _ACCURACY)
    while wide := [r for r, (low, high, _, inside) in spans.items() if inside > limit and (low is None or low != high)]:
        tries = []
        for r in wide:
            p = (r - spans[r][2] + 0.5) / spans[r][3]
            tries.append(F.percentile_approx(F.when(_within(x, spans[r]), x), [max(0.0, p - margin[r]), min(1.0, p + margin[r])], _ACCURACY))
        bounds = values.agg(*tries).first()
        counts = values.agg(*[c for low, high in bounds for c in (
            F.count_if(x < low), F.count_if(x.between(F.lit(low), F.lit(high))))]).first()
        for k, r in enumerate(wide):
            below, inside = counts[2 * k], counts[2 * k + 1]
            if below <= r < below + inside:
                spans[r] = (*bounds[k], below, inside)
            else:  # the sketch promised better
                margin[r] *= 2
    distinct = sorted(set(spans.values()), key=str)
    tagged = values.where(reduce(or_, [_within(x, s) for s in distinct])).select("x", F.explode(F.array(*[
        F.when(_within(x, s), F.lit(k)) for k, s in enumerate(distinct)])).alias("k")).where("k IS NOT NULL")
    order = W.partitionBy("k").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    counted = tagged.groupBy("k", "x").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(order), F.lit(0)))
    wanted = [(F.col("k") == distinct.index(s)) & (F.col("before") <= r - s[2]) & (F.col("before") + F.col("m") > r - s[2])
              for r, s in spans.items()]
    found = counted.where(reduce(or_, wanted)).collect()
    return {r: next(f.x for f in found if f.k == distinct.index(s) and f.before <= r - s[2] < f.before + f.m) for r, s in spans.items()}


def percentile_array(df: DataFrame, value: str | Column, probs: list[float], n: int, limit: int = LIMIT) -> Column:
    """An aggregate over `df` giving the percentiles of its `n` values that are not null."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    if n <= limit:
        return F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
    places = [p * (n - 1) for p in probs]
    ranks = sorted({f(x) for x in places for f in (math.floor, math.ceil)})
    at = _values_at(df.select(value.alias("x")).where("x IS NOT NULL"), n, ranks, limit)

    def between(place: float) -> float:
        low, high = at[math.floor(place)], at[math.ceil(place)]
        return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high

    return F.array(*[F.lit(between(x)) for x in places])


def exact_percentiles(df: DataFrame, value: str | Column, probs: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """One row with a column per entry of `probs`, linear interpolation, nulls ignored."""
    column = F.col(value) if isinstance(value, str) else value
    n = df.agg(F.count(column.cast("double"))).first()[0]
    found = df.agg(percentile_array(df, column, list(probs.values()), n, limit).alias("p"))
    return found.select(*[F.col("p")[k].alias(name) for k, name in enumerate(probs)])

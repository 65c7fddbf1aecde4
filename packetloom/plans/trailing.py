"""Trailing counts over time, exact for keys of any size.

A RANGE window per key would sort a key's whole history in one task. Here each event is
entered twice, once when it arrives and once when it leaves the trailing interval; a short
time slice of a key is processed per group, starting from the number of events still inside
the interval at the slice's begin, which comes from a small table of slice counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from packetloom.plans.sessions import slice_of

_BLOCK = 64  # slices of the count table per window group, in units of the interval


def trailing_sums(df: DataFrame, scope: list[str], ts: str, span_us: int, flags: dict[str, str],
                  slices: int = 32, counts_from: DataFrame | None = None) -> DataFrame:
    """Adds, for each `out: flag` in `flags`, the sum of the numeric column `flag` over rows of
    the same scope with `ts - span_us <= time <= ts` (peers at the same time included).

    `ts` is in microseconds, `scope` columns must not be null; empty scope means all rows.
    `counts_from` names a cheaper frame with the same rows to take the slice counts from, where
    `df` is itself the result of heavy work.
    """
    slices = max(1, min(slices, span_us))
    while span_us % slices:
        slices -= 1
    width = span_us // slices
    rows = df.withColumn("_slice", slice_of(ts, width))

    counted = rows if counts_from is None else counts_from.withColumn("_slice", slice_of(ts, width))
    counts = counted.groupBy(*scope, "_slice").agg(*[F.sum(f).alias(o) for o, f in flags.items()])
    block = _BLOCK * slices
    blocks = F.expr(
        f"CASE WHEN pmod(_slice, {block}) >= {block - slices} "
        f"THEN array(_slice - pmod(_slice, {block}), _slice - pmod(_slice, {block}) + {block}) "
        f"ELSE array(_slice - pmod(_slice, {block})) END"
    )
    behind = W.partitionBy(*scope, "_block").orderBy("_slice").rangeBetween(-slices, -1)
    base = (
        counts.withColumn("_block", F.explode(blocks))
        .withColumns({f"_base_{o}": F.coalesce(F.sum(o).over(behind), F.lit(0)) for o in flags})
        .where(F.col("_slice") >= F.col("_block"))  # the home copy
        .select(*scope, "_slice", *[F.col(f"_base_{o}").alias(f"_d_{o}") for o in flags])
        # clock is twice the time so that arrivals at t come before departures due at t
        .withColumn("_clock", F.col("_slice") * F.lit(2 * width) - 1)
    )
    moves = rows.withColumn(
        "_move",
        F.explode(F.array(
            F.struct(F.lit(0).alias("late"), F.col("_slice").alias("at"), (F.col(ts) * 2).alias("clock")),
            F.struct(F.lit(1).alias("late"), (F.col("_slice") + slices).alias("at"),
                     ((F.col(ts) + F.lit(span_us)) * 2 + 1).alias("clock")),
        )),
    ).select(
        *[F.when(F.col("_move.late") == 0, F.col(c)).alias(c) if c not in scope else F.col(c) for c in df.columns],
        F.col("_move.at").alias("_slice"),
        F.col("_move.clock").alias("_clock"),
        (F.col("_move.late") == 0).alias("_home"),
        *[F.when(F.col("_move.late") == 0, F.col(f)).otherwise(-F.col(f)).alias(f"_d_{o}") for o, f in flags.items()],
    )
    running = W.partitionBy(*scope, "_slice").orderBy("_clock").rangeBetween(W.unboundedPreceding, 0)
    return (
        moves.unionByName(base, allowMissingColumns=True)
        .withColumns({o: F.sum(f"_d_{o}").over(running) for o in flags})
        .where("_home")
        .drop("_slice", "_clock", "_home", *[f"_d_{o}" for o in flags])
    )

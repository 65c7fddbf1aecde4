"""Gap sessions over keys of any size.

A window over a whole key puts that key's history in one task. Here a key is cut into
fixed time slices, runs are found inside (key, slice), and only the first and last run of
each slice are chained across slices. The data is shuffled once; the per-key chain holds
at most two rows per slice, however many rows the key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def slice_of(ts: str, width_us: int) -> Column:
    """Number of the slice a microsecond time falls into (exact for any sign)."""
    return F.expr(f"(`{ts}` - pmod(`{ts}`, {int(width_us)}L)) div {int(width_us)}L")


def local_runs(df: DataFrame, keys: list[str], ts: str, seq: str, gap_us: int, slice_us: int,
               cut: str | None = None) -> DataFrame:
    """Adds the run each row belongs to inside its slice.

    A run opens at the first row of the slice, after a gap above `gap_us`, and after a row
    whose `cut` flag is set. New columns: `_slice`, `_prev` (time of the previous row of the
    run), `_head`/`_tail` (first or last row of the slice), `_run_ts`, `_run_seq`.
    """
    order = W.partitionBy(*keys, "_slice").orderBy(ts, seq)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    before = F.lag(ts).over(order)
    closed = F.lag(cut).over(order) if cut else F.lit(False)
    opens = before.isNull() | (F.col(ts) - before > F.lit(int(gap_us))) | closed
    return (
        df.withColumn("_slice", slice_of(ts, slice_us))
        .withColumns({
            "_before": before,
            "_opens": opens,
            "_tail": F.lead(ts).over(order).isNull(),
        })
        .withColumns({
            "_head": F.col("_before").isNull(),
            "_prev": F.when(~F.col("_opens"), F.col("_before")),
            "_run_ts": F.last(F.when(F.col("_opens"), F.col(ts)), True).over(upto),
            "_run_seq": F.last(F.when(F.col("_opens"), F.col(seq)), True).over(upto),
        })
        .drop("_before", "_opens")
    )


def run_bounds(ts: str, cut: str | None = None) -> list[Column]:
    """Aggregates `chain_runs` needs from the rows of a run."""
    return [
        F.max(ts).alias("_last"),
        F.max("_head").alias("_head"),
        F.max("_tail").alias("_tail"),
        (F.max(cut) if cut else F.lit(False)).alias("_cut"),
    ]


def chain_spec(keys: list[str]):
    """Window over the runs of a key; runs inside a slice stand alone, so only the runs at
    slice borders share a partition."""
    return W.partitionBy(*keys, "_chain").orderBy("_run_ts", "_run_seq")


def chain_runs(runs: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Joins runs across slice borders: adds `_starts`, `_prev_last`, `_start_ts`, `_start_seq`."""
    runs = runs.withColumn(
        "_chain",
        F.when(F.col("_head") | F.col("_tail"), F.lit(0).cast("long")).otherwise(
            F.xxhash64("_run_ts", "_run_seq")
        ),
    )
    order = chain_spec(keys)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    prev = F.lag("_last").over(order)
    starts = (
        ~F.col("_head")
        | prev.isNull()
        | (F.col("_run_ts") - prev > F.lit(int(gap_us)))
        | F.coalesce(F.lag("_cut").over(order), F.lit(False))
    )
    return runs.withColumns({"_prev_last": prev, "_starts": starts}).withColumns({
        "_start_ts": F.last(F.when(F.col("_starts"), F.col("_run_ts")), True).over(upto),
        "_start_seq": F.last(F.when(F.col("_starts"), F.col("_run_seq")), True).over(upto),
    })


def assign_sessions(df: DataFrame, keys: list[str], ts: str, seq: str, gap_us: int, slice_us: int | None = None,
                    cut: str | None = None, keep_slice: bool = False) -> DataFrame:
    """Adds `session_ts`, `session_seq`: time and sequence of the first row of the session.

    `keys` must not be null; an empty list sessionises the whole input. With `keep_slice` the
    result keeps `_slice`, by which (with the keys) it is partitioned.
    """
    slice_us = int(slice_us or 6 * gap_us)
    rows = local_runs(df, keys, ts, seq, gap_us, slice_us, cut)
    ident = [*keys, "_slice", "_run_ts", "_run_seq"]
    chained = chain_runs(rows.groupBy(*ident).agg(*run_bounds(ts, cut)), keys, gap_us)
    # only the first run of a slice can continue an earlier one, so (key, slice) is unique here
    # and the rows keep the partitioning of the window above
    moved = chained.where(~F.col("_starts")).select(
        *keys, "_slice", F.col("_run_ts").alias("_m_ts"), F.col("_run_seq").alias("_m_seq"), "_start_ts", "_start_seq"
    )
    joined = rows.join(moved, [*keys, "_slice"], "left")
    same = (F.col("_m_ts") == F.col("_run_ts")) & (F.col("_m_seq") == F.col("_run_seq"))
    return joined.withColumns({
        "session_ts": F.when(same, F.col("_start_ts")).otherwise(F.col("_run_ts")),
        "session_seq": F.when(same, F.col("_start_seq")).otherwise(F.col("_run_seq")),
    }).drop("_prev", "_head", "_tail", "_run_ts", "_run_seq", "_m_ts", "_m_seq", "_start_ts", "_start_seq",
            *([] if keep_slice else ["_slice"]))

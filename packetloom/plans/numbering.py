"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from packetloom.session import materialise


def ranged(df: DataFrame, keys: list[str], order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `_chunk`, the number of a range of (keys, order, ties). The ranges' edges are sampled, so they hold about as
    many rows each, whatever bursts or strays the order has. Stored, as a second sample could have other edges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *keys, order, *ties).withColumn("_chunk", F.spark_partition_id()), "ranged")


def number_rows(df: DataFrame, keys: list[str], order: str, out: str = "row_number", ties: tuple[str, ...] = (),
                chunks: int = 4096, bounds: tuple[int, int] | None = None, keep_upto: str | None = None) -> DataFrame:
    """1-based position of each row in its group by the column `order`, then `ties`.

    Rows are ranked inside (group, chunk of the order) and the counts of earlier chunks are added, so a group is spread over
    many tasks. Chunks are sampled ranges. With `bounds`, for a whole-number order known to be spread evenly over them (a
    hash), they are `chunks` equal parts. With `keep_upto` (a column), rows that cannot be within that position are dropped
    before ranking. Keys must not be null.
    """
    if bounds is None:
        rows = ranged(df, keys, order, ties)
    else:
        lo, hi = F.lit(int(bounds[0])).cast("long"), F.lit(int(bounds[1])).cast("long")
        # double arithmetic is monotone, so chunk order always agrees with value order
        span = (hi - lo).cast("double") + F.lit(1.0)
        rows = df.withColumn("_chunk", F.floor((F.col(order).cast("long") - lo).cast("double") / span * F.lit(float(chunks))).cast("int"))
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    # only groups that reach beyond one chunk have an offset, which keeps this table small
    offsets = sizes.select(*keys, "_chunk", F.sum("_n").over(earlier).alias("_offset")).where("_offset > 0")
    rows = rows.join(offsets, [*keys, "_chunk"], "left").withColumn("_offset", F.coalesce("_offset", F.lit(0)))
    if keep_upto:
        rows = rows.where(F.col("_offset") < F.col(keep_upto))
    inside = W.partitionBy(*keys, "_chunk").orderBy(order, *ties)
    rows = rows.withColumn(out, F.col("_offset") + F.row_number().over(inside)).drop("_chunk", "_offset")
    return rows.where(F.col(out) <= F.col(keep_upto)) if keep_upto else rows

"""Window analytics from a rollup: partial states per minute that are merged for any window.

A rollup is two tables. `cells` holds counts and sums per minute of creation, minute of the event, attack type, severity,
protocol and status; `sketches` holds per minute and kind (attack or not) the distribution of confidence (KLL) and the
addresses seen (HLL). Both are partitioned by day and batch: a batch that is run again replaces its own partitions, so a
stream may extend the rollup through foreachBatch. A window reads the days it touches and merges; only the minute that its
start cuts is read from the alerts themselves. Counts and means are those of the direct operators. Quantiles are within
RANK_ERROR of the wanted rank, distinct addresses within about DISTINCT_ERROR.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.functions import values as V
from packetloom.functions.scoring import LEVELS
from packetloom.operators.reports import share
from packetloom.operators.soc import (
    BUCKETS, LOW_CONFIDENCE, PERCENTILES, PROTOCOLS, WINDOW_MINUTES, _is_attack, _name, headline, monitored,
)

#: Settings of the sketches, and the errors that go with them (99 % of the time; 3 standard errors).
KLL_K, HLL_LOG_K = 400, 14
RANK_ERROR, DISTINCT_ERROR = 0.008, 0.025

KEYS = ["minute", "event_minute", "attack_type", "severity", "protocol", "status"]
_SCHEMAS = {
    "cells": "minute timestamp, event_minute timestamp, attack_type string, severity string, protocol string, status string, "
             "alerts long, confidences long, confidence double, low long, newest timestamp, day date, batch string",
    "sketches": "minute timestamp, attack boolean, confidence binary, sources binary, destinations binary, day date, batch string",
}
_SUMS = ["alerts", "confidences", "confidence", "low"]


def _minute(c: str) -> Column:
    return F.date_trunc("minute", F.col(c).cast("timestamp"))


def cells(alerts: DataFrame, weight: int = 1) -> DataFrame:
    """Counts and sums of alerts per cell; weight -1 takes them back. Alerts without a time of creation belong to no window."""
    protocol = F.upper(F.coalesce(F.nullif("protocol", F.lit("")), F.lit("OTHER")))
    c = V.to_double("confidence")
    return alerts.where(F.col("created_at").isNotNull()).groupBy(
        _minute("created_at").alias("minute"), _minute("event_time").alias("event_minute"), "attack_type",
        F.upper("severity").alias("severity"), F.when(protocol.isin(*PROTOCOLS), protocol).otherwise("OTHER").alias("protocol"),
        F.upper("status").alias("status"),
    ).agg(
        (F.count("*") * weight).alias("alerts"), (F.count(c) * weight).alias("confidences"),
        (F.coalesce(F.sum(c), F.lit(0.0)) * weight).alias("confidence"),
        (F.count_if(F.coalesce(c, F.lit(0.0)) < LOW_CONFIDENCE) * weight).alias("low"),
        F.max(F.col("created_at").cast("timestamp")).alias("newest"),
    )


def sketches(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("created_at").isNotNull()).groupBy(
        _minute("created_at").alias("minute"), F.coalesce(_is_attack(), F.lit(False)).alias("attack"),
    ).agg(
        F.kll_sketch_agg_double(F.coalesce(V.to_double("confidence"), F.lit(0.0)), KLL_K).alias("confidence"),
        F.hll_sketch_agg(F.coalesce("source_ip", F.lit("")), HLL_LOG_K).alias("sources"),
        F.hll_sketch_agg(F.coalesce("destination_ip", F.lit("")), HLL_LOG_K).alias("destinations"),
    )


def merge_cells(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("newest").alias("newest")).where("alerts <> 0")


def merge_sketches(parts: DataFrame, *keys: str | Column) -> DataFrame:
    return parts.groupBy(*keys).agg(
        F.kll_merge_agg_double("confidence", KLL_K).alias("confidence"),
        F.hll_union_agg("sources").alias("sources"), F.hll_union_agg("destinations").alias("destinations"),
    )


class Rollup:
    """The rollup stored below a path of a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, df: DataFrame, name: str, batch: str) -> None:
        stamped = df.withColumns({"day": F.to_date("minute"), "batch": F.lit(str(batch))})
        # Days together (a large one in several files), minutes in order: footers' ranges skip what a window does not touch.
        stamped = stamped.hint("rebalance", "day").sortWithinPartitions("day", "minute")
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(
            os.path.join(self.path, name))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(os.path.join(self.path, name))

    def extend(self, alerts: DataFrame, batch: str) -> None:
        """Adds a batch of new alerts; the same batch given again replaces what it wrote."""
        self._write(cells(alerts), "cells", batch)
        self._write(sketches(alerts), "sketches", batch)

    def restate(self, before: DataFrame, after: DataFrame, batch: str) -> None:
        """Moves alerts between cells after a change of status or severity; their sketches do not change."""
        self._write(merge_cells(cells(before, -1).unionByName(cells(after))), "cells", batch)

    def compact(self, path: str) -> Rollup:
        """The same rollup with the batches of a day merged, below another path."""
        out = Rollup(self.spark, path)
        out._write(merge_cells(self._read("cells")), "cells", "merged")
        out._write(merge_sketches(self._read("sketches"), "minute", "attack"), "sketches", "merged")
        return out

    def newest(self):
        """Microseconds of the newest creation, None while the rollup is empty."""
        return self._read("cells").agg(F.unix_micros(F.max("newest"))).first()[0]

    def window(self, alerts: DataFrame, window: str = "24h", as_of=None) -> Window:
        """The states of a window. `alerts` are the rolled-up alerts, of which only the minute of the start is read."""
        end = self.newest() if as_of is None else self.spark.range(1).select(F.unix_micros(F.lit(as_of).cast("timestamp"))).first()[0]
        length = WINDOW_MINUTES.get(_name(window))
        kept, drawn = self._read("cells"), self._read("sketches")
        if length is not None and end is not None:
            start = end - length * 60_000_000
            whole = -(-start // 60_000_000) * 60_000_000
            begin, first = F.timestamp_micros(F.lit(start)), F.timestamp_micros(F.lit(whole))
            later = (F.col("day") >= F.to_date(first)) & (F.col("minute") >= first)
            kept, drawn = kept.where(later), drawn.where(later)
            if whole > start:
                cut = alerts.where((F.col("created_at").cast("timestamp") >= begin) & (F.col("created_at").cast("timestamp") < first))
                kept, drawn = (have.select(*new.columns).unionByName(new) for have, new in ((kept, cells(cut)), (drawn, sketches(cut))))
        stamp = F.lit(None).cast("timestamp") if end is None else F.timestamp_micros(F.lit(end))
        return Window(window, stamp, kept, drawn)


class Window:
    """Answers over one window, from its merged states."""

    def __init__(self, name: str, as_of: Column, parts: DataFrame, drawn: DataFrame):
        self.name, self.as_of, self.cells, self.sketches = name, as_of, parts, drawn

    @staticmethod
    def _count(condition: Column | None = None) -> Column:
        counted = F.col("alerts") if condition is None else F.when(condition, F.col("alerts"))
        return F.coalesce(F.sum(counted), F.lit(0))

    @staticmethod
    def _mean(condition: Column | None = None, over: str = "confidences") -> Column:
        pick = (lambda c: F.col(c)) if condition is None else (lambda c: F.when(condition, F.col(c)))
        return F.try_divide(F.sum(pick("confidence")), F.sum(pick(over)))

    def soc_summary(self, incidents: DataFrame) -> DataFrame:
        facts = self.cells.agg(
            self._count().alias("total_alerts"), self._count(F.col("status") == "NEW").alias("active_alerts"),
            *[self._count(F.col("severity") == s).alias(f"{s.lower()}_alerts") for s in LEVELS],
            self._count(_is_attack()).alias("_attacks"), F.round(self._mean(_is_attack()), 4).alias("mean_confidence"))
        return headline(facts, incidents, self.name, self.as_of)

    def _fixed(self, key: str, names: tuple[str, ...]) -> DataFrame:
        wide = self.cells.agg(*[self._count(F.col(key) == n).alias(n) for n in names], self._count().alias("_all"))
        pairs = F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias("count")) for n in names])
        return wide.select("_all", F.inline(pairs))

    def severity_distribution(self) -> DataFrame:
        return self._fixed("severity", LEVELS).drop("_all")

    def protocol_distribution(self) -> DataFrame:
        return self._fixed("protocol", PROTOCOLS).select("protocol", "count", F.round(V.ratio(F.col("count"), F.col("_all")), 4).alias("fraction"))

    def attack_distribution(self) -> DataFrame:
        out = self.cells.groupBy("attack_type").agg(self._count().alias("count"), F.round(self._mean(), 4).alias("mean_confidence"))
        return out.where("count <> 0").withColumn("fraction", share("count", 4, 1.0)).orderBy(F.desc("count"), "attack_type")

    def activity_trends(self) -> DataFrame:
        unit = BUCKETS.get(_name(self.name), "day")
        return self.cells.where(F.col("event_minute").isNotNull()).groupBy(F.date_trunc(unit, "event_minute").alias("bucket")).agg(
            self._count().alias("total_alerts"), *[self._count(F.col("severity") == s).alias(s.lower()) for s in LEVELS],
            self._count(_is_attack()).alias("attack_alerts")).where("total_alerts <> 0").orderBy("bucket")

    def model_monitor(self) -> DataFrame:
        """The percentiles come from the merged sketch, all else is exact."""
        attack = _is_attack()
        kinds = self.cells.where(attack).groupBy("attack_type").agg(self._count().alias("count")).where("count <> 0")
        dist = kinds.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "attack_type", "count"))).alias("d"))
        sketch = merge_sketches(self.sketches).select("confidence")
        facts = self.cells.agg(
            self._count().alias("n"), self._count(attack).alias("attacks"), self._mean(over="alerts").alias("mean"),
            F.coalesce(F.sum("low"), F.lit(0)).alias("low"), self._mean(attack, over="alerts").alias("mean2"))
        return monitored(facts.withColumns({
            "p": F.kll_sketch_get_quantile_double(sketch.scalar(), F.array(*map(F.lit, PERCENTILES.values()))),
            "d": dist.scalar(), "minutes": self._minutes()}), self.name)

    def _minutes(self) -> Column:
        length = WINDOW_MINUTES.get(_name(self.name))
        return F.greatest(F.lit(1.0), F.unix_micros(self.as_of) / F.lit(60_000_000.0) if length is None else F.lit(float(length)))

    def distinct_addresses(self) -> DataFrame:
        """About how many source and destination addresses the window has; alerts without one count as one address."""
        return merge_sketches(self.sketches).select(
            F.hll_sketch_estimate("sources").alias("sources"), F.hll_sketch_estimate("destinations").alias("destinations"))

"""Time-window analytics over alerts and incidents, and model monitoring.

`as_of` defaults to the newest `created_at`; wall-clock time is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from packetloom.functions import values as V
from packetloom.functions.scoring import LEVELS
from packetloom.operators.alerts import ALERT_STATES
from packetloom.operators.reports import share
from packetloom.plans.quantiles import LIMIT, percentile_array

# Window names in minutes, bucket of each window, monitor baseline and limits.
WINDOW_MINUTES = {"15m": 15, "1h": 60, "24h": 1440, "7d": 10080}
BUCKETS = {"15m": "minute", "1h": "minute", "24h": "hour"}
BASELINE_CONFIDENCE, BASELINE_ATTACK_RATE = 0.945, 0.312
CONFIDENCE_SHIFT_LIMIT, ATTACK_RATE_SHIFT_LIMIT = 0.15, 0.25
LOW_CONFIDENCE = 0.60
PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
PROTOCOLS = ("TCP", "UDP", "ICMP", "OTHER")
OPEN_STATES = ("NEW", "INVESTIGATING", "ESCALATED")


def _name(window: str) -> str:
    key = str(window).strip().lower()
    return key if key in WINDOW_MINUTES else "all"


def as_of_time(df: DataFrame, as_of=None, at: str = "created_at") -> Column:
    if as_of is not None:
        return F.lit(as_of).cast("timestamp")
    return df.agg(F.max(F.col(at).cast("timestamp"))).scalar()


def window_cutoff(window: str, as_of: Column) -> tuple[Column, Column]:
    """Start of the window and its length in minutes; unknown names mean all time."""
    minutes = WINDOW_MINUTES.get(_name(window))
    if minutes is None:
        epoch = F.timestamp_micros(F.lit(0))
        return epoch, F.unix_micros(as_of) / F.lit(60_000_000.0)
    return F.timestamp_micros(F.unix_micros(as_of) - F.lit(minutes * 60_000_000)), F.lit(float(minutes))


def in_window(df: DataFrame, window: str = "24h", as_of=None, at: str = "created_at") -> DataFrame:
    if _name(window) == "all":
        return df.where(F.col(at).isNotNull())
    cutoff, _ = window_cutoff(window, as_of_time(df, as_of, at))
    return df.where(F.col(at).cast("timestamp") >= cutoff)


def _minutes(df: DataFrame, window: str, as_of) -> Column:
    _, minutes = window_cutoff(window, as_of_time(df, as_of))
    return F.greatest(F.lit(1.0), minutes)


def _is_attack() -> Column:
    return F.upper("attack_type") != "BENIGN"


def _levels(prefix: str = "", suffix: str = "_alerts") -> list[Column]:
    level = F.upper("severity")
    return [F.count_if(level == s).alias(f"{prefix}{s.lower()}{suffix}") for s in LEVELS]


def _time_to_resolve() -> Column:
    seconds = F.abs(F.unix_micros(F.col("updated_at").cast("timestamp"))
                    - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 1e6
    return F.round(F.avg(F.when(F.upper("status") == "RESOLVED", seconds)), 1)


def soc_summary(alerts: DataFrame, incidents: DataFrame, window: str = "24h", as_of=None) -> DataFrame:
    """Headline numbers of the window in one row."""
    facts = in_window(alerts, window, as_of).agg(
        F.count("*").alias("total_alerts"),
        F.count_if(F.col("status") == "NEW").alias("active_alerts"),
        *_levels(),
        F.count_if(_is_attack()).alias("_attacks"),
        F.round(F.avg(F.when(_is_attack(), F.col("confidence"))), 4).alias("mean_confidence"),
    )
    return headline(facts, incidents, window, as_of_time(alerts, as_of))


def headline(facts: DataFrame, incidents: DataFrame, window: str, stamp: Column) -> DataFrame:
    """The summary of a window's alert counts (one row) and its incidents."""
    status = F.upper("status")
    cases = incidents.where(F.col("created_at").isNotNull()) if _name(window) == "all" else \
        incidents.where(F.col("created_at").cast("timestamp") >= window_cutoff(window, stamp)[0])
    cases = cases.agg(F.struct(
        F.count_if(status.isin(*OPEN_STATES)).alias("open"), F.count_if(status == "RESOLVED").alias("resolved"),
        _time_to_resolve().alias("mttr"),
    ).alias("c")).scalar()
    minutes = F.greatest(F.lit(1.0), window_cutoff(window, stamp)[1])
    facts = facts.withColumns({"_c": cases, "_minutes": minutes})
    both = F.col("_c.open") + F.col("_c.resolved")
    total = F.col("total_alerts")
    return facts.select(
        F.lit(window).alias("window"), "total_alerts", "active_alerts", *[f"{s.lower()}_alerts" for s in LEVELS],
        F.col("_c.open").alias("open_incidents"), F.col("_c.resolved").alias("resolved_incidents"),
        "mean_confidence",
        F.round(total / F.col("_minutes"), 2).alias("alert_rate_per_min"),
        F.round(both / F.col("_minutes"), 2).alias("incident_rate_per_min"),
        F.round(F.try_divide(total, both), 2).alias("alert_to_incident_ratio"),
        F.round(V.ratio(F.col("_attacks"), total), 4).alias("attack_rate"),
        F.col("_c.mttr").alias("mttr_seconds"),
    )


def incident_analytics(incidents: DataFrame, window: str = "24h", as_of=None) -> DataFrame:
    status, level = F.upper("status"), F.upper("severity")
    return in_window(incidents, window, as_of).agg(
        F.count("*").alias("total_incidents"),
        F.count_if(status == "NEW").alias("open_incidents"),
        F.count_if(status == "INVESTIGATING").alias("investigating_incidents"),
        F.count_if(status == "ESCALATED").alias("escalated_incidents"),
        F.count_if(status == "RESOLVED").alias("resolved_incidents"),
        *[F.count_if(level == s).alias(f"{s.lower()}_incidents") for s in LEVELS],
        F.round(F.coalesce(F.avg(F.coalesce("alert_count", F.lit(0))), F.lit(0.0)), 1).alias("avg_alerts_per_incident"),
        _time_to_resolve().alias("mttr_seconds"),
    )


def activity_trends(alerts: DataFrame, window: str = "24h", as_of=None, ts: str = "event_time") -> DataFrame:
    """Counts per time bucket; rows without a time are dropped, empty buckets are absent."""
    unit = BUCKETS.get(_name(window), "day")
    return (
        in_window(alerts, window, as_of).where(F.col(ts).isNotNull())
        .groupBy(F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("bucket"))
        .agg(F.count("*").alias("total_alerts"), *_levels(suffix=""), F.count_if(_is_attack()).alias("attack_alerts"))
        .orderBy("bucket")
    )


def activity_per_minute(alerts: DataFrame, ts: str = "event_time") -> DataFrame:
    return (
        alerts.where(F.col(ts).isNotNull())
        .groupBy(F.date_trunc("minute", F.col(ts).cast("timestamp")).alias("minute"))
        .agg(F.count("*").alias("alert_count")).orderBy("minute")
    )


def attack_distribution(alerts: DataFrame, window: str = "24h", as_of=None) -> DataFrame:
    out = in_window(alerts, window, as_of).groupBy("attack_type").agg(
        F.count("*").alias("count"), F.round(F.avg("confidence"), 4).alias("mean_confidence")
    )
    return out.withColumn("fraction", share("count", 4, 1.0)).orderBy(F.desc("count"), "attack_type")


def _fixed(df: DataFrame, key: Column, names: tuple[str, ...], label: str) -> DataFrame:
    """Count per fixed name, zeros included, from one global aggregate."""
    wide = df.agg(*[F.count_if(key == n).alias(n) for n in names], F.count("*").alias("_all"))
    pairs = F.array(*[F.struct(F.lit(n).alias(label), F.col(f"`{n}`").alias("count")) for n in names])
    return wide.select("_all", F.inline(pairs))


def severity_distribution(alerts: DataFrame, window: str = "24h", as_of=None) -> DataFrame:
    return _fixed(in_window(alerts, window, as_of), F.upper("severity"), LEVELS, "severity").drop("_all")


def status_counts(alerts: DataFrame) -> DataFrame:
    """The four workflow states, always present, and whether they count as active."""
    out = _fixed(alerts, F.upper("status"), ALERT_STATES, "status").drop("_all")
    return out.withColumn("active", F.col("status").isin(*OPEN_STATES))


def protocol_distribution(alerts: DataFrame, window: str = "24h", as_of=None) -> DataFrame:
    name = F.upper(F.coalesce(F.nullif("protocol", F.lit("")), F.lit("OTHER")))
    folded = F.when(name.isin(*PROTOCOLS[:3]), name).otherwise("OTHER")
    out = _fixed(in_window(alerts, window, as_of), folded, PROTOCOLS, "protocol")
    return out.select("protocol", "count", F.round(V.ratio(F.col("count"), F.col("_all")), 4).alias("fraction"))


def top_entities(alerts: DataFrame, k: int = 10, window: str = "24h", as_of=None, ts: str = "event_time") -> DataFrame:
    """Top sources, destinations and ports by alerts.

    The rank filter lets Spark keep k rows per kind on each task before the shuffle.
    """
    port = F.col("destination_port").cast("string")
    entity = F.array(*[
        F.struct(F.lit(kind).alias("kind"), c.alias("entity"))
        for kind, c in (("source", F.col("source_ip")), ("destination", F.col("destination_ip")), ("port", port))
    ])
    stats = (
        in_window(alerts, window, as_of)
        .select(F.inline(entity), F.upper("severity").alias("_s"), F.col(ts).cast("timestamp").alias("_t"))
        .where("entity IS NOT NULL AND entity <> ''")
        .groupBy("kind", "entity")
        .agg(F.count("*").alias("alert_count"), F.count_if(F.col("_s") == "CRITICAL").alias("critical_count"),
             F.min("_t").alias("first_seen"), F.max("_t").alias("last_seen"))
    )
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("alert_count"), "entity"))
    return stats.withColumn("rank", rank).where(F.col("rank") <= k)


def alert_metrics(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("total_alerts"), *_levels(),
        F.coalesce(F.avg(V.to_double("confidence")), F.lit(0.0)).alias("average_confidence"),
        F.count_distinct("attack_type").alias("attack_types"),
    )


def count_by(alerts: DataFrame, column: str) -> DataFrame:
    return alerts.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def model_monitor(alerts: DataFrame, window: str = "24h", as_of=None) -> DataFrame:
    """Volume, rates, confidence percentiles and shift against the validation baseline, one row."""
    conf = F.coalesce(V.to_double("confidence"), F.lit(0.0))
    # once, instead of in every part of the plan
    newest, total = alerts.agg(F.max(F.col("created_at").cast("timestamp")), F.count("*")).first()
    as_of = newest if as_of is None else as_of
    rows = in_window(alerts, window, as_of).select("attack_type", conf.alias("c"))
    attack = _is_attack()
    kinds = rows.where(attack).groupBy("attack_type").agg(F.count("*").alias("count"))
    facts = rows.agg(
        F.count("*").alias("n"), F.count_if(attack).alias("attacks"), F.avg("c").alias("mean"),
        F.count_if(F.col("c") < LOW_CONFIDENCE).alias("low"), F.avg(F.when(attack, F.col("c"))).alias("mean2"),
        percentile_array(rows, "c", list(PERCENTILES.values()), total if total <= LIMIT else rows.count()).alias("p"),
    )
    dist = kinds.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "attack_type", "count")))
                     .alias("d")).scalar()
    facts = facts.withColumns({"d": dist, "minutes": _minutes(alerts, window, as_of)})
    return monitored(facts, window)


def monitored(facts: DataFrame, window: str) -> DataFrame:
    """Rates, shifts and status of a window's facts: n, attacks, mean, low, mean2, percentiles p, kinds d, minutes (one row)."""
    n = F.col("n")
    out = facts.select(
        F.lit(window).alias("window"),
        n.alias("inference_volume"),
        F.round(n / F.col("minutes"), 2).alias("prediction_throughput_per_min"),
        F.round(V.ratio(F.col("attacks"), n), 4).alias("attack_rate"),
        F.round(V.ratio(n - F.col("attacks"), n), 4).alias("benign_rate"),
        F.round("mean", 4).alias("mean_confidence"),
        F.col("low").alias("low_confidence_count"),
        *[F.round(F.col("p")[k], 4).alias(name) for k, name in enumerate(PERCENTILES)],
        F.col("attacks").alias("classification_volume"),
        F.round("mean2", 4).alias("classification_mean_confidence"),
        F.transform(F.coalesce("d", F.array()), lambda x: x.dropFields("o")).alias("attack_type_distribution"),
    )
    out = out.withColumns({
        "confidence_shift": F.round(F.col("mean_confidence") - BASELINE_CONFIDENCE, 4),
        "attack_rate_shift": F.when(F.col("inference_volume") > 0, F.round(F.col("attack_rate") - BASELINE_ATTACK_RATE, 4)),
    })
    return out.withColumn(
        "status",
        F.when(F.abs("confidence_shift") > CONFIDENCE_SHIFT_LIMIT, "CONFIDENCE_SHIFT_DETECTED")
        .when(F.abs("attack_rate_shift") > ATTACK_RATE_SHIFT_LIMIT, "ATTACK_RATE_SHIFT_DETECTED")
        .otherwise("NORMAL"),
    )


def batch_scorecard(scored: DataFrame, truth: str = "gt_is_attack", batch: str | None = None) -> DataFrame:
    """Counts of a scored batch: truth, verdicts, alerts stored, severities, attack confidence."""
    hit = F.col("is_attack")
    level = F.upper("severity")
    stored = F.count_if(F.col("inserted")) if "inserted" in scored.columns else F.lit(0).cast("long")
    groups = [batch] if batch else []
    return scored.groupBy(*groups).agg(
        F.count("*").alias("total_flows"),
        F.count_if(F.col(truth)).alias("gt_attack_count"), F.count_if(~F.col(truth)).alias("gt_benign_count"),
        F.count_if(hit).alias("attack_count"), F.count_if(~hit).alias("benign_count"),
        stored.alias("alerts_inserted"),
        *[F.count_if(hit & (level == s)).alias(s.lower()) for s in LEVELS],
        F.coalesce(F.avg(F.when(hit, F.col("confidence"))), F.lit(0.0)).alias("average_confidence"),
    )


def stream_telemetry(batches: DataFrame, seconds: Column | float | None = None) -> DataFrame:
    """Running totals over batch scorecards; confidence is weighted by attacks."""
    spent = F.lit(None).cast("double") if seconds is None else (F.lit(seconds) if isinstance(seconds, (int, float)) else seconds)
    total = F.sum("total_flows")
    out = batches.agg(
        F.coalesce(total, F.lit(0)).alias("flows_processed"),
        F.coalesce(F.sum("gt_attack_count"), F.lit(0)).alias("ground_truth_attacks"),
        F.coalesce(F.sum("gt_benign_count"), F.lit(0)).alias("ground_truth_benign"),
        F.round(F.coalesce(F.try_divide(F.sum("gt_attack_count") * 100.0, total), F.lit(0.0)), 2)
        .alias("ground_truth_attack_rate_percent"),
        F.coalesce(F.sum("attack_count"), F.lit(0)).alias("predicted_attacks"),
        F.coalesce(F.sum("benign_count"), F.lit(0)).alias("predicted_benign"),
        F.round(F.coalesce(F.try_divide(F.sum("attack_count") * 100.0, total), F.lit(0.0)), 2)
        .alias("predicted_attack_rate_percent"),
        F.coalesce(F.sum("alerts_inserted"), F.lit(0)).alias("alerts_generated"),
        *[F.coalesce(F.sum(s.lower()), F.lit(0)).alias(f"{s.lower()}_alerts") for s in LEVELS],
        F.round(F.coalesce(F.try_divide(F.sum(F.col("average_confidence") * F.col("attack_count")) * 100,
                                        F.sum("attack_count").cast("double")), F.lit(0.0)), 2)
        .alias("average_confidence_percent"),
    )
    return out.withColumn("throughput", F.round(F.try_divide(F.col("flows_processed").cast("double"), spent), 2))

"""Threat reports, profiling and dataset facts over flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from packetloom.functions import values as V


def share(count: str, digits: int, scale: float = 100.0) -> Column:
    """Share of a group's count in the total of the grouped result.

    Only for rows already grouped by a small domain (labels, ports, hours): the window over
    the whole result runs in one task.
    """
    return F.round(F.col(count) * scale / F.sum(count).over(W.partitionBy()), digits)


def _mean(c: str | Column, digits: int = 2) -> Column:
    return F.round(F.avg(c), digits)


def _attacks(df: DataFrame) -> DataFrame:
    return df.where("IsAttack = 1")


def attack_overview(df: DataFrame) -> DataFrame:
    out = df.groupBy("Label", "IsAttack").agg(F.count("*").alias("Flow_Count"))
    return out.withColumn("Percentage", share("Flow_Count", 4)).orderBy(F.desc("Flow_Count"), "Label")


def attack_timeline(df: DataFrame) -> DataFrame:
    return (
        _attacks(df)
        .groupBy(F.to_date("Timestamp").alias("Attack_Date"), "Hour", "Label")
        .agg(F.count("*").alias("Attack_Count"))
        .orderBy("Attack_Date", "Hour", F.desc("Attack_Count"), "Label")
    )


def targeted_ports(df: DataFrame, limit: int = 20) -> DataFrame:
    """Most attacked ports; shares are of all attacks. At most 65,536 groups exist."""
    out = _attacks(df).groupBy("Dst_Port").agg(
        F.count("*").alias("Attack_Count"),
        F.count_distinct("Label").alias("Attack_Types"),
        _mean("Flow_Duration").alias("Avg_Flow_Duration"),
    )
    return (
        out.withColumn("Attack_Share_Percent", share("Attack_Count", 2))
        .orderBy(F.desc("Attack_Count"), "Dst_Port")
        .limit(limit)
    )


def _averages(*extra: Column) -> list[Column]:
    return [
        F.count("*").alias("Flow_Count"),
        _mean("Flow_Duration").alias("Avg_Flow_Duration"),
        _mean("Tot_Fwd_Pkts").alias("Avg_Fwd_Packets"),
        _mean("Tot_Bwd_Pkts").alias("Avg_Bwd_Packets"),
        _mean("TotLen_Fwd_Pkts").alias("Avg_Fwd_Bytes"),
        _mean("TotLen_Bwd_Pkts").alias("Avg_Bwd_Bytes"),
        *extra,
    ]


def protocol_intelligence(df: DataFrame) -> DataFrame:
    return (
        _attacks(df).groupBy("Protocol", "Label").agg(*_averages())
        .orderBy(F.desc("Flow_Count"), "Protocol", "Label")
    )


def traffic_characteristics(df: DataFrame) -> DataFrame:
    rates = [
        _mean(V.finite("Flow_Byts_per_s")).alias("Avg_Bytes_Per_Second"),
        _mean(V.finite("Flow_Pkts_per_s")).alias("Avg_Packets_Per_Second"),
    ]
    return df.groupBy("Label").agg(*_averages(*rates)).orderBy(F.desc("Flow_Count"), "Label")


def hourly_concentration(df: DataFrame) -> DataFrame:
    out = _attacks(df).groupBy("Hour").agg(
        F.count("*").alias("Attack_Count"), F.count_distinct("Label").alias("Attack_Types")
    )
    return out.withColumn("Attack_Share_Percent", share("Attack_Count", 2)).orderBy(F.desc("Attack_Count"), "Hour")


def executive_summary(df: DataFrame) -> DataFrame:
    """Totals in one row.

    The distinct counts run over a first aggregation by (port, protocol, label), whose size is
    bounded by those domains, instead of expanding every input row once per distinct column.
    """
    cells = df.groupBy("Dst_Port", "Protocol", "Label", "IsAttack").agg(F.count("*").alias("n"))
    attack = F.col("IsAttack") == 1
    total = F.coalesce(F.sum("n"), F.lit(0))
    attacks = F.coalesce(F.sum(F.when(attack, F.col("n"))), F.lit(0))
    return cells.agg(
        total.alias("Total_Flows"),
        attacks.alias("Attack_Flows"),
        F.coalesce(F.sum(F.when(F.col("IsAttack") == 0, F.col("n"))), F.lit(0)).alias("Benign_Flows"),
        F.round(F.try_divide(attacks * 100.0, total), 4).alias("Attack_Rate_Percent"),
        F.count_distinct(F.when(attack, F.col("Dst_Port"))).alias("Unique_Attack_Targeted_Ports"),
        F.count_distinct("Protocol").alias("Protocols_Observed"),
        F.count_distinct(F.when(attack, F.col("Label"))).alias("Attack_Types"),
    )


def label_distribution(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("count")).orderBy(F.desc("count"), label)


def rows_by_source(df: DataFrame, source: str = "source_file") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("count")).orderBy(F.desc("count"), source)


def distinct_labels(df: DataFrame, label: str = "Label", approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(label) if approximate else F.count_distinct(label)
    return df.agg(count.alias("distinct_labels"))


def _long(df: DataFrame, counts: dict[str, Column], value: str) -> DataFrame:
    """All counts in one pass, then one row per column."""
    wide = df.agg(*[c.alias(k) for k, c in counts.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"`{k}`").alias(value)) for k in counts])
    return wide.select(F.inline(pairs))


def null_counts(df: DataFrame) -> DataFrame:
    return _long(df, {c: F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns}, "null_count")


def inf_counts(df: DataFrame) -> DataFrame:
    cols = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return _long(df, {c: F.count_if(F.col(f"`{c}`").isin(V.INF, -V.INF)) for c in cols}, "inf_count")


def schema_profile(df: DataFrame) -> DataFrame:
    """Row count, column count and the type of each column."""
    total = len(df.columns)
    kinds = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("type"))
        for i, f in enumerate(df.schema)
    ])
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(total).alias("columns"), F.inline(kinds)
    )


def dataset_scale(splits: dict[str, DataFrame], label: str = "attack_label") -> DataFrame:
    """One row: flows per split, class distribution, attack rate, top attack class."""
    tagged = None
    for name, df in splits.items():
        part = df.groupBy(F.col(label).alias("class_name")).agg(F.count("*").alias("n")).withColumn("split", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    classes = tagged.groupBy("class_name").agg(
        F.sum("n").alias("count"),
        *[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"_{s}") for s in splits],
    ).withColumn("percentage", share("count", 4, 1.0))
    attack = F.col("class_name") != "Benign"
    total, attacks = F.sum("count"), F.sum(F.when(attack, F.col("count")).otherwise(0))
    return classes.agg(
        total.alias("total_flows"),
        *[F.sum(f"_{s}").alias(f"{s}_flows") for s in splits],
        F.sum(F.when(~attack, F.col("count")).otherwise(0)).alias("benign_count"),
        attacks.alias("attack_count"),
        F.round(attacks / total, 4).alias("attack_rate"),
        F.max_by(F.when(attack, F.col("class_name")), F.when(attack, F.col("count"))).alias("top_attack_class"),
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("_o"), "class_name", "count", "percentage")))
        .alias("_d"),
    ).withColumn("class_distribution", F.transform("_d", lambda x: x.dropFields("_o"))).drop("_d")

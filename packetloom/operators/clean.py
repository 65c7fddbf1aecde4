"""Cleaning, typing and feature columns of flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from packetloom.functions import values as V
from packetloom.schemas import (
    DETECTOR_FEATURES, NETWORK_FEATURES, RAW_COLUMNS, TEMPORAL_FEATURES, TRUTH_COLUMNS, feature_name,
)

REQUIRED_COLUMNS = ("Dst Port", "Protocol", "Timestamp", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "Label")


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[feature_name(c) for c in df.columns])


def rename_features(df: DataFrame) -> DataFrame:
    """Raw header spellings to feature names; other columns stay."""
    return df.withColumnsRenamed({c: feature_name(c) for c in RAW_COLUMNS})


def drop_header_artifacts(df: DataFrame, label: str = "Label", observe: str | None = None) -> DataFrame:
    """Removes repeated header lines; `observe` names a metric that counts them in the same pass."""
    artifact = F.coalesce(F.trim(F.col(label)) == label, F.lit(False))
    if observe:
        df = df.observe(observe, F.count_if(artifact).alias("removed"), F.count(F.lit(1)).alias("seen"))
    return df.where(~artifact)


def normalise_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    text = F.trim(F.col(label))
    low = F.lower(text)
    return df.withColumn(label, F.when(low == "benign", "Benign").when(low == "bot", "Bot").otherwise(text))


def assert_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    """Passes rows through and fails the job at the first null or blank label."""
    text = F.trim(F.col(label))
    bad = text.isNull() | (text == "")
    checked = F.when(bad, F.raise_error(F.lit("null or blank label"))).otherwise(F.col(label))
    return df.withColumn(label, checked.cast("string"))


def sanity_check(df: DataFrame, required: tuple[str, ...] = REQUIRED_COLUMNS, label: str = "Label",
                 source: str = "source_file") -> DataFrame:
    """One row: row count, artifacts, blank labels, missing columns and a verdict."""
    have = set(df.columns)
    missing = [c for c in (*required, source) if c not in have]
    text = F.trim(F.col(label)) if label in have else F.lit(None).cast("string")
    facts = df.agg(
        F.count("*").alias("rows"),
        F.count_if(text == label).alias("artifacts"),
        F.count_if(text.isNull() | (text == "")).alias("blank_labels"),
    )
    return facts.withColumns({
        "missing": F.array(*[F.lit(c) for c in missing]).cast("array<string>"),
    }).withColumn("passed", (F.col("artifacts") == 0) & (F.col("blank_labels") == 0) & (F.size("missing") == 0))


def _is_float(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DoubleType, T.FloatType))


def inf_to_null(df: DataFrame) -> DataFrame:
    """±infinity to null in every floating column, in one projection."""
    return df.select(*[
        F.when(~F.col(f"`{f.name}`").isin(V.INF, -V.INF), F.col(f"`{f.name}`")).alias(f.name)
        if _is_float(f) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def sanitise_numeric(df: DataFrame, cols: list[str], fill: float = 0.0) -> DataFrame:
    """Doubles without null, NaN or infinity; a missing column is an error."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    chosen = set(cols)
    return df.select(*[
        V.finite_or(f"`{c}`", fill).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns
    ])


def parse_event_time(df: DataFrame, column: str = "Timestamp", out: str = "Timestamp", multi: bool = False) -> DataFrame:
    parse = V.parse_event_time_multi if multi else V.parse_event_time
    return df.withColumn(out, parse(F.col(column)))


def temporal_features(df: DataFrame, ts: str = "Timestamp", default: int | None = None) -> DataFrame:
    return df.withColumns(V.temporal(ts, default))


def binary_target(df: DataFrame, label: str = "Label", out: str = "IsAttack", kind: str = "int") -> DataFrame:
    return df.withColumn(out, F.when(F.trim(F.col(label)) == "Benign", 0).otherwise(1).cast(kind))


def truth_flag(df: DataFrame, out: str = "gt_is_attack") -> DataFrame:
    """Ground truth from either the binary or the class label."""
    hit = (F.col("stage1_label") == 1.0) | (F.col("attack_label") != "Benign")
    return df.withColumn(out, F.coalesce(hit, F.lit(False)))


def class_target(df: DataFrame, label: str = "Label", out: str = "attack_label") -> DataFrame:
    return df.withColumn(out, F.trim(F.col(label)))


def select_ml_columns(df: DataFrame) -> DataFrame:
    return df.select(*DETECTOR_FEATURES, *TRUTH_COLUMNS)


def ml_table(raw: DataFrame) -> DataFrame:
    """Raw labelled rows to the feature table: names, time parts, targets, finite doubles."""
    df = parse_event_time(rename_features(raw))
    df = temporal_features(df)
    df = class_target(binary_target(df, out="stage1_label", kind="double"))
    return select_ml_columns(sanitise_numeric(df, NETWORK_FEATURES + TEMPORAL_FEATURES))


def strip_ground_truth(df: DataFrame, keep_as: str | None = None) -> DataFrame:
    """Removes label and lineage columns; `keep_as` keeps them in a struct beside the features."""
    present = [c for c in TRUTH_COLUMNS if c in df.columns]
    if keep_as and present:
        df = df.withColumn(keep_as, F.struct(*present))
    return df.drop(*present)


def validate_features(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Adds the missing feature names, the invalid ones of each row and a valid flag."""
    features = features or DETECTOR_FEATURES
    have = [c for c in features if c in df.columns]
    missing = [c for c in features if c not in df.columns]

    def bad(c: str) -> Column:
        x = V.to_double(f"`{c}`")
        return F.when(x.isNull() | F.isnan(x) | x.isin(V.INF, -V.INF), F.lit(c))

    invalid = F.array_compact(F.array(*[bad(c) for c in have])) if have else F.array().cast("array<string>")
    if missing:
        invalid = F.concat(F.array(*[F.lit(c) for c in missing]), invalid)
    return df.withColumns({
        "missing_features": F.array(*[F.lit(c) for c in missing]).cast("array<string>"),
        "invalid_features": invalid,
    }).withColumn("schema_compatible", F.size("invalid_features") == 0)


def route_invalid(df: DataFrame, features: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows fit for scoring, the others with what is wrong with them, and how many rows each feature spoils."""
    checked = validate_features(df, features)
    marks = ("missing_features", "invalid_features", "schema_compatible")
    good = checked.where("schema_compatible").drop(*marks)
    bad = checked.where("NOT schema_compatible").drop("schema_compatible")
    counts = bad.select(F.explode("invalid_features").alias("feature")).groupBy("feature").agg(F.count("*").alias("rows"))
    return good, bad, counts


def default_fields(df: DataFrame, as_of, ts: str = "Timestamp") -> DataFrame:
    """Delivery defaults: missing event time becomes `as_of`, port and protocol become numbers, NaN null. Text that is no
    number stays in `<column>_text`, which is null otherwise."""
    stamp = F.lit(as_of).cast("timestamp")
    out = {ts: F.coalesce(F.col(ts).try_cast("timestamp"), stamp)} if ts in df.columns else {ts: stamp}
    for f in df.schema:
        if f.name in ("Dst_Port", "Protocol"):
            out[f.name] = F.nullif(V.to_double(f.name), F.lit(float("nan")))
            if f.dataType.typeName() == "string":
                out[f"{f.name}_text"] = F.when(out[f.name].isNull(), F.nullif(F.trim(f.name), F.lit("")))
        elif _is_float(f):
            out[f.name] = F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`"))
    return df.withColumns(out)


def distinct_flows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Optional exact de-duplication on a row hash key plus the compared columns."""
    columns = columns or df.columns
    return df.withColumn("_k", F.xxhash64(*columns)).dropDuplicates(["_k", *columns]).drop("_k")



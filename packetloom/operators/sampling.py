"""Splits and samples that give the same rows on every run and every layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.values import hash_32, hash_unit
from packetloom.plans.numbering import number_rows
from packetloom.session import materialise

_HASH_RANGE = (0, 4294967295)


def split_by_hash(df: DataFrame, key: list[str], train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Disjoint and complete split by a hash of the key; no shuffle."""
    u = hash_unit(*key, seed=seed)
    return df.where(u < train), df.where(u >= train)


def split_by_rand(df: DataFrame, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split on one random column. It depends on the partition layout: prefer `split_by_hash`."""
    tagged = df.withColumn("_u", F.rand(seed))
    return tagged.where(F.col("_u") < train).drop("_u"), tagged.where(F.col("_u") >= train).drop("_u")


def random_split(df: DataFrame, train: float = 0.8, seed: int = 42) -> list[DataFrame]:
    return df.randomSplit([train, 1.0 - train], seed=seed)


def class_fractions(df: DataFrame, label: str, target: int, floor: int = 0, truncate: bool = False) -> DataFrame:
    """Sampling fraction per class: min(count, max(floor, count x target / total)) / count."""
    counts = df.groupBy(label).agg(F.count("*").alias("class_count"))
    total = counts.agg(F.sum("class_count")).scalar()
    wanted = F.col("class_count") * F.lit(float(target)) / total
    if truncate:
        wanted = F.floor(wanted).cast("double")
    wanted = F.least(F.col("class_count").cast("double"), F.greatest(F.lit(float(floor)), wanted))
    return counts.withColumn("fraction", F.least(F.lit(1.0), wanted / F.col("class_count")))


def stratified_sample(df: DataFrame, label: str, key: list[str], target: int, floor: int = 0,
                      truncate: bool = False, seed: int = 42) -> DataFrame:
    """Rows kept at their class's fraction.

    The fractions (one row per class) are written first: as a table of known size they are
    broadcast when small, so the rows are filtered where they are scanned.
    """
    fractions = materialise(class_fractions(df, label, target, floor, truncate).select(label, "fraction"), "fractions")
    return df.join(fractions, label).where(hash_unit(*key, seed=seed) < F.col("fraction")).drop("fraction")


def quota_sample(df: DataFrame, group: str | Column, quotas: dict, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly min(quota, size) rows of each group, chosen by seeded hash.

    Ranking is spread over hash ranges; rows beyond the range that completes the quota are
    dropped before they are ranked.
    """
    group = F.col(group) if isinstance(group, str) else group
    quota = None
    for value, n in quotas.items():
        cond = group == F.lit(value)
        quota = F.when(cond, F.lit(int(n))) if quota is None else quota.when(cond, F.lit(int(n)))
    rows = df.withColumns({"_g": group, "_quota": quota, "_h": hash_32(*key, seed=seed)}).where("_quota > 0")
    picked = number_rows(rows, ["_g"], "_h", "_r", ties=tuple(key), bounds=_HASH_RANGE, keep_upto="_quota")
    return picked.drop("_g", "_quota", "_r", "_h")


def balanced_sample(df: DataFrame, n: int, key: list[str], label: str = "stage1_label", seed: int = 42) -> DataFrame:
    """n // 2 benign rows and the rest attacks."""
    return quota_sample(df, F.col(label) == 1, {False: n // 2, True: n - n // 2}, key, seed)


def ratio_sample(df: DataFrame, n: int, attack_ratio: float, key: list[str], label: str = "stage1_label",
                 seed: int = 42) -> DataFrame:
    """round(n x ratio) attacks and max(1, rest) benign rows, in seeded shuffled order."""
    attacks = int(round(n * attack_ratio))
    sample = quota_sample(df, F.col(label) == 1, {True: attacks, False: max(1, n - attacks)}, key, seed)
    return sample.orderBy(hash_32(*key, seed=seed + 1), *key)


def union_samples(benign: DataFrame, attacks: DataFrame) -> DataFrame:
    return benign.unionByName(attacks)


def missing_classes(splits: dict[str, DataFrame], label: str, required: list[str] | None = None) -> DataFrame:
    """(split, class) pairs that should be present and are not. Without `required` every class
    seen in any split is required in all of them."""
    present = None
    for name, df in splits.items():
        part = df.select(F.lit(name).alias("split"), F.col(label).alias("class_name")).distinct()
        present = part if present is None else present.unionByName(part)
    names = F.array(*[F.lit(s) for s in splits])
    if required is not None:
        spark = present.sparkSession
        wanted = spark.createDataFrame([(c,) for c in required], "class_name string")
    else:
        wanted = present.select("class_name").distinct()
    wanted = wanted.select(F.explode(names).alias("split"), "class_name")
    return wanted.join(present, ["split", "class_name"], "left_anti")


def require_classes(splits: dict[str, DataFrame], label: str, required: list[str] | None = None) -> None:
    gap = missing_classes(splits, label, required).orderBy("split", "class_name").take(20)
    if gap:
        raise ValueError(f"classes missing from splits: {[tuple(r) for r in gap]}")

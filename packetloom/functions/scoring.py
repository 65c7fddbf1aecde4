"""Severity and risk expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from packetloom.functions.values import col, confidence_fraction

# Attack families.
FLOOD_FAMILY = ("DDOS attack-HOIC", "DDoS attacks-LOIC-HTTP", "DoS attacks-Hulk", "DDOS attack-LOIC-UDP")
INTRUSION_FAMILY = (
    "Bot",
    "FTP-BruteForce",
    "SSH-Bruteforce",
    "Infilteration",
    "DoS attacks-SlowHTTPTest",
    "DoS attacks-GoldenEye",
    "DoS attacks-Slowloris",
)
WEB_FAMILY = ("Brute Force -Web", "Brute Force -XSS", "SQL Injection")

# The fourteen attack classes in the classifier's index order.
ATTACK_LABELS = (
    "DDOS attack-HOIC",
    "DDoS attacks-LOIC-HTTP",
    "DoS attacks-Hulk",
    "Bot",
    "FTP-BruteForce",
    "SSH-Bruteforce",
    "Infilteration",
    "DoS attacks-SlowHTTPTest",
    "DoS attacks-GoldenEye",
    "DoS attacks-Slowloris",
    "DDOS attack-LOIC-UDP",
    "Brute Force -Web",
    "Brute Force -XSS",
    "SQL Injection",
)

# Severity order and the base points of each level.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 0}
SEVERITY_POINTS = {"CRITICAL": 80.0, "HIGH": 60.0, "MEDIUM": 40.0, "LOW": 20.0, "UNKNOWN": 10.0}
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def _tiers(confidence: Column, top: str, middle: str, low: str) -> Column:
    return F.when(confidence >= 0.90, top).when(confidence >= 0.70, middle).otherwise(low)


def severity_by_probability(p: str | Column) -> Column:
    p = col(p)
    return F.when(p >= 0.90, "CRITICAL").when(p >= 0.80, "HIGH").otherwise("MEDIUM")


def severity(attack_type: str | Column, confidence: str | Column, policy: str = "family_confidence") -> Column:
    """Severity of a verdict; benign traffic is NONE.

    Policies: `family_confidence` (default), `probability`, `family`.
    """
    kind, conf = col(attack_type), col(confidence)
    if policy == "probability":
        level = severity_by_probability(conf)
    elif policy == "family":
        level = (
            F.when(kind.isin(*FLOOD_FAMILY), "CRITICAL")
            .when(kind.isin(*INTRUSION_FAMILY), "HIGH")
            .when(kind.isin(*WEB_FAMILY), "MEDIUM")
            .otherwise(_tiers(conf, "HIGH", "MEDIUM", "LOW"))
        )
    elif policy == "family_confidence":
        level = F.when(
            kind.isin(*FLOOD_FAMILY, *INTRUSION_FAMILY), _tiers(conf, "CRITICAL", "HIGH", "MEDIUM")
        ).otherwise(_tiers(conf, "HIGH", "MEDIUM", "LOW"))
    else:
        raise ValueError(f"unknown severity policy {policy!r}")
    return F.when(F.upper(kind) == "BENIGN", "NONE").otherwise(level)


def severity_rank(c: str | Column) -> Column:
    c = F.upper(col(c))
    expr = F.when(c == "CRITICAL", 4)
    for name in LEVELS[1:]:
        expr = expr.when(c == name, SEVERITY_RANK[name])
    return expr.otherwise(0)


def severity_from_rank(rank: Column) -> Column:
    expr = F.when(rank == 4, "CRITICAL")
    for name in LEVELS[1:]:
        expr = expr.when(rank == SEVERITY_RANK[name], name)
    return expr.otherwise("UNKNOWN")


def risk_score(
    level: str | Column,
    alert_count: str | Column,
    confidence: str | Column,
    attack_types: str | Column,
    duration_seconds: str | Column,
) -> Column:
    """Explainable 0-100 risk as a struct of the score and every part of it.

    `attack_types` is the number of distinct attack types.
    """
    level = F.upper(col(level))
    n, types = col(alert_count).cast("long"), F.greatest(col(attack_types).cast("long"), F.lit(1))
    seconds = F.coalesce(col(duration_seconds).cast("double"), F.lit(0.0))
    conf = confidence_fraction(confidence)
    base = F.when(level == "CRITICAL", SEVERITY_POINTS["CRITICAL"])
    for name in LEVELS[1:]:
        base = base.when(level == name, SEVERITY_POINTS[name])
    base = base.otherwise(SEVERITY_POINTS["UNKNOWN"])
    volume = F.least(F.lit(20.0), F.greatest(n - 1, F.lit(0)) * 3.0)
    diversity = F.least(F.lit(15.0), (types - 1) * 5.0)
    certainty = F.round(conf * 10, 2)
    sustained = F.when(seconds >= 60, 5.0).otherwise(0.0)
    total = base + volume + diversity + certainty + sustained
    return F.struct(
        F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 1).alias("risk_score"),
        level.alias("base_severity"),
        base.alias("base_score"),
        n.alias("alert_count"),
        volume.alias("volume_bonus"),
        types.alias("distinct_attack_types"),
        diversity.alias("diversity_bonus"),
        conf.alias("confidence"),
        certainty.alias("confidence_bonus"),
        seconds.alias("duration_seconds"),
        sustained.alias("duration_bonus"),
    )

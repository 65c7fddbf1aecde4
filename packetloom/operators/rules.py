"""Detection rules over event time and alert enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.functions import values as V
from packetloom.operators.intel import map_techniques, match_indicators
from packetloom.plans.trailing import trailing_sums

# Rule thresholds and the rule catalogue.
DEFAULT_CONFIG = {
    "correlation_window_seconds": 300,
    "ssh_alert_threshold": 3,
    "ftp_alert_threshold": 3,
    "dos_alert_threshold": 5,
    "critical_alert_threshold": 3,
}
RULES = [
    ("RULE-001", "Repeated SSH Activity", "HIGH", "ssh_alert_threshold", 3,
     "Triggers when multiple SSH-Bruteforce alerts originate from the same source IP within the correlation window."),
    ("RULE-002", "Repeated FTP Brute-Force Activity", "HIGH", "ftp_alert_threshold", 3,
     "Triggers when multiple FTP-BruteForce alerts originate from the same source IP within the correlation window."),
    ("RULE-003", "High-Volume DoS/DDoS Activity", "CRITICAL", "dos_alert_threshold", 5,
     "Triggers when high-volume DoS or DDoS attack flows surpass the volumetric stream threshold."),
    ("RULE-004", "Repeated Critical Alerts from Same Source", "CRITICAL", "critical_alert_threshold", 3,
     "Triggers when multiple CRITICAL severity alerts are detected from the same source entity."),
    ("RULE-005", "Known Malicious Indicator Match", "CRITICAL", "intel_match", 1,
     "Triggers when network traffic entities match a known malicious indicator in local threat intelligence."),
]
# Reason text of each rule.
REASONS = {
    "RULE-001": "Detected %d SSH brute-force alerts from source '%s' (Threshold: %d).",
    "RULE-002": "Detected %d FTP brute-force alerts from source '%s' (Threshold: %d).",
    "RULE-003": "Detected high-volume DoS/DDoS stream (%d flows) exceeding threshold (%d).",
    "RULE-004": "Accumulated %d CRITICAL severity alerts for source '%s' (Threshold: %d).",
    "RULE-005": "Entity '%s' matched threat intelligence indicator '%s' (%s).",
}
_NAME = {r[0]: r[1] for r in RULES}


def rule_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RULES, "rule_id string, rule_name string, severity string, threshold_param string, "
               "default_threshold int, description string")


def rule_counters(alerts: DataFrame, window_seconds: int = 300, ts: str = "event_time", slices: int = 32) -> DataFrame:
    """Adds how many alerts of each kind lie in the trailing window, this one included.

    `ssh_count`, `ftp_count` and `critical_count` are per source, over all sources where the
    alert has none; `dos_count` is over all sources. Alerts of no rule kind get zeros and do
    not enter the windows at all.
    """
    kind = F.upper(F.col("attack_type"))
    flags = {
        "_ssh": kind.contains("SSH"), "_ftp": kind.contains("FTP"), "_dos": kind.contains("DOS"),
        "_crit": F.upper("severity") == "CRITICAL",
    }
    rows = alerts.withColumns({k: F.coalesce(c, F.lit(False)).cast("int") for k, c in flags.items()})
    rows = rows.withColumns({"_us": V.micros(ts), "_src": F.coalesce("source_ip", F.lit(""))})
    busy = (F.col("_ssh") + F.col("_ftp") + F.col("_dos") + F.col("_crit") > 0) & F.col("_us").isNotNull()
    span = int(window_seconds) * 1_000_000
    active = rows.where(busy)
    own = trailing_sums(active, ["_src"], "_us", span,
                        {"_own_ssh": "_ssh", "_own_ftp": "_ftp", "_own_crit": "_crit"}, slices)
    everyone = trailing_sums(own, [], "_us", span,
                             {"_all_ssh": "_ssh", "_all_ftp": "_ftp", "_all_crit": "_crit", "_all_dos": "_dos"},
                             slices, counts_from=active)
    local = F.col("_src") != ""

    def pick(name: str) -> Column:
        return F.when(local, F.col(f"_own_{name}")).otherwise(F.col(f"_all_{name}"))

    counts = {"ssh_count": pick("ssh"), "ftp_count": pick("ftp"), "critical_count": pick("crit"),
              "dos_count": F.col("_all_dos")}
    # a counter only means something for an alert of its own kind
    own_kind = {"ssh_count": "_ssh", "ftp_count": "_ftp", "critical_count": "_crit", "dos_count": "_dos"}
    done = everyone.select(*alerts.columns, *[
        F.when(F.col(own_kind[k]) == 1, c).otherwise(0).cast("long").alias(k) for k, c in counts.items()
    ])
    quiet = rows.where(~F.coalesce(busy, F.lit(False))).select(*alerts.columns, *[
        F.lit(0).cast("long").alias(k) for k in counts
    ])
    return done.unionByName(quiet)


def _match(rule: str, severity: Column, reason: Column, evidence: dict[str, Column]) -> Column:
    pairs = [x for k, c in evidence.items() for x in (F.lit(k), c.cast("string"))]
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(_NAME[rule]).alias("rule_name"), severity.alias("severity"),
                    reason.alias("reason"), F.create_map(*pairs).alias("evidence"))


def match_rules(counted: DataFrame, config: dict | None = None, out: str = "rules_triggered",
                intel: str = "intel") -> DataFrame:
    """Adds the array of matched rules to alerts that carry counters and, optionally, an
    indicator struct."""
    conf = DEFAULT_CONFIG | (config or {})
    counters = (
        ("RULE-001", "HIGH", "ssh_count", "ssh_alert_threshold", True),
        ("RULE-002", "HIGH", "ftp_count", "ftp_alert_threshold", True),
        ("RULE-003", "CRITICAL", "dos_count", "dos_alert_threshold", False),
        ("RULE-004", "CRITICAL", "critical_count", "critical_alert_threshold", True),
    )
    hits = []
    for rule, level, count, setting, by_source in counters:
        seen, limit = F.col(count), F.lit(conf[setting])
        who = [F.coalesce("source_ip", F.lit("Local"))] if by_source else []
        evidence = {count: seen, "threshold": limit} | ({"source_ip": F.col("source_ip")} if by_source else {})
        reason = F.format_string(REASONS[rule], seen, *who, limit)
        hits.append(F.when((seen > 0) & (seen >= limit), _match(rule, F.lit(level), reason, evidence)))
    if intel in counted.columns:
        i = F.col(intel)
        reason = F.format_string(REASONS["RULE-005"], i["indicator_value"], i["threat_name"], i["source"])
        hits.append(F.when(i.isNotNull(), _match(
            "RULE-005", F.coalesce(i["severity"], F.lit("CRITICAL")), reason,
            {"indicator_value": i["indicator_value"], "threat_name": i["threat_name"],
             "intel_confidence": i["confidence"], "intel_source": i["source"]})))
    return counted.withColumn(out, F.array_compact(F.array(*hits)))


def rule_matches(alerts: DataFrame) -> DataFrame:
    """One row per alert and matched rule."""
    return alerts.select("alert_id", F.col("event_time").alias("timestamp"), F.inline("rules_triggered"))


def evaluate_rules(alerts: DataFrame, indicators: DataFrame | None = None, config: dict | None = None,
                   slices: int = 32) -> DataFrame:
    """Rule matches of every alert, one row each."""
    conf = DEFAULT_CONFIG | (config or {})
    counted = rule_counters(alerts, conf["correlation_window_seconds"], slices=slices)
    if indicators is not None:
        counted = match_indicators(counted, indicators)
    return rule_matches(match_rules(counted, config))


def enrich_alerts(alerts: DataFrame, indicators: DataFrame, config: dict | None = None) -> DataFrame:
    """Alerts with indicator, rule and technique columns; the model's own confidence and severity
    stay apart from the indicator's."""
    conf = DEFAULT_CONFIG | (config or {})
    counted = rule_counters(alerts, conf["correlation_window_seconds"])
    df = match_rules(match_indicators(counted, indicators), config)
    i = F.col("intel")
    df = df.withColumns({
        "model_confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)),
        "model_severity": F.upper(F.coalesce("severity", F.lit("MEDIUM"))),
        "intel_match": i.isNotNull(),
        "intel_threat_name": i["threat_name"],
        "intel_confidence": i["confidence"],
        "intel_severity": F.upper(i["severity"]),
        "intel_source": i["source"],
        "rules_triggered_count": F.size("rules_triggered"),
    })
    return map_techniques(df).drop("intel", "ssh_count", "ftp_count", "critical_count", "dos_count")

"""Threat-intelligence indicators and ATT&CK technique mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ATT&CK release, and per attack label: technique, tactic, confidence, rationale.
ATTACK_VERSION = "19.0"
ATTACK_SOURCE = "MITRE ATT&CK Enterprise v19.0 (STIX v2.1 Package)"
UNMAPPED_RATIONALE = "No defensive network evidence to map to specific ATT&CK technique."
TECHNIQUES = [
    ("SSH-Bruteforce", "T1110", "Brute Force", "TA0006", "Credential Access", 0.88,
     "Associated ATT&CK technique: Repeated SSH authentication-oriented network activity detected."),
    ("FTP-BruteForce", "T1110", "Brute Force", "TA0006", "Credential Access", 0.88,
     "Associated ATT&CK technique: Repeated FTP authentication-oriented network activity detected."),
    ("Brute Force -Web", "T1110.001", "Password Guessing", "TA0006", "Credential Access", 0.85,
     "Associated ATT&CK technique: Automated web form password guessing attempts."),
    ("Brute Force -XSS", "T1110.001", "Password Guessing", "TA0006", "Credential Access", 0.85,
     "Associated ATT&CK technique: Web application authentication probing and payload injection."),
    ("DoS attacks-Hulk", "T1498", "Network Denial of Service", "TA0040", "Impact", 0.85,
     "Associated ATT&CK technique: High-volume application HTTP GET resource exhaustion detected."),
    ("DoS attacks-Slowloris", "T1498.002", "Reflection Amplification / Low & Slow DoS", "TA0040", "Impact", 0.87,
     "Associated ATT&CK technique: Low & Slow socket connection exhaustion attack."),
    ("DoS attacks-GoldenEye", "T1498", "Network Denial of Service", "TA0040", "Impact", 0.85,
     "Associated ATT&CK technique: Web server connection pool starvation attempt."),
    ("DoS attacks-SlowHTTPTest", "T1498.002", "Reflection Amplification / Low & Slow DoS", "TA0040", "Impact", 0.87,
     "Associated ATT&CK technique: Incomplete HTTP header connection persistence attack."),
    ("DDOS attack-HOIC", "T1498.001", "Direct Network Flood", "TA0040", "Impact", 0.90,
     "Associated ATT&CK technique: High-yield direct HTTP request flooding detected."),
    ("DDoS attacks-LOIC-HTTP", "T1498.001", "Direct Network Flood", "TA0040", "Impact", 0.90,
     "Associated ATT&CK technique: Multi-threaded HTTP web request flooding detected."),
    ("DDOS attack-LOIC-UDP", "T1498.001", "Direct Network Flood", "TA0040", "Impact", 0.90,
     "Associated ATT&CK technique: UDP packet flood targeting host application ports."),
    ("Bot", "T1071", "Application Layer Protocol", "TA0011", "Command and Control", 0.80,
     "Associated ATT&CK technique: Automated botnet command and control communication traffic."),
    ("Infilteration", "T1190", "Exploit Public-Facing Application", "TA0001", "Initial Access", 0.82,
     "Associated ATT&CK technique: Potential internal network intrusion or perimeter breach activity."),
    ("SQL Injection", "T1190", "Exploit Public-Facing Application", "TA0001", "Initial Access", 0.82,
     "Associated ATT&CK technique: Malicious database query injection targeting public web services."),
]

# Fixed value: syntax of a domain name.
DOMAIN_PATTERN = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def techniques(spark: SparkSession) -> DataFrame:
    """The mapping dimension: fourteen rows."""
    return spark.createDataFrame(
        TECHNIQUES,
        "attack_type string, technique_id string, technique_name string, tactic_id string, tactic_name string, "
        "confidence double, rationale string",
    )


def map_techniques(df: DataFrame, label: str = "attack_type", out: str = "attack_mapping") -> DataFrame:
    """Adds the technique of each exact label as a struct; labels without one are UNMAPPED."""
    fields = ["technique_id", "technique_name", "tactic_id", "tactic_name", "confidence", "rationale"]
    # the dimension is the constant above, so its size is known
    dim = F.broadcast(techniques(df.sparkSession).select(F.col("attack_type").alias("_t"), *[
        F.col(f).alias(f"_m_{f}") for f in fields
    ]))
    joined = df.join(dim, F.col(label) == F.col("_t"), "left")
    mapped = F.struct(
        *[F.col(f"_m_{f}").alias(f) for f in fields[:4]],
        F.when(F.col("_t").isNotNull(), "MAPPED").otherwise("UNMAPPED").alias("mapping_status"),
        F.coalesce("_m_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("_m_rationale", F.lit(UNMAPPED_RATIONALE)).alias("rationale"),
        F.lit(ATTACK_SOURCE).alias("source"),
        F.lit(ATTACK_VERSION).alias("attack_version"),
    )
    return joined.withColumn(out, mapped).drop("_t", *[f"_m_{f}" for f in fields])


def technique_coverage(mapping: DataFrame) -> DataFrame:
    """One row: mapped labels, distinct tactics and techniques."""
    return mapping.agg(
        F.lit(ATTACK_VERSION).alias("attack_version"),
        F.lit(ATTACK_SOURCE).alias("dataset_source"),
        F.count("*").alias("mapped_detections"),
        F.count_distinct("tactic_id").alias("mapped_tactics_count"),
        F.count_distinct("technique_id").alias("mapped_techniques_count"),
        F.array_sort(F.collect_set("tactic_id")).alias("tactics"),
        F.array_sort(F.collect_set("technique_id")).alias("techniques"),
    )


def labels_by_technique(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("technique_id", "technique_name", "tactic_id", "tactic_name").agg(
        F.array_sort(F.collect_set("attack_type")).alias("associated_attacks"), F.max("confidence").alias("confidence")
    )


def labels_by_tactic(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("tactic_id", "tactic_name").agg(F.count("*").alias("techniques_count"))


def _is_ipv6(v: Column) -> Column:
    """IPv6 text: eight groups, or fewer with exactly one `::`; the last two may be an IPv4 form."""
    bare = F.regexp_replace(v, r"%[^%]+$", "")
    plain = F.regexp_replace(bare, rf"(?<=:){_IPV4}$", "0:0")
    chars = plain.rlike(r"^[0-9a-fA-F:]+$") & plain.contains(":") & ~plain.contains(":::")
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    doubles = F.size(F.split(plain, "::")) - 1
    edges = ~plain.rlike(r"^:[^:]") & ~plain.rlike(r"[^:]:$")
    short = ~F.exists(F.split(plain, ":"), lambda g: F.length(g) > 4)
    return chars & edges & short & (((doubles == 0) & (groups == 8)) | ((doubles == 1) & (groups <= 7)))


def validate_indicators(df: DataFrame, kind: str = "indicator_type", value: str = "indicator_value") -> DataFrame:
    """Adds `valid` and `error` by type-specific format checks. Types without a check pass."""
    k, v = F.upper(F.trim(F.col(kind))), F.trim(F.col(value))
    ip_ok = v.rlike(rf"^{_IPV4}$") | _is_ipv6(v)
    url_ok = v.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+")
    hash_ok = F.length(v).isin(32, 40, 64) & v.rlike(r"^[a-fA-F0-9]+$")
    error = (
        F.when(v.isNull() | (v == ""), "empty value")
        .when((k == "IP") & ~ip_ok, "invalid IP address")
        .when((k == "DOMAIN") & ~v.rlike(DOMAIN_PATTERN), "invalid domain")
        .when((k == "URL") & ~url_ok, "invalid URL")
        .when((k == "HASH") & ~hash_ok, "invalid hash")
    )
    return df.withColumn("error", error).withColumn("valid", F.col("error").isNull())


def indicator_id(kind: Column, value: Column) -> Column:
    """Whole digest: indicators are merged and removed by it."""
    return F.concat(F.lit("IND-"), F.upper(F.md5(F.concat_ws(":", kind, value))))


def prepare_indicators(raw: DataFrame, at: str = "observed_at") -> DataFrame:
    """Submitted indicators in the stored schema; invalid ones are dropped (see `validate_indicators`)."""
    have = set(raw.columns)

    def field(name: str, kind: str, default=None) -> Column:
        c = F.col(name) if name in have else F.lit(None)
        c = c.cast(kind)
        return F.coalesce(c, F.lit(default)) if default is not None else c

    good = validate_indicators(raw.withColumns({
        "indicator_type": F.upper(F.trim(field("indicator_type", "string", "IP"))),
        "indicator_value": F.trim("indicator_value"),
    })).where("valid")
    seen = F.col(at).cast("timestamp")
    return good.select(
        indicator_id(F.col("indicator_type"), F.col("indicator_value")).alias("indicator_id"),
        "indicator_type", "indicator_value",
        field("threat_name", "string", "Known Malicious Entity").alias("threat_name"),
        field("confidence", "double", 0.90).alias("confidence"),
        F.upper(field("severity", "string", "HIGH")).alias("severity"),
        field("source", "string", "LOCAL_SOC").alias("source"),
        (F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in have
         else F.array().cast("array<string>")).alias("tags"),
        seen.alias("first_seen"), seen.alias("last_seen"),
        field("expires_at", "timestamp").alias("expires_at"),
        F.coalesce(field("description", "string"),
                   F.concat(F.lit("Local Threat Indicator for "), F.col("indicator_value"))).alias("description"),
        seen.alias("created_at"),
    )


def upsert_indicators(known: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """One row per id: descriptive fields from the newest record, first_seen, expiry and
    creation from the oldest."""
    both = fresh if known is None else known.unionByName(fresh)
    latest = ["threat_name", "confidence", "severity", "source", "tags", "description"]
    oldest = ["indicator_type", "indicator_value", "expires_at", "created_at"]
    merged = both.groupBy("indicator_id").agg(
        F.max_by(F.struct(*latest), "last_seen").alias("_new"),
        F.min_by(F.struct(*oldest), "first_seen").alias("_old"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return merged.select("indicator_id", "_new.*", "_old.*", "first_seen", "last_seen").select(*both.columns)


def remove_indicators(known: DataFrame, ids: DataFrame) -> DataFrame:
    return known.join(ids.select("indicator_id"), "indicator_id", "left_anti")


def list_indicators(known: DataFrame, kind: str | None = None, limit: int = 100) -> DataFrame:
    if kind:
        known = known.where(F.upper("indicator_type") == kind.upper())
    return known.orderBy(F.desc("created_at"), "indicator_id").limit(limit)


def match_indicators(alerts: DataFrame, indicators: DataFrame, source: str = "source_ip",
                     destination: str = "destination_ip", as_of=None, out: str = "intel") -> DataFrame:
    """Adds the matched IP indicator as a struct: by source address first, by destination only
    when the source has none.

    No join hint is given: Spark broadcasts the indicators when their measured size allows it
    and otherwise runs a sort-merge join whose skewed partitions AQE splits.
    """
    live = indicators.where(F.upper("indicator_type") == "IP")
    if as_of is not None and "expires_at" in indicators.columns:
        live = live.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))
    fields = ["indicator_value", "threat_name", "confidence", "severity", "source"]
    table = live.select(F.trim("indicator_value").alias("_v"), F.struct(*fields).alias("_i")).dropDuplicates(["_v"])

    def side(name: str) -> DataFrame:
        return table.select(F.col("_v").alias(f"_v_{name}"), F.col("_i").alias(f"_i_{name}"))

    first = alerts.join(side("s"), F.trim(F.col(source)) == F.col("_v_s"), "left")
    wanted = F.when(F.col("_v_s").isNull(), F.trim(F.col(destination)))
    both = first.join(side("d"), wanted == F.col("_v_d"), "left")
    return both.withColumn(out, F.coalesce("_i_s", "_i_d")).drop("_v_s", "_i_s", "_v_d", "_i_d")

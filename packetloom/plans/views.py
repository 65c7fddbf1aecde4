"""Security-shaped views over the provided star-schema tables.

Each view is plain SQL that Spark and other engines read alike; `{table}` stands for its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.session import prepare

VIEWS: dict[str, tuple[str, str]] = {
    "flows": ("lineitem", """
SELECT l_orderkey * 10 + l_linenumber AS flow_id, l_shipdate AS Timestamp, CAST(l_partkey % 24 AS INT) AS Hour,
 CASE l_partkey % 5 WHEN 0 THEN 22 WHEN 1 THEN 21 WHEN 2 THEN 80 WHEN 3 THEN 443 ELSE 8080 END AS Dst_Port,
 CASE WHEN l_suppkey % 10 < 7 THEN 6 WHEN l_suppkey % 10 < 9 THEN 17 ELSE 1 END AS Protocol,
 l_extendedprice * 1000 AS Flow_Duration, l_quantity AS Tot_Fwd_Pkts, floor(l_quantity / 2) AS Tot_Bwd_Pkts,
 l_extendedprice AS TotLen_Fwd_Pkts, l_extendedprice * l_discount AS TotLen_Bwd_Pkts,
 CASE WHEN l_linenumber = 4 THEN CAST('Infinity' AS DOUBLE) WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS Flow_Byts_per_s,
 CASE WHEN l_linenumber = 4 THEN CAST('-Infinity' AS DOUBLE) ELSE l_quantity END AS Flow_Pkts_per_s,
 CASE WHEN l_returnflag = 'N' THEN 'Benign' ELSE CASE l_suppkey % 14 WHEN 0 THEN 'DDOS attack-HOIC' WHEN 1 THEN 'DDoS attacks-LOIC-HTTP' WHEN 2 THEN 'DoS attacks-Hulk'
  WHEN 3 THEN 'Bot' WHEN 4 THEN 'FTP-BruteForce' WHEN 5 THEN 'SSH-Bruteforce' WHEN 6 THEN 'Infilteration' WHEN 7 THEN 'DoS attacks-SlowHTTPTest'
  WHEN 8 THEN 'DoS attacks-GoldenEye' WHEN 9 THEN 'DoS attacks-Slowloris' WHEN 10 THEN 'DDOS attack-LOIC-UDP' WHEN 11 THEN 'Brute Force -Web'
  WHEN 12 THEN 'Brute Force -XSS' ELSE 'SQL Injection' END END AS Label,
 CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS IsAttack FROM {table}"""),
    "alerts": ("events", """
SELECT CAST(event_id AS STRING) AS alert_id, event_id AS seq, ts AS event_time, ts AS created_at,
 CASE event_type WHEN 'error' THEN 'DoS attacks-Hulk' WHEN 'click' THEN 'SSH-Bruteforce' WHEN 'purchase' THEN 'FTP-BruteForce' WHEN 'signup' THEN 'Bot' ELSE 'BENIGN' END AS attack_type,
 LEAST(CAST(1 AS DOUBLE), value / 100) AS confidence,
 CASE WHEN event_type = 'view' THEN 'LOW' WHEN event_type = 'signup' THEN CASE WHEN value >= 90 THEN 'HIGH' WHEN value >= 70 THEN 'MEDIUM' ELSE 'LOW' END
  ELSE CASE WHEN value >= 90 THEN 'CRITICAL' WHEN value >= 70 THEN 'HIGH' ELSE 'MEDIUM' END END AS severity,
 CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('10.0.0.', CAST(user_id AS STRING)) END AS source_ip,
 concat('192.168.1.', CAST(event_id % 8 AS STRING)) AS destination_ip,
 CASE event_id % 5 WHEN 0 THEN 22 WHEN 1 THEN 21 WHEN 2 THEN 80 WHEN 3 THEN 443 ELSE NULL END AS destination_port,
 CASE event_id % 4 WHEN 0 THEN 'UDP' WHEN 1 THEN 'Unknown' ELSE 'TCP' END AS protocol,
 CASE event_id % 7 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'ESCALATED' ELSE 'NEW' END AS status FROM {table}"""),
    "packets": ("events", """
SELECT event_id AS seq, ts AS packet_time,
 CASE WHEN event_id % 3 = 0 THEN '192.168.1.1' ELSE concat('10.0.0.', CAST(user_id % 30 AS STRING)) END AS src_ip,
 CASE WHEN event_id % 3 = 0 THEN concat('10.0.0.', CAST(user_id % 30 AS STRING)) ELSE '192.168.1.1' END AS dst_ip,
 CASE WHEN event_id % 3 = 0 THEN 80 ELSE CAST(40000 + user_id % 30 AS INT) END AS src_port,
 CASE WHEN event_id % 3 = 0 THEN CAST(40000 + user_id % 30 AS INT) ELSE 80 END AS dst_port, 6 AS protocol,
 CAST(floor(value) AS INT) + 40 AS pkt_len, CAST(floor(value) AS INT) AS payload_len, 40 AS header_len,
 event_type = 'error' AS fin, event_type = 'signup' AS syn, event_type = 'click' AS psh, CAST(user_id * 100 AS INT) AS win_bytes FROM {table}"""),
    "scored": ("events", """
SELECT event_id, CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label,
 CASE WHEN value >= 60 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS prediction, LEAST(CAST(1 AS DOUBLE), value / 100) AS attack_probability,
 event_type AS attack_label, CASE (event_id * 7) % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS predicted_label FROM {table}"""),
    "indicators": ("nation", """
SELECT concat('IND-', upper(md5(concat('IP:10.0.0.', CAST(n_nationkey * 6 + 1 AS STRING))))) AS indicator_id, 'IP' AS indicator_type,
 concat('10.0.0.', CAST(n_nationkey * 6 + 1 AS STRING)) AS indicator_value, n_name AS threat_name, CAST(50 + n_nationkey AS DOUBLE) / 100 AS confidence,
 CASE WHEN n_regionkey = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 'LOCAL_SOC' AS source FROM {table}"""),
    "cases": ("events", """
SELECT concat('INC-', CAST(user_id AS STRING), '-', event_type) AS incident_id, min(ts) AS created_at, min(ts) AS first_seen,
 max(ts) AS last_seen, max(ts) AS updated_at, count(*) AS alert_count, event_type AS primary_attack_type,
 CASE WHEN max(value) >= 90 THEN 'CRITICAL' WHEN max(value) >= 70 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 CASE min(event_id) % 4 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'ESCALATED' ELSE 'NEW' END AS status,
 LEAST(CAST(1 AS DOUBLE), max(value) / 100) AS confidence, CAST(1 + user_id % 4 AS INT) AS attack_types FROM {table} GROUP BY user_id, event_type"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = VIEWS[name]
    return prepare(spark).sql(sql, table=table(spark, sf_dir, source))


def oracle(names: str, sql: str) -> str:
    """`sql` with the named views (space separated) as leading common table expressions."""
    parts = [f"{n} AS ({VIEWS[n][1].format(table=VIEWS[n][0]).strip()})" for n in names.split()]
    text = sql.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {text[5:]}"
    return f"WITH {', '.join(parts)} {text}"

"""Registered queries: every operator over the whole provided tables, with the same result in
plain SQL wherever SQL can express it."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from packetloom.functions import scoring, values as V
from packetloom.operators import (
    alerts as A, clean as C, evaluate as E, flows as FL, incidents as I, intel as N, models as M, reports as R,
    rules as D, sampling as S, soc as O,
)
from packetloom.operators.rollup import DISTINCT_ERROR, RANK_ERROR, Rollup
from packetloom.operators.forests import FlatForest, class_share
from packetloom.plans.numbering import number_rows
from packetloom.plans.quantiles import exact_percentiles
from packetloom.plans.views import oracle, table, view
from packetloom.schemas import DETECTOR_FEATURES, RAW_COLUMNS, feature_name
from packetloom.session import materialise, new_path, ship
from packetloom.sources import tables as T
from packetloom.sources.capture import decode_capture_files as decode_captures, write_captures
from packetloom.streaming import streams as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = 86_400


class Inputs:
    """The views and tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from packetloom.plans.views import VIEWS

        return (view if name in VIEWS else table)(self.spark, self.dir, name)


def query(views: str = "", sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(ship(spark), sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = oracle(views, sql) if views else sql.strip()
        return fn

    return add


def day_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def time_text(c: str) -> Column:
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(c: str) -> Column:
    return F.concat_ws(",", F.col(c).cast("array<string>"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema
    ])


# ================================================================ threat reports

@query("flows", """SELECT Label, IsAttack, count(*) AS Flow_Count,
 round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS Percentage FROM flows GROUP BY Label, IsAttack""")
def attack_overview(t):
    return R.attack_overview(t.flows)


@query("flows", """SELECT strftime(Timestamp, '%Y-%m-%d') AS Attack_Date, Hour, Label, count(*) AS Attack_Count
 FROM flows WHERE IsAttack = 1 GROUP BY ALL""")
def attack_timeline(t):
    return R.attack_timeline(t.flows).withColumn("Attack_Date", day_text("Attack_Date"))


@query("flows", """SELECT Dst_Port, count(*) AS Attack_Count, count(DISTINCT Label) AS Attack_Types,
 round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS Attack_Share_Percent, round(avg(Flow_Duration), 2) AS Avg_Flow_Duration
 FROM flows WHERE IsAttack = 1 GROUP BY Dst_Port ORDER BY Attack_Count DESC, Dst_Port LIMIT 20""")
def targeted_ports(t):
    return R.targeted_ports(t.flows)


_AVERAGES = """count(*) AS Flow_Count, round(avg(Flow_Duration), 2) AS Avg_Flow_Duration,
 round(avg(Tot_Fwd_Pkts), 2) AS Avg_Fwd_Packets, round(avg(Tot_Bwd_Pkts), 2) AS Avg_Bwd_Packets,
 round(avg(TotLen_Fwd_Pkts), 2) AS Avg_Fwd_Bytes, round(avg(TotLen_Bwd_Pkts), 2) AS Avg_Bwd_Bytes"""


@query("flows", f"SELECT Protocol, Label, {_AVERAGES} FROM flows WHERE IsAttack = 1 GROUP BY Protocol, Label")
def protocol_intelligence(t):
    return R.protocol_intelligence(t.flows)


@query("flows", f"""SELECT Label, {_AVERAGES},
 round(avg(CASE WHEN isfinite(Flow_Byts_per_s) THEN Flow_Byts_per_s END), 2) AS Avg_Bytes_Per_Second,
 round(avg(CASE WHEN isfinite(Flow_Pkts_per_s) THEN Flow_Pkts_per_s END), 2) AS Avg_Packets_Per_Second
 FROM flows GROUP BY Label""")
def traffic_characteristics(t):
    return R.traffic_characteristics(t.flows)


@query("flows", """SELECT Hour, count(*) AS Attack_Count, count(DISTINCT Label) AS Attack_Types,
 round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS Attack_Share_Percent FROM flows WHERE IsAttack = 1 GROUP BY Hour""")
def hourly_concentration(t):
    return R.hourly_concentration(t.flows)


@query("flows", """SELECT count(*) AS Total_Flows, count(*) FILTER (IsAttack = 1) AS Attack_Flows,
 count(*) FILTER (IsAttack = 0) AS Benign_Flows,
 round(count(*) FILTER (IsAttack = 1) * 100.0 / count(*), 4) AS Attack_Rate_Percent,
 count(DISTINCT CASE WHEN IsAttack = 1 THEN Dst_Port END) AS Unique_Attack_Targeted_Ports,
 count(DISTINCT Protocol) AS Protocols_Observed, count(DISTINCT CASE WHEN IsAttack = 1 THEN Label END) AS Attack_Types FROM flows""")
def executive_summary(t):
    return R.executive_summary(t.flows)


@query("flows", "SELECT Label, count(*) AS n FROM flows GROUP BY Label")
def write_report(t):
    root = new_path(t.spark, "reports")
    T.write_report(R.label_distribution(t.flows), root, "labels")
    return t.spark.read.parquet(f"{root}/labels").withColumnRenamed("count", "n")


# ================================================================ profiling

@query("flows", "SELECT Label, count(*) AS count FROM flows GROUP BY Label")
def label_distribution(t):
    return R.label_distribution(t.flows)


@query("", "SELECT concat('day-', l_linestatus, '.csv') AS source_file, count(*) AS count FROM lineitem GROUP BY 1")
def rows_by_source(t):
    return R.rows_by_source(t.lineitem.select(F.concat(F.lit("day-"), "l_linestatus", F.lit(".csv")).alias("source_file")))


@query("flows", "SELECT count(DISTINCT Label) AS distinct_labels FROM flows")
def distinct_labels(t):
    return R.distinct_labels(t.flows)


_FLOW_COLUMNS = ("flow_id Timestamp Hour Dst_Port Protocol Flow_Duration Tot_Fwd_Pkts Tot_Bwd_Pkts TotLen_Fwd_Pkts TotLen_Bwd_Pkts Flow_Byts_per_s "
                 "Flow_Pkts_per_s Label IsAttack").split()
_FLOW_DOUBLES = [c for c in _FLOW_COLUMNS[5:12] if c != "Tot_Bwd_Pkts"]


@query("flows", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS null_count FROM flows""" for c in _FLOW_COLUMNS))
def null_counts(t):
    return R.null_counts(t.flows)


@query("flows", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (isinf({c})) AS inf_count FROM flows""" for c in _FLOW_DOUBLES))
def inf_counts(t):
    return R.inf_counts(t.flows)


@query("flows", f"""SELECT (SELECT count(*) FROM flows) AS "rows", {len(_FLOW_COLUMNS)} AS "columns", p AS position, c AS "column", k AS type FROM (VALUES """ + ", ".join(
    f"({i}, '{c}', '{'bigint' if c in ('flow_id', 'Tot_Bwd_Pkts') else 'string' if c == 'Label' else 'double' if c in _FLOW_DOUBLES else 'TIME' if c == 'Timestamp' else 'int'}')"
    for i, c in enumerate(_FLOW_COLUMNS)) + ") v(p, c, k)")
def schema_profile(t):
    kind = F.when(F.col("type").startswith("timestamp") | (F.col("type") == "date"), "TIME").otherwise(F.col("type"))
    return R.schema_profile(t.flows).withColumn("type", kind)


@query("flows", """WITH s AS (SELECT Label, flow_id % 5 < 4 AS train FROM flows),
 c AS (SELECT Label, count(*) AS n FROM s GROUP BY Label)
 SELECT (SELECT count(*) FROM s) AS total_flows, (SELECT count(*) FROM s WHERE train) AS train_flows,
 (SELECT count(*) FROM s WHERE NOT train) AS test_flows, (SELECT count(*) FROM s WHERE Label = 'Benign') AS benign_count,
 (SELECT count(*) FROM s WHERE Label <> 'Benign') AS attack_count,
 round((SELECT count(*) FROM s WHERE Label <> 'Benign') / (SELECT count(*) FROM s), 4) AS attack_rate,
 (SELECT string_agg(concat(Label, ':', CAST(n AS STRING)), ',' ORDER BY n DESC, Label) FROM c) AS classes""")
def dataset_scale(t):
    rows = t.flows.withColumnRenamed("Label", "attack_label")
    out = R.dataset_scale({"train": rows.where("flow_id % 5 < 4"), "test": rows.where("flow_id % 5 >= 4")})
    text = F.transform("class_distribution", lambda x: F.concat(x.class_name, F.lit(":"), x["count"].cast("string")))
    return out.select("total_flows", "train_flows", "test_flows", "benign_count", "attack_count", "attack_rate",
                      F.concat_ws(",", text).alias("classes"))


# ================================================================ scans, cleaning, typing

# Raw text rows as a labelled flow file would hold them: odd spacing and case in labels,
# repeated header lines, unparsable numbers and times.
_RAW_SQL = """SELECT l_orderkey, l_linenumber,
 CASE WHEN l_linenumber = 7 AND l_orderkey % 10 = 0 THEN ' Label ' WHEN l_returnflag = 'N' THEN CASE l_linenumber % 3 WHEN 0 THEN ' BENIGN' WHEN 1 THEN 'benign ' ELSE 'Benign' END
  WHEN l_returnflag = 'A' THEN CASE l_linenumber % 2 WHEN 0 THEN 'BOT ' ELSE 'Infilteration' END ELSE ' SSH-Bruteforce ' END AS Label,
 CASE l_linenumber % 4 WHEN 0 THEN 'Infinity' WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN 2 THEN 'n/a' ELSE NULL END AS rate,
 CASE WHEN l_linenumber = 5 THEN 'no time' ELSE concat(substr(d, 9, 2), '/', substr(d, 6, 2), '/', substr(d, 1, 4), ' 0', CAST(l_linenumber AS STRING), ':15:30') END AS stamp,
 CASE l_linenumber % 5 WHEN 0 THEN concat(substr(d, 9, 2), '/', substr(d, 6, 2), '/', substr(d, 1, 4), ' 07:08:09') WHEN 1 THEN concat(substr(d, 1, 10), ' 10:11:12')
  WHEN 2 THEN concat(substr(d, 1, 10), 'T13:14:15') WHEN 3 THEN concat(substr(d, 1, 10), 'T16:17:18.25') ELSE 'later' END AS any_stamp
 FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) AS STRING) AS d FROM {lineitem}) x"""


def raw_rows(t) -> DataFrame:
    return t.spark.sql(_RAW_SQL, lineitem=t.lineitem)


def _raw(sql: str) -> str:
    return f"WITH raw AS ({_RAW_SQL.format(lineitem='lineitem')}) {sql}"


def raw_file(t, lines: DataFrame | None = None) -> DataFrame:
    """All eighty columns of a flow file as text, derived from the order lines, which may be dealt anew first."""
    fixed = {
        "Dst Port": "CASE l_partkey % 5 WHEN 0 THEN '22' WHEN 1 THEN '21' ELSE '80' END", "Protocol": "'6'",
        "Timestamp": "concat(date_format(l_shipdate, 'dd/MM/yyyy'), ' 0', l_linenumber, ':00:00')",
        "Label": "CASE WHEN l_returnflag = 'N' THEN 'Benign' ELSE 'Bot' END",
        "Flow Byts/s": "CASE WHEN l_linenumber = 4 THEN 'Infinity' ELSE CAST(l_quantity AS STRING) END",
    }
    cols = [
        F.expr(f"CAST({fixed[c]} AS STRING)").alias(c) if c in fixed
        else (F.col("l_quantity") + i).cast("string").alias(c)
        for i, c in enumerate(RAW_COLUMNS)
    ]
    return (t.lineitem if lines is None else lines).select(*cols)


def _stored_raw(t) -> DataFrame:
    path = new_path(t.spark, "raw-csv")
    # compressed files cannot be split: rows are limited instead
    raw_file(t).write.option("header", True).option("compression", "gzip").option("maxRecordsPerFile", 1_000_000).csv(path)
    return T.with_source_file(T.read_flow_csv(t.spark, path))


@query("", """SELECT CASE WHEN l_returnflag = 'N' THEN 'Benign' ELSE 'Bot' END AS "Label", count(*) AS n,
 CAST(sum(l_quantity + 3) AS BIGINT) AS duration FROM lineitem GROUP BY 1""")
def read_flow_csv(t):
    raw = _stored_raw(t)
    return raw.groupBy("Label").agg(F.count("*").alias("n"), F.sum(V.to_double("`Flow Duration`")).cast("long").alias("duration"))


@query("", """SELECT count(*) AS "rows", 81 AS "columns", 0 AS header_artifacts, 0 AS unlabelled, 2 AS labels FROM lineitem""")
def table_check(t):
    """Strict by-name union of daily tables, written, re-read and checked in one pass."""
    raw = raw_file(t).withColumn("source_file", F.lit("a"))
    benign, rest = raw.where("Label = 'Benign'"), raw.where("Label <> 'Benign'")
    path = new_path(t.spark, "unified")
    T.write_table(T.canonicalise(benign).unionByName(T.canonicalise(rest), allowMissingColumns=False), path)
    return T.verify_table(t.spark, path, columns=81).drop("sources")


@query("", """SELECT CASE WHEN l_returnflag = 'N' THEN 'Benign' ELSE 'Bot' END AS attack_label,
 CAST(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS DOUBLE) AS stage1_label, count(*) AS n,
 round(sum(CASE WHEN l_linenumber = 4 THEN 0 ELSE l_quantity END), 3) AS byts, round(sum(l_linenumber), 3) AS hours,
 round(sum(dayofweek(l_shipdate) + 1), 3) AS days, CAST(sum(CASE WHEN dayofweek(l_shipdate) IN (0, 6) THEN 1 ELSE 0 END) AS DOUBLE) AS weekends,
 round(sum(l_quantity + 78), 3) AS idle_min FROM lineitem GROUP BY 1, 2""")
def ml_table(t):
    out = C.ml_table(raw_file(t).withColumn("source_file", F.lit("a")))
    return out.groupBy("attack_label", "stage1_label").agg(
        F.count("*").alias("n"), F.round(F.sum("Flow_Byts_per_s"), 3).alias("byts"), F.round(F.sum("Hour"), 3).alias("hours"),
        F.round(F.sum("DayOfWeek"), 3).alias("days"), F.sum("IsWeekend").alias("weekends"),
        F.round(F.sum("Idle_Min"), 3).alias("idle_min"))


@query("", _raw("""SELECT CASE WHEN lower(trim(Label)) = 'benign' THEN 'Benign' WHEN lower(trim(Label)) = 'bot' THEN 'Bot' ELSE trim(Label) END AS "Label",
 count(*) AS n FROM raw WHERE trim(Label) <> 'Label' GROUP BY 1"""))
def clean_labels(t):
    rows = C.assert_labels(C.normalise_labels(C.drop_header_artifacts(raw_rows(t))))
    return rows.groupBy("Label").agg(F.count("*").alias("n"))


@query("", _raw("""SELECT count(*) AS "rows", count(*) FILTER (trim(Label) = 'Label') AS artifacts, 0 AS blank_labels,
 count(*) FILTER (trim(Label) = 'Label') = 0 AS passed FROM raw"""))
def sanity_check(t):
    return C.sanity_check(raw_rows(t), required=("stamp", "rate"), source="stamp").drop("missing")


@query("", _raw("""SELECT l_orderkey, l_linenumber, CASE WHEN rate IN ('Infinity', 'n/a') OR rate IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(rate AS DOUBLE) END AS rate FROM raw"""))
def sanitise_numeric(t):
    return C.sanitise_numeric(raw_rows(t).select("l_orderkey", "l_linenumber", "rate"), ["rate"])


@query("flows", """SELECT flow_id, CASE WHEN isinf(Flow_Byts_per_s) THEN NULL ELSE Flow_Byts_per_s END AS byts,
 CASE WHEN isinf(Flow_Pkts_per_s) THEN NULL ELSE Flow_Pkts_per_s END AS pkts FROM flows""")
def inf_to_null(t):
    rows = C.inf_to_null(t.flows)
    return rows.select("flow_id", F.col("Flow_Byts_per_s").alias("byts"), F.col("Flow_Pkts_per_s").alias("pkts"))


@query("", _raw("""SELECT l_linenumber, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linenumber END AS "Hour",
 CASE WHEN l_linenumber = 5 THEN NULL ELSE dayofweek(strptime(stamp, '%d/%m/%Y %H:%M:%S')) + 1 END AS "DayOfWeek",
 CASE WHEN l_linenumber <> 5 AND dayofweek(strptime(stamp, '%d/%m/%Y %H:%M:%S')) IN (0, 6) THEN 1 ELSE 0 END AS "IsWeekend",
 count(*) AS n FROM raw GROUP BY ALL""").replace("strptime(", "try_strptime("))
def temporal_features(t):
    rows = C.temporal_features(C.parse_event_time(raw_rows(t), "stamp", "ts"), "ts")
    return rows.groupBy("l_linenumber", "Hour", "DayOfWeek", "IsWeekend").agg(F.count("*").alias("n"))


@query("", _raw("""SELECT l_linenumber, strftime(coalesce(try_strptime(any_stamp, '%d/%m/%Y %H:%M:%S'), try_strptime(any_stamp, '%Y-%m-%d %H:%M:%S'),
 try_strptime(any_stamp, '%Y-%m-%dT%H:%M:%S'), try_strptime(any_stamp, '%Y-%m-%dT%H:%M:%S.%f')), '%Y-%m-%d %H:%M:%S.%f') AS parsed,
 count(*) AS n FROM raw GROUP BY ALL"""))
def parse_event_time_multi(t):
    rows = C.parse_event_time(raw_rows(t), "any_stamp", "parsed", multi=True)
    return rows.withColumn("parsed", time_text("parsed")).groupBy("l_linenumber", "parsed").agg(F.count("*").alias("n"))


@query("flows", "SELECT Label, CASE WHEN Label = 'Benign' THEN 0 ELSE 1 END AS target, Label AS attack_label, count(*) AS n FROM flows GROUP BY Label")
def targets(t):
    rows = C.class_target(C.binary_target(t.flows, out="target"))
    return rows.groupBy("Label", "target", "attack_label").agg(F.count("*").alias("n"))


@query("flows", """SELECT flow_id, concat_ws(',', 'Idle_Min', CASE WHEN Flow_Byts_per_s IS NULL OR isinf(Flow_Byts_per_s) THEN 'Flow_Byts_per_s' END,
 CASE WHEN isinf(Flow_Pkts_per_s) THEN 'Flow_Pkts_per_s' END) AS invalid_features FROM flows""")
def validate_features(t):
    rows = C.validate_features(t.flows, ["Flow_Byts_per_s", "Flow_Pkts_per_s", "Flow_Duration", "Idle_Min"])
    return rows.select("flow_id", joined("invalid_features").alias("invalid_features"))


@query("flows", """SELECT Protocol, CASE Protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS name, Dst_Port AS port, count(*) AS n FROM flows GROUP BY ALL""")
def protocol_and_port(t):
    text = t.flows.withColumn("p", F.concat(F.col("Protocol").cast("string"), F.lit(".0"))).withColumn(
        "d", F.concat(F.col("Dst_Port").cast("string"), F.lit(".0")))
    return text.groupBy("Protocol", V.protocol_name("p").alias("name"), V.to_int("d").alias("port")).agg(F.count("*").alias("n"))


@query("flows", """SELECT flow_id, CAST(Dst_Port AS DOUBLE) AS Dst_Port, CAST(Protocol AS DOUBLE) AS Protocol, strftime(Timestamp, '%Y-%m-%d') AS day FROM flows""")
def default_fields(t):
    rows = t.flows.select("flow_id", F.col("Dst_Port").cast("string").alias("Dst_Port"), "Protocol", "Timestamp")
    return C.default_fields(rows, "2024-01-01 00:00:00").select("flow_id", "Dst_Port", "Protocol", day_text("Timestamp").alias("day"))


@query("alerts", """SELECT alert_id, attack_type, severity, round(CASE WHEN confidence * 150 > 1 THEN confidence * 150 / 100 ELSE confidence * 150 END, 6) AS confidence,
 destination_port, coalesce(source_ip, 'none') AS source_ip FROM alerts""")
def normalise_alert(t):
    rows = t.alerts.select(
        F.col("alert_id").alias("AlertId"), F.col("event_time").alias("Timestamp"), F.col("attack_type").alias("AttackType"),
        F.lower("severity").alias("Severity"), (F.col("confidence") * 150).alias("Model_Confidence"),
        F.col("destination_port").cast("string").alias("Destination_Port"), F.col("source_ip").alias("Src_IP"))
    return A.normalise_alert(rows).select("alert_id", "attack_type", "severity", F.round("confidence", 6).alias("confidence"),
                                          "destination_port", F.coalesce("source_ip", F.lit("none")).alias("source_ip"))


@query("", _raw("SELECT count(*) AS n, count(DISTINCT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))) AS keys FROM (SELECT DISTINCT * FROM raw) x"))
def distinct_flows(t):
    rows = C.distinct_flows(raw_rows(t))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("l_orderkey", "l_linenumber").alias("keys"))


@query("alerts", """SELECT alert_id, concat('{"type":"', attack_type, '","port":"', coalesce(CAST(destination_port AS STRING), 'none'), '"}') AS details FROM alerts""")
def json_columns(t):
    port = F.coalesce(F.col("destination_port").cast("string"), F.lit("none"))
    rows = t.alerts.select("alert_id", F.struct(F.col("attack_type").alias("type"), port.alias("port")).alias("details"))
    back = A.from_json_columns(A.json_columns(rows), {"details": "struct<type:string,port:string>"})
    return A.json_columns(back)


# ================================================================ severity and risk

_TIER = "CASE WHEN c >= 0.90 THEN '{0}' WHEN c >= 0.70 THEN '{1}' ELSE '{2}' END"
_WEB = "('Brute Force -Web', 'Brute Force -XSS', 'SQL Injection')"
_FLOOD = "('DDOS attack-HOIC', 'DDoS attacks-LOIC-HTTP', 'DoS attacks-Hulk', 'DDOS attack-LOIC-UDP')"


@query("flows", f"""WITH f AS (SELECT Label, l * 1.0 AS c FROM (SELECT Label, (flow_id % 101) / 100.0 AS l FROM flows) x)
 SELECT Label, CASE WHEN Label = 'Benign' THEN 'NONE' WHEN Label IN {_WEB} THEN {_TIER.format('HIGH', 'MEDIUM', 'LOW')} ELSE {_TIER.format('CRITICAL', 'HIGH', 'MEDIUM')} END AS by_family_confidence,
 CASE WHEN Label = 'Benign' THEN 'NONE' WHEN Label IN {_FLOOD} THEN 'CRITICAL' WHEN Label IN {_WEB} THEN 'MEDIUM' ELSE 'HIGH' END AS by_family,
 CASE WHEN Label = 'Benign' THEN 'NONE' WHEN c >= 0.90 THEN 'CRITICAL' WHEN c >= 0.80 THEN 'HIGH' ELSE 'MEDIUM' END AS by_probability,
 count(*) AS n FROM f GROUP BY ALL""")
def severity_policies(t):
    rows = t.flows.withColumn("c", F.pmod("flow_id", F.lit(101)) / F.lit(100.0))
    kinds = {f"by_{p}": scoring.severity("Label", "c", p) for p in ("family_confidence", "family", "probability")}
    return rows.groupBy("Label", *[c.alias(k) for k, c in kinds.items()]).agg(F.count("*").alias("n"))


@query("cases", """SELECT incident_id, severity, round(least(100.0, CASE severity WHEN 'CRITICAL' THEN 80 WHEN 'HIGH' THEN 60 ELSE 40 END
 + least(20.0, (alert_count - 1) * 3.0) + least(15.0, (attack_types - 1) * 5.0) + round(confidence * 10, 2)
 + CASE WHEN epoch_us(last_seen) - epoch_us(first_seen) >= 60000000 THEN 5 ELSE 0 END), 1) AS risk_score FROM cases""")
def risk_score(t):
    seconds = (V.micros("last_seen") - V.micros("first_seen")) / 1e6
    risk = scoring.risk_score("severity", "alert_count", "confidence", "attack_types", seconds)
    return t.cases.select("incident_id", "severity", risk.getField("risk_score").alias("risk_score"))


@query("alerts", """SELECT source_ip, CASE max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)
 WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM alerts GROUP BY source_ip""")
def escalate(t):
    return I.escalate(t.alerts, ["source_ip"])


# ================================================================ evaluation

@query("scored", "SELECT label, prediction, count(*) AS count FROM scored GROUP BY ALL")
def confusion_long(t):
    return E.confusion_long(t.scored)


@query("scored", "SELECT attack_label, " + ", ".join(
    f"count(*) FILTER (predicted_label = '{c}') AS \"{c}\"" for c in ("click", "error", "purchase", "signup", "view"))
    + " FROM scored GROUP BY attack_label")
def confusion_wide(t):
    return E.confusion_wide(t.scored, "attack_label", "predicted_label", ["click", "error", "purchase", "signup", "view"])


_RATES = """round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
 round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_positive_rate,
 round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS false_negative_rate, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
_CELLS = """count(*) FILTER (label = 1 AND {p}) AS tp, count(*) FILTER (label = 0 AND NOT ({p})) AS tn,
 count(*) FILTER (label = 0 AND {p}) AS fp, count(*) FILTER (label = 1 AND NOT ({p})) AS fn"""


@query("scored", f"WITH c AS (SELECT {_CELLS.format(p='prediction = 1')} FROM scored) SELECT tp, tn, fp, fn, {_RATES} FROM c")
def binary_metrics(t):
    return rounded(E.binary_metrics(t.scored))


_PER_CLASS = """p AS (SELECT k AS class_name, count(*) FILTER (attack_label = k) AS support, count(*) FILTER (attack_label = k AND predicted_label = k) AS tp,
 count(*) FILTER (attack_label <> k AND predicted_label = k) AS fp, count(*) FILTER (attack_label = k AND predicted_label <> k) AS fn
 FROM scored, (SELECT DISTINCT attack_label AS k FROM scored) ks GROUP BY k),
 m AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS re, 2 * tp / (2 * tp + fp + fn) AS f FROM p)"""


@query("scored", f"""WITH {_PER_CLASS} SELECT class_name, support, tp, fp, fn, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1_score FROM m""")
def per_class_metrics(t):
    return rounded(E.per_class_metrics(t.scored))


@query("scored", f"""WITH {_PER_CLASS} SELECT CAST(sum(support) AS BIGINT) AS samples, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(pr), 6) AS macro_precision,
 round(avg(re), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(support * pr) / sum(support), 6) AS weighted_precision,
 round(sum(support * re) / sum(support), 6) AS weighted_recall, round(sum(support * f) / sum(support), 6) AS weighted_f1 FROM m""")
def averaged_metrics(t):
    return rounded(E.averaged_metrics(E.per_class_metrics(t.scored)))


@query("scored", """WITH c AS (SELECT CASE WHEN label = prediction THEN 'correct' ELSE 'incorrect' END AS outcome, attack_probability AS p FROM scored)
 SELECT outcome, count(*) AS "rows", round(avg(p), 6) AS mean, min(p) AS min, max(p) AS max FROM c GROUP BY 1
 UNION ALL SELECT 'overall', count(*), round(avg(p), 6), min(p), max(p) FROM c""")
def confidence_stats(t):
    return E.confidence_stats(t.scored, "attack_probability", "label", "prediction").withColumn("mean", F.round("mean", 6))


@query("scored", f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS attacks, {_CELLS.format(p='prediction = 1')},
 count(*) FILTER (label = 1 AND prediction = 1 AND attack_label = predicted_label) AS good FROM scored)
 SELECT n AS total_samples, round((tn + good) / n, 6) AS overall_pipeline_accuracy, round(tp / attacks, 6) AS attack_detection_accuracy,
 round(good / tp, 6) AS attack_classification_on_detected, round(good / attacks, 6) AS attack_classification_overall, tn AS correct_benign_decisions,
 tp AS correct_attack_detections, good AS correct_attack_classifications, fp AS false_alarms, fn AS missed_attacks FROM c""")
def pipeline_metrics(t):
    return rounded(E.pipeline_metrics(t.scored))


@query("scored", f"""WITH {_PER_CLASS}, a AS (SELECT sum(tp) / sum(support) AS acc, sum(support * pr) / sum(support) AS wp, sum(support * re) / sum(support) AS wr,
 sum(support * f) / sum(support) AS wf FROM m) SELECT unnest(['accuracy', 'weightedPrecision', 'weightedRecall', 'f1', 'weightedFMeasure']) AS metric,
 unnest([round(acc, 6), round(wp, 6), round(wr, 6), round(wf, 6), round(wf, 6)]) AS value FROM a""")
def ml_evaluators(t):
    return rounded(E.ml_evaluators(t.scored, "attack_label", "predicted_label"))


# Points of the curves by falling score; trapezoids between them. Fourteen distinct scores, so the evaluator bins nothing.
@query("scored", """WITH s AS (SELECT label, event_id % 7 / 7.0 + label / 3 AS x FROM scored),
 g AS (SELECT round(x, 12) AS x, sum(label) AS p, count(*) - sum(label) AS n FROM s GROUP BY 1),
 c AS (SELECT x, sum(p) OVER w AS tp, sum(n) OVER w AS fp, (SELECT sum(p) FROM g) AS ap, (SELECT sum(n) FROM g) AS an FROM g WINDOW w AS (ORDER BY x DESC)),
 q AS (SELECT x, tp / ap AS r, fp / an AS f, tp / (tp + fp) AS pr FROM c),
 d AS (SELECT r, f, pr, lag(r, 1, 0.0) OVER w AS r0, lag(f, 1, 0.0) OVER w AS f0, coalesce(lag(pr) OVER w, pr) AS p0 FROM q WINDOW w AS (ORDER BY x DESC))
 SELECT 'areaUnderROC' AS metric, round(sum((f - f0) * (r + r0) / 2), 6) AS value FROM d UNION ALL SELECT 'areaUnderPR', round(sum((r - r0) * (pr + p0) / 2), 6) FROM d""")
def area_metrics(t):
    rows = t.scored.withColumn("shifted", F.pmod(F.col("event_id"), F.lit(7)) / 7 + F.col("label") / 3)
    return rounded(E.ml_evaluators(rows, "label", "prediction", raw="shifted")).where("metric LIKE 'area%'")


_SWEEP = f"""c AS (SELECT t AS threshold, {_CELLS.format(p='attack_probability >= t')} FROM scored,
 (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t) ts GROUP BY t), q AS (SELECT threshold, tp, tn, fp, fn, {_RATES} FROM c)"""


@query("scored", f"WITH {_SWEEP} SELECT * FROM q")
def threshold_sweep(t):
    return rounded(E.threshold_sweep(t.scored))


@query("scored", f"WITH {_SWEEP} SELECT *, recall >= 0.95 AS eligible FROM q ORDER BY recall >= 0.95 DESC, f1 DESC, threshold LIMIT 1")
def select_threshold(t):
    return rounded(E.select_threshold(E.threshold_sweep(t.scored)))


@query("scored", f"""WITH s AS (SELECT CAST(event_id % 3 AS STRING) AS replay_id, *, prediction = 1 AS hit, CASE WHEN attack_label = 'view' THEN 'Benign' ELSE attack_label END AS gt,
 CASE WHEN attack_probability >= 0.9 THEN 'CRITICAL' ELSE 'HIGH' END AS sev FROM scored)
 SELECT replay_id, count(*) AS flows_processed, count(*) FILTER (gt <> 'Benign') AS gt_attacks, count(*) FILTER (hit) AS pred_attacks,
 count(*) FILTER (hit AND gt <> 'Benign') AS tp, count(*) FILTER (hit AND gt = 'Benign') AS fp, count(*) FILTER (hit AND sev = 'CRITICAL') AS critical,
 round(avg(CASE WHEN hit THEN attack_probability END) * 100, 6) AS average_confidence_percent,
 round(count(*) FILTER (gt <> 'Benign' AND predicted_label = gt) / count(*) FILTER (gt <> 'Benign'), 6) AS stage2_accuracy FROM s GROUP BY replay_id""")
def replay_scorecard(t):
    rows = t.scored.select(
        F.pmod("event_id", F.lit(3)).cast("string").alias("replay_id"), (F.col("prediction") == 1).alias("is_attack"),
        F.when(F.col("attack_label") == "view", "Benign").otherwise(F.col("attack_label")).alias("gt_label"),
        F.col("predicted_label").alias("attack_type"), F.col("attack_probability").alias("confidence"),
        F.when(F.col("attack_probability") >= 0.9, "CRITICAL").otherwise("HIGH").alias("severity"))
    return rounded(E.replay_scorecard(rows)).select(
        "replay_id", "flows_processed", "gt_attacks", "pred_attacks", "tp", "fp", "critical", "average_confidence_percent", "stage2_accuracy")


@query("", """SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
 round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS min, max(value) AS max FROM events""")
def latency_summary(t):
    return rounded(E.latency_summary(t.events.withColumnRenamed("value", "latency_ms")))


@query("", """SELECT round(quantile_cont(l_extendedprice, 0.001), 6) AS p0, round(quantile_cont(l_extendedprice, 0.333), 6) AS p33,
 round(quantile_cont(l_extendedprice, 0.9999), 6) AS p99 FROM lineitem""")
def exact_percentile_search(t):
    return rounded(exact_percentiles(t.lineitem, "l_extendedprice", {"p0": 0.001, "p33": 0.333, "p99": 0.9999}))


@query("scored", """WITH c AS (SELECT label, count(*) AS n FROM scored GROUP BY label) SELECT label, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 8) AS classWeight, n AS "rows" FROM c""")
def class_weights(t):
    return E.class_weights(t.scored).groupBy("label", F.round("classWeight", 8).alias("classWeight")).agg(F.count("*").alias("rows"))


@query("scored", """SELECT event_id, prediction = 1 AS before_attack, prediction = 1 AND predicted_label <> 'view' AS after_attack FROM scored WHERE prediction = 1 AND predicted_label = 'view'""")
def compare_predictions(t):
    a = t.scored.select("event_id", (F.col("prediction") == 1).alias("is_attack"), F.lit("x").alias("attack_type"), F.lit("HIGH").alias("severity"))
    b = t.scored.select("event_id", ((F.col("prediction") == 1) & (F.col("predicted_label") != "view")).alias("is_attack"),
                        F.lit("x").alias("attack_type"), F.lit("HIGH").alias("severity"))
    out = E.compare_predictions(a, b, "event_id")
    return out.select("event_id", F.col("before.is_attack").alias("before_attack"), F.col("after.is_attack").alias("after_attack"))


@query("flows", """SELECT Label AS class_name, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM flows GROUP BY Label""")
def class_distribution(t):
    return E.class_distribution(t.flows.select(F.col("IsAttack").alias("stage1_label"), F.col("Label").alias("attack_label")))


# ================================================================ alerts

@query("alerts", """WITH d AS (SELECT *, 0 AS delivery FROM alerts UNION ALL SELECT *, 1 FROM alerts),
 k AS (SELECT seq, delivery, sha256(concat_ws('|', strftime(event_time, '%Y-%m-%d %H:%M:%S.%f'), attack_type, severity,
 coalesce(CAST(destination_port AS STRING), ''), protocol, printf('%.6f', confidence))) AS key FROM d),
 o AS (SELECT seq, delivery, sha256(concat(key, '|', CAST(row_number() OVER (PARTITION BY key ORDER BY seq, delivery) - 1 AS STRING))) AS whole,
 row_number() OVER (PARTITION BY key ORDER BY seq, delivery) - 1 AS occurrence FROM k)
 SELECT seq, delivery, occurrence, CASE WHEN seq % 50 = 0 THEN concat('S-', CAST(seq AS STRING)) ELSE substr(whole, 1, 16) END AS alert_id,
 CASE WHEN seq % 50 = 0 THEN concat('S-', CAST(seq AS STRING)) ELSE whole END AS alert_digest FROM o""")
def alert_ids(t):
    """Identity over the six fields of alerts, every alert delivered twice, every fiftieth with an id of its own."""
    twice = t.alerts.drop("alert_id").withColumn("delivery", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = twice.withColumns({
        "Timestamp": F.col("event_time").cast("timestamp"), "Dst_Port": F.col("destination_port"), "attack_probability": F.col("confidence"),
        "given": F.when(F.col("seq") % 50 == 0, F.concat(F.lit(" S-"), "seq"))})
    return A.with_alert_ids(rows, "seq", ("delivery",), supplied="given").select("seq", "delivery", "occurrence", "alert_id", "alert_digest")


@query("alerts", """SELECT alert_id, attack_type FROM alerts WHERE seq % 3 <> 0""")
def new_alerts_only(t):
    known = t.alerts.where("seq % 3 = 0")
    return A.new_alerts_only(t.alerts, known).select("alert_id", "attack_type")


@query("alerts", "SELECT attack_type, count(*) AS n FROM alerts GROUP BY attack_type")
def append_alerts(t):
    """Two overlapping deliveries: the second adds only what is not stored yet."""
    rows = t.alerts.drop("seq").withColumn("event_time", F.col("event_time").cast("timestamp"))
    path = new_path(t.spark, "alerts")
    A.append_alerts(rows.where(F.pmod(F.xxhash64("alert_id"), F.lit(3)) != 0), path)
    return A.append_alerts(rows, path).groupBy("attack_type").agg(F.count("*").alias("n"))


@query("alerts", """SELECT alert_id FROM alerts WHERE status = 'NEW' AND upper(severity) = 'CRITICAL' AND attack_type = 'SSH-Bruteforce' ORDER BY created_at DESC, alert_id DESC LIMIT 100""")
def newest_alerts(t):
    return A.newest_alerts(t.alerts, 100, status="new", severity="critical", attack_type="SSH-Bruteforce").select("alert_id")


@query("alerts", "SELECT alert_id, severity FROM alerts WHERE alert_id IN (SELECT CAST(n_nationkey * 11 AS STRING) FROM nation)")
def lookup_many(t):
    keys = t.nation.select((F.col("n_nationkey") * 11).cast("string").alias("alert_id"))
    return A.lookup_many(t.alerts, keys, "alert_id").select("alert_id", "severity")


@query("alerts", """WITH c AS (SELECT CAST(event_id * 7 % (SELECT count(*) FROM events) AS STRING) AS alert_id, ts, CASE event_id % 5 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'ESCALATED' WHEN 2 THEN 'BOGUS' ELSE 'INVESTIGATING' END AS s FROM events),
 l AS (SELECT alert_id, arg_max(s, (ts, s)) AS s FROM c WHERE s <> 'BOGUS' GROUP BY alert_id)
 SELECT alert_id, coalesce(l.s, status) AS status FROM alerts LEFT JOIN l USING (alert_id)""")
def apply_alert_status(t):
    total = t.events.agg(F.count("*")).scalar()
    k = F.pmod("event_id", F.lit(5))
    changes = t.events.select(
        F.pmod(F.col("event_id") * 7, total).cast("string").alias("alert_id"), F.col("ts").alias("changed_at"),
        F.when(k == 0, "resolved").when(k == 1, "Escalated").when(k == 2, "BOGUS").otherwise("INVESTIGATING").alias("status"))
    return A.apply_alert_status(t.alerts, changes.withColumn("n", F.upper("status")), order="n").select("alert_id", "status")


@query("alerts", """SELECT status, count(*) AS before, count(*) FILTER (NOT starts_with(alert_id, '1')) AS after FROM alerts GROUP BY status""")
def reset_alerts(t):
    return A.reset_alerts(t.alerts, ("1",))[1]


@query("flows", """SELECT strftime(Timestamp, '%Y-%m-%d') AS time, flow_id, Dst_Port AS dst_port, CASE Protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE CAST(Protocol AS STRING) END AS protocol,
 CAST(Tot_Fwd_Pkts + Tot_Bwd_Pkts AS BIGINT) AS packets, CASE WHEN IsAttack = 1 THEN 'ATTACK' ELSE 'BENIGN' END AS status FROM flows""")
def flow_summary(t):
    rows = t.flows.withColumns({"Src_IP": F.lit("a"), "Dst_IP": F.lit("b"), "is_attack": F.col("IsAttack") == 1,
                                "attack_type": F.col("Label"), "severity": F.lit("x"), "confidence": F.lit(1.0)})
    out = A.flow_summary(rows, None, tie="flow_id")
    return out.select(day_text("time").alias("time"), "flow_id", "dst_port", "protocol", "packets", "status")


@query("", """SELECT concat('r', CAST(user_id AS STRING)) AS replay_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_time, arg_max(event_id, ts) AS flows_processed FROM events GROUP BY user_id""")
def record_run(t):
    """Repeated runs of the same id, the later ones forced over the first."""
    order = W.partitionBy("user_id").orderBy("ts")
    runs = t.events.select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("replay_id"), F.col("ts").alias("start_time"),
        F.col("event_id").alias("flows_processed"), F.row_number().over(order).alias("n"),
        F.lead("ts").over(order).isNull().alias("final"))
    first = runs.where("n = 1").drop("n", "final")
    again = runs.where("final").drop("n", "final")
    return T.record_run(again, first, force=True).withColumn("start_time", time_text("start_time"))


@query("", """SELECT concat('r', CAST(o_orderkey AS STRING)) AS replay_id, o_custkey AS flows_processed FROM orders ORDER BY o_orderdate DESC, replay_id LIMIT 25""")
def recent_runs(t):
    runs = t.orders.select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("replay_id"), F.col("o_orderdate").alias("start_time"),
                           F.col("o_custkey").alias("flows_processed"))
    return T.recent_runs(runs, 25).drop("start_time")


@query("alerts", "SELECT alert_id, round(confidence, 6) AS attack_probability FROM alerts ORDER BY confidence DESC, alert_id LIMIT 10")
def top_alerts(t):
    rows = t.alerts.withColumn("attack_probability", F.col("confidence"))
    return rounded(M.top_alerts(rows, 10).select("alert_id", "attack_probability"))


@query("", """SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey = 7""")
def lookup(t):
    return A.lookup(t.orders, "o_orderkey", 7).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


# ================================================================ SOC analytics

_WIN = "(SELECT max(created_at) FROM alerts) - INTERVAL 7 DAY"


SOC_SUMMARY_SQL = f"""WITH a AS (SELECT * FROM alerts WHERE created_at >= {_WIN}), i AS (SELECT * FROM cases WHERE created_at >= (SELECT max(created_at) FROM alerts) - INTERVAL 7 DAY),
 s AS (SELECT count(*) FILTER (status <> 'RESOLVED') AS o, count(*) FILTER (status = 'RESOLVED') AS r, round(avg(CASE WHEN status = 'RESOLVED' THEN (epoch_us(updated_at) - epoch_us(first_seen)) / 1000000.0 END), 1) AS m FROM i)
 SELECT '7d' AS "window", count(*) AS total_alerts, count(*) FILTER (status = 'NEW') AS active_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical_alerts,
 count(*) FILTER (severity = 'HIGH') AS high_alerts, count(*) FILTER (severity = 'MEDIUM') AS medium_alerts, count(*) FILTER (severity = 'LOW') AS low_alerts,
 (SELECT o FROM s) AS open_incidents, (SELECT r FROM s) AS resolved_incidents, round(avg(CASE WHEN attack_type <> 'BENIGN' THEN confidence END), 4) AS mean_confidence,
 round(count(*) / 10080.0, 2) AS alert_rate_per_min, round((SELECT o + r FROM s) / 10080.0, 2) AS incident_rate_per_min, round(count(*) / nullif((SELECT o + r FROM s), 0), 2) AS alert_to_incident_ratio,
 round(count(*) FILTER (attack_type <> 'BENIGN') / count(*), 4) AS attack_rate, (SELECT m FROM s) AS mttr_seconds FROM a"""


@query("alerts cases", SOC_SUMMARY_SQL)
def soc_summary(t):
    return O.soc_summary(t.alerts, t.cases, "7d")


@query("cases", """SELECT count(*) AS total_incidents, count(*) FILTER (status = 'NEW') AS open_incidents, count(*) FILTER (status = 'INVESTIGATING') AS investigating_incidents,
 count(*) FILTER (status = 'ESCALATED') AS escalated_incidents, count(*) FILTER (status = 'RESOLVED') AS resolved_incidents, count(*) FILTER (severity = 'CRITICAL') AS critical_incidents,
 count(*) FILTER (severity = 'HIGH') AS high_incidents, count(*) FILTER (severity = 'MEDIUM') AS medium_incidents, count(*) FILTER (severity = 'LOW') AS low_incidents,
 round(avg(alert_count), 1) AS avg_alerts_per_incident, round(avg(CASE WHEN status = 'RESOLVED' THEN (epoch_us(updated_at) - epoch_us(first_seen)) / 1000000.0 END), 1) AS mttr_seconds FROM cases""")
def incident_analytics(t):
    return O.incident_analytics(t.cases, "all")


@query("alerts", """SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H') AS bucket, count(*) AS total_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical,
 count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,
 count(*) FILTER (attack_type <> 'BENIGN') AS attack_alerts FROM alerts WHERE created_at >= (SELECT max(created_at) FROM alerts) - INTERVAL 24 HOUR GROUP BY 1""")
def activity_trends(t):
    return O.activity_trends(t.alerts, "24h").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


@query("alerts", """SELECT strftime(date_trunc('minute', event_time), '%Y-%m-%d %H:%M') AS minute, count(*) AS alert_count FROM alerts GROUP BY 1""")
def activity_per_minute(t):
    return O.activity_per_minute(t.alerts).withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query("alerts", """SELECT attack_type, count(*) AS count, round(avg(confidence), 4) AS mean_confidence, round(count(*) / sum(count(*)) OVER (), 4) AS fraction FROM alerts GROUP BY attack_type""")
def attack_distribution(t):
    return O.attack_distribution(t.alerts, "all")


@query("alerts", f"""SELECT l AS severity, (SELECT count(*) FROM alerts WHERE severity = l AND created_at >= {_WIN}) AS count FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) v(l)""")
def severity_distribution(t):
    return O.severity_distribution(t.alerts, "7d")


@query("alerts", """WITH e AS (SELECT 'source' AS kind, source_ip AS entity, severity, event_time FROM alerts UNION ALL SELECT 'destination', destination_ip, severity, event_time FROM alerts
 UNION ALL SELECT 'port', CAST(destination_port AS STRING), severity, event_time FROM alerts),
 g AS (SELECT kind, entity, count(*) AS alert_count, count(*) FILTER (severity = 'CRITICAL') AS critical_count, min(event_time) AS f, max(event_time) AS l FROM e WHERE entity IS NOT NULL AND entity <> '' GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY alert_count DESC, entity) AS rank FROM g)
 SELECT kind, entity, alert_count, critical_count, strftime(f, '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(l, '%Y-%m-%d %H:%M:%S.%f') AS last_seen, rank FROM r WHERE rank <= 10""")
def top_entities(t):
    out = O.top_entities(t.alerts, 10, "all")
    return out.withColumns({"first_seen": time_text("first_seen"), "last_seen": time_text("last_seen")})


@query("alerts", """WITH p AS (SELECT CASE WHEN upper(protocol) IN ('TCP', 'UDP', 'ICMP') THEN upper(protocol) ELSE 'OTHER' END AS p FROM alerts)
 SELECT n AS protocol, (SELECT count(*) FROM p WHERE p.p = n) AS count, round((SELECT count(*) FROM p WHERE p.p = n) / (SELECT count(*) FROM p), 4) AS fraction FROM (VALUES ('TCP'), ('UDP'), ('ICMP'), ('OTHER')) v(n)""")
def protocol_distribution(t):
    return O.protocol_distribution(t.alerts, "all")


@query("alerts", """SELECT s AS status, (SELECT count(*) FROM alerts WHERE status = s) AS count, s <> 'RESOLVED' AS active FROM (VALUES ('NEW'), ('INVESTIGATING'), ('ESCALATED'), ('RESOLVED')) v(s)""")
def status_counts(t):
    return O.status_counts(t.alerts)


@query("alerts", """SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical_alerts, count(*) FILTER (severity = 'HIGH') AS high_alerts,
 count(*) FILTER (severity = 'MEDIUM') AS medium_alerts, count(*) FILTER (severity = 'LOW') AS low_alerts, round(avg(confidence), 6) AS average_confidence, count(DISTINCT attack_type) AS attack_types FROM alerts""")
def alert_metrics(t):
    return rounded(O.alert_metrics(t.alerts))


@query("alerts", "SELECT severity, count(*) AS count FROM alerts GROUP BY severity")
def count_by_severity(t):
    return O.count_by(t.alerts, "severity")


@query("alerts", f"""WITH a AS (SELECT attack_type, confidence AS c FROM alerts WHERE created_at >= {_WIN}),
 m AS (SELECT count(*) AS n, count(*) FILTER (attack_type <> 'BENIGN') AS k, round(avg(c), 4) AS mc, count(*) FILTER (c < 0.6) AS low, quantile_cont(c, [0.25, 0.5, 0.75, 0.9, 0.99]) AS q,
 round(avg(CASE WHEN attack_type <> 'BENIGN' THEN c END), 4) AS mk FROM a)
 SELECT n AS inference_volume, round(n / 10080.0, 2) AS prediction_throughput_per_min, round(k / n, 4) AS attack_rate, round((n - k) / n, 4) AS benign_rate, mc AS mean_confidence, low AS low_confidence_count,
 round(q[1], 4) AS p25, round(q[2], 4) AS p50, round(q[3], 4) AS p75, round(q[4], 4) AS p90, round(q[5], 4) AS p99, k AS classification_volume, mk AS classification_mean_confidence,
 (SELECT string_agg(concat(attack_type, ':', CAST(x AS STRING)), ',' ORDER BY x DESC, attack_type) FROM (SELECT attack_type, count(*) AS x FROM a WHERE attack_type <> 'BENIGN' GROUP BY 1) y) AS kinds,
 round(mc - 0.945, 4) AS confidence_shift, round(round(k / n, 4) - 0.312, 4) AS attack_rate_shift,
 CASE WHEN abs(mc - 0.945) > 0.15 THEN 'CONFIDENCE_SHIFT_DETECTED' WHEN abs(k / n - 0.312) > 0.25 THEN 'ATTACK_RATE_SHIFT_DETECTED' ELSE 'NORMAL' END AS status FROM m""")
def model_monitor(t):
    out = O.model_monitor(t.alerts, "7d").drop("window")
    text = F.transform("attack_type_distribution", lambda x: F.concat(x.attack_type, F.lit(":"), x["count"].cast("string")))
    return out.withColumn("kinds", F.concat_ws(",", text)).drop("attack_type_distribution")


# ---------------------------------------------------------------- the same from a rollup

def _rollup(t) -> Rollup:
    """All alerts rolled up by a stream, a part a batch; a third of them first came as NEW and were restated."""
    first = F.when(F.pmod("seq", F.lit(3)) == 0, "NEW").otherwise(F.col("status"))
    rows = t.alerts.withColumn("status", first)
    path = new_path(t.spark, "alerts")
    rows.repartition(3).write.parquet(path)
    out = Rollup(t.spark, new_path(t.spark, "rollup"))
    feed = T.flow_stream(t.spark, path, rows.schema, files_per_trigger=1)
    ST.stream_rollup(feed, out, new_path(t.spark, "rollup-checkpoint"))
    changed = F.pmod("seq", F.lit(3)) == 0
    out.restate(rows.where(changed), t.alerts.where(changed), "restated")
    return out


@query("alerts cases", SOC_SUMMARY_SQL)
def rollup_soc_summary(t):
    return _rollup(t).window(t.alerts, "7d").soc_summary(t.cases)


@query("alerts", """SELECT 'severity' AS kind, severity AS name, count(*) AS count FROM alerts WHERE created_at >= (SELECT max(created_at) FROM alerts) - INTERVAL 7 DAY GROUP BY 2
 UNION ALL SELECT 'attack_type', attack_type, count(*) FROM alerts WHERE created_at >= (SELECT max(created_at) FROM alerts) - INTERVAL 24 HOUR GROUP BY 2
 UNION ALL SELECT 'protocol', CASE WHEN upper(protocol) IN ('TCP', 'UDP', 'ICMP') THEN upper(protocol) ELSE 'OTHER' END, count(*) FROM alerts GROUP BY 2
 UNION ALL SELECT 'bucket', strftime(date_trunc('hour', event_time), '%Y-%m-%d %H'), count(*) FROM alerts WHERE created_at >= (SELECT max(created_at) FROM alerts) - INTERVAL 24 HOUR GROUP BY 2""")
def rollup_distributions(t):
    """Four distributions over three windows, from the batches merged per day."""
    merged = _rollup(t).compact(new_path(t.spark, "merged"))
    day = merged.window(t.alerts, "24h")

    def part(kind, df, name):
        return df.where("count > 0").select(F.lit(kind).alias("kind"), F.col(name).alias("name"), "count")

    trends = day.activity_trends().select(F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), F.col("total_alerts").alias("count"))
    return (part("severity", merged.window(t.alerts, "7d").severity_distribution(), "severity")
            .unionAll(part("attack_type", day.attack_distribution(), "attack_type"))
            .unionAll(part("protocol", merged.window(t.alerts, "all").protocol_distribution(), "protocol"))
            .unionAll(part("bucket", trends, "bucket")))


@query("alerts", f"""WITH a AS (SELECT * FROM alerts WHERE created_at >= {_WIN}) SELECT count(*) AS inference_volume, count(*) FILTER (attack_type <> 'BENIGN') AS classification_volume,
 count(*) FILTER (confidence < 0.6) AS low_confidence_count, round(avg(confidence), 4) AS mean_confidence, true AS ranks_within, true AS distinct_within FROM a""")
def rollup_model_monitor(t):
    """The monitor from sketches; each percentile's true rank and the true number of sources are held against the stated errors."""
    window = _rollup(t).window(t.alerts, "7d")
    rows = O.in_window(t.alerts, "7d")
    found = materialise(window.model_monitor(), "monitor")
    seen = materialise(window.distinct_addresses(), "addresses")
    # A percentile is rounded to four digits, and equal values share a range of ranks.
    checks = []
    for name, p in O.PERCENTILES.items():
        value = found.select(name).scalar()
        below, upto = F.avg((F.col("confidence") < value - 0.0001).cast("double")), F.avg((F.col("confidence") <= value + 0.0001).cast("double"))
        checks.append((below - RANK_ERROR <= p) & (upto + RANK_ERROR >= p))
    true_sources = F.count_distinct(F.coalesce("source_ip", F.lit("")))
    near = F.abs(seen.select("sources").scalar() - true_sources) <= F.greatest(F.lit(1.0), true_sources * DISTINCT_ERROR)
    held = rows.agg(reduce(lambda a, b: a & b, checks).alias("ranks_within"), near.alias("distinct_within"))
    return found.select("inference_volume", "classification_volume", "low_confidence_count", "mean_confidence",
                        held.select("ranks_within").scalar().alias("ranks_within"), held.select("distinct_within").scalar().alias("distinct_within"))


def _cards(t) -> DataFrame:
    rows = t.scored.select(
        F.pmod("event_id", F.lit(20)).alias("batch"), (F.col("label") == 1).alias("gt_is_attack"), (F.col("prediction") == 1).alias("is_attack"),
        F.when(F.col("attack_probability") >= 0.9, "CRITICAL").otherwise("HIGH").alias("severity"), F.col("attack_probability").alias("confidence"),
        (F.col("event_id") % 2 == 0).alias("inserted"))
    return O.batch_scorecard(rows, batch="batch")


@query("scored", """SELECT event_id % 20 AS batch, count(*) AS total_flows, count(*) FILTER (label = 1) AS gt_attack_count, count(*) FILTER (label = 0) AS gt_benign_count,
 count(*) FILTER (prediction = 1) AS attack_count, count(*) FILTER (prediction = 0) AS benign_count, count(*) FILTER (event_id % 2 = 0) AS alerts_inserted,
 count(*) FILTER (prediction = 1 AND attack_probability >= 0.9) AS critical, count(*) FILTER (prediction = 1 AND attack_probability < 0.9) AS high, 0 AS medium, 0 AS low,
 round(avg(CASE WHEN prediction = 1 THEN attack_probability END), 6) AS average_confidence FROM scored GROUP BY 1""")
def batch_scorecard(t):
    return rounded(_cards(t))


@query("scored", """SELECT count(*) AS flows_processed, count(*) FILTER (label = 1) AS ground_truth_attacks, count(*) FILTER (prediction = 1) AS predicted_attacks,
 round(count(*) FILTER (label = 1) * 100.0 / count(*), 2) AS ground_truth_attack_rate_percent, round(count(*) FILTER (prediction = 1) * 100.0 / count(*), 2) AS predicted_attack_rate_percent,
 round(avg(CASE WHEN prediction = 1 THEN attack_probability END) * 100, 2) AS average_confidence_percent FROM scored""")
def stream_telemetry(t):
    return O.stream_telemetry(_cards(t)).select("flows_processed", "ground_truth_attacks", "predicted_attacks", "ground_truth_attack_rate_percent",
                                                "predicted_attack_rate_percent", "average_confidence_percent")


# ================================================================ intelligence and rules

@query("alerts indicators", """SELECT alert_id, coalesce(s.threat_name, d.threat_name) AS threat_name, round(coalesce(s.confidence, d.confidence), 4) AS intel_confidence
 FROM alerts a LEFT JOIN indicators s ON a.source_ip = s.indicator_value LEFT JOIN indicators d ON s.indicator_value IS NULL AND a.destination_ip = d.indicator_value""")
def match_indicators(t):
    out = N.match_indicators(t.alerts, t.indicators)
    return out.select("alert_id", F.col("intel.threat_name").alias("threat_name"), F.round("intel.confidence", 4).alias("intel_confidence"))


_TECH = """(VALUES ('SSH-Bruteforce', 'T1110', 'TA0006', 0.88), ('FTP-BruteForce', 'T1110', 'TA0006', 0.88), ('DoS attacks-Hulk', 'T1498', 'TA0040', 0.85), ('Bot', 'T1071', 'TA0011', 0.80)) m(l, te, ta, c)"""


@query("alerts", f"""SELECT attack_type, te AS technique_id, ta AS tactic_id, CASE WHEN te IS NULL THEN 'UNMAPPED' ELSE 'MAPPED' END AS mapping_status, CAST(coalesce(c, 0) AS DOUBLE) AS confidence, count(*) AS n
 FROM alerts LEFT JOIN {_TECH} ON attack_type = l GROUP BY ALL""")
def map_techniques(t):
    m = F.col("attack_mapping")
    out = N.map_techniques(t.alerts).select("attack_type", m["technique_id"].alias("technique_id"), m["tactic_id"].alias("tactic_id"),
                                            m["mapping_status"].alias("mapping_status"), m["confidence"].alias("confidence"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query("alerts", f"""SELECT count(DISTINCT attack_type) AS mapped_detections, count(DISTINCT ta) AS mapped_tactics_count, count(DISTINCT te) AS mapped_techniques_count,
 string_agg(DISTINCT ta, ',' ORDER BY ta) AS tactics, string_agg(DISTINCT te, ',' ORDER BY te) AS techniques FROM alerts JOIN {_TECH} ON attack_type = l""")
def technique_coverage(t):
    """Coverage of the techniques the alerts actually show."""
    seen = t.alerts.select("attack_type").distinct()
    out = N.technique_coverage(N.techniques(t.spark).join(seen, "attack_type"))
    return out.select("mapped_detections", "mapped_tactics_count", "mapped_techniques_count", joined("tactics").alias("tactics"), joined("techniques").alias("techniques"))


_SUBMITTED = """SELECT CASE event_id % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'URL' ELSE 'hash' END AS k,
 CASE event_id % 4 WHEN 0 THEN concat('10.', CAST(event_id % 300 AS STRING), '.0.1') WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 'no_domain' ELSE concat('host', CAST(user_id AS STRING), '.example.com') END
 WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'example.com/a' ELSE concat('http://example.com/', CAST(user_id AS STRING)) END
 ELSE CASE WHEN event_id % 3 = 0 THEN 'xyz' ELSE md5(CAST(user_id AS STRING)) END END AS v, event_id, ts, event_type, value FROM {events}"""
_VALID = """CASE event_id % 4 WHEN 0 THEN event_id % 300 <= 255 ELSE event_id % 3 <> 0 END"""


@query("", f"SELECT event_id, {_VALID} AS valid FROM ({_SUBMITTED.format(events='events')}) x")
def validate_indicators(t):
    rows = t.spark.sql(_SUBMITTED, events=t.events)
    return N.validate_indicators(rows, "k", "v").select("event_id", "valid")


@query("", f"""WITH s AS (SELECT *, upper(k) AS t FROM ({_SUBMITTED.format(events='events')}) x WHERE {_VALID})
 SELECT concat('IND-', upper(md5(concat(t, ':', v)))) AS indicator_id, t AS indicator_type, v AS indicator_value, arg_max(event_type, ts) AS threat_name,
 strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM s GROUP BY t, v""")
def upsert_indicators(t):
    """Submissions in two deliveries; repeats refresh the stored indicator."""
    rows = t.spark.sql(_SUBMITTED, events=t.events).select(
        F.col("k").alias("indicator_type"), F.col("v").alias("indicator_value"), F.col("event_type").alias("threat_name"), F.col("ts").alias("observed_at"), "event_id")
    first = N.upsert_indicators(None, N.prepare_indicators(rows.where("event_id % 2 = 0")))
    out = N.upsert_indicators(first, N.prepare_indicators(rows.where("event_id % 2 = 1")))
    return out.select("indicator_id", "indicator_type", "indicator_value", "threat_name", time_text("first_seen").alias("first_seen"), time_text("last_seen").alias("last_seen"))


@query("alerts indicators", "SELECT indicator_id FROM indicators WHERE indicator_value NOT IN (SELECT source_ip FROM alerts WHERE source_ip IS NOT NULL AND severity = 'CRITICAL')")
def remove_indicators(t):
    """Indicators left after removing those seen as the source of a critical alert."""
    hit = t.alerts.where("severity = 'CRITICAL'").select(F.col("source_ip").alias("indicator_value")).distinct()
    gone = t.indicators.join(hit, "indicator_value").select("indicator_id")
    return N.remove_indicators(t.indicators, gone).select("indicator_id")


@query("indicators", "SELECT indicator_id, indicator_value FROM indicators ORDER BY threat_name DESC, indicator_id LIMIT 10")
def list_indicators(t):
    rows = t.indicators.withColumn("created_at", F.col("threat_name"))
    return N.list_indicators(rows, "ip", 10).select("indicator_id", "indicator_value")


_COUNTS = f"""c AS (SELECT *, upper(attack_type) AS u FROM alerts),
 n AS (SELECT alert_id, source_ip, severity, u,
 CASE WHEN u LIKE '%SSH%' THEN CASE WHEN source_ip IS NULL THEN count(*) FILTER (u LIKE '%SSH%') OVER g ELSE count(*) FILTER (u LIKE '%SSH%') OVER s END ELSE 0 END AS ssh_count,
 CASE WHEN u LIKE '%FTP%' THEN CASE WHEN source_ip IS NULL THEN count(*) FILTER (u LIKE '%FTP%') OVER g ELSE count(*) FILTER (u LIKE '%FTP%') OVER s END ELSE 0 END AS ftp_count,
 CASE WHEN severity = 'CRITICAL' THEN CASE WHEN source_ip IS NULL THEN count(*) FILTER (severity = 'CRITICAL') OVER g ELSE count(*) FILTER (severity = 'CRITICAL') OVER s END ELSE 0 END AS critical_count,
 CASE WHEN u LIKE '%DOS%' THEN count(*) FILTER (u LIKE '%DOS%') OVER g ELSE 0 END AS dos_count FROM c
 WINDOW g AS (ORDER BY event_time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), s AS (PARTITION BY source_ip ORDER BY event_time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))"""
_CONFIG = {"correlation_window_seconds": DAY}


@query("alerts", f"WITH {_COUNTS} SELECT alert_id, ssh_count, ftp_count, critical_count, dos_count FROM n")
def rule_counters(t):
    return D.rule_counters(t.alerts, DAY).select("alert_id", "ssh_count", "ftp_count", "critical_count", "dos_count")


_MATCHES = """r AS (SELECT alert_id, 'RULE-001' AS rule_id, 'HIGH' AS severity FROM n WHERE ssh_count >= 3 UNION ALL SELECT alert_id, 'RULE-002', 'HIGH' FROM n WHERE ftp_count >= 3
 UNION ALL SELECT alert_id, 'RULE-003', 'CRITICAL' FROM n WHERE dos_count >= 5 UNION ALL SELECT alert_id, 'RULE-004', 'CRITICAL' FROM n WHERE critical_count >= 3
 UNION ALL SELECT alert_id, 'RULE-005', i.severity FROM n JOIN indicators i ON n.source_ip = i.indicator_value)"""


@query("alerts indicators", f"WITH {_COUNTS}, {_MATCHES} SELECT * FROM r")
def evaluate_rules(t):
    return D.evaluate_rules(t.alerts, t.indicators, _CONFIG).select("alert_id", "rule_id", "severity")


@query("alerts indicators", f"""WITH {_COUNTS}, {_MATCHES}, k AS (SELECT alert_id, count(*) AS m FROM r GROUP BY alert_id)
 SELECT a.alert_id, round(a.confidence, 6) AS model_confidence, a.severity AS model_severity, i.indicator_id IS NOT NULL AS intel_match, i.threat_name AS intel_threat_name, coalesce(k.m, 0) AS rules_triggered_count,
 te AS technique_id FROM alerts a LEFT JOIN indicators i ON a.source_ip = i.indicator_value LEFT JOIN k ON a.alert_id = k.alert_id LEFT JOIN {_TECH} ON a.attack_type = l""")
def enrich_alerts(t):
    out = D.enrich_alerts(t.alerts, t.indicators, _CONFIG)
    return out.select("alert_id", F.round("model_confidence", 6).alias("model_confidence"), "model_severity", "intel_match", "intel_threat_name", "rules_triggered_count",
                      F.col("attack_mapping.technique_id").alias("technique_id"))


# ================================================================ incidents

@query("alerts cases", """SELECT c.incident_id, count(*) AS n, string_agg(DISTINCT a.attack_type, ',' ORDER BY a.attack_type) AS attack_types, count(*) FILTER (severity = 'CRITICAL') AS criticals
 FROM (SELECT concat('INC-', CAST(user_id AS STRING), '-', event_type) AS incident_id, CAST(event_id AS STRING) AS alert_id FROM events) c JOIN alerts a USING (alert_id) GROUP BY 1""")
def incident_alerts(t):
    links = t.events.select(F.concat(F.lit("INC-"), F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("incident_id"), F.col("event_id").cast("string").alias("alert_id"))
    kinds = I.incident_attack_types(t.alerts, links).select("incident_id", joined("attack_types").alias("attack_types"))
    return I.incident_alerts(t.alerts, links).groupBy("incident_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("criticals")).join(kinds, "incident_id")


def _correlated(t, hours: int = 6) -> DataFrame:
    return I.correlate(t.alerts, hours * 3600, strict=False)


# Sequential correlation in SQL: the i-th alert of every population meets the incidents left open by the one before, a list
# ordered by last alert. Alerts with and without a source are populations of their own.
_FOLD = """e AS (SELECT *, coalesce(source_ip, '') AS pop, epoch_us(event_time) AS us, CASE WHEN source_ip IS NULL THEN [] ELSE [source_ip] END AS src, [destination_ip] AS dst,
 CASE WHEN destination_port IS NULL THEN [] ELSE [CAST(destination_port AS INT)] END AS port,
 row_number() OVER (PARTITION BY coalesce(source_ip, '') ORDER BY event_time, alert_id) AS rn FROM alerts WHERE attack_type <> 'BENIGN'),
 fold(pop, rn, alert_id, incident_id, opened) AS (
 SELECT DISTINCT pop, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST([] AS STRUCT(id VARCHAR, kind VARCHAR, last BIGINT, src VARCHAR[], dst VARCHAR[], port INTEGER[])[]) FROM e
 UNION ALL SELECT pop, rn, alert_id, one.id, list_append(list_filter(opened, lambda x: x.id <> one.id AND x.last >= us - 21600000000), one) FROM (
  SELECT pop, rn, alert_id, us, opened, CASE WHEN m IS NULL THEN {'id': concat('INC-', strftime(event_time, '%Y%m%d'), '-', upper(md5(alert_id))), 'kind': attack_type, 'last': us, 'src': src, 'dst': dst, 'port': port}
   ELSE {'id': m.id, 'kind': m.kind, 'last': us, 'src': list_distinct(list_concat(m.src, src)), 'dst': list_distinct(list_concat(m.dst, dst)), 'port': list_distinct(list_concat(m.port, port))} END AS one FROM (
   SELECT e.*, f.opened, list_filter(f.opened, lambda x: e.us - x.last <= 21600000000 AND (len(e.src) = 0 OR len(x.src) = 0 OR list_has_any(x.src, e.src)) AND (
    (list_has_any(x.src, e.src) AND (x.kind = e.attack_type OR list_has_any(x.dst, e.dst) OR list_has_any(x.port, e.port))) OR
    (list_has_any(x.dst, e.dst) AND (x.kind = e.attack_type OR list_has_any(x.port, e.port))) OR (x.kind = e.attack_type AND list_has_any(x.port, e.port))))[-1] AS m
   FROM fold f JOIN e ON e.pop = f.pop AND e.rn = f.rn + 1) y) z),
 linked AS (SELECT f.incident_id, a.*, epoch_us(a.event_time) AS us FROM fold f JOIN alerts a ON a.alert_id = f.alert_id)"""


# The same over one population: an alert without a source may join any incident, an incident without one any alert.
_STRICT_FOLD = _FOLD.replace("coalesce(source_ip, '') AS pop", "'' AS pop").replace("PARTITION BY coalesce(source_ip, '') ORDER", "ORDER")


def _folded(sql: str, views: str = "alerts", more: str = "", fold: str = _FOLD) -> str:
    return oracle(views, f"WITH {fold}{more} {sql}").replace("WITH ", "WITH RECURSIVE ", 1)


def query_on_fold(sql: str, views: str = "alerts", more: str = "", fold: str = _FOLD):
    def add(fn):
        fn = query()(fn)
        ORACLES[fn.__name__] = _folded(sql, views, more, fold)
        return fn

    return add


_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


@query_on_fold(f"SELECT incident_id, alert_id, {_STAMP.format('event_time')} AS added_at FROM linked")
def correlate(t):
    """Order-dependent grouping of every attack alert."""
    return I.incident_links(_correlated(t)).withColumn("added_at", time_text("added_at"))


@query_on_fold(f"SELECT incident_id, alert_id, {_STAMP.format('event_time')} AS added_at FROM linked", fold=_STRICT_FOLD)
def correlate_strict(t):
    """All alerts as one population, in slices of 1,000 bursts folded at once."""
    return I.incident_links(I.correlate(t.alerts, 21_600, max_group=1_000)).withColumn("added_at", time_text("added_at"))


@query_on_fold(f"""SELECT incident_id, concat(fl, ' Incident: ', fk, CASE WHEN coalesce(fp, 0) <> 0 THEN concat(' on Port ', CAST(fp AS VARCHAR)) ELSE '' END) AS title, 'NEW' AS status, severity,
 CAST(CASE severity WHEN 'CRITICAL' THEN 80 WHEN 'HIGH' THEN 60 WHEN 'MEDIUM' THEN 40 ELSE 20 END + least(20.0, (n - 1) * 3.0) + least(15.0, (kinds - 1) * 5.0)
 + CASE WHEN lu - fu >= 60000000 THEN 5 ELSE 0 END AS DOUBLE) AS points, round(conf, 6) AS confidence, {_STAMP.format('ft')} AS first_seen, {_STAMP.format('lt')} AS last_seen, n AS alert_count, fk AS primary_attack_type,
 src AS source_entities, dst AS destination_entities, ports AS destination_ports, protocols, 'Unassigned' AS assigned_to,
 CASE WHEN n > 1 THEN concat('Incident correlated ', CAST(n AS VARCHAR), ' alerts covering ', CAST(kinds AS VARCHAR), ' attack types.')
 ELSE concat('Security Incident created for ', fk, ' alert on interface/port ', CASE WHEN coalesce(fp, 0) <> 0 THEN CAST(fp AS VARCHAR) ELSE 'N/A' END, '.') END AS summary FROM g""", more=""",
 g AS (SELECT incident_id, count(*) AS n, count(DISTINCT attack_type) AS kinds, min(us) AS fu, max(us) AS lu, min(event_time) AS ft, max(event_time) AS lt,
 CASE max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 first(severity ORDER BY us, alert_id) AS fl, first(attack_type ORDER BY us, alert_id) AS fk, first(destination_port ORDER BY us, alert_id) AS fp, last(confidence ORDER BY us, alert_id) AS conf,
 coalesce(string_agg(DISTINCT source_ip, ',' ORDER BY source_ip), '') AS src, string_agg(DISTINCT destination_ip, ',' ORDER BY destination_ip) AS dst, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols,
 coalesce(array_to_string(list_sort(list_distinct(list(destination_port) FILTER (destination_port IS NOT NULL))), ','), '') AS ports FROM linked GROUP BY incident_id)""")
def build_incidents(t):
    """The points of the score without its rounded share for confidence, which `risk_score` compares."""
    part = F.col("risk_factors")
    out = I.build_incidents(_correlated(t)).withColumns({
        "points": part.base_score + part.volume_bonus + part.diversity_bonus + part.duration_bonus,
        "confidence": F.round(part.confidence, 6)}).drop("risk_factors", "risk_score", "created_at", "updated_at")
    sets = ("source_entities", "destination_entities", "destination_ports", "protocols")
    return out.withColumns({c: time_text(c) for c in ("first_seen", "last_seen")} | {c: joined(c) for c in sets})


@query("alerts", """WITH a AS (SELECT *, epoch_us(event_time) AS us FROM alerts WHERE attack_type <> 'BENIGN'),
 g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 21600000000 THEN 0 ELSE 1 END AS n FROM a WHERE destination_port IS NOT NULL WINDOW w AS (PARTITION BY attack_type, destination_port ORDER BY us, alert_id)),
 s AS (SELECT *, sum(n) OVER (PARTITION BY attack_type, destination_port ORDER BY us, alert_id) AS k FROM g),
 f AS (SELECT *, first_value(alert_id) OVER w AS fa, first_value(event_time) OVER w AS ft FROM s WINDOW w AS (PARTITION BY attack_type, destination_port, k ORDER BY us, alert_id))
 SELECT alert_id, concat('INC-', strftime(ft, '%Y%m%d'), '-', upper(md5(fa))) AS incident_id FROM f
 UNION ALL SELECT alert_id, concat('INC-', strftime(event_time, '%Y%m%d'), '-', upper(md5(alert_id))) FROM a WHERE destination_port IS NULL""")
def correlate_without_addresses(t):
    """Alerts as the scoring path makes them, without addresses: sessions per type and port."""
    none = F.lit(None).cast("string")
    rows = t.alerts.withColumns({"source_ip": none, "destination_ip": none})
    return I.correlate(rows, 21_600, strict=False).select("alert_id", "incident_id")


@query("alerts", """WITH a AS (SELECT *, epoch_us(event_time) AS us FROM alerts WHERE attack_type <> 'BENIGN' AND source_ip IS NOT NULL),
 g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY source_ip ORDER BY us, alert_id) <= 21600000000 THEN 0 ELSE 1 END AS n FROM a)
 SELECT source_ip, CAST(sum(n) AS BIGINT) AS islands, count(*) AS alerts FROM g GROUP BY source_ip""")
def source_islands(t):
    from packetloom.plans.sessions import assign_sessions

    rows = t.alerts.where("attack_type <> 'BENIGN' AND source_ip IS NOT NULL").withColumn("us", V.micros("event_time"))
    out = assign_sessions(rows, ["source_ip"], "us", "alert_id", 21_600_000_000, slice_us=3_600_000_000)
    return out.groupBy("source_ip").agg(F.count_distinct("session_ts", "session_seq").alias("islands"), F.count("*").alias("alerts"))


@query_on_fold(f"""SELECT upper(md5(concat(incident_id, '|', k, '|', CASE k WHEN 'INCIDENT_CREATED' THEN 'CREATED' ELSE alert_id END, '|', CAST(us AS VARCHAR)))) AS event_key, incident_id,
 {_STAMP.format('event_time')} AS timestamp, k AS event_type, 'SYSTEM' AS actor, CASE k WHEN 'INCIDENT_CREATED' THEN concat('Incident created from alert ', alert_id, ' (', attack_type, ').')
 ELSE concat('Correlated alert ', alert_id, ' (', attack_type, ') to incident ', incident_id, '.') END AS description, concat(alert_id, ',', attack_type, ',', severity) AS details FROM h""", more=""",
 h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY incident_id ORDER BY us, alert_id) = 1 THEN 'INCIDENT_CREATED' ELSE 'ALERT_CORRELATED' END AS k FROM linked)""")
def incident_timeline(t):
    out = I.incident_timeline(_correlated(t))
    facts = F.concat_ws(",", *[F.col("details")[k] for k in ("alert_id", "attack_type", "severity")])
    return out.withColumns({"timestamp": time_text("timestamp"), "details": facts,
                            "event_key": F.upper(F.substring("event_id", 5, 32))}).drop("event_id")


@query_on_fold("""SELECT incident_id, intel_match_count, threat_names, intel_sources, intel_confidence, rules_triggered_count, CASE WHEN intel_match_count > 0 THEN 'HIGH' ELSE 'NONE' END AS intel_severity FROM (
 SELECT l.incident_id, count(i.indicator_id) AS intel_match_count, coalesce(string_agg(DISTINCT i.threat_name, ',' ORDER BY i.threat_name), '') AS threat_names,
 coalesce(string_agg(DISTINCT i.source, ',' ORDER BY i.source), '') AS intel_sources, coalesce(max(i.confidence), 0.0) AS intel_confidence, CAST(sum(coalesce(k.m, 0)) AS BIGINT) AS rules_triggered_count
 FROM linked l LEFT JOIN indicators i ON l.source_ip = i.indicator_value LEFT JOIN k ON k.alert_id = l.alert_id GROUP BY 1) y""", "alerts indicators", f""", {_COUNTS.replace("FROM alerts", "FROM linked")}, {_MATCHES},
 k AS (SELECT alert_id, count(*) AS m FROM r GROUP BY alert_id)""")
def incident_intel(t):
    enriched = D.enrich_alerts(_correlated(t), t.indicators, _CONFIG)
    out = I.incident_intel(enriched)
    return out.withColumns({c: joined(c) for c in ("threat_names", "intel_sources")})


_CHANGES = """SELECT concat('INC-', CAST(user_id AS STRING), '-', event_type) AS incident_id, ts AS changed_at,
 CASE event_id % 6 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'REOPEN' WHEN 2 THEN 'ESCALATED' WHEN 3 THEN 'LOST' ELSE 'INVESTIGATING' END AS status, concat('analyst-', CAST(event_id % 9 AS STRING)) AS assigned_to FROM {events}"""


@query("cases", f"""WITH c AS (SELECT incident_id, arg_max(status, (changed_at, status)) AS s FROM ({_CHANGES.format(events='events')}) x WHERE status <> 'LOST' GROUP BY 1)
 SELECT incident_id, CASE WHEN s = 'REOPEN' THEN 'NEW' ELSE coalesce(s, status) END AS status FROM cases LEFT JOIN c USING (incident_id)""")
def apply_status(t):
    changes = t.spark.sql(_CHANGES, events=t.events)
    return I.apply_status(t.cases, changes).select("incident_id", "status")


@query("cases", f"""SELECT incident_id, arg_max(assigned_to, changed_at) AS assigned_to FROM ({_CHANGES.format(events='events')}) x JOIN cases USING (incident_id) GROUP BY 1""")
def apply_assignment(t):
    changes = t.spark.sql(_CHANGES, events=t.events)
    rows = t.cases.withColumn("assigned_to", F.lit("Unassigned"))
    return I.apply_assignment(rows, changes).select("incident_id", "assigned_to")


@query("cases", """SELECT incident_id, severity, status FROM cases WHERE status = 'NEW' AND severity = 'HIGH' ORDER BY alert_count DESC, last_seen DESC, incident_id LIMIT 50""")
def incident_filter(t):
    rows = t.cases.withColumn("risk_score", F.col("alert_count").cast("double"))
    return I.incident_filter(rows, "new", "high", 50).select("incident_id", "severity", "status")


# ================================================================ packets and flows

_TIMEOUT = 10_800
_FLOW = """q AS (SELECT *, src_ip = '192.168.1.1' AS rev, epoch_us(packet_time) AS us, CASE WHEN src_ip = '192.168.1.1' THEN dst_ip ELSE src_ip END AS host FROM packets),
 b AS (SELECT *, lag(us) OVER w AS p, lag(fin) OVER w AS pf FROM q WINDOW w AS (PARTITION BY host ORDER BY us, seq)),
 c AS (SELECT *, CASE WHEN p IS NULL OR pf OR us - p > 10800000000 THEN 1 ELSE 0 END AS n FROM b),
 d AS (SELECT *, sum(n) OVER (PARTITION BY host ORDER BY us, seq) AS k FROM c),
 e AS (SELECT *, first_value(rev) OVER w AS frev, first_value(seq) OVER w AS fseq, CASE WHEN n = 1 THEN NULL ELSE us - p END AS gap, last_value(fin) OVER (PARTITION BY host, k ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ended FROM d WINDOW w AS (PARTITION BY host, k ORDER BY us, seq)),
 f AS (SELECT *, rev = frev AS fwd, us - lag(us) OVER (PARTITION BY host, k, rev = frev ORDER BY us, seq) AS sgap, row_number() OVER (PARTITION BY host, k, rev = frev ORDER BY us, seq) AS sn FROM e)"""


@query("packets", f"WITH {_FLOW} SELECT seq, fseq AS flow_seq, fwd AS forward FROM f")
def assign_flows(t):
    rows = FL.assign_flows(t.packets, _TIMEOUT)
    first = F.min_by("from_a", "seq").over(W.partitionBy(*FL.KEY, "flow_start", "flow_seq"))
    return rows.select("seq", "flow_seq", (F.col("from_a") == first).alias("forward"))


@query("packets", f"""WITH {_FLOW} SELECT fseq AS flow_seq, bool_or(ended) AS terminated, count(*) AS packet_count, any_value(CASE WHEN frev THEN '192.168.1.1' ELSE host END) AS Src_IP,
 CAST(max(us) - min(us) AS DOUBLE) AS Flow_Duration, CAST(count(*) FILTER (fwd) AS DOUBLE) AS Tot_Fwd_Pkts, CAST(count(*) FILTER (NOT fwd) AS DOUBLE) AS Tot_Bwd_Pkts,
 CAST(sum(pkt_len) FILTER (fwd) AS DOUBLE) AS TotLen_Fwd_Pkts, round(coalesce(avg(pkt_len) FILTER (NOT fwd), 0), 3) AS Bwd_Pkt_Len_Mean, round(stddev_pop(pkt_len), 3) AS Pkt_Len_Std,
 round(coalesce(stddev_pop(pkt_len) FILTER (fwd), 0), 3) AS Fwd_Pkt_Len_Std,
 round(sum(gap) / count(*), 3) AS Flow_IAT_Mean, round(stddev_pop(coalesce(gap, 0)) / 1000000, 3) AS Flow_IAT_Std, CAST(max(coalesce(gap, 0)) AS DOUBLE) AS Flow_IAT_Max,
 round(stddev_pop(CASE WHEN fwd THEN coalesce(sgap, 0) END) / 1000000, 3) AS Fwd_IAT_Std, CAST(coalesce(sum(sgap) FILTER (NOT fwd), 0) AS DOUBLE) AS Bwd_IAT_Tot,
 round(coalesce(stddev_pop(CASE WHEN NOT fwd THEN sgap END), 0) / 1000000, 3) AS Bwd_IAT_Std, CAST(coalesce(min(sgap) FILTER (NOT fwd), 0) AS DOUBLE) AS Bwd_IAT_Min,
 CAST(count(*) FILTER (psh AND fwd) AS DOUBLE) AS Fwd_PSH_Flags, CAST(count(*) FILTER (syn) AS DOUBLE) AS SYN_Flag_Cnt, CAST(count(*) FILTER (fin) AS DOUBLE) AS FIN_Flag_Cnt,
 CAST(max(CASE WHEN fwd AND sn = 1 THEN win_bytes END) AS DOUBLE) AS Init_Fwd_Win_Byts, CAST(coalesce(max(CASE WHEN NOT fwd AND sn = 1 THEN win_bytes END), 0) AS DOUBLE) AS Init_Bwd_Win_Byts,
 CAST(count(*) FILTER (fwd AND payload_len > 0) AS DOUBLE) AS Fwd_Act_Data_Pkts, round(coalesce(avg(gap) FILTER (gap > 1000000), 0) / 1000000, 3) AS Idle_Mean,
 CAST(hour(min(packet_time)) AS DOUBLE) AS "Hour", CAST(dayofweek(min(packet_time)) + 1 AS DOUBLE) AS "DayOfWeek" FROM f GROUP BY host, k, fseq""".replace("round(sum(gap) / count(*), 3)", "round(coalesce(sum(gap), 0) / count(*), 3)"))
def flow_features(t):
    out = FL.flow_features(t.packets, _TIMEOUT)
    # compared in seconds: the engines' deviations differ in the last digits of the microseconds
    seconds = ["Flow_IAT_Std", "Fwd_IAT_Std", "Bwd_IAT_Std", "Idle_Mean"]
    digits = {"Bwd_Pkt_Len_Mean": 3, "Pkt_Len_Std": 3, "Fwd_Pkt_Len_Std": 3, "Flow_IAT_Mean": 3, "Bwd_IAT_Tot": 0, "TotLen_Fwd_Pkts": 0}
    keep = ["flow_seq", "terminated", "packet_count", "Src_IP", "Flow_Duration", "Tot_Fwd_Pkts", "Tot_Bwd_Pkts", "Flow_IAT_Max", "Bwd_IAT_Min", "Fwd_PSH_Flags", "SYN_Flag_Cnt",
            "FIN_Flag_Cnt", "Init_Fwd_Win_Byts", "Init_Bwd_Win_Byts", "Fwd_Act_Data_Pkts", "Hour", "DayOfWeek"]
    return out.select(*keep, *[F.round(c, d).alias(c) for c, d in digits.items()], *[F.round(F.col(c) / 1000000, 3).alias(c) for c in seconds])


@query("packets", f"""WITH {_FLOW}, g AS (SELECT count(*) AS n, bool_or(ended) AS e, max(us) AS l FROM f GROUP BY host, k), x AS (SELECT *, e OR (SELECT max(l) FROM g) - l > 10800000000 AS done FROM g)
 SELECT CAST(sum(n) AS BIGINT) AS packets, count(*) AS flows_created, count(*) FILTER (done) AS flows_completed, count(*) FILTER (NOT done) AS flows_active FROM x""")
def flow_counters(t):
    return FL.flow_counters(FL.flow_features(t.packets, _TIMEOUT), timeout=_TIMEOUT)


@query("packets", f"""WITH {_FLOW}, g AS (SELECT fseq, bool_or(ended) AS e, max(us) AS l FROM f GROUP BY host, k, fseq)
 SELECT fseq AS flow_seq FROM g WHERE NOT e AND (SELECT max(l) FROM g WHERE NOT e) - l > 10800000000""")
def expire_flows(t):
    return FL.expire_flows(FL.flow_features(t.packets, _TIMEOUT), timeout=_TIMEOUT).select("flow_seq")


# ================================================================ sampling

_UNIT = "(CAST('0x' || substr(md5(concat('{seed}|', CAST({key} AS STRING))), 1, 8) AS BIGINT))"


@query("flows", f"""SELECT flow_id, {_UNIT.format(seed=42, key='flow_id')} / 4294967296.0 < 0.8 AS train, count(*) AS n FROM flows GROUP BY ALL""")
def split_by_hash(t):
    a, b = S.split_by_hash(t.flows, ["flow_id"])
    both = a.withColumn("train", F.lit(True)).unionByName(b.withColumn("train", F.lit(False)))
    return both.groupBy("flow_id", "train").agg(F.count("*").alias("n"))


@query("flows", f"""WITH c AS (SELECT Label, count(*) AS n FROM flows GROUP BY Label), r AS (SELECT Label, least(1.0, least(CAST(n AS DOUBLE), greatest(100.0, n * 5000.0 / (SELECT sum(n) FROM c))) / n) AS q FROM c)
 SELECT Label, count(*) AS n, CAST(sum(flow_id) AS BIGINT) AS ids FROM flows JOIN r USING (Label) WHERE {_UNIT.format(seed=42, key='flow_id')} / 4294967296.0 < q GROUP BY Label""")
def stratified_sample(t):
    out = S.stratified_sample(t.flows, "Label", ["flow_id"], target=5000, floor=100)
    return out.groupBy("Label").agg(F.count("*").alias("n"), F.sum("flow_id").alias("ids"))


@query("scored", f"""WITH r AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY {_UNIT.format(seed=7, key='event_id')}, event_id) AS k FROM scored)
 SELECT event_id, label FROM r WHERE k <= 500""")
def balanced_sample(t):
    return S.balanced_sample(t.scored, 1000, ["event_id"], label="label", seed=7).select("event_id", "label")


@query("scored", f"""WITH r AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY {_UNIT.format(seed=11, key='event_id')}, event_id) AS k FROM scored)
 SELECT event_id, label FROM r WHERE k <= CASE WHEN label = 1 THEN 300 ELSE 700 END""")
def ratio_sample(t):
    return S.ratio_sample(t.scored, 1000, 0.3, ["event_id"], label="label", seed=11).select("event_id", "label")


@query("flows", """WITH s AS (SELECT CASE WHEN flow_id % 5 < 4 THEN 'train' ELSE 'test' END AS split, Label FROM flows WHERE NOT (flow_id % 5 >= 4 AND Label IN ('Bot', 'SQL Injection')))
 SELECT x.split, c.Label AS class_name FROM (SELECT DISTINCT Label FROM s) c, (VALUES ('train'), ('test')) x(split) EXCEPT SELECT DISTINCT split, Label FROM s""")
def missing_classes(t):
    train = t.flows.where("flow_id % 5 < 4")
    test = t.flows.where("flow_id % 5 >= 4 AND Label NOT IN ('Bot', 'SQL Injection')")
    return S.missing_classes({"train": train, "test": test}, "Label")


@query("", "SELECT l_returnflag AS g, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem")
def number_rows_in_large_groups(t):
    rows = t.lineitem.withColumnRenamed("l_returnflag", "g")
    out = number_rows(rows, ["g"], "l_orderkey", "n", ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return out.select("g", "l_orderkey", "l_linenumber", "l_partkey", "n")


# ================================================================ models

# What the flow table has, and the calendar of its time; no feature is derived from a label.
_MODEL_FEATURES = ["Dst_Port", "Protocol", "Hour", "Flow_Duration", "Tot_Fwd_Pkts", "Tot_Bwd_Pkts", "TotLen_Fwd_Pkts", "TotLen_Bwd_Pkts", "Flow_Byts_per_s", "Flow_Pkts_per_s",
                   "Year", "Month", "DayOfWeek"]
TRAIN_ROWS, TRAIN_FLOOR = 20_000, 500  # bound on labelled rows a forest is trained on, and the least of a class
TRAIN_PARTITIONS = 8  # bags are drawn per partition: a fixed layout trains the same forest on any cluster
_TRAINED: dict[tuple[str, str], tuple] = {}


def model_rows(t) -> DataFrame:
    """Flow rows with clean features and both targets."""
    at = F.col("Timestamp")
    rows = t.flows.withColumns({"Year": F.year(at).cast("double"), "Month": F.month(at).cast("double"), "DayOfWeek": F.dayofweek(at).cast("double")})
    return C.sanitise_numeric(rows, _MODEL_FEATURES).withColumns({
        "stage1_label": F.col("IsAttack").cast("double"), "attack_label": F.col("Label")})


def held_out(t) -> DataFrame:
    return S.split_by_hash(model_rows(t), ["flow_id"])[1]


def trained(t):
    """Detector and classifier at their full settings, trained once for each application and folder."""
    key = (t.spark.sparkContext.applicationId, t.dir)
    if key not in _TRAINED:
        train, _ = S.split_by_hash(model_rows(t), ["flow_id"])
        sample = S.stratified_sample(train, "attack_label", ["flow_id"], target=TRAIN_ROWS, floor=TRAIN_FLOOR)
        sample = materialise(sample.repartition(TRAIN_PARTITIONS, "flow_id").sortWithinPartitions("flow_id"), "training-sample")
        _TRAINED[key] = M.train_detector(sample, _MODEL_FEATURES), M.train_classifier(sample, _MODEL_FEATURES)
    return _TRAINED[key]


_TEST = f"{_UNIT.format(seed=42, key='flow_id')} / 4294967296.0 >= 0.8"


@query("flows", """SELECT flow_id, Label, true AS consistent FROM flows""")
def score_two_stage(t):
    """All flows. What SQL cannot know is checked by the rules that bind a verdict: a benign one has
    no class and no second confidence, an attack a known class and the product of both confidences; severity follows."""
    detector, classifier = trained(t)
    out = M.score_two_stage(model_rows(t), detector, classifier, partitions=t.spark.sparkContext.defaultParallelism)
    known = F.col("attack_type").isin(*M.class_labels(classifier), "Unknown") & (F.col("attack_type") != "Benign")
    attack = known & (F.abs(F.col("confidence") - F.col("stage1_confidence") * F.col("stage2_confidence")) < 1e-9) & F.col("severity").isin(*scoring.LEVELS)
    benign = (F.col("attack_type") == "Benign") & (F.col("stage2_confidence") == 0) & (F.col("confidence") == F.col("stage1_confidence")) & (F.col("severity") == "NONE")
    likely = F.col("stage1_confidence").between(0.5, 1)
    return out.select("flow_id", "Label", (likely & F.when(F.col("is_attack"), attack).otherwise(benign)).alias("consistent"))


@query("flows", "SELECT flow_id, true AS same FROM flows")
def flat_forest_scores(t):
    """All flows by flat forests and by the model library's own transformers: same class, probabilities within 1e-12."""
    detector, classifier = trained(t)
    rows = detector.transform(M.score_two_stage(model_rows(t), detector, classifier))
    rows = M._scoring_part(classifier).transform(rows)
    p, q = vector_to_array("stage1_probability"), vector_to_array("stage2_probability")
    hit, index = F.col("stage1_prediction") == 1, F.col("stage2_prediction").cast("int")
    one = F.abs(F.col("stage1_confidence") - F.when(hit, p[1]).otherwise(p[0])) <= 1e-12
    two = F.abs(F.col("stage2_confidence") - F.when(hit, F.get(q, index)).otherwise(0.0)) <= 1e-12
    kind = F.when(hit, M.decode_class(index, M.class_labels(classifier))).otherwise("Benign")
    return rows.select("flow_id", ((F.col("is_attack") == hit) & one & two & (F.col("attack_type") == kind)).alias("same"))


_WALKED = ["Dst_Port", "Protocol", "Hour", "Flow_Duration", "Tot_Fwd_Pkts", "Tot_Bwd_Pkts", "Flow_Byts_per_s", "Flow_Pkts_per_s"]
_WALK_TREES, _WALK_DEPTH = 12, 5


def _ruled_forest() -> list[tuple]:
    """Nodes of complete trees by a rule: heap order, features in turn, limits over eight decades, counts by remainders."""
    inner, nodes = 2 ** _WALK_DEPTH - 1, []
    for tree in range(_WALK_TREES):
        for node in range(2 * inner + 1):
            leaf, h = node >= inner, (tree * 131 + node * 37) % 97
            feature = -1 if leaf else (tree + node) % len(_WALKED)
            nodes.append((tree, node, feature, None if leaf else float(10 ** (h % 8) * (1 + h % 5) / 2), -1 if leaf else 2 * node + 1,
                          -1 if leaf else 2 * node + 2, [1.0 + h % 7, 1.0 + h % 11]))
    return nodes


def _forest_sql(nodes: list[tuple]) -> str:
    """The same votes as nested CASE expressions."""
    by = {(n[0], n[1]): n for n in nodes}

    def case(tree: int, node: int) -> str:
        n = by[tree, node]
        if n[2] < 0:
            return f"CAST({n[6][1]!r} AS DOUBLE) / {sum(n[6])!r}"
        return f"CASE WHEN {_WALKED[n[2]]} <= {n[3]!r} THEN {case(tree, n[4])} ELSE {case(tree, n[5])} END"

    return " + ".join(f"({case(tree, 0)})" for tree in range(_WALK_TREES))


@query("flows", f"SELECT flow_id, round(({_forest_sql(_ruled_forest())}) / {_WALK_TREES}, 9) AS probability FROM flows")
def walk_forest(t):
    """A forest made by a rule, walked over all flows, missing and infinite values included; in SQL it is nested CASE expressions."""
    forest = t.spark.sparkContext.broadcast(FlatForest.of_nodes(_ruled_forest()))
    return t.flows.select("flow_id", F.round(class_share(_WALKED, forest), 9).alias("probability"))


@query("", "SELECT stage, true AS learnt FROM (VALUES ('detector'), ('classifier')) v(stage)")
def forests_learn(t):
    """Labels that follow from the packets of a flow, 81 features: on flows not seen in training the detector is right in
    95 of 100 cases and the classifier, on the attacks, too."""
    rows = C.sanitise_numeric(FL.flow_features(t.packets, _TIMEOUT), DETECTOR_FEATURES)
    kind = F.when(F.col("Pkt_Len_Mean") <= 66, "Benign").when(F.col("Dst_Port") == 80, "Bot").otherwise("SSH-Bruteforce")
    rows = materialise(rows.withColumns({"Label": kind, "attack_label": kind}).withColumn(
        "stage1_label", (F.col("Label") != "Benign").cast("double")), "labelled-flows")
    key = ["Src_IP", "Dst_IP", "flow_seq"]
    train, test = S.split_by_hash(rows, key)
    sample = materialise(S.stratified_sample(train, "attack_label", key, target=TRAIN_ROWS).repartition(TRAIN_PARTITIONS, *key).sortWithinPartitions(*key), "sample")
    detector, classifier = M.train_detector(sample, weighted=True, numTrees=30), M.train_classifier(sample)
    out = M.score_two_stage(test, detector, classifier)
    right = out.agg(F.avg((F.col("is_attack") == (F.col("Label") != "Benign")).cast("double")).alias("detector"),
                    F.avg(F.when(F.col("is_attack") & (F.col("Label") != "Benign"), (F.col("attack_type") == F.col("Label")).cast("double"))).alias("classifier"))
    return right.selectExpr("stack(2, 'detector', detector >= 0.95, 'classifier', classifier >= 0.95) AS (stage, learnt)")


@query("flows", """SELECT section, true AS agrees FROM (VALUES ('attack_type'), ('severity'), ('port')) v(section)""")
def detection_alerts(t):
    """One-stage alerting at a probability threshold: by type and by severity the counts are those of the alerts, and no more
    than ten ports are listed."""
    detector, _ = trained(t)
    alerts = M.make_alerts(M.detect(model_rows(t), detector, 0.5).withColumn("attack_type", F.col("Label")))
    counts = M.alert_summary(alerts).groupBy("section").agg(F.sum("count").alias("n"), F.count("*").alias("names"))
    total = alerts.agg(F.count("*")).scalar()
    return counts.select("section", F.when(F.col("section") == "port", (F.col("names") <= 10) & (F.col("n") <= total)).otherwise(F.col("n") == total).alias("agrees"))


@query("flows", f"SELECT {len(_MODEL_FEATURES)} AS features, 1.0 AS total, true AS ordered FROM flows LIMIT 1")
def feature_importance(t):
    detector, _ = trained(t)
    out = E.feature_importance(detector.stages[-1], _MODEL_FEATURES, t.spark)
    values = F.sort_array(F.collect_list("importance"), False)
    return out.agg(F.count_distinct("feature").cast("int").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
                   (F.collect_list("importance") == values).alias("ordered"))


@query("", f"""SELECT CAST(label AS VARCHAR) AS class_name, count(*) AS support, true AS better_than_chance FROM embeddings
 WHERE {_UNIT.format(seed=42, key='vec_id')} / 4294967296.0 >= 0.8 GROUP BY label""")
def vector_classifier(t):
    """Weighted multi-class forest over the embedding table, judged on vectors it has not seen."""
    names = [f"v{i}" for i in range(64)]
    rows = t.embeddings.select("vec_id", F.col("label").cast("string").alias("attack_label"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    train, test = S.split_by_hash(rows, ["vec_id"])
    model = M.train_classifier(train, names, attack_flag=None, weighted=True)
    scored = M._scoring_part(model).transform(test)
    scored = materialise(scored.withColumn("predicted_label", M.decode_class(F.col("stage2_prediction"), M.class_labels(model))).select(
        "vec_id", "attack_label", "predicted_label"), "scored")
    right = scored.agg(F.avg((F.col("attack_label") == F.col("predicted_label")).cast("double"))).scalar()
    chance = scored.agg(F.lit(1.0) / F.count_distinct("attack_label")).scalar()
    classes = E.per_class_metrics(scored, "attack_label", "predicted_label").where("support > 0")
    return classes.select("class_name", "support", (right > chance).alias("better_than_chance"))


# ================================================================ streams

def events_stream(t, name: str, close: bool = False) -> DataFrame:
    """The events file as a stream in the shape of a view. With `close`, one more event far after all others moves the
    watermark past them, so that everything open at the end of the input is emitted; its own group stays open."""
    from packetloom.plans.views import VIEWS

    raw = T.flow_stream(t.spark, t.dir, t.events.schema, glob="events.parquet")
    if close:
        path = new_path(t.spark, "marker")
        last = t.events.orderBy(F.desc("ts")).limit(1)
        marker = {"ts": F.col("ts") + F.expr("INTERVAL 60 DAYS"), "event_id": F.lit(0), "event_type": F.lit("click")}  # passes every filter
        last.withColumns(marker).select(*[F.col(c).cast(k) for c, k in t.events.dtypes]).write.parquet(path)
        raw = raw.unionByName(T.flow_stream(t.spark, path, t.events.schema))
    return t.spark.sql(VIEWS[name][1], table=raw)


@query("alerts", """SELECT strftime(date_trunc('day', event_time), '%Y-%m-%d') AS bucket, count(*) AS total_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
 count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (attack_type <> 'BENIGN') AS attack_alerts FROM alerts GROUP BY 1""")
def stream_trends(t):
    out = ST.run_available(ST.stream_trends(events_stream(t, "alerts"), "7d"), "trends", "complete", ST.overwrite_batch)
    return out.withColumn("bucket", day_text("bucket"))


@query("alerts", "SELECT alert_id, attack_type FROM alerts")
def stream_dedupe(t):
    """Every alert delivered twice in the same stream."""
    rows = events_stream(t, "alerts").select("alert_id", "attack_type", "event_time")
    twice = rows.unionByName(events_stream(t, "alerts").select("alert_id", "attack_type", "event_time"))
    return ST.run_available(ST.stream_dedupe(twice, delay="40 days"), "dedupe").select("alert_id", "attack_type")


_SESSIONS = """a AS (SELECT *, epoch_us(event_time) AS us FROM alerts WHERE attack_type <> 'BENIGN' AND destination_port IS NOT NULL),
 g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 21600000000 THEN 0 ELSE 1 END AS n FROM a WINDOW w AS (PARTITION BY attack_type, destination_port ORDER BY us, alert_id)),
 s AS (SELECT *, sum(n) OVER (PARTITION BY attack_type, destination_port ORDER BY us, alert_id) AS k FROM g)"""


@query("alerts", f"""WITH {_SESSIONS} SELECT concat('INC-', strftime(min(event_time), '%Y%m%d'), '-', upper(md5(first(alert_id ORDER BY us, alert_id)))) AS incident_id, attack_type, destination_port,
 count(*) AS alert_count, {_STAMP.format('min(event_time)')} AS first_seen, {_STAMP.format('max(event_time)')} AS last_seen FROM s GROUP BY attack_type, destination_port, k""")
def stream_sessions(t):
    out = ST.run_available(ST.stream_sessions(events_stream(t, "alerts", close=True), 21_600), "sessions")
    return out.withColumns({"first_seen": time_text("first_seen"), "last_seen": time_text("last_seen")})


@query_on_fold("SELECT alert_id, incident_id FROM linked")
def stream_correlate(t):
    return ST.run_available(ST.stream_correlate(events_stream(t, "alerts"), 21_600), "correlated")


@query_on_fold("SELECT alert_id, incident_id FROM linked")
def stream_correlate_continued(t):
    """The first half of the time in batch, the second as a stream that begins with the incidents still open."""
    span = t.alerts.agg(F.min("event_time"), F.max("event_time")).first()
    middle = F.lit(span[0] + (span[1] - span[0]) / 2)
    batch = materialise(I.correlate(t.alerts.where(F.col("event_time") <= middle), 21_600, strict=False), "first-half")
    initial = ST.open_incidents(batch, 21_600)
    later = events_stream(t, "alerts").where(F.col("event_time") > middle)
    stream = ST.run_available(ST.stream_correlate(later, 21_600, initial=initial), "second-half")
    return batch.select("alert_id", "incident_id").unionByName(stream)


@query()
def stream_correlate_without_addresses(t):
    none = F.lit(None).cast("string")
    rows = events_stream(t, "alerts").withColumns({"source_ip": none, "destination_ip": none})
    return ST.run_available(ST.stream_correlate(rows, 21_600, addresses=False), "correlated")


ORACLES["stream_correlate_without_addresses"] = ORACLES["correlate_without_addresses"]


@query("packets", f"""WITH {_FLOW} SELECT fseq AS flow_seq, count(*) AS packet_count, bool_or(ended) AS terminated, CAST(max(us) - min(us) AS DOUBLE) AS Flow_Duration,
 CAST(count(*) FILTER (fwd) AS DOUBLE) AS Tot_Fwd_Pkts, CAST(count(*) FILTER (NOT fwd) AS DOUBLE) AS Tot_Bwd_Pkts FROM f GROUP BY host, k, fseq""")
def stream_flows(t):
    out = ST.run_available(ST.stream_flows(events_stream(t, "packets", close=True), _TIMEOUT), "flows")
    return out.select("flow_seq", "packet_count", "terminated", "Flow_Duration", "Tot_Fwd_Pkts", "Tot_Bwd_Pkts")


@query("flows", """SELECT count(*) AS flows_processed, count(*) FILTER (IsAttack = 1) AS ground_truth_attacks, round(count(*) FILTER (IsAttack = 1) * 100.0 / count(*), 2) AS ground_truth_attack_rate_percent,
 true AS adds_up FROM flows""")
def stream_score(t):
    """Score all flows as a stream: alerts appended, one scorecard per batch, totals. Verdicts and stored alerts add up."""
    detector, classifier = trained(t)
    root = new_path(t.spark, "scoring")
    model_rows(t).write.option("compression", "zstd").parquet(f"{root}/incoming")
    feed = T.flow_stream(t.spark, f"{root}/incoming", model_rows(t).schema, files_per_trigger=4)
    alerts, cards = ST.stream_score(feed.withColumn("source_file", F.lit("s")), detector, classifier, root)
    kept = t.spark.read.parquet(alerts)
    stored = kept.agg(F.count("*"), F.count_distinct(F.xxhash64("alert_digest"))).first()
    if stored[0] != stored[1]:  # hashes that differ show that digests do; equal ones show nothing
        stored = kept.agg(F.count("*"), F.count_distinct("alert_digest")).first()
    adds = (F.col("predicted_attacks") + F.col("predicted_benign") == F.col("flows_processed")) & (F.col("alerts_generated") == stored[0]) & F.lit(stored[0] == stored[1])
    return ST.telemetry(t.spark, cards).select("flows_processed", "ground_truth_attacks", "ground_truth_attack_rate_percent", adds.alias("adds_up"))


# ================================================================ sources, sinks and small parts

_LABELS = "CASE WHEN l_returnflag = 'N' THEN 'Benign' ELSE 'Bot' END"


def _pieces(t, files: int) -> int:
    """As many tasks as the session has, the same number for each file."""
    return files * -(-int(t.spark.conf.get("spark.sql.shuffle.partitions")) // files)


def _delivered(t, raw: DataFrame, files: int) -> str:
    """A folder of `files` compressed flow files with a header line each. Every task packs a piece; the pieces of a file are put
    one after the other, which is a whole gzip file. `raw` holds numbers, dates and words, so no value needs quotes."""
    path = new_path(t.spark, "daily")
    line = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in raw.columns])
    raw.select(line.alias("value")).write.options(
        compression="gzip", **{"zlib.compress.level": "BEST_SPEED", T.BUFFER[0]: T.BUFFER[1]}).text(f"{path}/_pieces")
    jvm, conf = t.spark._jvm, t.spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(conf)
    pieces = sorted(x.getPath().getName() for x in store.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_pieces")) if x.getPath().getName().startswith("part-"))

    def put(k: int) -> None:
        held = jvm.org.apache.hadoop.fs.Path(f"{path}/_part-{k:05d}")
        out = store.create(held)
        out.write(bytearray(gzip.compress(f"{','.join(raw.columns)}\n".encode())))
        for name in pieces:
            if int(name.split("-")[1]) % files == k:
                piece = jvm.org.apache.hadoop.fs.Path(f"{path}/_pieces/{name}")
                packed = store.open(piece)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(packed, out, 1 << 20, False)
                packed.close()
                store.delete(piece, False)
        out.close()
        store.rename(held, jvm.org.apache.hadoop.fs.Path(f"{path}/part-{k:05d}-{uuid.uuid4()}.csv.gz"))

    with ThreadPoolExecutor(files) as several:
        list(several.map(put, range(files)))
    store.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_pieces"), True)
    return path


def _four_files(t) -> str:
    """Flow files as they are delivered, compressed. The order lines are dealt, not the eighty columns of text made of them."""
    return _delivered(t, raw_file(t, t.lineitem.repartition(_pieces(t, 4))), 4)


@query("", f"""SELECT {_LABELS} AS "Label", count(*) AS n, CAST(sum(l_quantity + 3) AS BIGINT) AS duration, 'double' AS kind FROM lineitem GROUP BY 1""")
def read_flow_csv_inferred(t):
    raw = T.read_flow_csv(t.spark, _four_files(t), infer=True)
    return raw.groupBy("Label").agg(F.count("*").alias("n"), F.sum("`Flow Duration`").cast("long").alias("duration"),
                                    F.first(F.typeof("`Flow Duration`")).alias("kind"))


@query("", "SELECT count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS packets FROM lineitem")
def read_flows(t):
    return T.read_flows(t.spark, f"{t.dir}/lineitem.parquet", ["l_quantity"]).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("packets"))


@query("", """SELECT 4 AS files, true AS filled""")
def discover(t):
    return T.discover(t.spark, [_four_files(t)], expected=4).agg(F.count("*").cast("int").alias("files"), F.bool_and(F.col("length") > 0).alias("filled"))


@query("", f"""SELECT {_LABELS} AS "Label", count(*) AS n, 4 AS files FROM lineitem GROUP BY 1""")
def read_flow_files(t):
    """Files with two header layouts, united by name; each row keeps the name of its file."""
    path = _four_files(t)
    raw = raw_file(t, t.lineitem.where("l_returnflag <> 'N' OR l_returnflag IS NULL").repartition(_pieces(t, 2)))
    other = _delivered(t, raw.where("Label = 'Bot'").select(F.lit("x").alias("extra"), *[F.col(f"`{c}`") for c in reversed(raw.columns)]), 2)
    first = [r.path for r in T.discover(t.spark, [path]).collect()]
    second = [r.path for r in T.discover(t.spark, [other]).collect()]
    rows = T.read_flow_files(t.spark, [*first, *second])
    names = rows.where(~F.col("source_file").isin([p.rsplit("/", 1)[1] for p in second]))
    return names.groupBy("Label").agg(F.count("*").alias("n"), F.count_distinct("source_file").cast("int").alias("files"))


@query("flows", """SELECT f AS fmt, Label, count(*) AS n FROM flows, (VALUES ('json'), ('csv')) v(f) GROUP BY ALL""")
def write_metrics(t):
    counts = R.label_distribution(t.flows).withColumnRenamed("count", "n")
    out = None
    for fmt in ("json", "csv"):
        path = new_path(t.spark, "metrics")
        T.write_metrics(counts, path, fmt)
        part = t.spark.read.schema(counts.schema).option("header", True).format(fmt).load(path).select(F.lit(fmt).alias("fmt"), "Label", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("packets", "SELECT count(*) AS n, CAST(sum(pkt_len) AS BIGINT) AS bytes, count(DISTINCT src_ip) AS sources FROM packets")
def read_packets(t):
    from packetloom.schemas import PACKET_SCHEMA

    path, have = new_path(t.spark, "packets"), set(t.packets.columns)
    t.packets.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in PACKET_SCHEMA]).write.parquet(path)
    return T.read_packets(t.spark, path).agg(F.count("*").alias("n"), F.sum("pkt_len").alias("bytes"), F.count_distinct("src_ip").alias("sources"))


@query("", f"""SELECT {_LABELS} AS label, count(*) AS "rows", round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percentage FROM lineitem GROUP BY 1""")
def label_shares(t):
    path = new_path(t.spark, "labelled")
    T.write_table(T.canonicalise(raw_file(t)), path)
    return T.label_shares(t.spark, path)


@query("", f"""SELECT {len(RAW_COLUMNS)} AS "columns", true AS clean, count(*) AS "rows" FROM lineitem""")
def clean_names(t):
    out = C.clean_names(raw_file(t))
    good = [c.isidentifier() for c in out.columns]
    return out.agg(F.lit(len(set(out.columns))).alias("columns"), F.lit(all(good)).alias("clean"), F.count("*").alias("rows"))


@query("flows", "SELECT Label, count(*) AS n, 0 AS truth_columns FROM flows GROUP BY Label")
def strip_ground_truth(t):
    rows = C.strip_ground_truth(t.flows.select("flow_id", "Hour", F.col("Label").alias("attack_label")), keep_as="truth")
    left = int("attack_label" in rows.columns)
    return rows.groupBy(F.col("truth.attack_label").alias("Label")).agg(F.count("*").alias("n"), F.lit(left).alias("truth_columns"))


@query("flows", """SELECT count(*) FILTER (isfinite(Flow_Byts_per_s)) AS valid, count(*) FILTER (Flow_Byts_per_s IS NULL OR isinf(Flow_Byts_per_s)) AS invalid,
 count(*) FILTER (Flow_Byts_per_s IS NULL OR isinf(Flow_Byts_per_s)) AS spoiled_by_bytes FROM flows""")
def route_invalid(t):
    good, bad, counts = C.route_invalid(t.flows, ["Tot_Fwd_Pkts", "Flow_Byts_per_s"])
    spoiled = counts.where("feature = 'Flow_Byts_per_s'").agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    return good.agg(F.count("*").alias("valid")).withColumns({"invalid": bad.agg(F.count("*")).scalar(), "spoiled_by_bytes": spoiled})


@query("flows", "SELECT count(*) AS n, true AS two_parts FROM flows")
def random_split(t):
    a, b = (materialise(x, "part") for x in S.random_split(t.flows.select("flow_id")))
    sizes = a.agg(F.count("*")).scalar(), b.agg(F.count("*")).scalar()
    return a.union(b).agg(F.count("*").alias("n"), ((sizes[0] > sizes[1]) & (sizes[1] > 0)).alias("two_parts"))


@query("flows", f"""WITH c AS (SELECT Label, count(*) AS n FROM flows GROUP BY Label), r AS (SELECT Label, least(1.0, least(CAST(n AS DOUBLE), n * 5000.0 / (SELECT sum(n) FROM c)) / n) AS q FROM c)
 SELECT Label, count(*) AS n, CAST(sum(flow_id) AS BIGINT) AS ids FROM flows JOIN r USING (Label) WHERE {_UNIT.format(seed=42, key='flow_id')} / 4294967296.0 < q GROUP BY Label""")
def proportional_sample(t):
    out = S.stratified_sample(t.flows, "Label", ["flow_id"], target=5000)
    return out.groupBy("Label").agg(F.count("*").alias("n"), F.sum("flow_id").alias("ids"))


@query("flows", "SELECT IsAttack, count(*) AS n FROM flows GROUP BY IsAttack")
def union_samples(t):
    return S.union_samples(t.flows.where("IsAttack = 0"), t.flows.where("IsAttack = 1")).groupBy("IsAttack").agg(F.count("*").alias("n"))


@query("alerts", f"""SELECT te AS technique_id, ta AS tactic_id, string_agg(DISTINCT attack_type, ',' ORDER BY attack_type) AS associated_attacks, max(CAST(c AS DOUBLE)) AS confidence
 FROM alerts JOIN {_TECH} ON attack_type = l GROUP BY 1, 2""")
def labels_by_technique(t):
    seen = N.techniques(t.spark).join(t.alerts.select("attack_type").distinct(), "attack_type")
    return N.labels_by_technique(seen).select("technique_id", "tactic_id", joined("associated_attacks").alias("associated_attacks"), "confidence")


@query("alerts", f"""SELECT ta AS tactic_id, count(DISTINCT attack_type) AS techniques_count FROM alerts JOIN {_TECH} ON attack_type = l GROUP BY 1""")
def labels_by_tactic(t):
    seen = N.techniques(t.spark).join(t.alerts.select("attack_type").distinct(), "attack_type")
    return N.labels_by_tactic(seen).select("tactic_id", "techniques_count")


@query_on_fold(f"""SELECT {_STAMP.format('event_time')} AS timestamp, CASE WHEN row_number() OVER (ORDER BY us, alert_id) = 1 THEN 'INCIDENT_CREATED' ELSE 'ALERT_CORRELATED' END AS event_type,
 row_number() OVER (ORDER BY us, alert_id) AS place FROM linked WHERE incident_id = (SELECT incident_id FROM linked GROUP BY 1 ORDER BY count(*) DESC, incident_id LIMIT 1)""")
def timeline_of(t):
    """History of the largest incident, oldest first."""
    correlated = materialise(_correlated(t), "correlated")
    largest = correlated.groupBy("incident_id").count().orderBy(F.desc("count"), "incident_id").first().incident_id
    rows = I.timeline_of(I.incident_timeline(correlated), largest)
    place = F.row_number().over(W.orderBy("timestamp", F.col("event_type") != "INCIDENT_CREATED", "event_id")).cast("long")
    return rows.select(time_text("timestamp").alias("timestamp"), "event_type", place.alias("place"))


@query("packets", f"""SELECT {_STAMP.format('packet_time')} AS packet_time, src_ip, dst_ip, src_port, dst_port, protocol, pkt_len, payload_len, header_len, fin, syn, psh, false AS rst, false AS ack,
 CAST(win_bytes % 65536 AS INT) AS win_bytes, row_number() OVER (ORDER BY packet_time, seq) - 1 AS place FROM packets""")
def decode_capture_files(t):
    """The packets written as one capture file and decoded from byte ranges, each with its record number."""
    folder = new_path(t.spark, "captures")
    write_captures(t.packets, folder, files=1).collect()
    out = decode_captures(t.spark, folder, range_bytes=1 << 16)
    return out.select(time_text("packet_time").alias("packet_time"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "pkt_len", "payload_len", "header_len",
                      "fin", "syn", "psh", "rst", "ack", "win_bytes", F.col("seq").alias("place"))


@query("alerts", """WITH d AS (SELECT date_trunc('day', event_time) AS day, count(*) AS n FROM alerts GROUP BY 1)
 SELECT strftime(day, '%Y-%m-%d') AS bucket, n AS total_alerts FROM d WHERE epoch_us(day) + 86400000000 <= (SELECT max(epoch_us(event_time)) - 600000000 FROM alerts)""")
def late_data(t):
    """The same events once more, two deliveries later: every one is behind the watermark, none is counted again."""
    at = new_path(t.spark, "late"), new_path(t.spark, "late-checkpoint")
    for feed in _deliveries(t):
        out = ST.run_available(ST.stream_trends(feed, "7d"), "late", at=at)
    return out.select(day_text("bucket").alias("bucket"), "total_alerts")


def _deliveries(t):
    """A stream before each of three deliveries: all alerts, the newest again, those of the days that are closed again."""
    path = new_path(t.spark, "deliveries")
    rows = t.alerts.select("alert_id", "event_time", "severity", "attack_type")
    newest = rows.agg(F.max("event_time")).scalar()
    closed = F.to_date("event_time") < F.to_date(newest - F.expr("INTERVAL 10 MINUTES"))
    for part in (rows, rows.orderBy(F.desc("event_time")).limit(1), rows.where(closed)):
        part.write.mode("append").parquet(path)
        yield T.flow_stream(t.spark, path, rows.schema, files_per_trigger=2**31 - 1)  # one batch a delivery, however many files


@query("alerts", """WITH d AS (SELECT event_time, false AS late FROM alerts UNION ALL SELECT max(event_time), false FROM alerts UNION ALL
 SELECT event_time, true FROM alerts WHERE CAST(event_time AS DATE) < (SELECT CAST(max(event_time) - INTERVAL 10 MINUTE AS DATE) FROM alerts))
 SELECT strftime(event_time, '%Y-%m-%d') AS bucket, late, count(*) AS n,
 CAST(sum(CASE WHEN late THEN (SELECT max(epoch_us(event_time)) FROM alerts) - 600000000 - epoch_us(event_time) END) AS BIGINT) AS behind_us FROM d GROUP BY 1, 2""")
def late_rows(t):
    """The same deliveries with every row kept: those behind the watermark are marked, with their distance from it."""
    at = new_path(t.spark, "kept"), new_path(t.spark, "kept-checkpoint")
    for feed in _deliveries(t):
        out = ST.late_rows(feed, at=at)
    return out.groupBy(day_text("event_time").alias("bucket"), "late").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("behind_seconds") * 1_000_000).cast("long")).alias("behind_us"))


@query("alerts", "SELECT count(*) AS input_rows, true AS numbered FROM alerts")
def stream_progress(t):
    with ST.ProgressLog(t.spark, new_path(t.spark, "progress")) as log:
        query = events_stream(t, "alerts").writeStream.format("noop").option(
            "checkpointLocation", new_path(t.spark, "progress-checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = ST.stream_progress(log, query)
    return rows.agg(F.sum("input_rows").alias("input_rows"), (F.count_distinct("batch") == F.count("*")).alias("numbered"))


@query("flows", f"""SELECT count(*) AS support, 3 AS time_features FROM flows WHERE {_TEST} AND IsAttack = 1""")
def leakage_report(t):
    """Weighted classifier with time features, judged on unseen attacks: what its time features weigh, and its averages."""
    rows = model_rows(t).where("IsAttack = 1")
    names = ["Hour", "DayOfWeek", "IsWeekend", "Tot_Fwd_Pkts", "Flow_Duration"]
    rows = rows.withColumn("IsWeekend", F.col("DayOfWeek").isin(1.0, 7.0).cast("double")).withColumn("Hour", F.col("Hour").cast("double"))
    train, test = S.split_by_hash(rows, ["flow_id"])
    sample = materialise(S.stratified_sample(train, "attack_label", ["flow_id"], target=TRAIN_ROWS), "sample")
    model = M.train_classifier(sample, names, weighted=True, numTrees=30)
    importance, averages = M.leakage_report(model, test, names)
    weighed = importance.agg(F.count("*")).scalar()
    return averages.agg(F.max("samples").cast("long").alias("support"), F.first(weighed).cast("int").alias("time_features"))

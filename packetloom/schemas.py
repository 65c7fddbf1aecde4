"""Column lists and schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

# The header of a labelled flow file, in file order.
RAW_COLUMNS = [
    "Dst Port", "Protocol", "Timestamp", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts",
    "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Fwd Pkt Len Max", "Fwd Pkt Len Min", "Fwd Pkt Len Mean",
    "Fwd Pkt Len Std", "Bwd Pkt Len Max", "Bwd Pkt Len Min", "Bwd Pkt Len Mean", "Bwd Pkt Len Std",
    "Flow Byts/s", "Flow Pkts/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Tot", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Tot",
    "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Bwd PSH Flags",
    "Fwd URG Flags", "Bwd URG Flags", "Fwd Header Len", "Bwd Header Len", "Fwd Pkts/s", "Bwd Pkts/s",
    "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var", "FIN Flag Cnt",
    "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt", "URG Flag Cnt", "CWE Flag Count",
    "ECE Flag Cnt", "Down/Up Ratio", "Pkt Size Avg", "Fwd Seg Size Avg", "Bwd Seg Size Avg",
    "Fwd Byts/b Avg", "Fwd Pkts/b Avg", "Fwd Blk Rate Avg", "Bwd Byts/b Avg", "Bwd Pkts/b Avg",
    "Bwd Blk Rate Avg", "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Pkts", "Subflow Bwd Byts",
    "Init Fwd Win Byts", "Init Bwd Win Byts", "Fwd Act Data Pkts", "Fwd Seg Size Min", "Active Mean",
    "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min", "Label",
]


def feature_name(raw: str) -> str:
    """Spelling of a raw header as a column name."""
    return raw.strip().replace(" ", "_").replace("/", "_per_").replace("-", "_")


NETWORK_FEATURES = [feature_name(c) for c in RAW_COLUMNS if c not in ("Timestamp", "Label")]
TEMPORAL_FEATURES = ["Hour", "DayOfWeek", "IsWeekend"]
DETECTOR_FEATURES = NETWORK_FEATURES + TEMPORAL_FEATURES
TRUTH_COLUMNS = ["stage1_label", "attack_label", "source_file"]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

TCP_FLAGS = ["fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwe"]

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("packet_time", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in ("src_port", "dst_port", "protocol", "pkt_len",
                                                      "payload_len", "header_len")],
        *[T.StructField(c, T.BooleanType()) for c in TCP_FLAGS],
        T.StructField("win_bytes", T.IntegerType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("attack_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("destination_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

INDICATOR_SCHEMA = T.StructType(
    [
        T.StructField("indicator_id", T.StringType()),
        T.StructField("indicator_type", T.StringType()),
        T.StructField("indicator_value", T.StringType()),
        T.StructField("threat_name", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
        T.StructField("description", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("replay_id", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        *[T.StructField(c, T.LongType()) for c in ("flows_requested", "flows_processed", "gt_benign", "gt_attacks",
                                                   "pred_benign", "pred_attacks", "alerts_inserted")],
        T.StructField("throughput", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)

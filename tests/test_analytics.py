"""Analytics on small cases, cleaning errors, sampling properties, sinks."""

import datetime as dt
import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from packetloom.functions import values as V
from packetloom.operators import clean as C, evaluate as E, sampling as S, soc as O
from packetloom.schemas import DETECTOR_FEATURES, NETWORK_FEATURES, RAW_COLUMNS
from packetloom.sources import tables as T

T0 = dt.datetime(2024, 3, 2, 12, 0, 0)
ALERT = ("alert_id string, event_time timestamp, created_at timestamp, attack_type string, severity string, confidence double, "
         "protocol string, status string")


def alerts(spark, *rows):
    return spark.createDataFrame([(f"a{i}", T0, T0, *r) for i, r in enumerate(rows)], ALERT)


def cases(spark):
    return spark.createDataFrame([], "created_at timestamp, first_seen timestamp, updated_at timestamp, status string, severity string, alert_count int")


def test_empty_window(spark):
    empty = alerts(spark).where("false")
    row = O.soc_summary(empty, cases(spark), "15m", as_of=T0).first()
    assert row["total_alerts"] == 0 and row["mean_confidence"] is None and row["mttr_seconds"] is None
    assert row["alert_to_incident_ratio"] is None and row["attack_rate"] == 0
    monitor = O.model_monitor(empty, "15m", as_of=T0).first()
    assert monitor["inference_volume"] == 0 and monitor["status"] == "NORMAL" and monitor["p50"] is None
    assert {r["severity"]: r["count"] for r in O.severity_distribution(empty, "all").collect()} == dict.fromkeys(
        ["CRITICAL", "HIGH", "MEDIUM", "LOW"], 0)
    assert O.incident_analytics(cases(spark), "all").first()["total_incidents"] == 0


def test_windows_and_monitor(spark):
    df = alerts(spark, ("Bot", "HIGH", 0.95, "TCP", "NEW"), ("BENIGN", "LOW", 0.40, "gre", "NEW"))
    assert O.model_monitor(df, "1h").first()["low_confidence_count"] == 1
    for window in ("15m", "1h", "24h", "7d", "all", "bogus"):
        row = O.soc_summary(df, cases(spark), window).first()
        assert row["window"] == window and row["total_alerts"] == 2
    later = T0 + dt.timedelta(minutes=20)
    assert O.soc_summary(df, cases(spark), "15m", as_of=later).first()["total_alerts"] == 0
    assert {r["protocol"]: r["count"] for r in O.protocol_distribution(df, "all").collect()} == {"TCP": 1, "UDP": 0, "ICMP": 0, "OTHER": 1}


def test_cleaning_errors(spark):
    df = spark.createDataFrame([("1", "x")], "a string, Label string")
    with pytest.raises(ValueError):
        C.sanitise_numeric(df, ["a", "b"])
    with pytest.raises(ValueError):
        T.canonicalise(df)
    with pytest.raises(Exception, match="blank label"):
        C.assert_labels(spark.createDataFrame([(" ",)], "Label string")).collect()
    row = C.sanity_check(df, required=("a", "zz")).first()
    assert not row["passed"] and row["missing"] == ["zz", "source_file"]


def test_scalar_rules(spark):
    df = spark.createDataFrame([("6",), ("17.0",), ("1",), ("47",), ("tcp",), ("x",), (None,), ("NaN",)], "p string")
    assert [r[0] for r in df.select(V.protocol_name("p")).collect()] == [
        "TCP", "UDP", "ICMP", "Other", "TCP", "Unknown", "Unknown", "Unknown"]
    df = spark.createDataFrame([("22.9",), ("x",), (None,)], "p string")
    assert [r[0] for r in df.select(V.to_int("p")).collect()] == [22, None, None]
    day = spark.createDataFrame([("02/03/2024 01:02:03",), ("bad",)], "Timestamp string")
    rows = C.temporal_features(C.parse_event_time(day), default=0).collect()
    assert (rows[0]["Hour"], rows[0]["DayOfWeek"], rows[0]["IsWeekend"]) == (1, 7, 1)
    assert (rows[1]["Hour"], rows[1]["DayOfWeek"], rows[1]["IsWeekend"]) == (0, 0, 0)
    assert len(RAW_COLUMNS) == 80 and len(NETWORK_FEATURES) == 78 and len(DETECTOR_FEATURES) == 81
    truth = C.strip_ground_truth(spark.createDataFrame([(1.0, "Bot", "f", 2)], "stage1_label double, attack_label string, source_file string, x int"), "truth")
    assert truth.columns == ["x", "truth"] and truth.first()["truth"]["attack_label"] == "Bot"


def test_header_artifacts_are_counted(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([("Label",), (" Label ",), ("Bot",), (None,)], "Label string")
    seen = Observation("h")
    artifact = F.coalesce(F.trim("Label") == "Label", F.lit(False))
    counted = df.observe(seen, F.count_if(artifact).alias("removed"))
    assert C.drop_header_artifacts(counted).count() == 2 and seen.get["removed"] == 2
    assert C.drop_header_artifacts(df, observe="named").count() == 2


def test_samples(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 5 == 0, 1.0).otherwise(0.0).alias("stage1_label"))
    a = S.ratio_sample(df.repartition(3), 100, 0.3, ["id"])
    b = S.ratio_sample(df.coalesce(1), 100, 0.3, ["id"])
    assert [r[0] for r in a.collect()] == [r[0] for r in b.collect()]
    assert a.count() == 100 and a.where("stage1_label = 1").count() == 30
    assert S.balanced_sample(df, 11, ["id"]).groupBy("stage1_label").count().collect().__len__() == 2
    assert S.balanced_sample(df, 5000, ["id"]).count() == 2000 - 1600 + 1600
    for train, test in (S.split_by_hash(df, ["id"]), S.split_by_rand(df), S.random_split(df)):
        assert train.count() + test.count() == 2000 and train.join(test, "id").isEmpty()
    kept = S.stratified_sample(df, "stage1_label", ["id"], target=500, floor=400)
    assert kept.where("stage1_label = 1").count() == 400
    with pytest.raises(ValueError):
        S.require_classes({"train": df, "test": df.where("stage1_label = 0")}, "stage1_label")


def test_runs_and_sinks(spark, tmp_path):
    run = spark.createDataFrame([("r1", T0, 5)], "replay_id string, start_time timestamp, flows_processed int")
    again = spark.createDataFrame([("r1", T0 + dt.timedelta(1), 9), ("r2", T0, 1)], run.schema)
    assert {r["replay_id"]: r["flows_processed"] for r in T.record_run(again, run).collect()} == {"r1": 5, "r2": 1}
    forced = {r["replay_id"]: r for r in T.record_run(again, run, force=True).collect()}
    assert forced["r1"]["flows_processed"] == 9 and forced["r1"]["start_time"] == T0
    for fmt in ("json", "csv"):
        T.write_metrics(run, str(tmp_path / fmt), fmt)
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    with pytest.raises(ValueError):
        T.write_metrics(run, str(tmp_path / "x"), "xml")
    for name in ("one.csv", "two.csv"):
        (tmp_path / name).write_text("Label, Dst Port\nBot,22\n")
    assert T.discover(spark, [str(tmp_path)], expected=None).where("path LIKE '%one.csv'").count() == 1
    with pytest.raises(ValueError):
        T.discover(spark, [str(tmp_path)], expected=10)


def test_flow_files_are_united_by_name(spark, tmp_path):
    head = RAW_COLUMNS
    (tmp_path / "a.csv").write_text(",".join(head) + "\n" + ",".join(["1"] * 79 + ["Bot"]) + "\n")
    other = ["Flow ID", *reversed([f" {c}" for c in head])]
    (tmp_path / "b.csv").write_text(",".join(other) + "\n" + ",".join(["id", "Benign", *["2"] * 79]) + "\n")
    df = T.read_flow_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert df.columns == [*RAW_COLUMNS, "source_file"]
    assert {(r["Label"], r["Dst Port"], r["source_file"]) for r in df.collect()} == {("Bot", "1", "a.csv"), ("Benign", "2", "b.csv")}


def test_comparison_and_scores(spark):
    a = spark.createDataFrame([(1, True, "Bot", "HIGH"), (2, False, "Benign", "NONE")], "id int, is_attack boolean, attack_type string, severity string")
    assert E.comparison_flag(E.compare_predictions(a, a, "id")).first()["passed"]
    assert not E.comparison_flag(E.compare_predictions(a, a.where("id = 1"), "id")).first()["passed"]
    none = E.binary_metrics(spark.createDataFrame([(0.0, 0.0)], "label double, prediction double")).first()
    assert none["precision"] == 0 and none["f1"] == 0 and none["accuracy"] == 1


def test_flow_files_are_compressed(spark, sf_dir):
    from packetloom import catalog

    t = catalog.Inputs(spark, sf_dir)
    rows = t.lineitem.count()
    files = T.discover(spark, [catalog._four_files(t)], expected=4).collect()
    assert all(f["path"].endswith(".csv.gz") for f in files) and sum(f["length"] for f in files) < 100 * rows


def test_flow_files_are_packed_in_pieces(spark, sf_dir):
    from packetloom import catalog

    t, tasks = catalog.Inputs(spark, sf_dir), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        files = [r.path.removeprefix("file:") for r in T.discover(spark, [catalog._four_files(t)], expected=4).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    lines = []
    for path in files:
        data, members = open(path, "rb").read(), 0
        while data:  # a gzip file is members one after the other: here the header and a piece of each of two tasks
            one = zlib.decompressobj(31)
            text = one.decompress(data).decode().splitlines()
            lines += text if members else []
            members, data = members + 1, one.unused_data
        assert members == 3 and gzip.open(path, "rt").readline() == ",".join(RAW_COLUMNS) + "\n"
    assert sorted(lines) == sorted(",".join(x or "" for x in r) for r in catalog.raw_file(t).collect())


def test_headers_are_found_without_reading_the_files(spark, tmp_path):
    """Of a file that breaks off the first lines are there all the same."""
    path = tmp_path / "a.csv.gz"
    body = "".join(",".join([str(hash((i, k))) for k in range(79)] + ["Bot"]) + "\n" for i in range(5_000))
    path.write_bytes(gzip.compress((",".join(RAW_COLUMNS) + "\n" + body).encode())[:-200_000])
    df = T.read_flow_files(spark, [str(path)])
    assert df.columns == [*RAW_COLUMNS, "source_file"] and df.first()["Label"] == "Bot"

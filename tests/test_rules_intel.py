"""Rules, indicators, mapping, identity and workflow on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from packetloom.operators import alerts as A, intel as N, rules as D

T0 = dt.datetime(2024, 3, 2, 12, 0, 0)
SCHEMA = ("alert_id string, event_time timestamp, attack_type string, severity string, confidence double, "
          "source_ip string, destination_ip string")


def alerts(spark, *rows):
    full = [(f"a{i}", T0 + dt.timedelta(seconds=t), kind, sev, 0.92, src, "192.0.2.1")
            for i, (t, kind, sev, src) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def indicators(spark, *rows):
    return N.prepare_indicators(spark.createDataFrame(
        [(*r, T0) for r in rows],
        "indicator_type string, indicator_value string, threat_name string, confidence double, severity string, observed_at timestamp"))


def test_thresholds(spark):
    three = alerts(spark, *[(i * 10, "SSH-Bruteforce", "HIGH", "10.0.0.5") for i in range(3)])
    got = D.evaluate_rules(three).collect()
    assert [(r["alert_id"], r["rule_id"]) for r in got] == [("a2", "RULE-001")]
    assert got[0]["reason"] == "Detected 3 SSH brute-force alerts from source '10.0.0.5' (Threshold: 3)."
    assert got[0]["evidence"]["ssh_count"] == "3"
    assert D.evaluate_rules(three, config={"ssh_alert_threshold": 5}).isEmpty()
    apart = alerts(spark, *[(i * 200, "FTP-BruteForce", "LOW", "10.0.0.5") for i in range(3)])
    assert D.evaluate_rules(apart).isEmpty()
    edge = alerts(spark, *[(i * 150, "FTP-BruteForce", "LOW", "10.0.0.5") for i in range(3)])
    assert [r["rule_id"] for r in D.evaluate_rules(edge).collect()] == ["RULE-002"]


def test_flood_rule_ignores_source_and_missing_source_counts_all(spark):
    flood = alerts(spark, *[(i, "DDOS attack-HOIC", "HIGH", f"10.0.0.{i}") for i in range(5)])
    assert [(r["alert_id"], r["rule_id"]) for r in D.evaluate_rules(flood).collect()] == [("a4", "RULE-003")]
    mixed = alerts(spark, (0, "Bot", "CRITICAL", "10.0.0.1"), (1, "Bot", "CRITICAL", "10.0.0.2"), (2, "Bot", "critical", None))
    got = D.evaluate_rules(mixed).collect()
    assert [(r["alert_id"], r["rule_id"]) for r in got] == [("a2", "RULE-004")] and "'Local'" in got[0]["reason"]


def test_one_hot_source(spark):
    rows = [(i * 0.25, "SSH-Bruteforce", "HIGH", "10.0.0.5") for i in range(4000)]
    got = D.rule_counters(alerts(spark, *rows)).agg(F.max("ssh_count"), F.count("*"), F.sum("ssh_count")).first()
    want = [min(i, 1200) + 1 for i in range(4000)]
    assert tuple(got) == (max(want), 4000, sum(want))


def test_enrichment(spark):
    known = indicators(spark, ("IP", " 10.0.0.5 ", "Bad Host", 0.8, "critical"), ("IP", "192.0.2.1", "Bad Target", 0.7, "HIGH"))
    rows = {r["alert_id"]: r for r in D.enrich_alerts(alerts(
        spark, (0, "SSH-Bruteforce", "HIGH", "10.0.0.5"), (1, "Novel", "LOW", "10.0.0.6")), known).collect()}
    a, b = rows["a0"], rows["a1"]
    assert a["intel_threat_name"] == "Bad Host" and a["model_confidence"] == 0.92 and a["intel_confidence"] == 0.8
    assert a["attack_mapping"]["technique_id"] == "T1110" and a["rules_triggered"][0]["rule_id"] == "RULE-005"
    assert b["intel_threat_name"] == "Bad Target" and b["attack_mapping"]["mapping_status"] == "UNMAPPED"
    assert b["attack_mapping"]["technique_id"] is None and b["attack_mapping"]["confidence"] == 0.0
    assert D.rule_catalogue(spark).count() == 5


@pytest.mark.parametrize("kind,value,valid", [
    ("IP", "102.202.290.1", False), ("IP", "192.0.2.100", True), ("ip", "::1", True), ("IP", "2001:db8::8:1", True),
    ("IP", "1:2:3:4:5:6:7", False), ("IP", "1::2::3", False), ("IP", "::ffff:10.0.0.1", True), ("IP", "01.2.3.4", False),
    ("IP", "1:2:3:4:5:6:7:8", True), ("IP", "12345::", False), ("DOMAIN", "invalid_domain_name", False),
    ("DOMAIN", "malicious-domain.com", True), ("URL", "http://a.b/c", True), ("URL", "a.b/c", False), ("URL", "http:///x", False),
    ("HASH", "d41d8cd98f00b204e9800998ecf8427e", True), ("HASH", "xyz", False), ("HASH", "ab" * 21, False), ("IP", "  ", False),
])
def test_indicator_formats(spark, kind, value, valid):
    df = spark.createDataFrame([(kind, value)], "indicator_type string, indicator_value string")
    assert N.validate_indicators(df).first()["valid"] is valid


def test_indicator_upsert_and_expiry(spark):
    old = indicators(spark, ("IP", "10.0.0.5", "Old", 0.5, "LOW"))
    new = old.withColumns({"threat_name": F.lit("New"), "last_seen": F.col("last_seen") + F.expr("INTERVAL 1 DAY"),
                           "first_seen": F.col("first_seen") + F.expr("INTERVAL 1 DAY")})
    row = N.upsert_indicators(old, new).first()
    assert row["threat_name"] == "New" and row["first_seen"] == T0 and row["last_seen"] == T0 + dt.timedelta(days=1)
    assert N.remove_indicators(old, new).isEmpty() and N.list_indicators(old, "ip").count() == 1
    dead = old.withColumn("expires_at", F.lit(T0))
    one = alerts(spark, (0, "Bot", "LOW", "10.0.0.5"))
    assert N.match_indicators(one, dead).first()["intel"] is not None
    assert N.match_indicators(one, dead, as_of=T0 + dt.timedelta(days=1)).first()["intel"] is None


def test_equal_alerts_get_distinct_repeatable_ids(spark):
    rows = spark.createDataFrame(
        [(i, T0, "Bot", "HIGH", 22, 6, 0.5 if i < 90 else 0.25, " given " if i == 7 else None) for i in range(100)],
        "seq long, Timestamp timestamp, attack_type string, severity string, Dst_Port int, Protocol int, attack_probability double, own string")
    a = A.with_alert_ids(rows.repartition(7), "seq", supplied="own").select("seq", "alert_id", "occurrence")
    b = A.with_alert_ids(rows.coalesce(1), "seq", supplied="own").select("seq", "alert_id", "occurrence")
    assert a.exceptAll(b).isEmpty() and a.select("alert_id").distinct().count() == 100
    assert a.where("seq = 7").first()["alert_id"] == "given" and a.where("occurrence = 89").count() == 1


def test_same_alerts_stored_twice(spark, tmp_path):
    scored = spark.createDataFrame([(i, T0, 22.0, "6", "Bot", "HIGH", 0.9) for i in range(5)],
                                   "flow_id long, Timestamp timestamp, Dst_Port double, Protocol string, attack_type string, severity string, attack_probability double")
    stored = A.stored_alerts(scored, "flow_id", T0)
    path = str(tmp_path / "alerts")
    assert A.append_alerts(stored, path, only_count=True) == 5
    assert A.append_alerts(stored, path, only_count=True) == 0
    row = spark.read.parquet(path).first()
    assert (row["protocol"], row["destination_port"], row["status"], row["confidence"]) == ("TCP", 22, "NEW", 0.9)


def flows_with_copies(spark, n):
    """Scored flows, most in groups of equal alerts, a seventh of them in one group, some without a time."""
    i = F.col("id")
    kind = F.when(i % 7 == 0, 0).otherwise(i % 50)
    return spark.range(n).select(
        i.alias("flow_id"), F.when(kind != 3, F.timestamp_seconds(F.lit(1_700_000_000) + kind * 900_000)).alias("Timestamp"), F.lit("Bot").alias("attack_type"),
        F.lit("HIGH").alias("severity"), F.lit(22.0).alias("Dst_Port"), F.lit("6").alias("Protocol"), F.lit(0.5).alias("attack_probability"))


@pytest.mark.parametrize("part,groups", [(500_000, 4096), (40, 8), (1, 1)])
def test_many_equal_alerts_are_numbered_in_chunks(spark, monkeypatch, part, groups):
    rows = flows_with_copies(spark, 700)
    monkeypatch.setattr(A, "_PART", part)
    monkeypatch.setattr(A, "_GROUPS", groups)
    got = A.with_alert_ids(rows, "flow_id").collect()
    seen, whole = {}, {}
    for r in sorted(got, key=lambda r: r["flow_id"]):
        key = r["Timestamp"]
        assert r["occurrence"] == seen.get(key, 0)
        seen[key] = r["occurrence"] + 1
        whole.setdefault(r["alert_digest"], r)
    assert len(got) == len(whole) == 700 and seen[dt.datetime(2023, 11, 14, 22, 13, 20)] >= 100


def test_stored_alerts_are_not_shuffled_for_a_batch(spark, tmp_path):
    """What a batch moves follows from the batch, not from the table it is compared with."""
    path, no_broadcast = str(tmp_path / "alerts"), "spark.sql.autoBroadcastJoinThreshold"
    all_rows = flows_with_copies(spark, 40_000).withColumn("Dst_Port", F.col("flow_id") + 0.0)
    all_rows.write.parquet(f"{path}-flows")
    flows = spark.read.parquet(f"{path}-flows")

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    def append(where):
        return A.append_alerts(A.stored_alerts(flows.where(where), "flow_id", T0), path, only_count=True)

    assert append("flow_id < 39800") == 39_800
    before = spark.conf.get(no_broadcast)
    spark.conf.set(no_broadcast, "-1")
    try:
        begun = moved()
        assert append("flow_id >= 39700") == 200
        assert moved() - begun < 300_000  # the digests alone have 2.5 MB
    finally:
        spark.conf.set(no_broadcast, before)


@pytest.mark.parametrize("few,bitmaps,numbered", [(0, 1, True), (200_000, 8192, True), (0, 1, False)])
def test_alerts_delivered_again_are_all_known(spark, tmp_path, monkeypatch, few, bitmaps, numbered):
    monkeypatch.setattr(A, "_FEW", few)
    monkeypatch.setattr(A, "_MOST_BITMAPS", bitmaps)
    flows, path = flows_with_copies(spark, 3_000), str(tmp_path / "alerts")

    def append(where):
        return A.append_alerts(A.stored_alerts(flows.where(where), "flow_id", T0), path, only_count=True, numbered=numbered)

    assert append("flow_id < 2000") == 2_000
    wanted = {r["alert_digest"] for r in A.stored_alerts(flows, "flow_id", T0).collect()}
    assert append("flow_id < 3000") == 1_000 and append("flow_id < 3000") == 0 and append("flow_id < 0") == 0
    got = [r["alert_digest"] for r in spark.read.parquet(path).collect()]
    assert len(got) == 3_000 and set(got) == wanted


def test_limits(spark):
    df = alerts(spark, (0, "Bot", "LOW", None)).withColumns({"status": F.lit("NEW"), "created_at": F.col("event_time")})
    assert A.newest_alerts(df, 1, severity="low").count() == 1 and A.lookup(df, "alert_id", "a0").count() == 1
    for bad in (0, 10_001):
        with pytest.raises(ValueError):
            A.newest_alerts(df, bad)
    changes = spark.createDataFrame([("a0", "nonsense"), ("a0", None), ("a0", "new")], "alert_id string, status string")
    assert A.rejected_changes(changes).count() == 2


def test_supplied_id_in_two_months_is_one_alert(spark, tmp_path):
    path = str(tmp_path / "alerts")
    first = spark.createDataFrame([("X1", "2024-01-31 10:00:00", "NEW"), ("X2", "2024-01-31 10:00:00", "NEW")], "alert_id string, event_time string, status string")
    again = spark.createDataFrame([("X1", "2024-02-01 10:00:00", "RESOLVED"), ("X3", "2024-02-01 10:00:00", "NEW"), ("X3", "2024-03-01 10:00:00", "NEW")],
                                  "alert_id string, event_time string, status string")
    assert A.append_alerts(first, path, only_count=True) == 2
    assert A.append_alerts(again, path, only_count=True) == 1
    assert sorted((r.alert_id, r.status) for r in spark.read.parquet(path).collect()) == [("X1", "NEW"), ("X2", "NEW"), ("X3", "NEW")]


def test_alerts_with_equal_printed_ids_are_told_apart(spark, tmp_path):
    path, rows = str(tmp_path / "alerts"), [("same", "d1", "2024-01-31 10:00:00"), ("same", "d2", "2024-01-31 10:00:00")]
    df = spark.createDataFrame(rows, "alert_id string, alert_digest string, event_time string")
    assert A.append_alerts(df.limit(1), path, only_count=True) == 1
    assert A.append_alerts(df, path, only_count=True, derived=True) == 1 and spark.read.parquet(path).count() == 2


def test_keys_are_whole_digests(spark):
    from packetloom.operators.incidents import incident_id, incident_label
    from packetloom.operators.intel import indicator_id

    row = spark.range(1).select(incident_id(F.lit(T0).cast("timestamp"), F.lit("a")).alias("i"), indicator_id(F.lit("IP"), F.lit("10.0.0.1")).alias("n"))
    row = row.withColumn("short", incident_label(F.col("i"))).first()
    assert len(row["i"]) == len("INC-20240101-") + 32 and len(row["n"]) == len("IND-") + 32 and row["i"].startswith(row["short"])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from packetloom.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)
    cluster.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared_dir(cluster)

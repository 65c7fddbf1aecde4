"""Training, two-stage scoring and the scoring stream."""

import pytest
from pyspark.sql import functions as F

from packetloom import catalog
from packetloom.operators import models as M
from packetloom.sources import tables as T
from packetloom.streaming import streams as ST


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    t = catalog.Inputs(spark, sf_dir)
    return t, *catalog.trained(t)


def test_two_stage_scores(inputs):
    t, detector, classifier = inputs
    rows = catalog.model_rows(t)
    out = M.score_two_stage(rows, detector, classifier).cache()
    assert out.count() == rows.count() and set(rows.columns) < set(out.columns)
    bad = out.where(
        "(NOT is_attack AND (attack_type <> 'Benign' OR severity <> 'NONE' OR stage2_confidence <> 0 OR confidence <> stage1_confidence)) "
        "OR (is_attack AND abs(confidence - stage1_confidence * stage2_confidence) > 1e-12) OR confidence NOT BETWEEN 0 AND 1")
    assert bad.isEmpty()
    assert "Unknown" not in {r[0] for r in out.select("attack_type").distinct().collect()}
    assert M.detected_only(out).count() == out.where("is_attack").count()


def test_forests_learn_what_there_is_to_learn(spark, inputs):
    """The table's labels are nearly independent of its features; here they follow them, and unseen rows are judged."""
    rows = catalog.model_rows(inputs[0])
    kind = F.when(F.col("Tot_Fwd_Pkts") <= 25, "Benign").when(F.col("Dst_Port") < 50, "Bot").when(F.col("Dst_Port") < 500, "SQL Injection").otherwise("SSH-Bruteforce")
    rows = rows.withColumns({"Label": kind, "attack_label": kind}).withColumn("stage1_label", (F.col("Label") != "Benign").cast("double"))
    train, test = catalog.S.split_by_hash(rows, ["flow_id"])
    out = M.score_two_stage(test, M.train_detector(train, catalog._MODEL_FEATURES), M.train_classifier(train, catalog._MODEL_FEATURES)).cache()
    assert out.where("is_attack = (Label <> 'Benign')").count() / out.count() > 0.97
    hits = out.where("is_attack AND Label <> 'Benign'")
    assert hits.where("attack_type = Label").count() / hits.count() > 0.97


def test_flat_forests_equal_a_plain_walk(spark, inputs):
    """Against the stored nodes followed one by one, with missing, infinite and boundary values."""
    import numpy as np

    from packetloom.operators.forests import FlatForest, flat, node_table

    path = catalog.new_path(spark, "forest")
    inputs[1].stages[-1].write().save(path)
    nodes = {(n["tree"], n["id"]): n for n in node_table(spark, path).collect()}
    names, forest = flat(inputs[1], spark)
    rng = np.random.default_rng(1)
    limits = [n["limit"] for n in nodes.values() if n["feature"] >= 0]
    x = rng.choice(np.array([*limits, np.nan, np.inf, -np.inf, 0.0]), (300, len(names)))

    def plain(row):
        total = np.zeros(2)
        for tree in range(1 + max(k for k, _ in nodes)):
            n = nodes[tree, 0]
            while n["feature"] >= 0:
                n = nodes[tree, n["left"] if row[n["feature"]] <= n["limit"] else n["right"]]
            total += np.array(n["counts"]) / sum(n["counts"])
        return total

    assert np.allclose(forest.value.raw(x), [plain(r) for r in x], rtol=0, atol=1e-12)
    assert forest.value.raw(x[:0]).shape == (0, 2)
    lone = FlatForest.of_nodes([(0, 0, -1, None, -1, -1, [3.0])])
    assert lone.depth == 0 and lone.shares(lone.raw(x[:2])).tolist() == [[1.0, 0.0]] * 2


def test_scoring_stores_and_shuffles_nothing(inputs):
    """One pass: no exchange, and only features reach Python."""
    t, detector, classifier = inputs
    plan = M.score_two_stage(catalog.model_rows(t), detector, classifier)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_detect_and_summary(inputs):
    t, detector, _ = inputs
    found = M.detect(catalog.model_rows(t), detector, 0.7)
    assert found.where("is_attack <> (attack_probability >= 0.7)").isEmpty()
    alerts = M.make_alerts(found.withColumn("attack_type", F.col("Label")))
    parts = M.alert_summary(alerts).groupBy("section").agg(F.sum("count").alias("n")).collect()
    assert {r["section"] for r in parts} == {"attack_type", "severity", "port"} and len({r["n"] for r in parts}) == 1
    assert M.top_alerts(alerts, 3, "flow_id").count() == 3


def test_weights_labels_and_leakage(inputs, tmp_path):
    t, _, classifier = inputs
    rows, test = catalog.S.split_by_hash(catalog.model_rows(t), ["flow_id"])
    weighted = M.train_detector(rows, catalog._MODEL_FEATURES, weighted=True)
    assert M.detect(test, weighted).count() == test.count()
    path = str(tmp_path / "model")
    T.save_model(classifier, path)
    assert M.class_labels(T.load_model(path)) == M.class_labels(classifier)
    importance, quality = M.leakage_report(classifier, test.where("IsAttack = 1"), catalog._MODEL_FEATURES)
    assert {r["feature"] for r in importance.collect()} == {"Hour", "DayOfWeek"} and quality.first()["samples"] == test.where("IsAttack = 1").count()


def test_scoring_stream(inputs, spark, tmp_path):
    t, detector, classifier = inputs
    rows, root = catalog.model_rows(t), str(tmp_path)
    for part in rows.randomSplit([1.0, 1.0], seed=3):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    feed = T.flow_stream(spark, f"{root}/in", rows.schema, 1)
    alerts, cards = ST.stream_score(feed, detector, classifier, root)
    batch = M.score_two_stage(rows, detector, classifier)
    total = ST.telemetry(spark, cards).first()
    attacks = batch.where("is_attack").count()
    assert total["flows_processed"] == rows.count() and total["predicted_attacks"] == attacks
    assert total["ground_truth_attacks"] == rows.where("IsAttack = 1").count()
    # flows equal in all six key fields within a batch are told apart by their occurrence
    assert total["alerts_generated"] == spark.read.parquet(alerts).count() <= attacks
    again = ST.score_batch(detector, classifier, alerts, cards)
    again(rows.limit(0), 99)
    assert spark.read.parquet(alerts).count() == total["alerts_generated"]


def test_session_stream_and_progress(spark, sf_dir):
    t = catalog.Inputs(spark, sf_dir)
    out = ST.stream_sessions(catalog.events_stream(t, "alerts"), 21_600)
    with ST.ProgressLog(spark, catalog.new_path(spark, "progress")) as log:
        query = out.writeStream.format("memory").queryName("sessions").trigger(availableNow=True).start()
        query.awaitTermination()
        progress = ST.stream_progress(log, query).collect()
    from packetloom.operators import incidents as I

    none = F.lit(None).cast("string")
    batch = I.correlate(t.alerts.withColumns({"source_ip": none, "destination_ip": none}), 21_600, strict=False)
    closed = {r["incident_id"]: r["alert_count"] for r in spark.table("sessions").collect()}
    counts = {r["incident_id"]: r["count"] for r in batch.groupBy("incident_id").count().collect()}
    assert closed and all(counts[k] == n for k, n in closed.items())
    assert sum(r["input_rows"] for r in progress) == t.events.count() and any(r["state_rows"] for r in progress)


def test_progress_of_more_batches_than_the_engine_keeps(spark, tmp_path):
    spark.range(0, 105, 1, 105).write.parquet(f"{tmp_path}/in")
    files = spark.read.parquet(f"{tmp_path}/in").select("_metadata.file_path").distinct().count()
    feed = T.flow_stream(spark, f"{tmp_path}/in", spark.range(1).schema, 1)
    with ST.ProgressLog(spark, f"{tmp_path}/log") as log:
        query = feed.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = ST.stream_progress(log, query).collect()
    assert files > 100 and sorted(r["batch"] for r in rows if r["input_rows"]) == list(range(files))
    assert sum(r["input_rows"] for r in rows) == 105 and len(query.recentProgress) <= 100 < len(rows)


def test_late_rows_are_kept_and_a_batch_can_run_again(spark, tmp_path):
    at = f"{tmp_path}/rows", f"{tmp_path}/c"
    for rows in ([("2024-01-01 12:00:00", 1), (None, 2)], [("2024-01-01 11:50:00", 3), ("2024-01-01 11:49:59", 4)], []):
        df = spark.createDataFrame(rows, "event_time string, k int").select(F.to_timestamp("event_time").alias("event_time"), "k")
        df.write.mode("append").parquet(f"{tmp_path}/in")
        out = ST.late_rows(T.flow_stream(spark, f"{tmp_path}/in", df.schema, 100), at=at)
    assert sorted((r["k"], r["late"], r["behind_seconds"]) for r in out.collect()) == [(1, False, None), (2, False, None), (3, False, None), (4, True, 1.0)]

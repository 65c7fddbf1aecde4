"""The skew-proof plan shapes against direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.plans.numbering import number_rows
from packetloom.plans.quantiles import exact_percentiles
from packetloom.plans.sessions import assign_sessions
from packetloom.plans.trailing import trailing_sums


@pytest.mark.parametrize("seed,slices,span", [(1, 32, 1000), (2, 1, 1000), (3, 7, 997), (4, 32, 3)])
def test_trailing_sums(spark, seed, slices, span):
    rnd = random.Random(seed)
    rows = [(i, "hot" if rnd.random() < 0.7 else rnd.choice("ab"), rnd.randrange(-500, 20_000), rnd.randrange(3), 1)
            for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k string, t long, a int, b int").repartition(6)
    for scope in (["k"], []):
        got = trailing_sums(df, scope, "t", span, {"sa": "a", "sb": "b"}, slices).collect()
        assert len(got) == len(rows)
        for r in got:
            near = [x for x in rows if r["t"] - span <= x[2] <= r["t"] and (not scope or x[1] == r["k"])]
            assert (r["sa"], r["sb"]) == (sum(x[3] for x in near), len(near))


@pytest.mark.parametrize("values", [
    [5.0] * 50, [1.0, 2.0], [3.5], list(range(101)), [0.1] * 300 + [0.1 + i * 1e-12 for i in range(200)] + [1e9],
])
def test_exact_percentiles(spark, values):
    values = [float(v) for v in values]
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.99, "f": 1.0}
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
    got = exact_percentiles(df, "x", probs).first()
    for k, p in probs.items():
        assert got[k] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


@pytest.mark.parametrize("values", [
    [10.0 ** (12 * k / 3000) for k in range(3000)], [float("inf")] * 40 + [float("-inf")] * 30 + [float(k % 97) for k in range(3000)],
    [5.0] * 2000 + [6.0, 7.0], [float("inf")] * 500, [-1e300, 1e300] * 400,
])
def test_percentiles_of_many_values(spark, values):
    """Brackets instead of one buffer: magnitudes over twelve decades, infinite values, copies."""
    random.Random(1).shuffle(values)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.99, "f": 1.0}
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
    got, plain = exact_percentiles(df, "x", probs, limit=50).first(), exact_percentiles(df, "x", probs).first()
    assert [got[k] for k in probs] == pytest.approx([plain[k] for k in probs], rel=1e-12)


def test_model_monitor_jobs(spark, sf_dir):
    from packetloom.operators import soc as O
    from packetloom.plans.views import view

    alerts = view(spark, sf_dir, "alerts")
    spark.sparkContext.setJobGroup("monitor", "monitor")
    O.model_monitor(alerts, "7d").collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("monitor")
    spark.sparkContext.setJobGroup("", "")
    assert 0 < len(jobs) <= 8


def test_ranges_are_even_in_spite_of_a_stray(spark):
    from packetloom.plans.numbering import ranged

    df = spark.range(4000).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, -(2**60)).otherwise(F.lit(2**40) + F.col("id") % 50).alias("v"), "id")
    sizes = [r["count"] for r in ranged(df, ["k"], "v", ("id",)).groupBy("_chunk").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * 4000 / len(sizes)


def test_number_rows(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else "cold", rnd.choice([rnd.randrange(10), rnd.randrange(2**40)]), i)
            for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long, id int")
    got = {r["id"]: r["n"] for r in number_rows(df, ["k"], "v", "n", ("id",), chunks=16).collect()}
    for key in ("hot", "cold"):
        for n, r in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == key), start=1):
            assert got[r[1]] == n
    kept = number_rows(df.withColumn("q", F.lit(7)), ["k"], "v", "n", ("id",), keep_upto="q")
    assert kept.count() == 14 and kept.agg(F.max("n")).first()[0] == 7


@pytest.mark.parametrize("width", [7, 100, 5000])
def test_sessions_of_the_whole_input(spark, width):
    rnd, t, rows = random.Random(width), 0, []
    for i in range(300):
        t += rnd.choice([0, 3, 10, 11, 60])
        rows.append((i, t, rnd.random() < 0.1))
    df = spark.createDataFrame(rows, "id int, t long, fin boolean").repartition(4)
    got = {r["id"]: r["session_seq"] for r in assign_sessions(df, [], "t", "id", 10, width, cut="fin").collect()}
    start, before = 0, None
    for i, t, fin in rows:
        if before is None or t - before[1] > 10 or before[2]:
            start = i
        assert got[i] == start
        before = (i, t, fin)


def _text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark, sf_dir):
    from packetloom.operators import flows as FL, intel as N, reports as R, rules as D, soc as O
    from packetloom.plans.views import view

    flows, alerts = view(spark, sf_dir, "flows"), view(spark, sf_dir, "alerts")
    plan = _text(R.hourly_concentration(flows))
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]
    # a filter on a plain column of the alert table reaches the scan
    assert "EqualTo(event_type,error)" in _text(spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'"))
    for df in (R.traffic_characteristics(flows), D.rule_counters(alerts), O.model_monitor(alerts, "7d"),
               FL.flow_features(view(spark, sf_dir, "packets"), 10_800)):
        text = _text(df)
        assert "Python" not in text and "InPandas" not in text and "CartesianProduct" not in text
    assert "WindowGroupLimit" in _text(O.top_entities(alerts, 10, "all"))
    assert "BroadcastHashJoin" in _text(N.map_techniques(alerts))
    assert "TakeOrderedAndProject" in _text(R.targeted_ports(flows))
    packets = view(spark, sf_dir, "packets")
    runs = FL._runs(packets, 10_000_000, 60_000_000, "packet_time", "seq")
    assert _text(runs).count("Exchange hashpartitioning") == 1  # one shuffle of the packets

"""Windows answered from a rollup equal those over the alerts themselves."""

import datetime

import pytest
from pyspark.sql import functions as F

from packetloom.operators import soc
from packetloom.operators.rollup import RANK_ERROR, Rollup
from packetloom.plans.views import view

AS_OF = "2024-01-10 12:34:56.789"


@pytest.fixture(scope="module")
def alerts(spark, tmp_path_factory):
    """Three days of alerts, a few without time, severity, confidence or address."""
    n = F.col("id")
    at = F.timestamp_micros(F.lit(1_704_700_800_000_000) + n * 37_123_457)
    rows = spark.range(8000).select(
        F.concat(F.lit("A"), n).alias("alert_id"), F.when(n % 97 != 0, at).alias("created_at"),
        F.when(n % 89 != 0, at - F.expr("INTERVAL 40 SECONDS")).alias("event_time"),
        F.when(n % 3 == 0, "BENIGN").when(n % 3 == 1, "Bot").when(n % 101 != 0, "DoS attacks-Hulk").alias("attack_type"),
        F.when(n % 11 != 0, (n % 1000) / 1000).alias("confidence"),
        F.when(n % 5 == 0, "critical").when(n % 5 == 1, "LOW").when(n % 5 == 2, "MEDIUM").otherwise("HIGH").alias("severity"),
        F.when(n % 7 != 0, F.concat(F.lit("10.0.0."), n % 200)).alias("source_ip"), F.lit("10.1.1.1").alias("destination_ip"),
        F.when(n % 2 == 0, "tcp").when(n % 13 == 0, "").otherwise("gre").alias("protocol"),
        F.when(n % 4 == 0, "RESOLVED").otherwise("NEW").alias("status"))
    path = str(tmp_path_factory.mktemp("alerts") / "t")
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rollup(spark, alerts, tmp_path_factory):
    out = Rollup(spark, str(tmp_path_factory.mktemp("rollup")))
    odd = F.crc32("alert_id") % 2 == 1
    out.extend(alerts.where(~odd), "0")
    out.extend(alerts.where(odd), "1")
    out.extend(alerts.where(odd), "1")  # delivered again after a failure
    return out


@pytest.mark.parametrize("window,as_of", [("15m", None), ("1h", AS_OF), ("24h", AS_OF), ("7d", None), ("all", None)])
def test_answers(spark, alerts, rollup, window, as_of):
    have = rollup.window(alerts, window, as_of)
    cases = view(spark, "/root/testdata/sf0.001", "cases")
    assert have.soc_summary(cases).collect() == soc.soc_summary(alerts, cases, window, as_of).collect()
    assert have.severity_distribution().collect() == soc.severity_distribution(alerts, window, as_of).collect()
    assert have.protocol_distribution().collect() == soc.protocol_distribution(alerts, window, as_of).collect()
    assert have.attack_distribution().collect() == soc.attack_distribution(alerts, window, as_of).collect()
    assert have.activity_trends().collect() == soc.activity_trends(alerts, window, as_of).collect()


def test_monitor_and_addresses(alerts, rollup):
    have = rollup.window(alerts, "24h", AS_OF).model_monitor().first().asDict()
    want = soc.model_monitor(alerts, "24h", AS_OF).first().asDict()
    values = [r.c or 0.0 for r in soc.in_window(alerts, "24h", AS_OF).select(F.col("confidence").alias("c")).collect()]
    for name, p in soc.PERCENTILES.items():
        value = have.pop(name)
        want.pop(name)
        assert sum(v < value - 1e-4 for v in values) / len(values) - RANK_ERROR <= p
        assert sum(v <= value + 1e-4 for v in values) / len(values) + RANK_ERROR >= p
    assert have == want
    seen = rollup.window(alerts, "all").distinct_addresses().first()
    assert abs(seen.sources - 201) <= 5 and seen.destinations == 1


def test_change_of_status_and_compaction(spark, alerts, rollup, tmp_path):
    own = rollup.compact(str(tmp_path / "own"))  # a copy that the change does not share
    before = alerts.where("status = 'NEW' AND severity = 'LOW'")
    after = before.withColumns({"status": F.lit("RESOLVED"), "severity": F.lit("HIGH")})
    own.restate(before, after, "change")
    now = alerts.where("status <> 'NEW' OR severity <> 'LOW'").unionByName(after)
    merged = own.compact(str(tmp_path / "merged"))
    cases = view(spark, "/root/testdata/sf0.001", "cases")
    for r in (own, merged):
        assert r.window(now, "24h", AS_OF).soc_summary(cases).collect() == soc.soc_summary(now, cases, "24h", AS_OF).collect()
    assert merged._read("cells").groupBy(*["minute", "event_minute", "attack_type", "severity", "protocol", "status"]).count().where("count > 1").isEmpty()


def test_only_the_cut_minute_is_read(alerts, rollup):
    window = rollup.window(alerts, "24h", AS_OF)
    plan = window.cells._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(created_at," in plan and "LessThan(created_at," in plan
    cut = alerts.where((F.col("created_at") >= "2024-01-09 12:34:56.789") & (F.col("created_at") < "2024-01-09 12:35:00"))
    states = window.cells.where(F.col("minute") == datetime.datetime(2024, 1, 9, 12, 34)).agg(F.sum("alerts")).first()[0]
    assert (states or 0) == cut.count()


def test_empty(spark, alerts, tmp_path):
    none = Rollup(spark, str(tmp_path))
    none.extend(alerts.limit(0), "0")
    cases = view(spark, "/root/testdata/sf0.001", "cases")
    got = none.window(alerts.limit(0), "24h").soc_summary(cases).first()
    assert got.total_alerts == 0 and got.mean_confidence is None

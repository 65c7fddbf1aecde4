"""Correlation against a sequential fold written from the rules, and the hand cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions import scoring
from packetloom.operators import incidents as I
from packetloom.plans import speculation
from packetloom.streaming import streams as ST
from packetloom.streaming.held_incidents import HeldIncidents

T0 = dt.datetime(2024, 3, 2, 12, 0, 0)
SCHEMA = ("alert_id string, event_time timestamp, attack_type string, severity string, confidence double, "
          "destination_port int, protocol string, source_ip string, destination_ip string")


def alert(aid, t, kind="SSH-Bruteforce", sev="HIGH", conf=0.95, port=22, src="10.0.0.5", dst="192.168.1.1", proto="TCP"):
    return (aid, T0 + dt.timedelta(seconds=t), kind, sev, conf, port, proto, src, dst)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sequential(rows, window, changes=()):
    """alert id -> number of its incident, by going through all alerts in order."""
    incidents, where = [], {}
    events = [(r[1], 1, r[0], r) for r in rows] + [(c[0], 2, c[1], c) for c in changes]
    for t, what, aid, r in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if what == 2:
            incidents[where[r[1]]]["open"] = r[2]
            continue
        _, _, kind, _, _, port, _, src, dst = r
        order = sorted(range(len(incidents)), key=lambda i: (incidents[i]["seen"], incidents[i]["touch"]), reverse=True)
        for i in order:
            one = incidents[i]
            if not one["open"] or abs((t - one["seen"]).total_seconds()) > window:
                continue
            if src and one["src"] and src not in one["src"]:
                continue
            type_, d, p = kind == one["kind"], bool(dst) and dst in one["dst"], bool(port) and port in one["port"]
            if (src and src in one["src"] and (type_ or d or p)) or (d and (type_ or p)) or (type_ and p):
                break
        else:
            i = len(incidents)
            incidents.append({"kind": kind, "src": set(), "dst": set(), "port": set(), "open": True})
        one = incidents[i]
        one["seen"], one["touch"] = t, (t, aid)
        for name, v in (("src", src), ("dst", dst), ("port", port)):
            if v is not None:
                one[name].add(v)
        where[aid] = i
    return where


def groups(mapping):
    out = {}
    for aid, inc in mapping.items():
        out.setdefault(inc, set()).add(aid)
    return sorted(map(sorted, out.values()))


def found(df):
    return groups({r["alert_id"]: r["incident_id"] for r in df.collect()})


def random_alerts(n, seed, src=True, dst=True):
    rnd, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rnd.choice([0, 1, 20, 100, 299, 300, 301, 900])
        rows.append(alert(
            f"a{i:05d}", t, rnd.choice(["SSH-Bruteforce", "FTP-BruteForce", "Bot"]), rnd.choice(["LOW", "HIGH"]), 0.5,
            rnd.choice([22, 21, 0, None]), rnd.choice(["10.0.0.1", "10.0.0.2", None]) if src else None,
            rnd.choice(["d1", "d2", "d3", None]) if dst else None))
    return rows


def by_population(rows, window):
    out = {}
    for part in (True, False):
        sub = [r for r in rows if (r[7] is not None) == part]
        out |= {a: (part, i) for a, i in sequential(sub, window).items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sequential_fold(spark, seed):
    rows = random_alerts(400, seed)
    df = frame(spark, rows)
    assert found(I.correlate(df.repartition(5), strict=False)) == groups(by_population(rows, 300))
    assert found(I.correlate(df)) == groups(sequential(rows, 300))


@pytest.mark.parametrize("strict", [True, False])
def test_large_groups_are_folded_in_slices(spark, strict):
    rows = random_alerts(150, 5)
    df = frame(spark, rows)
    got = I.correlate(df, 1800, strict=strict, max_group=25)
    assert found(got) == groups(sequential(rows, 1800) if strict else by_population(rows, 1800))
    one = I.correlate(df, 1800, strict=strict).select("alert_id", "incident_id")
    assert got.select("alert_id", "incident_id").exceptAll(one).isEmpty()


@pytest.mark.parametrize("size", [1, 7, 40])
def test_slices_that_never_settle_by_themselves(spark, size):
    """One incident lives through all slices and takes a new port with every alert: each slice's start is a state of its own."""
    rows = [alert(f"a{k:04d}", k * 10, port=1000 + k, dst=None) for k in range(120)]
    rows += [alert(f"b{k:04d}", k * 10 + 5, kind="Bot", port=1000 + k // 2, src=None, dst=None) for k in range(120)]
    assert found(I.correlate(frame(spark, rows), max_group=size)) == groups(sequential(rows, 300))


def test_changes_across_slices(spark):
    rows = random_alerts(120, 9)
    plain = I.correlate(frame(spark, rows)).select("alert_id", "incident_id").orderBy("alert_id").collect()
    firsts = {}
    for r in plain:
        firsts.setdefault(r["incident_id"], r["alert_id"])
    start = {r[0]: r[1] for r in rows}
    picked = [(i, a) for i, a in firsts.items()][::4]
    changes = [(start[a] + dt.timedelta(milliseconds=500), a, False) for _, a in picked]
    log = spark.createDataFrame([(i, "RESOLVED", c[0]) for (i, _), c in zip(picked, changes)], "incident_id string, status string, changed_at timestamp")
    # a change to an incident that no longer comes about changes nothing
    assert found(I.correlate(frame(spark, rows), changes=log, max_group=10)) == found(I.correlate(frame(spark, rows), changes=log))


def test_one_long_island_keeps_many_tasks_busy(spark, monkeypatch):
    n, busy = 200_000, {}
    i = F.col("id")
    df = spark.range(n).select(
        F.format_string("a%07d", i).alias("alert_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + i * 400_000).alias("event_time"),
        F.element_at(F.array(*map(F.lit, ("Bot", "SSH-Bruteforce", "FTP-BruteForce"))), (F.xxhash64(i) % 3 + 3).cast("int") % 3 + 1).alias("attack_type"),
        F.lit("HIGH").alias("severity"), F.lit(0.5).alias("confidence"), F.pmod(F.xxhash64(i, F.lit(1)), F.lit(6)).cast("int").alias("destination_port"),
        F.lit("TCP").alias("protocol"), F.when(i % 11 != 0, F.concat(F.lit("s"), F.pmod(F.xxhash64(i, F.lit(2)), F.lit(300)))).alias("source_ip"),
        F.concat(F.lit("d"), F.pmod(F.xxhash64(i, F.lit(3)), F.lit(8))).alias("destination_ip"))
    stored = speculation.materialise

    def counted(part, name):
        out = stored(part, name)
        if name == "fold-pass":
            files = out.where("_aid IS NOT NULL").groupBy(F.input_file_name().alias("f")).count()
            busy[len(busy)] = sorted(r["count"] for r in files.collect())
        return out

    monkeypatch.setattr(speculation, "materialise", counted)
    monkeypatch.setattr(speculation, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = I.correlate(df, max_group=5_000).select("alert_id", "incident_id")
        whole = I.correlate(df, max_group=10 * n).select("alert_id", "incident_id")
        assert got.exceptAll(whole).isEmpty() and got.count() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(busy[0]) >= 10 and max(busy[0]) < n / 4  # one key of 200,000 alerts, 40 slices over 16 tasks


def test_without_addresses(spark):
    rows = random_alerts(300, 3, src=False, dst=False)
    for strict in (True, False):
        assert found(I.correlate(frame(spark, rows), strict=strict)) == groups(sequential(rows, 300))


def test_bursts_of_equal_alerts(spark):
    rows = [alert(f"a{i:05d}", i * 0.5, src="10.9.9.9", port=22 if i < 3000 else 80) for i in range(4000)]
    rows += [alert(f"b{i:05d}", i * 100, kind="Bot", src="10.9.9.9", dst="d9", port=None) for i in range(20)]
    assert found(I.correlate(frame(spark, rows), strict=False)) == groups(by_population(rows, 300))


def test_changes_close_and_reopen(spark):
    rows = [alert(f"a{i}", i * 60) for i in range(8)]
    first = I.correlate(frame(spark, rows)).where("alert_id = 'a0'").first()["incident_id"]
    changes = [(T0 + dt.timedelta(seconds=150), "a0", False), (T0 + dt.timedelta(seconds=400), "a0", True)]
    log = spark.createDataFrame(
        [(first, "RESOLVED" if not c[2] else "REOPEN", c[0]) for c in changes],
        "incident_id string, status string, changed_at timestamp")
    assert found(I.correlate(frame(spark, rows), changes=log)) == groups(sequential(rows, 300, changes))


def test_an_unknown_state_reopens_nothing(spark):
    """RESOLVED closes the incident; a change to a state that does not exist is no change."""
    rows = [alert(f"a{k}", 10.0 * k, "Bot", "HIGH", 0.5, 22, "10.0.0.1", "d1") for k in range(6)]
    df = frame(spark, rows)
    first = I.correlate(df.limit(1)).first()["incident_id"]
    at = df.where("alert_id = 'a1'").first()["event_time"]
    log = [(first, "RESOLVED", 1), (first, "LOST", 2)]
    changes = spark.createDataFrame(log, "incident_id string, status string, s int").withColumn(
        "changed_at", F.lit(at).cast("timestamp") + F.make_dt_interval(secs=F.col("s")))
    for part in (changes, changes.where("s = 1")):
        got = I.correlate(df, changes=part.drop("s"))
        assert sorted(r["n"] for r in got.groupBy("incident_id").agg(F.count("*").alias("n")).collect()) == [2, 4]


def test_fold_state_survives_a_round(spark):
    from packetloom.plans.folding import OpenIncidents

    rnd = random.Random(8)
    whole = OpenIncidents(100)
    cut, ids, again = OpenIncidents(100), [], []
    for k in range(400):
        t, args = 7 * k, (f"a{k}", rnd.choice("xyz"), rnd.choice(["s1", "s2", None]), rnd.choice(["d1", "d2", None]), rnd.choice([1, 2, 0, None]))
        for state, out in ((whole, ids), (cut, again)):
            state.forget(t - 100)
            out.append(state.take(t, t, *args))
        if k % 37 == 0:
            cut = OpenIncidents(100, cut.dump())
    assert ids == again and len(whole.by_id) < 60 and len(whole.pairs) < 400


def test_stream_equals_batch(spark, tmp_path):
    rows = random_alerts(200, 8)
    path = str(tmp_path / "in")
    for i in range(0, len(rows), 50):
        frame(spark, rows[i:i + 50]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = ST.run_available(ST.stream_correlate(stream, delay="1 day"), "correlated")
    got = {(r["alert_id"], r["incident_id"]) for r in out.collect()}
    want = {(r["alert_id"], r["incident_id"]) for r in I.correlate(frame(spark, rows), strict=False).collect()}
    assert got == want


@pytest.mark.parametrize("strict", [True, False])
def test_stream_continues_a_batch(spark, tmp_path, strict):
    rows = random_alerts(160, 11)
    batch = I.correlate(frame(spark, rows[:80]), strict=strict)
    for i in (80, 120):
        frame(spark, rows[i:i + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    initial = ST.open_incidents(batch, 300, strict=strict)
    later = ST.run_available(ST.stream_correlate(stream, delay="1 day", strict=strict, initial=initial), "continued")
    got = {tuple(r) for r in batch.select("alert_id", "incident_id").unionByName(later).collect()}
    assert got == {tuple(r) for r in I.correlate(frame(spark, rows), strict=strict).select("alert_id", "incident_id").collect()}


def test_resolved_incidents_are_not_continued(spark):
    batch = I.correlate(frame(spark, [alert("a", 0), alert("b", 5, src="10.0.0.9", dst="x", port=1)]))
    done = batch.where("alert_id = 'a'").first()["incident_id"]
    status = spark.createDataFrame([(done, "RESOLVED")], "incident_id string, status string")
    got = {r["incident_id"]: r["active"] for r in ST.open_incidents(batch, incidents=status).collect()}
    assert len(got) == 2 and [i for i, open_ in got.items() if not open_] == [done]


class _Map(dict):
    """Stands in for a map state and counts what is written."""

    writes = 0

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


def test_a_batch_writes_only_what_it_touches():
    heads, sets, pairs = _Map(), _Map(), _Map()
    first = HeldIncidents(300, heads, sets, pairs, 0)
    names = [first.take(k, k, f"a{k}", f"kind{k}", "s", f"d{k}", 1000 + k) for k in range(200)]
    first.save()
    assert len(set(names)) == 200 and len(heads) == 200
    heads.writes = sets.writes = pairs.writes = 0
    again = HeldIncidents(300, heads, sets, pairs, first.turn)
    assert again.take(250, 250, "b", "kind7", "s", "d7", 1007) == names[7]
    again.save()
    assert (heads.writes, sets.writes, pairs.writes) == (1, 0, 0)
    again.take(251, 251, "c", "kind7", "s", "d7", 5)
    again.save()
    assert sets.writes == 1 and pairs.writes <= 3
    for name in set(names):
        HeldIncidents(300, heads, sets, pairs, 0).remove(name)
    assert not heads and not sets and not pairs


def test_hand_cases(spark):
    def n(*rows):
        return I.build_incidents(I.correlate(frame(spark, list(rows)))).collect()

    one = n(alert("a", 0))[0]
    assert one["incident_id"].startswith("INC-20240302-") and one["alert_count"] == 1 and one["risk_score"] == 69.5
    assert one["title"] == "HIGH Incident: SSH-Bruteforce on Port 22" and one["status"] == "NEW"
    merged = n(alert("a", 0), alert("b", 10))
    assert len(merged) == 1 and merged[0]["alert_count"] == 2 and merged[0]["source_entities"] == ["10.0.0.5"]
    assert len(n(alert("a", 0), alert("b", 10, kind="Bot", port=80, src="10.0.0.6", dst="x"))) == 2
    assert len(n(alert("a", 0), alert("b", 600))) == 2
    assert len(n(alert("a", 0), alert("b", 300))) == 1
    grown = n(alert("a", 0, port=80), alert("b", 5, dst="192.168.1.2", port=443))
    assert len(grown) == 1 and grown[0]["destination_ports"] == [80, 443] and len(grown[0]["destination_entities"]) == 2
    assert len(n(alert("a", 0, src=None, dst=None, port=None), alert("b", 1, src=None, dst=None, port=None))) == 2
    up = n(alert("a", 0, sev="LOW"), alert("b", 70, sev="CRITICAL"), alert("c", 80, sev="MEDIUM"))[0]
    assert up["severity"] == "CRITICAL" and up["risk_score"] == 100.0  # 80 + 6 + 9.5 + 5, clamped
    assert n(alert("a", 0, kind="Benign")) == []


def test_risk_arithmetic(spark):
    row = spark.range(1).select(scoring.risk_score(F.lit("HIGH"), F.lit(5), F.lit(0.95), F.lit(2), F.lit(120.0)).alias("r"))
    assert row.first()["r"]["risk_score"] == 91.5


def test_workflow_and_timeline(spark):
    correlated = I.correlate(frame(spark, [alert("a", 0), alert("b", 10)]))
    incidents = I.build_incidents(correlated)
    iid = incidents.first()["incident_id"]
    steps = ["INVESTIGATING", "ESCALATED", "bogus", "RESOLVED", "REOPEN"]
    changes = spark.createDataFrame(
        [(iid, s, T0 + dt.timedelta(minutes=i)) for i, s in enumerate(steps)],
        "incident_id string, status string, changed_at timestamp")
    assert I.apply_status(incidents, changes).first()["status"] == "NEW"
    jobs = changes.selectExpr("incident_id", "concat('analyst-', status) AS assigned_to", "changed_at")
    assert I.apply_assignment(incidents, jobs).first()["assigned_to"] == "analyst-REOPEN"
    log = I.incident_timeline(correlated, changes, jobs)
    kinds = {r["event_type"]: r["count"] for r in log.groupBy("event_type").count().collect()}
    assert kinds == {"INCIDENT_CREATED": 1, "ALERT_CORRELATED": 1, "STATUS_CHANGED": 4, "ASSIGNED": 5}
    assert log.select("event_id").distinct().count() == log.count()
    links = I.incident_links(correlated)
    alerts = correlated.withColumn("created_at", F.col("event_time"))
    assert [r["alert_id"] for r in I.incident_alerts(alerts, links, iid).collect()] == ["b", "a"]


@pytest.mark.parametrize("src", ["new", None])
def test_an_alert_looks_at_few_of_other_sources_incidents(monkeypatch, src):
    from packetloom.plans import folding

    looked = []

    class Counted(folding.Incident):
        __slots__ = ()

        def __getattribute__(self, name):
            if name == "active":
                looked.append(1)
            return super().__getattribute__(name)

    monkeypatch.setattr(folding, "Incident", Counted)
    state = folding.OpenIncidents(10_000)
    names = [state.take(k, k, f"a{k}", "Bot", f"s{k}", "d", 22) for k in range(2000)]
    assert len(set(names)) == 2000
    looked.clear()
    got = state.take(2000, 2000, "b", "Bot", src, "d", 22)
    assert (got == names[-1] if src is None else got not in names) and len(looked) < 100


def test_the_fold_finds_what_a_full_search_finds():
    from packetloom.plans.folding import OpenIncidents

    class Plain(OpenIncidents):
        def _best(self, first, kind, src, dst, port):
            found = [x for p in self._wanted(kind, src, dst, port) for x in self.pairs.get(p, {}).values()
                     if x.active and abs(first - x.last) <= self.window and not (src and x.sources and src not in x.sources)]
            return max(found, key=lambda x: (x.last, x.turn), default=None)

    rnd = random.Random(5)
    one, two, t = OpenIncidents(100), Plain(100), 0
    for k in range(4000):
        t += rnd.choice([0, 1, 3, -2 if k > 3000 else 2])  # times that fall are searched in full
        args = f"a{k}", rnd.choice("xyz"), rnd.choice([None, *"abcdefgh"]), rnd.choice([None, "d1", "d2", "d3"]), rnd.choice([1, 2, 0, None])
        for state in (one, two):
            state.forget(t - 100)
        got, want = (state.take(t, t, *args) for state in (one, two))
        assert got == want
        if k % 50 == 0:
            one.set_active(got, False), two.set_active(got, False)


def test_incidents_that_are_over_are_listed_not_filed():
    heads, sets, pairs = _Map(), _Map(), _Map()
    first = HeldIncidents(300, heads, sets, pairs, 0, True)
    names = [first.take(1000 * k, 1000 * k, f"a{k}", "Bot", "s", "d", 22) for k in range(200)]
    first.save()
    listed = first.listed()
    assert len(set(names)) == 200 and len(listed) == 199 and set(heads) == {(names[-1],)} and len(first.pairs) == 6
    late = HeldIncidents(300, heads, sets, pairs, first.turn)
    late.reopen(listed)
    assert late.take(5200, 5200, "b", "Bot", "s", "d", 22) == names[5]
    late.save()
    assert len(late.listed(100_000)) < len(late.listed()) == 198 and len(heads) == 2  # no older row files what is over


def test_older_rows_join_incidents_that_were_over(spark, tmp_path):
    rows = random_alerts(240, 13)
    path = str(tmp_path / "in")
    for part in (rows[60:180], rows[:60] + rows[180:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = ST.run_available(ST.stream_correlate(stream, 60, delay="1 day"), "correlated")
    assert out.count() == out.select("alert_id").distinct().count() == frame(spark, rows).where("upper(attack_type) <> 'BENIGN'").count()


def test_slices_hold_at_least_a_windows_share(spark):
    rows = [alert(f"a{k:04d}", k, src=f"10.0.0.{k}", dst=f"d{k}", port=k + 1) for k in range(1200)]
    df = frame(spark, rows)
    stored = []
    real = I.speculative_fold
    try:
        I.speculative_fold = lambda hot, *a: stored.append(hot.groupBy("_no").count().collect()) or real(hot, *a)
        got = I.correlate(df, 300, max_group=10).count()
    finally:
        I.speculative_fold = real
    assert got == 1200 and max(r["count"] for r in stored[0]) >= 300 and len(stored[0]) >= 4


def test_a_state_at_a_border_is_rows(spark, monkeypatch):
    """No stored row grows with what is open: 600 incidents are open at every border."""
    rows = [alert(f"a{k:05d}", k // 2, src=f"10.0.{k // 250}.{k % 250}", dst=f"d{k}", port=k + 1) for k in range(2400)]
    stored, widest = speculation.materialise, {}

    def measured(part, name):
        out = stored(part, name)
        widest[name] = max(widest.get(name, 0), out.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] or 0)
        return out

    monkeypatch.setattr(speculation, "materialise", measured)
    df = frame(spark, rows)
    got = I.correlate(df, 300, max_group=10)
    assert found(got) == groups(sequential(rows, 300))
    assert widest and max(widest.values()) < 2_000


def test_open_incidents_take_little_memory():
    import tracemalloc

    from packetloom.plans.folding import OpenIncidents

    tracemalloc.start()
    try:
        state = OpenIncidents(100_000)
        for k in range(20_000):
            state.take(k, k, f"a{k}", ("Bot", "SSH")[k % 2], f"10.0.0.{k}", f"d{k % 8}", (22, 80, None)[k % 3])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(state.by_id) == 20_000 and held < 1_300 * 20_000


def test_sources_with_many_incidents():
    """Incidents of a source are searched as a list or, if there are many, by pair: the same are found."""
    from packetloom.plans.folding import OpenIncidents

    rnd = random.Random(6)
    one, two, most = OpenIncidents(200), OpenIncidents(200, few=0), 0
    for k in range(5000):
        args = f"a{k}", f"k{rnd.randrange(60)}", rnd.choice(["s1", "s1", "s2", None]), rnd.choice([None, *(f"d{i}" for i in range(80))]), rnd.choice([0, None, *range(1, 90)])
        for state in (one, two):
            state.forget(k - 200)
        assert one.take(k, k, *args) == two.take(k, k, *args)
        most = max(most, sum(x.sources == ("s1",) for x in one.by_id.values()) if k % 50 == 0 else 0)
    assert one.dump() == two.dump() and most > 16 and len(one.pairs) > 0
    one.forget(10_000)
    assert not one.pairs and not one.by_id and one.last_touched is None

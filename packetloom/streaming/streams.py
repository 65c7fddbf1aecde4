"""Streaming forms of the operators. Every stream starts with `with_event_time`."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from packetloom.functions import values as V
from packetloom.operators.alerts import alert_inputs, append_alerts, stored_alerts
from packetloom.operators.clean import truth_flag
from packetloom.operators.flows import KEY, _timeout_us, flow_key
from packetloom.operators.incidents import incident_id
from packetloom.operators.models import score_two_stage
from packetloom.operators.soc import BUCKETS, _name, batch_scorecard, stream_telemetry
from packetloom.plans.folding import Incident
from packetloom.schemas import NETWORK_FEATURES, TCP_FLAGS
from packetloom.session import materialise, new_path, released
from packetloom.streaming.flow_state import OpenFlow
from packetloom.streaming.held_incidents import HeldIncidents


def with_event_time(stream: DataFrame, ts: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """Event time as TIMESTAMP with a watermark; rows later than the delay are dropped by the
    stateful operators below."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_available(stream: DataFrame, name: str, mode: str = "append", batch=None, at: tuple[str, str] | None = None) -> DataFrame:
    """Processes all data that is there now and returns the table written. `at` names table and checkpoint of a stream that
    is to be continued, as a scheduled job does."""
    spark = stream.sparkSession
    path, checkpoint = at or (new_path(spark, name), new_path(spark, f"{name}-checkpoint"))
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if batch is not None:
        writer = writer.foreachBatch(lambda df, number: batch(df, number, path))
        writer.start().awaitTermination()
    else:
        writer.format("parquet").option("path", path).start().awaitTermination()
    return spark.read.parquet(path)


def overwrite_batch(df: DataFrame, number: int, path: str) -> None:
    """Sink of complete-mode results: the whole (small) result replaces the last one."""
    df.write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------- scoring

def score_batch(detector, classifier, alerts_path: str, cards_path: str, truth: bool = True, time: str = "Timestamp",
                order: str = "flow_id"):
    """`foreachBatch` function: both stages, new alerts appended, one scorecard per batch.

    A batch is scored once; of its verdicts only what alerts and scorecard are made of is stored. A batch that runs again after a
    failure adds nothing: alert ids are deterministic and the scorecard of a batch number is overwritten.
    """
    def run(df: DataFrame, number: int) -> None:
        with released(df.sparkSession):  # what a batch has stored on its way goes once its sinks are written
            scored = score_two_stage(df, detector, classifier)
            scored = truth_flag(scored) if truth else scored.withColumn("gt_is_attack", F.lit(False))
            scored = scored.select(*alert_inputs(scored, "gt_is_attack", "is_attack", order, time))
            scored = materialise(scored, "scored", compression="zstd")
            card = materialise(batch_scorecard(scored), "scorecard")
            hits = scored.where("is_attack").drop("attack_probability").withColumnRenamed("confidence", "attack_probability")
            alerts = stored_alerts(hits, order, F.current_timestamp(), ties=(time,))
            stored = append_alerts(alerts, alerts_path, only_count=True, numbered="alert_id" not in hits.columns,
                                   expected=card.first()["attack_count"])
            card.withColumns({"alerts_inserted": F.lit(stored), "batch": F.lit(number)}).write.mode(
                "overwrite").parquet(f"{cards_path}/batch_id={number}")

    return run


def stream_score(stream: DataFrame, detector, classifier, root: str, **options) -> tuple[str, str]:
    """Scores a stream of flows; returns the paths of the alert table and the scorecards."""
    alerts, cards = f"{root}/alerts", f"{root}/scorecards"
    query = (
        stream.writeStream.foreachBatch(score_batch(detector, classifier, alerts, cards, **options))
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return alerts, cards


def telemetry(spark: SparkSession, cards_path: str) -> DataFrame:
    return stream_telemetry(spark.read.option("recursiveFileLookup", True).parquet(cards_path))


# ---------------------------------------------------------------- flows

_PIECE = 2_000  # packets or flows held as records
_ENDS = [c for c in KEY if c != "protocol"]


class _FlowAssembler(StatefulProcessor):
    """One open flow per endpoint pair; closed by a terminator, a gap, or an event-time timer."""

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", "saved string, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packets = pd.concat((part.drop(columns=[c for c in _ENDS if c in part]) for part in rows), ignore_index=True)
        order = packets[["us", "seq"]].sort_values(["us", "seq"], kind="stable").index
        old = self.flow.get()
        flow, due = (OpenFlow(old[0]), old[1]) if old else (None, None)
        out = []
        # rows become records, and records rows, a piece at a time
        for p in (p for begin in range(0, len(order), _PIECE) for p in packets.loc[order[begin:begin + _PIECE]].to_dict("records")):
            if len(out) >= _PIECE:
                yield _records(out)
                out = []
            if flow is not None and p["us"] - flow.last > self.timeout_us:
                out.append(flow.record())
                flow = None
            if flow is None:
                flow = OpenFlow.start(p)
            else:
                flow.add(p)
            if flow.ended:
                out.append(flow.record())
                flow = None
        if due is not None:
            self.handle.deleteTimer(due)
        if flow is None:
            self.flow.clear()
        else:
            # one millisecond more: a gap equal to the timeout still belongs to the flow
            due = (flow.last + self.timeout_us) // 1000 + 1
            self.handle.registerTimer(due)
            self.flow.update((flow.dump(), due))
        yield _records(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.flow.get()
        self.flow.clear()
        yield _records([OpenFlow(old[0]).record()] if old else [])

    def close(self) -> None:
        pass


_TEXT = ("Src_IP", "Dst_IP")
_LONGS = ("flow_seq", "packet_count", "start_us", "end_us")
_RECORD = [*NETWORK_FEATURES, *_TEXT, "Src_Port", *_LONGS, "terminated"]


def _records(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=_RECORD)
    kinds = {c: "float64" for c in (*NETWORK_FEATURES, "Src_Port")} | {c: "int64" for c in _LONGS}
    return df.astype(kinds | {"terminated": "bool", "Src_IP": "object", "Dst_IP": "object"})


def stream_flows(packets: DataFrame, timeout: float = 10.0, ts: str = "packet_time", seq: str = "seq",
                 delay: str = "10 seconds") -> DataFrame:
    """Stream of packets to a stream of finished flows, with the columns of `flow_features`."""
    rows = with_event_time(flow_key(packets), ts, delay)
    have = set(packets.columns)
    rows = rows.select(
        *KEY, ts, F.unix_micros(ts).alias("us"), F.col(seq).cast("long").alias("seq"), "src_ip", "dst_ip", "src_port",
        "dst_port", "pkt_len", "payload_len", "header_len", "win_bytes",
        *[(F.coalesce(F.col(f), F.lit(False)) if f in have else F.lit(False)).alias(f) for f in TCP_FLAGS],
    )
    kind = ", ".join(
        f"{c} " + ("string" if c in _TEXT else "long" if c in _LONGS else "boolean" if c == "terminated" else "double")
        for c in _RECORD
    )
    out = rows.groupBy(*KEY).transformWithStateInPandas(
        _FlowAssembler(_timeout_us(timeout)), kind, outputMode="Append", timeMode="EventTime")
    start = F.timestamp_micros("start_us")
    return out.select(
        *NETWORK_FEATURES, *[c.cast("double").alias(k) for k, c in V.temporal(start).items()],
        start.alias("Timestamp"), "Src_IP", "Dst_IP", "Src_Port", start.alias("flow_start"),
        F.timestamp_micros("end_us").alias("flow_end"), "flow_seq", "terminated", "packet_count",
    )


# ---------------------------------------------------------------- incidents

_LISTED = "id string, kind string, last long, entities string, active boolean, turn long"
_FEW = 64  # open incidents of a key that are kept in one list


class _Correlator(StatefulProcessor):
    """Open incidents of one key in map states; each is forgotten once the watermark rules out further alerts."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getMapState("heads", "id string", "kind string, last long, turn long, active boolean")
        self.sets = handle.getMapState("sets", "id string", "entities string")
        self.pairs = handle.getMapState("pairs", "pair string", "ids string")
        self.dues = handle.getMapState("dues", "due long", "ids string")
        self.turn = handle.getValueState("turn", "turn long")
        # incidents that were over when their batch ended, or few: written and read in bulk, dropped by one timer
        self.listed = handle.getListState("listed", _LISTED)
        self.listed_last = handle.getValueState("listed_last", "last long")

    def _held(self) -> HeldIncidents:
        turn = self.turn.get()
        return HeldIncidents(self.window_us, self.heads, self.sets, self.pairs, turn[0] if turn else 0, turn is None, _FEW)

    def _due(self, last: int) -> int:
        """Milliseconds at which an incident is surely over, in steps of the window: few timers serve many incidents."""
        step = max(self.window_us, 1000)
        return ((last + self.window_us) // step + 1) * step // 1000

    def _watch(self, last: dict[str, int]) -> None:
        """One timer for each time at which incidents may be over."""
        dues: dict[int, list[str]] = {}
        for name, us in last.items():
            dues.setdefault(self._due(us), []).append(name)
        for due, names in dues.items():
            held = self.dues.getValue((due,))
            if held is None:
                self.handle.registerTimer(due)
            self.dues.updateValue((due,), (json.dumps((json.loads(held[0]) if held else []) + names),))

    def _save(self, state: HeldIncidents, timerValues) -> None:
        state.save()
        self.turn.update((state.turn,))
        self._watch({one.id: one.last for one in state.lasting()})
        # rows of later batches are not behind the watermark of this one
        listed = state.listed(timerValues.getCurrentWatermarkInMs() * 1000 - self.window_us)
        if listed:
            held = None if state.blank else self.listed_last.get()
            last = max([r[2] for r in listed] + ([held[0]] if held else []))
            for begin in range(0, len(listed), 10_000):
                self.listed.appendList([(*r[:3], json.dumps(r[3:6]), *r[6:]) for r in listed[begin:begin + 10_000]])
            self.listed_last.update((last,))
            self.handle.registerTimer(self._due(last))

    def _reopen(self, state: HeldIncidents, first: int) -> None:
        held = self.listed_last.get()
        if held and held[0] >= first - self.window_us:
            state.reopen([(*r[:3], *json.loads(r[3]), *r[4:]) for r in self.listed.get()])
            self.listed.clear()
            self.listed_last.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        state = self._held()
        for r in initialState.sort_values(["last_us", "last_alert"], kind="stable").to_dict("records"):
            ports = [int(p) for p in r["ports"]]
            state.add(Incident(r["incident_id"], r["kind"], int(r["last_us"]), r["sources"], r["targets"], ports, bool(r["active"])))
        self._save(state, timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alerts = pd.concat(list(rows), ignore_index=True).sort_values(["us", "alert_id"], kind="stable")
        state, out = self._held(), []
        if not state.blank:
            self._reopen(state, int(alerts["us"].iloc[0]))
        for us, aid, kind, src, dst, port in zip(alerts["us"], alerts["alert_id"], alerts["attack_type"],
                                                 alerts["source_ip"], alerts["destination_ip"],
                                                 alerts["destination_port"]):
            port = None if pd.isna(port) else int(port)
            out.append((aid, state.take(int(us), int(us), aid, kind, src, dst, port)))
        self._save(state, timerValues)
        yield pd.DataFrame(out, columns=["alert_id", "incident_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        last = self.listed_last.get()
        if last and self._due(last[0]) <= due:
            self.listed.clear()
            self.listed_last.clear()
        held = self.dues.getValue((due,))
        if held is not None:
            self.dues.removeKey((due,))
        if held is None:
            return
        state, later = self._held(), {}
        for name in json.loads(held[0]):
            head = self.heads.getValue((name,))
            if head and self._due(head[1]) > due:  # it took alerts meanwhile
                later[name] = head[1]
            else:
                state.remove(name)
        self._watch(later)
        yield pd.DataFrame({"alert_id": pd.Series(dtype="object"), "incident_id": pd.Series(dtype="object")})

    def close(self) -> None:
        pass


_ALONE = 1024  # state keys over which alerts that can join nothing are dealt


def _population(strict: bool, addresses: bool = True) -> Column:
    if strict:
        return F.lit("")
    port = F.coalesce(F.col("destination_port").cast("int"), F.lit(0))
    return F.coalesce("source_ip", F.lit("")) if addresses else F.when(
        port != 0, F.concat_ws("|", "attack_type", port)).otherwise(F.concat(F.lit("alone "), F.pmod(F.xxhash64("alert_id"), F.lit(_ALONE))))


def open_incidents(correlated: DataFrame, window_seconds: int = 300, ts: str = "event_time", strict: bool = False,
                   incidents: DataFrame | None = None) -> DataFrame:
    """State for `stream_correlate` from alerts correlated in batch: the incidents that later alerts can still join.

    `incidents` (incident_id, status) says which are resolved; without it all are open. `strict` as in the stream."""
    blank, us = F.lit(""), F.unix_micros(F.col(ts).cast("timestamp"))
    at = F.struct(us, "alert_id")
    newest = correlated.agg(F.max(us)).scalar()
    out = correlated.withColumn("pop", _population(strict)).groupBy("incident_id").agg(
        F.first("pop").alias("pop"), F.min_by("attack_type", at).alias("kind"), F.max(F.struct(us.alias("us"), "alert_id")).alias("_last"),
        *[F.collect_set(F.nullif(c, blank)).alias(n) for c, n in (("source_ip", "sources"), ("destination_ip", "targets"))],
        F.collect_set(F.col("destination_port").cast("int")).alias("ports"))
    out = out.select("pop", "incident_id", "kind", F.col("_last.us").alias("last_us"), F.col("_last.alert_id").alias("last_alert"), "sources", "targets", "ports")
    out = out.where(F.col("last_us") >= newest - int(window_seconds) * 1_000_000)
    if incidents is None:
        return out.withColumn("active", F.lit(True))
    state = incidents.select("incident_id", (F.upper("status") != "RESOLVED").alias("_active"))
    return out.join(state, "incident_id", "left").withColumn("active", F.coalesce("_active", F.lit(True))).drop("_active")


def stream_correlate(alerts: DataFrame, window_seconds: int = 300, ts: str = "event_time",
                     delay: str = "10 minutes", addresses: bool = True, strict: bool = False,
                     initial: DataFrame | None = None) -> DataFrame:
    """Stream of (alert_id, incident_id); alerts with and without a source are kept apart.

    With `addresses=False` no alert has an address, as the scoring path makes them. Then only equal type and port can join,
    and every type and port is a state key of its own; alerts without a port join nothing and are dealt over a fixed number of keys,
    which hold no state of them. With `strict` all alerts are one
    population, and so one state key, which is one task: for streams whose source-less alerts must meet the others.
    `initial` (from `open_incidents`, with the same `strict`) continues incidents of a batch."""
    rows = with_event_time(alerts, ts, delay).where(F.upper("attack_type") != "BENIGN")
    rows = rows.select(
        _population(strict, addresses).alias("pop"), ts, F.unix_micros(ts).alias("us"), "alert_id", "attack_type",
        F.nullif("source_ip", F.lit("")).alias("source_ip"),
        F.nullif("destination_ip", F.lit("")).alias("destination_ip"),
        F.col("destination_port").cast("int").alias("destination_port"),
    )
    return rows.groupBy("pop").transformWithStateInPandas(
        _Correlator(int(window_seconds) * 1_000_000), "alert_id string, incident_id string",
        outputMode="Append", timeMode="EventTime", initialState=None if initial is None else materialise(initial, "open-incidents").groupBy("pop"))


def stream_sessions(alerts: DataFrame, window_seconds: int = 300, ts: str = "event_time",
                    delay: str = "10 minutes") -> DataFrame:
    """Incidents of alerts known by type and port only: gap sessions, closed by the watermark."""
    rows = with_event_time(alerts, ts, delay).where(
        (F.upper("attack_type") != "BENIGN") & (F.coalesce("destination_port", F.lit(0)) != 0))
    first = F.min_by("alert_id", F.struct(F.col(ts), "alert_id"))
    out = rows.groupBy(
        F.session_window(ts, f"{int(window_seconds)} seconds").alias("s"), "attack_type", "destination_port"
    ).agg(F.count("*").alias("alert_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
          first.alias("_first"))
    return out.select(incident_id(F.col("first_seen"), F.col("_first")).alias("incident_id"), "attack_type",
                      "destination_port", "alert_count", "first_seen", "last_seen")


# ---------------------------------------------------------------- small streams

def stream_dedupe(alerts: DataFrame, ts: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """Each alert id once within the watermark; older repeats are caught on append."""
    return with_event_time(alerts, ts, delay).dropDuplicatesWithinWatermark(["alert_id"])


def stream_trends(alerts: DataFrame, window: str = "1h", ts: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """Tumbling counts per minute, hour or day, as in `activity_trends`."""
    unit = BUCKETS.get(_name(window), "day")
    level = F.upper("severity")
    out = with_event_time(alerts, ts, delay).groupBy(F.window(ts, f"1 {unit}").alias("w")).agg(
        F.count("*").alias("total_alerts"),
        *[F.count_if(level == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.count_if(F.upper("attack_type") != "BENIGN").alias("attack_alerts"),
    )
    return out.select(F.col("w.start").alias("bucket"), *out.columns[1:])


def late_rows(stream: DataFrame, ts: str = "event_time", delay: str = "10 minutes", at: tuple[str, str] | None = None) -> DataFrame:
    """Every row delivered, with `late` and `behind_seconds` (how far behind the watermark); none is dropped.

    The watermark of a batch is the newest event time of all earlier batches less `delay`, as the engine's own; each batch
    stores its newest time beside its rows. A batch that runs again replaces what it wrote. Rows without a time are on time."""
    spark = stream.sparkSession
    path, checkpoint = at or (new_path(spark, "deliveries"), new_path(spark, "deliveries-checkpoint"))
    schema = "newest timestamp, batch_id long"

    def run(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        spark.range(0).select(F.lit(None).cast("timestamp").alias("newest")).write.mode("ignore").parquet(f"{path}/newest/batch_id=-1")
        seen = spark.read.schema(schema).parquet(f"{path}/newest").where(F.col("batch_id") < number)
        mark = (F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("mark")
        time = F.col(ts).cast("timestamp")
        behind = (F.unix_micros(F.lit(seen.agg(mark).first().mark).cast("timestamp")) - F.unix_micros(time)) / 1_000_000
        late = F.coalesce(behind > 0, F.lit(False))
        df.withColumns({"late": late, "behind_seconds": F.when(late, behind)}).write.mode("overwrite").parquet(f"{path}/rows/batch_id={number}")
        written = spark.read.parquet(f"{path}/rows/batch_id={number}")
        written.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch_id={number}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")


class ProgressLog(StreamingQueryListener):
    """Appends the progress of every batch of every query to a table; the engine itself keeps the recent ones only.
    It writes after `every` batches and at a query's end, so a lost driver loses the last few reports at most."""

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self.spark, self.path, self.every, self.ended, self.held = spark, path, every, {}, []

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write()
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states, mark = p.stateOperators, p.eventTime.get("watermark")
        row = (str(p.id), int(p.batchId), int(p.numInputRows), float(p.inputRowsPerSecond or 0), float(p.processedRowsPerSecond or 0), p.timestamp,
               mark, sum(s.numRowsTotal for s in states), sum(s.numRowsDroppedByWatermark for s in states))
        self.held.append(row)
        if len(self.held) >= self.every:
            self._write()

    def _write(self) -> None:
        if self.held:
            self.spark.createDataFrame(self.held, PROGRESS).coalesce(1).write.mode("append").json(self.path)
            self.held = []

    def settled(self, query, seconds: float = 60) -> None:
        """Waits for the events of a query that has ended: they arrive in order, its end last."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError(f"no end of query {query.id} was reported within {seconds} seconds")


PROGRESS = ("query string, batch long, input_rows long, input_rate double, processed_rate double, at string, watermark string, "
            "state_rows long, dropped_late long")


def stream_progress(log: ProgressLog, query) -> DataFrame:
    """Every batch of a query that has ended: rows, rates, watermark, rows in state, rows dropped as late. A batch number that
    was reported more than once (a trigger without data repeats the next number) has the row with most input."""
    log.settled(query)
    rows = log.spark.read.schema(PROGRESS).json(log.path).where(F.col("query") == str(query.id))
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in ("query", "batch")]), F.struct("input_rows", "at")).alias("_r")
    return rows.groupBy("query", "batch").agg(best).select("query", "batch", "_r.*")


def stream_rollup(alerts: DataFrame, rollup, checkpoint: str) -> None:
    """Extends a rollup by all alerts that are there now; a batch that is run again replaces what it wrote before."""
    alerts.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, number: rollup.extend(df, f"stream-{number}")).start().awaitTermination()

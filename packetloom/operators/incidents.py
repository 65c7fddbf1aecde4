"""Alerts to incidents: correlation, incident records, workflow and timeline."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from packetloom.functions import values as V
from packetloom.functions.scoring import risk_score, severity_from_rank, severity_rank
from packetloom.operators.intel import map_techniques
from packetloom.plans.folding import OpenIncidents
from packetloom.plans.numbering import number_rows
from packetloom.plans.sessions import assign_sessions
from packetloom.plans.speculation import ROW, speculative_fold
from packetloom.session import materialise

# Correlation window, and the states a workflow change may ask for.
WINDOW_SECONDS = 300
INCIDENT_STATES = ("NEW", "INVESTIGATING", "ESCALATED", "RESOLVED", "REOPEN")

# Texts of incident records and timeline events.
FIRST_SUMMARY = "Security Incident created for %s alert on interface/port %s."
MORE_SUMMARY = "Incident correlated %d alerts covering %d attack types."
CREATED_TEXT = "Incident created from alert %s (%s)."
CORRELATED_TEXT = "Correlated alert %s (%s) to incident %s."
STATUS_TEXT = "Analyst %s changed status from %s to %s."
ASSIGNED_TEXT = "Incident assigned to %s."

MAX_GROUP = 20_000  # bursts of one key folded in one go; longer histories are cut into slices


def incident_id(first: Column, alert_id: Column) -> Column:
    """Day and whole digest of the first alert: records are grouped and joined by it, so it is not cut."""
    return F.concat(F.lit("INC-"), F.date_format(first, "yyyyMMdd"), F.lit("-"), F.upper(F.md5(alert_id)))


def incident_label(incident: Column) -> Column:
    """Short form for display: never a key."""
    return F.substring(incident, 1, len("INC-yyyymmdd-") + 12)


def _fold(window_us: int):
    """Streams bursts, sorted by key and time, through the open incidents of the current key.

    Memory holds one key's open incidents and one Arrow batch, never a group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, OpenIncidents(window_us)
        for batch in batches:
            out = []
            for k, what, t0, t1, aid, kind, src, dst, port, note in zip(
                batch["_key"], batch["_what"], batch["_t0"], batch["_t1"], batch["_aid"], batch["attack_type"],
                batch["source_ip"], batch["destination_ip"], batch["destination_port"], batch["_note"],
            ):
                if k != key:
                    key, state = k, OpenIncidents(window_us)
                if what == 1:
                    state.forget(t0 - window_us)
                    port = None if pd.isna(port) else int(port)
                    out.append((aid, state.take(t0, t1, aid, kind, src, dst, port)))
                else:
                    state.set_active(aid, note != "RESOLVED")
            yield pd.DataFrame(out, columns=["_aid", "incident_id"])

    return run


_FOLD_IN = [c for c in ROW if c != "_no"]


def _folded(bursts: DataFrame, window_us: int) -> DataFrame:
    # an explicit number: AQE would merge partitions by bytes, but the cost here is per row
    tasks = int(bursts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bursts.select(*_FOLD_IN).repartition(tasks, "_key").sortWithinPartitions("_key", "_t0", "_what", "_aid")
    return rows.mapInPandas(_fold(window_us), "_aid string, incident_id string")


def _fold_all(bursts: DataFrame, most: int, window_us: int, max_group: int, named: bool) -> DataFrame:
    """(burst, incident) for every burst; `most` is the largest number of bursts of one key.

    Keys with up to `max_group` bursts are folded whole, many in a task. Larger ones are cut into slices of that many, which
    are folded at once from guessed states (`plans/speculation.py`): no task waits for another key's history. What is open at
    a slice's end is at most what came within a window, so a slice has at least a window's share of the bursts: the
    states at all borders together are then no larger than the bursts, however dense these are.
    """
    if most <= max_group:
        return _folded(bursts, window_us)
    sizes = bursts.groupBy("_key").agg(F.count("*").alias("_n"), (F.max("_t0") - F.min("_t0")).alias("_span"))
    share = F.ceil(F.col("_n") * F.least(F.lit(1.0), F.try_divide(F.lit(float(window_us)), F.col("_span"))))
    large = materialise(sizes.where(F.col("_n") > max_group).select(
        "_key", F.greatest(F.lit(max_group), F.coalesce(share, "_n")).cast("long").alias("_size")), "correlate-large")
    small = _folded(bursts.join(large, "_key", "left_anti"), window_us)
    hot = number_rows(bursts.join(large, "_key"), ["_key"], "_t0", "_nth", ("_what", "_aid"))
    hot = materialise(hot.withColumn("_no", F.expr("(_nth - 1) div _size")).select(*ROW), "correlate-hot")
    return small.unionByName(speculative_fold(hot, window_us, named))


def _mark_bursts(rows: DataFrame, key: str, window_us: int) -> DataFrame:
    """Adds `_aid`, the first alert of the run of equal alerts each alert belongs to.

    Equal means same source, type, destination and port, within the window of the one before.
    Such a run always lands in one incident: the previous alert's incident was touched last and
    its entity sets contain everything the next alert needs. A source-less alert needs a
    destination or a port for that.
    """
    order = W.partitionBy(key, "_slice").orderBy("_us", "alert_id")
    sig = F.struct("source_ip", "attack_type", "destination_ip", "destination_port")
    linked = F.col("source_ip").isNotNull() | F.col("destination_ip").isNotNull() | (
        F.coalesce("destination_port", F.lit(0)) != 0)
    same = F.lag(sig).over(order).eqNullSafe(sig) & (F.col("_us") - F.lag("_us").over(order) <= window_us) & linked
    rows = rows.withColumn("_new", ~F.coalesce(same, F.lit(False)))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_aid", F.last(F.when(F.col("_new"), F.col("alert_id")), True).over(upto)).drop("_new")


def _correlate_by_fold(rows: DataFrame, window_us: int, changes: DataFrame | None, max_group: int) -> DataFrame:
    """Exact sequential correlation inside (`_pop`, island); islands are separated by more than
    the window, so no incident crosses them."""
    rows = assign_sessions(rows, ["_pop"], "_us", "alert_id", window_us, keep_slice=True)
    if changes is None:
        rows = _mark_bursts(rows, "_pop", window_us)
    else:
        rows = rows.withColumn("_aid", F.col("alert_id"))
    rows = rows.withColumn("_key", F.concat_ws("|", "_pop", "session_ts", "session_seq"))
    # one write instead of running the windows again for the sizes, the fold and the final join
    rows = materialise(rows.drop("_pop", "session_ts", "session_seq"), "correlate-alerts")
    bursts = rows.groupBy("_key", "_slice", "_aid").agg(
        F.min("_us").alias("_t0"), F.max("_us").alias("_t1"),
        *[F.first(c).alias(c) for c in ("attack_type", "source_ip", "destination_ip", "destination_port")],
    ).withColumns({"_what": F.lit(1), "_note": F.lit(None).cast("string")})
    if changes is None:
        counted = rows.where(F.col("alert_id") == F.col("_aid"))
    else:
        # a change names an incident, and an incident is named after its first alert; unknown states change nothing
        changes = _checked(changes)
        would_be = rows.select("_key", incident_id(F.timestamp_micros("_us"), F.col("alert_id")).alias("incident_id"))
        marks = changes.join(would_be, "incident_id").select(
            "_key", F.lit(2).alias("_what"), V.micros("changed_at").alias("_t0"), F.col("incident_id").alias("_aid"),
            F.col("status").alias("_note"))
        bursts = bursts.unionByName(marks, allowMissingColumns=True)
        counted = bursts
    most = counted.groupBy("_key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    found = _fold_all(bursts, most, window_us, max_group, changes is not None)
    return rows.join(found, "_aid").drop("_key", "_aid", "_slice")


def _correlate_by_port(rows: DataFrame, window_us: int) -> DataFrame:
    """Source- and destination-less alerts: only equal type and port can join, which is a gap
    session per (type, port). Without a port every alert stands alone."""
    keyed = F.coalesce("destination_port", F.lit(0)) != 0
    grouped = assign_sessions(rows.where(keyed), ["attack_type", "destination_port"], "_us", "alert_id", window_us)
    grouped = grouped.withColumn(
        "incident_id", incident_id(F.timestamp_micros("session_ts"), F.col("session_seq"))
    ).drop("session_ts", "session_seq")
    alone = rows.where(~keyed).withColumn("incident_id", incident_id(F.timestamp_micros("_us"), F.col("alert_id")))
    return grouped.unionByName(alone)


def correlate(alerts: DataFrame, window_seconds: int = WINDOW_SECONDS, strict: bool = True,
              changes: DataFrame | None = None, ts: str = "event_time", max_group: int = MAX_GROUP) -> DataFrame:
    """Adds the `incident_id` of every attack alert; benign alerts are dropped.

    Alerts are taken in order of (time, alert id), all of them as one population: only a known source that differs keeps an
    alert out of an incident. With `strict=False` every source, and the alerts without one, are populations of their own:
    cheaper, and the same wherever every alert has a source. `changes` (`incident_id, status, changed_at`) closes and reopens incidents on the way.
    """
    window_us = int(window_seconds) * 1_000_000
    blank = F.lit("")
    rows = alerts.where((F.upper("attack_type") != "BENIGN") & F.col(ts).isNotNull()).withColumns({
        "_us": V.micros(ts),
        "source_ip": F.nullif("source_ip", blank),
        "destination_ip": F.nullif("destination_ip", blank),
        "destination_port": F.col("destination_port").cast("int"),
    })
    pop = F.lit("") if strict else F.coalesce("source_ip", blank)
    if not strict and changes is None:
        other = rows.where("source_ip IS NULL")
        if other.where("destination_ip IS NOT NULL").isEmpty():
            known = _correlate_by_fold(rows.where("source_ip IS NOT NULL").withColumn("_pop", pop), window_us, None,
                                       max_group)
            rest = _correlate_by_port(other, window_us)
            return known.unionByName(rest.select(*known.columns)).drop("_us")
    return _correlate_by_fold(rows.withColumn("_pop", pop), window_us, changes, max_group).drop("_us")


def incident_links(correlated: DataFrame, ts: str = "event_time") -> DataFrame:
    return correlated.select("incident_id", "alert_id", F.col(ts).cast("timestamp").alias("added_at"))


def build_incidents(correlated: DataFrame, ts: str = "event_time") -> DataFrame:
    """One record per incident from its alerts, in a single grouped aggregate."""
    at = F.struct(F.col(ts).cast("timestamp"), "alert_id")
    level = severity_rank("severity")
    sets = {"source_entities": "source_ip", "destination_entities": "destination_ip",
            "destination_ports": "destination_port", "protocols": "protocol"}
    out = correlated.groupBy("incident_id").agg(
        F.min(F.col(ts).cast("timestamp")).alias("first_seen"),
        F.max(F.col(ts).cast("timestamp")).alias("last_seen"),
        F.count("*").alias("alert_count"),
        severity_from_rank(F.max(level)).alias("severity"),
        F.min_by(F.struct(F.col("attack_type").alias("kind"), F.upper("severity").alias("level"),
                          F.col("destination_port").alias("port")), at).alias("_first"),
        F.max_by("confidence", at).alias("_confidence"),
        F.size(F.collect_set("attack_type")).alias("_types"),  # a set merges map-side, unlike a distinct count
        *[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()],
    )
    seconds = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6
    risk = risk_score("severity", "alert_count", "_confidence", "_types", seconds)
    kind, port = F.col("_first.kind"), F.col("_first.port")
    named = F.coalesce(port, F.lit(0)) != 0
    first_text = F.format_string(FIRST_SUMMARY, kind,
                                 F.when(named, port.cast("string")).otherwise("N/A"))
    more_text = F.format_string(MORE_SUMMARY, "alert_count", "_types")
    return out.withColumn("risk_factors", risk).select(
        "incident_id",
        F.concat(F.col("_first.level"), F.lit(" Incident: "), kind,
                 F.when(named, F.concat(F.lit(" on Port "), port.cast("string"))).otherwise("")).alias("title"),
        F.lit("NEW").alias("status"), "severity", F.col("risk_factors.risk_score").alias("risk_score"), "risk_factors",
        F.col("first_seen").alias("created_at"), F.col("last_seen").alias("updated_at"), "first_seen", "last_seen",
        "alert_count", kind.alias("primary_attack_type"), *sets, F.lit("Unassigned").alias("assigned_to"),
        F.when(F.col("alert_count") > 1, more_text).otherwise(first_text).alias("summary"),
    )


def escalate(df: DataFrame, keys: list[str], severity: str = "severity") -> DataFrame:
    """Highest severity per key."""
    return df.groupBy(*keys).agg(severity_from_rank(F.max(severity_rank(severity))).alias(severity))


def incident_filter(incidents: DataFrame, status: str | None = None, severity: str | None = None,
                    limit: int = 100) -> DataFrame:
    """Matching incidents by risk, newest first among equals."""
    if status:
        incidents = incidents.where(F.upper("status") == status.upper())
    if severity:
        incidents = incidents.where(F.upper("severity") == severity.upper())
    return incidents.orderBy(F.desc("risk_score"), F.desc("last_seen"), "incident_id").limit(limit)


def incident_alerts(alerts: DataFrame, links: DataFrame, incident: str | None = None) -> DataFrame:
    """Alerts of one incident (newest first) or of all incidents."""
    if incident is not None:
        links = links.where(F.col("incident_id") == incident)
    own = [c for c in alerts.columns if c != "incident_id"]
    out = alerts.select(*own).join(links.select("incident_id", "alert_id"), "alert_id")
    return out.orderBy(F.desc("created_at"), F.desc("alert_id")) if incident is not None else out


def incident_attack_types(alerts: DataFrame, links: DataFrame) -> DataFrame:
    return incident_alerts(alerts, links).groupBy("incident_id").agg(
        F.array_sort(F.collect_set("attack_type")).alias("attack_types"))


def incident_intel(enriched: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """Indicator and rule facts per incident from enriched alerts that carry `incident_id`."""
    hit = F.col("intel_match")

    def names(c: str) -> Column:
        return F.array_sort(F.collect_set(F.when(hit, F.col(c))))

    out = enriched.groupBy("incident_id").agg(
        F.count_if(hit).alias("intel_match_count"),
        names("intel_threat_name").alias("threat_names"),
        names("intel_source").alias("intel_sources"),
        F.coalesce(F.max(F.when(hit, F.col("intel_confidence"))), F.lit(0.0)).alias("intel_confidence"),
        F.sum("rules_triggered_count").cast("long").alias("rules_triggered_count"),
    ).withColumn("intel_severity", F.when(F.col("intel_match_count") > 0, "HIGH").otherwise("NONE"))
    if incidents is None:
        return out
    joined = incidents.join(out, "incident_id", "left").na.fill(
        {"intel_match_count": 0, "intel_confidence": 0.0, "rules_triggered_count": 0, "intel_severity": "NONE"})
    return map_techniques(joined, "primary_attack_type")


def _checked(changes: DataFrame) -> DataFrame:
    status = F.upper("status")
    valid = changes.where(status.isin(*INCIDENT_STATES))
    return valid.withColumn("status", F.when(status == "REOPEN", "NEW").otherwise(status))


def apply_status(incidents: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Incidents with the last valid change (`incident_id, status, changed_at`); REOPEN means NEW.

    Of changes at one time the one last in `order` wins, without it the last in the alphabet."""
    last = _checked(changes).groupBy("incident_id").agg(
        F.max_by("status", F.struct("changed_at", order or "status")).alias("_status"), F.max("changed_at").cast("timestamp").alias("_at"))
    return incidents.join(last, "incident_id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "updated_at": F.greatest("updated_at", "_at"),
    }).select(*incidents.columns)


def apply_assignment(incidents: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Incidents with their last assignee (`incident_id, assigned_to, changed_at`); ties as in `apply_status`."""
    last = changes.groupBy("incident_id").agg(
        F.max_by("assigned_to", F.struct("changed_at", order or "assigned_to")).alias("_who"), F.max("changed_at").cast("timestamp").alias("_at"))
    return incidents.join(last, "incident_id", "left").withColumns({
        "assigned_to": F.coalesce("_who", "assigned_to"), "updated_at": F.greatest("updated_at", "_at"),
    }).select(*incidents.columns)


def _event(kind: str, actor: Column, text: Column, details: dict[str, Column], mark: Column, at: Column) -> list[Column]:
    pairs = [x for k, c in details.items() for x in (F.lit(k), c.cast("string"))]
    tag = F.md5(F.concat_ws("|", F.col("incident_id"), F.lit(kind), mark, F.unix_micros(at).cast("string")))
    return [F.concat(F.lit("EVT-"), tag).alias("event_id"), F.col("incident_id"), at.alias("timestamp"),
            F.lit(kind).alias("event_type"), actor.alias("actor"), text.alias("description"),
            F.create_map(*pairs).alias("details")]


def timeline_of(timeline: DataFrame, incident: str) -> DataFrame:
    """History of one incident, oldest event first."""
    return timeline.where(F.col("incident_id") == incident).orderBy("timestamp", "event_id")


def incident_timeline(correlated: DataFrame, status_changes: DataFrame | None = None,
                      assignments: DataFrame | None = None, ts: str = "event_time") -> DataFrame:
    """Event log of all incidents; `orderBy("timestamp")` within an incident is its history."""
    at = F.col(ts).cast("timestamp")
    system = F.lit("SYSTEM")
    first = F.col("incident_id") == incident_id(at, F.col("alert_id"))
    facts = {"alert_id": F.col("alert_id"), "attack_type": F.col("attack_type"), "severity": F.col("severity")}
    created = correlated.where(first).select(*_event(
        "INCIDENT_CREATED", system,
        F.format_string(CREATED_TEXT, "alert_id", "attack_type"),
        facts, F.lit("CREATED"), at))
    joined = correlated.where(~first).select(*_event(
        "ALERT_CORRELATED", system,
        F.format_string(CORRELATED_TEXT, "alert_id", "attack_type", "incident_id"),
        facts, F.col("alert_id"), at))
    out = created.unionByName(joined)
    when = F.col("changed_at").cast("timestamp")
    if status_changes is not None:
        actor = F.col("actor") if "actor" in status_changes.columns else F.lit("ANALYST")
        order = W.partitionBy("incident_id").orderBy("changed_at")
        log = _checked(status_changes).withColumn("_old", F.coalesce(F.lag("status").over(order), F.lit("NEW")))
        out = out.unionByName(log.select(*_event(
            "STATUS_CHANGED", actor,
            F.format_string(STATUS_TEXT, actor, F.col("_old"), F.col("status")),
            {"old_status": F.col("_old"), "new_status": F.col("status")}, F.col("status"), when)))
    if assignments is not None:
        actor = F.col("actor") if "actor" in assignments.columns else F.lit("ANALYST")
        out = out.unionByName(assignments.select(*_event(
            "ASSIGNED", actor, F.format_string(ASSIGNED_TEXT, "assigned_to"),
            {"assigned_to": F.col("assigned_to")}, F.col("assigned_to"), when)))
    return out

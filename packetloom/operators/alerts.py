"""Alert identity, normalisation, workflow and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from packetloom.functions import values as V
from packetloom.plans.numbering import number_rows
from packetloom.session import materialise

# Workflow states of an alert.
ALERT_STATES = ("NEW", "INVESTIGATING", "ESCALATED", "RESOLVED")
MAX_LIMIT = 10_000

# Other spellings of the alert fields.
SPELLINGS = {
    "alert_id": ("alert_id", "Alert_ID", "AlertId", "ID"),
    "event_time": ("event_time", "timestamp", "Timestamp", "created_at"),
    "attack_type": ("attack_type", "AttackType", "Attack_Type", "attack_label"),
    "severity": ("severity", "Severity"),
    "status": ("status", "Status"),
    "confidence": ("attack_probability", "Attack_Probability", "AttackProbability", "confidence",
                   "model_confidence", "Model_Confidence", "ModelConfidence"),
    "destination_port": ("Dst_Port", "destination_port", "Destination_Port", "DestinationPort", "dst_port"),
    "protocol": ("Protocol", "protocol"),
    "source_ip": ("Src_IP", "src_ip", "source_ip"),
    "destination_ip": ("Dst_IP", "dst_ip", "destination_ip"),
}


def _text(c: Column) -> Column:
    """Non-blank text or null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def normalise_alert(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One spelling per field, with the defaults used for correlation; columns in `also` are kept as they are."""
    def pick(name: str) -> Column:
        # Spark resolves names case-insensitively: use each existing column once
        seen, names = set(), []
        for n in SPELLINGS[name]:
            real = next((c for c in df.columns if c == n), None)
            if real and real not in seen:
                seen.add(real)
                names.append(real)
        return V.first_present(df, names)

    return df.select(
        _text(pick("alert_id")).alias("alert_id"),
        pick("event_time").try_cast("timestamp").alias("event_time"),
        F.coalesce(_text(pick("attack_type")), F.lit("Threat Detected")).alias("attack_type"),
        F.upper(F.coalesce(_text(pick("severity")), F.lit("MEDIUM"))).alias("severity"),
        V.confidence_fraction(pick("confidence")).alias("confidence"),
        V.to_int(pick("destination_port")).alias("destination_port"),
        F.coalesce(_text(pick("protocol")), F.lit("TCP")).alias("protocol"),
        F.upper(F.coalesce(_text(pick("status")), F.lit("NEW"))).alias("status"),
        _text(pick("source_ip")).alias("source_ip"),
        _text(pick("destination_ip")).alias("destination_ip"), *also,
    )


def canonical_number(c: str | Column, digits: int = 6) -> Column:
    """Text form of a number inside an alert key: fixed digits, same on every platform."""
    return F.format_string(f"%.{digits}f", F.coalesce(V.to_double(c), F.lit(0.0)))


def alert_key(time: str = "Timestamp", attack_type: str = "attack_type", severity: str = "severity",
              port: str = "Dst_Port", protocol: str = "Protocol", probability: str = "attack_probability") -> Column:
    """sha256 over the six observable fields of an alert."""
    return F.sha2(
        F.concat_ws(
            "|",
            F.coalesce(F.date_format(F.col(time).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")),
            F.coalesce(F.col(attack_type), F.lit("")),
            F.coalesce(F.col(severity), F.lit("")),
            F.coalesce(F.col(port).cast("string"), F.lit("")),
            F.coalesce(F.col(protocol).cast("string"), F.lit("")),
            canonical_number(probability),
        ),
        256,
    )


_GROUPS = 4096  # of keys, by hash: keys in a group that is far larger than the others are numbered in chunks
_PART = 500_000  # rows of a month that are numbered, and stored, by one task
_MONTH = "yyyy-MM"


def _month(c: str | Column) -> Column:
    return F.coalesce(F.date_format(F.col(c) if isinstance(c, str) else c, _MONTH), F.lit("none"))


def _nth_of_key(df: DataFrame, key: Column, order: str, ties: tuple[str, ...], month: Column) -> DataFrame:
    """Adds `_key` and `_nth`, the 1-based position among rows of equal key, in one shuffle of the rows without their keys.

    Rows of a month, which must follow from the key, meet in as few tasks as they need. A key that may have too many rows for
    one task is found by counts of key groups and numbered in chunks of `order`.
    """
    group = F.pmod(F.xxhash64(key), F.lit(_GROUPS))
    sizes = df.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()
    most = max(_PART, 4 * sum(r["n"] for r in sizes) // _GROUPS)
    large = [r["g"] for r in sizes if r["n"] > most]
    months = df.groupBy(month.alias("_month")).agg(F.ceil(F.count("*") / _PART).cast("long").alias("_parts"))
    part = F.pmod(F.xxhash64(key), F.col("_parts"))
    rows = (df.where(~group.isin(large)) if large else df).withColumn("_month", month)
    rows = rows.join(F.broadcast(months), "_month", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    rows = rows.repartition(F.col("_month"), part).withColumns({"_part": part, "_key": key})
    nth = F.row_number().over(W.partitionBy("_month", "_part", "_key").orderBy(order, *ties))
    rows = rows.withColumn("_nth", nth).drop("_month", "_parts", "_part")
    if large:
        rows = rows.unionByName(number_rows(df.where(group.isin(large)).withColumn("_key", key), ["_key"], order, "_nth", ties))
    return rows


def with_alert_ids(df: DataFrame, order: str, ties: tuple[str, ...] = (), supplied: str | None = None,
                   key: Column | None = None) -> DataFrame:
    """Adds `occurrence` (0-based, among equal keys, in `order`) and `alert_id`.

    Equal alerts may be any share of the input: many of them are numbered in chunks of `order`.
    A supplied non-blank id wins. The printed id has 16 digits; `alert_digest` has the whole digest (of a supplied id,
    the id itself) and is what alerts are compared by.
    """
    month = _month(F.col("Timestamp").cast("timestamp")) if key is None else F.lit("any")
    rows = _nth_of_key(df, alert_key() if key is None else key, order, ties, month)
    whole = F.sha2(F.concat_ws("|", F.col("_key"), (F.col("_nth") - 1).cast("string")), 256)
    made = F.substring(whole, 1, 16)
    if supplied:
        given = F.nullif(F.trim(F.col(supplied).cast("string")), F.lit(""))
        made, whole = F.coalesce(given, made), F.coalesce(given, whole)
    return rows.withColumns({"occurrence": F.col("_nth") - 1, "alert_id": made, "alert_digest": whole}).drop("_key", "_nth")


def alert_inputs(df: DataFrame, *more: str) -> list[str]:
    """The columns of `df` that alert records are made of, and `more`."""
    names = {n.lower() for names in SPELLINGS.values() for n in names} | {n.lower() for n in more}
    return [c for c in df.columns if c.lower() in names]


def stored_alerts(scored: DataFrame, order: str, now, ties: tuple[str, ...] = ()) -> DataFrame:
    """Scored rows as alert records with status NEW, in the stored schema."""
    stamp = F.lit(now).cast("timestamp")
    ids = with_alert_ids(scored, order, ties, supplied="alert_id" if "alert_id" in scored.columns else None)
    text = normalise_alert(ids, ("alert_digest",))
    return text.select(
        "alert_id", "alert_digest", "event_time", "attack_type", "severity", "confidence", "destination_port",
        V.protocol_name("protocol").alias("protocol"), F.lit("NEW").alias("status"), "source_ip", "destination_ip",
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )


def new_alerts_only(alerts: DataFrame, known: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts not stored yet, each id once. Ids are unique-ish, so the anti join cannot skew."""
    return alerts.dropDuplicates([key]).join(known.select(key), key, "left_anti")


_BITMAP = 32_768  # bits of one bitmap
_MOST_BITMAPS = 8192  # 32 MB


def _likely_stored(stored: DataFrame, fresh: DataFrame, key: str, expected: int | None) -> DataFrame:
    """Keys of `stored` that may be in `fresh`: all that are, and few others. Bits of the new keys travel to the stored ones, so
    that these, which grow with each batch, are read but not shuffled. With more keys than the bitmaps are for, more pass."""
    wanted = _MOST_BITMAPS if expected is None else -(-16 * expected // _BITMAP)
    h = F.xxhash64(key)
    place = F.pmod(h, F.lit(max(1, min(_MOST_BITMAPS, wanted)))).alias("_place")
    spots = [F.pmod(F.shiftright(h, n), F.lit(_BITMAP)) for n in (20, 40)]
    bits = fresh.select(place, F.explode(F.array(*spots)).alias("_spot")).groupBy("_place").agg(
        F.bitmap_construct_agg("_spot").alias("_bits"))
    found = F.lit(True)
    for spot in spots:
        byte = F.substring("_bits", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))
        found = found & (F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(spot, F.lit(8)).cast("int")) == 1)
    return stored.select(key, place).join(F.broadcast(bits), "_place").where(found).select(key)


_FEW = 200_000  # keys that are sent to all tasks instead of dealing both sides anew


def append_alerts(alerts: DataFrame, path: str, only_count: bool = False, derived: bool = False, numbered: bool = False,
                  expected: int | None = None):
    """Appends unseen alerts to the table at `path`; stored ones keep their status.

    Alerts are compared by `alert_digest` where both sides have it, else by `alert_id`, whatever their time: a supplied id
    delivered again in another month is the same alert. With `derived` ids, which imply their time, only the months of the
    new alerts are read. `numbered` alerts are those of `stored_alerts` without supplied ids: none comes twice and a month's lie
    together, so they are neither compared with each other nor dealt anew; they are made twice, from rows that should be stored.
    `expected` is about how many they are. Returns the table, or the number of inserted alerts.
    """
    spark = alerts.sparkSession
    exists = table_exists(spark, path)
    key = "alert_digest" if "alert_digest" in alerts.columns else "alert_id"
    if exists and key not in spark.read.parquet(path).columns:
        key, numbered = "alert_id", False
    fresh = alerts.withColumn("event_month", _month("event_time"))
    if not numbered:
        fresh = fresh.dropDuplicates([key])
    if exists:
        if not numbered:
            fresh = materialise(fresh, "batch")
            expected = fresh.count()
        stored = spark.read.parquet(path)
        if derived:  # the months prune the stored table's folders
            stored = stored.join(F.broadcast(fresh.select("event_month").distinct()), "event_month", "left_semi")
        known = materialise(_likely_stored(stored, fresh, key, expected), "known")
        seen = known.count()
        if seen:
            fresh = fresh.join(F.broadcast(known) if seen <= _FEW else known, key, "left_anti")
    if not numbered:  # few files per month; AQE splits a month that is too large for one task
        fresh = fresh.hint("rebalance", "event_month")
    inserted = Observation()
    fresh.observe(inserted, F.count("*").alias("n")).write.mode("append").option("compression", "zstd").partitionBy(
        "event_month").parquet(path)
    return inserted.get["n"] if only_count else spark.read.parquet(path)


def table_exists(spark, path: str) -> bool:
    """Whether a table was committed at `path`, on any file system Spark can reach."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(hadoop, "_SUCCESS"))


def _limited(limit: int, most: int = MAX_LIMIT) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def alert_filter(df: DataFrame, status: str | None = None, severity: str | None = None,
                 attack_type: str | None = None) -> DataFrame:
    """Conjunction of the given predicates; severity ignores case, attack type is exact."""
    if status:
        df = df.where(F.col("status") == status.upper())
    if severity:
        df = df.where(F.upper("severity") == severity.upper())
    if attack_type:
        df = df.where(F.col("attack_type") == attack_type)
    return df


def newest_alerts(df: DataFrame, limit: int = 100, **where) -> DataFrame:
    return alert_filter(df, **where).orderBy(F.desc("created_at"), F.desc("alert_id")).limit(_limited(limit))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with one key value (pushed down to the scan)."""
    return df.where(F.col(key) == F.lit(value))


def lookup_many(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows for a table of keys; Spark broadcasts the keys when they are measured to be small."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def latest_change(changes: DataFrame, key: str, value: str, at: str = "changed_at", order: str | None = None) -> DataFrame:
    """Last value per key; a map-side aggregate, so a hot key sends one row per task."""
    by = F.struct(at, order) if order else F.col(at)
    return changes.groupBy(key).agg(F.max_by(value, by).alias(value), F.max(at).alias("_changed"))


def apply_alert_status(alerts: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Alerts with the last valid workflow change applied (`alert_id, status, changed_at`)."""
    good = changes.withColumn("status", F.upper("status")).where(F.col("status").isin(*ALERT_STATES))
    last = latest_change(good, "alert_id", "status", order=order).withColumnRenamed("status", "_status")
    joined = alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("_status", "status"))
    if "updated_at" in alerts.columns:
        joined = joined.withColumn("updated_at", F.coalesce(F.col("_changed").cast("timestamp"), F.col("updated_at")))
    return joined.drop("_status", "_changed")


def rejected_changes(changes: DataFrame, states: tuple[str, ...] = ALERT_STATES) -> DataFrame:
    return changes.where(~F.coalesce(F.upper("status").isin(*states), F.lit(False)))


def reset_alerts(alerts: DataFrame, prefixes: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Remaining alerts and a status table with counts before and after.

    Without prefixes every alert is removed; with prefixes only ids that start with one of them.
    """
    gone = F.lit(True)
    if prefixes is not None:
        gone = F.lit(False)
        for p in prefixes:
            gone = gone | F.coalesce(F.col("alert_id").startswith(p), F.lit(False))
    report = alerts.groupBy("status").agg(F.count("*").alias("before"), F.count_if(~gone).alias("after"))
    return alerts.where(~gone), report


def flow_summary(scored: DataFrame, limit: int | None = 50, time: str = "Timestamp", tie: str | None = None) -> DataFrame:
    """Compact rows of scored flows, newest first."""
    name = V.protocol_name("Protocol")
    out = scored.select(
        F.col(time).alias("time"), "Src_IP", "Dst_IP",
        V.to_int("Dst_Port").alias("dst_port"),
        F.when(name.isin("TCP", "UDP"), name).otherwise(F.col("Protocol").cast("string")).alias("protocol"),
        (F.col("Tot_Fwd_Pkts") + F.col("Tot_Bwd_Pkts")).cast("long").alias("packets"),
        (F.col("TotLen_Fwd_Pkts") + F.col("TotLen_Bwd_Pkts")).cast("long").alias("bytes"),
        "is_attack", "attack_type", "severity", "confidence",
        F.when(F.col("is_attack"), "ATTACK").otherwise("BENIGN").alias("status"),
        *([tie] if tie else []),
    )
    out = out.orderBy(F.desc("time"), *([F.desc(tie)] if tie else []))
    return out.limit(limit) if limit else out


def json_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for text-only sinks."""
    return df.select(*[
        F.to_json(c.name).alias(c.name) if c.dataType.typeName() in ("array", "map", "struct") else F.col(c.name)
        for c in df.schema
    ])


def from_json_columns(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """The reverse of `json_columns`; blank text gives an empty value."""
    return df.withColumns({
        c: F.from_json(F.coalesce(_text(F.col(c)), F.lit("[]" if s.startswith("array") else "{}")), s)
        for c, s in schemas.items()
    })

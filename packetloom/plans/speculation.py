"""A sequential fold without the chain: slices of a long sequence are folded at once, from guessed start states.

Every slice of a key starts as if nothing were open. Then each slice's start state is compared, by digest, with the state that the slice
before it ended in; slices that started from another state are folded again, until nothing changes. Incidents older than the
window are forgotten, so most guesses come true within a pass or two. Pass n settles groups of FAN^n neighbouring slices in one task, so
even a state that never settles by itself costs no more passes than the logarithm of the slices.

A state is compared without the names of its incidents: inside a slice, the k-th incident it started with is "#k". Slices
whose start state is right but for names are not folded again; names are looked up once, at the end, over the states at the
borders, a few rows a slice. Where status changes refer to incidents by name, states are compared with their names.

A state is rows, one an open incident: whatever is open at a border, only the task that folds the next slice holds it. Digests
and names are made as the rows stream by. Memory holds one slice's open incidents (of a slice passed over, their records) and one Arrow batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from packetloom.plans.folding import Incident, OpenIncidents
from packetloom.session import materialise

FAN = 8
PIECE = 20_000  # rows of a state that leave the fold at a time
ROW = ["_key", "_no", "_t0", "_what", "_t1", "_aid", "attack_type", "source_ip", "destination_ip", "destination_port", "_note"]
# a burst's incident (_aid, _ref), an open incident at a slice's end (_pos, _last, _ref, _rec) or a slice that was folded (_used)
_RESULT = {"_key": "string", "_no": "long", "_aid": "string", "_ref": "string", "_pos": "long", "_last": "long", "_rec": "string", "_used": "string"}
_SLICE = ["_key", "_no", "_first", "_used", "_pass"]
HEADER, START, END, BURST = range(4)


class Digest:
    """Digest of a state, one open incident after the other."""

    def __init__(self):
        self.md5, self.n = hashlib.md5(), 0

    def add(self, name: str, rec: str, named: bool) -> None:
        self.md5.update(f"{name if named else f'#{self.n}'}{rec}\n".encode())
        self.n += 1

    def text(self) -> str:
        return self.md5.hexdigest()


NOTHING_OPEN = Digest().text()


def _written(one: Incident) -> str:
    return json.dumps(one.record()[1:])


def _read(name: str, rec: str) -> Incident:
    return Incident(name, *json.loads(rec))


class _Slices:
    """Slices of a group, one after the other; those that began with the right state are passed over."""

    def __init__(self, window_us: int, named: bool):
        self.window, self.named = window_us, named
        self.group, self.slice, self.out = None, None, []
        self.start: list[Incident] = []  # what is open at the slice's begin, until it is folded
        self.kept: list[Incident] = []  # what was open at the end of a slice that is passed over
        self.state: OpenIncidents | None = None
        self.used, self.begun = None, False

    def end(self) -> Iterator[list]:
        """The state at the end of the slice, if it was folded."""
        if self.state is None:
            return
        self.kept, self.state = self.state.close(), None
        for at in range(0, len(self.kept), PIECE):
            yield [(*self.slice, None, x.id, at + k, x.last, _written(x), None) for k, x in enumerate(self.kept[at:at + PIECE])]

    def header(self, key: str, group: int, no: int, first: int, used: str | None) -> None:
        before = first - self.window
        self.start = [x for x in self.kept if x.last >= before] if (key, group) == self.group else []
        self.group, self.slice, self.used, self.begun, self.kept = (key, group), (key, no), used, False, []

    def begin(self) -> None:
        self.begun, mark = True, Digest()
        for k, x in enumerate(self.start):
            mark.add(x.id, _written(x), self.named)
            if not self.named:
                x.id = f"#{k}"
        if mark.text() != self.used:
            self.out.append((*self.slice, None, None, None, None, None, mark.text()))
            self.state = OpenIncidents(self.window)
            for x in self.start:
                self.state.resume(x)
        self.start = []

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, grp, no, head, t0, what, t1, aid, kind, src, dst, port, note in zip(*(batch[c] for c in ["_key", "_grp", "_no", "_head", *ROW[2:]])):
                if head == HEADER:
                    for rows in self.end():
                        yield pd.DataFrame(rows, columns=[*_RESULT])
                    self.header(key, grp, no, t0, note)
                elif head == START:
                    self.start.append(_read(aid, note))
                else:
                    if not self.begun:
                        self.begin()
                    if head == END:
                        if self.state is None:
                            self.kept.append(_read(aid, note))
                    elif self.state is not None:
                        if what == 1:
                            self.state.forget(t0 - self.window)
                            ref = self.state.take(t0, int(t1), aid, kind, src, dst, None if pd.isna(port) else int(port))
                            self.out.append((key, no, aid, ref, None, None, None, None))
                        else:
                            self.state.set_active(aid, note != "RESOLVED")
            yield pd.DataFrame(self.out, columns=[*_RESULT])
            self.out = []
        for rows in self.end():
            yield pd.DataFrame(rows, columns=[*_RESULT])


def _fold(window_us: int, named: bool):
    return lambda batches: _Slices(window_us, named).run(batches)


def _digests(named: bool):
    """(_key, _no, _mark) of the states that slices begin with, from their rows in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slice_, mark = None, Digest()
        for b in batches:
            out = []
            for key, no, name, rec in zip(b["_key"], b["_no"], b["_ref"], b["_rec"]):
                if (key, no) != slice_:
                    if slice_:
                        out.append((*slice_, mark.text()))
                    slice_, mark = (key, no), Digest()
                mark.add(name, rec, named)
            yield pd.DataFrame(out, columns=["_key", "_no", "_mark"])
        if slice_:
            yield pd.DataFrame([(*slice_, mark.text())], columns=["_key", "_no", "_mark"])

    return run


def _names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(_key, _no, _ref, incident_id) of the incidents that slices began with, from the states at the borders in order."""
    slice_, known, earlier = None, {}, {}
    for b in batches:
        out = []
        for key, no, name in zip(b["_key"], b["_no"], b["_ref"]):
            if (key, no) != slice_:
                earlier = known if slice_ == (key, no - 1) else {}  # a slice that began with nothing has no "#k"
                slice_, known = (key, no), {}
            ref = f"#{len(known)}"
            known[ref] = earlier.get(name, name)
            out.append((key, no, ref, known[ref]))
        yield pd.DataFrame(out, columns=["_key", "_no", "_ref", "incident_id"])


def speculative_fold(rows: DataFrame, window_us: int, named: bool = False) -> DataFrame:
    """(_aid, incident_id) of the rows (`ROW`, stored), of which `_no` numbers the slices of a key in the order of `_t0, _what, _aid`."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    result = ", ".join(f"{c} {kind}" for c, kind in _RESULT.items())
    slices = rows.groupBy("_key", "_no").agg(F.min("_t0").alias("_first")).select(
        "_key", "_no", "_first", F.lit(None).cast("string").alias("_used"), F.lit(-1).alias("_pass"))
    slices = materialise(slices, "fold-slices")
    every, width, number = None, 1, 0
    while True:
        starts = None
        checked = slices.withColumn("_mark", F.lit(NOTHING_OPEN))
        if every is not None:
            ends = every.where("_pos IS NOT NULL").join(slices.select("_key", "_no", "_pass"), ["_key", "_no", "_pass"]).drop("_pass", "_used", "_aid")
            after = slices.select("_key", (F.col("_no") - 1).alias("_no"), F.col("_first").alias("_next"))
            starts = ends.join(after, ["_key", "_no"]).where(F.col("_last") >= F.col("_next") - window_us).withColumn("_no", F.col("_no") + 1).drop("_next")
            marks = starts.select("_key", "_no", "_pos", "_ref", "_rec").repartition(tasks, "_key", "_no").sortWithinPartitions(
                "_key", "_no", "_pos").mapInPandas(_digests(named), "_key string, _no long, _mark string")
            checked = slices.join(marks, ["_key", "_no"], "left").withColumn("_mark", F.coalesce("_mark", F.lit(NOTHING_OPEN)))
        checked = materialise(checked.select(*_SLICE, (F.expr(f"_no div {width}")).alias("_grp"), (~F.col("_used").eqNullSafe(F.col("_mark"))).alias("_wrong")), "fold-borders")
        wrong = checked.where("_wrong").select("_key", "_grp").distinct()
        if wrong.isEmpty():
            break
        grp = F.expr(f"_no div {width}").alias("_grp")
        dealt = rows.select(*ROW, grp, F.lit(BURST).alias("_head")).join(wrong, ["_key", "_grp"], "left_semi")
        told = checked.join(wrong, ["_key", "_grp"], "left_semi").select(
            "_key", "_grp", "_no", F.lit(HEADER).alias("_head"), F.col("_first").alias("_t0"), F.col("_first").alias("_t1"), F.col("_used").alias("_note"))
        dealt = dealt.unionByName(told, allowMissingColumns=True)
        if starts is not None:
            # a group's first slice is told what it begins with; of the others the group may need what they ended with
            first, inner = F.expr(f"_no % {width} = 0"), F.expr(f"(_no + 1) % {width} <> 0")
            for told, head in ((starts.where(first), START), *(((ends.where(inner), END),) if width > 1 else ())):
                dealt = dealt.unionByName(told.select(
                    "_key", grp, "_no", F.lit(head).alias("_head"), F.col("_pos").alias("_t0"), F.col("_last").alias("_t1"), F.col("_ref").alias("_aid"),
                    F.col("_rec").alias("_note")).join(wrong, ["_key", "_grp"], "left_semi"), allowMissingColumns=True)
        dealt = dealt.repartition(tasks, "_key", "_grp").sortWithinPartitions("_key", "_grp", "_no", "_head", "_t0", "_what", "_aid")
        found = materialise(dealt.mapInPandas(_fold(window_us, named), result), "fold-pass").withColumn("_pass", F.lit(number))
        every = found if every is None else every.unionByName(found)
        fresh = found.where("_used IS NOT NULL").select("_key", "_no", F.col("_used").alias("_now"))
        slices = materialise(checked.join(fresh, ["_key", "_no"], "left").select(
            "_key", "_no", "_first", F.coalesce("_now", "_used").alias("_used"),
            F.when(F.col("_now").isNotNull(), F.lit(number)).otherwise(F.col("_pass")).alias("_pass")), "fold-slices")
        width, number = width * FAN, number + 1
    if every is None:
        return spark.createDataFrame([], "_aid string, incident_id string")
    last = every.where("_aid IS NOT NULL").join(slices.select("_key", "_no", "_pass"), ["_key", "_no", "_pass"])
    if named:
        return last.select("_aid", F.col("_ref").alias("incident_id"))
    names = starts.select("_key", "_no", "_pos", "_ref").repartition("_key").sortWithinPartitions("_key", "_no", "_pos").mapInPandas(
        _names, "_key string, _no long, _ref string, incident_id string")
    return last.select("_key", "_no", "_aid", "_ref").join(names, ["_key", "_no", "_ref"], "left").select(
        "_aid", F.coalesce("incident_id", "_ref").alias("incident_id"))

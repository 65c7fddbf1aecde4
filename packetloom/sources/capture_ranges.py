"""Capture files of any size, cut into byte ranges.

A range does not begin at a record. Its first record is found by a chain of plausible headers (lengths within the file's limit,
times near the file's first, each record ending where the next one begins) that goes on for longer than a record can be, so
no bytes inside a packet can pass for it, or up to the end of the file. A first pass only walks headers and gives every range its first record,
its end and its number of records. A range must begin where the one before it ended: those that do not are walked again from there,
until all agree. Record numbers are the sums over earlier ranges, and the second pass decodes ranges, each in its own task.

Only files of classic records can be cut; files of blocks carry their interfaces along and are one range. Files are opened by
path: local or shared folders, and stores known to pyarrow.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterator
from datetime import timedelta
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from packetloom.plans.folding import EPOCH
from packetloom.schemas import PACKET_SCHEMA
from packetloom.session import materialise

MAGIC_MICRO, MAGIC_NANO = 0xA1B2C3D4, 0xA1B23C4D  # fixed values: file magics
HEAD, RECORD, LARGEST = 24, 16, 262_144
RANGE_BYTES = 64 << 20
NEAR_SECONDS = 10 * 365 * 86_400


def open_file(path: str):
    """A seekable file of a local path, or of a store that pyarrow knows."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class Layout:
    """What the header of a classic file says."""

    def __init__(self, data: bytes):
        first = struct.unpack_from("<I", data)[0]
        self.order = "<" if first in (MAGIC_MICRO, MAGIC_NANO) else ">"
        magic = struct.unpack_from(self.order + "I", data)[0]
        if magic not in (MAGIC_MICRO, MAGIC_NANO):
            raise ValueError("no capture file")
        self.nano, self.link = magic == MAGIC_NANO, struct.unpack_from(self.order + "I", data, 20)[0] & 0x0FFFFFFF
        self.largest = max(struct.unpack_from(self.order + "I", data, 16)[0], 1)
        if self.largest > LARGEST:
            self.largest = LARGEST
        self.first = struct.unpack_from(self.order + "I", data, HEAD)[0] if len(data) >= HEAD + 4 else 0

    def record(self, data: bytes, at: int) -> tuple[int, int, int, int]:
        """Seconds, fraction, bytes kept, length on the wire."""
        return struct.unpack_from(self.order + "IIII", data, at)

    def plausible(self, data: bytes, at: int) -> int | None:
        """Where the record at `at` ends, if it may be one."""
        sec, frac, kept, length = self.record(data, at)
        good = kept <= min(self.largest, length) and length <= LARGEST and frac < (10**9 if self.nano else 10**6) and abs(sec - self.first) <= NEAR_SECONDS
        return at + RECORD + kept if good else None


def read_layout(f) -> Layout:
    f.seek(0)
    return Layout(f.read(HEAD + RECORD))


def first_record(f, layout: Layout, at: int, size: int) -> int:
    """The first record at or behind `at`; the file's size if there is none."""
    if at <= HEAD:
        return min(HEAD, size)
    reach = layout.largest + RECORD
    f.seek(at)
    data = f.read(3 * reach)  # a record begins within one, its chain outlasts another
    last = at + len(data) == size
    for begin in range(min(reach, len(data))):
        place = begin
        while place is not None and place - begin <= reach and place + RECORD <= len(data):
            place = layout.plausible(data, place)
        if place is not None and (place - begin > reach or (last and place >= len(data))):
            return at + begin
    return size


def records(f, layout: Layout, at: int, end: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(place, microseconds, bytes kept, length, frame) of the records that begin in [at, end), read in pieces of bounded size.
    A record cut off by the end of the file comes with what is left of it."""
    f.seek(at)
    stream = io.BufferedReader(f, 1 << 20) if not isinstance(f, io.BufferedReader) and isinstance(f, io.RawIOBase) else f
    while at < end:
        head = stream.read(RECORD)
        if len(head) < RECORD:
            return
        sec, frac, kept, length = layout.record(head, 0)
        yield at, sec * 1_000_000 + (frac // 1000 if layout.nano else frac), kept, length, stream.read(kept) if kept else b""
        at += RECORD + kept


def walk(f, layout: Layout, at: int, end: int, size: int) -> tuple[int, int]:
    """Number of records that begin in [at, end), and where the last of them ends: headers only."""
    n = 0
    while at < end and at + RECORD <= size:
        f.seek(at)
        at += RECORD + layout.record(f.read(RECORD), 0)[2]
        n += 1
    return n, max(at, end) if at + RECORD > size else at


_RANGE = "path string, size long, number int, low long, high long, cut boolean"
_WALKED = f"{_RANGE}, begin long, stop long, records long"


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = []
        for path, size, low, high, cut, given in zip(b["path"], b["size"], b["low"], b["high"], b["cut"], b["given"]):
            if not cut:
                found.append((0, size, 0))
                continue
            with open_file(path) as f:
                layout = read_layout(f)
                begin = first_record(f, layout, low, size) if pd.isna(given) else int(given)
                n, stop = walk(f, layout, begin, high, size)
                found.append((begin, stop, n))
        out = b.drop(columns="given")
        out[["begin", "stop", "records"]] = pd.DataFrame(found, columns=["begin", "stop", "records"], index=b.index)
        yield out


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        cut = []
        for path in b["path"]:
            with open_file(path) as f:
                try:
                    read_layout(f)
                    cut.append(True)
                except (ValueError, struct.error):
                    cut.append(False)
        yield b.assign(cut=cut)


def file_ranges(spark: SparkSession, path: str, pattern: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, number, begin, stop and first record number (`base`) of every range of every capture file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select(
        "path", F.col("length").alias("size"))
    files = files.mapInPandas(_heads, "path string, size long, cut boolean")
    ranges = files.withColumn("number", F.explode(F.when(F.col("cut"), F.expr(f"sequence(0L, greatest(size - 1, 0L) div {int(range_bytes)}L)")).otherwise(
        F.array(F.lit(0).cast("long"))))).select(
        "path", "size", F.col("number").cast("int").alias("number"), (F.col("number") * range_bytes).alias("low"),
        F.when(F.col("cut"), F.least(F.col("size"), (F.col("number") + 1) * range_bytes)).otherwise(F.col("size")).alias("high"), "cut")
    ranges = materialise(ranges, "ranges")
    tasks = max(1, min(4096, ranges.count()))
    walked = materialise(ranges.withColumn("given", F.lit(None).cast("long")).repartition(tasks, "path", "number").mapInPandas(_walked, _WALKED), "walked")
    order = W.partitionBy("path").orderBy("number")
    while True:
        due = walked.withColumn("given", F.lag("stop").over(order))
        wrong = due.where("given IS NOT NULL AND given <> begin")
        if wrong.isEmpty():
            break
        kept = due.where("given IS NULL OR given = begin").drop("given")
        again = wrong.select(*[c.split()[0] for c in _RANGE.split(", ")], "given").repartition(tasks, "path", "number").mapInPandas(_walked, _WALKED)
        walked = materialise(kept.unionByName(again), "walked")
    earlier = F.coalesce(F.sum("records").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return walked.select("path", "number", "begin", F.greatest("begin", F.least("stop", "high")).alias("stop"), "size", "cut", earlier.alias("base"))


# ---------------------------------------------------------------- a growing capture as a stream

class _Bytes(InputPartition):
    def __init__(self, path: str, begin: int, end: int, border: bool):
        self.path, self.begin, self.end, self.border = path, begin, end, border  # border: a record begins at `begin`


class CaptureStream(DataSource):
    """`spark.readStream.format("capture")`: packets of classic capture files that grow, in folder `path` (a local or shared
    one). Offsets are the bytes read of each file; a record is read once it is whole. `range_bytes` cuts a batch into tasks.
    `seq` is the record's place in its file: it orders and names packets, but is no count."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self):
        return T.StructType([*PACKET_SCHEMA.fields, T.StructField("path", T.StringType())])

    def streamReader(self, schema):
        return _CaptureReader(self.options)


class _CaptureReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = unquote(urlparse(options["path"]).path)
        self.suffix, self.step = options.get("suffix", ".pcap"), int(options.get("range_bytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the last whole record of every file."""
        found = {}
        for name in sorted(os.listdir(self.folder)):
            path = os.path.join(self.folder, name)
            size = os.path.getsize(path)
            if name.endswith(self.suffix) and size >= HEAD:
                found[path] = self._whole(path, size)
        return found

    def _whole(self, path: str, size: int) -> int:
        with open_file(path) as f:
            layout = read_layout(f)
            at = HEAD if size <= HEAD + 4 * LARGEST else first_record(f, layout, size - 3 * (layout.largest + RECORD), size)
            while at + RECORD <= size:
                f.seek(at)
                end = at + RECORD + layout.record(f.read(RECORD), 0)[2]
                if end > size:
                    break
                at = end
            return min(at, size)

    def partitions(self, start: dict, end: dict):
        out = []
        for path, stop in end.items():
            begin = start.get(path, HEAD)
            out += [_Bytes(path, low, min(low + self.step, stop), low == begin) for low in range(begin, stop, self.step)]
        return out

    def read(self, partition):
        from packetloom.sources.capture import parsed

        names = PACKET_SCHEMA.names
        with open_file(partition.path) as f:
            layout = read_layout(f)
            size = os.path.getsize(partition.path)
            begin = partition.begin if partition.border else first_record(f, layout, partition.begin, size)
            for at, us, _, length, frame in records(f, layout, begin, partition.end):
                row, _ = parsed(layout.link, frame, at, us, length)
                if row is not None:
                    row["packet_time"] = EPOCH + timedelta(microseconds=us)
                    yield (*(row[n] for n in names), partition.path)

"""Packet capture files to packet rows, and packet rows to capture files.

Spark lists the files, `capture_ranges.py` cuts them into byte ranges, and each range is decoded by its own task. Both classic
capture files (either byte order, micro- or nanosecond stamps) and the block format that replaced it are read; the latter
whole, mapped into memory page by page.
"""

from __future__ import annotations

import io
import ipaddress
import itertools
import mmap
import os
import shutil
import struct
import tempfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.schemas import PACKET_SCHEMA, TCP_FLAGS
from packetloom.session import materialise
from packetloom.sources import capture_ranges as R

# A file magic, link types, EtherTypes and IPv6 extension header numbers.
BLOCK_SECTION = 0x0A0D0D0A
LINK_ETHERNET, LINK_RAW = 1, (12, 14, 101)
ETHER_IPV4, ETHER_IPV6, ETHER_VLAN = 0x0800, 0x86DD, (0x8100, 0x88A8)
TCP, UDP, ICMP = 6, 17, 1


def _blocks(data: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    order, links, at = "<", [], 0
    while at + 12 <= len(data):
        kind = struct.unpack_from(order + "I", data, at)[0]
        if kind == BLOCK_SECTION:
            order = "<" if struct.unpack_from("<I", data, at + 8)[0] == 0x1A2B3C4D else ">"
            links = []
        size = struct.unpack_from(order + "I", data, at + 4)[0]
        if size < 12:
            return
        if kind == 1:  # interface: link type and clock resolution
            link, ticks, opt = struct.unpack_from(order + "H", data, at + 8)[0], 1_000_000, at + 16
            while opt + 4 <= at + size - 4:
                code, length = struct.unpack_from(order + "HH", data, opt)
                if code == 0:
                    break
                if code == 9:
                    raw = data[opt + 4]
                    ticks = 2 ** (raw & 0x7F) if raw & 0x80 else 10**raw
                opt += 4 + (length + 3) // 4 * 4
            links.append((link, ticks))
        elif kind == 6 and links:  # packet
            iface, hi, lo, kept, length = struct.unpack_from(order + "IIIII", data, at + 8)
            link, ticks = links[iface] if iface < len(links) else links[0]
            yield ((hi << 32) | lo) * 1_000_000 // ticks, link, data[at + 28 : at + 28 + kept], length
        at += size


def _parse(link: int, frame: bytes) -> dict | None:
    """Packet fields of one frame, None when it carries no IP."""
    at = 0
    if link == LINK_ETHERNET:
        at, ether = 14, struct.unpack_from(">H", frame, 12)[0]
        while ether in ETHER_VLAN:
            ether = struct.unpack_from(">H", frame, at + 2)[0]
            at += 4
        if ether not in (ETHER_IPV4, ETHER_IPV6):
            return None
    elif link not in LINK_RAW:
        return None
    version = frame[at] >> 4
    if version == 4:
        header = (frame[at] & 0x0F) * 4
        total = struct.unpack_from(">H", frame, at + 2)[0] or len(frame) - at
        proto = frame[at + 9]
        fragment = struct.unpack_from(">H", frame, at + 6)[0] & 0x1FFF
        src, dst = frame[at + 12 : at + 16], frame[at + 16 : at + 20]
    elif version == 6:
        header, fragment = 40, 0
        total = 40 + struct.unpack_from(">H", frame, at + 4)[0]
        proto = frame[at + 6]
        src, dst = frame[at + 8 : at + 24], frame[at + 24 : at + 40]
    else:
        return None
    body, left = at + header, total - header
    row = dict.fromkeys(TCP_FLAGS, False) | {
        "src_ip": str(ipaddress.ip_address(src)), "dst_ip": str(ipaddress.ip_address(dst)),
        "src_port": 0, "dst_port": 0, "protocol": proto, "win_bytes": 0,
        "header_len": header, "payload_len": max(0, left),
    }
    if fragment:
        return row
    if proto == TCP:
        sport, dport, _, _, off, flags, win = struct.unpack_from(">HHIIBBH", frame, body)
        size = (off >> 4) * 4
        row |= {"src_port": sport, "dst_port": dport, "win_bytes": win,
                "header_len": header + size, "payload_len": max(0, left - size)}
        row |= {name: bool(flags & (1 << bit)) for bit, name in enumerate(TCP_FLAGS)}
    elif proto == UDP:
        sport, dport = struct.unpack_from(">HH", frame, body)
        row |= {"src_port": sport, "dst_port": dport, "header_len": header + 8, "payload_len": max(0, left - 8)}
    elif proto == ICMP:
        row |= {"header_len": header + 8, "payload_len": max(0, left - 8)}
    return row


def parsed(link: int, frame: bytes, seq: int, when: int, length: int) -> tuple[dict | None, str | None]:
    """The packet row of a frame, or the reason why there is none."""
    try:
        row, reason = _parse(link, frame), "no IP packet"
    except (struct.error, IndexError, ValueError) as e:
        row, reason = None, f"damaged: {type(e).__name__}"
    if row is None:
        return None, reason
    return row | {"seq": seq, "packet_time": pd.Timestamp(when, unit="us"), "pkt_len": length}, None


def _range_records(path: str, begin: int, stop: int, size: int, cut: bool, base: int) -> Iterator[tuple[int, dict | None, str | None]]:
    """(number, packet row, None) or (number, None, reason) of the records of a range."""
    if size < R.HEAD:
        yield 0, None, "file shorter than a header"
        return
    with R.open_file(path) as f:
        if cut:
            layout = R.read_layout(f)
            found = ((us, layout.link, frame, length) for _, us, _, length, frame in R.records(f, layout, begin, stop))
        else:
            try:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            except (OSError, AttributeError, ValueError, io.UnsupportedOperation):
                data = f.read()
            if struct.unpack_from("<I", data)[0] != BLOCK_SECTION:
                yield 0, None, "unknown layout"
                return
            found = _blocks(data)
        for seq, (when, link, frame, length) in enumerate(found, base):
            yield seq, *parsed(link, frame, seq, when, length)


_WHERE = ("path", "begin", "stop", "size", "cut", "base")


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", *[f.name for f in PACKET_SCHEMA if f.name != "path"]]
    for batch in batches:
        for place in zip(*(batch[c] for c in _WHERE)):
            packets = (row | {"path": place[0]} for _, row, _ in _range_records(*place) if row is not None)
            while rows := list(itertools.islice(packets, 20_000)):
                yield pd.DataFrame(rows, columns=columns)


def _reject(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for place in zip(*(batch[c] for c in _WHERE)):
            bad = ((place[0], seq, reason) for seq, row, reason in _range_records(*place) if row is None)
            while rows := list(itertools.islice(bad, 20_000)):
                yield pd.DataFrame(rows, columns=["path", "seq", "reason"])


def _dealt(spark: SparkSession, path: str, pattern: str, range_bytes: int) -> DataFrame:
    ranges = materialise(R.file_ranges(spark, path, pattern, range_bytes), "ranges")
    return ranges.repartition(max(1, min(4096, ranges.count())), "path", "number").select(*_WHERE)


def decode_capture_files(spark: SparkSession, path: str, pattern: str = "*.pcap*", range_bytes: int = R.RANGE_BYTES) -> DataFrame:
    """Packet rows of every capture file below `path`, with the file name as `path`.

    `seq` is the record number in its file. What gives no packet is listed by `rejected_records`.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKET_SCHEMA if f.name != "path")
    return _dealt(spark, path, pattern, range_bytes).mapInPandas(_decode, f"path string, {fields}")


def rejected_records(spark: SparkSession, path: str, pattern: str = "*.pcap*", range_bytes: int = R.RANGE_BYTES) -> DataFrame:
    """path, seq and reason of every record (or file) that gives no packet."""
    return _dealt(spark, path, pattern, range_bytes).mapInPandas(_reject, "path string, seq long, reason string")


def write_captures(packets: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Writes packet rows as classic capture files of bare IPv4 packets, one a task, and lists them (path, packets).

    Rows go by (packet_time, seq). Payloads are zeros; fields wider than on the wire are cut to their low bits. A file appears
    under its name only when it is whole, so a task that runs twice leaves one. With fewer `files` than tasks, the tasks sort and
    write pieces of a file, which are then copied to their places in it, all at once.
    """
    folder = unquote(urlparse(folder).path)
    os.makedirs(folder, exist_ok=True)
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in packets.columns else F.lit(False).alias(c) for c in TCP_FLAGS]
    rows = packets.select(F.unix_micros(F.col("packet_time").cast("timestamp")).alias("us"), "seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                          "pkt_len", "payload_len", "win_bytes", *flags)
    tasks = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if files and files < tasks:
        return _written_in_pieces(rows, folder, files, tasks)

    def run(batches):
        path = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.pcap")
        held = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
        with open(held, "wb") as f:
            f.write(_HEADER)
            n = _append(batches, f)
        os.replace(held, path)
        yield pd.DataFrame({"path": [path], "packets": [n]})

    return rows.repartitionByRange(files or tasks, "us", "seq").sortWithinPartitions("us", "seq").mapInPandas(run, "path string, packets long")


_HEADER = struct.pack("<IHHiIII", R.MAGIC_MICRO, 2, 4, 0, 0, 65_535, LINK_RAW[-1])


def _append(batches: Iterator[pd.DataFrame], f) -> int:
    """Writes the records of packet rows and returns their number."""
    n = 0
    for b in batches:
        for p in b.to_dict("records"):
            frame = _frame(p)
            us = int(p["us"])
            f.write(struct.pack("<IIII", us // 10**6, us % 10**6, len(frame), int(p["pkt_len"])) + frame)
            n += 1
    return n


def _written_in_pieces(rows: DataFrame, folder: str, files: int, tasks: int) -> DataFrame:
    spark = rows.sparkSession
    pieces = tempfile.mkdtemp(prefix="_pieces-", dir=folder)
    os.chmod(pieces, 0o777)  # executors may run as another user

    def write(batches):
        number = TaskContext.get().partitionId()
        path = os.path.join(pieces, f"{number:05d}-{TaskContext.get().taskAttemptId()}")
        with open(path, "wb") as f:
            n = _append(batches, f)
            size = f.tell()
        yield pd.DataFrame({"number": [number], "piece": [path], "size": [size], "packets": [n]})

    def copy(batches):
        for b in batches:
            for piece, target, place in zip(b["piece"], b["target"], b["place"]):
                with open(piece, "rb") as source, open(target, "r+b") as f:
                    f.seek(place)
                    shutil.copyfileobj(source, f, 1 << 20)
            yield b[["piece"]]

    written = sorted(rows.repartitionByRange(tasks, "us", "seq").sortWithinPartitions("us", "seq").mapInPandas(
        write, "number int, piece string, size long, packets long").collect())  # a row a task
    held = [os.path.join(pieces, f"{k:05d}.whole") for k in range(files)]
    sizes, packets, places = [len(_HEADER)] * files, [0] * files, []
    for number, piece, size, n in written:
        k = number * files // tasks
        places.append((piece, held[k], sizes[k]))
        sizes[k] += size
        packets[k] += n
    for path, size in zip(held, sizes):
        with open(path, "wb") as f:
            f.write(_HEADER)
            f.truncate(size)
    if places:
        spark.createDataFrame(places, "piece string, target string, place long").repartition(len(places), "piece").mapInPandas(
            copy, "piece string").write.format("noop").mode("overwrite").save()
    out = []
    for k, path in enumerate(held):
        whole = os.path.join(folder, f"part-{k:05d}.pcap")
        os.replace(path, whole)
        out.append((whole, packets[k]))
    shutil.rmtree(pieces)
    return spark.createDataFrame(out, "path string, packets long")


def _frame(p: dict) -> bytes:
    flags = sum(bool(p[name]) << bit for bit, name in enumerate(TCP_FLAGS))
    sport, dport = int(p["src_port"]) & 0xFFFF, int(p["dst_port"]) & 0xFFFF
    if p["protocol"] == TCP:
        body = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, int(p["win_bytes"]) & 0xFFFF, 0, 0)
    elif p["protocol"] == UDP:
        body = struct.pack(">HHHH", sport, dport, (8 + int(p["payload_len"])) & 0xFFFF, 0)
    else:
        body = bytes(8)
    body += bytes(int(p["payload_len"]))
    ends = b"".join(ipaddress.IPv4Address(p[c]).packed for c in ("src_ip", "dst_ip"))
    return struct.pack(">BBHHHBBH", 0x45, 0, (20 + len(body)) & 0xFFFF, 1, 0, 64, int(p["protocol"]), 0) + ends + body


def skipped_frames(packets: DataFrame) -> DataFrame:
    """Per file: packets kept and the highest record number seen."""
    return packets.groupBy("path").agg(F.count("*").alias("kept"), (F.max("seq") + 1).alias("records_seen"))

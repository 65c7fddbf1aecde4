"""Decoding of capture files built here byte by byte."""

import struct

from packetloom.operators import flows as FL
from packetloom.sources import capture_ranges as R
from packetloom.sources.capture import decode_capture_files, skipped_frames, write_captures


def ip4(src, dst, proto, body):
    def a(x):
        return bytes(int(p) for p in x.split("."))

    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 64, proto, 0, a(src), a(dst)) + body


def tcp(sport, dport, flags, win=0, data=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, win, 0, 0) + data


def udp(sport, dport, data=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def ether(kind, body):
    return b"\x00" * 12 + struct.pack(">H", kind) + body


FRAMES = [
    (1_700_000_000_000_000, ether(0x0800, ip4("10.0.0.1", "192.168.1.1", 6, tcp(12345, 80, 0x02, 8192)))),
    (1_700_000_000_010_000, ether(0x0800, ip4("192.168.1.1", "10.0.0.1", 6, tcp(80, 12345, 0x12, 8192)))),
    (1_700_000_000_020_000, ether(0x8100, b"\x00\x01\x08\x00" + ip4("10.0.0.1", "192.168.1.1", 6, tcp(12345, 80, 0x18, 0, b"x" * 18)))),
    (1_700_000_000_030_000, ether(0x0806, b"\x00" * 28)),
    (1_700_000_000_040_000, ether(0x86DD, struct.pack(">IHBB", 6 << 28, 17, 17, 64) + b"\x20\x01" + b"\x00" * 13 + b"\x01"
                                  + b"\x20\x01" + b"\x00" * 13 + b"\x02" + udp(5000, 53, b"y" * 9))),
    (1_700_000_000_050_000, ether(0x0800, ip4("10.0.0.1", "192.168.1.1", 1, b"\x08\x00" + b"\x00" * 6 + b"ping"))),
    (1_700_000_000_060_000, ether(0x0800, ip4("10.0.0.1", "192.168.1.1", 6, b"\x00\x50"))),  # cut off
]


def classic(order="<", nano=False):
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for us, f in FRAMES:
        out += struct.pack(order + "IIII", us // 10**6, us % 10**6 * (1000 if nano else 1), len(f), len(f)) + f
    return out


def blocks():
    def block(kind, body):
        body += b"\x00" * (-len(body) % 4)
        size = 12 + len(body)
        return struct.pack("<II", kind, size) + body + struct.pack("<I", size)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for us, f in FRAMES:
        out += block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_all_layouts_decode_alike(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(classic())
    (tmp_path / "b.pcap").write_bytes(classic(">"))
    (tmp_path / "c.pcap").write_bytes(classic(nano=True))
    (tmp_path / "d.pcapng").write_bytes(blocks())
    (tmp_path / "e.pcap").write_bytes(b"short")
    rows = decode_capture_files(spark, str(tmp_path)).cache()
    files = {}
    for r in rows.collect():
        files.setdefault(r["path"][-8:], []).append(tuple(r)[1:])
    assert len(files) == 4 and len({tuple(sorted(v, key=lambda r: r[0])) for v in files.values()}) == 1
    one = {r["seq"]: r for r in rows.where("path LIKE '%a.pcap'").collect()}
    assert sorted(one) == [0, 1, 2, 4, 5]
    assert (one[0]["src_port"], one[0]["syn"], one[0]["ack"], one[0]["win_bytes"]) == (12345, True, False, 8192)
    assert (one[2]["payload_len"], one[2]["header_len"], one[2]["psh"], one[2]["ack"]) == (18, 40, True, True)
    assert (one[4]["src_ip"], one[4]["protocol"], one[4]["payload_len"], one[4]["header_len"]) == ("2001::1", 17, 9, 48)
    assert (one[5]["protocol"], one[5]["header_len"], one[5]["payload_len"], one[5]["src_port"]) == (1, 28, 4, 0)
    assert one[1]["pkt_len"] == 54 and str(one[1]["packet_time"]) == "2023-11-14 22:13:20.010000"
    assert skipped_frames(rows).where("kept = 5").count() == 4
    assert FL.flow_features(rows.where("path LIKE '%a.pcap'")).count() == 3


def many(path, n, payload=lambda k: b"p" * (k * 37 % 900), order="<"):
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 2000, 101))
        for k in range(n):
            frame = ip4("10.0.0.1", "10.0.0.2", 6, tcp(1000 + k % 5000, 80, 0x18, k % 65536, payload(k)))
            f.write(struct.pack(order + "IIII", 1_700_000_000 + k // 100, k % 100, len(frame), len(frame)) + frame)


def test_ranges_number_records_through(spark, tmp_path):
    many(tmp_path / "a.pcap", 3000)
    many(tmp_path / "b.pcap", 1, order=">")
    whole = decode_capture_files(spark, str(tmp_path), range_bytes=1 << 30)
    parts = decode_capture_files(spark, str(tmp_path), range_bytes=40_000)
    assert parts.exceptAll(whole).isEmpty() and parts.count() == 3001
    seqs = sorted(r["seq"] for r in parts.where("path LIKE '%a.pcap'").collect())
    assert seqs == list(range(3000))
    assert R.file_ranges(spark, str(tmp_path), "*.pcap", 40_000).where("path LIKE '%a.pcap'").count() > 30


def test_a_capture_inside_a_capture(spark, tmp_path):
    """Payloads that hold whole record chains of another capture must not pass for records."""
    inner = ip4("9.9.9.9", "8.8.8.8", 17, udp(1, 2, b"z"))
    chain = struct.pack("<IIII", 1_700_000_000, 5, len(inner), len(inner)) + inner
    many(tmp_path / "a.pcap", 800, payload=lambda k: chain * 30 if k % 3 else b"x" * 50)
    got = decode_capture_files(spark, str(tmp_path), range_bytes=20_000)
    assert got.count() == 800 and got.where("src_ip = '9.9.9.9'").isEmpty()


def test_a_sparse_file_above_two_gigabytes(spark, tmp_path):
    path, last = tmp_path / "big.pcap", 40_000
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101))
        for k in range(last):
            frame = ip4("10.0.0.1", "10.0.0.2", 17, udp(k % 60000, 53, b"q"))
            f.write(struct.pack("<IIII", 1_700_000_000 + k, 0, 60_000, 60_000) + frame)
            f.seek(60_000 - len(frame), 1)
        f.truncate(f.tell())
    assert path.stat().st_size > 2**31
    ranges = R.file_ranges(spark, str(tmp_path), "*.pcap", 256 << 20).collect()
    assert len(ranges) == 9 and sum(r["stop"] > r["begin"] for r in ranges) == 9
    got = decode_capture_files(spark, str(tmp_path), range_bytes=256 << 20).agg({"seq": "max", "src_port": "count"}).first()
    assert tuple(sorted(got)) == (last - 1, last)


def test_packets_written_are_read_again(spark, tmp_path):
    many(tmp_path / "a.pcap", 500)
    packets = decode_capture_files(spark, str(tmp_path))
    listed = write_captures(packets, str(tmp_path / "out"), files=3).collect()
    assert sum(r["packets"] for r in listed) == 500 and not list((tmp_path / "out").glob("*.tmp"))
    again = decode_capture_files(spark, str(tmp_path / "out"))
    columns = [c for c in packets.columns if c not in ("seq", "path")]
    assert again.select(*columns).exceptAll(packets.select(*columns)).isEmpty()


def test_a_growing_capture_as_a_stream(spark, tmp_path):
    folder, out, state = tmp_path / "live", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    many(tmp_path / "all.pcap", 300)
    data = (tmp_path / "all.pcap").read_bytes()
    spark.dataSource.register(R.CaptureStream)
    for cut in (len(data) // 3, len(data) - 5, len(data)):
        (folder / "a.pcap").write_bytes(data[:cut])
        rows = spark.readStream.format("capture").option("range_bytes", "20000").load(str(folder))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 300 and got.select("seq").distinct().count() == 300


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    many(tmp_path / "a.pcap", 500)
    packets = decode_capture_files(spark, str(tmp_path))
    sc = spark.sparkContext
    sc.setJobGroup("one-file", "")
    try:
        listed = write_captures(packets, str(tmp_path / "one"), files=1).collect()
    finally:
        sc.setJobGroup("", "")
    assert [r["packets"] for r in listed] == [500] and [p.name for p in (tmp_path / "one").iterdir()] == ["part-00000.pcap"]
    write_captures(packets, str(tmp_path / "many"), files=4).collect()
    parts = [p.read_bytes() for p in sorted((tmp_path / "many").iterdir())]
    assert len(parts) == 4 and parts[0] + b"".join(p[R.HEAD:] for p in parts[1:]) == (tmp_path / "one" / "part-00000.pcap").read_bytes()
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("one-file") for s in tracker.getJobInfo(j).stageIds]
    assert 4 in {s.numTasks for s in stages if s}  # of a table in one partition

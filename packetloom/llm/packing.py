"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance is its histogram: at most `capacity` counts, whatever the
number of documents. On it small sets that provably dominate every alternative are fixed for good (a piece alone, the
pair that fills a sequence, the longest partner where only one more fits, the best two where only two fit); the rest is
packed by best fit, longest first. Both steps treat equal lengths at once, and each step uses up a length or a kind of
open sequence, so the plan has a few thousand rows at most. Pieces get numbers within their length, counted in hashed
buckets so that a length shared by a third of all pieces is no hot group, and look up their places.

A null or empty text is the single id 0. Repeated rows are packed once each. A null id is carried through. An empty table
gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from packetloom.llm import words as X
from packetloom.llm.shared import plus
from packetloom.session import materialise

CAPACITY = 2048
Pattern = tuple[int, list[tuple[int, int]]]  # how many sequences hold these (length, pieces)


class Remembered:
    """A dictionary of bounded size that keeps what was used lately: full, it becomes the older half and starts anew."""

    def __init__(self, size: int):
        self.size, self.now, self.old = size, {}, {}

    def lacking(self, keys: set[str]) -> list[str]:
        """The keys that are not held, after those of the older half have been taken over."""
        if len(self.now) > self.size:
            self.now, self.old = {}, self.now
        gone = keys.difference(self.now)
        self.now.update((k, self.old[k]) for k in gone if k in self.old)
        return list(gone.difference(self.now))


class ChunkTokenizer:
    """Ids of whole texts by a tokenizer that drops white space and lowers case, one chunk between blanks at a time.

    Chunks are remembered. Of a new chunk, letters followed by punctuation are two words to the tokenizer, so each part is
    looked up by itself. What is new is encoded by the library in long rows, parted by a sign whose id shows the ends."""

    SIGN, ROW, HELD, LONG = "|", 200, 400_000, 64
    POINTS = ".,;:!?%#*$&()[]{}<>=+-"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.parts = Remembered(self.HELD), Remembered(self.HELD)
        (self.mark,) = self._library([self.SIGN])[0]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without blanks. A row whose count of signs is not as written is encoded part by part."""
        rows = [parts[k:k + self.ROW] for k in range(0, len(parts), self.ROW)]
        out: list[bytes] = []
        for row, ids in zip(rows, self._library([f" {self.SIGN} ".join(row) for row in rows])):
            ids = np.array(ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(row) - 1 and not any(self.SIGN in p for p in row):
                flat = ids.tobytes()
                begins = [0, *(4 * (ends + 1)).tolist()]
                out += [flat[a:b] for a, b in zip(begins, [*(4 * ends).tolist(), len(flat)])]
            else:
                out += [np.array(x, "<u4").tobytes() for x in self._library(row)]
        return out

    def _split(self, chunk: str) -> tuple[str, str]:
        core = chunk.rstrip(self.POINTS)
        if core.isalpha() and (core.isascii() or max(core) < "\u0130"):  # below it, case is the same to every library
            return core.lower(), chunk[len(core):]
        return chunk, ""

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = self.chunks.lacking(set().union(*split))
        pairs = [self._split(c) for c in new]
        unknown = self.parts.lacking({p for pair in pairs for p in pair})
        self.parts.now.update(zip(unknown, self._encode(unknown)))
        get = self.parts.now.__getitem__
        self.chunks.now.update((c, get(a) + get(b)) for c, (a, b) in zip(new, pairs))
        get = self.chunks.now.__getitem__
        ids = [b"".join(map(get, text)) for text in split]
        for c in (c for c in new if len(c) > self.LONG):  # the bound on entries is one on bytes, too
            del self.chunks.now[c]
        for p in (p for p in unknown if len(p) > self.LONG):
            del self.parts.now[p]
        return ids


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of at most `capacity` ids; each document ends with id 0."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        own = tokenizer(vocabulary)
        for part in X.pieces(batches, "t"):
            texts = part.column("t").to_pylist()
            rows = []
            for i, ids in zip(part.column("doc_id").to_pylist(), own.encode(texts)):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    held = ids[at:at + 4 * capacity]
                    rows.append((i, k, at // 4, len(held) // 4, zlib.crc32(held), *([np.frombuffer(held, "<i4")] if with_ids else ())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names[:5 + with_ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(cut, schema)


def _dominating(j: int, left: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """Lengths which, beside one piece of length j, dominate every other filling of its sequence; None if none is known.

    A filling S is dominated if its pieces can change places with the dominating ones' wherever those are.
    """
    room = capacity - j
    left[j] -= 1
    try:
        sizes = np.flatnonzero(left[:room + 1])
        if not len(sizes):
            return ()
        if left[room]:
            return (room,)
        small = np.repeat(sizes[:3], np.minimum(left[sizes[:3]], 3))[:3]
        longest = int(sizes[-1])
        if len(small) < 2 or small[:2].sum() > room:
            return (longest,)
        if len(small) == 3 and small.sum() <= room:
            return None
        # At most two fit: the best pair has each first length with the longest second that fits.
        seconds = np.searchsorted(sizes, room - sizes, "right") - 1
        ok = seconds >= 0
        same = ok & (sizes[np.maximum(seconds, 0)] == sizes) & (left[sizes] < 2)
        seconds[same] -= 1
        ok = seconds >= 0
        if not ok.any() or longest >= (sizes[ok] + sizes[seconds[ok]]).max():
            return (longest,)
        k = seconds[-1]
        if k < 0:
            return None
        second = int(sizes[k])
        more = sizes[k + 1:]
        two = np.repeat(more[:2], np.minimum(left[more[:2]], 2))[:2]
        return (longest, second) if len(two) < 2 or two.sum() > room else None
    finally:
        left[j] += 1


def reduce(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Fixes dominating sets until none is found; takes their pieces from `left`. Its premises hold while the pieces last,
    so a set is fixed as often as it can be at once."""
    fixed, again = [], True
    while again:
        again = False
        for j in np.flatnonzero(left)[::-1].tolist():
            while left[j] and (others := _dominating(j, left, capacity)) is not None:
                content: dict[int, int] = {}
                for s in (j, *others):
                    content[s] = content.get(s, 0) + 1
                times = min(int(left[s]) // n for s, n in content.items())
                for s, n in content.items():
                    left[s] -= n * times
                fixed.append((times, list(content.items())))
                again = True
    return fixed


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first, all pieces of a length at once: each goes to the fullest sequence that has room for it."""
    rooms: list[int] = []
    held: dict[int, list[Pattern]] = {}

    def put(room: int, times: int, content: list[tuple[int, int]]):
        if room not in held:
            bisect.insort(rooms, room)
            held[room] = []
        held[room].append((times, content))

    for s in np.flatnonzero(left)[::-1].tolist():
        count = int(left[s])
        while count:
            k = bisect.bisect_left(rooms, s)
            if k == len(rooms):
                room, times, content = capacity, math.ceil(count / (capacity // s)), []
            else:
                room = rooms[k]
                times, content = held[room].pop()
                if not held[room]:
                    del held[room], rooms[k]
            each = room // s
            full = min(times, count // each)
            if full:
                put(room - each * s, full, [*content, (s, each)])
                count -= full * each
            if full < times:
                if not full:  # fewer than one sequence takes
                    put(room - count * s, 1, [*content, (s, count)])
                    full, count = 1, 0
                if content and full < times:
                    put(room, times - full, content)
    return [p for some in held.values() for p in some]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first number, sequence of that number, pieces per sequence, offset of the first), ordered."""
    left = np.zeros(capacity + 1, np.int64)
    for size, count in histogram.items():
        left[size] = count
    patterns = reduce(left, capacity)
    patterns += best_fit(left, capacity)
    cursor, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for times, content in patterns:
        offset = 0
        for size, each in content:
            rows.append((size, int(cursor[size]), sequence, each, offset))
            cursor[size] += times * each
            offset += size * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def number(pieces: DataFrame, buckets: int) -> DataFrame:
    """Adds `number`: 0, 1, ... within each length. A length's pieces are dealt to `buckets` by a hash and numbered there."""
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = dealt.withColumn("place", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece")))
    return own.join(base, ["length", "bucket"]).withColumn("number", F.col("base") + F.col("place") - 1).drop("bucket", "base", "place")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table with doc_id, piece, ids_crc32 and length."""
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = pieces.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    numbered = number(pieces, math.isqrt(sum(histogram.values())) + 1)
    names = [*numbered.columns, "sequence_id", "offset"]

    def place(batches):
        size, first, sequence, each, offset = table.value.T
        keys = size << 40 | first
        for b in batches:
            length, n = b.column("length").to_numpy(), b.column("number").to_numpy()
            k = np.searchsorted(keys, length << 40 | n, "right") - 1
            step = n - first[k]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sequence[k] + step // each[k]), pa.array(offset[k] + step % each[k] * length)], names=names)

    return numbered.mapInArrow(place, plus(numbered.schema, sequence_id="long", offset="long")).drop("number")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(token_pieces(docs, vocabulary, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

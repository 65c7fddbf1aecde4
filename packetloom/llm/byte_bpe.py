"""Byte-level BPE encoding and decoding without regular expressions.

Code points are mapped to classes. An automaton over the classes knows where pre-tokens begin; every class is a function
from state to state, and composing functions is associative. So the functions are scanned in many lanes at once: each
lane composes its own functions step by step, the lanes' totals are composed in turn, and a last lookup gives every
position its state. The slices between boundaries feed a cache of merged pairs. Tokens keep their byte offsets, from
which decoding places their bytes in one step.

Null and empty texts have no tokens and decode to no bytes. Memory follows a slice of about a megabyte, or the longest
single text. Rows are independent, so repeated rows and ties get the same result; columns besides the id and the text
are not read.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from packetloom.llm import words as X
from packetloom.llm.shared import plus

# Classes: the letters that can stand in a contraction have classes of their own.
LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE, S, T, R, E, V, M, L, D, EDGE = range(15)
CLASSES = 15
_LETTERS = (LETTER, S, T, R, E, V, M, L, D)
# States: what the open pre-token is made of. AFTER_*: a quote opened it and one letter of a longer contraction followed.
(START, IN_LETTERS, IN_NUMBER, IN_OTHER, AFTER_BLANK, AFTER_SPACE, AFTER_QUOTE, AFTER_R, AFTER_V, AFTER_L, DONE) = range(11)
STATES = 11
_LONGER = {R: (AFTER_R, E), V: (AFTER_V, E), L: (AFTER_L, L)}


def _classes() -> np.ndarray:
    """Class of every code point. Letters and numbers are those of the library's own version of Unicode: it is asked once,
    with all code points as one text, which of them it holds for letters and which for numbers."""
    bytes_alone = {bytes([k]): k for k in range(256)}
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, known in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        encoding = tiktoken.Encoding("points", pat_str=known, mergeable_ranks=bytes_alone, special_tokens={})
        table[np.frombuffer(bytes(encoding.encode_ordinary(points)).decode().encode("utf-32-le"), np.uint32)] = kind
    for sign, kind in zip(" 'strevmld", (BLANK, QUOTE, S, T, R, E, V, M, L, D)):
        table[ord(sign)] = kind
    return table


def _next_state(state: int, kind: int) -> int:
    if kind == EDGE:
        return START
    if kind == BLANK:
        return AFTER_BLANK
    if kind == SPACE:
        return AFTER_SPACE
    if kind == NUMBER:
        return IN_NUMBER
    if kind in (OTHER, QUOTE):
        joins = state in (IN_OTHER, AFTER_BLANK, AFTER_QUOTE)
        return AFTER_QUOTE if kind == QUOTE and not joins else IN_OTHER
    if state == AFTER_QUOTE and kind in (S, T, M, D):
        return DONE
    if state == AFTER_QUOTE and kind in _LONGER:
        return _LONGER[kind][0]
    if any(state == after and kind == last for after, last in _LONGER.values()):
        return DONE
    return IN_LETTERS


def _begins(state: int, kind: int, following: int) -> bool:
    """Whether a pre-token begins at a character, given the state before it and the next character's class."""
    spaces = state in (AFTER_BLANK, AFTER_SPACE)
    if kind in (BLANK, SPACE):  # the last of several spaces parts from them if a word follows
        return not spaces or following not in (BLANK, SPACE, EDGE)
    if kind in (OTHER, QUOTE):
        return state not in (IN_OTHER, AFTER_BLANK, AFTER_QUOTE)
    if kind == NUMBER:
        return state not in (IN_NUMBER, AFTER_BLANK)
    if state == AFTER_QUOTE:
        return not (kind in (S, T, M, D) or kind in _LONGER and following == _LONGER[kind][1])
    if any(state == after and kind == last for after, last in _LONGER.values()):
        return False
    return state not in (IN_LETTERS, AFTER_BLANK, AFTER_R, AFTER_V, AFTER_L)


class Boundaries:
    """The automaton's functions, closed under composition, as lookup tables."""

    def __init__(self):
        self.kinds = _classes()
        single = [tuple(_next_state(s, c) for s in range(STATES)) for c in range(CLASSES)]
        functions = {tuple(range(STATES)): 0}
        queue = list(functions)
        for f in queue:
            for g in single:
                if (h := tuple(g[s] for s in f)) not in functions:
                    functions[h] = len(functions)
                    queue.append(h)
        self.apply = np.array(queue, np.uint8)  # function, state -> state
        self.step = np.array([[functions[tuple(g[s] for s in f)] for g in single] for f in queue], np.uint16)  # function, then class
        self.begin = np.array([[[_begins(s, c, n) for n in range(CLASSES)] for c in range(CLASSES)] for s in range(STATES)]).ravel()

    def states(self, kinds: np.ndarray, lane: int = 64) -> np.ndarray:
        """State before each character."""
        n = len(kinds)
        lanes = -(-n // lane)
        padded = np.full(lanes * lane, EDGE, np.uint8)
        padded[:n] = kinds
        across = np.ascontiguousarray(padded.reshape(lanes, lane).T)
        before = np.empty((lane, lanes), np.uint16)  # composition of a lane's functions before each of its characters
        done, step = np.zeros(lanes, np.uint16), self.step.ravel()
        for k in range(lane):
            before[k] = done
            done = step[done.astype(np.int32) * CLASSES + across[k]]
        entry = self._carried(done)
        return self.apply.ravel()[before.astype(np.int32) * STATES + entry].T.ravel()[:n]

    def _carried(self, totals: np.ndarray) -> np.ndarray:
        """State at the begin of each lane: an exclusive scan over the lanes' functions by doubling."""
        prefix = self.apply[totals]
        reach = 1
        while reach < len(prefix):
            prefix[reach:] = np.take_along_axis(prefix[reach:], prefix[:-reach].astype(np.int64), axis=1)
            reach *= 2
        entry = np.zeros(len(totals), np.int32)
        entry[1:] = prefix[:-1, START]
        return entry

    def find(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Places where pre-tokens begin; a text ends at each of `edges`."""
        kinds = self.kinds[points]
        kinds[edges] = EDGE
        following = np.append(kinds[1:], EDGE)
        key = (self.states(kinds).astype(np.int32) * CLASSES + kinds) * CLASSES + following
        begin = self.begin[key]
        begin[edges] = True
        return np.flatnonzero(begin)


class Codec:
    """Ranks of a vocabulary with a cache of the ids of whole pre-tokens."""

    CACHED = 600_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[[self.ranks[t] for t in tokens]] = [len(t) for t in tokens]
        self.places = np.cumsum(self.sizes) - self.sizes
        self.boundaries, self.cache = Boundaries(), {}

    def merge(self, piece: bytes) -> list[int]:
        """Joins the adjacent pair of least rank, leftmost first, until no pair has a rank; a heap holds the pairs."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        part: list[bytes | None] = [piece[k:k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, part[k], part[k + 1]) for k in range(n - 1) if (r := ranks.get(piece[k:k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if part[k] is not a or j >= n or part[j] is not b:
                continue
            part[k], part[j] = a + b, None
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (r := ranks.get(part[k] + part[j])) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[j]))
            if (i := before[k]) >= 0 and (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[k]))
        return [ranks[p] for p in part if p is not None]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 places at which the texts' ids begin."""
        joined = "".join(t + "\n" for t in texts)  # each added character is an edge
        edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        begins = self.boundaries.find(np.frombuffer(joined.encode("utf-32-le"), np.uint32), edges)
        inner = np.isin(begins, edges, assume_unique=True, invert=True)
        starts, ends = begins[inner], np.append(begins[1:], len(joined))[inner]
        slices = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(self.cache) > self.CACHED:
            self.cache.clear()
        known = list(map(self.cache.get, slices))
        if None in known:
            extra = {}
            for w in {w for w, ids in zip(slices, known) if ids is None}:
                (self.cache if len(w) <= 64 else extra)[w] = np.array(self.merge(w.encode()), "<i4").tobytes()
            known = [self.cache.get(w) or extra[w] for w in slices]
        ids = np.frombuffer(b"".join(known), "<i4")
        many = np.fromiter(map(len, known), np.int64, len(known)) // 4
        total = np.concatenate([[0], np.cumsum(many)])
        return ids, total[np.concatenate([[0], np.searchsorted(starts, edges)])]

    def offsets(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its text."""
        sizes = self.sizes[ids]
        place = np.cumsum(sizes) - sizes
        base = np.append(place, sizes.sum())[bounds[:-1]]
        return place - np.repeat(base, np.diff(bounds))

    def decode(self, ids: np.ndarray, offsets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row and the n + 1 places at which they begin; every token's bytes go to its offset."""
        sizes = self.sizes[ids]
        filled = bounds[1:] > bounds[:-1]
        lengths = np.zeros(len(bounds) - 1, np.int64)
        last = bounds[1:][filled] - 1
        lengths[filled] = offsets[last] + sizes[last]
        base = np.concatenate([[0], np.cumsum(lengths)])
        place = offsets + np.repeat(base[:-1], np.diff(bounds))
        source = np.arange(sizes.sum()) + np.repeat(self.places[ids] - (np.cumsum(sizes) - sizes), sizes)
        target = np.arange(sizes.sum()) + np.repeat(place - (np.cumsum(sizes) - sizes), sizes)
        out = np.zeros(base[-1], np.uint8)
        out[target] = self.blob[source]
        return out, base


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec and cache for each worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, offsets (in bytes of the UTF-8 text) of every whole text."""
    def run(batches):
        own = codec(vocabulary)
        for part in X.pieces(batches, "t"):
            ids, bounds = own.encode([t or "" for t in part.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), _lists(ids, bounds), _lists(own.offsets(ids, bounds), bounds)], names=["doc_id", "ids", "offsets"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode(tokens: DataFrame, vocabulary: str, rows: int = 64) -> DataFrame:
    """Adds `decoded`, the bytes of the ids, to rows with ids and offsets; `rows` at a time. Null ids decode to no bytes."""
    names = [*tokens.columns, "decoded"]

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                ids, places = (part.column(c).fill_null([]) for c in ("ids", "offsets"))
                bounds = ids.offsets.to_numpy().astype(np.int64)
                out, base = own.decode(ids.flatten().to_numpy(), places.flatten().to_numpy().astype(np.int64), bounds - bounds[0])
                texts = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=names)

    return tokens.mapInArrow(run, plus(tokens.schema, decoded="binary"))

r"""Conversations as training text with a loss mask that fits the tokens.

A turn is written as <|turn|>role<|text|>text<|end|>. The three control strings are single tokens added to the tokenizer's; no
text can hold one, since a backslash is put into "<|", "<\|", "<\\|" and so on and taken out again. A conversation is rendered
whole and encoded once, with the place of every token in the rendered text. The spans of the assistant's texts and those of
the tokens are both sorted, so each token finds the span it may meet by binary search and is under the mask if it does.

Rows are ordered over sampled ranges of (conversation, turn), each range is rendered and encoded as it streams by. A conversation that
spans a border of ranges, or is longer than `limit` characters, is several segments in order; tokens are the same, as control
strings part them everywhere. Memory follows the longest text and `limit`, not the longest conversation. Only the digest over a
conversation is sequential: segments are digested where they are read, and the turns of conversations in several segments
are streamed in order, in constant memory, to one task a conversation.

A null text or role is empty, a null turn comes first; rows of one turn are ordered by role and a hash of the text, and repeated rows are turns
of their own. A null conversation id is a conversation. An empty text is a turn with no character under the mask. An empty
table has an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from packetloom.llm import words as X
from packetloom.session import materialise

TURN, TEXT, END = CONTROL = ("<|turn|>", "<|text|>", "<|end|>")
LEARNED = "assistant"
LIMIT = 1 << 18

_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of what the assistant says in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens [start, end) meet one of the sorted, disjoint spans (n, 2)."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(spans[:, 1], starts, "right")  # the first span that ends behind the token's begin
    return (at < len(spans)) & (spans[np.minimum(at, len(spans) - 1), 0] < ends)


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The connected pieces of text under the mask, unescaped. Tokens that share a character overlap."""
    s, e = starts[mask], ends[mask]
    if not len(s):
        return []
    far = np.maximum.accumulate(e)
    first = np.append(True, s[1:] > far[:-1])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(s) - 1)
    return [unescape(text[a:b]) for a, b in zip(s[first].tolist(), far[last].tolist())]


_vocabularies: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def vocabulary(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a file of ranks with the control strings as further tokens, and the bytes of each token; once a worker."""
    if path not in _vocabularies:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        free = max(ranks.values()) + 2  # the next id is the end of a text in the files of this vocabulary
        control = {c: free + k for k, c in enumerate(CONTROL)}
        sizes = np.zeros(free + len(CONTROL), np.int32)
        for token, rank in (ranks | {c.encode(): k for c, k in control.items()}).items():
            sizes[rank] = len(token)
        own = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=control)
        _vocabularies[path] = own, sizes
    return _vocabularies[path]


def encode(text: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and the code points at which each token begins and ends. Tokens that share a character's bytes share its place."""
    encoding, sizes = vocabulary(path)
    ids = encoding.encode_to_numpy(text, allowed_special=set(CONTROL), disallowed_special=()).astype(np.int32)
    ends = np.cumsum(sizes[ids])
    begun = np.cumsum(X.code_points(np.frombuffer(text.encode(), np.uint8)), dtype=np.int32)  # characters begun up to a byte
    return ids, begun[ends - sizes[ids]] - 1, begun[ends - 1]


_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("whole", pa.bool_()), ("formatted", pa.string()),
    ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])
_SEGMENT_SQL = ("conv_id long, part int, segment int, whole boolean, formatted string, ids array<int>, starts array<int>, "
                "ends array<int>, loss array<boolean>")


def _segments(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """(conv_id, part, segment, whole, turns) of the conversations of one range, in order. `whole`: nothing of the conversation
    can be elsewhere, so it is neither the first nor the last one of its range, nor in several segments."""
    conv, part, turns, size, number, begun = None, None, [], 0, 0, False
    first = True
    for batch in batches:
        for c, p, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "role", "text"))):
            if begun and (c != conv or size >= limit):
                same = c == conv
                yield conv, part, number, not (first or same or number), turns
                first, number = first and same, number + 1 if same else 0
                turns, size = [], 0
            conv, part, begun = c, p, True
            turns.append((role, text))
            size += len(role) + len(text)
    if begun:
        yield conv, part, number, False, turns


def _encoded(rows: list[tuple], path: str) -> pa.RecordBatch:
    rendered = [render(turns) for *_, turns in rows]
    ids, starts, ends = zip(*[encode(text, path) for text, _ in rendered])
    masks = [loss_mask(s, e, np.array(spans, np.int64).reshape(-1, 2)) for s, e, (_, spans) in zip(starts, ends, rendered)]
    bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (ids, starts, ends, masks)]
    plain = [pa.array([r[k] for r in rows], _SEGMENT.field(k).type) for k in range(4)]
    return pa.RecordBatch.from_arrays([*plain, pa.array([text for text, _ in rendered], pa.string()), *lists], schema=_SEGMENT)


def format_conversations(conversations: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """conv_id, part and segment (which order the segments of a conversation), whole (it is the only one), formatted, and of
    every token: ids, starts and ends (code points of `formatted`), loss (whether it is learned)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    keys = ["conv_id", "turn", "role", F.xxhash64("text"), F.monotonically_increasing_id()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns({"_h": keys[3], "_n": keys[4]}).repartitionByRange(parts, "conv_id", "turn", "role", "_h", "_n")
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "_h", "_n").select(
        "conv_id", F.spark_partition_id().alias("part"), "role", "text")

    def run(batches):
        held, size = [], 0
        for one in _segments((b for batch in batches for b in X.pieces([batch], "text")), limit):
            held.append(one)
            size += sum(len(text) for _, text in one[4]) + 64
            if size >= limit:
                yield _encoded(held, path)
                held, size = [], 0
        if held:
            yield _encoded(held, path)

    return dealt.mapInArrow(run, _SEGMENT_SQL)


_READ_SQL = ("conv_id long, part int, segment int, whole boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long, turns binary, learned binary")


def read_back(segments: DataFrame) -> DataFrame:
    """What each segment says: its turns, parsed from the formatted text, and the text under the mask, by the tokens' places.
    Segments that are a whole conversation have digests; the others carry the bytes to be digested."""
    names = [c.split()[0] for c in _READ_SQL.split(", ")]

    def run(batches):
        for batch in batches:
            for part in X.pieces([batch], "formatted"):
                out = []
                lists = [part.column(k) for k in ("starts", "ends", "loss")]
                for i, (conv, p, segment, whole, text) in enumerate(zip(*(part.column(k).to_pylist() for k in (
                        "conv_id", "part", "segment", "whole", "formatted")))):
                    s, e, m = (x[i].values.to_numpy(zero_copy_only=False) for x in lists)
                    found = _READ.findall(text)
                    turns = "".join(f"{unescape(role)}\n{unescape(body)}\n" for role, body in found).encode()
                    learned = "".join(masked_texts(text, s, e, m))
                    raw = learned.encode()
                    digests = (hashlib.sha256(turns).hexdigest(), hashlib.sha256(raw).hexdigest()) if whole else (None, None)
                    out.append((conv, p, segment, whole, len(found), digests[0], len(learned), digests[1], len(text),
                                None if whole else turns, None if whole else raw))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), _READ_TYPES)], names=names)

    return segments.mapInArrow(run, _READ_SQL)


_READ_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def conversation_digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation."""
    def join(batches):
        key, state = None, None

        def done():
            conv, n, turns, chars, learned, total = state
            return conv, n, turns.hexdigest(), chars, learned.hexdigest(), total

        for batch in batches:
            out = []
            for conv, n, turns, chars, learned, total in zip(*(batch.column(k).to_pylist() for k in (
                    "conv_id", "n_turns", "turns", "loss_chars", "learned", "formatted_chars"))):
                if state is None or conv != key:
                    if state is not None:
                        out.append(done())
                    key, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(turns)
                state[3] += chars
                state[4].update(learned)
                state[5] += total
            if out:
                yield _digest_rows(out)
        if state is not None:
            yield _digest_rows([done()])

    sql = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    stored = materialise(read, "conversations")
    parted = stored.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")
    return stored.filter("whole").select(*_DIGESTS).union(parted.mapInArrow(join, sql))


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=_DIGESTS)

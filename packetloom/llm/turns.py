"""Repair of conversations: the cheapest edits that give every conversation the roles (s?(ua)+)?, with the least audit.

Every row of a conversation is kept (0), given the other role (3), or deleted (4); empty user or assistant turns may be inserted
anywhere (3). Blank rows and repeats must be deleted; a truncated row that stays costs 3 more. Which role an inserted or changed
row gets follows from what stands before it, so there are four states (nothing, s, u, a), and the cheapest rest of the edits
from each of them is a vector of four costs.

The vectors are found from the end backwards, by a Viterbi search that is parallel in the length of a conversation:

1. Rows are numbered over sampled ranges and become one letter each; chunks of CHUNK letters are the units of work.
2. Every chunk starts from a speculative vector at its end (the last one from the true one). A row lets most differences between
   vectors vanish, so after a few rows the vectors are the true ones but for a constant.
3. Fix-up passes: where the vector a chunk used and the one its successor found differ by more than a constant, the chunk runs
   again from the latter, until old and new vector differ only by a constant. Pass k settles FAN^k neighbouring chunks in one task,
   so even rows that let no difference vanish (deleted ones) need no more passes than the logarithm of the chunks.
4. With the true vectors at the chunks' ends, each chunk traces, from each of the four states, the least letter that keeps to the cheapest
   cost; the states at the chunks' begins follow from these maps, a few numbers for a chunk.

Vectors, less their least cost, are few, so a step is a lookup. Only the audit, one letter an edit, and the digest of the
repaired turns are of a whole conversation: both are values that grow with it. Texts stream in order through one task a conversation
in constant memory; everything else is spread over chunks.

Nulls in the conversation, turn, role or text count as one space (a null turn still comes first and in no gap); rows of one turn are ordered by role and a
hash of the text. Empty texts are blank, long ones are read once. Repeated rows are faults, by the contract. An empty table
has an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from packetloom.llm.words import pieces
from packetloom.plans.numbering import number_rows
from packetloom.session import materialise

CHUNK, FAN = 4096, 16
CHANGE, DELETE, INSERT, CUT = 3, 4, 3, 3
START, S, U, A = range(4)

# A row is a letter: its role's initial (o: another one), a capital if it is truncated, a digit if it must be deleted.
INITIALS = "suao"
GONE = "1234"
_NEXT = (U, U, A, U)  # the state after an inserted or changed row
_FINAL = (0, 6, 3, 0)  # the rest after the last row
_GUESS = (0, 0, 0, 0)


def _options(letter: str) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row with this letter: (audit letter, cost, next state)."""
    out = [[("D", DELETE, state)] for state in range(4)]
    if letter in GONE:
        return out
    more, role = (CUT if letter.isupper() else 0), letter.lower()
    for state in range(4):
        if role == "s" and state == START:
            out[state].append(("K", more, S))
        elif role in "ua" and _NEXT[state] == (U if role == "u" else A):
            out[state].append(("K", more, _NEXT[state]))
        out[state].append(("R", CHANGE + more, _NEXT[state]))
    return out


class Costs:
    """Vectors less their least cost, each known by a number, and what one row makes of them."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.steps: dict[str, list[tuple[int, int] | None]] = {}
        self.choices: dict[tuple[int, str, int], tuple[str, int]] = {}
        self.options = {x: _options(x) for x in INITIALS + INITIALS.upper() + GONE}
        self.final, self.guess = self.number(_FINAL)[0], self.number(_GUESS)[0]

    def number(self, vector) -> tuple[int, int]:
        """The number of a vector and its least cost."""
        low = min(vector)
        v = tuple(x - low for x in vector)
        if v not in self.known:
            self.known[v] = len(self.vectors)
            self.vectors.append(v)
        return self.known[v], low

    def back(self, letter: str, v: int) -> tuple[int, int]:
        """The vector before a row, from the one behind it."""
        row = self.steps.setdefault(letter, [])
        while len(row) < len(self.vectors):
            row.append(None)
        if row[v] is None:
            behind = self.vectors[v]
            best = [min(cost + behind[to] for _, cost, to in edits) for edits in self.options[letter]]
            u, a = min(best[U], INSERT + best[A]), min(best[A], INSERT + best[U])
            found = self.number((min(best[START], INSERT + u), min(best[S], INSERT + u), u, a))
            self.steps[letter][v] = found
        return row[v]

    def run(self, letters: str, v: int) -> tuple[int, int]:
        """The vector before a chunk and the cost that was taken off on the way."""
        cost = 0
        for x in reversed(letters):
            row = self.steps.get(x)
            step = row[v] if row is not None and v < len(row) else None
            v, low = step or self.back(x, v)
            cost += low
        return v, cost

    def rerun(self, letters: str, old: int, new: int) -> tuple[int | None, int]:
        """As `run` from `new`, which is not `old`, but no further than to where the vectors differ only by a constant: then no
        vector, and by how much the costs before it grow."""
        taken, cost = 0, 0
        for x in reversed(letters):
            old, less = self.back(x, old)
            new, low = self.back(x, new)
            taken, cost = taken + less, cost + low
            if old == new:
                return None, cost - taken
        return new, cost

    def cheapest(self, letter: str, state: int, before: int, behind: int, spent: int) -> tuple[str, int]:
        """The least audit letter among the cheapest edits in a state, and the next state. `spent` is what `back` took off."""
        key = (state, letter, behind)
        if key not in self.choices:
            goal, after, here = self.vectors[before][state] + spent, self.vectors[behind], self.vectors[before]
            fits = [(x, to) for x, cost, to in self.options[letter][state] if cost + after[to] == goal]
            if INSERT + here[_NEXT[state]] == here[state]:
                fits.append(("I", _NEXT[state]))
            self.choices[key] = min(fits)
        return self.choices[key]

    def trace(self, letters: str, behind: int, state: int) -> tuple[str, int]:
        """The audit of a chunk from a state at its begin, and the state at its end; `behind` is the true vector there."""
        vectors, spent = [behind], []
        for x in reversed(letters):
            v, low = self.back(x, vectors[-1])
            vectors.append(v)
            spent.append(low)
        audit = []
        for k, x in enumerate(letters):
            i = len(letters) - k
            while True:
                edit, state = self.cheapest(x, state, vectors[i], vectors[i - 1], spent[i - 1])
                audit.append(edit)
                if edit != "I":
                    break
        return "".join(audit), state


def ending(state: int) -> str:
    """The edits behind the last row."""
    return "I" * (_FINAL[state] // INSERT)


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that the contract plants, by a checksum of conversation and turn: conv (the id as text, one
    space if null), turn, role, text."""
    chance = F.crc32(F.concat(_key("conv_id"), F.lit(":"), _key("turn")).cast("binary")) % 20
    rows = conversations.select(
        _key("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _key("role").alias("role"), _key("text").alias("text"), chance.alias("_c"))
    return rows.filter("_c <> 0").select(
        "conv", "turn", F.when(F.col("_c") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_twice")).drop("_twice")


def _letter() -> Column:
    """The letter of a row, apart from repeats."""
    kind = F.when(F.substring("role", 1, 1).isin(*"sua"), F.substring("role", 1, 1)).otherwise("o")
    blank = F.translate(kind, INITIALS, GONE)
    body = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    return F.when(body == "", blank).when(F.substring(body, -1, 1).isin(*".!?"), kind).otherwise(F.upper(kind))


_ORDER = ("turn", "role", "h", "h2")


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text"), "letter": _letter()})


def chunked(rows: DataFrame) -> DataFrame:
    """conv, chunk, last, letters, firsts (places of rows that are the first of their kind); rows: conv, turn, role, text."""
    slim = _shaped(rows).select("conv", *_ORDER, "letter").withColumn("n", F.monotonically_increasing_id())
    numbered = number_rows(slim, ["conv"], "turn", "pos", ("role", "h", "h2", "n")).select(
        "conv", "role", "h", "h2", "letter", (F.col("pos") - 1).alias("pos"))
    numbered = materialise(numbered, "turns")
    place = [F.expr(f"pos div {CHUNK}").alias("chunk"), F.expr(f"cast(pos % {CHUNK} as int)").alias("at")]
    letters = numbered.select("conv", *place, "letter").groupBy("conv", "chunk").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("at", "letter")))["letter"], "").alias("letters"))
    # Repeats are found as all rows but the first of their kind: the grouping is combined before the shuffle.
    first = numbered.filter(~F.col("letter").isin(*GONE)).groupBy("conv", "role", "h", "h2").agg(F.min("pos").alias("pos"))
    firsts = first.select("conv", *place).groupBy("conv", "chunk").agg(F.collect_list("at").alias("firsts"))
    last = letters.groupBy("conv").agg(F.max("chunk").alias("_last"))
    found = letters.join(firsts, ["conv", "chunk"], "left").join(last, "conv")
    return found.select("conv", "chunk", (F.col("chunk") == F.col("_last")).alias("last"), "letters", "firsts")


def _table(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def _rows(found: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.values())], names=list(schema))


_VECTOR = pa.list_(pa.int32())
_CHUNK = {"conv": pa.string(), "chunk": pa.int64(), "last": pa.bool_(), "letters": pa.string(), "blank": pa.int64(), "duplicate": pa.int64(),
          "truncated": pa.int64(), "illegal": pa.int64(), "ends": pa.string(), "used": _VECTOR, "found": _VECTOR}
_CHUNK_SQL = ("conv string, chunk long, last boolean, letters string, blank long, duplicate long, truncated long, illegal long, ends string, "
              "used array<int>, found array<int>")
_LEGAL = {"su", "ua", "au"}


def _initial(letter: str) -> str:
    return INITIALS[GONE.index(letter)] if letter in GONE else letter.lower()


def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults and costs of each chunk, the latter from the true vector for a last chunk and from a guess for the others."""
    costs = Costs()
    for b in batches:
        out = []
        for conv, chunk, last, letters, firsts in _table([b], "conv", "chunk", "last", "letters", "firsts"):
            initials = "".join(map(_initial, letters))
            keep = set(firsts or ())
            marked = "".join(x if x in GONE or k in keep else GONE[INITIALS.index(x.lower())] for k, x in enumerate(letters))
            used = costs.final if last else costs.guess
            v, low = costs.run(marked, used)
            out.append((
                conv, chunk, last, marked, sum(x in GONE for x in letters), sum(x in GONE for x in marked) - sum(x in GONE for x in letters),
                sum(x.isupper() for x in marked), sum(initials[k:k + 2] not in _LEGAL for k in range(len(initials) - 1)),
                initials[0] + initials[-1], costs.vectors[used], [x + low for x in costs.vectors[v]]))
        yield _rows(out, _CHUNK)


_FIXED = {"conv": pa.string(), "chunk": pa.int64(), "last": pa.bool_(), "letters": pa.string(), "used": _VECTOR, "found": _VECTOR}
_FIXED_SQL = "conv string, chunk long, last boolean, letters string, used array<int>, found array<int>"


def fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a group from its last to its first: each runs again from the vector behind it where that is not the one it used.

    Sorted by (conv, group, chunk descending). `border`, of a group's last chunk, is the vector found by the next group's first chunk."""
    costs, group, behind = Costs(), None, None
    for b in batches:
        out = []
        for conv, g, chunk, last, letters, used, found, border in _table([b], "conv", "grp", "chunk", "last", "letters", "used", "found", "border"):
            if (conv, g) != group:
                group, behind = (conv, g), border
            if not last and behind is not None:
                old, new = costs.number(used)[0], costs.number(behind)[0]
                if old != new:
                    v, cost = costs.rerun(letters, old, new)
                    used = costs.vectors[new]
                    found = [x + cost for x in (found if v is None else costs.vectors[v])]
            behind = found
            out.append((conv, chunk, last, letters, used, found))
        yield _rows(out, _FIXED)


def settled(chunks: DataFrame) -> DataFrame:
    """Chunks whose used vectors are those that their successors found, but for a constant: conv, chunk, last, letters, used, found."""
    chunks, width = chunks.select(*_FIXED), 1
    least = lambda c: F.transform(c, lambda x: x - F.array_min(c))
    while True:
        behind = chunks.select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("found").alias("border"))
        joined = materialise(chunks.join(behind, ["conv", "chunk"], "left"), "borders")
        open_ = joined.filter(F.col("border").isNotNull() & (least(F.col("border")) != least(F.col("used"))))
        if open_.isEmpty():
            return joined.drop("border")
        width *= FAN
        grouped = joined.withColumn("grp", F.expr(f"chunk div {width}"))
        busy = open_.select("conv", F.expr(f"chunk div {width}").alias("grp")).distinct()
        rest = grouped.join(busy, ["conv", "grp"], "left_anti").select(*_FIXED)
        again = grouped.join(busy, ["conv", "grp"], "left_semi").repartition("conv", "grp").sortWithinPartitions(
            "conv", "grp", F.desc("chunk")).mapInArrow(fix_up, _FIXED_SQL)
        chunks = rest.union(again)


_TRACED = {"conv": pa.string(), "chunk": pa.int64(), "last": pa.bool_(), "audits": pa.list_(pa.string()), "exits": _VECTOR, "found": _VECTOR}
_TRACED_SQL = "conv string, chunk long, last boolean, audits array<string>, exits array<int>, found array<int>"


def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of each chunk and the states it ends in, for every state it may begin in."""
    costs = Costs()
    for b in batches:
        out = []
        for conv, chunk, last, letters, used, found in _table([b], *_FIXED):
            low = min(used)
            behind = costs.number([x - low for x in used])[0]
            each = [costs.trace(letters, behind, state) for state in (range(4) if chunk else (START,))]
            out.append((conv, chunk, last, [audit + (ending(state) if last else "") for audit, state in each], [state for _, state in each], found))
        yield _rows(out, _TRACED)


_PART = {"conv": pa.string(), "chunk": pa.int64(), "audit": pa.string(), "cost": pa.int64(), "illegal": pa.int64()}
_PART_SQL = "conv string, chunk long, audit string, cost long, illegal long"


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each chunk from the state that the chunk before it ends in; sorted by (conv, chunk). `illegal` counts the
    pair of rows at the chunk's begin."""
    state, before = START, None
    for b in batches:
        out = []
        for conv, chunk, audits, exits, found, ends in _table([b], "conv", "chunk", "audits", "exits", "found", "ends"):
            at = state if chunk else 0
            out.append((conv, chunk, audits[at], found[START] if chunk == 0 else min(found), int(chunk > 0 and before + ends[0] not in _LEGAL)))
            state, before = exits[at], ends[1]
        yield _rows(out, _PART)


_NAMES = {S: "system", U: "user", A: "assistant"}
_REPAIRED = {"conv": pa.string(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(),
             "audit": pa.string(), "repaired_sha256": pa.string()}
_REPAIRED_SQL = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NUMBERS = ("blank", "duplicate", "truncated", "illegal", "cost")


class _Repair:
    """The edits of one conversation, applied to its rows as they stream by."""

    def __init__(self, conv: str):
        self.conv, self.sums, self.parts, self.state, self.sha, self.begun = conv, [0] * len(_NUMBERS), [], START, hashlib.sha256(), False
        self.edits = None

    def part(self, audit: str, numbers) -> None:
        self.parts.append(audit)
        self.sums = [a + b for a, b in zip(self.sums, numbers)]

    def emit(self, role: str, text: str, state: int) -> None:
        self.sha.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun, self.state = True, state

    def inserted(self) -> str | None:
        """Emits inserted turns; the next edit of a row."""
        for edit in self.edits:
            if edit != "I":
                return edit
            self.emit(_NAMES[_NEXT[self.state]], "", _NEXT[self.state])
        return None

    def row(self, role: str, text: str) -> None:
        if self.edits is None:
            self.edits = (x for part in self.parts for x in part)
        edit = self.inserted()
        if edit == "K":
            self.emit(role, text, S if role[:1] == "s" else _NEXT[self.state])
        elif edit == "R":
            self.emit(_NAMES[_NEXT[self.state]], text, _NEXT[self.state])

    def done(self) -> tuple:
        if self.edits is not None:
            self.inserted()
        return self.conv, *self.sums, "".join(self.parts), self.sha.hexdigest()


def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums, audit and digest of each conversation; its parts of the audit come before its rows."""
    one = None
    for batch in batches:
        for b in pieces([batch], "text"):
            out = []
            for conv, what, audit, role, text, *numbers in _table([b], "conv", "what", "audit", "role", "text", *_NUMBERS):
                if one is None or conv != one.conv:
                    if one is not None:
                        out.append(one.done())
                    one = _Repair(conv)
                if what == 0:
                    one.part(audit, numbers)
                else:
                    one.row(role, text)
            yield _rows(out, _REPAIRED)
    if one is not None:
        yield _rows([one.done()], _REPAIRED)


def repair_rows(rows: DataFrame) -> DataFrame:
    """conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows (conv, turn, role, text)."""
    chunks = materialise(chunked(rows).mapInArrow(speculate, _CHUNK_SQL), "chunks")
    true = settled(chunks)
    traced = true.mapInArrow(trace, _TRACED_SQL).join(chunks.select("conv", "chunk", "ends"), ["conv", "chunk"])
    parts = traced.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(stitch, _PART_SQL)
    faults = chunks.select("conv", "chunk", "blank", "duplicate", "truncated", F.col("illegal").alias("inner"))
    parts = parts.join(faults, ["conv", "chunk"]).withColumn("illegal", F.col("illegal") + F.col("inner"))
    none = F.lit(None)
    lead = parts.select(
        "conv", F.lit(0).alias("what"), "chunk", none.cast("long").alias("turn"), none.cast("long").alias("h"), none.cast("long").alias("h2"),
        F.lit("").alias("role"), F.lit("").alias("text"), "audit", *_NUMBERS)
    body = _shaped(rows).select(
        "conv", F.lit(1).alias("what"), F.lit(0).cast("long").alias("chunk"), "turn", "h", "h2", "role", "text", F.lit("").alias("audit"),
        *[F.lit(0).cast("long").alias(c) for c in _NUMBERS])
    both = lead.union(body).repartition("conv").sortWithinPartitions("conv", "what", "chunk", *_ORDER)
    return both.select("conv", "what", "audit", "role", "text", *_NUMBERS).mapInArrow(repair, _REPAIRED_SQL)


def turn_gaps(rows: DataFrame) -> DataFrame:
    """conv, gaps: turns missing between the first and the last one."""
    turns = rows.filter("turn IS NOT NULL").groupBy("conv", "turn").count()
    return turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """One row per original conversation with the contract's columns."""
    rows = damage(conversations)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", _key("conv_id"))
    found = every.join(repair_rows(rows), "conv", "left").join(turn_gaps(rows), "conv", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

"""A Merkle manifest of a dataset, with a proof for every record.

A leaf is the digest of a record's fields. The leaves of a group (a language) ascend by id, and eight consecutive nodes hash to
their parent until one is left, the group's subroot; the subroots, in order of their groups, hash to the root in the same way.

Nodes are numbered over sampled ranges, never in one task, and cut into aligned blocks of BLOCK = 8^4. A block keeps each
of its levels as one string of hex digests: 512 characters of it are a run, whose hash is a parent on the next level, and
what stands left and right of a node in its run are the siblings that its proof needs. The tops of the blocks are the nodes
of the next, 4,096 times smaller tree, which is built and proven by the same code; its paths are joined to the blocks, so a
record's proof never leaves the row of its block.

Only digests are shuffled and stored. Nulls are fields of their own ("-"); a null group comes first, a null id first in its
group. Rows that repeat an id are leaves of their own, ordered by leaf; equal rows are spread over ranges like any others.
Empty texts are fields of no bytes, long texts are hashed whole. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.plans.numbering import number_rows
from packetloom.session import materialise

FAN, DEPTH, DIGEST = 8, 4, 64
BLOCK, RUN = FAN ** DEPTH, FAN * DIGEST
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WHOLE = ("doc_id", "n_chars")
_STEP = "array<struct<before: binary, after: binary>>"


def digest(data: Column) -> Column:
    return F.sha2(data, 256)


def record_digest(fields: list[Column]) -> Column:
    """Digest of fields, each with its length in bytes before it, "-" for a null one."""
    texts = [c.cast("string") for c in fields]
    return digest(F.concat(*[
        F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]))


def leaves(docs: DataFrame, changed: Callable[[Column], Column], when: Column, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """g, doc_id, leaf and, of the rows that `when` chooses, `found`: the leaf of the record as it is met later, when its text
    has become `changed(text)`. g keeps null groups apart and first."""
    fields = {c: F.col(c).cast("long" if c in WHOLE else "string") for c in FIELDS}
    later = fields | {"text": changed(fields["text"])}
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), fields[key].alias("doc_id"),
        record_digest(list(fields.values())).alias("leaf"),
        F.when(when, record_digest(list(later.values()))).alias("found"))


def _cut(level: Column, begin: Column, size) -> Column:
    return F.substring(level, begin + 1, size if isinstance(size, Column) else F.lit(size))


def blocks(nodes: DataFrame) -> DataFrame:
    """g, block, m (payload of the nodes in order), s0 .. s3 (levels of the block), steps (levels hashed), top.

    nodes: g, pos, h, payload. Only the first block of a group can be its only one; it is hashed until one node is left, all
    others DEPTH times, a lone last node too."""
    out = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "h", "payload"))).alias("m"))
    lone = (F.col("block") == 0) & (F.size("m") < BLOCK)
    out = out.select("g", "block", F.col("m.payload").alias("m"), lone.alias("lone"), F.array_join("m.h", "").cast("binary").alias("s0"))
    for k in range(DEPTH):
        level = F.col(f"s{k}")
        parents = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length(level) / RUN).cast("int") - 1),
                              lambda r: digest(_cut(level, r * RUN, RUN)))
        out = out.withColumn(f"s{k + 1}", F.when(~F.col("lone") | (F.octet_length(level) > DIGEST), F.array_join(parents, "").cast("binary")))
    levels = [F.col(f"s{k}") for k in range(DEPTH + 1)]
    steps = sum((c.isNotNull().cast("int") for c in levels[1:]), F.lit(0))
    return out.select("g", "block", "m", *levels[:DEPTH], steps.alias("steps"), F.coalesce(*levels[::-1]).cast("string").alias("top"))


def proofs(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every node with its path: g, payload, h, root, path (siblings left and right, level by level up to the root).

    nodes: g, pos (gapless from 0 in g), h, payload. `finish` may carry the paths of the blocks (g, block, root, path) on."""
    held = materialise(blocks(nodes), "merkle")
    tops = held.select("g", "block", "top")
    if held.filter("block > 0").isEmpty():
        above = tops.select("g", "block", F.col("top").alias("root"), F.array().cast(_STEP).alias("path"))
    else:
        above = proofs(tops.select("g", F.col("block").alias("pos"), F.col("top").alias("h"), F.col("block").alias("payload")))
        above = above.select("g", F.col("payload").alias("block"), "root", "path")
    if finish:
        above = finish(materialise(above, "merkle-tops"))
    carried = [c for c in above.columns if c not in ("g", "block", "path")]

    def run(r: Column) -> Column:
        """The nodes of run r of the lowest level, with the run of each level that they hang below."""
        own = [_cut(F.col(f"s{k}"), F.floor(r / FAN ** k).cast("int") * RUN, RUN).alias(f"run{k}") for k in range(DEPTH)]
        return F.struct(F.slice("m", r * FAN + 1, FAN).alias("nodes"), r.alias("r"), *own)

    runs = held.join(above, ["g", "block"]).select(
        "g", *carried, "path", "steps",
        F.inline(F.transform(F.sequence(F.lit(0), F.ceil(F.size("m") / FAN).cast("int") - 1), run)))

    def node(x: Column, j: Column) -> Column:
        steps = []
        for k in range(DEPTH):
            place = j if k == 0 else F.pmod(F.floor(F.col("r") / FAN ** (k - 1)).cast("int"), F.lit(FAN))
            steps.append(F.struct(_cut(F.col(f"run{k}"), F.lit(0), place * DIGEST).alias("before"),
                                  _cut(F.col(f"run{k}"), (place + 1) * DIGEST, RUN).alias("after")))
        path = F.concat(F.slice(F.array(*steps), F.lit(1), F.col("steps")), F.col("path"))
        return F.struct(x.alias("payload"), _cut(F.col("run0"), j * DIGEST, DIGEST).cast("string").alias("h"), path.alias("path"))

    return runs.select("g", *carried, F.inline(F.transform("nodes", node)).alias("payload", "h", "path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["before"], h.cast("binary"), s["after"])))


def siblings_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"]).cast("string")), ""))


def manifest(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for the rows of `leaves`.

    The folded root is recomputed from the leaf as met later, where there is one, and the siblings of the manifest."""
    stored = materialise(rows.withColumn("n", F.monotonically_increasing_id()), "leaves")
    numbered = number_rows(stored, ["g"], "doc_id", "pos", ("leaf", "n"))
    nodes = numbered.select("g", (F.col("pos") - 1).alias("pos"), F.col("leaf").alias("h"), F.struct("doc_id", "found").alias("payload"))

    def to_root(above: DataFrame) -> DataFrame:
        groups = above.filter("block = 0").select("g", F.col("root").alias("h"), F.lit("").alias("all"))
        groups = number_rows(groups, ["all"], "g", "pos").select(
            F.col("all").alias("g"), (F.col("pos") - 1).alias("pos"), "h", F.col("g").alias("payload"))
        top = proofs(groups).select(F.col("payload").alias("g"), F.col("root").alias("all_root"), F.col("path").alias("rest"))
        return above.join(top, "g").select("g", "block", F.col("root").alias("subroot"), F.col("all_root").alias("root"), F.concat("path", "rest").alias("path"))

    found = proofs(nodes, to_root)
    folded = fold(F.coalesce("payload.found", "h"), F.col("path"))
    return found.select(F.col("payload.doc_id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root",
                        siblings_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def checked_by_id(docs: DataFrame) -> DataFrame:
    """The manifest checked against records of which those with 3 | crc32(doc_id) have lost their capitals."""
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    return manifest(leaves(docs, lower_ascii, F.coalesce(chosen, F.lit(False))))

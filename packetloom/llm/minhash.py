"""Near-duplicate documents by b-bit MinHash over word shingles.

1. Each text's distinct shingles give K minima. Their bands are the candidate keys; of each minimum only the low BITS bits
   stay, packed into 64-bit words. Texts with equal sets (copies) become one node.
2. Nodes that share a band key are compared by their packed signatures: exclusive or, a bit count of the differing groups,
   and the similarity corrected for chance agreement of the low bits. Pairs above a cut far below the wanted similarity
   join a family. A bucket with more than LARGE nodes joins one family as it is: comparing all its pairs would grow with
   the square, and the next step decides anyway.
3. Links are confirmed on full sets inside the families, in blocks of bounded size: first each block with some anchors of
   its family, then, in families of several blocks, whatever is not yet in the family's main class against all else. Blocks
   compare all their pairs by a matrix product and emit a spanning star of each class, never pairs.
4. Components of the stars give every node, and so every document, its class.

ROWS and BANDS miss a pair at the wanted similarity with probability 2e-7. Shingles are compared by 64-bit hashes. Texts
without words have an empty set and link with nothing, very long ones are read whole. A row without id links with nothing, has
no component and is kept. Nodes are sets, not ids: an id that repeats with other texts has several nodes, each is searched, and
they have one component, as they are one document to the links. Only the id and the text are read; keep_one() keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packetloom.llm import words as X
from packetloom.llm.shared import classes
from packetloom.session import materialise, new_path, released

ROWS, BANDS, BITS = 7, 40, 4
LARGE = 256
BLOCK_NODES, BLOCK_SHINGLES, ANCHORS = 64, 100_000, 8

WHO, NAMED = ["doc_id", "t1", "t2"], ["n_shingles", "print1", "print2"]  # a row's text, and its set

_K = ROWS * BANDS
_FACTORS = X.mix(np.arange(1, _K + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_PER_WORD = 64 // BITS
_WORDS = -(-_K // _PER_WORD)
_LOW = np.uint64(sum(1 << BITS * k for k in range(_PER_WORD)))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the lower-cased texts and the n + 1 places at which the texts' shingles begin. A text with
    fewer words than `width` has its whole sequence as one shingle; one without words has none."""
    h, bounds = X.words(data, offsets, X.LOWER)
    n = np.diff(bounds)
    g, inside = X.grams(h, bounds, width)
    short = np.flatnonzero((n > 0) & (n < width))
    if not len(short):
        counts = np.maximum(n - width + 1, 0)
        return g[inside], np.concatenate([[0], np.cumsum(counts)])
    whole = X.mix(np.array([np.sum(h[a:b] * X.GRAM[:b - a], dtype=np.uint64) for a, b in zip(bounds[short], bounds[short + 1])])
                  + n[short].astype(np.uint64))
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(int))
    ends = np.cumsum(counts)
    out = np.empty(ends[-1], np.uint64)
    single = np.zeros(len(out), bool)
    single[ends[short] - 1] = True
    out[single], out[~single] = whole, g[inside]
    return out, np.concatenate([[0], ends])


def distinct(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which shingles are the first of their kind in their text."""
    salt = X.mix(X.owners(bounds).astype(np.uint64) + np.uint64(1))
    return ~X.repeated(X.mix(g ^ salt))[1]


def signatures(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts, BANDS) and packed low bits (texts, _WORDS) of the minima of texts with shingles."""
    n = len(bounds) - 1
    minima = np.empty((_K, n), np.uint64)
    for k, factor in enumerate(_FACTORS):
        minima[k] = np.minimum.reduceat(g * factor, bounds[:-1])
    minima = X.mix(minima)  # a product's low bits say little, those of a mixed one are even
    keys = np.zeros((BANDS, n), np.uint64)
    for k in range(ROWS):
        keys = X.mix(keys * np.uint64(31) + minima[k::ROWS])
    keys = X.mix(keys + np.arange(BANDS, dtype=np.uint64)[:, None])
    low = np.zeros((_WORDS, n), np.uint64)
    for k in range(_K):
        low[k // _PER_WORD] |= (minima[k] & np.uint64((1 << BITS) - 1)) << np.uint64(BITS * (k % _PER_WORD))
    return keys.T, low.T


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures along the last axis, corrected for low bits that agree by chance."""
    x = a ^ b
    for k in range(1, BITS):
        x = x | ((a ^ b) >> np.uint64(k))
    differ = np.bitwise_count(x & _LOW).sum(-1, dtype=np.int64)
    chance = 2.0 ** -BITS
    return ((_K - differ) / _K - chance) / (1 - chance)


def _longs(values: np.ndarray) -> pa.Array:
    """A matrix of 64-bit words as rows of lists."""
    flat = np.ascontiguousarray(values).view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(flat))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, t1, t2, n_shingles, print1, print2 (together naming the set), keys, low of every document."""
    def run(batches):
        for part in X.pieces(batches, "t"):
            g, bounds = shingles(*X.text_bytes(part.column("t")), width)
            some, first = np.diff(bounds) > 0, distinct(g, bounds)
            total = np.concatenate([[0], np.cumsum(first)])
            n = total[bounds[1:]] - total[bounds[:-1]]
            prints = []
            for values in (g, X.mix(g ^ np.uint64(0xABCDEF))):
                up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(first, values, np.uint64(0)), dtype=np.uint64)])
                prints.append((up[bounds[1:]] - up[bounds[:-1]]).view(np.int64))
            keys, low = np.zeros((len(some), BANDS), np.uint64), np.zeros((len(some), _WORDS), np.uint64)
            if some.any():
                keys[some], low[some] = signatures(g, np.append(bounds[:-1][some], len(g)))
            yield pa.RecordBatch.from_arrays(
                [*map(part.column, WHO), pa.array(n.astype(np.int64)), *map(pa.array, prints), _longs(keys), _longs(low)],
                names=[*WHO, *NAMED, "keys", "low"])

    fields = "doc_id long, t1 long, t2 long, n_shingles long, print1 long, print2 long, keys array<long>, low array<long>"
    return named_texts(docs).mapInArrow(run, fields)


def named_texts(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (together naming the text) and t, the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("t"))


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Sorted batches as tables that never part equal values of `column`."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(v, v[-1], "left"))
        if last or (held and held[-1].column(column)[-1].as_py() != v[0]):
            cut = last if last else 0
            if cut:
                held.append(b.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _stars(ids: np.ndarray, linked: np.ndarray) -> tuple[list[int], list[int]]:
    """(member, least member) of each class of a symmetric matrix of links."""
    label = ids.astype(np.int64).copy()
    top = np.iinfo(np.int64).max
    while True:
        best = np.minimum(label, np.where(linked, label, top).min(1))
        if (best == label).all():
            break
        label = best
    other = label != ids
    return ids[other].tolist(), label[other].tolist()


def possible(candidates: DataFrame, cut: float) -> DataFrame:
    """(a, b): stars of the nodes of a bucket whose estimate reaches the cut. candidates: key, id, low; sorted by key."""
    def run(batches):
        for t in _runs(batches, "key"):
            key, ids = (t.column(c).to_numpy() for c in ("key", "id"))
            low = t.column("low").combine_chunks()
            low = (low.chunk(0) if isinstance(low, pa.ChunkedArray) else low).flatten().to_numpy().view(np.uint64).reshape(-1, _WORDS)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            two = starts[sizes == 2]
            two = two[estimate(low[two], low[two + 1]) >= cut]
            a, b = [np.maximum(ids[two], ids[two + 1])], [np.minimum(ids[two], ids[two + 1])]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = low[s:s + n]
                x, y = _stars(ids[s:s + n], np.stack([estimate(row, own) >= cut for row in own]))
                a.append(np.array(x, np.int64))
                b.append(np.array(y, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return candidates.mapInArrow(run, "a long, b long")


def families(nodes: DataFrame, similarity: float) -> DataFrame:
    """(id, family, n_shingles) of the nodes that may link with another one. nodes: id, n_shingles, keys, low."""
    cut = similarity - 5 * (similarity * (1 - similarity) / _K) ** 0.5
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("center")).filter("n > 1"), "buckets")
    members = materialise(keyed.join(shared, "key"), "members")
    small = members.filter(F.col("n") <= LARGE).join(nodes.select("id", "low"), "id").select("key", "id", "low")
    small = possible(small.repartition("key").sortWithinPartitions("key"), cut)
    large = members.filter((F.col("n") > LARGE) & (F.col("id") != F.col("center"))).select(F.col("id").alias("a"), F.col("center").alias("b"))
    edges = materialise(small.union(large).distinct(), "possible")
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    return classes(ends, edges).withColumnRenamed("root", "family").join(nodes.select("id", "n_shingles"), "id")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, hashes): the sorted distinct shingles, as bytes, of the nodes (id, doc_id, t1, t2, twins), from one row each."""
    def run(batches):
        for part in X.pieces(batches, "t"):
            g, bounds = shingles(*X.text_bytes(part.column("t")), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([np.unique(g[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                names=["id", "hashes"])

    def held(wanted: DataFrame) -> DataFrame:
        return named_texts(docs).join(wanted.select("id", *WHO).hint("merge"), WHO).select("id", "t")

    fields = "id long, hashes binary"
    repeated = nodes.filter("twins > 1")  # rows that repeat both id and text
    if repeated.isEmpty():
        return held(nodes).mapInArrow(run, fields)
    once = held(repeated).dropDuplicates(["id"])
    return held(nodes.filter("twins = 1")).mapInArrow(run, fields).union(once.mapInArrow(run, fields))


def links_in_block(ids: np.ndarray, sets: list[np.ndarray], percent: int, apart: np.ndarray | None = None):
    """Stars of the classes of a block by exact similarity: 100 * common >= percent * union.

    apart: classes known before; pairs of one class are not linked again."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, owner = np.concatenate(sets)[order], owner[order]
    fresh = np.append(True, values[1:] != values[:-1])
    name = np.cumsum(fresh) - 1
    often = np.bincount(name)[name] > 1
    name, owner = np.unique(name[often], return_inverse=True)[1], owner[often]
    common, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for k in range(0, int(name.max()) + 1 if len(name) else 0, width):
        a, b = np.searchsorted(name, [k, k + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], name[a:b] - k] = 1
        common += held @ held.T
    common = np.rint(common).astype(np.int64)
    linked = (100 * common >= percent * (sizes[:, None] + sizes[None] - common)) & (sizes[:, None] > 0)
    np.fill_diagonal(linked, False)
    if apart is not None:
        linked &= apart[:, None] != apart[None]
    return _stars(ids, linked)


def _confirm(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Stars of confirmed links of each group of (id, root, hashes)."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        a, b = links_in_block(ids, sets, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "a long, b long")


def confirmed(docs: DataFrame, nodes: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Stars (a, b) of the links between the members of each family."""
    sets = materialise(shingle_sets(docs, materialise(nodes.join(members.select("id"), "id"), "wanted"), width), "sets")
    size = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).select(
        "family", F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    size = materialise(size, "sizes")
    members = materialise(members.join(size, "family").withColumn("h", F.xxhash64("id")), "members")
    single = members.filter("blocks = 1").select("id", "family", F.lit(0).alias("block"))
    several = members.filter("blocks > 1")
    dealt = several.select("id", "family", F.expr("pmod(h, blocks)").cast("int").alias("block"))
    # Anchors: the nodes of least hash of each family, in every block of it.
    least = several.groupBy("family", "blocks").agg(F.expr(f"slice(array_sort(collect_list(if(pmod(h, blocks * 64) < {ANCHORS}, struct(h, id), null))), 1, {ANCHORS})").alias("x"))
    anchors = least.select("family", F.explode("x.id").alias("id"), "blocks").select(
        "id", "family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = single.union(dealt).union(anchors).distinct()
    first = materialise(_confirm(rows.join(sets, "id"), ["family", "block"], percent), "stars")
    if several.isEmpty():
        return first
    # What is not in the main class of a family meets every other node of the family.
    rooted = materialise(classes(several, first.join(several.select(F.col("id").alias("a")), "a", "left_semi")).join(
        several.select("id", "family", "blocks", "h"), "id"), "rooted")
    per_root = rooted.groupBy("family", "root").count()
    main = per_root.groupBy("family").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("held"))
    main = materialise(main.filter("held < n").select("family", "main", (F.col("n") - F.col("held")).alias("rest")), "main")
    left = rooted.join(main, "family").withColumn("mine", F.col("root") == F.col("main")).withColumn(
        "parts", F.least("blocks", F.ceil(F.col("rest") / BLOCK_NODES)).cast("int"))
    own = F.when(F.col("mine"), F.expr("pmod(h, blocks)")).otherwise(F.expr("pmod(h, parts)")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = left.withColumn("own", own).select("id", "family", F.explode(
        F.when(F.col("mine"), F.transform(every, lambda p: F.struct(p.alias("p"), (F.col("own")).alias("q"), F.lit(True).alias("core"))))
        .otherwise(F.concat(
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(F.col("own").alias("p"), q.alias("q"), F.lit(True).alias("core"))),
            F.transform(every, lambda p: F.struct(F.least("own", p).alias("p"), F.greatest("own", p).alias("q"), F.lit(False).alias("core")))))).alias("b"))
    pairs = pairs.select("id", "family", "b.p", "b.q", "b.core").distinct()
    second = _confirm(pairs.join(sets, "id"), ["family", "p", "q", "core"], percent)
    return materialise(first.union(second), "stars")


def linked_sets(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sketched rows; texts (WHO, NAMED, twins: rows that hold them); nodes (id, NAMED and the least of its WHO); stars (a, b)."""
    rows = materialise(sketch(docs, width), "sketches")
    full = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    texts = materialise(full.groupBy(*WHO, *NAMED).agg(F.count("*").alias("twins")), "texts")
    nodes = texts.groupBy(*NAMED).agg(F.min(F.struct(*WHO, "twins")).alias("w")).select(
        F.monotonically_increasing_id().alias("id"), *NAMED, "w.*")
    nodes = materialise(nodes, "nodes")
    detailed = nodes.join(full.select(*WHO, *NAMED, "keys", "low"), [*WHO, *NAMED]).dropDuplicates(["id"])
    detailed = materialise(detailed.select("id", "n_shingles", "keys", "low"), "nodes")
    members = materialise(families(detailed, percent / 100), "families")
    return rows, texts, nodes, confirmed(docs, nodes, members, width, percent)


def _ties(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): the nodes of an id that repeats with other sets, each with the least of them."""
    several = texts.groupBy("doc_id").agg(F.min(F.struct(*NAMED)).alias("x"), F.max(F.struct(*NAMED)).alias("y")).filter("x <> y").select("doc_id")
    mine = materialise(texts.join(several, "doc_id").join(nodes.select(*NAMED, "id"), NAMED).select("doc_id", "id").distinct(), "ties")
    least = mine.groupBy("doc_id").agg(F.min("id").alias("b"))
    return mine.join(least, "doc_id").filter("id <> b").select(F.col("id").alias("a"), "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable over links), kept (doc_id = component_id) of every row.

    Documents are linked if their sets of `width`-word shingles have 100 * intersection >= percent * union."""
    rows, texts, nodes, links = linked_sets(docs, width, percent)
    rooted = nodes.join(classes(nodes, links.union(_ties(texts, nodes))), "id")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = materialise(rooted.join(least, "root").select(*NAMED, "component_id"), "rooted")
    joined = rows.select("doc_id", *NAMED).join(found, NAMED, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of linked texts, that of the least id, with all its columns. Rows without id or without words stay, and so
    does a text whose id repeats with other texts: only copies go."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "classes")
    with released(spark):
        _, texts, nodes, links = linked_sets(docs, width, percent)
        rooted = nodes.join(classes(nodes, links), "id")
        best = rooted.groupBy("root").agg(F.min(F.struct(*WHO)).alias("best"))
        judged = texts.join(materialise(rooted.join(best, "root").select(*NAMED, "best"), "rooted"), NAMED)
        judged.select(*WHO, "twins", (F.struct(*WHO) != F.col("best")).alias("goes")).filter("goes OR twins > 1").write.parquet(path)
    found = spark.read.parquet(path)
    text = F.col("text").cast("string")
    marked = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text)})
    place = {k: f"_{k}" if k != "doc_id" else "_id" for k in WHO}
    names = [F.col(k).alias(v) for k, v in place.items()]
    # The table grows with the texts: the same plan at every size.
    left = marked.join(found.filter("goes").select(*names).hint("merge"), list(place.values()), "left_anti")
    twins = found.filter("NOT goes").select(*names)
    if not twins.isEmpty():
        keys = list(place.values())
        single = left.join(twins, keys, "left_anti").select(*left.columns)
        left = single.union(left.join(twins, keys, "left_semi").select(*left.columns).dropDuplicates(keys))
    return left.select(*docs.columns)

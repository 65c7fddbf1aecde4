"""Near-duplicate vectors by lattice hashing.

Each of TABLES tables projects a unit vector on BLOCKS times eight random orthogonal directions, scales by 1 / WIDTH and
decodes each eight numbers to the nearest point of the E8 lattice. Besides that cell, the PROBES neighbouring lattice points
nearest to the vector count as its cells, on both sides of a comparison. Vectors that share a cell are candidates, and the
cosine decides. At a cosine of 0.95 a table misses a pair with probability 0.39, all nine with 2e-4; above 0.97, 2e-6.

Equal vectors become one node first, whatever their ids. Cells with many nodes are dealt to blocks, and blocks are compared by matrix products:
no pairs are emitted, only sums and a star of each class. A pair that shares several cells counts in the first of them.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths do
not link. A row without id links with nothing and is kept. Rows that repeat an id and vector are copies of it; an id that repeats
with other vectors has several nodes with links of their own and one component. Very long vectors are read whole. An empty table has an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packetloom.llm import words as X
from packetloom.llm.minhash import _runs
from packetloom.llm.shared import classes
from packetloom.session import materialise

TABLES, BLOCKS, PROBES, WIDTH = 9, 2, 1, 0.25
GROUP = 128


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    found.append(v)
    halves = [np.array([0.5 - (m >> k & 1) for k in range(8)]) for m in range(256)]
    return np.array(found + [v for v in halves if (v < 0).sum() % 2 == 0])


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest whole vectors with an even sum."""
    f = np.rint(x)
    off, odd = x - f, f.sum(1).astype(np.int64) % 2 != 0
    at, rows = np.abs(off).argmax(1), np.arange(len(x))
    step = np.where(off[rows, at] >= 0, 1.0, -1.0)
    f[rows[odd], at[odd]] += step[odd]
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points: E8 is D8 and D8 moved by one half in each direction."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


_spaces: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _space(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of all tables and their random shifts, the same on every machine. Vectors with fewer components than a
    table has directions use directions that are not orthogonal."""
    if size not in _spaces:
        rng, wide = np.random.default_rng(size), 8 * BLOCKS
        parts = []
        for _ in range(TABLES):
            m = rng.normal(size=(max(size, wide), wide))
            q = np.linalg.qr(m)[0] if size >= wide else m[:size] / np.linalg.norm(m[:size], axis=1, keepdims=True)
            parts.append(q)
        # Rounded, so that the last bits of different linear algebra libraries do not matter.
        _spaces[size] = np.round(np.concatenate(parts, 1), 6), np.round(rng.random(TABLES * wide), 6)
    return _spaces[size]


_WEIGHTS = X.mix(np.arange(1, 9, dtype=np.uint64))


def block_cells(unit: np.ndarray) -> np.ndarray:
    """Hashes (vectors, TABLES, BLOCKS, 1 + PROBES) of the lattice points of each table's blocks.

    The projection is added up one component after the other: the same vector gets the same cells in any batch."""
    directions, shifts = _space(unit.shape[1])
    y = np.zeros((len(unit), directions.shape[1]))
    for k in range(unit.shape[1]):
        y += unit[:, k:k + 1] * directions[k]
    y = (y / WIDTH + shifts).reshape(-1, 8)
    cell = nearest_e8(y)
    score = np.zeros((len(y), len(ROOTS)), np.float32)
    left = (y - cell).astype(np.float32)
    for k in range(8):
        score += left[:, k:k + 1] * ROOTS[:, k].astype(np.float32)
    points = [cell]
    for _ in range(PROBES):
        best = score.argmax(1)
        points.append(cell + ROOTS[best])
        score[np.arange(len(y)), best] = -np.inf
    twice = np.rint(2 * np.stack(points, 1)).astype(np.int64).astype(np.uint64)
    salt = np.arange(len(y), dtype=np.uint64) % np.uint64(TABLES * BLOCKS) + np.uint64(unit.shape[1] << 16)
    h = X.mix((twice * _WEIGHTS).sum(2, dtype=np.uint64) ^ X.mix(salt)[:, None])
    return h.reshape(len(unit), TABLES, BLOCKS, 1 + PROBES)


def cells(parts: np.ndarray) -> np.ndarray:
    """Every combination of a table's block cells: (vectors, TABLES, (1 + PROBES) ** BLOCKS)."""
    out = parts[:, :, 0]
    for b in range(1, parts.shape[2]):
        out = X.mix(out[..., None] * np.uint64(31) + parts[:, :, b][:, :, None]).reshape(*out.shape[:2], -1)
    return out


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one cell in which a pair counts: in its first common table, the least common point of each block."""
    top = np.uint64(2**64 - 1)
    least = []
    for k in range(a.shape[2]):
        x, y = a[:, :, k], b[:, :, k]
        low = np.full(x.shape[:2], top)
        for j in range(y.shape[2]):
            low = np.minimum(low, np.where(x == y[:, :, j:j + 1], x, top).min(2))
        least.append(low)
    shared = np.logical_and.reduce([low != top for low in least])
    table, rows = shared.argmax(1), np.arange(len(a))
    out = least[0][rows, table]
    for low in least[1:]:
        out = X.mix(out * np.uint64(31) + low[rows, table])
    return out


def _unit(column: pa.Array, wide: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of packed vectors, one entry for each length."""
    kind = np.dtype("<f8" if wide else "<f4")
    data, offsets = X.text_bytes(column)
    sizes = np.diff(offsets) // kind.itemsize
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = np.stack([data[offsets[r]:offsets[r + 1]].view(kind) for r in rows]).astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        out.append((rows, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


def packed(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, bool]:
    """vec_id and the vector's bytes `v`, null if it links with nothing; and whether the components are doubles."""
    wide = vectors.schema[vector].dataType.elementType.typeName() != "float"
    kind = np.dtype("<f8" if wide else "<f4")

    def pack(batches):
        for b in batches:
            rows = []
            for x in b.column("v"):
                values = x.values
                good = values is not None and len(values) and not values.null_count
                x = values.to_numpy().astype(kind) if good else None
                rows.append(x.tobytes() if good and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(rows, pa.binary())], names=["vec_id", "v"])

    chosen = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>" if wide else "array<float>").alias("v"))
    return chosen.mapInArrow(pack, "vec_id long, v binary"), wide


def least_linked(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least id that each row reaches over the links between the rows x and y."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    x, y, root = place[x], place[y], np.arange(len(ids))
    while len(x):
        a, b = root[x], root[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return ids[order][root][place]


def _compare(rows: DataFrame, wide: bool, least: float) -> DataFrame:
    """(id, links, low) from rows (g, cell, part, id, copies, v) sorted by group g: copies linked, and the least id that the group's links reach."""
    def run(batches):
        for t in _runs(batches, "g"):
            t = t.combine_chunks()
            g, cell, part, ids, copies = (t.column(c).to_numpy() for c in ("g", "cell", "part", "id", "copies"))
            v = t.column("v").combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            ends = np.append(starts[1:], len(g))
            links, low = np.zeros(len(g), np.int64), ids.copy()
            for at, unit in _unit(v, wide):
                place = np.full(len(g), -1)
                place[at] = np.arange(len(at))
                left, right = [], []
                two = starts[(ends - starts == 2)]
                two = two[(place[two] >= 0) & (place[two + 1] >= 0) & (ids[two] != ids[two + 1])]
                two = two[(part[two] != part[two + 1]) | (part[two] < 0)]
                close = (unit[place[two]] * unit[place[two + 1]]).sum(1) >= least
                left.append(two[close])
                right.append(two[close] + 1)
                for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                    own = np.arange(a, b)[place[a:b] >= 0]
                    if len(own) < 2:
                        continue
                    if part[a] < 0:  # one block with itself
                        i, j = np.nonzero(np.triu(unit[place[own]] @ unit[place[own]].T >= least, 1))
                        i, j = own[i], own[j]
                    else:
                        p, q = own[part[own] == 0], own[part[own] == 1]
                        i, j = np.nonzero(unit[place[p]] @ unit[place[q]].T >= least)
                        i, j = p[i], q[j]
                    left.append(i)
                    right.append(j)
                i, j = np.concatenate(left), np.concatenate(right)
                parts = block_cells(unit) if len(i) else None
                counted = np.zeros(len(i), bool)
                for k in range(0, len(i), 20_000):
                    x, y = i[k:k + 20_000], j[k:k + 20_000]
                    first = _first_shared(parts[place[x]], parts[place[y]]).view(np.int64) == cell[x]
                    counted[k:k + 20_000] = first
                    x, y = x[first], y[first]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                low = np.minimum(low, least_linked(ids, i[counted], j[counted]))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(low[some])], names=["id", "links", "low"])

    return rows.mapInArrow(run, "id long, links long, low long")


def near_vectors(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of `least` or more), component_id (the least id reachable), kept."""
    rows, wide = packed(vectors, key, vector)
    prints = [F.xxhash64("v").alias("print1"), F.xxhash64(F.lit(1), "v").alias("print2")]
    rows = materialise(rows.withColumns({"print1": prints[0], "print2": prints[1]}), "vectors")
    named = ["print1", "print2"]
    nodes = rows.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).groupBy(*named).agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")

    def spread(batches):
        for b in batches:
            for at, unit in _unit(b.column("v"), wide) if b.num_rows else []:
                every = cells(block_cells(unit)).reshape(len(unit), -1)
                ids = b.column("id").to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64).ravel()), pa.array(np.repeat(ids, every.shape[1]))], names=["cell", "id"])

    celled = materialise(nodes.select("id", "v").mapInArrow(spread, "cell long, id long").distinct(), "cells")
    shared = materialise(celled.groupBy("cell").count().filter("count > 1").select(
        "cell", F.ceil(F.col("count") / GROUP).cast("int").alias("blocks")), "shared")
    members = celled.join(shared, "cell").withColumn("own", F.expr("pmod(xxhash64(id), blocks)").cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "cell", "id",
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("part"))
    grouped = dealt.join(nodes.select("id", "copies", "v"), "id").select("g", "cell", "part", "id", "copies", "v")
    found = materialise(_compare(grouped.repartition("g").sortWithinPartitions("g"), wide, least), "found")
    # Nodes of an id that repeats with other vectors hang together.
    known = rows.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", *named)
    several = known.groupBy("vec_id").agg(F.min(F.struct(*named)).alias("x"), F.max(F.struct(*named)).alias("y")).filter("x <> y").select("vec_id")
    mine = materialise(known.join(several, "vec_id").join(nodes.select(*named, "id"), named).select("vec_id", "id").distinct(), "ties")
    ties = mine.join(mine.groupBy("vec_id").agg(F.min("id").alias("b")), "vec_id").filter("id <> b").select(F.col("id").alias("a"), "b")
    rooted = classes(nodes, found.select(F.col("id").alias("a"), F.col("low").alias("b")).union(ties))
    counted = nodes.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(rooted, "id")
    counted = materialise(counted.select(*named, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "root", "vec_id"), "counted")
    least = counted.groupBy("root").agg(F.min("vec_id").alias("least"))
    counted = counted.drop("vec_id").join(least, "root")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull() & F.col("vec_id").isNotNull(), F.col("print1")).alias("print1"), "print2").join(
        counted.select(*named, "links", "least"), named, "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

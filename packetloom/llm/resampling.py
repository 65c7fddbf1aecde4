"""Quality classifier by importance resampling.

Two bags of hashed n-grams (words, word pairs, word shapes and pairs of shapes) are modelled: those of the documents labelled good, and those of all
documents. A document's weight is the ratio of the two likelihoods; Gumbel noise, drawn from a hash of the id, turns
the k largest perturbed weights into a sample without replacement in proportion to the weights.

The counts cover all documents; only the set of labelled ids is bounded (`TRAIN_ROWS`). Null and empty texts have weight
1 (log 0). Rows with the same id and text draw the same noise; ties at the k-th place are all kept. Other columns are
not read. Without labelled documents of both kinds every weight is 1 and every document is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packetloom.llm import words as X
from packetloom.llm.shared import TRAIN_ROWS, labelled
from packetloom.session import materialise, released

BUCKETS = 1 << 16
SMOOTH = 1.0


def _shapes() -> np.ndarray:
    """Each byte's kind: letters by case, digits, other signs as they are, bytes of other scripts alike."""
    table = X.AS_IS.copy()
    table[65:91], table[97:123], table[48:58], table[128:] = 65, 97, 48, 97
    return table


_SHAPE = _shapes()


def _shape_hashes(data, starts, ends):
    """Hash of a word's first and last two shapes: case and signs at its edges, whatever its letters."""
    s = _SHAPE[data].astype(np.uint64)
    size = ends - starts
    second, third = np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts)
    return X.mix(s[starts] | s[second] << np.uint64(8) | s[third] << np.uint64(16) | s[ends - 1] << np.uint64(24)
                 | (size > 2).astype(np.uint64) << np.uint64(40))


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
    """(text, bucket) of every n-gram of a batch; half of the buckets are for words, half for pairs and shapes."""
    starts, ends, bounds = X.runs(~X.SPACE[data], offsets)
    h, shape, owner = X.run_hashes(data, starts, ends), _shape_hashes(data, starts, ends), X.owners(bounds)
    pair, inside = X.grams(h, bounds, 2)
    # A pair is either two different words or one word said twice: the latter is one feature for all words.
    if len(pair):
        pair = np.where(h[:-1] == h[1:], np.uint64(0x5EED), pair)
    shapes, _ = X.grams(shape, bounds, 2)
    half = np.uint64(buckets // 2)
    quarter = np.uint64(buckets // 4)
    first = owner[:len(pair)][inside]
    return (np.concatenate([owner, first, owner, first]),
            np.concatenate([h % half, half + pair[inside] % quarter, half + quarter + shape % quarter,
                            half + quarter + shapes[inside] % quarter]).astype(np.int64))


def counts(docs: DataFrame, good: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, target, raw): occurrences in the documents whose id is in `good`, and in all documents."""
    def count(batches):
        total = np.zeros((2, buckets), np.int64)
        for part in X.pieces(batches, "t"):
            owner, bucket = features(*X.text_bytes(part.column("t")), buckets)
            chosen = np.isin(part.column("i").fill_null(-1).to_numpy(), good)[owner]
            total[0] += np.bincount(bucket[chosen], minlength=buckets)
            total[1] += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])],
                                         names=["bucket", "target", "raw"])

    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(
        F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def ratios(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket; one row per bucket reaches the driver."""
    got = np.zeros((2, buckets))
    for r in counted.collect():
        got[:, r.bucket] = r.target, r.raw
    p = (got + SMOOTH) / (got.sum(1, keepdims=True) + SMOOTH * buckets)
    return np.log(p[0]) - np.log(p[1])


def gumbel(ids: np.ndarray, salts: np.ndarray, seed: int) -> np.ndarray:
    h = X.mix(ids.astype(np.int64).view(np.uint64) ^ X.mix(salts + np.uint64(seed)))
    return -np.log(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 1) -> DataFrame:
    """doc_id, log_weight, and sort_key: the perturbed weight as an integer in the same order."""
    ratio = docs.sparkSession.sparkContext.broadcast(ratio)

    def weights(batches):
        for part in X.pieces(batches, "t"):
            w, key = _perturbed(part.column("i"), part.column("t"), ratio.value, seed)
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(w), pa.array(key)],
                                             names=["doc_id", "log_weight", "sort_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(weights, "doc_id long, log_weight double, sort_key long")


def _perturbed(ids: pa.Array, texts: pa.Array, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = X.text_bytes(texts)
    owner, bucket = features(data, offsets, len(ratio))
    w = np.bincount(owner, ratio[bucket], len(offsets) - 1).astype(np.float64)  # without words numpy counts in whole numbers
    whole = X.run_hashes(data, offsets[:-1], offsets[1:])
    bits = (w + gumbel(ids.fill_null(-1).to_numpy(), whole, seed)).view(np.int64)
    return w, bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The exact k-th largest of a column of longs: four rounds, each counting 16 more bits of the values that agree with
    the bits found so far (at most 65,536 counts reach the driver). None if there are fewer than k values, or k is below 1."""
    if k < 1:
        return None
    found, rest = None, df.select(F.col(column).alias("v")).dropna()
    for shift in (48, 32, 16, 0):
        part = F.shiftright("v", shift)
        inside = rest if found is None else rest.filter(F.shiftright("v", shift + 16) == found)
        for r in sorted(inside.groupBy(part.alias("p")).count().collect(), reverse=True):
            if k <= r["count"]:
                found = r.p
                break
            k -= r["count"]
        else:
            return None
    return found


def threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight above which the fewest labelled documents are on the wrong side; of equal ones the least. It is far below
    all weights if keeping everything is best."""
    order = np.argsort(-weights, kind="stable")
    w, g = weights[order], good[order].astype(np.int64)
    gain = np.cumsum(2 * g - 1)
    gain[:-1][w[:-1] == w[1:]] = np.iinfo(np.int64).min
    best = len(w) - 1 - int(gain[::-1].argmax())
    return -np.inf if best + 1 == len(w) else float((w[best] + w[best + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 1):
    """(log ratios, threshold of the weights, table of weights), or None without both kinds of labels."""
    known = labelled(labels, "quality", rows)
    good = np.array([i for i, y in known if y], np.int64)
    if not len(good) or len(good) == len(known):
        return None
    ratio = ratios(counts(docs, good))
    weights = materialise(weigh(docs, ratio, seed), "weights")
    marked = weights.join(F.broadcast(docs.sparkSession.createDataFrame(known, "doc_id long, y int")), "doc_id")
    got = marked.groupBy("doc_id").agg(F.max("log_weight").alias("w"), F.max("y").alias("y")).orderBy("doc_id").limit(rows).toPandas()
    if got.y.nunique() < 2:
        return None
    return ratio, threshold(got.w.to_numpy(), got.y.to_numpy()), weights


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, rows: int = TRAIN_ROWS, seed: int = 1) -> DataFrame:
    """doc_id, log_weight, sort_key, kept. `k` documents are sampled; by default as many as have weights above the one
    that parts the labelled documents best."""
    model = fit(docs, labels, rows, seed)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("log_weight"),
                           F.lit(0).cast("long").alias("sort_key"), F.lit(True).alias("kept"))
    _, cut, weights = model
    least = kth_largest(weights, "sort_key", weights.filter(F.col("log_weight") >= cut).count() if k is None else k)
    kept = F.lit(k is None or k > 0) if least is None else F.col("sort_key") >= least
    return weights.withColumn("kept", kept)


def keep_sampled(docs: DataFrame, labels: DataFrame, k: int | None = None, rows: int = TRAIN_ROWS, seed: int = 1) -> DataFrame:
    """The sampled rows of `docs` with all their columns."""
    with released(docs.sparkSession):
        model = fit(docs, labels, rows, seed)
        if model is None:
            return docs
        ratio, cut, weights = model
        least = kth_largest(weights, "sort_key", weights.filter(F.col("log_weight") >= cut).count() if k is None else k)
    if least is None:
        return docs if k is None or k > 0 else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def keep(batches):
        for part in X.pieces(batches, "text"):
            key = _perturbed(part.column("doc_id").cast(pa.int64()), part.column("text"), shared.value, seed)[1]
            yield part.filter(pa.array(key >= least))

    return docs.mapInArrow(keep, docs.schema)

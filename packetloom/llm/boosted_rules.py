"""Quality rules: hard limits on document statistics, then gradient-boosted trees over them.

The trees are grown here on labelled documents (histogram splits on the logistic loss) with monotonic constraints: more
symbols, repeated words, repeated lines or shouting never raise a score. They are flattened into numpy node arrays, so
that a batch of documents walks every tree with a few array operations.

Null or empty texts have no words and fail the limits. Repeated rows are scored alike and all kept. A null id is carried
through. Columns other than the id and the text are not read, so their names cannot clash. Without labelled documents of
both kinds only the limits decide.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packetloom.llm import words as X
from packetloom.llm.shared import TRAIN_ROWS, labelled
from packetloom.session import materialise, released

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Direction of each feature: -1 if a higher value may only lower the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": -1,
    "mark_share": -1, "digit_share": -1, "distinct_share": 0, "words_per_line": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHERS = ("n_lines", "n_upper", "n_marks", "n_digits", "n_distinct")
STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *OTHERS))


def _has(symbols: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(symbols.encode())] = True
    return table


_SYMBOL, _UPPER, _MARK, _DIGIT = _has("#*$%&|<>"), _has("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _has("!?"), _has("0123456789")


def count_batch(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text of a batch."""
    solid = ~X.SPACE[data]
    starts, ends, bounds = X.runs(solid, offsets)
    hashes, texts = X.run_hashes(data, starts, ends), len(offsets) - 1

    def chars(mask):
        return X.sums(mask, offsets)

    triple, inside = X.grams(hashes, bounds, 3)
    owner = X.owners(bounds)
    salt = X.mix(owner.astype(np.uint64) + np.uint64(1))
    again = np.zeros(len(hashes), bool)
    if len(triple):
        twice = np.zeros(len(triple), bool)
        twice[inside] = X.repeated(X.mix(triple[inside] ^ salt[:len(triple)][inside]))[0]
        for k in range(3):
            again[k:k + len(twice)] |= twice
    _, later = X.repeated(X.mix(hashes ^ salt))

    line_starts, line_ends, line_bounds = X.runs(data != 10, offsets)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=filled[1:])
    spoken = filled[line_ends] > filled[line_starts]
    line_owner = X.owners(line_bounds)
    line_key = X.mix(X.run_hashes(data, line_starts, line_ends) ^ X.mix(line_owner.astype(np.uint64) + np.uint64(1)))
    dup = X.repeated(line_key[spoken])[1]
    n_words = np.diff(bounds)
    return {
        "n_words": n_words, "word_chars": chars(solid & X.code_points(data)), "n_symbols": chars(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_owner[spoken][dup], minlength=texts), "n_repeat_words": X.sums(again, bounds),
        "n_lines": np.bincount(line_owner[spoken], minlength=texts), "n_upper": chars(_UPPER[data]),
        "n_marks": chars(_MARK[data]), "n_digits": chars(_DIGIT[data]), "n_distinct": n_words - X.sums(later, bounds),
    }


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of every whole text: doc_id and the columns COUNTS and OTHERS."""
    def count(batches):
        for part in X.pieces(batches, "t"):
            found = count_batch(*X.text_bytes(part.column("t")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(found[c].astype(np.int64)) for c in (*COUNTS, *OTHERS))],
                names=["doc_id", *COUNTS, *OTHERS])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(count, STATISTICS)


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, np.float64) for k, v in c.items()}
    n, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / chars, c["n_repeat_words"] / n, c["n_dup_lines"] / lines,
        c["n_upper"] / chars, c["n_marks"] / chars, c["n_digits"] / chars, c["n_distinct"] / n, c["n_words"] / lines,
    ])


@dataclasses.dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
         bins: int = 64, smooth: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees on the logistic loss; `directions` holds -1, 0 or 1 for each feature.

    A split on a constrained feature must give its sides values in that order, and the values below either side stay on
    their side of the middle, so a whole tree, and thus the sum of trees, is monotonic.
    """
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    nodes: dict[str, list] = {k: [] for k in ("feature", "limit", "left", "right", "value")}
    roots, margin = [], np.full(len(y), base)

    def add(value: float) -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("limit", np.inf), ("left", k), ("right", k), ("value", value * rate)):
            nodes[name].append(v)
        return k

    def split(rows, g, h, low, high, room):
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + smooth), low, high))
        k, best = add(value), None
        if room:
            for f, e in enumerate(edges):
                gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))
                hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))
                a, b = gs[:-1], gs[-1] - gs[:-1]
                ha, hb = hs[:-1], hs[-1] - hs[:-1]
                va, vb = np.clip(-a / (ha + smooth), low, high), np.clip(-b / (hb + smooth), low, high)
                gain = -(a * va + 0.5 * (ha + smooth) * va**2) - (b * vb + 0.5 * (hb + smooth) * vb**2)
                gain[(ha < least) | (hb < least) | ((vb - va) * directions[f] < 0)] = -np.inf
                if len(gain) and (best is None or gain.max() > best[0]):
                    best = (gain.max(), f, int(gain.argmax()), va, vb)
            stay = -(g[rows].sum() * value + 0.5 * (h[rows].sum() + smooth) * value**2)
        if best is None or not best[0] > stay + 1e-9:
            margin[rows] += value * rate
            return k
        _, f, cut, va, vb = best
        middle, side = (va[cut] + vb[cut]) / 2, binned[rows, f] <= cut
        ranges = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[f]]
        left = split(rows[side], g, h, *ranges[0], room - 1)
        right = split(rows[~side], g, h, *ranges[1], room - 1)
        for name, v in (("feature", f), ("limit", edges[f][cut]), ("left", left), ("right", right)):
            nodes[name][k] = v
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(split(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, depth))
    arrays = {k: np.array(v, np.float64 if k in ("limit", "value") else np.int32) for k, v in nodes.items()}
    return Trees(**arrays, roots=np.array(roots, np.int32), depth=depth, base=base)


def fit(counted: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees from at most `rows` labelled documents; None without both kinds of labels."""
    known = counted.sparkSession.createDataFrame(labelled(labels, "quality", rows), "doc_id long, y int")
    got = counted.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(rows).toPandas()
    if got.y.nunique() < 2:
        return None
    return grow(features({c: got[c].to_numpy() for c in (*COUNTS, *OTHERS)}), got.y.to_numpy(float), list(FEATURES.values()))


def judge(counted: DataFrame, trees: Trees | None, cut: float = 0.5) -> DataFrame:
    """Adds base_failed, score (null without trees) and kept to a table of statistics."""
    names = [*counted.columns, "base_failed", "score", "kept"]

    def score(batches):
        for b in batches:
            c = {k: b.column(k).to_numpy() for k in (*COUNTS, *OTHERS)}
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            s = np.full(b.num_rows, np.nan) if trees is None else trees.score(features(c))
            kept = ~failed if trees is None else ~failed & (s >= cut)
            extra = [pa.array(failed), pa.array(s, mask=np.isnan(s)), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=names)

    return counted.mapInArrow(score, f"{STATISTICS}, base_failed boolean, score double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Statistics, base_failed, score and kept of every document; texts are read once."""
    counted = materialise(statistics(docs), "statistics")
    return judge(counted, fit(counted, labels, rows))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns."""
    with released(docs.sparkSession):
        trees, schema = fit(materialise(statistics(docs), "statistics"), labels, rows), docs.schema

    def keep(batches):
        for part in X.pieces(batches, "text"):
            c = count_batch(*X.text_bytes(part.column("text")))
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            good = ~failed if trees is None else ~failed & (trees.score(features(c)) >= 0.5)
            yield part.filter(pa.array(good))

    return docs.mapInArrow(keep, schema)

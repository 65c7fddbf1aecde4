"""Secret scan: candidate strings, and a random forest that removes false positives.

Candidates are, first, the values assigned to a secret's name or given as a URL's password: up to the closing quote or the
word's end, whatever their signs and length. Besides, they are runs of at least MIN_LENGTH of the characters of keys and tokens
that hold a digit or are assigned to something. A word may have several, as compact JSON, lists and URLs do: each is assigned to the nearest name before it, a
URL's password to "password", and the parts of a URL's path are runs of their own. The forest sees their length and make-up, how likely their character transitions are in the
corpus (counted over all documents), how much of them is covered by words frequent in the corpus, the names in the document's
path, and the words beside them.

Labelled findings can be given. Without them, findings that strict rules decide serve as labels: issued key formats and
values assigned to a secret's name that hold a digit or a sign are secrets; such values of letters alone are harmless where
they are words frequent in the corpus, and else undecided. Of the other runs addresses, telephone numbers, card numbers, network addresses, plain
words and numbers are harmless. The bounded sample `rows` holds the findings of least hash; half of the rest measures accuracy.

Null and empty texts have no findings; a null path has no names. Repeated rows are scanned alike, each giving its findings.
A null id is carried through. Other columns are not read, or kept when secrets are masked. Without labels of both kinds the
strict rules alone decide.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packetloom.llm import words as X
from packetloom.llm.shared import TRAIN_ROWS, least
from packetloom.session import materialise, released

MIN_LENGTH = 8
BUCKETS = 1 << 15
MASK = "[SECRET]"
#: Names of secrets, and of places where examples stand. Fixed lists.
SECRET_NAMES = "password passwd pwd secret token apikey api_key key auth credential credentials bearer private".split()
EXAMPLE_NAMES = "test tests example examples sample samples doc docs demo fixture fixtures mock".split()
ISSUED = re.compile(r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{24,}")
HARMLESS = re.compile(r"[^@\s]+@[^@\s]+\.[a-z]+|\+?[\d().,:/ -]+|(?:\d{1,3}\.){3}\d{1,3}|https?://.*|v?\d+(?:\.\d+)+|[^\W\d_]+")
#: Between two runs: what assigns the second to the first, parts a list, and shows that the first is a name.
_ASSIGNS = re.compile(r"[=:]>?[\"'`\[({\\]*$")
_LISTS = re.compile(r"[\"'`\\]*[,|][\"'`\\]*")
_NAMES = re.compile(r"[\"'`\])\\]*[=:]")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:([^\s/?#\"'`<>]*)@)?([^\s/?#\"'`<>@]*)([^\s?#\"'`<>]*)")
#: A name and what assigns to it; the value that follows a quote or not; where the value of a list or of settings ends.
_NAMED = re.compile(r"([A-Za-z_][\w.-]*)[\"'`\])\\]*(?:=>|:=|==?|:)(?=[^=:])")
_OPENS = re.compile(r"[\[({\\]*([\"'`]?)")
_VALUE = re.compile(r"(?:(?![,;&|](?:[\"'{]*[A-Za-z_][\w.-]*[\"']?[=:]|[A-Za-z0-9+/_.@~-]{8}))[^\"'`])*")
_CORE = re.compile(r"[A-Za-z0-9+/_.@~-]+(?:=(?=[\"'`;,.]*$))*")

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "sign_share", "distinct_share", "kind_changes", "is_hex",
    "transition", "worst_transition", "dictionary", "assigned", "secret_left", "secret_right", "left_known", "right_known",
    "quoted", "has_at", "dots", "example_path", "issued",
)


@dataclasses.dataclass
class Corpus:
    """What the corpus says about characters and words: log probabilities of transitions, and shares of hashed words."""

    transitions: np.ndarray
    words: np.ndarray


def _char_kinds() -> np.ndarray:
    """Letters without case, digits as one, all signs as one, bytes of other scripts as one."""
    table = np.full(256, 27)
    for k in range(26):
        table[97 + k] = table[65 + k] = k
    table[48:58] = 26
    table[128:] = 28
    return table


_CHARS, _KINDS = _char_kinds(), 29


def _letters(data: np.ndarray) -> np.ndarray:
    return _CHARS[data] < 26


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(place, n): counts of character transitions inside words, then of hashed lower-case letter runs; all texts, whole."""
    def count(batches):
        total = np.zeros(_KINDS * _KINDS + BUCKETS, np.int64)
        for part in X.pieces(batches, "t"):
            data, offsets = X.text_bytes(part.column("t"))
            kind, solid = _CHARS[data], ~X.SPACE[data]
            inner = solid[1:] & solid[:-1]
            pair = kind[:-1][inner] * _KINDS + kind[1:][inner]
            total[:_KINDS * _KINDS] += np.bincount(pair, minlength=_KINDS * _KINDS)
            starts, ends, _ = X.runs(_letters(data), offsets)
            bucket = (X.run_hashes(X.LOWER[data], starts, ends)[ends - starts > 2] % np.uint64(BUCKETS)).astype(np.int64)
            total[_KINDS * _KINDS:] += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    rows = docs.select(F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def corpus(docs: DataFrame) -> Corpus:
    """The counts as probabilities; a row per place, fixed in number, reaches the driver."""
    total = np.zeros(_KINDS * _KINDS + BUCKETS)
    for r in corpus_counts(docs).collect():
        total[r.place] = r.n
    pairs = total[:_KINDS * _KINDS].reshape(_KINDS, _KINDS) + 0.5
    words = total[_KINDS * _KINDS:]
    return Corpus(np.log(pairs / pairs.sum(1, keepdims=True)), words / max(words.sum(), 1))


def _known(text: str, own: Corpus, least: float = 5e-5) -> float:
    """Share of the characters that lie in letter runs frequent in the corpus."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return 0.0
    starts, ends, _ = X.runs(_letters(data), np.array([0, len(data)]))
    long = ends - starts > 2
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return 0.0
    often = own.words[(X.run_hashes(X.LOWER[data], starts, ends) % np.uint64(BUCKETS)).astype(np.int64)] >= least
    return float((ends - starts)[often].sum() / len(data))


def _describe(value: str, name: str, assigned: bool, quoted: bool, left: list[str], right: list[str], path: str, own: Corpus) -> list[float]:
    data = np.frombuffer(value.encode(), np.uint8)
    kind, n = _CHARS[data], len(data)
    step = own.transitions[kind[:-1], kind[1:]] if n > 1 else np.zeros(1)
    group = np.minimum(np.where(kind < 26, 0, kind - 25), 3)
    digits, upper = (kind == 26).sum(), ((data >= 65) & (data < 91)).sum()
    lower = ((data >= 97) & (data < 123)).sum()

    def named(words, names):
        return float(any(part in names for w in words for part in parts_of(w)))

    return [
        n, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, len(set(value)) / n, (group[1:] != group[:-1]).mean() if n > 1 else 0,
        float(re.fullmatch("[0-9a-fA-F]+", value) is not None), step.mean(), step.min(), _known(value, own), float(assigned),
        named([name, *left], SECRET_NAMES), named(right, SECRET_NAMES), _known(" ".join(left), own), _known(" ".join(right), own),
        float(quoted), float("@" in value), value.count("."), named(re.split(r"[/\\\\.]", path), EXAMPLE_NAMES), float(ISSUED.fullmatch(value) is not None),
    ]


def parts_of(word: str) -> list[str]:
    """Lower-case parts of a name in any of the usual spellings."""
    return re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", word).lower())


def _secret_name(word: str) -> bool:
    return any(part in SECRET_NAMES for part in parts_of(word))


def values_of(raw: str, name: str, assigned: bool):
    """(first character, value, name) of what a word assigns to a secret's name, URLs' passwords included. `name` and `assigned`
    say what the words before assign its beginning to. URLs as values are left to `runs_of`, as is what is a name itself."""
    begins = [(0, name)] if assigned and _secret_name(name) else []
    begins += [(m.end(), m.group(1)) for m in _NAMED.finditer(raw) if _secret_name(m.group(1))]
    found, end = [], 0
    for m in _URL.finditer(raw) if "://" in raw else ():
        user, sign, password = (m.group(1) or "").partition(":")
        if password:
            found.append((m.start(1) + len(user) + 1, password, "password"))
    for at, own in begins:
        opened = _OPENS.match(raw, at)
        start, quote = opened.end(), opened.group(1)
        if quote:
            close = raw.find(quote, start)
            value = raw[start:] if close < 0 else raw[start:close]
            value = value.rstrip("\\") if close >= 0 else value.rstrip(",;.)]}")
        else:
            value = _VALUE.match(raw, start).group().rstrip(",;.)]}:\\")
        if value.strip("=:-*._~") and start >= end and "://" not in value and not value.startswith("//") and not _NAMES.match(raw, start + len(value)):
            found.append((start, value, own))
            end = start + len(value)
    return sorted(found)


def runs_of(raw: str, name: str, assigned: bool):
    """(first character, run, name, whether assigned, whether a name itself, whether a URL's host) of each run of a word.
    `name` and `assigned` say what the words before assign the first one to."""
    passwords, hosts = [], []
    for m in _URL.finditer(raw) if "://" in raw else ():
        parts = list(raw)
        parts[m.start():m.start() + m.group().index("://") + 3] = " " * (m.group().index("://") + 3)
        if m.group(1) is not None:
            parts[m.end(1)] = " "
            if ":" in m.group(1):
                passwords.append((m.start(1) + m.group(1).index(":"), m.end(1)))
        hosts.append(m.span(2))
        parts[m.start(3):m.end(3)] = m.group(3).replace("/", " ")
        raw = "".join(parts)
    cores, before = list(_CORE.finditer(raw)), ""
    for k, core in enumerate(cores):
        start, end = core.span()
        is_name = _NAMES.match(raw, end) is not None
        if k:
            gap = raw[cores[k - 1].end():start]
            if _ASSIGNS.search(gap.rstrip(" ")):
                name, assigned = before, True
            elif is_name or not _LISTS.fullmatch(gap):
                name, assigned = "", False
        elif _ASSIGNS.search(raw[:start]) and not assigned:
            assigned = True
        before = core.group()
        own = ("password", True) if any(a <= start < b for a, b in passwords) else (name, assigned)
        yield start, core.group().rstrip(".-"), *own, is_name, any(a <= start < b for a, b in hosts)


def findings(data: np.ndarray, offsets: np.ndarray, paths: list[str], corpus: Corpus):
    """(text, first byte, end byte, value, silver label or -1, features) of each candidate of a batch."""
    starts, ends, bounds = X.runs(~X.SPACE[data], offsets)
    owner, size = X.owners(bounds), ends - starts
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 48) & (data < 58), out=digits[1:])
    equals = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 61) | (data == 58), out=equals[1:])
    has_sign = equals[ends] > equals[starts]
    after = np.zeros(len(starts), bool)
    after[1:] = has_sign[:-1] & (owner[1:] == owner[:-1])
    named = has_sign | after
    # a value may be short, and so may its word: the word assigns, or the one before ends so
    last_byte = data[ends - 1] if len(ends) else data[:0]
    before = np.zeros(len(starts), bool)
    before[1:] = ((last_byte[:-1] == 61) | (last_byte[:-1] == 58)) & (owner[1:] == owner[:-1])
    chosen = np.flatnonzero((size >= MIN_LENGTH) & ((digits[ends] > digits[starts]) | named) | has_sign | before)

    def word(k):
        return data[starts[k]:ends[k]].tobytes().decode(errors="replace")

    for k in chosen.tolist():
        text, first, last = int(owner[k]), int(bounds[owner[k]]), int(bounds[owner[k] + 1])
        raw = word(k)
        left = [word(j) for j in range(max(first, k - 3), k)]
        right = [word(j) for j in range(k + 1, min(last, k + 3))]
        name, assigned = "", False
        if left and left[-1][-1] in "=:":
            name, assigned = (left[-1][:-1] or (left[-2] if len(left) > 1 else "")), True
        direct = values_of(raw, name, assigned) if has_sign[k] or before[k] else []
        if size[k] < MIN_LENGTH and not direct:
            continue
        found = [(start, value, own, True) for start, value, own in direct]
        for start, value, own, given, is_name, host in runs_of(raw, name, assigned):
            if len(value) < MIN_LENGTH or not (given or any(c in "0123456789" for c in value) or named[k] and not is_name and "://" not in raw):
                continue
            if host and not ISSUED.search(value):  # an address
                continue
            if any(start < a + len(v) and a < start + len(value) for a, v, _ in direct):
                continue
            found.append((start, value, own, given))
        for start, value, own, given in sorted(found):
            quoted = start > 0 and raw[start - 1] in "\"'`"
            begin = int(starts[k]) + len(raw[:start].encode())
            x = _describe(value, own, given, quoted, left, right, paths[text] or "", corpus)
            yield text, begin, begin + len(value.encode()), value, silver(value, dict(zip(FEATURES, x)), (start, value, own) in direct), x


def silver(value: str, x: dict, direct: bool) -> int:
    """What the strict rules say of a candidate: 1 secret, 0 harmless, -1 undecided. What is assigned to a secret's name (`direct`)
    is never harmless by its form, only as a word frequent in the corpus."""
    if x["issued"]:
        return 1
    harmless = HARMLESS.fullmatch(value) is not None
    if direct:
        odd = x["digit_share"] > 0 or x["sign_share"] > 0
        return 1 if odd and len(value) >= 6 and x["dictionary"] <= 0.8 and not harmless else 0 if x["dictionary"] > 0.8 else -1
    if x["assigned"] and x["secret_left"] and x["digit_share"] > 0 and len(value) >= 10 and not harmless:
        return 1
    return 0 if harmless or (not x["assigned"] and x["dictionary"] > 0.8) else -1


@dataclasses.dataclass
class Forest:
    """Trees in flat arrays; a leaf points to itself and holds the share of secrets."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.value[at].mean(1)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 2, seed: int = 7) -> Forest:
    """Each tree sees a bootstrap of the rows, each split a random third of the features; splits lower the Gini impurity."""
    rng = np.random.default_rng(seed)
    nodes: dict[str, list] = {k: [] for k in ("feature", "limit", "left", "right", "value")}
    tried = max(1, round(x.shape[1] / 3))

    def split(rows, room):
        k, p = len(nodes["value"]), float(y[rows].mean())
        for name, v in (("feature", 0), ("limit", np.inf), ("left", k), ("right", k), ("value", p)):
            nodes[name].append(v)
        best = None
        if room and 0 < p < 1:
            for f in rng.permutation(x.shape[1])[:tried].tolist():
                order = np.argsort(x[rows, f], kind="stable")
                v, c = x[rows, f][order], np.cumsum(y[rows][order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                n = cut + 1.0
                cut = cut[(n >= least) & (len(rows) - n >= least)]
                if not len(cut):
                    continue
                n, a = cut + 1.0, c[cut]
                b, m = c[-1] - a, len(rows) - cut - 1.0
                impurity = a * (1 - a / n) + b * (1 - b / m)
                j = int(impurity.argmin())
                if best is None or impurity[j] < best[0]:
                    best = (impurity[j], f, (v[cut[j]] + v[cut[j] + 1]) / 2)
        if best is None:
            return k
        side = x[rows, best[1]] <= best[2]
        left, right = split(rows[side], room - 1), split(rows[~side], room - 1)
        for name, v in (("feature", best[1]), ("limit", best[2]), ("left", left), ("right", right)):
            nodes[name][k] = v
        return k

    roots = [split(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]
    arrays = {k: np.array(v, np.float64 if k in ("limit", "value") else np.int32) for k, v in nodes.items()}
    return Forest(**arrays, roots=np.array(roots, np.int32), depth=depth)


@dataclasses.dataclass
class Scanner:
    corpus: Corpus
    forest: Forest | None
    cut: float = 0.5

    def __call__(self, texts: pa.Array, paths: pa.Array) -> list[tuple]:
        """(text, first character, end, score, secret) of each candidate of a batch."""
        data, offsets = X.text_bytes(texts)
        found = list(findings(data, offsets, paths.to_pylist(), self.corpus))
        if not found:
            return []
        if self.forest is None:
            scores = [float(f[4] == 1) for f in found]
        else:
            scores = self.forest.score(np.array([f[5] for f in found])).tolist()
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum(X.code_points(data), out=points[1:])
        base = points[offsets[:-1]]
        return [(f[0], int(points[f[1]] - base[f[0]]), int(points[f[2]] - base[f[0]]), s, s >= self.cut) for f, s in zip(found, scores)]


def candidates(docs: DataFrame, own: Corpus, path: str = "source") -> DataFrame:
    """doc_id, begin and end (bytes), silver label and features of every candidate of the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        for part in X.pieces(batches, "t"):
            data, offsets = X.text_bytes(part.column("t"))
            ids, rows = part.column("doc_id").to_pylist(), list(findings(data, offsets, part.column("p").to_pylist(), shared.value))
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] - int(offsets[r[0]]) for r in rows], pa.int64()),
                pa.array([r[2] - int(offsets[r[0]]) for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int32()),
                pa.array([r[5] for r in rows], pa.list_(pa.float64()))], names=["doc_id", "begin", "end", "label", "features"])

    rows = _rows(docs, path)
    return rows.mapInArrow(run, "doc_id long, begin long, end long, label int, features array<double>")


def _rows(docs: DataFrame, path: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"), F.col(path).cast("string").alias("p"))


def fit(docs: DataFrame, labels: DataFrame | None = None, rows: int = TRAIN_ROWS, path: str = "source") -> tuple[Scanner, dict]:
    """A scanner and its held-out accuracy. labels: doc_id, begin, end (bytes), label; by default the strict rules' labels.

    At most `rows` findings train the forest and as many others test it."""
    with released(docs.sparkSession):
        return _fit(docs, labels, rows, path)


def _fit(docs, labels, rows, path):
    own = corpus(docs)
    found = candidates(docs, own, path)
    if labels is not None:
        found = found.drop("label").join(labels.select("doc_id", "begin", "end", "label"), ["doc_id", "begin", "end"])
    known = materialise(found.filter("label >= 0").select("doc_id", "begin", "end", "label", "features"), "findings")
    got = least(known, ["doc_id", "begin", "end"], 2 * rows).toPandas()
    if got.label.nunique() < 2:
        return Scanner(own, None), {"findings": len(got)}
    x, y = np.array(got.features.tolist()), got.label.to_numpy(float)
    train = np.arange(len(y)) % 2 == 0
    if len(set(y[train])) < 2:
        train[:] = True
    test = ~train if (~train).any() else train
    (more, label), (hard, truth) = varied(x[train], y[train]), varied(x[test], y[test])
    forest = grow_forest(np.concatenate([x[train], more]), np.concatenate([y[train], label]))
    right = (forest.score(x[test]) >= 0.5) == (y[test] == 1)
    return Scanner(own, forest), {"findings": len(got), "held_out": int(test.sum()), "accuracy": float(right.mean()),
                                  "hard": len(hard), "hard_accuracy": float(((forest.score(hard) >= 0.5) == (truth == 1)).mean()) if len(hard) else None}


def varied(x: np.ndarray, y: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Harder findings and their labels: the rows of secrets assigned to a secret's name, once shorter, once of letters alone, once with more signs
    and other characters' transitions. The labelled findings of a corpus may hold few forms, all long; the name is what makes
    these values secrets, and the forest has to learn that; but a word frequent in the corpus beside such a name is prose."""
    at, rng = {n: k for k, n in enumerate(FEATURES)}, np.random.default_rng(seed)
    rows = x[(y == 1) & (x[:, at["assigned"]] > 0) & (x[:, at["secret_left"]] > 0) & (x[:, at["issued"]] == 0)]
    out = []
    for digits, signs in ((None, None), (0.0, 0.0), (None, 0.3)):
        some = rows.copy()
        some[:, at["length"]] = np.floor(rng.uniform(5, np.maximum(rows[:, at["length"]], 6)))
        some[:, [at["transition"], at["worst_transition"]]] *= rng.uniform(0.4, 1.2, (len(rows), 2))
        some[:, at["is_hex"]] = 0
        some[:, at["quoted"]] = rng.integers(0, 2, len(rows))
        if digits is not None:
            some[:, at["digit_share"]], some[:, at["kind_changes"]] = 0, 0
            some[:, at["lower_share"]] = 1 - some[:, at["upper_share"]]
        if signs is not None:
            some[:, at["sign_share"]] = signs
            some[:, at["lower_share"]] = np.maximum(0, 1 - some[:, at["upper_share"]] - some[:, at["digit_share"]] - signs)
        out.append(some)
    prose = out[1].copy()
    prose[:, at["dictionary"]] = rng.uniform(0.8, 1, len(rows))
    prose[:, at["quoted"]] = 0
    return np.concatenate([*out, prose]), np.repeat([1.0, 0.0], [3 * len(rows), len(rows)])


def scan(docs: DataFrame, scanner: Scanner, path: str = "source") -> DataFrame:
    """doc_id, begin, end (characters), score, secret of every candidate of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches):
        for part in X.pieces(batches, "t"):
            ids, rows = part.column("doc_id").to_pylist(), shared.value(part.column("t"), part.column("p"))
            columns = list(zip(*[(ids[r[0]], *r[1:]) for r in rows])) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "begin", "end", "score", "secret"])

    return _rows(docs, path).mapInArrow(run, "doc_id long, begin long, end long, score double, secret boolean")


def secret_scan(docs: DataFrame, labels: DataFrame | None = None, rows: int = TRAIN_ROWS, path: str = "source") -> DataFrame:
    """All candidates with the forest's verdict."""
    return scan(docs, fit(docs, labels, rows, path)[0], path)


def mask_secrets(docs: DataFrame, labels: DataFrame | None = None, rows: int = TRAIN_ROWS, path: str = "source") -> DataFrame:
    """`docs` with each secret in the text replaced by MASK, and n_chars, if there is one, counted anew; all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows, path)[0])
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for part in X.pieces(batches, "text"):
            texts, paths = part.column("text"), part.column(path).cast(pa.string())
            spans: dict[int, list] = {}
            for text, begin, end, _, secret in shared.value(texts, paths):
                if secret:
                    spans.setdefault(text, []).append((begin, end))
            changed = texts.to_pylist()
            for k, found in spans.items():
                for begin, end in reversed(found):
                    changed[k] = changed[k][:begin] + MASK + changed[k][end:]
            columns = list(part.columns)
            columns[at] = pa.array(changed, texts.type)
            if "n_chars" in names:
                own = names.index("n_chars")
                counts = part.column(own).to_pylist()
                for k in spans:
                    counts[k] = len(changed[k])
                columns[own] = pa.array(counts, part.column(own).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)

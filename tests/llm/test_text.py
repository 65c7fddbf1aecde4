"""Operators on texts against plain recomputation; nulls, empty and long texts, repeated rows, empty tables, odd columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from packetloom.llm import boosted_rules as R, byte_bpe as B, minhash as M, packing as K, resampling as G, words as X
from packetloom.llm.shared import classes, ready, table

RANKS, WORD_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "a b c d " * 40), (8, "x" * 300_000),
       (9, "lang word\nlang word\n \n\nlang word " * 20), (None, "no id here " * 30), (11, "a b c d " * 40), (11, "a b c d " * 40),
       (12, "été Été 10 ça 日本 😀 " * 30), (13, "w%d " * 60 % tuple(range(60)))]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "src", 0, "clash", k) for k, (i, t) in enumerate(ODD)]
    return ready(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(ready(spark), sf_dir, "documents")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def base_counts(t):
    w = words(t)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered))


def test_statistics(odd, docs):
    for df in (odd, docs):
        got = collections.Counter(tuple(r) for r in R.statistics(df).select("doc_id", *R.COUNTS).collect())
        want = collections.Counter((r.doc_id, *base_counts(r.text)) for r in df.select("doc_id", "text").collect())
        assert got == want


def test_rules(spark, odd, docs, labels):
    got = {r.doc_id: r for r in R.quality_rules(docs, labels).collect()}
    for r in docs.collect():
        n, *_, again = base_counts(r.text)
        assert got[r.doc_id].base_failed == (n < 50 or 100 * again > 50 * n)
        assert not (got[r.doc_id].base_failed and got[r.doc_id].kept)
    good = [got[r.doc_id] for r in labels.collect() if r.quality == 1]
    bad = [got[r.doc_id] for r in labels.collect() if r.quality == 0]
    assert all(r.kept for r in good if not r.base_failed) and sum(r.kept for r in bad) <= 0.2 * len(bad)
    kept = R.keep_good(odd, labels)
    assert kept.schema == odd.schema and {r.doc_id for r in kept.collect()} <= {None, 7, 8, 9, 11, 12, 13}
    none = labels.limit(0)
    assert [r.kept for r in R.quality_rules(odd, none).filter("doc_id in (4, 13)").orderBy("doc_id").collect()] == [False, True]
    assert R.quality_rules(odd.limit(0), labels).count() == 0


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)).astype(float)
    trees = R.grow(x, y, [1, -1, 0])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.98
    line = np.linspace(0, 1, 50)
    for f, sign in ((0, 1), (1, -1)):
        for _ in range(20):
            row = np.repeat(rng.random((1, 3)), 50, 0)
            row[:, f] = line
            assert (np.diff(trees.score(row)) * sign >= -1e-12).all()


def test_resampling(spark, odd, docs, labels):
    got = {r.doc_id: r for r in G.resample(docs, labels).collect()}
    known = [(got[r.doc_id].kept, r.quality) for r in labels.collect()]
    assert np.mean([k == bool(q) for k, q in known]) > 0.97
    few = G.resample(docs, labels, k=20).filter("kept")
    assert few.count() == 20 and min(r.sort_key for r in few.collect()) > max(
        r.sort_key for r in G.resample(docs, labels, k=20).filter("not kept").collect())
    assert G.resample(odd, labels.limit(0)).filter("kept").count() == len(ODD)
    assert G.resample(odd, labels).count() == len(ODD) and G.keep_sampled(odd, labels).schema == odd.schema
    assert G.resample(docs.limit(0), labels).count() == 0


def test_gumbel_sample_follows_the_weights():
    ids = np.arange(200_000)
    w = np.where(ids % 2 == 0, np.log(3.0), 0.0)
    top = np.argsort(-(w + G.gumbel(ids, np.zeros(len(ids), np.uint64), 1)))[:2000]
    assert abs((top % 2 == 0).mean() - 0.75) < 0.03


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([-5, 2**62, 7, -2**63, 2**63 - 1, 0, 7]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 50, 200):
        assert G.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert G.kth_largest(df, "v", 201) is None and G.kth_largest(df, "v", 0) is None


def sets_of(rows, width):
    out = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        out[i] = frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def brute_classes(sets, percent):
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root


def near_group(n, words_each=60, seed=3):
    """Copies of one text, each with a few words changed: many of them similar, not all linked."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words_each)]
    return [(1000 + k, " ".join(f"x{rng.random()}" if rng.random() < 0.03 else w for w in base)) for k in range(n)]


def test_near_duplicates(spark, docs, odd):
    for rows in ([tuple(r) for r in docs.select("doc_id", "text").collect()], near_group(150)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for width, percent in ((3, 85), (5, 80)):
            sets = sets_of(rows, width)
            want = brute_classes(sets, percent)
            got = {r.doc_id: r for r in M.near_duplicates(df, width, percent).collect()}
            assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
                i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    got = {r.doc_id: r for r in M.near_duplicates(odd, 3, 85).collect()}
    assert (got[6].component_id, got[11].component_id, got[3].n_shingles, got[None].component_id) == (5, 7, 0, None)
    one = M.keep_one(odd, 3, 85)
    assert one.schema == odd.schema and sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 12, 13]
    assert M.near_duplicates(odd.limit(0)).count() == 0


def test_blocks_and_anchors(spark, monkeypatch):
    """Families of several blocks: the second pass links what is outside the main class."""
    monkeypatch.setattr(M, "BLOCK_NODES", 16)
    rows = near_group(120, seed=5)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_classes(sets_of(rows, 3), 85)


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "LARGE", 10)
    rows = near_group(60, seed=6)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_classes(sets_of(rows, 3), 85)


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
    sets = [np.concatenate([common, own[k]]) for k in range(2)] + [rng.integers(0, 2**63, 900, dtype=np.uint64)]
    low = M.signatures(np.concatenate(sets), np.cumsum([0, 900, 900, 900]))[1]
    assert abs(M.estimate(low[0], low[1]) - 0.8) < 0.1 and abs(M.estimate(low[0], low[2])) < 0.07


def test_classes_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 100] + [(500, 500)], "a long, b long")
    nodes = spark.range(302).select("id")
    got = {r.id: r.root for r in classes(nodes, links).collect()}
    assert got == {k: 1 if 1 <= k <= 100 else 101 if 101 <= k <= 200 else 201 if 201 <= k <= 300 else k for k in range(302)}


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_boundaries_and_merges(library):
    own, rng = B.codec(RANKS), random.Random(4)
    signs = " '  \n\t's'tre'll'vemd AbéЖ9¾٣!?#- 　\x85😀ll'xᲉ\U00010d40́"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", " ", "'", "ab" * 5000]
    ids, bounds = own.encode(texts)
    offsets = own.offsets(ids, bounds)
    out, base = own.decode(ids, offsets, bounds)
    for k, t in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == library.encode_ordinary(t), repr(t)
        assert out[base[k]:base[k + 1]].tobytes() == t.encode()
    tokens = [library.decode_single_token_bytes(i) for i in ids[bounds[7]:bounds[8]]]
    assert offsets[bounds[7]:bounds[8]].tolist() == [sum(map(len, tokens[:k])) for k in range(len(tokens))]


def test_scan_of_lanes_equals_a_loop():
    bounds, rng = B.Boundaries(), np.random.default_rng(2)
    for n in (1, 63, 64, 65, 5000):
        kinds = rng.integers(0, B.CLASSES, n).astype(np.uint8)
        state, want = B.START, []
        for k in kinds:
            want.append(state)
            state = B._next_state(state, k)
        assert bounds.states(kinds).tolist() == want


def test_encode_and_decode_rows(odd, docs, library):
    for df in (odd, docs):
        texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        got = B.decode(B.encode(df, RANKS), RANKS).collect()
        assert [(r.doc_id, bytes(r.decoded).decode()) for r in got] == texts
        assert all(r.ids == library.encode_ordinary(t) for r, (_, t) in zip(got, texts))
    assert B.decode(B.encode(odd.limit(0), RANKS), RANKS).count() == 0


def test_token_pieces_and_places(odd, docs):
    library = Tokenizer.from_file(WORD_BPE)
    for df in (odd, docs):
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
            for k in range(0, len(ids), 2048):
                part = ids[k:k + 2048]
                want[r.doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
        rows = K.pack_documents(df, WORD_BPE).collect()
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        held = collections.defaultdict(list)
        for r in rows:
            held[r.sequence_id].append((r.offset, r.length))
        for content in held.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= 2048
        least = -(-sum(r.length for r in rows) // 2048)
        assert len(held) <= least + 1 + 0.02 * least
    assert K.pack_documents(odd.limit(0), WORD_BPE).count() == 0


def test_chunks_equal_whole_texts():
    own, rng = K.ChunkTokenizer(WORD_BPE), random.Random(3)
    signs = [*"abcDE éÜßñİΣσ'.,|!-%  \n\t\x1c 12٣<|endoftext|>́ſK日本😀", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    own.chunks.size = own.parts.size = 50
    assert [x for k in range(0, 3000, 100) for x in own.encode(texts[k:k + 100])] == want


def best_fit_bins(items, capacity):
    rooms = []
    for s in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def least_bins(items, capacity):
    """The fewest bins, by trying."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= items[k]:
                go(k + 1, rooms[:j] + [rooms[j] - items[k]] + rooms[j + 1:])
        go(k + 1, rooms + [capacity - items[k]])

    go(0, [])
    return best[0]


def used(histogram, capacity):
    left = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        left[s] = n
    fixed = K.reduce(left, capacity)
    rest = {int(s): int(left[s]) for s in np.flatnonzero(left)}
    return sum(n for n, _ in fixed), rest, sum(n for n, _ in K.best_fit(left, capacity))


def test_reduction_is_optimal_and_best_fit_is_best_fit():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([7, 10, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        fixed, rest, packed = used(collections.Counter(items), capacity)
        rest_items = [s for s, n in rest.items() for _ in range(n)]
        assert fixed + (least_bins(rest_items, capacity) if rest_items else 0) == least_bins(items, capacity)
        assert packed == best_fit_bins(rest_items, capacity)


def test_pieces_of_batches_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (0, 5, 100, 1, 0, 300)] + [None]})
    parts = list(X.pieces(iter([batch]), "t", 100))
    assert [v for p in parts for v in p.column("t").to_pylist()] == batch.column("t").to_pylist() and len(parts) > 2


def test_digests(spark, sf_dir, library):
    from packetloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op6_byte_bpe"](spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        ids = library.encode_ordinary(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())

"""Ids that repeat with other contents, bulk nulls, and words on the layout: the cases in which rows could get lost."""

import random

import numpy as np
import pytest

from packetloom.llm import lattice, minhash, pages, slots
from packetloom.session import new_path

A = " ".join(f"a{k}" for k in range(60))
B = " ".join(f"b{k}" for k in range(60))


def sets(text, width):
    words = (text or "").split()
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def components(items, linked):
    """Least id reachable, over rows (id, content): rows of one id hang together."""
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(items):
        for j, y in items[n + 1:]:
            if linked(x, y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def close(x, y):
    a, b = sets(x, 3), sets(y, 3)
    return bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)


def test_ids_that_repeat_with_other_texts(spark):
    rows = [(5, A), (5, B), (7, B + " more"), (8, B), (9, A), (5, A), (11, "other words here"), (11, ""), (None, A)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    want = components([r for r in rows if r[0] is not None], close)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in found) == sorted(
        (i or 0, len(sets(t, 3)), want.get(i, 0), i is None or want[i] == i) for i, t in rows)


def test_repeated_ids_at_random(spark):
    rng = random.Random(4)
    base = [[f"w{k}-{j}" for j in range(40)] for k in range(6)]
    rows = []
    for _ in range(80):
        words = list(rng.choice(base))
        if rng.random() < 0.5:
            words[rng.randrange(40)] = "changed"
        rows.append((rng.randrange(40), " ".join(words)))
    want = components(rows, close)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((i, want[i]) for i, _ in rows)


def test_only_copies_are_dropped(spark):
    rows = [(5, A, 1), (5, B, 2), (7, B + " more", 3), (8, B, 4), (9, A, 5), (5, A, 1), (11, "other", 6), (11, "", 7), (None, A, 8), (12, "", 9)]
    left = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, t1 int"), 3, 85).collect()
    assert sorted((r.t1, r.doc_id or 0) for r in left) == [(1, 5), (2, 5), (6, 11), (7, 11), (8, 0), (9, 12)]


def test_vector_ids_that_repeat_with_other_vectors(spark):
    rng = np.random.default_rng(3)
    u, v, w = rng.normal(size=(3, 24))
    rows = [(5, u), (5, v), (7, v + 1e-3), (8, w), (9, u), (9, u)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, embedding array<float>")
    unit = [np.float32(x).astype(float) / np.linalg.norm(np.float32(x).astype(float)) for _, x in rows]
    links = [sum(k != n and x @ y >= 0.95 for k, y in enumerate(unit)) for n, x in enumerate(unit)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).collect())
    assert got == sorted((i, n, {5: 5, 7: 5, 8: 8, 9: 5}[i], i in (5, 8)) for (i, _), n in zip(rows, links))


@pytest.mark.parametrize("share", ["null", "same id", "same row"])
def test_a_third_of_the_rows_does_not_weigh_on_one_shard(spark, share):
    rng = random.Random(2)
    rows = [(k, "x" * rng.randint(5, 90)) for k in range(4000)]
    rows += [(None if share == "null" else 1, "same text of a row" if share == "same row" else "y" * rng.randint(5, 90) + str(k)) for k in range(2000)]
    placed = slots.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16, new_path(spark, "maps")).collect()
    assert len(placed) == len(rows)
    size, places = [0] * 16, [[] for _ in range(16)]
    for r in placed:
        size[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert max(size) < 1.02 * min(size) and all(sorted(p) == list(range(len(p))) for p in places)


def test_words_on_the_layout_empty_no_article():
    for page in ("<article class='post with-sidebar'><p>Main text.</p></article>", "<main class='header-offset menu-open'><p>Main text.</p></main>",
                 "<main id='menu'><article><p>Main text.</p></article></main>"):
        assert [t for t, s in pages.blocks(page) if s == pages.IN] == ["Main text."]
    for page in ("<article><div class='site-sidebar left'><p>Gone.</p></div><p>Main.</p></article>", "<article><p>Main.</p><section id='comments'><article class='comment-body'>Gone.</article></section></article>"):
        assert [t for t, s in pages.blocks(page) if s == pages.IN] == ["Main."]

"""Conversation formatting, repair and the manifest against plain recomputation."""

import hashlib
import itertools
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from packetloom.llm import chat, manifest, queries, turns

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- 12

def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        c, t, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        out.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def legal(roles):
    if roles[:1] == "s" and len(roles) > 1:
        roles = roles[1:]
    return len(roles) % 2 == 0 and all(x == "ua"[k % 2] for k, x in enumerate(roles))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest_plain(rows, faults):
    """Dijkstra by (cost, audit) over (row, state): the least audit among the cheapest, without vectors or chunks."""
    import heapq

    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, k, state = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in (0, 3):
            return cost, audit
        follow = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 3, audit + "I", k, follow))
        if k < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state))
            if faults[k] not in ("blank", "duplicate"):
                more, first = 3 * (faults[k] == "truncated"), rows[k][1][:1]
                heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, follow))
                if (first == "s" and state == 0) or (first in ("u", "a") and follow == (2 if first == "u" else 3)):
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, 1 if first == "s" else follow))
    raise AssertionError


def repaired(rows, audit):
    out, state, rest = [], 0, iter(rows)
    for edit in audit:
        follow = 3 if state == 2 else 2
        if edit == "I":
            out.append(("user" if follow == 2 else "assistant", ""))
        else:
            _, role, text = next(rest)
            if edit == "D":
                continue
            out.append((role, text) if edit == "K" else ("user" if follow == 2 else "assistant", text))
            if edit == "K" and role[:1] == "s":
                state = 1
                continue
        state = follow
    return out


def plain_repair(rows):
    out = {}
    for conv, own in plain_damage(rows).items():
        # rows of one turn go by role and a hash of the text: the fixtures hold only equal rows in one turn
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        faults = faults_of(own)
        cost, audit = cheapest_plain(own, faults)
        known = [r[0] for r in own if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        kept = repaired(own, audit)
        assert legal("".join(role[:1] for role, _ in kept))
        first = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     sha("\n".join(f"{role}:{text}" for role, text in kept)))
    return out


def spark_repair(spark, rows, schema=SCHEMA):
    found = turns.repair_damaged(spark.createDataFrame(rows, schema)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


def random_rows(rng, convs, most, roles=("user", "assistant", "system", "tool", None, "")):
    texts = ["Yes.", "No!", "Why?", "and then", " ", "", None, "End. \n", "Straße ", "a.b", "?"]
    out = []
    for conv in convs:
        place = 0
        for _ in range(rng.randint(1, most)):
            place += rng.choice((1, 1, 1, 2, 4))
            out.append((conv, place, rng.choice(roles), rng.choice(texts)))
    return out


def test_repair_equals_plain_search(spark):
    rng = random.Random(5)
    rows = random_rows(rng, [None, *range(60)], 9) + random_rows(rng, range(60, 64), 60) + [(77, None, "user", "x"), (78, None, None, None)]
    rng.shuffle(rows)
    assert spark_repair(spark, rows) == plain_repair(rows)


def test_repair_across_chunks(spark, monkeypatch):
    """Chunks of four rows, also runs that let no difference vanish: the fix-up passes settle them all."""
    monkeypatch.setattr(turns, "CHUNK", 4)
    monkeypatch.setattr(turns, "FAN", 3)
    rng = random.Random(6)
    rows = random_rows(rng, [1, 2], 150) + random_rows(rng, [3, 4], 150, roles=("tool",))
    rows += [(5, k, "user", "  " if k > 1 else "Hi.") for k in range(120)] + [(6, k, ("user", "assistant")[k % 2], "Fine.") for k in range(90)]
    assert spark_repair(spark, rows) == plain_repair(rows)


def test_vectors_meet_or_not():
    costs = turns.Costs()
    v, spent = costs.run("uaua", costs.guess)
    true, cost = costs.run("uaua", costs.final)
    assert v == true
    met, more = costs.rerun("uaua", costs.guess, costs.final)
    assert met is None and spent + more == cost
    apart, _ = costs.rerun("1111", costs.guess, costs.final)
    assert apart is not None  # deleted rows let no difference vanish


def test_letters_and_options_cover_every_role():
    costs = turns.Costs()
    for x, state in itertools.product(turns.INITIALS + turns.INITIALS.upper() + turns.GONE, range(4)):
        v, low = costs.back(x, costs.final)
        assert low >= 0 and min(costs.vectors[v]) == 0
        assert costs.trace(x, costs.final, state)[1] in range(4)


def test_repair_of_odd_tables(spark):
    assert spark_repair(spark, []) == {}
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 5)], SCHEMA + ", chunk string, pos int")
    assert turns.repair_damaged(wide).count() == 1
    same = [(1, 2, "user", "Same.")] * 40 + [(1, 3, "assistant", "long " * 200_000 + ".")]
    assert spark_repair(spark, same) == plain_repair(same)


def test_repair_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op12_viterbi_repair"](spark, sf_dir).collect()}
    assert found == plain_repair(rows)


# ---------------------------------------------------------------- 11

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_digests(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {conv: (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), sum(len(t) for r, t in own if r == "assistant"),
                   sha("".join(t for r, t in own if r == "assistant"))) for conv, own in out.items()}


def digests(spark, rows, schema=SCHEMA, **options):
    segments = chat.format_conversations(spark.createDataFrame(rows, schema), VOCABULARY, **options)
    return {r.conv_id: tuple(r)[1:5] for r in chat.conversation_digests(chat.read_back(segments)).collect()}


HARD = ["<|end|>", "<\\|turn|>", "a <|", "|> b", "<", "\\", "😀 <|text|> é", "", None, "\n\n x", "### </turn>", "<|endoftext|>", "日本語 " * 50]


@pytest.mark.parametrize("limit", [1, 60, 1 << 18])
def test_formatting_is_read_back(spark, limit):
    rng = random.Random(limit)
    rows = [(conv, turn, rng.choice(("user", "assistant", "system", None, "<|x")), rng.choice(HARD))
            for conv in [None, *range(25)] for turn in [None, *range(rng.randint(1, 9))]]
    rows += [(99, 1, "assistant", "Same.")] * 50 + [(98, 0, "assistant", "word " * 100_000)]
    rng.shuffle(rows)
    assert digests(spark, rows, limit=limit) == plain_digests(rows)


def test_tokens_are_those_of_the_whole_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], t or "") for k, t in enumerate(HARD)]
    text, spans = chat.render([(r, t) for _, _, r, t in rows])
    ranks, sizes = chat.vocabulary(VOCABULARY)
    whole = ranks.encode(text, allowed_special=set(chat.CONTROL), disallowed_special=())
    got = sorted(chat.format_conversations(spark.createDataFrame(rows, SCHEMA), VOCABULARY, limit=20).collect(), key=lambda r: (r.part, r.segment))
    assert [x for r in got for x in r.ids] == whole and "".join(r.formatted for r in got) == text
    assert isinstance(ranks, tiktoken.Encoding) and int(sizes[whole].sum()) == len(text.encode())
    for r in got:
        assert r.starts == sorted(r.starts) and r.ends[-1] == len(r.formatted)
        under = {k for s, e, m in zip(r.starts, r.ends, r.loss) if m for k in range(s, e)}
        assert all(("<|" in r.formatted[s:e]) <= (not m) for s, e, m in zip(r.starts, r.ends, r.loss)) and len(under) <= len(r.formatted)


def test_escape_is_reversible():
    for text in ("<|", "<\\|", "<\\\\|end|>", "<<||", "\\", "<\\"):
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_formatting_of_an_empty_table(spark):
    assert digests(spark, []) == {}
    assert digests(spark, [(1, 0, "assistant", "x", 1, "y")], SCHEMA + ", part int, ids string") == plain_digests([(1, 0, "assistant", "x")])


# ---------------------------------------------------------------- 13

def plain_record(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k:k + 8])) for k in range(0, len(last), 8)])
    return levels


def plain_path(levels, k):
    out = []
    for level in levels[:-1]:
        run = level[k // 8 * 8:k // 8 * 8 + 8]
        out.append(("".join(run[:k % 8]), "".join(run[k % 8 + 1:])))
        k //= 8
    return out


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_record(r)))
        trees[g] = plain_levels([plain_record(r) for r in groups[g]])
    top = plain_levels([trees[g][-1][0] for g in order])
    out, root = [], top[-1][0]
    for n, g in enumerate(order):
        for k, r in enumerate(groups[g]):
            path = plain_path(trees[g], k) + plain_path(top, n)
            h = plain_record(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                h = plain_record((*r[:4], "".join(x.lower() if "A" <= x <= "Z" else x for x in r[4])))
            for before, after in path:
                h = sha(before + h + after)
            out.append((r[0], plain_record(r), trees[g][-1][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_of(spark, rows, schema=DOCS):
    return sorted((tuple(r) for r in manifest.checked_by_id(spark.createDataFrame(rows, schema)).collect()), key=repr)


def random_docs(rng, n, langs):
    return [(rng.choice((None, *range(n))), rng.choice(("web", None, "ÄB")), rng.choice(langs), rng.choice((None, 5)),
             rng.choice(("Ab", "ab", "", None, "É x", f"T{rng.random()}"))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 700])
def test_manifest_equals_plain_trees(spark, n):
    rows = random_docs(random.Random(n), n, ("de", None, "", "en", "ß", "zz"))
    assert manifest_of(spark, rows) == plain_manifest(rows)


@pytest.mark.parametrize("n", [8, 9, 63, 64, 65, 300])
def test_manifest_of_several_blocks(spark, monkeypatch, n):
    """Blocks of eight leaves: the tree of their tops is built by the same code, several times over."""
    monkeypatch.setattr(manifest, "DEPTH", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    rows = random_docs(random.Random(n), n, ("de",)) + random_docs(random.Random(n + 1), 20, ("en", "fr"))
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_of_odd_tables(spark):
    assert manifest_of(spark, []) == []
    many = [(1, "s", "en", 2, "Same")] * 100 + [(4, None, None, None, "x" * 1_000_000)]
    assert manifest_of(spark, many) == plain_manifest(many)
    clash = [(*r, 1, "y") for r in random_docs(random.Random(1), 30, ("en", "de"))]
    assert manifest_of(spark, clash, DOCS + ", g int, path string") == plain_manifest([r[:5] for r in clash])


def test_manifest_of_many_languages(spark):
    rows = [(k, "s", f"lang{k % 150}", 1, f"Text {k}") for k in range(400)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_changed_records_are_found(spark):
    rows = manifest.checked_by_id(spark.createDataFrame([(k, "s", "en", 1, "Capital") for k in range(50)], DOCS))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    assert rows.filter(F.col("verified") == chosen).isEmpty()

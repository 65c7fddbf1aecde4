"""Registered queries of the operators: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm import (
    boosted_rules, byte_bpe, chat, lattice, manifest, minhash, packing, pages, resampling, secrets, slots, surrogates,
    turns,
)
from packetloom.llm.shared import ready, table
from packetloom.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ready(spark), sf_dir)
    return fn


@query
def op1_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op3_secret_scan(spark, sf_dir):
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


@query
def op4_lattice(spark, sf_dir):
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_byte_bpe(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_host_suffixes(spark, sf_dir):
    return pages.main_text(table(spark, sf_dir, "pages"))


@query
def op8_virtual_slots(spark, sf_dir):
    placed = slots.shard_documents(table(spark, sf_dir, "documents"), 16, new_path(spark, "slot-maps"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query
def op9_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.surrogates(docs, key="packetloom")


@query
def op10_quality_rules(spark, sf_dir):
    found = boosted_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *boosted_rules.COUNTS, "base_failed", "score", "kept")


@query
def op11_chat_format(spark, sf_dir):
    own = spark.createDataFrame([(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))],
                                "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.conversation_digests(chat.read_back(chat.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"))))


@query
def op12_viterbi_repair(spark, sf_dir):
    return turns.repair_damaged(table(spark, sf_dir, "conversations"))


@query
def op13_manifest(spark, sf_dir):
    return manifest.checked_by_id(table(spark, sf_dir, "documents"))


# The least id reachable over links (a, b), for the rows of `base` (id, n).
_REACH = """reach(id, root) AS (SELECT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.id = l.a),
 least_root AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""

ORACLES["op2_minhash"] = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, hash(ws[k], ws[k + 1], ws[k + 2]) AS g FROM w, unnest(range(1, len(ws) - 1)) t(k) WHERE len(ws) >= 3 UNION ALL SELECT doc_id, hash(ws) FROM w WHERE len(ws) IN (1, 2)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)), {_REACH}
 SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
 FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_root ON id = doc_id"""

ORACLES["op4_lattice"] = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95), {_REACH}
 SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
 FROM v LEFT JOIN least_root ON id = vec_id"""

# Unsigned CRC-32 in SQL: `tab` holds the table of a byte, `t` is its only column.
_CRC_TABLE = """tab AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n)))"""


def _crc(text: str) -> str:
    return (f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), "
            "lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)")


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, nodes: str) -> str:
    """Nodes (g, pos, h) level by level up to each group's only one, as `name` (g, lev, pos, h)."""
    return (f"{name}(g, lev, pos, h) AS (SELECT g, 0, pos, h FROM {nodes} UNION ALL SELECT g, lev + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) "
            f"FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, lev + 1, pos // 8)")


def _walk(name: str, tree: str, start: str) -> str:
    """From `start` (n, g, pos, digest, proof) up the tree, one level a step: the siblings, and the digest that they give."""
    run = f"FROM {tree} s WHERE s.g = w.g AND s.lev = w.lev AND s.pos // 8 = w.pos // 8"
    before = f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.pos) {run} AND s.pos < w.pos), '')"
    after = f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.pos) {run} AND s.pos > w.pos), '')"
    return (f"{name}(n, g, lev, pos, digest, proof) AS (SELECT n, g, 0, pos, digest, proof FROM {start} UNION ALL "
            f"SELECT n, g, lev + 1, pos // 8, sha256(b || digest || a), proof || b || a FROM (SELECT *, {before} AS b, {after} AS a FROM {name} w "
            f"WHERE EXISTS (SELECT 1 FROM {tree} u WHERE u.g = w.g AND u.lev = w.lev + 1)))")


ORACLES["op13_manifest"] = f"""WITH RECURSIVE {_CRC_TABLE},
 leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(text="text")} AS h, CASE WHEN {_crc("doc_id::VARCHAR")} % 3 = 0 THEN {_LEAF.format(text=_LOWER)} END AS found FROM documents, tab),
 placed AS (SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, h) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves),
 {_tree("tree", "placed")},
 subroots AS (SELECT g AS lang_key, max_by(h, lev) AS h FROM tree GROUP BY g),
 ranked AS (SELECT '' AS g, lang_key, row_number() OVER (ORDER BY lang_key) - 1 AS pos, h FROM subroots),
 {_tree("above", "ranked")},
 started AS (SELECT n, g, pos, coalesce(found, h) AS digest, '' AS proof FROM placed),
 {_walk("low", "tree", "started")},
 ends AS (SELECT n, max_by(digest, lev) AS digest, max_by(proof, lev) AS proof FROM low GROUP BY n),
 over AS (SELECT e.n, '' AS g, r.pos, e.digest, e.proof FROM ends e JOIN placed p ON p.n = e.n JOIN ranked r ON r.lang_key = p.g),
 {_walk("high", "above", "over")},
 done AS (SELECT n, max_by(digest, lev) AS folded_root, sha256(max_by(proof, lev)) AS proof_sha256 FROM high GROUP BY n)
 SELECT doc_id, p.h AS leaf, s.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
 FROM placed p JOIN done USING (n) JOIN subroots s ON s.lang_key = p.g, (SELECT max_by(h, lev) AS root FROM above)"""

_ESCAPED = r"regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g')"

ORACLES["op11_chat_format"] = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r))
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length('<|turn|><|text|><|end|>') + length({_ESCAPED.format(c="role")}) + length({_ESCAPED.format(c="text")})) AS BIGINT) AS formatted_chars
 FROM c GROUP BY conv_id"""

# Faults planted, numbered rows, costs from the end backwards, then the least audit forwards, row by row.
ORACLES["op12_viterbi_repair"] = rf"""WITH RECURSIVE {_CRC_TABLE},
 d AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, tab),
 e AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again FROM d WHERE kind <> 0),
 p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, again) - 1 AS pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM e),
 r AS (SELECT conv, turn, pos, role, text, left(role, 1) AS i, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'd'
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS f FROM p),
 x AS (SELECT *, f IN ('b', 'd') AS gone, CASE f WHEN 't' THEN 3 ELSE 0 END AS m FROM r),
 back(conv, pos, c) AS (SELECT conv, max(pos) + 1, [0, 6, 3, 0] FROM x GROUP BY conv
  UNION ALL SELECT conv, pos, [least(b[1], 3 + u), least(b[2], 3 + u), u, a] FROM (SELECT *, least(b[3], 3 + b[4]) AS u, least(b[4], 3 + b[3]) AS a FROM (
   SELECT x.conv, x.pos, CASE WHEN gone THEN [4 + c[1], 4 + c[2], 4 + c[3], 4 + c[4]] ELSE [
    least(4 + c[1], 3 + m + c[3], CASE i WHEN 's' THEN m + c[2] WHEN 'u' THEN m + c[3] END), least(4 + c[2], 3 + m + c[3], CASE i WHEN 'u' THEN m + c[3] END),
    least(4 + c[3], 3 + m + c[4], CASE i WHEN 'a' THEN m + c[4] END), least(4 + c[4], 3 + m + c[3], CASE i WHEN 'u' THEN m + c[3] END)] END AS b
   FROM back JOIN x ON x.conv = back.conv AND x.pos = back.pos - 1))),
 walk(conv, pos, s, audit, said) AS (SELECT conv, 0, 1, '', CAST([] AS VARCHAR[]) FROM back WHERE pos = 0
  UNION ALL SELECT conv, CASE WHEN edit = 'I' THEN pos ELSE pos + 1 END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN keeps ELSE follow END, audit || edit,
   CASE edit WHEN 'D' THEN said WHEN 'K' THEN said || [role || ':' || text] ELSE said || [CASE follow WHEN 3 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END] END
  FROM (SELECT *, CASE WHEN 4 + after[s] = c[s] THEN 'D' WHEN 3 + c[follow] = c[s] THEN 'I' WHEN NOT gone AND m + after[keeps] = c[s] THEN 'K' ELSE 'R' END AS edit
   FROM (SELECT w.*, x.* EXCLUDE (conv, pos), b.c, n.c AS after, CASE s WHEN 3 THEN 4 ELSE 3 END AS follow,
     CASE WHEN s = 1 AND i = 's' THEN 2 WHEN s <> 3 AND i = 'u' THEN 3 WHEN s = 3 AND i = 'a' THEN 4 END AS keeps
    FROM walk w JOIN back b ON b.conv = w.conv AND b.pos = w.pos LEFT JOIN back n ON n.conv = w.conv AND n.pos = w.pos + 1 LEFT JOIN x ON x.conv = w.conv AND x.pos = w.pos
    WHERE b.c[w.s] > 0 OR x.pos IS NOT NULL))),
 repaired AS (SELECT conv, max_by(audit, length(audit)) AS audit, max_by(said, length(audit)) AS said FROM walk GROUP BY conv),
 sums AS (SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate,
  count(*) FILTER (WHERE f = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(i) OVER (PARTITION BY conv ORDER BY pos) || i AS pair FROM x) GROUP BY conv)
 SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(c[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations) LEFT JOIN sums USING (conv) LEFT JOIN repaired USING (conv) LEFT JOIN back ON back.conv = sums.conv AND back.pos = 0"""

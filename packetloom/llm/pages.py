"""Main text of HTML pages, with a suffix array over the token streams of each host.

A page becomes blocks of text in page order. Markup says much about some: what lies in an article or main element is text,
what lies in menus, headers, footers, sidebars, forms, adverts, notices or comments is not. Of the others the host decides:
the token streams of its pages are concatenated, their suffixes sorted, and runs of RUN or more tokens that occur on two or
more distinct pages are boilerplate. A block at least half covered by such runs goes, the rest is kept as unique.
Blocks outside an existing article go; passages inside it stay, though several articles may quote them.

Hosts are dealt to groups of at most about CHUNK bytes, so one host with a third of all pages is many tasks. A repeat that
only spans two groups of such a host is found by a second pass, which counts the windows of RUN tokens on distinct pages by
key and is run for the pages without an article block as parsed, the only ones it can change.

Null or empty html has the empty text. Pages without url share a nameless host, each with its own id. A page repeated with
the same id and url counts as one page, so its text is no repeat of itself. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from packetloom.llm import words as X
from packetloom.session import materialise

RUN, CHUNK = 8, 500_000

#: Fixed lists: elements by what they are, and words in class, id or role that tell what a part of a page is for.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe object svg math select button xmp noframes canvas audio video".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog search".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion notice notices cookie cookies consent gdpr alert popup "
    "modal overlay newsletter subscribe signup login comment comments disqus respond replies reply sidebar menu navbar navigation breadcrumb "
    "breadcrumbs pagination pager related recommended share sharing social footer header masthead skip toolbar widget".split())
#: Fixed lists: words that make such a word a remark on the layout ("with-sidebar", "header-offset").
BEFORE = frozenset("with has have no not without is below above under after before hide hides show shows near".split())
BEHIND = frozenset("offset enabled disabled layout open closed fixed sticky padding margin visible hidden free less".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: What closes an open paragraph or list item, as browsers do.
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

OUT, IN, OPEN = 0, 1, 2


def _names_part(token: str) -> bool:
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    return bool(words) and words[0] not in BEFORE and words[-1] not in BEHIND and any(w in PARTS for w in words)


def _is_part(attributes: str, content: bool = False) -> bool:
    """Whether an element says it is a part outside. `content`: of the main element only its role and visibility count."""
    for name, value in _NAMED.findall(attributes) if "=" in attributes else ():
        value = value.strip("\"'").lower()
        if name.lower() == "role":
            if value in ROLES:
                return True
        elif name.lower() == "aria-hidden":
            if value == "true":
                return True
        elif not content and any(map(_names_part, value.split())):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, OUT | IN | OPEN) of each block with text: outside, in an article, or undecided."""
    page, at, found, pieces = page or "", 0, [], []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, whether it is a part outside, an article, a heading
    outside = articles = headings = headers = 0

    def close():
        text = " ".join(entities.unescape("".join(pieces)).split()) if pieces else ""
        pieces.clear()
        if text:
            dropped = outside - (headers if headings and articles else 0)
            found.append((text, OUT if dropped > 0 else IN if articles else OPEN))

    def leave(depth: int):
        nonlocal outside, articles, headings, headers
        while len(stack) > depth:
            name, part, content, heading = stack.pop()
            outside -= part
            articles -= content
            headings -= heading
            headers -= part and name == "header"

    while True:
        m = _TAG.search(page, at)
        pieces.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        end, name, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            close()
        elif name in ("br", "td", "th"):
            pieces.append(" ")
        if end:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                leave(depth)
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                tail = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = tail.end() if tail else len(page) if name in ("script", "style", "title", "textarea") else at
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in BLOCK:  # a block ends an open paragraph
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in BLOCK), None)
            if depth is not None and stack[depth][0] == "p":
                leave(depth)
        if name in _IMPLIED and stack and stack[-1][0] in _IMPLIED[name]:
            leave(len(stack) - 1)
        part = name in OUTSIDE or name not in ("html", "body") and _is_part(attributes, name == "main")
        state = (name, part, name in CONTENT and not part, name in HEADINGS)
        stack.append(state)
        outside += part
        articles += state[2]
        headings += state[3]
        headers += part and name == "header"
    close()
    return found


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all blocks in a row, and the n + 1 places at which the blocks begin."""
    data, offsets = X.text_bytes(pa.array(texts, pa.string()))
    return X.words(data, offsets)


def suffix_ranks(tokens: np.ndarray, stream: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first `depth` tokens, found by doubling; suffixes that leave their stream stay alone."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        key = np.full(n, -1, np.int64)
        key[:n - step] = rank[step:]
        order = np.lexsort((key, rank))
        new = np.append(True, (rank[order][1:] != rank[order][:-1]) | (key[order][1:] != key[order][:-1]))
        rank[order] = np.cumsum(new) - 1
        known += step
    whole = np.zeros(n, bool)
    if n >= depth:
        whole[:n - depth + 1] = stream[:n - depth + 1] == stream[depth - 1:]
    return np.where(whole, rank, -1)


def repeats(tokens: np.ndarray, page: np.ndarray, stream: np.ndarray, depth: int = RUN) -> np.ndarray:
    """Which tokens lie in a run of `depth` or more that occurs on two distinct pages; a stream is one page's row of tokens."""
    rank = suffix_ranks(tokens, stream, depth)
    order = np.argsort(rank, kind="stable")
    order = order[rank[order] >= 0]
    covered = np.zeros(len(tokens) + 1, np.int64)
    if len(order):
        begins = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1]))
        several = np.minimum.reduceat(page[order], begins) < np.maximum.reduceat(page[order], begins)
        at = order[np.repeat(several, np.diff(np.append(begins, len(order))))]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + depth, -1)
    return np.cumsum(covered)[:-1] > 0


def choose(texts: list[str], states: list[int], share: np.ndarray) -> str:
    """The main text of a page, given how far each block is covered."""
    if IN in states:
        return "\n".join(t for t, s in zip(texts, states) if s == IN)
    return "\n".join(t for t, s, c in zip(texts, states, share) if s == OPEN and c < 0.5)


def _parse(pages: DataFrame) -> DataFrame:
    def run(batches):
        for part in X.pieces(batches, "html"):
            found = [blocks(h) for h in part.column("html").to_pylist()]
            columns = [c for n, c in zip(part.schema.names, part.columns) if n != "html"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([[b[0] for b in f] for f in found], pa.list_(pa.string())),
                 pa.array([[b[1] for b in f] for f in found], pa.list_(pa.int32()))],
                names=[*(n for n in part.schema.names if n != "html"), "texts", "states"])

    return pages.mapInArrow(run, "page_id long, url string, host string, chunk int, across boolean, page long, texts array<string>, states array<int>")


def _within(table: pa.Table) -> pa.Table:
    """Main texts of the pages of one group."""
    rows = table.select(["page", "texts", "states", "across"]).to_pylist()
    flat = [t for r in rows for t in r["texts"]]
    tokens, bounds = token_hashes(flat)
    per_row = np.array([len(r["texts"]) for r in rows])
    row_of_block = np.repeat(np.arange(len(rows)), per_row)
    stream = np.repeat(row_of_block, np.diff(bounds))
    page = np.array([r["page"] for r in rows], np.int64)[stream] if len(stream) else np.zeros(0, np.int64)
    covered = repeats(tokens, page, stream)
    share = X.sums(covered, bounds) / np.maximum(np.diff(bounds), 1)
    first = np.concatenate([[0], np.cumsum(per_row)])
    # Pages whose blocks may repeat in another group of the host are left to the second pass.
    texts = [None if r["across"] and IN not in r["states"] else choose(r["texts"], r["states"], share[a:b])
             for r, a, b in zip(rows, first[:-1], first[1:])]
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string())})


def _windows(parsed: DataFrame) -> DataFrame:
    """(host, page, block, at, window) of every window of RUN tokens, at the block and token where it begins."""
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                texts = b.column("texts")[k].as_py()
                tokens, bounds = token_hashes(texts)
                g, inside = X.grams(tokens, np.array([0, len(tokens)]), RUN)
                n = len(g)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b.column("host")[k].as_py()] * n, pa.string()), pa.array(np.full(n, b.column("page")[k].as_py())),
                    pa.array(np.arange(n)), pa.array(g.view(np.int64))], names=["host", "page", "at", "window"])

    return parsed.mapInArrow(run, "host string, page long, at long, window long")


def _across(parsed: DataFrame) -> DataFrame:
    """Main texts of the pages without an article of hosts in several groups, by windows counted over the whole host."""
    windows = materialise(_windows(parsed), "windows")
    repeated = windows.groupBy("host", "window").agg(F.min("page").alias("a"), F.max("page").alias("b")).filter("a < b").select("host", "window")
    lone = parsed.filter(~F.array_contains("states", IN))
    begun = windows.join(lone.select("host", "page").distinct(), ["host", "page"], "left_semi").join(materialise(repeated, "repeated"), ["host", "window"])
    places = begun.groupBy("host", "page").agg(F.collect_set("at").alias("places"))

    def run(batches):
        for b in batches:
            texts = []
            for r in b.select(["texts", "states", "places"]).to_pylist():
                tokens, bounds = token_hashes(r["texts"])
                covered = np.zeros(len(tokens) + 1, np.int64)
                at = np.array(r["places"] or [], np.int64)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + RUN, -1)
                share = X.sums(np.cumsum(covered)[:-1] > 0, bounds) / np.maximum(np.diff(bounds), 1)
                texts.append(choose(r["texts"], r["states"], share))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return lone.join(places, ["host", "page"], "left").select("page_id", "url", "texts", "states", "places").mapInArrow(
        run, "page_id long, url string, text string")


def main_text(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    named = pages.withColumn("host", host_of(F.col("url")))
    hosts = named.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    large = materialise(hosts.filter(F.col("bytes") > chunk).select("host", F.ceil(F.col("bytes") / chunk).cast("int").alias("chunks")), "hosts")
    page = F.xxhash64("page_id", "url")
    dealt = named.join(large, "host", "left").select(
        "page_id", "url", "host", F.coalesce(F.pmod(page, F.col("chunks")), F.lit(0)).cast("int").alias("chunk"),
        F.col("chunks").isNotNull().alias("across"), page.alias("page"), "html")
    texts = _parse(dealt).groupBy("host", "chunk").applyInArrow(_within, "page_id long, url string, text string")
    # Large hosts with a page whose states hold no article block. Parsing them twice writes less than keeping all texts would.
    lone = materialise(_parse(dealt.filter("across")).filter(~F.array_contains("states", IN)).select("host").distinct(), "lone")
    if not lone.isEmpty():
        texts = texts.filter(F.col("text").isNotNull()).union(_across(_parse(dealt.filter("across").join(lone, "host", "left_semi").select(*dealt.columns))))
    return texts.withColumn("n_chars", F.length("text").cast("long"))

"""Main text of web pages: a host's repeated token runs, with markup as protection.

A page becomes blocks of text: of an article or main element, of what markup
shows to be no article text (menus, adverts, comments), or neither.

The suffixes of a host's concatenated token streams are put in order as far as
RUN tokens tell them apart, which is all that "repeated" asks: suffixes that
agree in RUN tokens are one bucket of an aggregation, so the array is spread over
all tasks and a host with a third of the pages is no single group.  Neighbours
in it from pages of different content are a repeated run; runs that follow one
another are one longer run.  The array is dense (a suffix a token) outside
articles and sparse (a suffix a block, compared as far as the block goes) inside.

Covered tokens go, unique runs stay.  Inside an article or main element a block
goes only if it is the same on most of its host's pages; on pages with such
elements nothing else is text.  Pages with the same text are copies and prove
nothing about each other's runs, and a page of which most repeats is a changed
copy, and keeps its text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Tokens of the shortest run that counts as repeated, and the share of a page's tokens beyond which repeats are its text.
RUN, COPY = 8, 0.9
#: An article's block is boilerplate if so many contents of its host, and such a share of all of them, have it.
LEAST, MOST = 4, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[a-zA-Z/!?](?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*'|[\"'])*+>?", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_CUES = re.compile(r"(?:\b|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Elements whose text is never shown or never part of an article.
_RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template", "xmp")
_CHROME = frozenset("nav footer aside form button select option dialog menu svg canvas audio video object head".split())
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is no article text.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|comment-list|consent|contentinfo|cookie|cookies|disqus|footer|gdpr|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|pager|popup|promo|promoted|promotion|related|reply|replies|respond|reviews|search|share|sharing|sidebar|signup|skip-link|social|sponsor|sponsored|subscribe|subscription|teaser|toc|toolbar|user-review|widget)(?=$|[\s_-])",
    re.I,
)
_HIDDEN = re.compile(r"\shidden(?=[\s=/>])|\sstyle\s*=\s*[\"']?[^\"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_QUOTED = re.compile(r"(?<!style=)(?:\"[^\"]*\"|'[^']*')", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in _RAW}


@lru_cache(8192)
def _tag(tag: str) -> tuple[str, bool, bool, bool] | None:
    """``(name, an end?, without content?, marked as no article text?)``; None for comments and declarations."""
    if not (named := _NAME.match(tag)):
        return None
    name = named[2].lower()
    marked = "=" in tag and name not in ("html", "body") and any(_MARKS.search(a or b or c) for a, b, c in _CUES.findall(tag))
    marked = marked or bool(_HIDDEN.search(_QUOTED.sub("''", tag)))
    return name, bool(named[1]), name in _VOID or tag.endswith("/>"), marked


def blocks(page: str) -> list[tuple[str, int]]:
    """``(text, kind)`` of a page's blocks in order; kind 0: of an article or main element, 1: no article text, 2: neither.

    White space in a text is single spaces; empty blocks are left out.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # name, kind before it
    opened: Counter[str] = Counter()  # names on the stack
    # kind 3: an inline element whose text is left out of the block around it, which is of the kind ``base``
    kind, base, parts, at = 2, 2, [], 0

    def close() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, base if kind == 3 else kind))

    def pop() -> str:
        nonlocal kind
        name, kind = stack.pop()
        opened[name] -= 1
        return name

    end = len(page)
    start = page.find("<")
    while start >= 0:
        if (found := _TOKEN.match(page, start)) is None:
            start = page.find("<", start + 1)
            continue
        if start > at and kind != 3:
            parts.append(page[at:start])
        at, tag = found.end(), found.group()
        start = page.find("<", at)
        if (known := _tag(tag)) is None:
            continue
        name, closes, bare, marked = known
        if closes:
            if name in _BLOCKS:
                close()
            if opened[name] > 0:
                while pop() != name:
                    pass
            elif name == "p":
                close()
            continue
        if name in _BLOCKS:
            close()
        elif name in ("td", "th") and kind != 3:
            parts.append(" ")
        if name in _RAW and not bare:
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else end
            start = page.find("<", at)
            continue
        if bare:
            continue
        new = kind
        if name in ("article", "main"):
            if marked:
                close()
                new = 1
            elif kind != 1 or not (opened["article"] or opened["main"]):
                # an unclosed menu or advert before the article ends with it
                new = 0
        elif kind in (0, 2) and marked and name not in _BLOCKS and name not in _CHROME:
            base, new = kind, 3
        elif kind in (0, 2) and (name in _CHROME or marked or name == "header" and kind != 0):
            close()
            new = 1
        if name == "p":  # an open paragraph ends where the next begins
            while stack and stack[-1][0] == "p":
                pop()
            new = 1 if marked else kind
        if name in _BLOCKS or new != kind:
            stack.append((name, kind))
            opened[name] += 1
            kind = new
    if at < end and kind != 3:
        parts.append(page[at:])
    close()
    return out


def host(url: str | None) -> str:
    """The host of an address in lower case, without a port; empty if there is none."""
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _stream(found: list[tuple[str, int]]) -> list[tuple[int, str]]:
    """``(block, token)`` of the blocks that aren't article text."""
    return [(k, token) for k, (text, kind) in enumerate(found) if kind for token in text.split()]


def _key(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text, seed) - (1 << 63)


def _suffixes(name: str, tokens: list[tuple[int, str]]) -> list[int]:
    """A key for each place from which RUN tokens follow: of the host and those tokens."""
    seed = xxhash.xxh64_intdigest(name)
    words = [t for _, t in tokens]
    return [_key(" ".join(words[i : i + RUN]), seed) for i in range(len(words) - RUN + 1)]


def parse(url: str | None, page: str | None) -> tuple[str, bool, list[int], list[int], int, int]:
    """``(text, settled, dense, whole, host, content)`` of a page.

    ``settled``: some text is in an article or main element; text then is its
    blocks' lines, and otherwise every block's, each behind the digit of its
    kind.  ``dense`` are the keys of the suffixes outside articles, ``whole``
    those of an article's blocks, ``host`` and ``content`` hashes: copies agree
    in content, whatever their menus show.
    """
    name, found = host(url), blocks(page or "")
    settled = any(kind == 0 for _, kind in found)
    text = [x for x, kind in found if kind == 0] if settled else [f"{kind}{x}" for x, kind in found]
    seed = xxhash.xxh64_intdigest(name, 1)
    whole = [_key(x, seed) for x in text] if settled else []
    content = _key(" ".join(x for x, kind in found if kind == 0 or not settled and kind == 2), 0)
    return "\n".join(text), settled, _suffixes(name, _stream(found)), whole, seed - (1 << 63), content


def decide(text: str, settled: bool, hits: list[int], copy: float = COPY) -> tuple[str, int]:
    """The text that stays, and how many tokens went, by the places of repeated keys: blocks of an article, or else suffixes."""
    if settled:
        lines, out = text.split("\n"), set(hits)
        sizes = [len(x.split()) for x in lines]
        if not out or 2 * (gone := sum(sizes[k] for k in out)) > sum(sizes):
            return text, 0
        return "\n".join(x for k, x in enumerate(lines) if k not in out), gone
    found = [(x[1:], int(x[0])) for x in text.split("\n")] if text else []
    tokens = _stream(found)
    keep = np.ones(len(tokens), dtype=bool)
    for i in hits:
        keep[i : i + RUN] = False
    own = np.array([found[k][1] == 2 for k, _ in tokens], dtype=bool)
    if (own & ~keep).sum() > copy * own.sum():
        keep[:] = True
    left: dict[int, list[str]] = {}
    for (k, token), good in zip(tokens, keep):
        if good and found[k][1] == 2:
            left.setdefault(k, []).append(token)
    return "\n".join(" ".join(x) for x in left.values()), int((~keep).sum())


def parsed(pages: DataFrame) -> DataFrame:
    """``row, page_id, url, text, settled, dense, whole, host, content`` for every row of pages, written once."""
    ids = pages.schema["page_id"].dataType.simpleString()
    names = ["text", "settled", "dense", "whole", "host", "content"]
    kinds = [pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = list(zip(*(parse(u.as_py(), h.as_py()) for u, h in zip(part.column(2), part.column(3)))))
                yield pa.record_batch([*part.columns[:3], *(pa.array(c, kind) for c, kind in zip(out, kinds))], names=["row", "page_id", "url", *names])

    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return table(rows.mapInArrow(run, f"row bigint, page_id {ids}, url string, text string, settled boolean, dense array<bigint>, whole array<bigint>, host bigint, content bigint"), "pages")


def repeated(each: DataFrame) -> DataFrame:
    """``key``: of the suffixes that pages of different content share, and of the article blocks that most of a host's contents have."""
    runs = each.select("content", F.explode("dense").alias("key")).groupBy("key").agg(F.min("content").alias("a"), F.max("content").alias("b"))
    whole = each.where("settled").select("host", "content", F.explode("whole").alias("key"))
    # nearly all blocks are unique: plain counts leave them out before copies are told from other pages
    often = table(whole.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("key"), "often")
    of = whole.join(often, "key", "left_semi").distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    hosts = each.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("all"))
    most = of.join(hosts, "host").where(F.col("n") >= MOST * F.col("all"))
    return table(runs.where("a <> b").select("key").unionByName(most.select("key")), "repeated")


def main_text(pages: DataFrame, copy: float = COPY) -> DataFrame:
    """``page_id, url, text, n_chars, n_repeated`` for every row of ``page_id, url, html``.

    ``n_repeated`` is the number of tokens that went as repeated: of an article,
    or, on pages without one, of all blocks.  Null and empty pages have an empty
    text; very long ones are read whole; rows that repeat, by id or whole, are
    pages of their own, and such copies don't count as repeats; pages without a
    host form one host; an empty table gives no rows; other columns are ignored.
    ``copy`` is the share of a page's text beyond which its repeats stay.
    """
    ids = pages.schema["page_id"].dataType.simpleString()
    each = parsed(pages)
    asked = each.select("row", F.posexplode(F.when(F.col("settled"), F.col("whole")).otherwise(F.col("dense"))).alias("place", "key"))
    # of pages from which something goes alone, so texts move only where even these are too many to broadcast
    hits = table(asked.join(repeated(each), "key", "left_semi").groupBy("row").agg(F.collect_list("place").alias("hits")), "hits")  # of one page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cells = [decide(text.as_py(), settled.as_py(), found.as_py() or [], copy) for text, settled, found in zip(*part.columns[2:])]
                yield pa.record_batch([*part.columns[:2], pa.array([x for x, _ in cells], pa.string()), pa.array([n for _, n in cells], pa.int64())], names=["page_id", "url", "text", "n_repeated"])

    joined = each.join(hits, "row", "left").select("page_id", "url", "text", "settled", "hits")
    out = joined.mapInArrow(run, f"page_id {ids}, url string, text string, n_repeated bigint")
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_repeated")

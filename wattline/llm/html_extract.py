"""Main text of web pages: markup gives each block a standing, a suffix array of each host's text decides with it.

Each page becomes text blocks in page order. Furniture (menus, headers, footers, sidebars, notices, adverts, forms,
comments) is never text. What is left, inside article or main where a page has them, else all other blocks, makes
the token stream of the host, page after page. Suffixes are grouped by their leading run of words; runs that stand
on pages of different text are repeats. How much repetition makes a block boilerplate depends on its standing:

- a block of a page that marks no article goes if half of its words are in runs that another page has (long blocks: a
  third of the host's pages, at least three, so that an article told twice stays);
- a block that an article element vouches for goes only if half of its words are in runs that four of five pages of
  the host have, at least eight: what nearly all pages say is the template's, wherever it stands.

Unique runs stay. A page all of whose blocks would go is a copy, not furniture, and keeps them.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import bounded_batches, hashed_words, hot_keys, kept, mix, ngram_hashes, salted, sized, spread

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is no text.
RAW = frozenset("script style noscript template svg math iframe object textarea title select option canvas audio video head".split())
#: Elements that are furniture with all they hold.
FURNITURE = frozenset("nav header footer aside form button menu dialog".split())
#: Words in class, id or role that mark furniture.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer form header masthead menu"
    " nav navbar navigation newsletter notice popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget"
    " contentinfo complementary search alert modal".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre"
    " section summary table tbody td tfoot th thead tr ul caption center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag closes by itself.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN, FURNISHED, OPEN = 2, 1, 0
#: Words from which an open block is long; pages, and their share of the host's, that must have a long block's runs.
LONG, LONG_PAGES, LONG_SHARE = 40, 3, 1 / 3
#: Pages, and their share of the host's, that must have the runs of an article's block.
TEMPLATE_PAGES, TEMPLATE_SHARE = 8, 0.8
#: Words of a host are counted in 2 to the power of so many classes: a class has at least the pages of each of its words.
WORD_BITS = 12


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the text blocks of a page in order: kind MAIN, FURNISHED or OPEN. White space in a block is one space."""
    out, buffer, stack = [], [], []  # stack: (tag, is furniture, is main)
    furnished = main = 0
    at = 0

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            out.append((FURNISHED if furnished else MAIN if main else OPEN, text))

    def pop():
        nonlocal furnished, main
        _, f, m = stack.pop()
        furnished -= f
        main -= m

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m[1]:
            if any(s[0] == name for s in stack):
                if name in BLOCKS or name in FURNITURE:
                    flush()
                while pop_name := stack[-1][0]:
                    pop()
                    if pop_name == name:
                        break
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if name == "head":
                body = re.compile(r"<body\b", re.I).search(page, at)
                at = min(end.end() if end else n, body.start() if body else n)
            else:
                at = end.end() if end else n
            buffer.append(" ")
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in BLOCKS:
            flush()
            while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(name, ())):
                pop()
            if stack and name in CLOSES and any(s[0] in CLOSES[name] for s in stack[-3:]) and name in {s[0] for s in stack[-3:]}:
                while stack[-1][0] not in CLOSES[name]:
                    pop()
                pop()
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        furniture = name in FURNITURE
        for key, a, b, c in _ATTR.findall(m[3] or ""):
            key = key.lower()
            words = re.split(r"[^a-z0-9]+", (a or b or c).lower())
            furniture |= key == "hidden" or (key == "aria-hidden" and words[0] == "true") or (key in ("class", "id", "role") and not MARKS.isdisjoint(words))
        if name in ("body", "html", "main", "article"):
            furniture = False
        stack.append((name, int(furniture), int(name in ("article", "main"))))
        furnished += furniture
        main += stack[-1][2]
    flush()
    return out


def _split(batches):
    """(page_id, url, host, html) to (..., marked, texts, n_words): the blocks that may be text; marked pages have an article."""
    for batch in batches:
        marked, texts, n_words = [], [], []
        for page in batch.column(3).to_pylist():
            found = blocks(page or "")
            marked.append(any(k == MAIN for k, _ in found))
            texts.append([t for k, t in found if k == (MAIN if marked[-1] else OPEN)])
            n_words.append(sum(len(t.encode().split()) for t in texts[-1]))
        arrays = [*batch.columns[:3], pa.array(marked, pa.bool_()), pa.array(texts, pa.list_(pa.string())), pa.array(n_words, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "host", "marked", "texts", "n_words"])


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)


def _words(batches):
    """(host, text) to (host, word): the distinct words of each page, as the WORD_BITS first bits of their hashes."""
    for batch in batches:
        hosts = batch.column(0).to_numpy()
        for lo, _, _, bounds, hashes, _ in hashed_words(batch.column(1), lower=False):
            got = [np.unique(_short(hashes[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
            owner = np.repeat(hosts[lo : lo + len(got)], [len(x) for x in got])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(got))], ["host", "word"])


def _suffixes(least: int):
    """(page, host, open, words, text) to (key, page, host, pos, open): the hash of host and the ``least`` words from each place.

    Where words are given, places with another word among their ``least`` are left out: no run that counts stands there.
    """

    def run(batches):
        for batch in batches:
            pages, hosts, is_open = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, _, _, bounds, hashes, _ in hashed_words(batch.column(4), lower=False):
                got = []
                for i in np.flatnonzero(np.diff(bounds) >= least):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    at = np.arange(len(own) - least + 1)
                    if not is_open[lo + i]:
                        common = batch.column(3)[lo + i].values.to_numpy()
                        passed = np.concatenate([[0], np.cumsum(np.isin(_short(own), common))])
                        at = np.flatnonzero(passed[least:] - passed[:-least] == least)
                        if not len(at):
                            continue
                    keys = mix(ngram_hashes(own, least)[at] ^ mix(hosts[lo + i : lo + i + 1].view(np.uint64)))
                    got.append((keys.view(np.int64), np.full(len(at), pages[lo + i], np.int64), np.full(len(at), hosts[lo + i], np.int64), at.astype(np.int32), np.full(len(at), is_open[lo + i])))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], ["key", "page", "host", "pos", "open"])

    return run


def boilerplate(n_words: int, marked: bool, covered: np.ndarray, shared: np.ndarray, template: np.ndarray) -> bool:
    """Whether a block goes, from the words of it in runs of another page, of a third of the pages, and of nearly all pages."""
    hit = template if marked else shared if n_words >= LONG else covered
    return n_words > 0 and 2 * hit.sum() >= n_words


def _keep(least: int):
    """(page_id, url, marked, texts, pages of the host, places (pos, pages)) to (page_id, url, text, n_words, n_repeated, n_dropped)."""

    def run(batches):
        for batch in batches:
            out, words, repeated, dropped = [], [], [], []
            for marked, texts, total, places in zip(*[batch.column(i).to_pylist() for i in range(2, 6)]):
                n = [len(t.encode().split()) for t in texts]
                levels = np.zeros((3, sum(n) + 1), bool)
                ends = np.cumsum([0, *n])
                for p in places or ():
                    several, start, stop = p["pages"], p["pos"], p["pos"] + least
                    levels[0, start:stop] = True
                    levels[1, start:stop] |= several >= max(LONG_PAGES, LONG_SHARE * total)
                    levels[2, start:stop] |= several >= max(TEMPLATE_PAGES, TEMPLATE_SHARE * total)
                gone = [boilerplate(b - a, marked, *levels[:, a:b]) for a, b in zip(ends[:-1], ends[1:])]
                gone = [False] * len(gone) if all(gone) else gone
                out.append("\n".join(t for t, g in zip(texts, gone) if not g))
                words.append(sum(n))
                repeated.append(int(levels[0].sum()))
                dropped.append(sum(gone))
            counts = [pa.array(c, pa.int64()) for c in (words, repeated, dropped)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), *counts], ["page_id", "url", "text", "n_words", "n_repeated", "n_dropped"])

    return run


def extract(
    spark: SparkSession, pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 8
) -> DataFrame:
    """(page_id, url, text, n_words, n_repeated, n_dropped) per page: its main text, blocks in page order joined by a line feed, '' if there is none.

    n_words are the words of all blocks that may be text, n_repeated those in runs of ``least`` words that other pages
    of the host have too (on hosts whose pages all mark an article: those that so many pages have that they decide), n_dropped
    the blocks that went for it (boilerplate()). Pages of one text are one page there. Every place of every page is looked at.
    On hosts whose pages all mark an article a run counts only if TEMPLATE_PAGES and TEMPLATE_SHARE of the pages have it, and so
    each of its words; other runs are never sent. Hosts are told apart by their hash.
    Null and empty pages give ''. Pages of one id are rows of their own; pages without host share nothing. Hosts
    are lower-cased. Broken markup is read on; very long pages are one row. Extra columns are ignored.
    """
    bounded_batches(spark)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"://([^/?#]*)", 1), F.lit("")))
    own_host = F.when(host == "", F.xxhash64(html_col, url_col, F.lit(""))).otherwise(F.xxhash64(host))  # a page without host is a host
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), own_host.alias("host"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    split = rows.mapInArrow(_split, f"page_id {kind}, url string, host long, marked boolean, texts array<string>, n_words int")
    text = F.array_join("texts", "\n")
    split = kept(spark, split.withColumn("page", F.xxhash64(text)), "host_split", "zstd")
    own = split.where(f"n_words >= {least}")
    hosts = own.groupBy("host", "page").agg((~F.min("marked")).alias("open")).groupBy("host").agg(F.count("*").alias("total"), F.max("open").alias("open"))
    hosts = kept(spark, hosts, "hosts")
    enough = F.greatest(F.lit(TEMPLATE_PAGES), TEMPLATE_SHARE * F.col("total"))
    closed = hosts.where(f"not open and total >= {TEMPLATE_PAGES}").select("host", enough.alias("enough"))
    words = own.join(sized(closed), "host").select("host", text.cast("binary")).mapInArrow(_words, "host long, word int")
    words = words.groupBy("host", "word").agg(F.count("*").alias("n")).join(sized(closed), "host").where("n >= enough")
    words = words.groupBy("host").agg(F.collect_list("word").alias("words"))  # 2 to the power of WORD_BITS at most
    asked = hosts.where("open").select("host", "open", F.lit(None).cast("array<int>").alias("words")).union(words.select("host", F.lit(False), "words"))
    asked = kept(spark, asked, "host_words")
    stream = own.join(sized(asked, 20_000), "host").select("page", "host", "open", "words", text.cast("binary"))
    suffixes = kept(spark, stream.mapInArrow(_suffixes(least), "key long, page long, host long, pos int, open boolean"), "host_suffixes")
    common = suffixes.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("open")).where(f"n >= 2 and (open or n >= {TEMPLATE_PAGES})")
    common = kept(spark, common.select("key", "n"), "host_common")
    frequent = hot_keys(spark, common, "key")
    found = salted(suffixes, "key", frequent, ["page", "pos"]).join(spread(common.select("key"), "key", frequent), ["key", "_salt"])
    found = kept(spark, found.select("key", "page", "host", "pos").distinct(), "host_repeats")
    several = found.select("key", "page").distinct().groupBy("key").agg(F.count("*").alias("pages"))
    several = kept(spark, several.where("pages > 1"), "host_counts")
    places = salted(found, "key", frequent, ["page", "pos"]).join(spread(several, "key", frequent), ["key", "_salt"])
    places = places.join(sized(hosts.select("host", "total", F.col("open").alias("any"), enough.alias("enough"))), "host").where("any or pages >= enough")
    places = places.groupBy("host", "page", "total").agg(F.collect_list(F.struct("pos", "pages")).alias("places"))  # bounded by a page's words
    places = kept(spark, places, "host_places")
    rest = split.join(sized(places), ["host", "page"], "left").select("page_id", "url", "marked", "texts", "total", "places")
    return rest.mapInArrow(_keep(least), f"page_id {kind}, url string, text string, n_words long, n_repeated long, n_dropped long")

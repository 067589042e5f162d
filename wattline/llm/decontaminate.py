"""Benchmark decontamination with a positional inverted index.

The index holds, for each document, the posting lists (term, positions) of the terms that any test
item uses; it is stored as Parquet, sharded by document, so no posting ever crosses the network and a
very long document is one row. A query takes the windows of the test items, orders each window's terms
from the rarest in the corpus, starts from the posting list of the rarest, shifts it by the term's
offset, and intersects it with the shifted lists of the others until the phrase is complete.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import alnum_words, bounded_batches, kept, sized

INDEX = "doc_id long, row string, text_key long, n_words int, terms array<int>, counts array<int>, positions array<int>"
MATCHES = "doc_id long, row string, text_key long, n_words int, starts array<int>, ends array<int>, items array<long>"
#: Distinct terms of test items that one index may hold: they are broadcast.
TERMS = 2_000_000


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item_id, terms): each run of ``width`` words of each item; a shorter item, but not an empty one, is one."""

    def windows(batches):
        for batch in batches:
            ids, runs = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alnum_words(text)
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    ids.append(item)
                    runs.append(words[i : i + width])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(runs, pa.list_(pa.binary()))], ["item_id", "terms"]
            )

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.where("item_id is not null").mapInArrow(windows, "item_id long, terms array<binary>")


def text_key(text):
    """Tells texts apart, so that rows can be found again by it."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, text_key, text): each row of docs under a key of its own; fixed once it is written."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr("uuid()").alias("row"), text_key(text).alias("text_key"), text.cast("binary").alias("text"))


def build_index(spark: SparkSession, rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The posting lists of every keyed() document, restricted to the terms in ``vocabulary``, stored in the shared folder."""
    known = spark.sparkContext.broadcast(vocabulary)

    def post(batches):
        look = known.value.get
        for batch in batches:
            n_words, terms, counts, positions = [], [], [], []
            sizes, heads = [0], [0]
            for text in batch.column(3).to_pylist():
                words = alnum_words(text)
                ids = np.fromiter((look(w, -1) for w in words), np.int32, len(words))
                at = np.flatnonzero(ids >= 0)
                at = at[np.argsort(ids[at], kind="stable")]
                own, count = np.unique(ids[at], return_counts=True)
                n_words.append(len(words))
                terms.append(own)
                counts.append(count)
                positions.append(at)
                heads.append(heads[-1] + len(own))
                sizes.append(sizes[-1] + len(at))
            cat = lambda parts: pa.array(np.concatenate(parts).astype(np.int32) if parts else [], pa.int32())
            lists = lambda offsets, parts: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cat(parts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n_words, pa.int32()), lists(heads, terms), lists(heads, counts), lists(sizes, positions)],
                ["doc_id", "row", "text_key", "n_words", "terms", "counts", "positions"],
            )

    return kept(spark, rows.mapInArrow(post, INDEX), "postings")


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _intersect(order, size, offsets, terms, owner, by_rarest, first, slop):
    """A function over batches of the index. Windows are rows of ``terms``; ``order`` lists offsets from the rarest term."""

    def run(batches):
        for batch in batches:
            n_words = batch.column(3).to_numpy().astype(np.int64)
            sizes = batch.column(6).offsets.to_numpy().astype(np.int64)
            term, count, at = _flat(batch.column(4)), _flat(batch.column(5)), _flat(batch.column(6))
            gap = terms.shape[1] + 1 if len(terms) else 1
            base = np.concatenate([[0], np.cumsum(n_words + gap)])
            doc_of = np.repeat(np.arange(len(n_words)), np.diff(sizes))
            place = at + base[doc_of]  # positions of all documents of the batch on one line, with gaps between
            posted = np.repeat(term, count)
            found = []
            anchors = np.flatnonzero(first[posted + 1] < first[posted + 2]) if len(posted) else np.zeros(0, np.int64)
            many = (first[posted[anchors] + 2] - first[posted[anchors] + 1]) if len(anchors) else np.zeros(0, np.int64)
            line = np.full(base[-1] + gap, -1, np.int64)
            line[place] = posted
            keys = np.sort(posted * (len(line) + 1) + place) if slop else None
            for lo in range(0, len(anchors), 200_000):  # so that the candidates of a block stay small
                a, m = anchors[lo : lo + 200_000], many[lo : lo + 200_000]
                within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                window = by_rarest[np.repeat(first[posted[a] + 1], m) + within]
                doc, spot = np.repeat(doc_of[a], m), np.repeat(place[a], m)
                if slop:
                    found.append(_near(window, doc, spot, order, size, terms, keys, len(line) + 1, base, n_words, slop))
                    continue
                start = spot - offsets[order[window, 0]]
                ok = (start >= base[doc]) & (start + size[window] <= base[doc] + n_words[doc])
                window, doc, start = window[ok], doc[ok], start[ok]
                for j in range(1, terms.shape[1]):
                    off = order[window, j]
                    ok = (off < 0) | (line[start + np.maximum(off, 0)] == terms[window, np.maximum(off, 0)])
                    window, doc, start = window[ok], doc[ok], start[ok]
                found.append((window, doc, start, start + size[window]))
            window, doc, start, end = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
            spans = np.unique(np.stack([doc, start, end], 1), axis=0) if len(doc) else np.zeros((0, 3), np.int64)
            items = np.unique(np.stack([doc, owner[window]], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            cut = lambda x: pa.array(np.searchsorted(x[:, 0], np.arange(len(n_words) + 1)), pa.int32())
            local = lambda x: pa.array((x - base[spans[:, 0]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.ListArray.from_arrays(cut(spans), local(spans[:, 1])),
                    pa.ListArray.from_arrays(cut(spans), local(spans[:, 2])),
                    pa.ListArray.from_arrays(cut(items), pa.array(items[:, 1])),
                ],
                ["doc_id", "row", "text_key", "n_words", "starts", "ends", "items"],
            )

    return run


def _near(window, doc, spot, order, size, terms, keys, width, base, n_words, slop):
    """Windows whose terms follow one another with at most ``slop`` other words between, around a rarest term at ``spot``."""
    low = np.maximum(spot - order[window, 0] - slop, base[doc])
    starts, kept_from = [], []
    for shift in range(slop + 1):  # every start that can reach the rarest term
        s = low + shift
        ok = s + size[window] <= base[doc] + n_words[doc]
        starts.append(s[ok])
        kept_from.append(np.flatnonzero(ok))
    start, rows = np.concatenate(starts), np.concatenate(kept_from)
    window, doc = window[rows], doc[rows]
    at = start - 1
    for j in range(terms.shape[1]):
        live = terms[window, j] >= 0
        want = terms[window, j] * width + at + 1
        i = np.searchsorted(keys, want)
        hit = keys[np.minimum(i, len(keys) - 1)]
        nxt = hit - terms[window, j] * width
        ok = ~live | ((i < len(keys)) & (hit // width == terms[window, j]) & (nxt < base[doc] + n_words[doc]))
        if j == 0:
            ok &= nxt == start
        at = np.where(live, nxt, at)
        window, doc, start, at = window[ok], doc[ok], start[ok], at[ok]
    ok = at + 1 - start <= size[window] + slop
    return window[ok], doc[ok], start[ok], at[ok] + 1


def find_matches(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    slop: int = 0,
    block: int = 200_000,
) -> DataFrame:
    """(doc_id, row, text_key, n_words, starts, ends, items) per row of docs: where windows of the test items occur.

    slop 0 gives exact phrases; slop s gives the window's terms in order with at most s other words
    between. starts and ends are word positions (end exclusive), sorted, without repeats; items are the
    ids whose windows occur, sorted. Distinct windows are taken in blocks of about ``block``, dealt by their words, so that
    a huge item is many blocks: the bound of what is broadcast. The documents are indexed once for all blocks while the
    items have at most TERMS distinct terms, else once for each block. Null or empty texts have no words and no
    matches; items without words or without id never match; repeated items count once; repeated
    documents, and those without id, give a row each. Ids are whole numbers, others fail. Extra columns are ignored.
    """
    bounded_batches(spark)
    windows = kept(spark, item_windows(items, item_id, item_text, width).distinct(), "windows")
    n = windows.count()
    blocks = max(1, -(-n // block))
    terms_of = windows.select(F.explode("terms").alias("term")).distinct()
    once = terms_of.limit(TERMS + 1).count() <= TERMS
    keys = keyed(docs, doc_id, doc_text)
    if once:
        vocabulary = {t: i for i, t in enumerate(sorted(bytes(r.term) for r in terms_of.collect()))}
        index = build_index(spark, keys, vocabulary)
    else:
        keys = kept(spark, keys, "keyed")
    parts = []
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == b).collect()
        if not once:
            vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
            index = build_index(spark, keys, vocabulary)
        seen = np.zeros(len(vocabulary), np.int64)
        df = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("x.*")
        for r in df.groupBy("terms").agg(F.sum("counts").alias("n")).collect():  # a row for each term of the block
            seen[r.terms] = r.n
        rows = [(r.item_id, [vocabulary[bytes(t)] for t in r.terms]) for r in rows]
        rows = [r for r in rows if all(seen[t] for t in r[1])]  # a term that the corpus lacks rules its window out
        wide = max((len(t) for _, t in rows), default=1)
        terms = np.full((len(rows), wide), -1, np.int64)
        order = np.full((len(rows), wide), -1, np.int64)
        for i, (_, t) in enumerate(rows):
            terms[i, : len(t)] = t
            order[i, : len(t)] = np.argsort(seen[t], kind="stable")
        size = np.array([len(t) for _, t in rows], np.int64)
        owner = np.array([i for i, _ in rows], np.int64)
        rarest = terms[np.arange(len(rows)), order[:, 0]] if rows else np.zeros(0, np.int64)
        by_rarest = np.argsort(rarest, kind="stable")
        first = np.concatenate([[0], np.searchsorted(rarest[by_rarest], np.arange(len(vocabulary) + 1))])
        parts.append(index.mapInArrow(_intersect(order, size, np.arange(wide + 1), terms, owner, by_rarest, first, slop), MATCHES))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    spans = F.array_distinct(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))))
    firsts = [F.first(c).alias(c) for c in ("doc_id", "text_key", "n_words")]
    items = F.array_distinct(F.array_sort(F.flatten(F.collect_list("items"))))
    every = every.groupBy("row").agg(*firsts, spans.alias("s"), items.alias("items"))  # a row for each block
    return every.select("doc_id", "row", "text_key", "n_words", "s.starts", "s.ends", "items")


def hit_words(matches: DataFrame) -> DataFrame:
    """matches with n_hit: the words inside any match (spans are sorted by start; overlaps count once)."""
    step = lambda acc, s: F.struct(
        (acc.n + F.greatest(F.lit(0), s.ends - F.greatest(s.starts, acc.till))).cast("int").alias("n"),
        F.greatest(acc.till, s.ends).alias("till"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("till"))
    return matches.withColumn("n_hit", F.aggregate(F.arrays_zip("starts", "ends"), zero, step, lambda acc: acc.n))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items and contaminated. Options as for find_matches."""
    return hit_words(find_matches(spark, docs, items, **options)).select(
        "doc_id",
        "text_key",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "starts",
        "ends",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, *, doc_text: str = "text", **options) -> DataFrame:
    """docs without the rows in whose text a window of any item occurs, whatever their ids. Options as for find_matches."""
    found = contamination(spark, docs, items, doc_text=doc_text, **options).where("contaminated")
    gone = kept(spark, found.select("text_key").distinct(), "contaminated")
    return docs.join(sized(gone), text_key(docs[doc_text]) == gone["text_key"], "left_anti")

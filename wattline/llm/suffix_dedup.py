"""Removal of long passages that repeat across documents, by sparse suffix arrays.

Of all suffixes of all documents only those are retained that start where a k-gram of words is the
smallest of a window (a minimiser): places that depend on the words around them alone, so every copy of
a passage retains the same ones. A passage of the least length that counts has k-grams for one window;
it belongs to the first smallest of them, so each passage of a document belongs to one retained suffix,
and those of one suffix stand one word apart: together they are its stretch. Retained suffixes are
grouped by their k-gram; in a group, equal stretches have the same passages, and different ones are
compared passage by passage. No source is picked beforehand, so none that has the passage is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import GOLDEN, bounded_batches, hashed_words, kept, mix, ngram_hashes, sized, unused


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every run of ``width`` values, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


_INVERSE = np.uint64(pow(int(GOLDEN), -1, 1 << 64))


class _Ranges:
    """Hashes of any ranges of words, from running sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(np.full(n, GOLDEN, np.uint64)))])
            self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64))])

    def __call__(self, start: np.ndarray, n) -> np.ndarray:
        with np.errstate(over="ignore"):
            found = (self.sums[start + n] - self.sums[start]) * self.back[start]
            return mix(found + np.asarray(n).astype(np.uint64)).view(np.int64)


def stretches(hashes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and k-gram hash of the stretches of a text of at least one window."""
    h = ngram_hashes(hashes, gram)
    least = _slide(h, window, np.minimum)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])  # a smaller one came in, or the first smallest went out
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(least))) + gram + window - 2, least[first]


def _suffixes(gram: int, window: int):
    """(doc, text) to (key, stretch, doc, start, n)."""

    def run(batches):
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for lo, _, _, bounds, hashes, _ in hashed_words(batch.column(1), lower=False):
                ranges = _Ranges(hashes)
                got = []
                for i in np.flatnonzero(np.diff(bounds) >= gram + window - 1):
                    first, n, key = stretches(hashes[bounds[i] : bounds[i + 1]], gram, window)
                    whole = ranges(bounds[i] + first, n)
                    got.append((key.view(np.int64), whole, np.full(len(n), docs[lo + i], np.int64), first.astype(np.int32), n.astype(np.int32)))
                if got:
                    arrays = [pa.array(np.concatenate(x)) for x in zip(*got)]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "stretch", "doc", "start", "n"])

    return run


def _own(lists: pa.ListArray, i: int, names) -> list[np.ndarray]:
    return [lists[i].values.field(name).to_numpy(zero_copy_only=False) for name in names]


def _passages(least: int):
    """(src, text, places: array<struct<start, n, stretch>>) to (passage, stretch, src, at) of each passage of these stretches."""

    def run(batches):
        for batch in batches:
            docs, lists = batch.column(0).to_numpy(), batch.column(2)
            for lo, _, _, bounds, hashes, _ in hashed_words(batch.column(1), lower=False):
                ranges = _Ranges(hashes)
                got = []
                for i in range(len(bounds) - 1):
                    start, n, stretch = _own(lists, lo + i, ("start", "n", "stretch"))
                    start, n, stretch = _standing(ranges, bounds[i], bounds[i + 1], start, n, stretch)
                    each = n - least + 1
                    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    found = ranges(np.repeat(start, each) + at, least)
                    got.append((found, np.repeat(stretch, each), np.full(len(at), docs[lo + i], np.int64), at.astype(np.int32)))
                arrays = [pa.array(np.concatenate(x)) for x in zip(*got)]
                yield pa.RecordBatch.from_arrays(arrays, ["passage", "stretch", "src", "at"])

    return run


def _standing(ranges: _Ranges, lo: int, hi: int, start: np.ndarray, n: np.ndarray, stretch: np.ndarray, *more: np.ndarray):
    """These stretches, start counted from the slice, without those that another row of the same id has there."""
    start = start.astype(np.int64) + lo
    inside = start + n <= hi
    inside[inside] = ranges(start[inside], n[inside]) == stretch[inside]
    return tuple(x[inside] for x in (start, n, stretch, *more))


def _cut(text_at: int, found_at: int, least: int, window: int):
    """Drops the words of the passages found in each document, and reports them."""

    def spans(ranges, lo, hi, start, n, stretch, mask):
        start, n, _, mask = _standing(ranges, lo, hi, start, n, stretch, mask)
        at = np.arange(window)
        hit = ((mask[:, None] >> at) & 1).astype(bool) & (at <= n[:, None] - least)
        places = np.unique((start[:, None] - lo + at)[hit])
        if not len(places):
            return []
        gap = np.flatnonzero(np.diff(places) > least)
        return list(zip(places[np.append(0, gap + 1)].tolist(), (places[np.append(gap, len(places) - 1)] + least).tolist()))

    def run(batches):
        for batch in batches:
            lists = batch.column(found_at)
            column = batch.column(text_at).cast(pa.binary())
            texts, n_words, cuts = [], [], []
            for lo, starts, _, bounds, hashes, at in hashed_words(column, lower=False):
                ranges = _Ranges(hashes)
                for i in range(len(bounds) - 1):
                    text = column[lo + i].as_py() or b""
                    found = []
                    if lists[lo + i].is_valid:
                        found = spans(ranges, bounds[i], bounds[i + 1], *_own(lists, lo + i, ("start", "n", "stretch", "mask")))
                    if found:
                        places = np.append(starts[bounds[i] : bounds[i + 1]] - at[i], len(text))
                        keep, last = [], 0
                        for a, b in found:
                            keep.append(text[last : places[a]])
                            last = places[b]
                        text = b"".join([*keep, text[last:]])
                    texts.append(text)
                    n_words.append(int(bounds[i + 1] - bounds[i]))
                    cuts.append([{"start": a, "stop": b} for a, b in found])
            missing = column.is_null().to_numpy(zero_copy_only=False)
            new = pa.array([None if m else t for t, m in zip(texts, missing)], pa.binary()).cast(pa.string())
            columns = [new if i == text_at else batch.column(i) for i in range(batch.num_columns) if i != found_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != found_at]
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words, pa.int32()), pa.array(cuts, span)], [*names, "repeat_n_words", "repeat_spans"]
            )

    return run


def _with_each(rows: DataFrame, single: DataFrame, key: str) -> DataFrame:
    """rows joined with the row of their key in single, by one way at every size: a sort-merge join, of which Spark splits the large partitions."""
    return rows.join(single.hint("merge"), key)


def remove_repeats(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50, gram: int = 30
) -> DataFrame:
    """docs with text_col freed of passages of ``least`` words or more that stand in a document of a smaller id too.

    Words stand between ASCII white space and match exactly. Columns repeat_n_words (words before) and
    repeat_spans (the cut words, start and stop) are added; the first document that has a passage keeps it,
    repeats within one document stay. Columns of those names are replaced. Ids that are no whole numbers fail. A cut takes the white space after it along. Null texts stay null
    without words; empty, short and unique texts stay as they are; a copied text becomes empty, its row
    stays; rows without id are neither sources nor cut. Rows that repeat an id count as one document.
    """
    bounded_batches(spark)
    docs = docs.drop("repeat_n_words", "repeat_spans")
    gram = max(gram, least - 61)  # a stretch has at most ``window`` passages, one bit each
    window = least - gram + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text")).where("doc is not null")
    suffixes = kept(spark, rows.mapInArrow(_suffixes(gram, window), "key long, stretch long, doc long, start int, n int"), "suffixes")
    keys = suffixes.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), (F.min("stretch") < F.max("stretch")).alias("mixed"))
    keys = kept(spark, keys.where("lo < hi").select("key", "mixed"), "keys")
    shared = kept(spark, _with_each(suffixes, keys, "key"), "shared")
    alike = shared.groupBy("stretch", "mixed").agg(F.min(F.struct("doc", "start", "n")).alias("least"), F.max("doc").alias("top"))
    alike = kept(spark, alike.select("stretch", "mixed", F.col("least.doc").alias("src"), "least.start", "least.n", "top"), "alike")
    # Stretches that share a k-gram but not all words: their passages one by one, each stretch once.
    todo = alike.where("mixed").groupBy("src").agg(F.collect_list(F.struct("start", "n", "stretch")).alias("places"))  # bounded by the document's length
    todo = kept(spark, todo, "todo")
    text = rows.withColumnRenamed("doc", "src").join(todo, "src").select("src", "text", "places")
    passages = kept(spark, text.mapInArrow(_passages(least), "passage long, stretch long, src long, at int"), "passages")
    first = passages.groupBy("passage").agg(F.min("src").alias("lo"), F.max("src").alias("hi")).where("lo < hi").select("passage", "lo")
    first = kept(spark, first, "first")
    late = passages.join(sized(first), "passage").where("src > lo").groupBy("stretch").agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"))
    late = kept(spark, late, "late")
    # The first document of a stretch loses the passages that stand in a smaller one by another stretch; later ones lose it all.
    source = alike.join(sized(late), "stretch", "left").where("top > src or mask is not null").select("stretch", "src", F.coalesce("mask", F.lit(0)).alias("some"))
    source = kept(spark, source, "source")
    found = _with_each(shared, source, "stretch").select("doc", "start", "n", "stretch", F.expr("if(doc > src, -1L, some)").alias("mask")).where("mask <> 0")
    of, spans = unused(docs, "_repeat_doc", "_repeat_found")
    per_doc = found.groupBy(F.col("doc").alias(of)).agg(F.collect_list(F.struct("start", "n", "stretch", "mask")).alias(spans))
    per_doc = kept(spark, per_doc, "per_doc")
    joined = docs.join(per_doc, docs[id_col].cast("long") == per_doc[of], "left").drop(of)
    text_at, found_at = joined.columns.index(text_col), len(joined.columns) - 1
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("repeat_n_words", T.IntegerType()),
         T.StructField("repeat_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))]
    )
    return joined.mapInArrow(_cut(text_at, found_at, least, window), schema)

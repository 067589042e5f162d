"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon hits (words and word beginnings whose presence marks the
label in the training rows), hits near a second person, capitals, punctuation, and obfuscated spelling.
The lexicon is mined on one half of the training rows for the other half, so that the trees see hits
as they are on new texts; for scoring, both halves are mined together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import LETTERS, bounded_batches, hashed_words, kept, raw_bytes, slices

#: Second person in the languages of the corpus.
YOU = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tus su sus ti"
#: Lengths in bytes of the word beginnings that are terms beside whole words.
HEADS = (4, 5, 6, 7)
FEATURES = 15
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_MASK = np.isin(np.arange(256), list(b"0123456789@$!|*._-"))
_PUNCT = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])
_LOUD = np.isin(np.arange(256), list(b"!?"))


def _terms(column: pa.Array):
    """For slices of lower-cased texts: (first row, word bounds of the rows, row of each word, [hashes of words, of their heads])."""
    for lo, _, _, bounds, hashes, _, heads in hashed_words(column, False, LETTERS, HEADS):
        yield lo, bounds, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), [hashes, *heads]


def _you() -> np.ndarray:
    return next(iter(_terms(pa.array([YOU.encode()], pa.binary()))))[3][0]


def _count(batches):
    """(half, toxic, lower-cased text) to the documents that have each term, summed up within some texts; term 0 counts documents."""

    def summed(kinds):
        where, term = (np.concatenate(x) for x in zip(*kinds))
        n = pd.DataFrame({"cell": where, "term": term.view(np.int64)}).groupby(["cell", "term"], sort=False).size().reset_index(name="n")
        half, toxic = (n["cell"] // 2).to_numpy(np.int32), (n["cell"] % 2).to_numpy(np.int32)
        arrays = [pa.array(half), pa.array(toxic), pa.array(n["term"].to_numpy()), pa.array(n["n"].to_numpy(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, ["half", "toxic", "term", "n"])

    for batch in batches:
        cell = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
        kinds, held = [(cell, np.zeros(len(cell), np.uint64))], 0
        for lo, _, row, terms in _terms(batch.column(2)):
            for h in terms:
                own = pd.DataFrame({"row": row[h != 0], "term": h[h != 0]}).drop_duplicates()
                kinds.append((cell[lo + own["row"].to_numpy()], own["term"].to_numpy()))
                held += len(own)
            if held > 2_000_000:
                yield summed(kinds)
                kinds, held = [], 0
        if kinds:
            yield summed(kinds)


def lexicon(counts: DataFrame, halves: tuple[int, ...], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-odds of up to ``most`` terms that mark the label, from the counts of some halves of the rows."""
    none = np.zeros(0, np.uint64), np.zeros(0)
    c = counts.where(F.col("half").isin(list(halves)))
    c = c.groupBy("term").agg(F.sum(F.col("n") * F.col("toxic")).alias("pos"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("neg"))
    total = c.where("term = 0").first()
    if total is None or not total.pos or not total.neg:
        return none
    odds = F.log(((F.col("pos") + 0.25) / total.pos) / ((F.col("neg") + 0.25) / total.neg))
    c = c.where("term <> 0").withColumn("odds", odds).where("pos >= 3 and odds >= 2")
    rows = c.orderBy(F.desc(F.col("pos") * F.col("odds")), "term").limit(most).collect()
    if not rows:
        return none
    terms = np.array([r.term for r in rows], np.int64).view(np.uint64)
    order = np.argsort(terms)
    return terms[order], np.array([r.odds for r in rows], float)[order]


def _look(lex, h: np.ndarray) -> np.ndarray:
    terms, odds = lex
    if not len(terms):
        return np.zeros(len(h))
    i = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[i] == h, odds[i], 0.0)


def _rates(column: pa.Array) -> np.ndarray:
    """Bytes, capitals, punctuation, shouts and masked letters of each text."""
    data, offsets = raw_bytes(column)
    out = np.zeros((len(column), 5))
    for lo, hi in slices(offsets, 1 << 18):  # so that what is held for each byte stays small
        raw = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        letter = LETTERS[raw] | _UPPER[raw]
        masked = np.zeros(len(raw), bool)
        masked[1:-1] = letter[:-2] & _MASK[raw[1:-1]] & letter[2:] if len(raw) > 2 else False
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])  # noqa: B023, E731
        out[lo:hi] = np.stack([np.diff(at), sums(_UPPER[raw]), sums(_PUNCT[raw]), sums(_LOUD[raw]), sums(masked)], 1)
    return out


def features(text: pa.Array, lower: pa.Array, lexes, which: np.ndarray) -> np.ndarray:
    """Dense features of each whole text (bytes, and lower-cased bytes), by the lexicon of number ``which``; zeros for empty texts."""
    out = np.zeros((len(text), FEATURES))
    you = _you()
    for lo, bounds, row, terms in _terms(lower):
        rows = len(bounds) - 1
        n = np.maximum(np.diff(bounds), 1)
        odds = np.zeros((2, len(row)))
        for i, lex in enumerate(lexes):
            at = which[lo + row] == i
            odds[0, at] = _look(lex, terms[0][at])
            odds[1, at] = np.max([_look(lex, h[at]) for h in terms[1:]], axis=0)
        count = lambda weights: np.bincount(row, weights, rows)
        whole, heads = count(odds[0] > 0), count(odds[1] > 0)
        hit = np.flatnonzero(odds.max(0))
        best = np.zeros(rows)
        np.maximum.at(best, row[hit], odds[:, hit].max(0))
        kinds = pd.DataFrame({"row": row[hit], "term": terms[0][hit]}).drop_duplicates()["row"].to_numpy()
        place = np.arange(len(row)) + row * 100  # texts stand apart
        second = place[np.isin(terms[0], you)]
        near = np.zeros(rows)
        if len(second) and len(hit):
            j = np.searchsorted(second, place[hit])
            gap = np.minimum(np.abs(second[np.minimum(j, len(second) - 1)] - place[hit]), np.abs(second[np.maximum(j - 1, 0)] - place[hit]))
            near = np.bincount(row[hit], gap <= 5, rows)
        out[lo : lo + rows, :11] = np.stack(
            [whole / n, np.log1p(whole), count(odds[0]) / n, heads / n, np.log1p(heads), count(odds[1]) / n, best,
             np.bincount(kinds, minlength=rows), near / n, np.log1p(near), np.log1p(np.diff(bounds))], 1
        )
    rates = _rates(text)
    out[:, 11:15] = rates[:, 1:] / np.maximum(rates[:, :1], 1)
    return out


def _features(lexes, column, which=None):
    """A column of features by the lexicon of number ``which`` (a column), or by the only one."""

    @F.arrow_udf("array<double>")
    def of(text: pa.Array, lower: pa.Array, nr: pa.Array) -> pa.Array:
        x = features(text, lower, lexes.value, nr.to_numpy())
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))

    return of(column.cast("binary"), F.lower(column).cast("binary"), F.lit(0) if which is None else which)


def score(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "toxic",
    sample: int = 20_000,
    terms: int = 4_000,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs; with carry, docs with those columns added (or replaced).

    Trained on at most ``sample`` labelled rows, those of the smallest hashes, whose crc32(id as text) mod 5
    is not 0; of these, remainder 1 calibrates, the rest grows the trees. ``terms`` bounds the lexicon. Every
    document is scored on its whole text. Null and empty texts have features of zero and get a score like
    others; labels that are null, or whose document is missing, teach nothing; repeated labels count as one (toxic if any
    is). Where no label or only one kind is left to learn from, the score is the share of label 1 (0 without
    labels). Rows without id are scored and not held out.
    """
    bounded_batches(spark)
    name = F.col(id_col)
    fold = F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(5))
    known = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(label_id).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    known = known.withColumn("_fold", fold.cast("int")).where("_fold <> 0").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(name.alias("_id"), F.col(text_col).alias("_text"))
    # At most ``sample`` narrow rows are broadcast.
    rows = texts.join(F.broadcast(known), "_id").select((F.col("_fold") % 2).cast("int").alias("half"), "_fold", "_toxic", "_text")
    rows = kept(spark, rows, "labelled")
    counts = rows.select("half", "_toxic", F.lower("_text").cast("binary")).mapInArrow(_count, "half int, toxic int, term long, n long")
    counts = kept(spark, counts.groupBy("half", "toxic", "term").agg(F.sum("n").alias("n")), "terms")
    cross = spark.sparkContext.broadcast([lexicon(counts, (1,), terms), lexicon(counts, (0,), terms)])  # by the half of the row
    both = spark.sparkContext.broadcast([lexicon(counts, (0, 1), terms)])
    train = rows.select("_fold", F.col("_toxic").cast("double").alias("label"), _features(cross, F.col("_text"), F.col("half")).alias("x"))
    train = kept(spark, train, "features")
    seen = {(r["cal"], r["label"]): r["n"] for r in train.groupBy((F.col("_fold") == 1).alias("cal"), "label").agg(F.count("*").alias("n")).collect()}
    # The rows as they are stand apart from what the models add, whatever their columns are called.
    out = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), _features(both, F.col(text_col)).alias("_x"))
    if seen.get((False, 1.0), 0) and seen.get((False, 0.0), 0):
        train = train.select("_fold", "label", array_to_vector("x").alias("features")).repartition(4).cache()
        trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.25, minInstancesPerNode=5, seed=7).fit(train.where("_fold <> 1"))
        margin = vector_to_array("rawPrediction")[1]
        held = trees.transform(train).where("_fold = 1").select("label", margin.alias("margin"))
        train.unpersist()
        out = trees.transform(out.withColumn("features", array_to_vector("_x")))
        if seen.get((True, 1.0), 0) and seen.get((True, 0.0), 0):
            iso = IsotonicRegression(featuresCol="margin", predictionCol="_score").fit(held)
            out = iso.transform(out.withColumn("margin", margin))
        else:
            out = out.withColumn("_score", vector_to_array("probability")[1])
    else:
        ones, all_ = sum(n for (_, y), n in seen.items() if y), sum(seen.values())
        out = out.withColumn("_score", F.lit(ones / all_ if all_ else 0.0))
    own_id = F.col("_row")[id_col]
    held_out = F.coalesce(F.pmod(F.crc32(own_id.cast("string")), F.lit(5)) == 0, F.lit(False)).alias("held_out")
    result = F.least(F.greatest(F.col("_score"), F.lit(0.0)), F.lit(1.0))
    added = ("held_out", "score", "predicted")
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in added] if carry else [own_id.alias("doc_id")]
    return out.select(*own, held_out, result.alias("score"), (result >= 0.5).cast("int").alias("predicted"))

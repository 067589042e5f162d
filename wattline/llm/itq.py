"""Embedding near-duplicates by iterative quantisation.

Rotations of the principal axes, learned on a bounded sample, turn each vector into balanced binary codes. Codes are
cut into chunks, one Hamming table for each, in which two vectors meet when their chunks are equal. How many tables there
are, and how wide, is worked out from the data: chunks grow with the logarithm of the number of vectors, and tables
are added until pairs made at the bound of the cosine (sampled vectors, moved in directions in which the data
spreads) meet in at least one of them. What meets within a Hamming bound is reranked by the cosine of the original
vectors in double precision. Buckets of many vectors are compared as matrices inside tasks, which send counts and a
spanning set of links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .text import GOLDEN, bounded_batches, hot_keys, kept, mix, salted, sized, spread, whole_groups

#: Vectors of a bucket that are paired by a join; larger buckets are compared in tiles of so many inside tasks.
TILE = 256
#: Rounds of learning of the first rotation, and of the others, which are to differ from it.
ROUNDS = 50, 4


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 50, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors x: principal axes turned so that signs lose least (bits is at most the dimension)."""
    mean = x.mean(0)
    _, axes = np.linalg.eigh(np.cov(x - mean, rowvar=False, bias=True).reshape(x.shape[1], x.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return mean, axes @ r


def _packed(signs: np.ndarray, width: int) -> np.ndarray:
    """A number for each ``width`` signs."""
    parts = signs.reshape(len(signs), -1, width).astype(np.uint64)
    return (parts << np.arange(width, dtype=np.uint64)).sum(2, dtype=np.uint64)


class Codes:
    """Mean and projections of vectors of one dimension: ``tables`` chunks of ``width`` bits, and a code of 64 bits (or fewer)."""

    def __init__(self, mean: np.ndarray, projection: np.ndarray, width: int, tables: int, within: int):
        self.mean, self.projection, self.width, self.tables, self.within = mean, projection, width, tables, within

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, chunks) of unit vectors."""
        signs = (x - self.mean) @ self.projection >= 0
        code = np.zeros(len(x), np.uint64)
        for i in range(min(64, signs.shape[1])):
            code |= signs[:, i].astype(np.uint64) << np.uint64(i)
        return code, _packed(signs[:, : self.tables * self.width], self.width)


class Slabs:
    """Cells in which every pair at least so similar meets: no code, all certain.

    Unit vectors of a cosine c are at most sqrt(2 - 2c) apart, and no farther along any direction. Along each of some
    directions two grids of twice that width, one moved by half a cell, hold each such pair in a cell of one of them at
    least; the tables are all choices of a grid for each direction.
    """

    within = 64

    def __init__(self, x: np.ndarray, cosine: float, directions: int = 3):
        self.mean = x.mean(0)
        _, axes = np.linalg.eigh(np.cov(x - self.mean, rowvar=False, bias=True).reshape(x.shape[1], x.shape[1]))
        self.axes = axes[:, ::-1][:, :directions]
        self.width = 2 * (np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (x - self.mean) @ self.axes / self.width
        grids = np.stack([np.floor(at), np.floor(at + 0.5)]).astype(np.int64)  # (grid, vector, direction)
        k = at.shape[1]
        chunks = np.zeros((len(x), 1 << k), np.uint64)
        for table in range(1 << k):
            for d in range(k):  # at most 2 / 1e-9 cells a direction; a hash of all of them
                with np.errstate(over="ignore"):
                    chunks[:, table] = mix(chunks[:, table] * GOLDEN + grids[table >> d & 1, :, d].astype(np.uint64) + np.uint64(1))
        return np.zeros(len(x), np.uint64), chunks


def at_bound(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """A unit vector at the cosine of each of x, moved half the time towards where another vector lies, else anywhere."""
    away = np.where(rng.random((len(x), 1)) < 0.5, x[rng.permutation(len(x))] - x, rng.normal(size=x.shape))
    away -= (away * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    return np.where(size > 0, cosine * x + np.sqrt(1 - cosine * cosine) * away / np.where(size > 0, size, 1), x)


def learn_codes(x: np.ndarray, n: int, cosine: float, miss: float = 0.004, most: int = 512, seed: int = 11) -> Codes:
    """Codes for n vectors like the sampled x: tables are added until at most ``miss`` of the pairs at the bound meet in none.

    ``most`` tables end the search where the data lie so close together that hardly any code tells them apart.
    """
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    width = int(min(32, max(8, np.ceil(np.log2(max(n, 2))))))
    some = x[rng.integers(0, len(x), 2_000)]
    near = at_bound(some, min(cosine, 1.0), rng)
    projections, met, tables, mean = [], np.zeros(len(some), bool), 0, x.mean(0)
    signs_a, signs_b = np.zeros((len(some), 0), bool), np.zeros((len(some), 0), bool)
    while tables < most and (not tables or (~met).mean() > miss):
        while signs_a.shape[1] < (tables + 1) * width:
            _, p = learn_rotation(x, dim, ROUNDS[bool(projections)], seed + len(projections))
            projections.append(p)
            signs_a = np.hstack([signs_a, (some - mean) @ p >= 0])
            signs_b = np.hstack([signs_b, (near - mean) @ p >= 0])
        part = slice(tables * width, (tables + 1) * width)
        met |= (signs_a[:, part] == signs_b[:, part]).all(1)
        tables += 1
    apart = (signs_a[:, :64] != signs_b[:, :64]).sum(1)
    return Codes(mean, np.hstack(projections), width, tables, int(apart.max()) + 4)


def _first_met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first table in which the rows of two arrays of chunks are equal."""
    return (a == b).argmax(1)


def _tiles(cosine: float):
    """Sorted (label, dim, nr, chunk, t0, t1, class, rep, copies, side, v, chunks) to the links whose first table this is.

    Rows (0, class, other vectors linked) and (1, rep, rep) of links that span what is connected. side is the tile of a pair of
    tiles that a vector stands in, 2 if the tile meets itself.
    """

    def run(batches):
        for t in whole_groups(batches, 6):
            cols = [t.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *new], [*new, t.num_rows]):
                nr = int(cols[2][lo])
                cls, rep, copies, side = (t.column(i).slice(lo, hi - lo).to_numpy() for i in range(6, 10))
                v = np.stack(t.column(10).slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                chunks = np.stack(t.column(11).slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
                found, root = np.zeros(len(cls), np.int64), {}
                edges = []

                def top(i):
                    while root.get(i, i) != i:
                        root[i] = root.get(root[i], root[i])
                        i = root[i]
                    return i

                for start in range(0, len(left), 64):  # so that what is held stays small
                    l = left[start : start + 64]
                    i, j = np.nonzero(v[l] @ v[right].T >= cosine - 1e-9)
                    i, j = l[i], right[j]
                    ok = (i != j) & ((side[i] != 2) | (cls[i] < cls[j]))
                    i, j = i[ok], j[ok]
                    ok = (_first_met(chunks[i], chunks[j]) == nr) & (_dots(v[i], v[j]) >= cosine) if len(i) else np.zeros(0, bool)
                    i, j = i[ok], j[ok]
                    np.add.at(found, i, copies[j])
                    np.add.at(found, j, copies[i])
                    for a, b in zip(i.tolist(), j.tolist()):
                        a, b = top(a), top(b)
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            edges.append((rep[a], rep[b]))
                seen = np.flatnonzero(found)
                a = [*cls[seen].tolist(), *[int(x) for x, _ in edges]]
                b = [*found[seen].tolist(), *[int(y) for _, y in edges]]
                kind = [0] * len(seen) + [1] * len(edges)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    return run


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit vectors, added up in the order of their components, as SQL does."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def near_duplicates(
    spark: SparkSession,
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    sample: int = 20_000,
    tile: int = TILE,
    exact: bool = False,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row. Rows link if their labels are equal and not null and their cosine >= ``cosine``.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; so do vectors of
    another dimension than each other, and rows without id. Equal vectors of a label are one class from the start: their
    links are counted, not listed. The codes are fitted on the ``sample`` valid vectors of the smallest id hashes; every vector
    is indexed. A pair at the bound meets in no table with a chance of about 0.4 % (learn_codes), closer ones more
    rarely; with ``exact`` cells that no such pair can miss (Slabs) stand in for the codes, at the price of larger
    buckets. Repeated ids are rows that link like others (ids are whole numbers); empty tables give no rows; extra columns are ignored.
    """
    bounded_batches(spark)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = v.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    top = F.array_max(F.transform("v", F.abs))  # first scaled by the largest component, so that no square is lost or too large
    rows = rows.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    rows = rows.withColumn("v", F.when(F.col("fine"), F.transform("v", lambda x: x / top)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))))
    rows = rows.withColumn("class", F.when(F.col("fine"), F.xxhash64("label", "v", F.size("v"))))
    rows = kept(spark, rows, "vectors")
    good = rows.where("fine")
    classes = good.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = kept(spark, classes.withColumn("dim", F.size("v")).withColumn("group", F.xxhash64("label")), "vector_classes")

    learned = {}
    for r in classes.groupBy("dim").count().collect():  # one model for each dimension that occurs
        some = classes.where(F.col("dim") == r.dim).orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toArrow()
        x = some.column("v").combine_chunks().flatten().to_numpy().reshape(-1, r.dim)
        learned[r.dim] = Slabs(x, cosine) if exact else learn_codes(x, r["count"], cosine)
    model = spark.sparkContext.broadcast(learned)  # some rotations of dim by dim numbers for each dimension

    @F.pandas_udf("struct<code: long, chunks: array<long>>")
    def coded(v: pd.Series) -> pd.DataFrame:
        code, chunks = np.zeros(len(v), np.int64), [None] * len(v)
        dims = v.map(len).to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            c, parts = model.value[d](np.stack(v.iloc[at].to_list()))
            code[at] = c.view(np.int64)
            for i, p in zip(at, parts.view(np.int64)):
                chunks[i] = p
        return pd.DataFrame({"code": code, "chunks": chunks})

    codes = classes.select("class", "group", "dim", coded("v").alias("c")).select("class", "group", "dim", "c.*")
    codes = kept(spark, codes, "codes")
    within = F.coalesce(*[F.when(F.col("dim") == d, m.within) for d, m in learned.items()], F.lit(0)) if learned else F.lit(0)
    index = codes.select("group", "dim", "class", "code", "chunks", F.posexplode("chunks").alias("nr", "chunk"))
    bucket = ["group", "dim", "nr", "chunk"]
    index = index.withColumn("bucket", F.xxhash64(*bucket))
    sizes = index.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    sizes = kept(spark, sizes, "bucket_sizes")
    large = kept(spark, sizes.where(F.col("size") > tile), "large_buckets")  # at most one for each ``tile`` rows of the index

    # Small buckets: candidates by a join, once for each pair, in the first table in which it meets.
    small = sizes.where(F.col("size") <= tile).select("bucket")
    member = index.join(small, "bucket").select("bucket", *bucket, "class", "code", "chunks")
    other = member.select("bucket", F.col("group").alias("group_o"), F.col("dim").alias("dim_o"), F.col("nr").alias("nr_o"), F.col("chunk").alias("chunk_o"), F.col("class").alias("other"), F.col("code").alias("code_o"), F.col("chunks").alias("chunks_o"))
    same = (F.col("group") == F.col("group_o")) & (F.col("dim") == F.col("dim_o")) & (F.col("nr") == F.col("nr_o")) & (F.col("chunk") == F.col("chunk_o"))
    first = F.array_position(F.zip_with("chunks", "chunks_o", lambda x, y: x == y), True) - 1
    close = F.bit_count(F.col("code").bitwiseXOR(F.col("code_o"))) <= within
    pairs = member.join(other, "bucket").where((F.col("class") < F.col("other")) & same & close & (first == F.col("nr")))
    pairs = kept(spark, pairs.select("class", "other"), "near_codes")
    side = lambda a, b: classes.select(F.col("class").alias(a), F.col("v").alias(b), F.col("rep").alias(f"rep_{b}"), F.col("copies").alias(f"copies_{b}"))
    full = pairs.join(side("class", "v"), "class").join(side("other", "w"), "other")
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    links = kept(spark, full.where(dot >= cosine).select("class", "other", "rep_v", "rep_w", "copies_v", "copies_w"), "cosine_links")

    # Large buckets: tiles against tiles inside tasks.
    tiles = F.ceil(F.col("size") / tile).cast("int")
    dense = index.join(sized(large), "bucket").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("class", "nr"), "tiles").cast("int"))
    dense = dense.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dense = dense.select(
        *bucket,
        F.least("tile", "meets").alias("t0"),
        F.greatest("tile", "meets").alias("t1"),
        "class",
        "chunks",
        F.when(F.col("tile") == F.col("meets"), 2).when(F.col("tile") < F.col("meets"), 0).otherwise(1).alias("side"),
    )
    six = [*bucket, "t0", "t1"]
    dense = dense.join(classes.select("class", "rep", "copies", "v"), "class").select(*six, "class", "rep", "copies", "side", "v", "chunks")
    inside = dense.repartition(*six).sortWithinPartitions(*six).mapInArrow(_tiles(cosine), "kind byte, a long, b long")
    inside = kept(spark, inside, "dense_links")

    counts = links.select(F.col("class"), F.col("copies_w").alias("n")).union(links.select("other", "copies_v")).union(inside.where("kind = 0").select("a", "b"))
    others = counts.groupBy("class").agg(F.sum("n").alias("others"))
    edges = links.select(F.col("rep_v").alias("a"), F.col("rep_w").alias("b")).union(inside.where("kind = 1").select("a", "b"))
    group = components(spark, edges)
    of_class = classes.join(others, "class", "left").join(group, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("class", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    of_class = kept(spark, of_class, "class_groups")
    copied = hot_keys(spark, of_class, "class", "copies")
    out = salted(rows.where("fine").select("id", "class"), "class", copied, ["id"])
    out = out.join(spread(of_class, "class", copied), ["class", "_salt"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))

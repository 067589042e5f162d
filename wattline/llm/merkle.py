"""A Merkle manifest of a table: a leaf for each row, a tree for each group, and one over the groups' roots.

Rows get their place in their group without a window over it: by a range partitioning, and by the counts of
its partitions. ``SIZE`` consecutive nodes are an aligned block, which keeps each level of its part of the
tree as one string of fixed-width hex digests; parents are hashes of substrings of the level below. The
blocks' last digests are the nodes of the next tier, until each group has one block. Going down again, the
substrings beside a node's own are its siblings; those of all tiers, one after the other, are its proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import kept, sized

#: Levels of a block, and its nodes.
DEPTH = 8
SIZE = 1 << DEPTH
#: Hex digits of a digest.
WIDE = 64


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def placed(spark: SparkSession, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, which have a group g, with their rank in it by these columns (from 0) and the group's total.

    Equal ranges may come to be in several partitions of one group; a partition's row numbers, and the counts of those
    before it, make the ranks. The counts have a row for each partition and each group in it.
    """
    by = ["g", *order]
    rows = kept(spark, rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("nr", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("nr", 33).alias("part")
    parts = rows.groupBy("g", part).agg(F.min("nr").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = kept(spark, parts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total")), "parts")
    return rows.withColumn("part", part).join(sized(parts), ["g", "part"]).withColumn("rank", F.col("nr") + F.col("shift")).drop("nr", "part", "shift")


def _levels() -> Column:
    """All levels of a block from its nodes; in a group of one block as many as its nodes need, else all of a full block."""
    depth = F.when(F.col("total") > SIZE, DEPTH).when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0)
    nodes = F.array_join(F.transform("nodes", lambda x: x.digest), "")

    def parents(level):
        pairs = F.sequence(F.lit(0), F.ceil(F.length(level) / (2 * WIDE)) - 1)
        return F.array_join(F.transform(pairs, lambda i: digest(F.substring(level, (i * 2 * WIDE + 1).cast("int"), F.lit(2 * WIDE)))), "")

    every = F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), depth)
    return F.aggregate(every, F.array(nodes), lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1)))))


def climb(spark: SparkSession, nodes: DataFrame) -> list[DataFrame]:
    """Tiers of blocks (g, block, total, nodes, levels, top) over nodes (g, rank, total, digest, own); the last has one block for each group."""
    tiers = []
    while True:
        blocks = nodes.groupBy("g", F.floor(F.col("rank") / SIZE).alias("block"), "total").agg(F.array_sort(F.collect_list(F.struct("rank", "digest", "own"))).alias("nodes"))  # at most SIZE
        blocks = kept(spark, blocks.withColumn("levels", _levels()).withColumn("top", F.element_at("levels", -1)), "tier")
        tiers.append(blocks)
        if (blocks.agg(F.max("block").alias("last")).first().last or 0) == 0:
            return tiers
        nodes = blocks.select("g", F.col("block").alias("rank"), F.ceil(F.col("total") / SIZE).alias("total"), F.col("top").alias("digest"), F.lit(None).cast("int").alias("own"))


def _siblings(place: Column) -> Column:
    """For each level below the top: the digests left and right of the node at this place of the block, '' if there is none."""

    def beside(j):
        at = F.call_function("shiftright", place, j - 1)
        level = F.element_at("levels", j)
        node = lambda i: F.substring(level, (i * WIDE + 1).cast("int"), F.lit(WIDE))
        odd = at % 2 == 1
        return F.struct(F.when(odd, node(at - 1)).otherwise("").alias("left"), F.when(odd, "").otherwise(node(at + 1)).alias("right"))

    below = F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), F.size("levels") - 1)
    return F.transform(below, beside)


def descend(spark: SparkSession, tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """A row for each node of the first tier: (g, own, digest, path, the other columns of tops).

    tops has for each g the siblings from its root on (path), and what else its nodes are to carry; path is extended
    from the node up to them, bottom level first.
    """
    carried = [c for c in tops.columns if c not in ("g", "path")]
    upper = tops.withColumn("block", F.lit(0).cast("long"))
    for t in range(len(tiers) - 1, -1, -1):
        both = tiers[t].join(upper, ["g", "block"])
        each = F.transform("nodes", lambda x, i: F.struct(x["rank"].alias("rank"), x.digest.alias("digest"), x.own.alias("own"), _siblings(i).alias("beside")))
        rows = both.select("g", "path", *carried, F.explode(each).alias("x"))
        rows = rows.select("g", F.col("x.rank").alias("block"), F.concat("x.beside", "path").alias("path"), *carried, "x.digest", "x.own")
        upper = rows.drop("digest", "own") if t == 0 else kept(spark, rows.drop("digest", "own"), "paths")
    return rows.drop("block")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s.left, h, s.right)))


def manifest(spark: SparkSession, leaves: DataFrame) -> DataFrame:
    """(own, leaf, subroot, root, path) of leaves (lang, doc_id, leaf, own: anything that is to come along).

    Per lang leaves ascend by doc_id, null first, and then by leaf (so repeated rows don't matter); langs ascend by
    their bytes, null first. path is the proof of a leaf: siblings left and right, from its level to the root's. An
    empty table has an empty manifest. No task holds more than a block of a group, or a range of its rows.
    """
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"), "doc_id", F.col("leaf").alias("digest"), "own")
    rows = kept(spark, rows.withColumn("seq", F.monotonically_increasing_id()), "leaves")  # equal rows may part
    tiers = climb(spark, placed(spark, rows, ["doc_id", "digest", "seq"]).drop("doc_id", "seq"))
    subroots = tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("own"), F.col("top").alias("digest"))
    langs = climb(spark, placed(spark, subroots, ["own"]))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    of_lang = descend(spark, langs, langs[-1].select("g", empty.alias("path"), F.col("top").alias("root")))
    tops = kept(spark, of_lang.select(F.col("own").alias("g"), "path", F.col("digest").alias("subroot"), "root"), "subroots")
    return descend(spark, tiers, tops).select("own", F.col("digest").alias("leaf"), "subroot", "root", "path")


def verified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The manifest of documents, and a check of it against a copy in which some rows were changed.

    In the copy n_chars is one more where 7 divides the crc32 of doc_id's decimals (null stays). Returns doc_id, leaf,
    subroot, root, proof_sha256, folded_root (of the copy's leaf and the manifest's proof) and verified, a row for each
    row. Any column may be null; rows without doc_id come first and are never changed; other columns are ignored.
    """
    of = lambda n_chars: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    changed = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    own = F.struct("doc_id", F.when(changed, of(F.col("n_chars").cast("long") + 1)).alias("changed"))
    done = manifest(spark, docs.select("lang", "doc_id", of(F.col("n_chars")).alias("leaf"), own.alias("own")))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s.left, s.right)), "")
    done = done.select(F.col("own.doc_id").alias("doc_id"), "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), folded(F.coalesce("own.changed", "leaf"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))

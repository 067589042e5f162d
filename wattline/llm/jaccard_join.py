"""N-gram Jaccard join with parity sketches.

Every text becomes the set of its distinct word shingles. XOR-hashing the shingles into k blocks gives a
sketch in which two sets differ in at most as many blocks (and bits) as their symmetric difference has
members. Two sets of one size band that are similar enough differ by at most D shingles, so with
k = D + 1 blocks at least one block is equal (pigeonhole): blocks are the join keys. Pairs that share a
key are held against the Hamming bound of their bit sketches and then verified on the whole texts.

Equal sets are one class from the start, so copies are never paired. Keys shared inside a map task are
combined there, so a hot key sends one row per task. Hubs first: each key pairs its members only with
its most connected class; the links found are contracted to components; only then are members of one key
that are still in different components compared, block by block, behind the Hamming bound.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .text import bounded_batches, hashed_words, hot_keys, kept, mix, ngram_hashes, salted, sized, spread, unused, whole_groups

#: Pairs of a band that must share so many shingles need no empty blocks as keys: the block of a shared shingle is
#: equal with a chance of 1 / e at least, so that none of 64 is has a chance below (1 - 1 / e) ** 64 = 2e-13.
SURE = 64
#: From similarities of so many percent on, so many blocks are keys of sets that have more, with the same chance; below,
#: or if asked for exactly, all are.
CAPPED = 80
#: Members of a key compared in one go.
TILE = 1024
#: Texts that one task holds against a hub's.
MET = 500


@lru_cache
def _bands() -> list[int]:
    """The smallest set size of each size band; bands grow by half."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, starts[-1] * 3 // 2))
    return starts


def bands_of(n: int, percent: int) -> list[int]:
    """The bands in which a set of n shingles meets others: from its own to that of the largest set it may link with."""
    starts = np.array(_bands())
    own = int(np.searchsorted(starts, n, "right")) - 1
    top = int(np.searchsorted(starts, n * 100 // percent, "right")) - 1
    return list(range(own, top + 1))


def most_apart(band: int, percent: int) -> int:
    """The largest symmetric difference of two similar sets of a band."""
    return 2 * (_bands()[band + 1] - 1) * (100 - percent) // (100 + percent)


def needs_empty(band: int, percent: int) -> bool:
    """Whether empty blocks must be keys too, so that similar sets are certain to meet."""
    return most_apart(band, percent) * percent < SURE * (100 - percent)


def shingle_sets(column: pa.Array, words: int):
    """The sorted distinct shingle hashes of each text of a column."""
    for _, _, _, bounds, hashes, _ in hashed_words(column):
        n = len(hashes)
        runs = ngram_hashes(hashes, words) if n >= words else hashes[:0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            s = np.sort(runs[lo : hi - words + 1]) if hi - lo >= words else ngram_hashes(hashes[lo:hi], words)
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def set_hash(shingles: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(shingles ^ np.uint64(len(shingles))).sum(dtype=np.uint64)]))[0]


def _of_class(words: int):
    """Keeps the (class, text) whose text has that class: an id may stand for several texts."""

    def run(batches):
        for batch in batches:
            own = [int(set_hash(s).view(np.int64)) for s in shingle_sets(batch.column(1), words)]
            yield batch.filter(pa.array(np.array(own, np.int64) == batch.column(0).to_numpy(), pa.bool_()))

    return run


def block_keys(sets: list[np.ndarray], bands: np.ndarray, percent: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set in its band, and the set each belongs to: the XOR of the shingle hashes of each block.

    With ``exact``, or below CAPPED percent, all blocks are keys, else SURE of them; empty ones where needs_empty(), or with
    ``exact`` always. The band is the key's last seven bits. Sets whose band lets only equal ones be similar have no keys.
    """
    every_band = range(int(bands.max(initial=0)) + 1)
    apart = np.array([most_apart(b, percent) for b in every_band], np.int64)
    empty = np.array([exact or needs_empty(b, percent) for b in every_band], bool)
    blocks = np.where(apart[bands] > 0, apart[bands] + 1, 0)
    n = np.array(list(map(len, sets)), np.int64)
    n = np.where(blocks > 0, n, 0)
    sets = [s for s, m in zip(sets, n) if m]
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(n)), n)
    block = ((every >> np.uint64(32)) % np.maximum(blocks[of], 1).astype(np.uint64)).astype(np.int64)
    some = blocks if exact or percent < CAPPED else np.minimum(blocks, SURE)
    use = block < some[of]
    of, block, every = of[use], block[use], every[use]
    value = mix(every + bands[of].astype(np.uint64) + np.uint64(1))
    base = np.cumsum(some) - some
    keys = np.zeros(int(some.sum()), np.uint64)
    np.bitwise_xor.at(keys, base[of] + block, value)
    owner = np.repeat(np.arange(len(n)), some)
    at = (np.arange(len(keys)) - base[owner]).astype(np.uint64)
    keys = mix(keys ^ mix(at + np.uint64(12345))) & ~np.uint64(127) | bands[owner].astype(np.uint64)
    filled = np.zeros(len(keys), bool)
    filled[base[of] + block] = True
    good = filled | empty[bands[owner]]
    return keys[good], owner[good]


def bit_sketch(shingles: np.ndarray, band: int) -> bytes:
    """One parity bit flipped for each shingle, in twice as many bits as the band's largest set has members."""
    bits = max(256, -(-2 * (_bands()[band + 1] - 1) // 64) * 64)
    parity = np.bincount((mix(shingles) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def _sets(percent: int, words: int, exact: bool):
    """Batches of (doc_id, text) to rows: kind 0 (doc_id, set hash, set size), kind 1 (key, class), kind 2 (key, class,
    first class of that key in this task's batch)."""

    def run(batches):
        starts = np.array(_bands())
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            sizes = np.array(list(map(len, sets)), np.int64)
            hashes = np.array([set_hash(s) for s in sets], np.uint64)
            own = np.searchsorted(starts, np.maximum(sizes, 1), "right") - 1
            top = np.searchsorted(starts, np.maximum(sizes * 100 // percent, 1), "right") - 1
            key, owner = [], []
            for step in range(int((top - own).max(initial=0)) + 1):
                rows, band = np.flatnonzero((sizes > 0) & (own + step <= top)), own + step
                for i in range(0, len(rows), 1000):
                    r = rows[i : i + 1000]
                    k, of = block_keys([sets[x] for x in r], band[r], percent, exact)
                    key.append(k.view(np.int64))
                    owner.append(hashes[r[of]].view(np.int64))
            key = np.concatenate(key) if key else np.zeros(0, np.int64)
            owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            same = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
            again = same & np.concatenate([[False], owner[1:] == owner[:-1]]) if len(key) else same
            lead = owner[np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))] if len(key) else owner
            one, more = ~same, same & ~again
            cols = [
                np.concatenate([np.zeros(len(sets)), np.ones(one.sum()), np.full(more.sum(), 2)]).astype(np.int8),
                pa.concat_arrays([batch.column(0), pa.array(key[one]), pa.array(key[more])]),
                np.concatenate([hashes.view(np.int64), owner[one], owner[more]]),
                np.concatenate([sizes, np.zeros(one.sum(), np.int64), lead[more]]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], ["kind", "a", "b", "c"])

    return run


def _shared(batches):
    """Batches of (key, class) sorted by key and class to (key, class) of the keys with two classes or more."""
    last_key, last_cls, out_last = None, None, False
    for batch in batches:
        key, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        prev_key, prev_cls = np.roll(key, 1), np.roll(cls, 1)
        first_new = last_key is None or key[0] != last_key
        new_key = key != prev_key
        new_key[0] = first_new
        repeat = ~new_key & (cls == prev_cls)
        repeat[0] = not first_new and cls[0] == last_cls
        key, cls, new_key = key[~repeat], cls[~repeat], new_key[~repeat]
        if not len(key):
            continue
        shared = ~new_key | np.concatenate([~new_key[1:], [False]])
        keys, classes = key[shared], cls[shared]
        if not new_key[0] and not out_last:  # the row before this batch turns out to share its key
            keys, classes = np.concatenate([[last_key], keys]), np.concatenate([[last_cls], classes])
        last_key, last_cls, out_last = key[-1], cls[-1], bool(shared[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(classes)], ["key", "class"])


def _verify(percent: int, words: int):
    """Batches of (hub, salt, side, far, text), each hub's own text (side 0) before the far ones, to the (a, b) whose sets are similar enough."""

    def run(batches):
        left = np.zeros(0, np.uint64)
        for batch in batches:
            hub, side, far = (batch.column(i).to_numpy() for i in (0, 2, 3))
            ok = np.zeros(batch.num_rows, bool)
            for i, right in enumerate(shingle_sets(batch.column(4), words)):
                if side[i] == 0:
                    left = right
                    continue
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(left) + len(right) - both)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(hub, far)[ok]), pa.array(np.maximum(hub, far)[ok])], ["a", "b"])

    return run


def _sketches(percent: int, words: int):
    """(class, rep, text) to (class, band, n, sketch)."""

    def run(batches):
        for batch in batches:
            cls, band, n, sketch = [], [], [], []
            for c, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words)):
                for b in bands_of(len(s), percent):
                    cls.append(c)
                    band.append(b)
                    n.append(len(s))
                    sketch.append(bit_sketch(s, b))
            arrays = [pa.array(cls, pa.int64()), pa.array(band, pa.int32()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["class", "band", "n", "sketch"])

    return run


def _compare(percent: int):
    """Sorted batches of the tiles of keys to the pairs in different components within the Hamming bound.

    side is the tile of a pair of tiles that a member stands in, 2 if the tile meets itself.
    """

    def pairs(cls, comp, n, side, sketches, got):
        bits = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(cls), -1)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        for i in left:
            j = right[(comp[right] != comp[i]) & ((side[i] != 2) | (cls[right] > cls[i]))]
            j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
            for lo in range(0, len(j), 256):
                k = j[lo : lo + 256]
                apart = np.bitwise_count(bits[k] ^ bits[i]).sum(1, dtype=np.int64)
                k = k[apart * (100 + percent) <= (100 - percent) * (n[i] + n[k])]
                got.append([np.minimum(cls[i], cls[k]), np.maximum(cls[i], cls[k])])

    def run(batches):
        for t in whole_groups(batches, 3):
            key, t0, t1, cls, comp, n, side = (t.column(c).to_numpy() for c in range(7))
            sketches = t.column(7).to_pylist()
            new = np.flatnonzero((key[1:] != key[:-1]) | (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1])) + 1
            got = [[np.zeros(0, np.int64)] * 2]
            for lo, hi in zip([0, *new], [*new, len(key)]):
                pairs(cls[lo:hi], comp[lo:hi], n[lo:hi], side[lo:hi], sketches[lo:hi], got)
            found = np.unique(np.stack([np.concatenate(x) for x in zip(*got)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    return run


def jaccard_classes(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    exact: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the group of each document under links of Jaccard >= percent / 100.

    Words are what stands between ASCII white space, A-Z lower-cased; fewer words than a shingle needs are one
    shingle. Null, empty and blank texts have no shingles and link with nothing; they are their own component,
    as are rows without id (component null). Rows that repeat an id share its component if their texts link.
    Very long texts are one set each. Extra columns are ignored. Sets count as equal when their sizes and
    64-bit hashes of all shingles agree. Large sets that link are missed with a chance below 2e-13 a pair; with
    ``exact`` never, at the price of keys for empty blocks. Ids that are no whole numbers fail.
    """
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    made = kept(spark, rows.mapInArrow(_sets(percent, words, exact), "kind byte, a long, b long, c long"), "sets")
    sets = made.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("class"), F.col("c").alias("n"))
    ids = sets.where("n > 0 and doc_id is not null")
    classes = kept(spark, ids.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    copied = hot_keys(spark, classes, "class")
    classes = classes.drop("n")

    firsts = made.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("class"))
    across = firsts.repartition("key").sortWithinPartitions("key", "class").mapInArrow(_shared, "key long, class long")
    inside = made.where("kind = 2").select(F.col("a").alias("key"), F.explode(F.array("b", "c")).alias("class"))
    shared = kept(spark, across.union(inside).distinct(), "shared")  # (key, class) of keys with two classes or more

    # Hubs: the class that meets most others leads its keys.
    per_key = kept(spark, shared.groupBy("key").agg((F.count("*") - 1).alias("others")), "per_key")
    frequent = hot_keys(spark, per_key, "key", "others")
    dealt = lambda rows: salted(rows, "key", frequent, ["class"])
    score = dealt(shared).join(spread(per_key, "key", frequent), ["key", "_salt"]).groupBy("class").agg(F.sum("others").alias("score"))
    score = kept(spark, score, "score")
    hubs = shared.join(score, "class").groupBy("key").agg(F.max_by("class", F.struct("score", "class")).alias("hub"))
    hubs = kept(spark, hubs, "hubs")
    pairs = dealt(shared).join(spread(hubs, "key", frequent), ["key", "_salt"]).where("class <> hub")
    pairs = pairs.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b"), "hub").distinct()
    pairs = kept(spark, pairs, "pairs")

    named = score.select("class").join(classes, "class")
    named = kept(spark, named, "named")
    wanted = sized(named.withColumnRenamed("rep", "doc_id"))
    own_text = rows.join(wanted, "doc_id").select("class", "text").mapInArrow(_of_class(words), "class long, text binary")
    texts = kept(spark, own_text, "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        """The (a, b) of pairs of classes that link, by their whole texts; hub is the side with many pairs.

        A hub's text goes once to each task that compares with it, and a far side's text once for each of its hubs.
        """
        far = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        p = pairs.select("hub", far.alias("far"))
        per_hub = kept(spark, p.groupBy("hub").agg(F.count("*").alias("n")), "per_hub")
        busy = hot_keys(spark, per_hub, "hub", most=MET)
        p = salted(p, "hub", busy, ["far"]).join(texts.withColumnsRenamed({"class": "far"}), "far").select("hub", "_salt", F.lit(1).alias("side"), "far", "text")
        own = per_hub.join(texts.withColumnsRenamed({"class": "hub"}), "hub").select("hub", "text")
        own = spread(own, "hub", busy).select("hub", "_salt", F.lit(0).alias("side"), F.col("hub").alias("far"), "text")
        both = own.union(p).repartition("hub", "_salt").sortWithinPartitions("hub", "_salt", "side")
        return both.mapInArrow(_verify(percent, words), "a long, b long").distinct()

    links = kept(spark, linked(pairs), "found")
    group = kept(spark, components(spark, links).withColumnsRenamed({"node": "class"}), "group")

    # What hubs left apart: keys whose members are in different components.
    member = shared.join(group, "class", "left").withColumn("component", F.coalesce("component", "class"))
    member = kept(spark, member, "member")
    open_keys = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    open_keys = kept(spark, open_keys.where("lo <> hi and size > 2").select("key", "size"), "open")  # hubs settle keys of two
    sketch = kept(spark, texts.select("class", "text").mapInArrow(_sketches(percent, words), "class long, band int, n long, sketch binary"), "sketches")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    tiled = dealt(member).join(spread(open_keys, "key", frequent), ["key", "_salt"]).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("class"), "tiles").cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select(
        "key",
        F.least("tile", "other").alias("t0"),
        F.greatest("tile", "other").alias("t1"),
        "class",
        "component",
        F.col("key").bitwiseAND(127).cast("int").alias("band"),
        F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    dealt = tiled.join(sketch, ["class", "band"]).select("key", "t0", "t1", "class", "component", "n", "side", "sketch")
    dealt = dealt.repartition("key", "t0", "t1").sortWithinPartitions("key", "t0", "t1")
    near = dealt.mapInArrow(_compare(percent), "a long, b long").distinct()
    near = kept(spark, near.join(pairs.select("a", "b"), ["a", "b"], "left_anti").withColumn("hub", F.col("a")), "near")
    links = links.union(linked(near))

    reps = lambda side: classes.select(F.col("class").alias(side), F.col("rep").alias(f"rep_{side}"))
    by_rep = links.join(reps("a"), "a").join(reps("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    group = kept(spark, components(spark, by_rep), "groups")
    of_class = classes.join(group, classes.rep == group.node, "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    of_class = kept(spark, of_class, "of_class")
    some = salted(sets.where("n > 0"), "class", copied, ["doc_id"])
    out = some.join(spread(of_class, "class", copied), ["class", "_salt"], "left").select("doc_id", "n", "component_id")
    out = out.unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group, that of the smallest id; rows without id stay, and link nothing.

    Rows are told apart by a 64-bit hash of id and text, so that a repeated id stands for each of its texts; of rows
    with one id and one text (not blank) one stays.
    """
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col), F.col(text_col)))
    own = docs.where(F.col(id_col).isNotNull()).select(key.alias("_nr"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    classes = jaccard_classes(spark, own, id_col="_nr", text_col="_text", **options).where("n_shingles > 0").select(F.col("doc_id").alias("_nr"), F.col("component_id").alias("_group"))
    classes = kept(spark, classes, "row_groups")
    again = classes.groupBy("_nr").agg(F.count("*").alias("n"), F.first("_group").alias("_group"))
    many = again.groupBy("_group").agg(F.count("*").alias("n")).where("n > 1")  # texts on their own need no second look
    many = kept(spark, many, "large_groups")
    hot = hot_keys(spark, many, "_group")
    grouped = salted(again.select("_nr", "_group"), "_group", hot, ["_nr"]).join(spread(many.select("_group"), "_group", hot), ["_group", "_salt"])
    grouped = kept(spark, grouped.select("_nr", "_group").join(own.select("_nr", "_id").distinct(), "_nr"), "grouped")
    first = grouped.groupBy("_group").agg(F.min(F.struct("_id", "_nr")).alias("_first")).select("_first._nr")
    gone = kept(spark, grouped.select("_nr").join(first, "_nr", "left_anti"), "gone")
    twice = kept(spark, again.where("n > 1").select("_nr"), "twice")
    (nr,) = unused(docs, "_nr")
    gone, twice = gone.withColumnRenamed("_nr", nr), twice.withColumnRenamed("_nr", nr)
    left = docs.join(sized(gone), key == gone[nr], "left_anti")
    if twice.isEmpty():
        return left
    single = left.join(sized(twice), key == twice[nr], "left_semi").withColumn(nr, key).dropDuplicates([nr]).select(*docs.columns)
    return left.join(sized(twice), key == twice[nr], "left_anti").unionByName(single)

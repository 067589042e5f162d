"""Byte-level BPE: encoding of overlapping chunks in parallel, and decoding.

A text longer than a chunk is cut into chunks that overlap. Each is pre-tokenised by itself; where both
chunks of an overlap have a boundary in common, the pattern goes on alike from there, so that is where
they are stitched. The pieces between stitches are encoded by the merges of the rank file, and the ids of
a text are those of its pieces in order. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import bounded_batches, give_back, kept

#: Pieces of at most so many bytes are merged by plain search.
SHORT = 48
#: Stands for a pair that is no token; above all ranks.
NONE = 1 << 62
#: Boundaries this close to a chunk's end may look beyond it.
MARGIN = 8


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of the lowest rank is merged, the leftmost of equals, until none is left.

    In short pieces the lowest rank is looked for anew each time. In long ones a heap of pairs over a linked list
    of parts takes n log n steps for a piece of n bytes.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, n, ranks)
    end = list(range(1, n + 1))  # part at i is piece[i : end[i]]
    back = list(range(-1, n - 1))
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        live[gone] = False
        end[i] = stop
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := back[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _merge_short(piece: bytes, n: int, ranks: dict[bytes, int]) -> list[int]:
    look = ranks.get
    parts = [piece[i : i + 1] for i in range(n)]
    pairs = [look(piece[i : i + 2], NONE) for i in range(n - 1)]
    while pairs and (least := min(pairs)) != NONE:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = look(parts[i - 1] + parts[i], NONE)
        if i < len(pairs):
            pairs[i] = look(parts[i] + parts[i + 1], NONE)
    return [ranks[p] for p in parts]


class PieceCache(dict):
    """Ids of pre-tokens as bytes of int32; when it has grown to ``most``, only pieces that are used again stay."""

    most = 150_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.whole = {}
        for token, i in ranks.items():
            try:
                self.whole[token.decode()] = np.array([i], np.int32).tobytes()
            except UnicodeDecodeError:  # part of a character: no piece of a text
                continue
        self.old = {}
        super().__init__(self.whole)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.update(self.whole)
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


#: The cache of the last vocabulary that this Python worker has used, for its next task.
_caches: list[PieceCache] = []


def _cache(ranks: dict[bytes, int]) -> PieceCache:
    if not _caches or _caches[0].ranks is not ranks:
        _caches[:] = [PieceCache(ranks)]
    return _caches[0]


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode has it, which is what rank files' users split by (0x1C-0x1F are none)."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _bounds(pattern: str, size: int, overlap: int):
    """(doc, chunk, text) to the boundaries of the chunk's pre-tokens in its first and last ``overlap`` characters."""

    def run(batches):
        split = compiled(pattern)
        for batch in batches:
            heads, tails = [], []
            for chunk, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                # What is white space before a cut could match otherwise, not seeing what follows; so no cut after any.
                at = np.array([m.end() for m in split.finditer(text) if not m[0][-1].isspace()], np.int64)
                at = at[at <= len(text) - MARGIN] if len(text) == size + overlap else at
                heads.append(at[at < overlap] + chunk * size)
                tails.append(at[at >= size] + chunk * size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                ["row", "chunk", "head", "tail"],
            )

    return run


def _cut(ends_of, most: int = 1 << 20):
    """(row, text, more) to (row, chunk, text): each text cut once, in slices from a to b of ends_of(text, more); few at a time are held."""

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["row", "chunk", "text"])

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for row, text, more in zip(*[c.to_pylist() for c in batch.columns]):
                for nr, (a, b) in enumerate(ends_of(text, more)):
                    rows.append((row, nr, text[a:b]))
                    held += b - a
                    if held >= most:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def _encode(pattern: str, ranks):
    """(row, chunk, text) to (row, chunk, ids)."""

    def run(batches):
        split, cache = compiled(pattern).findall, _cache(ranks.value)
        for batch in batches:
            parts, ends = [], [0]
            for text in batch.column(2).to_pylist():
                parts.append(b"".join(map(cache.__getitem__, split(text or ""))))
                ends.append(ends[-1] + len(parts[-1]) // 4)
            ids = pa.array(np.frombuffer(b"".join(parts), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["row", "chunk", "ids"])
            give_back()

    return run


def _decode(table):
    """Batches with a column ids to batches with the column decoded (binary) after the others."""

    def run(batches):
        look = table.value.__getitem__
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids"))
            decoded = pa.array([b"".join(map(look, x.values.to_numpy().tolist())) if x.is_valid else None for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    return run


def _tokens(spark: SparkSession, ranks: dict[bytes, int]):
    """The bytes of each id, broadcast: as large as the rank file."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return spark.sparkContext.broadcast(table)


def encode(
    spark: SparkSession,
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    *,
    decoded: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 1 << 16,
    overlap: int = 1 << 10,
) -> DataFrame:
    """(doc_id, ids) per row: the ids of the whole text, null being empty, without special tokens.

    Texts of at most ``chunk`` characters are one piece and never shuffled. Of longer ones only boundary
    places meet per document; their pieces are encoded apart and put in order by document. Where an overlap
    has no common boundary (a pre-token longer than it) the chunks beside it are one piece. Repeated ids and
    null ids keep their rows. Extra columns are ignored. With ``decoded`` a column of that name has the bytes
    the ids decode to; a batch of short texts is decoded by the Python worker that has encoded it.
    """
    bounded_batches(spark)
    known = spark.sparkContext.broadcast(ranks)  # the vocabulary: its size is that of the rank file
    rows = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).select("row", F.lit(0).alias("chunk"), "text")
    ids = "chunk int, ids array<int>"
    kind = docs.schema[id_col].dataType.simpleString()
    if decoded:
        code, back = _encode(pattern, known), _decode(_tokens(spark, ranks))
        done = short.mapInArrow(lambda batches: back(code(batches)), f"row {kind}, {ids}, decoded binary")
        done = done.select(F.col("row").alias("doc_id"), "ids", "decoded")
    else:
        done = short.mapInArrow(_encode(pattern, known), f"row {kind}, {ids}").select(F.col("row").alias("doc_id"), "ids")

    long = rows.where(F.length("text") > chunk).withColumn("place", F.struct("row", F.expr("uuid()").alias("nr")))
    long = kept(spark, long.select("place", "text"), "long_texts")  # a key of its own for each row, fixed by writing it
    named = long.select(F.to_json("place").alias("row"), "place", "text")
    overlapping = _cut(lambda text, _: [(a, a + chunk + overlap) for a in range(0, len(text), chunk)])
    parts = named.select("row", "text", F.lit(0)).mapInArrow(overlapping, "row string, chunk int, text string")
    found = parts.mapInArrow(_bounds(pattern, chunk, overlap), "row string, chunk int, head array<long>, tail array<long>")
    found = kept(spark, found, "bounds")
    tails = found.select("row", (F.col("chunk") + 1).alias("chunk"), "tail")
    stitch = found.where("chunk > 0").drop("tail").join(tails, ["row", "chunk"])
    stitch = stitch.select("row", F.array_min(F.array_intersect("tail", "head")).alias("cut")).where("cut is not null")
    cuts = stitch.groupBy("row").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))  # a place for each chunk of a text
    stitched = _cut(lambda text, cuts: list(zip([0, *(cuts or ())], [*(cuts or ()), len(text)])))
    pieces = named.join(cuts, "row", "left").select("row", "text", "cuts").mapInArrow(stitched, "row string, chunk int, text string")
    pieces = pieces.repartition("row", "chunk")
    coded = pieces.mapInArrow(_encode(pattern, known), f"row string, {ids}")
    whole = coded.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x.ids)).alias("ids"))
    whole = whole.join(named.select("row", "place"), "row").select(F.col("place.row").alias("doc_id"), "ids")
    return done.unionByName(decode(spark, whole, ranks) if decoded else whole)


def decode(spark: SparkSession, coded: DataFrame, ranks: dict[bytes, int], *, ids_col: str = "ids") -> DataFrame:
    """coded with the column decoded (binary): the bytes of the ids, one after the other. Null ids give null; unknown ids fail."""
    known = _tokens(spark, ranks)

    @F.arrow_udf("binary")
    def join(ids: pa.Array) -> pa.Array:
        look = known.value.__getitem__
        return pa.array([b"".join(map(look, x.values.to_numpy().tolist())) if x.is_valid else None for x in ids], pa.binary())

    return coded.withColumn("decoded", join(F.col(ids_col)))

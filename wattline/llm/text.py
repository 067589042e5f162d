"""Helpers shared by the corpus operators: words, hashes, and tables kept in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = bytes(range(65, 91))
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: A-Z to a-z, and a space for every ASCII byte that is neither digit nor letter.
LOWER_ALNUM = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of digits, ASCII letters and any non-ASCII characters."""
    return text.translate(LOWER_ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words between ASCII white space (bytes.split() parts at exactly 0x20 and 0x09-0x0D)."""
    return text.translate(LOWER).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Returns what freed arrays held to the system; an idle worker should not keep it from the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


_KNOWN = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def slices(offsets: np.ndarray, most: int):
    """Ranges of texts of about ``most`` bytes together."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


#: Bytes that stand in words: all but ASCII white space.
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Lower-case ASCII letters and all bytes of other characters.
LETTERS = np.array([b >= 128 or 97 <= b <= 122 for b in range(256)])


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binary texts one after the other, and where each begins; null is empty."""
    column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def hashed_words(column: pa.Array, lower: bool = True, word_bytes: np.ndarray = NOT_SPACE, heads: tuple[int, ...] = ()):
    """For slices of a column of texts (binary): (first row, starts, ends, bounds, hashes, places) of the runs of word_bytes.

    starts and ends are byte places in the slice's texts one after the other, whose own places are in the last value;
    words of row r are bounds[r] : bounds[r + 1]. Null is an empty text. With heads, a list follows: for each of these
    lengths the hash of so many first bytes of each word, 0 for words that are not longer.
    """
    data, offsets = raw_bytes(column)
    for lo, hi in slices(offsets, 1 << 18):
        raw = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        word = word_bytes[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[1:-1] = word[1:] != word[:-1] if len(raw) > 1 else False
        if len(raw):
            edge[0], edge[-1] = word[0], word[-1]
        cut = at[1:-1]  # a word never crosses from one text to the next
        both = cut[(cut > 0) & (cut < len(raw))]
        both = both[word[both - 1] & word[both]]
        marks = np.sort(np.concatenate([np.flatnonzero(edge), np.unique(both), np.unique(both)]))
        starts, ends = marks[0::2], marks[1::2]
        first = [np.zeros(len(starts), np.uint64) for _ in heads]
        hashes = np.zeros(len(starts), np.uint64)
        if len(starts):
            size = ends - starts
            begin = np.cumsum(size) - size
            inside = raw[word]
            j = np.arange(len(inside)) - np.repeat(begin, size)
            with np.errstate(over="ignore"):
                power = np.cumprod(np.full(int(size.max()) + 1, GOLDEN, np.uint64))
                table = _KNOWN.copy()
                if lower:
                    table[65:91] = table[97:123]
                parts = table[inside] * power[j]
                hashes = mix(np.add.reduceat(parts, begin) + size.astype(np.uint64))
                if heads:
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts)])
                    for k, out in zip(heads, first):
                        long = np.flatnonzero(size > k)
                        out[long] = mix(sums[begin[long] + k] - sums[begin[long]] + np.uint64(k << 32))
        found = lo, starts, ends, np.searchsorted(starts, at), hashes, at
        yield (*found, first) if heads else found
    give_back()


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; a text of fewer words, but not none, is one run."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            out = out * GOLDEN + h[i : n - k + 1 + i]
        return mix(out + np.uint64(k))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Arrow batches of at most so many rows and bytes from here on: what a task holds then doesn't depend on the texts' lengths.

    Frames read these settings when they run, after an operator has returned, so they stay; hashed_words() reads 32-bit offsets.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and Spark is local, as in tests, a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") + "/wattline"


def kept(spark: SparkSession, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and any executor can read it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before those that df has as columns (in upper or lower case)."""
    own, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in own:
            name = "_" + name
        out.append(name)
    return out


def sized(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df with a broadcast hint if it has at most ``most`` (narrow) rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of one key that may meet in one task of a join.
HOT = 50_000


def hot_keys(spark: SparkSession, counted: DataFrame, key: str, n: str = "n", most: int = HOT) -> DataFrame:
    """(key, _parts) of the keys with more than ``most`` rows, from a table of their counts: as many parts as keep each part below it."""
    hot = counted.where(F.col(n) > most).select(key, F.ceil(F.col(n) / most).cast("int").alias("_parts"))
    return sized(kept(spark, hot, "hot_keys"))


def salted(rows: DataFrame, key: str, hot: DataFrame, by: list[str]) -> DataFrame:
    """rows with _salt, which deals the rows of a hot key out by the columns ``by``."""
    return rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), "_parts").cast("int"), F.lit(0))).drop("_parts")


def spread(single: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """A table of one row a key with a copy for each _salt of a hot key: join it to salted() rows on key and _salt."""
    last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
    return single.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_parts")


def whole_groups(batches, n_keys: int):
    """Batches sorted by their first n_keys columns as tables that cut no group in two; a group must be bounded."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        keys = [table.column(i) for i in range(n_keys)]
        last = table.num_rows - 1
        end = last
        tail = tuple(k[last] for k in keys)
        while end > 0 and tuple(k[end - 1] for k in keys) == tail:
            end -= 1
        rest = table.slice(end)
        if end:
            yield table.slice(0, end).combine_chunks()
    if rest is not None:
        yield rest.combine_chunks()

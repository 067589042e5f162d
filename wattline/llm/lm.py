"""A bigram language model whose counts live in a log-frequency Bloom filter.

A count c is quantised to the number of thresholds (1, 2, 3, 4, 6, 8, 12, ...) that it reaches, and a gram of
level q is put into a Bloom filter q times, as (gram, 1) to (gram, q). Asking for (gram, 1), (gram, 2), ...
until one is absent gives the level back, never too small; a gram that was never seen passes each question
with the filter's small error rate.

Texts are kept in chunks of some three million tokens. A chunk sends the grams of its texts, each once and with
the times that training texts have it, to shards of grams: that counts them and asks for them at once. A shard
sums the counts, quantises them, fills its filter, asks it for the grams of each chunk and sends back levels
in the order of the grams, so that neither grams nor filter travel again. Shards grow in number with the text;
nothing is broadcast, and no row is made for a token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import GOLDEN, NOT_SPACE, bounded_batches, give_back, hashed_words, kept, mix, raw_bytes

#: Filter bits for each gram and level, and how many of them are set.
BITS, PROBES = 10, 7
#: Counts at which a level begins: 1, 2, then 3 and 4 times the powers of two.
THRESHOLDS = np.array([1, 2, *sorted(m << e for e in range(40) for m in (3, 4))], np.int64)
#: What a level stands for: the mean of the counts that it has.
MEANS = np.concatenate([[0.0], (THRESHOLDS[:-1] + THRESHOLDS[1:] - 1) / 2, [float(THRESHOLDS[-1])]])
#: Bytes of text that make a shard.
SHARD = 8 << 20
#: The end of a text as a token, and its begin as a history.
END, BEGIN = (mix(np.array([n], np.uint64))[0] for n in (0x656E64, 0x626567))
#: Tokens of a chunk of texts, and a 16th of its bytes, unless a batch has more.
HELD = 3 << 20
#: What packs texts and numbers.
ZSTD = pa.Codec("zstd", compression_level=3)


def gram(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(history * GOLDEN + word + np.uint64(2))


def tokens(column: pa.Array):
    """For slices of texts: (first row, tokens, bounds): hashes of the lower-cased words of each text and its end."""
    for lo, _, _, bounds, hashes, _ in hashed_words(column):
        n = np.diff(bounds) + 1
        out = np.full(len(hashes) + len(n), END, np.uint64)
        stops = np.cumsum(n)
        inside = np.ones(len(out), bool)
        inside[stops - 1] = False
        out[inside] = hashes
        yield lo, out, np.append(0, stops)


def histories(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each token; a text's first has BEGIN."""
    before = np.roll(words, 1)
    before[bounds[:-1]] = BEGIN
    return before


def _joined(slices):
    """Slices of tokens() as one."""
    starts = np.cumsum([0, *[b[-1] for *_, b in slices]])
    return slices[0][0], np.concatenate([w for _, w, _ in slices]), np.concatenate([b[:-1] + s for (*_, b), s in zip(slices, starts)] + [starts[-1:]])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    return np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]


def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the place of each key among them."""
    order = np.argsort(keys)
    first = _firsts(keys[order])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    return keys[order][first], place


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers, packed: their lowest bytes first, then the next ones."""
    return ZSTD.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(ZSTD.decompress(packed, 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes by their differences, of which the five lowest bytes are noise and stay as they are."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return planes[:5].tobytes() + ZSTD.compress(planes[5:].tobytes(), asbytes=True)


def _unpack_keys(packed: bytes, n: int) -> np.ndarray:
    low, high = packed[: 5 * n], ZSTD.decompress(packed[5 * n :], 3 * n, asbytes=True)
    planes = np.frombuffer(low + high, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _chunk(chunk: int, held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=ZSTD)) as out:
        for batch in held:
            out.write_batch(batch)
    values = (chunk, pa.int64()), (size, pa.int64()), (sink.getvalue().to_pybytes(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in values], ["chunk", "size", "docs"])


def _chunked(most: int):
    """(doc_id, held_out, text) to (chunk, size, docs): the rows of a chunk as a stream of batches, and the bytes of their texts."""

    def run(batches):
        chunk, held, n, size = TaskContext.get().partitionId() << 40, [], 0, 0
        for batch in batches:
            data, offsets = raw_bytes(batch.column(2))
            word = NOT_SPACE[data[offsets[0] : offsets[-1]]]
            more = max(2 * batch.num_rows + int(np.count_nonzero(word[1:] & ~word[:-1])), len(word) // 16)  # no fewer than its tokens
            if held and n + more > most:
                yield _chunk(chunk, held, size)
                chunk, held, n, size = chunk + 1, [], 0, 0
            if batch.num_rows:
                held, n, size = [*held, batch], n + more, size + len(word)
        if held:
            yield _chunk(chunk, held, size)
        give_back()

    return run


def _read(docs: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A chunk's rows, their tokens and the tokens' bounds."""
    rows = pa.ipc.open_stream(docs).read_all()
    _, words, bounds = _joined(list(tokens(rows["text"].combine_chunks())))
    return rows, words, bounds


def _questions(shards: int):
    """(chunk, docs) to (chunk, shard, ...): the words (the begin is one too) and bigrams of its texts, how many, and how often training texts have them, packed."""

    def counted(keys, teach):
        ordered = np.sort(keys)
        unique = ordered[_firsts(ordered)]
        taught, n = np.unique(keys[teach], return_counts=True)
        times = np.zeros(len(unique), np.int64)
        times[np.searchsorted(unique, taught)] = n
        return unique, times, np.searchsorted(shard_of(unique, shards), np.arange(shards + 1))  # keys are sorted, and so are their shards

    def run(batches):
        kinds = pa.int64(), pa.int32(), *[pa.int32(), pa.binary(), pa.binary()] * 2
        for batch in batches:
            for chunk, docs in zip(*[c.to_pylist() for c in batch.columns]):
                rows, words, bounds = _read(docs)
                teach = ~rows["held_out"].to_numpy()
                of_token = np.repeat(teach, np.diff(bounds))
                begins = np.full(len(teach), BEGIN, np.uint64)
                both = counted(np.append(words, begins), np.append(of_token, teach)), counted(gram(histories(words, bounds), words), of_token)
                out = []
                for shard in range(shards):
                    spans = [slice(cut[shard], cut[shard + 1]) for *_, cut in both]
                    if any(s.start < s.stop for s in spans):
                        out.append((chunk, shard, *[x for (keys, times, _), s in zip(both, spans) for x in (s.stop - s.start, _pack_keys(keys[s]), _pack(times[s]))]))
                for at in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 1000]), kinds)], ["chunk", "shard", "n_words", "words", "word_times", "n_grams", "grams", "gram_times"])
        give_back()

    return run


class Filter:
    """The bits of the grams and levels of a shard."""

    def __init__(self, n_bytes: int, probes: int = PROBES):
        self.bits = np.zeros(n_bytes, np.uint8)
        self.size = np.uint64(8 * n_bytes)
        self.probes = probes

    @classmethod
    def of(cls, keys: np.ndarray, times: np.ndarray, bits: int = BITS, probes: int = PROBES) -> Filter:
        """A shard's filter from its grams and their counts."""
        levels = np.searchsorted(THRESHOLDS, times, "right")
        made = cls(-(-int(levels.sum()) * bits // 64) * 8 + 8, probes)
        level = 1
        while len(keys):
            at, step = _probe(keys, level)
            with np.errstate(over="ignore"):
                for _ in range(probes):
                    place = at % made.size
                    np.bitwise_or.at(made.bits, (place >> np.uint64(3)).astype(np.int64), np.left_shift(1, place & np.uint64(7), dtype=np.uint64).astype(np.uint8))
                    at = at + step
            keys, levels = keys[levels > level], levels[levels > level]
            level += 1
        return made

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Of each gram the level below the first one that is absent."""
        found = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        level = 1
        while len(live):
            yes = self._present(keys, level)
            live, keys = live[yes], keys[yes]
            found[live] = level
            level += 1
        return found

    def _present(self, keys: np.ndarray, level: int) -> np.ndarray:
        here = np.arange(len(keys))
        at, step = _probe(keys, level)
        with np.errstate(over="ignore"):
            for _ in range(self.probes):
                place = at % self.size
                yes = np.flatnonzero(self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                here, at, step = here[yes], (at + step)[yes], step[yes]
        return here


def _probe(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first bit of each key at a level is looked for, and how far apart the others are."""
    with np.errstate(over="ignore"):
        at = mix(keys + np.uint64(level) * GOLDEN)
        return at, mix(at) | np.uint64(1)


def _answered(bits: int, probes: int):
    """The questions of a shard to (chunk, shard, counts, levels): the exact counts of each chunk's words, and the levels of its words and bigrams; the first row has the shard's tokens and distinct words."""

    def run(rows):
        columns = rows.to_pydict()
        found = []
        for kind in ("word", "gram"):
            sizes = columns[f"n_{kind}s"]
            keys = np.concatenate([_unpack_keys(x, n) for x, n in zip(columns[f"{kind}s"], sizes)])
            times = np.concatenate([_unpack(x, n) for x, n in zip(columns[f"{kind}_times"], sizes)])
            unique, place = _placed(keys)
            sums = np.zeros(len(unique), np.int64)
            np.add.at(sums, place, times.astype(np.int64))
            found.append((unique, sums, place, np.cumsum([0, *sizes])))
        (words, n, of_word, word_at), (grams, m, of_gram, gram_at) = found
        keys, sums = np.append(words, grams), np.append(n, m)
        levels = Filter.of(keys[sums > 0], sums[sums > 0], bits, probes).levels(keys)
        out = []
        for i in range(rows.num_rows):
            own, both = of_word[word_at[i] : word_at[i + 1]], of_gram[gram_at[i] : gram_at[i + 1]]
            out.append((columns["chunk"][i], columns["shard"][i], len(own), len(both), _pack(n[own]), _pack(levels[np.append(own, len(words) + both)])))
        totals = [[int(x), *[0] * (len(out) - 1)] for x in (n[words != BEGIN].sum(), np.count_nonzero(n[words != BEGIN]))]
        kinds = pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
        give_back()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip([*zip(*out), *totals], kinds)], ["chunk", "shard", "n_words", "n_grams", "counts", "levels", "tokens", "kinds"])

    return run


def _log(history: np.ndarray, both: np.ndarray, share: np.ndarray, weight: float) -> np.ndarray:
    """log10 of the probability of tokens: the bigram's count, with ``weight`` more pseudo-counts dealt out as the words are."""
    top = MEANS[history]
    return np.log10((np.minimum(MEANS[both], top) + weight * share) / (top + weight))


def _base(c, n_tokens: int, n_words: int):
    return (c + 0.1) / (n_tokens + 0.1 * (n_words + 1))


def _scored(n_tokens: int, n_words: int, weight: float):
    """A chunk (chunk, docs) and what the shards answered for it to its rows with their sums."""

    def run(docs, answers):
        rows, words, bounds = _read(docs["docs"][0].as_py())
        before = histories(words, bounds)
        keys, place = _placed(np.append(words, BEGIN))
        grams, pair = _placed(gram(before, words))
        parts = answers.sort_by("shard").to_pydict()  # shards are ranges of keys, so their answers are in the order of the keys
        sizes = list(zip(parts["n_words"], parts["n_grams"]))
        count = np.concatenate([_unpack(x, n) for x, (n, _) in zip(parts["counts"], sizes)])
        split = [np.split(_unpack(x, n + m).astype(np.int64), [n]) for x, (n, m) in zip(parts["levels"], sizes)]
        level, gram_level = [np.concatenate(x) for x in zip(*split)]
        if (len(count), len(gram_level)) != (len(keys), len(grams)):
            raise ValueError(f"chunk {docs['chunk'][0]} asked for {len(keys)} words and {len(grams)} bigrams, but has answers for {len(count)} and {len(gram_level)}")
        place, first = place[:-1], level[place[-1]]
        own = level[place]
        top = np.where(before == BEGIN, first, np.roll(own, 1))
        both = np.where(np.minimum(top, own) > 0, gram_level[pair], 0)  # a bigram is never without its words
        share = _base(MEANS[level], n_tokens, n_words)[place]
        cut = bounds[:-1]
        score = np.add.reduceat(_log(top, both, share, weight), cut)
        base = np.add.reduceat(np.log10(_base(count, n_tokens, n_words))[place], cut)
        known = np.add.reduceat((count > 0).astype(np.int64)[place], cut)
        give_back()
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": np.diff(bounds), "n_known": known, "base_score": base, "score": score})

    return run


def score(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weight: float = 4.0, most_bytes: int = 256 << 20, most_words: int = 1_000_000,
    bits: int = BITS, probes: int = PROBES,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Rows whose crc32 of the id as text is divisible by ten are held out, the others teach. Tokens are the words between
    ASCII white space, A-Z lower-cased, and an end. base_score is that of single tokens with 0.1 added to exact counts;
    score that of bigrams: count of the bigram, and ``weight`` pseudo-counts dealt out as the single tokens are, over
    count of the history and weight, all by quantised counts from the filter. Null and empty texts have the end only;
    rows without id are held out; repeated ids keep their rows; extra columns are ignored. Without training rows every
    token is unknown. Tokens are told apart by 64-bit hashes.

    The filter grows with the corpus; it is filled and asked shard by shard. ``most_bytes`` and ``most_words`` bounded
    what of filter and counts was broadcast; nothing is any more, so they change nothing.
    """
    bounded_batches(spark)
    own = F.col(id_col)
    held = F.coalesce(F.crc32(own.cast("string")) % 10 == 0, F.lit(True))
    rows = docs.select(own.cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    chunks = kept(spark, rows.mapInArrow(_chunked(HELD), "chunk long, size long, docs binary"), "lm_chunks")
    shards = max(1, -(-(chunks.agg(F.sum("size").alias("n")).first().n or 0) // SHARD))
    chunks = chunks.select("chunk", "docs")
    asked = chunks.mapInArrow(_questions(shards), "chunk long, shard int, n_words int, words binary, word_times binary, n_grams int, grams binary, gram_times binary")
    answers = asked.groupBy("shard").applyInArrow(_answered(bits, probes), "chunk long, shard int, n_words int, n_grams int, counts binary, levels binary, tokens long, kinds long")
    answers = kept(spark, answers, "lm_answers")
    total = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    done = chunks.groupBy("chunk").cogroup(answers.drop("tokens", "kinds").groupBy("chunk")).applyInArrow(_scored(total.n, total.v, weight), schema)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), "base_score", "score")

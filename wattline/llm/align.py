"""Alignment of the tokens of two tokenizers by byte offsets, and how often their ids meet in a corpus.

Both tokenizers cut a text into tokens whose byte ends are two rising arrays. Where the texts of two
tokens agree one to one, the arrays agree at a constant shift of their indices: that shift is the
diagonal, and the length of the stretch is found by exponential probing (slices of 1, 2, 4, ... ends are
compared, then halved), so a stretch is jumped and not walked. Where they part, the group up to the next
common end is resolved token by token, and the shift goes on from there.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import bounded_batches, give_back, kept, sized

#: Bytes of text that are aligned at once, and links after which a block of documents is closed.
PIECE, BLOCK = 1 << 20, 1 << 22
#: A space between two characters that are none: no token of either tokenizer lies on both of its sides.
_BETWEEN = regex.compile(r"(?<=\S) (?=\S)")
_LOOSE = regex.compile(r"\s | \s|^ | $")


def runs(ends_a: list[int], ends_b: list[int]):
    """(run_a, run_b, run_n, groups, links): the one-to-one stretches, and of the other groups their token ranges and pairs of overlapping tokens.

    Both lists rise and have the same last value. A stretch of n groups begins at token run_a of A and run_b of B;
    groups has (a, a_stop, b, b_stop), links (a, b) one after the other.
    """
    run_a, run_b, run_n, groups, links = [], [], [], [], []
    i = j = 0
    many = len(ends_a)
    while i < many:
        if ends_a[i] == ends_b[j]:
            n = step = 1
            while ends_a[i + n : i + n + step] == ends_b[j + n : j + n + step] and i + n + step <= many:
                n += step
                step += step
            while step > 1:  # the stretch ends within the next ``step`` ends
                step >>= 1
                if i + n + step <= many and ends_a[i + n : i + n + step] == ends_b[j + n : j + n + step]:
                    n += step
            run_a.append(i)
            run_b.append(j)
            run_n.append(n)
            i += n
            j += n
            continue
        x, y = i, j
        p, q = ends_a[x], ends_b[y]
        while p != q:
            links += x, y
            if p < q:
                x += 1
                p = ends_a[x]
            else:
                y += 1
                q = ends_b[y]
        links += x, y
        groups.append((i, x + 1, j, y + 1))
        i, j = x + 1, y + 1
    return run_a, run_b, run_n, groups, links


class Vocabulary:
    """Byte-level BPE ranks (A) and a sentence-piece model (B), and how both cut the pieces of text between single spaces.

    No token of either lies on both sides of a single space (``cuts`` tells whether that holds for a model), so such
    pieces are encoded and aligned once each: the end arrays are those of all new pieces one after the other.
    """

    most, most_chars = 200_000, 4_000_000

    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n_a, n_b = max(ranks.values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * n_a
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        #: A piece with a space after another character could lie across a cut.
        self.cuts = not any(regex.search("[^\u2581]\u2581", p) for p in pieces)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = [str(i) for i in range(n_a)], [str(i) for i in range(n_b)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str] = []  # the groups of each known part
        self.odd: set[str] = set()  # parts that either tokenizer doesn't give back
        self.numbers: dict[int, int] = {}  # of pairs
        self.codes = np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 3), np.int64)  # tokens of A and B, and groups
        self.stops = np.zeros(1, np.int64)  # of the links of each part
        self.links = np.zeros(0, np.int32)  # the pair of each link

    def cut(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return _BETWEEN.split(text) if _LOOSE.search(text) else text.split(" ")

    def learn(self, parts: list[str]) -> np.ndarray:
        """The places of all of these parts among the known ones."""
        new = list(set(parts).difference(self.known))
        if new and (len(self.known) + len(new) > self.most or self.chars > self.most_chars):
            self.forget()
            new = list(set(parts))
        if new:
            self._align(new)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _encode(self, new: list[str]):
        """Ids and numbers of tokens of A and of B of each of these parts, whose ids must give back a space and the part; else None."""
        plain = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        a = self.a.encode_ordinary(" " + " ".join(plain)) if plain else []  # cut at every part's end, as a text is
        edged = [p for p in new if not p or p[0].isspace() or p[-1].isspace()]
        for p in edged:
            a += self.a.encode_ordinary(" " + p)
        new[:] = plain + edged
        every_b = self.b.encode(new, num_threads=1)
        b = list(chain.from_iterable(every_b))
        due = (" " + " ".join(new)).encode() if new else b""
        stops = np.cumsum(np.fromiter(map(len, map(str.encode, new)), np.int64, len(new)) + 1)
        if b"".join(map(self.bytes_a.__getitem__, a)) != due or b"".join(map(self.bytes_b.__getitem__, b)) != due:
            return None
        n_b = np.fromiter(map(len, every_b), np.int64, len(new))
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        last = np.searchsorted(ends_a, stops)
        if not np.array_equal(ends_a[last], stops) or not np.array_equal(ends_b[np.cumsum(n_b) - 1], stops):
            return None
        return a, np.diff(last, prepend=-1), b, n_b, ends_a, ends_b

    def _align(self, new: list[str]) -> None:
        self.chars += sum(map(len, new))
        odd: list[str] = []
        if (got := self._encode(new)) is None:  # some part is changed by a tokenizer: look for it
            odd = [p for p in new if self._encode([p]) is None]
            new = list(set(new).difference(odd))
            got = self._encode(new)
        a, n_a, b, n_b, ends_a, ends_b = got
        stop_a = np.cumsum(n_a)
        name_a, name_b = list(map(self.name_a.__getitem__, a)), list(map(self.name_b.__getitem__, b))
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        run_a, run_b, run_n, groups, links = runs(ends_a.tolist(), ends_b.tolist())
        run_a, run_b, run_n = (np.array(x, np.int64) for x in (run_a, run_b, run_n))
        step = np.arange(run_n.sum()) - np.repeat(np.cumsum(run_n) - run_n, run_n)
        one_a, one_b = np.repeat(run_a, run_n) + step, np.repeat(run_b, run_n) + step
        own = np.array(links, np.int64).reshape(-1, 2)

        place_a, place_b = np.concatenate([one_a, own[:, 0]]), np.concatenate([one_b, own[:, 1]])
        part = np.searchsorted(stop_a, place_a, "right")
        order = np.argsort(part, kind="stable")
        codes, inverse = np.unique((a[place_a] << 32 | b[place_b])[order], return_inverse=True)
        numbers = [self.numbers.setdefault(c, len(self.numbers)) for c in codes.tolist()]
        self.codes = np.fromiter(self.numbers, np.int64, len(self.numbers))
        self.links = np.concatenate([self.links, np.array(numbers, np.int32)[inverse]])
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(np.bincount(part, minlength=len(new)))])

        # The groups in order, as text: those of the stretches and the others merged by their first token of A.
        texts = [name_a[x] + "|" + name_b[y] for x, y in zip(one_a.tolist(), one_b.tolist())]
        texts += [",".join(name_a[i:x]) + "|" + ",".join(name_b[j:y]) for i, x, j, y in groups]
        first = np.concatenate([one_a, np.array([g[0] for g in groups], np.int64)])
        turn = np.argsort(first, kind="stable")
        texts = list(map(texts.__getitem__, turn.tolist()))
        until = np.searchsorted(first[turn], stop_a, "left")
        lo = 0
        for name, hi in zip(new, until.tolist()):
            self.known[name] = len(self.texts)
            self.texts.append(";".join(texts[lo:hi]))
            lo = hi
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, np.diff(until, prepend=0)], 1)])
        self.odd.update(odd)
        for name in odd:  # without tokens; a text that has one is left out as a whole
            self.known[name] = len(self.texts)
            self.texts.append("")
            self.sizes = np.concatenate([self.sizes, np.zeros((1, 3), np.int64)])
            self.stops = np.append(self.stops, self.stops[-1])


#: The vocabulary that this Python worker has used last, for its next task.
_held: dict[tuple, Vocabulary] = {}


def vocabulary(*paths: str) -> Vocabulary:
    if paths not in _held:
        _held.clear()
        _held[paths] = Vocabulary(*paths)
    return _held[paths]


class _Text:
    """What is known so far of one text: its sizes, its groups' digest (and text, if asked for), its pairs and how often it has them."""

    def __init__(self, row, whole: bool):
        self.row, self.sizes, self.odd, self.digest = row, np.zeros(3, np.int64), False, None
        self.codes, self.times = [], []
        self.groups = [] if whole else None

    def add(self, text: str, sizes: np.ndarray) -> None:
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            text = ";" + text
        self.digest.update(text.encode())
        self.sizes = self.sizes + sizes
        if self.groups is not None:
            self.groups.append(text)

    def fields(self):
        """doc_id, n_a, n_b, n_groups, n_links, digest, groups."""
        if self.odd or self.digest is None:
            return self.row, 0, 0, 0, 0, "", ""
        return self.row, *self.sizes.tolist(), int(sum(t.sum() for t in self.times)), self.digest.hexdigest(), "".join(self.groups or ())


def _take(v: Vocabulary, pieces: list[tuple[_Text, list[str]]]) -> None:
    """Adds these pieces of texts to what is known of the texts."""
    places = v.learn([p for _, parts in pieces for p in parts])
    stops = np.cumsum([len(parts) for _, parts in pieces])
    n = np.diff(v.stops)[places]
    at = np.arange(n.sum()) + np.repeat(v.stops[places] - (np.cumsum(n) - n), n)
    piece = np.repeat(np.repeat(np.arange(len(pieces)), np.diff(stops, prepend=0)), n)
    many = len(v.codes)
    both, times = np.unique(piece * many + v.links[at], return_counts=True)
    piece, codes = both // max(many, 1), v.codes[both % max(many, 1)]
    cut = np.searchsorted(piece, np.arange(len(pieces) + 1))
    lo = 0
    for k, ((text, parts), hi) in enumerate(zip(pieces, stops.tolist())):
        own = places[lo:hi]
        lo = hi
        text.odd = text.odd or not v.odd.isdisjoint(parts)
        text.add(";".join(map(v.texts.__getitem__, own.tolist())), v.sizes[own].sum(0))
        text.codes.append(codes[cut[k] : cut[k + 1]])
        text.times.append(times[cut[k] : cut[k + 1]])


MADE = "kind byte, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, own binary, pairs array<long>, times array<long>"


def _blocks(paths: tuple[str, str, str], whole: bool, block_links: int):
    """(doc_id, text) to rows of kind 0, a document of a block with its pairs (packed), and of kind 1, a block's pairs and their numbers."""
    names = [x.split()[0] for x in MADE.split(", ")]
    types = [pa.int8(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def block_of(nr: int, texts: list[_Text]):
        texts = [t for t in texts if t]
        for t in texts:
            if t.odd:
                t.codes, t.times = [], []
        codes, times = (np.concatenate([np.zeros(0, np.int64), *[x for t in texts for x in getattr(t, k)]]) for k in ("codes", "times"))
        pairs, place = np.unique(codes, return_inverse=True)
        rows, lo = [], 0
        for t in texts:
            n = sum(len(x) for x in t.codes)
            own = np.concatenate([place[lo : lo + n], times[lo : lo + n]]).astype("<i4")
            lo += n
            rows.append((0, nr, *t.fields(), zlib.compress(own.tobytes(), 1), None, None))
        if len(pairs):
            rows.append((1, nr, *[None] * 7, None, pairs, np.bincount(place, times).astype(np.int64)))
        for at in range(0, len(rows), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 500]), types)], names)

    def run(batches):
        v, nr = vocabulary(*paths), TaskContext.get().partitionId() << 32
        texts, pieces, held, links = [], [], 0, 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.append(_Text(row, whole))
                parts = v.cut(text) if text else []
                while parts:  # a long text in pieces, many short ones in one
                    end = min(len(parts), max(1, PIECE // (1 + len(text) // len(parts))))
                    pieces.append((texts[-1], parts[:end]))
                    held += sum(map(len, parts[:end])) + end
                    parts = parts[end:]
                    if held >= PIECE:
                        _take(v, pieces)
                        links += sum(len(t.codes[-1]) for t, _ in pieces)
                        pieces, held = [], 0
                if links >= block_links and not pieces or len(texts) >= 100_000:
                    if pieces:
                        _take(v, pieces)
                    yield from block_of(nr, texts)
                    texts, pieces, held, links, nr = [], [], 0, 0, nr + 1
        if pieces:
            _take(v, pieces)
        if texts:
            yield from block_of(nr, texts)
        give_back()

    return run


def _summed(own: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block with n_best and count_sum, from the corpus-wide counts of the block's pairs."""
    n = np.zeros(counts.num_rows, np.int64)
    best = np.zeros(counts.num_rows, bool)
    if counts.num_rows:
        at = counts["at"].to_numpy()
        n[at] = counts["n"].to_numpy()
        best[at] = counts["best"].to_numpy()
    n_best, count_sum = [], []
    for packed in own["own"]:
        place, times = np.frombuffer(zlib.decompress(packed.as_py()), "<i4").astype(np.int64).reshape(2, -1)
        n_best.append(int(times[best[place]].sum()))
        count_sum.append(int((times * n[place]).sum()))
    kept_columns = own.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"])
    return kept_columns.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align(
    spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", groups: bool = True, block_links: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Per row of docs its alignment, and the table of the id pairs that are linked: (a_id, b_id, n, best).

    A is byte-level BPE over a space and the text, B sentence pieces over the text; special tokens are plain text. The
    alignment has doc_id, n_a, n_b (tokens), n_groups, n_links, groups_sha256, groups (``a1,a2|b1;...``; with
    groups=False empty), n_best (links whose pair is one of the most frequent of its B id) and count_sum. Null and
    empty texts, and such as a tokenizer changes, have no tokens: zeros and ''. Null and repeated ids keep their rows;
    ids that are no whole numbers fail. Extra columns are ignored; a text is as long as it is.

    Links are counted inside blocks of documents; a block's pairs, not those of each document, meet the counts of the
    corpus, which come back to the block.
    """
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = kept(spark, rows.mapInArrow(_blocks((ranks_path, pattern, model_path), groups, block_links), MADE), "aligned")
    each = made.where("kind = 1").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = kept(spark, each.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    top = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("top"))  # as many rows as B has ids at most
    counts = counts.withColumn("b_id", b_id).join(F.broadcast(top), "b_id").select("pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "n", (F.col("n") == F.col("top")).alias("best"))
    counts = kept(spark, counts, "pairs")
    looked = each.drop("n").join(sized(counts.select("pair", "n", "best")), "pair").select(F.col("block").alias("of"), "at", "n", "best")  # both sides stem from one table
    own = made.where("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "own")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    return own.groupBy("block").cogroup(looked.groupBy("of")).applyInArrow(_summed, schema), counts.drop("pair")

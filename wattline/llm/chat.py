"""Transcript parsing: a hidden Markov model over speaker markers and line features recovers roles before rendering.

States are roles. A text is parted where a line starts with a speaker marker. A part's symbols are its marker and
features of its lines; emission and transition counts come from turns of known role in other conversations. Viterbi runs over chunks of turns: each chunk
gives the best score from every state before it to every state at its end, these are chained per
conversation, and then every chunk is traced back between its two known states, so that a conversation of any
length is never in one task as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import kept, whole_groups

ROLES = ("system", "user", "assistant", "tool")
#: Speaker markers at the start of a turn, and the role that each stands for.
MARKERS = (  # fixed values
    ("system", r"(?i)^\s*(?:<\|?system\|?>|\[system\]|#+ *system *:?|system *:)"),
    ("user", r"(?i)^\s*(?:<\|?user\|?>|\[inst\]|#+ *(?:instruction|human|user|question)|user|human|question|customer) *:"),
    ("assistant", r"(?i)^\s*(?:<\|?assistant\|?>|\[/inst\]|#+ *(?:response|assistant|answer)|assistant|ai|bot|chatbot|model|answer|agent|gpt) *:"),
    ("tool", r"(?i)^\s*(?:<\|?tool\|?>|#+ *(?:observation|tool)|tool|function|observation) *:"),
)
#: Short markers; they may as well be the letters of a list.
WEAK = (("user", r"(?i)^\s*(?:q|me) *:"), ("assistant", r"(?i)^\s*a *:"))
#: A line of a list: a letter or two that are no marker.
_LISTED = r"(?im)^\s*(?!(?:q|me|a) *:)[a-z]{1,2} *:"
SYMBOLS = ("marker", "opening", "chars", "lines", "question", "address", "code", "parity")
#: What all markers begin with.
LEAD = r"^\s*"


def _next(markers) -> str:
    return r"\n\s*(?=" + "|".join(f"(?:{p.replace(LEAD, '')})" for _, p in markers) + ")"


def parted(text):
    """A text's parts: it goes on with another speaker before a line that starts with a marker.

    Short markers count only in a text that has those of both speakers at the start of lines, and no other letters there.
    """
    q, a = (text.rlike(p.replace("(?i)", "(?im)")) for _, p in WEAK)
    return F.when(q & a & ~text.rlike(_LISTED), F.split(text, _next(MARKERS + WEAK))).otherwise(F.split(text, _next(MARKERS)))


def marker_of(text, values: dict):
    """Of the first marker that a text starts with: values[(role, pattern)], else values[None]."""
    found = F.lit(values[None]) if isinstance(values[None], str) else values[None]
    for role, pattern in reversed(WEAK):
        found = F.when(text.rlike(pattern) & ~text.rlike(_LISTED), values[role, pattern]).otherwise(found)
    for role, pattern in reversed(MARKERS):
        found = F.when(text.rlike(pattern), values[role, pattern]).otherwise(found)
    return found


def symbols(text, turn, part):
    """The symbols of a step, one small string for each feature."""
    marker = marker_of(text, {(r, p): F.lit(r) for r, p in MARKERS + WEAK} | {None: "none"})
    size = lambda n: F.least(F.lit(12), F.floor(F.log2(n + 1))).cast("string")
    return {
        "marker": marker,
        "opening": ((turn == 0) & (part == 0)).cast("string"),
        "chars": size(F.length(text)),
        "lines": size(F.size(F.split(text, "\n"))),
        "question": text.rlike(r"\?\s*$").cast("string"),
        "address": text.rlike(r"(?i)^\s*(?:you are|act as|always|never|please|can you|how|what|why)\b").cast("string"),
        "code": text.contains("```").cast("string"),
        "parity": F.pmod(turn + part, F.lit(2)).cast("string"),
    }


def train(rows: DataFrame, folds: int) -> list[dict]:
    """For each fold the log-probabilities of starts, steps and symbols from the conversations of all other folds.

    rows: (key, fold, turn, part, parts, role, symbols...); steps of known role whose text is one part teach.
    """
    known = rows.where(F.col("role").isin(*ROLES) & (F.col("parts") == 1))
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("feature"), F.col(s).alias("value")) for s in SYMBOLS])).alias("x")
    seen = known.select("fold", "role", pairs).groupBy("fold", "role", "x.feature", "x.value").count().collect()  # folds by roles by symbols: a small table
    one = known.groupBy("key", "fold", "turn").agg(F.min("role").alias("role"))
    ahead = one.select("key", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    steps = one.join(ahead, ["key", "turn"], "left").groupBy("fold", "before", "role").count().collect()
    return [fitted([r for r in seen if r.fold != f], [r for r in steps if r.fold != f]) for f in range(folds)]


def fitted(seen, steps) -> dict:
    """The model of counts of symbols (role, feature, value, count) and of steps (before, role, count)."""
    at = {r: i for i, r in enumerate(ROLES)}
    move = np.full((len(ROLES) + 1, len(ROLES)), 0.1)
    for r in steps:
        move[at[r.before] if r.before else len(ROLES), at[r.role]] += r["count"]
    log = np.log(move / move.sum(1, keepdims=True))
    emit = {s: {} for s in SYMBOLS}
    for r in seen:
        emit[r.feature].setdefault(r.value, np.full(len(ROLES), 0.5))[at[r.role]] += r["count"]
    for s, values in emit.items():
        total = sum(values.values()) + 1.0 if values else np.ones(len(ROLES))
        emit[s] = {v: np.log(c / total) for v, c in values.items()} | {None: np.log(0.5 / total)}
    for role in ROLES:  # a marker says its role even where the known turns have none
        emit["marker"].setdefault(role, np.where(np.arange(len(ROLES)) == at[role], 0.0, -6.0) + emit["marker"][None].max())
    return {"start": log[-1], "move": log[:-1], "emit": emit}


def _emissions(model):
    """(key, fold, turn, part, symbols...) to (key, fold, turn, part, one log-probability for each role)."""

    def run(batches):
        for batch in batches:
            score = np.zeros((batch.num_rows, len(ROLES)))
            fold = batch.column(1).to_pylist()
            for i, s in enumerate(SYMBOLS):
                if batch.num_rows:
                    looks = [m["emit"][s] for m in model.value]
                    score += np.stack([looks[f].get(v, looks[f][None]) for f, v in zip(fold, batch.column(i + 4).to_pylist())])
            columns = [pa.array(score[:, j].copy()) for j in range(len(ROLES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["key", "fold", "turn", "part", *ROLES])

    return run


def _groups(batches, keys: int):
    for t in whole_groups(batches, keys):
        cols = [t.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *new], [*new, t.num_rows]):
            yield t.slice(lo, hi - lo)


def _matrix(t: pa.Table, first: int) -> np.ndarray:
    return np.stack([t.column(first + j).to_numpy() for j in range(len(ROLES))], 1)


def _through(model):
    """Sorted (key, chunk, fold, turn, part, scores) to (key, chunk, best scores from the state before to the last state, row by row)."""

    def run(batches):
        for t in _groups(batches, 2):
            m = model.value[t.column(2)[0].as_py()]
            move, e = m["move"], _matrix(t, 5)
            best = np.vstack([move + e[0], m["start"] + e[0]])  # rows: state before the chunk, then none
            for row in e[1:]:
                best = (best[:, :, None] + move[None]).max(1) + row
            arrays = [t.column(0).slice(0, 1).combine_chunks(), t.column(1).slice(0, 1).combine_chunks(), pa.array([best.ravel().tolist()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "chunk", "best"])

    return run


def _chain(batches):
    """Sorted (key, chunk, best) to (key, chunk, state before, last state); state before of the first chunk is len(ROLES)."""
    n = len(ROLES)
    for t in _groups(batches, 1):
        best = np.array(t.column(2).to_pylist()).reshape(-1, n + 1, n)
        score, back = best[0, n], []
        for b in best[1:]:
            paths = score[:, None] + b[:n]
            back.append(paths.argmax(0))
            score = paths.max(0)
        ends = [int(score.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        arrays = [t.column(0).combine_chunks(), t.column(1).combine_chunks(), pa.array([n, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "chunk", "before", "last"])


def _trace(model):
    """Sorted (key, chunk, fold, turn, part, scores, before, last) to (key, turn, part, role)."""

    def run(batches):
        n = len(ROLES)
        for t in _groups(batches, 2):
            m, e = model.value[t.column(2)[0].as_py()], _matrix(t, 5)
            move = m["move"]
            before, last = t.column(5 + n)[0].as_py(), t.column(6 + n)[0].as_py()
            score, back = (m["start"] if before == n else move[before]) + e[0], []
            for row in e[1:]:
                paths = score[:, None] + move
                back.append(paths.argmax(0))
                score = paths.max(0) + row
            states = [last]
            for b in reversed(back):
                states.append(int(b[states[-1]]))
            roles = pa.array([ROLES[s] for s in states[::-1]])
            yield pa.RecordBatch.from_arrays([t.column(i).combine_chunks() for i in (0, 3, 4)] + [roles], ["key", "turn", "part", "recovered"])

    return run


def format_chats(
    spark: SparkSession, turns: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", chunk: int = 4096, folds: int = 5, trust: bool = False
) -> DataFrame:
    """(conv_id, turn, part, role, given, rendered) per part of each row: the recovered role and the canonical rendering.

    A text is one part, or several where lines inside start with speaker markers. role is what the model says from
    the text and its place; no conversation's own roles teach the model that labels it (conversations are dealt to
    ``folds`` folds, each labelled by what the others teach). given is the role of the row, lower-cased and
    trimmed; with trust a known one decides over the model where the text is one part. rendered is <|role|>, the text without
    its speaker marker, and <|end|>, on lines of their own. Turns of one conversation and number are one step of the
    model. Null texts are empty, null turns stand before all others, null conversations are one, apart from all others;
    unknown roles teach nothing; without any known role all are recovered from even odds and markers. Very long texts are one row; extra
    columns are ignored; empty tables give no rows.
    """
    role = F.lower(F.trim(F.col(role_col)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62)))
    key = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit(""))
    fold = F.pmod(F.crc32(key), F.lit(folds)).cast("int")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("given_turn"), key.alias("key"), fold.alias("fold"), turn.alias("turn"), role.alias("given"), parted(text).alias("texts"))
    rows = rows.select("conv_id", "given_turn", "key", "fold", "turn", "given", F.size("texts").alias("parts"), F.posexplode("texts").alias("part", "text"))
    marks = symbols(F.col("text"), F.col("turn"), F.col("part"))
    marked = rows.select("key", "fold", "turn", "part", "parts", F.col("given").alias("role"), *[c.alias(n) for n, c in marks.items()])
    marked = kept(spark, marked, "turn_symbols")
    model = spark.sparkContext.broadcast(train(marked, folds))
    scores = ", ".join(f"{r} double" for r in ROLES)
    place = ["key", "fold", "turn", "part"]
    emitted = marked.select(*place, *SYMBOLS).mapInArrow(_emissions(model), f"key string, fold int, turn long, part int, {scores}")
    emitted = emitted.groupBy(*place).agg(*[F.sum(r).alias(r) for r in ROLES])
    emitted = emitted.select("key", F.floor(F.col("turn") / chunk).alias("chunk"), "fold", "turn", "part", *ROLES)
    emitted = kept(spark, emitted, "turn_scores")
    order = ["key", "chunk", "turn", "part"]
    by_chunk = emitted.repartition("key", "chunk").sortWithinPartitions(*order)
    through = kept(spark, by_chunk.mapInArrow(_through(model), "key string, chunk long, best array<double>"), "chunk_paths")
    chained = through.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_chain, "key string, chunk long, before int, last int")
    chained = kept(spark, chained, "chunk_ends")
    both = emitted.join(chained, ["key", "chunk"]).select("key", "chunk", "fold", "turn", "part", *ROLES, "before", "last")
    traced = both.repartition("key", "chunk").sortWithinPartitions(*order).mapInArrow(_trace(model), "key string, turn long, part int, recovered string")
    traced = kept(spark, traced, "turn_roles")
    out = rows.join(traced, ["key", "turn", "part"])
    final = F.when(F.col("given").isin(*ROLES) & (F.col("parts") == 1) & F.lit(trust), F.col("given")).otherwise(F.col("recovered"))
    bare = F.col("text")  # without the marker that it starts with; a second one is what was said
    bare = marker_of(bare, {(r, p): F.regexp_replace(bare, p, "") for r, p in MARKERS + WEAK} | {None: bare})
    rendered = F.concat(F.lit("<|"), final, F.lit("|>\n"), F.trim(bare), F.lit("\n<|end|>"))
    return out.select("conv_id", F.col("given_turn").alias("turn"), F.col("part").cast("long").alias("part"), final.alias("role"), "given", rendered.alias("rendered"))

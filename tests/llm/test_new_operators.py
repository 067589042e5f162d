"""Manifests, token alignment and language-model scores against brute force, and helper names that clash."""

import collections
import gc
import hashlib
import math
import pathlib
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("wattline.llm.text")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from wattline.llm import align, chat, decontaminate, jaccard_join, lm, merkle, suffix_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, leaf string, g string, own string, block string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _fields(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def _fold(nodes):
    """The root of a run of nodes, and each node's siblings from below."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(proofs):
            a = at[i]
            p.append((nodes[a - 1], "") if a % 2 else ("", nodes[a + 1] if a + 1 < len(nodes) else ""))
            at[i] = a // 2
        nodes = [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0], proofs


def _manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], H(_fields(r[0], r[3], r[2], r[4], r[1])), r))
    out, tops, order = [], [], sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops.append(_fold([x[1] for x in groups[g]]))
    root, above = _fold([t[0] for t in tops])
    for g, (subroot, proofs), up in zip(order, tops, above):
        for (i, leaf, r), p in zip(groups[g], proofs):
            changed = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r[4] is not None
            h = H(_fields(r[0], r[3], r[2], r[4] + 1, r[1])) if changed else leaf
            for a, b in p + up:
                h = H(a, h, b)
            out.append((i, leaf, subroot, root, H(*[a + b for a, b in p + up]), h, h == root))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 0, 5), (7, 256, 257), (600, 4, 1)])
def test_manifest_equals_brute_force(spark, monkeypatch, sizes):
    rows = []
    for k, n in enumerate(sizes):
        for i in range(n):
            rows.append((1000 * k + 7 * i, None if i % 9 == 4 else f"text {i} ä", (None, "en", "", "Zä")[k % 4], "s" * (i % 3), None if i % 11 == 5 else i, "x", "x", "x", "x"))
    rows += [rows[0], (None, "t", "en", None, 3, "x", "x", "x", "x")]
    got = _got(merkle.verified(spark, spark.createDataFrame(rows[::-1], SCHEMA)))
    assert got == _manifest(rows)
    assert {r[6] for r in got} == ({True, False} if max(sizes) > 20 else {r[6] for r in got})


def test_manifest_of_several_tiers_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "SIZE", 4)
    rows = [(i, "t", ("en", "de")[i % 3 == 0], "s", i, "x", "x", "x", "x") for i in range(90)] + [(i, "t", f"l{i:03}", "s", i, "x", "x", "x", "x") for i in range(200, 240)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(merkle.verified(spark, df)) == _manifest(rows)
    assert merkle.verified(spark, df.limit(0)).collect() == []


PATHS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "one", "one", "Ünïcode and 中文字 mixed", "a  b   c\n\n d\t e ", "\nlead", "tail ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ odd ▁x", "x y   z\x1c w", "12345.678 isn't it's",
    "é é ́", "😀 emoji 👩‍👩‍👧", "don't " * 500 + "stop", "w" * 5000, "unbelievableness antidisestablishmentarianism " * 40, "\x00 nul", "ﬁ ligature ½", " 　 wide",
]


def _aligned_by_brute_force(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    v = align.vocabulary(*PATHS)
    out, counts = [], collections.Counter()
    for t in texts:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = [[table[i] for i in x] for x, table in zip(ids, (v.bytes_a, v.bytes_b))]
        if not t or any(b"".join(x) != (" " + t).encode() for x in raw):
            out.append((0, 0, 0, "", []))
            continue
        owner = [[k for k, token in enumerate(x) for _ in token] for x in raw]
        links = [(ids[0][x], ids[1][y]) for x, y in dict.fromkeys(zip(*owner))]
        counts.update(links)
        ends = [set(np.cumsum([len(y) for y in x]).tolist()) for x in raw]
        common = sorted(ends[0] & ends[1])
        cut = [np.searchsorted(np.cumsum([len(y) for y in x]), common).tolist() for x in raw]
        names, lo = [], [0, 0]
        for stops in zip(*cut):
            names.append("|".join(",".join(map(str, i[k : s + 1])) for i, k, s in zip(ids, lo, stops)))
            lo = [s + 1 for s in stops]
        out.append((len(ids[0]), len(ids[1]), len(names), ";".join(names), links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    full = [(*r[:3], len(r[4]), hashlib.sha256(r[3].encode()).hexdigest() if r[3] else "", r[3], sum(counts[p] == best[p[1]] for p in r[4]), sum(counts[p] for p in r[4])) for r in out]
    return full, counts


@pytest.mark.parametrize("block", [align.BLOCK, 50])
def test_alignment_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(align, "PIECE", 64 if block == 50 else align.PIECE)
    full, counts = _aligned_by_brute_force(TEXTS)
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(TEXTS)] + [(None, None, "x", "x")], "doc_id long, text string, block string, pair string")
    done, pairs = align.align(spark, df, *PATHS, block_links=block)
    columns = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum"]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in done.collect()}
    assert [got[i] for i in range(len(TEXTS))] == full and got[None] == (0, 0, 0, 0, "", "", 0, 0)
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == dict(counts)
    assert align.align(spark, df.limit(0), *PATHS)[0].count() == 0


def test_runs_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (sorted({n, *rng.choice(np.arange(1, n + 1), int(rng.integers(0, n)), False).tolist()}) for _ in range(2))
        if rng.random() < 0.3:
            b = sorted({*a, int(rng.integers(1, n + 1))})
        run_a, run_b, run_n, groups, links = align.runs(a, b)
        pairs = {(i + k, j + k) for i, j, m in zip(run_a, run_b, run_n) for k in range(m)} | set(zip(links[::2], links[1::2]))
        want = {(i, j) for i, e in enumerate(a) for j, f in enumerate(b) if min(e, f) > max([0, *a][i], [0, *b][j])}
        assert pairs == want
        assert sum(run_n) + len(groups) == len(set(a) & set(b))


def _tokens(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [*lower.split(), None]


def test_lm_scores_equal_brute_force(spark):
    sparse = {"bits": 200, "probes": 30}  # no question errs
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{int(i)}" for i in rng.zipf(1.4, int(rng.integers(0, 80))) % 400) for _ in range(120)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (501, "   ", "x"), (3, "again w1", "x"), (None, "w1 w2", "x"), (502, "never\x1cseen Ä", "x"), (503, "w1 " * 30_000, "x")]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    uni, bi = collections.Counter(), collections.Counter()
    for (_, t, _), h in zip(rows, held):
        if not h:
            w = _tokens(t)
            uni.update([*w, "begin"])
            bi.update(zip(["begin", *w], w))
    total, kinds = sum(uni.values()) - uni["begin"], len(uni) - ("begin" in uni)
    q = lambda n: lm.MEANS[np.searchsorted(lm.THRESHOLDS, n, "right")]
    share = lambda n: (n + 0.1) / (total + 0.1 * (kinds + 1))
    want = []
    for (i, t, _), h in zip(rows, held):
        w = _tokens(t)
        score = sum(math.log10((min(q(bi[a, b]), q(uni[a])) + 4.0 * share(q(uni[b]))) / (q(uni[a]) + 4.0)) for a, b in zip(["begin", *w], w))
        want.append((i, h, len(w), sum(uni[x] > 0 for x in w), total, sum(math.log10(share(uni[x])) for x in w), score))
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(5)
    for settings in ({}, {"most_words": 3}, {"most_bytes": 0}):
        got = sorted((tuple(r) for r in lm.score(spark, df, **settings, **sparse).collect()), key=str)
        assert [r[:5] for r in got] == [r[:5] for r in sorted(want, key=str)]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in sorted(want, key=str)])
    assert lm.score(spark, df.limit(0)).count() == 0


def test_lm_scores_are_the_same_in_any_chunks_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.4, int(rng.integers(0, 200))) % 900) for _ in range(300)] + [None, "", " \t", "x" * 40_000]
    df = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    scored = lambda: sorted((tuple(r) for r in lm.score(spark, df, bits=200, probes=30).collect()), key=str)
    want = scored()
    monkeypatch.setattr(lm, "SHARD", 500)  # about 450 shards, more than some chunks have words
    monkeypatch.setattr(lm, "HELD", 2_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got = scored()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want])


def test_lm_takes_little_disk_whatever_the_filter_is(spark, tmp_path):
    rng = np.random.default_rng(9)
    path = str(tmp_path / "documents")
    rows = [(i, " ".join(f"word{int(k)}" for k in rng.zipf(1.3, 2_000) % 40_000)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    held = lambda folder: sum(f.stat().st_size for f in pathlib.Path(folder).rglob("*") if f.is_file())
    folder = spark.conf.get("spark.local.dir")  # the session's shuffle files and shared folder
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(3)  # shuffle files of earlier tests go now, not meanwhile
    before = held(folder)
    assert lm.score(spark, spark.read.parquet(path), most_bytes=0).count() == len(rows)
    assert held(folder) - before < 6 * held(path)


def test_bloom_filter_errs_rarely_and_never_low():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 40_000).astype(np.uint64))
    times = rng.zipf(1.6, len(keys)).clip(1, 10**6)
    shard = lm.Filter.of(keys, times)
    level = np.searchsorted(lm.THRESHOLDS, times, "right")
    found = shard.levels(keys)
    assert (found >= level).all() and (found == level).mean() > 0.98
    assert (shard.levels(rng.integers(0, 1 << 63, 40_000).astype(np.uint64)) > 0).mean() < 0.02


PASSAGE = " ".join(f"p{i}" for i in range(60))
NAMES = ["_repeat_doc", "_repeat_found", "_nr", "_id", "_text", "_group", "_first", "_salt", "_parts", "n", "doc", "text_key", "row", "class", "key", "mask", "src", "hub", "far", "side", "kind", "repeat_id", "node", "component"]


@pytest.mark.parametrize("names", [NAMES[i : i + 8] for i in range(0, len(NAMES), 8)])
def test_stages_keep_columns_of_any_name(spark, names):
    rows = [(1, f"before {PASSAGE} after"), (2, f"other {PASSAGE} words"), (3, f"other {PASSAGE} words"), (4, None), (5, "short")]
    df = spark.createDataFrame([(*r, *[f"own{r[0]}"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "short")], "item_id long, text string")
    for left, ids in (
        (suffix_dedup.remove_repeats(spark, df).select(*df.columns), {1, 2, 3, 4, 5}),
        (jaccard_join.drop_near_duplicates(spark, df), {1, 2, 4, 5}),
        (decontaminate.drop_contaminated(spark, df, items), {1, 2, 3, 4}),
    ):
        got = left.collect()
        assert left.columns == df.columns and {r.doc_id for r in got} <= ids and len(got) >= 3
        assert all(r[n] == f"own{r.doc_id}" for r in got for n in names)


def test_chats_lose_no_words_and_lists_stay_whole(spark):
    rows = [(1, 0, "user", "User: Answer: yes or no?"), (1, 1, "assistant", "A: the first\nB: the second\nMe: third"), (2, 0, "user", "Q: why?\nA: because"), (2, 1, "assistant", "fine")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in chat.format_chats(spark, df).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.part, r.rendered))
    assert "Answer: yes or no?" in got[1, 0][0][1] and "User:" not in got[1, 0][0][1]
    assert len(got[1, 1]) == 1 and "A: the first\nB: the second\nMe: third" in got[1, 1][0][1]
    assert len(got[2, 0]) == 2

"""Archives, URL rules, the URL model on held-out hosts, and the pipeline's stages but toxicity, against plain Python."""

import base64
import collections
import hashlib
import random

import pytest

pytest.importorskip("wattline.llm.text")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from wattline.llm import entry, url_filter  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_archives_equal_hashlib(spark):
    pages = entry.table(spark, DATA, "pages").select("page_id", "html").collect()
    groups = collections.defaultdict(list)
    for r in pages:
        groups[(r.html or "").encode()].append(r.page_id)
    want = {}
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            want[i] = (len(payload), digest, "response", None) if i == max(ids) else (len(payload), digest, "revisit", max(ids))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in entry.op4_warc(spark, DATA).collect()}
    assert got == want


def _judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules_equal_brute_force(spark):
    pages = {r.page_id: r.url for r in entry.table(spark, DATA, "pages").select("page_id", "url").collect()}
    for r in entry.op8_url_filter(spark, DATA).collect():
        host, path, rule, verdict = _judged(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_url_model_on_hosts_that_it_has_not_seen(spark):
    labelled = url_filter.labelled_urls(spark).withColumn("fold", F.pmod(F.crc32(url_filter.host_of(F.col("url"))), F.lit(4))).cache()
    right = n = 0
    for k in range(4):
        test = labelled.where(F.col("fold") == k).select(F.monotonically_increasing_id().alias("page_id"), "url", "label")
        truth = {r.page_id: r.label for r in test.collect()}
        got = url_filter.judge(spark, test, rules=(), labelled=labelled.where(F.col("fold") != k))
        right += sum((r.verdict == "block") == bool(truth[r.page_id]) for r in got.collect())
        n += len(truth)
    print(f"held-out hosts: {right} of {n}")
    assert n == len(url_filter.BLOCKED) + len(url_filter.ALLOWED) and right >= 0.8 * n


def _shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_but_toxicity_equal_brute_force(spark):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared, item = words(70), words(14)
    texts = []
    for i in range(40):
        w = words(rng.randrange(30, 160))
        if i % 4 == 0:
            w[10:10] = shared
        if i % 9 == 0:
            w += item[:11]
        texts.append(w)
    for i in range(12):  # near copies: one word of many changed
        w = list(texts[i])
        w[len(w) // 2] = f"Changed{i}"
        texts.append(w)
    texts += [texts[3], [], item[:9]]
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in enumerate(texts)] + [(90, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.mode("overwrite").parquet(path := entry.shared_folder(spark) + "/brute/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, path.rsplit("/", 1)[0])
    got = {r.doc_id: r.text for r in docs.collect()}

    sets = {r[0]: _shingles(r[1]) for r in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    kept = [(i, t) for i, t, *_ in rows if root[i] == i]
    first = {}
    for i, t in kept:
        w = (t or "").split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    cut = {}
    for i, t in kept:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        cut[i] = None if t is None else [x for k, x in enumerate(w) if k not in gone]
    window = {tuple(item[k : k + 10]) for k in range(5)}
    want = {i: w for i, w in cut.items() if not any(tuple(w[k : k + 10]) in window for k in range(len(w or []) - 9))}
    assert {i: None if t is None else t.split() for i, t in got.items()} == want
    assert len(want) < len(kept) < len(rows)

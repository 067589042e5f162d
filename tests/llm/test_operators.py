"""Edge cases of the corpus operators, and brute force on small tables."""

import base64
import hashlib
import random

import pytest

pytest.importorskip("wattline.llm.text")

from wattline.llm import bpe, chat, decontaminate, entry, html_extract, itq, jaccard_join, suffix_dedup, toxicity, url_filter, warc  # noqa: E402

LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
DOCS = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "one"), (6, LONG), (7, LONG + " end"), (8, f"before {PASSAGE} after"), (9, f"other {PASSAGE} words"), (9, f"other {PASSAGE} words"), (None, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, class string")


def test_jaccard_edges(spark, docs):
    got = jaccard_join.jaccard_classes(spark, docs).collect()
    assert len(got) == len(DOCS)
    by = {r.doc_id: r for r in got}
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 3, 4, 4, 6, 6]
    assert by[1].n_shingles == by[3].n_shingles == 0 and by[4].n_shingles == 1 and by[None].component_id is None
    assert jaccard_join.jaccard_classes(spark, docs.limit(0)).count() == 0
    assert {r.doc_id for r in jaccard_join.drop_near_duplicates(spark, docs).collect()} == {1, 2, 3, 4, 6, 8, None}


def test_jaccard_chain_links_through_neighbours(spark):
    words = [f"a{i}" for i in range(100)]
    texts = [" ".join(words[k : k + 60]) for k in range(0, 12, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.jaccard_classes(spark, df, words=3, percent=90).collect()} == {0}


def test_suffix_dedup_edges(spark, docs):
    got = suffix_dedup.remove_repeats(spark, docs).collect()
    assert len(got) == len(DOCS)
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[4].text == "one" and by[8].text == DOCS[7][1]
    assert by[9].text == "other words" and by[7].text == "end" and by[9]["class"] == "x"
    assert suffix_dedup.remove_repeats(spark, docs.limit(0)).count() == 0


def _passages_by_brute_force(rows, least=50):
    """The words (by row) that stand in a run of ``least`` words that a smaller id has too."""
    words = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - least + 1):
            p = tuple(w[a : a + least])
            first[p] = min(i, first.get(p, i))
    out = []
    for i, w in words:
        out.append({a + j for a in range(len(w) - least + 1) if first[tuple(w[a : a + least])] < i for j in range(least)})
    return out


def test_suffix_dedup_finds_passages_around_frequent_lines(spark):
    rng = random.Random(1)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    lines, rows = [new(n) for n in (30, 35, 40, 45, 49, 49)], []
    parts = [new(rng.randrange(1, 40)) for _ in range(40)]
    for i in range(60):
        seq = []
        for _ in range(rng.randrange(2, 9)):
            seq += rng.choice(lines) if rng.random() < 0.6 else rng.choice(parts) if rng.random() < 0.7 else new(rng.randrange(1, 60))
        rows.append((i, " ".join(seq)))
    a, line, b = new(30), lines[2], new(30)
    rows += [(100, " ".join(new(5) + line + new(30) + a + line + b)), (101, " ".join(new(9) + a + line + b + new(9)))]  # the source has the line twice
    rows += [(102, "a " * 120), (103, "b " + "a " * 90)]
    want = dict(zip([i for i, _ in rows], _passages_by_brute_force(rows)))
    shuffled = rng.sample(rows, len(rows))
    got = suffix_dedup.remove_repeats(spark, spark.createDataFrame(shuffled, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert len(want[101]) == 100 and sum(map(bool, want.values())) > 10
    for r in got:
        assert {j for s in r.repeat_spans for j in range(s.start, s.stop)} == want[r.doc_id], r.doc_id
        assert r.text.split() == [w for j, w in enumerate(texts[r.doc_id].split()) if j not in want[r.doc_id]]


def test_decontamination_edges(spark, docs):
    items = spark.createDataFrame([(1, " ".join(f"P{i}" for i in range(5, 20))), (2, None), (3, ""), (4, "ONE"), (5, "no such")], "item_id long, text string")
    by = {r.doc_id: r for r in decontaminate.contamination(spark, docs, items).collect()}
    assert (by[8].n_hit, list(by[8]["items"])) == (15, [1]) and list(by[4]["items"]) == [4] and not by[1].contaminated and by[1].n_words == 0
    assert not any(r.contaminated for r in decontaminate.contamination(spark, docs, items.limit(0)).collect())
    assert {r.doc_id for r in decontaminate.contamination(spark, docs, items, block=5).where("contaminated").collect()} == {4, 5, 8, 9, None}
    near = spark.createDataFrame([(1, "a b x c d")], "doc_id long, text string")
    phrase = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert not decontaminate.contamination(spark, near, phrase, width=4).first().contaminated
    assert decontaminate.contamination(spark, near, phrase, width=4, slop=1).first().n_hit == 5


def test_bpe_round_trip_and_chunks(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = entry.ranks()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "it's we'll  x\n\n y", "é漢😀" * 50, "a" * 3000 + " " * 500 + "b", LONG[:5000]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.decode(spark, bpe.encode(spark, df, ranks, P.PATTERN, chunk=200, overlap=40), ranks).collect()}
    once = {r.doc_id: r for r in bpe.encode(spark, df, ranks, P.PATTERN, decoded=True, chunk=200, overlap=40).collect()}
    assert got == once
    for i, t in enumerate(texts):
        assert list(got[i].ids) == own.encode_ordinary(t or "") and bytes(got[i].decoded).decode() == (t or "")


def test_html_edges(spark):
    menu = "<div>" + " ".join(f"menu{i}" for i in range(12)) + "</div>"
    rows = [
        (1, "http://a.org/1", "<html><nav>x</nav><article><h1>T &amp; U</h1><p>one <b>two</b><br>three<p>four<div class='comments'>no</div></article><footer>f"),
        (2, None, None), (3, "http://a.org/3", ""), (4, "http://b.org/4", menu + "<p>first own text</p>"), (5, "http://b.org/5", menu + "<p>second own text</p>"),
        (6, "http://c.org", "<script>var t='</p>';</script><p>alone"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(spark, df).collect()}
    assert got == {1: "T & U\none two three\nfour", 2: "", 3: "", 4: "first own text", 5: "second own text", 6: "alone"}
    assert html_extract.extract(spark, df.limit(0)).count() == 0


def test_html_drops_only_runs_that_other_pages_have(spark):
    new = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    phrase, run, article = new("p", 5), new("r", 8), new("m", 40)
    rows = [
        (1, "http://a.org/1", f"<p>one two {phrase} three"), (2, "http://a.org/2", f"<p>{new('x', 20)} {phrase} {new('y', 20)}"),  # five words are no run of eight
        (3, "http://b.org/3", f"<p>{article}</p>"), (4, "http://b.org/4", f"<p>{article}</p>"),  # copies are no other page
        (5, "http://c.org/5", f"<p>{run} a</p><p>own five"), (6, "http://c.org/6", f"<p>b {run}</p><p>own six"), (7, "http://d.org/7", f"<p>{run}"),
    ]
    got = {r.page_id: r.text for r in html_extract.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: f"one two {phrase} three", 2: rows[1][2][3:], 3: article, 4: article, 5: "own five", 6: "own six", 7: run}


def test_html_looks_at_every_place_of_articles(spark):
    new = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    notices = [new(f"n{k}w", 8 + k) for k in range(5)]  # short runs between texts that differ
    often = new("often", 7)  # frequent words, but no run of eight
    page = lambda i: f"<p>{often}</p>" + "".join(f"<p>{t}</p>" for k, n in enumerate(notices) for t in (new(f"p{i}k{k}x", 25), n))
    rows = [(i, f"http://a.org/{i}", f"<article>{page(i)}</article>") for i in range(10)]
    rows += [(20 + i, f"http://b.org/{i}", f"<article><p>{notices[0]}</p><p>{new(f'q{i}x', 30)}</p></article>") for i in range(7)]  # too few pages
    rows += [(30, "http://c.org/1", f"<article><p>{new('left', 30)}</p><p>{notices[4]}</p><p>{new('right', 30)}</p></article>"), (31, "http://c.org/2", f"<p>{notices[4]}</p><p>own text")]
    got = {r.page_id: r for r in html_extract.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(10):
        assert got[i].text == "\n".join([often, *(new(f"p{i}k{k}x", 25) for k in range(5))]) and (got[i].n_dropped, got[i].n_repeated) == (5, 50)
    assert all(got[20 + i].text.startswith(notices[0]) for i in range(7))
    assert got[31].text == "own text" and got[30].n_repeated == 12  # pages beside one without an article send all their places


def test_warc_round_trip(spark):
    rows = [(1, "http://a/%0d\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 100_000), (None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(spark, warc.records(spark, df), entry.shared_folder(spark) + "/t-" + hashlib.sha1(str(id(df)).encode()).hexdigest())
    got = {(r.record_id, r.record_type): r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == 6
    assert got["<urn:page:1>", "revisit"].refers_to == "<urn:page:2>" and got["<urn:page:1>", "revisit"].target_uri == rows[0][1]
    assert bytes(got["<urn:page:5>", "response"].payload).decode() == rows[4][2] and got["<urn:page:3>", "revisit"].refers_to == "<urn:page:4>"
    assert got["<urn:page:4>", "response"].payload_digest == base64.b32encode(hashlib.sha1(b"").digest()).decode()
    wanted = warc.read_archives(spark, path).where("record_type = 'revisit' and refers_to = '<urn:page:2>'")
    assert [r.record_id for r in wanted.collect()] == ["<urn:page:1>"]


def test_url_rules(spark):
    urls = ["https://EN.Example.org/en/12?x#y", "http://example.org/es/", "http://a.com/fr/1", "http://x.com/de/", "no scheme", None, "http://org", "http://notexample.org/es/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(spark, df).collect()}
    assert [got[i].rule for i in range(8)] == ["example.org/en/1", "example.org/es/", "com/fr/", "com/de/", None, None, None, "org/"]
    assert [got[i].verdict for i in range(4)] == ["block", "block", "allow", "block"] and (got[0].host, got[0].path) == ("en.example.org", "/en/12")
    assert got[5].host == "" and got[5].verdict in ("allow", "block")


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.05], 0), (4, [0.0, 1.0], 0), (5, [1.0, 0.0], 1), (6, None, 0), (7, [0.0, 0.0], 0), (8, [float("nan"), 1.0], 0), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 0), (11, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(spark, df).collect()}
    assert [got[i] for i in (1, 2, 3, 10)] == [(3, 1, True), (3, 1, False), (3, 1, False), (3, 1, False)]
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 11))


def test_chat_recovers_roles_across_chunks(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", ("what is this?" if t % 2 == 0 else "It is a long answer. " * 9)) for c in range(20) for t in range(6)]
    turns += [(99, 0, None, "User: what is this?"), (99, 1, None, "It is a long answer. " * 9), (99, 2, None, None), (None, None, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    one = {(r.conv_id, r.turn): r for r in chat.format_chats(spark, df).collect()}
    two = {(r.conv_id, r.turn): r.role for r in chat.format_chats(spark, df, chunk=2).collect()}
    assert {k: r.role for k, r in one.items()} == two and len(one) == len(turns)
    assert one[99, 0].role == "user" and one[99, 1].role == "assistant" and one[99, 0].rendered == "<|user|>\nwhat is this?\n<|end|>"


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, None), (77, 1)], "doc_id long, toxic int")
    got = toxicity.score(spark, docs, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.score == 0 for r in toxicity.score(spark, docs, labels.limit(0)).collect())


def test_toxicity_held_out(spark):
    base = "the quick brown fox jumps over the lazy dog near a river bank today".split()
    rows = [(i, " ".join(base[(i + j) % 13] for j in range(40)) + (" you idiot moron" if i % 4 == 0 else "")) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    got = toxicity.score(spark, spark.createDataFrame(rows, "doc_id long, text string"), labels).where("held_out").collect()
    assert got and all(r.predicted == int(r.doc_id % 4 == 0) for r in got)

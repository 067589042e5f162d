"""Names that clash, exact blocks, other archives, hot keys, transcripts, and the pipeline as a whole."""

import gzip
import itertools
import os
import random
import tempfile

import numpy as np
import pytest

pytest.importorskip("wattline.llm.text")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from wattline.llm import chat, components, decontaminate, entry, html_extract, jaccard_join, suffix_dedup, text, toxicity, warc  # noqa: E402


def test_jaccard_meets_all_pairs_at_a_low_bound(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(20, 60)))) for i in range(60)]
    sets = {i: set(t.split()) for i, t in rows}
    parent = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 45 * len(sets[a] | sets[b]):
            x, y = parent[a], parent[b]
            parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(spark, df, words=1, percent=45, exact=True).collect()}
    assert got == parent and len(set(parent.values())) < 60
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(spark, df, words=1, percent=45).collect()} == parent


def test_all_blocks_are_keys():
    sets = [np.sort(text.mix(np.arange(1, n, dtype=np.uint64))) for n in (5, 900)]
    bands = np.array([jaccard_join.bands_of(len(s), 80)[0] for s in sets])
    keys, owner = jaccard_join.block_keys(sets, bands, 80, exact=True)
    assert [int((owner == i).sum()) for i in (0, 1)] == [b + 1 if b else 0 for b in (jaccard_join.most_apart(int(b), 80) for b in bands)]


def test_components_of_a_star_and_a_chain_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(text.hot_keys, "__defaults__", ("n", 50))
    links = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(399, 1030)]
    got = {r.node: r.component for r in components.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 400 + 61


def test_near_duplicates_go_by_row(spark):
    same = " ".join(f"s{i}" for i in range(30))
    rows = [(1, same, "a"), (1, same, "b"), (2, same, "c"), (2, "quite another text with words of its own here", "d"), (None, same, "e"), (5, "", "f"), (5, "", "g")]
    left = jaccard_join.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    names = sorted(r.source for r in left)
    assert names in (["a", "d", "e", "f", "g"], ["b", "d", "e", "f", "g"])
    assert jaccard_join.drop_near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination_gives_every_row_in_one_block_and_in_several(spark):
    words = " ".join(f"k{i}" for i in range(12))
    rows = [(1, words), (1, "clean"), (None, words), (None, "clean"), (2, words), (2, words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, words), (7, words), (8, " ".join(f"z{i}" for i in range(300)))], "item_id long, text string")
    for block in (200_000, 40):
        got = sorted((str(r.doc_id), r.n_hit, list(r["items"])) for r in decontaminate.contamination(spark, docs, items, block=block).collect())
        assert got == sorted((str(i), 12 if t == words else 0, [7] if t == words else []) for i, t in rows)
        assert decontaminate.drop_contaminated(spark, docs, items, block=block).count() == 2


@pytest.mark.parametrize("name", ["prediction", "rawPrediction", "probability", "features", "margin", "_x", "_score", "score", "held_out"])
def test_toxicity_with_clashing_columns(spark, name):
    rows = [(i, "you moron " * (i % 2) + f"word{i} some text here", i) for i in range(40)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {name} long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    done = toxicity.score(spark, docs, labels, carry=True)
    assert done.count() == 40 and sorted(done.columns) == sorted({*docs.columns, "held_out", "score", "predicted"})


def test_suffix_dedup_replaces_its_own_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, repeat_spans string")
    assert suffix_dedup.remove_repeats(spark, docs).columns == ["doc_id", "text", "repeat_n_words", "repeat_spans"]


def test_html_template_runs_go_even_inside_articles(spark):
    new = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    notice = new("notice", 30)
    rows = [(i, "http://A.org/" + str(i), f"<article><p>{new(f'p{i}x', 60)}</p><p>{notice}</p></article>") for i in range(10)]
    rows += [(20 + i, "http://b.org/" + str(i), f"<article><p>{new('same', 50)}</p><p>{new(f'q{i}x', 20)}</p></article>") for i in range(3)]  # too few pages to tell
    rows += [(30 + i, None, f"<p>{new('alone', 20)} {new(f'r{i}x', 9)}") for i in range(2)]  # no host: nothing shared
    rows += [(40 + i, "http://d.org/" + str(i), f"<p>{new('told', 60)}</p><p>{new(f's{i}x', 9)}</p>") for i in range(2)]  # an article told twice
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(spark, df).collect()}
    assert all(got[i].text == new(f"p{i}x", 60) and got[i].n_dropped == 1 and got[i].n_repeated >= 23 for i in range(10))
    assert all(got[20 + i].text == new("same", 50) + "\n" + new(f"q{i}x", 20) for i in range(3))
    assert all(got[30 + i].text.startswith("alone0") and got[40 + i].text.startswith("told0") for i in range(2))
    long = spark.createDataFrame([(1, "http://c.org", "<article><p>" + new("l", 100_000) + "</article>"), (1, "http://c.org", "<article><p>x</article>")], "page_id long, url string, html string")
    assert sorted(len(r.text) for r in html_extract.extract(spark, long).collect()) == [1, len(new("l", 100_000))]


def test_suffixes_meet_their_keys_in_one_join(spark):
    rows = spark.range(3000).selectExpr("if(id < 2500, 7, id) AS key", "id AS doc")
    met = suffix_dedup._with_each(rows, spark.range(2600).selectExpr("id AS key", "true AS mixed"), "key")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plan.count("SortMergeJoin") == 1 and "LeftOuter" not in plan  # no row is looked up in a table of hot keys
    assert met.count() == 2600 and met.where("key = 7").count() == 2500


def test_warc_reads_other_archives(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    head = lambda kind, i, size, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}:{i}>\r\n{more}Content-Length: {size}\r\n\r\n".encode()
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    body = lambda i: f"<p>page {i}\r\n\r\nmore".encode() * (i + 1)
    info = head("warcinfo", 0, 7) + b"made: x\r\n\r\n"
    kind = "Content-Type: application/http; msgtype=response\r\n"
    records = [info] + [head("response", i, len(http + body(i)), kind) + http + body(i) + b"\r\n\r\n" for i in range(5)]
    with open(f"{folder}/a.warc", "wb") as f:
        f.write(b"".join(records))
    with open(f"{folder}/b.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(r) for r in records))
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == 12
    by = {r.record_id: bytes(r.payload) for r in got}
    assert by["<urn:warcinfo:0>"] == b"made: x" and all(by[f"<urn:response:{i}>"] == body(i) for i in range(5))
    assert warc.read_archives(spark, folder).where("record_type = 'warcinfo'").count() == 2
    assert [r.payload_length for r in warc.read_archives(spark, folder, payload=False).where("record_id = '<urn:response:3>'").collect()] == [len(body(3))] * 2
    with open(f"{folder}/c.warc", "wb") as f:
        f.write(b"no archive at all")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_archives(spark, folder).collect()


def test_warc_ranges_that_split_a_file_give_every_record_once(spark):
    rows = [(i, f"http://h/{i}", os.urandom(400).hex()) for i in range(300)] + [(1000 + i, "u", "common") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(spark, warc.records(spark, df), entry.shared_folder(spark) + "/split-archives")
    back = spark.read.format("warc").option("splitbytes", "5000").load(path)
    assert sorted(r.record_id for r in back.collect()) == sorted(f"<urn:page:{i}>" for i, *_ in rows)
    assert back.where("record_type = 'revisit'").select("refers_to").distinct().collect()[0].refers_to == "<urn:page:1039>"
    assert warc.records(spark, df.limit(0)).count() == 0


def _viterbi(model, scores):
    """The best of all paths of roles."""
    best = None
    for path in itertools.product(range(len(chat.ROLES)), repeat=len(scores)):
        p = model["start"][path[0]] + sum(s[r] for s, r in zip(scores, path)) + sum(model["move"][a, b] for a, b in zip(path, path[1:]))
        best = max(best or (-np.inf,), (p, path))
    return best[1]


def test_chat_equals_brute_force_without_its_own_roles(spark):
    rng = random.Random(2)
    turns = []
    for c in range(40):
        for t in range(5):
            role = "system" if t == 0 and c % 4 == 0 else "user" if (t + (c % 4 == 0)) % 2 == 0 else "assistant"
            turns.append((c, t, role, " ".join(["word"] * rng.randrange(1, 8 if role == "user" else 60)) + ("?" if role == "user" and rng.random() < 0.6 else "")))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.role for r in chat.format_chats(spark, df, chunk=3).collect()}
    hidden = df.withColumn("role", F.when(F.col("conv_id") != 7, F.col("role")))
    alone = {(r.conv_id, r.turn): r.role for r in chat.format_chats(spark, hidden).where("conv_id = 7").collect()}
    assert alone == {k: v for k, v in got.items() if k[0] == 7}  # its own roles are no input
    assert sum(got[c, t] == r for c, t, r, _ in turns) > 0.8 * len(turns)
    marks = chat.symbols(F.col("text"), F.col("turn"), F.lit(0))
    rows = df.withColumn("key", F.concat(F.lit("c"), F.col("conv_id"))).withColumn("fold", F.pmod(F.crc32("key"), F.lit(5)).cast("int"))
    marked = rows.select("key", "fold", "conv_id", "turn", F.lit(0).alias("part"), F.lit(1).alias("parts"), "role", *[m.alias(n) for n, m in marks.items()])
    models = chat.train(marked, 5)
    seen = {}
    for r in marked.collect():
        emit = models[r.fold]["emit"]
        seen.setdefault((r.conv_id, r.fold), []).append((r.turn, sum(emit[s].get(r[s], emit[s][None]) for s in chat.SYMBOLS)))
    for (c, fold), steps in seen.items():
        path = _viterbi(models[fold], [s for _, s in sorted(steps, key=lambda x: x[0])])
        assert [chat.ROLES[i] for i in path] == [got[c, t] for t in range(5)]


def test_chat_parts_transcripts_and_edges(spark):
    told = "User: hi there\nhow are you\nAssistant: fine\n\nHuman: ok?"
    rows = [(1, 0, None, told), (1, 1, None, "bot: yes"), (None, None, None, None), (None, 0, "user", ""), (3, None, "user", "x " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn, r.part): r for r in chat.format_chats(spark, df).collect()}
    assert [(got[1, 0, i].role, got[1, 0, i].rendered.split("\n", 1)[1]) for i in range(3)] == [("user", "hi there\nhow are you\n<|end|>"), ("assistant", "fine\n<|end|>"), ("user", "ok?\n<|end|>")]
    assert len(got) == 7 and got[1, 1, 0].role == "assistant"
    assert chat.format_chats(spark, df.limit(0)).count() == 0


def test_components_raise_without_a_shared_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf, sparkContext = Conf, type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        text.shared_folder(Session)


def _stage_tables(spark, rows, extra=""):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, "doc_id long, text string, lang string" + extra).write.parquet(f"{folder}/documents.parquet")
    item = " ".join(f"bench{i}" for i in range(14))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], 0, int("moron" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] >= 1000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_does_each_stage(spark):
    rng = random.Random(9)
    new = lambda n: " ".join(f"t{rng.randrange(10**9)}" for _ in range(n))
    passage, near, item = new(60), new(80), " ".join(f"bench{i}" for i in range(14))
    rows = [(1, f"{new(20)} {passage} {new(20)}", "en"), (2, f"{new(20)} {passage} {new(20)}", "en"), (3, near, "en"), (4, near + " end", "en"), (5, f"{new(9)} {item}", "en")]
    rows += [(6, None, None), (7, "", "en"), (None, new(30), "en"), (8, new(5000), "de"), (9, "you moron you moron " + new(30), "en")]
    rows += [(1000 + i, new(30) + (" you moron you moron" if i % 2 else ""), "en") for i in range(300)]
    folder = _stage_tables(spark, rows)
    docs = entry.table(spark, folder, "documents")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = text.kept(spark, stage(spark, docs, folder), f"test_{name}")
        assert docs.columns == ["doc_id", "text", "lang"]
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 9 not in left["toxicity"] and {1, 2, 3, 4, 5, 6, 7, 8, None} <= left["toxicity"].keys()
    assert 4 not in left["jaccard_join"] and {1, 2, 3, 5, 6, 7, 8, None} <= left["jaccard_join"].keys()
    assert passage in left["suffix_dedup"][1] and "".join(left["suffix_dedup"][2].split()) == "".join(rows[1][1].replace(passage, "").split())
    assert 5 not in left["decontaminate"] and {1, 2, 3, 6, 7, 8, None} <= left["decontaminate"].keys()
    end = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert end.keys() == left["decontaminate"].keys() and end[7].n_tokens == 0 == end[6].n_tokens


def test_pipeline_of_an_empty_table_with_clashing_names(spark):
    folder = _stage_tables(spark, [], ", score double, class long, _row string, prediction long, n_chars int")
    docs = entry.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "score", "class", "_row", "prediction", "n_chars"]
    assert docs.count() == 0

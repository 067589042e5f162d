"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontaminate, html_extract, itq, jaccard_join, lm, merkle, suffix_dedup, toxicity, url_filter, warc
from .text import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(spark, docs, items)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"))
    removed = F.aggregate("repeat_spans", F.lit(0), lambda n, s: n + s.stop - s.start)
    return done.select("doc_id", "text", F.col("repeat_n_words").alias("n_words"), removed.alias("n_removed"), F.col("repeat_spans").alias("spans"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_extract.extract(spark, table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_words", "n_repeated", "n_dropped")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.records(spark, table(spark, sf_dir, "pages"), least=0)
    path = warc.write_archives(spark, rows, f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}")
    back = warc.read_archives(spark, path)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).cast("long")
    return back.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(spark, table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark, table(spark, sf_dir, "conversations"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def ranks() -> dict[bytes, int]:
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def coded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: the number of its ids, and digests of the ids and of the bytes they decode to."""
    done = bpe.encode(spark, docs, ranks(), public_tokenizers.PATTERN, decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(spark, table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    done, _ = align.align(spark, table(spark, sf_dir, "documents"), *paths, groups=False)
    return done.drop("groups")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_html_extract": op3_html_extract,
        "op4_warc": op4_warc,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_chat_format": op6_chat_format,
        "op7_toxicity": op7_toxicity,
        "op8_url_filter": op8_url_filter,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_token_alignment": op12_token_alignment,
        "op13_lm_scoring": op13_lm_scoring,
    }


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_ALNUM, _SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

DECONTAMINATE_SQL = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '{_ALNUM}') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({_lowered("text")}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
    FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
),
place AS (
    SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM doc, (SELECT DISTINCT k FROM win) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)
),
hit AS (SELECT doc_id, k, i, item_id FROM place JOIN win USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD_SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '{_SPACED}') AS w FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
    FROM doc
),
shingle AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
link AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT x, b FROM reach JOIN link ON y = a),
least_of AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least_of USING (doc_id)
"""


EMBEDDING_SQL = """
WITH RECURSIVE vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
link AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_sum(list_transform(a.x, lambda v: v * v)) > 0 AND list_sum(list_transform(b.x, lambda v: v * v)) > 0 AND list_cosine_similarity(a.x, b.x) >= 0.98
),
reach AS (SELECT vec_id AS x, vec_id AS y FROM vec UNION SELECT x, b FROM reach JOIN link ON y = a),
least_of AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM vec JOIN least_of USING (vec_id) LEFT JOIN degree USING (vec_id)
"""


#: crc32 of ASCII text, bit by bit.
_CRC32 = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)"""


def _field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _tree(name: str, nodes: str) -> str:
    """Levels of the trees over nodes (g, i, h), and each first node's siblings from below to the top."""
    return f"""
{name} AS (SELECT g, i, h, 0 AS level, count(*) OVER (PARTITION BY g) AS n FROM ({nodes})
    UNION ALL SELECT g, k AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, level + 1 AS level, (n + 1) // 2 AS n FROM (SELECT *, i // 2 AS k FROM {name} WHERE n > 1) GROUP BY g, k, level, n),
{name}_path AS (SELECT f.g, f.i AS leaf, s.level, s.n, s.i AS at FROM {name} f JOIN {name} s ON s.g = f.g AND s.i = f.i >> s.level WHERE f.level = 0),
{name}_proof AS (SELECT p.g, p.leaf, list({{'l': CASE WHEN p.at % 2 = 1 THEN coalesce(t.h, '') ELSE '' END, 'r': CASE WHEN p.at % 2 = 0 THEN coalesce(t.h, '') ELSE '' END}} ORDER BY p.level) FILTER (p.n > 1) AS proof
    FROM {name}_path p LEFT JOIN {name} t ON t.g = p.g AND t.level = p.level AND t.i = p.at + 1 - 2 * (p.at % 2) GROUP BY p.g, p.leaf)"""


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


MERKLE_SQL = f"""
WITH RECURSIVE base AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS h,
        CASE WHEN (4294967295 - ({_CRC32})) % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS changed FROM documents),
leaf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM base),
{_tree("node", "SELECT g, i, h FROM leaf")},
sub AS MATERIALIZED (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h FROM node WHERE n = 1),
{_tree("top", "SELECT g, i, h FROM sub")},
proved AS (SELECT f.doc_id, f.h AS leaf, f.changed, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(d.proof, []) || coalesce(l.proof, []) AS beside
    FROM leaf f JOIN node_proof d ON d.g = f.g AND d.leaf = f.i JOIN sub s ON s.lang = f.g JOIN top_proof l ON l.leaf = s.i),
done AS (SELECT *, list_reduce(list_concat([{{'l': changed, 'r': ''}}], beside), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM proved)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(beside, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": MERKLE_SQL, "op1_decontaminate": DECONTAMINATE_SQL, "op5_jaccard_join": JACCARD_SQL, "op9_embedding_dedup": EMBEDDING_SQL}

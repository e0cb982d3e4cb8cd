"""Queries of the corpus operators over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import chat, embeddings, exact_dedup, language_id, minhash, mixing, packing, substring_dedup, toxicity, url_filter
from linkloom.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


#: The chain: poor quality first, then toxicity.
CATEGORIES = [("poor", "1 - quality"), ("toxic", "toxic")]


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, threshold_pct=80)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(docs["doc_id"])))
    return language_id.identify(docs, model)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: In DuckDB's dialect.
ORACLES = {
    "op3_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
        ), p AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        link AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
        ), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
        SELECT doc_id, len(s) AS n_shingles, component_id, component_id = doc_id AS kept
        FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id
    """,
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
            WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_dot_product(x, x) > 0
        ), link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
        SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = vec_id) AS n_links, component_id, component_id = vec_id AS kept
        FROM embeddings JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = vec_id
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op1_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, '<|' || regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '|>' || chr(10) || regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') || chr(10) || '<|end|>' || chr(10) AS line,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
                   count(*) OVER (PARTITION BY conv_id) AS n
            FROM conversations
        ), p AS (
            SELECT conv_id, pos, n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t
        ), whole AS (SELECT min(conv_id) AS conv_id, prefix FROM p WHERE pos = n - 1 GROUP BY prefix),
        stay AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n - 1))
        SELECT conv_id, CAST(floor(pos / 256) AS BIGINT) AS segment, count(*) AS n_turns, string_agg(line, '' ORDER BY pos) AS text
        FROM t JOIN stay USING (conv_id) GROUP BY ALL
    """,
    "op7_url_filter": """
        WITH r AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
        ), u AS (
            SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM r
        ), f AS (
            SELECT *, CASE
                WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
            FROM u
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host LIKE '%spam%' OR host LIKE '%cheap-pills%' OR host LIKE '%casino%' THEN 'block' ELSE 'allow' END AS verdict
        FROM f
    """,
}


def oracle_sql() -> dict:
    return dict(ORACLES)

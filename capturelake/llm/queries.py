"""The queries of this package: one ``opN_<name>`` for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from capturelake.llm import oracles
from capturelake.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.html_extraction import page_texts

    return page_texts(table(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.warc import page_derivatives

    return page_derivatives(table(spark, sf_dir, "pages"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.language import languages_of

    return languages_of(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.sharding import shards_of

    return shards_of(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.personal_data import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_window_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.panes import click_panes

    return click_panes(table(spark, sf_dir, "clicks"))


def op12_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.suffixes import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from capturelake.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op5_near_duplicates": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS e FROM d, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 1))) AS i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
        SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
        FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op10_benchmark_decontamination": rf"""
        WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + 9], ' ') AS t FROM i, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS k) WHERE len(w) > 0),
        dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM iw), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)),
        hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, t)),
        words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, LATERAL (SELECT unnest(range(k, k + n)) AS j) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_window_panes": oracles.PANES,
    "op12_repeated_strings": oracles.REPEATS,
    "op13_merkle_manifest": oracles.MERKLE,
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that it can express; tests hold the others against brute force."""
    return dict(ORACLES)

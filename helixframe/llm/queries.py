"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing_report

    return mixing_report(_docs(spark, sf_dir))


def op2_warc_two_level_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_index import archive_report

    return archive_report(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import near_report

    return near_report(_docs(spark, sf_dir))


def op4_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_patience import scan_licenses

    return scan_licenses(_docs(spark, sf_dir)).selectExpr("doc_id", "license", "coverage", "n_finds", "array_join(transform(finds, x -> concat_ws(':', x.template, x.start, x.end)), ',') AS finds")


def op5_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_mcd import quality_report

    return quality_report(_docs(spark, sf_dir))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_rollup import rollup_report

    return rollup_report(_docs(spark, sf_dir), {"byte_bpe_50k": vocabulary()})


def op7_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_docs(spark, sf_dir), vocabulary(), keep_ids=False)


def op8_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup_report

    return dedup_report(_docs(spark, sf_dir))


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shard_shuffle import shard_report

    return shard_report(_docs(spark, sf_dir))


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_weak import pii_report

    return pii_report(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_raked_mixture, op2_warc_two_level_index, op3_order_minhash, op4_license_patience, op5_quality_mcd, op6_token_rollup, op7_exact_complement_packing, op8_patricia_owners, op9_external_shuffle, op10_weak_pii)}


ORACLE = {
    "op2_warc_two_level_index": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM o""",
    "op8_patricia_owners": r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

"""Queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import ann, minhash, mixing, packing, pii, secrets, tiff, tokens, toxicity, warc
from scorelake.llm._common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, among all vectors."""
    return ann.neighbours(table(spark, sf_dir, "embeddings")).withColumn("score", F.round("score", 5))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.prefix_table(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.measured(table(spark, sf_dir, "documents")))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as TIFF media, decoded again: properties of every page and least, greatest and total of its samples."""
    pages = tiff.pages(tiff.from_vectors(table(spark, sf_dir, "embeddings")), "key", "data")
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x)
    return pages.select(
        F.col("key").alias("vec_id"), "page", "width", "height", "bits", "format", "compression", "predictor", "blocks",
        F.array_min("pixels").alias("least"), F.array_max("pixels").alias("greatest"), F.round(total, 4).alias("total"), "error",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files, read back by the chain of their records."""
    files = warc.write(table(spark, sf_dir, "pages"), warc.folder_of(spark, "warc"))
    found = warc.records(files).filter("type = 'resource'")
    number = F.regexp_extract("record_id", r"urn:page:(\d+)", 1).try_cast("long")
    return found.select(number.alias("page_id"), F.col("uri").alias("url"), F.length("payload").cast("long").alias("n_bytes"), F.md5("payload").alias("digest"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_ann, op3_secrets, op4_tokens, op5_toxicity, op6_pii, op7_packing, op8_tiff, op9_warc, op10_minhash)}


_TIFF = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
w AS (SELECT vec_id, e, list_transform(e, lambda x: least(greatest((x + 1) / 2, 0), 1)) AS u FROM v),
p AS (SELECT vec_id, 0 AS page, 32 AS bits, 'float' AS format, 'deflate' AS compression, 3 AS predictor, 1 AS blocks, e AS x FROM w
UNION ALL SELECT vec_id, 1, 8, 'uint', 'lzw', 2, 2, list_transform(u, lambda x: floor(x * 255)) FROM w
UNION ALL SELECT vec_id, 2, 16, 'uint', 'packbits', 1, 1, list_transform(u, lambda x: floor(x * 65535)) FROM w)
SELECT vec_id, CAST(page AS INTEGER) AS page, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, CAST(bits AS INTEGER) AS bits, format, compression, CAST(predictor AS INTEGER) AS predictor,
CAST(blocks AS INTEGER) AS blocks, list_min(x) AS least, list_max(x) AS greatest, round(list_sum(x), 4) AS total, CAST(NULL AS VARCHAR) AS error FROM p"""

_WARC = "SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, md5(coalesce(html, '')) AS digest FROM pages"


def oracle_sql() -> dict[str, str]:
    return {"op2_ann": ann.oracle(), "op7_packing": packing.oracle(), "op8_tiff": _TIFF, "op9_warc": _WARC}

"""Vault frames over ready-made tables: documents as plain text, conversations as sections by turn, pages as HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import first_line, word_count

HREF = r'(?i)<a\s[^>]*?href="([^"]*)"'


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section per document; tags are its language and source."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")))
    return read(spark, sf_dir, "documents").select(
        "doc_id", path.alias("path"), F.lit(0).alias("sec_no"), F.lit(1).cast("long").alias("line"), first_line(F.col("text"), 60).alias("heading"), F.col("text").alias("content"),
        F.substr(F.trim(F.substring_index("text", "\n", 1)), F.lit(1), F.lit(80)).alias("title"), F.array("lang", "source").alias("tags"), F.array().cast("array<string>").alias("aliases"),
    )


def document_files(scan: DataFrame) -> DataFrame:
    return scan.select("doc_id", "path", "title", word_count(F.col("content")).alias("words"), F.sha2("content", 256).alias("sha"), "tags", "aliases")


def conversation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("conv-"), "conv_id")
    return read(spark, sf_dir, "conversations").select(
        "conv_id", F.concat(F.lit("conv/"), "conv_id", F.lit(".md")).alias("path"), F.col("turn").cast("int").alias("sec_no"), F.col("turn").alias("line"), F.col("role").alias("heading"),
        F.col("text").alias("content"), name.alias("title"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("aliases"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): the links of every page, as often as they stand."""
    return read(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("dst"))

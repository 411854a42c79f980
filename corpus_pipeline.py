"""The corpus pipeline: five stages from raw documents to a weighted training mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one. All
but the last return the columns of ``documents``; the last adds ``copy_no`` and ``shuffle_key``. A stage drops rows by a key its
operator decided on: the id, or a hash of id and text where the id is null or has several texts. Rows that repeat id and text
are one document, of which exact dedup keeps one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import cut
from quillgrid.llm.decontaminate import contamination
from quillgrid.llm.exact_dedup import exact_duplicates
from quillgrid.llm.langid import identify_languages
from quillgrid.llm.mixing import mix_sources
from quillgrid.llm.near_dup import near_duplicates


#: Keys made of hashes are at least this large, so that they come after all ids where the smallest stays.
HASHED = 1 << 62


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the documents has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _key_of(docs: DataFrame) -> str:
    """The name of the row key."""
    return _free(docs, "__key")


def _shared(docs: DataFrame) -> DataFrame:
    """(shared_id, mixed, under names that the documents leave free) of the ids that are null or on several rows; ``mixed`` are null ones and those with several texts."""
    h = F.xxhash64("text")
    per = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(h).alias("low"), F.max(h).alias("high")).where("n > 1 or doc_id is null")
    return cut(per.select(F.col("doc_id").alias(_free(docs, "shared_id")), (F.col("doc_id").isNull() | (F.col("low") != F.col("high"))).alias(_free(docs, "mixed"))))


def _keyed(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``docs`` with the row key, which is never null."""
    hashed = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(HASHED - 1)).bitwiseOR(F.lit(HASHED))
    return docs.join(shared, F.col("doc_id").eqNullSafe(F.col(_free(docs, "shared_id"))), "left").select(*docs.columns, F.when(F.coalesce(_free(docs, "mixed"), F.lit(False)), hashed).otherwise(F.col("doc_id")).alias(_key_of(docs)))


def _without(keyed: DataFrame, key: str, decisions: DataFrame, gone: str) -> DataFrame:
    """``keyed`` less the keys of the decisions for which ``gone`` holds; the keys are a table of known size, which Spark broadcasts if it is small."""
    return keyed.join(cut(decisions.where(gone).select(key).distinct()), key, "left_anti").select(*(c for c in keyed.columns if c != key))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the labelled documents are in."""
    keyed, key = _keyed(docs, _shared(docs)), _key_of(docs)
    return _without(keyed, key, identify_languages(keyed, keyed, id_col=key), "rejected")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; of rows that repeat id and text the smallest by all columns."""
    shared = _shared(docs)
    keyed, key = _keyed(docs, shared), _key_of(docs)
    of = F.col("doc_id").eqNullSafe(F.col(_free(docs, "shared_id")))
    one = keyed.join(shared, of, "left_semi").groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*", key)
    single = keyed.join(shared, of, "left_anti").unionByName(one)
    return _without(single, key, exact_duplicates(keyed, id_col=key), "not kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    keyed, key = _keyed(docs, _shared(docs)), _key_of(docs)
    return _without(keyed, key, near_duplicates(keyed, id_col=key, words=5, percent=80), "not kept")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed, key = _keyed(docs, _shared(docs)), _key_of(docs)
    return _without(keyed, key, contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key), "contaminated")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: copies of documents by source, in a random global order."""
    return mix_sources(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix)]

#: A language model decides in the first stage, which SQL can't say; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else cut(docs), sf_dir)
    return docs

"""Line dedup in DataFrame operations: lines are exploded, hashed, counted over documents and reassembled by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, let


def drop_repeated_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document without the lines that many documents share.

    A line's key is the line without blanks at either end, A-Z folded. Keys of at least ``min_chars`` code points that
    occur in at least ``min_docs`` documents lose all their lines but those of the largest id that holds the key.

    Null or empty text is one empty line. Rows count as one document when id and text are equal; with a null id they
    count too, but keep a shared line only if no row with an id holds it. Repeated rows each give the same result.
    Other columns are ignored. Only (id, position, hash) rows and the texts themselves are shuffled, each once; a line
    that very many documents share is counted map-side and its rows are joined with one row.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    lines = docs.select("id", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("id", "version", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    hashed = cut(keys.select("id", "version", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))
    held = hashed.groupBy("h1", "h2", "id", "version").agg(F.lit(1).alias("one"))
    shared = cut(held.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs).select("h1", "h2", "keeper"))
    lost = hashed.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = cut(lost.groupBy("id", "version").agg(F.collect_set("pos").alias("lost")))
    there = docs.alias("d").join(lost.alias("x"), F.expr("d.id <=> x.id and d.version = x.version"), "left")
    n = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"))) + 1
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost"))
    kept = let(F.split("text", "\n"), lambda all_lines: F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n"))
    return there.select(
        F.col("d.id").alias(id_col),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept).alias(text_col),
        n.cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
    )

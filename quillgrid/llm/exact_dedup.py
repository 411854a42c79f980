"""Exact dedup of an incoming batch against an immutable snapshot, by way of binary-fuse filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse_filter
from .common import BLANKS, cut, drop

#: Digests of a filter, on average; the number of filters follows from the snapshot's size.
FILTER_KEYS = 400_000


def squeezed(text: Column) -> Column:
    """The text without any blank; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank))
    return out


def _best(rows: DataFrame) -> DataFrame:
    """(sha, n, chars, id) of each digest: its rows and the row that stays (most code points, then the smallest id; a null id last)."""
    return rows.groupBy("sha").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id")).alias("b")).select("sha", "n", (-F.col("b.less")).alias("chars"), F.col("b.id").alias("id"))


def _key() -> Column:
    return F.xxhash64("sha")


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) over the distinct digests ``snapshot.sha``; a bucket's keys are bounded, as digests spread evenly."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "filter": [fuse_filter.build(np.unique(rows["h"].to_numpy().view(np.uint64)))]})

    keyed = snapshot.select(_key().alias("h")).select(F.pmod("h", F.lit(buckets)).alias("bucket"), "h")
    return keyed.groupBy("bucket").applyInPandas(run, "bucket long, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(sha) of the distinct incoming digests that their bucket's filter may hold."""

    def run(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if not len(of):
            return rows.iloc[:0][["sha"]]
        return rows[fuse_filter.contains(of["filter"].iloc[0], rows["h"].to_numpy().view(np.uint64))][["sha"]]

    keyed = incoming.select("sha", _key().alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(run, "sha string")


def _same_bytes(matches: DataFrame, texts: DataFrame) -> DataFrame:
    """(sha) of the matches whose two texts, snapshot ``old`` and incoming ``new``, are equal byte for byte."""
    a = texts.select(F.col("id").alias("old"), "sha", F.col("squeezed").alias("a"))
    b = texts.select(F.col("id").alias("new"), "sha", F.col("squeezed").alias("b"))
    both = matches.join(a, (matches["old"].eqNullSafe(a["old"])) & (matches["sha"] == a["sha"])).select(matches["sha"], "new", "a")
    return both.join(b, (both["new"].eqNullSafe(b["new"])) & (both["sha"] == b["sha"])).where("a = b").select(both["sha"]).distinct()


def exact_duplicates(documents: DataFrame, *, snapshot: Column | None = None, id_col: str = "doc_id", text_col: str = "text", filter_keys: int = FILTER_KEYS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``documents``.

    Rows for which ``snapshot`` is true are the immutable snapshot, the others the incoming batch (by default three
    quarters and one quarter, by a hash of the id). The snapshot's distinct digests are spread over buckets, each with
    a static binary-fuse filter. Incoming digests, one per text, are screened by the filter of their bucket. Positives
    join the snapshot on the exact digest and then have their bytes checked; the rest are grouped among themselves.

    Texts are equal when identical without blanks ([\\x20\\x09-\\x0D]); null is the empty text. Of equal texts the row with
    the most code points, then the smallest id (null last), stays; rows that repeat its id and text stay with it. Other columns are ignored.
    Only digests are grouped; of the texts themselves one per matched digest and side is compared. A text with very
    many copies is counted map-side and its rows are joined with one row.
    """
    old = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) != 0 if snapshot is None else F.coalesce(snapshot, F.lit(False))
    text = F.col(text_col)
    chars = F.coalesce(F.char_length(text), F.lit(0))
    rows = cut(documents.select(F.col(id_col).alias("id"), F.sha2(squeezed(text), 256).alias("sha"), chars.alias("chars"), old.alias("old")))
    kept, fresh = cut(_best(rows.where("old"))), cut(_best(rows.where("not old")))
    buckets = 1 + kept.count() // filter_keys
    filters = cut(build_filters(kept.select("sha"), buckets))
    maybe = screen(fresh.select("sha"), filters, buckets)
    matches = cut(maybe.join(kept.select("sha", F.col("id").alias("old")), "sha").join(fresh.select("sha", F.col("id").alias("new")), "sha"))
    ids = matches.select(F.col("old").alias("id"), "sha").unionByName(matches.select(F.col("new").alias("id"), "sha")).distinct()
    held = cut(ids.select(F.col("id").alias("rep")).distinct())
    named = documents.select(F.col(id_col).alias("id"), text.alias("text"))
    texts = named.join(held, F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("id", squeezed(F.col("text")).alias("squeezed")).withColumn("sha", F.sha2("squeezed", 256))
    same = cut(_same_bytes(matches, texts))
    shared = cut(_merged(kept, fresh, same))
    drop(kept, fresh, filters, matches, held, same)
    out = rows.join(shared, (rows["sha"] == shared["of"]) & (rows["old"] == shared["part"]))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def _merged(kept: DataFrame, fresh: DataFrame, same: DataFrame) -> DataFrame:
    """(of, part, n, keep_id) of each digest and part (snapshot or incoming): matched digests are one group, others one per part."""
    parts = kept.withColumn("part", F.lit(True)).unionByName(fresh.withColumn("part", F.lit(False)))
    tagged = parts.join(same.select("sha", F.lit(True).alias("both")), "sha", "left").withColumn("class", F.when(F.col("both"), F.lit(True)).otherwise(F.col("part")))
    order = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id")
    groups = tagged.groupBy("sha", "class").agg(F.sum("n").alias("n"), F.min(order).alias("b"), F.collect_set("part").alias("parts"))
    return groups.select(F.col("sha").alias("of"), F.explode("parts").alias("part"), "n", F.col("b.id").alias("keep_id"))

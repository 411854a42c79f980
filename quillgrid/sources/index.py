"""An index that outlives the session: the vault's tables in buckets by path, of which an update rewrites only those it touches, trigram postings, and words with their document frequencies.

A table is a folder of buckets (a hash of the document's path). Every bucket holds a marker row without a path, so that a bucket whose
last document goes is overwritten too. ``files`` is written last: after a crash in between, its rows still show what was to be read,
and the next update reads it again. Frequencies are kept as counts of each bucket's documents, which a reader adds up: an update counts
touched buckets only, and doing so twice changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import IMAGES, PROSE, extension
from ..functions.tables import cut
from ..functions.terms import Query, least_variants
from ..operators.suggest import token_weights
from .vault import PARSER, Frames, with_images

#: The tables and the column that names the document of a row.
TABLES = {"sections": "path", "links": "src", "alts": "src", "grams": "path", "tokens": "path", "files": "path"}
#: The order in a bucket, where it is not that of documents.
ORDER = {"grams": ["gram", "path"], "counts": ["token"]}
#: Trigrams in more than this part of the documents (and in so many at least) have no postings: they would hardly narrow a search.
COMMON, COMMON_LEAST = 0.1, 64
#: Up to so many candidates are named in the scan itself, which then skips files and row groups; more are joined.
NAMED = 1_000
BLANKS = " \t\n\x0b\f\r"


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters without white space."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(\S{3}))"), F.lit(1)))


def term_grams(term: str) -> list[str]:
    """Trigrams that any text with the term has; none for terms without three characters in a row."""
    return sorted({term[k : k + 3] for k in range(len(term) - 2) if not set(term[k : k + 3]) & set(BLANKS)})


class KeptIndex:
    """``path`` is a folder that Spark can write; ``buckets`` counts when the index is made, and stays."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._table("files").agg(F.max("bucket")).first()[0] + 1 if self.exists() else buckets

    def _made(self):
        """The mark of an index that was made whole, and its file system."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_made2")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()), mark

    def exists(self) -> bool:
        fs, mark = self._made()
        return fs.exists(mark)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _rows(self, name: str) -> DataFrame:
        return self._table(name).where(F.col(TABLES[name]).isNotNull())

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """``rows`` as the new content of ``buckets``; the others stay as they are."""
        marks = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket")).where(F.col("bucket").isin(buckets))
        dealt = rows if "bucket" in rows.columns else rows.withColumn("bucket", self._bucket(F.col(TABLES[name])))
        dealt = dealt.unionByName(marks, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", *ORDER.get(name, [TABLES.get(name)]))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _grams(self, sections: DataFrame, common: DataFrame | None) -> DataFrame:
        """(path, gram) of all fields that search looks at."""
        fields = F.lower(F.concat_ws(" ", "title", "path", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), "heading", "content"))
        found = sections.select("path", F.explode(trigrams(fields)).alias("gram")).distinct()
        return found if common is None else found.join(common, "gram", "left_anti")

    def _tokens(self, sections: DataFrame) -> DataFrame:
        """(path, token, weight) of prose, by which documents are found to be alike."""
        return token_weights(sections.where(extension(F.col("path")).isin(*PROSE)))

    def _count(self, buckets: list[int]) -> None:
        """Count the words of ``buckets`` as their tokens are now."""
        self._write("counts", cut(self._rows("tokens").where(F.col("bucket").isin(buckets)).groupBy("bucket", "token").agg(F.count("*").alias("n"))), buckets)

    def words(self) -> tuple[DataFrame, DataFrame]:
        """(path, token, weight), and (token, d): the number of documents with a word. No text is read for either."""
        counts = self._table("counts").where("token is not null")
        return self._rows("tokens").drop("bucket"), counts.groupBy("token").agg(F.sum("n").alias("d"))

    def create(self, frames: Frames) -> Frames:
        """Write all tables of frames without images' sections (they depend on other documents and are made on opening)."""
        every, texts = list(range(self.buckets)), frames.sections
        grams = cut(self._grams(texts, None))
        n = frames.files.count()
        common = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > max(COMMON * n, COMMON_LEAST)).select("gram")
        common.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/common")
        tables = {"sections": texts, "links": frames.links, "alts": frames.alts, "grams": grams.join(self._table("common"), "gram", "left_anti"), "tokens": self._tokens(texts), "files": frames.files}
        for name, rows in tables.items():
            self._write(name, rows, every)
        self._count(every)
        fs, mark = self._made()
        fs.create(mark, True).close()
        return self.open()

    def open(self, parsed: DataFrame | None = None) -> Frames:
        """The frames as kept, without reading a document; ``parsed`` are those that an update just read."""
        files = self._rows("files").drop("bucket")
        nothing = files.select("path").where("false") if parsed is None else parsed
        return with_images(Frames(files, self._rows("sections"), self._rows("links").drop("bucket"), self._rows("alts").drop("bucket"), nothing))

    def same(self, now: DataFrame) -> DataFrame:
        """(path) of the files of ``now`` (path, mtime) that are indexed as they are, by this parser."""
        return now.join(self._rows("files").where(F.col("parser") == PARSER).select("path", "mtime"), ["path", "mtime"], "left_semi").select("path")

    def apply(self, new: Frames, same: DataFrame) -> list[int]:
        """Put the frames of new and changed documents in place and drop all that are neither these nor ``same``; returns the buckets that were rewritten."""
        gone = self._rows("files").select("path").join(same, "path", "left_anti")
        touched = cut(gone.unionByName(new.files.select("path")).distinct())
        buckets = sorted(r["bucket"] for r in touched.select(self._bucket(F.col("path")).alias("bucket")).distinct().collect())
        if not buckets:
            return []
        fresh = {"sections": new.sections, "links": new.links, "alts": new.alts, "grams": self._grams(new.sections, self._table("common")), "tokens": self._tokens(new.sections), "files": new.files}
        for name, rows in fresh.items():
            if name == "files":  # the last one
                self._count(buckets)
            key = TABLES[name]
            stay = self._rows(name).where(F.col("bucket").isin(buckets)).join(touched.withColumnRenamed("path", key), key, "left_anti").drop("bucket")
            self._write(name, cut(stay.unionByName(rows.select(stay.columns))), buckets)
        return buckets

    def candidates(self, queries: list[Query]) -> DataFrame | None:
        """(path) of all documents that may hold a plain term of any of the queries, and maybe more; None if nothing can be ruled out.

        A document may hold a term if it has all trigrams of one of its least variants. Trigrams that are too common to have postings count as had.
        """
        terms = {t for q in queries for t in q.plain}
        if not terms or any(not q.plain for q in queries):
            return None
        ways = [term_grams(v) for t in terms for v in least_variants(t)]
        common = {r["gram"] for r in self._table("common").where(F.col("gram").isin(sorted({g for w in ways for g in w}))).collect()}
        ways = [[g for g in w if g not in common] for w in ways]
        if not all(ways):
            return None
        grams = sorted({g for w in ways for g in w})
        per = self._rows("grams").where(F.col("gram").isin(grams)).groupBy("path").agg(*(F.max(F.col("gram") == g).alias(f"g{k}") for k, g in enumerate(grams)))
        fits = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(f"g{grams.index(g)}") for g in w)) for w in ways))
        images = self._rows("files").where(extension(F.col("path")).isin(*IMAGES)).select("path")  # their texts are made on opening
        return cut(per.where(fits).select("path").unionByName(images).distinct())

    def narrowed(self, scan: DataFrame, queries: list[Query]) -> DataFrame:
        """The rows of ``scan`` (of ``open``) that any of the queries may find."""
        found = self.candidates(queries)
        if found is None:
            return scan
        few = [r["path"] for r in found.limit(NAMED + 1).collect()]
        if len(few) > NAMED:
            return scan.join(found, "path", "left_semi")
        at = sorted({r["b"] for r in found.select(self._bucket(F.col("path")).alias("b")).distinct().collect()})
        return scan.where((F.col("bucket").isin(at) | F.col("bucket").isNull()) & F.col("path").isin(few))

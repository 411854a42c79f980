"""Streaming upserts: new and changed files of a folder, or any keyed stream, folded into a table of what each batch changed."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tables import cut
from ..operators.semlog import last_wins


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha, mtime, length) of files as they come in."""
    schema = spark.read.format("binaryFile").load(root).schema
    files = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha"), F.col("modificationTime").alias("mtime"), "length")


def upsert(stream: DataFrame, target: str, checkpoint: str, key: str, order: str, *, parser: int | None = None, most: int = 64) -> StreamingQuery:
    """Fold every micro-batch into ``target``: of each ``key`` the row of the greatest ``order`` stays.

    A batch writes its own rows only, one per key, to a folder named by its number; replaying it after a failure writes the same rows again.
    ``current`` puts the folders together. They are merged into a base when they hold as much as the one before, so a row is written again only
    as often as the table doubles, or when there are ``most`` of them. Every ``parser`` version has a table and a checkpoint of its own: a new one begins with all files.
    """
    target = of_parser(target, parser)

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _newest(batch, key, order).write.mode("overwrite").parquet(f"{target}/v{number:012d}")
        base, later = _split(_versions(spark, target))
        if len(later) >= most or len(later) > 1 and sum(_size(spark, f"{target}/{v}") for v in later) >= (_size(spark, f"{target}/{base}") if base else 0):
            compact(spark, target, key, order)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", of_parser(checkpoint, parser)).trigger(availableNow=True).queryName(f"upsert-{uuid.uuid4().hex[:8]}").start()


def of_parser(folder: str, parser: int | None) -> str:
    return folder if parser is None else f"{folder}/parser-{parser}"


def _fs(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _size(spark: SparkSession, folder: str) -> int:
    fs, path = _fs(spark, folder)
    return fs.getContentSummary(path).getLength()


def _versions(spark: SparkSession, target: str) -> list[str]:
    """The names of the whole folders, oldest first. After the number of the last batch before it, a list of deleted keys has another "s" and a base another "b"."""
    fs, path = _fs(spark, target)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def _next(last: str, kind: str) -> str:
    return f"{last}{'' if '-' in last else '-'}{kind}"


def _split(versions: list[str]) -> tuple[str | None, list[str]]:
    """The last base and what came after it."""
    bases = [k for k, v in enumerate(versions) if v.endswith("b")]
    return (versions[bases[-1]], versions[bases[-1] + 1 :]) if bases else (None, versions)


def current(spark: SparkSession, target: str, key: str, order: str, *, parser: int | None = None) -> DataFrame | None:
    """The table as of now, or None before the first batch. Of rows of one key, those that were written before its last deletion don't count, then the greatest ``order`` does, and of equal ones the last written."""
    target = of_parser(target, parser)
    base, later = _split(_versions(spark, target))
    rows = [v for v in ([base] if base else []) + later if not v.endswith("s")]
    if not rows:
        return None
    read = lambda v: spark.read.parquet(f"{target}/{v}").withColumn("__version", F.lit(v))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(read, rows))
    gone = [read(v) for v in later if v.endswith("s")]
    if gone:
        last = reduce(DataFrame.unionByName, gone).groupBy(F.col(key).alias("__gone")).agg(F.max("__version").alias("__until"))
        every = every.join(last, F.col(key).eqNullSafe(F.col("__gone")), "left").where("__until is null or __version > __until").drop("__gone", "__until")
    return (_newest(every, key, order, "__version") if len(rows) > 1 else every).drop("__version")


def _newest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row of the greatest ``order``; null is least."""
    return last_wins(rows.withColumn("__order", F.struct(*order)), key, order="__order").select(*rows.columns)


def compact(spark: SparkSession, target: str, key: str, order: str, *, parser: int | None = None) -> None:
    """Write the table as of now as a base. Folders before the base that it replaces go; those since then stay for readers that still use them."""
    target = of_parser(target, parser)
    versions = _versions(spark, target)
    base, later = _split(versions)
    if not later:
        return
    current(spark, target, key, order).write.mode("overwrite").parquet(f"{target}/{_next(versions[-1], 'b')}")
    for v in versions[: versions.index(base)] if base else []:
        fs, path = _fs(spark, f"{target}/{v}")
        fs.delete(path, True)


def sweep(spark: SparkSession, target: str, there: DataFrame, key: str, order: str, *, parser: int | None = None) -> int:
    """Write down that the rows whose ``key`` is not among those of ``there`` are deleted, and return how many these are.

    A stream of files does not tell of deletions: ``there`` is a listing, made when no stream writes to the table. Only the deleted keys are written;
    a key that comes again in a later batch is there again.
    """
    kept = current(spark, target, key, order, parser=parser)
    if kept is None:
        return 0
    folder = of_parser(target, parser)
    gone = cut(kept.select(key).join(there.select(key), key, "left_anti"))
    n = gone.count()
    if n:
        gone.write.mode("overwrite").parquet(f"{folder}/{_next(_versions(spark, folder)[-1], 's')}")
    return n


def event_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, event_type, n, total) of an event stream or table, with late rows dropped by watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

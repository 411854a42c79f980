"""Tables in the session's shared checkpoint folder, and a distributed global rank."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillgrid-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so that nothing above it is ever computed twice."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` returned (not frames made from them). Only for tables that no frame still in use reads: what was made from them has been cut itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._cut_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with the 0-based place of every row in the order given, without moving all rows to one task.

    Rows are dealt by range and sorted within partitions; a partition's first place is the number of rows before it, of
    which only one count per partition reaches the driver. The order must be total for the result to be repeatable.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["__part"], r["n"]) for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    if not offsets:
        return kept.withColumn(name, F.lit(0).cast("long")).drop("__part", "__row")
    starts = F.create_map(*(F.lit(x) for pair in offsets for x in pair))
    return kept.withColumn(name, F.element_at(starts, F.col("__part")).cast("long") + F.col("__row")).drop("__part", "__row")

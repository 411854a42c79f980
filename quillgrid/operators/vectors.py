"""Exact nearest vectors without reading all of them: groups around centroids, skipped by the triangle inequality of angles."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import semantic_hits

#: The group of vectors that no angle can bound: of another length than the centroids, zero, or with null or non-finite entries.
ODD = -1
#: Angles are widened by so much, as arcs near 0 are only known to about the root of a double's precision.
SLACK = 1e-6


class GroupedVectors:
    """Vectors in a folder, dealt to groups by their nearest centroid; a group keeps the largest angle that any of its vectors has to the centroid.

    Centroids are fitted on a bounded sample and never change which rows are found: every vector is kept, and a search reads each group that
    may hold one of its n nearest. ``add`` writes new vectors beside the old ones.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, embeds: DataFrame, groups: int = 64, sample: int = 10_000, rounds: int = 4) -> GroupedVectors:
        """Fit up to ``groups`` centroids on at most ``sample`` vectors (those whose paths have the smallest hashes) in ``rounds`` of spherical k-means, and keep ``embeds`` (path, vec).

        The centroids are of the commonest length; without a usable vector all rows are in one group that is always read.
        """
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bounds")
        if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            raise ValueError(f"{self.path} holds vectors already")
        usable = embeds.where(_sound(F.col("vec")))
        sizes = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
        fitted = np.zeros((0, 0))
        if sizes is not None:
            some = usable.where(F.size("vec") == sizes["d"]).orderBy(F.xxhash64("path"), "path").limit(sample)
            fitted = _centroids(np.array([r["vec"] for r in some.select("vec").collect()], dtype=float), groups, rounds)
        rows = [(k, [float(x) for x in c]) for k, c in enumerate(fitted)]
        self.spark.createDataFrame(rows, "part int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        return self.add(embeds)

    def _centroids(self) -> np.ndarray:
        return np.array([r["centroid"] for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("part").collect()], dtype=float)

    def add(self, embeds: DataFrame) -> GroupedVectors:
        """Keep more vectors (path, vec). They count from when the largest angles of the batch are written, which comes last; a batch that broke off is never read."""
        name, centers = uuid.uuid4().hex, self._centroids()
        vec = F.col("vec").cast("array<double>")
        sound = _sound(F.col("vec")) & (F.size("vec") == (centers.shape[1] if len(centers) else -1))
        near = _nearest(centers)(F.when(sound, vec))
        dealt = embeds.select("path", vec.alias("vec"), near.alias("at")).select("path", "vec", "at.part", "at.angle").repartition("part", F.pmod(F.xxhash64("path"), F.lit(8)))
        dealt.write.partitionBy("part").parquet(f"{self.path}/vectors/batch={name}")
        kept = self.spark.read.schema("path string, vec array<double>, angle double, part int").parquet(f"{self.path}/vectors/batch={name}")
        bounds = kept.groupBy("part").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).withColumn("batch", F.lit(name))
        bounds.coalesce(1).write.mode("append").parquet(f"{self.path}/bounds")
        return self

    def bounds(self, vector: list[float]) -> list[dict]:
        """Per batch and group (batch, part, n) the least angle that any of its vectors can have to ``vector``, nearest first. Angles that nothing bounds are 0."""
        q, centers = np.asarray(vector, dtype=float), self._centroids()
        known = [r.asDict() for r in self.spark.read.parquet(f"{self.path}/bounds").collect()]  # a row for each group of each batch
        length = float(np.linalg.norm(q))
        fits = len(centers) > 0 and len(q) == centers.shape[1] and math.isfinite(length) and length > 0
        for r in known:
            bound = fits and r["part"] != ODD
            r["least"] = max(0.0, float(np.arccos(np.clip(centers[r["part"]] @ (q / length), -1, 1))) - r["radius"] - SLACK) if bound else 0.0
        return sorted(known, key=lambda r: (r["least"], r["batch"], r["part"]))

    def _read(self, chosen: list[dict]) -> DataFrame:
        """The vectors of some groups; the scan lists their folders only."""
        folders = [f"{self.path}/vectors/batch={r['batch']}/part={r['part']}" for r in chosen]
        schema = "path string, vec array<double>"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def search(self, vector: list[float], n: int = 10) -> DataFrame:
        """What ``semantic_hits`` of all vectors gives. The nearest groups that hold n vectors are read first; then those whose bound does not rule out a cosine as large as the n-th found."""
        return semantic_hits(self._read(self.needed(vector, n)), vector, n)

    def needed(self, vector: list[float], n: int) -> list[dict]:
        """The groups that ``search`` reads."""
        near = self.bounds(vector)
        first, held = [], 0
        for r in near:
            if held >= n and r["least"] > 0:
                break
            first.append(r)
            held += r["n"]
        found = semantic_hits(self._read(first), vector, n).agg(F.min("cosine").alias("low"), F.count("*").alias("n")).first()
        if found["n"] < n or found["low"] is None or math.isnan(found["low"]):
            return near
        widest = math.acos(min(1.0, max(-1.0, found["low"]))) + SLACK
        return [r for r in near if r["least"] <= widest]


def _sound(vec: Column) -> Column:
    """Vectors that have an angle to others: finite entries, not all zero, and a length that a double can hold."""
    square = F.aggregate(F.transform(vec, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return F.coalesce(~F.isnan(square) & (square > 1e-200) & (square < 1e200), F.lit(False))


def _centroids(sample: np.ndarray, groups: int, rounds: int) -> np.ndarray:
    """Unit centroids: the first is the first vector, each next the one farthest from those before; then a few rounds of means."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, best = [0], unit @ unit[0]
    while len(chosen) < min(groups, len(unit)) and best.min() < 1 - 1e-9:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, unit @ unit[chosen[-1]])
    centers = unit[chosen]
    for _ in range(rounds):
        at = (unit @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centers)
    return centers


def _nearest(centers: np.ndarray):
    """A column function: (part, angle) of the centroid with the least angle to a vector; null vectors are odd."""

    @F.pandas_udf("part int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        there = vectors.notna().to_numpy()
        part, angle = np.full(len(vectors), ODD, dtype=np.int32), np.zeros(len(vectors))
        if there.any():
            m = np.stack(vectors[there].to_list()).astype(float)
            dots = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ centers.T
            best = dots.argmax(axis=1)
            part[there] = best
            angle[there] = np.arccos(np.clip(dots[np.arange(len(best)), best], -1, 1))
        return pd.DataFrame({"part": part, "angle": angle})

    return nearest

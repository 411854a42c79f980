"""MinHash near-duplicate detection: one-permutation sketches, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop
from .components import components
from .shingles import mix, shingle_sets

#: Bins of the one-permutation sketch (a power of two, so that a hash's high bits name its bin).
BINS = 256
#: Sketch values in a band. 42 bands of 6 find a pair of similarity 0.8 in 99.9997 % of cases.
ROWS = 6
#: From one round to the next a bucket that is still of several components has so many times the centres.
CENTRES = 64
#: A shingle that a centre lacks and at most so many members of its buckets have is rare.
RARE = 8


def _donors(bins: int) -> np.ndarray:
    """For every bin its own random order of all bins: an empty bin copies the first non-empty one in it (optimal densification)."""
    rng = np.random.default_rng(20240607)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def _sketch(shingles: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a sorted set; empty bins are densified."""
    bins = len(donors)
    seen, first = np.unique(shingles >> np.uint64(64 - bins.bit_length() + 1), return_index=True)
    values, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[seen.astype(np.int64)] = shingles[first]
    full[seen.astype(np.int64)] = True
    if len(seen) < bins:
        empty = np.flatnonzero(~full)
        order = donors[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(1)]]
    return values


def sketches(docs: DataFrame, words: int, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(id, text) -> (id, n, f1, f2, bits, bands): set size, 128-bit fingerprint of the set, one byte per bin, one key per band (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        donors, bands = _donors(bins), bins // rows
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, f1, f2, keys, bits = [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                f1.append((digest >> 64) - (1 << 63))
                f2.append((digest & (1 << 64) - 1) - (1 << 63))
                if len(s):
                    least = _sketch(s, donors)
                    bits.append(mix(least).astype(np.uint8).tobytes())
                    v, key = least[: bands * rows].reshape(bands, rows), salt
                    for k in range(rows):
                        key = mix(key ^ v[:, k])
                    keys.append(key.view(np.int64))
                else:
                    bits.append(b"")
                    keys.append(np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), np.concatenate(keys or [np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bits, pa.binary()), lists], ["id", "n", "f1", "f2", "bits", "bands"])

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, bits binary, bands array<long>")


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, tu, tv)."""
    texts = docs.select(F.col("id").alias("u"), F.col("text").alias("tu"))
    return pairs.join(texts, "u").join(texts.toDF("v", "tv"), "v").select("u", "v", "tu", "tv")


def _both_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple]:
    """Small parts of (u, v, tu, tv) batches with the shingle sets of either side; a run of rows of one v hashes its text once."""
    for batch in batches:
        for low in range(0, len(batch), 64):
            part = batch.slice(low, 64)
            others, last = [], None
            for k, v in enumerate(part.column(1).to_pylist()):
                others.append(others[-1] if others and v == last else next(shingle_sets(part.column(3).slice(k, 1), words)))
                last = v
            yield part, list(shingle_sets(part.column(2), words)), others


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, others in _both_sets(batches, words):
            common = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(sets, others)]
            keep = [c > 0 and 100 * c >= percent * (len(a) + len(b) - c) for a, b, c in zip(sets, others, common)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _with_texts(pairs, docs).mapInArrow(run, "u long, v long")


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents``.

    A document's set holds its distinct shingles of ``words`` words (A-Z folded); two documents are linked when
    100 * |intersection| >= ``percent`` * |union| on the full sets. Documents with equal sets are first folded into
    one representative. Representatives are sketched (one permutation, ``bins`` bins, empty bins densified), bands of
    ``rows`` values make buckets, and each bucket gives one edge per member, to the bucket's centre. Edges are
    confirmed on the full sets. Buckets that then still hold several components stay open, as a link may run between
    two members that are not the centre. Of what the centre lacks, members that share a rare shingle (one that at most 8 members of
    the centre have) are compared. What any other pair shares is bounded by the shingles that are not rare, which rules out nearly
    all the rest; what it leaves gets more centres per bucket, again and again, until every member was one or all are joined.

    Null or blank text: ``n_shingles`` 0, linked with nothing. A null id: its own component (null), kept. Rows that
    repeat an id are one document (of the row with the smallest fingerprint) and each gets the result. Other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = docs.where("id is not null")
    sketch = cut(sketches(named, words, bins, rows))
    full = sketch.where("n > 0").select("id", "f1", "f2")
    sets = cut(full.groupBy("f1", "f2").agg(F.min("id").alias("rep")))
    member = cut(full.join(sets, ["f1", "f2"]).groupBy("id").agg(F.min("rep").alias("rep")))
    fold = member.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    reps = cut(sketch.join(member.where("id = rep").select("id"), "id").select("id", "n", "bits", "bands").dropDuplicates(["id"]))
    sizes = cut(sketch.select("id", "n"))
    drop(sets, sketch)
    parts = _links(reps, named, words, percent)
    links = cut(reduce(DataFrame.unionByName, parts, fold))
    drop(member, reps, *parts)
    groups = components(links)
    drop(links)
    texts = sizes.join(groups, sizes["id"] == groups["node"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    out = texts.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    lost = sketches(docs.where("id is null"), words, bins, rows)
    return out.unionByName(lost.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))


def _links(reps: DataFrame, docs: DataFrame, words: int, percent: int) -> list[DataFrame]:
    """Tables of (u, v) links between representatives that connect all that are linked by way of a bucket."""
    entries = cut(reps.select(F.explode("bands").alias("key"), "id", "n"))
    buckets = cut(entries.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("centre")).where("m > 1"))
    alive = cut(entries.join(buckets, "key").withColumn("comp", F.col("id")))
    drop(entries, buckets)
    pairs = cut(alive.where("id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v")).distinct())
    links = [cut(confirmed(_plausible(pairs, reps, percent), docs, words, percent))]
    alive = _open(alive, links[0])
    if not alive.limit(1).count():
        drop(alive, pairs)
        return links
    tested, tables = pairs, [pairs]
    members = cut(alive.where("id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v")).distinct())
    rare, few = _rare(members, docs, words)
    before, alive = alive, alive.join(few, ["centre", "id"], "left").withColumns({"core": F.col("n") - F.coalesce("lacks", F.lit(0)), "more": F.coalesce(F.col("lacks") - F.col("few"), F.lit(0))})
    alive = cut(alive.select(F.col("centre").alias("key"), "id", "n", "core", "more", "comp").distinct())  # from here on the buckets of one centre are one
    drop(before, members, few)
    pairs = cut(_rare_pairs(rare, alive.withColumnRenamed("key", "centre"), percent).join(tested, ["u", "v"], "left_anti"))
    found = cut(confirmed(_plausible(pairs, reps, percent), docs, words, percent))
    drop(rare)
    links, tested, tables = [*links, found], tested.unionByName(pairs), [*tables, pairs]
    before = _open(alive, found)
    least = cut(before.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("m")))
    alive = _mixed(cut(before.join(least, "key").where(f"{100 + percent} * (core + more) >= {percent} * (n + least)").drop("least")))
    drop(before, least)
    centres, most = 1, alive.agg(F.max("m")).first()[0]
    while most is not None and centres < most:
        centres *= CENTRES
        chosen = alive.where(F.pmod(F.xxhash64("id", F.lit(centres)), F.lit(1 << 40)) / float(1 << 40) * F.col("m") < centres).select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("core").alias("core2"), F.col("more").alias("more2"), F.col("comp").alias("other"))
        near = alive.join(chosen, "key").where(f"comp <> other and {100 + percent} * (least(core, core2) + least(more, more2)) >= {percent} * (n + n2)")
        pairs = near.select(F.greatest("id", "id2").alias("u"), F.least("id", "id2").alias("v")).distinct()
        pairs = cut(pairs.join(tested, ["u", "v"], "left_anti"))
        found = cut(confirmed(_plausible(pairs, reps, percent), docs, words, percent))
        links, tested, tables = [*links, found], tested.unionByName(pairs), [*tables, pairs]
        alive = _open(alive, found)
        most = alive.agg(F.max("m")).first()[0]
    drop(alive, *tables)
    return links


def _open(alive: DataFrame, links: DataFrame) -> DataFrame:
    """What is left of ``alive`` (a table of buckets of more than one component each, which goes) once new links have joined components."""
    return _mixed(_merged(alive, links)) if links.limit(1).count() else alive


def _merged(alive: DataFrame, links: DataFrame) -> DataFrame:
    """``alive`` (a table, which goes) with the components that new links between its documents make of the present ones."""
    comp = cut(alive.select("id", "comp").distinct())
    ends = links.join(comp.toDF("u", "cu"), "u").join(comp.toDF("v", "cv"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    moved = components(ends)
    out = cut(alive.join(moved.toDF("comp", "into"), "comp", "left").withColumn("comp", F.coalesce("into", "comp")).drop("into"))
    drop(alive, comp, moved)
    return out


def _mixed(alive: DataFrame) -> DataFrame:
    """The buckets of ``alive`` (a table, which goes) that hold more than one component."""
    keys = cut(alive.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key"))
    out = cut(alive.join(keys, "key"))
    drop(alive, keys)
    return out


def _rare(pairs: DataFrame, docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Of members u of open buckets with centre v, and the shingles of u that v lacks: (centre, h, id) of each that 2 to RARE members of the centre have,
    and (centre, id, few, lacks), how many each member has that RARE members at most have, and how many in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, others in _both_sets(batches, words):
            own = [np.setdiff1d(a, b, assume_unique=True) for a, b in zip(sets, others)]
            rows = pa.array(np.repeat(np.arange(len(part)), list(map(len, own))))
            yield pa.RecordBatch.from_arrays([part.column(1).take(rows), part.column(0).take(rows), pa.array(np.concatenate(own).view(np.int64))], ["centre", "id", "h"])

    each = cut(_with_texts(pairs, docs).mapInArrow(run, "centre long, id long, h long"))
    seldom = cut(each.groupBy("centre", "h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where(F.col("c") <= RARE))
    rare = cut(each.join(seldom.where("c > 1").select("centre", "h"), ["centre", "h"]).distinct())
    once = seldom.where("c = 1").select("centre", "id").unionByName(rare.select("centre", "id"))
    marked = once.withColumn("few", F.lit(1)).unionByName(each.select("centre", "id", F.lit(0).alias("few")))
    few = cut(marked.groupBy("centre", "id").agg(F.sum("few").alias("few"), F.sum(1 - F.col("few")).alias("lacks")))
    drop(each, seldom)
    return rare, few


def _rare_pairs(rare: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(u, v) of different components and one centre that share a rare shingle and, as far as is known, may be linked: they share those, and of the centre's and of the other shingles at most what the lesser has."""
    of = rare.join(known, ["centre", "id"]).select("centre", "h", "id", "n", "core", "more", "comp")
    two = of.join(of.toDF("centre", "h", "id2", "n2", "core2", "more2", "comp2"), ["centre", "h"]).where("id > id2 and comp <> comp2")
    per = two.groupBy("centre", "id", "id2", "n", "n2", "core", "core2", "more", "more2").agg(F.count("*").alias("r"))
    return per.where(f"{100 + percent} * (least(core, core2) + least(more, more2) + r) >= {percent} * (n + n2)").select(F.col("id").alias("u"), F.col("id2").alias("v")).distinct()


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose sizes rule a link out, or whose sketches agree in too few bins by six standard deviations."""
    of = reps.select("id", "n", "bits")
    both = pairs.join(of.toDF("u", "nu", "bu"), "u").join(of.toDF("v", "nv", "bv"), "v").where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, bu, bv = (batch.column(batch.schema.get_field_index(c)) for c in ("u", "v", "nu", "bu", "bv"))
            if len(batch):
                a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(batch), -1) for x in (bu, bv))
                least = percent / 100 - 6 * np.sqrt(0.16 / np.minimum(a.shape[1], n.to_numpy()))
                yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array((a == b).mean(1) >= least))

    return both.select("u", "v", F.least("nu", "nv").alias("nu"), "bu", "bv").mapInArrow(run, "u long, v long")

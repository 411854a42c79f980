"""Edit plans: fuzzy link targets, links to add, and the rewrites that follow a rename. A plan is a DataFrame; nothing is written here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import folder, let, link_stem, stem
from ..functions.tables import cut
from .closeness import Chunk, common, counts, distinct, split
from .links import MARKDOWN, WIKI, names, resolve_relative

RELATED = ("related", "related pages", "related docs", "see also")


#: Labels that are held against all names at a time; names of a chunk; chunks in which a label is looked up first.
BLOCK, CHUNK, HOMES = 32_768, 50_000, 3


def close_names(labels: DataFrame, known: DataFrame, n: int = 3, cutoff: float = 0.6) -> DataFrame:
    """(label, candidate, ratio): for every label its up to n most similar known names, by the ratio of matching blocks.

    The labels are a query set: in blocks of bounded size they are broadcast. Names are dealt by their letters to chunks of bounded size, so that a chunk has names alike. What two names can
    have in common at most bounds the ratio from above: by their letters, by letters and digits, and by the longest common subsequence. A label is first held against the few chunks with the
    highest bound by letters; its n-th best ratio there is a bar that all other chunks' names have to reach, so that few names are compared and none of the best is lost.
    """
    spark = labels.sparkSession
    wanted = cut(labels.select("label", link_stem(F.col("label")).alias("low")).where("label is not null").distinct())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    all_names = cut(known.select(F.col("name").alias("candidate")).where("candidate is not null").distinct())
    total = all_names.count()
    chunks = max(-(-total // CHUNK), min(tasks, -(-total // 1_000)), 1)
    letters = F.array_join(F.array_sort(F.split(F.regexp_replace("candidate", "[0-9]", ""), "")), "")
    names_ = cut(all_names.repartitionByRange(chunks, letters, F.col("candidate")).withColumn("chunk", F.spark_partition_id()))
    dealt = names_.repartitionById(chunks, "chunk")
    blocks = 1 + wanted.count() // BLOCK
    scored = None
    for k in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k).toPandas()
        if len(part):
            found = _held_against(dealt, part, n, cutoff)
            scored = found if scored is None else scored.unionByName(found)
    if scored is None:
        return wanted.select("label", F.col("low").alias("candidate"), F.lit(0.0).alias("ratio")).where("false")
    return scored.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("ratio"), F.desc("candidate")))).where(F.col("r") <= n).drop("r")


def _held_against(dealt: DataFrame, labels: pd.DataFrame, n: int, cutoff: float) -> DataFrame:
    """The n best, or more, of the names (candidate, chunk) for each label of a block."""
    spark = dealt.sparkSession
    texts, lows = labels["label"].tolist(), labels["low"].tolist()
    rest, digits = split(counts(lows))
    letters, of = distinct(rest)

    def each_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Chunk]]:
        rows = pd.concat(batches, ignore_index=True) if (batches := list(batches)) else pd.DataFrame({"candidate": [], "chunk": []})
        for chunk, own in rows.groupby("chunk"):
            yield int(chunk), Chunk(own["candidate"].tolist())

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, names_ in each_chunk(batches):
            yield pd.DataFrame({"letters": np.arange(len(shared.value[0])), "chunk": chunk, "top": [names_.top(x) for x in shared.value[0]]})

    shared = spark.sparkContext.broadcast((letters,))
    order = W.partitionBy("letters").orderBy(F.desc("top"), F.xxhash64("letters", "chunk"))
    ranked = dealt.mapInPandas(tops, "letters int, chunk int, top double").withColumn("r", F.row_number().over(order)).where(F.col("r") <= HOMES)
    homes: dict[int, set[int]] = {}
    for r in ranked.select("letters", "chunk").toPandas().itertuples():
        homes.setdefault(r.letters, set()).add(r.chunk)

    def searched(best: list[list[tuple[float, str]]], at_home: bool) -> DataFrame:
        block = spark.sparkContext.broadcast((texts, lows, letters, np.argsort(of, kind="stable"), np.searchsorted(np.sort(of), np.arange(len(letters) + 1)), digits, homes, best))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            texts, lows, letters, order, first, digits, homes, best = block.value
            for chunk, names_ in each_chunk(batches):
                found = []
                for k, own in enumerate(letters):
                    if (chunk in homes.get(k, ())) != at_home:
                        continue
                    shared, size, some = common(names_.letters, own), int(own.sum()), order[first[k] : first[k + 1]]
                    if len(some) * len(shared) <= 1 << 20:
                        bars = np.array([best[at][-1][0] if len(best[at]) == n else cutoff for at in some])
                        some = some[names_.reach(shared, size, digits[some].sum(1, dtype=np.int64)[:, None], bars[:, None]).any(1)]
                    for at in some:
                        mine = list(best[at])
                        names_.search(lows[at], digits[at], size, shared, mine, n, cutoff)
                        found += [(texts[at], c, r) for r, c in mine if (r, c) not in best[at]]
                yield pd.DataFrame(found, columns=["label", "candidate", "ratio"])

        return dealt.mapInPandas(run, "label string, candidate string, ratio double")

    first = cut(searched([[] for _ in lows], True))
    at, best = {x: k for k, x in enumerate(texts)}, [[] for _ in lows]
    for r in first.toPandas().itertuples():
        best[at[r.label]].append((r.ratio, r.candidate))
    best = [sorted(x, reverse=True)[:n] for x in best]
    return first.unionByName(searched(best, False))


def links_to_add(docs: DataFrame, files: DataFrame, requests: DataFrame, section: str | None = None) -> DataFrame:
    """(path, text, added): documents (path, text) with the targets of ``requests`` (path, target) linked in their section of related documents.

    Unknown targets, links to the document itself and documents that are linked already are left out. The section is the first whose heading is one of
    the usual ones (or ``section``); items go before the blank lines at its end, which is the next heading of its level or above. Without such a section, one is put at the end.
    """
    known = names(files)
    wanted = requests.select("path", "target", F.lower(link_stem(F.col("target"))).alias("name")).join(known.withColumnRenamed("target", "by_name"), "name", "left")
    real = wanted.join(files.select(F.col("path").alias("by_path")), F.col("target") == F.col("by_path"), "left").withColumn("to", F.coalesce("by_name", "by_path")).where("to is not null and to <> path")
    own = known.withColumnRenamed("target", "owner")
    label = F.when(F.col("owner") == F.col("to"), stem(F.col("to"))).otherwise(F.regexp_replace("to", r"\.[^./]+$", ""))
    labelled = real.withColumn("name", F.lower(stem(F.col("to")))).join(own, "name", "left").select("path", "to", label.alias("label")).distinct()
    wiki = docs.where(F.lower("path").endswith(".md")).select("path", F.explode(F.regexp_extract_all("text", F.lit(WIKI), F.lit(1))).alias("d")).select("path", link_stem(F.trim("d")).alias("name")).join(known, "name").select("path", F.col("target").alias("to"))
    plain = docs.select("path", F.explode(F.regexp_extract_all("text", F.lit(MARKDOWN), F.lit(1))).alias("d")).select("path", resolve_relative(folder(F.col("path")), F.col("d")).alias("to"))
    new = labelled.join(wiki.unionByName(plain).distinct(), ["path", "to"], "left_anti").groupBy("path").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return docs.where(F.lower("path").endswith(".md")).join(new, "path").select("path", _inserted(F.col("text"), F.transform("labels", lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), section).alias("text"), F.size("labels").alias("added"))


def _inserted(text: Column, items: Column, section: str | None) -> Column:
    headings = (section.lower(),) if section else RELATED
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    level = lambda x: F.char_length(F.regexp_extract(x, r"^(#{1,6})\s", 1))
    title = lambda x: F.lower(F.trim(F.regexp_replace(x, r"^#{1,6}\s+", "")))

    def at(ls: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ls) - 1)
        start = F.get(F.filter(places, lambda i: (level(F.get(ls, i)) > 0) & title(F.get(ls, i)).isin(*headings)), F.lit(0))
        end = F.coalesce(F.get(F.filter(places, lambda j: (j > start) & (level(F.get(ls, j)) > 0) & (level(F.get(ls, j)) <= level(F.get(ls, start)))), F.lit(0)), F.size(ls))
        last = F.array_max(F.filter(places, lambda j: (j >= start) & (j < end) & ((F.trim(F.get(ls, j)) != "") | (j == start)))) + 1
        inside = F.concat(F.slice(ls, F.lit(1), last), items, F.slice(ls, last + 1, F.size(ls)))
        final = F.coalesce(F.array_max(F.filter(places, lambda j: F.trim(F.get(ls, j)) != "")), F.lit(-1)) + 1
        outside = F.concat(F.slice(ls, F.lit(1), final), F.array(F.lit(""), F.lit(f"## {section or 'Related'}")), items)
        return F.when(start.isNull(), outside).otherwise(inside)

    return F.concat(F.array_join(F.element_at(F.transform(F.array(lines), at), 1), "\n"), F.lit("\n"))


def rename_plan(docs: DataFrame, files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, text, n): text documents whose references to ``old`` are rewritten to ``new``; n counts the changed references.

    Wiki links that resolve to the old document by its stem take the new stem, or the new path without suffix if they were paths; links by an alias
    stay. Markdown and image links are recomputed relative to their document, with their anchors. The moved document comes under its new path, with its own
    relative links as seen from there.
    """
    target = {r["name"]: r["target"] for r in names(files).where(F.col("target") == old).collect()}  # the names of one document
    old_stem = old.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    new_base = new.rsplit(".", 1)[0] if "." in new.rsplit("/", 1)[-1] else new
    out, changed = F.col("text"), F.lit(0)
    suffix = r"(?:\.md|\.txt|\.html|\.pdf)?"
    if old_stem.lower() in target:
        by_path = rf"(?i)\[\[\s*(?:[^\]|#\[]*/)\Q{old_stem}\E{suffix}\s*(?=[\]|#])"
        by_stem = rf"(?i)\[\[\s*\Q{old_stem}\E{suffix}\s*(?=[\]|#])"
        changed = F.regexp_count("text", F.lit(by_path)) + F.regexp_count("text", F.lit(by_stem))
        dollar = lambda t: t.replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(F.regexp_replace(out, by_path, "[[" + dollar(new_base)), by_stem, "[[" + dollar(new_base.rsplit("/", 1)[-1]))
    urls = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"\]\(([^)#\s]+)(?:#[^)\s]*)?\)"), F.lit(1)), lambda u: ~F.rlike(u, F.lit(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|/)"))))
    here, target = F.col("path"), lambda u: resolve_relative(folder(F.col("path")), u)
    to = lambda u: F.when(target(u) == old, F.lit(new)).otherwise(target(u))
    place = F.when(here == old, F.lit(new)).otherwise(here)
    moves = F.filter(F.transform(urls, lambda u: F.struct(u.alias("u"), relative(folder(place), to(u)).alias("link"))), lambda m: (here == old) & (m["link"] != m["u"]) | (target(m["u"]) == old))
    # every link is first marked and then put in place, so that no new link is taken for an old one
    mark = lambda k: F.concat(F.lit("](\x00"), k.cast("string"), F.lit("\x00"))
    both = F.aggregate(F.sequence(F.lit(0), F.size(moves)), F.struct(out.alias("t"), changed.alias("n")), lambda s, k: F.when(k == F.size(moves), s).otherwise(
        let(F.get(moves, k)["u"], lambda u: F.struct(F.replace(F.replace(s["t"], F.concat(F.lit("]("), u, F.lit(")")), F.concat(mark(k), F.lit(")"))), F.concat(F.lit("]("), u, F.lit("#")), F.concat(mark(k), F.lit("#"))).alias("t"), (s["n"] + 1).alias("n")))))
    placed = lambda s: F.aggregate(F.sequence(F.lit(0), F.size(moves)), s, lambda t, k: F.when(k == F.size(moves), t).otherwise(F.replace(t, mark(k), F.concat(F.lit("]("), F.get(moves, k)["link"]))))
    both = let(both, lambda s: F.struct(placed(s["t"]).alias("t"), s["n"].alias("n")))
    plan = docs.where(F.lower("path").rlike(r"\.(md|txt|rst|org|adoc)$")).select(place.alias("to"), both.alias("b")).select(F.col("to").alias("path"), F.col("b.t").alias("text"), F.col("b.n").alias("n"))
    return plan.where((F.col("n") > 0) | (F.col("path") == new))


def relative(of: Column, target: Column) -> Column:
    """The way from folder ``of`` to a path, both seen from the root."""
    a, b = F.filter(F.split(of, "/"), lambda x: x != "."), F.split(target, "/")
    shared = lambda p: F.size(F.filter(F.sequence(F.lit(0), F.size(p["a"])), lambda i: (i > 0) & (i < F.size(p["b"])) & (F.slice(p["a"], F.lit(1), i) == F.slice(p["b"], F.lit(1), i))))
    way = lambda p: let(shared(p), lambda n: F.concat(F.repeat(F.lit("../"), F.size(p["a"]) - n), F.array_join(F.slice(p["b"], n + 1, F.size(p["b"])), "/")))
    return let(F.struct(a.alias("a"), b.alias("b")), way)

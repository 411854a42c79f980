"""The vault report and incremental update, as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import extension, folder, stem, stem_words


#: The relation of an imported link that names none (a fixed value).
DEFAULT_RELATION = "conceptually_related_to"


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("words"), F.lit(0)).alias("n_words"))


def folders(files: DataFrame, shown: int = 4) -> DataFrame:
    """(dir, n, titles): files of each folder and the titles of the first ones by path. Only the ``shown`` first ones are kept on the way."""
    of = files.select(folder(F.col("path")).alias("dir"), "path", "title")
    counts = of.groupBy("dir").agg(F.count("*").alias("n"))
    first = of.withColumn("r", F.row_number().over(W.partitionBy("dir").orderBy("path"))).where(F.col("r") <= shown)
    titles = first.groupBy("dir").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), " | ").alias("titles"))
    return counts.join(titles, "dir")


def top_tags(tags: DataFrame, n: int = 15) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def shared_refs(links: DataFrame, kind: str = "req", n: int | None = 15) -> DataFrame:
    """(dst, n): references of one kind that several documents make."""
    out = links.where(F.col("kind") == kind).groupBy("dst").agg(F.countDistinct("src").alias("n")).where("n > 1")
    return out if n is None else out.orderBy(F.desc("n"), "dst").limit(n)


def coverage(paths: DataFrame) -> DataFrame:
    """(ext, n) of a listing."""
    return paths.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): new, changed, deleted or unchanged, by content hash."""
    a, b = before.select("path", F.col("sha").alias("a")), now.select("path", F.col("sha").alias("b"))
    kind = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change"))


def applied(old: DataFrame, new: DataFrame, change: DataFrame) -> DataFrame:
    """A table after an update: rows of unchanged documents, and the new rows of new and changed ones."""
    stay = change.where("change = 'unchanged'").select("path")
    come = change.where("change in ('new', 'changed')").select("path")
    return old.join(stay, "path", "left_semi").unionByName(new.join(come, "path", "left_semi"))


def image_texts(images: DataFrame, alts: DataFrame) -> DataFrame:
    """(path, content): an image's name as words and the distinct alternative texts of the references to it."""
    texts = alts.where("alt <> ''").groupBy(F.col("dst").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("alt")), " ").alias("alts"))
    name = stem(F.col("path"))
    return images.join(texts, "path", "left").select("path", F.concat_ws(" ", name, stem_words(name), "alts").alias("content"))


def node_files(nodes: DataFrame, files: DataFrame, folder_name: str = "wiki") -> DataFrame:
    """(id, label, path) of the nodes whose ``source_file`` is a document, by itself or below ``folder_name``."""
    own, below = files.select("path"), files.select(F.col("path").alias("below"))
    found = nodes.join(own, F.col("source_file") == F.col("path"), "left").join(below, F.concat(F.lit(f"{folder_name}/"), "source_file") == F.col("below"), "left")
    return found.select("id", "label", F.coalesce("path", "below").alias("path")).where("path is not null")


def imported_edges(nodes: DataFrame, links: DataFrame, existing: DataFrame | None = None, shown: int = 3) -> DataFrame:
    """(src, dst, relation, rationale): inferred links between nodes as edges between their documents.

    ``nodes`` is (id, label, path), ``links`` (source, target, confidence, relation). Pairs are sorted; a link without a
    relation has ``DEFAULT_RELATION``; the relation is the most frequent one (of equals the smallest), the rationale the first labels by name; pairs that ``existing`` has with that relation are left out.
    """
    a, b = nodes.select(F.col("id").alias("source"), F.col("path").alias("pa"), F.col("label").alias("la")), nodes.select(F.col("id").alias("target"), F.col("path").alias("pb"), F.col("label").alias("lb"))
    ends = links.where("confidence = 'INFERRED'").join(a, "source").join(b, "target").where("pa <> pb")
    of = ends.select(F.least("pa", "pb").alias("src"), F.greatest("pa", "pb").alias("dst"), F.coalesce("relation", F.lit(DEFAULT_RELATION)).alias("relation"), F.concat(F.coalesce("la", F.lit("")), F.lit(" --"), F.coalesce("relation", F.lit("")), F.lit("→ "), F.coalesce("lb", F.lit(""))).alias("why"))
    counted = of.groupBy("src", "dst", "relation").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("why")), 1, shown).alias("some"))
    best = counted.groupBy("src", "dst").agg(F.min(F.struct((-F.col("n")).alias("n"), "relation")).alias("m"), F.flatten(F.collect_list("some")).alias("every"))
    out = best.select("src", "dst", F.col("m.relation").alias("relation"), F.array_join(F.slice(F.array_sort(F.array_distinct("every")), 1, shown), " | ").alias("rationale"))
    return out if existing is None else out.join(existing.select("src", "dst", "relation"), ["src", "dst", "relation"], "left_anti")


def lines(parts: dict[str, DataFrame], shown: int = 5) -> DataFrame:
    """(part, place, line): the report as markdown. ``parts`` are the frames of ``Vault.report``; of orphans and broken links the first ``shown`` are named."""

    def part(k: int, title: str, df: DataFrame, line: Column, *order: Column) -> DataFrame:
        """A heading and a line a row, by ``order`` (folders may be many, so they are not numbered but carry their place as text)."""
        body = df.select(F.lit(k).alias("part"), F.struct(*(o.cast("string").alias(f"o{j}") for j, o in enumerate(order))).alias("o"), line.alias("line"))
        body = body.select("part", F.concat_ws("\u0001", F.lit("1"), *(F.coalesce(F.col(f"o.o{j}"), F.lit("")) for j in range(len(order)))).alias("place"), "line")
        head = body.limit(1).select("part", F.explode(F.array(F.struct(F.lit("0a").alias("place"), F.lit("").alias("line")), F.struct(F.lit("0b").alias("place"), F.lit(f"## {title}").alias("line")), F.struct(F.lit("0c").alias("place"), F.lit("").alias("line")))).alias("x")).select("part", "x.place", "x.line")
        return head.unionByName(body)

    most = lambda c: F.lpad((F.lit(1 << 40) - c).cast("string"), 14, "0")  # noqa: E731  # the greatest first
    link = lambda title, path: F.concat(F.lit("["), F.coalesce(title, path), F.lit("]("), path, F.lit(")"))
    n, path = F.col("n"), F.col("path")
    folders_ = F.concat(F.lit("- `"), F.col("dir"), F.lit("/` ("), n, F.lit("): "), F.coalesce("titles", F.lit("")), F.when(n > 4, " …").otherwise(""))
    first = lambda df, *order: df.orderBy(*order).limit(shown)
    counted = lambda df, say: df.agg(F.count("*").alias("n")).select("n", F.concat(F.lit(f"- {say}: "), "n").alias("line"))
    head = parts["totals"].select(F.lit(0).alias("part"), F.lit("1").alias("place"), F.concat(F.lit("# Vault: "), "n_files", F.lit(" documents, "), F.format_number("n_words", 0), F.lit(" words")).alias("line"))
    health = [(0, counted(parts["orphans"], "documents without links")), (2, counted(parts["broken"], "broken links"))]
    sums = reduce(DataFrame.unionByName, (df.select(F.lit(str(j)).alias("o"), "line") for j, df in health))
    named = first(parts["orphans"], "path").select(F.lit("1").alias("o"), F.concat(F.lit("  - `"), "path", F.lit("`")).alias("line"))
    named = named.unionByName(first(parts["broken"], "label", "src").select(F.lit("3").alias("o"), F.concat(F.lit("  - `"), "label", F.lit("` in "), "src").alias("line")))
    return reduce(DataFrame.unionByName, (
        head,
        part(1, "Not indexed", parts["coverage"], F.concat(F.lit("- `"), "ext", F.lit("` "), "n"), most(n), F.col("ext")),
        part(2, "Folders", parts["folders"], folders_, F.col("dir")),
        part(3, "Most linked", parts["hubs"], F.concat(F.lit("- "), path, F.lit(" ← "), n), most(n), path),
        part(4, "Recently changed", parts["recent"], F.concat(F.lit("- "), link(F.col("title"), path)), most(F.unix_seconds(F.col("mtime").cast("timestamp"))), path),
        part(5, "Tags", parts["tags"], F.concat(F.lit("- `"), "tag", F.lit("` ("), n, F.lit(")")), most(n), F.col("tag")),
        part(6, "Requirements in several documents", parts["refs"], F.concat(F.lit("- "), "dst", F.lit(" ("), n, F.lit(")")), most(n), F.col("dst")),
        part(7, "Inferred connections", parts["edges"].where("fresh"), F.concat(F.lit("- "), "src", F.lit(" ↔ "), "dst", F.lit(" — "), F.coalesce("relation", F.lit("related"))), F.col("src"), F.col("dst"), F.col("relation")),
        part(8, "Fresh notes", parts["notes"], F.concat(F.lit("- "), F.coalesce("question", F.lit(""))), F.col("question")),
        part(9, "Health", sums.unionByName(named), F.col("line"), F.col("o"), F.col("line")),
    ))

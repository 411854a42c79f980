"""The link graph: extraction, resolution, hubs, health and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import folder, link_stem, stem
from ..functions.tables import cut

#: Fixed patterns of references in text; group 1 is what is referred to (of an image: 1 the alternative text, 2 the target).
WIKI = r"\[\[([^\]|#]+)"
MARKDOWN = r"\]\(([^)#\s]+\.md)(?:#[^)\s]*)?\)"
IMAGE = r"!\[([^\]]*)\]\(([^)#\s]+)\)"
CODE = r"(?U)\b([\w/.-]*\w\.(?:kt|kts|swift|java|py|ts|tsx|gradle))\b"
REQUIREMENT = r"(?U)\b(REQ-\d+)\b"
PICTURES = r"(?i)\.(png|jpg|jpeg|gif|webp|svg)$"


def extract(docs: DataFrame) -> DataFrame:
    """(path, text) -> (src, dst, kind): wiki, markdown and image links as often as they stand, code and requirement references once a document."""

    def found(kind: str, pattern: str, group: int = 1, once: bool = False) -> DataFrame:
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        return docs.select(F.col("path").alias("src"), F.explode(F.array_distinct(hits) if once else hits).alias("dst"), F.lit(kind).alias("kind"))

    image = found("img", IMAGE, 2).where(F.lower("src").endswith(".md") & F.rlike("dst", F.lit(PICTURES)))
    out = found("wiki", WIKI).unionByName(found("md", MARKDOWN)).unionByName(image)
    out = out.unionByName(found("code", CODE, once=True)).unionByName(found("req", REQUIREMENT, once=True))
    local = out.where("kind in ('wiki', 'code', 'req') or not dst rlike '^(http|//)'").withColumn("dst", F.trim("dst"))
    return local.withColumn("dst", F.when(F.col("kind").isin("md", "img"), resolve_relative(folder(F.col("src")), F.col("dst"))).otherwise(F.col("dst")))


def image_alts(docs: DataFrame) -> DataFrame:
    """(path, text) -> (src, dst, alt) of image references in markdown that have an alternative text."""
    two = F.arrays_zip(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all("text", F.lit(IMAGE), F.lit(2)).alias("dst"))
    each = docs.where(F.lower("path").endswith(".md")).select(F.col("path").alias("src"), F.explode(two).alias("x")).select("src", "x.dst", F.trim("x.alt").alias("alt"))
    local = each.where(F.rlike("dst", F.lit(PICTURES)) & (F.col("alt") != "") & ~F.rlike("dst", F.lit("^(http|//)")))
    return local.withColumn("dst", resolve_relative(folder(F.col("src")), F.col("dst")))


def resolve_relative(of: Column, target: Column) -> Column:
    """A relative path seen from folder ``of``, with "." and ".." worked out; a target that leaves the root stays as it is."""
    parts = F.split(F.when(of == ".", target).otherwise(F.concat_ws("/", of, target)), "/")
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))
    def step(s: Column, p: Column) -> Column:
        up = p == ".."
        kept = F.when(up, F.slice(s["kept"], F.lit(1), F.greatest(F.size(s["kept"]) - 1, F.lit(0)))).when(p.isin("", "."), s["kept"]).otherwise(F.array_append(s["kept"], p))
        return F.struct(kept.alias("kept"), (s["out"] | (up & (F.size(s["kept"]) == 0))).alias("out"))
    return F.aggregate(parts, state, step, lambda s: F.when(s["out"], target).otherwise(F.array_join(s["kept"], "/")))


def names(files: DataFrame) -> DataFrame:
    """(name, target): what wiki links may call a document. A file's stem goes before any alias; of equal names the greatest path is meant."""
    stems = files.select(F.lower(stem(F.col("path"))).alias("name"), F.struct(F.lit(1).alias("rank"), "path").alias("p"))
    aliases = files.select(F.explode(F.transform("aliases", F.lower)).alias("name"), F.struct(F.lit(0).alias("rank"), "path").alias("p"))
    return stems.unionByName(aliases).groupBy("name").agg(F.max("p").alias("p")).select("name", F.col("p.path").alias("target"))


def resolved(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` with ``target``: the document a wiki link names, or the path of another link if it is a document; null if broken."""
    named = links.withColumn("name", F.when(F.col("kind") == "wiki", link_stem(F.col("dst"))))
    with_name = named.join(names(files), "name", "left")
    known = files.select(F.col("path").alias("known"))
    return with_name.join(known, with_name["dst"] == known["known"], "left").select("src", "dst", "kind", F.when(F.col("kind") == "wiki", F.col("target")).otherwise(F.col("known")).alias("target"))


def hubs(links: DataFrame, files: DataFrame) -> DataFrame:
    """(path, n): how often wiki and markdown links point to each document; repeated links count, links to itself don't."""
    ends = resolved(links.where("kind in ('wiki', 'md')"), files).withColumn("path", F.when(F.col("kind") == "md", F.col("dst")).otherwise(F.col("target")))
    return ends.where("path is not null and path <> src").groupBy("path").agg(F.count("*").alias("n"))


def broken(links: DataFrame, files: DataFrame) -> DataFrame:
    """(label, src) of links to nothing, once each."""
    return resolved(links.where("kind in ('wiki', 'md', 'img')"), files).where("target is null").select(F.col("dst").alias("label"), "src").distinct()


def connections(links: DataFrame, files: DataFrame, fresh_edges: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of different documents that a link or a fresh edge joins, in both directions."""
    one = resolved(links.where("kind in ('wiki', 'md', 'img')"), files).where("target is not null and target <> src").select(F.col("src").alias("a"), F.col("target").alias("b"))
    if fresh_edges is not None:
        one = one.unionByName(fresh_edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def labelled(links: DataFrame, files: DataFrame, fresh_edges: DataFrame) -> DataFrame:
    """(a, b, via): how documents are joined: by a link of a kind, with or against its direction, or by a fresh edge."""
    one = resolved(links.where("kind in ('wiki', 'md', 'img')"), files).where("target is not null and target <> src")
    there = one.select(F.col("src").alias("a"), F.col("target").alias("b"), F.format_string("—[%s]→", "kind").alias("via"))
    back = one.select(F.col("target").alias("a"), F.col("src").alias("b"), F.format_string("←[%s]—", "kind").alias("via"))
    edge = F.format_string("↔[%s|%s]", "relation", "origin").alias("via")
    joined = [fresh_edges.select(F.col(x).alias("a"), F.col(y).alias("b"), edge) for x, y in (("src", "dst"), ("dst", "src"))]
    return there.unionByName(back).unionByName(joined[0]).unionByName(joined[1])


def orphans(files: DataFrame, pairs: DataFrame) -> DataFrame:
    return files.select("path").join(pairs.select(F.col("a").alias("path")), "path", "left_anti")


def distances(pairs: DataFrame, start: DataFrame, target: str | None = None, limit: int | None = None) -> DataFrame:
    """(node, hops, via) from the nodes of ``start``: breadth-first over (a, b), a frontier join a level.

    Each level is a table in the shared folder; a node is reached once, by way of its smallest neighbour on the level before. The loop
    ends when nothing new is found, ``target`` is reached or after ``limit`` levels.
    """
    level = cut(start.select("node", F.lit(0).cast("long").alias("hops"), F.lit(None).cast(start.schema["node"].dataType).alias("via")).distinct())
    seen, hops = level, 0
    while limit is None or hops < limit:
        hops += 1
        nearby = pairs.join(level.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("via"))
        level = cut(nearby.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hops).cast("long").alias("hops"), "via"))
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
        if target is not None and level.where(F.col("node") == target).limit(1).count():
            break
    return seen


def shortest_path(pairs: DataFrame, a: str, b: str) -> list[str]:
    """The documents on a shortest way from a to b, or [] if there is none; of several the one with the smallest names, compared from a on.

    ``pairs`` (a, b) has both directions. Two frontiers, from either end, are widened level by level, always the smaller one, until they
    share a document: so levels reach half as far as from one end. A row carries the way to its end, and no level is read again on the way back.
    """
    spark = pairs.sparkSession
    if not pairs.where(F.col("a").isin(a, b)).limit(1).count() and a != b:
        return []
    sides = []
    for end in (a, b):
        level = cut(spark.createDataFrame([(end, [end])], "node string, way array<string>"))
        sides.append({"level": level, "seen": level.select("node"), "n": 1})
    while True:
        there, back = (side["level"] for side in sides)
        meet = there.join(back.select("node", F.slice("way", 2, F.greatest(F.size("way"), F.lit(1))).alias("rest")), "node")
        best = meet.agg(F.min(F.concat("way", "rest")).alias("way")).first()["way"]
        if best is not None:
            return list(best)
        forward = sides[0]["n"] <= sides[1]["n"]
        side = sides[0 if forward else 1]
        nearby = pairs.join(side["level"].select(F.col("node").alias("a"), "way"), "a").groupBy(F.col("b").alias("node")).agg(F.min("way").alias("way"))
        node = F.array("node")
        new = nearby.join(side["seen"], "node", "left_anti").select("node", (F.concat("way", node) if forward else F.concat(node, "way")).alias("way"))
        side["level"] = cut(new)
        side["n"] = side["level"].count()
        if not side["n"]:
            return []
        side["seen"] = side["seen"].unionByName(side["level"].select("node"))

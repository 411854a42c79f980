"""A folder of documents -> vault frames. Text formats and HTML are taken apart by DataFrame functions; a small helper finds the plain strings of PDF files."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.tables import cut
from ..operators.links import extract, image_alts, resolve_relative
from ..operators.report import image_texts
from . import html as H
from .pdf import shown_text

#: Folders and files that are never indexed.
SKIPPED_FOLDERS = (".obsidian", ".git", ".quillgrid", "node_modules", ".github", "__pycache__", ".venv", "venv", ".trash")
SKIPPED_FILES = ("MAP.md", ".vaultignore")
SECTION = "array<struct<line:int,level:int,heading:string,content:string>>"
#: Of the code below; rows of another version are read anew by an update.
PARSER = 4
#: So many touched files are named to the reader.
NAMED = 1_000
#: A plain-text section ends at the first blank line after so many lines that are not.
PLAIN_LINES = 12


@dataclass(frozen=True)
class Frames:
    """The tables of a vault."""

    files: DataFrame
    #: With title, tags and aliases of the document.
    sections: DataFrame
    links: DataFrame
    alts: DataFrame
    #: (path) of the documents that were read and taken apart for these tables.
    parsed: DataFrame

    def scan(self) -> DataFrame:
        """A row per section with its document's metadata, as search reads it; sections carry these, so no text is moved."""
        return self.sections


def ignored(path: Column, patterns: list[str]) -> Column:
    """A pattern with "/" or a wildcard is matched against the whole path (or a folder above it), another one against its parts."""
    out = F.exists(F.split(path, "/"), lambda p: p.isin(*SKIPPED_FOLDERS)) | C.base(path).isin(*SKIPPED_FILES)
    for raw in patterns:
        pattern = raw.strip().rstrip("/")
        if not pattern or pattern.startswith("#"):
            continue
        if any(c in pattern for c in "/*?["):
            out = out | F.rlike(path, F.lit("^" + fnmatch.translate(pattern).replace("(?s:", "(?:(?s)"))) | F.rlike(path, F.lit("^" + fnmatch.translate(pattern + "/*").replace("(?s:", "(?:(?s)")))
        else:
            out = out | F.array_contains(F.split(path, "/"), pattern)
    return out


def ignore_patterns(spark: SparkSession, root: str) -> list[str]:
    """The lines of the folder's own list of patterns (".vaultignore"), if it has one; a short file that people write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.vaultignore")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    stream = fs.open(path)  # Spark's readers pass over hidden files
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def listing(spark: SparkSession, root: str, patterns: list[str] = (), only: list[str] | None = None) -> DataFrame:
    """(path, mtime, length, ext, content) of all files below ``root`` (or of the files ``only``) that are not ignored; paths are relative. Content is read where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.load(root if only is None else [f"{root}/{p}" for p in only])
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    path = F.regexp_replace(full, "^" + "\\Q" + "/" + root.split(":", 1)[-1].strip("/") + "/\\E", "")
    return files.select(path.alias("path"), F.col("modificationTime").alias("mtime"), "length", "content").where(~ignored(F.col("path"), list(patterns))).withColumn("ext", C.extension(F.col("path")))


def unindexed(files: DataFrame) -> DataFrame:
    """(ext, n) of files whose type is not indexed."""
    return files.where(~F.col("ext").isin(*C.INDEXED)).groupBy("ext").agg(F.count("*").alias("n"))


def _front(text: Column, key: str) -> Column:
    """The value of a frontmatter key: inline, or the items of a block list joined by commas; null without it."""
    front = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)(?:\n---[ \t]*(?:\n|\z)|\z)", 1)
    inline = F.regexp_extract(front, rf"(?im)^{key}:[ \t]*(\S.*)$", 1)
    block = F.regexp_extract(front, rf"(?im)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+.*(?:\n|\z))+)", 1)
    items = F.regexp_replace(F.regexp_replace(F.trim(block), r"(?m)^[ \t]*-[ \t]+", ""), "\n", ", ")
    return F.regexp_replace(F.trim(F.when(inline != "", inline).otherwise(items)), "^[\"']|[\"']$", "")


def list_items(raw: Column) -> Column:
    """``[a, b]`` or ``a, b`` -> lower-cased items."""
    return F.filter(F.transform(F.split(F.regexp_replace(raw, r"^\[|\]$", ""), ","), lambda x: F.lower(F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))), lambda x: x != "")


def markdown_sections(text: Column) -> Column:
    """Sections at heading lines (any line of one to six # and a blank); text before the first is "(intro)", level 0."""
    ends = F.regexp_instr(text, F.lit(r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(\n|\z)"))
    front = F.when(ends > 0, F.size(F.split(F.regexp_extract(text, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", 0), "\n")) - 1).otherwise(0)
    lines = F.split(text, "\n")
    state = F.transform(F.array(F.struct(lines.alias("l"), front.alias("f"))), lambda s: F.struct(s["l"].alias("l"), s["f"].alias("f"), F.filter(F.sequence(F.lit(0), F.size(s["l"]) - 1), lambda i: (i >= s["f"]) & F.rlike(F.get(s["l"], i), F.lit(r"^#{1,6}\s+"))).alias("h")))

    def sections(s: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(s["h"], k), F.size(s["l"]))
        text_of = lambda a, b: F.btrim(F.array_join(F.slice(s["l"], a + 1, F.greatest(b - a, F.lit(0))), "\n"), F.lit("\n"))
        heads = F.transform(s["h"], lambda h, k: F.struct((h + 1).alias("line"), F.char_length(F.regexp_extract(F.get(s["l"], h), "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.get(s["l"], h), r"^#{1,6}\s+", "")).alias("heading"), text_of(h + 1, stop(k + 1)).alias("content")))
        intro = F.struct((s["f"] + 1).alias("line"), F.lit(0).alias("level"), F.lit("(intro)").alias("heading"), text_of(s["f"], stop(F.lit(0))).alias("content"))
        return F.when((F.size(heads) == 0) | (F.coalesce(F.get(s["h"], F.lit(0)), F.size(s["l"])) > s["f"]), F.concat(F.array(intro).cast(SECTION), heads.cast(SECTION))).otherwise(heads.cast(SECTION))

    return F.element_at(F.transform(state, sections), 1)


def _blank(line: Column) -> Column:
    return ~F.rlike(line, F.lit(r"(?U)\S"))


def plain_sections(text: Column) -> Column:
    """Sections at blank lines after twelve lines that are not blank; the first such line is the heading."""
    start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(s: Column, line: Column) -> Column:
        blank = _blank(line)
        end = blank & (s["n"] >= PLAIN_LINES)
        n = F.when(end, 0).when(blank, s["n"]).otherwise(s["n"] + 1)
        return F.struct(F.when(end, F.array_append(s["cuts"], s["i"] + 1)).otherwise(s["cuts"]).alias("cuts"), n.alias("n"), (s["i"] + 1).alias("i"))

    cuts = F.aggregate(F.split(text, "\n"), start, step, lambda s: F.array_append(s["cuts"], s["i"]))

    def sections(c: Column, lines: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: F.struct((F.get(c, k - 1) + 1).alias("line"), F.lit(1).alias("level"), F.slice(lines, F.get(c, k - 1) + 1, F.get(c, k) - F.get(c, k - 1)).alias("own")))
        named = F.transform(made, lambda x: F.struct(x["line"], x["level"], F.substr(C.trim_spaces(F.get(F.filter(x["own"], lambda t: ~_blank(t)), F.lit(0))), F.lit(1), F.lit(60)).alias("heading"), F.btrim(F.array_join(x["own"], "\n"), F.lit("\n")).alias("content")))
        return F.filter(named, lambda x: x["heading"].isNotNull()).cast(SECTION)

    return F.element_at(F.transform(F.array(F.struct(cuts.alias("c"), F.split(text, "\n").alias("l"))), lambda s: sections(s["c"], s["l"])), 1)


def _pdf_texts(rows: DataFrame) -> DataFrame:
    """(path, content) of PDF files -> (path, pdf)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "pdf": [shown_text(bytes(c)) for c in batch["content"]]})

    return rows.select("path", "content").mapInPandas(run, "path string, pdf string")


def build(spark: SparkSession, root: str, patterns: list[str] = (), before: Frames | None = None) -> Frames:
    """Index the folder ``root``; each table is written to the session's shared folder.

    With the tables ``before``, only documents that are new or have another modification time are read; the rows of all others stay.
    """
    if before is None:
        return with_images(parsed(indexed(spark, root, patterns)))
    now = cut(indexed(spark, root, patterns).select("path", "mtime"))
    same = cut(now.join(before.files.where(F.col("parser") == PARSER).select("path", "mtime"), ["path", "mtime"], "left_semi").select("path"))
    new = parsed(touched(spark, root, patterns, now, same))
    stay = lambda old, own, key: cut(old.join(same.withColumnRenamed("path", key), key, "left_semi").select(own.columns).unionByName(own))
    return with_images(Frames(stay(before.files, new.files, "path"), stay(before.sections, new.sections, "path"), stay(before.links, new.links, "src"), stay(before.alts, new.alts, "src"), new.parsed))


def indexed(spark: SparkSession, root: str, patterns: list[str] = ()) -> DataFrame:
    """The listing of all files that are indexed."""
    return listing(spark, root, patterns).where(F.col("ext").isin(*C.INDEXED))


def touched(spark: SparkSession, root: str, patterns: list[str], now: DataFrame, same: DataFrame) -> DataFrame:
    """The listing of those files of ``now`` (path, mtime) that are not ``same`` (path).

    A few are named to the reader. Of many only their first and last modification time reach the driver; the reader passes over the content of all files outside of these.
    """
    todo = cut(now.join(same, "path", "left_anti").select("path", "mtime"))
    n, first, last = todo.agg(F.count("*"), F.min("mtime"), F.max("mtime")).first()
    if not n:
        return indexed(spark, root, patterns).where("false")
    if n <= NAMED:
        return listing(spark, root, patterns, [r["path"] for r in todo.select("path").collect()])
    return indexed(spark, root, patterns).where(F.col("mtime").between(F.lit(first), F.lit(last))).join(todo.select("path"), "path", "left_semi")


def with_images(frames: Frames) -> Frames:
    """Frames with a section for each image: its name and what references to it say. Images' own sections are made anew; no other section is moved."""
    images = frames.files.where(F.col("ext").isin(*C.IMAGES))
    shown = image_texts(images.select("path"), frames.alts).join(images.select("path", "title", "tags", "aliases"), "path")
    made = cut(shown.select("path", F.lit(0).alias("sec_no"), F.lit(1).cast("long").alias("line"), F.lit(1).alias("level"), F.lit("(image)").alias("heading"), "content", "title", "tags", "aliases"))
    others = frames.sections.where(~C.extension(F.col("path")).isin(*C.IMAGES))
    return Frames(frames.files, others.unionByName(made, allowMissingColumns=True), frames.links, frames.alts, frames.parsed)


def parsed(found: DataFrame) -> Frames:
    """The tables of the files given."""
    binary = F.col("ext").isin(*C.PDF, *C.IMAGES)
    raw = C.line_feeds(F.make_valid_utf8(F.col("content").cast("string")))
    docs = found.withColumn("raw", F.when(~binary, raw)).join(_pdf_texts(found.where(F.col("ext").isin(*C.PDF))), "path", "left")
    is_html = F.col("ext").isin(*C.HTML)
    page = H.body(F.col("raw"))
    docs = docs.withColumns({"page": F.when(is_html, page), "refs": F.when(is_html, H.references(F.col("raw"))), "pics": F.when(is_html, H.pictures(F.col("raw")))})
    docs = docs.withColumn("parsed", F.when(is_html, H.sections(F.col("page")).cast(SECTION)))
    svg = F.regexp_replace("raw", r"<[^>]*>", " ")
    text = F.when(F.col("ext").isin(*C.PDF), F.col("pdf")).when(is_html, H.visible(F.col("page"))).when(F.col("ext") == ".svg", svg).otherwise(F.col("raw"))
    docs = docs.withColumn("text", F.coalesce(text, F.lit("")))
    name = C.stem(F.col("path"))
    only_name = F.array(F.struct(F.lit(1).alias("line"), F.lit(1).alias("level"), F.when(F.col("ext") == ".pdf", "(pdf)").otherwise("(image)").alias("heading"), F.concat_ws(" ", name, C.stem_words(name)).alias("content"))).cast(SECTION)
    sections = (
        F.when(F.col("ext").isin(*C.MARKDOWN), markdown_sections(F.col("text")))
        .when(F.col("ext").isin(*C.IMAGES) | (F.trim("text") == "") & F.col("ext").isin(".pdf", ".svg"), only_name)
        .when(F.coalesce(F.size("parsed"), F.lit(0)) > 0, F.col("parsed"))
        .otherwise(plain_sections(F.col("text")))
    )
    docs = docs.withColumn("sections", sections)
    first = F.get(F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != ""), F.lit(0))
    h1 = F.get(F.filter("sections", lambda s: s["level"] == 1), F.lit(0))["heading"]
    title = (
        F.when(F.col("ext").isin(*C.MARKDOWN), F.coalesce(F.nullif(_front(F.col("text"), "title"), F.lit("")), h1))
        .when(is_html, F.nullif(H.page_title(F.col("raw")), F.lit("")))
        .when(F.col("ext") == ".svg", F.nullif(F.trim(F.regexp_extract("raw", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))
        .when(F.col("ext").isin(*C.PLAIN), F.substr(first, F.lit(1), F.lit(80)))
    )
    sha = F.when(binary, F.sha2("content", 256)).otherwise(F.sha2("raw", 256))
    words = F.when(F.col("ext").isin(*C.IMAGES), 0).otherwise(C.word_count(F.when(F.col("ext") == ".pdf", F.col("text")).otherwise(F.col("raw"))))
    listed = lambda key: F.when(F.col("ext").isin(*C.MARKDOWN), list_items(_front(F.col("text"), key))).otherwise(F.array().cast("array<string>"))
    done = cut(docs.select("path", "ext", "mtime", sha.alias("sha"), F.coalesce(title, name).alias("title"), words.cast("long").alias("words"), listed("tags").alias("tags"), listed("aliases").alias("aliases"), "sections", "text", F.when(F.col("ext").isin(*C.HTML), F.col("raw")).otherwise(F.col("text")).alias("linked"), "refs", "pics"))
    files = done.select("path", "ext", "mtime", "sha", "title", "words", "tags", "aliases", F.lit(PARSER).alias("parser"))
    wide = done.where(~F.col("ext").isin(*C.PDF, *C.IMAGES)).select("path", F.col("linked").alias("text"))
    href = done.where(F.size("refs") > 0).select(F.col("path").alias("src"), F.explode("refs").alias("dst")).withColumn("dst", F.regexp_replace("dst", "[#?].*$", ""))
    href = href.where((F.col("dst") != "") & ~F.rlike("dst", F.lit("^(https?://|mailto:|//)")) & C.extension(F.col("dst")).isin(*C.MARKDOWN, *C.HTML))
    href = href.select("src", resolve_relative(C.folder(F.col("src")), F.col("dst")).alias("dst"), F.lit("md").alias("kind"))
    pics = done.where(F.size("pics") > 0).select(F.col("path").alias("src"), F.explode("pics").alias("x")).select("src", F.regexp_replace("x.src", "[#?].*$", "").alias("dst"), F.trim("x.alt").alias("alt"))
    pics = pics.where(C.extension(F.col("dst")).isin(*C.IMAGES, ".svg") & ~F.rlike("dst", F.lit("^(https?://|data:|//)"))).withColumn("dst", resolve_relative(C.folder(F.col("src")), F.col("dst")))
    links = cut(extract(wide).unionByName(href).unionByName(pics.select("src", "dst", F.lit("img").alias("kind"))))
    alts = cut(image_alts(wide).unionByName(pics.where("alt <> ''").select("src", "dst", "alt")))
    each = done.where(~F.col("ext").isin(*C.IMAGES)).select("path", "title", "tags", "aliases", F.posexplode("sections").alias("sec_no", "s"))
    each = each.select("path", "sec_no", F.col("s.line").cast("long").alias("line"), "s.level", "s.heading", "s.content", "title", "tags", "aliases")
    return Frames(files, each, links, alts, done.select("path"))

"""The append-only log: reading, compaction, freshness against content hashes, pruning, repinning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SOURCES = "array<struct<path:string,sha:string>>"
KINDS = ("note", "edge", "embed")


#: Folders of rewritten lines begin so; each holds the names of the files that it stands for.
REWRITTEN, COVERS = "rewritten-", "_covers"


def log_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files and folders of a log that count, and those that the newest rewritten folder stands for and that may be deleted."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
    names = [n for n in names if n[0] not in "._"]
    newest = max((n for n in names if n.startswith(REWRITTEN)), default=None)
    if newest is None:
        return names, []
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{path}/{newest}/{COVERS}"))
    try:
        covered = set(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n"))
    finally:
        stream.close()
    return [n for n in names if n not in covered], [n for n in names if n in covered]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, raw, v, type): JSON lines as VARIANT, ``line`` ordering them: those that were rewritten, then by file name and place; what is no JSON object with a string type has a null type, and unknown types are kept as they are."""
    files, _ = log_files(spark, path)
    late = F.when(F.contains("_metadata.file_path", F.lit(f"/{REWRITTEN}")), "0").otherwise("1")
    at = F.concat_ws("#", late, "_metadata.file_name", F.lpad(F.col("_metadata.file_block_start").cast("string"), 16, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    found = spark.read.text([f"{path}/{n}" for n in files]) if files else spark.createDataFrame([], "value string, _metadata struct<file_path:string,file_name:string,file_block_start:long>")
    lines = found.select(at.alias("line"), F.col("value").alias("raw")).where("trim(raw) <> ''")
    return typed(lines)


def rewrite_log(spark: SparkSession, path: str, kept: DataFrame, now: str) -> None:
    """Replace what the log holds by the lines ``kept`` (line, raw).

    They are written beside the log's files, with the names of the files they stand for, and come in force by one rename; the old files go
    after that. At every moment a reader finds the old lines or the new ones, and what is appended meanwhile stays.
    """
    jvm = spark._jvm
    of = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = of("x").getFileSystem(spark._jsc.hadoopConfiguration())
    counted, covered = log_files(spark, path)
    new, hidden = f"{REWRITTEN}{now}", f"_{now}"
    kept.repartitionByRange("line").sortWithinPartitions("line").select("raw").write.text(f"{path}/{hidden}")
    out = fs.create(of(f"{hidden}/{COVERS}"), False)
    out.write(bytearray("\n".join([*counted, *covered]).encode()))
    out.close()
    if not fs.rename(of(hidden), of(new)):
        raise OSError(f"cannot rename {hidden} to {new} in {path}")
    for name in (*counted, *covered):
        fs.delete(of(name), True)


def typed(lines: DataFrame) -> DataFrame:
    """Lines of JSON (``raw``) with their value as VARIANT and its type."""
    return lines.withColumn("v", F.expr("try_parse_json(raw)")).withColumn("type", F.expr("try_variant_get(v, '$.type', 'string')"))


def surfaced(notes_: DataFrame, files: DataFrame, terms: list[str], n: int = 3, key: str = "line") -> DataFrame:
    """The n newest of the fresh notes whose question and insight hold all terms literally; none without a term."""
    if not terms:
        return notes_.where("false")
    low = F.lower(F.concat_ws(" ", "question", "insight"))
    holding = notes_.where(reduce(lambda a, b: a & b, (F.contains(low, F.lit(t)) for t in terms)))
    fresh = note_freshness(holding, files, key).where("fresh").select(key)
    return holding.join(fresh, key, "left_semi").orderBy(F.desc(key)).limit(n)


def matched_notes(notes_: DataFrame, terms: list[str], n: int = 3) -> DataFrame:
    """The n newest notes whose question and insight hold all terms literally."""
    low = F.lower(F.concat_ws(" ", "question", "insight"))
    for term in terms:
        notes_ = notes_.where(F.contains(low, F.lit(term)))
    return newest(notes_, n)


def pruned(log: DataFrame, kind: str, *key: str) -> DataFrame:
    """``log`` of which of one kind only the last record of each ``key`` stays; without a key none of that kind does."""
    rest = log.where((F.col("type") != kind) | F.col("type").isNull())
    return rest.unionByName(last_wins(log.where(F.col("type") == kind), *key).select(log.columns)) if key else rest


def _get(name: str, kind: str = "string") -> Column:
    return F.coalesce(F.expr(f"try_variant_get(v, '$.{name}', '{kind}')"), F.lit("")) if kind == "string" else F.expr(f"try_variant_get(v, '$.{name}', '{kind}')")


def notes(log: DataFrame) -> DataFrame:
    return log.where("type = 'note'").select("line", _get("question").alias("question"), _get("insight").alias("insight"), _get("created").alias("created"), F.coalesce(_get("sources", SOURCES), F.array().cast(SOURCES)).alias("sources"))


def edges(log: DataFrame) -> DataFrame:
    return log.where("type = 'edge'").select("line", *(_get(c).alias(c) for c in ("src", "dst", "relation", "rationale", "origin", "created", "src_sha", "dst_sha")))


def embeds(log: DataFrame) -> DataFrame:
    return log.where("type = 'embed'").select("line", _get("path").alias("path"), _get("sha").alias("sha"), _get("vec", "array<double>").alias("vec"))


def last_wins(records: DataFrame, *key: str, order: str = "line") -> DataFrame:
    """The last record of every key: a grouped maximum, combined map-side, not a window."""
    rest = [c for c in records.columns if c not in (*key, order)]
    best = records.groupBy(*key).agg(F.max(order).alias(order), F.max_by(F.struct(*rest), order).alias("r") if rest else F.lit(1).alias("r"))
    return best.select(*key, order, *([F.col(f"r.{c}").alias(c) for c in rest]))


def compacted(log: DataFrame) -> DataFrame:
    """``log`` without superseded records: of an edge (src, dst, relation) and an embedding (path) the last; all notes, unknown and malformed lines stay."""
    key = F.when(F.col("type") == "edge", F.concat_ws("\x1f", _get("src"), _get("dst"), _get("relation"))).when(F.col("type") == "embed", _get("path"))
    keyed = log.withColumn("key", key)
    last = keyed.where("key is not null").groupBy("type", "key").agg(F.max("line").alias("line")).select("line")
    return keyed.where("key is null").select(log.columns).unionByName(keyed.where("key is not null").join(last, "line", "left_semi").select(log.columns))


def note_freshness(notes_: DataFrame, files: DataFrame, key: str = "line") -> DataFrame:
    """(key, fresh): whether all sources of a note still have their hash; a note without sources is fresh."""
    pins = notes_.select(key, F.explode_outer("sources").alias("s")).select(key, F.col("s.path").alias("path"), F.col("s.sha").alias("pinned"))
    now = pins.join(files.select("path", F.col("sha").alias("now")), "path", "left")
    return now.groupBy(key).agg(F.bool_and(F.col("path").isNull() | F.coalesce(F.col("pinned") == F.col("now"), F.lit(False))).alias("fresh"))


def edge_freshness(edges_: DataFrame, files: DataFrame) -> DataFrame:
    """``edges_`` with fresh: both ends exist and have their pinned hashes."""
    a, b = files.select(F.col("path").alias("src"), F.col("sha").alias("a_sha")), files.select(F.col("path").alias("dst"), F.col("sha").alias("b_sha"))
    joined = edges_.join(a, "src", "left").join(b, "dst", "left")
    return joined.withColumn("fresh", F.coalesce((F.col("src_sha") == F.col("a_sha")) & (F.col("dst_sha") == F.col("b_sha")), F.lit(False))).drop("a_sha", "b_sha")


def embed_status(embeds_: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of every document: fresh, stale or missing. Vectors of documents that are gone are in none."""
    pinned = last_wins(embeds_.select("path", "line", F.col("sha").alias("pinned")), "path").select("path", "pinned")
    both = files.select("path", "sha").join(pinned, "path", "left")
    return both.select("path", F.when(F.col("pinned").isNull(), "missing").when(F.col("pinned") == F.col("sha"), "fresh").otherwise("stale").alias("status"))


#: A JSON string.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_SOURCES, _OBJECT = rf'(?s)^(.*?"sources"\s*:\s*)(\[(?:[^\]"]++|{_STRING})*+\])(.*)$', rf'(?s)\{{(?:[^{{}}"]++|{_STRING})*+\}}'


def _json(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def _put(record: Column, key: str, value: Column) -> Column:
    """A JSON text with the string value of a key replaced, and nothing else. A quote inside a string is escaped, so only a key looks like one."""
    around = rf'(?s)^(.*?"{key}"\s*:\s*){_STRING}(.*)$'
    before = F.regexp_extract(record, around, 1)
    return F.when((before != "") & value.isNotNull(), F.concat(before, _json(value), F.regexp_extract(record, around, 2))).otherwise(record)


def carried(log: DataFrame, rewritten: DataFrame, old: str | None = None, new: str | None = None) -> DataFrame:
    """(line, raw) of ``log`` after documents were rewritten and, with ``old`` and ``new``, one was moved.

    ``rewritten`` is (was, path, old_sha, new_sha). A record's paths become the new ones, and a pin that equalled the old hash becomes the new one;
    stale pins stay stale. Only these strings are put in place: all else of a record stays byte for byte, and so do records without such a path, of unknown types or malformed. The ends of an edge stay sorted.
    """
    fields = {"edge": (("src", "src_sha"), ("dst", "dst_sha")), "embed": (("path", "sha"),)}
    pins = log.where("type = 'note'").select("line", F.posexplode(F.coalesce(_get("sources", SOURCES), F.array().cast(SOURCES))).alias("k", "s")).select("line", "k", "s.path", "s.sha")
    for kind, ends in fields.items():
        for k, (path, sha) in enumerate(ends):
            pins = pins.unionByName(log.where(F.col("type") == kind).select("line", F.lit(k).alias("k"), _get(path).alias("path"), _get(sha).alias("sha")))
    moved = rewritten if old is None else rewritten.unionByName(log.sparkSession.createDataFrame([(old, new, None, None)], rewritten.schema))
    moves = moved.groupBy("was").agg(F.max("path").alias("to"), F.max("old_sha").alias("old_sha"), F.max("new_sha").alias("new_sha"))
    now = F.when((F.col("sha") == F.col("old_sha")) & F.col("new_sha").isNotNull(), F.col("new_sha")).otherwise(F.col("sha"))
    changed = pins.join(moves, pins["path"] == moves["was"], "left").select("line", "k", F.coalesce("to", "path").alias("path"), now.alias("sha"), F.col("was").isNotNull().alias("hit"))
    per = changed.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("k", "path", "sha"))).alias("p"), F.max("hit").alias("hit")).where("hit").select("line", "p")
    sides = F.array_sort(F.transform("p", lambda x: F.struct(x["path"].alias("path"), x["sha"].alias("sha"))))
    raw, one = F.col("raw"), lambda k, name: F.get(sides, F.lit(k))[name]
    span = F.regexp_extract(raw, _SOURCES, 2)
    objects = F.zip_with(F.regexp_extract_all(span, F.lit(_OBJECT), F.lit(0)), F.col("p"), lambda o, x: _put(_put(o, "path", x["path"]), "sha", x["sha"]))
    listed = F.array_join(F.zip_with(F.split(span, _OBJECT, -1), objects, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    made = (
        F.when(F.col("type") == "note", F.concat(F.regexp_extract(raw, _SOURCES, 1), listed, F.regexp_extract(raw, _SOURCES, 3)))
        .when(F.col("type") == "edge", _put(_put(_put(_put(raw, "src", one(0, "path")), "dst", one(1, "path")), "src_sha", one(0, "sha")), "dst_sha", one(1, "sha")))
        .when(F.col("type") == "embed", _put(_put(raw, "path", one(0, "path")), "sha", one(0, "sha")))
    )
    return log.join(per, "line", "left").select("line", F.when(F.col("p").isNull(), raw).otherwise(made).alias("raw"))


def counters(log: DataFrame, known: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, n): lines of each type, of unknown types and malformed ones."""
    kind = F.when(F.col("type").isNull(), "malformed").when(F.col("type").isin(*known), F.col("type")).otherwise("unknown")
    return log.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def newest(records: DataFrame, n: int, *key: str) -> DataFrame:
    """The n newest records of each key, or of all."""
    if not key:
        return records.orderBy(F.desc("line")).limit(n)
    return records.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("line")))).where(F.col("r") <= n).drop("r")

"""The Vault: one object over a folder's frames and its log, with a method per command."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import cut
from ..functions.terms import parse
from ..operators import edits as E
from ..operators import links as L
from ..operators import report as R
from ..operators import search as S
from ..operators import semlog as G
from ..operators import suggest as U
from ..operators.vectors import GroupedVectors
from ..sources import vault as V
from ..sources.index import KeptIndex


#: A node-link graph as it is exported.
GRAPH = "nodes array<struct<id: string, label: string, source_file: string>>, links array<struct<source: string, target: string, confidence: string, relation: string>>"


#: A folder of this name marks the root of a vault.
MARK = ".quillgrid"


def find_root(spark: SparkSession, start: str, mark: str = MARK) -> str:
    """``start`` or the nearest folder above it that holds ``mark``, in any file system that Spark reads; an error if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(start).getFileSystem(spark._jsc.hadoopConfiguration())
    at = fs.makeQualified(hadoop.Path(start))
    while at is not None:
        if fs.exists(hadoop.Path(at, mark)):
            return at.toString()
        at = at.getParent()
    raise FileNotFoundError(f"no {mark} in {start} or above it")


class Vault:
    """``root`` is a folder that Spark can read; the log is a folder of JSON lines, each append a file of its own."""

    def __init__(self, spark: SparkSession, root: str, log: str | None = None, patterns: list[str] = (), index: str | None = None, buckets: int = 64) -> None:
        """``index`` is a folder for an index that outlives the session: it is made there once, opened as it is afterwards, and brought up to date by ``update``."""
        self.spark, self.root, self.log_path, self.patterns = spark, root.rstrip("/"), log, list(patterns)
        self.index = KeptIndex(spark, index, buckets) if index else None
        if self.index is None:
            self.frames = V.build(spark, self.root, self._all_patterns())
        elif self.index.exists():
            self.frames = self.index.open()
        else:
            read = V.parsed(V.indexed(spark, self.root, self._all_patterns()))
            self.index.create(read)
            self.frames = self.index.open(read.parsed)

    def _all_patterns(self) -> list[str]:
        return self.patterns + V.ignore_patterns(self.spark, self.root)

    def update(self, patterns: list[str] | None = None) -> DataFrame:
        """Read what is new or was touched since; returns (change, n): documents that are new, changed, deleted or unchanged by content. ``frames.parsed`` lists what was read."""
        before = cut(self.frames.files.select("path", "sha"))
        self.patterns = self.patterns if patterns is None else list(patterns)
        if self.index is None:
            self.frames = V.build(self.spark, self.root, self._all_patterns(), self.frames)
        else:
            now = cut(V.indexed(self.spark, self.root, self._all_patterns()).select("path", "mtime"))
            same = cut(self.index.same(now))
            new = V.parsed(V.touched(self.spark, self.root, self._all_patterns(), now, same))
            self.index.apply(new, same)
            self.frames = self.index.open(new.parsed)
        return R.changes(before, self.frames.files).groupBy("change").agg(F.count("*").alias("n"))

    def _scan(self, texts: list[str]) -> tuple[DataFrame, int | None]:
        """What a search of ``texts`` has to read, and the number of all documents: with a kept index, only documents that its trigrams don't rule out."""
        scan = self.frames.scan()
        if self.index is None:
            return scan, None
        return self.index.narrowed(scan, [parse(x) for x in texts]), scan.agg(F.count_distinct("path")).first()[0]

    def search(self, queries: str | list[str], n: int = 8, vector: list[float] | None = None) -> DataFrame:
        texts = [queries] if isinstance(queries, str) else list(queries)
        scan, total = self._scan(texts)
        if vector is not None and len(texts) == 1:
            return S.hybrid(self.frames.scan(), texts[0], self.fresh_embeds(), vector, n, S.rank(scan, texts[0], total))
        if len(texts) > 1:
            near = None if vector is None else S.semantic_hits(self.fresh_embeds(), vector, max(n, 20))
            return S.fused(scan, texts, n, near, total)
        return S.rank(scan, texts[0], total).top(n)

    def feedback(self, queries: str | list[str]) -> dict | list[dict]:
        """Flags and document frequencies of a query, or of each of several phrasings, from one pass over the texts."""
        texts = [queries] if isinstance(queries, str) else list(queries)
        scan, total = self._scan(texts)
        says = [{"query": text, "partial": found.partial, "weak": found.weak(), "terms": [{"term": t, "df": found.stats.df.get(t, 0)} for t in found.query.plain]} for text, found in zip(texts, S.rank_all(scan, texts, total))]
        return says[0] if isinstance(queries, str) else says

    def evidence(self, query: str, n: int = 8, k: int = 5) -> DataFrame:
        scan = self.frames.scan()
        found = S.rank(scan, query)
        return S.evidence(scan, cut(found.top(n).select("path", "line")), found.query, found.stats, k)

    def links(self, target: str) -> dict[str, DataFrame]:
        f = self.frames
        if target.upper().startswith("REQ-"):
            return {"docs": f.links.where((F.col("kind") == "req") & (F.col("dst") == target.upper())).select("src").distinct()}
        r = L.resolved(f.links, f.files)
        edges = self.edges().where("fresh").where((F.col("src") == target) | (F.col("dst") == target))
        other = F.when(F.col("src") == target, F.col("dst")).otherwise(F.col("src"))
        return {
            "outlinks": r.where(F.col("src") == target).select(F.coalesce("target", "dst").alias("target"), "kind").distinct(),
            "backlinks": r.where((F.col("target") == target) & (F.col("src") != target)).select(F.col("src").alias("source"), "kind").distinct(),
            "inferred": edges.select(other.alias("other"), "relation", "origin", "rationale"),
        }

    def connections(self) -> DataFrame:
        return L.connections(self.frames.links, self.frames.files, self.edges().where("fresh"))

    def path(self, a: str, b: str) -> list[str]:
        return L.shortest_path(cut(self.connections()), a, b)

    def path_steps(self, a: str, b: str) -> DataFrame:
        """(step, path, via): the documents of ``path`` and what joins each to the one before (of several the smallest); no rows if there is no way."""
        chain = self.path(a, b)
        steps = self.spark.createDataFrame([(k, chain[k - 1] if k else None, x) for k, x in enumerate(chain)], "step int, a string, b string")
        via = L.labelled(self.frames.links, self.frames.files, self.edges().where("fresh")).join(steps, ["a", "b"]).groupBy("step").agg(F.min("via").alias("via"))
        return steps.join(via, "step", "left").select("step", F.col("b").alias("path"), "via").orderBy("step")

    def suggest(self, doc: str | None = None, n: int | None = 10, max_df: int = 4) -> DataFrame:
        prose = self.frames.files.where(F.col("ext").isin(*V.C.PROSE))
        linked = L.connections(self.frames.links.where("kind in ('wiki', 'md')"), self.frames.files, self.edges())
        return U.suggest(self.frames.scan().join(prose.select("path"), "path", "left_semi"), prose, links=self.frames.links, linked=linked, doc=doc, max_df=max_df, n=n, words=self.index and self.index.words())

    def suggest_links(self, doc: str | None = None, n: int | None = 10, max_df: int = 4) -> DataFrame:
        """``suggest`` with wiki links to paste."""
        return U.paste_links(self.suggest(doc, n, max_df), doc)

    def fix_links(self) -> DataFrame:
        broken = L.broken(self.frames.links.where("kind = 'wiki'"), self.frames.files)
        close = E.close_names(broken.select("label"), L.names(self.frames.files))
        return broken.join(close.groupBy("label").agg(F.collect_list("candidate").alias("candidates")), "label", "left")

    def link_add(self, doc: str, targets: list[str], section: str | None = None) -> DataFrame:
        wanted = self.spark.createDataFrame([(doc, t) for t in targets], "path string, target string")
        return E.links_to_add(self._texts(), self.frames.files, wanted, section)

    def mv(self, old: str, new: str) -> DataFrame:
        """(path, text, n): the moved document under its new path, its own relative links made right, and all documents that refer to it."""
        return E.rename_plan(self._texts(), self.frames.files, old, new)

    def log_after(self, plan: DataFrame, old: str | None = None, new: str | None = None) -> DataFrame:
        """(line, raw): the log after the texts of ``plan`` (path, text) are in place and, with ``old`` and ``new``, a document was moved: records of the old path name the new one, and pins that were fresh are those of the new texts."""
        here = F.col("path") if new is None else F.when(F.col("path") == new, old).otherwise(F.col("path"))
        now = plan.select("path", F.sha2(V.C.line_feeds(F.col("text")), 256).alias("new_sha"), here.alias("was"))
        was = self.frames.files.select(F.col("path").alias("was"), F.col("sha").alias("old_sha"))
        return G.carried(self.log(), now.join(was, "was").select("was", "path", "old_sha", "new_sha"), old, new)

    def apply(self, plan: DataFrame, old: str | None = None, new: str | None = None) -> DataFrame:
        """Put the texts of a plan (of ``link_add``, or of ``mv`` with its ``old`` and ``new``) in their files, carry the log along and update; returns what ``update`` does.

        Each file is written beside its place and renamed into it, one at a time as they come from the executors; the log is rewritten last, and only if it changes.
        """
        plan = cut(plan.select("path", "text"))
        log = None if self.log_path is None else cut(self.log_after(plan, old, new))
        path = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())
        for row in plan.toLocalIterator():
            place, beside = path(row["path"]), path(f"{row['path']}.{uuid.uuid4().hex}.part")
            fs.mkdirs(place.getParent())
            out = fs.create(beside, False)
            out.write(bytearray(row["text"].encode()))
            out.close()
            fs.delete(place, False)
            fs.rename(beside, place)
        if old is not None:
            fs.delete(path(old), False)
        if log is not None and log.join(self.log().select("line", F.col("raw").alias("was")), "line").where("raw <> was").limit(1).count():
            self.rewrite_log(log)
        return self.update()

    def notes_for(self, text: str, n: int = 3) -> DataFrame:
        """The newest fresh notes that hold all plain terms of a query."""
        return G.surfaced(G.notes(self.log()), self.frames.files, list(parse(text).plain), n)

    def find(self, queries: str | list[str], n: int = 8, vector: list[float] | None = None, show: str = "blocks") -> dict:
        """All that a search answers: results with what matched, notes of the first query, and flags.

        ``results`` (place, path, line, heading, score, matched, ...) shows per document the best lines by idf, of all phrasings' terms: as ``blocks``, the first three documents' eight best
        lines with two lines around each and the others' five best lines; ``compact``, one line; ``full``, blocks and the ``content`` of the section shown. Fused results have ``sources``, those near ``vector`` a ``cosine``.
        """
        texts = [queries] if isinstance(queries, str) else list(queries)
        scan, total = self._scan(texts)
        ranked = S.rank_all(scan, texts, total)
        if len(texts) > 1:
            near = None if vector is None else S.semantic_hits(self.fresh_embeds(), vector, max(n, 20))
            best = S.fused_ranks(ranked, n, near).withColumnRenamed("rrf", "score")
            order = (F.desc("score"), F.col("best_rank"), F.col("best_query"), F.col("path"))
        elif vector is not None:
            best, order = S.hybrid(self.frames.scan(), texts[0], self.fresh_embeds(), vector, n, ranked[0]), (F.desc("blend"), F.desc("matched_idf"), F.desc("nmatched"), F.col("path"))
        else:
            best, order = ranked[0].top(n), S.ranking()
        best = cut(best)
        top = cut(best.withColumn("place", F.row_number().over(W.orderBy(*order))))  # at most n rows
        terms = {t: r.stats.df.get(t, 0) for r in ranked for t in r.query.plain}
        shown = S.matched(self.frames.scan(), top, tuple(terms), S.Statistics(ranked[0].stats.total, terms), compact=show == "compact")
        results = top.join(shown, "path", "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
        if show == "full":
            sections = self.frames.scan().select("path", "line", "heading", "content")
            results = results.join(sections.join(top.select("path"), "path", "left_semi"), ["path", "line", "heading"], "left")
        says = [{"query": r.query.text, "partial": r.partial, "weak": r.weak(), "terms": [{"term": t, "df": r.stats.df.get(t, 0)} for t in r.query.plain]} for r in ranked]
        notes = self.notes_for(texts[0]) if self.log_path else None
        return says[0] | {"queries": says, "notes": notes, "results": results.orderBy("place")}

    def pruned_log(self, kind: str) -> DataFrame:
        """(line, raw) of the log without stale records of a kind ("note" or "edge"); ``rewrite_log`` puts it in place."""
        stale = (self.notes() if kind == "note" else self.edges()).where("not fresh")
        gone = stale.select("line") if kind == "note" else G.edges(self.log()).join(stale.select("src", "dst", "relation"), ["src", "dst", "relation"], "left_semi").select("line")
        return self.log().join(gone, "line", "left_anti").select("line", "raw")

    def rewrite_log(self, kept: DataFrame) -> None:
        """Replace the log by the lines ``kept`` (line, raw)."""
        G.rewrite_log(self.spark, self.log_path, kept, f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}")

    def _texts(self) -> DataFrame:
        found = V.listing(self.spark, self.root, self._all_patterns()).where(F.col("ext").isin(".md", ".txt", ".rst", ".org", ".adoc"))
        return found.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))

    def log(self) -> DataFrame:
        if self.log_path is None:
            return self.spark.createDataFrame([], "line string, raw string").withColumn("v", F.expr("try_parse_json(raw)")).withColumn("type", F.lit(None).cast("string"))
        return G.read_log(self.spark, self.log_path)

    def _append(self, record: dict) -> None:
        """A file per record; its name begins with the time, so that files are read in order."""
        if self.log_path is None:
            raise ValueError("this vault has no log")
        jvm = self.spark._jvm
        name = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}.jsonl"
        path = jvm.org.apache.hadoop.fs.Path(f"{self.log_path}/{name}")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False)
        out.write(bytearray((json.dumps(record, ensure_ascii=False) + "\n").encode()))
        out.close()

    def _pins(self, *paths: str) -> dict[str, str]:
        found = {r["path"]: r["sha"] for r in self.frames.files.where(F.col("path").isin(*paths)).select("path", "sha").collect()}
        for p in paths:
            if p not in found:
                raise ValueError(f"not indexed: {p}")
        return found

    def note_add(self, question: str, insight: str, sources: list[str]) -> None:
        pins = self._pins(*sources) if sources else {}
        self._append({"type": "note", "question": question, "insight": insight, "created": _now(), "sources": [{"path": p, "sha": pins[p]} for p in sources]})

    def edge_add(self, a: str, b: str, rationale: str, relation: str = "related", origin: str = "manual") -> None:
        if not rationale:
            raise ValueError("an edge needs a rationale")
        src, dst = sorted((a, b))
        pins = self._pins(src, dst)
        self._append({"type": "edge", "src": src, "dst": dst, "relation": relation, "rationale": rationale, "origin": origin, "created": _now(), "src_sha": pins[src], "dst_sha": pins[dst]})

    def edge_repin(self, a: str, b: str) -> None:
        src, dst = sorted((a, b))
        pins = self._pins(src, dst)
        for r in self.edges().where((F.col("src") == src) & (F.col("dst") == dst)).collect():
            self._append({"type": "edge", "repinned": _now(), "src_sha": pins[src], "dst_sha": pins[dst]} | {k: r[k] for k in ("src", "dst", "relation", "rationale", "origin", "created")})

    def embed_set(self, path: str, vector: list[float]) -> None:
        self._append({"type": "embed", "path": path, "sha": self._pins(path)[path], "vec": list(map(float, vector))})

    def notes(self) -> DataFrame:
        own = G.notes(self.log())
        return own.join(G.note_freshness(own, self.frames.files), "line")

    def edges(self) -> DataFrame:
        return G.edge_freshness(G.last_wins(G.edges(self.log()), "src", "dst", "relation"), self.frames.files)

    def fresh_embeds(self) -> DataFrame:
        own = G.last_wins(G.embeds(self.log()), "path")
        return own.join(self.frames.files.select("path", "sha"), ["path", "sha"], "left_semi").select("path", "vec")

    def embed_status(self) -> DataFrame:
        return G.embed_status(G.embeds(self.log()), self.frames.files)

    def semsearch(self, vector: list[float], n: int = 10) -> DataFrame:
        return S.semantic_hits(self.fresh_embeds(), vector, n)

    def grouped_vectors(self, path: str, groups: int = 64) -> GroupedVectors:
        """The fresh vectors of now, kept in the folder ``path`` in groups, so that searches skip those that cannot hold a result."""
        return GroupedVectors(self.spark, path).create(self.fresh_embeds(), groups)

    def compacted_log(self) -> DataFrame:
        """(line, raw) of the log without superseded records; write ``raw`` as text to a new folder to replace it."""
        return G.compacted(self.log()).select("line", "raw").orderBy("line")

    def import_edges(self, path: str) -> DataFrame:
        """Edges of a node-link graph (JSON) whose links were inferred; those there already are left out."""
        graph = self.spark.read.schema(GRAPH).option("multiLine", True).json(path)
        nodes = R.node_files(graph.select(F.explode("nodes").alias("x")).select("x.id", "x.label", "x.source_file"), self.frames.files)
        links = graph.select(F.explode("links").alias("x")).select("x.source", "x.target", "x.confidence", "x.relation")
        return R.imported_edges(nodes, links, self.edges())

    def report(self) -> dict[str, DataFrame]:
        f = self.frames
        tags = f.files.select("path", F.explode("tags").alias("tag"))
        pairs = cut(self.connections())
        return {
            "totals": R.totals(f.files), "folders": R.folders(f.files), "hubs": L.hubs(f.links, f.files).orderBy(F.desc("n"), "path").limit(10),
            "recent": f.files.orderBy(F.desc("mtime"), "path").limit(10), "tags": R.top_tags(tags), "refs": R.shared_refs(f.links),
            "edges": self.edges().orderBy(F.desc("line")).limit(12), "notes": self.notes().where("fresh").orderBy(F.desc("line")).limit(10),
            "orphans": L.orphans(f.files, pairs), "broken": L.broken(f.links, f.files), "coverage": V.unindexed(V.listing(self.spark, self.root, self._all_patterns())),
        }

    def write_report(self, path: str) -> None:
        """The report as markdown, as lines of text in order in the folder ``path``."""
        whole = cut(R.lines(self.report()))
        whole.repartitionByRange("part", "place", "line").sortWithinPartitions("part", "place", "line").select("line").write.mode("overwrite").text(path)

    def doctor(self) -> dict[str, DataFrame]:
        f = self.frames
        now = V.listing(self.spark, self.root, self._all_patterns()).where(F.col("ext").isin(*V.C.INDEXED)).select("path", F.col("mtime").cast("string").alias("sha"))
        return {
            "index": R.changes(f.files.select("path", F.col("mtime").cast("string").alias("sha")), now).groupBy("change").agg(F.count("*").alias("n")),
            "log": G.counters(self.log()), "broken": L.broken(f.links, f.files), "orphans": L.orphans(f.files, cut(self.connections())),
            "stale_notes": self.notes().where("not fresh"), "stale_edges": self.edges().where("not fresh"), "embeds": self.embed_status().groupBy("status").agg(F.count("*").alias("n")),
        }


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")

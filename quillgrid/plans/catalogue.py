"""The registered queries of the vault operators over the driver's tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.tables import checkpoint_dir, cut
from ..functions.terms import least_variants, parse, variants
from ..operators import edits as E
from ..operators import links as L
from ..operators import report as R
from ..operators import search as S
from ..operators import semlog as G
from ..operators import suggest as U
from ..operators.vectors import GroupedVectors
from ..sources import tables as T
from ..sources import html as H
from ..sources import vault as V
from ..sources.index import KeptIndex
from ..sources.vault import ignored, plain_sections
from ..streaming.ingest import event_counts

AND, PHRASE, RELAXED = "schung tioned", '"of the"', "schung tioned queción über-alles"
LONG = "the and schung tioned en que der"
CROSSING = '"the. assistant" en'
RARE_WORDS, RARE_PART = "heoron athesh", "lichlich thanbletion"
PHRASINGS = ("schung en", "tioned the", "schung der")


def _round(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _searched(scan: DataFrame, text: str, n: int = 8) -> DataFrame:
    return _round(S.rank(scan, text).top(n), "matched_idf", "score").select("path", "line", "heading", "nmatched", "matched_idf", "score")


def vault_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.document_files(T.document_scan(spark, sf_dir)).select("path", "title", "words", "sha")


def vault_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals(vault_files(spark, sf_dir))


def directory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.folders(vault_files(spark, sf_dir))


def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and idf of fixed terms, in one aggregate."""
    scan = T.document_scan(spark, sf_dir)
    hay = F.lower(F.concat_ws(" ", "title", "path", "heading", "content"))
    terms = ["schung", "tioned", "the", "queción"]
    counts = scan.agg(F.count("*").alias("n"), *(F.sum(C.holds_any(hay, least_variants(t)).cast("long")).alias(f"c{k}") for k, t in enumerate(terms)))
    each = counts.select("n", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"c{k}").alias("df")) for k, t in enumerate(terms)))).alias("x"))
    return each.select("x.term", "x.df", F.round(C.inverse_frequency(F.col("n"), F.col("x.df")), 6).alias("idf"))


def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(T.document_scan(spark, sf_dir), AND)


def search_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(T.document_scan(spark, sf_dir), RELAXED)


def search_long_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(T.document_scan(spark, sf_dir), LONG)


def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(T.document_scan(spark, sf_dir), PHRASE)


def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(T.document_scan(spark, sf_dir), "type:text path:src1 tag:en tioned")


def search_field_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(T.document_scan(spark, sf_dir), "title:the")


def search_rollup_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(T.conversation_scan(spark, sf_dir), "heading:assistant the en")


def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms scattered over several turns of a conversation count for it as a whole."""
    return _searched(T.conversation_scan(spark, sf_dir), "tioned schung", 20)


def search_fused_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.fused(T.document_scan(spark, sf_dir), list(PHRASINGS), 12), "rrf", digits=8)


def _embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents that have the vector's id."""
    scan = T.document_scan(spark, sf_dir).select("doc_id", "path")
    return T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")).join(scan, "doc_id").select("path", "vec")


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in T.read(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()[0]]


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.hybrid(T.document_scan(spark, sf_dir), AND, _embeds(spark, sf_dir), _probe(spark, sf_dir), 12)
    return _round(found.select("path", "nmatched", "score", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), "blend"), "score", "cosine", "blend", digits=3)


def semsearch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("vec"))
    return S.semantic_hits(near, _probe(spark, sf_dir), 10).select(F.col("path").cast("long").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


def semsearch_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``semsearch_topk`` from vectors kept in groups: only groups that may hold one of the nearest are read."""
    near = T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("vec"))
    kept = GroupedVectors(spark, f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}").create(near)
    return kept.search(_probe(spark, sf_dir), 10).select(F.col("path").cast("long").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = T.document_scan(spark, sf_dir)
    found = S.rank(scan, AND)
    return S.evidence(scan, cut(found.top(8).select("path", "line")), found.query, found.stats).select("path", "ord", "text", F.round("idf", 4).alias("idf"), "place")


def snippet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = T.document_scan(spark, sf_dir)
    found = S.rank(scan, AND)
    picks = S.evidence(scan, cut(found.top(3).select("path", "line")), found.query, found.stats, k=8)
    return S.snippets(scan, cut(picks.select("path", "ord")))


def weak_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of several queries, all from one pass over the texts."""
    texts = (AND, RELAXED, LONG, "zzqqxx", "the")
    found = S.rank_all(T.document_scan(spark, sf_dir), list(texts))
    return reduce(DataFrame.unionByName, (r.flags().select(F.lit(x).alias("query"), "n_results", "partial", "weak") for x, r in zip(texts, found)))


def search_conversation_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase whose words may end one turn and begin the next."""
    return _searched(T.conversation_scan(spark, sf_dir), CROSSING, 20)


def _frames(scan: DataFrame) -> V.Frames:
    """Documents of a table as the frames of a vault without links."""
    spark = scan.sparkSession
    files = scan.select("path", F.lit(".txt").alias("ext"), F.lit(None).cast("timestamp").alias("mtime"), F.sha2("content", 256).alias("sha"), "title", C.word_count(F.col("content")).alias("words"), "tags", "aliases", F.lit(V.PARSER).alias("parser"))
    sections = scan.select("path", "sec_no", "line", F.lit(1).alias("level"), "heading", "content", "title", "tags", "aliases")
    return V.Frames(files, sections, spark.createDataFrame([], "src string, dst string, kind string"), spark.createDataFrame([], "src string, dst string, alt string"), files.select("path"))


def _index(spark: SparkSession) -> KeptIndex:
    return KeptIndex(spark, f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", 16)


def search_kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over a kept index of the documents: trigram postings choose what is read, and the rows are those of a full scan."""
    kept = _index(spark)
    kept.create(_frames(T.document_scan(spark, sf_dir)))
    again = KeptIndex(spark, kept.path)  # as another session opens it
    scan = again.open().scan()
    texts = [RARE_WORDS, RARE_PART]
    narrow, total = again.narrowed(scan, [parse(x) for x in texts]), scan.agg(F.count_distinct("path")).first()[0]
    found = S.rank_all(narrow, texts, total)
    rows = [_round(r.top(8), "matched_idf", "score").select(F.lit(x).alias("query"), "path", "line", "heading", "nmatched", "matched_idf", "score") for x, r in zip(texts, found)]
    return reduce(DataFrame.unionByName, rows)


def kept_index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of an older state (every 10th document missing, every 7th with another text, some that are gone now) brought up to date: its files and words a section, which are those of the documents."""
    now = T.document_scan(spark, sf_dir)
    old = now.where("doc_id % 10 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, "another text").otherwise(F.col("content")))
    gone = now.where("doc_id % 50 = 0").withColumn("path", F.concat(F.lit("gone/"), "path"))
    kept = _index(spark)
    kept.create(_frames(old.unionByName(gone)))
    unchanged = cut(now.where("doc_id % 10 <> 0 and doc_id % 7 <> 0").select("path"))
    kept.apply(_frames(now.where("doc_id % 10 = 0 or doc_id % 7 = 0")), unchanged)
    frames = KeptIndex(spark, kept.path).open()
    return frames.files.select("path", "sha", "words").join(frames.sections.select("path", F.char_length("content").cast("long").alias("n_chars")), "path")


def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = T.document_scan(spark, sf_dir)
    return U.rare_tokens(scan.select("path", F.explode(F.array_distinct(C.tokens(F.col("content")))).alias("token")), 4).withColumnRenamed("d", "df")


def suggest_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by words that 2 to 4 documents have twice or in their title."""
    scan = T.document_scan(spark, sf_dir)
    pairs = U.token_pairs(U.token_weights(scan))
    return pairs.groupBy("a", "b").agg(F.round(F.sum(F.round("amount", 9)), 6).alias("score"), F.count("*").alias("n_words"))


def suggest_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents in one folder or sibling folders, counted by parent and kind: (n choose 2) from counts of folders, no pair is made."""
    of = T.document_scan(spark, sf_dir).select(C.folder(F.col("path")).alias("dir"), C.folder(C.folder(F.col("path"))).alias("above"))
    per = of.groupBy("above", "dir").agg(F.count("*").alias("n"))
    return per.groupBy("above").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("same"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("sibling"))


def suggest_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = T.page_links(spark, sf_dir).select("src", "dst", F.lit("code").alias("kind"))
    return U.ref_pairs(links).groupBy("a", "b").agg(F.sum("amount").alias("score"), F.count("*").alias("n_refs"))


def suggest_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = T.document_scan(spark, sf_dir)
    found = U.suggest(scan, scan.select("path"), folders=False, n=20)
    return found.select("a", "b", F.round("score", 4).alias("score"), "dir")


def suggest_by_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files in a folder per brand, named by name and key and without any text: the best pairs by folder and rarity of name parts, found without all pairs; neighbouring keys are linked already."""
    path = F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey") % 50, F.lit("-"), F.col("p_partkey"), F.lit(".md"))
    files = T.read(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    none = F.array().cast("array<string>")
    scan = files.select("path", F.lit(0).alias("sec_no"), F.lit(1).cast("long").alias("line"), F.lit("").alias("heading"), F.lit("").alias("content"), F.lit("").alias("title"), none.alias("tags"), none.alias("aliases"))
    linked = files.select("p_partkey", F.col("path").alias("a")).join(files.select((F.col("p_partkey") - 50).alias("p_partkey"), F.col("path").alias("b")), "p_partkey").select("a", "b")
    return U.suggest(scan, files.select("path"), linked=linked, n=30).select("a", "b", F.round("score", 4).alias("score"), "dir")


def suggest_for_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals for document 0: shared words, links of the pages with the documents' ids as references, folders and names; documents of neighbouring ids are linked already."""
    scan = T.document_scan(spark, sf_dir)
    ids = scan.select("doc_id", "path")
    hrefs = T.read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.regexp_extract_all("html", F.lit(T.HREF), F.lit(1))).alias("dst"))
    links = hrefs.join(ids, "doc_id").select(F.col("path").alias("src"), "dst", F.lit("code").alias("kind"))
    linked = ids.select("doc_id", F.col("path").alias("a")).join(ids.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("b")), "doc_id").select("a", "b")
    doc = ids.where("doc_id = 0").first()
    found = U.suggest(scan, scan.select("path"), links=links, linked=linked, doc=doc["path"] if doc else "", n=20)
    return found.select("a", "b", F.round("score", 4).alias("score"), "dir", F.array_join("signals", ",").alias("signals"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_tags(T.document_scan(spark, sf_dir).select(F.explode("tags").alias("tag")))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): documents as markdown notes whose links follow from id, language and source."""
    k, lang = F.col("doc_id"), F.coalesce("lang", F.lit("none"))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), lang, F.lit("/doc-"), k, F.lit(".md"))
    wiki = F.when(k % 3 == 0, F.concat(F.lit("[[doc-"), k + 1, F.lit("|next]]"))).otherwise("")
    near = F.when(k % 5 == 0, F.concat(F.lit("[t](../"), lang, F.lit("/doc-"), k + 2, F.lit(".md#part) [out](../../../x.md)"))).otherwise("")
    image = F.concat(F.lit("!["), lang, F.lit(" "), k % 3, F.lit("](./pics/shot-"), k % 20, F.lit(".png) ![far](http://x.org/a.png)"))
    refs = F.concat(F.lit("src/A"), k % 50, F.lit(".kt, again src/A"), k % 50, F.lit(".kt, REQ-"), k % 30)
    return T.read(spark, sf_dir, "documents").select(path.alias("path"), F.concat_ws("\n", wiki, near, image, refs).alias("text"))


def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every note, with relative targets resolved."""
    return L.extract(_notes(spark, sf_dir)).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


def note_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that no link joins to another one."""
    notes = _notes(spark, sf_dir)
    files = notes.select("path", F.array().cast("array<string>").alias("aliases"))
    return L.orphans(files, L.connections(L.extract(notes), files))


def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable text of every image that the notes show."""
    notes = _notes(spark, sf_dir)
    images = L.extract(notes).where("kind = 'img'").select(F.col("dst").alias("path")).distinct()
    return R.image_texts(images, L.image_alts(notes))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as markdown with frontmatter and a heading per turn, taken apart again."""
    turn = lambda t: F.concat(F.repeat(F.lit("#"), (t["turn"] % 3 + 1).cast("int")), F.lit(" "), t["role"], F.lit("\n"), F.coalesce(t["text"], F.lit("")))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), turn)
    texts = T.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("---\ntags: [talk]\n---\n"), F.array_join(turns, "\n")).alias("text"))
    each = texts.select("conv_id", F.explode(V.markdown_sections(F.col("text"))).alias("s"))
    return each.select("conv_id", F.col("s.line").cast("long").alias("line"), F.col("s.level").cast("long").alias("level"), "s.heading", F.md5("s.content").alias("content_md5"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.page_links(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))


def ref_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shared_refs(T.page_links(spark, sf_dir).withColumn("kind", F.lit("req")), n=10)


def _page_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as files whose alias is their first link's text, so that links of other pages may name them."""
    hrefs = F.regexp_extract_all("html", F.lit(T.HREF), F.lit(1))
    files = T.read(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("path"), F.slice(F.transform(hrefs, lambda h: F.lower(C.base(h))), 1, 1).alias("aliases"))
    return T.page_links(spark, sf_dir).withColumn("kind", F.lit("wiki")), files


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.broken(*_page_graph(spark, sf_dir))


def backlink_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hubs(*_page_graph(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, files = _page_graph(spark, sf_dir)
    return L.orphans(files, L.connections(links, files))


def graph_bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from supplier 0 over the graph of parts and suppliers that occur in a line item."""
    pairs = T.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).distinct()
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    start = both.where("a = 's0'").select(F.col("a").alias("node")).distinct()
    return L.distances(both, start).select("node", "hops")


def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest way between two customers over customers, their orders' parts and the parts' suppliers; of several the first by names."""
    lines = T.read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"))
    made = lines.join(T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("c")), "l_orderkey")
    one = made.select(F.col("c").alias("a"), F.col("p").alias("b")).unionByName(lines.select(F.col("p").alias("a"), F.col("s").alias("b"))).where("a is not null and b is not null").distinct()
    both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    ends = T.read(spark, sf_dir, "orders").agg(F.min("o_custkey").alias("a"), F.max("o_custkey").alias("b")).first()
    chain = L.shortest_path(both, f"c{ends['a']}", f"c{ends['b']}")
    return spark.createDataFrame(list(enumerate(chain)), "step long, node string")


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events").select(F.col("event_id").alias("line"), "user_id", "event_type", "value")


def log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.last_wins(_event_log(spark, sf_dir), "user_id", "event_type")


def prune_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one kind only the last record of each user stays; other kinds are kept as they are."""
    return G.pruned(_event_log(spark, sf_dir).withColumnRenamed("event_type", "type"), "click", "user_id").withColumnRenamed("type", "event_type")


def note_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notes whose sources are the documents that their turns number; every seventh pin is out of date."""
    files = T.document_scan(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.md5("content").alias("sha"))
    pins = T.read(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 3 + F.col("turn")).alias("d"))
    docs = files.select(F.col("path").cast("long").alias("d"), "sha")
    sources = pins.join(docs, "d", "left").select("conv_id", F.struct(F.col("d").cast("string").alias("path"), F.when(F.col("d") % 7 == 0, "old").otherwise(F.coalesce("sha", F.lit("none"))).alias("sha")).alias("s"))
    notes = sources.groupBy("conv_id").agg(F.collect_list("s").alias("sources"))
    return G.note_freshness(notes, files, "conv_id")


def edge_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is joined to the next; pins of ids divisible by 5 are out of date, and the last document's partner is missing."""
    files = T.document_scan(spark, sf_dir).select(F.col("doc_id").alias("path"), F.md5("content").alias("sha"))
    pin = F.when(F.col("path") % 5 == 0, "old").otherwise(F.col("sha"))
    a = files.select(F.col("path").alias("src"), (F.col("path") + 1).alias("dst"), pin.alias("src_sha"))
    edges = a.join(files.select(F.col("path").alias("dst"), pin.alias("dst_sha")), "dst", "left").select("src", "dst", "src_sha", F.coalesce("dst_sha", F.lit("gone")).alias("dst_sha"))
    return G.edge_freshness(edges, files).select("src", "dst", "fresh")


def embed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as pinned vectors: those of low quality were pinned to an older text."""
    files = T.document_scan(spark, sf_dir).select(F.col("doc_id").alias("path"), F.md5("content").alias("sha"))
    pins = T.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), "quality").join(files, "path").select("path", F.lit(1).alias("line"), F.when(F.col("quality") == 0, "old").otherwise(F.col("sha")).alias("sha"))
    return G.embed_status(pins, files).groupBy("status").agg(F.count("*").alias("n"))


def doctor_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each kind in a log of event properties: known types, unknown ones, lines that are no JSON."""
    log = T.read(spark, sf_dir, "events").select(F.concat(F.lit('{"type":"'), "event_type", F.lit('","p":'), "props", F.when(F.col("event_id") % 11 == 0, "").otherwise("}")).alias("raw"))
    return G.counters(G.typed(log), known=("click", "view", "purchase", "signup", "error"))


def update_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots: the older one lacks every 10th document, has another text for every 7th and ones that are gone now."""
    docs = T.read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sha"))
    before = docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("sha")).alias("sha"))
    now = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), "sha")
    return R.changes(before, now)


def import_relation_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as inferred links between parts and suppliers; the relation is the ship mode's flag."""
    li = T.read(spark, sf_dir, "lineitem")
    nodes = li.select(F.concat(F.lit("s"), "l_suppkey").alias("id")).unionByName(li.select(F.concat(F.lit("p"), "l_partkey").alias("id"))).distinct().select("id", F.col("id").alias("label"), F.concat("id", F.lit(".md")).alias("path"))
    links = li.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.when(F.col("l_linestatus") == "O", "INFERRED").otherwise("EXTRACTED").alias("confidence"), F.col("l_returnflag").alias("relation"))
    return R.imported_edges(nodes, links)


def ext_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "[?#].*$", "")
    return R.coverage(T.read(spark, sf_dir, "pages").select(bare.alias("path")))


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of file-name parts."""
    parts = T.read(spark, sf_dir, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".md")).alias("path"))
    return parts.select(F.explode(C.name_tokens(F.col("path"))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem, its words and parts, link name, folder and type of every page's address as a path."""
    path = C.posix(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", ""))
    pages = T.read(spark, sf_dir, "pages").select("page_id", path.alias("p"))
    own = F.col("p")
    return pages.select("page_id", C.stem(own).alias("stem"), C.stem_words(C.stem(own)).alias("words"), F.array_join(F.array_sort(C.name_tokens(own)), ",").alias("parts"), C.link_stem(own).alias("link"), C.folder(own).alias("dir"), C.extension(own).alias("ext"))


def path_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each document's folder is to that of the next document."""
    scan = T.document_scan(spark, sf_dir).select("doc_id", "path")
    both = scan.join(scan.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("other")), "doc_id")
    return both.groupBy(C.proximity(F.col("path"), F.col("other")).alias("dir")).agg(F.count("*").alias("n"))


def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language that the patterns "src1", "*/de/*" and "src2/en" leave."""
    scan = T.document_scan(spark, sf_dir)
    return scan.where(~ignored(F.col("path"), ["src1", "*/de/*", "src2/en", "# comment"])).groupBy(F.element_at("tags", 1).alias("lang")).agg(F.count("*").alias("n"))


def capped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a term and its variants in each document, five at most."""
    every = variants("über")
    count = sum((C.occurrences(F.col("c"), v) for v in every), F.lit(0))
    return T.document_scan(spark, sf_dir).select("path", F.lower("content").alias("c")).select("path", F.least(count, F.lit(5)).cast("long").alias("n")).where("n > 0")


def notes_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest conversations, read as notes of all their turns, that hold all terms literally."""
    turns = T.read(spark, sf_dir, "conversations")
    texts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " ").alias("insight"))
    found = G.matched_notes(texts.select(F.col("conv_id").alias("line"), F.lit("").alias("question"), "insight"), ["the", "en"])
    return found.select(F.col("line").alias("conv_id"), F.char_length("insight").cast("long").alias("n_chars"))


def notes_surfaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest fresh conversations, read as notes, that hold all terms; the sources of each are the documents that its turns number, and every seventh pin is out of date."""
    turns = T.read(spark, sf_dir, "conversations")
    files = T.document_scan(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.md5("content").alias("sha"))
    pins = turns.select("conv_id", "turn", "text", (F.col("conv_id") * 3 + F.col("turn")).cast("string").alias("path")).join(files, "path", "left")
    source = F.struct("path", F.when(F.col("path").cast("long") % 7 == 0, "old").otherwise(F.coalesce("sha", F.lit("none"))).alias("sha"))
    notes = pins.groupBy(F.col("conv_id").alias("line")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " ").alias("insight"), F.collect_list(source).alias("sources"))
    found = G.surfaced(notes.withColumn("question", F.lit("")), files, ["the", "en"])
    return found.select(F.col("line").alias("conv_id"), F.char_length("insight").cast("long").alias("n_chars"))


def log_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of vectors and edges pinned to documents, after every third text was rewritten and document 5 moved: only paths and fresh pins change."""
    docs = T.read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sha"))
    name = F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md"))
    pin = F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("sha"))
    embed = F.concat(F.lit('{"type":"embed", "dim":3,"path": "'), name, F.lit('","sha":"'), pin, F.lit('","vec":[1,2.50]}'))
    edge = F.concat(F.lit('{"weight":0.25,"type":"edge","src":"'), name, F.lit('","dst":"z.md","rationale":"a \\"src\\": \\"d/5\\"","src_sha":"'), pin, F.lit('","dst_sha":"zz","ok":true}'))
    log = docs.select(F.concat(F.lit("a"), "doc_id").alias("line"), embed.alias("raw")).unionByName(docs.select(F.concat(F.lit("b"), "doc_id").alias("line"), edge.alias("raw")))
    old, new = "d/000000005.md", "new/5.md"
    rewritten = docs.where("doc_id % 3 = 0 or doc_id = 5").select(name.alias("was"), F.when(F.col("doc_id") == 5, new).otherwise(name).alias("path"), F.col("sha").alias("old_sha"), F.reverse("sha").alias("new_sha"))
    return G.carried(G.typed(log), rewritten, old, new)


def plain_text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document as plain text; a document without any text (none, empty or blank) has one row too, so that no document is left out."""
    text = F.col("content")
    heading = F.substr(C.trim_spaces(F.substring_index(text, "\n", 1)), F.lit(1), F.lit(60))
    alone = F.array(F.struct(F.lit(1).alias("line"), F.lit(1).alias("level"), heading.alias("heading"), F.btrim(text, F.lit("\n")).alias("content")))
    sections = C.let(plain_sections(text), lambda s: F.when(F.size(s) > 0, s).otherwise(alone))
    each = T.document_scan(spark, sf_dir).select("path", F.posexplode(sections).alias("sec_no", "s"))
    return each.select("path", F.col("sec_no").cast("long").alias("sec_no"), F.col("s.line").cast("long").alias("line"), F.col("s.heading").alias("heading"), F.char_length("s.content").cast("long").alias("n_chars"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every page by its headings, with the source line of each."""
    each = T.read(spark, sf_dir, "pages").select("page_id", H.body(F.coalesce("html", F.lit(""))).alias("page")).select("page_id", F.explode(H.sections(F.col("page"))).alias("s"))
    return each.select("page_id", F.col("s.line").cast("long").alias("line"), F.col("s.level").cast("long").alias("level"), "s.heading", F.md5("s.content").alias("content_md5"))


def fuzzy_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the name of every part whose key 100 divides, with its third letter gone and its key after it, the most similar of all parts' names."""
    part = T.read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", F.lower("p_name"), "p_partkey").alias("name"))
    labels = part.where("p_partkey % 100 = 0").select(F.concat(F.substr("name", F.lit(1), F.lit(2)), F.substr("name", F.lit(4))).alias("label"))
    return E.close_names(labels, part.select("name")).select("label", "candidate", F.round("ratio", 4).alias("ratio"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their values per day and type, by the streaming aggregation run over the table."""
    found = event_counts(T.read(spark, sf_dir, "events"))
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


QUERIES = {f.__name__: f for f in (
    vault_files, vault_totals, directory_summary, term_df_idf, search_and, search_or_fallback, search_long_query, search_phrase, search_fields, search_field_title, search_rollup_sections,
    search_conversations, search_conversation_phrase, search_kept_index, kept_index_update, search_fused_rrf, search_hybrid, semsearch_topk, semsearch_grouped, evidence_lines, snippet_blocks, weak_signal, token_df, suggest_shared_terms, suggest_directory, suggest_refs,
    suggest_ranked, suggest_by_names, suggest_for_document, tag_counts, link_kinds, note_orphans, image_texts, markdown_sections, page_titles, page_links, ref_hubs, broken_links, backlink_hubs, orphans, graph_bfs_hops, graph_shortest_path, log_compact, prune_log, note_freshness, edge_freshness, embed_status,
    doctor_counters, update_diff, import_relation_mode, ext_coverage, name_parts, path_functions, path_pairs, ignore_rules, capped_counts, notes_matched, notes_surfaced, log_carried, plain_text_sections, page_sections,
    fuzzy_link_targets, event_windows,
)}

"""Ranked search: sections are scored, rolled up to documents and gated; several phrasings and vectors are fused by rank."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import TYPES, cosine, extension, holds_any, occurrences
from ..functions.tables import cut, global_rank
from ..functions.terms import COVER, FIELDS, RARE, RRF_K, WEAK_SCORE, Query, least_variants, parse, variants

#: Columns of the scan that search reads: one row per section with its document's metadata, in lower case beside the original.
SCAN = ("path", "sec_no", "line", "heading", "content", "title", "tags", "aliases")


@dataclass(frozen=True)
class Statistics:
    """Documents in all, and with each term."""

    total: int
    df: dict[str, int]

    def idf(self, term: str) -> float:
        n = max(self.total, 1)
        return math.log(n / self.df[term]) if self.df.get(term) else math.log(n)


def _lower(scan: DataFrame) -> DataFrame:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return scan.select("path", "sec_no", "line", "heading", low("title").alias("t"), low("path").alias("p"), low("heading").alias("h"), low("content").alias("c"), "tags", F.transform("aliases", F.lower).alias("aliases"))


def _field(field: str, term: str) -> Column:
    t = F.lit(term)
    return {
        "title": F.contains("t", t) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(a, t)),
        "path": F.contains("p", t),
        "heading": F.contains("h", t),
        "tag": F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda a: F.contains(a, t)),
        "type": extension(F.col("path")).isin(*TYPES.get(term, ())),
    }[field]


@dataclass(frozen=True)
class Hits:
    """What one pass over all texts leaves for any number of queries: a row per section that matters, without its text, written.

    For term k: ``h`` (found in any field), ``p`` (points before the idf), ``w`` (found, aliases aside) or, of a phrase, ``s`` and ``g`` (its state in the
    section and in the document's head); for query q ``f`` (all its fields hold).
    """

    table: DataFrame
    queries: tuple[Query, ...]
    terms: tuple[str, ...]
    total: int


def _phrase_state(text: Column, phrase: str) -> Column:
    """Whether a text holds a phrase, and as many characters of its two ends as a hit across them may need."""
    reach = F.lit(len(phrase) - 1)
    return F.struct(F.contains(text, F.lit(phrase)).alias("found"), F.left(text, reach).alias("first"), F.right(text, reach).alias("last"))


def _phrase_found(head: Column, sections: Column, phrase: str) -> Column:
    """Whether the phrase occurs in a head and sections (in order) joined by blanks, from their states."""
    reach = len(phrase) - 1

    def step(carry: Column, x: Column) -> Column:
        s = x["s"]
        found = carry["found"] | s["found"] | F.contains(F.concat(carry["last"], F.lit(" "), s["first"]), F.lit(phrase))
        last = F.when(F.char_length(s["last"]) >= reach, s["last"]).otherwise(F.right(F.concat(carry["last"], F.lit(" "), s["last"]), F.lit(reach)))
        return F.struct(found.alias("found"), last.alias("last"))

    return F.aggregate(sections, F.struct(head["found"].alias("found"), head["last"].alias("last")), step, lambda x: x["found"])


def section_hits(scan: DataFrame, queries: list[Query], total: int | None = None) -> Hits:
    """The only pass over the texts that a search makes, however many phrasings it has. ``total`` is the number of documents, if ``scan`` is only part of them."""
    terms = tuple(dict.fromkeys(t for q in queries for t in q.plain))
    low, columns, kept = _lower(scan), [], F.lit(False)
    for k, term in enumerate(terms):
        least, every = least_variants(term), variants(term)
        named = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: holds_any(a, least))
        titled, in_path, in_head, in_body = (holds_any(F.col(c), least) for c in "tphc")
        count = F.when(in_body, F.least(reduce(lambda a, b: a + b, (occurrences(F.col("c"), v) for v in every)), F.lit(5))).otherwise(0)
        columns += [(titled | named | in_path | in_head | in_body).alias(f"h{k}"), (8 * (titled | named).cast("int") + 6 * in_path.cast("int") + 5 * in_head.cast("int") + count).cast("double").alias(f"p{k}")]
        kept = kept | F.col(f"h{k}")
        if " " in term:
            columns += [_phrase_state(F.concat_ws(" ", "h", "c"), term).alias(f"s{k}"), _phrase_state(F.concat_ws(" ", "t", "p"), term).alias(f"g{k}")]
            kept = F.lit(True)  # a phrase may run over any section's ends
        else:
            columns.append((titled | in_path | in_head | in_body).alias(f"w{k}"))
    for k, query in enumerate(queries):
        columns.append(reduce(lambda a, b: a & b, (_field(f, t) for f, t in query.fields), F.lit(True)).alias(f"f{k}"))
        if not query.plain:
            kept = kept | F.col(f"f{k}")
    if total is None:
        total = scan.agg(F.count_distinct("path")).first()[0]
    each = low.select("path", "sec_no", "line", "heading", *columns)
    # not a filter, which the optimizer would move below, where it looks for every term once more
    return Hits(cut(each.select(F.inline(F.when(kept, F.array(F.struct(*each.columns)))))), tuple(queries), terms, total)


def statistics(hits: Hits) -> Statistics:
    """Document frequencies of all terms. Words are looked for section by section; a phrase in the document's fields joined by blanks, across which it may run: the states of the sections are put together in order."""
    if not hits.terms:
        return Statistics(hits.total, {})
    phrases = [k for k, t in enumerate(hits.terms) if " " in t]
    each = [F.sort_array(F.collect_list(F.struct("sec_no", F.col(f"s{k}").alias("s")))).alias(f"s{k}") for k in phrases] + [F.first(f"g{k}").alias(f"g{k}") for k in phrases]
    docs = hits.table.groupBy("path").agg(*(F.max(f"w{k}").alias(f"w{k}") for k in range(len(hits.terms)) if k not in phrases), *each)
    found = [_phrase_found(F.col(f"g{k}"), F.col(f"s{k}"), t) if k in phrases else F.col(f"w{k}") for k, t in enumerate(hits.terms)]
    row = docs.agg(*(F.sum(x.cast("int")) for x in found)).first()
    return Statistics(hits.total, {t: row[k] or 0 for k, t in enumerate(hits.terms)})


@dataclass(frozen=True)
class Ranked:
    """All results of one query (unordered, ungated ones gone) and its flags."""

    query: Query
    results: DataFrame
    partial: bool
    stats: Statistics

    def top(self, n: int) -> DataFrame:
        return self.results.orderBy(*ranking()).limit(n)

    def flags(self) -> DataFrame:
        """(n_results, partial, weak), one row. Weak: nothing found, a term that occurs nowhere, only a relaxed match, or a low best score."""
        sure = any(not self.stats.df.get(t) for t in self.query.plain) or (self.partial and not self.query.long)
        found = self.results.agg(F.count("*").alias("n_results"), F.max("score").alias("best"))
        return found.select("n_results", F.lit(self.partial).alias("partial"), (F.lit(sure) | F.coalesce(F.col("best") < WEAK_SCORE, F.lit(True))).alias("weak"))

    def weak(self) -> bool:
        """Whether another phrasing is called for."""
        return self.flags().first()["weak"]


def ranking() -> tuple[Column, ...]:
    """Best first; equal ones by path."""
    return F.col("score").desc(), F.col("matched_idf").desc(), F.col("nmatched").desc(), F.col("path")


def _documents(hits: Hits, stats: Statistics) -> DataFrame:
    """A row per document with, for query q, ``n`` (terms found), ``i`` (their idf), ``r`` (the rarest is found) and ``b``: score, line and heading of its best section; null if no section has the query's fields."""
    total, aggs, outs = lambda xs, zero: reduce(lambda a, b: a + b, xs, F.lit(zero)), [], []
    for q, query in enumerate(hits.queries):
        places, idfs = [hits.terms.index(t) for t in query.plain], [stats.idf(t) for t in query.plain]
        score = total([F.when(F.col(f"h{k}"), F.lit(1 + i) * F.col(f"p{k}")).otherwise(0.0) for k, i in zip(places, idfs)], float(sum(FIELDS[f] for f, _ in query.fields)))
        fits = F.col(f"f{q}")
        aggs += [F.max(fits & F.col(f"h{k}")).alias(f"m{q}_{k}") for k in places]
        aggs.append(F.max_by(F.when(fits, F.struct(score.alias("score"), "line", "heading")), F.when(fits, F.struct(score.alias("score"), (-F.col("sec_no")).alias("s")))).alias(f"b{q}"))
        top, found = max(idfs, default=0.0), [F.col(f"m{q}_{k}") for k in places]
        rare = reduce(lambda a, b: a | b, (h for h, i in zip(found, idfs) if top > 0 and i >= top * RARE), F.lit(False))
        outs += [total([h.cast("long") for h in found], 0).cast("long").alias(f"n{q}"), total([F.when(h, F.lit(i)).otherwise(0.0) for h, i in zip(found, idfs)], 0.0).alias(f"i{q}"), rare.alias(f"r{q}"), F.col(f"b{q}")]
    return hits.table.groupBy("path").agg(*aggs).select("path", *outs)


def rank_all(scan: DataFrame, texts: list[str], total: int | None = None) -> list[Ranked]:
    """The results of each query, all from one pass over the texts.

    Every plain term must occur in a document, unless the query is long; if no document has all, half of them suffice. Long queries ask for 30 % of the idf mass, or for the rarest term.
    """
    hits = section_hits(scan, [parse(x) for x in texts], total)
    stats = statistics(hits)
    docs = cut(_documents(hits, stats))
    whole = [(F.col(f"n{q}") >= len(query.plain)) & F.col(f"b{q}").isNotNull() for q, query in enumerate(hits.queries)]
    any_whole = docs.agg(*(F.max(w) for w in whole)).first()
    out = []
    for q, query in enumerate(hits.queries):
        need, partial = len(query.plain), query.long or len(query.plain) >= 2 and not any_whole[q]
        if query.long:
            gate = (F.col(f"n{q}") > 0) & ((F.col(f"i{q}") >= COVER * sum(stats.idf(t) for t in query.plain)) | F.col(f"r{q}"))
        else:
            gate = (F.col(f"n{q}") > 0) & (F.col(f"n{q}") * 2 >= need) if partial else whole[q]
        best = F.col(f"b{q}")
        found = docs.where(gate & best.isNotNull()).select("path", best["line"].alias("line"), best["heading"].alias("heading"), F.col(f"n{q}").alias("nmatched"), F.col(f"i{q}").alias("matched_idf"), best["score"].alias("score"))
        out.append(Ranked(query, found, partial, stats))
    return out


def rank(scan: DataFrame, text: str, total: int | None = None) -> Ranked:
    return rank_all(scan, [text], total)[0]


def semantic_hits(embeds: DataFrame, vector: list[float], n: int) -> DataFrame:
    """(path, cosine) of the n nearest fresh vectors of the same dimension; ties go to the greater path."""
    near = embeds.select("path", cosine(F.col("vec"), F.array(*(F.lit(float(x)) for x in vector))).alias("cosine")).where("cosine is not null")
    return near.orderBy(F.desc("cosine"), F.desc("path")).limit(n)


def first_sections(scan: DataFrame) -> DataFrame:
    return scan.groupBy("path").agg(F.min_by(F.struct("line", "heading"), F.struct("line", "sec_no")).alias("s")).select("path", "s.line", "s.heading")


def hybrid(scan: DataFrame, text: str, embeds: DataFrame, vector: list[float], n: int = 8, matched: Ranked | None = None) -> DataFrame:
    """Keyword results blended with vector hits: score * (1 + cosine); documents found by vector alone come in with 10 * cosine."""
    near = cut(semantic_hits(embeds, vector, max(n, 20)))  # a table of known size, which Spark broadcasts if it is small
    found = (matched or rank(scan, text)).results.join(near, "path", "left")
    alone = near.join(found.select("path"), "path", "left_anti")
    extra = first_sections(scan.join(alone.select("path"), "path", "left_semi")).join(alone, "path")
    extra = extra.select("path", "line", "heading", F.lit(0).cast("long").alias("nmatched"), F.lit(0.0).alias("matched_idf"), (F.lit(float(WEAK_SCORE)) * F.col("cosine")).alias("score"), "cosine")
    both = found.unionByName(extra).withColumn("blend", F.col("score") * (1 + F.coalesce("cosine", F.lit(0.0))))
    return both.orderBy(F.desc("blend"), F.desc("matched_idf"), F.desc("nmatched"), "path").limit(n)


def fused(scan: DataFrame, texts: list[str], n: int = 8, near: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of several phrasings (and, if given, of vector hits): each list votes 1 / (60 + rank). Line and heading are those of the best rank by words (null where only vectors found a document).

    The texts are read once for all phrasings, and all lists are ranked in one sort.
    """
    return fused_ranks(rank_all(scan, texts, total), n, near)


def fused_ranks(ranked: list[Ranked], n: int, near: DataFrame | None = None) -> DataFrame:
    """``fused`` of results that are there already."""
    lists = cut(reduce(DataFrame.unionByName, (r.results.withColumn("q", F.lit(q)) for q, r in enumerate(ranked))))
    sizes = {r["q"]: r["n"] for r in lists.groupBy("q").agg(F.count("*").alias("n")).collect()}
    before = F.array(*(F.lit(sum(sizes.get(j, 0) for j in range(q))).cast("long") for q in range(len(ranked))))
    votes = global_rank(lists, "rank", F.col("q"), *ranking()).select("path", (F.col("rank") - F.get(before, F.col("q"))).alias("rank"), "q", "line", "heading")
    if near is not None:
        place = (F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("heading"))
        votes = votes.unionByName(near.withColumn("rank", F.row_number().over(W.orderBy(F.desc("cosine"), F.desc("path"))).cast("long") - 1).select("path", "rank", F.lit(len(ranked)).alias("q"), *place))
    summed = votes.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("q", "rank"))).alias("v"), F.count("*").alias("sources"), F.min(F.struct("rank", "q")).alias("best"), F.min(F.when(F.col("line").isNotNull(), F.struct("rank", "q", "line", "heading"))).alias("shown"))
    rrf = F.aggregate("v", F.lit(0.0), lambda s, x: s + 1.0 / (RRF_K + x["rank"]))
    return summed.select("path", rrf.alias("rrf"), "sources", F.col("best.rank").alias("best_rank"), F.col("best.q").cast("long").alias("best_query"), "shown.line", "shown.heading").orderBy(F.desc("rrf"), "best_rank", "best_query", "path").limit(n)


def evidence(scan: DataFrame, top: DataFrame, query: Query, stats: Statistics, k: int = 5) -> DataFrame:
    """(path, ord, text, idf): the k best lines of each result of ``top`` (path, line). Lines are ranked by the idf of the terms they hold, those of the displayed section first, then in order; equal lines count once."""
    chosen = top.select(F.col("path").alias("r"), F.col("line").alias("shown"))
    lines = _lines(scan.join(chosen, F.col("path") == F.col("r")))
    low = F.lower("text")
    mass = reduce(lambda a, b: a + b, (F.when(holds_any(low, variants(t)), F.lit(stats.idf(t))).otherwise(0.0) for t in query.plain), F.lit(0.0))
    any_hit = reduce(lambda a, b: a | b, (holds_any(low, variants(t)) for t in query.plain), F.lit(False))
    hits = lines.where(any_hit & (F.trim("text") != "")).select("path", "ord", F.trim("text").alias("text"), mass.alias("idf"), (F.col("line") == F.col("shown")).alias("own"))
    order = (F.desc("idf"), F.desc("own"), F.col("ord"))
    once = hits.withColumn("c", F.row_number().over(W.partitionBy("path", "text").orderBy(*order))).where("c = 1")
    return once.withColumn("place", F.row_number().over(W.partitionBy("path").orderBy(*order))).where(F.col("place") <= k).select("path", "ord", "text", "idf", F.col("place").cast("long").alias("place"))


def matched(scan: DataFrame, top: DataFrame, terms: tuple[str, ...], stats: Statistics, compact: bool = False, blocks: int = 3) -> DataFrame:
    """(path, matched): of the results ``top`` (path, line, place) what to show: the five best lines, best first, or for the first ``blocks`` the eight best with those around them, in order; one line if ``compact``. No rows without terms."""
    if not terms:
        return top.select("path", F.array().cast("array<string>").alias("matched"))
    part = scan.join(top.select("path"), "path", "left_semi")
    picks = cut(evidence(part, top.select("path", "line"), Query("", (), terms), stats, 1 if compact else 8).join(top.select("path", F.col("place").alias("at")), "path"))
    listed = lambda df, order: df.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias("matched"))
    if compact:
        return listed(picks, "place")
    wide = snippets(part, picks.where(F.col("at") <= blocks).select("path", "ord"))
    return listed(picks.where((F.col("at") > blocks) & (F.col("place") <= 5)), "place").unionByName(listed(wide, "first"))


def _lines(sections: DataFrame) -> DataFrame:
    """Lines of documents with their place in the document, over all of its sections."""
    per = sections.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "content"))).alias("s"), F.max("shown").alias("shown"))
    lines = F.flatten(F.transform("s", lambda x: F.transform(F.split(x["content"], "\n"), lambda t: F.struct(x["line"].alias("line"), t.alias("text")))))
    return per.select("path", "shown", F.posexplode(lines).alias("ord", "l")).select("path", "shown", "l.line", "l.text", F.col("ord").cast("long"))


def snippets(scan: DataFrame, picks: DataFrame, around: int = 2) -> DataFrame:
    """(path, first, text): picked lines (path, ord) with those around them, merged into blocks of consecutive lines."""
    near = picks.select("path", F.explode(F.sequence(F.col("ord") - around, F.col("ord") + around)).alias("ord")).distinct()
    lines = _lines(scan.withColumn("shown", F.lit(0)).join(picks.select("path"), "path", "left_semi"))
    kept = lines.join(near, ["path", "ord"]).select("path", "ord", "text")
    island = kept.withColumn("g", F.col("ord") - F.row_number().over(W.partitionBy("path").orderBy("ord")))
    blocks = island.groupBy("path", "g").agg(F.min("ord").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.rtrim("text").alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    return blocks.select("path", "first", F.btrim("text", F.lit("\n")).alias("text")).where("text <> ''")

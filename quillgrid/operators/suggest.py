"""Missing links: documents that share rare words, references or folders, scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import folder, name_tokens, proximity, stem, tokens
from ..functions.tables import cut

SAME, SIBLING, NAME_WEIGHT = 4.0, 2.0, 1.5
REF_POINTS = {"req": 3.0, "code": 2.0}


def token_weights(scan: DataFrame) -> DataFrame:
    """(path, token, weight): 2 for words of title or heading, 1 for words that a section has twice."""
    strong = scan.select("path", F.explode(F.array_distinct(F.concat(tokens(F.coalesce("title", F.lit(""))), tokens(F.col("heading"))))).alias("token"), F.lit(2).alias("weight"))
    body = scan.select("path", "sec_no", F.explode(tokens(F.col("content"))).alias("token")).groupBy("path", "sec_no", "token").agg(F.count("*").alias("n"))
    weak = body.where("n >= 2").select("path", "token", F.lit(1).alias("weight"))
    return strong.unionByName(weak).groupBy("path", "token").agg(F.max("weight").alias("weight"))


def rare_tokens(weights: DataFrame, max_df: int, df: DataFrame | None = None) -> DataFrame:
    """(token, d) of words that 2 to ``max_df`` documents have; ``df`` (token, d) are their frequencies, if they are kept."""
    df = weights.groupBy("token").agg(F.count("*").alias("d")) if df is None else df
    return df.where(F.col("d").between(2, max_df))


def token_pairs(weights: DataFrame, max_df: int = 4, df: DataFrame | None = None) -> DataFrame:
    """(a, b, amount, signal) for documents that share a word which 2 to ``max_df`` documents have; the cap bounds a word to so many pairs."""
    if df is None:
        weights = cut(weights)  # texts are taken apart once
    of = cut(weights.join(rare_tokens(weights, max_df, df), "token"))
    left, right = of.select("token", F.col("path").alias("a"), F.col("weight").alias("wa"), "d"), of.select("token", F.col("path").alias("b"), F.col("weight").alias("wb"))
    return left.join(right, "token").where("a < b").select("a", "b", (F.col("wa") * F.col("wb") / F.col("d")).alias("amount"), F.col("token").alias("signal"))


def ref_pairs(links: DataFrame, most: int = 6) -> DataFrame:
    """The same for requirement and code references that 2 to ``most`` documents make."""
    refs = links.where("kind in ('req', 'code')").select(F.col("src").alias("path"), "dst", "kind").distinct()
    rare = refs.groupBy("dst", "kind").agg(F.count("*").alias("d")).where(F.col("d").between(2, most)).drop("d")
    of = refs.join(rare, ["dst", "kind"])
    points = F.when(F.col("kind") == "req", REF_POINTS["req"]).otherwise(REF_POINTS["code"])
    both = of.select("dst", "kind", F.col("path").alias("a")).join(of.select("dst", "kind", F.col("path").alias("b")), ["dst", "kind"])
    return both.where("a < b").select("a", "b", points.alias("amount"), F.col("dst").alias("signal"))


def folder_pairs(files: DataFrame, doc: str | None = None) -> DataFrame:
    """(a, b) in one folder or in folders of one parent. With ``doc`` only its own pairs are made; all of them grow with the square of a folder's files, as the rule says, so callers aggregate them."""
    of = files.where("not lower(path) like '%.pdf'").select("path", folder(folder(F.col("path"))).alias("above"))
    left = of if doc is None else of.where(F.col("path") == doc)
    both = left.select("above", F.col("path").alias("x")).join(of.select("above", F.col("path").alias("y")), "above").where("x < y" if doc is None else "x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where(proximity(F.col("a"), F.col("b")) != "far")


def suggest(
    scan: DataFrame, files: DataFrame, *, links: DataFrame | None = None, linked: DataFrame | None = None, doc: str | None = None, max_df: int = 4, folders: bool = True, n: int | None = 10,
    words: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(a, b, score, dir, signals): pairs that look related and are not ``linked`` (a, b) yet, best first; ``n=None`` gives all.

    Pairs that only share a folder are all made for one ``doc``, or where all are asked for; for the n best of all, ``folder_best`` makes the few that can be among them.
    ``words`` are kept weights (path, token, weight) and frequencies (token, d) of the documents of ``scan``, which then is not read.
    """
    weights, df = (token_weights(scan), None) if words is None else words
    if doc is not None:
        weights = _shared_with(weights, doc, words is not None)
    pairs = token_pairs(weights, max_df, df)
    if links is not None:
        pairs = pairs.unionByName(ref_pairs(links))
    if folders and (doc is not None or n is None):
        pairs = pairs.unionByName(folder_pairs(files, doc).select("a", "b", F.lit(0.0).alias("amount"), F.lit(None).cast("string").alias("signal")))
    if doc is not None:
        pairs = pairs.where((F.col("a") == doc) | (F.col("b") == doc))
    known = None if linked is None else linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if known is not None:
        pairs = pairs.join(known, ["a", "b"], "left_anti")
    summed = cut(pairs.groupBy("a", "b").agg(F.sum(F.round("amount", 9)).alias("base"), F.slice(F.array_sort(F.collect_set("signal")), 1, 8).alias("signals")))
    ranked = scored_pairs(files, summed)
    if folders and doc is None and n is not None:
        taken = summed.select("a", "b") if known is None else summed.select("a", "b").unionByName(known)
        return folder_best(files, cut(ranked), cut(taken), n)
    ranked = ranked.orderBy(*_best())
    return ranked if n is None else ranked.limit(n)


def _best() -> tuple:
    return F.round("score", 6).desc(), F.col("a"), F.col("b")


def _shared_with(weights: DataFrame, doc: str, kept: bool = False) -> DataFrame:
    """The weights of the words that ``doc`` has; no others can join it to a document."""
    weights = weights if kept else cut(weights)
    return weights.join(weights.where(F.col("path") == doc).select("token"), "token", "left_semi")


def scored_pairs(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, score, dir, signals) of pairs (a, b, base, signals): their base, a bonus for near folders and the rarity of shared name parts."""
    out = pairs.join(shared_names(files, pairs.select("a", "b")), ["a", "b"], "left").withColumn("dir", proximity(F.col("a"), F.col("b")))
    bonus = F.when(F.col("dir") == "same", SAME).when(F.col("dir") == "sibling", SIBLING).otherwise(0.0)
    return out.select("a", "b", (F.col("base") + bonus + NAME_WEIGHT * F.coalesce("names", F.lit(0.0))).alias("score"), "dir", "signals")


def folder_best(files: DataFrame, ranked: DataFrame, taken: DataFrame, n: int) -> DataFrame:
    """The n best of the pairs ``ranked`` (a, b, score, dir, signals) and of all pairs in one folder or sibling folders that are not ``taken`` (a, b), without making all of these.

    Such a pair scores its folder's bonus and what name parts both have. Files of one folder with the same shared parts are a class and pair alike with any other, so that only the first
    by path of each class count: n, and as many as any file has taken pairs. The heaviest classes' own pairs set the bar. From there on classes are paired, not files, by the rarest part that
    both have, rare parts first: a class takes part with those of its parts that, with its more frequent ones, can still reach the n-th best, which rises on the way; where none is left, all is found.
    Pairs that share no part score the bonus alone, and are made of the first files by path.
    """
    total = max(files.count(), 1)
    shared = lambda bag: F.aggregate(bag, F.lit(0.0), lambda s, p: s + F.ln(F.lit(float(total)) / p["d"]))
    of = files.where("not lower(path) like '%.pdf'").select("path", folder(F.col("path")).alias("dir"), folder(folder(F.col("path"))).alias("above"))
    parts = files.select("path", F.explode(name_tokens(F.col("path"))).alias("part"))
    df = cut(parts.groupBy("part").agg(F.count("*").alias("d")).where(F.col("d").between(2, total - 1)))
    bags = cut(of.join(parts.join(df, "part").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("d", "part"))).alias("bag")), "path", "left").withColumn("bag", F.coalesce("bag", F.array())))
    degrees = taken.select(F.col("a").alias("path")).unionByName(taken.select(F.col("b").alias("path"))).groupBy("path").agg(F.count("*").alias("n"))
    first = n + 1 + (degrees.agg(F.max("n")).first()[0] or 0)
    head = lambda rows, *key: rows.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("path"))).where(F.col("r") <= first).drop("r")
    alike = W.partitionBy("dir", "key")
    kept = cut(head(bags.withColumn("key", F.to_json("bag")), "dir", "key").withColumns({"class": F.min("path").over(alike), "size": F.count("*").over(alike)}).drop("key"))
    classes = cut(kept.where("path = class").withColumn("weight", shared(F.col("bag"))).drop("path"))

    def pair_score(x: str, y: str) -> tuple:
        """(score, dir) of near pairs by their folders and bags."""
        same = F.col(f"{x}.dir") == F.col(f"{y}.dir")
        return F.when(same, SAME).otherwise(SIBLING) + NAME_WEIGHT * shared(F.array_intersect(f"{x}.bag", f"{y}.bag")), F.when(same, "same").otherwise("sibling")

    def both(rows: DataFrame, *key: str) -> DataFrame:
        """All pairs of files with the same key, scored."""
        score, near = pair_score("x", "y")
        pairs = rows.alias("x").join(rows.alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key] + [F.col("x.path") < F.col("y.path")])
        return pairs.select(F.col("x.path").alias("a"), F.col("y.path").alias("b"), score.alias("score"), near.alias("dir"))

    def better(best: DataFrame, pairs: DataFrame) -> tuple[DataFrame, tuple[float, str] | None]:
        """The n best with what is not taken of ``pairs``, and the score and first path of the last of them, if there are n."""
        free = pairs.join(taken, ["a", "b"], "left_anti").withColumn("signals", F.array().cast("array<string>"))
        best = cut(best.unionByName(free).dropDuplicates(["a", "b"]).orderBy(*_best()).limit(n))
        found, last = best.agg(F.count("*"), F.max(F.struct((-F.round("score", 6)).alias("s"), "a", "b"))).first()
        return best, (-last["s"], last["a"]) if found == n else None

    heaviest = classes.where("size > 1").orderBy(F.round("weight", 6).desc(), "class").limit(n).select("class")
    best, worst = better(ranked, both(kept.join(heaviest, "class", "left_semi"), "class"))
    if worst is None or worst[0] <= SAME + 1e-6:
        best, worst = better(best, both(head(bags, "dir"), "dir"))
    step = -1
    while True:
        need = 0.0 if worst is None else (worst[0] - SAME) / NAME_WEIGHT - 1e-5
        own = classes.where(F.col("weight") >= need).select("*", F.posexplode("bag").alias("i", "p")).where(shared(F.slice("bag", F.col("i") + 1, F.size("bag"))) >= need)
        own = own.select("class", "size", "dir", "above", "bag", F.col("p.part").alias("part"), F.ceil(F.log2("p.d") / 2).cast("int").alias("step"))
        step = own.where(F.col("step") > step).agg(F.min("step")).first()[0]
        if step is None:
            break
        own = own.where(F.col("step") == step)
        score, near = pair_score("x", "y")
        rarest = F.get(F.array_intersect("x.bag", "y.bag"), F.lit(0))["part"] == F.col("x.part")
        pairs = own.alias("x").join(own.alias("y"), (F.col("x.above") == F.col("y.above")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.class") <= F.col("y.class")))
        pairs = pairs.where(rarest & ((F.col("x.class") < F.col("y.class")) | (F.col("x.size") > 1))).select(F.col("x.class").alias("cx"), F.col("y.class").alias("cy"), score.alias("score"), near.alias("dir"))
        if worst is not None:
            at = F.round("score", 6)
            pairs = pairs.where((at > worst[0]) | (at == worst[0]) & (F.col("cx") <= worst[1]))
        made = pairs.join(kept.select(F.col("class").alias("cx"), F.col("path").alias("x")), "cx").join(kept.select(F.col("class").alias("cy"), F.col("path").alias("y")), "cy")
        best, worst = better(best, made.where("cx < cy or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score", "dir"))
    if worst is None or worst[0] <= SIBLING + 1e-6:
        best, worst = better(best, both(head(bags, "above"), "above"))
    return best.orderBy(*_best()).limit(n)


def paste_links(pairs: DataFrame, doc: str | None = None, shown: int = 4) -> DataFrame:
    """``pairs`` with ``text``: a wiki link to the other document (of ``doc``), or to both, and why, ready to be pasted."""
    why = F.concat_ws("", F.lit(" — "), F.array_join(F.slice("signals", 1, shown), ", "))
    both = F.format_string("[[%s]] ↔ [[%s]]", stem(F.col("a")), stem(F.col("b")))
    other = F.when(F.col("a") == doc, F.col("b")).otherwise(F.col("a"))
    of = F.format_string("[[%s]]  # %s", stem(other), other)
    text = both if doc is None else F.when((F.col("a") == doc) | (F.col("b") == doc), of).otherwise(both)
    return pairs.withColumn("text", F.concat(text, why, F.format_string(" (%.1f)", "score")))


def shared_names(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, names): for the pairs given, the summed ln(N / df) of the file-name parts that both have."""
    named = files.select("path", F.explode(name_tokens(F.col("path"))).alias("part"))
    weights = named.groupBy("part").agg(F.count("*").alias("d"))
    total = files.count()
    of = named.join(weights.where(F.col("d") > 1), "part").select("path", "part", F.ln(F.lit(float(max(total, 1))) / F.col("d")).alias("w"))
    bags = of.groupBy("path").agg(F.collect_list(F.struct("part", "w")).alias("bag"))
    both = pairs.join(bags.toDF("a", "ba"), "a").join(bags.toDF("b", "bb"), "b")
    common = F.array_intersect("ba", "bb")
    return both.select("a", "b", F.aggregate(common, F.lit(0.0), lambda s, x: s + x["w"]).alias("names"))

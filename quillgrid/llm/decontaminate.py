"""Benchmark decontamination in DataFrame operations: canonical templates, hashed windows, slot consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop, let

#: Words of a window, at most and at least; an item of fewer is held against whole texts.
WINDOW, LEAST_WINDOW = 8, 5
#: Words proper (no slots) of a template window that counts along a run, and of the run.
PROPER, RUN_PROPER = 2, 4
#: Units and ordinal endings after a number, in any case.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "lbs", "oz", "ml", "cl", "l", "s", "sec", "secs", "min", "mins", "h", "hr", "hrs", "ms",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "meters", "metres", "kilometers", "kilometres", "miles", "feet", "inches", "grams", "kilograms",
    "pounds", "liters", "litres", "dollars", "euros", "cents", "percent", "degrees", "kmh", "mph", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "kwh", "v", "a",
    "st", "nd", "rd", "th",
)
#: Placeholders of a number or row of numbers, of a number with its unit, and of a name.
NUMBER, QUANTITY, NAME = "0n", "0q", "0p"
_L = r"[\p{L}\p{M}\p{N}]"
_DIGITS = r"\d++(?:[.,:/]\d++)*+"
_UNIT = rf" ?(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!{_L})"
#: "5km", "3.5 miles"; "7" or "1, 2, 3"; a run of words with a capital ("McDonald", "Jean-Luc Picard"), wherever it stands.
QUANTITIES = rf"(?<!{_L}){_DIGITS}{_UNIT}"
NUMBERS = rf"(?<!{_L}){_DIGITS}(?![\p{{L}}\p{{M}}])(?:[ ,;]{{1,3}}{_DIGITS}(?![\p{{L}}\p{{M}}])(?!{_UNIT}))*+"
NAMES = rf"(?<!{_L})\p{{Lu}}[\p{{L}}\p{{M}}]*+(?!\p{{N}})(?:[ '’-]\p{{Lu}}[\p{{L}}\p{{M}}]*+(?!\p{{N}}))*+"
#: Readings: as a template, and word by word in lower case.
TEMPLATE, LITERAL = 0, 1


def words(text: Column, reading: int) -> Column:
    """The words of a text, lower-cased; in a template with placeholders for numbers, quantities and names."""
    text = F.coalesce(text, F.lit(""))
    if reading == TEMPLATE:
        counted = F.regexp_replace(F.regexp_replace(text, QUANTITIES, QUANTITY), NUMBERS, NUMBER)
        text = F.regexp_replace(F.when(F.rlike(text, F.lit(r"\d")), counted).otherwise(text), NAMES, NAME)
    return F.split(F.lower(text), rf"{_L.replace('[', '[^')}+")


def proper(found: Column) -> Column:
    """Without the empty strings that stand for separators at the ends of a text."""
    return F.filter(found, lambda w: w != "")


def slot_values(text: Column) -> Column:
    """What stands for each word of a template: a number without blanks, the last word of a name, else the word; all in lower case."""
    every = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{QUANTITIES}|{NUMBERS}|{NAMES}|{_L}+"), F.lit(0))
    return F.transform(every, lambda v: F.lower(F.when(F.rlike(v, F.lit(r"^\d")), F.replace(v, F.lit(" "))).otherwise(F.regexp_extract(v, rf"{_L}+$", 0))))


def window_hashes(found: Column, lengths: list[int], reading: int) -> Column:
    """The hashes of all windows of the given lengths (5 to 8) at every word, one length after another.

    Hashes of two and four words are made by doubling, and a window of 5 to 8 words is two runs of four. At the last places, where a window does not
    fit, there are hashes that belong to no window. In the end comes the hash of all words if they are fewer than 5, else null.
    """
    twice = lambda h, step: F.transform(h, lambda v, i: F.xxhash64(v, F.get(h, i + step)))
    two_runs = lambda h, n: F.transform(h, lambda v, i: F.xxhash64(v, F.get(h, i + (n - 4)), F.lit(reading * 16 + n)))
    each = lambda h: F.concat(*(two_runs(h, n) for n in lengths), F.array().cast("array<long>"))
    four = let(let(found, lambda w: twice(w, 1)), lambda h: twice(h, 2))
    own = proper(found)
    return F.concat(let(four, each), F.array(F.when(F.size(own) < LEAST_WINDOW, F.xxhash64(F.concat_ws(" ", own), F.lit(reading)))))


def _pattern(found: Column, values: Column, start: Column, length: Column) -> Column:
    """Of the slots of a window the place of the first slot with the same value."""
    slots = F.filter(F.transform(F.sequence(start, start + length - 1), lambda k: F.when(F.get(found, k).isin(NUMBER, QUANTITY, NAME), F.get(values, k))), lambda v: v.isNotNull())
    return let(slots, lambda s: F.transform(s, lambda v: F.array_position(s, v).cast("int")))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, text) -> (hash, reading, item, ipos, length, n_words, pattern, heavy, solid): the windows of every item. ``solid`` says of each word whether it is no slot, ``heavy`` that
    most are slots; such with fewer than two words proper are left out."""
    tables = []
    for reading in (TEMPLATE, LITERAL):
        items = benchmark.select("item", proper(words(F.col("text"), reading)).alias("w"), slot_values(F.col("text")).alias("v")).where("size(w) > 0").dropDuplicates(["item", "w", "v"])
        items = items.withColumn("n_words", F.size("w")).withColumn("length", F.least("n_words", F.lit(WINDOW)))
        every = window_hashes(F.col("w"), list(range(LEAST_WINDOW, WINDOW + 1)), reading)
        own = lambda e: F.when(F.col("length") < LEAST_WINDOW, F.slice(e, -1, 1)).otherwise(F.slice(e, (F.col("length") - LEAST_WINDOW) * F.col("n_words") + 1, F.col("n_words") - F.col("length") + 1))
        hashes = let(every, own)
        each = items.select("item", "w", "v", "n_words", "length", F.posexplode(hashes).alias("ipos", "hash"))
        if reading == TEMPLATE:
            each = each.withColumn("solid", F.transform(F.slice("w", F.col("ipos") + 1, F.col("length")), lambda w: ~w.isin(NUMBER, QUANTITY, NAME)))
            each = each.withColumn("heavy", 2 * _count(F.col("solid")) < F.col("length")).where(~F.col("heavy") | (_count(F.col("solid")) >= PROPER))
            each = each.withColumn("pattern", _pattern(F.col("w"), F.col("v"), F.col("ipos"), F.col("length")))
        else:
            each = each.withColumns({"pattern": F.array().cast("array<int>"), "heavy": F.lit(False), "solid": F.array().cast("array<boolean>")})
        tables.append(each.select("hash", F.lit(reading).alias("reading"), "item", "ipos", "length", "n_words", "pattern", "heavy", "solid"))
    return tables[0].unionByName(tables[1])


def _count(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x))


def _runs(windows: DataFrame, least: int) -> DataFrame:
    """(id, version, reading, item, n_words, first, last): the runs of windows that follow one another word by word, and hold so many words, of which enough are proper, that windows full of slots count in them."""
    of = ["id", "version", "reading", "item", "n_words"]
    once = windows.groupBy(*of, "ipos", "length").agg(F.min("solid").alias("solid"))
    run = once.withColumn("run", F.col("ipos") - F.row_number().over(W.partitionBy(*of).orderBy("ipos")))
    first = F.min(F.struct("ipos", _count(F.col("solid")).alias("n"), F.element_at("solid", -1).cast("int").alias("end")))
    per = run.groupBy(*of, "run").agg(first.alias("first"), F.max(F.col("ipos") + F.col("length") - 1).alias("last"), F.sum(F.element_at("solid", -1).cast("int")).alias("ends"))
    # the first window's words, and the last word of each one after it
    solid = F.col("first.n") - F.col("first.end") + F.col("ends")
    whole = F.col("last") - F.col("first.ipos") + 1 >= F.least(F.lit(least), F.col("n_words"))
    return per.where(whole & (solid >= RUN_PROPER)).select(*of, F.col("first.ipos").alias("first"), "last")


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 13) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, covered) for every row of ``documents``.

    Texts become templates: rows of numbers, numbers with a unit ("5km", "3.5 miles") and runs of words with a capital, wherever they stand, are
    one typed placeholder each. Beside it, texts are read word by word in lower case, so that copies in any case match. Windows of 8 words of
    either reading are joined by hash. A window of the template counts if its slots are consistent and at least half of it is words proper, or two are and it is part of a run of
    windows that follow one another, over ``least`` words (or all of a shorter item), four of them proper: so a question that is mostly numbers is told by all of it. Consistent means that along it equal values of the item's slots stand for equal values of the document's. Different ones may stand for equal ones, as numbers
    of a re-parameterised copy may happen to be equal. A run of shared windows is so split at a conflicting slot, and the parts on either
    side count. A document is contaminated by the items of which, in one reading, such windows cover at least ``least`` words, or all words of a
    shorter item. ``covered`` is the largest such number of words.

    Items of 5 to 7 words are one window; those of fewer are found where they are a whole document; null or empty ones are not searched. Null or empty
    documents are clean. Repeated rows and items each count alike; of items that repeat an id all texts count for it; null ids are judged like others. Empty tables give no
    row, or clean rows. Texts of any length are read as a whole; a window that a document repeats counts once. Other columns are ignored. Documents' windows are never shuffled
    when Spark finds the items' windows small enough to broadcast, else both are shuffled by hash.
    """
    items = cut(item_windows(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")))
    lengths = sorted(r[0] for r in items.where(F.col("length") >= LEAST_WINDOW).select("length").distinct().collect())  # at most four
    known = cut(items.select("hash", "reading", "length").distinct())  # a table, so that Spark knows its size
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    every = F.concat(*(window_hashes(words(F.col("text"), reading), lengths, reading) for reading in (TEMPLATE, LITERAL)))
    hits = cut(docs.select("id", "version", F.explode(every).alias("hash")).join(known, "hash").distinct())
    plain = hits.where(F.col("reading") == LITERAL).select("id", "version", "hash").join(items.where(F.col("reading") == LITERAL), "hash")
    patterns, read = _with_patterns(hits.where(F.col("reading") == TEMPLATE), docs, known, lengths)
    filled = patterns.join(items.where(F.col("reading") == TEMPLATE), "hash")
    steady = F.forall(F.arrays_zip(F.col("pattern").alias("a"), F.col("found").alias("b")), lambda x: F.get("found", x["a"] - 1) == x["b"])
    fine = plain.drop("hash").unionByName(filled.where(steady).select(*(c for c in plain.columns if c != "hash")))
    fine = cut(fine.select("id", "version", "reading", "item", "n_words", "ipos", "length", "heavy", "solid").distinct())
    drop(items, known, hits, *read)
    spans = fine.where("not heavy").withColumns({"first": F.col("ipos"), "last": F.col("ipos") + F.col("length") - 1})
    mixed = fine.where(F.col("reading") == TEMPLATE)
    spans = spans.select("id", "version", "reading", "item", "n_words", "first", "last").unionByName(_runs(mixed, least))
    place = spans.select("id", "version", "reading", "item", "n_words", F.explode(F.sequence("first", "last")).alias("place")).distinct()
    per = place.groupBy("id", "version", "reading", "item", "n_words").agg(F.count("*").alias("n")).where(F.col("n") >= F.least(F.lit(least), F.col("n_words")))
    marks = cut(per.groupBy("id", "version").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("n").alias("n")))
    drop(fine)
    out = docs.select("id", "version").alias("d").join(marks.alias("x"), F.expr("d.id <=> x.id and d.version <=> x.version"), "left")
    return out.select(
        F.col("d.id").alias(id_col),
        F.col("n").isNotNull().alias("contaminated"),
        F.when(F.col("n").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast(marks.schema["items"].dataType)).alias("item_ids"),
        F.coalesce("n", F.lit(0)).cast("long").alias("covered"),
    )


def _with_patterns(hits: DataFrame, docs: DataFrame, known: DataFrame, lengths: list[int]) -> tuple[DataFrame, list[DataFrame]]:
    """(id, version, hash, found): the distinct patterns of slots that a hit's windows have in the document, read again from the few documents with hits; and the tables it reads."""
    hit = cut(hits.select(F.col("id").alias("hit_id"), F.col("version").alias("hit_version")).distinct())
    texts = cut(docs.join(hit, F.expr("id <=> hit_id and version = hit_version"), "left_semi").dropDuplicates(["id", "version"]))
    own = proper(words(F.col("text"), TEMPLATE))
    places = texts.select("id", "version", F.posexplode(window_hashes(own, lengths, TEMPLATE)).alias("at", "hash"))
    size = texts.select(F.col("id").alias("i"), F.col("version").alias("v"), F.size(own).alias("n"))
    found = places.join(known.where(F.col("reading") == TEMPLATE).select("hash", "length"), "hash").join(size, F.expr("id <=> i and version = v"))
    found = found.withColumn("start", F.when(F.col("length") < LEAST_WINDOW, 0).otherwise(F.pmod("at", F.greatest("n", F.lit(1)))))
    per = cut(found.groupBy("id", "version").agg(F.collect_list(F.struct("hash", "start", "length")).alias("windows")))
    there = per.alias("p").join(texts.alias("t"), F.expr("p.id <=> t.id and p.version = t.version")).select("p.id", "p.version", "windows", "text")
    # bound, so that a text is read once and not once for every window
    both = F.struct(own.alias("w"), slot_values(F.col("text")).alias("v"))
    each = let(both, lambda t: F.transform("windows", lambda x: F.struct(x["hash"].alias("hash"), _pattern(t["w"], t["v"], x["start"], x["length"]).alias("found"))))
    return there.select("id", "version", F.explode(F.array_distinct(each)).alias("x")).select("id", "version", "x.hash", "x.found"), [hit, texts, per]

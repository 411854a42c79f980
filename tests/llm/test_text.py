import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import decontaminate as D
from quillgrid.llm.chat_format import digest, escape, format_examples, read_turns, unescape
from quillgrid.llm.decontaminate import TEMPLATE, contamination, proper, slot_values, words
from quillgrid.llm.langid import fit, gram_counts, identify_languages, prepare, score_texts
from quillgrid.llm.mixing import mix_sources, poisson_count, poisson_steps
from quillgrid.llm.pii import distinct_surrogates, replace_pii
from quillgrid.llm.url_filter import domain_and_suffix, filter_urls, host_and_path


def test_language_id(spark):
    words = {"aa": "banana cabana papaya ananas macabre", "bb": "sixth mythic lynx hymn glyph crypt", "cc": "ночь день свет тьма огонь вода"}
    rows = [(k, " ".join(words[lang].split()[(k + j) % 5] for j in range(30)), lang) for k in range(90) for lang in [("aa", "bb", "cc")[k % 3]]]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "banana papaya", "?", 1), (2, "GLYPH hymn", None, 1), (3, "день и ночь", None, 1), (4, None, None, 1), (5, "123 ... 4", None, 1), (6, "漢字仮名交文" * 40, None, 1), (None, "lynx", None, 1), (7, "cabana " * 20000, None, 1)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in identify_languages(asked, labelled).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, None, 7)] == ["aa", "bb", "cc", "und", "und", "bb", "aa"]
    assert got[4].score == 0 and got[4].rejected and got[6].rejected and not got[1].rejected and not got[7].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    none = identify_languages(asked, labelled.where("false")).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == 8
    assert identify_languages(asked.where("false"), labelled).count() == 0


def test_language_id_rejects_beside_a_noisy_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    calibrating = spark.range(10_000_000, 10_000_100).where(F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(5)) == 0).limit(1)
    noisy = docs.unionByName(calibrating.select(F.col("id").alias("doc_id"), F.lit("漢字仮名交文" * 100).alias("text"), F.lit("en").alias("lang")))
    foreign = spark.createDataFrame([(1, "ภาษาไทย " * 100), (2, "ქართული ენა " * 60)], "doc_id long, text string")
    asked = foreign.unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    got = {r.doc_id for r in identify_languages(asked, noisy).where("rejected").collect()}
    assert {1, 2} <= got and len(got) - 2 <= 0.03 * docs.count()


def kneser_ney(texts):
    """log p of a code point after three others, by the definition, in plain Python."""
    from collections import Counter
    from math import log

    own = [prepare(t) for t in texts]
    counts = {4: Counter(t[k - 3 : k + 1] for t in own for k in range(3, len(t)))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    some = {n: Counter(c.values()) for n, c in counts.items()}
    discount = {n: min(0.9, max(0.1, some[n][1] / max(1, some[n][1] + 2 * some[n][2]))) for n in counts}

    def p(context, c, alphabet):
        n = len(context) + 1
        lower = p(context[1:], c, alphabet) if context else 1 / alphabet
        after = [x for g, x in counts[n].items() if g[:-1] == context]
        if not after:
            return lower
        return max(counts[n][context + c] - discount[n], 0) / sum(after) + discount[n] * len(after) / sum(after) * lower

    return lambda context, c, alphabet: log(p(context, c, alphabet))


def test_models_as_brute_force(spark):
    """Every code point's probability in every language, of texts that were learnt from, of others, and with code points that no language has."""
    learnt = {"aa": ["banana cabana", "papaya ananas", "a"], "bb": ["lynx hymn banana", "glyph", "glyph crypt"], "cc": ["ночь день", "день и свет"]}
    rows = [(lang, t) for lang, ts in learnt.items() for t in ts]
    model = fit(gram_counts(spark.createDataFrame(rows, "lang string, text string")).toPandas())
    alphabet = len(set("".join(prepare(t) for _, t in rows))) + 1
    asked = ["Banana!", "glyph, день", "zebra 漢字 x", "ночь lynx papaya", "q"]
    own = {lang: kneser_ney(ts) for lang, ts in learnt.items()}
    count, loss = score_texts([*asked, None, "12"], model)
    assert model.languages == sorted(learnt) and list(count[-2:]) == [0, 0]
    for k, text in enumerate(asked):
        ready = prepare(text)
        codes = np.array([list(map(ord, ready[j - 3 : j + 1])) for j in range(3, len(ready))], np.uint64)
        by_hand = np.array([[own[lang](ready[j - 3 : j], ready[j], alphabet) for lang in model.languages] for j in range(3, len(ready))])
        assert np.allclose(model.logs(codes), by_hand, atol=1e-5) and np.allclose(loss[k], -by_hand.mean(0), atol=1e-5) and count[k] == len(by_hand)


def test_models_grow_by_what_languages_have(spark):
    """Two hundred languages learn as much each as one alone would, and their models are as large as these together."""
    import random

    draw = random.Random(3)
    rows = []
    for k in range(200):
        letters = draw.sample("abcdefghijklmnopqrstuvwxyz", 6)
        rows += [(f"l{k:03}", " ".join("".join(draw.choices(letters, k=draw.randrange(2, 6))) for _ in range(60))) for _ in range(2)]
    counts = gram_counts(spark.createDataFrame(rows, "lang string, text string")).toPandas()
    whole, one = fit(counts), fit(counts[counts["lang"] == "l007"])
    sizes = counts.groupby("lang").size()
    assert len(whole.grams[-1].value) == sizes.sum() and len(one.grams[-1].value) == sizes["l007"]
    _, loss = score_texts([t for _, t in rows], whole)
    assert [whole.languages[k] for k in loss.argmin(1)] == [lang for lang, _ in rows]


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    got = identify_languages(docs, docs.where(fold != 0)).join(docs.where(fold == 0).select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.where("rejected").count() <= 0.01 * got.count()


def test_urls(spark):
    urls = {1: "HTTP://User@A.Example.COM:80/fr/x?q=://z", 2: None, 3: "no scheme/x", 4: "https://x.org", 5: "https://x.org/", 6: "https://sub.example.org/es/1", 7: "https://notexample.org/es/1", 8: "http://b.com/de/#f", 9: "http://Bad.net/1", 10: "http://fine.net/1", 11: "://h?x"}
    pages = spark.createDataFrame([(k, u, 0) for k, u in urls.items()] + [(100 + k, f"http://Bad.net/{k}", 0) for k in range(60)] + [(200 + k, f"http://fine.net/{k}", 0) for k in range(60)], "page_id long, url string, host int")
    labels = spark.createDataFrame([(100 + k, True) for k in range(60)] + [(200 + k, False) for k in range(60)] + [(None, True), (1, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in filter_urls(pages.drop("host").withColumn("rule", F.lit("x")), labels).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("user@a.example.com:80", "/fr/x", None, "allow")
    assert (got[2].host, got[2].path) == ("", "") and (got[3].host, got[3].path) == ("", "")
    assert (got[4].path, got[4].rule) == ("", None) and got[5].rule == "org/"
    assert (got[6].rule, got[6].verdict) == ("example.org/es/", "block") and (got[7].rule, got[7].verdict) == ("org/", "allow")
    assert (got[8].rule, got[8].verdict) == ("com/de/", "block") and got[9].verdict == "block" and got[10].verdict == "allow"
    assert (got[11].host, got[11].path) == ("h", "") and got[9].bad_low > got[10].bad_rate
    assert filter_urls(pages.where("false"), labels.where("false")).count() == 0
    assert {r.verdict for r in filter_urls(pages, labels.where("false")).where("rule is null").collect()} == {"allow"}


def test_mixing(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") < 4500, "big").when(F.col("id") < 5900, "small").otherwise(None).alias("source"), F.lit(1).alias("copy_no"))
    out = mix_sources(docs, {"big": 1, "small": 3}).cache()
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["big"] - 1500) < 150 and abs(n["small"] - 4500) < 250 and None not in n
    assert out.columns == ["doc_id", "text", "source", "copy_no", "shuffle_key"]
    again = mix_sources(docs.repartition(7), {"big": 1, "small": 3})
    assert out.select("doc_id", "copy_no").exceptAll(again.select("doc_id", "copy_no")).count() == 0
    assert [r.n for r in out.groupBy("doc_id").agg((F.max("copy_no") - F.count("*")).alias("n")).select("n").distinct().collect()] == [0]
    even = mix_sources(docs, temperature=1.0).count()
    assert abs(even - 6000) < 400
    assert mix_sources(docs.where("false")).count() == 0 and mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_mixing_edges(spark):
    from math import exp, lgamma, log

    def brute(r, u):
        total = 0.0
        for k in range(10**6):
            total += exp(k * log(r) - r - lgamma(k + 1))
            if total > u:
                return k

    asked = [(r, u) for r in (0.3, 7.0, 1000.0, 4000.0, 50_000.0) for u in (0.0, 0.1, 0.5, 0.999)]
    rows = spark.createDataFrame(asked, "r double, u double")
    steps = F.when(F.col("r") <= 1000, F.size(F.filter(poisson_steps(F.col("r")), lambda c: c <= F.col("u"))))
    for r in rows.select("r", "u", poisson_count(F.col("r"), F.col("u")).alias("n"), steps.alias("m")).collect():
        assert r.n == brute(r.r, r.u) and r.m in (None, r.n)
    docs = spark.createDataFrame([(None, "a", "s"), (None, "a", "s"), (1, "b", "s"), (1, "b", "s"), (2, None, "s"), (3, "c" * 100_000, None)], "doc_id long, text string, source string")
    n = {r.doc_id: r.n for r in mix_sources(docs, {"s": 1}, budget=0.2).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(n) == {None, 1, 2} and n[None] % 2 == 0 and n[1] % 2 == 0 and abs(n[2] - 5000) < 400


ITEM = "Anna has 12 apples and gives 5 of them to Peter after walking 3 km to the market square in Boston today"


def test_decontamination(spark):
    other = "Anna has 40 apples and gives 7 of them to Peter after walking 9 km to the market square in Boston today"
    twisted = "Anna has 12 apples and gives 12 of them to Peter after walking 3 km to the market square in Boston today"
    renamed = "so Maria has 12 apples and gives 5 of them to Olaf after walking 3 km to the market square in Lisbon today"
    rows = [(1, f"Some text. {ITEM} and more"), (2, f"Before. {other}."), (3, twisted), (4, renamed), (5, "a clean text about walking to the market"), (6, None), (7, ""), (8, f"x\n{ITEM.upper()}"), (None, ITEM), (1, f"Some text. {ITEM} and more"), (9, "one two three four five six"), (10, "zero one two three four"), (11, ITEM[:40]), (12, "Two, three!"), (13, "two three four")]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, item long, pos int")
    bench = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "two three four five six", 0), (4, "two three", 0)], "item_id long, text string, hash int")
    got = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {1, 2, 3, 4, 8, None, 9, 12}
    assert got[1].item_ids == [1] and got[9].item_ids == [3] and got[12].item_ids == [4] and min(got[k].covered for k in (1, 2, 3, 4, 8)) >= 13
    assert contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert contamination(docs.where("false"), bench).count() == 0


def test_decontamination_of_glued_units_and_odd_names(spark):
    item = "Yesterday McDonald drove 5km with Jean-Luc Picard, paid 3.5 dollars for 10, 20 and 30 pears and then slept until noon"
    texts = ["Yesterday McGregor drove 7 miles with Anne-Marie, paid 9.25 dollars for 1, 2, 3 and 4 pears and then slept until noon", "A. " + item.replace("5km", "5 km"), "Yesterday McGregor drove a car with Anne-Marie, ate pears"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[0].contaminated and got[1].contaminated and not got[2].contaminated


def test_decontamination_of_long_rows_of_numbers(spark):
    """Thousands of equal windows on either side stay few rows, and prove nothing by themselves."""
    docs = spark.createDataFrame([(1, " ".join(f"{k} x" for k in range(4000))), (2, " ".join(map(str, range(4000)))), (3, "ha " * 4000), (4, "ho " * 20)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"{k} x" for k in range(7000, 9000))), (2, " ".join(map(str, range(7000, 9000)))), (3, "ha " * 2000)], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in contamination(docs, bench).collect()}
    assert got[3] == [3] and got[2] == [] and got[4] == []


def template_brute(text):
    """The template and the values of its slots, word by word in plain Python."""
    import regex

    units = "|".join(sorted(D.UNITS, key=len, reverse=True))
    digits, word = r"\d++(?:[.,:/]\d++)*+", r"[\p{L}\p{M}\p{N}]"
    kinds = ((D.QUANTITY, rf"{digits} ?(?i:{units})(?!{word})"), (D.NUMBER, rf"{digits}(?![\p{{L}}\p{{M}}])(?:[ ,;]{{1,3}}{digits}(?![\p{{L}}\p{{M}}])(?! ?(?i:{units})(?!{word})))*"), (D.NAME, r"\p{Lu}[\p{L}\p{M}]*(?![\p{L}\p{M}\p{N}])(?:[ '’-]\p{Lu}[\p{L}\p{M}]*(?![\p{L}\p{M}\p{N}]))*"))
    out, at = [], 0
    while at < len(text):
        if not regex.match(word, text[at]):
            at += 1
            continue
        for kind, pattern in kinds:
            if m := regex.compile(pattern).match(text, at):
                out.append((kind, (m[0].replace(" ", "") if kind != D.NAME else regex.split(rf"(?!{word}).", m[0])[-1]).lower()))
                break
        else:
            m = regex.compile(f"{word}+").match(text, at)
            out.append((m[0].lower(), m[0].lower()))
        at = m.end()
    return out


def contamination_brute(texts, items, least=13):
    """Every window of every item against every window of every document; literal windows without slots, template windows slot by slot."""
    slots = {D.NUMBER, D.QUANTITY, D.NAME}
    read = lambda t: (template_brute(t), [(w, w) for w in re.findall(r"[^\W_]+", t.lower())])
    out = {}
    docs = {d: read(t) for d, t in texts.items()}
    for i, text in items.items():
        for k, item in enumerate(read(text)):
            n = min(8, len(item))
            for d, both in docs.items():
                doc, cover, hit = both[k], set(), set()
                if n < 5 and len(doc) != len(item):
                    continue
                for a in range(len(item) - n + 1):
                    want = item[a : a + n]
                    full = sum(w in slots for w, _ in want)
                    if k == 0 and 2 * full > n and n - full < 2:
                        continue
                    for b in range(len(doc) - n + 1):
                        have = doc[b : b + n]
                        if [w for w, _ in want] == [w for w, _ in have]:
                            to = {}
                            if k or all(to.setdefault(x, y) == y for (w, x), (_, y) in zip(want, have) if w in slots):
                                hit.add(a)
                                cover |= set() if k == 0 and 2 * full > n else set(range(a, a + n))
                for a in hit if k == 0 else ():
                    end = a
                    while end + 1 in hit:
                        end += 1
                    long = end + n - a >= min(least, len(item)) and sum(w not in slots for w, _ in item[a : end + n]) >= 4
                    cover |= set(range(a, end + n)) if a - 1 not in hit and long else set()
                if item and len(cover) >= min(least, len(item)):
                    out.setdefault(d, set()).add(i)
    return {d: sorted(out.get(d, ())) for d in texts}


def test_decontamination_as_brute_force(spark):
    import random

    rng = random.Random(11)
    small = "has gives takes of them to the market after walking and sells home again with his her before noon".split()

    def say(n):
        return " ".join(rng.choice([rng.choice(small)] * 5 + [str(rng.randint(1, 30)), f"{rng.randint(1, 9)}.5 km", f"{rng.randint(1, 9)}km", rng.choice(["Anna", "Jean-Luc Picard", "McDonald", "Olga", "NASA"]), "1, 2, 3"]) for _ in range(n))

    def changed(t):
        t = re.sub(r"\d+", lambda m: str(rng.randint(1, 12)), t) if rng.random() < 0.5 else t
        for name in ("Anna", "Olga", "McDonald"):
            t = t.replace(name, rng.choice(["Maria", "Boris", name])) if rng.random() < 0.5 else t
        return rng.choice([str, str, str.upper, str.lower])(t)

    items = {k: say(rng.choice([2, 3, 5, 6, 7, 12, 30])) for k in range(30)} | {30: "", 31: "Anna has"}
    texts = {k: rng.choice([f"{say(4)}. {changed(items[rng.randrange(30)])}! {say(5)}", changed(items[rng.randrange(32)]), say(20)]) for k in range(120)}
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = contamination_brute(texts, items)
    assert {r.doc_id: r.item_ids for r in contamination(docs, bench).collect()} == want and sum(map(bool, want.values())) > 30
    for r in docs.select("doc_id", proper(words(F.col("text"), TEMPLATE)).alias("w"), slot_values(F.col("text")).alias("v")).collect():
        assert list(zip(r.w, r.v)) == template_brute(texts[r.doc_id])


def test_decontamination_splits_at_a_conflicting_slot(spark):
    tail = "of them to his neighbour before the train leaves the old station in the evening"
    item = f"Then Carl has 12 pears and eats 12 {tail}"
    rows = [(1, f"Then Carl has 12 pears and eats 30 {tail}"), (2, f"Then Carl has 4 pears and eats 4 {tail}"), (3, "Then Carl has 12 pears and eats 30 of them"), (4, "Then Olga had 5 eggs, ate 5 and sold 5 of them before noon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "Then Olga had 3 eggs, ate 4 and sold 6 of them before noon")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {1, 2, 4} and got[4].item_ids == [2]
    assert got[2].covered > got[1].covered >= 13 and got[3].covered == 0


def test_decontamination_of_questions_full_of_slots(spark):
    item = "If 3 + 4 = 7 and 5 x 6 = 30 what is 8 x 9 - 2"
    texts = ["So: if 4 + 5 = 9 and 2 x 8 = 16 what is 3 x 7 - 1? Say it.", "If 4 + 5 = 9 and 2 x 8 = 16 what is 3 x 7 - 1?", "If 4 + 5 = 9 and 2 x 8 = 16 then all is well", "Anna, Bob, Carl, Dora, Emil and Fritz met Gina, Hans, Ida and Jan in Kiel", "1 + 2 = 3 and 4 + 5 = 9 and 6 + 7 = 13 and 8 + 9 = 17"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = "Adam, Beth, Cleo, Dave, Eric and Fred met Gwen, Hugo, Iris and Jack in Leeds"
    bench = spark.createDataFrame([(1, item), (2, names.replace("met", "and").replace("in", "and")), (3, "2 + 3 = 5 and 7 + 1 = 8 and 4 + 4 = 8 or 1 + 1 = 2")], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in contamination(docs, bench).collect()}
    assert got == contamination_brute(dict(enumerate(texts)), {r.item_id: r.text for r in bench.collect()}) and got[1] == [1] and not (got[2] or got[3] or got[4])


def test_decontamination_types_names_anywhere(spark):
    items = ["John has 5 apples and gives 2 to his sister", "The answer is known. Mary sold 7 eggs. John bought 3 of them. Carl lost 2 at home.", 'They said "Mary is a friend of NASA people since May" and left the room', "Der Hund sah die Katze im Garten und das Kind im Haus am See"]
    texts = ["Mary has 9 apples and gives 4 to his sister", "The answer is known. Olga sold 4 eggs. Peter bought 9 of them. Anna lost 8 at home.", 'They said "Olga is a friend of ESA people since July" and left the room', items[3].lower(), items[3].upper(), "x: " + items[0].lower(), "Mary has a dog and gives it food at home", "MARIA has 9 apples and gives 4 to his sister"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in contamination(docs, bench).collect()}
    assert got == {0: [0], 1: [1], 2: [2], 3: [3], 4: [3], 5: [0], 6: [], 7: [0]}


def test_decontamination_finds_what_brute_force_finds(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = {tuple(w[k : k + 13]) for r in bench.collect() for w in [words(r.text)] for k in range(len(w) - 12)}
    want = {r.doc_id for r in docs.collect() for w in [words(r.text)] if any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12))}
    assert {r.doc_id for r in contamination(docs, bench).where("contaminated").collect()} == want


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\l\\b\\-\\n <|user|>\n", "", "a\\", "<\\l>[[\\]]", "plain"])
def test_escapes(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("t"), unescape(escape(F.col("t"), True), True).alias("r"), escape(F.col("t"), True).alias("re")).first()
    assert row.t == text and row.r == text and "<" not in row.e and "[" not in row.e and "\n" not in row.re


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 2, "assistant", "one </s>"), (1, 1, "user", "hi\n[INST]"), (1, 3, "user", None), (2, 0, "user", "alone"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, None, None, "x"), (4, 1, "odd\nrole", "y"), (None, 0, "assistant", "z")]
    rows = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, example int")
    made = format_examples(rows)
    got = {r.conv_id: r for r in digest(made).collect()}
    conv = {}
    for c, t, role, text in sorted(turns, key=lambda x: (x[0] or -1, x[1] if x[1] is not None else -1, x[2] or "", x[3] or "")):
        conv.setdefault(c, []).append((role or "", text or ""))
    for c, own in conv.items():
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = made.where("conv_id = 1 and example = 0").select("formatted", read_turns(F.col("formatted")).alias("t")).first()
    assert [tuple(t) for t in first.t] == conv[1][:3]
    assert made.where("conv_id = 1").count() == 2 and format_examples(rows.where("false")).count() == 0


def test_pii(spark):
    text = 'Mail jo.ann@mail3.example.com or bob@mail3.example.com, call +1 (017) 555-7713, card 4539578763621486, ip 97.51.17.173, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962". Mrs. Maria Lopez met Dr. Lopez.'
    rows = [(1, text), (2, "again jo.ann@mail3.example.com!"), (3, None), (4, ""), (5, "version 3.14, year 2024, 12,345.67 and a@b"), (1, text), (None, "ip 97.51.17.173"), (6, "w " * 30000 + "x@y.org")]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, value int, type int")
    got = {r.doc_id: r for r in replace_pii(docs, key="k").collect()}
    new = got[1].text
    for gone in ("jo.ann", "bob@", "mail3", "555-7713", "4539578763621486", "97.51.17.173", "04dbebab", "Maria", "Lopez"):
        assert gone not in new
    assert got[1].n_entities == 8 and len(new) == len(text) and new.startswith("Mail ") and "+1 (" in new and 'token = "' in new and "Mrs. " in new
    mails = re.findall(r"\S+@(\S+?\.com)", new)
    assert len(set(mails)) == 1
    assert re.search(r"again (\S+)!", got[2].text)[1] in new
    names = re.search(r"Mrs\. (\w+) (\w+) met Dr\. (\w+)\.", new)
    assert names[2] == names[3] and names[1].istitle() and names[1].endswith("a")
    card = re.search(r"card (\d{16})", new)[1]
    assert sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(card)) % 10 == 0
    assert all(int(o) < 256 for o in re.search(r"ip ([\d.]+)", new)[1].rstrip(".").split("."))
    assert got[3].text is None and got[4].text == "" and got[5].text == rows[4][1] and got[5].n_entities == 0 and got[6].n_entities == 1
    assert got[None].text.split()[1] == re.search(r"ip (\d+\.\d+\.\d+\.\d+)", new)[1]
    assert swapped(spark, [text], "other")[0] != new
    assert replace_pii(docs.where("false"), key="k").count() == 0


def swapped(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in replace_pii(rows, key=key).orderBy("doc_id").collect()]


def test_pii_follows_a_name_through_its_document(spark):
    text = "Mr. John Smith said so. Later Smith left, and JOHN came back. Maria Lopez de la Cruz saw Smith's dog; cruz is no name. Dr. Ana J. O'Brien-Lee left, and O'Brien-Lee wrote."
    other = "Smith is a trade, and Maria sang. Herr Müller Die Lampe. My name is Иван Петров. Иван Петров, Петров."
    new, second = swapped(spark, [text, other])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) said so\. Later (\w+) left, and (\w+) came back\. (\w+) (\w+) de la (\w+) saw (\w+)'s dog; cruz is no name\. Dr\. (\w+) (\w)\. ([\w'-]+) left, and ([\w'-]+) wrote\.", new)
    assert m and m[2] == m[3] == m[8] and m[4] == m[1].upper() and m[11] == m[12]
    for old, made in zip(("John", "Smith", "Maria", "Lopez", "Cruz", "Ana", "O'Brien-Lee"), (m[1], m[2], m[5], m[6], m[7], m[9], m[11])):
        assert made != old and len(made) == len(old)
    assert m[5].endswith("a") and m[9].endswith("a") and not m[1].endswith(("a", "e", "i", "u")) and re.fullmatch(r"\w'\w{5}-\w{3}", m[11])
    n = re.fullmatch(r"Smith is a trade, and Maria sang\. Herr (\w+) Die Lampe\. My name is (\w+) (\w+)\. (\w+) (\w+), (\w+)\.", second)
    assert n and n[1] != "Müller" and (n[2], n[3]) == (n[4], n[5]) and n[3] == n[6] != "Петров" and all("а" <= c <= "я" for c in n[2][1:].lower())


def test_pii_of_any_length(spark):
    jwt = "eyJ" + "h" * 900 + "." + "Q" * 900 + "." + "z" * 40
    assigned, hexes = "A1b2-" * 400 + "=", "0123456789abcdef" * 40
    new = swapped(spark, [f"see {jwt} now", f'password: "{assigned}" end', f"h {hexes}", "gh ghp_" + "a1" * 400, "x" * 80 + "@" + "y" * 70 + ".org."])
    assert [len(t) for t in new] == [len(f"see {jwt} now"), len(f'password: "{assigned}" end'), 642, 807, 156]
    assert new[0].startswith("see eyJ") and "hhhh" not in new[0] and "QQQ" not in new[0] and "zzzz" not in new[0] and new[0].endswith(" now")
    assert new[1].startswith('password: "') and "A1b2" not in new[1] and new[1].endswith('=" end') and re.fullmatch(r"h [0-9a-f]{640}", new[2]) and hexes[-16:] not in new[2]
    assert new[3].startswith("gh ghp_") and "a1a1" not in new[3] and "xxx" not in new[4] and "yyy" not in new[4] and new[4].endswith(".org.")


def test_pii_formats(spark):
    keep = ["card 4539578763621487 has no check digit", "at 12:30:45, std::vector a::b, 1:2", "It was Alice who sang", "ratio 1.2.3.4.5"]
    new = swapped(spark, [*keep, "ip 2001:db8::ff00:42:8329 and fe80::1 and 1:2:3:4:5:6:7:8.", "pay DE89 3704 0044 0532 0130 00 now"])
    assert new[:4] == keep
    assert re.fullmatch(r"ip \d{4}:[0-9a-f]{2}\d::[0-9a-f]{2}\d\d:\d\d:\d{4} and [a-f]{2}\d\d::\d and \d(:\d){7}\.", new[4]) and "8329" not in new[4]
    iban = re.fullmatch(r"pay (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) now", new[5])[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"


def test_pii_keeps_domains_apart(spark):
    sites = [f"{a}{b}.com" for a in "bcdfghjklm" for b in "bcdfghjklm"]
    new = swapped(spark, [f"me@{s} you@{s}" for s in sites])
    made = [re.fullmatch(r"(\S+)@(\S+\.com) (\S+)@(\S+\.com)", t) for t in new]
    assert all(m[2] == m[4] for m in made) and len({m[2] for m in made}) == 100 and not {m[2] for m in made} & set(sites)


def test_pii_leaves_only_what_brute_force_calls_clean(spark):
    """Over a whole table: documents without a hit of plain patterns stay byte for byte; in others every hit is gone, equal ones got equal surrogates, and distinct ones distinct ones."""
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    luhn = lambda s: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(s))) % 10 == 0
    plain = re.compile(r"(?<![\w.])\S+@[\w.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<=token = \")[0-9a-f]{40}|(?<!\d)\d{16}(?!\d)")
    new = {r.doc_id: r for r in replace_pii(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), key="k").collect()}
    pairs = set()
    for i, text in rows.items():
        hits = [h for h in plain.findall(text) if not re.fullmatch(r"\d{16}", h) or luhn(h)]
        got = [h for h in plain.findall(new[i].text or "") if not re.fullmatch(r"\d{16}", h) or luhn(h)]
        assert new[i].n_entities == len(hits) == len(got)
        assert hits or (new[i].text or "") == text
        assert not any(h in new[i].text for h in hits)
        pairs |= set(zip(hits, got))
    assert len(pairs) >= 80 and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def test_surrogates_are_distinct_when_formats_are_scarce(spark):
    values = spark.createDataFrame([("ip", f"{a}.{b}.1.1", None) for a in range(10) for b in range(10)] + [("ssn", f"{k}", None) for k in range(10)] + [("part", f"{a}{b}", None) for a in "bcdfg" for b in "aeiou"], "type string, value string, site string")
    got = distinct_surrogates(values, "k").collect()
    assert len(got) == 135 and len({(r.type, r.surrogate) for r in got}) == 135
    real = {(r.type, r.value) for r in got}
    assert not any((r.type, r.surrogate) in real for r in got)


def test_domains(spark):
    hosts = ["a.b.example.com", "x.co.uk", "y.x.co.uk:80", "u@10.0.0.1", "99.7.0.1", "[2001:db8::1]:443", "localhost", "", "a.b.gov.au", "p.q.myhost.app"]
    domain, suffix = domain_and_suffix(F.col("h"), ("myhost.app",))
    got = [(r.d, r.s) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(domain.alias("d"), suffix.alias("s")).collect()]
    assert got == [("example.com", "com"), ("x.co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("10.0.0.1", "(address)"), ("99.7.0.1", "(address)"), ("[2001:db8::1]", "(address)"), ("localhost", "localhost"), ("", ""), ("b.gov.au", "gov.au"), ("q.myhost.app", "myhost.app")]


def test_host_of_odd_urls(spark):
    host, path = host_and_path(F.col("u"))
    row = spark.createDataFrame([("x://a://b/c",)], "u string").select(host.alias("h"), path.alias("p")).first()
    assert (row.h, row.p) == ("a:", "//b/c")

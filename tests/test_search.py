"""Search in one pass over the texts, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import search as S
from quillgrid.functions.terms import parse

SCHEMA = "path string, sec_no int, line long, heading string, content string, title string, tags array<string>, aliases array<string>"


def corpus(spark, seed=0):
    rng = random.Random(seed)
    words = ["ab", "abc", "b", "über", "of", "the", "of the", "", "x y", "ofthe"]
    rows = []
    for d in range(60):
        title = rng.choice(["t of", "the", "", None])
        for s in range(rng.randint(1, 5)):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
            rows.append((f"d/{d}.md", s, 1 + s, rng.choice(["the", "of", "", "h"]), rng.choice([text, text, None]), title, None, rng.choice([None, ["of the"]])))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("phrase", ["of the", "b of", "the of the", "y x y x", "md the", "abc abc abc"])
def test_phrases_run_over_section_ends(spark, phrase):
    rows, scan = corpus(spark)
    docs = {}
    for path, _, _, heading, content, title, _, _ in sorted(rows, key=lambda r: r[:2]):
        docs.setdefault(path, [(title or "").lower() + " " + path]).append(f"{heading.lower()} {(content or '').lower()}")
    want = sum(phrase in " ".join(parts) for parts in docs.values())
    stats = S.statistics(S.section_hits(scan, [parse(f'"{phrase}"')]))
    assert (stats.total, stats.df[phrase]) == (60, want)


def test_no_text_is_shuffled(spark):
    """Plans of the pass itself and of what follows it: texts are read, nothing but states and points is written."""
    _, scan = corpus(spark)
    hits = S.section_hits(scan, [parse('"of the" abc'), parse("über tag:x")])
    assert not {"content", "c", "title", "t"} & set(hits.table.columns)
    plan = S._documents(hits, S.statistics(hits))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_phrasings_together_as_one_by_one(spark):
    _, scan = corpus(spark)
    texts = ["abc of", '"of the" abc', "path:3 the", "title:of", "nosuch abc", "abc of the über xx ofthe", "abc"]
    for text, found in zip(texts, S.rank_all(scan, texts)):
        alone = S.rank(scan, text)
        assert sorted(map(tuple, found.results.collect())) == sorted(map(tuple, alone.results.collect())) and found.partial == alone.partial
        assert found.flags().first() == alone.flags().first()


def test_fusion_reads_the_texts_once(spark, tmp_path):
    _, scan = corpus(spark)
    scan.write.parquet(str(tmp_path / "scan"))
    rows = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda c: rows.add(1) or c, "string").asNondeterministic()
    scan = spark.read.parquet(str(tmp_path / "scan")).withColumn("content", seen("content"))
    got = S.fused(scan, ["abc of", "the abc", '"of the"'], 10).collect()
    assert rows.value == scan.count() and len(got) == 10
    assert all(r.sources >= 1 and r.line is not None for r in got)
    one = {r.path: k for k, r in enumerate(S.rank(scan, "abc of").results.orderBy(*S.ranking()).collect())}
    two = {r.path: k for k, r in enumerate(S.rank(scan, "the abc").results.orderBy(*S.ranking()).collect())}
    three = {r.path: k for k, r in enumerate(S.rank(scan, '"of the"').results.orderBy(*S.ranking()).collect())}
    for r in got:
        ranks = [x[r.path] for x in (one, two, three) if r.path in x]
        assert r.rrf == pytest.approx(sum(1 / (60 + k) for k in ranks)) and r.best_rank == min(ranks)


def test_empty_scan(spark):
    scan = spark.createDataFrame([], SCHEMA)
    assert S.rank(scan, "abc").results.count() == 0 and S.rank(scan, "abc").weak() and S.fused(scan, ["a b cd", "xy"], 5).count() == 0

"""The kept index: reopened without reading, updated bucket by bucket, searched by trigrams."""

import os
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from quillgrid.functions.terms import parse
from quillgrid.operators import search as S
from quillgrid.operators.suggest import token_weights
from quillgrid.plans.vault import Vault
from quillgrid.sources import vault as V
from quillgrid.sources.index import KeptIndex, term_grams
from test_vault import FILES, INDEXED, PATTERNS, put

QUERIES = ["water", "water towers", "gronk", "semaphore arms", '"water towers"', '"made here"', "tag:diesel wagons", "type:pdf", "be", "scones nosuchword", "cab left", "platform", "the works of water scoops by hand rail", "coal", "zzz", "boilers'"]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kept")
    put(root, FILES)
    put(root, {f"more/n{k}.md": f"# Note {k}\n\nnumber{k} filler words of no matter\n" for k in range(80)})
    return str(root), str(tmp_path_factory.mktemp("index") / "ix")


def rows(frame):
    return sorted(map(repr, frame.collect()))


def stamps(index, name):
    """The files of each bucket."""
    return {d: sorted(os.listdir(f"{index}/{name}/{d}")) for d in os.listdir(f"{index}/{name}") if d.startswith("bucket=")}


def test_second_session_reads_nothing(spark, place):
    root, index = place
    first = Vault(spark, root, None, PATTERNS, index=index, buckets=8)
    assert {r.path for r in first.frames.parsed.collect()} >= INDEXED
    second = Vault(spark, root, None, PATTERNS, index=index)
    assert second.frames.parsed.count() == 0 and second.index.buckets == 8
    plain = Vault(spark, root, None, PATTERNS)
    for name in ("files", "sections", "links", "alts"):
        a, b = getattr(second.frames, name), getattr(plain.frames, name)
        assert rows(a.select(sorted(set(a.columns) - {"bucket"}))) == rows(b.select(sorted(b.columns))), name
    assert {r.change for r in second.update().collect()} == {"unchanged"} and second.frames.parsed.count() == 0


def test_search_as_a_full_scan(spark, place):
    """What a query finds in all texts is among its candidates, and ranks alike if only these are read."""
    root, index = place
    kept, plain = Vault(spark, root, None, PATTERNS, index=index, buckets=8), Vault(spark, root, None, PATTERNS)
    full = S.rank_all(plain.frames.scan(), QUERIES)
    narrowed = 0
    for query, found in zip(QUERIES, full):
        candidates = kept.index.candidates([parse(query)])
        if candidates is not None:
            narrowed += 1
            assert found.results.join(candidates, "path", "left_anti").count() == 0, query
    assert narrowed >= 10
    for query in ("water towers", '"made here"', "type:pdf"):
        assert [tuple(r) for r in kept.search(query, 50).collect()] == [tuple(r) for r in plain.search(query, 50).collect()]
    texts = ["water towers", "semaphore", "boilers works"]
    assert [tuple(r) for r in kept.search(texts).collect()] == [tuple(r) for r in plain.search(texts).collect()]
    assert kept.feedback(texts) == plain.feedback(texts)


def test_search_reads_few_buckets(spark, place):
    root, index = place
    kept = Vault(spark, root, None, PATTERNS, index=index, buckets=8)
    scan = kept.frames.scan()
    narrow = kept.index.narrowed(scan, [parse("scoops columns")])
    files = lambda df: df.where("heading <> '(image)'").select(F.input_file_name()).distinct().count()
    assert files(narrow) <= 2 < files(scan) and "IN" in narrow._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ", 1)[1][:80]
    read = narrow.select("path").distinct().count()
    assert read < 5 < scan.select("path").distinct().count()
    assert kept.index.candidates([parse("be")]) is None and kept.index.candidates([parse("type:md")]) is None
    assert term_grams("ab cdef") == ["cde", "def"] and term_grams("ab") == []


def test_an_edit_rewrites_its_buckets_only(spark, place):
    root, index = place
    Vault(spark, root, None, PATTERNS, index=index, buckets=8)
    before = {name: stamps(index, name) for name in ("files", "sections", "grams", "links", "tokens", "counts")}
    note, gone = pathlib.Path(root, "more/n3.md"), pathlib.Path(root, "more/n4.md")
    note.write_text("# Note 3\n\nquixotic [[pacific]]\n")
    gone.unlink()
    kept = Vault(spark, root, None, PATTERNS, index=index)
    assert kept.search("quixotic").count() == 0  # as it was kept
    assert {r.change: r.n for r in kept.update().collect()} == {"changed": 1, "deleted": 1, "unchanged": len(INDEXED) + 78}
    assert [r.path for r in kept.frames.parsed.collect()] == ["more/n3.md"]
    assert kept.search("quixotic").first().path == "more/n3.md" and "more/n4.md" not in {r.path for r in kept.search("number4", 50).collect()}
    for name, old in before.items():
        now = stamps(index, name)
        assert set(now) == set(old) and 1 <= sum(now[d] != old[d] for d in old) <= 2, name
    third = Vault(spark, root, None, PATTERNS, index=index)
    assert third.search("quixotic").first().path == "more/n3.md" and ("more/n3.md", "pacific") in {(r.src, r.dst) for r in third.frames.links.collect()}


def test_frequencies_follow_adds_edits_and_deletions(spark, tmp_path):
    """After each of several random updates, kept words and their frequencies are those of a fresh count, and suggestions are those of a fresh vault."""
    draw, root, index = random.Random(5), tmp_path / "v", str(tmp_path / "ix")
    text = lambda: f"# Head {draw.choice('pqrs')}eck\n\n" + " ".join(f"w{draw.randrange(12)}" for _ in range(14)) + "\n"
    put(root, {f"d{k % 3}/n{k}.md": text() for k in range(14)} | {"d0/pic.svg": "<svg><text>reck reck</text></svg>"})
    kept = Vault(spark, str(root), index=index, buckets=4)
    for step in range(3):
        if step:
            there = sorted(p for p in root.rglob("*.md"))
            for p in draw.sample(there, 2):
                p.unlink()
            left = [p for p in there if p.exists()]
            put(root, {str(p.relative_to(root)): text() for p in draw.sample(left, 2)} | {f"d{step % 3}/new{step}.md": text()})
            kept.update()
        weights, df = kept.index.words()
        fresh = token_weights(kept.frames.scan().where("path not like '%.svg'"))
        assert rows(weights) == rows(fresh) and rows(df) == rows(fresh.groupBy("token").agg(F.count("*").alias("d")))
    plain = Vault(spark, str(root))
    assert rows(weights) == rows(token_weights(plain.frames.scan().where("path not like '%.svg'")))
    assert rows(kept.suggest(n=None)) == rows(plain.suggest(n=None))
    doc = plain.frames.files.where("ext = '.md'").agg(F.min("path")).first()[0]
    assert rows(kept.suggest(doc)) == rows(plain.suggest(doc)) and kept.suggest(doc).count()


def test_counting_twice_changes_nothing(spark, place):
    root, index = place
    kept = Vault(spark, root, None, PATTERNS, index=index, buckets=8)
    before, files = rows(kept.index.words()[1]), stamps(index, "counts")
    kept.index._count([1, 2])
    assert rows(kept.index.words()[1]) == before
    assert {d for d, x in stamps(index, "counts").items() if x != files[d]} == {"bucket=1", "bucket=2"}


def test_another_parser_reads_all_again(spark, place, monkeypatch):
    root, index = place
    kept = Vault(spark, root, None, PATTERNS, index=index, buckets=8)
    monkeypatch.setattr("quillgrid.sources.index.PARSER", V.PARSER + 1)
    assert kept.index.same(V.indexed(spark, root, PATTERNS).select("path", "mtime")).count() == 0


def test_many_touched_files(spark, place, monkeypatch):
    root, _ = place
    monkeypatch.setattr(V, "NAMED", 3)
    now = V.indexed(spark, root, PATTERNS).select("path", "mtime")
    same = now.where("path not like 'engines/%' and path not like 'works/%'").select("path")
    assert {r.path for r in V.touched(spark, root, PATTERNS, now, same).collect()} == {p for p in INDEXED if p.startswith(("engines/", "works/"))}


def test_an_emptied_vault(spark, tmp_path):
    put(tmp_path / "v", {"a.md": "# only one"})
    index = str(tmp_path / "ix")
    Vault(spark, str(tmp_path / "v"), index=index, buckets=2)
    (tmp_path / "v/a.md").write_text("")
    kept = Vault(spark, str(tmp_path / "v"), index=index)
    kept.update()
    assert kept.search("only").count() == 0 and kept.frames.files.count() == 1
    assert KeptIndex(spark, index).buckets == 2

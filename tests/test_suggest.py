"""The best pairs of documents without all pairs of a folder, against all pairs."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import suggest as U

SCHEMA = "path string, sec_no int, line long, heading string, content string, title string, tags array<string>, aliases array<string>"


def vault(spark, seed, n_files, folders, words, numbered=False):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(words)]
    rows, links = [], []
    for k in range(n_files):
        name = "-".join(["note", f"{k:06}"] if numbered else rng.sample(names, rng.choice([1, 2, 3])))
        path = f"{rng.choice(folders)}/{name}{'' if numbered else k}.{rng.choice(['md', 'md', 'txt', 'pdf'])}"
        text = " ".join(rng.choice(["rare%d" % rng.randrange(n_files), "same"]) for _ in range(4))
        rows.append((path, 0, 1, "", f"{text} {text}" if rng.random() < 0.3 else text, "", None, None))
    paths = [r[0] for r in rows]
    links = [tuple(sorted(rng.sample(paths, 2))) for _ in range(n_files // 3)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(links, "a string, b string")


def show(df):
    return [(r.a, r.b, round(r.score, 6), r.dir, list(r.signals)) for r in df.collect()]


@pytest.mark.parametrize("seed, n_files, folders, words, numbered, n", [(1, 60, ["x/a", "x/b", "y"], 9, False, 10), (2, 40, ["x/a"], 4, True, 7), (3, 30, [f"s/{k}" for k in range(40)], 5, False, 25)])
def test_best_pairs_as_all_pairs(spark, seed, n_files, folders, words, numbered, n):
    scan, linked = vault(spark, seed, n_files, folders, words, numbered)
    files = scan.select("path")
    want = show(U.suggest(scan, files, linked=linked, n=None))[:n]
    assert show(U.suggest(scan, files, linked=linked, n=n)) == want


def test_a_large_folder(spark):
    """50,000 files of one folder have over a thousand million pairs."""
    files = spark.range(50_000).select(F.concat(F.lit("big/note-"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".md")).alias("path"))
    scan = files.select("path", F.lit(0).alias("sec_no"), F.lit(1).cast("long").alias("line"), F.lit("").alias("heading"), F.lit("nothing in common").alias("content"), F.lit("").alias("title"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("aliases"))
    got = show(U.suggest(scan, files, n=3))
    assert [x[:3] for x in got] == [("big/note-000000.md", f"big/note-00000{k}.md", 4.0) for k in (1, 2, 3)]


def test_frequent_parts(spark):
    """60,000 files of 20 folders whose parts are all frequent: pairs that share a part are hundreds of millions, which cannot be made in the time given."""
    k = F.col("id")
    name = F.format_string("f%02d/w%02d-v%02d-u%03d-%06d.md", k % 20, k % 7, k % 11, k % 50, k)
    files = spark.range(60_000).select(name.alias("path"))
    scan = files.select("path", F.lit(0).alias("sec_no"), F.lit(1).cast("long").alias("line"), F.lit("").alias("heading"), F.lit("").alias("content"), F.lit("").alias("title"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("aliases"))
    late = threading.Timer(150, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = show(U.suggest(scan, files, n=5))
    finally:
        late.cancel()
    # the best are pairs of files of one folder with the same three parts
    n, seen, rows = 60_000, {}, {}
    for i in range(n):
        for p in (f"w{i % 7:02}", f"v{i % 11:02}", f"u{i % 50:03}"):
            seen[p] = seen.get(p, 0) + 1
        rows.setdefault((i % 20, i % 7, i % 11, i % 50), []).append(f"f{i % 20:02}/w{i % 7:02}-v{i % 11:02}-u{i % 50:03}-{i:06}.md")
    want = []
    for (_, w, v, u), paths in rows.items():
        score = 4 + 1.5 * sum(math.log(n / seen[p]) for p in (f"w{w:02}", f"v{v:02}", f"u{u:03}"))
        want += [(-round(score, 6), a, b) for at, a in enumerate(sorted(paths)) for b in sorted(paths)[at + 1 :]]
    assert [(a, b, s) for a, b, s, *_ in got] == [(a, b, -s) for s, a, b in sorted(want)[:5]]

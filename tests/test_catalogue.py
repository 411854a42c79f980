import math

import pytest

import __spark_entry__ as entry
from quillgrid.plans.catalogue import QUERIES
from quillgrid.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    """Rows with columns by name; nulls and NaN alike, doubles to nine digits."""
    frame = frame[sorted(frame.columns)]
    show = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_plain_text_sections_of_odd_texts(spark, tmp_path):
    """Documents without text, and spaces of other scripts around the first line."""
    import duckdb

    texts = [None, "", "  ", "\n\n", "\t\n ", "\u00a0", " \u00a0first\u3000 \nsecond", "\tone\t", "one\r\ntwo\u2003", "é" * 70 + "\nx\n", "a\n\nb", "\n".join("line" for _ in range(40))]
    rows = [(k, t, "en" if k % 2 else None, "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["plain_text_sections"](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert len(got) == len(texts) and rows_of(got) == rows_of(c.execute(ORACLES["plain_text_sections"]).fetchdf())


def rows_of(frame):
    """``rows`` with whole numbers that a frame with nulls holds as doubles."""
    return rows(frame.assign(n_chars=frame["n_chars"].astype("float64")))


def test_close_names_as_difflib(spark):
    import difflib
    import random

    from quillgrid.operators.edits import close_names

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeilnorstz-é") for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])))
    names = sorted({word() for _ in range(300)} | {"plan", "abcd", "logs", "index", "test", "ghost", "log"})
    labels = {"paln", "abc", "ghast", "idnex", "tets", "abxcd", "log", "zzzzqq"}
    for name in names[::4]:
        k = rng.randrange(len(name) + 1)
        labels.add(rng.choice([name[:k] + rng.choice("xyé") + name[k:], name[:k] + name[k + 1 :] or "x", name[::-1]]))
    known = spark.createDataFrame([(x,) for x in [*names, None]], "name string")
    got = {}
    for r in close_names(spark.createDataFrame([(x,) for x in labels], "label string"), known).collect():
        got.setdefault(r.label, []).append((r.ratio, r.candidate))
    for label in labels:
        assert [c for _, c in sorted(got.get(label, []), reverse=True)] == difflib.get_close_matches(label, names, n=3, cutoff=0.6), label


def test_close_names_of_a_series(spark, monkeypatch):
    """A label shares the letters of a fifth of all names; only those whose digits and their order can come up to the third best are compared."""
    import difflib

    from quillgrid.operators import closeness

    words = ["large ring", "old plate", "blue rod", "hot bolt", "new anvil"]
    names = [f"{words[k % 5]}-{k * 7919 % 100_000}" for k in range(3_000)]
    chunk, compared = closeness.Chunk(names), []

    class Counted(difflib.SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    labels = [x[:2] + x[3:] for x in names[::100]]
    want = {x: [(difflib.SequenceMatcher(None, c, x).ratio(), c) for c in difflib.get_close_matches(x, names)] for x in labels}
    monkeypatch.setattr(closeness.difflib, "SequenceMatcher", Counted)
    rest, digits = closeness.split(closeness.counts(labels))
    for k, label in enumerate(labels):
        best = []
        chunk.search(label, digits[k], int(rest[k].sum()), closeness.common(chunk.letters, rest[k]), best, 3, 0.6)
        assert best == want[label]
    assert len(compared) <= 30 * len(labels)


def test_close_names_in_chunks(spark, monkeypatch):
    """Labels in blocks, names in many chunks: as all pairs, with names that no first chunk has."""
    import difflib

    from quillgrid.operators import edits

    monkeypatch.setattr(edits, "BLOCK", 20)
    monkeypatch.setattr(edits, "CHUNK", 40)
    monkeypatch.setattr(edits, "HOMES", 1)
    names = sorted({f"{w}{k % 37}{e}" for k in range(150) for w, e in (("note-", ""), ("Note ", "é"), ("", "-etons"), ("plan", "x" * (k % 5)))} | {"", "a", "1", "x" * 100, "y" * 80 + "note-1"})
    labels = [*names[::9], "not-12", "1-note", "plaan7x", "étons-3", "zzz", "x" * 97, "12", "y" * 79 + "note-1"]
    got = {}
    for r in edits.close_names(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in names], "name string")).collect():
        got.setdefault(r.label, []).append((r.ratio, r.candidate))
    for label in labels:
        assert [c for _, c in sorted(got.get(label, []), reverse=True)] == difflib.get_close_matches(label.lower(), names, n=3, cutoff=0.6), label
    nothing = spark.createDataFrame([], "label string")
    assert edits.close_names(nothing, spark.createDataFrame([("a",)], "name string")).count() == 0


def test_fuzzy_link_targets(spark):
    import difflib

    rows = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name").collect()
    names = [f"{r.p_name.lower()}-{r.p_partkey}" for r in rows]
    got = {}
    for r in QUERIES["fuzzy_link_targets"](spark, SF).collect():
        got.setdefault(r.label, []).append(r.candidate)
    want = {x[:2] + x[3:] for x, r in zip(names, rows) if r.p_partkey % 100 == 0}
    assert set(got) == want and all(set(got[x]) == set(difflib.get_close_matches(x, names, n=3, cutoff=0.6)) for x in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_global_rank(spark):
    from pyspark.sql import functions as F

    from quillgrid.functions.tables import global_rank

    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = [r.k for r in global_rank(df, "r", F.col("k")).orderBy("r").collect()]
    assert got == sorted(got) and len(set(got)) == 1000
    assert global_rank(df.where("false"), "r", F.col("k")).count() == 0

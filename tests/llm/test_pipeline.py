import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from quillgrid.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].astype(got[cols].dtypes.to_dict()).itertuples(index=False, name=None)))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(out := str(tmp_path / str(k)))
        docs = spark.read.parquet(out)
        counts.append(docs.count())
        if name != "mix_sources":
            assert docs.columns == columns and counts[-1] <= counts[-2]
    assert counts[1] >= 0.97 * counts[0] and counts[2] < counts[1] and counts[4] < counts[3]
    before = spark.read.parquet(str(tmp_path / "1"))
    squeezed = F.regexp_replace("text", "[ \t\n\x0b\x0c\r]", "")
    assert before.select(squeezed.alias("s")).distinct().count() == before.count() == spark.read.parquet(str(tmp_path / "0")).select(squeezed.alias("s")).distinct().count()


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    rows = [(k, f"The quiet number {k} " + " ".join(f"word{k * 31 + j}" for j in range(40)), "en", "s", 1) for k in range(50)]
    clean = spark.createDataFrame(rows, docs.schema)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, clean, SF).count() == 50
        assert stage(spark, clean.where("false"), SF).count() == 0


def test_rows_without_or_with_a_shared_id(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text")), "text").first().text
    text = lambda k: f"The quiet number {k} " + " ".join(f"word{k * 31 + j}" for j in range(40))
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    left = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, make(rows), SF).collect()), key=str)
    plain = [(k, text(k)) for k in range(10, 40)]
    assert left(P.language_id, [*plain, (None, "123"), (1, "456"), (1, text(1)), (None, text(2))]) == sorted([*plain, (1, text(1)), (None, text(2))], key=str)
    copies = [(1, text(1)), (1, text(1)), (None, text(1)), (2, text(2)), (2, text(10)), (None, text(3)), (None, text(3))]
    assert left(P.exact_dedup, [*plain, *copies]) == sorted([*plain, (1, text(1)), (2, text(2)), (None, text(3))], key=str)
    near = [(None, text(10) + " end"), (3, text(11) + " end"), (3, text(3)), (None, text(4))]
    assert left(P.near_dedup, [*plain, *near]) == sorted([*plain, (3, text(3)), (None, text(4))], key=str)
    assert left(P.decontaminate, [*plain, (None, item), (4, item), (4, text(4))]) == sorted([*plain, (4, text(4))], key=str)


def test_columns_named_like_the_stages_own(spark, tmp_path):
    """Extra columns of any name pass through every stage."""
    names = "__key __rate __u __n __steps __source row name of rate u n mixed shared_id copy_no".split()
    rows = [(k, f"the house number {k} stands on a hill by the old sea and nobody lives there", "en", "s", 9, *range(len(names))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    spark.createDataFrame([(1, "something else entirely")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in P.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) - {"copy_no"} <= set(found.columns), name
        got = found.where("doc_id = 3").collect()
        assert all(r["__key"] == 0 and r["__rate"] == 1 and r["mixed"] == names.index("mixed") for r in got), name

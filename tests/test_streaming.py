from pyspark.sql import functions as F

from quillgrid.streaming.ingest import compact, current, event_counts, file_stream, sweep, upsert


def test_upsert_is_idempotent(spark, tmp_path):
    root, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    root.mkdir()
    (root / "a.md").write_text("one")
    assert current(spark, target, "path", "mtime") is None
    for text in ("two", "three"):
        (root / f"{text}.md").write_text(text)
        q = upsert(file_stream(spark, str(root)), target, state, "path", "mtime")
        q.awaitTermination()
    got = {r.path.rsplit("/", 1)[-1]: r.sha for r in current(spark, target, "path", "mtime").collect()}
    assert set(got) == {"a.md", "two.md", "three.md"}


def test_sweep_replay_and_parser_versions(spark, tmp_path):
    root, target, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    root.mkdir()
    names = lambda **k: sorted(r.path.rsplit("/", 1)[-1] for r in current(spark, target, "path", "mtime", **k).collect())
    listing = lambda: spark.read.format("binaryFile").load(str(root)).select("path")
    run = lambda **k: upsert(file_stream(spark, str(root)), target, str(state), "path", "mtime", **k).awaitTermination()
    assert sweep(spark, target, spark.createDataFrame([], "path string"), "path", "mtime") == 0
    for name in "abc":
        (root / name).write_text(name)
        run()
    for gone, left in (("a", ["b", "c"]), ("b", ["c"])):
        (root / gone).unlink()
        assert sweep(spark, target, listing(), "path", "mtime") == 1 and names() == left and sweep(spark, target, listing(), "path", "mtime") == 0
    (root / "d").write_text("d")
    run()
    assert names() == ["c", "d"]
    for f in (state / "commits").glob("*3*"):  # the last batch was written but never committed: it comes again
        f.unlink()
    run()
    assert names() == ["c", "d"]
    run(parser=2)
    assert names(parser=2) == ["c", "d"]


def test_a_batch_writes_what_changed(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = StructType([StructField("k", StringType()), StructField("at", LongType()), StructField("v", StringType())])
    want, first = {}, {f"k{i:04}": (1, "x" * 50 + str(i)) for i in range(3000)}

    def send(rows):
        spark.createDataFrame([(k, at, v) for k, at, v in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
        upsert(spark.readStream.schema(schema).parquet(str(source)), target, state, "k", "at").awaitTermination()
        for k, at, v in rows:
            if k not in want or at >= want[k][0]:
                want[k] = (at, v)

    table = lambda: {r.k: (r.at, r.v) for r in current(spark, target, "k", "at").collect()}
    weigh = lambda: {d.name: sum(f.stat().st_size for f in d.glob("*.parquet")) for d in (tmp_path / "out").iterdir()}
    send([(k, at, v) for k, (at, v) in first.items()])
    whole = sum(weigh().values())
    send([("k0001", 2, "new"), ("k0002", 0, "late"), ("n", 1, "one"), ("n", 3, "three"), ("n", 2, "two")])
    compact(spark, target, "k", "at")
    before = weigh()
    send([("k0003", 9, "again"), (None, 1, "null")])
    assert table() == want and sum(n for name, n in weigh().items() if name not in before) < whole / 10
    there = spark.createDataFrame([(k,) for k in want if k and k not in ("k0005", "n")], "k string")
    assert sweep(spark, target, there, "k", "at") == 3  # a null key is in no listing
    for k in ("k0005", "n", None):
        del want[k]
    assert table() == want
    send([("n", 1, "back")])  # older than what was deleted
    send([("k0004", 1, "as old, but later")])
    assert table() == want and want["n"] == (1, "back")
    compact(spark, target, "k", "at")
    assert table() == want
    compact(spark, target, "k", "at")
    assert table() == want and len([x for x in weigh() if x.endswith("b")]) == 2


def test_event_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = event_counts(events).agg(F.sum("n")).first()[0]
    assert got == events.count()

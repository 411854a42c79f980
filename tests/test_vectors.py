import numpy as np
import pytest

from quillgrid.operators.search import semantic_hits
from quillgrid.operators.vectors import ODD, GroupedVectors

SCHEMA = "path string, vec array<float>"


def hits(df):
    return [(r.path, r.cosine) for r in df.collect()]


def test_grouped_search_as_a_full_scan(spark, tmp_path):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8))
    close = [(f"c{k}-{i:03}", (centers[k] * rng.uniform(0.5, 3) + rng.normal(size=8) * 0.05).tolist()) for k in range(12) for i in range(40)]
    odd = [("zero", [0.0] * 8), ("short", [1.0, 2.0]), ("none", None), ("hole", [1.0, None, *[0.0] * 6]), ("twin-a", close[3][1]), ("twin-b", close[3][1]), ("huge", [3e38] * 8)]
    table = spark.createDataFrame([*close, *odd], SCHEMA).cache()
    kept = GroupedVectors(spark, str(tmp_path / "v")).create(table, groups=12)
    for query, n in ((centers[0], 5), (close[3][1], 3), (centers[4] + centers[5], 60), (-centers[1], 7), ([1.0, 1.0], 2), ([0.0] * 8, 4)):
        query = [float(x) for x in query]
        assert hits(kept.search(query, n)) == hits(semantic_hits(table, query, n)), n
    read = kept.needed([float(x) for x in centers[0]], 5)
    assert ODD in {r["part"] for r in read} and sum(r["n"] for r in read) < 100
    with pytest.raises(ValueError):
        kept.create(table)
    more = spark.createDataFrame([("new", (-centers[1]).tolist()), ("off", [9.0])], SCHEMA)
    kept.add(more)
    for query in (-centers[1], centers[2]):
        query = [float(x) for x in query]
        assert hits(kept.search(query, 4)) == hits(semantic_hits(table.union(more), query, 4))


def test_grouped_search_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert hits(GroupedVectors(spark, str(tmp_path / "a")).create(none).search([1.0, 2.0], 3)) == []
    odd = spark.createDataFrame([("z", [0.0, 0.0]), ("n", None)], SCHEMA)
    kept = GroupedVectors(spark, str(tmp_path / "b")).create(odd)
    assert hits(kept.search([1.0, 2.0], 3)) == [("z", 0.0)]

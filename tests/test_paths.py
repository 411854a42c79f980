import random
from itertools import product

from quillgrid.operators.links import shortest_path


def ways(pairs, a, b):
    """All shortest ways, by brute force."""
    level, seen = [[a]], {a}
    while level:
        found = [w for w in level if w[-1] == b]
        if found:
            return found
        level = [[*w, y] for w in level for x, y in pairs if x == w[-1] and y not in seen]
        seen |= {w[-1] for w in level}
    return []


def test_shortest_path_as_brute_force(spark):
    rng = random.Random(3)
    nodes = "abcdefghijkl"
    one = {tuple(rng.sample(nodes, 2)) for _ in range(14)}
    both = sorted(one | {(y, x) for x, y in one})
    table = spark.createDataFrame([*both, *both[:3]], "a string, b string").cache()
    lengths = set()
    for a, b in list(product(nodes, nodes))[::19]:
        want = min(ways(both, a, b), default=[])
        assert shortest_path(table, a, b) == want, (a, b)
        lengths.add(len(want))
    assert len(lengths) >= 3


def test_shortest_path_of_odd_graphs(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert shortest_path(none, "x", "y") == [] and shortest_path(none, "x", "x") == ["x"]
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(9)]
    table = spark.createDataFrame([*chain, *((y, x) for x, y in chain), (None, "n00"), ("n00", "n00")], "a string, b string")
    assert shortest_path(table, "n00", "n09") == [f"n{k:02}" for k in range(10)]
    assert shortest_path(table, "n03", "gone") == []

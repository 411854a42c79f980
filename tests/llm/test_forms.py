import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgrid.llm import fim, sharding, whitening

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
EXTRA = ", x string, n int, form string, row long, shard int, hub string, component int, h1 long"


def extra(rows):
    return [(*r, "a", 1, "b", 2, 3, "c", 4, 5) for r in rows]


# whitening


def vectors(seed=3, n=300, d=20):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * 0.2
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(mixed)]
    return rows + [(1000 + k, rows[0][1]) for k in range(100)] + [(7, rows[7][1]), (None, rows[8][1])]


BAD = [(900, None), (901, []), (902, [None] * 20), (903, [float("nan")] + [0.0] * 19), (904, [float("inf")] + [0.0] * 19), (905, [1e30] * 20), (906, [1.0, 2.0])]


def brute_whitening(rows):
    xs = {i: tuple(int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v) for i, v in rows}
    fit = np.array(sorted(set(xs.values())), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in fit])
    e, c = np.linalg.eigh(y.T @ y / n)
    e, c = e[::-1], c[:, ::-1]
    out = {}
    for i, x in xs.items():
        z = np.array([float(n * a - s) / n for a, s in zip(x, sums)]) @ c / np.sqrt(e)
        out[i] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), z, e / e.sum())
    return out


def test_whitening_as_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(extra(rows + BAD), "vec_id long, embedding array<float>" + EXTRA)
    got = whitening.whitened_embeddings(df).collect()
    want = brute_whitening(rows)
    assert Counter(r.vec_id for r in got) == {i: 16 * m for i, m in Counter(i for i, _ in rows).items()}
    assert all(r.identity_error < 1e-9 for r in got) and {r.component for r in got} == set(range(1, 17))
    signs = {r.component: np.sign(r.whitened * want[0][2][r.component - 1]) for r in got if r.vec_id == 0}
    for r in got:
        n, deviation, z, share = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(signs[r.component] * z[r.component - 1], abs=1e-8) and r.explained == pytest.approx(share[r.component - 1], rel=1e-9)


def test_whitening_edge_cases(spark):
    run = lambda rows: whitening.whitened_embeddings(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    assert run([]) == [] and run([("a", None)]) == []
    assert run([("a", [1.0, 2.0]), ("b", [1.0, 2.0])]) == []  # no variance
    line = run([("a", [1.0, 2.0]), ("b", [2.0, 4.0]), ("c", [3.0, 6.0])])  # rank one
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1.0)
    assert len(run([("a", [0.0]), ("b", [9.0]), (None, [9.0])])) == 3
    far = run([("a", [2.0**49, 0.0]), ("b", [-(2.0**49), 1.0])])
    assert {r.deviation for r in far} == {None} and far[0].identity_error < 1e-4


def test_eigenpairs_of_equal_and_split_matrices():
    rng = np.random.default_rng(0)
    for values in ([3.0] * 9, [5.0, 5.0, 5.0, 1.0, 1.0, 0.5], [2.0, 2.0 - 1e-9, 1.0, 0.0], [1.0]):
        q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
        a = (q * values) @ q.T
        e, c = whitening.eigenpairs((a + a.T) / 2, 16)
        assert np.allclose(e, [v for v in values if v > 0], atol=1e-12)
        assert np.abs(c @ c.T - np.eye(len(e))).max() < 1e-12 and np.abs(a @ c.T - c.T * e).max() < 1e-12


def test_counts_of_sturm():
    d, b = np.array([2.0, 2.0, 2.0, 2.0]), np.array([1.0, 0.0, 1.0])  # 1, 1, 3, 3
    assert whitening.count_below(d, b, np.array([0.5, 2.0, 3.5])).tolist() == [0, 2, 4]


# sharding


def sharded(spark, rows, links=None, **options):
    df = spark.createDataFrame(extra(rows), "doc_id long, text string" + EXTRA)
    return sharding.balanced_shards(df, links, **options).collect()


def check_shards(rows, got, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r.shard for r in got)
    assert all(sizes[s] == len(rows) // shards + (s < len(rows) % shards) for s in range(shards))
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert {r.law for r in got} <= {"rows"} and all(r.grown_shard is None for r in got)


def brute_cut(groups):
    """Pairs of neighbours in different shards, each pair formed."""
    return sum(a != b for g in groups.values() for k, a in enumerate(g) for b in g[:k])


def test_shards_are_even_and_keep_groups_whole(spark):
    rng = random.Random(1)
    rows = [(k, f"own {k}") for k in range(400)]
    for g in range(60):
        rows += [(len(rows) + k, f"group {g}") for k in range(rng.choice([2, 3, 8]))]
    rng.shuffle(rows)
    got = sharded(spark, rows)
    check_shards(rows, got)
    text, groups = dict(rows), defaultdict(list)
    for r in got:
        groups[text[r.doc_id]].append(r.shard)
    assert brute_cut(groups) == 0
    again = sharding.balanced_shards(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_when_every_document_is_linked(spark):
    rows = [(k, f"pair {k // 2}") for k in range(800)]
    got = sharded(spark, rows)
    check_shards(rows, got)
    groups = defaultdict(list)
    for r in got:
        groups[r.doc_id // 2].append(r.shard)
    assert brute_cut(groups) < 40  # of 400 links; dealt at random 350 are cut


def test_shards_of_a_group_larger_than_a_shard(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"t{k}") for k in range(900)]
    got = sharded(spark, rows)
    check_shards(rows, got)
    held = Counter(r.shard for r in got if r.doc_id % 3 == 0)
    assert len(held) == 3 and min(sorted(held.values())[1:]) >= 111  # of 112 or 113 that a shard takes


def test_shards_by_given_links(spark):
    """Two cliques joined by one link, given as hubs; the string ids of hubs are anything."""
    rows = [(k, f"t{k}") for k in range(64)]
    links = [(k, "a" if k % 2 else "b") for k in range(16)] + [(0, "bridge"), (1, "bridge"), (5, None), (999, "a"), (None, "b")]
    got = sharded(spark, rows, spark.createDataFrame(links, "doc_id long, hub string"))
    check_shards(rows, got)
    shard = {r.doc_id: r.shard for r in got}
    assert len({shard[k] for k in range(0, 16, 2)}) == 1 and len({shard[k] for k in range(1, 16, 2)}) == 1
    members = spark.createDataFrame([(h, shard[i]) for i, h in links if i in shard and h], "hub string, shard int")
    assert tuple(sharding.cut_links(members).first()) == (57, int(shard[0] != shard[1]))


def test_shard_edge_cases(spark):
    assert sharded(spark, []) == []
    for rows in ([(1, None)], [(None, None), (None, ""), (2, "a"), (2, "a"), (2, "b"), (3, "é" * 100_000)], [(5, "same")] * 20):
        check_shards(rows, sharded(spark, rows))
    check_shards([(k, "x") for k in range(10)], sharded(spark, [(k, "x") for k in range(10)], shards=3), shards=3)


def test_quotas_never_overfill():
    rng = random.Random(2)
    for _ in range(200):
        k = rng.randint(2, 6)
        most = [rng.randint(5, 30) for _ in range(k)]
        sizes = [rng.randint(0, m) for m in most]
        wishes = {(i, j): rng.randint(1, max(sizes[i], 1)) for i in range(k) for j in range(k) if i != j and sizes[i] and rng.random() < 0.7}
        for swaps in (True, False):
            found = sharding.quotas(wishes, sizes, most, swaps)
            after = [sizes[s] + sum(n for (i, j), n in found.items() if j == s) - sum(n for (i, j), n in found.items() if i == s and swaps) for s in range(k)]
            assert all(a <= m for a, m in zip(after, most)) and all(0 < n <= wishes[w] for w, n in found.items())


# fill in the middle


def brute_fim(i, text):
    text = text or ""
    units = UNIT.findall(text)
    n, x = len(units), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    rng = random.Random(4)
    some = ["word", "über", "a b", " ", "<", "P>", "𝔘", "\x1c", "ab\x00c"]
    rows = [(k, "".join(rng.choice([" ", "\n", "\t ", "\r\n", "", " "]) + rng.choice(some) for _ in range(rng.randint(0, 60))) + rng.choice(["", " ", "\n\n"])) for k in range(200)]
    rows += [(k, rng.choice(["<P>", "x <S> y", "<M> z"])) for k in range(200, 220)]
    rows += [(k, f"row {k % 3} again") for k in range(300, 320)] * 3 + [(None, "no id at all here")] * 2 + [(None, None), (400, None), (401, ""), (402, " \n")]
    return rows + [(k, "long " * 9_000) for k in range(500, 508)] + [(k, "x" * 200_001) for k in range(508, 516)]


@pytest.mark.parametrize("rules", [fim.Rules(), fim.Rules(chunk_units=3, chunk_chars=4)])
def test_fim_as_brute_force(spark, rules):
    rows = fim_rows() if rules.chunk_units > 3 else [r for r in fim_rows() if len(r[1] or "") < 1000]
    df = spark.createDataFrame(extra(rows), "doc_id long, text string" + EXTRA).repartition(5)
    got = Counter(tuple(r) for r in fim.fim_texts(df, rules).collect())
    assert got == Counter((i, *brute_fim(i, t)) for i, t in rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    digests = Counter(tuple(r) for r in fim.fim_digests(df, rules).collect())
    assert digests == Counter((i, *brute_fim(i, t)[:4], sha(brute_fim(i, t)[4]), sha(t)) for i, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}


def test_fim_restores(spark):
    rows = fim_rows()
    texts = {(i, t or "") for i, t in rows}
    assert {(r.doc_id, fim.restore(r.output, r.form)) for r in fim.fim_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == texts


def test_fim_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert fim.fim_texts(empty).collect() == [] and fim.fim_digests(empty).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    named = fim.fim_texts(spark.createDataFrame([("a", "one two"), ("b", "three")], "key string, body string"), fim.Rules(percent=100, suffix_first=0), id_col="key", text_col="body").collect()
    assert {r.key for r in named} == {"a", "b"} and {r.form for r in named} == {"psm"}


def test_fim_sorts_again_without_a_shuffle(spark):
    """The pieces of the second sort are where the first one brought them."""
    records = fim._emit(spark.createDataFrame([(k, "a b c d") for k in range(40)], "doc_id long, text string"), fim.Rules(), str)
    first = fim._sorted(records, 4).mapPartitions(fim._read_back, preservesPartitioning=True)
    assert fim._sorted(first, 4).toDebugString().count(b"ShuffledRDD") + fim._sorted(first, 4).toDebugString().count(b"PartitionerAwareUnion") <= 1
    assert first.partitioner == fim._sorted(first, 4).partitioner



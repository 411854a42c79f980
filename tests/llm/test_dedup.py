import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import fuse_filter
from quillgrid.llm.common import checkpoint_dir
from quillgrid.llm.components import components
from quillgrid.llm.decontaminate import contamination
from quillgrid.llm.exact_dedup import exact_duplicates
from quillgrid.llm.line_dedup import drop_repeated_lines
from quillgrid.llm.near_dup import near_duplicates
from quillgrid.llm.shingles import shingle_sets
from quillgrid.llm.substring_dedup import LONG, drop_repeated_spans, pieces

SCHEMA = "doc_id long, text string, kept int, n int, h1 string, hash string, Version string"


def docs(spark, rows):
    """Documents with extra columns of names that operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", "z") for i, t in rows], SCHEMA)


def word_sets(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(rows, k, percent=80):
    sets = {i: word_sets(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def near_corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.choice([1, 2, 8])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 9))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((i, " ".join(own)))
            i += 1
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_as_brute_force(spark, k):
    rows = near_corpus() + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "a b"), (906, "É b"), (907, "é b"), (908, "long " * 5000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(spark, rows), words=k).collect()}
    assert got == brute_components(rows, k)


def test_chain_without_a_common_centre(spark):
    """a ~ b ~ c in one bucket although a and c are not linked: the star around a alone would lose c."""
    base = [f"x{k}" for k in range(100)]
    rows = [(k, " ".join(base[4 * k :] + [f"y{j}" for j in range(4 * k)])) for k in range(12)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows), words=1).collect()}
    assert got == {i: c for i, (_, c, _) in brute_components(rows, 1).items()} and set(got.values()) == {0}


def test_near_edge_cases(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    same = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B c d e f")]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(docs(spark, same)).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_shingles_split_like_bytes():
    texts = ["a  b\u00a0c\x0bd", None, "", "A b", "x" * 3000 + " y"]
    got = list(shingle_sets(pa.array(texts), 2))
    assert [len(g) for g in got] == [len(word_sets(t, 2)) for t in texts]
    assert got[3].tolist() == next(shingle_sets(pa.array(["a\n B"]), 2)).tolist()


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(200, 260)] + [(300, 300), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in [100, *range(200, 260)]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tables_that_are_done_with_are_deleted(spark):
    """Of the tables an operator writes only those stay that its result reads."""
    kept = lambda: set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))
    rows = docs(spark, near_corpus()).cache()
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    items = spark.createDataFrame([(1, near_corpus()[40][1])], "item_id long, text string")
    makers = {"near": lambda: near_duplicates(rows, words=2), "exact": lambda: exact_duplicates(rows), "components": lambda: components(chain), "leaks": lambda: contamination(rows, items)}
    left, sizes = {}, {}
    for name, make in makers.items():
        before = kept()
        made = make()
        left[name] = len(kept() - before)
        sizes[name] = made.count()
    assert left == {"near": 2, "exact": 2, "components": 1, "leaks": 1} and sizes == {"near": rows.count(), "exact": rows.count(), "components": 41, "leaks": rows.count()}


@pytest.mark.parametrize("n", [0, 1, 3, 100, 20_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    built = fuse_filter.build(keys)
    assert fuse_filter.contains(built, keys).all()
    others = rng.integers(1 << 62, 1 << 63, 50_000).astype(np.uint64)
    assert fuse_filter.contains(built, others).mean() < 0.01


def test_exact_duplicates(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, "é"), (7, "e\u0301"), (8, "a b"), (9, " \n"), (10, "z" * 9000)]
    rows += [(k, f"copy {k % 3}") for k in range(20, 60)]

    def brute():
        groups = {}
        for i, t in rows:
            groups.setdefault(re.sub("[ \t\n\x0b\x0c\r]", "", t or ""), []).append((-len(t or ""), i))
        out = {}
        for key, own in groups.items():
            for _, i in own:
                out[i] = (min(own)[1], len(own), min(own)[1] == i, hashlib.sha256(key.encode()).hexdigest())
        return out

    for snapshot in (None, F.col("doc_id") < 30, F.lit(False), F.lit(True)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(docs(spark, rows), snapshot=snapshot, filter_keys=4).collect()}
        assert got == brute()
    assert exact_duplicates(docs(spark, [])).count() == 0
    odd = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs(spark, [(None, "q"), (3, "q"), (3, "q")])).collect())
    assert odd == [(-1, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True)]


def test_line_dedup(spark):
    hot, short = "this line is shared by very many documents", "too short"
    rows = [(k, f"own {k}\n  {hot.upper() if k % 2 else hot}\t\n{short}\n{hot}") for k in range(6)] + [(10, None), (11, ""), (12, hot[:-1]), (13, "x\n\n")]
    got = {r.doc_id: r for r in drop_repeated_lines(docs(spark, rows)).collect()}
    assert got[0].text == f"own 0\n{short}" and got[0].n_dropped == 2 and got[0].n_lines == 4
    assert got[5].text == rows[5][1] and got[5].n_dropped == 0
    assert (got[10].text, got[10].n_lines) == ("", 1) and got[12].n_dropped == 0 and got[13].text == "x\n\n" and got[13].n_lines == 3
    only = {r.doc_id: r.text for r in drop_repeated_lines(docs(spark, [(k, hot) for k in range(5)])).collect()}
    assert only == {0: "", 1: "", 2: "", 3: "", 4: hot}
    assert drop_repeated_lines(docs(spark, [])).count() == 0
    nulls = drop_repeated_lines(docs(spark, [(None, hot)] * 2 + [(k, hot) for k in range(4)])).collect()  # five documents: the two null rows are one
    assert [r.doc_id for r in nulls if r.text == hot] == [3]


def cut_up(text):
    """The pieces of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    begin = [*pieces(data, np.array([0, len(data)])).begin.tolist(), len(data)]
    return [data[a:b].tobytes().decode() for a, b in zip(begin, begin[1:])]


def brute_spans(rows, least):
    """Every run of pieces, checked one by one: how many pieces each text loses."""
    seen, gone = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        parts = [p.lower().split() for p in cut_up(text)]
        n = [len(p) for p in parts]
        runs = set()
        for a in range(len(n)):
            for b in range(a + 2, len(n) + 1):
                short = lambda x, y: y - x < 2 or sum(n[x:y]) < least
                if sum(n[a:b]) >= least and (short(a, b - 1) or short(a + 1, b)):
                    runs.add((a, b))
        lost = set()
        for a, b in sorted(runs):
            key = tuple(w for p in parts[a:b] for w in p)
            if key in seen:
                lost |= set(range(a, b))
            seen.add(key)
        gone[i] = len(lost)
    return gone


def test_sentence_pieces():
    assert cut_up(None) == cut_up(" \n\t") == []
    assert cut_up(" One two. Three!\n\nfour\nfive? 漢字。漢！x") == [" One two. ", "Three!\n\n", "four\n", "five? ", "漢字。", "漢！", "x"]
    rng = random.Random(5)
    for words in (400, 3000):
        text = " ".join(f"é{rng.randrange(300)}" for _ in range(words))
        parts = cut_up(text)
        assert "".join(parts) == text and len(parts) > words / 32 and max(len(p.split()) for p in parts) <= 2 * LONG
        middle = text.split()[100:200]
        other = cut_up("some other words before " + " ".join(middle) + " and after them")
        assert len(set(parts) & set(other)) >= len(other) - 4  # the same cuts, whatever is around them
    same = cut_up("again " * 5000)
    assert max(len(p.split()) for p in same) <= 2 * LONG and "".join(same) == "again " * 5000
    texts = ["a b. c", "", "\n", "d. e f", "g " * 40]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found = pieces(data, np.cumsum([0, *map(len, texts)]))
    assert np.diff(found.head).tolist() == [len(cut_up(t)) for t in texts] and found.text.tolist() == sorted(found.text.tolist())


def test_repeated_passages(spark):
    """Passages of over 50 words with ends inside sentences go, on made-up documents and on whole tables; what stays of them is short."""
    rng = random.Random(11)
    say = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    shared = [f"{say(14)}, {say(20)}. {say(9)}! {say(12)}" for _ in range(40)]
    rows = [(k, f"{say(30)} {shared[k % 40]} {say(25)}. {say(18)}.") for k in range(120)]
    got = {r.doc_id: r for r in drop_repeated_spans(docs(spark, rows)).collect()}
    assert all(got[k].text == rows[k][1] for k in range(40))
    assert all(got[k].n_removed and len(set(got[k].text.split()) & set(shared[k % 40].split())) <= 30 for k in range(40, 120))
    long = " ".join(say(40) for _ in range(2000))  # 80,000 words without an end, twice
    twice = drop_repeated_spans(docs(spark, [(1, long), (2, "x " + long)])).collect()
    assert [len(r.text.split()) < 40 for r in sorted(twice, key=lambda r: r.doc_id)] == [False, True]

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    left = {r.doc_id: r for r in drop_repeated_spans(docs(spark, [tuple(r) for r in table])).collect()}
    assert {i: r.n_removed for i, r in left.items()} == brute_spans([tuple(r) for r in table if len(r.text or "") < 20000], 30) | {r.doc_id: left[r.doc_id].n_removed for r in table if len(r.text or "") >= 20000}


def test_substring_dedup(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n)) + "."
    passage = " ".join(say(n) for n in (9, 14, 22, 11))
    one = say(55)
    rows = [(k, f"{say(12)} {say(9)}\n{passage if k % 2 else one} {say(30)}") for k in range(8)]
    rows += [(20, None), (21, ""), (22, passage), (23, f"{say(5)} {passage} {passage}"), (24, say(12)), (25, "no end at all")]
    got = {r.doc_id: r for r in drop_repeated_spans(docs(spark, rows)).collect()}
    assert {i: r.n_removed for i, r in got.items()} == brute_spans(rows, 30)
    assert passage in got[1].text and passage[:40] not in got[3].text and one not in got[2].text and one in got[0].text
    assert got[22].text == "" and got[24].text == rows[-2][1] and got[25].text == "no end at all" and got[20].text == ""
    assert drop_repeated_spans(docs(spark, [])).count() == 0
    twice = drop_repeated_spans(docs(spark, [(1, one), (1, one), (None, one)])).collect()
    assert sorted(r.text for r in twice) == ["", "", one]

"""The log under edits, notes in search, and what a search shows."""

import json
import pathlib

import pytest

from quillgrid.operators import semlog as G
from quillgrid.plans.vault import Vault
from test_vault import put

FILES = {
    "a/one.md": "# One\n\n" + "\n".join(f"line {k} of kestrel" if k % 7 == 0 else f"line {k}" for k in range(30)) + "\n",
    "a/two.md": "# Two\n\nkestrel and heron\nafter it\n[one](one.md)\n",
    "b/three.md": "# Three\n\nheron [[one]]\n\n## Related\n\n- [[two]]\n",
    "b/four.md": "# Four\n\nkestrel kestrel heron\n",
    "b/five.md": "# Five\n\nheron\n",
}


@pytest.fixture
def vault(spark, tmp_path):
    put(tmp_path / "v", FILES)
    (tmp_path / "log").mkdir()
    return Vault(spark, str(tmp_path / "v"), str(tmp_path / "log"))


def test_records_keep_every_other_byte(spark):
    tricky = r'a \"src\": \"a.md\" in text, é \u00e9 and $1'
    lines = [
        '{"type":"edge","src":"a.md","score":5,"ok":true,"tags":["a","b"],"dst" : "m.md","rationale":"%s","src_sha":"s1","dst_sha":"old","weight":0.25}' % tricky,
        '{"type": "embed", "dim": 3, "path": "a.md", "sha": "s1", "vec": [1, 2.50, 3e1]}',
        '{"sources": [ {"path":"a.md","sha":"s1","page":7} , {"sha":"zz","path":"a.md"},{"path":"m.md","sha":"m1"}], "type":"note", "question":"sources?", "insight":"[\\"x\\"]"}',
        '{"type":"future","path":"a.md","sha":"s1"}', "not json", '{"type":"embed","path":"m.md","sha":"m1"}',
    ]
    log = G.typed(spark.createDataFrame([(f"{k}", x) for k, x in enumerate(lines)], "line string, raw string"))
    rewritten = spark.createDataFrame([("a.md", 'z "q"/$a.md', "s1", "s2"), ("m.md", "m.md", "m1", "m2")], "was string, path string, old_sha string, new_sha string")
    got = {int(r.line): r.raw for r in G.carried(log, rewritten, "a.md", 'z "q"/$a.md').collect()}
    new = r'"z \"q\"/$a.md"'
    assert got[0] == lines[0].replace('"src":"a.md"', '"src":"m.md"').replace('"dst" : "m.md"', f'"dst" : {new}').replace('"src_sha":"s1","dst_sha":"old"', '"src_sha":"old","dst_sha":"s2"')
    assert got[1] == lines[1].replace('"a.md"', new).replace('"s1"', '"s2"')
    assert got[2] == lines[2].replace('"a.md"', new).replace('"s1"', '"s2"').replace('"m1"', '"m2"')
    assert (got[3], got[4]) == (lines[3], lines[4])
    assert got[5] == lines[5].replace("m1", "m2") and all(json.loads(got[k]) for k in (0, 1, 2, 5))
    alone = {int(r.line): r.raw for r in G.carried(log, rewritten.where("was = 'm.md'")).collect()}
    assert alone[1] == lines[1] and alone[2] == lines[2].replace('"m1"', '"m2"') and alone[5] == got[5]


def test_fresh_notes_come_first(vault, spark):
    vault.note_add("where is the kestrel?", "above", ["a/one.md"])
    for k in range(3):
        vault.note_add(f"kestrel again {k}", "elsewhere", ["b/four.md"])
    put(pathlib.Path(vault.root), {"b/four.md": "# Four\n\nchanged kestrel\n"})
    vault.update()
    found = vault.find("kestrel")
    assert [n.insight for n in found["notes"].collect()] == ["above"]
    assert vault.find("type:md")["notes"].count() == 0 and vault.find(["kestrel", "heron"])["notes"].count() == 1


def test_what_a_search_shows(vault):
    rows = {r.path: r for r in vault.find("kestrel")["results"].collect()}
    assert (rows["a/one.md"].place, rows["b/four.md"].place) == (1, 2) and rows["a/one.md"].matched[0].split("\n")[:3] == ["line 0 of kestrel", "line 1", "line 2"]
    assert rows["a/two.md"].matched == ["kestrel and heron\nafter it\n[one](one.md)"]
    compact = {r.path: r.matched for r in vault.find("kestrel", show="compact")["results"].collect()}
    assert compact["a/one.md"] == ["line 0 of kestrel"] and all(len(m) == 1 for m in compact.values())
    full = vault.find("heron", show="full")
    assert {r.path: r.content for r in full["results"].collect()}["b/five.md"] == "heron" and full["partial"] is False
    fused = vault.find(["kestrel heron", "heron nosuch"], n=5)
    last = fused["results"].collect()[-1]
    assert [q["partial"] for q in fused["queries"]] == [False, True] and last.place == 4 and last.matched
    assert {r.path: r.sources for r in fused["results"].collect()}["b/four.md"] == 2
    assert vault.find("type:md")["results"].first().matched == []


def test_added_links_keep_pins_fresh(vault):
    vault.note_add("q", "on three", ["b/three.md"])
    vault.edge_add("a/one.md", "b/three.md", "why")
    got = {r.change: r.n for r in vault.apply(vault.link_add("b/three.md", ["five"])).collect()}
    assert got == {"changed": 1, "unchanged": 4} and "- [[two]]\n- [[five]]\n" in open(f"{vault.root}/b/three.md").read()
    assert vault.notes().first().fresh and vault.edges().first().fresh


def test_a_move_in_place(vault):
    vault.edge_add("a/one.md", "b/three.md", "why")
    vault.embed_set("a/one.md", [1.0])
    got = {r.change: r.n for r in vault.apply(vault.mv("a/one.md", "c/uno.md"), "a/one.md", "c/uno.md").collect()}
    assert got == {"new": 1, "deleted": 1, "changed": 2, "unchanged": 2}
    assert "[one](../c/uno.md)" in open(f"{vault.root}/a/two.md").read() and "[[uno]]" in open(f"{vault.root}/b/three.md").read()
    edge = vault.edges().first()
    assert edge.fresh and (edge.src, edge.dst) == ("b/three.md", "c/uno.md") and [r.path for r in vault.fresh_embeds().collect()] == ["c/uno.md"]


def test_rewriting_never_leaves_the_log_empty(vault, spark, tmp_path, monkeypatch):
    for k in range(3):
        vault.note_add(f"q{k}", "x", [])
    kept = vault.log().where("raw not like '%q1%'").select("line", "raw")
    vault.rewrite_log(kept)
    assert [r.question for r in vault.notes().orderBy("line").collect()] == ["q0", "q2"]
    vault.note_add("q3", "x", [])
    before = G.log_files(spark, vault.log_path)[0]
    assert len(before) == 2 and [r.question for r in vault.notes().orderBy("line").collect()] == ["q0", "q2", "q3"]
    # a crash after the rename, before the old files went: they are passed over
    put(tmp_path / "log", {"20200101T0-x.jsonl": '{"type":"note","question":"old","insight":""}\n'})
    folder = next((tmp_path / "log").glob("rewritten-*"))
    (folder / "_covers").write_text((folder / "_covers").read_text() + "\n20200101T0-x.jsonl")
    (folder / "._covers.crc").unlink(missing_ok=True)
    assert vault.notes().count() == 3
    vault.rewrite_log(vault.log().select("line", "raw"))
    assert vault.notes().count() == 3 and not (tmp_path / "log/20200101T0-x.jsonl").exists() and len(G.log_files(spark, vault.log_path)[0]) == 1

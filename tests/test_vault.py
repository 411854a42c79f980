import json
import pathlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import links as L
from quillgrid.operators import report as R
from quillgrid.operators import semlog as G
from quillgrid.plans.vault import Vault, find_root
from quillgrid.sources import html as H
from quillgrid.sources import vault as V
from quillgrid.sources.pdf import shown_text


def pdf(*streams):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n<< /Filter /FlateDecode >>\nstream\n" % k + zlib.compress(s) + b"\nendstream\nendobj\n" for k, s in enumerate(streams, 1)) + b"%%EOF"


#: A museum of trains: eleven documents that are indexed, and four files that are not.
FILES = {
    "engines/pacific.md": "# Pacific class\n\nThree cylinders, [built](../works/swindle.md#boilers) by hand.\n\n### Livery\n\nGreen, like [[tender-car|its tender]].\n\n### Faults\n\nREQ-311 asks for `tools/gauge.py`; see also tools/gauge.py.\n",
    "engines/shunter.md": "---\ntitle: \"Yard shunter\"\ntags: diesel, Yard\naliases: [Gronk, little one]\n---\n## Duties\n\nMoves wagons. ![cab from the left](cab.webp)\n",
    "engines/cab.webp": b"RIFF",
    "works/swindle.md": "Works note before any heading. [[gronk]] was made here, [[Pacific]] too.\n\n# Works\n\n## boilers\n\nREQ-311, REQ-40.\n\n## See also\n\n* [[pacific]]\n\n\n## Hours\n\nclosed\n",
    "works/tender-car.rst": "Coal and water for long runs.\nWater scoops, water towers, water columns.\n",
    "visit/hours.html": "<!doctype html><title>Visiting</title><body>Open daily<h2 data-x='1>0'>Getting here</h2><p>By rail: <a href=\"../works/swindle.md?x#boilers\">works</a>, <a href='http://a.b/c.md'>elsewhere</a></p><img src=\"map.svg\" alt=\"way from station\"><script>tickets()</script></body>",
    "visit/map.svg": "<svg><title>Station map</title><text>Platform nine</text></svg>",
    "visit/café menu.md": "# Café\n\nScones. [lost](../nowhere/gone.md) [[phantom]] [[phantom]]\n",
    "lone/turntable.org": "* Turntable\nIt turns. Semaphore semaphore, water towers.\n",
    "lone/signal box.txt": "Levers and bells.\nSemaphore semaphore arms.\n",
    "lone/plan.pdf": pdf(b"BT (Drawing of the \\(old\\) shed) Tj ET", b"0 0 m BT (in ) Tj (ink) Tj ET"),
    "lone/plan.dwg": "not indexed",
    ".obsidian/app.md": "# settings",
    "old/2019/list.md": "# ignored by a pattern",
    "engines/sketch.tmp.md": "# ignored by another",
}
PATTERNS = ["old", "*.tmp.md", "# a comment", ""]
INDEXED = set(FILES) - {"lone/plan.dwg", ".obsidian/app.md", "old/2019/list.md", "engines/sketch.tmp.md"}


def put(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    put(root, FILES)
    return Vault(spark, str(root), str(tmp_path_factory.mktemp("log")), PATTERNS)


def test_files(vault):
    rows = {r.path: r for r in vault.frames.files.collect()}
    assert set(rows) == INDEXED
    shunter = rows["engines/shunter.md"]
    assert (shunter.title, shunter.tags, shunter.aliases) == ("Yard shunter", ["diesel", "yard"], ["gronk", "little one"])
    titles = {"engines/pacific.md": "Pacific class", "visit/hours.html": "Visiting", "visit/map.svg": "Station map", "lone/signal box.txt": "Levers and bells.", "engines/cab.webp": "cab"}
    assert {p: rows[p].title for p in titles} == titles
    assert rows["lone/plan.pdf"].words == 7
    assert {r.ext: r.n for r in V.unindexed(V.listing(vault.spark, vault.root, vault.patterns)).collect()} == {".dwg": 1}


def test_sections(vault):
    rows = {(r.path, r.heading): r for r in vault.frames.sections.collect()}
    assert rows["works/swindle.md", "(intro)"].content.startswith("Works note") and rows["works/swindle.md", "boilers"].line == 5
    assert rows["engines/shunter.md", "Duties"].line == 6 and ("engines/shunter.md", "(intro)") not in rows
    assert rows["engines/pacific.md", "Faults"].level == 3
    assert (rows["visit/hours.html", "Getting here"].content, rows["visit/hours.html", "(intro)"].content) == ("By rail: works, elsewhere", "Open daily")
    assert "cab from the left" in rows["engines/cab.webp", "(image)"].content
    assert "Platform nine" in {r.content.strip() for r in vault.frames.sections.where("path = 'visit/map.svg'").collect()}.pop()


def test_links_and_health(vault):
    f = vault.frames
    got = {(r.src, r.dst, r.kind) for r in f.links.collect()}
    assert got >= {("engines/pacific.md", "works/swindle.md", "md"), ("engines/pacific.md", "tools/gauge.py", "code"), ("engines/shunter.md", "engines/cab.webp", "img"), ("visit/hours.html", "works/swindle.md", "md"), ("visit/hours.html", "visit/map.svg", "img")}
    assert {(r.label, r.src) for r in L.broken(f.links, f.files).collect()} == {("phantom", "visit/café menu.md"), ("nowhere/gone.md", "visit/café menu.md")}
    assert {r.path for r in L.orphans(f.files, vault.connections()).collect()} == {"visit/café menu.md", "lone/turntable.org", "lone/signal box.txt", "lone/plan.pdf"}
    assert vault.path("visit/map.svg", "engines/cab.webp") == ["visit/map.svg", "visit/hours.html", "works/swindle.md", "engines/shunter.md", "engines/cab.webp"]
    assert vault.path("visit/map.svg", "lone/plan.pdf") == [] and vault.path("lone/plan.pdf", "lone/plan.pdf") == ["lone/plan.pdf"]


def test_path_steps(vault):
    got = [tuple(r) for r in vault.path_steps("visit/hours.html", "engines/cab.webp").collect()]
    assert got == [(0, "visit/hours.html", None), (1, "works/swindle.md", "—[md]→"), (2, "engines/shunter.md", "—[wiki]→"), (3, "engines/cab.webp", "—[img]→")]
    assert vault.path_steps("visit/hours.html", "lone/plan.pdf").count() == 0


def test_import(vault, tmp_path):
    of = lambda k, p: {"id": k, "label": k.upper(), "source_file": p, "more": 1}
    nodes = [of("a", "works/swindle.md"), of("b", "lone/turntable.org"), of("c", "nowhere.md"), of("d", None)]
    inferred = lambda s, t, **k: {"source": s, "target": t, "confidence": "INFERRED", **k}
    links = [inferred("a", "b"), inferred("b", "a"), inferred("a", "b", relation="x"), inferred("a", "c"), inferred("a", "d"), {"source": "a", "target": "b", "confidence": "EXTRACTED", "relation": "y"}]
    path = tmp_path / "graph.json"
    path.write_text(json.dumps({"nodes": nodes, "links": links}, indent=1))
    got = vault.import_edges(str(path)).collect()
    assert [(r.src, r.dst, r.relation, r.rationale) for r in got] == [("lone/turntable.org", "works/swindle.md", "conceptually_related_to", "A --x→ B | A --→ B | B --→ A")]
    below = R.node_files(vault.spark.createDataFrame([("k", "K", "p.md")], "id string, label string, source_file string"), vault.spark.createDataFrame([("wiki/p.md",)], "path string"))
    assert below.first().path == "wiki/p.md"


def test_search(vault):
    assert [r.path for r in vault.search("scoops").collect()] == ["works/tender-car.rst"]
    assert vault.search("gronk").first().path == "engines/shunter.md"
    assert {r.path for r in vault.search("tag:dies wagons").collect()} == {"engines/shunter.md"}
    assert {r.path for r in vault.search("type:pdf").collect()} == {"lone/plan.pdf"}
    assert vault.feedback("scoops nosuchword")["weak"] and vault.feedback("scoops nosuchword")["partial"]
    both = vault.feedback(["water towers", "nosuchword"])
    assert [x["weak"] for x in both] == [vault.feedback("water towers")["weak"], True] and both[0]["terms"][1] == {"term": "towers", "df": 2}
    assert vault.search(["scoops", "columns"]).first().sources == 2
    assert "scoops" in vault.evidence("scoops").first().text


def test_suggest(vault):
    pairs = {(r.a, r.b): r for r in vault.suggest(n=None).collect()}
    assert ("lone/signal box.txt", "lone/turntable.org") in pairs
    assert ("engines/pacific.md", "works/swindle.md") not in pairs
    assert any(r.text.startswith("[[signal box]] ↔ [[turntable]] — ") for r in vault.suggest_links(n=None).collect())
    assert any(r.text.startswith("[[turntable]]  # lone/turntable.org — ") for r in vault.suggest_links("lone/signal box.txt").collect())


def test_edits(vault):
    plan = vault.link_add("works/swindle.md", ["café menu", "swindle", "pacific", "unknown"]).first()
    assert plan.added == 1 and "* [[pacific]]\n- [[café menu]]\n\n\n## Hours" in plan.text
    new = vault.link_add("visit/café menu.md", ["shunter"]).first()
    assert new.text.endswith("\n\n## Related\n- [[shunter]]\n")
    fixes = {r.label: r.candidates for r in vault.fix_links().collect()}
    assert set(fixes) == {"phantom"}


def test_log(vault):
    vault.note_add("where are boilers made?", "at the works", ["works/swindle.md"])
    vault.edge_add("works/tender-car.rst", "lone/turntable.org", "both need water")
    vault.edge_add("works/tender-car.rst", "lone/turntable.org", "both need water, again")
    vault.embed_set("lone/turntable.org", [1.0, 0.0])
    vault.embed_set("lone/signal box.txt", [0.0, 1.0])
    vault._append({"type": "future", "x": {"y": [1]}})
    assert vault.notes().first().fresh
    edge = vault.edges().collect()
    assert len(edge) == 1 and edge[0].fresh and edge[0].rationale.endswith("again")
    assert [r.path for r in vault.semsearch([1.0, 0.1]).collect()] == ["lone/turntable.org", "lone/signal box.txt"]
    kept = [json.loads(r.raw) for r in vault.compacted_log().collect()]
    assert [r["type"] for r in kept].count("edge") == 1 and {"type": "future", "x": {"y": [1]}} in kept
    assert {r.kind: r.n for r in G.counters(vault.log()).collect()} == {"note": 1, "edge": 2, "embed": 2, "unknown": 1}
    assert {r.status: r.n for r in vault.embed_status().groupBy("status").agg(F.count("*").alias("n")).collect()} == {"fresh": 2, "missing": 9}
    both = {r.path: r.sources for r in vault.search(["scoops", "semaphore"], vector=[1.0, 0.0]).collect()}
    assert both["lone/turntable.org"] >= 2


def test_report_and_doctor(vault):
    report = {k: v.collect() for k, v in vault.report().items()}
    assert report["totals"][0].n_files == 11 and [r.dst for r in report["refs"]] == ["REQ-311"]
    assert {r.tag for r in report["tags"]} == {"diesel", "yard"}
    assert {r.change: r.n for r in vault.doctor()["index"].collect()} == {"unchanged": 11}


def test_root_discovery(spark, tmp_path):
    inner = tmp_path / "a" / "b" / "c"
    inner.mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        find_root(spark, str(inner))
    (tmp_path / "a" / ".quillgrid").mkdir()
    assert find_root(spark, str(inner)).endswith("/a") and find_root(spark, str(tmp_path / "a")).endswith("/a")
    (inner / ".quillgrid").mkdir()
    assert find_root(spark, f"file://{inner}").endswith("/a/b/c")


def test_report_text(vault, tmp_path):
    vault.write_report(str(tmp_path / "report"))
    got = [line for f in sorted((tmp_path / "report").glob("part-*")) for line in f.read_text().splitlines()]
    assert got[0].startswith("# Vault: 11 documents, ") and got.count("## Folders") == 1
    at = got.index("## Folders")
    assert got[at + 2].startswith("- `engines/` (3): ") and [x[3:x.index("/`")] for x in got[at + 2 : at + 6]] == ["engines", "lone", "visit", "works"]
    assert "- REQ-311 (2)" in got and "- `diesel` (1)" in got and "- `.dwg` 1" in got
    broken, health = got.index("- broken links: 2"), got.index("## Health")
    assert health < broken and "  - `phantom` in visit/café menu.md" in got[broken:]


def test_update(vault):
    note = pathlib.Path(vault.root, "lone/turntable.org")
    old = note.read_text()
    try:
        note.write_text("* Turntable\nrusted\n")
        assert {r.change: r.n for r in vault.update().collect()} == {"unchanged": 10, "changed": 1}
        assert [r.path for r in vault.frames.parsed.collect()] == ["lone/turntable.org"]
        assert vault.search("rusted").first().path == "lone/turntable.org" and vault.search("cab left").first().path in {"engines/cab.webp", "engines/shunter.md"}
        assert not vault.edges().first().fresh
    finally:
        note.write_text(old)
        vault.update()


def test_mv_and_log(spark, tmp_path):
    root, log = tmp_path / "v", tmp_path / "log"
    for name, text in {"a/x.md": "# X\r\n[y](y.md) ![p](../p.png) [w](http://x.org/y.md) [self](x.md#t) [[y]]\r\n", "a/y.md": "# Y\n[x](x.md) [up](../a/x.md#t)\n", "b/z.md": "# Z\n[[x]]\n", "skip/q.md": "# Q", ".vaultignore": "# list\nskip\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    log.mkdir()
    v = Vault(spark, str(root), str(log))
    assert {r.path for r in v.frames.files.collect()} == {"a/x.md", "a/y.md", "b/z.md"}
    v.note_add("what is x?", 'it "was" y', ["a/x.md", "b/z.md"])
    v.edge_add("a/x.md", "b/z.md", "both")
    v.embed_set("a/x.md", [1.0, 2.5])
    v._append({"type": "future", "path": "a/x.md"})
    (log / "z.jsonl").write_text("not json\n")
    plan = v.mv("a/x.md", "c/d/new.md")
    got = {r.path: r.text for r in plan.collect()}
    assert got["c/d/new.md"] == "# X\r\n[y](../../a/y.md) ![p](../../p.png) [w](http://x.org/y.md) [self](new.md#t) [[y]]\r\n"
    assert got["a/y.md"] == "# Y\n[x](../c/d/new.md) [up](../c/d/new.md#t)\n" and got["b/z.md"] == "# Z\n[[new]]\n"
    v.rewrite_log(v.log_after(plan, "a/x.md", "c/d/new.md"))
    (root / "a/x.md").unlink()
    for name, text in got.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    assert {r.change: r.n for r in v.update().collect()} == {"new": 1, "deleted": 1, "changed": 2}
    note, edge = v.notes().first(), v.edges().first()
    assert note.fresh and note.insight == 'it "was" y' and [s.path for s in note.sources] == ["c/d/new.md", "b/z.md"]
    assert edge.fresh and (edge.src, edge.dst, edge.rationale) == ("b/z.md", "c/d/new.md", "both")
    assert [(r.path, r.vec) for r in v.fresh_embeds().collect()] == [("c/d/new.md", [1.0, 2.5])]
    raw = [r.raw for r in v.log().collect()]
    assert '{"type": "future", "path": "a/x.md"}' in raw and "not json" in raw
    assert v.notes_for("it nowhere").count() == 0 and v.notes_for("it y").first().insight == 'it "was" y'
    (root / "b/z.md").write_text("# other\n")
    v.update()
    v.rewrite_log(v.pruned_log("note"))
    v.rewrite_log(v.pruned_log("edge"))
    assert v.notes().count() == 0 and v.edges().count() == 0 and len(v.log().collect()) == 3


def test_plain_sections(spark):
    text = "\n".join([f"line {k}" for k in range(12)] + ["", "next part", "", "more"])
    rows = spark.createDataFrame([(text,), ("",)], "t string").select(V.plain_sections(F.col("t")).alias("s")).collect()
    assert [(s.line, s.heading) for s in rows[0].s] == [(1, "line 0"), (14, "next part")]
    assert rows[1].s == []


PAGE = """<!doctype html>
<html><head><title>A &lt;b&gt;
 title</title>
<style>h1 { }</style></head><body>intro &eacute;&#233;&#xE9; &unknown; <b>bold</b>
<!-- <h1>not this</h1> -->
<h1 class="x">Top
 <i>one</i></h1><p>first<p>second &amp;amp;<script>if (a < b) { "<h2>no</h2>" }
</script>
<h3></h3>
<img alt='a &amp; b' src="p/q.png"><a class=c href=plan.md#x>go</a><A HREF='other.html'>to</A>
</body></html>"""


def test_html(spark):
    rows = spark.createDataFrame([(PAGE,), ("",), ("<p>only text<p>more",), ("<h2>left open",), ("<title>t",), ("&#55555;&#0;",)], "t string")
    t = F.col("t")
    got = rows.select(H.page_title(t).alias("title"), H.sections(H.body(t)).alias("s"), H.visible(H.body(t)).alias("v"), H.references(t).alias("refs"), H.pictures(t).alias("pics")).collect()
    assert got[0].title == "A <b> title" and got[0].refs == ["plan.md#x", "other.html"] and [tuple(p) for p in got[0].pics] == [("p/q.png", "a & b")]
    assert [tuple(s) for s in got[0].s] == [(1, 0, "(intro)", "intro ééé &unknown; bold"), (6, 1, "Top one", "first\nsecond &amp;"), (9, 3, "(heading)", "goto")]
    assert [(r.title, r.s, r.v) for r in got[1:]] == [("", [], ""), ("", [], "only text\nmore"), ("", [], "left open"), ("t", [], ""), ("", [], "&#55555;&#0;")]


def test_html_attributes_and_open_headings(spark):
    pages = ["<h1 title='a > b'>One</h1>x<img alt='a>b' src=q.png>y", "<h2>Open<p>text</p>\n<h2>Next</h2>t", "<h2>a</h2>b<h3>never closed", "".join(f"<h2>H{k}</h2>\n<p>t{k}</p>\n" for k in range(500))]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, t string").orderBy("k")
    got = rows.select(H.sections(H.body(F.col("t"))).alias("s"), H.pictures(F.col("t")).alias("p")).collect()
    assert [tuple(s) for s in got[0].s] == [(1, 1, "One", "xy")] and [tuple(p) for p in got[0].p] == [("q.png", "a>b")]
    assert [tuple(s) for s in got[1].s] == [(1, 0, "(intro)", "Open\ntext"), (2, 2, "Next", "t")]
    assert [tuple(s) for s in got[2].s] == [(1, 2, "a", "b\nnever closed")]
    assert [(s.line, s.heading, s.content) for s in got[3].s] == [(2 * k + 1, f"H{k}", f"t{k}") for k in range(500)]


def test_pdf_strings():
    assert shown_text(pdf(b"BT (one \\(two\\) thr\\145e) Tj ET BT [(fo) -20 (ur)] TJ ET")) == "one (two) three\nfour"
    assert shown_text(b"stream\nBT (not packed) Tj ET\nendstream") == "not packed"
    assert shown_text(b"") == "" and shown_text(b"%PDF") == "" and shown_text(pdf(b"BT (1 2) Tj ET", b"(no block)")) == ""

"""Core operators against small cases: nulls, ties, repeats, empty tables, hot keys."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import evaluation, extraction, graph, incremental, intervals, ranking
from codelode.sources import sinks, tree
from codelode.streaming import sessions


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, T.terms(F.col("x")), "loadWindow load_window2 a") == ["load", "window", "window2"]
    assert one(spark, T.text_hint(F.col("x")), "\n  a \n\n b\r\n") == "a\nb"
    assert one(spark, T.preview(F.col("x")), " a \n\t b ") == "a b"
    assert one(spark, T.token_proxy(F.col("x")), "äb") == 1
    assert one(spark, T.language(F.col("x")), "a/B.PY") == "Python" and one(spark, T.language(F.col("x")), "x") == "other"
    assert one(spark, T.stable_id(F.lit("1"), F.col("x")), None) is None


@pytest.mark.parametrize("glob,path,hit", [("src/**/*.py", "src/a.py", True), ("src/**/*.py", "src/a/b/c.py", True), ("*.py", "a/b.py", False), ("a?c.txt", "abc.txt", True), ("**/t.js", "t.js", True), ("a+(b).md", "a+(b).md", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, T.admits(F.col("x"), [glob], []), path) is hit


def test_ranking(spark):
    docs = spark.createDataFrame([("a", "red fish"), ("b", "red red fish blue"), ("c", "none"), ("d", None)], "k string, t string")
    index = ranking.postings(docs, "k", F.split("t", " "))
    got = {r.k: r.score for r in ranking.bm25(index, "k", ["red", "blue"]).collect()}
    assert set(got) == {"a", "b"} and got["b"] > got["a"]
    assert ranking.bm25(index.limit(0), "k", ["red"]).count() == 0
    rows = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 2.0)], "k string, score double")
    assert [r.k for r in ranking.ranked(rows.repartition(3), "score", "k", 2).orderBy("place").collect()] == ["y", "z"]
    fused = {r.k: r.score for r in ranking.fuse([(ranking.ranked(rows, "score", "k", 3), 1.0)], "k", 5).collect()}
    assert fused["y"] == round(1 / 6, 6)
    sem = spark.createDataFrame([("x", 10.0), ("n", 200.0)], "k string, score double")
    assert {r.k: r.score for r in ranking.merge_semantic(rows, sem, "k").collect()} == {"x": 9.0, "y": 2.0, "z": 2.0, "n": 80.0}
    assert {r.k for r in ranking.over_share(rows, "score", 0.6).collect()} == {"y", "z"}
    v = ranking.term_vectors(docs, "k", F.col("t"))
    assert {round(r.n, 3) for r in v.groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()} == {1.0}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "calls", "INFERRED"), ("a", "b", "calls", "EXTRACTED"), ("b", "c", "calls", "EXTRACTED"), ("c", "a", "calls", "EXTRACTED"), ("x", None, "calls", "EXTRACTED"), ("p", "q", "calls", "EXTRACTED")], "source string, target string, relation string, confidence string")
    c = graph.canonical_edges(e)
    assert c.count() == 4 and c.filter("source = 'a'").first().confidence == "EXTRACTED"
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.hops) for r in graph.reach(c, start, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [r.id for r in graph.shortest_path(c, "b", "a").orderBy("step").collect()] == ["b", "a"]
    assert graph.shortest_path(c, "a", "q").count() == 0
    nodes = spark.createDataFrame([(x,) for x in "abcpq"], "id string")
    com = {r.id: r.community for r in graph.communities(nodes, c).collect()}
    assert com["a"] == com["b"] == com["c"] and com["p"] != com["a"]
    assert graph.without_dangling(c, nodes.filter("id <> 'q'")).count() == 3
    ids = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "a"), ("2", "b"), (None, "z")], "edge_id string, source string")
    assert [r.edge_id for r in graph.conflicting_ids(ids).collect()] == ["2"]
    hubs = graph.hubs(c, nodes.withColumn("community", F.lit(1))).first()
    assert (hubs.id, hubs.degree) == ("a", 2)


def test_intervals(spark):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    left = spark.createDataFrame([("r", t(5)), ("r", t(40)), ("r", t(0)), ("q", t(9))], "root string, at timestamp")
    right = spark.createDataFrame([("r", t(1), 1), ("r", t(5), 2), ("r", t(5), 3), ("r", t(50), 9), ("r", None, 8)], "root string, t timestamp, v int")
    assert {(r.root, r["at"].day, r.v) for r in intervals.as_of(left, right, "root", "at", "t", "v").collect()} == {("r", 6, 3), ("r", 10, 3), ("r", 1, None), ("q", 10, None)}
    spans = spark.createDataFrame([("f", "outer", 1, 200), ("f", "inner", 50, 90), ("f", "open", 1, None)], "file string, k string, line_start int, line_end int")
    pts = spark.createDataFrame([("f", 10), ("f", 60), ("f", 150), ("f", 500), ("g", 1)], "file string, line int")
    assert {(r.line, r.k) for r in intervals.innermost(pts, spans, "file", "line", "k").collect()} == {(10, "outer"), (60, "inner"), (150, "outer"), (500, None), (1, None)}


def test_extraction(spark):
    rows = [("m", "r", "a.md", "# A\n```\n# no\n```\n## B\n# C\n"), ("s", "r", "q.sql", "select * from db.Orders join x on 1=1"), ("p", "r", "pkg/a.py", "from pkg.b import c\nimport os\n\ndef f():\n    pass\n"), ("b", "r", "pkg/b.py", ""), ("j", "r", "web/x.ts", "import { y } from './z/y';\nexport class K {}\n"), ("y", "r", "web/z/y.ts", ""), ("n", "r", None, None)]
    c = spark.createDataFrame(rows, "file_id string, root_id string, rel_path string, content string")
    assert {(r.title, r.level, r.line_start, r.line_end) for r in extraction.headings(c).collect()} == {("A", 1, 1, 5), ("B", 2, 5, 5), ("C", 1, 6, 7)}
    assert {r.name for r in extraction.table_references(c).collect()} == {"orders", "x"}
    got = {(r.rel_path, r.target, r.confidence) for r in extraction.resolve_imports(extraction.imports(c), c).collect()}
    assert got == {("pkg/a.py", "pkg/b.py", "EXTRACTED"), ("web/x.ts", "web/z/y.ts", "EXTRACTED")}
    assert {(r.name, r.kind) for r in extraction.definitions(c).collect()} == {("f", "function"), ("K", "class")}


def test_incremental(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "k string, h string")
    b = spark.createDataFrame([("x", "2"), ("z", None), ("n", "1")], "k string, h string")
    assert {(r.k, r.status) for r in incremental.changes(a, b, ["k"], "h").collect()} == {("x", "changed"), ("y", "removed"), ("n", "added")}
    d = lambda df: incremental.digest(df, ["k", "h"]).first().digest
    assert d(a) == d(a.repartition(3).orderBy(F.desc("k"))) != d(b) and d(a) != d(a.union(a))
    many = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1)], "r string, id int")
    assert sorted(r.id for r in incremental.newest(many, "r", "id", 3).filter("r = 'hot'").collect()) == [497, 498, 499]


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 1, 2, 1), ("a", 2, 1, 3), ("b", 1, 1, 0)], "q string, place int, ideal int, grade int")
    got = {r.q: r.ndcg for r in evaluation.ndcg(rows, "q", 5).collect()}
    assert got["b"] is None and 0.6 < got["a"] < 1
    r = {x.q: x for x in evaluation.recall(rows, "q", 1).collect()}
    assert r["a"].recall == 0 and r["a"].reciprocal_rank == 0.5 and r["b"].recall is None
    vals = spark.createDataFrame([("g", float(i)) for i in range(20)], "g string, v double")
    assert evaluation.nearest_rank(vals, "g", "v", 0.95).first().v == 18.0


def test_sessions(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 8) + dt.timedelta(minutes=m)
    ev = spark.createDataFrame([("s", "query", t(0), None), ("s", "opened", t(5), "a"), ("s", "opened", t(6), "a"), ("s", "query", t(10), None), ("s", "changed", t(11), "b"), ("s", "stop", t(12), None), ("s", "opened", t(13), "c"), ("z", "opened", t(1), "a"), (None, "query", t(1), None)], "session string, action string, time timestamp, path string")
    got = {((r.start - t(0)).seconds // 60, (r.end - t(0)).seconds // 60, r.opened, r.changed) for r in sessions.records(ev).collect()}
    assert got == {(0, 10, 1, 0), (10, 12, 0, 1)}
    assert sessions.windows(ev.limit(0)).count() == 0


def test_stream_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("s", "q", dt.datetime(2024, 1, 1)), ("s", "q", dt.datetime(2024, 1, 1, 1)), ("s", "r", dt.datetime(2024, 1, 1))], "session string, query string, time timestamp").write.parquet(src)
    stream = spark.readStream.schema("session string, query string, time timestamp").parquet(src)
    q = sessions.once_per_query(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2


def _zip(**files):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k, v in files.items():
            z.writestr(k.replace("__", "/") + ".xml", v)
    return buf.getvalue()


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src/a.py").write_text("x = 1\n")
    (root / "src/.env").write_text("A=1")
    (root / "node_modules/b.js").write_text("1")
    doc = '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'
    (root / "d.docx").write_bytes(_zip(word__document=doc))
    (root / "bad.pptx").write_bytes(b"no")
    scanned = tree.scan(spark, str(root))
    assert {r.rel_path for r in scanned.collect()} == {"src/a.py", "d.docx", "bad.pptx"}
    assert {r.content for r in tree.texts(scanned.filter("rel_path like '%.py'")).collect()} == {"x = 1\n"}
    docs = {(r.rel_path, r.status, r.title, r.text) for r in tree.documents(scanned.filter("rel_path not like '%.py'")).collect()}
    assert docs == {("d.docx", "ok", "Head", "Body"), ("bad.pptx", "unreadable", None, None)}
    sheet = _zip(xl__workbook='<w><sheet name="S"/></w>', xl__sharedStrings="<s><si><t>hi</t></si></s>", xl__worksheets__sheet1='<w><row><c t="s"><v>0</v></c><c><v>2</v></c></row></w>')
    assert tree.document_parts("a.xlsx", sheet) == ("ok", [("sheet", 1, "S", "hi\t2")])
    assert tree.document_parts("a.svg", b"<svg><title>T</title><text>x</text></svg>")[1] == [("document", 1, "T", "T\nx")]
    assert tree.document_parts("a.svg", b"<!DOCTYPE a><svg/>")[0] == "unreadable" and tree.document_parts("a.pdf", b"")[0] == "unreadable" and tree.document_parts("a.odt", b"")[0] == "unsupported"
    commits, files = tree.commit_tables(spark, "s2\x1f2024-01-02T00:00:00Z\x1fsecond\x1f\x1f\nR100\ta.py\tb.py\n\x1es1\x1f2024-01-01T00:00:00Z\x1ffirst\x1fbody\x1f\nA\ta.py\n\x1e")
    assert [(r.id, r.sha) for r in commits.orderBy("id").collect()] == [(1, "s1"), (2, "s2")]
    assert {tuple(r) for r in files.collect()} == {(1, "A", "a.py", None), (2, "R", "b.py", "a.py")}
    out = str(tmp_path / "j")
    sinks.write_jsonl(commits.select("sha", "id"), out)
    assert tree.read_jsonl(spark, out, "id bigint, sha string").count() == 2
    e = spark.createDataFrame([(f"a{i}", "b'<", "calls") for i in range(1203)], "source string, target string, relation string")
    st = sinks.cypher_statements(e).collect()
    assert sum(s.statement.count("{s: ") for s in st) == 1203 and all(s.statement.count("{s: ") <= 500 for s in st)
    lines = [r.line for r in sinks.graphml_lines(spark.createDataFrame([("a0", "<A>")], "id string, label string"), e.limit(1)).collect()]
    assert lines[0].startswith("<?xml") and "&lt;A&gt;" in lines[1] and lines[-1] == "</graph></graphml>"


def test_privacy(spark):
    from codelode.functions import privacy as P

    hide = P.hide_standalone(F.col("x"))
    assert one(spark, hide, "redis://svc:abc123@h/0 and redis://svc:${PW}@h/0") == "redis://svc:[hidden]@h/0 and redis://svc:${PW}@h/0"
    assert one(spark, hide, "a\n-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----\nb") == "a\n[hidden]\nb"
    assert one(spark, hide, "glpat-abcdefghijklmnopqrst plain") == "[hidden] plain" and one(spark, hide, None) is None
    assert one(spark, P.secret_path(F.col("x")), "a/.env.local") and not one(spark, P.secret_path(F.col("x")), "env.py")
    assert one(spark, P.ignored_path(F.col("x")), "A/Node_Modules/b.js") and not one(spark, P.ignored_path(F.col("x")), "vendor_portal/a.py")


def test_feedback(spark):
    """The contract: Jaccard squared times the best evidence, half the top score for a full weight, a quarter taken for ignored files, 0.8 for unused ones."""
    from codelode.operators import feedback as B

    S = "root_id string, query string, outcome string, suggested array<string>, opened array<string>, changed array<string>, missed array<string>, ignored array<string>"
    rec = spark.createDataFrame([
        ("r", "render window", "passed", ["u"], ["b"], ["a"], None, ["d", "external:x"]), ("r", "render window twice", None, ["u"], None, ["a"], ["c"], ["d"]), ("r", "window render scope", "failed", ["u"], ["b"], None, None, None),
        ("r", "other thing", "passed", None, None, ["z"], None, None), ("r", None, None, None, None, ["z"], None, None),
    ], S)
    s = {r.rel_path: r for r in B.signals(rec, "render window").collect()}
    assert set(s) == {"a", "b", "c", "d", "u"} and s["a"].weight == round(1 + 4 / 9, 6) and s["c"].weight == round(4 / 9, 6)
    assert s["b"].weight == round(0.4 + 4 / 9 * 0.4 * 0.3, 6) and s["d"].weight == round(-0.3 - 0.3 * 4 / 9, 6) and s["u"].unused and not s["a"].unused and s["a"].helped == 2
    rows = spark.createDataFrame([("r", "a", 100), ("r", "d", 100), ("r", "n", 5), ("r", "u", 10)], "root_id string, rel_path string, score int")
    got = {r.rel_path: r.score for r in B.apply(rows, B.signals(rec, "render window")).collect()}
    assert got == {"a": 150, "d": 100 - 11, "n": 5, "u": 8, "b": 23, "c": 22}
    assert B.signals(rec.limit(0), "x").count() == 0
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    assert {(r.id, r.score) for r in B.spread(spark.createDataFrame([("a", 10.0)], "id string, score double"), e).collect()} == {("a", 10.0), ("b", 3.5), ("c", 1.5)}


def test_chunks(spark):
    from codelode.operators import chunks

    rows = [("1", "r", "a.py", "import os\n# about f\n@deco\ndef f():\n    pass\n\ndef g():\n    pass\n"), ("1", "r", "a.py", "import os\n# about f\n@deco\ndef f():\n    pass\n\ndef g():\n    pass\n"), ("2", "r", "d.md", "# T\ntext\n"), ("3", None, "x.py", "def h(): pass"), ("4", "r", "e.py", None)]
    c = spark.createDataFrame(rows, "file_id string, root_id string, rel_path string, content string")
    got = {(r.rel_path, r.chunk_kind, r.chunk_text_preview) for r in chunks.semantic_chunks(c).collect()}
    assert ("a.py", "symbol", "a.py f") in got and ("d.md", "doc_heading", "d.md T") in got and ("e.py", "path", "e.py e .py") in got and len(got) == 8
    p = {(r.name, r.line_start, r.line_end) for r in chunks.symbol_pieces(c.filter("root_id is not null")).collect()}
    assert p == {("f", 2, 6), ("g", 7, 9)}
    s = spark.createDataFrame([("f", 1, 5, 3.0), ("f", 9, 9, 2.0), ("f", 20, 30, 1.0), ("q", 1, 1, 1.0)], "file string, line_start int, line_end int, score double")
    assert {(r.file, r.line_start) for r in chunks.best_ranges(s, "file", "score").collect()} == {("f", 1), ("f", 9), ("q", 1)}


def test_arms_compared_shuffles_no_pairs(spark, tmp_path):
    """The rows of its SQL, also for null keys, shared keys and tasks without files; a repository's tasks times files are not written to disk (before, 112,000 rows of them went there three times)."""
    import duckdb

    from codelode.plans import measures

    files = [(f"f{i}", "r1" if i % 30 else "r2", f"src/part_{i}/file_{i}.py") for i in range(3000)] + [("f", "r3", None), ("g", "r2", "src/part_1/file_1.py")]
    tasks = [(i, "a/b", [f"src/part_{(i * 7 + j) % 3000}/file_{(i * 7 + j) % 3000}.py" for j in range(i % 4)]) for i in range(300)]
    tasks += [(i, "c/d", ["src/part_30/file_30.py", None, "x", "x"]) for i in range(290, 320)] + [(320, None, ["y", "z", "w", "v"]), (None, "a/b", ["y", "z", "w", "v"]), (321, "e/f", None), (322, "none", ["y"]), (323, "c/d", None)]
    spark.createDataFrame(files, "file_id string, root_id string, rel_path string").write.parquet(str(tmp_path / "files.parquet"))
    spark.createDataFrame([("r1", "a/b"), ("r2", "c/d"), ("r3", "e/f")], "root_id string, repo string").write.parquet(str(tmp_path / "roots.parquet"))
    spark.createDataFrame(tasks, "task_key bigint, repo string, gold array<string>").write.parquet(str(tmp_path / "tasks.parquet"))
    base = duckdb.connect()
    for t in ("files", "roots", "tasks"):
        base.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = base.execute(measures.ORACLE["arms_compared"]).fetchall()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    began = written()
    got = [tuple(r) for r in measures.arms_compared(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 300 and {x[1:] for x in got} >= {(True, False, False), (False, True, False), (False, False, False)}
    assert written() - began < 2_000_000

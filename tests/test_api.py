"""The engine as one object, its generations and its exports, on a small folder of tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codelode.api import Engine
from codelode.operators import codegraph, logs
from codelode.sources import sinks, worktree
from codelode.sources.generations import Generations

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def engine(spark):
    texts = {"src/a.py": "from b import run_it\n\n\ndef load_window(x):\n    return run_it(x)\n", "src/b.py": "def run_it(x):\n    return x\n", "tests/test_a.py": "from a import load_window\n\n\ndef test_x():\n    assert load_window(1)\n", "Makefile": "test:\n\tpytest\n"}
    f = spark.createDataFrame([(f"f{i}", "r", p, p.rsplit("/", 1)[-1], p.rsplit(".", 1)[-1], len(t), "h", "generic", t, None, T0) for i, (p, t) in enumerate(texts.items())], "file_id string, root_id string, rel_path string, filename string, extension string, size bigint, hash string, adapter string, content_hint string, metadata_text string, indexed_at timestamp")
    c = spark.createDataFrame([("r", f"f{i}", p, t, T0) for i, (p, t) in enumerate(texts.items())], "root_id string, file_id string, rel_path string, content string, modification_time timestamp")
    ch = spark.createDataFrame([("c1", "r", "f0", "src/a.py", "load window", '{"5": 1.0}'), ("c2", "r", None, "src/b.py", None, "broken"), ("c3", None, None, None, None, None)], "chunk_id string, root_id string, file_id string, rel_path string, chunk_text_preview string, vector_json string")
    com = spark.createDataFrame([(1, "r", "s1", T0, "load window", None)], "id bigint, root_id string, sha string, commit_date timestamp, subject string, body string")
    cf = spark.createDataFrame([(1, "D", "src/old.py", None)], "commit_id bigint, status string, path string, old_path string")
    return Engine(spark, f, c, ch, com, cf)


def test_answers(engine):
    first = engine.find("Fix load_window", 2).orderBy("place").first()
    assert first.rel_path == "src/a.py"
    assert engine.find("Fix load_window", 5, path_globs=["tests/**"]).first().rel_path == "tests/test_a.py"
    pre = engine.preflight("Fix load_window").orderBy("place").collect()
    assert pre[0].rel_path == "src/a.py" and not pre[0].test
    lines = [r.line for r in engine.pack("Fix load_window").orderBy("place").collect()]
    assert lines[0] == "# Task: Fix load_window" and "- test `tests/test_a.py`" in lines and "- run `make test`" in lines
    assert {r.label for r in engine.symbol("run_it", "callers", 2).collect()} == {"load_window", "test_x"} and engine.symbol("load").first().name == "load_window"
    assert {r.rel_path for r in engine.impact("src/b.py").filter("how = 'calls'").collect()} == {"src/a.py", "tests/test_a.py"}
    assert engine.why("src/a.py", "Fix load_window").first().place == 1 and engine.history("load window").first().sha == "s1" and engine.lost("see old.py").first().change == "deleted"
    assert "def load_window" in engine.snippets(engine.find("load_window", 1), "load_window").first().snippet
    assert engine.route("load the window", {"ui": ["window"], "db": ["table"]}).first().name == "ui" and engine.adapter_for(".PY") == "python" and engine.candidates("load_window|nosuch") == ["load_window"]
    assert {r.status for r in engine.stale().collect()} == {"changed"} and engine.semantic("load window").count() >= 1 and engine.outline("Makefile").first().name is None


def test_generations(engine, spark, tmp_path):
    g = Generations(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert g.current() is None
    with pytest.raises(RuntimeError):
        g.publish({"t": one}, "2024", fail_after="manifest")
    assert g.current() is None
    a = g.publish({"t": one}, "2024")
    assert g.current() == a and g.table("t").count() == 1 and g.publish({"t": one.repartition(3)}, "2025") is None and g.broken().count() == 0
    b = g.publish({"t": one.union(one)}, "2025")
    assert b != a and g.current() == b and {r.name for r in g.manifest(b).collect()} == {"t"}
    c = g.publish({"t": one.limit(0)}, "2026")
    assert g.clean(2) == [a] and g.current() == c and g.table("t").count() == 0


def test_exports(engine):
    nodes, edges = engine.graph
    notes = {r.name: r.text for r in sinks.note_files(nodes, edges).collect()}
    assert "- `load_window`" in notes["src-a.py.md"] and "[[src-b.py]]" in notes["src-a.py.md"]
    page = [r.line for r in sinks.html_lines(nodes, edges, "<t>").collect()]
    assert "&lt;t>" in page[0] and page[-1].endswith("</script>") and any("load_window" in x for x in page)
    assert codegraph.graph_report(nodes, edges).orderBy("place").first().line.startswith("# Graph: ")


def test_logs(spark):
    t = lambda m: T0 + dt.timedelta(minutes=m)
    ev = spark.createDataFrame([
        ("s", "query", t(0), None, ["a", "b", "c"]), ("s", "opened", t(1), "a", None), ("s", "changed", t(2), "x", None), ("s", "query", t(10), None, ["d"]), ("s", "opened", t(10), "d", None), ("s", "stop", t(12), None, None), ("s", "opened", t(13), "z", None),
        ("open", "query", t(100), None, ["q"]), ("open", "opened", t(101), "q", None), ("idle", "query", t(0), None, None), ("idle", "opened", t(150), "late", None),
    ], "session string, action string, time timestamp, path string, shown array<string>")
    got = {(r.session, (r.start - T0).seconds // 60): (r.opened, r.changed, r.ignored) for r in logs.session_records(ev, t(140)).collect()}
    assert got == {("s", 0): (["a"], ["x"], ["b", "c"]), ("s", 10): (["d"], [], [])}
    q = spark.createDataFrame([("k", t(5)), ("k", t(20)), ("n", t(5))], "query_key string, time timestamp")
    c = spark.createDataFrame([("k", t(4), "s1"), ("k", t(3), "s0"), ("k", t(6), "s2")], "query_key string, time timestamp, session string")
    assert {(r.query_key, r.time, r.session) for r in logs.query_sessions(q, c).collect()} == {("k", t(5), "s1"), ("k", t(20), None), ("n", t(5), None)}
    shown = spark.createDataFrame([("s", "a", t(0))], "session string, path string, time timestamp")
    asked = spark.createDataFrame([("s", "a", t(1)), ("s", "a", t(-1)), ("s", "b", t(1)), ("s", "a", t(60 * 30))], "session string, path string, time timestamp")
    assert sorted(r.shown for r in logs.was_shown(asked, shown).collect()) == [False, False, False, True]


def test_worktree(tmp_path):
    assert worktree.ignored(str(tmp_path)) == [] and worktree.fingerprint(str(tmp_path), "1") is None and worktree.log_text(str(tmp_path)) == ""
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/.git").write_text("gitdir: x")
    assert worktree.linked_worktrees(str(tmp_path)) == ["sub"]
    s = tmp_path / "s.toml"
    s.write_text('include = ["src/**"]\nmax_bytes = 5\n[languages]\ninc = "php"\n')
    got = worktree.settings(str(s))
    assert got.include == ["src/**"] and got.extension("a.inc") == "php" and worktree.settings(str(tmp_path / "no")).max_bytes == 1_000_000
    s.write_text('bad = 1\n')
    with pytest.raises(ValueError):
        worktree.settings(str(s))

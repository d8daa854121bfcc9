"""Query parsing, path roles, the ranked lookup, resolution, the code graph, redaction and readers on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codelode.functions import query as Q
from codelode.functions import redaction as R
from codelode.functions import roles
from codelode.operators import codegraph, configs, evaluation, graph, history, lookup, plantree, resolve, symbols

T0 = dt.datetime(2024, 1, 1)


def test_query_terms():
    q = Q.Query("Fix parseConfig in src/app/query.py without touching tests but update docs\n\npytest fails")
    assert q.terms[:5] == ["fix", "parseconfig", "parse", "config", "src"] and "py" not in q.terms and "tests" not in q.terms and q.excluded == ["tests"]
    assert q.edits and not q.tests and not q.explains and not q.fuses
    assert Q.Query("explain the design").explains and not Q.Query("explain the design").edits and Q.Query("add tests for x").tests
    assert Q.excluded("do not exclude the parser") == [] and Q.excluded('exclude "old api" please') == ["old", "api"]
    assert Q.code_names("use `a.b_c` and loadWindow or load_x, not plain") == ["a", "b_c", "loadWindow", "load_x"]
    assert Q.named_identifiers("`x.render_it()` fooBar ab") == {"render_it", "fooBar"} and Q.pairs("日本語") == ["日本", "本語"] and Q.pairs("日") == ["日"]
    assert Q.headline("\n  one \ntwo") == "one" and Q.whole_name("./src/A.py") == "src/a.py" and Q.whole_name("fix a.py") is None and Q.place_terms(["fix", "x"]) == ["x"] and Q.place_terms(["fix"]) == ["fix"]
    assert Q.Query("x " * 3).scale == 1.0 and Q.Query("").terms == []


def test_inflections(spark):
    rows = spark.createDataFrame([(t,) for t in ("cache", "caches", "caching", "cached", "cacher", "cach", "art", "start", "proxies", "proxy")], "t string")
    hit = lambda term: {r.t for r in rows.filter(Q.matches(F.col("t"), term)).collect()}
    assert hit("cache") == {"cache", "caches", "caching", "cached", "cacher"} and hit("art") == {"art"} and hit("proxy") == {"proxy", "proxies"} and hit("caching") == {"cache", "caching", "cach"}


def test_roles(spark):
    want = {
        "docs/a.py": "doc", "README.md": "doc", "notes/plan.md": "doc", "src/a.py": "source", "tests/a.py": "test", "src/a_test.go": "test", "src/ThingTest.java": "test", "src/latest.py": "source", "alembic/x.py": "migration", "old/a.py": "retired",
        "vendor/a.js": "supporting", "SECURITY.md": "noise", "src/security.py": "source", "a.min.js": "bundle", "src/x.test.ts": "test",
    }
    rows = spark.createDataFrame([(p,) for p in want], "p string")
    p = F.col("p")
    kinds = {"doc": roles.is_doc(p), "test": roles.is_test(p), "migration": roles.is_migration(p), "retired": roles.is_retired(p), "supporting": roles.is_supporting(p), "noise": roles.is_noise(p), "bundle": roles.is_bundle(p), "source": roles.is_source(p), "surface": roles.is_edit_surface(p)}
    for r in rows.select("p", *[v.alias(k) for k, v in kinds.items()]).collect():
        assert r[want[r.p]], r
        assert r.source == (want[r.p] in ("source", "bundle")), r
    got = {r.p: (r.surface) for r in rows.select("p", kinds["surface"].alias("surface")).collect()}
    assert got["src/a.py"] and not got["a.min.js"] and not got["tests/a.py"]


@pytest.fixture(scope="module")
def repo(spark):
    texts = {
        "src/app/render.py": "from app import window\nfrom .scope import parse_scope\n\n\n# draws it\ndef render_window(x):\n    return parse_scope(window.open_it(x))\n\n\nclass Box(window.Base):\n    def draw(self):\n        return self.fill()\n\n    def fill(self):\n        return render_window(1)\n",
        "src/app/scope.py": "def parse_scope(x):\n    return x\n", "src/app/window.py": "class Base:\n    pass\n\n\ndef open_it(x):\n    return x\n", "src/app/__init__.py": "", "tests/test_render.py": "from app.render import render_window\n\n\ndef test_it():\n    assert render_window(1)\n",
        "web/a.ts": "import { b } from './lib/b';\nimport c from '@/c';\nexport function go() { return b(); }\n", "web/lib/b.ts": "export const b = () => 1;\n", "web/src/c.ts": "export default 1;\n", "docs/guide.md": "# Guide\nSee [render](../src/app/render.py) and [[scope]].\n",
        "go.mod": "module example.com/m\n\ngo 1.22\n", "cmd/main.go": 'package main\nimport (\n\t"example.com/m/pkg/x"\n)\nfunc main() { x.Run() }\n', "pkg/x/x.go": "package x\nfunc Run() {}\n", "pkg/x/x_test.go": "package x\n", "Broken.py": "def (:\n",
    }
    c = spark.createDataFrame([("r", f"f{i}", p, t, T0) for i, (p, t) in enumerate(texts.items())] + [("r", "f0", "src/app/render.py", "old", T0 - dt.timedelta(days=1)), ("r", "n", None, "x", T0), (None, "n", "a.py", "x", T0), ("r", "n", "null.py", None, T0)], "root_id string, file_id string, rel_path string, content string, modification_time timestamp")
    f = spark.createDataFrame([(f"f{i}", "r", p, p.rsplit("/", 1)[-1], p.rsplit(".", 1)[-1], len(t), "h", "generic", t[:80], None, T0) for i, (p, t) in enumerate(texts.items())] + [("g0", "q", "a.py", "a.py", "py", 1, "h", None, None, None, T0)], "file_id string, root_id string, rel_path string, filename string, extension string, size bigint, hash string, adapter string, content_hint string, metadata_text string, indexed_at timestamp")
    return f.withColumn("score", F.lit("clash")), c.withColumn("place", F.lit("clash"))


def test_resolution_and_graph(spark, repo):
    _, c = repo
    found = symbols.code_facts(c)
    aliases = spark.createDataFrame([("r", "web", "@/*", "web/src/*"), ("r", "", "@/*", "nowhere/*")], "root_id string, folder string, pattern string, goal string")
    imp = {(r.rel_path, r.target, r.confidence) for r in resolve.resolve_imports(found, c.select("root_id", "rel_path"), None, codegraph.go_modules(c), aliases).collect()}
    assert {("src/app/render.py", "src/app/scope.py", "EXTRACTED"), ("src/app/render.py", "src/app/window.py", "EXTRACTED"), ("tests/test_render.py", "src/app/render.py", "EXTRACTED"), ("web/a.ts", "web/lib/b.ts", "EXTRACTED"), ("web/a.ts", "web/src/c.ts", "EXTRACTED"), ("cmd/main.go", "pkg/x/x.go", "EXTRACTED")} <= imp
    assert not any(t == "pkg/x/x_test.go" for _, t, _ in imp)
    nodes, edges = codegraph.build(c)
    name = {r.id: r.label for r in nodes.collect()}
    got = {(name[r.source], r.relation, name[r.target]) for r in edges.collect()}
    assert {("render_window", "calls", "parse_scope"), ("render_window", "calls", "open_it"), ("draw", "calls", "fill"), ("fill", "calls", "render_window"), ("test_it", "calls", "render_window"), ("Box", "inherits", "Base"), ("docs/guide.md", "references", "src/app/render.py")} <= got
    rows = codegraph.call_rows(nodes, edges, "parse_scope", 3)
    assert {(r.label, r.depth) for r in rows.collect()} == {("render_window", 1), ("fill", 2), ("test_it", 2), ("draw", 3)}
    goal = spark.createDataFrame([("r", "src/app/scope.py")], "root_id string, rel_path string")
    hit = {(r.rel_path, r.how, r.is_test) for r in codegraph.impact(nodes, edges, goal).collect()}
    assert {("src/app/render.py", "calls", False), ("tests/test_render.py", "calls", True), ("src/app/render.py", "imports", False)} <= hit and not any(p == "src/app/scope.py" for p, _, _ in hit)
    assert [r.rel_path for r in codegraph.test_files(nodes, edges, goal).collect()] == ["tests/test_render.py"]
    assert codegraph.surface(nodes, "scope").orderBy("place").first().label == "parse_scope" and codegraph.exact_surface(nodes, "Box").count() == 1 and codegraph.surface_evidence(nodes, edges, "render_window").first().nodes == 1
    assert codegraph.build(c.limit(0))[1].count() == 0


def test_lookup(spark, repo):
    from codelode.operators.chunks import symbol_texts

    f, c = repo
    index, s, p = lookup.file_index(f, c), symbols.symbols(symbols.code_facts(c)), symbol_texts(c)
    rows = lookup.find(index, s, p, "Fix `parse_scope` in the window", 3).filter("root_id = 'r'").orderBy("place").collect()
    assert rows[0].rel_path == "src/app/scope.py" and "defines `parse_scope`" in rows[0].evidence and rows[0].score >= rows[1].score and rows[0].ranges[0].name == "parse_scope"
    assert [r.place for r in rows] == [1, 2, 3]
    exact = lookup.find(index, s, p, "render.py", 2).filter("root_id = 'r'").orderBy("place").first()
    assert exact.rel_path == "src/app/render.py"
    assert {r.rel_path for r in lookup.named_paths(f, Q.Query("in app/window.py and app.render.Box of b.ts")).collect()} == {"src/app/window.py", "src/app/render.py", "web/lib/b.ts"}
    assert {r.name for r in lookup.missing_names(f, Q.Query("see nosuch.py and scope.py")).filter("root_id = 'r'").collect()} == {"nosuch.py"}
    assert lookup.find(index.limit(0), s, p, "x", 3).count() == 0 and lookup.find(index, s, p, "", 3).count() == 0
    with pytest.raises(ValueError):
        lookup.page(index, 0)


def test_fusion_hands_scores_out(spark):
    rows = spark.createDataFrame([("r", "a.py", 90, 1), ("r", "b.py", 50, 2), ("r", "c.py", 10, None)], "root_id string, rel_path string, score int, place int")
    lst = spark.createDataFrame([("r", "b.py", 1), ("r", "n.py", 2), ("r", "tests/t.py", 3), ("r", "far.py", 31)], "root_id string, rel_path string, place int")
    got = {r.rel_path: r.score for r in lookup.fused(rows, lst, 5, 0.75, Q.Query("fix a")).collect()}
    assert got == {"b.py": 90, "a.py": 50, "n.py": 50, "c.py": 10}


@pytest.mark.parametrize("text,out", [
    ('password = "hunter22x"', 'password = "[REDACTED]"'), ("API_KEY=abc123def", "API_KEY=[REDACTED]"), ('if "abcd1234efgh" == api_token:', 'if "[REDACTED]" == api_token:'), ('("password", "s3cret99")', '("password", "[REDACTED]")'), ('u, password = "bob", "s3cret99"', 'u, password = "bob", "[REDACTED]"'),
    ("secret: |\n  abc\n  def\nnext: 1\n", "secret: |\n  [REDACTED]\n  [REDACTED]\nnext: 1\n"), ('password: "first\n  second"\n', 'password: "[REDACTED]\n"\n'), ('password = "never closed', 'password = "[REDACTED]'), ('{:password => "s3cret99"}', '{:password => "[REDACTED]"}'), ("x?token=abcdef12&y=1", "x?token=[REDACTED]&y=1"),
    ("Authorization: Bearer abc123def456", "Authorization: Bearer [REDACTED]"), ('u = "postgres://u:s3cr3tpw@h/db"', 'u = "postgres://u:[REDACTED]@h/db"'), ("-----BEGIN PRIVATE KEY-----\n" + "QUJD" * 16 + "\n-----END PRIVATE KEY-----\nx", "[REDACTED]\n\n\nx"[:-1].replace("\n\n\n", "\n\n") + "\nx"),
])
def test_redaction(text, out):
    got = R.redact(text)
    assert got == out and got.count("\n") == text.count("\n") and R.contains_secret(text)


@pytest.mark.parametrize("text", ['password = os.environ["X"]', 'password_hash = "abc1234"', "token_count = 5", "def f(token: str):", 'secret = "<your secret>"', 'see the password: "Enter your password now"', "apiKey: config.apiKey,", 'if password == "": pass', "password: ${PW}", "", "plain text"])
def test_redaction_keeps(text):
    assert R.redact(text) == text


def test_redaction_columns(spark):
    c = spark.createDataFrame([("r", "a.py", 'password = "hunter22x"\n'), ("r", "b.py", "x = 1"), ("r", ".env", "A=1"), ("r", "n.py", None), ("r", "z.bin", "a\x00b")], "root_id string, rel_path string, content string")
    assert {(r.rel_path, r.outcome, r.content) for r in R.indexable(c).collect()} == {("a.py", "redacted", 'password = "[REDACTED]"\n'), ("b.py", "kept", "x = 1"), (".env", "refused", None), ("z.bin", "refused", None)}
    assert R.sanitized({"a": [{"password": "s3cret99"}], "n": 1}) == {"a": [{"password": R.MARK}], "n": 1}
    assert c.limit(1).select(R.feedback_note(F.lit("token: abc and bearer abcdefgh12")).alias("x")).first().x == "token: [REDACTED] and bearer [REDACTED]"


def test_readers():
    f = configs.names_in
    assert ("package", "requests", 1) in f("requirements.txt", "requests>=2\n# no\n") and f("package-lock.json", '{"a": 1}') == []
    assert [n for k, n, _ in f("Makefile", "test: x\nlint:\nfoo:\n") if k == "check"] == ["make test", "make lint"]
    assert [n for k, n, _ in f("a/package.json", '{"scripts": {"test": "x", "go": "y"}, "dependencies": {"z": "1"}}') if k in ("check", "package")] == ["z", "cd a && npm run test"]
    assert ("resource", "Pod/web", 1) in f("k.yaml", "kind: Pod\nmetadata:\n  name: web\n") and ("key", "metadata.name", 3) in f("k.yaml", "kind: Pod\nmetadata:\n  name: web\n")
    assert [(k, n) for k, n, _ in f("q.sql", "create table a.u (id int, name text, primary key (id));\nselect ';' from U join o on 1=1;")] == [("table", "u"), ("column", "u.id"), ("column", "u.name"), ("refers", "u"), ("refers", "o")]
    assert ("route", "GET /x/y", 3) in f("api.py", "r = APIRouter(prefix='/x')\n@r.get('/y')\ndef f(): pass\n") and configs.page_route("app/(a)/blog/[id]/page.tsx") == "/blog/:id" and configs.screen_route("app/(tabs)/index.tsx") == "/"
    assert ("revision", "a1", 1) in f("m.py", "revision = 'a1'\ndown_revision = 'a0'\nop.create_table('t')\n") and f("x.json", "{broken") == [] and f("x.toml", "[") == [] and f("x.xml", "<a>") == []
    assert ("table", "tool.x", 1) in f("a.toml", "[tool.x]\nk = 1\n") and ("resource", "aws.web", 1) in f("a.tf", 'resource "aws" "web" {\n}\n') and ("setting", "A_KEY", 1) in f(".env.example", "A_KEY=1\n")
    assert ("title", "T", 2) in f("d.md", "---\ntitle: T\n---\n# H\n") and [x for x, _ in symbols._links("[a](b.md) [c](https://x) [[w|n]]")] == ["b.md", "w"]
    assert configs.xcode_targets("// !$*UTF8*$!\n{ objects = { A = { isa = PBXNativeTarget; name = App; productType = \"com.apple.product-type.application\"; }; }; }")[0][1] == "App (application)"


@pytest.mark.parametrize("lang,importer,module,key", [
    ("rust", "src/a/b.rs", "crate::x::Y", "src/x.rs"), ("rust", "src/a/mod.rs", "super::z", "src/z.rs"), ("dart", "lib/a.dart", "package:p/x.dart", "lib/x.dart"), ("java", "A.java", "com.x.B", "com/x/B.java"), ("haskell", "A.hs", "Data.X", "Data/X.hs"), ("fortran", "a.f90", "Mod_X", "mod_x"), ("pascal", "a.pas", "MyUnit", "myunit"),
    ("scss", "css/a.scss", "vars", "css/_vars.scss"), ("html", "p/a.html", "/js/x.js", "public/js/x.js"), ("hcl", "env/a.tf", "../mod", "mod/main.tf"), ("bash", "s/a.sh", "./lib.sh", "s/lib.sh"), ("c", "src/a.c", "b.h", "src/b.h"), ("lua", "a.lua", "x.y", "x/y.lua"), ("perl", "a.pl", "A::B", "A/B.pm"), ("ruby", "lib/a.rb", "./b", "lib/b.rb"),
    ("elixir", "a.ex", "MyApp.Thing", "my_app/thing.ex"), ("ocaml", "a.ml", "Util", "util.ml"), ("python", "a/b.py", "..c", "c.py"), ("python", "tools/run.py", "helper", "tools/helper.py"), ("julia", "a.jl", "x.jl", "x.jl"), ("groovy", "A.groovy", "com.x.*", "com/x"),
])
def test_import_candidates(lang, importer, module, key):
    assert key in {k for _, _, k, _ in resolve.candidates(lang, importer, module)}
    assert resolve.candidates("bash", "a.sh", "$X/lib.sh") == [] and resolve.candidates("dart", "a.dart", "dart:io") == []


def test_facts_of_languages():
    cases = {"a.rs": ("pub fn go() {}\nstruct S {}\n", {"go", "S"}), "a.rb": ("class A < B\n  def go\n  end\nend\n", {"A", "go"}), "A.kt": ("class A : B() {\n  fun go() {}\n}\n", {"A", "go"}), "a.sh": ("go() {\n  x\n}\n", {"go"}), "a.lua": ("function m.go()\nend\n", {"go"}), "a.ex": ("defmodule A.B do\n  def go(x) do\n  end\nend\n", {"B", "go"}),
             "a.hs": ("data T = T\ngo :: Int\n", {"T", "go"}), "a.css": (".x { }\n", {".x"}), "a.vue": ("<template/>\n<script>\nexport function go() {}\n</script>\n", {"go"}), "a.php": ("<?php\nclass A extends B { function go() {} }\n", {"go"}), "a.c": ("int go(int x) {\n  return 1;\n}\n", {"go"}), "A.groovy": ("class A {\n  def go() {\n  }\n}\n", {"A", "go"})}
    for path, (text, names) in cases.items():
        got = {f[2] for f in symbols.facts(text, path) if f[0] == "def"}
        assert names <= got, (path, got)
    assert symbols.facts("", "a.py") == [] and symbols.facts("x", "a.unknown") == [] and any(f[0] == "def" for f in symbols.facts("def ok():\n pass\nclass (:\n", "a.py"))


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q", "a", 1, 10), ("q", "b", 2, 20), ("q", "b", 3, 5), ("q", "c", 4, 40), ("z", "a", 1, 1)], "q string, path string, place int, tokens int")
    gold = spark.createDataFrame([("q", "b"), ("q", "n"), ("z", "a")], "q string, path string")
    g = {r.q: r for r in evaluation.gold_ranks(ranked, gold, "q").collect()}
    assert (g["q"].first, g["q"].recall_5, g["q"].missed, g["q"].all_in_5) == (2, 0.5, 1, False) and g["z"].all_in_1
    assert {r.q: r.cost for r in evaluation.task_cost(ranked, gold, "q").collect()} == {"q": 35, "z": 1}
    w = {r.q: (r.reads, r.tokens, r.located) for r in evaluation.walk(ranked, gold, "q", None, 2).collect()}
    assert w == {"q": (2, 30, False), "z": (1, 1, True)}
    a = spark.createDataFrame([("f", 10), ("f", 13), ("f", 30), ("g", 1)], "f string, n int")
    assert {(r.f, r.start, r.end) for r in evaluation.merged_windows(a, ["f"], "n", 2).collect()} == {("f", 8, 15), ("f", 28, 32), ("g", 1, 3)}
    vals = spark.createDataFrame([("g", float(i)) for i in range(20)] + [("g", None), ("h", 3.0), ("h", 3.0)], "g string, v double")
    for q in (0.05, 0.5, 0.95, 1.0):
        assert {tuple(r) for r in evaluation.nearest_rank_ranges(vals, "g", "v", q, 4).collect()} == {tuple(r) for r in evaluation.nearest_rank(vals.filter("v is not null"), "g", "v", q).collect()}
    d = spark.createDataFrame([(1, "diff --git a/x.py b/x.py\n@@ -1,2 +3,4 @@\n+a\ndiff --git a/o.py b/n.py\nrename from o.py\ndiff --git a/d.py b/d.py\ndeleted file mode 1\n@@ -1 +0,0 @@\n")], "id int, p string")
    assert {(r.status, r.path, r.old_path) for r in evaluation.patch_paths(d, "id", "p").collect()} == {("M", "x.py", None), ("R", "n.py", "o.py"), ("D", "d.py", None)}
    assert ("x.py", 3, 6) in {(r.path, r.start, r.end) for r in evaluation.patch_lines(d, "id", "p").collect()}
    ids = spark.createDataFrame([(c,) for c in "abcdefg"], "k string")
    parts = [evaluation.shard(ids, "k", i, 3) for i in (1, 2, 3)]
    assert sorted(r.k for r in evaluation.merge_shards(parts, "k").collect()) == list("abcdefg")
    with pytest.raises(ValueError):
        evaluation.merge_shards([parts[0], parts[0]], "k")
    t = spark.createDataFrame([("r", "a", "foo bar foo"), ("r", "b", "foobar"), ("r", "c", None)], "r string, path string, content string")
    assert {(x.path, x.distinct_words, x.hits) for x in evaluation.grep_ranked(t, ["foo", "bar"], ["r"]).collect()} == {("a", 2, 3)}


def test_plans(spark):
    p = plantree.create(spark, "p", "root")
    root = p.first().id
    p = plantree.split(p, root, ["one", "two"])
    one = p.filter("text = 'one'").first().id
    p = plantree.split(p, one, ["deep"])
    assert [r.line for r in plantree.rendered(p).collect()] == ["- root", "  - one", "    - deep", "  - two"]
    assert plantree.errors(p).count() == 0 and plantree.digest(p) == plantree.digest(p.repartition(3))
    with pytest.raises(ValueError):
        plantree.split(p, root, ["x"])
    bad = p.unionByName(spark.createDataFrame([("x", "y", 0, " "), ("y", "x", 0, "loop"), ("z", "gone", 0, "o")], plantree.SCHEMA))
    assert {(r.code, r.id) for r in plantree.errors(bad).collect()} == {("empty_text", "x"), ("not_reached", "x"), ("not_reached", "y"), ("not_reached", "z"), ("orphan", "z")}


def test_history(spark):
    c = spark.createDataFrame([(1, "r", "s1", T0, "add parser", None), (2, "r", "s2", T0, "fix parser window", "body"), (3, "r", "s2", T0, "fix parser scope", "body"), (4, "r", "s3", T0, "other", "")], "id bigint, root_id string, sha string, commit_date timestamp, subject string, body string")
    f = spark.createDataFrame([(1, "A", "src/a.py", None), (3, "R", "src/b.py", "src/old.py"), (4, "D", "src/gone.py", None)], "commit_id bigint, status string, path string, old_path string")
    table = history.commit_table(c, f)
    assert {r.sha: r.subject for r in table.collect()}["s2"] == "fix parser scope"
    assert [r.sha for r in history.search(table, "parser scope").orderBy("place").collect()][0] == "s2" and [r.sha for r in history.search(table, "src/old.py").collect()] == ["s2"]
    lost = {(r.name, r.change, r.new_path) for r in history.lost_mentions(c, f, spark.createDataFrame([("r", "src/a.py")], "root_id string, rel_path string"), "see gone.py, old.py and a.py").collect()}
    assert lost == {("gone.py", "deleted", None), ("old.py", "renamed", "src/b.py")}
    pre = spark.createDataFrame([("s", 100, ["a"]), ("s", 150, ["a", "b"]), ("s", 200, ["z"]), ("s", 300, ["a"])], "session string, at bigint, top array<string>")
    com = spark.createDataFrame([("s", "c", 99, 200, ["a", "b"])], "session string, commit string, parent_at bigint, at bigint, changed array<string>")
    assert [(r["at"], r.overlap) for r in history.usage(pre, com).collect()] == [(150, 2)]


def test_graph_lineage(spark):
    rev = spark.createDataFrame([("r", "m/1.py", "a", None), ("r", "m/2.py", "b", "a"), ("r", "m/3.py", "c", "b"), ("r", "m/4.py", "b2", "x")], "root_id string, rel_path string, revision string, down string")
    assert {(r.rel_path, r.target) for r in resolve.lineage(rev).collect()} == {("m/2.py", "m/1.py"), ("m/3.py", "m/2.py")}
    t = spark.createDataFrame([("r", "t1.sql", "Users", "i1"), ("r", "t2.sql", "users", "i2")], "root_id string, rel_path string, name string, symbol_id string")
    refs = spark.createDataFrame([("r", "t1.sql", "users"), ("r", "q.sql", "USERS"), ("r", "q.sql", "nope")], "root_id string, rel_path string, name string")
    assert {(r.rel_path, r.symbol_id) for r in resolve.resolve_tables(refs, t).collect()} == {("t1.sql", "i2"), ("q.sql", "i1")} and resolve.resolve_only(refs, t).count() == 0
    e = spark.createDataFrame([("h", f"n{i}") for i in range(50)], "source string, target string")
    assert graph.reach(e, spark.createDataFrame([("n1",)], "id string"), 2, undirected=True).count() == 51


def test_partners_and_merged_definitions(spark):
    links = spark.createDataFrame([("r", "a", "b", "imports"), ("r", "b", "c", "calls"), ("r", "c", "d", "calls"), ("r", "d", "e", "calls"), ("q", "a", "e", "imports")], "root_id string, source string, target string, relation string")
    missed, found = spark.createDataFrame([("r", "b"), ("r", "d"), ("r", "e")], "root_id string, rel_path string"), spark.createDataFrame([("r", "a")], "root_id string, rel_path string")
    got = {r.rel_path: (r.hops, r.relations) for r in codegraph.partner_links(links, missed, found).collect()}
    assert got == {"b": (1, ["<-imports-"]), "d": (3, []), "e": (None, [])}
    d = spark.createDataFrame([("r", "f", "s.css", "css", "rule", ".x", "", 1, 2), ("r", "f", "s.css", "css", "rule", ".x", "", 4, 5), ("r", "f", "s.css", "css", "rule", ".y", "", 7, 8), ("r", "f", "s.css", "css", "rule", ".y", "", 20, 21)], "root_id string, file_id string, rel_path string, language string, kind string, name string, owner string, line_start int, line_end int")
    assert {(r.name, r.line_start, r.line_end) for r in symbols.merged_rules(d).collect()} == {(".x", 1, 5), (".y", 7, 8)}
    assert {(r.name, r.line_start, r.line_end) for r in symbols.merged_clauses(d).collect()} == {(".x", 1, 5), (".y", 7, 21)}

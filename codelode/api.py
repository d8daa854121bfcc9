"""The engine as one object: everything a user asks of indexed repositories, as DataFrames over all roots.

    engine = Engine.over(spark, "/data/tables")
    engine.find("Fix the render window", languages=["py"]).show()
    engine.symbol("render_window", relation="callers").show()

Nothing is computed until it is asked for; the index, the symbols and the graph are built once and kept in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions import roles as R
from codelode.functions.query import Query, headline
from codelode.functions.redaction import redact
from codelode.operators import chunks, codegraph, configs, feedback, history, incremental, lookup, plantree, ranking, symbols
from codelode.session import cut, table
from codelode.sources.generations import Generations

#: What each reader takes and gives; a table, so nothing has to be registered.
READERS = [("python", "py pyi", "definitions, imports, calls, bases, routes, migrations"), ("script", "js jsx ts tsx mjs cjs", "definitions, imports, exports, calls, bases"), ("markdown", "md mdx", "headings, links, front matter"), ("sql", "sql", "objects, columns, references"),
           ("settings", "yaml json toml xml tf", "keys, resources, packages, checks"), ("page", "html vue svelte", "ids, sources, embedded scripts and styles"), ("document", "docx xlsx pptx pdf svg", "sections, sheets, slides, pages"), ("source", "go rs java kt cs php swift rb scala groovy c cpp sh lua pl dart zig ex hs ml r jl sol f90 pas", "definitions, imports, calls")]


@dataclass
class Engine:
    """Answers over tables ``files``, ``contents``, ``chunks``, ``commits``, ``commit_files`` and, where there are some, feedback ``records``."""

    spark: SparkSession
    files: DataFrame
    contents: DataFrame
    chunks: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    records: DataFrame | None = None

    @classmethod
    def over(cls, spark: SparkSession, folder: str) -> Engine:
        """An engine over a folder of tables."""
        return cls(spark, *(table(spark, folder, n) for n in ("files", "contents", "semantic_chunks", "commits", "commit_files")))

    @cached_property
    def index(self) -> DataFrame:
        return cut(lookup.file_index(self.files, self.contents))

    @cached_property
    def symbols(self) -> DataFrame:
        return cut(symbols.symbols(symbols.code_facts(self.contents)))

    @cached_property
    def pieces(self) -> DataFrame:
        return cut(chunks.symbol_texts(self.contents))

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = codegraph.build(self.contents)
        return cut(nodes), cut(edges)

    @cached_property
    def facts(self) -> DataFrame:
        return cut(configs.config_facts(self.contents))

    def find(self, text: str, limit: int = 10, graph: bool = False, semantic: bool = False, languages: list[str] | None = None, path_globs: list[str] | None = None, exclude_globs: list[str] | None = None, offset: int = 0) -> DataFrame:
        """The ranked lookup: (root_id, rel_path, place, score, evidence, ranges)."""
        nodes, edges = self.graph if graph else (None, None)
        found = None
        if self.records is not None:
            found = feedback.signals(self.records, text).join(self.index.select(*lookup.KEYS), lookup.KEYS, "left_semi")
        sem = ranking.semantic_scores(self.chunks, text).join(self.index.select(*lookup.KEYS), lookup.KEYS, "left_semi") if semantic else None
        return lookup.find(self.index, self.symbols, self.pieces, redact(text), limit, nodes, edges, found, sem, offset=offset, include=path_globs, exclude=exclude_globs, languages=languages)

    def snippets(self, rows: DataFrame, text: str, lines: int = 8, chars: int = 800) -> DataFrame:
        """``rows`` with ``snippet``: the line with most query terms and those after it, within the line and character budget of a row."""
        terms = F.array(*map(F.lit, Query(text).terms)) if Query(text).terms else F.array().cast("array<string>")
        body = self.index.select(*lookup.KEYS, F.split("body", "\n").alias("_l"))
        hit = F.transform("_l", lambda x, i: F.struct(F.size(F.filter(terms, lambda t: F.contains(F.lower(x), t))).alias("n"), (-i).alias("i")))
        best = -F.array_max(hit)["i"]
        part = F.substring(F.array_join(F.slice("_l", best + 1, F.lit(lines)), "\n"), 1, chars)
        return rows.join(body, lookup.KEYS, "left").withColumn("snippet", part).drop("_l")

    def preflight(self, text: str, limit: int = 8) -> DataFrame:
        """(root_id, place, rel_path, score, ranges, test): what to read first: files with a tenth of the best score and more, named ones first, then likely edit surfaces; and whether each is a test."""
        rows = self.find(text, limit, graph=True)
        best = F.max("score").over(Window.partitionBy("root_id"))  # a page of rows
        rows = rows.withColumn("_b", best).filter(F.col("score") >= 0.1 * F.col("_b"))
        exact = lookup.exact_paths(self.index, Query(text)).withColumn("_x", F.lit(1))
        bucket = F.lit(0) if Query(text).tests else F.when(F.col("_x") == 1, 0).when(R.is_edit_surface(F.col("rel_path")), 1).otherwise(2)
        order = Window.partitionBy("root_id").orderBy("_k", "place")
        rows = rows.join(exact, lookup.KEYS, "left").withColumn("_k", bucket)
        return rows.withColumn("place", F.row_number().over(order)).select("root_id", "place", "rel_path", "score", "ranges", R.is_test(F.col("rel_path")).alias("test"))

    def pack(self, text: str) -> DataFrame:
        """(root_id, place, line): the Markdown lines of a task pack: the task, what to read with its lines, the tests that reach it, and the checks to run."""
        first = cut(self.preflight(text))
        ranges = F.array_join(F.transform(F.coalesce("ranges", F.array().cast("array<struct<start:int,end:int,name:string>>")), lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ", ")
        part = lambda rows, n, line: rows.select("root_id", F.lit(n).alias("part"), F.col("place").alias("at"), line.alias("line"))
        head = first.select("root_id").distinct().select("root_id", F.lit(0).alias("part"), F.lit(0).alias("at"), F.lit(f"# Task: {headline(redact(text))}").alias("line"))
        rows = head.unionByName(part(first, 1, F.concat(F.lit("- `"), "rel_path", F.lit("`"), F.when(ranges != "", F.concat(F.lit(" lines "), ranges)).otherwise(F.lit("")))))
        tests = codegraph.test_files(*self.graph, first.filter("not test").select(*lookup.KEYS))
        rows = rows.unionByName(part(tests, 2, F.concat(F.lit("- test `"), "rel_path", F.lit("`"))))
        rows = rows.unionByName(part(self.checks().join(first.select("root_id").distinct(), "root_id", "left_semi"), 3, F.concat(F.lit("- run `"), "command", F.lit("`"))))
        order = Window.partitionBy("root_id").orderBy("part", "at", "line")
        return rows.withColumn("place", F.row_number().over(order)).select("root_id", "place", "line")

    def checks(self, most: int = 8) -> DataFrame:
        """(root_id, place, command): at most ``most`` commands each root checks itself with, those at its top first."""
        c = self.facts.filter("kind = 'check'").groupBy("root_id", F.col("name").alias("command")).agg(F.min(F.size(F.split("rel_path", "/"))).alias("_d"))
        order = Window.partitionBy("root_id").orderBy("_d", "command")  # the few commands of a root
        return c.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("root_id", "place", "command")

    def symbol(self, name: str, relation: str | None = None, depth: int = 1, rel_path: str | None = None) -> DataFrame:
        """The callers or callees of a symbol, or without a relation the symbols whose name holds ``name``: exact ones first, then by kind, path and line."""
        nodes, edges = self.graph
        if relation in ("callers", "callees"):
            return codegraph.call_rows(nodes, edges, name, depth, relation == "callers", rel_path)
        kind = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).when(F.col("kind") == "method", 2).otherwise(3)
        hit = self.symbols.filter(F.contains(F.lower("name"), F.lit(name.lower()))).withColumn("_e", F.when(F.col("name") == name, 0).otherwise(1)).withColumn("_k", kind)
        return lookup.best_of(hit, ["root_id"], [F.asc("_e"), F.asc("_k"), F.asc("rel_path"), F.asc("line_start"), F.asc("symbol_id")], 50, "symbol_id").drop("_e", "_k")

    def outline(self, rel_path: str) -> DataFrame:
        """The symbols of a file in order; a file without any has one row with nulls."""
        s = self.symbols.filter("kind in ('class', 'function', 'method', 'heading')").select("root_id", "rel_path", "name", "kind", "line_start", "line_end")
        return self.index.filter(F.col("rel_path") == rel_path).select(*lookup.KEYS).join(s, lookup.KEYS, "left").orderBy("root_id", "line_start", "name")

    def related(self, text: str, limit: int = 10) -> DataFrame:
        rows = lookup.graph_scores(*self.graph, Query(text))
        return lookup.page(rows.withColumnRenamed("graph_score", "score"), limit)

    def semantic(self, text: str, limit: int = 10) -> DataFrame:
        return lookup.page(ranking.semantic_scores(self.chunks, text), limit)

    def explain(self, text: str, limit: int = 5) -> dict[str, DataFrame]:
        """The files, symbols and edges behind an answer."""
        rows = cut(self.find(text, limit, graph=True))
        chosen = rows.select(*lookup.KEYS)
        return {"files": rows, "symbols": self.symbols.join(chosen, lookup.KEYS, "left_semi"), "edges": codegraph.touching_edges(*self.graph, chosen)}

    def why(self, rel_path: str, text: str, window: int = 100) -> DataFrame:
        """(root_id, place, score, evidence): where one file stands for a query among the first ``window``; no row where it does not."""
        return self.find(text, window).filter(F.col("rel_path") == rel_path).select("root_id", "place", "score", "evidence")

    def path(self, source: str, target: str, hops: int = 6) -> DataFrame:
        """A shortest way between two nodes, named by id."""
        from codelode.operators import graph

        return graph.shortest_path(self.graph[1], source, target, hops)

    def impact(self, rel_path: str, depth: int = 3) -> DataFrame:
        goal = self.index.filter(F.col("rel_path") == rel_path).select(*lookup.KEYS)
        return codegraph.impact(*self.graph, goal, depth)

    def history(self, text: str, limit: int = 10) -> DataFrame:
        return history.search(history.commit_table(self.commits, self.commit_files), text, limit)

    def lost(self, text: str) -> DataFrame:
        """Files a text names that are gone, with the commits that removed them."""
        return history.lost_mentions(self.commits, self.commit_files, self.index, text)

    def feedback(self) -> DataFrame:
        """How past records went; empty without records."""
        return feedback.stats(self.records) if self.records is not None else self.spark.createDataFrame([], "root_id string, outcome string, records bigint")

    def status(self) -> DataFrame:
        """(root_id, files, covered, status) of the chunks, and below it what is stale is in ``stale``."""
        return incremental.health(self.chunks, self.files)

    def stale(self) -> DataFrame:
        """(root_id, rel_path, status): paths whose newest text is not the one indexed."""
        named = "root_id is not null and rel_path is not null"
        return incremental.changes(self.files.filter(named), self.contents.filter(named).withColumn("hash", F.sha2("content", 256)), lookup.KEYS, "hash", "indexed_at", "modification_time")

    def digest(self) -> str:
        """A digest of the index that no order, machine or partitioning changes."""
        return incremental.digest(self.index.select(*lookup.KEYS, "file_id"), [*lookup.KEYS, "file_id"]).first().digest

    def publish(self, folder: str, created_at: str) -> str | None:
        """Writes the index, symbols, pieces and graph as a generation; None where nothing changed."""
        nodes, edges = self.graph
        return Generations(self.spark, folder).publish({"files": self.index, "symbols": self.symbols, "pieces": self.pieces, "nodes": nodes, "edges": edges}, created_at)

    def route(self, text: str, groups: dict[str, list[str]], limit: int = 3) -> DataFrame:
        """(name, score): groups of words by how much of them a query and its first files hold: two for a word of the query, one for a word of a path; ties by name. The groups are the caller's."""
        rows = self.find(text, 10).select("rel_path")
        q = set(Query(text).terms)
        parts = [(n, 2 * len(q & set(ws))) for n, ws in sorted(groups.items())]
        paths = rows.agg(*[F.sum(F.lower("rel_path").rlike("|".join(map(_plain, ws))).cast("int")).alias(n) for n, ws in sorted(groups.items())]).first()  # one row
        scored = [(n, s + int(paths[n] or 0)) for n, s in parts]
        return self.spark.createDataFrame(sorted(scored, key=lambda x: (-x[1], x[0]))[:limit], "name string, score int")

    def gates(self, text: str, patterns: dict[str, str]) -> list[str]:
        """The names of the patterns a query or its first files match; the patterns are the caller's."""
        rows = self.find(text, 10).agg(*[F.max(F.col("rel_path").rlike(p).cast("int")).alias(n) for n, p in patterns.items()]).first()
        import re

        return sorted(n for n, p in patterns.items() if re.search(p, text) or rows[n])

    def adapters(self) -> DataFrame:
        """(name, endings, facts) of the readers."""
        return self.spark.createDataFrame(READERS, "name string, endings string, facts string")

    def adapter_for(self, extension: str) -> str | None:
        return next((n for n, ends, _ in READERS if extension.lower().lstrip(".") in ends.split()), None)

    def plan(self, name: str, text: str) -> DataFrame:
        return plantree.create(self.spark, name, text)

    def candidates(self, pattern: str) -> list[str]:
        """Symbol names that a search pattern asks for as whole names, of those the index knows: its parts between bars, without anchors and brackets."""
        import re

        names = sorted({m for part in re.split(r"\|", pattern) for m in re.findall(r"^\W*(?:\\b)?([A-Za-z_]\w{2,})(?:\\b)?\W*$", part.strip())})
        return [r.name for r in self.symbols.filter(F.col("name").isin(*names)).select("name").distinct().orderBy("name").collect()] if names else []  # no more than the pattern has names


def _plain(word: str) -> str:
    import re

    return re.escape(word.lower())

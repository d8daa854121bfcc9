"""Queries over the graph of files and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import codegraph, graph, lookup, resolve, symbols
from codelode.functions.query import Query
from codelode.session import cut, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _graph(spark, sf):
    nodes, edges = codegraph.build(table(spark, sf, "contents"))
    return cut(nodes), cut(edges)


@query()
def code_facts(spark, sf):
    """How many facts of each kind the files of each language and root hold."""
    f = symbols.code_facts(table(spark, sf, "contents"))
    return f.groupBy("root_id", "language", "fact").agg(F.count("*").alias("facts"))


@query()
def imported_files(spark, sf):
    """Imports of every language joined to the files of their root."""
    c = table(spark, sf, "contents")
    return resolve.resolve_imports(cut(symbols.code_facts(c)), c.select("root_id", "rel_path"), None, codegraph.go_modules(c))


@query()
def graph_edges(spark, sf):
    """How many edges of each relation and confidence each root's graph has."""
    return _graph(spark, sf)[1].groupBy("root_id", "relation", "confidence").agg(F.count("*").alias("edges"))


@query()
def symbol_callers(spark, sf):
    """For the most called symbol of each root its callers within three calls."""
    nodes, edges = _graph(spark, sf)
    called = edges.filter("relation = 'calls'").groupBy("root_id", F.col("target").alias("id")).agg(F.count("*").alias("n"))
    best = called.groupBy("root_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("b")).select("root_id", "b.id")
    return codegraph.call_relations(edges, best, 3)


@query()
def change_impact(spark, sf):
    """What a change of each root's most imported file reaches, and which of that are tests."""
    nodes, edges = _graph(spark, sf)
    n = edges.filter("relation = 'imports'").groupBy("root_id", F.col("target").alias("id")).agg(F.count("*").alias("n"))
    best = n.groupBy("root_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("b")).select("root_id", "b.id")
    goal = nodes.join(best, ["root_id", "id"]).select("root_id", "rel_path")
    return codegraph.impact(nodes, edges, goal)


@query()
def related_files(spark, sf):
    """Files by their place in the graph for a task."""
    nodes, edges = _graph(spark, sf)
    return lookup.page(lookup.graph_scores(nodes, edges, Query("render window parse scope")).withColumnRenamed("graph_score", "score").select("root_id", "rel_path", "score"), 10)


@query()
def code_communities(spark, sf):
    """The communities of the graph and their hubs."""
    nodes, edges = _graph(spark, sf)
    return graph.hubs(edges, graph.communities(nodes, edges))


@query()
def graph_report(spark, sf):
    return codegraph.graph_report(*_graph(spark, sf))


_FOLDER = "case when contains(rel_path, '/') then regexp_replace(rel_path, '/[^/]*$', '') else '.' end"


@query(f"select root_id, {_FOLDER} folder, count(*) files from (select distinct root_id, rel_path from files where root_id is not null and rel_path is not null) group by 1, 2")
def folder_clusters(spark, sf):
    return codegraph.folder_clusters(table(spark, sf, "files"))


@query(r"""
with i as (select root_id, rel_path, regexp_extract(u, '["'']([^"'']+)["'']', 1) m from (select root_id, rel_path, unnest(regexp_extract_all(content, '(?:\bfrom|\bimport)\s*\(?\s*["''](\.[^"''\n]+)["'']')) u
  from (select root_id, rel_path, content, row_number() over (partition by root_id, rel_path order by modification_time desc nulls last, content desc) rn from contents where root_id is not null and rel_path is not null and content is not null and regexp_matches(rel_path, '\.(js|ts)$')) where rn = 1)),
n as (select distinct root_id, rel_path, regexp_replace(m, '\.(js)$', '') m from i),
j as (select *, string_split(regexp_replace(rel_path, '/?[^/]*$', ''), '/') d, len(m) - len(ltrim(m, '.')) dots, len(regexp_extract_all(m, '\.\./')) ups, regexp_replace(m, '^(\.{1,2}/)+', '') rest from n),
b as (select root_id, rel_path, m, array_to_string(list_concat(list_slice(d, 1, len(d) - ups), [rest]), '/') base from j where len(d) >= ups),
p as (select distinct root_id, rel_path target from contents where rel_path is not null),
k as (select b.*, unnest(['.ts', '.tsx', '.mts', '.cts', '.d.ts', '.js', '.jsx', '.mjs', '.cjs', '.vue', '.svelte', '.json']) e, unnest(range(12)) o from b),
h as (select k.root_id, k.rel_path, k.m, p.target, row_number() over (partition by k.root_id, k.rel_path, k.m order by o) rn from k join p on k.root_id = p.root_id and p.target = ltrim(k.base, '/') || k.e)
select root_id, rel_path, target from h where rn = 1 and rel_path <> target group by 1, 2, 3""")
def script_imports(spark, sf):
    """Relative imports of scripts, joined to the files they name without or with an ending."""
    c = table(spark, sf, "contents")
    rows = QUERIES["imported_files"](spark, sf).filter(F.col("rel_path").rlike(r"\.(js|ts)$") & F.col("module").startswith("."))
    return rows.select("root_id", "rel_path", "target").distinct()

"""The graph of files and symbols: its build, who calls whom, what a change reaches, which tests see it, and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions import roles as R
from codelode.functions.text import stable_id
from codelode.operators import graph, resolve, symbols
from codelode.operators.joins import salted_join
from codelode.session import cut

KINDS_FIRST = ("class", "function", "method")


def normal_label(label: Column) -> Column:
    """Lower case, separators as one space."""
    return F.trim(F.lower(F.regexp_replace(label, r"[\s_\-./\\:]+", " ")))


def file_nodes(paths: DataFrame) -> DataFrame:
    """(id, root_id, rel_path, kind, label, line_start): one node for each path."""
    p = paths.filter("root_id is not null and rel_path is not null").select("root_id", "rel_path").distinct()
    return p.select(stable_id(F.col("root_id"), F.col("rel_path")).alias("id"), "root_id", "rel_path", F.lit("file").alias("kind"), F.col("rel_path").alias("label"), F.lit(None).cast("int").alias("line_start"))


def build(contents: DataFrame, declared_modules: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the newest texts: files and their definitions; defines, imports, calls, inherits and links between them.

    Nodes have id, root_id, rel_path, kind, label, line_start, line_end; edges root_id, source, target, relation, confidence. Edges without both ends
    are dropped; equal ones are one, EXTRACTED before INFERRED. Facts and definitions are written once, as every edge family reads them.
    """
    found = cut(symbols.code_facts(contents))
    defs = cut(symbols.symbols(found))
    paths = contents.select("root_id", "rel_path")
    files = file_nodes(paths)
    nodes = files.withColumn("line_end", F.lit(None).cast("int")).unionByName(defs.select(F.col("symbol_id").alias("id"), "root_id", "rel_path", "kind", F.col("name").alias("label"), "line_start", "line_end"))
    fid = lambda c: stable_id(F.col("root_id"), F.col(c))
    declared = defs.filter("language in ('haskell', 'fortran') and kind = 'class'").select("root_id", F.when(F.col("language") == "fortran", F.lower("name")).otherwise(F.col("name")).alias("name"), "rel_path") if declared_modules else None
    imports = cut(resolve.resolve_imports(found, paths, declared, go_modules(contents)))
    edge = lambda rows, s, t, rel, conf: rows.select("root_id", s.alias("source"), t.alias("target"), F.lit(rel).alias("relation"), conf.alias("confidence"))
    sure = F.lit(resolve.EXTRACTED)
    rows = edge(defs, fid("rel_path"), F.col("symbol_id"), "defines", sure)
    rows = rows.unionByName(edge(imports, fid("rel_path"), fid("target"), "imports", F.col("confidence")))
    calls = resolve.resolve_calls(found, defs, imports)
    rows = rows.unionByName(edge(calls, F.coalesce("caller", fid("rel_path")), F.col("callee"), "calls", F.col("confidence")))
    rows = rows.unionByName(edge(resolve.resolve_bases(found, defs, imports), F.col("child"), F.col("parent"), "inherits", F.col("confidence")))
    rows = rows.unionByName(edge(resolve.resolve_links(found, paths), fid("rel_path"), fid("target"), "references", sure))
    kept = graph.without_dangling(rows.filter("source <> target"), nodes)
    return nodes, kept.groupBy("root_id", "source", "target", "relation").agg(F.min("confidence").alias("confidence"))


def go_modules(contents: DataFrame) -> DataFrame:
    """(root_id, prefix, folder) of the module files of the newest texts."""
    c = symbols.newest_texts(contents).filter(F.col("rel_path").rlike(r"(^|/)go\.mod$"))
    prefix = F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1)
    return c.select("root_id", prefix.alias("prefix"), F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("folder")).filter("prefix <> ''")


def folder_clusters(paths: DataFrame) -> DataFrame:
    """(root_id, folder, files): how many paths lie in each folder; those at the top lie in ``.``."""
    folder = F.when(F.col("rel_path").contains("/"), F.regexp_replace("rel_path", r"/[^/]*$", "")).otherwise(".")
    return paths.filter("root_id is not null and rel_path is not null").select("root_id", "rel_path").distinct().groupBy("root_id", folder.alias("folder")).agg(F.count("*").alias("files"))


def call_relations(edges: DataFrame, start: DataFrame, depth: int, callers: bool = True) -> DataFrame:
    """(start, id, depth, confidence): who calls the symbols of ``start`` (column ``id``), or whom they call, within ``depth`` calls.

    A node has its smallest depth; it is EXTRACTED if some shortest chain to it is so throughout. Each hop meets the edges of the last frontier alone, on
    salted copies, so a symbol that a third of all code calls is spread.
    """
    a, b = ("target", "source") if callers else ("source", "target")
    steps = cut(edges.filter("relation = 'calls'").groupBy(F.col(a).alias("_from"), F.col(b).alias("_to")).agg(F.min("confidence").alias("_c")))
    front = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.lit(True).alias("_sure")).distinct()
    seen = cut(front)
    front, parts = seen, [seen]
    for hop in range(1, depth + 1):
        nxt = salted_join(steps, front.select("start", F.col("id").alias("_from"), "_sure"), ["_from"], ["_to"]).groupBy("start", F.col("_to").alias("id")).agg(F.max(F.col("_sure") & (F.col("_c") == resolve.EXTRACTED)).alias("_sure"))
        for p in parts:
            nxt = nxt.join(p.select("start", "id"), ["start", "id"], "left_anti")
        front = cut(nxt.select("start", "id", F.lit(hop).alias("depth"), "_sure"))
        if front.isEmpty():
            break
        parts.append(front)
    out = parts[0].limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("start", "id", "depth", F.when(F.col("_sure"), resolve.EXTRACTED).otherwise(resolve.INFERRED).alias("confidence"))


def call_rows(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 3, callers: bool = True, rel_path: str | None = None) -> DataFrame:
    """(root_id, of, rel_path, label, line_start, depth, confidence): the callers or callees of a name in each root, files with most of them first in ``place``.

    A name that several symbols of a root have is ambiguous and gives nothing unless ``rel_path`` narrows it to one.
    """
    hit = nodes.filter((F.col("kind") != "file") & (F.col("label") == name))
    if rel_path is not None:
        hit = hit.filter(F.col("rel_path") == rel_path)
    one = hit.groupBy("root_id").agg(F.min("id").alias("id"), F.max("id").alias("_b")).filter("id = _b").select("root_id", "id")
    found = call_relations(edges, one, depth, callers).join(nodes.select("id", "root_id", "rel_path", "label", "line_start"), "id")
    n = F.count("*").over(Window.partitionBy("root_id", "rel_path"))
    order = Window.partitionBy("root_id").orderBy(F.desc("_n"), "rel_path", "depth", "line_start", "label", "id")  # the neighbours of one symbol
    return found.withColumn("_n", n).withColumn("place", F.row_number().over(order)).select("root_id", F.col("start").alias("of"), "rel_path", "label", "line_start", "depth", "confidence", "place")


def importing_files(nodes: DataFrame, edges: DataFrame, goal: DataFrame) -> DataFrame:
    """(root_id, rel_path, target): the files that import the files of ``goal`` (root_id, rel_path)."""
    files = nodes.filter("kind = 'file'").select("id", "root_id", "rel_path")
    ids = files.join(goal.select("root_id", "rel_path").distinct(), ["root_id", "rel_path"]).select(F.col("id").alias("target"), F.col("rel_path").alias("_t"))
    rows = salted_join(edges.filter("relation = 'imports'").select("source", "target"), ids, ["target"], ["source"])
    return rows.join(files.withColumnRenamed("id", "source"), "source").select("root_id", "rel_path", F.col("_t").alias("target")).distinct()


def referencing_files(nodes: DataFrame, edges: DataFrame, goal: DataFrame) -> DataFrame:
    """(root_id, rel_path, target): the files with a reference onto the files of ``goal`` or onto their symbols."""
    ids = nodes.join(goal.select("root_id", "rel_path").distinct(), ["root_id", "rel_path"]).select(F.col("id").alias("target"), F.col("rel_path").alias("_t"))
    rows = salted_join(edges.filter("relation = 'references'").select("source", "target"), ids, ["target"], ["source"])
    return rows.join(nodes.select(F.col("id").alias("source"), "root_id", "rel_path"), "source").select("root_id", "rel_path", F.col("_t").alias("target")).filter("rel_path <> target").distinct()


def impact(nodes: DataFrame, edges: DataFrame, goal: DataFrame, depth: int = 3) -> DataFrame:
    """(root_id, rel_path, how, depth, is_test): what a change of the files of ``goal`` reaches: callers of their symbols by the fewest calls, importing and referencing files."""
    starts = nodes.filter("kind <> 'file'").join(goal.select("root_id", "rel_path").distinct(), ["root_id", "rel_path"]).select("id")
    by_call = call_relations(edges, starts, depth).join(nodes.select("id", "root_id", "rel_path"), "id").groupBy("root_id", "rel_path").agg(F.min("depth").alias("depth"))
    rows = by_call.select("root_id", "rel_path", F.lit("calls").alias("how"), "depth")
    for how, f in (("imports", importing_files), ("references", referencing_files)):
        rows = rows.unionByName(f(nodes, edges, goal).select("root_id", "rel_path", F.lit(how).alias("how"), F.lit(1).alias("depth")).distinct())
    rows = rows.join(goal.select("root_id", "rel_path").distinct(), ["root_id", "rel_path"], "left_anti")
    return rows.withColumn("is_test", R.is_test(F.col("rel_path")))


def test_files(nodes: DataFrame, edges: DataFrame, goal: DataFrame, most: int = 8) -> DataFrame:
    """(root_id, rel_path, depth, place): at most ``most`` test files of each root that reach the symbols of ``goal`` within two calls, nearest first."""
    rows = impact(nodes, edges, goal, 2).filter("is_test and how = 'calls'").groupBy("root_id", "rel_path").agg(F.min("depth").alias("depth"))
    place = F.row_number().over(Window.partitionBy("root_id").orderBy("depth", "rel_path"))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def exact_surface(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes that a text names exactly: by id or label, else in any case, else by file path; the best kind of each root alone (``rank``)."""
    low = F.lower(F.lit(text))
    rank = F.when((F.col("id") == text) | (F.col("label") == text), 1).when(F.lower("label") == low, 2).when(F.col("rel_path") == text, 3)
    rows = nodes.withColumn("rank", rank).filter("rank is not null")
    best = rows.groupBy("root_id").agg(F.min("rank").alias("rank"))
    return salted_join(rows, best, ["root_id", "rank"], ["id"])


def surface(nodes: DataFrame, text: str, most: int = 5) -> DataFrame:
    """(root_id, id, label, score, place): the ``most`` nodes of each root that hold a text: 10, and 20 for its beginning, 15 for its end, 25 for all of the label."""
    t = text.lower()
    label = F.lower("label")
    score = F.lit(10) + F.when(F.startswith(label, F.lit(t)), 20).otherwise(0) + F.when(F.endswith(label, F.lit(t)), 15).otherwise(0) + F.when(label == t, 25).otherwise(0)
    from codelode.operators.lookup import best_of

    rows = nodes.filter(F.contains(label, F.lit(t))).select("root_id", "id", "label", "rel_path", score.alias("score"))
    return best_of(rows, ["root_id"], [F.desc("score"), F.asc("label"), F.asc("id")], most, "id").drop("rel_path")


def surface_evidence(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """(root_id, nodes, edges): how many nodes of each root hold a text and how many edges touch them."""
    hit = nodes.filter(F.contains(F.lower("label"), F.lit(text.lower()))).select("root_id", "id")
    n = hit.groupBy("root_id").agg(F.count("*").alias("nodes"))
    ends = edges.select("root_id", F.struct("source", "target", "relation").alias("e"), F.explode(F.array("source", "target")).alias("id")).join(hit.select("id"), "id", "left_semi")
    e = ends.select("root_id", "e").distinct().groupBy("root_id").agg(F.count("*").alias("edges"))
    return n.join(e, "root_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def touching_edges(nodes: DataFrame, edges: DataFrame, chosen: DataFrame, most: int = 12, both: bool = False) -> DataFrame:
    """At most ``most`` edges of each root that touch the chosen files (root_id, rel_path), or with ``both`` lie between them: across files first, definitions last, then in order."""
    ids = nodes.join(chosen.select("root_id", "rel_path").distinct(), ["root_id", "rel_path"], "left_semi").select("id", F.col("rel_path").alias("_p"))
    s, t = ids.withColumnsRenamed({"id": "source", "_p": "_sp"}), ids.withColumnsRenamed({"id": "target", "_p": "_tp"})
    rows = edges.join(s, "source", "inner" if both else "left").join(t, "target", "inner" if both else "left").filter(F.col("_sp").isNotNull() | F.col("_tp").isNotNull())
    across = F.when(F.col("_sp").eqNullSafe(F.col("_tp")), 1).otherwise(0)
    order = Window.partitionBy("root_id").orderBy(across, F.when(F.col("relation") == "defines", 1).otherwise(0), "source", "target", "relation")  # edges of the few chosen files
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("root_id", "source", "target", "relation", "confidence", "place")


def surprising_edges(nodes: DataFrame, edges: DataFrame, groups: DataFrame, most: int = 10) -> DataFrame:
    """(root_id, source, target, relation, score, place): edges between communities, by how unexpected they are: 2 if inferred, else 1; 2 for other kinds of file, 2 for
    other top folders, 1 between a hub (degree of 8 and more) and a node of degree two and less. Ties by source, target and relation."""
    d = graph.degrees(edges)
    category = F.when(R.is_test(F.col("rel_path")), "test").when(R.is_doc(F.col("rel_path")), "doc").otherwise("code")
    top = F.regexp_extract("rel_path", "^([^/]+)/", 1)
    n = nodes.select("id", category.alias("c"), top.alias("f")).join(d, "id").join(groups, "id")
    s, t = n.select(*[F.col(x).alias(y) for x, y in (("id", "source"), ("c", "sc"), ("f", "sf"), ("degree", "sd"), ("community", "sm"))]), n.select(*[F.col(x).alias(y) for x, y in (("id", "target"), ("c", "tc"), ("f", "tf"), ("degree", "td"), ("community", "tm"))])
    rows = edges.join(s, "source").join(t, "target").filter("sm <> tm")
    score = F.when(F.col("confidence") == resolve.INFERRED, 2).otherwise(1) + F.when(F.col("sc") != F.col("tc"), 2).otherwise(0) + F.when(F.col("sf") != F.col("tf"), 2).otherwise(0)
    score = score + F.when((F.greatest("sd", "td") >= 8) & (F.least("sd", "td") <= 2), 1).otherwise(0)
    from codelode.operators.lookup import best_of

    return best_of(rows.select("root_id", "source", "target", "relation", score.alias("score")), ["root_id"], [F.desc("score"), F.asc("source"), F.asc("target"), F.asc("relation")], most, "source")


def graph_report(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(root_id, place, line): a Markdown report of each root's graph: counts, the nodes of highest degree, the most unexpected edges. Its parts are bounded, so the lines of a root are few."""
    from codelode.operators.lookup import best_of

    counts = nodes.groupBy("root_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "file", 1)).alias("f")).join(edges.groupBy("root_id").agg(F.count("*").alias("e")), "root_id", "left")
    head = counts.select("root_id", F.lit(0).alias("part"), F.lit(0).alias("place"), F.concat(F.lit("# Graph: "), F.col("n").cast("string"), F.lit(" nodes in "), F.col("f").cast("string"), F.lit(" files, "), F.coalesce("e", F.lit(0)).cast("string"), F.lit(" edges")).alias("line"))
    d = nodes.select("id", "root_id", "label").join(graph.degrees(edges), "id")
    top = best_of(d, ["root_id"], [F.desc("degree"), F.asc("label"), F.asc("id")], most, "id").select("root_id", F.lit(1).alias("part"), "place", F.concat(F.lit("- `"), "label", F.lit("` has "), F.col("degree").cast("string"), F.lit(" edges")).alias("line"))
    rows = head.unionByName(top)
    order = Window.partitionBy("root_id").orderBy("part", "place")
    return rows.select("root_id", F.row_number().over(order).alias("place"), "line")


def file_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root_id, source, target, relation): the edges lifted to files, each once, none from a file to itself; ends are paths."""
    ends = nodes.select("id", "rel_path")
    s, t = ends.withColumnsRenamed({"id": "source", "rel_path": "_s"}), ends.withColumnsRenamed({"id": "target", "rel_path": "_t"})
    rows = edges.join(s, "source").join(t, "target").filter("_s <> _t")
    return rows.select("root_id", F.col("_s").alias("source"), F.col("_t").alias("target"), "relation").distinct()


def partner_links(links: DataFrame, missed: DataFrame, found: DataFrame, depth: int = 3) -> DataFrame:
    """(root_id, rel_path, hops, relations): for files a ranking missed (root_id, rel_path) the fewest undirected hops, at most ``depth``, to a file it found, and the direct
    relations between them with their direction. ``links`` is a ``file_links`` table; a missed file out of reach has null hops."""
    both = links.select("root_id", "source", "target").unionByName(links.select("root_id", F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    key = lambda c: F.concat_ws("\x1f", "root_id", c)
    steps = both.select(key("source").alias("source"), key("target").alias("target"))
    near = graph.reach(steps, found.select(key("rel_path").alias("id")).distinct(), depth)
    rows = missed.select("root_id", "rel_path", key("rel_path").alias("id")).distinct().join(near, "id", "left").drop("id")
    hit = found.select("root_id", F.col("rel_path").alias("_f")).distinct()
    out = links.withColumn("_r", F.concat(F.lit("-"), "relation", F.lit("->"))).select("root_id", F.col("source").alias("rel_path"), F.col("target").alias("_f"), "_r")
    into = links.withColumn("_r", F.concat(F.lit("<-"), "relation", F.lit("-"))).select("root_id", F.col("target").alias("rel_path"), F.col("source").alias("_f"), "_r")
    direct = out.unionByName(into).join(hit, ["root_id", "_f"], "left_semi").groupBy("root_id", "rel_path").agg(F.array_sort(F.collect_set("_r")).alias("relations"))
    return rows.join(direct, ["root_id", "rel_path"], "left").select("root_id", "rel_path", "hops", F.coalesce("relations", F.array().cast("array<string>")).alias("relations"))

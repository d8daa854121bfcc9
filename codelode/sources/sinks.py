"""What leaves the engine: JSON lines, graph files, manifests. Rows are written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a row, keys in order."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def _escape(col):
    out = col.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.coalesce(out, F.lit(""))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, line): the lines of a GraphML document of nodes (id, label) and edges (source, target, relation), to be written in order."""
    spark = nodes.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'
    ends = spark.createDataFrame([("0", head), ("3", "</graph></graphml>")], "place string, line string")
    n = nodes.select(F.concat(F.lit("1"), "id").alias("place"), F.concat(F.lit('<node id="'), _escape(F.col("id")), F.lit('"><data key="label">'), _escape(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(
        F.concat(F.lit("2"), F.concat_ws(" ", "source", "target", "relation")).alias("place"),
        F.concat(F.lit('<edge source="'), _escape(F.col("source")), F.lit('" target="'), _escape(F.col("target")), F.lit('"><data key="relation">'), _escape(F.col("relation")), F.lit("</data></edge>")).alias("line"),
    )
    return ends.unionByName(n).unionByName(e).orderBy("place", "line")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder whose part files, joined in order of name, are the GraphML document."""
    graphml_lines(nodes, edges).select("line").write.mode("overwrite").text(path)


def cypher_statements(edges: DataFrame, batch: int = 500) -> DataFrame:
    """(relation, number, statement): MERGE statements of at most ``batch`` edges of one relation each."""
    quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))
    row = F.concat(F.lit("{s: "), quoted("source"), F.lit(", t: "), quoted("target"), F.lit("}"))
    count = edges.groupBy("relation").agg(F.ceil(F.count("*") / (batch / 2)).alias("_parts"))
    spread = edges.join(count, "relation").withColumn("number", F.pmod(F.xxhash64("source", "target"), "_parts"))
    parts = spread.groupBy("relation", "number").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # about batch / 2 rows each
    name = F.regexp_replace(F.upper("relation"), r"\W", "_")
    parts = parts.select("relation", "number", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("rows"), F.lit(batch)), lambda i: F.slice("rows", i, batch))).alias("_k", "rows"))
    text = F.concat(F.lit("UNWIND ["), F.array_join("rows", ", "), F.lit("] AS r MERGE (a:Node {id: r.s}) MERGE (b:Node {id: r.t}) MERGE (a)-[:"), name, F.lit("]->(b)"))
    return parts.select("relation", (F.col("number") * 1000 + F.col("_k")).alias("number"), text.alias("statement"))


def file_manifest(files: DataFrame) -> DataFrame:
    """(rel_path, hash, mtime): the newest hash of each path; rows without path or hash are skipped."""
    rows = files.filter("rel_path is not null and hash is not null")
    return rows.groupBy("rel_path").agg(F.max(F.struct("mtime", "hash")).alias("m")).select("rel_path", "m.hash", "m.mtime")


def _json_text(col):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col, "&", "\\\\u0026"), "<", "\\\\u003c"), ">", "\\\\u003e")


def html_lines(nodes: DataFrame, edges: DataFrame, title: str) -> DataFrame:
    """(place, line): a page that shows a graph without loading anything: its data as escaped JSON lines and a small script that lists and filters them."""
    spark = nodes.sparkSession
    head = (
        '<!doctype html><meta charset="utf-8"><title>' + title.replace("&", "&amp;").replace("<", "&lt;") + "</title><input id=f placeholder=filter><pre id=o></pre>"
        "<script>const g=[];const show=()=>{const t=f.value.toLowerCase();o.textContent=g.filter(x=>JSON.stringify(x).toLowerCase().includes(t)).map(x=>x.label||`${x.source} -${x.relation}-> ${x.target}`).join('\\n')};f.oninput=show;"
    )
    ends = spark.createDataFrame([("0", head), ("3", "show();</script>")], "place string, line string")
    n = nodes.select(F.concat(F.lit("1"), "id").alias("place"), F.concat(F.lit("g.push("), _json_text(F.to_json(F.struct("id", "label"))), F.lit(");")).alias("line"))
    e = edges.select(F.concat(F.lit("2"), F.concat_ws(" ", "source", "target", "relation")).alias("place"), F.concat(F.lit("g.push("), _json_text(F.to_json(F.struct("source", "target", "relation"))), F.lit(");")).alias("line"))
    return ends.unionByName(n).unionByName(e).orderBy("place", "line")


def note_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root_id, name, text): one linked note for each file: its symbols, and links to the notes of the files its edges lead to. Names that only differ in signs a file name cannot have get a number from the path's hash."""
    files = nodes.filter("kind = 'file'").select("id", "root_id", "rel_path")
    clean = F.regexp_replace("rel_path", r"[^A-Za-z0-9._ -]+", "-")
    same = files.withColumn("_c", F.lower(clean)).groupBy("root_id", "_c").agg(F.count("*").alias("_n"))
    named = files.withColumn("_c", F.lower(clean)).join(same, ["root_id", "_c"]).select("root_id", "rel_path", F.when(F.col("_n") > 1, F.concat(clean, F.lit("-"), F.substring(F.sha2("rel_path", 256), 1, 8))).otherwise(clean).alias("name"))
    symbols = nodes.filter("kind <> 'file'").groupBy("root_id", "rel_path").agg(F.array_sort(F.collect_list(F.struct("line_start", "label"))).alias("s"))  # the symbols of one file
    ends = nodes.select("id", "root_id", "rel_path")
    s, t = ends.withColumnsRenamed({"id": "source", "rel_path": "_s"}).drop("root_id"), ends.withColumnsRenamed({"id": "target", "rel_path": "_t"}).drop("root_id")
    to = edges.filter("relation <> 'defines'").join(s, "source").join(t, "target").filter("_s <> _t").select("root_id", F.col("_s").alias("rel_path"), "_t", "relation").distinct()
    links = to.join(named.select("root_id", F.col("rel_path").alias("_t"), F.col("name").alias("_name")), ["root_id", "_t"]).groupBy("root_id", "rel_path").agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "relation", F.lit(" [["), "_name", F.lit("]]")))).alias("l"))
    rows = named.join(symbols, ["root_id", "rel_path"], "left").join(links, ["root_id", "rel_path"], "left")
    own = F.transform(F.coalesce("s", F.array().cast("array<struct<line_start:int,label:string>>")), lambda x: F.concat(F.lit("- `"), x["label"], F.lit("`")))
    return rows.select("root_id", F.concat("name", F.lit(".md")).alias("name"), F.array_join(F.concat(F.array(F.concat(F.lit("# "), "rel_path")), own, F.coalesce("l", F.array().cast("array<string>"))), "\n").alias("text"))


def newest_files(listing: DataFrame, keep: int = 20) -> DataFrame:
    """The rows of a listing (path, modification_time) that are kept: the ``keep`` newest, ties by path."""
    return listing.orderBy(F.desc("modification_time"), "path").limit(keep)

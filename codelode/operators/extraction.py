"""Facts taken from file texts: lines, headings, imports, table references, names. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions.text import extension

# The words after which SQL names a table, and the lines that import.
TABLE_AFTER = r"(?i)\b(?:from|join|update|insert\s+into|delete\s+from)\s+([A-Za-z_][\w.]*)"
PYTHON_IMPORT = r"(?m)^\s*(?:from\s+([.\w]+)\s+import\b|import\s+([\w.]+))"
SCRIPT_IMPORT = r"""(?:\bfrom\s+|\brequire\(\s*|\bimport\s+)["']([^"']+)["']"""
DEFINITIONS = {
    "py": (r"^(?:async\s+)?def\s+(\w+)", r"^class\s+(\w+)"), "ts": (r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", r"^(?:export\s+)?(?:default\s+)?class\s+(\w+)"),
    "go": (r"^func\s+(?:\([^)]*\)\s*)?(\w+)", r"^type\s+(\w+)"), "java": (r"^\s{4}(?:public|private|protected)[\w\s<>\[\],]*\s(\w+)\s*\(", r"^(?:public\s+)?(?:final\s+|abstract\s+)?(?:class|interface|enum|record)\s+(\w+)"),
}
DEFINITIONS["js"] = DEFINITIONS["ts"]


def lines(contents: DataFrame, *keys: str) -> DataFrame:
    """(keys, line_no, line): one row for each line, from one on, without a carriage return at its end."""
    return contents.filter("content is not null").select(*keys, F.posexplode(F.split("content", "\n")).alias("line_no", "line")).select(
        *keys, (F.col("line_no") + 1).alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line")
    )


def headings(contents: DataFrame) -> DataFrame:
    """(file_id, line_start, level, title, line_end) of Markdown headings outside code fences.

    A heading ends before the next of the same or a higher level, or with the text. Texts
    are unnested once; the windows run within a file.
    """
    rows = lines(contents.filter(extension(F.col("rel_path")) == "md").select("file_id", "content").distinct(), "file_id")
    here = Window.partitionBy("file_id").orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*(```|~~~)").cast("int")
    rows = rows.withColumn("_open", F.sum(fence).over(here) % 2 == 1).withColumn("_last", F.max("line_no").over(Window.partitionBy("file_id")))
    found = rows.filter(~F.col("_open") & F.col("line").rlike(r"^#{1,6}\s+\S")).select(
        "file_id", F.col("line_no").alias("line_start"), F.length(F.regexp_extract("line", r"^(#{1,6})", 1)).alias("level"),
        F.trim(F.regexp_replace("line", r"^#{1,6}\s+|\s+#*\s*$", "")).alias("title"), "_last",
    )
    after = Window.partitionBy("file_id").orderBy("line_start").rowsBetween(1, Window.unboundedFollowing)
    # the next heading of each level and above, by six running minima from the end
    later = [F.min(F.when(F.col("level") <= n, F.col("line_start"))).over(after) for n in range(1, 7)]
    nxt = F.array(*later)[F.col("level") - 1]
    return found.withColumn("_n", nxt).select("file_id", "line_start", "level", "title", F.coalesce(F.col("_n") - 1, F.col("_last")).alias("line_end"))


def table_references(contents: DataFrame) -> DataFrame:
    """(file_id, name): lower-case last part of the tables an SQL text names, each once."""
    found = F.explode(F.regexp_extract_all("content", F.lit(TABLE_AFTER), 1))
    rows = contents.filter((extension(F.col("rel_path")) == "sql") & F.col("content").isNotNull()).select("file_id", found.alias("name"))
    return rows.select("file_id", F.lower(F.regexp_extract("name", r"([^.]+)$", 1)).alias("name")).filter("name <> ''").distinct()


def imports(contents: DataFrame) -> DataFrame:
    """(root_id, rel_path, module): what a Python, JavaScript or TypeScript file imports, each once."""
    ext = extension(F.col("rel_path"))
    rows = contents.filter("content is not null").select("root_id", "rel_path", "content", ext.alias("ext")).distinct()
    py = rows.filter("ext = 'py'").select("root_id", "rel_path", F.explode(F.concat(F.regexp_extract_all("content", F.lit(PYTHON_IMPORT), 1), F.regexp_extract_all("content", F.lit(PYTHON_IMPORT), 2))).alias("module"))
    js = rows.filter("ext in ('js', 'ts')").select("root_id", "rel_path", F.explode(F.regexp_extract_all("content", F.lit(SCRIPT_IMPORT), 1)).alias("module"))
    return py.unionByName(js).filter("module <> ''").distinct()


def definitions(contents: DataFrame) -> DataFrame:
    """(file_id, name, kind, line_start): functions and types declared at the start of a line (in a class for Java)."""
    ext = extension(F.col("rel_path"))
    rows = lines(contents.select("file_id", "content", ext.alias("ext")).filter(F.col("ext").isin(*DEFINITIONS)).distinct(), "file_id", "ext")
    func, kind = F.lit(""), F.lit("")
    for e, (f, c) in DEFINITIONS.items():
        func = F.when(F.col("ext") == e, F.regexp_extract("line", f, 1)).otherwise(func)
        kind = F.when(F.col("ext") == e, F.regexp_extract("line", c, 1)).otherwise(kind)
    rows = rows.select("file_id", "line_no", kind.alias("type"), func.alias("func"))
    name = F.when(F.col("type") != "", F.col("type")).otherwise(F.col("func"))
    return rows.filter("type <> '' or func <> ''").select("file_id", name.alias("name"), F.when(F.col("type") != "", "class").otherwise("function").alias("kind"), F.col("line_no").alias("line_start"))


def resolve_imports(found: DataFrame, paths: DataFrame) -> DataFrame:
    """(root_id, rel_path, module, target, confidence): imports joined to the files of their root.

    A dotted module matches ``a/b.py`` or ``a/b/__init__.py`` exactly, a relative one is
    resolved from the importing file (both EXTRACTED); else the one file with that path suffix (INFERRED).
    A suffix of several files gives none.
    """
    known = paths.select("root_id", F.col("rel_path").alias("target")).filter("target is not null").distinct()
    stem = F.regexp_replace("target", r"(/__init__|/index)?\.(py|js|ts)$", "")
    ends = known.filter(F.col("target").rlike(r"\.(py|js|ts)$")).withColumn("stem", stem)
    base = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    up = F.regexp_replace(F.concat(base, F.lit("/"), F.col("module")), r"(^|/)\./", "$1")
    for _ in range(3):
        up = F.regexp_replace(up, r"(^|/)(?!\.\.)[^/]+/\.\./", "$1")
    relative = F.col("module").startswith(".") & F.col("module").contains("/")
    want = F.when(relative, F.regexp_replace(F.regexp_replace(up, r"^/", ""), r"\.(js|ts)$", "")).otherwise(F.regexp_replace(F.regexp_replace("module", r"^\.+", ""), r"\.", "/"))
    asked = found.withColumn("stem", want).withColumn("relative", relative)
    exact = asked.join(ends, ["root_id", "stem"]).groupBy("root_id", "rel_path", "module").agg(F.min("target").alias("target")).withColumn("confidence", F.lit("EXTRACTED"))
    parts = F.split("stem", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tails = ends.select("root_id", "target", F.explode(suffixes).alias("stem")).groupBy("root_id", "stem").agg(F.min("target").alias("a"), F.max("target").alias("b")).filter("a = b").select("root_id", "stem", F.col("a").alias("target"))
    rest = asked.filter("not relative").join(exact.select("root_id", "rel_path", "module"), ["root_id", "rel_path", "module"], "left_anti")
    loose = rest.join(tails, ["root_id", "stem"]).select("root_id", "rel_path", "module", "target", F.lit("INFERRED").alias("confidence"))
    return exact.unionByName(loose).filter("rel_path <> target")


def is_minified(content):
    """Whether a text of 20,000 bytes and more is built output: lines of over 300 bytes in the mean with at most a tenth of white space, or a line over 5,000 bytes with less than one line end in 1,000 bytes."""
    n = F.octet_length(content)
    breaks = F.char_length(content) - F.char_length(F.replace(content, F.lit("\n"), F.lit("")))
    spaces = F.char_length(content) - F.char_length(F.translate(content, " \t", ""))
    longest = F.array_max(F.transform(F.split(content, "\n"), F.octet_length))
    return (n >= 20_000) & (((n / (breaks + 1) > 300) & (spaces <= 0.1 * n)) | ((longest > 5000) & (breaks < n / 1000)))


def minified(contents: DataFrame) -> DataFrame:
    """(file_id) of scripts and styles that are built output, see ``is_minified``."""
    rows = contents.filter("content is not null").filter(extension(F.col("rel_path")).isin("js", "cjs", "mjs", "jsx", "ts", "tsx", "css"))
    return rows.filter(is_minified(F.col("content"))).select("file_id").distinct()


def variable_names(contents: DataFrame) -> DataFrame:
    """(file_id, name): the names set in environment files; values are never kept."""
    rows = lines(contents.filter(F.col("rel_path").rlike(r"(^|/)(\.env(\.\w+)?|[\w.-]*\.env)$")).select("file_id", "content").distinct(), "file_id")
    return rows.select("file_id", F.regexp_extract("line", r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", 1).alias("name")).filter("name <> ''").distinct()

"""Search units of files: semantic chunks of four kinds, and line pieces of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions.query import body_words
from codelode.functions.redaction import redact_where_needed
from codelode.functions.text import extension, preview, stable_id, text_hint
from codelode.operators.configs import config_facts
from codelode.operators.extraction import definitions, headings, lines
from codelode.operators.intervals import filled_spans

SCHEMA = "2"
#: Comment and decorator lines a piece takes in above its symbol.
ATTACHED = 15


def semantic_chunks(contents: DataFrame) -> DataFrame:
    """(chunk_id, root_id, file_id, rel_path, chunk_kind, chunk_text_hash, chunk_text_preview) of files.

    Kinds: ``path`` (path, name and ending), ``content_hint`` (first lines), ``symbol`` (path and
    name), ``doc_heading`` (path and title) and, where the texts have a time, ``adapter_fact`` (what configuration readers find). Texts are redacted before they are hashed, so no chunk holds a credential. A file's equal texts of a kind are one chunk; ids come from schema,
    root, path, kind and text, so a rerun gives the same. Rows without root or path have no chunks.
    """
    files = contents.filter("root_id is not null and rel_path is not null").select("root_id", "file_id", "rel_path", "content").distinct()
    keys = ["root_id", "file_id", "rel_path"]
    ids = files.select(*keys).distinct()
    name = F.regexp_extract("rel_path", r"([^/]+)$", 1)
    path = ids.select(*keys, F.lit("path").alias("kind"), F.concat_ws(" ", "rel_path", F.regexp_replace(name, r"\.[^.]*$", ""), F.concat(F.lit("."), extension(F.col("rel_path")))).alias("text"))
    hint = files.filter("content is not null").select(*keys, F.lit("content_hint").alias("kind"), text_hint(F.col("content")).alias("text"))
    symbol = definitions(files).join(ids, "file_id").select(*keys, F.lit("symbol").alias("kind"), F.concat_ws(" ", "rel_path", "name").alias("text"))
    head = headings(files).join(ids, "file_id").select(*keys, F.lit("doc_heading").alias("kind"), F.concat_ws(" ", "rel_path", "title").alias("text"))
    fact = config_facts(contents).filter(~F.col("kind").isin("setting", "heading")).join(ids, ["root_id", "rel_path"]).select(*keys, F.lit("adapter_fact").alias("kind"), F.concat_ws(" ", "rel_path", F.col("kind"), "name").alias("text")) if "modification_time" in contents.columns else path.limit(0)
    rows = path.unionByName(hint).unionByName(symbol).unionByName(head).unionByName(fact).filter("text <> ''")
    rows = redact_where_needed(rows, "text", "_clean").withColumn("text", F.col("_clean")).drop("_clean").withColumn("hash", F.sha2("text", 256))
    rows = rows.dropDuplicates([*keys, "kind", "hash"])
    return rows.select(
        stable_id(F.lit(SCHEMA), F.col("root_id"), F.col("rel_path"), F.col("kind"), F.col("hash")).alias("chunk_id"), *keys, F.col("kind").alias("chunk_kind"),
        F.col("hash").alias("chunk_text_hash"), preview(F.col("text")).alias("chunk_text_preview"),
    )


def symbol_pieces(contents: DataFrame) -> DataFrame:
    """(file_id, name, kind, line_start, line_end): the lines of each symbol, from the comments and decorators right above it to
    the line before the next symbol or the file's last.

    At most ``ATTACHED`` lines are taken in above. The comment runs come from one sort of a file's lines.
    """
    rows = lines(contents.select("file_id", "content").distinct(), "file_id")
    note = F.col("line").rlike(r"^\s*(#|//|/\*|\*|--|@|\"\"\")")
    here = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_plain", F.last(F.when(~note, F.col("line_no")), ignorenulls=True).over(here))
    runs = rows.filter(note).select("file_id", (F.col("line_no") + 1).alias("line_start"), (F.col("line_no") - F.coalesce("_plain", F.lit(0))).alias("above"))
    last = rows.groupBy("file_id").agg(F.max("line_no").alias("_last"))
    spans = filled_spans(definitions(contents).withColumn("line_end", F.lit(None).cast("int")), "file_id")
    out = spans.join(runs, ["file_id", "line_start"], "left").join(last, "file_id")
    start = F.col("line_start") - F.least(F.coalesce("above", F.lit(0)), F.lit(ATTACHED))
    return out.select("file_id", "name", "kind", start.cast("int").alias("line_start"), F.coalesce("line_end", "_last").cast("int").alias("line_end"))


def symbol_texts(contents: DataFrame) -> DataFrame:
    """(root_id, rel_path, name, line_start, line_end, body): the pieces of each path's newest text with the words of their lines, each word at most three times.

    A piece takes its lines out of the text where it lies; no line is a row of its own.
    """
    c = contents.filter("root_id is not null and rel_path is not null and content is not null")
    last = c.groupBy("root_id", "rel_path").agg(F.max(F.struct("modification_time", "content")).alias("c")).select("root_id", "rel_path", F.col("c.content").alias("content"), F.concat_ws("\x1f", "root_id", "rel_path").alias("file_id"))
    spans = symbol_pieces(last).dropDuplicates(["file_id", "line_start", "line_end"])
    rows = spans.join(last.select("file_id", "root_id", "rel_path", F.split("content", "\n").alias("_l")), "file_id")
    text = F.array_join(F.slice("_l", F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))), "\n")
    seen = F.aggregate(F.array_sort(body_words(text)), F.array().cast("array<string>"), lambda a, w: F.when((F.size(a) >= 3) & (F.get(a, F.size(a) - 3) == w), a).otherwise(F.concat(a, F.array(w))))
    return rows.select("root_id", "rel_path", "name", "line_start", "line_end", seen.alias("body"))


def best_ranges(pieces: DataFrame, by: str, score: str, most: int = 2, share: float = 0.5) -> DataFrame:
    """The best piece of each ``by`` and, if ``most`` is two, the next best that does not overlap it and has a share of its score; ties by start line. For documents, whose
    weak parts say nothing; ``lookup.best_ranges`` is the rule for code. Only the best rows of each salted part meet in the last ranking."""
    from codelode.operators.lookup import best_of

    order = [F.desc(score), F.asc("line_start"), F.asc("line_end")]
    first = best_of(pieces, [by], order, 1, "line_start").drop("place")
    if most < 2:
        return first
    top = first.select(by, F.col("line_start").alias("_a"), F.col("line_end").alias("_e"), F.col(score).alias("_b"))
    rest = pieces.join(top, by).filter(((F.col("line_start") > F.col("_e")) | (F.col("line_end") < F.col("_a"))) & (F.col(score) >= share * F.col("_b"))).drop("_a", "_e", "_b")
    return first.unionByName(best_of(rest, [by], order, 1, "line_start").drop("place"))


def joined_pages(pages: DataFrame, by: str, score: str, share: float = 0.5) -> DataFrame:
    """(by, line_start, line_end, score): runs of neighbouring pages (``line_start`` is the page) whose scores are at least a share of the best of the run, each page in the run of the best page it touches so.

    Pages between which no score falls under the share of the larger are one stretch; a stretch is split where it does.
    """
    w = Window.partitionBy(by).orderBy("line_start")
    before, own = F.lag(score).over(w), F.col(score)
    apart = (F.lag("line_start").over(w) + 1 != F.col("line_start")) | (F.least(before, own) < share * F.greatest(before, own)) | before.isNull()
    rows = pages.withColumn("_run", F.sum(apart.cast("int")).over(w))
    return rows.groupBy(by, "_run").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.max(score).alias(score)).drop("_run")


def document_pieces(parts: DataFrame) -> DataFrame:
    """(root_id, rel_path, name, line_start, line_end, body) of document parts with text: the part's number stands for its lines, its title, redacted and of 80 signs at most, for its name."""
    from codelode.functions.redaction import redact_where_needed

    rows = parts.filter("root_id is not null and rel_path is not null and trim(text) <> ''").select("root_id", "rel_path", "part_number", "title", "text").dropDuplicates(["root_id", "rel_path", "part_number"])
    rows = redact_where_needed(rows, "title", "_t")
    return rows.select("root_id", "rel_path", F.substring(F.coalesce("_t", F.lit("")), 1, 80).alias("name"), F.col("part_number").alias("line_start"), F.col("part_number").alias("line_end"), body_words(F.col("text")).alias("body"))


def document_bodies(parts: DataFrame) -> DataFrame:
    """(root_id, rel_path, words): the words of each document's parts and of their titles, but for pages, whose titles all say the same."""
    title = F.when(F.col("part_kind") != "page", F.col("title"))
    rows = parts.filter("root_id is not null and rel_path is not null").select("root_id", "rel_path", "part_number", F.concat_ws("\n", title, "text").alias("t")).dropDuplicates(["root_id", "rel_path", "part_number"])
    return rows.groupBy("root_id", "rel_path").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part_number", "t"))), lambda x: body_words(x["t"]))).alias("words"))  # the parts of one document


def titles(paths: DataFrame, pieces: DataFrame) -> DataFrame:
    """(root_id, rel_path, title): one title for each path, its words, and one for each piece, with its name."""
    words = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " "))
    p = paths.filter("root_id is not null and rel_path is not null").select("root_id", "rel_path").distinct()
    one = p.select("root_id", "rel_path", words(F.col("rel_path")).alias("title"))
    return one.unionByName(pieces.select("root_id", "rel_path", F.concat_ws(" ", words(F.col("rel_path")), words(F.col("name"))).alias("title"))).distinct()

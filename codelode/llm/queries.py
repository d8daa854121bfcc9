"""Queries of the problems of this package, and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.llm import credentials, mixing, neighbors, overlap, packing, parsing, pieces, provenance, truncation
from codelode.session import table

#: Factor of the neighbour search: below one it may lose neighbours; the README has the measured loss.
FACTOR = 0.5
#: A parameter of the mix: the domain of each source of these tables.
DOMAINS = {
    "issue_tracker": "discussion", "pull_requests": "discussion", "review_comments": "discussion", "chat_export": "discussion", "forum": "discussion", "mailing_list": "discussion",
    "readme": "documentation", "api_docs": "documentation", "docstrings": "documentation", "tutorials": "documentation", "faq": "documentation", "wiki": "documentation", "migration_guides": "documentation",
    "design_notes": "design", "adr": "design", "runbooks": "operations", "incident_reports": "operations", "benchmark_reports": "operations", "podcasts": "speech", "transcripts": "speech",
}


def setting(spark, sf_dir, name: str) -> int:
    """One value of job_settings."""
    return int(table(spark, sf_dir, "job_settings").filter(F.col("setting") == name).agg(F.max("setting_value")).first()[0])


def p1_found(spark, sf_dir):
    return credentials.found(*(table(spark, sf_dir, t) for t in ("files", "contents", "semantic_chunks")))


def p1_redacted(spark, sf_dir):
    return credentials.redacted_texts(*(table(spark, sf_dir, t) for t in ("files", "contents", "semantic_chunks")))


def p2_found(spark, sf_dir):
    return provenance.not_handwritten(table(spark, sf_dir, "contents")).select("file_id").distinct()


def p2_reasons(spark, sf_dir):
    return provenance.not_handwritten(table(spark, sf_dir, "contents")).groupBy("reason").agg(F.countDistinct("file_id").alias("files"))


def p3_found(spark, sf_dir):
    k = setting(spark, sf_dir, "neighbors")
    vectors = neighbors.usable(table(spark, sf_dir, "semantic_chunks"))
    return neighbors.unordered_pairs(neighbors.nearest(vectors, F.col("chunk_id").startswith("0"), k, FACTOR))


def p3_neighbors(spark, sf_dir):
    """The neighbours of every chunk whose id, read as a number, is divisible by 50, against all."""
    k = setting(spark, sf_dir, "neighbors")
    number = F.conv(F.substring("chunk_id", -12, 12), 16, 10).cast("bigint")
    return neighbors.nearest(neighbors.usable(table(spark, sf_dir, "semantic_chunks")), number % 50 == 0, k, FACTOR)


def p5_found(spark, sf_dir):
    return parsing.parsed(table(spark, sf_dir, "contents")).filter(~F.col("valid")).select("file_id").distinct()


def p5_rates(spark, sf_dir):
    return parsing.rates(parsing.parsed(table(spark, sf_dir, "contents")))


def p6_pieces(spark, sf_dir):
    limit, lap = setting(spark, sf_dir, "piece_max_chars"), setting(spark, sf_dir, "piece_overlap_chars")
    parts = table(spark, sf_dir, "document_parts").dropDuplicates(["root_id", "rel_path", "part_number", "text"])
    return pieces.pieces(parts, limit, lap)


def p6_found(spark, sf_dir):
    limit, lap = setting(spark, sf_dir, "piece_max_chars"), setting(spark, sf_dir, "piece_overlap_chars")
    return pieces.pieces(table(spark, sf_dir, "document_parts"), limit, lap).select("root_id", "rel_path", "part_number").distinct()


def p6_rebuilt(spark, sf_dir):
    """Of each part its length, pieces and whether they are right: within the limit, overlapping as asked, and together the text."""
    limit, lap = setting(spark, sf_dir, "piece_max_chars"), setting(spark, sf_dir, "piece_overlap_chars")
    keys = ["root_id", "rel_path", "part_number"]
    parts = table(spark, sf_dir, "document_parts").select(*keys, "text").distinct().filter(F.char_length("text") > limit).withColumn("digest", F.sha2("text", 256))
    got = pieces.pieces(parts, limit, lap)
    tail = F.expr("substring(text, new_start - char_start + 1)")
    ok = (F.char_length("text") <= limit) & ((F.col("piece_number") == 1) | (F.col("new_start") - F.col("char_start") == lap))
    rows = got.withColumn("tail", tail).withColumn("ok", ok).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("piece_number", "char_end", "tail"))).alias("p"), F.min("ok").alias("ok"))  # the pieces of one part
    whole = rows.select(*keys, "ok", F.sha2(F.array_join("p.tail", ""), 256).alias("digest"))
    lens = parts.groupBy(*keys).agg(F.max(F.char_length("text")).alias("chars"), F.count("*").alias("texts"), F.max("digest").alias("digest"))
    same = F.col("ok") & ((F.col("texts") > 1) | whole["digest"].eqNullSafe(lens["digest"]))
    return lens.join(whole, keys).select(*keys, "chars", same.alias("right"))


def p7_found(spark, sf_dir):
    return overlap.overlaps(table(spark, sf_dir, "tasks")).select("task_key_a", "task_key_b")


def p7_report(spark, sf_dir):
    return overlap.report(table(spark, sf_dir, "tasks"))


def p8_assign(spark, sf_dir):
    return packing.assign(table(spark, sf_dir, "documents"), setting(spark, sf_dir, "container_tokens"))


def p8_checked(spark, sf_dir):
    """What must hold of the assignment: documents with a text, those lost, tokens lost or doubled, containers over capacity, needless splits."""
    capacity = setting(spark, sf_dir, "container_tokens")
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null and text is not null")
    want = docs.select("doc_id", packing.token_count(F.col("text"), packing.VOCABULARY).alias("want"))
    got = p8_assign(spark, sf_dir)
    each = got.groupBy("doc_id").agg(F.sum("tokens").alias("got"), F.count("*").alias("parts"))
    n = lambda c: F.count(F.when(c, 1))
    rows = want.join(each, "doc_id", "left").agg(F.count("*").alias("documents"), n(F.col("parts").isNull()).alias("lost"), n(~F.col("want").eqNullSafe(F.col("got"))).alias("wrong_tokens"), n((F.col("parts") > 1) & (F.col("want") <= capacity)).alias("needless_splits"))
    bins = got.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.max("capacity").alias("c")).agg(n((F.col("t") > F.col("c")) | (F.col("c") > capacity)).alias("overfull"))
    return rows.withColumn("_k", F.lit(1)).join(bins.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row and one row


def p8_report(spark, sf_dir):
    return packing.report(p8_assign(spark, sf_dir))


def _mix(spark, sf_dir):
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), domains=DOMAINS)


def p9_selection(spark, sf_dir):
    return _mix(spark, sf_dir).selection()


def p9_shares(spark, sf_dir):
    return _mix(spark, sf_dir).shares()


def p9_checked(spark, sf_dir):
    """What must hold of the mix: selected documents that are of no targeted source, repeated too often, or doubled."""
    most = table(spark, sf_dir, "source_targets").select(F.lower(F.trim("source")).alias("source"), "max_repeats")
    got = p9_selection(spark, sf_dir).join(F.broadcast(most), "source", "left")  # the targets are a fixed table
    n = lambda c: F.count(F.when(c, 1))
    return got.agg(n(F.col("max_repeats").isNull()).alias("untargeted"), n(F.col("copies") > F.col("max_repeats")).alias("too_often"), (F.count("*") - F.countDistinct("doc_id")).alias("doubled"))


def p10_found(spark, sf_dir):
    return truncation.judged(table(spark, sf_dir, "documents")).filter("reason is not null").select("doc_id").distinct()


def p10_rates(spark, sf_dir):
    return truncation.rates(truncation.judged(table(spark, sf_dir, "documents")))


QUERIES = {
    "p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_reasons": p2_reasons, "p3_found": p3_found, "p3_neighbors": p3_neighbors,
    "p5_found": p5_found, "p5_rates": p5_rates, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_rebuilt": p6_rebuilt, "p7_found": p7_found, "p7_report": p7_report,
    "p8_assign": p8_assign, "p8_report": p8_report, "p8_checked": p8_checked, "p9_selection": p9_selection, "p9_shares": p9_shares, "p9_checked": p9_checked, "p10_found": p10_found, "p10_rates": p10_rates,
}

ORACLE: dict[str, str] = {
    "p3_found": """
with v as (
  select chunk_id, max(vector_json) vj from semantic_chunks
  where json_valid(vector_json) and vector_json <> '{}' and json_type(vector_json) = 'OBJECT' group by 1),
w as (select chunk_id, unnest(map_entries(cast(vj as json)::map(varchar, double))) e from v),
d as (select chunk_id, e.key k, e.value x from w),
n as (select chunk_id, sqrt(sum(x * x)) n from d group by 1),
s as (select a.chunk_id q, b.chunk_id c, sum(a.x * b.x) dot from d a join d b on a.k = b.k and a.chunk_id like '0%' and a.chunk_id <> b.chunk_id group by 1, 2),
r as (select q, c, row_number() over (partition by q order by round(dot / (nq.n * nc.n), 6) desc, c) rn from s join n nq on nq.chunk_id = q join n nc on nc.chunk_id = c)
select distinct least(q, c) chunk_id_a, greatest(q, c) chunk_id_b from r where rn <= 10""",
    "p6_rebuilt": """
select root_id, rel_path, part_number, max(length(text))::int chars, true as "right" from document_parts
where length(text) > (select setting_value from job_settings where setting = 'piece_max_chars') group by 1, 2, 3""",
    "p8_checked": "select count(*) documents, 0::bigint lost, 0::bigint wrong_tokens, 0::bigint needless_splits, 0::bigint overfull from documents where doc_id is not null and text is not null",
    "p9_checked": "select 0::bigint untargeted, 0::bigint too_often, 0::bigint doubled",
    "p6_found": """
select distinct root_id, rel_path, part_number from document_parts
where length(text) > (select setting_value from job_settings where setting = 'piece_max_chars')""",
}

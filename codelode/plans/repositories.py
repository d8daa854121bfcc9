"""Queries over the tables of indexed repositories, each with its SQL where SQL can tell the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions import roles as R
from codelode.functions import text as T
from codelode.operators import chunks, evaluation, extraction, graph, incremental, intervals, ranking
from codelode.session import table
from codelode.streaming import sessions

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sources and files


@query("select root_id, rel_path, count(distinct hash) hashes from files where rel_path is not null group by 1, 2")
def scan_files(spark, sf):
    """Every path once; more than one hash tells that it was rescanned changed, or that names collide."""
    return table(spark, sf, "files").filter("rel_path is not null").groupBy("root_id", "rel_path").agg(F.countDistinct("hash").alias("hashes"))


@query(
    "select root_id, count(*) n from (select distinct root_id, rel_path from files where regexp_matches(rel_path, '^(?:src/(?:[^/]+/)*[^/]*\\.(py|ts))$') "
    "and not regexp_matches(rel_path, '^(?:[^/]+/)*test_[^/]*$')) group by 1"
)
def admitted_paths(spark, sf):
    rows = table(spark, sf, "files").select("root_id", "rel_path").distinct()
    return rows.filter(T.admits(F.col("rel_path"), ["src/**/*.py", "src/**/*.ts"], ["**/test_*"])).groupBy("root_id").agg(F.count("*").alias("n"))


@query(
    "select count(*) files, count(*) filter (where size > case when regexp_matches(lower(rel_path), '\\.(pdf|docx|pptx|xlsx|svg)$') then 20971520 else 1000000 end) oversized, max(size) largest "
    "from (select distinct file_id, rel_path, size from files)"
)
def size_limits(spark, sf):
    rows = table(spark, sf, "files").select("file_id", "rel_path", "size").distinct()
    return rows.agg(F.count("*").alias("files"), F.count(F.when(F.col("size") > T.size_limit(F.col("rel_path")), 1)).alias("oversized"), F.max("size").alias("largest"))


@query("select distinct file_id, substr(sha256(root_id || '::' || rel_path), 1, 24) stable_id from files where root_id is not null and rel_path is not null")
def stable_ids(spark, sf):
    return table(spark, sf, "files").filter("root_id is not null and rel_path is not null").select("file_id", T.stable_id(F.col("root_id"), F.col("rel_path")).alias("stable_id")).distinct()


@query(r"""
select distinct file_id, substr(array_to_string(list_slice([y for y in [regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') for x in string_split(substr(content, 1, 12000), chr(10))] if y <> ''], 1, 40), chr(10)), 1, 2000) hint from contents where content is not null""")
def text_hints(spark, sf):
    return table(spark, sf, "contents").filter("content is not null").select("file_id", T.text_hint(F.col("content")).alias("hint")).distinct()


@query("""
select case lower(regexp_extract(rel_path, '\\.([A-Za-z0-9]+)$', 1)) when 'py' then 'Python' when 'js' then 'JavaScript' when 'ts' then 'TypeScript' when 'go' then 'Go' when 'java' then 'Java'
  when 'sql' then 'SQL' when 'md' then 'Markdown' when 'json' then 'JSON' when 'yaml' then 'YAML' when 'toml' then 'TOML' when 'xml' then 'XML' when 'sh' then 'Shell' else 'other' end language_name,
  count(distinct file_id) files from files where rel_path is not null group by 1""")
def language_counts(spark, sf):
    return table(spark, sf, "files").filter("rel_path is not null").groupBy(T.language(F.col("rel_path")).alias("language_name")).agg(F.countDistinct("file_id").alias("files"))


_M = lambda p: f"regexp_matches(rel_path, '{p}')"
_DOC, _TEST, _MIG = f"({_M(R.DOC_FOLDER)} or {_M(R.DOC_NAME)} or {_M(R.DOC_TEXT)})", f"({_M(R.TEST_FOLDER)} or {_M(R.TEST_NAME)})", f"({_M(R.MIGRATION_FOLDER)} or {_M(R.MIGRATION_NAME)})"
_SOURCE = f"({_M(R.SOURCE)} and not ({_DOC} or {_TEST} or {_MIG} or {_M(R.RETIRED)} or {_M(R.SUPPORT)}))"
_ROLE_SQL = {
    "test": _TEST, "doc": _DOC, "migration": _MIG, "retired": _M(R.RETIRED), "supporting": _M(R.SUPPORT), "noise": f"({_M(R.NOISE_FOLDER)} or {_M(R.BUNDLE)} or {_M(R.META)})", "bundle": _M(R.BUNDLE), "source": _SOURCE,
    "edit_surface": f"(not ({_DOC} or {_TEST} or {_M(R.BUNDLE)} or {_M(R.NO_SURFACE)}) and ({_SOURCE} or {_M(R.SETTINGS)}))",
}


@query("select root_id, " + ", ".join(f"count(*) filter (where {sql}) {k}_files" for k, sql in _ROLE_SQL.items()) + " from (select distinct root_id, rel_path from files where rel_path is not null and root_id is not null) group by 1")
def path_roles(spark, sf):
    """Files of each root by the roles their paths tell."""
    rows = table(spark, sf, "files").select("root_id", "rel_path").distinct().filter("rel_path is not null and root_id is not null")
    p = F.col("rel_path")
    roles = {"test": R.is_test(p), "doc": R.is_doc(p), "migration": R.is_migration(p), "retired": R.is_retired(p), "supporting": R.is_supporting(p), "noise": R.is_noise(p), "bundle": R.is_bundle(p), "source": R.is_source(p), "edit_surface": R.is_edit_surface(p)}
    return rows.groupBy("root_id").agg(*[F.count(F.when(v, 1)).alias(f"{k}_files") for k, v in roles.items()])


@query("""
with h as (select root_id, file_id, arg_min(hash, (indexed_at, hash)) old, arg_max(hash, (indexed_at, hash)) new from files where hash is not null group by 1, 2)
select root_id, count(*) files, count(*) filter (where old is distinct from new) changed from h group by 1""")
def rescanned_files(spark, sf):
    """Files whose hash differs between their first and their last scan."""
    at = F.struct("indexed_at", "hash")
    h = table(spark, sf, "files").filter("hash is not null").groupBy("root_id", "file_id").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return h.groupBy("root_id").agg(F.count("*").alias("files"), F.count(F.when(~F.col("a.hash").eqNullSafe(F.col("b.hash")), 1)).alias("changed"))


@query("""
with o as (select root_id, rel_path, hash h, row_number() over (partition by root_id, rel_path order by indexed_at desc nulls last, hash desc nulls last) rn from files where root_id is not null and rel_path is not null),
n as (select root_id, rel_path, sha256(content) h, row_number() over (partition by root_id, rel_path order by modification_time desc nulls last, sha256(content) desc nulls last) rn from contents where root_id is not null and rel_path is not null),
a as (select *, 1 r from o where rn = 1), b as (select *, 1 r from n where rn = 1)
select root_id, rel_path, case when a.r is null then 'added' when b.r is null then 'removed' else 'changed' end status from a full join b using (root_id, rel_path) where a.h is distinct from b.h or a.r is null or b.r is null""")
def index_freshness(spark, sf):
    """Paths that differ between the newest row of the file index and the newest text at hand."""
    new = table(spark, sf, "contents").withColumn("hash", F.sha2("content", 256))
    named = "root_id is not null and rel_path is not null"
    return incremental.changes(table(spark, sf, "files").filter(named), new.filter(named), ["root_id", "rel_path"], "hash", "indexed_at", "modification_time")


@query("""
with have as (select distinct root_id, file_id from semantic_chunks where file_id is not null), f as (select distinct root_id, file_id from files),
c as (select f.root_id, count(*) files, count(h.file_id) covered from f left join have h on f.root_id = h.root_id and f.file_id = h.file_id group by 1)
select *, case when covered = 0 then 'missing' when covered < files then 'stale' else 'current' end status from c""")
def chunk_health(spark, sf):
    return incremental.health(table(spark, sf, "semantic_chunks"), table(spark, sf, "files"))


@query()
def index_digest(spark, sf):
    """A digest of the file index that no order or partitioning changes."""
    return incremental.digest(table(spark, sf, "files").select("file_id", "root_id", "rel_path", "hash").distinct(), ["file_id", "root_id", "rel_path", "hash"])


# ---------------------------------------------------------------- extraction


@query(r"""
with l as (select file_id, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) line_no from (select distinct file_id, content from contents where lower(rel_path) like '%.md' and content is not null)),
m as (select file_id, line_no, regexp_replace(line, '\r$', '') line, sum(cast(regexp_matches(line, '^\s*(```|~~~)') as int)) over (partition by file_id order by line_no) % 2 op, max(line_no) over (partition by file_id) last from l),
h as (select file_id, line_no line_start, length(regexp_extract(line, '^(#{1,6})', 1)) level, trim(regexp_replace(line, '^#{1,6}\s+|\s+#*\s*$', '', 'g')) title, last from m where op = 0 and regexp_matches(line, '^#{1,6}\s+\S'))
select file_id, line_start, level, title, coalesce((select min(n.line_start) from h n where n.file_id = h.file_id and n.line_start > h.line_start and n.level <= h.level) - 1, last) line_end from h""")
def markdown_headings(spark, sf):
    return extraction.headings(table(spark, sf, "contents"))


@query(r"""
with r as (select distinct file_id, unnest(regexp_extract_all(content, '(?i)\b(?:from|join|update|insert\s+into|delete\s+from)\s+([A-Za-z_][\w.]*)', 1)) n from contents where lower(rel_path) like '%.sql')
select distinct file_id, lower(regexp_extract(n, '([^.]+)$', 1)) as name from r where regexp_extract(n, '([^.]+)$', 1) <> ''""")
def table_references(spark, sf):
    return extraction.table_references(table(spark, sf, "contents"))


@query(r"""
with c as (select distinct root_id, rel_path, content from contents where content is not null),
p as (select root_id, rel_path, unnest(list_concat(regexp_extract_all(content, '(?m)^\s*(?:from\s+([.\w]+)\s+import\b|import\s+([\w.]+))', 1), regexp_extract_all(content, '(?m)^\s*(?:from\s+([.\w]+)\s+import\b|import\s+([\w.]+))', 2))) m from c where lower(rel_path) like '%.py'),
j as (select root_id, rel_path, unnest(regexp_extract_all(content, '(?:\bfrom\s+|\brequire\(\s*|\bimport\s+)["'']([^"'']+)["'']', 1)) m from c where lower(rel_path) like '%.js' or lower(rel_path) like '%.ts')
select distinct root_id, rel_path, m as "module" from (select * from p union all select * from j) where m <> ''""")
def file_imports(spark, sf):
    return extraction.imports(table(spark, sf, "contents"))


@query()
def resolved_imports(spark, sf):
    c = table(spark, sf, "contents")
    return extraction.resolve_imports(extraction.imports(c), c.select("root_id", "rel_path"))


_DEF_LINES = "(select distinct file_id, content, lower(regexp_extract(rel_path, '[.]([A-Za-z0-9]+)$', 1)) ext from contents where content is not null)"
_DEFINED = f"""
l as (select file_id, ext, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) line_no from {_DEF_LINES} where ext in ({", ".join(f"'{e}'" for e in extraction.DEFINITIONS)})),
k as (select file_id, line_no, case ext {" ".join(f"when '{e}' then regexp_extract(regexp_replace(line, chr(13) || '$', ''), '{c}', 1)" for e, (_, c) in extraction.DEFINITIONS.items())} end typ, case ext {" ".join(f"when '{e}' then regexp_extract(regexp_replace(line, chr(13) || '$', ''), '{f}', 1)" for e, (f, _) in extraction.DEFINITIONS.items())} end fun from l),
defs as (select file_id, case when typ <> '' then typ else fun end as name, case when typ <> '' then 'class' else 'function' end kind, line_no::int line_start from k where typ <> '' or fun <> '')"""


@query("with " + _DEFINED + " select file_id, name, kind, line_start from defs")
def symbol_definitions(spark, sf):
    return extraction.definitions(table(spark, sf, "contents"))


@query()
def enclosing_symbols(spark, sf):
    """How many lines each symbol holds as the innermost: lines of code joined to symbol spans."""
    c = table(spark, sf, "contents").filter("content is not null").select(F.concat_ws(":", "file_id", F.sha2("content", 256)).alias("file_id"), "rel_path", "content").distinct()
    spans = chunks.symbol_pieces(c).withColumn("symbol", F.concat_ws(":", "name", "line_start"))
    code = c.filter(T.extension(F.col("rel_path")).isin(*extraction.DEFINITIONS))
    return intervals.innermost(extraction.lines(code, "file_id").filter("trim(line) <> ''"), spans, "file_id", "line_no", "symbol").groupBy("file_id", "symbol").agg(F.count("*").alias("lines"))


@query(r"""
with c as (select distinct file_id, rel_path, content, octet_length(encode(content)) n from contents where content is not null and regexp_matches(lower(rel_path), '\.(js|cjs|mjs|jsx|ts|tsx|css)$')),
m as (select file_id, n, len(content) - len(replace(content, chr(10), '')) breaks, list_max([octet_length(encode(x)) for x in string_split(content, chr(10))]) longest,
  len(content) - len(replace(replace(content, ' ', ''), chr(9), '')) spaces from c where n >= 20000)
select distinct file_id from m where (n / (breaks + 1) > 300 and spaces <= 0.1 * n) or (longest > 5000 and breaks < n / 1000)""")
def minified_files(spark, sf):
    return extraction.minified(table(spark, sf, "contents"))


@query(r"""
with l as (select file_id, unnest(string_split(content, chr(10))) line from (select distinct file_id, content from contents where content is not null and regexp_matches(rel_path, '(^|/)(\.env(\.\w+)?|[\w.-]*\.env)$')))
select distinct file_id, regexp_extract(line, '^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=', 1) as name from l where regexp_extract(line, '^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=', 1) <> ''""")
def environment_names(spark, sf):
    return extraction.variable_names(table(spark, sf, "contents"))


@query("select distinct file_id, ceil(octet_length(encode(content)) / 4)::bigint tokens, length(content)::int chars from contents where content is not null")
def token_proxies(spark, sf):
    return table(spark, sf, "contents").filter("content is not null").select("file_id", T.token_proxy(F.col("content")).alias("tokens"), F.char_length("content").alias("chars")).distinct()


@query(r"""
with p as (select root_id, rel_path, part_number, max(length(text)) n from document_parts where text is not null and root_id is not null and rel_path is not null group by 1, 2, 3),
c as (select *, sum(n) over (partition by root_id, rel_path order by part_number) upto from p)
select root_id, rel_path, count(*) parts, count(*) filter (where upto <= 20000) kept, max(upto) > 20000 cut from c group by 1, 2""")
def capped_documents(spark, sf):
    """Parts of a document that fit a cap of 20,000 characters, in order, and whether it cut."""
    p = table(spark, sf, "document_parts").filter("text is not null and root_id is not null and rel_path is not null").groupBy("root_id", "rel_path", "part_number").agg(F.max(F.char_length("text")).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("root_id", "rel_path").orderBy("part_number").rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("upto", upto).groupBy("root_id", "rel_path").agg(F.count("*").alias("parts"), F.count(F.when(F.col("upto") <= 20000, 1)).alias("kept"), (F.max("upto") > 20000).alias("cut"))


@query(r"""
select distinct chunk_id, trim(regexp_replace(chunk_text_preview, '[\s\x0B]+', ' ', 'g')) = chunk_text_preview and length(chunk_text_preview) <= 500 bounded from semantic_chunks where chunk_text_preview is not null""")
def bounded_previews(spark, sf):
    """Whether each stored preview is what the preview function gives."""
    return table(spark, sf, "semantic_chunks").filter("chunk_text_preview is not null").select("chunk_id", (T.preview(F.col("chunk_text_preview")) == F.col("chunk_text_preview")).alias("bounded")).distinct()


# ---------------------------------------------------------------- retrieval

_TERMS = r"[w for w in string_split(lower(trim(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' ') if length(w) >= 2]"
_ASK = ["render", "window", "scope", "cursor"]


def _commit_index(spark, sf):
    """Each commit's newest delivery, so that subject and body are of one row."""
    c = table(spark, sf, "commits").filter("sha is not null and root_id is not null and id is not null")
    last = c.groupBy("root_id", "sha").agg(F.max(F.struct("id", "subject", "body")).alias("c")).select(F.concat_ws(" ", "root_id", "sha").alias("commit"), "c.subject", "c.body")
    return ranking.postings(last, "commit", T.term_list(F.concat_ws(" ", "subject", "body")))


_LAST = """
with x as (select *, row_number() over (partition by root_id, sha order by id desc, subject desc nulls last, body desc nulls last) rn from commits where sha is not null and root_id is not null and id is not null),
d as (select root_id || ' ' || sha as commit, concat_ws(' ', subject, body) t from x where rn = 1)"""
_BM25 = f"""{_LAST},
p as (select commit, term, count(*) tf from (select commit, unnest({_TERMS.format(c='t')}) term from d) group by 1, 2), l as (select commit, sum(tf) len from p group by 1), t as (select count(*) docs, avg(len) mean from l),
h as (select * from p where term in ('render', 'window', 'scope', 'cursor')), df as (select term, count(*) df from h group by 1),
s as (select h.commit, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) score from h join df using (term) join l using (commit), t group by 1)"""


@query(_BM25 + "select commit, score from s")
def commit_search(spark, sf):
    """Every commit with a term of the query, scored by BM25."""
    return ranking.bm25(_commit_index(spark, sf), "commit", _ASK)


@query(_BM25 + "select commit, score, row_number() over (order by score desc, commit) place from s order by score desc, commit limit 20")
def commit_search_top(spark, sf):
    return ranking.ranked(ranking.bm25(_commit_index(spark, sf), "commit", _ASK), "score", "commit", 20)


@query(_BM25 + """, a as (select commit, row_number() over (order by score desc, commit) place from s order by score desc, commit limit 30),
b as (select commit, row_number() over (order by n desc, commit) place from (select root_id || ' ' || sha as commit, max(id) n from commits where sha is not null and root_id is not null group by 1) order by n desc, commit limit 30)
select commit, round(sum(x), 6) score from (select commit, 1.0 / (5 + place) x from a union all select commit, 0.75 / (5 + place) from b) group by 1""")
def fused_commits(spark, sf):
    """Reciprocal rank fusion of the keyword list and the newest commits."""
    a = ranking.ranked(ranking.bm25(_commit_index(spark, sf), "commit", _ASK), "score", "commit", 30)
    newest = table(spark, sf, "commits").filter("sha is not null and root_id is not null").groupBy(F.concat_ws(" ", "root_id", "sha").alias("commit")).agg(F.max("id").alias("n"))
    return ranking.fuse([(a, 1.0), (ranking.ranked(newest, "n", "commit", 30), 0.75)], "commit", 5)


@query(f"""
with d as (select distinct file_id, rel_path from files where rel_path is not null), p as (select distinct file_id, unnest({_TERMS.format(c='rel_path')}) term from d),
n as (select count(distinct file_id) n from p) select term, count(distinct file_id) df, round(1 + ln(((select n from n) + 1) / (count(distinct file_id) + 1)), 6) weight from p group by 1""")
def path_term_weights(spark, sf):
    docs = table(spark, sf, "files").filter("rel_path is not null").select("file_id", "rel_path").distinct()
    return ranking.term_weights(ranking.postings(docs, "file_id", T.terms(F.col("rel_path"))), "file_id")


@query(r"""
with r as (select chunk_id, unnest([t for t in string_split(lower(regexp_replace(chunk_text_preview, '[^A-Za-z0-9]+', ' ', 'g')), ' ') if t <> '']) t from (select distinct chunk_id, chunk_text_preview from semantic_chunks where chunk_text_preview is not null)),
w as (select chunk_id, t from r union all select chunk_id, x from (select chunk_id, t, unnest(regexp_extract_all(t, '[a-z]+|[0-9]+')) x from r) where x <> t),
c as (select chunk_id, 16 * (instr('0123456789abcdef', substr(sha256(t), 7, 1)) - 1) + instr('0123456789abcdef', substr(sha256(t), 8, 1)) - 1 dim, count(*) n from w group by 1, 2)
select chunk_id, dim, round(n / sqrt(sum(n * n) over (partition by chunk_id)), 6) weight from c""")
def preview_vectors(spark, sf):
    """The hashed term vector of each chunk's preview: (chunk_id, dim, weight)."""
    rows = table(spark, sf, "semantic_chunks").filter("chunk_text_preview is not null").select("chunk_id", "chunk_text_preview").distinct()
    return ranking.term_vectors(rows, "chunk_id", F.col("chunk_text_preview"))


@query(r"""
with f as (select distinct root_id, rel_path, regexp_extract(rel_path, '([^/]+)$', 1) as name from files where rel_path is not null)
select root_id, name, min(rel_path) rel_path from f group by 1, 2 having count(*) = 1""")
def unique_names(spark, sf):
    """File names that stand for one path of their root: only they are credited when a query names a bare file."""
    f = table(spark, sf, "files").filter("rel_path is not null").select("root_id", "rel_path").distinct()
    return f.groupBy("root_id", F.regexp_extract("rel_path", r"([^/]+)$", 1).alias("name")).agg(F.min("rel_path").alias("rel_path"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query(r"""
with g as (select distinct repo, regexp_replace(replace(unnest(gold), '\', '/'), '^(\./)+', '') path from tasks),
f as (select distinct r.repo, f.rel_path path from files f join roots r using (root_id)) select g.repo, g.path from g anti join f on g.repo = f.repo and g.path = f.path""")
def unknown_gold_paths(spark, sf):
    """Gold paths of tasks that no file of their repository has."""
    g = table(spark, sf, "tasks").select("repo", F.explode("gold").alias("g"))
    g = g.select("repo", F.regexp_replace(F.replace("g", F.lit("\\"), F.lit("/")), r"^(\./)+", "").alias("path")).distinct()
    f = table(spark, sf, "files").join(table(spark, sf, "roots").select("root_id", "repo"), "root_id").select("repo", F.col("rel_path").alias("path")).distinct()
    return g.join(f, ["repo", "path"], "left_anti")


# ---------------------------------------------------------------- history


@query("""
select case status when 'A' then 'added' when 'D' then 'deleted' when 'R' then 'renamed' when 'M' then 'modified' when 'T' then 'retyped' end status_name, count(*) changes, count(distinct path) paths
from (select distinct commit_id, status, path, old_path from commit_files) group by 1""")
def change_kinds(spark, sf):
    rows = table(spark, sf, "commit_files").select("commit_id", "status", "path", "old_path").distinct()
    return rows.groupBy(T.status_word(F.col("status")).alias("status_name")).agg(F.count("*").alias("changes"), F.countDistinct("path").alias("paths"))


@query("""
with c as (select distinct id, root_id from commits where id is not null and root_id is not null),
gone as (select c.root_id, old_path path, commit_id from commit_files f join c on f.commit_id = c.id where status = 'R' and old_path is not null union select c.root_id, path, commit_id from commit_files f join c on f.commit_id = c.id where status = 'D' and path is not null)
select g.root_id, g.path, max(commit_id) commit_id from gone g anti join (select distinct root_id, rel_path from files where rel_path is not null) k on g.root_id = k.root_id and g.path = k.rel_path group by 1, 2""")
def lost_paths(spark, sf):
    """Paths that a root's commits deleted or renamed and none of its files has now, with the newest such commit."""
    c = table(spark, sf, "commits").select(F.col("id").alias("commit_id"), "root_id").filter("commit_id is not null and root_id is not null").distinct()
    f = table(spark, sf, "commit_files").join(c, "commit_id")
    gone = f.filter("status = 'R' and old_path is not null").select("root_id", F.col("old_path").alias("path"), "commit_id").unionByName(f.filter("status = 'D' and path is not null").select("root_id", "path", "commit_id"))
    known = table(spark, sf, "files").select("root_id", F.col("rel_path").alias("path")).filter("path is not null").distinct()
    return gone.groupBy("root_id", "path").agg(F.max("commit_id").alias("commit_id")).join(known, ["root_id", "path"], "left_anti")


@query("select root_id, id from (select root_id, id, row_number() over (partition by root_id order by id desc) rn from (select distinct root_id, id from commits)) where rn <= 50")
def newest_commits(spark, sf):
    """The 50 newest deliveries of each root."""
    return incremental.newest(table(spark, sf, "commits"), "root_id", "id", 50)


@query("""
select distinct h.root_id, h.generation_id, h.recorded_at, (select arg_max(c.id, (c.commit_date, c.id)) from commits c where c.root_id = h.root_id and c.commit_date <= h.recorded_at) id
from history_state h where h.recorded_at is not null and h.root_id is not null""")
def commits_as_of_runs(spark, sf):
    """The newest commit by date that each run could see."""
    runs = table(spark, sf, "history_state").filter("recorded_at is not null and root_id is not null").select("root_id", "generation_id", "recorded_at").distinct()
    return intervals.as_of(runs, table(spark, sf, "commits").select("root_id", "commit_date", "id").distinct(), "root_id", "recorded_at", "commit_date", "id")


# ---------------------------------------------------------------- graph

_EDGES = """
with e as (select distinct 'c' || c_custkey source, 'n' || c_nationkey target from customer union select distinct 's' || s_suppkey, 'n' || s_nationkey from supplier
union select 'n' || n_nationkey, 'r' || n_regionkey from nation union select 'r' || r_regionkey, 'world' from region)"""


def _edges(spark, sf):
    def pairs(t, a, x, b, y):
        return table(spark, sf, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"))

    return pairs("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(pairs("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(pairs("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(
        table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("source"), F.lit("world").alias("target"))
    )


@query(_EDGES + ", b as (select source, target from e union select target, source from e), h1 as (select target id, 1 hops from b where source = 'c1'), h2 as (select target id, 2 from b join h1 on b.source = h1.id), "
       "h3 as (select target, 3 from b join (select distinct id from h2) x on b.source = x.id) select id, min(hops) hops from (select 'c1' id, 0 hops union all select * from h1 union all select * from h2 union all select * from h3) group by 1")
def nodes_within_three(spark, sf):
    return graph.reach(_edges(spark, sf), spark.createDataFrame([("c1",)], "id string"), 3, undirected=True)


@query()
def path_between(spark, sf):
    return graph.shortest_path(_edges(spark, sf), "c1", "r0", 6)


@query()
def node_communities(spark, sf):
    e = _edges(spark, sf)
    return graph.communities(graph.degrees(e).select("id"), e)


@query(_EDGES + ", d as (select id, count(*) degree from (select source id from e union all select target from e) group by 1), g as (select id, substr(id, 1, 1) community, degree from d), r as (select *, row_number() over (partition by community order by degree desc, id) rn from g) select community, id, degree from r where rn = 1")
def community_hubs(spark, sf):
    e = _edges(spark, sf).distinct()
    return graph.hubs(e, graph.degrees(e).select("id", F.substring("id", 1, 1).alias("community")))


@query("select source, target, relation, min(confidence) confidence from (select 'o' || l_orderkey source, 'p' || l_partkey target, l_returnflag relation, case when l_linestatus = 'F' then 'EXTRACTED' else 'INFERRED' end confidence from lineitem) group by 1, 2, 3")
def canonical_edges(spark, sf):
    li = table(spark, sf, "lineitem")
    e = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_returnflag").alias("relation"), F.when(F.col("l_linestatus") == "F", "EXTRACTED").otherwise("INFERRED").alias("confidence"))
    return graph.canonical_edges(e)


# ---------------------------------------------------------------- sessions and reports


def _session_events(spark, sf):
    action = F.create_map(*[F.lit(x) for x in ("view", "query", "click", "opened", "purchase", "changed", "error", "stop")])[F.col("event_type")]
    return table(spark, sf, "events").select(F.col("user_id").alias("session"), action.alias("action"), F.col("ts").alias("time"), F.get_json_object("props", "$.k").alias("path")).filter("action is not null")


_SESSIONS = """
with ev as (select distinct user_id as session, case event_type when 'view' then 'query' when 'click' then 'opened' when 'purchase' then 'changed' when 'error' then 'stop' end as action, ts, props->>'$.k' path from events where event_type in ('view', 'click', 'purchase', 'error')),
q as (select distinct session, ts as qstart from ev where action = 'query'),
w as (select session, qstart, least((select min(n.qstart) from q n where n.session = q.session and n.qstart > q.qstart), (select min(s.ts) from ev s where s.action = 'stop' and s.session = q.session and s.ts >= q.qstart), qstart + interval 2 hour) as qend from q)
"""


@query(_SESSIONS + 'select session, qstart as "start", qend as "end" from w')
def session_windows(spark, sf):
    return sessions.windows(_session_events(spark, sf))


@query(_SESSIONS + """, t as (select e.session, (select max(q.qstart) from q where q.session = e.session and q.qstart <= e.ts) qstart, e.action, e.ts, e.path from ev e where e.action in ('opened', 'changed'))
select t.session, t.qstart as "start", w.qend as "end", count(distinct path) filter (where action = 'opened') opened, count(distinct path) filter (where action = 'changed') changed from t join w on t.session = w.session and t.qstart = w.qstart where t.ts <= w.qend group by 1, 2, 3""")
def session_records(spark, sf):
    return sessions.records(_session_events(spark, sf))


@query("""
select user_id, event_type, count(*) events, round(sum(value), 4) total, round(count(*) filter (where event_type = 'click') / nullif(count(*) filter (where event_type in ('click', 'view')), 0), 6) click_share
from events group by rollup (user_id, event_type)""")
def usage_report(spark, sf):
    """Counts for each session and kind, each session, and all; shares are null where there is nothing to share."""
    e = F.col("event_type")
    clicks, both = F.count(F.when(e == "click", 1)), F.count(F.when(e.isin("click", "view"), 1))
    return table(spark, sf, "events").rollup("user_id", "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"), evaluation.share(clicks, both).alias("click_share"))


_GRADED = """
with r as (select l_orderkey, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) place, row_number() over (partition by l_orderkey order by l_quantity % 4 desc, l_linenumber) ideal, (l_quantity % 4)::int grade from lineitem)
"""


def _graded(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("grade", (F.col("l_quantity") % 4).cast("int"))
    w = Window.partitionBy("l_orderkey")
    return li.select("l_orderkey", F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_linenumber")).alias("place"), F.row_number().over(w.orderBy(F.desc("grade"), "l_linenumber")).alias("ideal"), "grade")


@query(_GRADED + "select l_orderkey, round(sum((2 ** grade - 1) / log2(place + 1.0)) filter (where place <= 5) / nullif(sum((2 ** grade - 1) / log2(ideal + 1.0)) filter (where ideal <= 5), 0), 6) ndcg from r group by 1")
def ndcg_at_5(spark, sf):
    return evaluation.ndcg(_graded(spark, sf), "l_orderkey", 5)


@query(_GRADED + 'select l_orderkey, round(count(*) filter (where grade >= 2 and place <= 3) / nullif(count(*) filter (where grade >= 2), 0), 6) recall, round(1.0 / min(place) filter (where grade >= 2), 6) reciprocal_rank, count(*) filter (where grade >= 2 and place <= 3) > 0 hit from r group by 1')
def recall_at_3(spark, sf):
    return evaluation.recall(_graded(spark, sf), "l_orderkey", 3)


@query("select o_orderpriority, quantile_disc(o_totalprice, 0.95) o_totalprice from orders group by 1")
def price_p95(spark, sf):
    return evaluation.nearest_rank_ranges(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", 0.95)

"""Queries of the ranked lookup over all roots, stage by stage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import roles as R
from codelode.functions.query import STOPWORDS, Query, body_words, code_names
from codelode.operators import extraction, feedback, lookup, ranking
from codelode.plans.repositories import _DEFINED
from codelode.session import cut, table

QUERIES, ORACLE = {}, {}

#: The task all stages are asked for, and a question of a headline and a body long enough for the keyword list.
TASK = "Fix render window so that `parse_scope` keeps the cursor"
LONG_TASK = TASK + "\n\nWhen the gateway reloads a manifest the scheduler drops the ledger, and the shard, the replay queue, the token budget, the posting index, the digest, the bundle, the adapter, the anchor and the filter all report a stale snapshot of the graph."


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _index(spark, sf):
    """The file index, built once and kept in the shared folder, as every stage reads it."""
    return cut(lookup.file_index(table(spark, sf, "files"), table(spark, sf, "contents")))


def _symbols(spark, sf):
    c = table(spark, sf, "contents").filter("root_id is not null and rel_path is not null and content is not null")
    ids = c.select("file_id", "root_id", "rel_path").distinct()
    return extraction.definitions(c).join(ids, "file_id").select("root_id", "rel_path", "name", "kind", "line_start").distinct()


def _pieces(spark, sf):
    """Pieces of symbols with the words of their lines, a term at most three times."""
    from codelode.operators.chunks import symbol_texts

    return cut(symbol_texts(table(spark, sf, "contents")))


_LOW = {"filename": 1.4, "extension": 0.4, "content_hint": 0.8, "metadata_text": 0.8}
_INDEX = """
with f0 as (select *, row_number() over (partition by root_id, rel_path order by indexed_at desc nulls last, hash desc nulls last, file_id desc nulls last, filename desc nulls last, extension desc nulls last, adapter desc nulls last, content_hint desc nulls last, metadata_text desc nulls last, size desc nulls last) rn
  from files where root_id is not null and rel_path is not null),
c0 as (select root_id, rel_path, content, row_number() over (partition by root_id, rel_path order by modification_time desc nulls last, content desc) rn from contents where root_id is not null and rel_path is not null and content is not null),
ix as (select f.root_id, f.rel_path, coalesce(filename, '') filename, coalesce(extension, '') extension, coalesce(adapter, '') adapter, coalesce(content_hint, '') content_hint, coalesce(metadata_text, '') metadata_text, coalesce(c.content, '') body
  from (select * from f0 where rn = 1) f left join (select * from c0 where rn = 1) c on f.root_id = c.root_id and f.rel_path = c.rel_path)"""
_PLAIN = r"[w for w in string_split(lower(regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') if w <> '']"
_BODY = r"[w for w in string_split(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' ') if length(w) >= 2 and not regexp_matches(w, '^[0-9]+$')]"
_TERMS = Query(TASK).terms


def _bm25_sql(terms: list[str], prefix: bool = True) -> str:
    cols = {**{c: _PLAIN.format(c=c) for c in ("rel_path", *_LOW)}, "body": _BODY.format(c="body")}
    weights = {"rel_path": 1.0, **_LOW, "body": 0.8}
    hit = (lambda c, t: f"len([x for x in a_{c} if starts_with(x, '{t}')])") if prefix else (lambda c, t: f"len([x for x in a_{c} if x = '{t}'])")
    tf = ", ".join("(" + " + ".join(f"{w} * {hit(c, t)}" for c, w in weights.items()) + f") t{i}" for i, t in enumerate(terms))
    arrays = ", ".join(f"{sql} a_{c}" for c, sql in cols.items())
    score = " + ".join(f"case when t{i} > 0 then greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * t{i} * 2.2 / (t{i} + 1.2 * (1 - 0.75 + 0.75 * ln_ / mean)) else 0 end" for i in range(len(terms)))
    return f"""{_INDEX},
ar as (select root_id, rel_path, {arrays} from ix), tf as (select root_id, rel_path, {' + '.join(f'len(a_{c})' for c in cols)} ln_, {tf} from ar),
st as (select root_id, count(*) n, avg(ln_) mean, {', '.join(f'count(*) filter (where t{i} > 0) d{i}' for i in range(len(terms)))} from tf group by 1),
sc as (select root_id, rel_path, round({score}, 9) rk from tf join st using (root_id) where {' or '.join(f't{i} > 0' for i in range(len(terms)))}),
top as (select *, row_number() over (partition by root_id order by rk desc, rel_path) place from sc)"""


_BOOST = _bm25_sql(_TERMS) + f", bo as (select root_id, rel_path, round_even((8 + 72 * rk / max(rk) over (partition by root_id)) * {Query(TASK).scale}, 0)::int boost from top where place <= 80)"


@query(_BOOST + " select root_id, rel_path, boost from bo")
def keyword_boosts(spark, sf):
    """The keyword boost of the 80 best files of each root, by BM25 over six weighted columns with prefix terms."""
    return lookup.keyword_boosts(_index(spark, sf), Query(TASK))


_M = lambda p: f"regexp_matches(rel_path, '{p}')"
_DOC, _TEST, _MIG = f"({_M(R.DOC_FOLDER)} or {_M(R.DOC_NAME)} or {_M(R.DOC_TEXT)})", f"({_M(R.TEST_FOLDER)} or {_M(R.TEST_NAME)})", f"({_M(R.MIGRATION_FOLDER)} or {_M(R.MIGRATION_NAME)})"
_SOURCE = f"({_M(R.SOURCE)} and not ({_DOC} or {_TEST} or {_MIG} or {_M(R.RETIRED)} or {_M(R.SUPPORT)}))"
_NOISE, _BUNDLE = f"({_M(R.NOISE_FOLDER)} or {_M(R.BUNDLE)} or {_M(R.META)})", _M(R.BUNDLE)


def _intent_sql(source: str, score: str) -> str:
    """The edit rules one after the other, each cut to a whole number."""
    return f"""
i1 as (select *, case when {_M(R.RETIRED)} then trunc({score} * 0.5) else {score} end s1 from {source}), i2 as (select *, case when {_NOISE} then trunc(s1 * 0.3) else s1 end s2 from i1),
i3 as (select *, case when {_SOURCE} and not {_BUNDLE} then s2 + 100 else s2 end s3 from i2), i4 as (select *, case when {_DOC} then trunc(s3 * 0.6) - 60 when {_M(R.SUPPORT)} and not {_TEST} then trunc(s3 * 0.75) - 20 else s3 end s4 from i3),
i5 as (select *, case when {_TEST} then trunc(s4 * 0.75) - 20 else s4 end s5 from i4), i6 as (select *, greatest(1, case when {_MIG} then trunc(s5 * 0.55) - 50 else s5 end)::int score from i5)"""


_CONTENT = _BOOST + f""",
hits as (select ix.*, {', '.join(f"({' + '.join(f'contains(lower({c}), {chr(39)}{t}{chr(39)})::int' for t in _TERMS)})::int {k}" for k, c in (('filename_hits', 'filename'), ('path_hits', 'rel_path'), ('hint_hits', 'content_hint'), ('metadata_hits', 'metadata_text')))} from ix),
raw as (select h.*, b.boost fts, 30 * filename_hits + 20 * path_hits + 10 * hint_hits + 6 * metadata_hits + coalesce(b.boost, 0) r from hits h left join bo b using (root_id, rel_path)),
cs as (select *, r + case when r > 0 and adapter <> 'generic' then 8 else 0 end content_score from raw where r > 0),{_intent_sql('cs', 'content_score')}"""


@query(_CONTENT + " select root_id, rel_path, filename_hits, path_hits, hint_hits, metadata_hits, fts, content_score::int content_score, score from i6")
def content_scores(spark, sf):
    """The content score of every file with its signals, after the intent rules."""
    return lookup.content_scores(_index(spark, sf), Query(TASK)).select("root_id", "rel_path", "filename_hits", "path_hits", "hint_hits", "metadata_hits", "fts", "content_score", "score")


def _round3(x: str) -> str:
    return f"round({x}, 3)"


_LEARN = " + ".join(
    [f"{_round3(f'ln(1 + {c})')} * {lookup.WEIGHTS[c]}" for c in ("filename_hits", "path_hits", "hint_hits", "metadata_hits", "content_score")]
    + [f"{_round3('ln(1 + coalesce(fts, 0))')} * {lookup.WEIGHTS['fts']}", f"{_round3('ln(1 + score)')} * {lookup.WEIGHTS['final_score']}", f"{_round3('ln(1 + size)')} * {lookup.WEIGHTS['file_bytes']}",
       f"{_round3('least(round(score / content_score, 4), 2.0)')} * {lookup.WEIGHTS['intent_multiplier']}", f"{_round3('ln(place)')} * {lookup.WEIGHTS['log_rank']}", f"{lookup.WEIGHTS['has_content']}",
       f"{_DOC}::int * {lookup.WEIGHTS['doc']}", f"{_M(R.SUPPORT)}::int * {lookup.WEIGHTS['supporting']}", f"{_MIG}::int * {lookup.WEIGHTS['migration']}", f"ends_with(rel_path, '__init__.py')::int * {lookup.WEIGHTS['init']}",
       f"(len(string_split(rel_path, '/')) - 1) * {lookup.WEIGHTS['depth']}"]
)


@query(_CONTENT.replace("metadata_text, coalesce(c.content", "metadata_text, coalesce(size, 0) size, coalesce(c.content") + f""",
pl as (select *, row_number() over (partition by root_id order by score desc, rel_path) place from i6), po as (select * from pl where place <= 50),
le as (select root_id, rel_path, place, score, round({_LEARN}, 3) learned from po),
ne as (select root_id, rel_path, row_number() over (partition by root_id order by learned desc, place) place from le)
select n.root_id, n.rel_path, n.place::int place, l.score from ne n join le l on n.root_id = l.root_id and n.place = l.place""")
def reranked_pool(spark, sf):
    """The first 50 files of each root in the learned order, with the pool's scores handed out again."""
    rows = lookup.reranked(lookup.content_scores(_index(spark, sf), Query(TASK)))
    return rows.filter("place is not null").select("root_id", "rel_path", "place", "score")


_SEEN = "(" + " + ".join(f"list_contains(ws, '{t}')::int" for t in sorted(set(_TERMS))) + ")"


def _query_vector() -> dict[int, float]:
    import hashlib
    import math
    import re

    n: dict[int, int] = {}
    for run in re.findall("[a-z0-9]+", TASK.lower()):
        d = int(hashlib.sha256(run.encode()).hexdigest()[:8], 16) % 256
        n[d] = n.get(d, 0) + 1
    return {d: round(v / math.sqrt(sum(x * x for x in n.values())), 6) for d, v in n.items()}


_SIM = " + ".join(f"coalesce(try_cast(m->>'{d}' as double), 0) * {w}" for d, w in sorted(_query_vector().items()))


@query(rf"""
with c as (select * from (select *, row_number() over (partition by chunk_id order by rel_path) rn from (select distinct chunk_id, root_id, rel_path, chunk_text_preview, vector_json from semantic_chunks where root_id is not null and rel_path is not null)) where rn = 1),
v as (select root_id, rel_path, case when json_valid(vector_json) then cast(vector_json as json) end m, [w for w in string_split(lower(regexp_replace(coalesce(chunk_text_preview, ''), '[^A-Za-z0-9]+', ' ', 'g')), ' ') if w <> ''] ws from c),
s as (select root_id, rel_path, {_SIM} sim, {_SEEN} seen from v), k as (select root_id, rel_path, case when sim > 0 then round_even(sim * 100, 0) else least(12, 3 * seen) end::int k from s)
select root_id, rel_path, sum(k)::int score from k where k > 0 group by 1, 2""")
def semantic_scores(spark, sf):
    """Files by the summed similarity of their chunks' stored vectors to the task's, chunks with one row of data each."""
    c = table(spark, sf, "semantic_chunks")
    one = c.groupBy("chunk_id").agg(F.countDistinct("root_id", "rel_path", F.coalesce("chunk_text_preview", F.lit("")), F.coalesce("vector_json", F.lit(""))).alias("n")).filter("n = 1")
    return ranking.semantic_scores(c.join(one, "chunk_id", "left_semi"), TASK)


ORACLE["semantic_scores"] = ORACLE["semantic_scores"].replace("where rn = 1)", "where chunk_id in (select chunk_id from semantic_chunks where root_id is not null and rel_path is not null group by 1 having count(distinct (root_id, rel_path, coalesce(chunk_text_preview, ''), coalesce(vector_json, ''))) = 1))")


def _records(spark, sf):
    """Past records made of commits: the subject is the query, and what happened to a path is its role."""
    c = table(spark, sf, "commits").filter("root_id is not null and id is not null").groupBy("root_id", "id").agg(F.max("subject").alias("query"))
    f = table(spark, sf, "commit_files").filter("path is not null").select("commit_id", "status", "path").distinct()
    role = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("path"))))  # noqa: E731  # the files of one commit
    rows = f.groupBy("commit_id").agg(role("M").alias("changed"), role("A").alias("opened"), role("R").alias("missed"), role("D").alias("ignored"), role("T").alias("suggested"))
    outcome = F.element_at(F.array(*map(F.lit, ["passed", "partial", "failed", "unknown"])), (F.col("id") % 4 + 1).cast("int"))
    return c.join(rows, F.col("id") == F.col("commit_id")).select("root_id", "id", "query", outcome.alias("outcome"), "suggested", "opened", "changed", "missed", "ignored")


_PAST = "render window scope cursor parser index"
_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_PT = rf"list_distinct([lower(w) for w in regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(coalesce(query, ''), '[_/-]', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Za-z0-9]+') if length(w) >= 2 and lower(w) not in ({_STOP})])"
_SIGNALS = f"""
with c as (select root_id, id, max(subject) as query from commits where root_id is not null and id is not null group by 1, 2),
f as (select distinct commit_id, status, path from commit_files where path is not null),
r as (select c.*, {_PT} t from c), s as (select root_id, id, len([x for x in t if x in ('render', 'window', 'scope', 'cursor', 'parser', 'index')]) b, len(t) n from r),
m as (select root_id, id, case when b >= 2 or (b >= 1 and (b = n or b = 6)) then b / (n + 6 - b) else 0 end sim from s),
x as (select m.root_id, m.id, f.path, m.sim, max(case f.status when 'M' then 1.0 when 'R' then 1.0 when 'A' then 0.4 * case m.id % 4 when 0 then 1.0 when 1 then 0.6 when 2 then 0.3 else 0.6 end when 'D' then -0.3 end) e, max((f.status in ('M', 'A', 'R'))::int) used,
  max((f.status = 'T')::int) sug from m join f on m.id = f.commit_id where sim > 0 group by 1, 2, 3, 4),
k as (select root_id, id, max(used) act from (select m.root_id, m.id, (f.status in ('M', 'A'))::int used from m join f on m.id = f.commit_id where sim > 0) group by 1, 2),
g as (select x.root_id, x.path rel_path, round(coalesce(sum(sim * sim * e), 0), 6) weight, sum(case when sug = 1 and used = 0 and act = 1 then 1 else 0 end) >= 3 and max(used) = 0 unused, sum(used)::bigint helped, count(e) ne from x join k on x.root_id = k.root_id and x.id = k.id group by 1, 2)"""


@query(_SIGNALS + " select root_id, rel_path, weight, unused, helped from g where ne > 0 or unused")
def feedback_signals(spark, sf):
    """What records similar to a query tell of each path."""
    rows = _records(spark, sf).withColumn("query", F.regexp_replace("query", r"\.", " "))
    return feedback.signals(rows, _PAST)


ORACLE["feedback_signals"] = ORACLE["feedback_signals"].replace("max(subject) as query", "replace(max(subject), '.', ' ') as query")


@query(ORACLE["feedback_signals"].split(" select root_id, rel_path, weight, unused")[0] + """,
base as (select distinct root_id, path rel_path, (50 + length(path))::int score from commit_files f join (select distinct root_id, id from commits where root_id is not null) c on f.commit_id = c.id where status = 'M' and path is not null),
top as (select root_id, max(score) t from base group by 1), sig as (select * from g where ne > 0 or unused),
j as (select coalesce(b.root_id, s.root_id) root_id, coalesce(b.rel_path, s.rel_path) rel_path, b.score s, s.weight w, s.unused u from base b full join sig s on b.root_id = s.root_id and b.rel_path = s.rel_path),
kk as (select j.*, coalesce(t, 100) t from j left join top using (root_id)),
a as (select *, case when w > 0 then s + round_even(0.5 * least(w, 1.0) * t, 0) when w < 0 then greatest(1, s + round_even(0.5 * greatest(w, -1.0) * t * 0.5, 0)) else s end m from kk),
z as (select root_id, rel_path, case when w is null then s when s is null then case when w > 0 then round_even(0.5 * least(w, 1.0) * t, 0) end else greatest(1, case when u then greatest(1, round_even(m * 0.8, 0)) else m end) end score from a)
select root_id, rel_path, score::int score from z where score > 0""")
def feedback_applied(spark, sf):
    """Rows with a score after what the records tell."""
    c = table(spark, sf, "commits").filter("root_id is not null").select("root_id", F.col("id").alias("commit_id")).distinct()
    rows = table(spark, sf, "commit_files").filter("status = 'M' and path is not null").join(c, "commit_id").select("root_id", F.col("path").alias("rel_path")).distinct()
    rows = rows.withColumn("score", 50 + F.char_length("rel_path"))
    records = _records(spark, sf).withColumn("query", F.regexp_replace("query", r"\.", " "))
    return feedback.apply(rows, feedback.signals(records, _PAST))


@query("""
with c as (select root_id, id from commits where root_id is not null and id is not null group by 1, 2), f as (select distinct commit_id, status, path from commit_files where path is not null),
r as (select c.root_id, c.id, ['passed', 'partial', 'failed', 'unknown'][(c.id % 4 + 1)::int] outcome, count(*) filter (where status = 'T') suggested, count(*) filter (where status = 'A') opened, count(*) filter (where status = 'M') changed, count(*) filter (where status = 'R') missed, count(*) filter (where status = 'D') ignored
  from c join f on c.id = f.commit_id group by 1, 2, 3)
select root_id, outcome, count(*) records, sum(suggested)::bigint suggested, sum(opened)::bigint opened, sum(changed)::bigint changed, sum(missed)::bigint missed, sum(ignored)::bigint ignored from r group by rollup (root_id, outcome)""")
def feedback_stats(spark, sf):
    return feedback.stats(_records(spark, sf))


_LIFTED = _CONTENT.replace("metadata_text, coalesce(c.content", "metadata_text, coalesce(size, 0) size, coalesce(c.content").replace("\nwith f0", "\nwith " + _DEFINED + ",\nf0") + f""",
df as (select distinct c.root_id, c.rel_path from contents c join defs d on c.file_id = d.file_id where d.name in ('parse_scope') and c.root_id is not null and c.rel_path is not null and c.content is not null),
li as (select i6.* exclude (score), i6.score s0, case when df.root_id is null then 0 else 1 end named_defs, case when df.root_id is null then i6.score else trunc(i6.score * 1.1) end::int score from i6 left join df using (root_id, rel_path)),
pl as (select *, row_number() over (partition by root_id order by score desc, rel_path) place from li), po as (select * from pl where place <= 50),
le as (select root_id, rel_path, place, score, round({_LEARN.replace("score / content_score", "s0 / content_score")} + round(ln(1 + named_defs), 3) * {lookup.WEIGHTS['named_defs']}, 3) learned from po),
ne as (select root_id, rel_path, row_number() over (partition by root_id order by learned desc, place) place from le),
ho as (select n.root_id, n.rel_path, l.score from ne n join le l on n.root_id = l.root_id and n.place = l.place union all select root_id, rel_path, score from pl where place > 50),
pg as (select *, row_number() over (partition by root_id order by score desc, rel_path) place from ho)
select root_id, rel_path, place::int place, score from pg where place <= 10"""


@query(_LIFTED)
def ranked_page(spark, sf):
    """The page of the ranked lookup itself: ten files of each root with place and score."""
    return lookup.find(_index(spark, sf), _symbols(spark, sf), _pieces(spark, sf), TASK, 10).select("root_id", "rel_path", "place", "score")


@query()
def ranked_files(spark, sf):
    """The ten best files of each root for a short task, with their evidence and line ranges."""
    rows = lookup.find(_index(spark, sf), _symbols(spark, sf), _pieces(spark, sf), TASK, 10)
    return rows.select("root_id", "rel_path", "place", "score", "evidence", "ranges")


@query()
def ranked_files_long(spark, sf):
    """The same for a task with a long body, whose keyword list of files is fused in, with feedback and similarity."""
    found = feedback.signals(_records(spark, sf), TASK)
    known = table(spark, sf, "files").select("root_id", "rel_path").distinct()
    rows = lookup.find(_index(spark, sf), _symbols(spark, sf), _pieces(spark, sf), LONG_TASK, 10, signals=found.join(known, ["root_id", "rel_path"], "left_semi"), semantic=ranking.semantic_scores(table(spark, sf, "semantic_chunks"), TASK))
    return rows.select("root_id", "rel_path", "place", "score", "evidence", "ranges")


@query()
def piece_files(spark, sf):
    """The 30 best files of each root by pieces, code names, whole files and named symbols."""
    q = Query(LONG_TASK)
    return lookup.piece_file_ranking(_index(spark, sf), _pieces(spark, sf), _symbols(spark, sf), q, 200).filter("place <= 30")


_KEPT = list(dict.fromkeys(Query(TASK).terms))
_HEAVY = sorted({w for n in code_names(TASK) for w in Query(n).terms})


@query(rf"""{_INDEX}, b as (select root_id, rel_path, {_BODY.format(c='body')} w from ix where body <> ''), n as (select root_id, count(*) n from b group by 1),
t as (select unnest([{', '.join(f"'{t}'" for t in _KEPT)}]) term, unnest(range({len(_KEPT)})) pos),
d as (select b.root_id, t.term, t.pos, count(*) df from b join t on list_contains(b.w, t.term) group by 1, 2, 3)
select d.root_id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * case when term in ({', '.join(f"'{t}'" for t in _HEAVY)}) then 2.0 else 1.0 end, 6) weight from d join n using (root_id)""")
def kept_terms(spark, sf):
    """The query's terms by weight times rarity over a root's texts."""
    rows = _index(spark, sf).filter("body <> ''").withColumn("body", body_words(F.col("body")))
    return lookup.kept_terms(rows, _KEPT, set(_HEAVY))


@query(rf"""{_INDEX}, w as (select root_id, rel_path, unnest({_BODY.format(c='body')}) term from ix) select root_id, rel_path, term, least(count(*), 3)::bigint tf from w group by 1, 2, 3""")
def body_terms(spark, sf):
    """How often each term stands in each file's newest text, three at most: the postings of a full-text column."""
    p = ranking.postings(_index(spark, sf).withColumn("file", F.struct("root_id", "rel_path")), "file", body_words(F.col("body")))
    return p.select("file.root_id", "file.rel_path", "term", F.least("tf", F.lit(3)).alias("tf"))


_NAMED = "The traceback in src/jobs/column/parser.js and in `handbook.md` says that tests/conftest.py broke pyproject.toml"


@query()
def named_files(spark, sf):
    """The files that a text names by path, module or bare name, and which of them are of what kind."""
    return lookup.named_paths(table(spark, sf, "files").filter("root_id is not null and rel_path is not null"), Query(_NAMED))


@query("""
with p as (select distinct root_id, lower(rel_path) p from files where root_id is not null and rel_path is not null),
n as (select unnest(['src/jobs/column/parser.js', 'handbook.md', 'tests/conftest.py', 'pyproject.toml']) as name),
h as (select p.root_id, n.name, max((p.p = n.name or ends_with(p.p, '/' || n.name) or regexp_replace(p.p, '([^/])[.][^./]*$', '\\1') = n.name or ends_with(regexp_replace(p.p, '([^/])[.][^./]*$', '\\1'), '/' || n.name))::int) has from p cross join n group by 1, 2)
select root_id, name from h where has = 0""")
def missing_names(spark, sf):
    """File names that a text writes out and no file of the root has."""
    return lookup.missing_names(table(spark, sf, "files").filter("root_id is not null and rel_path is not null"), Query(_NAMED))

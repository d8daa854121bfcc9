"""Ranked file lookup: keyword boost, content score, intent rules, graph score, learned order, fusion, exact names, page.

All roots are searched at once and ranked apart. A query is a literal, so its terms become columns: a file's
hits are counted where the file lies, and only numbers by root are shuffled. Every place comes
from a total order (score falling, path rising), and a pool is first cut in salted parts, so a root with a third of
all files is never sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions import roles as R
from codelode.functions.query import MIGRATIONS, PLUMBING, Query, body_words, code_names, is_file_name, matches, mentions, named_identifiers, plain_tokens, terms_of, whole_name
from codelode.operators.joins import salted_join
from codelode.session import cut

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Files that get a keyword boost, rows of the learned pool, places of a list that take part in a fusion.
BOOSTED, POOL, LISTED = 80, 50, 30
# The fitted weights of the learned order, by signal.
WEIGHTS = {
    "graph_label": -244, "graph_path": 167, "graph_coverage": -63, "graph_matches": -157, "graph_multi": 91, "graph_degree": 142, "graph_topology": -85, "graph_reached": 65, "graph_score": 1,
    "filename_hits": -254, "path_hits": 197, "hint_hits": 55, "metadata_hits": 49, "fts": 22, "named_path": 396, "content_score": 69, "content_on_graph": 287, "named_defs": 1501, "feedback": 0,
    "exact_lift": 0, "cluster_bonus": 0, "final_score": 517, "file_bytes": 136, "intent_multiplier": 183, "log_rank": -847, "has_graph": 514, "has_content": 323, "doc": -1367, "supporting": -818,
    "migration": 5, "init": -112, "depth": -78,
}
# Weights of a file's columns in the keyword boost.
COLUMNS = {"rel_path": 1.0, "filename": 1.4, "extension": 0.4, "content_hint": 0.8, "metadata_text": 0.8, "body": 0.8}

KEYS = ["root_id", "rel_path"]


def file_index(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(root_id, rel_path, file_id, filename, extension, adapter, content_hint, metadata_text, size, body): each path once, as last indexed, with its newest text.

    Rows without root or path are left out; null texts are empty.
    """
    cols = ["file_id", "filename", "extension", "adapter", "content_hint", "metadata_text", "size"]
    f = files.filter("root_id is not null and rel_path is not null")
    last = f.groupBy(*KEYS).agg(F.max(F.struct("indexed_at", "hash", *cols)).alias("f")).select(*KEYS, *[F.col(f"f.{c}") for c in cols])
    c = contents.filter("root_id is not null and rel_path is not null and content is not null")
    text = c.groupBy(*KEYS).agg(F.max(F.struct("modification_time", "content")).alias("c")).select(*KEYS, F.col("c.content").alias("body"))
    texts = [F.coalesce(x, F.lit("")).alias(x) for x in ("filename", "extension", "adapter", "content_hint", "metadata_text", "body")]
    return last.join(text, KEYS, "left").select(*KEYS, "file_id", *texts, F.coalesce("size", F.lit(0)).alias("size"))


def best_of(rows: DataFrame, by: list[str], order: list[Column], most: int, salt: str = "rel_path") -> DataFrame:
    """``rows`` with ``place`` from one on, only the ``most`` first of each ``by``; cut in 16 salted parts before the last sort."""
    part = Window.partitionBy(*by, "_s").orderBy(*order)
    first = rows.withColumn("_s", F.pmod(F.xxhash64(salt), F.lit(16))).withColumn("_p", F.row_number().over(part)).filter(F.col("_p") <= most)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= most).drop("_s", "_p")


def bm25(rows: DataFrame, by: str, arrays: dict[str, float], terms: list[str], prefix: bool = True) -> DataFrame:
    """``rows`` with ``rank``, the BM25 score over weighted token arrays; rows without a term are dropped.

    Statistics are by ``by``. A term counts a token that begins with it, or only equal ones if not ``prefix``. Hits are counted in the row; only
    one row of counts for each ``by`` is shuffled. IDF is Robertson's, at least ``LEAST_IDF``.
    """
    if not terms:
        return rows.withColumn("rank", F.lit(0.0)).limit(0)
    def hits(t: Column) -> Column:
        one = [F.lit(w) * F.size(F.filter(c, (lambda x: F.startswith(x, t)) if prefix else (lambda x: x == t))) for c, w in arrays.items()]
        return reduce(lambda a, b: a + b, one)

    size = reduce(lambda a, b: a + b, [F.size(c) for c in arrays])
    # one expression over the terms, so the plan does not grow with the query
    counted = rows.withColumn("_tf", F.transform(F.array(*map(F.lit, terms)), hits)).withColumn("_len", size).drop(*arrays)
    counted = cut(counted)  # counts alone are kept, so no text is split twice
    stats = counted.groupBy(by).agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), F.array(*[F.sum((F.col("_tf")[i] > 0).cast("int")) for i in range(len(terms))]).alias("_df"))
    found = counted.filter(F.exists("_tf", lambda x: x > 0))
    scored = salted_join(found, stats, [by], ["_len", "_tf"])
    part = lambda f, d: F.greatest(F.lit(LEAST_IDF), F.log((F.col("_n") - d + 0.5) / (d + 0.5))) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.greatest(F.col("_mean"), F.lit(1e-9))))
    total = F.aggregate(F.zip_with("_tf", "_df", lambda f, d: F.when(f > 0, part(f, d)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("rank", F.round(total, 9)).drop("_tf", "_len", "_n", "_mean", "_df")


def keyword_boosts(index: DataFrame, q: Query) -> DataFrame:
    """(root_id, rel_path, boost): 8 to 80 by share of the best BM25 score for the ``BOOSTED`` best files of each root, more for long queries."""
    arrays = {f"_{c}": w for c, w in COLUMNS.items()}
    rows = index.select(*KEYS, *[(body_words(F.col(c)) if c == "body" else plain_tokens(F.col(c))).alias(f"_{c}") for c in COLUMNS])
    found = best_of(bm25(rows, "root_id", arrays, q.terms).select(*KEYS, "rank"), ["root_id"], [F.desc("rank"), F.asc("rel_path")], BOOSTED)
    best = F.max("rank").over(Window.partitionBy("root_id"))  # at most BOOSTED rows a root
    return found.select(*KEYS, F.when(best > 0, F.bround((8 + 72 * F.col("rank") / best) * q.scale)).otherwise(8).cast("int").alias("boost"))


# ---------------------------------------------------------------- files a query names


def _forms(p: Column) -> list[tuple[Column, bool]]:
    """A path as it is, without its ending, and as its package's folder."""
    stem = F.regexp_replace(p, r"(?<=[^/])\.[^./]*$", "")
    package = F.when(p.rlike(r"/(__init__|index)\.[^./]+$"), F.regexp_replace(p, r"/[^/]*$", ""))
    return [(p, True), (stem, False), (F.coalesce(package, F.lit("")), False)]


def _ends(p: Column, suffix: str) -> Column:
    return (p == suffix) | p.endswith("/" + suffix)


def named_paths(paths: DataFrame, q: Query) -> DataFrame:
    """(root_id, rel_path, named, boost): the files a query names; ``named`` is path, module or file name, the strongest alone.

    A path mention names the files sharing its longest suffix of two parts and more; a dotted one those ended by its longest prefix; a bare
    file name the one file of the root with it. More than three files alike name none.
    """
    p = paths.select(*KEYS).distinct()
    forms = _forms(F.col("rel_path"))
    folder, ending = F.regexp_extract("rel_path", "^([^/]+)/", 1), F.regexp_extract("rel_path", r"\.([^./]+)$", 1)
    found = []
    for m in mentions(q.text):
        parts = [x for x in m.split("/") if x] if "/" in m else m.split(".")
        if "/" in m:
            lengths = [F.when(_ends(f, "/".join(parts[-i:])), i) for f, _ in forms for i in range(2, len(parts) + 1)]
            found.append(("path", p.withColumn("_l", F.greatest(*lengths, F.lit(0), F.lit(0))).filter("_l >= 2"), 0))
            continue
        known_end = p.filter(ending == m.rpartition(".")[2]).select("root_id").distinct()
        found.append(("file name", p.filter(_ends(F.col("rel_path"), m)).withColumn("_l", F.lit(1)).join(known_end, "root_id", "left_semi"), 1))
        if len(parts) >= 2:
            lengths = [F.when(_ends(f, "/".join(parts[:i])), i) for f, _ in forms for i in range(2, len(parts) + 1)]
            rows = p.withColumn("_l", F.greatest(*lengths, F.lit(0), F.lit(0))).filter("_l >= 2").join(known_end, "root_id", "left_anti")
            if len(parts) == 2:
                rows = rows.join(p.filter(folder == parts[0]).select("root_id").distinct(), "root_id", "left_semi")
            found.append(("module", rows, 0))
    rows = None
    for i, (kind, hit, most_one) in enumerate(found):
        n = hit.groupBy("root_id", "_l").agg(F.count("*").alias("_n")).filter(F.col("_n") <= (1 if most_one else 3))
        if kind == "path":  # ties at the longest suffix alone count
            top = hit.groupBy("root_id").agg(F.max("_l").alias("_l"))
            n = n.join(top, ["root_id", "_l"], "left_semi")
        n = n.groupBy("root_id").agg(F.max("_l").alias("_l"))
        one = salted_join(hit, n, ["root_id", "_l"], ["rel_path"]).select(*KEYS, F.lit({"path": 1, "module": 2, "file name": 3}[kind]).alias("_k"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return p.limit(0).select(*KEYS, F.lit("").alias("named"), F.lit(0).alias("boost"))
    best = rows.groupBy(*KEYS).agg(F.min("_k").alias("_k"))
    return best.select(*KEYS, F.when(F.col("_k") == 1, "path").when(F.col("_k") == 2, "module").otherwise("file name").alias("named"), F.when(F.col("_k") == 3, 60).otherwise(120).alias("boost"))


def exact_paths(paths: DataFrame, q: Query) -> DataFrame:
    """(root_id, rel_path): the files the whole query names, in any case, with or without ending; none if more than three of a root do."""
    name = whole_name(q.text)
    p = paths.select(*KEYS).distinct()
    if name is None:
        return p.limit(0)
    low = F.lower("rel_path")
    stem = F.regexp_replace(low, r"(?<=[^/])\.[^./]*$", "")
    hit = p.filter(_ends(low, name) | _ends(stem, name))
    few = hit.groupBy("root_id").agg(F.count("*").alias("_n")).filter("_n <= 3").select("root_id")
    return hit.join(few, "root_id", "left_semi")


def missing_names(paths: DataFrame, q: Query) -> DataFrame:
    """(root_id, name): file names the query writes out that no file of the root has."""
    names = [m for m in dict.fromkeys(m.replace("\\", "/").rstrip(".-") for m in mentions(q.text)) if is_file_name(m)]
    p = paths.select(*KEYS).distinct()
    if not names:
        return p.limit(0).select("root_id", F.lit("").alias("name"))
    low = F.lower("rel_path")
    stem = F.regexp_replace(low, r"(?<=[^/])\.[^./]*$", "")
    has = p.groupBy("root_id").agg(F.array(*[F.max((_ends(low, n.lower()) | _ends(stem, n.lower())).cast("int")) for n in names]).alias("_h"))
    pair = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), F.col("_h").alias("has")))
    return has.select("root_id", pair.alias("z")).filter("z.has = 0").select("root_id", "z.name")


# ---------------------------------------------------------------- scores


def intent_adjusted(score: Column, p: Column, q: Query, minified: Column | None = None) -> Column:
    """A whole score after the intent rules in their order, cut to a whole number each time and at least one; scores of zero and less stay."""
    s = F.when(R.is_retired(p), (score * 0.5).cast("int")).otherwise(score)
    if not q.intent & PLUMBING:
        s = F.when(R.is_noise(p, minified), (s * 0.3).cast("int")).otherwise(s)
    if q.edits:
        s = F.when(R.is_source(p) & ~R.is_bundle(p, minified), s + 100).otherwise(s)
        s = F.when(R.is_doc(p), (s * 0.6).cast("int") - 60).when(R.is_supporting(p) & ~R.is_test(p), (s * 0.75).cast("int") - 20).otherwise(s)
        s = F.when(R.is_test(p), s + 100 if q.tests else (s * 0.75).cast("int") - 20).otherwise(s)
        s = F.when(R.is_migration(p), s + 20 if q.intent & MIGRATIONS else (s * 0.55).cast("int") - 50).otherwise(s)
    elif q.explains:
        s = F.when(R.is_doc(p), s + 25).otherwise(s)
    return F.when(score > 0, F.greatest(s, F.lit(1))).otherwise(score).cast("int")


def content_scores(index: DataFrame, q: Query) -> DataFrame:
    """``index`` rows (without texts) with ``score`` and the signals it is made of; files that score nothing are dropped.

    Each term gives 30 for the name, 20 for the path, 10 for the hint and 6 for the metadata that hold it; then the keyword boost, the boost of a named file, 8 for a special adapter and the intent rules.
    """
    low = {"filename_hits": ("filename", 30), "path_hits": ("rel_path", 20), "hint_hits": ("content_hint", 10), "metadata_hits": ("metadata_text", 6)}
    zero = F.lit(0)
    lits = F.array(*map(F.lit, q.terms)) if q.terms else F.array().cast("array<string>")

    def held(c: str) -> Column:
        return F.size(F.filter(lits, lambda t: F.contains(F.lower(F.col(c)), t)))

    hits = {k: held(c) for k, (c, _) in low.items()}
    rows = index.select(*KEYS, "file_id", "adapter", "size", *[v.alias(k) for k, v in hits.items()])
    rows = rows.join(keyword_boosts(index, q).withColumnRenamed("boost", "fts"), KEYS, "left").join(_named(index, q), KEYS, "left")
    raw = sum((F.col(k) * w for k, (_, w) in low.items()), F.coalesce("fts", zero)) + F.coalesce("named_path", zero)
    raw = raw + F.when((raw > 0) & (F.col("adapter") != "generic"), 8).otherwise(0)
    out = rows.withColumn("content_score", raw.cast("int")).filter("content_score > 0").withColumn("score", intent_adjusted(F.col("content_score"), F.col("rel_path"), q))
    return out.withColumn("intent_multiplier", F.round(F.col("score") / F.col("content_score"), 4))


def _named(index: DataFrame, q: Query) -> DataFrame:
    """(root_id, rel_path, named_path): boosts of named files; an exact name counts as a path. Tests named by a task that is not about tests count nothing."""
    rows = named_paths(index, q).select(*KEYS, "boost").unionByName(exact_paths(index, q).withColumn("boost", F.lit(120)))
    best = rows.groupBy(*KEYS).agg(F.max("boost").alias("named_path"))
    return best if q.tests else best.filter(~R.is_test(F.col("rel_path")))


def graph_scores(nodes: DataFrame, edges: DataFrame, q: Query) -> DataFrame:
    """(root_id, rel_path, graph_score, graph_label, graph_path, graph_coverage, graph_matches, graph_multi, graph_degree, graph_topology, graph_reached).

    ``nodes`` has id, root_id, rel_path, label; ``edges`` source and target. Terms weigh 1 + ln((N + 1) / (df + 1)) over a root's files. A file gets 30 for each weight of its best label, 25
    for its path, 12 for other terms in its labels, up to 15 for several matching labels and up to 30 for the best node's place in the graph;
    files without a match get 0.35 and 0.15 of a neighbour's label score over one and two hops, the best alone.
    """
    terms = q.terms
    if not terms:
        return nodes.select(*KEYS).limit(0).select(*KEYS, *[F.lit(0.0).alias(c) for c in GRAPH_SIGNALS])

    def one(col: Column, t: str) -> Column:
        return F.exists(col, lambda x: matches(x, t)).cast("int")

    def hit(col: Column) -> Column:
        return F.array(*[one(col, t) for t in terms])

    n = cut(nodes.select("id", *KEYS, hit(terms_of(F.col("label"))).alias("m")))
    any_ = lambda c: F.array(*[F.max(F.col(c)[i]) for i in range(len(terms))])
    files = n.groupBy(*KEYS).agg(any_("m").alias("labels")).withColumn("path", hit(terms_of(F.col("rel_path"))))
    df = files.groupBy("root_id").agg(F.count("*").alias("N"), F.array(*[F.sum(F.greatest(F.col("labels")[i], F.col("path")[i])) for i in range(len(terms))]).alias("df"))
    weights = df.select("root_id", F.transform("df", lambda d: 1 + F.log((F.col("N") + 1) / (d + 1))).alias("w"))
    weigh = lambda m: F.aggregate(F.zip_with(m, F.col("w"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    degree = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    scored = salted_join(n, weights, ["root_id"], ["id"]).withColumn("label", weigh(F.col("m")))
    found = scored.filter("label > 0").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = found.groupBy(*KEYS).agg(F.max(F.struct("label", "degree", "m")).alias("b"), F.count("*").alias("graph_matches"))
    rows = salted_join(files, weights, ["root_id"], ["rel_path"]).join(best, KEYS, "left")
    other = F.zip_with(F.zip_with("labels", "path", lambda a, b: F.greatest(a, b)), F.coalesce(F.col("b.m"), F.array_repeat(F.lit(0), len(terms))), lambda a, b: a * (1 - b))
    r6 = lambda c: F.round(c, 6)
    rows = rows.select(
        *KEYS, r6(30 * F.coalesce("b.label", F.lit(0.0))).alias("graph_label"), r6(25 * weigh(F.col("path"))).alias("graph_path"), r6(12 * F.when(F.col("b").isNotNull(), weigh(other)).otherwise(0.0)).alias("graph_coverage"),
        F.coalesce("graph_matches", F.lit(0)).alias("graph_matches"), r6(F.when(F.col("graph_matches") > 1, F.least(F.lit(15.0), 5 * F.log2("graph_matches"))).otherwise(0.0)).alias("graph_multi"),
        F.coalesce("b.degree", F.lit(0)).alias("graph_degree"), F.when(F.col("b").isNotNull(), F.least(F.lit(25), 5 * F.col("b.degree")) + F.when(F.col("b.degree") > 0, 5).otherwise(0)).otherwise(0).alias("graph_topology"),
    )
    reached = expanded(found.select("id", F.bround(30 * F.col("label")).cast("int").alias("score")), edges).join(nodes.select("id", *KEYS), "id").groupBy(*KEYS).agg(F.max("score").alias("graph_reached"))
    rows = rows.join(reached, KEYS, "left").withColumn("graph_reached", F.coalesce("graph_reached", F.lit(0)))
    total = F.col("graph_label") + F.col("graph_path") + F.col("graph_coverage") + F.col("graph_multi") + F.col("graph_topology") + F.col("graph_reached")
    return rows.filter(total > 0).withColumn("graph_score", intent_adjusted(F.bround(total).cast("int"), F.col("rel_path"), q))


GRAPH_SIGNALS = ("graph_score", "graph_label", "graph_path", "graph_coverage", "graph_matches", "graph_multi", "graph_degree", "graph_topology", "graph_reached")


def expanded(seeds: DataFrame, edges: DataFrame, factors: tuple[float, ...] = (0.35, 0.15)) -> DataFrame:
    """(id, score): what seeds (id, score) carry over one and two undirected hops into other nodes, cut to whole numbers; the best alone.

    Hubs are met on salted copies of the frontier, so a node with a large part of all edges is spread.
    """
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).filter("source <> target").distinct()
    known, front, out = seeds.select("id"), seeds.groupBy("id").agg(F.max("score").alias("score")), None
    for f in factors:
        nxt = salted_join(both, front.withColumnRenamed("id", "source"), ["source"], ["target"]).groupBy("target").agg(F.max("score").alias("base")).select(F.col("target").alias("id"), "base")
        nxt = nxt.join(known, "id", "left_anti")
        one = nxt.select("id", (F.col("base") * f).cast("int").alias("score"))
        out = one if out is None else out.unionByName(one)
        known, front = known.unionByName(nxt.select("id")), nxt.select("id", F.col("base").alias("score"))
    return out.filter("score > 0")


def merged(content: DataFrame, graph: DataFrame) -> DataFrame:
    """Content and graph rows by path, both scores added where both know a file; ``content_on_graph`` tells what the content added."""
    both = content.withColumn("_c", F.lit(1)).withColumnRenamed("score", "_s").join(graph, KEYS, "full_outer")
    score = F.coalesce("_s", F.lit(0)) + F.coalesce("graph_score", F.lit(0))
    out = both.withColumn("score", score.cast("int")).withColumn("content_on_graph", F.when(F.col("graph_score").isNotNull(), F.col("_s")))
    return out.drop("_s", "_c")


def definition_lift(rows: DataFrame, symbols: DataFrame, q: Query) -> DataFrame:
    """``rows`` with a tenth more score for each identifier the query names that the file defines, three at most; ``named_defs`` counts them. ``symbols`` has root_id, rel_path and name."""
    names = sorted(named_identifiers(q.text))
    if not names:
        return rows.withColumn("named_defs", F.lit(0))
    last = F.element_at(F.split("name", r"\."), -1)
    n = symbols.filter(last.isin(*names)).groupBy(*KEYS).agg(F.countDistinct(last).alias("named_defs"))
    out = rows.join(n, KEYS, "left").withColumn("named_defs", F.coalesce("named_defs", F.lit(0)))
    return out.withColumn("score", (F.col("score") * (1 + 0.1 * F.least("named_defs", F.lit(3)))).cast("int"))


def _signal(rows: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in rows.columns else F.lit(0)


def learned_score(rows: DataFrame) -> Column:
    """The fitted score of rows with a ``place``: signals as log(1 + x), derived ones as they are, each to three decimals times its weight."""
    p = F.col("rel_path")
    flag = lambda c: c.cast("double")
    derived = {
        "intent_multiplier": F.least(F.coalesce(F.col("intent_multiplier") if "intent_multiplier" in rows.columns else F.lit(None), F.lit(1.0)), F.lit(2.0)), "log_rank": F.log("place"),
        "has_graph": flag(F.col("graph_score").isNotNull()) if "graph_score" in rows.columns else F.lit(0.0), "has_content": flag(F.col("content_score").isNotNull()) if "content_score" in rows.columns else F.lit(0.0),
        "doc": flag(R.is_doc(p)), "supporting": flag(R.is_supporting(p)), "migration": flag(R.is_migration(p)), "init": flag(p.endswith("__init__.py")), "depth": (F.size(F.split(p, "/")) - 1).cast("double"),
    }
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        source = "score" if name == "final_score" else "size" if name == "file_bytes" else name
        value = derived.get(name, F.log1p(F.greatest(F.lit(0.0), _signal(rows, source).cast("double"))))
        total = total + F.round(value, 3) * weight
    return F.round(total, 3)


def handed_out(pool: DataFrame, order: list[Column]) -> DataFrame:
    """A pool of few rows a root in a new order: the scores it holds are given out again, falling, and ``place`` is the new one."""
    new = pool.withColumn("place", F.row_number().over(Window.partitionBy("root_id").orderBy(*order)))
    scores = pool.select("root_id", "score", "rel_path").withColumn("place", F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("score"), "rel_path"))).select("root_id", "place", F.col("score").alias("_s"))
    return new.join(scores, ["root_id", "place"]).withColumn("score", F.col("_s")).drop("_s")


def reranked(rows: DataFrame) -> DataFrame:
    """The first ``POOL`` rows of each root in the learned order, with their scores handed out again; the rest stays. ``place`` is set for the pool alone."""
    pool = best_of(rows, ["root_id"], [F.desc("score"), F.asc("rel_path")], POOL)
    rest = rows.join(pool.select(*KEYS), KEYS, "left_anti").withColumn("place", F.lit(None).cast("int"))
    pool = pool.withColumn("learned", learned_score(pool))
    return handed_out(pool, [F.desc("learned"), F.asc("place")]).unionByName(rest, allowMissingColumns=True)


def fused(rows: DataFrame, listed: DataFrame, k: int, weight: float, q: Query) -> DataFrame:
    """A ranked list (root_id, rel_path, place) fused into the pool: 1 / (k + place) in the pool and weight / (k + place) in the list, its first ``LISTED`` places.

    A listed file outside the pool joins with the pool's lowest score unless it is a test no one asked for. The pool's scores are handed out in the new order.
    """
    lst = listed.filter(F.col("place") <= LISTED).select(*KEYS, F.col("place").alias("_listed"))
    if not q.tests:
        lst = lst.join(rows.filter("place is not null").select(*KEYS, F.lit(1).alias("_in")), KEYS, "left").filter(F.col("_in").isNotNull() | ~R.is_test(F.col("rel_path"))).drop("_in")
    floor = rows.filter("place is not null").groupBy("root_id").agg(F.min("score").alias("_floor"))
    both = rows.join(lst, KEYS, "full_outer").join(floor, "root_id", "left")
    pool = both.filter(F.col("place").isNotNull() | F.col("_listed").isNotNull())
    pool = pool.withColumn("score", F.coalesce("score", "_floor", F.lit(0)))
    mark = F.coalesce(1 / (k + F.col("place")), F.lit(0.0)) + F.coalesce(F.lit(weight) / (k + F.col("_listed")), F.lit(0.0))
    pool = pool.withColumn("fused", F.round(mark, 9)).drop("_listed", "_floor")
    rest = both.filter(F.col("place").isNull() & F.col("_listed").isNull()).drop("_listed", "_floor")
    return handed_out(pool, [F.desc("fused"), F.asc("rel_path")]).unionByName(rest, allowMissingColumns=True)


def without_excluded(rows: DataFrame, q: Query) -> DataFrame:
    """Rows whose path has a word the query excludes keep a tenth of their score, at least one."""
    if not q.excluded:
        return rows
    hit = F.arrays_overlap(terms_of(F.regexp_replace("rel_path", "[_/-]", " ")), F.array(*map(F.lit, q.excluded)))
    return rows.withColumn("score", F.when(hit & (F.col("score") > 0), F.greatest(F.lit(1), (F.col("score") * 0.1).cast("int"))).otherwise(F.col("score")))


def exact_first(rows: DataFrame, exact: DataFrame) -> DataFrame:
    """The exactly named files of each root lifted together above all others."""
    rows = rows.join(exact.select(*KEYS, F.lit(True).alias("_x")), KEYS, "left")
    lift = rows.groupBy("root_id").agg(F.max(F.when(F.col("_x").isNull(), F.col("score"))).alias("_o"), F.min(F.when(F.col("_x"), F.col("score"))).alias("_e"))
    rows = salted_join(rows, lift, ["root_id"], ["rel_path"])
    up = F.greatest(F.lit(0), F.coalesce("_o", F.lit(0)) + 1 - F.col("_e"))
    return rows.withColumn("exact_lift", F.when(F.col("_x"), up).otherwise(0)).withColumn("score", F.col("score") + F.col("exact_lift")).drop("_x", "_o", "_e")


# ---------------------------------------------------------------- pieces


def kept_terms(pieces: DataFrame, terms: list[str], heavy: set[str], most: int = 48) -> DataFrame:
    """(root_id, term, weight): the ``most`` query terms of most weight times rarity over a root's pieces (column ``body`` of words); terms no piece has are dropped, ties keep the query's order. Terms of code names weigh double."""
    n = pieces.groupBy("root_id").agg(F.count("*").alias("n"), F.array(*[F.sum(F.array_contains("body", t).cast("int")) for t in terms]).alias("df"))
    rows = n.select("root_id", "n", F.posexplode("df").alias("pos", "df")).filter("df > 0")
    name = F.array(*map(F.lit, terms))[F.col("pos")]
    weight = F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.when(name.isin(*sorted(heavy)), 2.0).otherwise(1.0), 6) if heavy else F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6)
    rows = rows.withColumn("term", name).withColumn("weight", weight)
    at = F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("weight"), "pos"))  # as many rows as the query has terms
    return rows.withColumn("_p", at).filter(F.col("_p") <= most).select("root_id", "term", "weight")


def piece_ranks(pieces: DataFrame, terms: list[str], prefix: bool = False) -> DataFrame:
    """(root_id, rel_path, line_start, line_end, name, rank): BM25 of pieces over name (1.4) and body (1.0)."""
    rows = pieces.withColumn("_name", plain_tokens(F.col("name")))
    return bm25(rows, "root_id", {"_name": 1.4, "body": 1.0}, terms, prefix).select(*KEYS, "line_start", "line_end", "name", "rank")


def _first_places(ranks: DataFrame, limit: int) -> DataFrame:
    """(root_id, rel_path, place, best, total, hits) of files by their best of the ``limit`` first pieces; total is the best and a halving tail of eight more."""
    order = [F.desc("rank"), F.asc("rel_path"), F.asc("line_start")]
    top = best_of(ranks, ["root_id"], order, limit, "line_start")
    files = top.groupBy(*KEYS).agg(F.min("place").alias("_f"), F.sort_array(F.collect_list("rank"), asc=False).alias("s"))  # at most ``limit`` ranks
    tail = F.aggregate(F.transform(F.slice("s", 2, 8), lambda x, i: x * F.pow(F.lit(0.5), i + 1)), F.lit(0.0), lambda a, x: a + x)
    place = F.row_number().over(Window.partitionBy("root_id").orderBy("_f"))
    return files.select(*KEYS, place.alias("place"), F.round(F.col("s")[0], 4).alias("best"), F.round(F.col("s")[0] + 0.5 * tail, 4).alias("total"), F.size("s").alias("hits"))


def piece_file_ranking(index: DataFrame, pieces: DataFrame, symbols: DataFrame, q: Query, limit: int = 200) -> DataFrame:
    """(root_id, rel_path, place, score): files by four lists fused with k = 20 - pieces, pieces by code names alone, whole files (double) and files defining a
    named symbol that at most four share - times the path factor; ties by path."""
    terms, names = list(dict.fromkeys(q.terms)), code_names(q.text)
    parts = {w for n in names for w in Query(n).terms}
    if not terms:
        return index.select(*KEYS).limit(0).select(*KEYS, F.lit(0).alias("place"), F.lit(0.0).alias("score"))
    heavy = [t for t in terms if t in parts]
    arrays = {f"_{c}": w for c, w in COLUMNS.items()}
    whole = index.select(*KEYS, *[(body_words(F.col(c)) if c == "body" else plain_tokens(F.col(c))).alias(f"_{c}") for c in COLUMNS])
    lists = [(_first_places(piece_ranks(pieces, terms), limit), 1.0), (best_of(bm25(whole, "root_id", arrays, terms, False).select(*KEYS, "rank"), ["root_id"], [F.desc("rank"), F.asc("rel_path")], 100), 2.0)]
    if heavy:
        lists.append((_first_places(piece_ranks(pieces, heavy), limit), 1.0))
    if names:
        low = symbols.filter(F.lower("name").isin(*sorted({n.lower() for n in names}))).select(*KEYS, F.lower("name").alias("name"))
        rare = low.groupBy("root_id", "name").agg(F.count("*").alias("n")).filter("n <= 4")
        defs = low.join(rare, ["root_id", "name"]).groupBy(*KEYS).agg(F.min("n").alias("n"))
        lists.append((best_of(defs, ["root_id"], [F.asc("n"), F.asc("rel_path")], limit), 1.0))
    all_ = reduce(DataFrame.unionByName, [rows.select(*KEYS, (F.lit(w) / (20 + F.col("place"))).alias("part")) for rows, w in lists])
    sums = all_.groupBy(*KEYS).agg(F.sum("part").alias("s")).select(*KEYS, F.round(F.col("s") * R.path_factor(F.col("rel_path")), 6).alias("score"))
    return best_of(sums, ["root_id"], [F.desc("score"), F.asc("rel_path")], limit)


def best_ranges(ranks: DataFrame, most: int = 2) -> DataFrame:
    """(root_id, rel_path, ranges): of each file the ``most`` best pieces that do not overlap, by start line.

    Only a file's first 64 pieces by rank can be told from each other in the fold; nested pieces beyond that never displace a better one.
    """
    piece = F.struct((-F.col("rank")).alias("r"), F.col("line_start").alias("start"), F.col("line_end").alias("end"), "name")
    rows = ranks.groupBy(*KEYS).agg(F.sort_array(F.collect_list(piece)).alias("p"))  # the matching pieces of one file
    first = rows.withColumn("a", F.col("p")[0])
    rest = F.filter("p", lambda x: (x["start"] > F.col("a.end")) | (x["end"] < F.col("a.start")))
    out = first.withColumn("b", F.get(rest, F.lit(0)))
    both = F.when(F.col("b").isNull() | (F.lit(most) < 2), F.array("a")).otherwise(F.array("a", "b"))
    return out.select(*KEYS, F.array_sort(F.transform(both, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["name"].alias("name")))).alias("ranges"))


def evidence(rows: DataFrame, symbols: DataFrame, pieces: DataFrame, q: Query) -> DataFrame:
    """``rows`` with ``evidence``, the strongest first: defined names (80), words of the file name (60), of the path (40), and the three terms in most pieces (20 and more)."""
    names, terms = sorted(named_identifiers(q.text)), list(dict.fromkeys(q.terms))
    wanted = rows.select(*KEYS)
    last = F.element_at(F.split("name", r"\."), -1)
    defined = symbols.join(wanted, KEYS, "left_semi").filter(last.isin(*names) if names else F.lit(False)).groupBy(*KEYS).agg(F.slice(F.array_sort(F.collect_set(last)), 1, 3).alias("_d"))
    counts = pieces.join(wanted, KEYS, "left_semi").groupBy(*KEYS).agg(F.array(*[F.sum(F.array_contains("body", t).cast("int")) for t in terms] or [F.lit(0)]).alias("_n"))
    out = rows.join(defined, KEYS, "left").join(counts, KEYS, "left")
    name, path = F.lower(F.element_at(F.split("rel_path", "/"), -1)), F.lower("rel_path")
    lits = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    in_name, in_path = F.filter(lits, lambda t: F.contains(name, t)), F.filter(lits, lambda t: F.contains(path, t) & ~F.contains(name, t))
    quoted = lambda a: F.array_join(F.transform(a, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    item = lambda ok, strength, text: F.when(ok, F.struct((-strength).alias("s"), text.alias("t")))
    best = F.slice(F.array_sort(F.filter(F.zip_with("_n", lits, lambda n, t: F.struct((-n).alias("n"), t.alias("t"))), lambda z: z["n"] < 0)), 1, 3)
    top = F.transform(F.coalesce(best, F.array().cast("array<struct<n:bigint,t:string>>")), lambda z: F.struct((-(20 + F.least(-z["n"], F.lit(10)))).cast("int").alias("s"), F.concat(F.lit('"'), z["t"], F.lit('" in '), (-z["n"]).cast("string"), F.when(z["n"] == -1, " place").otherwise(" places")).alias("t")))
    own = F.array(
        item(F.size("_d") > 0, F.lit(80), F.concat(F.lit("defines "), F.array_join(F.transform("_d", lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", "))),
        item(F.size(in_name) > 0, F.lit(60), F.concat(F.lit("file name has "), quoted(in_name))), item(F.size(in_path) > 0, F.lit(40), F.concat(F.lit("path has "), quoted(in_path))),
    )
    return out.withColumn("evidence", F.transform(F.array_sort(F.concat(F.array_compact(own), top)), lambda z: z["t"])).drop("_d", "_n")


def page(rows: DataFrame, limit: int, offset: int = 0, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """The page of each root after all ranking: filters by language and path glob first, then ``limit`` rows from ``offset`` on, with their ``place`` among those left."""
    from codelode.functions.text import admits, extension

    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    kept = rows.filter(admits(F.col("rel_path"), include or [], exclude or []))
    if languages:
        kept = kept.filter(extension(F.col("rel_path")).isin(*languages))
    first = best_of(kept.drop("place"), ["root_id"], [F.desc("score"), F.asc("rel_path")], offset + limit)
    return first.filter(F.col("place") > offset)


def find(index: DataFrame, symbols: DataFrame, pieces: DataFrame, text: str, limit: int = 10, nodes: DataFrame | None = None, edges: DataFrame | None = None, signals: DataFrame | None = None,
         semantic: DataFrame | None = None, **scope) -> DataFrame:
    """(root_id, rel_path, place, score, evidence, ranges): the ranked lookup of each root.

    In order: content scores; graph scores added where ``nodes`` and ``edges`` are given; lift of defined names; learned order of the first 50; keyword list fused in for
    long queries; past feedback (``signals``); hashed similarity (``semantic`` rows with a score); exclusions; exact names; then filters and the page. Ranks are made before filters, so a filter never changes them.
    """
    from codelode.operators import feedback
    from codelode.operators.ranking import merge_semantic

    q = Query(text)
    rows = content_scores(index, q)
    if nodes is not None and edges is not None:
        rows = merged(rows, graph_scores(nodes, edges, q))
    rows = reranked(cut(definition_lift(rows, symbols, q)))  # the pool is read for its order, its scores and the rest
    if q.fuses:
        rows = fused(cut(rows), piece_file_ranking(index, pieces, symbols, q), 5, 0.75, q)
    rows = cut(rows.select(*KEYS, "score"))
    if signals is not None:
        rows = feedback.apply(rows, signals, KEYS)
    if semantic is not None:
        rows = merge_semantic(rows, semantic, KEYS)
    exact = exact_paths(index, q)
    rows = exact_first(without_excluded(rows, q), exact if q.tests else exact.filter(~R.is_test(F.col("rel_path"))))
    out = cut(page(rows.select(*KEYS, "score"), limit, **scope))
    ranges = best_ranges(piece_ranks(pieces.join(out.select(*KEYS), KEYS, "left_semi"), q.terms, True)) if q.terms else None
    out = evidence(out, symbols, pieces, q)
    return out.join(ranges, KEYS, "left") if ranges is not None else out.withColumn("ranges", F.lit(None))

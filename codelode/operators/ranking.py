"""Ranked retrieval: BM25 over an inverted index, rank fusion, score merges and total-order cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions.text import dimension, hashed_words

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, term, tf): how often each term stands in each text. Null texts have none."""
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, key: str, query: list[str]) -> DataFrame:
    """(key, score) of the texts with at least one query term, by BM25.

    ``index`` is a ``postings`` table. The query is a handful of literals, so
    the index is filtered before any shuffle; lengths are sums over the index.
    """
    lens = index.groupBy(key).agg(F.sum("tf").alias("len"))
    total = lens.agg(F.count("*").alias("docs"), F.avg("len").alias("mean")).first()  # two numbers
    docs, mean = total.docs, total.mean or 1.0
    hits = index.filter(F.col("term").isin(*query))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    rows = hits.join(F.broadcast(df), "term").join(lens, key)  # df has one row for each query term
    return rows.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def top(rows: DataFrame, score: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows by falling score; ties by key, so the cut is the same in any order of input."""
    return rows.orderBy(F.desc(score), key).offset(offset).limit(limit)


def ranked(rows: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    """``top`` with its ``place`` from one on; only ``limit`` rows reach the single window."""
    return top(rows, score, key, limit).withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(lists: list[tuple[DataFrame, float]], key: str, k: int) -> DataFrame:
    """(key, score): reciprocal rank fusion of lists with a ``place``; a list's part is weight / (k + place)."""
    parts = None
    for rows, weight in lists:
        one = rows.select(key, (F.lit(weight) / (k + F.col("place"))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(key).agg(F.round(F.sum("part"), 6).alias("score"))


def merge_semantic(base: DataFrame, semantic: DataFrame, keys: list[str] | str) -> DataFrame:
    """(keys, score) with whole scores: a full outer merge. A known row gains 0.35 of its semantic score, cut to a whole number, at least 8 and at most 35;
    a new one enters with its semantic score, at most 80."""
    keys = [keys] if isinstance(keys, str) else keys
    gain = F.greatest(F.lit(8), F.least(F.lit(35), (F.col("sem") * 0.35).cast("int")))
    both = base.select(*keys, F.col("score").alias("base")).join(semantic.select(*keys, F.col("score").alias("sem")), keys, "full_outer")
    score = F.when(F.col("sem").isNull(), F.col("base")).when(F.col("base").isNull(), F.least(F.lit(80), F.col("sem"))).otherwise(F.col("base") + gain)
    return both.select(*keys, score.cast("int").alias("score"))


def semantic_scores(chunks: DataFrame, text: str) -> DataFrame:
    """(root_id, rel_path, score): files by the summed similarity of their chunks to a query, in whole hundredths for each chunk.

    ``chunks`` has chunk_id, root_id, rel_path, chunk_text_preview and vector_json (broken ones count as empty). A chunk without similarity counts 3 for each query term its preview
    has, at most 12. The query's vector has at most 256 entries and is a literal, so no chunk is joined to anything.
    """
    import hashlib
    import math
    import re

    from codelode.functions.query import Query

    q, counts = Query(text), {}
    for run in re.findall("[a-z0-9]+", text.lower()):
        for w in (run, *(x for x in re.findall("[a-z]+|[0-9]+", run) if x != run)):
            d = hashlib.sha256(w.encode()).digest()[3]
            counts[d] = counts.get(d, 0) + 1
    norm = math.sqrt(sum(v * v for v in counts.values())) or 1.0
    rows = chunks.filter("root_id is not null and rel_path is not null").select("chunk_id", "root_id", "rel_path", "chunk_text_preview", "vector_json").dropDuplicates(["chunk_id"])
    v = F.from_json("vector_json", "map<string,double>")
    sim = F.lit(0.0)
    for d, n in sorted(counts.items()):
        sim = sim + F.coalesce(v[str(d)], F.lit(0.0)) * round(n / norm, 6)
    words = hashed_words(F.coalesce("chunk_text_preview", F.lit("")))
    seen = F.size(F.array_intersect(F.array(*map(F.lit, sorted(set(q.terms)))) if q.terms else F.array().cast("array<string>"), words))
    score = F.when(sim > 0, F.bround(sim * 100)).otherwise(F.least(F.lit(12), 3 * seen)).cast("int")
    return rows.select("root_id", "rel_path", score.alias("score")).filter("score > 0").groupBy("root_id", "rel_path").agg(F.sum("score").cast("int").alias("score"))


def over_share(rows: DataFrame, score: str, share: float = 0.1) -> DataFrame:
    """Rows whose score is at least a share of the largest."""
    best = rows.agg(F.max(score)).first()[0]  # one number
    return rows.filter(F.col(score) >= F.lit(share * (best or 0.0)))


def term_weights(index: DataFrame, key: str) -> DataFrame:
    """(term, df, weight): 1 + ln((N + 1) / (df + 1)) over all texts."""
    n = index.select(key).distinct().count()
    df = index.groupBy("term").agg(F.countDistinct(key).alias("df"))
    return df.select("term", "df", F.round(1 + F.log((F.lit(n) + 1) / (F.col("df") + 1)), 6).alias("weight"))


def term_vectors(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, dim, weight): hashed word counts of each text, of unit length, six decimals. Texts without words have no rows."""
    counts = rows.select(key, F.explode(hashed_words(text)).alias("_w")).select(key, dimension(F.col("_w")).alias("dim")).groupBy(key, "dim").agg(F.count("*").alias("_n"))
    norm = F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(Window.partitionBy(key)))  # at most 256 rows a key
    return counts.select(key, "dim", F.round(F.col("_n") / norm, 6).alias("weight"))


def cosine(a: DataFrame, b: DataFrame, key_a: str, key_b: str, few: int = 64) -> DataFrame:
    """(key_a, key_b, similarity) of the pairs of sparse unit vectors with a common dimension, where ``b`` holds at most ``few`` vectors.

    The few are gathered by dimension into 256 rows, so ``a`` meets a table of fixed size; more than ``few`` are refused.
    """
    if b.select(key_b).distinct().limit(few + 1).count() > few:
        raise ValueError(f"the second side holds more than {few} vectors")
    own = b.groupBy("dim").agg(F.collect_list(F.struct(F.col(key_b), F.col("weight").alias("_w"))).alias("_v"))  # at most ``few`` entries in each of 256 rows
    pairs = a.join(F.broadcast(own), "dim").select(key_a, "weight", F.explode("_v").alias("_x"))
    return pairs.groupBy(key_a, F.col(f"_x.{key_b}").alias(key_b)).agg(F.round(F.sum(F.col("weight") * F.col("_x._w")), 6).alias("similarity"))

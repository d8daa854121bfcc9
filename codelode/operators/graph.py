"""Graph tables: canonical edges, bounded searches, label propagation, hubs.

Searches keep one frontier table a hop and cut its lineage with a checkpoint,
so plans stay short whatever the depth; nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.joins import salted_join
from codelode.session import cut


def canonical_edges(edges: DataFrame) -> DataFrame:
    """One row for each (source, target, relation): ``EXTRACTED`` beats ``INFERRED``. Edges with a null end are dropped."""
    kept = edges.filter(F.col("source").isNotNull() & F.col("target").isNotNull())
    return kept.groupBy("source", "target", "relation").agg(F.min("confidence").alias("confidence"))


def conflicting_ids(edges: DataFrame, key: str = "edge_id") -> DataFrame:
    """Ids that stand for different edges; equal repeats are no conflict."""
    rest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in edges.columns if c != key]), {"ignoreNullFields": "false"}), 256)
    return edges.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(rest).alias("a"), F.max(rest).alias("b")).filter("a <> b").select(key)


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes (column ``id``)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def reach(edges: DataFrame, start: DataFrame, depth: int, undirected: bool = False) -> DataFrame:
    """(id, hops): nodes within ``depth`` hops of ``start`` (column ``id``), with the fewest hops.

    Each hop joins the last frontier alone with the edges and drops what is
    known, so the work of a hop is that of its new nodes' edges.
    """
    steps = edges.select("source", "target")
    if undirected:
        steps = steps.unionByName(steps.select(F.col("target").alias("source"), F.col("source").alias("target")))
    steps = cut(steps.distinct())
    seen = cut(start.select("id").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        # a hub's many edges meet copies of its one frontier row
        nxt = salted_join(steps, frontier.select(F.col("id").alias("source")), ["source"], ["target"]).select(F.col("target").alias("id")).distinct()
        frontier = cut(nxt.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # a union of at most ``depth`` written tables
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str, depth: int = 6) -> DataFrame:
    """(step, id): a shortest undirected path, of equal ones that with the smallest ids from the goal back; empty if there is none."""
    spark = edges.sparkSession
    near = reach(edges, spark.createDataFrame([(start,)], "id string"), depth, undirected=True)
    found = near.filter(F.col("id") == goal).select("hops").collect()  # at most one row
    schema = "step int, id string"
    if not found:
        return spark.createDataFrame([], schema)
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    path, at = [(found[0].hops, goal)], goal
    for hop in range(found[0].hops - 1, -1, -1):  # one row comes back for each of at most ``depth`` hops
        at = both.filter(F.col("target") == at).join(near.filter(F.col("hops") == hop), F.col("source") == F.col("id")).agg(F.min("id").alias("id")).first().id
        path.append((hop, at))
    return spark.createDataFrame(sorted(path), schema)


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, community) by synchronous label propagation over undirected edges, at most ``rounds`` rounds; communities are whole numbers from zero in the order of their smallest label.

    A node counts its own label; of equally frequent labels the smallest wins. Labels
    are counted before they are compared, so a hub's neighbours never meet in one group.
    """
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).filter("source <> target").distinct()
    both = cut(both)
    labels = cut(nodes.select("id").distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = salted_join(both, labels.select(F.col("id").alias("target"), "label"), ["target"], ["source"]).select(F.col("source").alias("id"), "label").unionByName(labels.select("id", "label"))
        counts = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
        new = cut(counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("id", F.col("b.label").alias("label")).join(labels.select("id"), "id", "left_semi"))
        changed = new.alias("n").join(labels.alias("o"), "id").filter("n.label <> o.label").limit(1).count()
        labels = new
        if not changed:
            break
    names = labels.select("label").distinct()
    numbers = names.rdd.map(lambda r: r.label).sortBy(lambda x: x).zipWithIndex().toDF("label string, community bigint") if not names.isEmpty() else names.withColumn("community", F.lit(0).cast("bigint"))  # numbers in order without one task for all
    return salted_join(labels, numbers, ["label"], ["id"]).select("id", "community")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over both ends of all edges."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(community, id, degree): the node of highest degree of each community, ties by id."""
    d = groups.join(degrees(edges), "id")
    best = F.min(F.struct((-F.col("degree")).alias("d"), "id")).alias("b")
    return d.groupBy("community").agg(best).select("community", F.col("b.id").alias("id"), (-F.col("b.d")).alias("degree"))

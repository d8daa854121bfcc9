"""Plans as tables of nodes: (id, parent, pos, text). Ids come from the parent and the place, so the same plan has the same ids everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.text import stable_id
from codelode.session import cut

SCHEMA = "id string, parent string, pos int, text string"
#: Levels a plan may have.
DEPTH = 64


def normal_text(text: str) -> str:
    """Line ends as one sign, composed letters, no white space at the ends."""
    import unicodedata

    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


def create(spark: SparkSession, name: str, text: str) -> DataFrame:
    """A plan of one node."""
    import hashlib

    root = hashlib.sha256(f"plan::{normal_text(name)}::root".encode()).hexdigest()[:24]
    return spark.createDataFrame([(root, None, 0, normal_text(text))], SCHEMA)


def split(plan: DataFrame, node: str, children: list[str]) -> DataFrame:
    """The plan with children, in order, under a leaf; a node that has some or does not exist is refused."""
    if not children:
        raise ValueError("a split needs children")
    if plan.filter(F.col("id") == node).isEmpty():
        raise ValueError("no such node")
    if not plan.filter(F.col("parent") == node).isEmpty():
        raise ValueError("the node is no leaf")
    texts = F.array(*[F.lit(normal_text(c)) for c in children])
    new = plan.filter(F.col("id") == node).select(F.col("id").alias("parent"), F.posexplode(texts).alias("pos", "text"))
    return plan.unionByName(new.select(stable_id(F.col("parent"), F.lit("child"), F.col("pos").cast("string"), F.col("text")).alias("id"), "parent", F.col("pos").cast("int").alias("pos"), "text"))


def reached(plan: DataFrame) -> DataFrame:
    """(id, level, path): the nodes below the root with their level and the places on the way, zero-filled, so that their order is that of a walk."""
    front = plan.filter("parent is null").select("id", F.lit(0).alias("level"), F.lit("").alias("path"))
    out, kids = front, cut(plan.filter("parent is not null").select("id", "parent", "pos"))
    for level in range(1, DEPTH + 1):
        front = cut(kids.join(front.select(F.col("id").alias("parent"), F.col("path").alias("_p")), "parent").select("id", F.lit(level).alias("level"), F.concat("_p", F.lpad(F.col("pos").cast("string"), 6, "0")).alias("path")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def errors(plan: DataFrame) -> DataFrame:
    """(code, id): what is wrong with a plan: no root or several, repeated ids, parents that do not exist, doubled places, empty texts, and nodes the root does not reach."""
    e = lambda rows, code, col="id": rows.select(F.lit(code).alias("code"), F.col(col).alias("id"))
    roots = plan.filter("parent is null")
    n = roots.agg(F.count("*").alias("n"), F.min("id").alias("id"))
    out = e(n.filter("n = 0"), "no_root").unionByName(e(n.filter("n > 1"), "several_roots"))
    out = out.unionByName(e(plan.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "repeated_id"))
    out = out.unionByName(e(plan.filter("parent is not null").join(plan.select(F.col("id").alias("parent")).distinct(), "parent", "left_anti"), "orphan"))
    out = out.unionByName(e(plan.filter("parent is not null").groupBy("parent", "pos").agg(F.count("*").alias("n")).filter("n > 1"), "doubled_place", "parent"))
    out = out.unionByName(e(plan.filter("text is null or trim(text) = ''"), "empty_text"))
    return out.unionByName(e(plan.join(reached(plan).select("id").distinct(), "id", "left_anti"), "not_reached")).distinct()


def rendered(plan: DataFrame) -> DataFrame:
    """(place, line): the plan as an indented list, in the order of a walk."""
    rows = reached(plan).join(plan.select("id", "text"), "id")
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), "text")
    return rows.select("path", line.alias("line")).orderBy("path").select("line")


def digest(plan: DataFrame) -> str:
    """A digest of the plan that no order of rows changes."""
    h = F.sha2(F.to_json(F.struct("id", "parent", "pos", "text"), {"ignoreNullFields": "false"}), 256)
    return plan.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(h)), ""), 256)).first()[0]  # the nodes of one plan

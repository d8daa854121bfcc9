"""Problem 9: a selection of documents whose tokens per source approach target shares.

Weights go down a tree of domains, languages and sources. A node gets no more than
its leaves can give with all their repeats; what one child cannot give goes to
its siblings before it goes to relatives of their parent. Each leaf then takes whole
seeded epochs of its documents and a token prefix of one more.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.llm.tokens import VOCABULARY, token_count
from codelode.session import cut

#: Languages with a branch of their own; all others share one.
LANGUAGES = ("en", "de", "fr", "es", "ja")
SEED = 20
#: Ranges of the seeded order whose sums tell where a prefix ends.
RANGES = 4096


def share_out(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Splits a budget over (weight, capacity) children by weight; what passes a child's capacity goes to the others by theirs."""
    got, open_ = [0.0] * len(children), {i for i, (w, c) in enumerate(children) if w > 0 and c > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if got[i] + left * children[i][0] / total >= children[i][1] - 1e-9]
        if not full:
            for i in open_:
                got[i] += left * children[i][0] / total
            return got
        for i in full:
            left -= children[i][1] - got[i]
            got[i] = children[i][1]
        open_ -= set(full)
    return got


def plan(leaves: dict[tuple[str, str, str], tuple[float, float]], total: float) -> dict[tuple[str, str, str], float]:
    """Tokens for each (domain, language, source) leaf of (weight, capacity)."""

    def down(level: int, keys: list[tuple], budget: float) -> dict:
        if level == 3:
            return {keys[0]: budget}
        parts: dict[str, list] = defaultdict(list)
        for k in sorted(keys):
            parts[k[level]].append(k)
        sums = [(sum(leaves[k][0] for k in ks), sum(leaves[k][1] for k in ks)) for ks in parts.values()]
        out: dict = {}
        for ks, b in zip(parts.values(), share_out(budget, sums)):
            out |= down(level + 1, ks, b)
        return out

    return down(0, list(leaves), total) if leaves else {}


def _order(epoch: int):
    """The place of a document in an epoch's seeded order."""
    return F.xxhash64(F.lit(SEED), F.lit(epoch), F.col("doc_id"))


class Mix:
    """The mix of ``documents`` to ``targets`` (source, target_share, max_repeats).

    ``total`` is the number of tokens wanted, by default as many as the targeted
    sources hold once. Source names count without case and outer white space.
    Documents without a doc_id, tokens or targeted source are never taken; a doc_id that repeats
    counts with each of its rows. Targets without a share are ignored. ``domains`` gives the domain of each source, the
    tree's top; sources it lacks share one of their own.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, domains: dict[str, str] | None = None):
        spark = documents.sparkSession
        source = F.lower(F.trim("source"))
        self.targets = {}
        for r in targets.filter("source is not null and target_share > 0").toLocalIterator():
            self.targets[r.source.strip().lower()] = (float(r.target_share), int(r.max_repeats if r.max_repeats is not None else 1))
        lang = F.lower(F.trim("lang"))
        wanted = documents.filter(F.col("doc_id").isNotNull() & source.isin(*self.targets)) if self.targets else documents.limit(0)
        self.docs = cut(
            wanted.select("doc_id", source.alias("source"), F.when(lang.isin(*LANGUAGES), lang).otherwise("und").alias("lang"), token_count(F.col("text"), vocabulary).alias("tokens")).filter("tokens > 0")
        )
        # at most (targeted sources) x (languages) rows
        self.held = {(r.source, r.lang): (r.tokens, r.docs) for r in self.docs.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
        per_source: dict[str, int] = defaultdict(int)
        for (s, _), (t, _) in self.held.items():
            per_source[s] += t
        leaves = {}
        for s, (share, repeats) in self.targets.items():
            langs = [lg for x, lg in self.held if x == s] or ["und"]
            for lg in langs:
                have = self.held.get((s, lg), (0, 0))[0]
                part = have / per_source[s] if per_source[s] else 1.0
                leaves[(domains or {}).get(s, "other"), lg, s] = (share * part, float(have * repeats))
        self.total = float(total if total is not None else sum(per_source.values()))
        self.budget = {(s, lg): b for (_, lg, s), b in plan(leaves, self.total).items()}
        rows = []
        for (s, lg), b in self.budget.items():
            have = self.held.get((s, lg), (0, 0))[0]
            if not have:
                continue
            repeats = self.targets[s][1]
            whole = min(int((b + 0.5) // have), repeats)
            rows.append((s, lg, whole, int(b - whole * have + 0.5) if whole < repeats else 0))
        self.leaves = spark.createDataFrame(rows, "source string, lang string, epochs int, rest bigint")

    def selection(self) -> DataFrame:
        """(doc_id, source, lang, tokens, copies): each document taken and how often."""
        docs = self.docs.join(F.broadcast(self.leaves), ["source", "lang"])  # the leaves are as few as sources times languages
        most = max((r for _, r in self.targets.values()), default=0)
        order = F.lit(0).cast("bigint")
        for e in range(most + 1):
            order = F.when(F.col("epochs") == e, _order(e)).otherwise(order)
        docs = docs.withColumn("_at", order).withColumn("_range", F.shiftrightunsigned(F.col("_at").bitwiseXOR(F.lit(-(2**63))), 64 - (RANGES - 1).bit_length()))
        leaf = Window.partitionBy("source", "lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sums = docs.filter("rest > 0").groupBy("source", "lang", "rest", "_range").agg(F.sum("tokens").alias("t"))
        ends = sums.withColumn("base", F.coalesce(F.sum("t").over(leaf), F.lit(0))).filter((F.col("base") <= F.col("rest")) & (F.col("base") + F.col("t") > F.col("rest")))
        ends = ends.groupBy("source", "lang").agg(F.min(F.struct("_range", "base")).alias("end")).select("source", "lang", F.col("end._range").alias("_end"), F.col("end.base").alias("_base"))
        docs = docs.join(F.broadcast(ends), ["source", "lang"], "left")  # one row for each leaf
        inside = Window.partitionBy("source", "lang").orderBy("_at", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
        last = docs.filter(F.col("_range") == F.col("_end"))  # one of RANGES ranges of each leaf
        last = last.withColumn("_more", (F.sum("tokens").over(inside) + F.col("_base") <= F.col("rest")).cast("int"))
        other = docs.filter((F.col("_end").isNull()) | (F.col("_range") != F.col("_end")))
        other = other.withColumn("_more", F.when((F.col("rest") > 0) & (F.col("_end").isNull() | (F.col("_range") < F.col("_end"))), 1).otherwise(0))
        both = other.unionByName(last)
        return both.select("doc_id", "source", "lang", "tokens", (F.col("epochs") + F.col("_more")).alias("copies")).filter("copies > 0")

    def shares(self) -> DataFrame:
        """(source, target_share, max_repeats, held_tokens, planned_tokens, tokens, share): what was wanted and what was reached."""
        spark = self.docs.sparkSession
        got = self.selection().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
        rows = []
        for s, (share, repeats) in self.targets.items():
            rows.append((s, share, repeats, sum(t for (x, _), (t, _) in self.held.items() if x == s), int(round(sum(b for (x, _), b in self.budget.items() if x == s)))))
        wanted = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, held_tokens bigint, planned_tokens bigint")
        all_ = Window.partitionBy()
        out = wanted.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        return out.withColumn("share", F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(all_), F.lit(1)), 6))

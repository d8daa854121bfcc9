"""Log-based change capture: process only what is new or changed since the last good run.

A delivery log is a table whose rows carry a partition (here the root), a key
(the commit) and an offset that only grows (the delivery number). State is one
offset for each partition. A run first writes a *batch plan* - for each
partition the offsets ``(low, high]`` it will read - and only then works; a run
that finds an unfinished plan replays exactly that plan. A key of the batch counts
only if it is new or its newest row differs from its newest processed one, so an unchanged
redelivery is no work. The sink is written
under the plan's number and read back with one row for each key, the one with
the largest offset, so neither a replay nor a repeated delivery shows twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators.joins import salted_join


def last_good_runs(generations: DataFrame, history: DataFrame) -> DataFrame:
    """The newest finished run of each root: (root_id, generation_id, head).

    A run is good if its generation has a checksum and its history entry has a
    head and no reason for being unavailable. Repeated rows count once; of
    equal times the larger generation_id wins, of several entries of one
    generation the one recorded last. Rows without root or generation, and
    generations without a time, are no runs.
    """
    done = (
        generations.filter(F.col("semantic_checksum").isNotNull() & F.col("created_at").isNotNull())
        .select("root_id", "generation_id", "created_at")
    )
    read = history.filter(F.col("head").isNotNull() & F.col("unavailable").isNull()).select(
        "root_id", "generation_id", "head", "recorded_at"
    )
    best = F.max(F.struct("created_at", "generation_id", "recorded_at", "head")).alias("best")
    return (
        done.join(read, ["root_id", "generation_id"])
        .groupBy("root_id").agg(best)
        .select("root_id", "best.generation_id", "best.head")
    )


def with_offsets(log: DataFrame, state: DataFrame, partition: str, key: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """``log`` with its partition's columns of ``state`` (all but the partition, or ``columns``; null if it has none).

    The state has one row for each partition; a partition with a third of all rows is spread over many tasks.
    """
    kept = state.select(partition, *(columns or [c for c in state.columns if c != partition]))
    return salted_join(log, kept, [partition], [key], "left")


def head_offsets(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The smallest offset of each run's head: (root_id, done_to). A head that
    the log does not hold for that root gives no row: nothing is processed."""
    heads = runs.select("root_id", F.col("head").alias("sha"))
    first = log.filter(F.col("id").isNotNull()).groupBy("root_id", "sha").agg(F.min("id").alias("done_to"))
    return heads.join(first, ["root_id", "sha"]).groupBy("root_id").agg(F.min("done_to").alias("done_to"))


@dataclass
class ChangeFeed:
    """Runs over a delivery log with exactly-once results under ``folder``.

    ``folder`` holds ``plan/<n>`` (the write-ahead batch plans: every partition's low, high
    and number of rows up to high), ``sink/<n>`` (what batch n wrote), ``done/<n>`` (batch n
    is finished) and ``base/<n>`` (the sinks up to n, compacted). Each is a
    table written by Spark, whole only with its ``_SUCCESS`` file; anything
    less is written anew. The log keeps its rows, as processed ones are compared with. One run at a time may work on a folder. ``fields`` are the columns whose
    change makes a key count again; empty means all others.
    """

    spark: SparkSession
    folder: str
    partition: str
    key: str
    offset: str
    fields: tuple[str, ...] = ()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _whole(self, kind: str) -> list[int]:
        """The numbers of the whole tables of a kind; after ``compact`` there are few."""
        fs, p = self._fs(f"{self.folder}/{kind}")
        if not fs.exists(p):
            return []
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n) for n in names if fs.exists(jvm(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def _drop(self, kind: str, n: int) -> None:
        fs, p = self._fs(f"{self.folder}/{kind}/{n}")
        fs.delete(p, True)

    def _schema(self, log: DataFrame) -> str:
        return f"{self.partition} {log.schema[self.partition].dataType.simpleString()}, done_to bigint, done_rows bigint"

    def state(self, log: DataFrame, seed: DataFrame | None = None) -> DataFrame:
        """(partition, done_to, done_rows): the offset each partition has been processed to, from the last finished plan;
        before the first one from ``seed`` (partition, done_to), which may lack partitions."""
        done = self._whole("done")
        if done:
            plan = self.spark.read.parquet(f"{self.folder}/plan/{done[-1]}")
            return plan.select(self.partition, F.col("high").alias("done_to"), F.col("rows").alias("done_rows"))
        if seed is not None:
            return seed.select(self.partition, "done_to", F.lit(None).cast("bigint").alias("done_rows"))
        return self.spark.createDataFrame([], self._schema(log))

    def plan(self, log: DataFrame, seed: DataFrame | None = None) -> int | None:
        """The batch to work on: the unfinished one if there is one, else a new
        one written now, else None (nothing new).

        Offsets must only grow. A partition with more rows up to its processed offset than when that was
        processed has late rows, which no range would ever hold; the run then stops with an error.
        """
        plans, done = self._whole("plan"), set(self._whole("done"))
        for n in plans:
            if n not in done:
                return n
        n = max(plans, default=-1) + 1
        placed = log.filter(F.col(self.partition).isNotNull() & F.col(self.offset).isNotNull())
        counted = with_offsets(placed.select(self.partition, self.key, self.offset), self.state(log, seed), self.partition, self.key)
        ends = counted.groupBy(self.partition).agg(
            F.max("done_to").alias("low"), F.max(self.offset).cast("bigint").alias("end"), F.count("*").alias("rows"),
            F.count(F.when(F.col(self.offset) <= F.col("done_to"), 1)).alias("again"), F.max("done_rows").alias("done_rows"),
        )
        high = F.greatest(F.coalesce("end", "low"), F.coalesce("low", "end"))
        ends.select(self.partition, "low", high.alias("high"), "rows", (F.col("again") > F.col("done_rows")).alias("late"), (F.col("low").isNull() | (F.col("end") > F.col("low"))).alias("fresh")).write.mode("overwrite").parquet(f"{self.folder}/plan/{n}")
        got = self.spark.read.parquet(f"{self.folder}/plan/{n}").agg(F.max(F.col("fresh").cast("int")).alias("fresh"), F.min(F.when(F.col("late"), F.col(self.partition))).alias("late")).first()  # one row
        if got.late is not None or not got.fresh:
            self._drop("plan", n)
        if got.late is not None:
            raise RuntimeError(f"late rows at or before the processed offset, first in partition {got.late!r}")
        return n if got.fresh else None

    def batch(self, log: DataFrame, n: int) -> DataFrame:
        """The rows of batch n: of each key whose newest row up to the planned end is new or differs from its newest
        processed one that row. Of rows with one offset the greatest by value stands for all."""
        plan = self.spark.read.parquet(f"{self.folder}/plan/{n}").select(self.partition, F.col("low").alias("done_to"), "high")
        rows = log.filter(F.col(self.partition).isNotNull() & F.col(self.key).isNotNull() & F.col(self.offset).isNotNull())
        others = [c for c in log.columns if c not in (self.partition, self.key, self.offset)]
        fields = [c for c in (self.fields or others)]
        row = F.struct(F.col(self.offset).alias("offset"), F.struct(*fields).alias("value") if fields else F.lit(0).alias("value"), F.struct(*others).alias("rest") if others else F.lit(0).alias("rest"))
        newest = (
            with_offsets(rows, plan, self.partition, self.key, ("done_to", "high")).filter(F.col(self.offset) <= F.col("high"))
            .groupBy(self.partition, self.key).agg(F.max(row).alias("last"), F.max(F.when(F.col(self.offset) <= F.col("done_to"), row)).alias("seen"))
        )
        kept = newest.filter(F.col("seen").isNull() | ~F.col("last.value").eqNullSafe(F.col("seen.value")))
        return kept.select(self.partition, self.key, F.col("last.offset").alias(self.offset), *([F.col(f"last.rest.{c}").alias(c) for c in others]))

    def run(self, log: DataFrame, work=None, fail_after: str | None = None, seed: DataFrame | None = None) -> int | None:
        """One run: plan, work, sink, mark. ``work`` maps the batch's rows to
        what is stored and must keep partition, key and offset. ``fail_after``
        (``plan`` or ``sink``) breaks the run off there, for tests. ``seed`` is the state before the first run."""
        n = self.plan(log, seed)
        if n is None:
            return None
        if fail_after == "plan":
            raise RuntimeError("broken off after the plan")
        rows = self.batch(log, n)
        (work(rows) if work else rows).write.mode("overwrite").parquet(f"{self.folder}/sink/{n}")
        if fail_after == "sink":
            raise RuntimeError("broken off after the sink")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/done/{n}")
        return n

    def _tables(self) -> list[str]:
        base = self._whole("base")
        newest = base[-1] if base else -1
        return [f"{self.folder}/base/{b}" for b in base[-1:]] + [f"{self.folder}/sink/{k}" for k in self._whole("sink") if k > newest]

    def result(self) -> DataFrame | None:
        """What the sink holds: one row for each key, that with the largest offset; None if no run has written."""
        tables = self._tables()
        if not tables:
            return None
        rows = self.spark.read.parquet(*tables)
        others = [c for c in rows.columns if c not in (self.partition, self.key, self.offset)]
        return (
            rows.groupBy(self.partition, self.key)
            .agg(F.max(F.struct(self.offset, *others)).alias("_row"))
            .select(self.partition, self.key, "_row.*")
        )

    def compact(self) -> int | None:
        """Merges the finished batches into one table and drops their folders, so that a run lists few; the number of the last one.

        The merged table is whole before anything is dropped, and readers skip the sinks it holds, so a
        failure in between leaves the same result. The last plan stays, it is the state.
        """
        done = self._whole("done")
        if not done:
            return None
        n, old = done[-1], self._whole("base")
        if n not in old:
            self.result().write.mode("overwrite").parquet(f"{self.folder}/base/{n}")
        for k in self._whole("sink"):
            if k <= n:
                self._drop("sink", k)
        for k in old:
            if k < n:
                self._drop("base", k)
        for k in done[:-1]:
            self._drop("plan", k)
            self._drop("done", k)
        return n


def commit_feed(commits: DataFrame, generations: DataFrame, history: DataFrame, folder: str) -> ChangeFeed:
    """A feed under ``folder`` that has made the one run due after each root's last good run; its sink holds the commits to process.

    A sha counts if it has no processed row or its newest row differs from its newest processed one in date, subject or body.
    Rows without root, sha or id cannot be placed in the log and are left out.
    """
    feed = ChangeFeed(commits.sparkSession, folder, "root_id", "sha", "id", ("commit_date", "subject", "body"))
    feed.run(commits.select("root_id", "sha", "id", "commit_date", "subject", "body"), seed=head_offsets(commits, last_good_runs(generations, history)))
    return feed


def pending_commits(commits: DataFrame, generations: DataFrame, history: DataFrame, folder: str) -> DataFrame:
    """(root_id, sha, id): what the sink of ``commit_feed``'s run holds."""
    done = commit_feed(commits, generations, history, folder).result()
    return done.select("root_id", "sha", "id") if done is not None else commits.select("root_id", "sha", "id").limit(0)


def next_state(commits: DataFrame, generations: DataFrame, history: DataFrame, folder: str) -> DataFrame:
    """The state after that run: (root_id, done_to, next_to, head, pending), from its plan and sink.

    ``next_to`` is the largest id of the root and ``head`` its sha; ``pending``
    counts the commits the run took. Every root with a placed commit has a row.
    """
    feed = commit_feed(commits, generations, history, folder)
    placed = commits.filter(F.col("root_id").isNotNull() & F.col("sha").isNotNull() & F.col("id").isNotNull())
    ends = placed.groupBy("root_id").agg(F.max(F.struct("id", "sha")).alias("end"))
    state = head_offsets(commits, last_good_runs(generations, history))
    done = feed.result()
    count = (done if done is not None else placed.limit(0)).groupBy("root_id").agg(F.count("*").alias("pending"))
    return (
        ends.join(state, "root_id", "left").join(count, "root_id", "left")
        .select("root_id", "done_to", F.col("end.id").alias("next_to"), F.col("end.sha").alias("head"),
                F.coalesce("pending", F.lit(0)).alias("pending"))
    )

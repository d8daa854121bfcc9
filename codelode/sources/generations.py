"""Index generations: tables written under a number, a manifest of what was written, and a pointer that is swapped last.

A reader follows the pointer, so it sees a whole generation or the one before. A run that fails leaves the pointer as it was and its folder is written anew.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators.incremental import digest


@dataclass
class Generations:
    """Generations of an index under ``folder``."""

    spark: SparkSession
    folder: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def current(self) -> str | None:
        """The generation the newest whole pointer names, or None."""
        fs, _ = self._fs(self.folder)
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        whole = [n for n in self._children(f"{self.folder}/pointer") if fs.exists(jvm(f"{self.folder}/pointer/{n}/_SUCCESS"))]
        return self.spark.read.parquet(f"{self.folder}/pointer/{whole[-1]}").first().generation if whole else None

    def table(self, name: str) -> DataFrame:
        g = self.current()
        if g is None:
            raise FileNotFoundError("no generation is published")
        return self.spark.read.parquet(f"{self.folder}/gen/{g}/{name}")

    def manifest(self, generation: str) -> DataFrame:
        """(name, rows, digest) of a generation's tables; digests do not depend on the order of rows."""
        return self.spark.read.parquet(f"{self.folder}/gen/{generation}/_manifest")

    def publish(self, tables: dict[str, DataFrame], created_at: str, fail_after: str | None = None) -> str | None:
        """Writes a generation and points to it; None if its tables are those of the current one. ``fail_after`` (``tables`` or ``manifest``) breaks the run off, for tests.

        The generation's name comes from the digests, so a repeated run writes the same.
        """
        staged = f"{self.folder}/stage"
        rows = []
        for name, df in sorted(tables.items()):
            df.write.mode("overwrite").parquet(f"{staged}/{name}")
            d = digest(self.spark.read.parquet(f"{staged}/{name}"), sorted(df.columns)).first()
            rows.append((name, d.rows, d.digest))
        if fail_after == "tables":
            raise RuntimeError("broken off after the tables")
        number = hashlib.sha256(json.dumps(rows).encode()).hexdigest()[:24]
        if self.current() == number:
            return None
        self.spark.createDataFrame([(*r, created_at) for r in rows], "name string, rows bigint, digest string, created_at string").coalesce(1).write.mode("overwrite").parquet(f"{staged}/_manifest")
        if fail_after == "manifest":
            raise RuntimeError("broken off after the manifest")
        fs, target = self._fs(f"{self.folder}/gen/{number}")
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        if fs.exists(target):
            fs.delete(target, True)
        fs.mkdirs(target.getParent())
        if not fs.rename(jvm(staged), target):
            raise OSError("the generation could not be moved into place")
        last = self._children(f"{self.folder}/pointer")
        self.spark.createDataFrame([(number, created_at)], "generation string, created_at string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pointer/{int(last[-1]) + 1 if last else 0:08d}")
        return number

    def broken(self) -> DataFrame:
        """(name, expected, found) of the current generation's tables that are not what its manifest says; a missing table is found as null."""
        g, out = self.current(), []
        for r in self.manifest(g).collect() if g else []:  # one row a table
            try:
                df = self.spark.read.parquet(f"{self.folder}/gen/{g}/{r.name}")
                found = digest(df, sorted(df.columns)).first().digest
            except Exception:  # noqa: BLE001  a table that cannot be read is broken, whatever the reader says
                found = None
            if found != r.digest:
                out.append((r.name, r.digest, found))
        return self.spark.createDataFrame(out, "name string, expected string, found string")

    def clean(self, keep: int = 2) -> list[str]:
        """Drops all but the ``keep`` newest published generations and pointers; the names dropped."""
        pointers = self._children(f"{self.folder}/pointer")
        kept = {self.spark.read.parquet(f"{self.folder}/pointer/{n}").first().generation for n in pointers[-keep:]}
        dropped = [g for g in self._children(f"{self.folder}/gen") if g not in kept]
        for path in [*(f"gen/{g}" for g in dropped), *(f"pointer/{n}" for n in pointers[:-keep])]:
            fs, p = self._fs(f"{self.folder}/{path}")
            fs.delete(p, True)
        return dropped


def changed(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, status): rows added, removed or changed between two generations' tables of one row a key."""
    value = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    a, b = old.select(*key, value.alias("_a")), new.select(*key, value.alias("_b"))
    rows = a.join(b, key, "full_outer")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return rows.select(*key, status.alias("status")).filter("status is not null")


def canonical(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as JSON with its keys in order, in total order: a form that no run, machine or partitioning changes."""
    return rows.select(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("line")).orderBy("line")


def masked(text, values: dict[str, str]):
    """A text column with run-specific values (a root's folder, a generation's name, a time) replaced by the names given; only whole values are, not parts of longer words."""
    out = text
    for value, name in sorted(values.items(), key=lambda kv: -len(kv[0])):
        out = F.regexp_replace(out, r"(?<![\w-])\Q" + value + r"\E(?![\w-])", f"<{name}>")
    return out

"""Problem 7: tasks of evaluation splits that also stand in the training split.

Three disjoint passages of each normalised task, so that one survives two slips, form
Aho-Corasick automata, sharded by gold path and bounded in size. Every training task is
scanned by the automata of the evaluation tasks of its own gold paths, and every evaluation
task by those of the training tasks, as either may be the shorter one. A passage found at its
place makes a candidate; a word-by-word comparison decides whether both ask for the
same change, and the matched intervals are merged into the share of the evaluation task they cover.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.joins import salted_join

#: Signs by which two slips can move a passage.
SHIFT = 2
#: Rows of evaluation and of training tasks in one group, as far as paths can be told apart or split.
EVAL_ROWS, TRAIN_ROWS = 3000, 20_000
#: Share of tasks a word must stand in to be taken as spelled right; so at most (words a task / share) words are.
KNOWN_SHARE = 1e-3

# Words that ask for the same, and words that ask for nothing.
_SAME = {
    "repair": "fix", "correct": "fix", "fixes": "fix", "drop": "remove", "delete": "remove", "introduce": "add", "retitle": "rename", "prevent": "avoid", "accelerate": "speedup",
}
_EMPTY = frozenset("the a an one please".split())
_INVISIBLE = re.compile(r"[­​-‏ -‮⁠﻿]")
_PREFIX = re.compile(r"^\s*(?:\[[^\]\n]{1,40}\]|\([^)\n]{1,30}\)|[a-z]+(?:\([\w ./-]{1,30}\))?!?:(?=\s)|(?:backport|revert|wip|rfc|draft|please)\b:?)\s*", re.I)
_SUFFIX = re.compile(
    r"[\s,;.]*(?:[(\[]?\s*(?:(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?|see|refs?|re)\s*:?\s*)?(?:gh-|#|!)\d+\s*[)\]]?|[(\[]?\s*(?:second|third|another|next) (?:try|attempt)\s*[)\]]?|[(\[]?\s*backport\s*[)\]]?|,?\s*please|\[[\w ./-]{1,30}\])\s*[.!]?\s*$", re.I
)
_WORD = re.compile(r"\w+")
_ELLIPSIS = re.compile(r"(?:…|\.{3}|\[\.\.\.\])\s*$")


def normal_words(text: str | None) -> tuple[list[str], bool]:
    """The words that say what a task asks for, and whether the text is marked as cut."""
    if not text:
        return [], False
    t = " ".join(_INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).split())
    while (s := _PREFIX.sub("", t, count=1)) != t and s:
        t = s
    cut = bool(_ELLIPSIS.search(text.rstrip()))
    while (s := _SUFFIX.sub("", t)) != t and s:
        t = s
    t = re.sub(r"\bmake faster\b|\bspeed up\b", "speedup", t.lower())
    words = [w for w in _WORD.findall(t) if w not in _EMPTY]
    return [_SAME.get(w, w) if i == 0 else w for i, w in enumerate(words)], cut


def normal_path(path: str) -> str | None:
    """A gold path in one form: forward slashes, no leading dots, no address or line part; null if nothing is left."""
    p = unicodedata.normalize("NFKC", path or "").strip().strip("`'\"<>").replace("\\", "/")
    p = re.sub(r"^[a-z]+://[^/]+/[^/]+/[^/]+/(?:blob|tree|raw)/[^/]+/", "", p)
    p = re.sub(r"(?:#L?\d+(?:-L?\d+)?|:\d+(?:[:-]\d+)?|\?.*)$", "", p)
    p = re.sub(r"/(?:\./)+|/{2,}", "/", p)
    p = re.sub(r"^(?:\.?/)+", "", p)
    return re.sub(r"^[ab]/(?=.+/)", "", p) or None


def one_slip(a: str, b: str) -> bool:
    """Whether one letter was left out, put in, exchanged or swapped with its neighbour."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def same_change(a: list[str], b: list[str], cut: bool, known: frozenset) -> bool:
    """Whether two word lists ask for the same change.

    They may differ by slips of the pen - one letter, in a word without digits that is not a
    usual word on both sides - by one word written as two, and in that one goes on
    where the other ends. Any other word, name or number makes another change.
    """
    if not a or not b:
        return False
    i = j = slips = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x == y:
            i, j = i + 1, j + 1
            continue
        ends_a, ends_b = i == len(a) - 1, j == len(b) - 1
        if len(x) > 2 and len(y) > 2 and one_slip(x, y) and not (x in known and y in known) and re.sub(r"\D", "", x) == re.sub(r"\D", "", y):
            i, j, slips = i + 1, j + 1, slips + 1
        elif j + 1 < len(b) and x == y + b[j + 1]:
            i, j = i + 1, j + 2
        elif i + 1 < len(a) and y == x + a[i + 1]:
            i, j = i + 2, j + 1
        elif (ends_a and y.startswith(x) or ends_b and x.startswith(y)) and min(i, j) >= 4:
            return slips <= 2  # cut inside a word
        elif cut and (ends_a and any(e.startswith(x) for e in _EMPTY) or ends_b and any(e.startswith(y) for e in _EMPTY)) and min(i, j) >= 5:
            return slips <= 2  # cut inside a word that says nothing
        else:
            return False
        if slips > 2:
            return False
    shared = min(i, j)
    rest = max(len(a) - i, len(b) - j)
    return rest == 0 or shared >= 5 or (cut and shared >= 3)


def known_words(tasks: DataFrame) -> frozenset:
    """Words that stand in at least ``KNOWN_SHARE`` of the tasks and in three; counted over all tasks."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for t in b["task"]:
                n.update(set(normal_words(t)[0]))
        yield pd.DataFrame(n.items(), columns=["w", "n"])

    n = tasks.count()
    words = tasks.select("task").mapInPandas(work, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(3.0, KNOWN_SHARE * n))
    return frozenset(r.w for r in words.toLocalIterator())


def _prepared(tasks: DataFrame) -> DataFrame:
    """(task_key, held, words, cut, gold, path): one row for each task and normal gold path."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, split, task, gold in zip(b["task_key"], b["split_name"], b["task"], b["gold"]):
                words, cut = normal_words(task)
                paths = sorted({p for g in (gold if gold is not None else []) if g and (p := normal_path(g))})
                rows += [(key, split != "train", " ".join(words), cut, paths, p) for p in paths if words]
            yield pd.DataFrame(rows, columns=["task_key", "held", "words", "cut", "gold", "path"])

    rows = tasks.select("task_key", "split_name", "task", "gold").filter("task_key is not null and split_name is not null")
    return rows.mapInPandas(work, "task_key bigint, held boolean, words string, cut boolean, gold array<string>, path string").dropDuplicates(["task_key", "words", "path"])


def passages(words: list[str]) -> list[tuple[int, str]]:
    """(offset, passage) over the words run together, so that a word written as two is no difference.

    A task that ``same_change`` accepts as the shorter or equal side keeps at least one of them within two signs of its
    place: two slips spoil two of three groups of words, or, as a swap can lie on a border, four of five pieces of a
    text of under three words. A last word that may be the start of one that says nothing is tried without, too.
    """
    out = set()
    for n in {len(words), len(words) - 1 if any(e.startswith(words[-1]) for e in _EMPTY) else len(words)} - {0}:
        if n > 2:
            parts = ["".join(words[n * k // 3 : n * (k + 1) // 3]) for k in range(3)]
        else:
            text = "".join(words[:n])
            k = min(5, len(text))
            parts = [text[len(text) * i // k : len(text) * (i + 1) // k] for i in range(k)]
        at = 0
        for part in parts:
            out.add((at, part))
            at += len(part)
    return sorted(out)


def _machine(lists: list[list[str]], paths: list[str]):
    """An automaton over the passages of all tasks; each has, by path and offset, the tasks it belongs to."""
    import ahocorasick

    where: dict[str, dict] = {}
    for n, (words, path) in enumerate(zip(lists, paths)):
        for at, part in passages(words):
            where.setdefault(part, {}).setdefault((path, at), []).append(n)
    machine = ahocorasick.Automaton()
    for part, tasks in where.items():
        machine.add_word(part, (len(part), tasks))
    machine.make_automaton()
    return machine


def _hits(machine, text: str, path: str):
    """(task, offset here, offset there, length) of the passages that stand in a text within two signs of their place."""
    for end, (size, tasks) in machine.iter(text):
        here = end - size + 1
        for at in range(max(0, here - SHIFT), here + SHIFT + 1):
            for n in tasks.get((path, at), ()):
                yield n, here, at, size


def _scan(known: frozenset):
    def work(key, held: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        held, train = held.rename(columns=lambda c: c[2:]), train.rename(columns=lambda c: c[2:])
        none = pd.DataFrame({"task_key_a": pd.Series(dtype="int64"), "task_key_b": pd.Series(dtype="int64"), "covered": pd.Series(dtype="float64")})
        if held.empty or train.empty:
            return none
        # Equal words on one path are compared once; both directions, as either side may be the shorter one.
        sides = []
        for rows in (held, train):
            alike: dict[tuple, list[int]] = {}
            for tkey, words, cut, path in zip(rows["task_key"], rows["words"], rows["cut"], rows["path"]):
                alike.setdefault((words, bool(cut), path), []).append(int(tkey))
            sides.append(([k[0].split() for k in alike], [k[1] for k in alike], [k[2] for k in alike], list(alike.values())))
        (e_words, e_cut, e_path, e_keys), (t_words, t_cut, t_path, t_keys) = sides
        covered: dict[tuple[int, int], list] = {}
        for forth in (True, False):
            near, far = ((e_words, e_path), (t_words, t_path)) if forth else ((t_words, t_path), (e_words, e_path))
            machine = _machine(*near)
            for m, (words, path) in enumerate(zip(*far)):
                found: dict[int, list] = {}
                for n, here, there, size in _hits(machine, "".join(words), path):
                    x = there if forth else here
                    found.setdefault(n, []).append((x, x + size))
                for n, parts in found.items():
                    e, t = (n, m) if forth else (m, n)
                    if (e, t) in covered or same_change(e_words[e], t_words[t], e_cut[e] or t_cut[t], known):
                        covered.setdefault((e, t), []).extend(parts)
        out = {}
        for (e, t), parts in covered.items():
            share = len(set().union(*(range(x, y) for x, y in parts))) / len("".join(e_words[e]))
            for x in e_keys[e]:
                for y in t_keys[t]:
                    pair = (min(x, y), max(x, y))
                    out[pair] = max(out.get(pair, 0.0), share)
        if not out:
            return none
        return pd.DataFrame([(a, b, c) for (a, b), c in out.items()], columns=["task_key_a", "task_key_b", "covered"])

    return work


def overlaps(tasks: DataFrame) -> DataFrame:
    """(task_key_a, task_key_b, covered): pairs of a training task and one of another split that ask for the same
    change and share a gold path; a < b. ``covered`` is the share of the evaluation
    task's signs, spaces apart, inside matched passages.

    Tasks without words or gold paths have no pair; repeated rows count once. A path with
    many tasks is split: its evaluation tasks into chunks with an automaton each, its
    training tasks into blocks, and every block meets every chunk.
    """
    from codelode.session import cut

    known = known_words(tasks)
    rows = cut(_prepared(tasks))
    counts = rows.groupBy("path").agg(F.sum(F.col("held").cast("int")).alias("e"), F.sum((~F.col("held")).cast("int")).alias("t")).filter((F.col("e") > 0) & (F.col("t") > 0))
    paths = cut(counts.select("path", F.ceil(F.col("e") / EVAL_ROWS).cast("int").alias("chunks"), F.ceil(F.col("t") / TRAIN_ROWS).cast("int").alias("blocks"), "e", "t"))
    total = paths.agg(F.sum("e"), F.sum("t")).first()
    shards = max(1, -(-(total[0] or 0) // EVAL_ROWS), -(-(total[1] or 0) // TRAIN_ROWS), 4)
    shard = F.when((F.col("chunks") > 1) | (F.col("blocks") > 1), F.col("path")).otherwise(F.pmod(F.xxhash64("path"), F.lit(shards)).cast("string")).alias("shard")
    both = salted_join(rows, paths.select("path", "chunks", "blocks", shard), ["path"], ["task_key"])
    salt = F.xxhash64("task_key")

    def side(held: bool, own: str, other: str, mark: str):
        place = {own: F.pmod(salt, F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
        rest = [F.col(c).alias(mark + c) for c in ("shard", "task_key", "words", "cut", "path")]
        return both.filter(F.col("held") == held).select(*[v.alias(mark + k) for k, v in sorted(place.items())], *rest)

    a, b = side(True, "chunks", "blocks", "e_"), side(False, "blocks", "chunks", "t_")
    pairs = a.groupBy("e_shard", "e_chunks", "e_blocks").cogroup(b.groupBy("t_shard", "t_chunks", "t_blocks")).applyInPandas(_scan(known), "task_key_a bigint, task_key_b bigint, covered double")
    return pairs.groupBy("task_key_a", "task_key_b").agg(F.max("covered").alias("covered"))


def report(tasks: DataFrame) -> DataFrame:
    """(split_name, repo, tasks, leaked): of each evaluation split and repo the tasks and those with a training partner."""
    pairs = overlaps(tasks)
    keys = pairs.select(F.col("task_key_a").alias("task_key")).unionByName(pairs.select(F.col("task_key_b").alias("task_key"))).distinct().withColumn("hit", F.lit(1))
    held = tasks.filter("split_name <> 'train'").select("task_key", "split_name", "repo").distinct()
    return held.join(keys, "task_key", "left").groupBy("split_name", "repo").agg(F.countDistinct("task_key").alias("tasks"), F.countDistinct(F.when(F.col("hit") == 1, F.col("task_key"))).alias("leaked"))

"""Problem 8: texts assigned to containers of a few permitted sizes, by variable-capacity best fit.

Texts are spread by hash over groups of bounded size that are packed apart. In a
group the longest come first; each goes into the open container it fills best. If none has
room, the permitted size that costs least for each token expected in it is opened. In
the end every container shrinks to the smallest permitted size that holds its contents.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.tokens import VOCABULARY, token_count

#: Texts of a group; tokens each container costs besides its size.
GROUP_SIZE, OVERHEAD = 20_000, 16
#: Permitted sizes as parts of the largest.
PARTS = (8, 4, 2, 1)


def permitted(largest: int) -> list[int]:
    """The permitted sizes, rising."""
    return sorted({largest // p for p in PARTS if largest // p > 0})


def pack(sizes: list[int], largest: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Assigns items to containers: ((item, part, tokens, container) ..., capacity of each container).

    An item over ``largest`` is cut into full containers and a rest; no other is
    split. Items without tokens go along in the first container with others, or in
    one of the smallest size.
    """
    caps = permitted(largest)
    todo, assigned, used, capacity = [], [], [], []
    for i, n in enumerate(sizes):
        part = 0
        while n > largest:
            assigned.append((i, part, largest, len(used)))
            used.append(largest)
            capacity.append(largest)
            n, part = n - largest, part + 1
        todo.append((n, i, part))
    todo.sort(key=lambda x: (-x[0], x[1]))
    rising = [n for n, _, _ in reversed(todo)]
    volume = [0]
    for n in rising:
        volume.append(volume[-1] + n)
    room: list[tuple[int, int]] = []  # (free tokens, container), rising
    for k, (n, i, part) in enumerate(todo):
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, c = room.pop(at)
        else:
            left = len(todo) - k - 1  # the items after this one are the first ``left`` of ``rising``

            def price(cap: int) -> float:
                fits = volume[min(left, bisect.bisect_right(rising, cap - n, 0, left))]
                return (cap + OVERHEAD) / max(1, n + min(cap - n, fits))

            cap = min((c for c in caps if c >= n), key=lambda c: (price(c), -c))
            c, free = len(used), cap
            used.append(0)
            capacity.append(cap)
        used[c] += n
        assigned.append((i, part, n, c))
        if free - n >= 0:
            bisect.insort(room, (free - n, c))
    return assigned, [caps[bisect.bisect_left(caps, u)] for u in used]


def assign(documents: DataFrame, largest: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, tokens, token_start, container_id, capacity, position): where each text, or part of one, lies.

    Every row of ``documents`` with a doc_id is assigned once, null and empty texts with
    zero tokens; rows that repeat are items of their own. ``position`` is the token at
    which it begins in its container.
    """
    if largest < 1:
        raise ValueError("a container holds at least one token")
    groups = max(1, -(-documents.count() // GROUP_SIZE))
    sized = documents.filter("doc_id is not null").select("doc_id", token_count(F.col("text"), vocabulary).alias("tokens"))
    grouped = sized.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))

    def work(key, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "tokens"], kind="stable")
        ids = items["doc_id"].tolist()
        got, caps = pack(items["tokens"].tolist(), largest)
        place = [0] * len(caps)
        rows = []
        for i, part, n, c in sorted(got, key=lambda x: (x[3], x[0], x[1])):
            rows.append((ids[i], part, n, part * largest, (int(key[0]) << 32) + c, caps[c], place[c]))
            place[c] += n
        return pd.DataFrame(rows, columns=["doc_id", "part", "tokens", "token_start", "container_id", "capacity", "position"])

    return grouped.groupBy("grp").applyInPandas(
        work, "doc_id bigint, part int, tokens bigint, token_start bigint, container_id bigint, capacity int, position bigint"
    )


def report(assigned: DataFrame) -> DataFrame:
    """(capacity, containers, tokens, fill): how many containers of each size came out and how full they are."""
    one = assigned.groupBy("container_id", "capacity").agg(F.sum("tokens").alias("t"))
    return one.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.sum("t") / F.sum("capacity"), 6).alias("fill"))

"""Problem 6: texts over a size limit cut into overlapping pieces at natural boundaries.

Text is taken as lines and sentences. At each gap between two of them the words before and
after are compared; a valley of the similarity marks a change of topic. In each window of sizes
the deepest valley is the cut; where the window has no gap, white space, and in an unbroken run the
limit itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a block on each side of a gap; the least share of the room a piece fills, where text goes on.
BLOCK_WORDS, LEAST_FILL = 60, 0.5
#: What a boundary's kind adds to its depth: sentence, line, blank line or heading; and what being inside a fence or table takes away.
LEVEL_BONUS, INSIDE_COST = 0.12, 0.4

_UNIT = re.compile(r"[^\n]*?(?:[.!?]+[\"'»”’)\]]*(?=\s)[ \t]*|[。！？]+|\n|$)")
_WORD = re.compile(r"[^\W_]{2,}")


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines and sentences, which together are the whole text."""
    out, pos = [], 0
    while pos < len(text):
        end = _UNIT.match(text, pos).end()
        if end == pos:
            end = pos + 1
        if text.startswith("\n", end) and end < len(text) and text[end - 1] != "\n":
            end += 1
        if text[pos:end].isspace() and out:
            out[-1] = (out[-1][0], end)
        else:
            out.append((pos, end))
        pos = end
    return out


def words(s: str) -> list[str]:
    """Lower-cased words; runs without spaces, as in Japanese, as pairs of signs."""
    out = []
    for w in _WORD.findall(s.lower()):
        out += [w[i : i + 2] for i in range(len(w) - 1)] if ord(w[0]) > 0x2E80 else [w]
    return out


def similarities(bags: list[list[str]]) -> list[float]:
    """The cosine of the word counts of the blocks before and after each gap between units.

    A block is the fewest whole units next to the gap that hold ``BLOCK_WORDS`` words. Both blocks
    only move forward, so each word enters and leaves each of them once.
    """
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = left_sq = right_sq = left_n = right_n = 0
    out, lo, hi = [], 0, 0  # the blocks are units [lo, i) and [i, hi)
    for i in range(1, len(bags)):
        # the unit before the gap goes from the right block to the left one
        for w in bags[i - 1]:
            if i - 1 < hi:
                v = right[w]
                right[w], right_sq, right_n = v - 1, right_sq - 2 * v + 1, right_n - 1
                dot -= left.get(w, 0)
            v = left.get(w, 0)
            left[w], left_sq, left_n = v + 1, left_sq + 2 * v + 1, left_n + 1
            dot += right.get(w, 0)
        hi = max(hi, i)
        while lo < i - 1 and left_n - len(bags[lo]) >= BLOCK_WORDS:
            for w in bags[lo]:
                v = left[w]
                left[w], left_sq, left_n = v - 1, left_sq - 2 * v + 1, left_n - 1
                dot -= right.get(w, 0)
            lo += 1
        while hi < len(bags) and right_n < BLOCK_WORDS:
            for w in bags[hi]:
                v = right.get(w, 0)
                right[w], right_sq, right_n = v + 1, right_sq + 2 * v + 1, right_n + 1
                dot += left.get(w, 0)
            hi += 1
        norm = math.sqrt(left_sq * right_sq)
        out.append(dot / norm if norm else 0.0)
    return out


def gaps(text: str) -> list[tuple[int, float]]:
    """(offset, score) of each gap between units; the score is the valley's depth and the kind of boundary."""
    us = units(text)
    fence, inside = False, []
    for a, b in us:
        line = text[a:b].lstrip()
        if line.startswith("```"):
            fence = not fence
        inside.append(fence or line.startswith("|"))
    sims = similarities([words(text[a:b]) for a, b in us])
    # the nearest peak on each side, in one pass each way: a slope goes on while it does not fall
    before, after = sims[:], sims[:]
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            before[i] = before[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            after[i] = after[i + 1]
    out = []
    for i, s in enumerate(sims):
        start, prev = us[i + 1][0], text[us[i][0] : us[i][1]]
        level = 3 if re.search(r"\n[ \t\r]*\n\s*$", prev) or text.startswith("#", start) else 2 if "\n" in prev else 1
        out.append((start, (before[i] - s) + (after[i] - s) + LEVEL_BONUS * level - INSIDE_COST * (inside[i] and inside[i + 1])))
    return out


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """The offsets at which a text is cut so that each piece, with the overlap before it, keeps the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return []
    places = gaps(text)
    out, start, at = [], 0, 0
    while len(text) - start > (room := limit - (overlap if start else 0)):
        low = start + max(min(overlap, room - 1), int(room * LEAST_FILL), 1)
        high = start + room
        while at < len(places) and places[at][0] < low:
            at += 1
        k, best = at, None
        while k < len(places) and places[k][0] <= high:
            if best is None or places[k][1] >= best[1]:
                best = places[k]
            k += 1
        if best is None:
            space = max((m.end() for m in re.compile(r"\s+").finditer(text, low, high)), default=0)
            cut = space if space > low else high
            while cut > low + 1 and (text[cut - 1 : cut + 1] == "\r\n" or 0x300 <= ord(text[cut]) < 0x370 or text[cut] in "‍️" or text[cut - 1] == "‍"):
                cut -= 1
        else:
            cut = best[0]
        out.append(cut)
        start = cut
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, new_start, end) of each piece; ``start`` lies ``overlap`` before ``new_start``, but for the first."""
    at = [0, *cuts(text, limit, overlap), len(text)]
    return [(max(0, a - overlap) if a else 0, a, b) for a, b in zip(at, at[1:])]


def pieces(parts: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(root_id, rel_path, part_number, chunk_kind, piece_number, char_start, new_start, char_end, text) of every part over the limit.

    A piece is at most ``limit`` Unicode characters and begins with the last
    ``overlap`` of the one before; from ``new_start`` on the pieces give the whole text again. Parts within the
    limit, null and empty texts have no pieces. ``chunk_kind`` is doc_heading for a piece that begins with a heading, else
    content_hint. Repeated rows give repeated pieces.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for root, path, number, text in zip(b["root_id"], b["rel_path"], b["part_number"], b["text"]):
                for n, (a, new, e) in enumerate(split_text(text, limit, overlap)):
                    kind = "doc_heading" if re.match(r"\s*#{1,6}\s", text[new:e]) else "content_hint"
                    rows.append((root, path, number, kind, n + 1, a, new, e, text[a:e]))
            yield pd.DataFrame(rows, columns=["root_id", "rel_path", "part_number", "chunk_kind", "piece_number", "char_start", "new_start", "char_end", "text"]).astype({"part_number": "Int32"})

    long = parts.select("root_id", "rel_path", "part_number", "text").filter(F.char_length("text") > limit)
    return long.mapInPandas(
        work, "root_id string, rel_path string, part_number int, chunk_kind string, piece_number int, char_start int, new_start int, char_end int, text string"
    )

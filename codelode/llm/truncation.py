"""Problem 10: texts cut off by field limits or broken transfers.

Lengths are recomputed under several encodings and escapings and counted for
each source; a length far more frequent than its neighbours is a hidden storage limit.
Then endings are inspected: an open escape, fence, table row or code span is a
cut; a final sentence mark is none; any other last words are judged by how lines
of that kind end in the whole collection.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.operators.joins import salted_join

#: A length is a limit from so many texts and so many times the mean of the lengths within ``NEAR`` of it.
LEAST, TIMES, NEAR, SHORTEST = 5, 5.0, 16, 100
#: and from this share of a source's texts.
LIMIT_SHARE = 0.02
#: Share of a kind's line ends, and of all texts' ends, from which last words are a regular ending; their number is at most the inverse.
LINE_SHARE, TEXT_SHARE = 1e-4, 2e-3
#: Share of a word's occurrences that end a line from which the word alone is a regular ending.
END_SHARE = 0.3

_TOKEN = re.compile(
    r"[\w.-]*\w/[\w./-]*\w|[^\W\d]\w*(?:\.\w+)*|\d+(?:[.,]\d+)*|[:;]-?[)(]|\+\d|[^\w\s]"
)
_END_MARK = re.compile(r"[.!?。！？][\"'»”’)\]」』*_]*$")
_CUT_MARK = re.compile(
    r"(?i)(?:[\[(<{]\s*(?:\.{3}|…|cut|truncated|trimmed|clipped|snip(?:ped)?|more|abridged|shortened|gekürzt|abgeschnitten|tronqué|coupé|truncado|cortado|省略|続く|\d+ (?:more )?(?:chars|characters|bytes)[^\])>}]*|text (?:cut|truncated))\s*[\])>}]"
    r"|(?:read|see|show) more|continued|to be continued)\s*$"
)
_OPEN_ESCAPE = re.compile(r"(?:&[A-Za-z]{1,8}|&#?\d{0,5}|&#?x?[0-9a-fA-F]{0,5}|\\|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|=[0-9A-F]?|%[0-9A-F]?|<!?/?[A-Za-z][^<>]*|�+)$")
_LIST = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s")


def representations(text) -> dict:
    """The lengths of a text as a store may have counted them."""
    n, u8 = F.char_length(text), F.octet_length(text)

    def count(c: str):
        return n - F.char_length(F.replace(text, F.lit(c), F.lit("")))

    line = count("\n") - (n - F.char_length(F.replace(text, F.lit("\r\n"), F.lit("\n"))))
    html = 4 * count("&") + 3 * count("<") + 3 * count(">") + 5 * count('"')
    json = count('"') + count("\\") + count("\n") + count("\r") + count("\t")
    wide = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    foreign = n - F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return {
        "chars": n, "utf8": u8, "utf16": wide, "chars_crlf": n + line, "utf8_crlf": u8 + line, "chars_html": n + html, "utf8_html": u8 + html,
        "chars_json": n + json, "utf8_json": u8 + json, "ascii_json": n + json + 5 * foreign,
    }


FORMS = ("chars", "utf8", "utf16", "chars_crlf", "utf8_crlf", "chars_html", "utf8_html", "chars_json", "utf8_json", "ascii_json")


def source_of(col):
    """A source's name without case and outer white space; null where nothing is left."""
    return F.nullif(F.lower(F.trim(col)), F.lit(""))


def _plain(form: str) -> int:
    """Of equal forms the plainest counts: the later in ``FORMS``, the less."""
    return -FORMS.index(form)


def limits(documents: DataFrame) -> DataFrame:
    """(source, form, size, texts): the hidden storage limits of each source.

    Each different text of a source counts once. A text that fits several limits is
    counted for the one with most texts, so a limit in one form does not
    show again in others. Lengths are counted by (source, form, size) before anything is joined; a peak holds
    ``LIMIT_SHARE`` of its source's texts, so a source has at most its inverse in each form.
    """
    from codelode.session import cut

    texts = documents.filter(F.col("text").isNotNull()).select(source_of(F.col("source")).alias("source"), F.col("text")).filter(F.col("source").isNotNull())
    forms = representations(F.col("text"))
    sizes = F.array(*[F.struct(F.lit(k).alias("form"), v.cast("int").alias("size")) for k, v in forms.items()])
    rows = cut(texts.select("source", F.xxhash64("text").alias("h"), sizes.alias("all")).dropDuplicates(["source", "h"]))
    hist = rows.select("source", F.explode("all").alias("x")).select("source", "x.form", "x.size").filter(F.col("size") >= SHORTEST).groupBy("source", "form", "size").agg(F.count("*").alias("texts"))
    of = rows.filter(F.col("all")[0]["size"] >= SHORTEST).groupBy("source").agg(F.count("*").alias("of"))
    near = Window.partitionBy("source", "form").orderBy("size").rangeBetween(-NEAR, NEAR)
    high = lambda: (F.col("texts") >= LEAST) & (F.col("texts") > TIMES * F.col("around") + 2) & (F.col("texts") >= LIMIT_SHARE * F.col("of"))
    peaks = hist.withColumn("around", (F.sum("texts").over(near) - F.col("texts")) / (2 * NEAR)).join(of, "source").filter(high())
    own = peaks.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("form", "size").alias("k"), F.struct("texts", "around").alias("v")))).alias("peaks"), F.max("of").alias("of"))
    place = F.create_map(*[x for k in FORMS for x in (F.lit(k), F.lit(_plain(k)))])
    hit = F.array_max(F.transform(F.filter("all", lambda x: F.map_contains_key("peaks", x)), lambda x: F.struct(F.col("peaks")[x]["texts"].alias("texts"), place[x["form"]].alias("plain"), x["form"].alias("form"), x["size"].alias("size"), F.col("peaks")[x]["around"].alias("around"))))
    best = salted_join(rows, own, ["source"], ["h"]).select("source", "of", hit.alias("b")).filter("b is not null")
    return (
        best.groupBy("source", "b.form", "b.size").agg(F.count("*").alias("texts"), F.max("b.around").alias("around"), F.max("of").alias("of"))
        .filter(high()).select("source", "form", "size", "texts")
    )


def kind_of(line: str, before: str) -> str:
    """What a line is: list, heading, table, note (a key and a value), sign (after a signature mark) or prose."""
    if before.rstrip() == "--":
        return "sign"
    if _LIST.match(line):
        return "list"
    if line.startswith("#"):
        return "heading"
    if line.lstrip().startswith("|"):
        return "table"
    if re.match(r"\s*[A-Z][\w -]{1,24}: \S+$", line):
        return "note"
    return "prose"


def fold(token: str) -> str:
    """A token's form: numbers, versions, paths and identifiers by their kind, other words as they are."""
    if "/" in token:
        ext = re.search(r"\.(\w{1,5})$", token)
        return f"P.{ext.group(1)}" if ext else "P"
    if token[0].isdigit():
        return re.sub(r"\d+", "0", token)
    if "_" in token.strip("_"):
        return "I_"
    if re.search(r"[a-z][A-Z]", token):
        return "Ic"
    return token.lower() if len(token) < 30 else "L"


def last_words(line: str) -> tuple[str, str]:
    toks = _TOKEN.findall(line)
    return (fold(toks[-2]) if len(toks) > 1 else "^", fold(toks[-1]) if toks else "^")


def limit_of(sizes: dict[str, int], known: list[tuple[str, int]]) -> tuple | None:
    """(form, size) of the limit a text of these sizes is at. Bytes may miss up to three, where a sign did not fit."""
    for form, size in known:
        n = sizes[form]
        if n == size or (form.startswith("utf8") and size - 3 <= n < size):
            return form, size
    return None


#: Folded tokens a task remembers, and counts it holds before it hands them on.
MEMO, HELD = 200_000, 400_000


class _Lines:
    """Counts how lines end, by kind of line; what it holds is bounded by ``HELD``."""

    def __init__(self) -> None:
        self.two: Counter = Counter()
        self.one: Counter = Counter()
        self.memo: dict[str, str] = {}

    def folds(self, line: str) -> list[str]:
        memo, out = self.memo, []
        for t in _TOKEN.findall(line):
            f = memo.get(t)
            if f is None:
                if len(memo) > MEMO:
                    memo.clear()
                f = memo[t] = fold(t)
            out.append(f)
        return out

    def add(self, lines: list[str], at_limit: bool) -> None:
        fence = False
        for i, line in enumerate(lines):
            if line.lstrip().startswith("```"):
                fence = not fence
                continue
            if fence or not line.strip():
                continue
            final = i == len(lines) - 1
            if final and at_limit:
                continue
            toks = self.folds(line)
            if not toks:
                continue
            kind = kind_of(line, lines[i - 1] if i else "")
            for t in toks[:-1]:
                self.one[kind, t, 0] += 1
            self.one[kind, toks[-1], 2 if final else 1] += 1
            self.two[kind, toks[-2] if len(toks) > 1 else "^", toks[-1], 2 if final else 1] += 1

    def rows(self) -> list[tuple]:
        out = [(k, p, t, f, n) for (k, p, t, f), n in self.two.items()] + [(k, None, t, f, n) for (k, t, f), n in self.one.items()]
        self.two.clear()
        self.one.clear()
        return out


def _regular(counts: DataFrame) -> DataFrame:
    """(kind, before, word) with which lines or texts of the collection end regularly; ``before`` is null for a word alone.

    ``counts`` has (kind, before, word, place, n): all texts are counted, but for the last lines of those at a limit. Every
    member has at least ``LINE_SHARE`` of the line
    ends of its kind or ``TEXT_SHARE`` of all text ends, so there are at
    most a few times their inverses.
    """
    from codelode.session import cut

    n = F.col("n")
    t = cut(counts.groupBy("kind", "before", "word").agg(
        F.sum(F.when(F.col("place") == 0, n).otherwise(0)).alias("within"), F.sum(F.when(F.col("place") == 1, n).otherwise(0)).alias("line"), F.sum(F.when(F.col("place") == 2, n).otherwise(0)).alias("final")
    ))
    tot = {r.kind: r.line for r in t.filter(F.col("before").isNotNull()).groupBy("kind").agg(F.sum("line").alias("line")).collect()}  # one row a kind
    texts = t.filter(F.col("before").isNotNull()).agg(F.sum("final")).first()[0] or 0
    share = F.create_map(*[x for k, v in tot.items() for x in (F.lit(k), F.lit(float(max(3.0, LINE_SHARE * v))))])[F.col("kind")] if tot else F.lit(3.0)
    often = F.col("final") >= max(4.0, TEXT_SHARE * texts)
    by_line = F.col("line") >= share
    single = F.col("before").isNull()
    number = F.col("word").rlike(r"^0|^P|^I|^L$|^[^\w]$")
    whole = F.col("line") + F.col("final") >= END_SHARE * (F.col("within") + F.col("line") + F.col("final"))
    keep = t.filter((~single & (by_line | often)) | (single & ~number & whole & (by_line | often)))
    return keep.select("kind", "before", "word")


def ending(text: str, at_limit: bool) -> str | None | tuple[str, str, str, bool]:
    """Why a text is cut off, or None if it is whole; where only the collection's own endings can tell,
    (kind of line, word before, last word, whether it ends after a word's end). Empty texts are whole."""
    t = text.rstrip()
    if not t:
        return None
    if _CUT_MARK.search(t):
        return "mark"
    lines = t.split("\n")
    last, before = lines[-1], lines[-2] if len(lines) > 1 else ""
    sentence = re.split(r"[.!?。！？]\s|```|\|", last.rstrip(".!?。！？"))[-1]
    ended = bool(_END_MARK.search(last)) and len(re.findall(r"[^\W\d_]{2,}", sentence)) >= 4 and not re.search(r"[;={}<>]", sentence)
    if sum(ln.lstrip().startswith("```") for ln in lines) % 2 and not ended:
        return "fence"
    if last.lstrip().startswith("```"):
        return None if len(last.strip()) == 3 else "fence"
    kind = kind_of(last, before)
    if kind == "table" and not ended:
        cells = before.count("|") if before.lstrip().startswith("|") else None
        return None if last.endswith("|") and (cells is None or cells == last.count("|")) else "table"
    if last.count("`") % 2:
        return "code"
    if _OPEN_ESCAPE.search(last) and not re.search(r"[`\s]=$|\s<$", last):
        return "escape"
    if last[0] in "{[" and last[-1] in "}]" and last.count("{") == last.count("}"):
        return None
    if re.search(r"(?:\.{3}|…)$", t):
        stem = re.sub(r"[.…]+$", "", last)
        words = re.findall(r"\w+", re.split(r"[.!?。！？…]\s", stem)[-1])
        return "mark" if len(words) >= 2 or at_limit else None
    if _END_MARK.search(last):
        if re.search(r"(?<![\d.])\d+\.\d+\.$", last) or re.search(r"/\w+\.$", last):
            return "word"
        opened = last.count("(") - last.count(")")
        return "sentence" if opened > 0 and not re.search(r"[:;]-?\($", last) and at_limit else None
    a, b = last_words(last)
    return kind, a, b, bool(re.search(r"[\s,;:(]$", text))


_ENDS = "doc_id bigint, source string, form string, size int, reason string, kind string, before string, word string, open boolean, place int, n bigint"


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, form, size, reason): ``reason`` says how a text is cut and is null for whole texts;
    ``form`` and ``size`` name the limit the text is at, if any. Null and empty texts are whole; rows that repeat are
    judged alike.

    With the limits known every text is read once more: its lines are counted and its ending is
    inspected. Endings that only the counts can judge are joined to the regular ones.
    """
    from codelode.session import cut

    known: dict[str, list] = {}
    for r in sorted(limits(documents).toLocalIterator(), key=lambda r: (-r.texts, r.form, r.size)):
        known.setdefault(r.source, []).append((r.form, r.size))
    used = sorted({form for found in known.values() for form, _ in found}, key=FORMS.index)
    forms = representations(F.col("text"))
    texts = documents.select("doc_id", source_of(F.col("source")).alias("source"), "text", *[F.coalesce(forms[k], F.lit(0)).cast("int").alias(k) for k in used])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ENDS.split(", ")]
        none = (None,) * 5
        types = {"doc_id": "Int64", "size": "Int32", "place": "Int32", "n": "Int64", "open": "boolean"}
        count = _Lines()

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype(types)

        for b in batches:
            rows = []
            sizes = {k: b[k].tolist() for k in used}
            for i, (doc, source, text) in enumerate(zip(b["doc_id"], b["source"], b["text"])):
                hit = limit_of({k: v[i] for k, v in sizes.items()}, known[source]) if source in known else None
                got = None
                if text:
                    count.add(text.rstrip().split("\n"), hit is not None)
                    got = ending(text, hit is not None)
                head = (None if pd.isna(doc) else int(doc), source, *(hit or (None, None)))
                rows.append((*head, None, *got, None, None) if isinstance(got, tuple) else (*head, got, None, None, None, None, None, None))
            yield frame(rows)
            if len(count.two) > HELD:
                yield frame([(*none, k, p, w, None, f, n) for k, p, w, f, n in count.rows()])
        yield frame([(*none, k, p, w, None, f, n) for k, p, w, f, n in count.rows()])

    ends = cut(texts.mapInPandas(work, _ENDS))
    regular = _regular(ends.filter("place is not null").select("kind", "before", "word", "place", "n"))
    # both tables have at most a few times the inverse of the shares
    two = F.broadcast(regular.filter("before is not null").withColumn("_two", F.lit(True)))
    one = F.broadcast(regular.filter("before is null").select("kind", "word", F.lit(True).alias("_one")))
    docs = ends.filter("place is null").join(two, ["kind", "before", "word"], "left").join(one, ["kind", "word"], "left")
    asked = F.col("kind").isNotNull() & F.col("_two").isNull() & F.col("_one").isNull()
    reason = F.when(asked, F.when(F.col("open"), "sentence").otherwise("word")).otherwise(F.col("reason"))
    return docs.select("doc_id", "source", "form", "size", reason.alias("reason"))


def rates(rows: DataFrame) -> DataFrame:
    """(source, texts, cut, at_limit, rate) over ``judged``; texts without a source are one group with a null source."""
    return rows.groupBy("source").agg(
        F.count("*").alias("texts"), F.count("reason").alias("cut"), F.count("form").alias("at_limit"), F.round(F.count("reason") / F.count("*"), 6).alias("rate")
    )

"""Problem 5: source files that do not parse.

Each distinct text of a language is parsed once by the packrat grammar of its
file name's language and must be consumed in full. The result has the furthest
position reached, a cause and the line; rates are counted per root and language.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.grammars import EMPTY_OK, ENDINGS, grammar
from codelode.llm.lexers import LexError, lex
from codelode.operators.joins import salted_join

_MARK = re.compile(r"^(?:<{7}|\|{7}|={7}|>{7})(?: .*)?$", re.M)


def language_of(path):
    """The language of a file name's ending (lower or upper case), else null."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])[ending]


def check(language: str, text: str) -> tuple[bool, int, str]:
    """(valid, furthest position, cause) of a text.

    The cause is one of ``conflict`` (a merge marker at the failure), ``truncated``
    (all was read when it failed), ``empty``, the lexer's reason, or ``unexpected``.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    try:
        kinds, at, lines = lex(language, text)
    except LexError as e:
        return False, e.at, _cause(text, e.at, e.why)
    if not kinds:
        return language in EMPTY_OK, 0, "" if language in EMPTY_OK else "empty"
    end = grammar(language).parse(kinds, lines)
    if end < 0:
        return True, len(text), ""
    where = at[end] if end < len(at) else len(text)
    return False, where, _cause(text, where, "unexpected")


def _cause(text: str, at: int, why: str) -> str:
    """Names the conflict or the cut-off that lies behind a failure."""
    begin = text.rfind("\n", 0, at) + 1
    near = _MARK.search(text, max(0, text.rfind("\n", 0, max(0, begin - 1))))
    if near and near.start() <= at + 1:
        return "conflict"
    if at >= len(text.rstrip()) or (why.startswith("unclosed") and "\n" not in text[at:].rstrip()):
        return "truncated"
    return why


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [check(lang, text) for lang, text in zip(b["language"], b["content"])]
        lines = [text.count("\n", 0, at) + 1 for (_, at, _), text in zip(got, b["content"])]
        yield pd.DataFrame({
            "language": b["language"], "digest": b["digest"], "valid": [v for v, _, _ in got],
            "position": [p for _, p, _ in got], "line_no": lines, "cause": [c for _, _, c in got],
        })


def parsed(contents: DataFrame) -> DataFrame:
    """(file_id, root_id, rel_path, language, valid, position, line_no, cause) of each distinct file row.

    Rows whose name has none of the nine endings, and null texts or names,
    have no result. Repeated rows count once; a file with several texts has a row
    for each. Equal texts of a language are parsed once, wherever they lie.
    """
    rows = (
        contents.select("file_id", "root_id", "rel_path", "content", language_of(F.col("rel_path")).alias("language"))
        .filter(F.col("language").isNotNull() & F.col("content").isNotNull())
        .withColumn("digest", F.sha2("content", 256))
    )
    texts = rows.groupBy("language", "digest").agg(F.first("content").alias("content"))
    result = texts.select("language", "digest", "content").mapInPandas(
        _parse, "language string, digest string, valid boolean, position int, line_no int, cause string"
    )
    files = rows.drop("content").dropDuplicates(["file_id", "root_id", "rel_path", "digest"])
    return salted_join(files, result, ["language", "digest"], ["file_id"]).drop("digest")


def rates(files: DataFrame) -> DataFrame:
    """(root_id, language, files, invalid, rate) over ``parsed``: a file is invalid if one of its texts is."""
    one = files.groupBy("root_id", "language", "file_id").agg(F.max((~F.col("valid")).cast("int")).alias("bad"))
    return one.groupBy("root_id", "language").agg(
        F.count("*").alias("files"), F.sum("bad").alias("invalid"), F.round(F.avg("bad"), 6).alias("rate")
    )

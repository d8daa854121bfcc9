"""Column functions over names, paths and texts. All are built-ins, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of source languages and folders that mark a path's role.
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "go": "Go", "java": "Java", "sql": "SQL", "md": "Markdown", "json": "JSON",
    "yaml": "YAML", "toml": "TOML", "xml": "XML", "sh": "Shell",
}
TEST_PATH = r"(^|/)(tests?|__tests__|spec|fixtures)/|(^|/)test_[^/]*$|[._](test|spec)\.[a-z]+$"
DOC_PATH = r"(^|/)(docs?|design|handbook|plans?)/|\.(md|rst|txt|adoc)$"
MIGRATION_PATH = r"(^|/)migrations?/"
RETIRED_PATH = r"(^|/)(archive|archived|legacy|deprecated|old)/"
SUPPORT_PATH = r"(^|/)(examples?|bench|benchmarks|vendor|third_party|node_modules)/"
BUNDLE_PATH = r"\.min\.(js|css)$|(^|/)bundle\.[0-9a-f]+\.js$|\.map$"
DOCUMENT_ENDING = r"(?i)\.(pdf|docx|pptx|xlsx|svg)$"


def stable_id(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the parts joined by ``::``; null if a part is null."""
    return F.substring(F.sha2(F.concat(*[x for p in parts for x in (F.lit("::"), p)][1:]), 256), 1, 24)


def extension(path: Column) -> Column:
    """The ending after the last dot of the name, lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))


def language(path: Column) -> Column:
    """The display name of a path's language, else ``other``."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)], F.lit("other"))


def glob_pattern(glob: str) -> str:
    """A path glob as a pattern: ``*`` and ``?`` within a segment, ``**`` over any number of segments."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = glob[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".^$+{}()|[]\\" else c)
            i += 1
    return "^" + "".join(out) + "$"


def admits(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether the globs admit a path: an exclusion wins; without inclusions all are included."""
    inside = F.lit(True) if not include else F.lit(False)
    for g in include:
        inside = inside | path.rlike(glob_pattern(g))
    for g in exclude:
        inside = inside & ~path.rlike(glob_pattern(g))
    return inside


def size_limit(path: Column, limit: int = 1_000_000) -> Column:
    """The largest size in bytes that is read of a path: 20 MiB for office documents, else ``limit``."""
    return F.when(path.rlike(DOCUMENT_ENDING), F.lit(20 * 1024 * 1024)).otherwise(F.lit(limit))


def terms(text: Column) -> Column:
    """``term_list`` with each word once."""
    return F.array_distinct(term_list(text))


def term_list(text: Column) -> Column:
    """Lower-case words of two and more letters or digits, split at signs and inside camel case; in order, repeats kept."""
    split = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(split)), " "), lambda w: F.length(w) >= 2)


def text_hint(content: Column) -> Column:
    """The first 40 lines that are not blank, stripped, of the first 12,000 characters; at most 2,000 characters."""
    lines = F.transform(F.split(F.substring(content, 1, 12_000), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.substring(F.array_join(F.slice(F.filter(lines, lambda x: x != ""), 1, 40), "\n"), 1, 2000)


def preview(text: Column) -> Column:
    """White space collapsed, at most 500 characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 500)


def token_proxy(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def dimension(token: Column) -> Column:
    """The hashed dimension of a token: the first four SHA-256 bytes modulo 256, which is the fourth byte."""
    return F.conv(F.substring(F.sha2(token, 256), 7, 2), 16, 10).cast("int")


def hashed_words(text: Column) -> Column:
    """The lower-case runs of letters and digits of a text, each followed by its letter and digit parts where it has both; repeats kept."""
    runs = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    return F.flatten(F.transform(runs, lambda w: F.concat(F.array(w), F.filter(F.regexp_extract_all(w, F.lit("([a-z]+|[0-9]+)"), 1), lambda x: x != w))))


def tokens_in(chars: Column) -> Column:
    """A quarter of a number of characters, to the nearest whole, halves to the even one."""
    return F.bround(chars / 4).cast("bigint")


def status_word(status: Column) -> Column:
    """The word for a change's letter."""
    words = {"A": "added", "D": "deleted", "R": "renamed", "M": "modified", "T": "retyped"}
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[status]

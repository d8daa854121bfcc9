"""Redaction of texts before they are indexed: credentials by family, one pass over the text for each.

A label says that a value is secret, a judgement of the value says that it is a literal: references, calls, placeholders and masks stay. Families: key blocks,
published token forms, passwords and secret parameters in addresses, authorization headers, assignments and entries of every bracket and arrow, comparisons, tuples, unpackings,
block values, values over several lines and quotes that never close. Line ends are kept, so every line keeps its number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

MARK = "[REDACTED]"
# Published forms of tokens, words that make a label secret or harmless, and values that are none.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[\w-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[\w-]{20,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}|xox[abeprs]-[A-Za-z0-9-]{10,}|hvs\.[\w-]{20,}|"
    r"SG\.[\w-]{20,}\.[\w-]{20,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})"
)
_SECRET = frozenset("password passwd pwd passphrase passwort secret secrets credential credentials token apikey auth bearer".split())
_KEYED = frozenset("api access signing encryption private secret master service auth client".split())
_PLAIN = frozenset("hash digest checksum id name type count length limit expiry expires url uri path file field label regex pattern policy min max public version prefix header column input form class test error message hint key_id kind".split())
_NOT_VALUE = re.compile(
    r"(?i)^(?:none|null|nil|true|false|undefined|string|str|text|int|bytes|required|optional|hidden|changeme|change[_-]me|replace[_-]?me|todo|example|placeholder|dummy|redacted|\[redacted\]|your[-_ ].*|<.*>|\[.*\]|\{.*\}|\$.*|%.*%|\*+|x{3,}|\.{3,}|env|vault|stdin|prompt)$"
)
_REFERENCE = re.compile(r"(?i)^(?:[a-z_][\w]*(?:\.[a-z_]\w*)+(?:\(.*)?|[a-z_]\w*\s*[(\[].*|vault:.*|\w+://.*/secrets?/.*|(?:os|process|env|config|settings|self|this)[.\[].*)$")
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINE = re.compile(r"(?:\n[ \t]*[\"']?(?:[A-Za-z0-9+/=]{16,}|[A-Z][\w-]+: [^\n]*|)[\"',+\\]*)*")
_ADDRESS = re.compile(r"(://[^\s:/@\"'`]*:)([^\s/@\"'`]{2,})(?=@)")
_PARAMETER = re.compile(r"(?i)([?&](?:access_token|api_?key|apikey|auth|client_secret|password|passwd|secret|sig|signature|token)=)([^&\s\"'`#<>]{4,})")
_HEADER = re.compile(r"(?i)((?:proxy-)?authorization[\"']?\s*[:=,]\s*[\"'`]?\s*(?:bearer|basic|token|digest)\s+)([\"']\s*\+?\s*[\"'])?([A-Za-z0-9._~+/=!%@#-]{6,})")
_COOKIE = re.compile(r"(?i)((?:x-api-key|x-auth-token|private-token)[\"']?\s*[:=]\s*[\"'`]?)([A-Za-z0-9._~+/=-]{8,})")
_LABEL = r"(?P<label>[A-Za-z_][\w.-]*)"
_PAIR = re.compile(rf"{_LABEL}(?P<lq>[\"'`]?)\s*\]?\s*(?P<op>:=|=>|->|==?=?|!==?|:)\s*(?P<value>(?P<p>[brfu]{{0,2}})(?P<q>[\"'`])(?P<in>(?:\\.|(?!(?P=q))[^\n])*)(?P=q)|(?P<bare>[^\s\"'`,;(){{}}\[\]<>]+))")
_LEFT = re.compile(rf"(?P<q>[\"'])(?P<in>[^\"'\n]{{8,}})(?P=q)\s*(?:===?|!==?)\s*{_LABEL}")
_TUPLE = re.compile(r"[(\[]\s*[\"'](?P<label>[A-Za-z_][\w-]*)[\"']\s*,\s*(?P<q>[\"'])(?P<in>[^\"'\n]{4,})(?P=q)\s*[)\]]")
_UNPACK = re.compile(r"(?m)^(?P<names>[ \t]*[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)+)\s*=\s*(?P<values>[^\n=]+)$")
_YAML = re.compile(r"(?m)^(?P<indent>[ \t]*)(?:- )?(?P<label>[A-Za-z_][\w.-]*)[ \t]*:[ \t]*[|>][+-]?\d?[ \t]*\n(?P<body>(?:(?P=indent)[ \t]+[^\n]*\n?|[ \t]*\n)+)")
_MULTI = re.compile(r"(?m)^(?P<indent>[ \t]*)(?P<label>[A-Za-z_][\w.-]*)[ \t]*:[ \t]*(?P<q>[\"'])(?P<in>[^\"']*\n[^\"']*)(?P=q)")
_OPEN = re.compile(rf"(?m){_LABEL}[\"'`]?\s*(?:=|:|=>)\s*(?P<q>[\"'])(?P<in>[^\"'\n]{{6,}})$")


def is_secret_label(label: str) -> bool:
    """Whether a name says that its value is secret: by its words, unless one of them says it is only about a secret."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", label)]
    if not words or words[-1] in _PLAIN or any(w in ("hash", "digest", "checksum", "public", "length", "count") for w in words):
        return False
    return any(w in _SECRET for w in words) or (words[-1] == "key" and any(w in _KEYED for w in words[:-1]))


def is_literal(value: str, quoted: bool) -> bool:
    """Whether a value could be used as it stands. Bare values count with a digit or sign, as plain words are names in code."""
    v = value.strip()
    if len(v) < 4 or _NOT_VALUE.match(v) or (not quoted and _REFERENCE.match(v)):
        return False
    if quoted:
        return not re.fullmatch(r"(?:[A-Z][a-z]+|[a-z]+)(?: [a-z]+){2,}[.!?:]?", v) and not re.fullmatch(r"[A-Z][A-Z0-9_]+", v) and "${" not in v and "{{" not in v
    return bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) and not re.fullmatch(r"\d+(?:\.\d+)*[a-z]{0,2}", v)


def _kept_lines(text: str) -> str:
    return MARK + "\n" * text.count("\n")


def _pair(m: re.Match) -> str:
    label, value = m.group("label").rsplit(".", 1)[-1], m.group("in")
    if not is_secret_label(label):
        return m.group()
    compared = m.group("op") in ("==", "===", "!=", "!==")
    quoted = value is not None
    value = value if quoted else m.group("bare")
    if not is_literal(value, quoted) or (compared and (not quoted or len(value) < 8)):
        return m.group()
    a = m.start("in" if quoted else "bare") - m.start()
    return m.group()[:a] + MARK + m.group()[a + len(value) :]


def _unpack(m: re.Match) -> str:
    names, values = [n.strip() for n in m.group("names").split(",")], re.findall(r"\s*(\"[^\"\n]*\"|'[^'\n]*'|[^,\"'\n]+)(?:,|$)", m.group("values"))
    if len(names) != len(values):
        return m.group()
    out = [v[0] + MARK + v[-1] if is_secret_label(n) and v[:1] in "\"'" and v[:1] and is_literal(v[1:-1], True) else v for n, v in zip(names, (v.strip() for v in values))]
    return m.group() if all(MARK not in v for v in out) else m.group()[: m.start("values") - m.start()] + ", ".join(out)


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of private keys, to their end mark, however far, or over the lines that look like a key's where there is none before the next begin mark."""
    out, pos = [], 0
    while m := _BLOCK.search(text, pos):
        end, nxt = _BLOCK_END.search(text, m.end()), _BLOCK.search(text, m.end())
        stop = end.end() if end and (not nxt or end.start() < nxt.start()) else _KEY_LINE.match(text, m.end()).end()
        out.append((m.start(), stop))
        pos = max(stop, m.end())
    return out


def standalone(text: str) -> str:
    """A text without key blocks and published token forms."""
    out, pos = [], 0
    for a, b in key_blocks(text):
        out += [text[pos:a], _kept_lines(text[a:b])]
        pos = b
    return TOKEN.sub(MARK, "".join([*out, text[pos:]]))


def redact(text: str) -> str:
    """A text without credentials of any family; texts without one come back as they are."""
    if not text:
        return text
    out = standalone(text)
    if not any(c in out for c in "=:(,"):
        return out
    out = _ADDRESS.sub(lambda m: m.group(1) + MARK if is_literal(m.group(2), True) else m.group(), out)
    out = _PARAMETER.sub(lambda m: m.group(1) + MARK if is_literal(m.group(2), True) else m.group(), out)
    out = _HEADER.sub(lambda m: m.group(1) + (m.group(2) or "") + MARK if is_literal(m.group(3), True) else m.group(), out)
    out = _COOKIE.sub(lambda m: m.group(1) + MARK if is_literal(m.group(2), True) else m.group(), out)
    out = _YAML.sub(lambda m: m.group()[: m.start("body") - m.start()] + re.sub(r"\S[^\n]*", MARK, m.group("body")) if is_secret_label(m.group("label")) and MARK not in m.group("body") else m.group(), out)
    out = _MULTI.sub(lambda m: m.group()[: m.start("in") - m.start()] + _kept_lines(m.group("in")) + m.group("q") if is_secret_label(m.group("label")) else m.group(), out)
    out = _UNPACK.sub(_unpack, out)
    out = _PAIR.sub(_pair, out)
    out = _LEFT.sub(lambda m: m.group().replace(m.group("in"), MARK, 1) if is_secret_label(m.group("label").rsplit(".", 1)[-1]) and is_literal(m.group("in"), True) else m.group(), out)
    out = _TUPLE.sub(lambda m: m.group()[: m.start("in") - m.start()] + MARK + m.group()[m.end("in") - m.start() :] if is_secret_label(m.group("label")) and is_literal(m.group("in"), True) else m.group(), out)
    return _OPEN.sub(lambda m: m.group()[: m.start("in") - m.start()] + MARK if is_secret_label(m.group("label")) and is_literal(m.group("in"), True) else m.group(), out)


def contains_secret(text: str) -> bool:
    return bool(text) and redact(text) != text


def sanitized(value):
    """Any JSON value with all its strings redacted; the value of a secret key goes as a whole."""
    if isinstance(value, str):
        return redact(value)
    if isinstance(value, dict):
        return {k: MARK if isinstance(v, str) and is_secret_label(str(k)) and is_literal(v, True) else sanitized(v) for k, v in value.items()}
    return [sanitized(v) for v in value] if isinstance(value, (list, tuple)) else value


@F.pandas_udf(StringType())
def redacted(texts: pd.Series) -> pd.Series:
    """``redact`` over a column; nulls stay."""
    return texts.map(lambda t: redact(t) if t is not None else None)


@F.pandas_udf(BooleanType())
def has_secret(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: contains_secret(t) if t is not None else False)


#: What a cheap look must find before a text is read by Python at all: a sign of a label, a token or a block.
MAY_HOLD = r"(?i)passw|pwd|secret|token|credential|api.?key|apikey|auth|bearer|private key|access.?key|signing.?key|encryption.?key|master.?key|service.?key|client.?key|://[^\s/@]*:[^\s/@]+@|AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|[rs]k_|sk-|npm_|xox|hvs\.|SG\.|eyJ"


def redact_where_needed(rows: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """``rows`` with ``column`` redacted; texts without any sign of a secret never leave the JVM."""
    name = out or column
    hit = F.coalesce(F.col(column).rlike(MAY_HOLD), F.lit(False))
    return rows.filter(hit).withColumn(name, redacted(F.col(column))).unionByName(rows.filter(~hit).withColumn(name, F.col(column)))


def feedback_note(text: Column) -> Column:
    """A note of a feedback record without label values, token forms and addresses' passwords; built-ins alone."""
    out = F.regexp_replace(text, r"(?i)\b((?:api[_-]?key|token|secret|password|passwd|pwd)\s*[:=]\s*)\S+", "$1[REDACTED]")
    out = F.regexp_replace(out, r"(?i)\b(bearer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1[REDACTED]")
    out = F.regexp_replace(out, r"(://[^\s:/@]*:)[^\s/@]+@", "$1[REDACTED]@")
    return F.regexp_replace(out, r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,})", "[REDACTED]")


def indexable(contents: DataFrame) -> DataFrame:
    """(root_id, rel_path, outcome, content): ``kept`` as it is, ``redacted`` with the same lines, or ``refused`` (null content) for a secret file by its name or a text with null signs."""
    from codelode.functions.privacy import secret_path

    rows = contents.filter("root_id is not null and rel_path is not null and content is not null").select("root_id", "rel_path", "content")
    bad = secret_path(F.col("rel_path")) | F.col("content").contains("\x00")
    out = redact_where_needed(rows.filter(~bad), "content", "_r")
    outcome = F.when(F.col("_r") == F.col("content"), "kept").otherwise("redacted")
    return out.select("root_id", "rel_path", outcome.alias("outcome"), F.col("_r").alias("content")).unionByName(rows.filter(bad).select("root_id", "rel_path", F.lit("refused").alias("outcome"), F.lit(None).cast("string").alias("content")))


def visible(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files without an ignored part in their path, and the symbols of those files."""
    from codelode.functions.privacy import ignored_path

    kept = files.filter(F.col("rel_path").isNotNull() & ~ignored_path(F.col("rel_path")))
    return kept, symbols.join(kept.select("file_id").distinct(), "file_id", "left_semi")


def batches_redacted(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Arrow batches with every named column redacted, for sinks that write what they are given."""
    for b in batches:
        for c in columns:
            b[c] = b[c].map(lambda t: redact(t) if isinstance(t, str) else t)
        yield b

"""Problem 2: generated, minified, compiled, vendored and data files among sources.

Character trigram models of identifiers are trained for each language on all
texts, and one of the words of paths on all paths. A file is then measured:

* *mangled*: its names cost far more bits a character than hand-written ones do;
* *template*: its names, or its lines with literals folded, are of few kinds -
  data kept as code, dumps, locks, compiler output; or a comment says what tool wrote it;
  Kinds of names are counted over ``WINDOW`` names at a time, as in longer files names return more often;
* *foreign*: it carries another project's notice, or names foreign to the path
  model in a folder for copies, or its body lies in several roots, or its names, in whatever
  language, are foreign to the models of all languages and to that of the root's other files.

The models are tables of at most ``ALPHABET`` ** 3 counts a language, so their
size does not grow with the data; the counts cover all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.joins import salted_join

#: Signs a name is folded to: letters, 0, _, $, ? and the two ends.
ALPHABET = 32
#: Bits a character above which names are mangled; share of short names needed besides.
MANGLED_BITS, SHORT_SHARE = 3.2, 0.35
#: Distinct names from which a file's cross-entropy is judged in every language, and bits above which it is foreign
#: to the root besides (sf0.1: at most 3.4 in hand-written files, at least 3.5 in minified ones); least trigrams of a root's model.
STRANGE_NAMES, ROOT_BITS, ROOT_GRAMS = 30, 3.6, 2000
#: Names of a window, and the share of distinct ones under which a file is a template (sf0.1: hand-written ones have 0.23 and more, dumps 0.04).
WINDOW, LOW_DIVERSITY = 100, 0.12
#: Different names a task holds before it spells them out, and costs a model remembers.
HELD_NAMES, MEMO = 200_000, 200_000
#: Buckets of roots and parts a root's strange files are split into.
ROOT_BUCKETS, PARTS = 65_536, 16
#: First comment lines, in which a notice in any words counts.
HEAD = 12
#: Bits a character above which a path word is foreign.
FOREIGN_BITS = 2.6
#: Least non-space characters of a data block, and the largest share of them in names.
DATA_SIZE, NAME_SHARE = 350, 0.08
#: Lines from which a text of one line form is a dump, and the largest share of distinct forms.
DUMP_LINES, FORM_SHARE = 15, 0.1

_LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "json": "json",
    "map": "json", "sql": "sql", "yaml": "yaml", "yml": "yaml", "xml": "xml", "css": "css", "sh": "shell",
}
_PROSE = (".md", ".rst", ".txt", ".adoc")
_CODE = frozenset("python javascript typescript go java sql css".split())
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"\b\d[\w.]*")
_COMMENT = re.compile(r"^[ \t]*(?:#(?!!)|//|--|/\*+|\*|<!--|;)[ \t!]*(.*?)[ \t]*(?:\*/|-->)?[ \t]*$", re.M)
_BLOCK = re.compile(r"/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|'''.*?'''", re.S)

# How tools mark what they wrote, in several languages, and what notices of other projects say.
_MADE = re.compile(
    r"(?i)^\W*@generated\b|<auto-?generated\b|^\W*auto-?\s?generated\b(?!.{0,12}\b(?:files|code) (?:are|is)\b)|\b(?:code|file|source)\b.{0,20}\bgenerated (?:by|from|with|using)\b.{0,60}|"
    r"\bgenerated (?:automatically )?by\b.{0,60}\b(?:do not|don't|never) (?:edit|modify|change)|\b(?:produced|created|written|built) automatically (?:from|by|with)\b|\bmachine[- ](?:made|generated|written) (?:by|from|with)\b|"
    r"\bchanges will be (?:lost|overwritten)\b|automatisch (?:erzeugt|generiert|erstellt) (?:mit|von|aus)\b|g[ée]n[ée]r[ée] (?:automatiquement |)(?:par|avec)\b|generado (?:autom[áa]ticamente |)(?:por|con)\b|"
    r"generato (?:automaticamente |)da\b|自動生成|自动生成|\bthis (?:file|code) (?:is|was) (?:auto-?\s?)?generated\b"
)
_THEIRS = re.compile(
    r"(?i)\bcopied (?:verbatim |unchanged )?from\b|\bvendored from\b|^\W*upstream\s*[:=]|\bupstream (?:revision|version|commit)\b|\bcopyright\b.{0,60}\b(?:project|authors|contributors|foundation|inc)\b|"
    r"\(c\) the \w+ (?:project|authors|contributors|team)|\breleased under the .{0,30}\b(?:terms|licen[sc]e)\b|\bredistribution and use in source\b|\bpermission is hereby granted\b|\blicensed under the (?:apache|mit|bsd|mozilla|gnu|isc)\b"
)
# A notice in itself, where the pattern above also takes mentions: it begins the comment and goes on as notices do.
_NOTICE = re.compile(
    r"(?i)^\W*(?:(?:copied (?:verbatim |unchanged )?|vendored )from\b|upstream\s*[:=]|upstream (?:revision|version|commit)\s*[:=]?\s*v?[\da-f]|(?:copyright\b|\(c\)).{0,60}\b(?:project|authors|contributors|foundation|team|inc)\b|"
    r"released under the .{0,30}\b(?:terms|licen[sc]e)\b|redistribution and use in source\b|permission is hereby granted\b|licensed under the (?:apache|mit|bsd|mozilla|gnu|isc)\b)"
)
_PLAIN_BLOCK = re.compile(r"^[ \t]*(?:/\*|<!--)(.*?)(?:\*/|-->)", re.S | re.M)
_COPY_FOLDER = re.compile(r"(?:^|/)(?:_?vendor(?:ed)?|_vendored|third[_-]?party|node_modules|bower_components|external|externals|extern|deps|Pods|Carthage|site-packages|jspm_packages|Godeps)/(.+)$")
_LOCK_NAME = re.compile(r"(?i)(?:^|/)(?:[\w.-]*lock[\w.-]*\.(?:json|ya?ml|toml)|npm-shrinkwrap\.json|yarn\.lock|go\.sum|cargo\.lock|poetry\.lock|[\w.-]+\.lock)$")


def language_of(path: str) -> str:
    return _LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "other") if "." in path else "other"


def fold(name: str) -> str:
    """A name as signs of the models' alphabet, with both ends."""
    return "^^" + re.sub(r"[^a-z0_$]", "?", re.sub(r"\d", "0", name.lower())) + "."


def names(text: str) -> list[str]:
    """The names of a text outside comments, strings and numbers, in order."""
    return _NAME.findall(_NUMBER.sub(" ", _STRING.sub(" ", _COMMENT.sub("", _BLOCK.sub(" ", text)))))


def path_words(path: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", path) if len(w) > 2]


def own_part(path: str) -> str:
    """A path up to and with its first folder for copies."""
    m = _COPY_FOLDER.search(path)
    return path[: m.start(1)] if m else path


def _counts(contents: DataFrame) -> DataFrame:
    """(language, gram, n): trigrams of each file's distinct names, and of its path's words under language ``path``.

    What lies below a folder for copies is left out of the path model, so that no
    copied project, however many rows it has, teaches the model its own name.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        words: Counter = Counter()

        def spell() -> None:
            for (lang, w), n in words.items():
                f = fold(w)
                for i in range(len(f) - 2):
                    total[lang, f[i : i + 3]] += n
            words.clear()

        for b in batches:
            for path, text in zip(b["rel_path"], b["content"]):
                words.update([(language_of(path), w) for w in set(names(text))])
                words.update([("path", w) for w in set(path_words(own_part(path)))])
            if len(words) > HELD_NAMES:
                spell()
        spell()
        yield pd.DataFrame([(a, g, n) for (a, g), n in total.items()], columns=["language", "gram", "n"])

    return contents.mapInPandas(work, "language string, gram string, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))


class Trigrams:
    """Bits of names under one language's counts, smoothed by half a count for each sign."""

    def __init__(self, grams: dict[str, int]):
        pre: Counter = Counter()
        for g, n in grams.items():
            pre[g[:2]] += n
        self.none = math.log2(ALPHABET)
        self.bits = {g: -math.log2((n + 0.5) / (pre[g[:2]] + 0.5 * ALPHABET)) for g, n in grams.items()}
        self.rest = {p: -math.log2(0.5 / (n + 0.5 * ALPHABET)) for p, n in pre.items()}
        self.known: dict[str, float] = {}

    def cost(self, name: str) -> float:
        """Mean bits a sign of a name; remembered, as files share most of their names."""
        got = self.known.get(name)
        if got is None:
            if len(self.known) > MEMO:
                self.known.clear()
            got = self.known[name] = self._cost(name)
        return got

    def _cost(self, name: str) -> float:
        f = fold(name)
        return sum(self.bits.get(f[i : i + 3]) or self.rest.get(f[i : i + 2], self.none) for i in range(len(f) - 2)) / (len(f) - 2)


def diversity(found: list[str]) -> float:
    """Mean share of distinct names in the windows of ``WINDOW`` names, half of it apart; 1 for shorter files, where it says nothing."""
    shares = [len(set(found[i : i + WINDOW])) / WINDOW for i in range(0, len(found) - WINDOW + 1, WINDOW // 2)]
    return sum(shares) / len(shares) if shares else 1.0


def is_noticed(notes: list[str], text: str) -> bool:
    """Whether the comments hold another project's notice: in their first ``HEAD`` lines in any words, further down or
    inside a block comment without signs of its own as a line that is a notice itself, not a mention."""
    if any(_THEIRS.search(n) for n in notes[:HEAD]) or any(_NOTICE.search(n) for n in notes[HEAD:]):
        return True
    return any(_NOTICE.search(ln) for m in _PLAIN_BLOCK.finditer(text) for ln in m.group(1).splitlines())


def is_strange(distinct: set[str], bits: float, models: dict[str, Trigrams]) -> bool:
    """Whether a file's names are foreign to its language and to every other, prose included: a text in another language
    than its name says, or prose outside comments, has names of that kind. Files of few names say nothing."""
    if len(distinct) < STRANGE_NAMES or bits <= MANGLED_BITS:
        return False
    return all(sum(map(m.cost, distinct)) / len(distinct) > MANGLED_BITS for lang, m in models.items() if lang != "path")


def train(contents: DataFrame) -> dict[str, Trigrams]:
    """The models of all languages of ``contents``; what comes to the driver is bounded by the alphabet."""
    tables: dict[str, dict[str, int]] = {}
    for r in _counts(contents).toLocalIterator():
        tables.setdefault(r.language, {})[r.gram] = r.n
    return {lang: Trigrams(t) for lang, t in tables.items()}


def measure(path: str, text: str, models: dict[str, Trigrams]) -> dict:
    """The measures of one file and the reason why it is not hand-written, or none."""
    lang = language_of(path)
    own, pathm = models.get(lang), models.get("path")
    found = names(text)
    distinct = set(found)
    solid = sum(map(len, text.split()))
    bits = sum(own.cost(n) for n in distinct) / len(distinct) if own and distinct else 0.0
    short = sum(len(n) <= 2 for n in found) / len(found) if found else 0.0
    variety = diversity(found)
    share = sum(map(len, found)) / solid if solid else 1.0
    lines = [ln for ln in text.splitlines() if ln.strip()]
    longest = max(map(len, lines), default=0)
    forms = {_NUMBER.sub("0", _STRING.sub("s", ln.strip())) for ln in lines}
    form_share = len(forms) / len(lines) if lines else 1.0
    serial = sum(bool(re.search(r"_\d+$", n)) for n in found) / len(found) if found else 0.0
    notes = [m.group(1) for m in _COMMENT.finditer(text)]
    foreign = 0.0
    if pathm and (m := _COPY_FOLDER.search(path)):
        foreign = max((pathm.cost(w) for w in path_words(m.group(1))), default=0.0)
    reason = None
    prose = path.lower().endswith(_PROSE)
    if prose:
        notes = []
    if any(_MADE.search(n) for n in notes):
        reason = "generated"
    elif not prose and is_noticed(notes, text):
        reason = "vendored"
    elif foreign > FOREIGN_BITS:
        reason = "vendored"
    elif lang == "json" and re.search(r"\"mappings\"\s*:\s*\"", text) and re.search(r"\"(?:sources|version)\"\s*:", text):
        reason = "source map"
    elif _LOCK_NAME.search(path) and re.search(r"(?i)lockfileVersion|integrity|resolved|checksum|\bsha\d+[-:]", text):
        reason = "lock"
    elif lang in ("javascript", "css") and bits > MANGLED_BITS and short > SHORT_SHARE and longest > 200:
        reason = "minified"
    elif lang in ("javascript", "typescript") and (re.search(r"__esModule|//# sourceMappingURL=", text) and (serial > 0.1 or "sourceMappingURL" in text)):
        reason = "compiled"
    elif lang in _CODE and solid >= DATA_SIZE and share < NAME_SHARE and not any(len(n.split()) > 5 for n in notes):
        reason = "data"
    elif lang in _CODE and len(lines) >= DUMP_LINES and form_share < FORM_SHARE:
        reason = "data"
    elif lang in _CODE and variety < LOW_DIVERSITY:
        reason = "generated"
    strange = " ".join(sorted(distinct)) if reason is None and lang in _CODE and is_strange(distinct, bits, models) else None
    return {"strange": strange, "diversity": variety, "bits": bits, "short": short, "name_share": share, "form_share": form_share, "serial": serial, "foreign_bits": foreign, "longest": longest, "reason": reason}


def body(text: str) -> str:
    """A text without its first comments, blank lines and white space: what copies have in common."""
    lines = text.replace("\r", "").split("\n")
    i = 0
    while i < len(lines) and (not lines[i].strip() or _COMMENT.match(lines[i])):
        i += 1
    return "".join("".join(lines[i:]).split())


_MEASURES = "strange string, diversity double, bits double, short double, name_share double, form_share double, serial double, foreign_bits double, longest int, reason string"


def _rows(contents: DataFrame) -> DataFrame:
    return contents.select("file_id", "root_id", "rel_path", "content").filter(F.col("content").isNotNull() & F.col("rel_path").isNotNull())


def provenance(contents: DataFrame, models: dict[str, Trigrams] | None = None) -> DataFrame:
    """(file_id, root_id, rel_path, measures, reason) of each row of ``contents``.

    ``reason`` is null for hand-written files, else generated, vendored, source
    map, lock, minified, compiled or data; ``not_handwritten`` adds foreign. A body of code that lies in more than
    one root under different paths is vendored, whatever its names. ``strange`` has the distinct names
    of a file without a reason whose names are foreign to its language, for ``foreign_to_root``. Rows with a null
    path or text have no result; empty texts are hand-written.
    """
    rows = _rows(contents)
    models = models or train(rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            got = []
            for fid, root, path, text in zip(b["file_id"], b["root_id"], b["rel_path"], b["content"]):
                core = body(text) if language_of(path) in _CODE else ""
                digest = xxhash.xxh3_128_hexdigest(core) if len(core) >= 200 else None
                got.append({"file_id": fid, "root_id": root, "rel_path": path, "body": digest, **measure(path, text, models)})
            yield pd.DataFrame(got, columns=["file_id", "root_id", "rel_path", "body", *_names])

    _names = [x.split()[0] for x in _MEASURES.split(", ")]
    files = rows.mapInPandas(work, f"file_id string, root_id string, rel_path string, body string, {_MEASURES}")
    return files


def copies(files: DataFrame) -> DataFrame:
    """Bodies in more than one root: (body). Two minima tell it, so a body in a third of all rows costs no more."""
    return (
        files.filter(F.col("body").isNotNull()).groupBy("body").agg(F.min("root_id").alias("a"), F.max("root_id").alias("b")).filter(F.col("a") < F.col("b")).select("body")
    )


def _bucket():
    return F.pmod(F.xxhash64("root_id"), F.lit(ROOT_BUCKETS)).cast("int")


def _root_counts(contents: DataFrame, models: dict[str, Trigrams], buckets: frozenset) -> DataFrame:
    """(root_id, gram, n): trigrams of the names of the code files of the roots in ``buckets``; strange files are left out, so that
    they do not teach a root their own names."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def flush():
            return pd.DataFrame([(r, g, n) for (r, g), n in total.items()], columns=["root_id", "gram", "n"])

        for b in batches:
            for root, path, text, bucket in zip(b["root_id"], b["rel_path"], b["content"], b["bucket"]):
                lang = language_of(path)
                if bucket not in buckets or lang not in _CODE or lang not in models:
                    continue
                words = set(names(text))
                if words and is_strange(words, sum(map(models[lang].cost, words)) / len(words), models):
                    continue
                for w in words:
                    f = fold(w)
                    for i in range(len(f) - 2):
                        total[root, f[i : i + 3]] += 1
            if len(total) > 200_000:
                yield flush()
                total.clear()
        yield flush()

    rows = contents.filter(F.col("root_id").isNotNull()).select("root_id", "rel_path", "content", _bucket().alias("bucket"))
    return rows.mapInPandas(work, "root_id string, gram string, n bigint").groupBy("root_id", "gram").agg(F.sum("n").alias("n"))


def _judge(key, files: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
    ids = []
    if len(files) and int(grams["n"].sum()) >= ROOT_GRAMS:
        model = Trigrams(dict(zip(grams["gram"], grams["n"])))
        for fid, words in zip(files["file_id"], files["strange"].str.split(" ")):
            if sum(map(model.cost, words)) / len(words) > ROOT_BITS:
                ids.append(fid)
    return pd.DataFrame({"file_id": pd.Series(ids, dtype="object")})


def foreign_to_root(files: DataFrame, contents: DataFrame, models: dict[str, Trigrams]) -> DataFrame:
    """(file_id): strange files of ``files`` whose names are foreign to the other files of their root as well. Roots of few
    names have no say. A root's files are judged in ``PARTS`` parts; only numbers of buckets come to the driver."""
    strange = files.filter(F.col("strange").isNotNull() & F.col("root_id").isNotNull())
    buckets = frozenset(r.bucket for r in strange.select(_bucket().alias("bucket")).distinct().collect())
    if not buckets:
        return files.select("file_id").limit(0)
    grams = _root_counts(_rows(contents), models, buckets).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    own = strange.select("root_id", F.pmod(F.xxhash64("file_id"), F.lit(PARTS)).cast("int").alias("part"), "file_id", "strange")
    return own.groupBy("root_id", "part").cogroup(grams.groupBy("root_id", "part")).applyInPandas(_judge, "file_id string")


def not_handwritten(contents: DataFrame) -> DataFrame:
    """(file_id, reason) of the files that were not written by hand there, one row for each file and reason."""
    from codelode.session import cut

    models = train(_rows(contents))
    files = cut(provenance(contents, models).select("file_id", "root_id", "body", "reason", "strange"))
    marked = files.filter(F.col("reason").isNotNull()).select("file_id", "reason")
    copied = salted_join(files.filter(F.col("reason").isNull() & F.col("body").isNotNull()), copies(files), ["body"], ["file_id"]).select("file_id", F.lit("vendored").alias("reason"))
    foreign = foreign_to_root(files, contents, models).select("file_id", F.lit("foreign").alias("reason"))
    return marked.unionByName(copied).unionByName(foreign).distinct()

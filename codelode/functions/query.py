"""What a query in plain words asks for: terms, intent, exclusions, code names, files it names.

A query is one literal, so it is parsed once on the driver; ``terms_of`` and
``body_words`` are the same splitting as column expressions, for the texts searched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking contract: words that say nothing of a place, words that ask for something, and inflections.
STOPWORDS = frozenset(
    "being been was were when which who whom whose what why their they them there these those this that than into its our your we you us his her she he but if so "
    "should would could can will has have had does did also very just several various multiple many some instead despite potential potentially possible possibly properly correctly directly "
    "already always never now still even again via unnecessary unnecessarily actually currently a an and are as at be by for from how in is it of on or the to with".split()
)
CONCEPT = frozenset("overview explain spec design plan docs doc research concept".split())
EDIT = frozenset("edit fix implement change wire build debug update".split())
ACTION = EDIT | frozenset(
    "fixes fixed add adds added remove removes removed updates updated support supports allow allows make makes improve improves refactor feat perf replace replaces replaced replacing "
    "rename renames renamed renaming move moves moved moving avoid avoids avoided avoiding ensure ensures ensured ensuring prevent prevents prevented preventing introduce introduces introduced introducing "
    "use uses used using simplify simplifies simplified simplifying".split()
)
TESTS = frozenset("test tests testing pytest vitest jest spec".split())
MIGRATIONS = frozenset("migration migrations alembic schema".split())
PLUMBING = frozenset("github workflow workflows ci action actions template templates vendor vendored contributing contributor contributors codeowners minified bundle funding security".split())
CONTROL = frozenset("without touching changing editing modifying exclude excluded excluding except not don".split())
INFLECTIONS = ("s", "es", "d", "ed", "r", "er", "ers", "ing", "ings")
#: Endings of names of files a query may write out.
FILE_ENDINGS = frozenset(
    "py js mjs cjs jsx ts mts cts tsx go rs java kt kts cs php swift rb scala groovy gvy gradle c h cc cpp cxx hh hpp hxx sh bash ps1 psm1 lua pl pm dart m mm zig ex exs hs ml mli r jl sol f90 f95 f03 f08 pas pp dpr lpr "
    "vue svelte html htm css scss sass less sql tf hcl json jsonc yaml yml toml xml md mdx pdf docx xlsx pptx svg".split()
)
#: Most terms of a headline that decide its intent; terms from which keyword lists are fused in; terms from which the boost grows.
HEADLINE_TERMS, FUSE_TERMS, LONG_QUERY = 24, 20, 24

_CJK = "々〇ぁ-ゟ゠-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ가-힯"
_WORD = re.compile(f"[A-Za-z0-9]+|[{_CJK}]+")
_CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
_SCOPE = re.compile(r"""\b(without(?:\s+(?:touching|changing|editing|modifying))?|exclude(?:d|ing)?)\s*:?\s*("[^"]+"|'[^']+'|[^,;.!?]+)""", re.I)
_NEXT_CLAUSE = re.compile(r"\s+(?:but|while|when|then|so|to|from)\b|\s+and\s+(?=(?:edit|fix|implement|change|wire|build|debug|update|touch|modify)\w*\b)", re.I)
_ENDING = re.compile(r"(?<=\w)\.([A-Za-z0-9]+)\b")
_MENTION = re.compile(r"\w[\w.\-]*(?:[/\\][\w.\-]+)*")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def words(text: str) -> list[str]:
    """The lower-case words of a text and their camel-case parts, each once in order; stopwords and single signs left out."""
    found: dict[str, None] = {}
    for run in _WORD.findall(re.sub("[_/-]", " ", text)):
        for w in (run, *re.split(_CAMEL, run)):
            if len(w) > 1 and w.lower() not in STOPWORDS:
                found.setdefault(w.lower())
    return list(found)


def pairs(run: str) -> list[str]:
    """Overlapping pairs of signs of a run written without spaces; one sign stands for itself."""
    return [run[i : i + 2] for i in range(max(1, len(run) - 1))]


def excluded(text: str) -> list[str]:
    """The words of what a query asks to leave out: quoted as a whole, else up to the next clause. 'Do not exclude' excludes nothing."""
    out: dict[str, None] = {}
    for m in _SCOPE.finditer(text):
        if m.group(1).lower().startswith("exclude") and re.search(r"(?i)(?:\bdo\s+not|\bdon't)\s*$", text[: m.start()]):
            continue
        scope = m.group(2).strip()
        scope = scope.strip("\"' \t") if scope[:1] in "\"'" else _NEXT_CLAUSE.split(scope, maxsplit=1)[0]
        out.update(dict.fromkeys(w for w in words(scope) if w not in CONTROL))
    return list(out)


def without_endings(text: str) -> str:
    """A text without the endings of the file names in it."""
    return _ENDING.sub(lambda m: "" if m.group(1).lower() in FILE_ENDINGS else m.group(), text)


def query_terms(text: str) -> list[str]:
    """The words a query asks for: not those it excludes, nor endings of file names."""
    out = set(excluded(text)) | CONTROL
    return [w for w in words(without_endings(text)) if w not in out]


def headline(text: str, limit: int = 300) -> str:
    """The first line that is not blank, stripped and cut."""
    return next((ln.strip() for ln in text.splitlines() if ln.strip()), "")[:limit]


def intent_terms(text: str) -> list[str]:
    """The first terms of the headline; only they decide what is wanted."""
    return query_terms(next((ln for ln in text.splitlines() if ln.strip()), ""))[:HEADLINE_TERMS]


def place_terms(terms: list[str]) -> list[str]:
    """Terms that can say where something is; all of them where only actions remain."""
    return [t for t in terms if t not in ACTION] or terms


def code_names(text: str) -> list[str]:
    """Names a query writes as code: those between back-ticks first, then words with an inner underscore or hump."""
    ticked = [n for span in re.findall(r"`([^`]*)`", text) for n in _NAME.findall(span)]
    shaped = [n for n in _NAME.findall(text) if "_" in n.strip("_") or re.search("[a-z][A-Z]", n)]
    return list(dict.fromkeys(ticked + shaped))


def named_identifiers(text: str) -> set[str]:
    """The last parts of dotted names between back-ticks and all names of three signs and more shaped like code."""
    ticked = {m.split(".")[-1] for m in re.findall(r"`([A-Za-z_][\w.]*)(?:\(\))?`", text)}
    return ticked | {n for n in _NAME.findall(text) if len(n) > 2 and ("_" in n.strip("_") or re.search("[a-z][A-Z]", n))}


def mentions(text: str) -> list[str]:
    """Words a query writes with a slash or a dot, with forward slashes, each once."""
    found = [m.replace("\\", "/").rstrip(".-") for m in _MENTION.findall(text or "")]
    return [m for m in dict.fromkeys(found) if "/" in m or "." in m]


def is_file_name(word: str) -> bool:
    stem, dot, end = word.rpartition(".")
    return bool(stem and dot and end.lower() in FILE_ENDINGS)


def whole_name(text: str) -> str | None:
    """The lower-case name if the whole query is one file name or path suffix, else None."""
    name = (text or "").strip().replace("\\", "/").removeprefix("./").rstrip(".-").lower()
    return name if name and _MENTION.fullmatch(name) else None


@dataclass(frozen=True)
class Query:
    """A parsed query."""

    text: str
    terms: list[str] = field(init=False)
    intent: frozenset = field(init=False)
    excluded: list[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "terms", query_terms(self.text))
        object.__setattr__(self, "intent", frozenset(intent_terms(self.text)))
        object.__setattr__(self, "excluded", excluded(self.text))

    @property
    def edits(self) -> bool:
        """A task is a change unless it asks to explain or survey."""
        return bool(self.intent & EDIT) or not self.intent & CONCEPT

    @property
    def explains(self) -> bool:
        return bool(self.intent & CONCEPT) and not self.edits

    @property
    def tests(self) -> bool:
        return bool(self.intent & TESTS)

    @property
    def scale(self) -> float:
        """What the keyword boost of a long query is multiplied by, so that sums over its terms do not drown it."""
        return max(1.0, 1 + 4 * (len(self.terms) - LONG_QUERY) / LONG_QUERY)

    @property
    def fuses(self) -> bool:
        return len(set(self.terms)) >= FUSE_TERMS


def matches(token: Column, term: str) -> Column:
    """Whether a token is a term or, from four signs on, differs from it by an inflection only; e and y at a stem's end may go or turn."""
    out = token == term
    if len(term) < 4:
        return out
    forms = []
    for stem in [term] + ([term[:-1]] if term.endswith("e") else [term[:-1] + "i"] if term.endswith("y") else []):
        forms += [stem + x for x in INFLECTIONS if len(stem + x) >= len(term)]
    # the token as the shorter word: which stems would give the term
    for x in INFLECTIONS:
        if term.endswith(x) and len(term) > len(x):
            stem = term[: -len(x)]
            forms += [w for w in (stem, stem + "e", stem[:-1] + "y" if stem.endswith("i") else stem) if 4 <= len(w) <= len(term)]
    return out | token.isin(*sorted(set(forms) - {term})) if forms else out


def terms_of(text: Column) -> Column:
    """The set form of ``words`` for labels and paths: lower-case runs and their camel-case parts, each once, in order."""
    runs = F.regexp_extract_all(text, F.lit(f"([A-Za-z0-9]+|[{_CJK}]+)"), 1)
    parts = F.flatten(F.transform(runs, lambda r: F.concat(F.array(F.lower(r)), F.split(F.lower(F.regexp_replace(r, _CAMEL, " ")), " "))))
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 2) & ~w.isin(*sorted(STOPWORDS))))


def body_words(text: Column) -> Column:
    """The words of a text with repeats: camel-case parts, lower case, two signs and more, no plain numbers."""
    runs = F.split(F.lower(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")), " ")
    return F.filter(runs, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, repeats kept: what a full-text column holds."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")

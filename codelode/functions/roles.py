"""What a path tells of a file's role, as column expressions over built-ins.

The word lists and patterns are fixed values of the ranking contract; each predicate is one pattern over
the path, so it is pushed into generated code and can be said in SQL with the same text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names (exact, or in any case) and file names that mark a role.
DOC_FOLDERS = ("docs", "doc", "spec", "specs", "design", "designs", ".claude", ".codex", ".superpowers", "superpowers")
MIGRATION_FOLDERS = ("migrations", "migration", "versions", "alembic")
RETIRED_FOLDERS = ("archive", "archived", "legacy", "deprecated", "old", "attic", "graveyard")
SUPPORT_FOLDERS = ("examples", "example", "samples", "sample", "bench", "benches", "benchmarks", "benchmark", "vendor", "third_party", "node_modules")
TEMPLATE_FOLDERS = (".github", ".gitlab", ".circleci")
VENDORED_FOLDERS = ("vendor", "vendored", "_vendor", "extern", "externals", "third_party", "thirdparty", "third-party")
TEST_FOLDERS = ("tests", "test", "__tests__", "testdata", "testing")
BUNDLE_ENDINGS = (".min.js", ".min.css", ".min.mjs", "-min.js", ".bundle.js")
META_STEMS = ("contributing", "code_of_conduct", "security", "support", "funding", "codeowners", "authors", "contributors", "maintainers")
META_ENDINGS = (".md", ".rst", ".txt", ".adoc", ".yml", ".yaml")
SOURCE_ENDINGS = (
    "py ts tsx mts cts js jsx mjs cjs go rs java kt cs php swift rb scala groovy gvy c h cc cpp cxx hh hpp hxx sh bash ps1 psm1 lua pl pm dart m zig "
    "ex exs hs ml mli r jl sol f90 f95 f03 f08 pas pp dpr lpr vue svelte"
).split()
TEST_NAMES = (
    r"^test_.+", r"^tests?\.py$", r"^conftest\.py$", r"_test\.(py|go|rs|rb|exs?)$", r"_spec\.rb$", r"\.(test|spec)\.[cm]?[jt]sx?$", r"^Test[A-Z]\w*\.(java|kt|cs|scala)$",
    r"[a-z0-9](Test|Tests|IT|Spec)\.(java|kt|cs|scala)$", r"^test_.*\.[ch](pp|xx)?$", r"_test\.[ch](pp|xx)?$", r"_unittest\.cc$", r"^Test[A-Z]\w*\.swift$", r"[a-z0-9](Test|Tests|IT|Spec)\.swift$",
    r"\.bats$", r"^test_.*\.sh$", r"_test\.sh$", r"\.Tests\.ps1$", r"_spec\.lua$", r"^test_.*\.lua$", r"_test\.lua$", r"\.t$", r"_test\.dart$", r"[A-Za-z0-9](Test|Tests)\.m$", r"_test\.zig$",
    r"^test_.*\.zig$", r"(Spec|Test)\.hs$", r"_test\.ml$", r"^test[-_].+\.[Rr]$", r"^runtests\.jl$", r"\.t\.sol$", r"\.test\.sol$", r"_test\.(f90|f95|f03|f08)$", r"^Test[A-Z]\w*\.pas$", r"^Test\.pas$", r"[A-Za-z0-9](Test|Tests)\.pas$",
)


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in ".+*?()[]{}|^$\\" else c for c in word)


def _folder(words: tuple[str, ...], any_case: bool, last: bool = False) -> str:
    """A pattern for paths with one of the folders; with ``last`` the file name itself counts as well."""
    return ("(?i)" if any_case else "") + "(^|/)(" + "|".join(map(_quoted, words)) + ")" + ("(/|$)" if last else "/")


DOC_FOLDER, DOC_NAME, DOC_TEXT = _folder(DOC_FOLDERS, False, True), r"(?i)(^|/)readme\.mdx?$", r"(?i)(plan|spec|design|doc).*\.(md|mdx|rst|txt)$"
TEST_FOLDER = _folder(TEST_FOLDERS, True)
#: Name patterns carried over to whole paths: a beginning is that of the last part.
TEST_NAME = "|".join("(^|/)" + p[1:].replace(".+", "[^/]+").replace(".*", "[^/]*") if p.startswith("^") else p for p in TEST_NAMES)
TEST_NAME = TEST_NAME.replace("(^|/)test_[^/]+", "(^|/)test_[^/]+$", 1)
MIGRATION_FOLDER, MIGRATION_NAME = _folder(MIGRATION_FOLDERS, False, True), r"(?i)(^|/)migration_[^/]*$"
RETIRED = _folder(RETIRED_FOLDERS, True, True)
SUPPORT = _folder(SUPPORT_FOLDERS, True)
NOISE_FOLDER = _folder(TEMPLATE_FOLDERS + VENDORED_FOLDERS, True)
BUNDLE = "(?i)(" + "|".join(map(_quoted, BUNDLE_ENDINGS)) + ")$"
META = "(?i)(^|/)(" + "|".join(META_STEMS) + ")(" + "|".join(map(_quoted, META_ENDINGS)) + ")?$"
SOURCE = r"(?i)[^/.][^/]*\.(" + "|".join(SOURCE_ENDINGS) + ")$"
SETTINGS = r"(?i)\.(sql|toml|json|yaml|yml)$"
NO_SURFACE = r"(?i)^(package\.json|pyproject\.toml|readme\.md|agents\.md|claude\.md)$"


def is_doc(p: Column) -> Column:
    """Documents and plans: by folder, as a read-me, or a text whose path speaks of plans, specifications, designs or documents."""
    return p.rlike(DOC_FOLDER) | p.rlike(DOC_NAME) | p.rlike(DOC_TEXT)


def is_test(p: Column) -> Column:
    """Tests, by a folder above the file or by the file's name."""
    return p.rlike(TEST_FOLDER) | p.rlike(TEST_NAME)


def is_migration(p: Column) -> Column:
    return p.rlike(MIGRATION_FOLDER) | p.rlike(MIGRATION_NAME)


def is_retired(p: Column) -> Column:
    return p.rlike(RETIRED)


def is_supporting(p: Column) -> Column:
    """Examples, benchmarks and copies that ship with the product."""
    return p.rlike(SUPPORT)


def is_bundle(p: Column, minified: Column | None = None) -> Column:
    """Built output, by name or by the ``minified`` flag of its content."""
    named = p.rlike(BUNDLE)
    return named if minified is None else named | F.coalesce(minified, F.lit(False))


def is_noise(p: Column, minified: Column | None = None) -> Column:
    """Templates, copied code, bundles and the project's own meta files."""
    return p.rlike(NOISE_FOLDER) | is_bundle(p, minified) | p.rlike(META)


def is_source(p: Column) -> Column:
    """Product code: a source ending and none of the other roles."""
    return p.rlike(SOURCE) & ~(is_doc(p) | is_migration(p) | is_test(p) | is_retired(p) | is_supporting(p))


def is_edit_surface(p: Column, minified: Column | None = None) -> Column:
    """What a task is likely to edit: product code or settings, but no manifest at the top."""
    return ~(is_doc(p) | is_test(p) | is_bundle(p, minified) | p.rlike(NO_SURFACE)) & (is_source(p) | p.rlike(SETTINGS))


def path_factor(p: Column) -> Column:
    """What a file's keyword rank is multiplied by: tests, documents and examples 0.3, package initialisers 0.5, else 1."""
    low = is_test(p) | is_doc(p) | F.lower(p).rlike(r"(^|/)examples?(/|$)")
    return F.when(low, 0.3).when(p.rlike(r"(^|/)__init__\.py$"), 0.5).otherwise(1.0)


def segments(p: Column) -> Column:
    """The parts of a path."""
    return F.filter(F.split(p, "/"), lambda x: x != "")

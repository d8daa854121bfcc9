"""What version control tells of a folder, by its command line on the driver: small lists that become filters or rows.

Outside a repository, or where the command is missing, every answer is empty.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.text import admits


def _lines(root: str, *args: str) -> list[str]:
    try:
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return [x for x in got.stdout.decode("utf-8", "replace").split("\0") if x] if got.returncode == 0 else []


def ignored(root: str) -> list[str]:
    """Untracked files and folders (ending with a slash) that version control ignores."""
    return [x[3:] for x in _lines(root, "status", "--porcelain", "-z", "--ignored", "--untracked-files=normal") if x.startswith("!! ")]


def uncommitted(root: str) -> list[str]:
    """Paths with changes that are not committed, untracked ones too."""
    return sorted(x[3:] for x in _lines(root, "status", "--porcelain", "-z", "--untracked-files=all", "--no-renames") if not x.startswith("!! "))


def without_ignored(rows: DataFrame, root: str) -> DataFrame:
    """Scanned rows (rel_path) that are not ignored: whole folders by their beginning, files by name."""
    found = ignored(root)
    files = [x for x in found if not x.endswith("/")]
    keep = F.lit(True)
    for folder in (x for x in found if x.endswith("/")):
        keep = keep & ~F.startswith("rel_path", F.lit(folder))
    return rows.filter(keep & ~F.col("rel_path").isin(*files)) if files else rows.filter(keep)


def linked_worktrees(root: str) -> list[str]:
    """Folders under a root that are work trees of another repository: they hold a ``.git`` file."""
    out = []
    for at, folders, files in os.walk(root):
        if at != root and ".git" in files:
            out.append(os.path.relpath(at, root))
            folders.clear()
        folders[:] = [f for f in folders if f != ".git"]
    return sorted(out)


def fingerprint(root: str, version: str, settings: str = "") -> str | None:
    """A digest of the tool's version, the settings, the head and each changed path's size and time; None outside a repository."""
    head = _lines(root, "rev-parse", "HEAD")
    if not head:
        return None
    h = hashlib.sha256("\0".join([version, settings, head[0].strip()]).encode())
    for p in uncommitted(root):
        try:
            st = os.lstat(os.path.join(root, p))
            h.update(f"\0{p}\0{st.st_size}\0{st.st_mtime_ns}".encode())
        except OSError:
            h.update(f"\0{p}\0gone".encode())
    return h.hexdigest()


def log_text(root: str, since: str | None = None, most: int = 5000, first_parent: bool = False) -> str:
    """The newest commits that are no merges, in the form ``tree.read_log`` reads; since a commit, or along first parents, if asked."""
    what = [f"{since}..HEAD"] if since else ["HEAD"]
    args = ["log", f"-n{most}", "--first-parent" if first_parent else "--no-merges", "--name-status", "-M", "--format=%x1e%H%x1f%cI%x1f%s%x1f%b%x1f"]
    try:
        got = subprocess.run(["git", "-C", root, *args, *what], capture_output=True, timeout=600, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return got.stdout.decode("utf-8", "replace").lstrip("\x1e") if got.returncode == 0 else ""


def is_ancestor(root: str, old: str, new: str = "HEAD") -> bool:
    """Whether a commit lies behind another: then a history can be appended to, else it is rebuilt."""
    try:
        return subprocess.run(["git", "-C", root, "merge-base", "--is-ancestor", old, new], capture_output=True, timeout=60, check=False).returncode == 0
    except (OSError, subprocess.TimeoutExpired):
        return False


@dataclass(frozen=True)
class Settings:
    """What a root's settings file asks for: globs, a size limit and languages of endings."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    max_bytes: int = 1_000_000
    languages: dict[str, str] = field(default_factory=dict)

    def admits(self, rows: DataFrame) -> DataFrame:
        return rows.filter(admits(F.col("rel_path"), self.include, self.exclude))

    def extension(self, path: str) -> str:
        """The ending of a path, or that of the language the settings give it."""
        end = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
        return self.languages.get(end, end)


def settings(path: str) -> Settings:
    """The settings of a TOML file; unknown keys and wrong types are refused, a missing file gives the defaults."""
    if not os.path.exists(path):
        return Settings()
    with open(path, "rb") as f:
        data = tomllib.load(f)
    kinds = {"include": list, "exclude": list, "max_bytes": int, "languages": dict}
    for k, v in data.items():
        if k not in kinds or not isinstance(v, kinds[k]) or isinstance(v, bool):
            raise ValueError(f"bad setting {k!r}")
        if isinstance(v, list) and not all(isinstance(x, str) and x and not x.startswith("/") and ".." not in x.split("/") for x in v):
            raise ValueError(f"{k} holds globs inside the root")
    return Settings(**data)


def changed_ranges(spark: SparkSession, root: str) -> DataFrame:
    """(path, start, end): the line ranges that differ from the last commit."""
    from codelode.operators.evaluation import patch_lines

    try:
        text = subprocess.run(["git", "-C", root, "diff", "HEAD", "-U0", "--no-color", "--no-ext-diff"], capture_output=True, timeout=120, check=False).stdout.decode("utf-8", "replace")
    except (OSError, subprocess.TimeoutExpired):
        text = ""
    return patch_lines(spark.createDataFrame([(0, text)], "id int, patch string"), "id", "patch").drop("id")

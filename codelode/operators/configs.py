"""Names, packages, routes, checks and facts in data, build and settings files.

Each reader takes one text and gives (kind, name, line); one Arrow-batched pass sends a file to the reader of its name. Lock files and data files
over 256 KiB have no names. Values of secret settings are never kept.
"""

from __future__ import annotations

import ast
import configparser
import json
import plistlib
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.symbols import newest_texts

LARGEST = 256 * 1024
FACTS = "root_id string, rel_path string, kind string, name string, line int"
_LOCK = re.compile(r"(?i)(^|/)(package-lock\.json|npm-shrinkwrap\.json|composer\.lock|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|cargo\.lock|go\.sum|uv\.lock|gemfile\.lock|[^/]*\.lock(\.json)?)$")
# What a check's name says it does.
CHECKS = {"test": "test", "tests": "test", "pytest": "test", "unit": "test", "integration": "test", "check": "test", "lint": "lint", "ruff": "lint", "flake8": "lint", "eslint": "lint", "format": "format", "fmt": "format", "black": "format", "prettier": "format",
          "type": "typecheck", "types": "typecheck", "typecheck": "typecheck", "mypy": "typecheck", "tsc": "typecheck", "pyright": "typecheck", "build": "build", "compile": "build"}


def names_allowed(path: str, size: int) -> bool:
    """Whether a data file's names are worth keeping: no lock file, and not over 256 KiB."""
    return not _LOCK.search(path) and size <= LARGEST


def _line(text: str, name: str) -> int:
    m = re.search(rf"(?<![\w-]){re.escape(name)}(?![\w-])", text)
    return text.count("\n", 0, m.start()) + 1 if m else 1


def without_json_comments(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON."""
    kept = re.sub(r"(\"(?:\\.|[^\"\\\n])*\")|//[^\n]*|/\*.*?\*/", lambda m: m.group(1) or " ", text, flags=re.S)
    return re.sub(r"(\"(?:\\.|[^\"\\\n])*\")|,(?=\s*[}\]])", lambda m: m.group(1) or "", kept)


def yaml_names(text: str) -> list[tuple]:
    """Mapping keys to depth two, and kind/name of resources; template actions are blanked first, sequences and block values are passed over."""
    text, out, stack, block = re.sub(r"\{\{.*?\}\}", " ", text), [], [], None
    for no, line in enumerate(text.split("\n"), 1):
        if re.match(r"---|\.\.\.", line):
            stack = []
            continue
        m = re.match(r"( *)([A-Za-z_][\w./-]*)[ \t]*:(?:[ \t]+(.*))?$", line)
        indent = len(line) - len(line.lstrip(" "))
        if block is not None and line.strip() and indent > block:
            continue
        block = None
        if not m:
            continue
        while stack and stack[-1][0] >= indent:
            stack.pop()
        stack.append((indent, m.group(2)))
        if len(stack) <= 2:
            out.append(("key", ".".join(k for _, k in stack), no))
        if (m.group(3) or "").strip()[:1] in ("|", ">") and (m.group(3) or "").strip():
            block = indent
    kind = re.search(r"(?m)^kind:\s*(\w+)", text)
    name = re.search(r"(?m)^metadata:\s*\n(?:[ ]+[^\n]*\n)*?[ ]+name:\s*([\w.-]+)", text)
    if kind and name:
        out.append(("resource", f"{kind.group(1)}/{name.group(1)}", text.count("\n", 0, kind.start()) + 1))
    return out


def json_names(text: str) -> list[tuple]:
    """Object keys to depth two, never inside arrays."""
    try:
        data = json.loads(without_json_comments(text))
    except (ValueError, RecursionError):
        return []
    out = []
    for k, v in data.items() if isinstance(data, dict) else ():
        out.append(("key", k, _line(text, k)))
        out += [("key", f"{k}.{x}", _line(text, x)) for x in v] if isinstance(v, dict) else []
    return out


def toml_names(text: str) -> list[tuple]:
    """Table headers and the keys directly in each, dotted, each once."""
    try:
        tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return []
    out, at = {}, ""
    for no, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*\[\[?\s*([^\]]+?)\s*\]\]?", line):
            at = m.group(1).replace('"', "")
            out.setdefault(at, ("table", at, no))
        elif m := re.match(r"\s*([A-Za-z0-9_.\"-]+)\s*=", line):
            name = f"{at}.{m.group(1)}".lstrip(".").replace('"', "")
            out.setdefault(name, ("key", name, no))
    return list(out.values())


def xml_names(text: str, name: str) -> list[tuple]:
    """id and name attributes, MSBuild packages, properties and targets, keys of property lists, the coordinate of a build file."""
    if "<!DOCTYPE" in text and "<!ENTITY" in text:
        return []
    try:
        tree = ET.fromstring(text.lstrip("\ufeff").encode())
    except (ET.ParseError, ValueError):
        return []
    out, local = [], lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    for e in tree.iter():
        for a, v in e.attrib.items():
            if a.rsplit("}", 1)[-1].lower() in ("id", "name", "key") and v:
                out.append(("target" if local(e) == "Target" else "id", v, _line(text, v)))
        if local(e) == "PackageReference" and e.get("Include"):
            out.append(("package", e.get("Include"), _line(text, e.get("Include"))))
        if local(e) == "PropertyGroup":
            out += [("property", local(c), _line(text, local(c))) for c in e]
        if local(e) == "key" and e.text:
            out.append(("key", e.text.strip(), _line(text, e.text.strip())))
    if name == "pom.xml":
        kids = {local(c): (c.text or "").strip() for c in tree}
        if kids.get("artifactId"):
            out.append(("package", ":".join(x for x in (kids.get("groupId"), kids["artifactId"]) if x), _line(text, kids["artifactId"])))
    return out


def hcl_names(text: str) -> list[tuple]:
    """Names of resources, data, modules, variables, outputs, providers and locals."""
    out = [(m.group(1), ".".join(x for x in m.groups()[1:] if x), text.count("\n", 0, m.start()) + 1) for m in re.finditer(r'(?m)^(resource|data|module|variable|output|provider)\s+"([^"]+)"(?:\s+"([^"]+)")?', text)]
    for b in re.finditer(r"(?ms)^locals\s*\{(.*?)^\}", text):
        out += [("local", m.group(1), text.count("\n", 0, b.start(1) + m.start(1)) + 1) for m in re.finditer(r"(?m)^[ \t]+([A-Za-z_]\w*)\s*=", b.group(1))]
    return out


def packages(path: str, text: str) -> list[tuple]:
    """The packages a manifest depends on."""
    name, out = path.rsplit("/", 1)[-1].lower(), []
    try:
        if name == "package.json":
            data = json.loads(text)
            out = [k for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for k in (data.get(part) or {})]
        elif name == "pyproject.toml":
            data = tomllib.loads(text)
            project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
            specs = [*project.get("dependencies", []), *(x for xs in project.get("optional-dependencies", {}).values() for x in xs), *(x for xs in data.get("dependency-groups", {}).values() for x in xs if isinstance(x, str))]
            out = [m.group() for x in specs if (m := re.match(r"[A-Za-z0-9][\w.-]*", x))]
            out += [k for part in (poetry.get("dependencies", {}), *(g.get("dependencies", {}) for g in poetry.get("group", {}).values())) for k in part if k.lower() != "python"]
        elif re.fullmatch(r"(?:.*[-_])?requirements(?:[-_.].*)?\.(?:txt|in)", name):
            out = [m.group(1) for ln in text.split("\n") if (m := re.match(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*(?:[=<>!~;@]|$|#)", ln))]
        elif name == "go.mod":
            out = re.findall(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+v\d", text)
        elif name == "cargo.toml":
            data = tomllib.loads(text)
            out = [k for part in ("dependencies", "dev-dependencies", "build-dependencies") for k in data.get(part, {})]
    except (ValueError, AttributeError, TypeError, tomllib.TOMLDecodeError, RecursionError):
        return []
    return [("package", x, _line(text, x)) for x in dict.fromkeys(out)]


def sql_statements(text: str) -> list[tuple[int, int]]:
    """(start, end) of the statements of an SQL text: strings, comments, dollar quotes and BEGIN blocks hold no ends."""
    out, start, depth = [], 0, 0
    pattern = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|\$(\w*)\$.*?\$\1\$|\b(?:begin|case)\b(?!\s*(?:;|transaction|work))|\bend\b|;", re.S | re.I)
    for m in pattern.finditer(text):
        word = m.group().lower()
        if word in ("begin", "case"):
            depth += 1
        elif word == "end":
            depth = max(0, depth - 1)
        elif word == ";" and not depth:
            if text[start : m.start()].strip():
                out.append((start, m.end()))
            start = m.end()
    return out + ([(start, len(text))] if text[start:].strip() else [])


_OBJECT = re.compile(r"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:unique\s+|temp(?:orary)?\s+|materialized\s+|external\s+)*(table|view|function|procedure|trigger|index|type|schema|sequence)\s+(?:if\s+not\s+exists\s+|concurrently\s+)*((?:[\w\"`\[\]]+\.)*[\w\"`\[\]]+)")
_REFERENCE = re.compile(r"(?i)\b(?:from|join|update|insert\s+into|delete\s+from|references|exec(?:ute)?)\s+((?:[\w\"`\[\]]+\.)*[A-Za-z_\"`\[][\w\"`\]]*)")
_SQL_WORDS = frozenset("select where set values only lateral unnest table dual the a an this that each into procedure function immediate now".split())


def sql_names(text: str) -> list[tuple]:
    """The objects an SQL text creates, with a table's columns, and the names it refers to."""
    out = []
    for a, b in sql_statements(text):
        part = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), text[a:b], flags=re.S)
        at = text.count("\n", 0, a + len(part) - len(part.lstrip())) + 1
        if m := _OBJECT.match(part):
            kind, name = m.group(1).lower(), re.sub(r"[\"`\[\]]", "", m.group(2)).rsplit(".", 1)[-1]
            out.append((kind, name, at))
            if kind == "table" and (body := re.search(r"\((.*)\)", part, re.S)):
                for col in re.split(r",(?![^(]*\))", body.group(1)):
                    c = re.match(r"\s*[\"`\[]?([A-Za-z_]\w*)", col)
                    if c and c.group(1).lower() not in ("primary", "foreign", "unique", "constraint", "check", "key", "index", "exclude"):
                        out.append(("column", f"{name}.{c.group(1)}", at))
        out += [("refers", n, at) for n in dict.fromkeys(re.sub(r"[\"`\[\]]", "", m.group(1)).rsplit(".", 1)[-1].lower() for m in _REFERENCE.finditer(part)) if n not in _SQL_WORDS]
    return out


def check_label(name: str) -> str | None:
    """What a recipe, script or session of this name checks, or None."""
    for word in re.split(r"[^a-z0-9]+", name.lower()):
        if word in CHECKS:
            return CHECKS[word]
    return None


def checks(path: str, text: str) -> list[tuple]:
    """(check, command, line): what a repository runs to check itself, by its build, workflow and task files."""
    folder, name = path.rpartition("/")[0], path.rsplit("/", 1)[-1].lower()
    pre, out = f"cd {folder} && " if folder and not folder.startswith(".github") else "", []
    if name in ("makefile", "gnumakefile"):
        out = [(f"{pre}make {m.group(1)}", m) for m in re.finditer(r"(?m)^([A-Za-z][\w.-]*)\s*:(?!=)", text) if check_label(m.group(1))]
    elif name in ("justfile", ".justfile"):
        out = [(f"{pre}just {m.group(1)}", m) for m in re.finditer(r"(?m)^@?([A-Za-z][\w-]*)\s*:(?!=)", text) if check_label(m.group(1))]
    elif name == "noxfile.py":
        out = [(f"{pre}nox -s {m.group(1)}", m) for m in re.finditer(r"(?m)^@nox\.session[^\n]*\ndef\s+(\w+)", text) if check_label(m.group(1))]
    elif name == "tox.ini":
        p = configparser.ConfigParser(interpolation=None, strict=False)
        try:
            p.read_string(text)
        except configparser.Error:
            return []
        envs = [e for e in re.split(r"[,\s]+", p.get("tox", "envlist", fallback="")) if e] + [s.split(":", 1)[1] for s in p.sections() if s.startswith("testenv:")]
        return [("check", f"{pre}tox -e {e}", _line(text, e)) for e in dict.fromkeys(envs) if check_label(e)]
    elif name == "package.json":
        try:
            scripts = json.loads(text).get("scripts") or {}
        except (ValueError, AttributeError):
            return []
        return [("check", f"{pre}npm run {k}", _line(text, k)) for k in scripts if check_label(k)]
    elif name == "pyproject.toml":
        try:
            tool = tomllib.loads(text).get("tool", {})
        except (tomllib.TOMLDecodeError, RecursionError):
            return []
        return [("check", pre + c, _line(text, t)) for t, c in (("pytest", "pytest"), ("ruff", "ruff check ."), ("mypy", "mypy ."), ("black", "black --check .")) if t in tool]
    elif re.search(r"(^|/)\.github/workflows/[^/]+\.ya?ml$", path):
        found = [(m.group(1) or m.group(2) or "", m) for m in re.finditer(r"(?m)^[ \t]*-?[ \t]*run:[ \t]*(?:\|[^\n]*\n((?:[ \t]+[^\n]*\n?)+)|([^\n|]+))", text)]
        lines = [(c.strip(), m) for block, m in found for c in (block or m.group(2) or "").split("\n") if c.strip()]
        return [("check", c, text.count("\n", 0, m.start()) + 1) for c, m in lines if any(check_label(w) for w in re.findall(r"[\w-]+", c)[:4]) and not re.match(r"(?:pip|npm|yarn|pnpm|uv|apt|brew|cargo)\b.*\binstall\b|npm ci", c)]
    return [("check", c, text.count("\n", 0, m.start()) + 1) for c, m in out]


def settings_names(text: str) -> list[tuple]:
    """Names that an environment example sets; values are never kept."""
    return [("setting", m.group(1), text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_]\w*)[ \t]*=", text)]


def endpoints(text: str) -> list[tuple]:
    """Routes declared by decorators of a Python web application: method and path with the router's prefix."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    prefix: dict[str, str] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.targets[0], ast.Name) and getattr(n.value.func, "id", getattr(n.value.func, "attr", "")) in ("FastAPI", "APIRouter"):
            prefix[n.targets[0].id] = next((k.value.value for k in n.value.keywords if k.arg == "prefix" and isinstance(k.value, ast.Constant)), "")
    out = []
    for n in ast.walk(tree):
        for d in getattr(n, "decorator_list", []):
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.value.id in prefix and d.func.attr in ("get", "post", "put", "patch", "delete", "head", "options", "websocket") and d.args and isinstance(d.args[0], ast.Constant):
                out.append(("route", f"{d.func.attr.upper()} {prefix[d.func.value.id]}{d.args[0].value}", n.lineno))
    return out


def page_route(path: str) -> str | None:
    """The route of a page or handler file of an application folder: groups in brackets fall away, dynamic parts stay as :name."""
    m = re.search(r"(?:^|/)app/(.*?)/?(page|route|layout|loading|error)\.(?:tsx?|jsx?)$", path)
    if not m:
        return None
    parts = [re.sub(r"^\[\[?(?:\.\.\.)?(\w+)\]\]?$", r":\1", p) for p in m.group(1).split("/") if p and not re.fullmatch(r"\(.*\)", p) and not p.startswith("@")]
    return "/" + "/".join(parts)


def screen_route(path: str) -> str | None:
    """The route of a mobile screen file; layouts and files that begin with a plus are none."""
    m = re.search(r"(?:^|/)app/(.+)\.(?:tsx|jsx)$", path)
    if not m or re.search(r"(?:^|/)(?:_layout|\+)", m.group(1)):
        return None
    parts = [re.sub(r"^\[(?:\.\.\.)?(\w+)\]$", r":\1", p) for p in m.group(1).split("/") if not re.fullmatch(r"\(.*\)", p)]
    return "/" + "/".join(p for p in parts if p != "index")


def migration(text: str) -> list[tuple]:
    """A migration's revision, what it follows and the tables it works on."""
    out = []
    for key, kind in (("revision", "revision"), ("down_revision", "down")):
        if m := re.search(rf"(?m)^{key}\s*(?::[^=\n]+)?=\s*(.+)$", text):
            out += [(kind, x, text.count("\n", 0, m.start()) + 1) for x in re.findall(r"[\"']([^\"']+)[\"']", m.group(1))]
    if not any(k == "revision" for k, _, _ in out):
        return []
    return out + [("table_change", f"{m.group(1)} {m.group(2)}", text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"\bop\.(create_table|drop_table|add_column|drop_column|alter_column|rename_table)\(\s*[\"'](\w+)", text)]


def plist_names(text: str) -> list[tuple]:
    try:
        data = plistlib.loads(text.encode())
    except (ValueError, plistlib.InvalidFileException, ET.ParseError, OverflowError, AttributeError):
        return []
    return [("key", k, _line(text, k)) for k in data] if isinstance(data, dict) else []


def open_plist(text: str) -> dict | None:
    """An old-style property list as nested dicts, lists and strings; None if it is none or over four million signs."""
    toks = re.findall(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\]|\\.)*\"|[{}()=;,]|[^\s{}()=;,\"]+", text[:4_000_000] if len(text) <= 4_000_000 else "", re.S)
    toks = [t for t in toks if not t.startswith(("/*", "//"))]
    root: list = []
    stack: list[tuple[object, str | None]] = [(root, None)]
    key = None
    for t in toks:
        top = stack[-1][0]
        if t in "{(":
            new: object = {} if t == "{" else []
            top.__setitem__(key, new) if isinstance(top, dict) else top.append(new)
            stack.append((new, key))
            key = None
        elif t in "})":
            if len(stack) < 2:
                return None
            key = None
            stack.pop()
        elif t in ";,":
            key = None
        elif t != "=":
            v = t[1:-1] if t[:1] == '"' else t
            if isinstance(top, dict) and key is None:
                key = v
            elif isinstance(top, dict):
                top[key] = v
            else:
                top.append(v)
    return root[0] if root and isinstance(root[0], dict) else None


def xcode_targets(text: str) -> list[tuple]:
    """The targets of an Xcode project file with their product type."""
    data = open_plist(text) or {}
    out = []
    for o in (data.get("objects") or {}).values():
        if isinstance(o, dict) and str(o.get("isa", "")).endswith("Target") and o.get("name"):
            out.append(("target", f"{o['name']} ({str(o.get('productType', '')).rsplit('.', 1)[-1] or 'aggregate'})", _line(text, o["name"])))
    return out


def expo_names(text: str) -> list[tuple]:
    try:
        app = json.loads(without_json_comments(text)).get("expo") or {}
    except (ValueError, AttributeError):
        return []
    return [("app", f"{k}={app[k]}", _line(text, k)) for k in ("name", "slug", "scheme", "version") if isinstance(app.get(k), str)] + [("plugin", p if isinstance(p, str) else str(p[0]), _line(text, "plugins")) for p in app.get("plugins", []) if p]


def front_matter(text: str) -> list[tuple]:
    """Title, type and tags of a document's front matter, at most 120 signs each."""
    m = re.match(r"\s*---\s*\n(.*?)\n---\s*(?:\n|$)", text, re.S)
    return [(k, v.strip().strip("\"'")[:120], text.count("\n", 0, m.start(1) + f.start()) + 1) for f in re.finditer(r"(?m)^(title|type|tags):[ \t]*(.+)$", m.group(1)) for k, v in [f.groups()]] if m else []


def doc_facts(text: str) -> list[tuple]:
    """Front matter and the first twelve headings of a document."""
    heads = [("heading", m.group(1)[:120], text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"(?m)^#{1,6}\s+(.+?)\s*#*$", re.sub(r"(?ms)^```.*?^```", lambda m: re.sub(r"[^\n]", " ", m.group()), text))]
    return front_matter(text) + heads[:12]


def ts_paths(text: str) -> list[tuple]:
    """A compiler configuration's base folder, path patterns with their first goal and what it extends."""
    try:
        data = json.loads(without_json_comments(text))
        o = data.get("compilerOptions") or {}
        out = [("base", o["baseUrl"], 1)] if isinstance(o.get("baseUrl"), str) else []
        out += [("alias", f"{k}\x1f{g}", _line(text, k)) for k, gs in (o.get("paths") or {}).items() for g in gs[:8]]
        ext = data.get("extends")
        return out + [("extends", x, 1) for x in ([ext] if isinstance(ext, str) else ext or [])]
    except (ValueError, AttributeError, TypeError):
        return []


def names_in(path: str, text: str) -> list[tuple]:
    """(kind, name, line) of one file by its name and ending."""
    name, end = path.rsplit("/", 1)[-1].lower(), path.rpartition(".")[2].lower()
    if not text or not names_allowed(path, len(text.encode())):
        return []
    out = packages(path, text) + checks(path, text)
    if re.fullmatch(r"(?:ts|js)config(?:\.[\w.-]+)?\.json", name):
        out += ts_paths(text)
    elif name in ("app.json", "app.config.json"):
        out += expo_names(text)
    if name.startswith(".env") and name.endswith((".example", ".sample", ".template")):
        out += settings_names(text)
    if end in ("yaml", "yml"):
        out += yaml_names(text)
    elif end in ("json", "jsonc"):
        out += json_names(text)
    elif end == "toml":
        out += toml_names(text)
    elif end in ("xml", "csproj", "props", "targets", "xaml"):
        out += xml_names(text, name)
    elif end in ("plist", "entitlements"):
        out += plist_names(text)
    elif name == "project.pbxproj":
        out += xcode_targets(text)
    elif end in ("tf", "hcl"):
        out += hcl_names(text)
    elif end == "sql":
        out += sql_names(text)
    elif end == "py":
        out += endpoints(text) + migration(text)
    elif end in ("md", "mdx"):
        out += doc_facts(text)
    if route := page_route(path) or screen_route(path):
        out.append(("route", route, 1))
    return out


def config_facts(contents: DataFrame) -> DataFrame:
    """``FACTS`` rows of each path's newest text; files without names have none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(root, path, *f) for root, path, text in zip(b["root_id"], b["rel_path"], b["content"]) for f in names_in(path, text)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FACTS.split(", ")])

    return newest_texts(contents).select("root_id", "rel_path", "content").mapInPandas(work, FACTS)


def alias_tables(facts: DataFrame, depth: int = 8) -> DataFrame:
    """(root_id, folder, pattern, goal) of compiler configurations, goals as paths of the root: own patterns, else those of the configuration they extend, over at most ``depth`` steps."""
    folder = F.regexp_replace("rel_path", "/?[^/]*$", "")
    a = facts.filter("kind = 'alias'").select("root_id", "rel_path", F.split("name", "\x1f")[0].alias("pattern"), F.split("name", "\x1f")[1].alias("goal"))
    base = facts.filter("kind = 'base'").groupBy("root_id", "rel_path").agg(F.min("name").alias("base"))
    own = a.join(base, ["root_id", "rel_path"], "left").withColumn("goal", _tidy(F.concat_ws("/", F.nullif(folder, F.lit("")), F.coalesce("base", F.lit(".")), "goal"))).drop("base")
    up = facts.filter("kind = 'extends'").select("root_id", "rel_path", _tidy(F.concat_ws("/", F.nullif(folder, F.lit("")), F.regexp_replace("name", r"(?<!\.json)$", ".json"))).alias("parent")).dropDuplicates(["root_id", "rel_path"])
    have, open_ = own, up.join(own.select("root_id", "rel_path").distinct(), ["root_id", "rel_path"], "left_anti")
    for _ in range(depth):  # chains are a few configurations of a root
        got = open_.join(own.withColumnRenamed("rel_path", "parent"), ["root_id", "parent"]).select("root_id", "rel_path", "pattern", "goal")
        have = have.unionByName(got)
        open_ = open_.join(up.withColumnsRenamed({"rel_path": "parent", "parent": "_next"}), ["root_id", "parent"]).select("root_id", "rel_path", F.col("_next").alias("parent"))
        if depth <= 0 or open_.isEmpty():
            break
    return have.select("root_id", folder.alias("folder"), "pattern", "goal").distinct()


def _tidy(path):
    out = F.regexp_replace(path, r"(^|/)(?:\./)+", "$1")
    out = F.regexp_replace(out, r"/\.(?=/|$)", "")
    for _ in range(3):
        out = F.regexp_replace(out, r"(^|/)(?!\.\.)[^/]+/\.\./", "$1")
    return out

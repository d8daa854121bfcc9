"""Definitions, imports, exports, calls and bases of source files.

One Arrow-batched pass reads each file once: Python by its own parser (by line patterns where it does not parse), other languages
by patterns over a text whose strings and comments are blanked. What comes out are small tables; resolving them is done by joins.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a fact table: kind is def, import, export, call, base or link.
FACTS = "root_id string, file_id string, rel_path string, language string, fact string, kind string, name string, owner string, line_start int, line_end int"

# Endings of source languages, and what a line must look like to declare something there.
ENDINGS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "php": "php", "swift": "swift", "rb": "ruby", "scala": "scala", "groovy": "groovy", "gvy": "groovy", "gradle": "groovy", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp",
    "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "sh": "bash", "bash": "bash", "ps1": "powershell", "psm1": "powershell", "lua": "lua", "pl": "perl", "pm": "perl", "dart": "dart", "m": "objc", "mm": "objc", "zig": "zig",
    "ex": "elixir", "exs": "elixir", "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "r": "r", "jl": "julia", "sol": "solidity", "f90": "fortran", "f95": "fortran", "f03": "fortran", "f08": "fortran", "pas": "pascal", "pp": "pascal",
    "dpr": "pascal", "lpr": "pascal", "vue": "vue", "svelte": "svelte", "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "scss", "less": "less", "sql": "sql", "tf": "hcl", "hcl": "hcl", "yaml": "yaml", "yml": "yaml",
    "json": "json", "jsonc": "json", "toml": "toml", "xml": "xml", "md": "markdown", "mdx": "markdown",
}
_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|open|override|sealed|export|default|async|virtual|inline|data|pub(?:\([a-z]+\))?|unsafe|extern|const|partial|readonly|suspend|local)\s+)*"
DEFINES: dict[str, list[tuple[str, str]]] = {
    "javascript": [("class", rf"^[ \t]*{_MOD}class\s+([A-Za-z_$][\w$]*)"), ("function", rf"^[ \t]*{_MOD}function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("function", r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)\n]*\)|[A-Za-z_$][\w$]*)\s*=>"), ("method", r"^[ \t]+(?:async\s+|static\s+|get\s+|set\s+)*([A-Za-z_$][\w$]*)\s*\([^)\n]*\)\s*\{")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"), ("class", r"^type\s+([A-Za-z_]\w*)")],
    "rust": [("function", rf"^[ \t]*{_MOD}fn\s+([A-Za-z_]\w*)"), ("class", rf"^[ \t]*{_MOD}(?:struct|enum|trait|union|mod|type)\s+([A-Za-z_]\w*)")],
    "java": [("class", rf"^[ \t]*{_MOD}(?:class|interface|enum|record|@interface)\s+([A-Za-z_]\w*)"), ("method", rf"^[ \t]+{_MOD}(?:<[^>\n]+>\s*)?[\w<>\[\],.?]+\s+([A-Za-z_]\w*)\s*\([^)\n;]*\)\s*(?:throws [\w, .]+)?\{{")],
    "kotlin": [("class", rf"^[ \t]*{_MOD}(?:class|interface|object|enum class)\s+([A-Za-z_]\w*)"), ("function", rf"^[ \t]*{_MOD}fun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?([A-Za-z_]\w*)")],
    "csharp": [("class", rf"^[ \t]*{_MOD}(?:class|interface|enum|record|struct)\s+([A-Za-z_]\w*)"), ("method", rf"^[ \t]+{_MOD}[\w<>\[\],.?]+\s+([A-Za-z_]\w*)\s*\([^)\n;]*\)\s*\{{?\s*$")],
    "php": [("class", rf"^[ \t]*{_MOD}(?:class|interface|trait|enum)\s+([A-Za-z_]\w*)"), ("function", rf"(?:^|[{{;}}])[ \t]*{_MOD}function\s+&?([A-Za-z_]\w*)")],
    "swift": [("class", rf"^[ \t]*{_MOD}(?:class|struct|enum|protocol|extension|actor)\s+([A-Za-z_]\w*)"), ("function", rf"^[ \t]*{_MOD}func\s+([A-Za-z_]\w*)")],
    "ruby": [("class", r"^[ \t]*(?:class|module)\s+(?:\w+::)*([A-Z]\w*)"), ("function", r"^[ \t]*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)")],
    "scala": [("class", rf"^[ \t]*{_MOD}(?:case\s+)?(?:class|object|trait|enum)\s+([A-Za-z_]\w*)"), ("function", rf"^[ \t]*{_MOD}def\s+([A-Za-z_]\w*)")],
    "groovy": [("class", rf"^[ \t]*{_MOD}(?:class|interface|enum|trait)\s+([A-Za-z_]\w*)"), ("method", rf"^[ \t]*{_MOD}(?:def|void|[A-Z]\w*(?:<[^>\n]*>)?)\s+([A-Za-z_]\w*)\s*\([^)\n]*\)\s*\{{"), ("task", r"^[ \t]*task\s+([A-Za-z_]\w*)")],
    "c": [("class", r"^(?:typedef\s+)?(?:struct|enum|union)\s+([A-Za-z_]\w*)\s*\{"), ("function", r"^[A-Za-z_][\w \t*]*?[ \t*]([A-Za-z_]\w*)\s*\([^;{}\n]*\)\s*\{?\s*$")],
    "bash": [("function", r"^[ \t]*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{?"), ("function", r"^[ \t]*function\s+([A-Za-z_][\w-]*)\s*\{")],
    "powershell": [("function", r"(?i)^[ \t]*function\s+([A-Za-z_][\w-]*)"), ("class", r"(?i)^[ \t]*class\s+([A-Za-z_]\w*)")],
    "lua": [("function", r"^[ \t]*(?:local\s+)?function\s+(?:[\w]+[.:])*([A-Za-z_]\w*)")],
    "perl": [("function", r"^[ \t]*sub\s+([A-Za-z_]\w*)"), ("class", r"^[ \t]*package\s+(?:\w+::)*([A-Za-z_]\w*)")],
    "dart": [("class", rf"^[ \t]*{_MOD}(?:class|mixin|enum|extension)\s+([A-Za-z_]\w*)"), ("function", r"^[A-Za-z_][\w<>,? ]*\s([A-Za-z_]\w*)\s*\([^;\n]*\)\s*(?:async\s*)?\{")],
    "objc": [("class", r"^@(?:interface|implementation|protocol)\s+([A-Za-z_]\w*)"), ("method", r"^[-+]\s*\([^)]*\)\s*([A-Za-z_]\w*)")],
    "zig": [("function", r"^[ \t]*(?:pub\s+)?fn\s+([A-Za-z_]\w*)"), ("class", r"^[ \t]*(?:pub\s+)?const\s+([A-Z]\w*)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)")],
    "elixir": [("class", r"^[ \t]*defmodule\s+(?:\w+\.)*([A-Z]\w*)"), ("function", r"^[ \t]*defp?\s+([a-z_]\w*[?!]?)")],
    "haskell": [("class", r"^(?:data|newtype|class|type)\s+(?:[^=\n]*=>\s*)?([A-Z]\w*)"), ("function", r"^([a-z_][\w']*)\s*::")],
    "ocaml": [("function", r"^let\s+(?:rec\s+)?([a-z_][\w']*)"), ("class", r"^(?:module|type|class)\s+(?:type\s+|nonrec\s+)?(?:'\w+\s+)?([A-Za-z_]\w*)")],
    "r": [("function", r"^[ \t]*([A-Za-z.][\w.]*)\s*(?:<-|=)\s*function\b")],
    "julia": [("function", r"^[ \t]*function\s+(?:\w+\.)*([A-Za-z_]\w*!?)"), ("class", r"^[ \t]*(?:mutable\s+)?(?:struct|module|abstract type)\s+([A-Za-z_]\w*)"), ("function", r"^([A-Za-z_]\w*!?)\([^)\n]*\)\s*=(?!=)")],
    "solidity": [("class", r"^[ \t]*(?:abstract\s+)?(?:contract|interface|library|struct|enum)\s+([A-Za-z_]\w*)"), ("function", r"^[ \t]*(?:function|modifier|event)\s+([A-Za-z_]\w*)")],
    "fortran": [("class", r"(?im)^[ \t]*(?:module(?!\s+procedure)|program|submodule\s*\([^)]*\))\s+([A-Za-z_]\w*)"), ("function", r"(?im)^[ \t]*(?!end)(?:[\w()= ]+\s)?(?:subroutine|function)\s+([A-Za-z_]\w*)")],
    "pascal": [("class", r"(?im)^[ \t]*([A-Za-z_]\w*)\s*=\s*(?:packed\s+)?(?:class|record|interface|object)\b"), ("function", r"(?im)^[ \t]*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+(?:\w+\.)?([A-Za-z_]\w*)")],
    "css": [("rule", r"^[ \t]*([.#][A-Za-z_][\w-]*)[^{};\n]*\{"), ("variable", r"^[ \t]*(--[\w-]+)\s*:")],
    "hcl": [("resource", r'^(?:resource|data)\s+"[^"]+"\s+"([^"]+)"'), ("block", r'^(?:module|variable|output|provider)\s+"([^"]+)"'), ("local", r"^  ([A-Za-z_]\w*)\s*=")],
    "markdown": [("heading", r"^#{1,6}\s+(.+?)\s*#*\s*$")],
}
DEFINES["typescript"] = [*DEFINES["javascript"], ("class", rf"^[ \t]*{_MOD}(?:interface|type|enum|namespace)\s+([A-Za-z_$][\w$]*)")]
DEFINES["cpp"] = [*DEFINES["c"], ("class", r"^[ \t]*(?:template\s*<[^>\n]*>\s*)?(?:class|struct|namespace)\s+([A-Za-z_]\w*)")]
DEFINES["scss"] = DEFINES["less"] = [*DEFINES["css"], ("mixin", r"^[ \t]*@mixin\s+([\w-]+)"), ("variable", r"^[ \t]*([$@][\w-]+)\s*:")]
IMPORTS: dict[str, list[str]] = {
    "javascript": [r"""(?:\bfrom|\bimport)\s*\(?\s*["']([^"'\n]+)["']""", r"""\brequire\s*\(\s*["']([^"'\n]+)["']"""], "go": [r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./~-]+)"\s*$'], "rust": [r"^\s*(?:pub\s+)?use\s+([\w:]+)", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;"],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"], "kotlin": [r"^\s*import\s+([\w.]+(?:\.\*)?)"], "scala": [r"^\s*import\s+([\w.]+)"], "groovy": [r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)"], "csharp": [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"],
    "php": [r"""\b(?:require|include)(?:_once)?\s*\(?\s*["']([^"'\n]+)["']""", r"^\s*use\s+([\w\\]+)"], "swift": [r"^\s*(?:@\w+\s+)?import\s+(\w+)"], "ruby": [r"""^\s*require(?:_relative)?\s+["']([^"'\n]+)["']"""], "c": [r'^\s*#\s*(?:include|import)\s+[<"]([^>"\n]+)[>"]'],
    "bash": [r"""^\s*(?:source|\.)\s+["']?([^\s"';]+)"""], "powershell": [r"""(?i)^\s*\.\s+["']?([^\s"']+)""", r"""(?i)^\s*(?:import-module|using module)\s+["']?([^\s"']+)"""], "lua": [r"""\brequire\s*\(?\s*["']([^"'\n]+)["']"""], "perl": [r"^\s*(?:use|require)\s+([A-Z][\w:]*)"],
    "dart": [r"""^\s*(?:import|export|part)\s+["']([^"'\n]+)["']"""], "zig": [r'@import\("([^"\n]+)"\)'], "elixir": [r"^\s*(?:alias|import|use|require)\s+([A-Z][\w.]*)"], "haskell": [r"^import\s+(?:qualified\s+)?([A-Z][\w.]*)"], "ocaml": [r"^\s*open\s+([A-Z]\w*)"],
    "r": [r"""\bsource\s*\(\s*["']([^"'\n]+)["']"""], "julia": [r"""\binclude\s*\(\s*"([^"\n]+)"\s*\)""", r"^\s*(?:using|import)\s+([\w.]+)"], "solidity": [r"""^\s*import\s+(?:[^"'\n]*from\s+)?["']([^"'\n]+)["']"""], "fortran": [r"(?i)^\s*use\s*(?:,\s*intrinsic\s*)?(?:::)?\s*(\w+)", r"""(?i)^\s*include\s+["']([^"'\n]+)["']"""],
    "pascal": [r"(?i)^\s*uses\s+([\w., ]+)"], "css": [r"""@(?:import|use|forward)\s+(?:url\()?["']([^"'\n]+)["']"""], "html": [r"""<(?:script|link|img)\b[^>]*?\b(?:src|href)\s*=\s*["']([^"'\n]+)["']"""], "hcl": [r'^\s*source\s*=\s*"([^"\n]+)"'], "xml": [r"""<import\b[^>]*?\b(?:Project|resource)\s*=\s*["']([^"'\n]+)["']"""],
}
IMPORTS["typescript"] = IMPORTS["vue"] = IMPORTS["svelte"] = IMPORTS["javascript"]
IMPORTS["objc"] = IMPORTS["cpp"] = IMPORTS["c"]
IMPORTS["scss"] = IMPORTS["less"] = IMPORTS["css"]
BASES = {
    "javascript": r"\bclass\s+([A-Za-z_$][\w$]*)\s+extends\s+([\w$.]+)", "java": r"\b(?:class|interface|record)\s+(\w+)[^{\n]*?\b(?:extends|implements)\s+([\w.<>, ]+)", "kotlin": r"\b(?:class|object|interface)\s+(\w+)[^:{\n]*:\s*([\w.<>(), ]+)",
    "csharp": r"\b(?:class|interface|record|struct)\s+(\w+)[^:{\n]*:\s*([\w.<>, ]+)", "php": r"\bclass\s+(\w+)\s+(?:extends|implements)\s+([\w\\, ]+)", "swift": r"\b(?:class|struct|enum|protocol)\s+(\w+)\s*:\s*([\w., ]+)", "ruby": r"^\s*class\s+(\w+)\s*<\s*([\w:]+)",
    "scala": r"\b(?:class|object|trait)\s+(\w+)[^{\n]*?\bextends\s+([\w.]+)", "cpp": r"\b(?:class|struct)\s+(\w+)\s*(?:final\s*)?:\s*([\w:<>, ]+)", "rust": r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)", "dart": r"\bclass\s+(\w+)[^{\n]*?\b(?:extends|implements|with)\s+([\w, ]+)",
    "solidity": r"\b(?:contract|interface)\s+(\w+)\s+is\s+([\w, ]+)", "groovy": r"\bclass\s+(\w+)[^{\n]*?\b(?:extends|implements)\s+([\w., ]+)", "objc": r"^@interface\s+(\w+)\s*:\s*(\w+)",
}
BASES["typescript"] = BASES["java"]
_NO_CALL = frozenset("if for while switch return catch function def class new await typeof sizeof throw assert elif except with and or not in is lambda print super else do match when unless until func fn sub let var const import from require export yield foreach using lock fixed synchronized".split())
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*)\s*\(")
_EXPORT = re.compile(r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:const|let|var|function\*?|class|interface|type|enum|namespace)\s+([A-Za-z_$][\w$]*)|^\s*export\s*\{([^}]*)\}|^\s*(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*=", re.M)
_HASH = frozenset("python ruby bash powershell perl r julia elixir yaml toml hcl".split())
_LITERAL = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*", re.S)
_LITERAL_HASH = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*", re.S)
_EMBEDDED = re.compile(r"<(script|style)\b([^>]*)>(.*?)</\1\s*>", re.S | re.I)


def language_of(path: str, overrides: dict[str, str] | None = None) -> str | None:
    """The language of a file's ending; ``overrides`` gives endings another one."""
    end = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return (overrides or {}).get(end) or ENDINGS.get(end)


def blanked(text: str, language: str) -> str:
    """A text of the same length and lines without the insides of strings and comments."""
    return (_LITERAL_HASH if language in _HASH else _LITERAL).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _python(text: str) -> list[tuple]:
    """(fact, kind, name, owner, line_start, line_end) of a Python text that parses."""
    tree, out = ast.parse(text), []

    def dotted(n) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute) and (left := dotted(n.value)):
            return f"{left}.{n.attr}"
        return None

    def visit(n, owner: str, in_class: bool) -> None:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(c, ast.ClassDef) else "method" if in_class else "function"
                first = min([c.lineno, *(d.lineno for d in c.decorator_list)])
                out.append(("def", kind, c.name, owner, first, c.end_lineno))
                if isinstance(c, ast.ClassDef):
                    out.extend(("base", "class", b, c.name, c.lineno, c.lineno) for x in c.bases if (b := dotted(x)))
                visit(c, c.name, kind == "class")
                continue
            if isinstance(c, ast.Import):
                out.extend(("import", "module", a.name, owner, c.lineno, c.lineno) for a in c.names)
            elif isinstance(c, ast.ImportFrom):
                base = "." * c.level + (c.module or "")
                out.append(("import", "module", base, owner, c.lineno, c.lineno)) if c.module or not c.level else None
                out.extend(("import", "guess", f"{base}{'' if base.endswith('.') else '.'}{a.name}", owner, c.lineno, c.lineno) for a in c.names if a.name != "*")
            elif isinstance(c, ast.Call) and (name := dotted(c.func)):
                out.append(("call", "call", name, owner, c.lineno, c.lineno))
            visit(c, owner, in_class and not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))

    visit(tree, "", False)
    return out


def _ends(plain: str, starts: list[int]) -> list[int]:
    """The last line of each definition by its brace block, else the line before the next definition; ``starts`` are offsets in order."""
    out = []
    for i, at in enumerate(starts):
        stop = starts[i + 1] if i + 1 < len(starts) else len(plain)
        brace = plain.find("{", at, min(stop, at + 400))
        if brace < 0:
            out.append(plain.count("\n", 0, max(at, len(plain[:stop].rstrip()))) + 1)
            continue
        depth, pos = 0, brace
        for m in re.finditer(r"[{}]", plain[brace:]):
            depth += 1 if m.group() == "{" else -1
            if not depth:
                pos = brace + m.start()
                break
        else:
            pos = len(plain) - 1
        out.append(plain.count("\n", 0, pos) + 1)
    return out


def _patterns(text: str, language: str) -> list[tuple]:
    """The facts of a text by line patterns."""
    plain, out, found = blanked(text, language), [], {}
    for kind, pattern in DEFINES.get(language, []):
        for m in re.finditer(pattern, text if language in ("markdown", "hcl") else plain, re.M):
            name = m.group(1)
            if name not in _NO_CALL:
                found.setdefault(m.start(1), (kind, name))
    starts = sorted(found)
    ends = _ends(plain, starts)
    spans = [(text.count("\n", 0, a) + 1, e, *found[a]) for a, e in zip(starts, ends)]
    for i, (a, e, kind, name) in enumerate(spans):
        owner = next((n for b, f, _, n in reversed(spans[:i]) if b <= a and e <= f), "")
        out.append(("def", kind, name, owner, a, max(a, e)))
    lines = text.split("\n")
    for pattern in IMPORTS.get(language, []):
        for no, line in enumerate(lines, 1):
            for m in re.finditer(pattern, line):
                names = re.split(r"\s*,\s*", m.group(1).strip()) if language == "pascal" else [m.group(1)]
                out += [("import", "module", n, "", no, no) for n in names if n]
    if language in BASES:
        for m in re.finditer(BASES[language], plain, re.M):
            child, parents = (m.group(2), m.group(1)) if language == "rust" else (m.group(1), m.group(2))
            no = plain.count("\n", 0, m.start()) + 1
            for b in re.split(r"\s*,\s*|\s+(?:implements|extends|with)\s+", re.sub(r"<[^>]*>|\([^)]*\)", "", parents).strip()):
                if re.fullmatch(r"[\w.$:\\]+", b):
                    out.append(("base", "class", b, child, no, no))
    if language in ("javascript", "typescript"):
        for m in _EXPORT.finditer(plain):
            names = [m.group(1) or m.group(3)] if not m.group(2) else [x.split(" as ")[-1].strip() for x in m.group(2).split(",")]
            out += [("export", "name", n, "", plain.count("\n", 0, m.start()) + 1, plain.count("\n", 0, m.start()) + 1) for n in names if n]
    if language in DEFINES and language not in ("markdown", "css", "scss", "less", "hcl"):
        heads = {(a, n) for a, _, _, n in spans}
        for m in _CALL.finditer(plain):
            name, no = re.sub(r"::|->", ".", m.group(1)), plain.count("\n", 0, m.start()) + 1
            last = name.rsplit(".", 1)[-1]
            if last not in _NO_CALL and (no, last) not in heads:
                out.append(("call", "call", name, "", no, no))
    return out


def facts(text: str, path: str, overrides: dict[str, str] | None = None) -> list[tuple]:
    """(fact, kind, name, owner, line_start, line_end) of one file; scripts and styles inside pages keep the page's lines."""
    language = language_of(path, overrides)
    if language is None or not text:
        return []
    if language == "python":
        try:
            return _python(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            rows = [("def", "class" if m.group(1) == "class" else "function", m.group(2), "", n := text.count("\n", 0, m.start()) + 1, n) for m in re.finditer(r"^(?:async\s+)?(def|class)\s+(\w+)", text, re.M)]
            return rows + [("import", "module", m.group(1) or m.group(2), "", n := text.count("\n", 0, m.start()) + 1, n) for m in re.finditer(r"^\s*(?:from\s+([.\w]+)\s+import\b|import\s+([\w.]+))", text, re.M)]
    if language in ("html", "vue", "svelte"):
        out = [("def", "id", m.group(1), "", n := text.count("\n", 0, m.start()) + 1, n) for m in re.finditer(r"""<\w[^>]*?\bid\s*=\s*["']([^"']+)["']""", text)] if language == "html" else []
        out += _patterns(text, "html") if language == "html" else []
        for m in _EMBEDDED.finditer(text):
            inner = ("typescript" if re.search(r"""lang\s*=\s*["']tsx?""", m.group(2)) else "javascript") if m.group(1).lower() == "script" else "scss" if "scss" in m.group(2) else "css"
            shift = text.count("\n", 0, m.start(3))
            out += [(f, k, n, o, a + shift, b + shift) for f, k, n, o, a, b in _patterns(m.group(3), inner)]
        return out
    out = _patterns(text, language)
    if language == "markdown":
        out += [("link", "doc", x, "", n, n) for x, n in _links(text)]
    return out


def _links(text: str) -> list[tuple[str, int]]:
    """The targets of links and wiki links of a document that are no addresses, each once, with their lines."""
    found: dict[str, int] = {}
    for m in re.finditer(r"\[\[([^\]|#\n]+)[^\]\n]*\]\]|\]\(\s*<?([^)\s>#]+)[^)\n]*\)", text):
        x = (m.group(1) or m.group(2)).strip()
        if x and not re.match(r"[a-z][a-z0-9+.-]*:|//|#", x, re.I):
            found.setdefault(x, text.count("\n", 0, m.start()) + 1)
    return sorted(found.items())[:50]


def code_facts(contents: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``FACTS`` rows of each path's newest text. Null texts, roots and paths have none; unknown endings have none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        for b in batches:
            rows = []
            for root, fid, path, text in zip(b["root_id"], b["file_id"], b["rel_path"], b["content"]):
                rows += [(root, fid, path, language_of(path, overrides), *f) for f in facts(text, path, overrides)]
            yield pd.DataFrame(rows, columns=names)

    return newest_texts(contents).mapInPandas(work, FACTS)


def newest_texts(contents: DataFrame) -> DataFrame:
    """(root_id, rel_path, file_id, content): each path once, with the newest text; of equal times the greatest."""
    c = contents.filter("root_id is not null and rel_path is not null and content is not null")
    return c.groupBy("root_id", "rel_path").agg(F.max(F.struct("modification_time", "content", "file_id")).alias("c")).select("root_id", "rel_path", "c.file_id", "c.content")


def symbols(found: DataFrame) -> DataFrame:
    """(symbol_id, root_id, file_id, rel_path, language, kind, name, owner, line_start, line_end) of the definitions among ``FACTS`` rows."""
    from codelode.functions.text import stable_id

    d = found.filter("fact = 'def'").dropDuplicates(["root_id", "rel_path", "name", "kind", "line_start"])
    sid = stable_id(F.col("root_id"), F.col("rel_path"), F.col("name"), F.col("kind"), F.coalesce("line_start", F.lit(0)).cast("string"))
    return d.select(sid.alias("symbol_id"), "root_id", "file_id", "rel_path", "language", "kind", "name", "owner", "line_start", "line_end")


def merged_clauses(defs: DataFrame) -> DataFrame:
    """Neighbouring definitions of the same name, kind and owner in a file as one, from the first's start to the last's end: clauses of one function."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("root_id", "rel_path").orderBy("line_start", "name", "kind")
    same = (F.lag("name").over(w) == F.col("name")) & (F.lag("kind").over(w) == F.col("kind")) & F.lag("owner").over(w).eqNullSafe(F.col("owner"))
    run = F.sum(F.when(same, 0).otherwise(1)).over(w)
    rows = defs.withColumn("_run", run).groupBy("root_id", "file_id", "rel_path", "language", "_run", "kind", "name", "owner").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    return rows.drop("_run")


def methods(defs: DataFrame) -> DataFrame:
    """Definitions whose owner is a class of the same file."""
    classes = defs.filter("kind = 'class'").select("root_id", "rel_path", F.col("name").alias("owner")).distinct()
    return defs.filter("kind in ('function', 'method')").join(classes, ["root_id", "rel_path", "owner"], "left_semi")


def merged_rules(defs: DataFrame) -> DataFrame:
    """Style rules of one name and kind in a file as one: from the first, to the last if no gap between two of them is more than one blank line, else the first alone."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("root_id", "rel_path", "name", "kind").orderBy("line_start", "line_end")
    rows = defs.withColumn("_gap", F.col("line_start") - F.lag("line_end").over(w))
    close = F.max(F.coalesce(F.col("_gap") > 2, F.lit(False)).cast("int")) == 0
    return rows.groupBy("root_id", "rel_path", "name", "kind").agg(F.min(F.struct("line_start", "line_end")).alias("f"), F.max("line_end").alias("_last"), close.alias("_close")).select(
        "root_id", "rel_path", "name", "kind", "f.line_start", F.when(F.col("_close"), F.col("_last")).otherwise(F.col("f.line_end")).alias("line_end")
    )

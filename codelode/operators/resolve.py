"""Names in code joined to what they stand for: imports to files, calls and bases to definitions, links and table names to their targets.

Every rule gives candidate keys in an order; the targets of a root are keyed once and counted, and only keys with one target
stay, so a candidate meets at most one row however often a name is used. The first rule with an
unambiguous target wins; an ambiguous one gives nothing.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.intervals import innermost
from codelode.operators.joins import salted_join

EXTRACTED, INFERRED = "EXTRACTED", "INFERRED"
_SCRIPT = (".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json")
# Languages whose imports are paths to a file, with the endings they may leave out.
_RELATIVE = {
    "bash": ("",), "powershell": ("", ".ps1", ".psm1"), "lua": (".lua", "/init.lua"), "perl": (".pm", ".pl"), "zig": ("",), "r": ("", ".R", ".r"), "julia": ("", ".jl"), "solidity": ("",), "css": ("", ".css"), "xml": ("",), "c": ("",), "cpp": ("",), "objc": ("",),
    "php": ("", ".php"), "ruby": ("", ".rb"), "swift": (".swift",), "elixir": (".ex", ".exs"), "ocaml": (".ml", ".mli"),
}
_CLASSES = {"java": (".java", ".kt", ".groovy"), "kotlin": (".kt", ".java"), "scala": (".scala", ".java"), "groovy": (".groovy", ".java", ".kt"), "csharp": (".cs",)}
_FORTRAN_OWN = frozenset("iso_c_binding iso_fortran_env ieee_arithmetic ieee_exceptions ieee_features omp_lib mpi".split())


def joined(base: str, path: str) -> str | None:
    """A path relative to a folder without dots; None if it leaves the root."""
    out = posixpath.normpath(posixpath.join(base, path))
    return None if out.startswith("..") or out.startswith("/") else out.removeprefix("./")


def candidates(language: str, importer: str, module: str, kind: str = "module") -> list[tuple[int, str, str, str]]:
    """(rule, mode, key, confidence) in order. Modes: path, suffix (a path's end), folder (all its code files), declared, unit, first (a folder's first file of settings)."""
    here, out = posixpath.dirname(importer), []

    def paths(rule: int, base: str, ends, conf: str = EXTRACTED, at: str = here) -> None:
        if (p := joined(at, base)) is not None:
            out.extend((rule, "path", p + e, conf) for e in ends)

    if language == "python":
        level = len(module) - len(module.lstrip("."))
        parts = [x for x in module[level:].split(".") if x]
        both = (".py", "/__init__.py") if parts else ("/__init__.py",)
        if level:
            base = here
            for _ in range(level - 1):
                base = posixpath.dirname(base)
            paths(1, "/".join(parts) or ".", both, at=base)
            return out
        name = "/".join(parts)
        for root in ("", "src"):
            paths(2, name, both, at=root)
        if kind == "guess":
            return out + [(2, "suffix", name + e, EXTRACTED) for e in both if len(parts) > 1]
        out += [(2, "suffix", name + e, EXTRACTED) for e in both if len(parts) > 1]
        if len(parts) == 1:
            paths(3, name, (".py",), INFERRED)
        return out + [(4, "suffix", name + e, INFERRED) for e in both]
    if language in ("javascript", "typescript", "vue", "svelte"):
        if module.startswith("."):
            bare = re.sub(r"\.(?:js|jsx|mjs|cjs)$", "", module)
            paths(1, module, ("",))
            paths(1, bare, _SCRIPT)
            paths(1, module, tuple("/index" + e for e in _SCRIPT))
        elif "/" in module:
            out += [(4, "suffix", module.lstrip("@~/") + e, INFERRED) for e in ("", *_SCRIPT, *("/index" + x for x in _SCRIPT))]
        return out
    if language == "rust":
        parts = [p for p in module.split("::") if p]
        inside = importer[: importer.rfind("src/") + 4].rstrip("/") if "src/" in importer else ""
        stem = posixpath.splitext(posixpath.basename(importer))[0]
        own = here if stem in ("mod", "lib", "main") else posixpath.join(here, stem)
        head, base = parts[0], None
        if head == "crate":
            base, parts = inside, parts[1:]
        elif head == "self":
            base, parts = own, parts[1:]
        else:
            base = own
            while parts and parts[0] == "super":
                base, parts, head = posixpath.dirname(base), parts[1:], "super"
        sure = EXTRACTED if head in ("crate", "self", "super") or len(parts) == 1 else INFERRED
        for n in range(len(parts), 0, -1):
            paths(1, "/".join(parts[:n]), (".rs", "/mod.rs"), sure, base)
        return out + [(4, "suffix", "/".join(parts[:n]) + ".rs", INFERRED) for n in range(len(parts), 1, -1)]
    if language == "dart":
        if module.startswith("dart:"):
            return []
        if m := re.match(r"package:[\w]+/(.+)$", module):
            return [(2, "path", "lib/" + m.group(1), INFERRED), (2, "suffix", "lib/" + m.group(1), INFERRED)]
        paths(1, module, ("",))
        return out
    if language in _CLASSES:
        name = module.replace(".", "/")
        if name.endswith("/*"):
            return [(1, "suffix", name[:-2] + e, EXTRACTED) for e in _CLASSES[language]] + [(2, "folder", name[:-2], EXTRACTED)]
        parent = name.rpartition("/")[0]
        return [(1, "suffix", name + e, EXTRACTED) for e in _CLASSES[language]] + [(2, "suffix", parent + e, EXTRACTED) for e in _CLASSES[language] if parent]
    if language == "haskell":
        return [(1, "declared", module, EXTRACTED), (2, "suffix", module.replace(".", "/") + ".hs", INFERRED)]
    if language == "fortran":
        if module.lower() in _FORTRAN_OWN:
            return []
        if "." in module:
            paths(2, module, ("",))
        return [(1, "declared", module.lower(), EXTRACTED), *out]
    if language == "pascal":
        return [(1, "unit", module.strip().lower(), INFERRED)]
    if language in ("scss", "less"):
        folder, name = posixpath.split(re.sub(r"^~", "", module))
        forms = [posixpath.join(folder, x) for x in (name, name + ".scss", f"_{name}.scss", f"_{name}", name + "/_index.scss", name + "/index.scss", name + ".less", name + ".css")]
        for rule, base, conf in ((1, here, EXTRACTED), (2, "", INFERRED), (3, "node_modules", INFERRED)):
            out += [(rule, "path", p, conf) for f in forms if (p := joined(base, f))]
        return out
    if language == "html":
        if re.match(r"[a-z]+:|//|#", module, re.I):
            return []
        m = re.sub(r"[?#].*", "", module)
        if m.startswith("/"):
            return [(1, "path", m[1:], EXTRACTED), (2, "path", "public" + m, INFERRED), (3, "path", "static" + m, INFERRED)]
        paths(1, m, ("",))
        return out
    if language == "hcl":
        if module.startswith(".") and (p := joined(here, module)):
            return [(1, "path", p + "/main.tf", EXTRACTED), (2, "first", p, EXTRACTED)]
        return []
    if language in _RELATIVE:
        if "$" in module:
            return []
        name = module.replace("::", "/").replace("\\", "/") if language in ("perl", "php") else module.replace(".", "/") if language in ("lua",) else re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", module.replace(".", "/")).lower() if language == "elixir" else module
        if language == "ocaml":
            name = name[:1].lower() + name[1:]
        paths(1, name, _RELATIVE[language])
        if language not in ("bash", "xml", "zig"):
            out += [(4, "suffix", name.lstrip("./") + e, INFERRED) for e in _RELATIVE[language]]
        return out
    return []


def targets(paths: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(root_id, mode, key, target): the keys that stand for one file of their root alone. ``declared`` has root_id, name and rel_path of modules that files declare."""
    p = paths.select("root_id", F.col("rel_path").alias("target")).filter("target is not null").distinct()
    parts = F.split("target", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    rows = p.select("root_id", F.lit("path").alias("mode"), F.col("target").alias("key"), "target").unionByName(p.select("root_id", F.lit("suffix").alias("mode"), F.explode(ends).alias("key"), "target"))
    unit = F.lower(F.regexp_extract("target", r"([^/]+)\.(?:pas|pp)$", 1))
    rows = rows.unionByName(p.filter(unit != "").select("root_id", F.lit("unit").alias("mode"), unit.alias("key"), "target"))
    if declared is not None:
        rows = rows.unionByName(declared.select("root_id", F.lit("declared").alias("mode"), F.col("name").alias("key"), F.col("rel_path").alias("target")))
    one = rows.groupBy("root_id", "mode", "key").agg(F.min("target").alias("target"), F.max("target").alias("_b")).filter(F.col("target") == F.col("_b")).drop("_b")
    tf = p.filter(F.col("target").endswith(".tf")).groupBy("root_id", F.regexp_replace("target", "/?[^/]*$", "").alias("key")).agg(F.min("target").alias("target"))
    return one.unionByName(tf.select("root_id", F.lit("first").alias("mode"), "key", "target"))


_FIELDS = "root_id string, rel_path string, module string, line_start int, rule int, place int, mode string, key string, confidence string"


def resolve_imports(found: DataFrame, paths: DataFrame, declared: DataFrame | None = None, go_modules: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(root_id, rel_path, module, target, confidence) of import facts (root_id, rel_path, language, kind, name, line_start).

    ``go_modules`` has root_id, prefix and folder of module files; ``aliases`` root_id, folder, pattern and goal of path tables (``*`` stands for
    any text), of which the nearest folder's longest pattern counts. A file never imports itself.
    """
    rows = found.filter("fact = 'import'").select("root_id", "rel_path", "language", "kind", F.col("name").alias("module"), "line_start").dropDuplicates(["root_id", "rel_path", "module"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for root, path, lang, kind, module, line in zip(b["root_id"], b["rel_path"], b["language"], b["kind"], b["module"], b["line_start"]):
                got = candidates("html" if lang == "html" else lang, path, module, kind)
                out += [(root, path, module, line, r, i, m, k, c) for i, (r, m, k, c) in enumerate(got)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _FIELDS.split(", ")]).astype({"line_start": "Int32"})

    asked = rows.mapInPandas(work, _FIELDS)
    if aliases is not None:
        asked = asked.unionByName(alias_candidates(rows, aliases))
    hits = salted_join(asked, targets(paths, declared), ["root_id", "mode", "key"], ["rel_path", "module"])
    best = hits.groupBy("root_id", "rel_path", "module").agg(F.min(F.struct("rule", "place", "target", "confidence")).alias("b"))
    out = best.select("root_id", "rel_path", "module", F.col("b.target").alias("target"), F.col("b.confidence").alias("confidence"))
    code = paths.select("root_id", F.col("rel_path").alias("target")).filter("target is not null").distinct()
    folders = code.select("root_id", F.regexp_replace("target", "/?[^/]*$", "").alias("key"), "target")
    many = asked.filter("mode = 'folder'").select("root_id", "rel_path", "module", "key", "confidence").join(out.select("root_id", "rel_path", "module"), ["root_id", "rel_path", "module"], "left_anti")
    tails = folders.select("root_id", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("key", "/"))), lambda i: F.array_join(F.slice(F.split("key", "/"), i, F.size(F.split("key", "/"))), "/"))).alias("key"))
    wide = many.join(tails.filter(F.col("target").rlike(r"\.(java|kt|groovy|scala|cs)$")), ["root_id", "key"]).select(*out.columns)
    out = out.unionByName(wide)
    if go_modules is not None:
        go = rows.filter("language = 'go'").withColumn("_m", F.split("module", "/"))
        cuts = F.transform(F.sequence(F.lit(1), F.size("_m")), lambda i: F.struct(i.alias("n"), F.array_join(F.slice("_m", F.lit(1), i), "/").alias("prefix"), F.array_join(F.slice("_m", i + 1, F.size("_m")), "/").alias("rest")))
        own = go_modules.groupBy("root_id", "prefix").agg(F.min("folder").alias("folder"), F.count("*").alias("_c")).filter("_c = 1").drop("_c")
        near = go.select("root_id", "rel_path", "module", F.explode(cuts).alias("x")).select("root_id", "rel_path", "module", "x.*").join(own, ["root_id", "prefix"])
        last = near.groupBy("root_id", "rel_path", "module").agg(F.max(F.struct("n", "folder", "rest")).alias("b"))
        at = F.array_join(F.filter(F.array("b.folder", "b.rest"), lambda x: x != ""), "/")
        files = folders.filter(F.col("target").endswith(".go") & ~F.col("target").endswith("_test.go"))
        out = out.unionByName(last.select("root_id", "rel_path", "module", at.alias("key")).join(files, ["root_id", "key"]).select("root_id", "rel_path", "module", "target", F.lit(EXTRACTED).alias("confidence")))
    return out.filter("rel_path <> target").distinct()


def alias_candidates(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Candidate keys of script imports by path tables: the nearest folder above the importer that has a table, an exact pattern before one with a star, of those the longest beginning."""
    scripts = rows.filter(F.col("language").isin("javascript", "typescript", "vue", "svelte") & ~F.col("module").startswith(".")).select("root_id", "rel_path", "module", "line_start")
    folder = F.regexp_replace("rel_path", "/?[^/]*$", "")
    parts = F.split(folder, "/")
    up = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    near = scripts.select("*", F.explode(F.array_distinct(up)).alias("folder")).join(aliases.select("root_id", "folder").distinct(), ["root_id", "folder"])
    own = near.groupBy("root_id", "rel_path", "module").agg(F.max(F.struct(F.length("folder").alias("n"), "folder", "line_start")).alias("b")).select("root_id", "rel_path", "module", "b.folder", "b.line_start")
    head, tail = F.substring_index("pattern", "*", 1), F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).otherwise("")
    star = F.col("pattern").contains("*")
    hit = own.join(aliases, ["root_id", "folder"]).filter(F.when(star, F.startswith("module", head) & F.endswith("module", tail)).otherwise(F.col("module") == F.col("pattern")))
    middle = F.expr("substring(module, length(substring_index(pattern, '*', 1)) + 1, length(module) - length(pattern) + 1)")
    goal = F.when(star, F.replace("goal", F.lit("*"), middle)).otherwise(F.col("goal"))
    best = hit.withColumn("_g", goal).withColumn("_w", F.when(star, F.length(head)).otherwise(100_000)).groupBy("root_id", "rel_path", "module").agg(F.max(F.struct("_w", "_g", "line_start")).alias("b"))
    ends = F.array(*[F.lit(e) for e in ("", *_SCRIPT, *("/index" + x for x in _SCRIPT))])
    rows2 = best.select("root_id", "rel_path", "module", F.col("b.line_start").alias("line_start"), F.posexplode(F.transform(ends, lambda e: F.concat(F.col("b._g"), e))).alias("place", "key"))
    return rows2.select("root_id", "rel_path", "module", F.col("line_start").cast("int").alias("line_start"), F.lit(0).alias("rule"), "place", F.lit("path").alias("mode"), F.regexp_replace("key", r"^\./", "").alias("key"), F.lit(EXTRACTED).alias("confidence"))


def resolve_calls(found: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(root_id, rel_path, line_start, name, caller, callee, tier, confidence) of call facts.

    Tiers: a method of the caller's class, a definition of the caller's file, of one imported file (the one the qualifier names, if several have it), a method of the own file, of
    one imported file, and the only definition of that name in the root. The first tier with candidates decides: if it has more than one, the call stays open. ``defs`` is a ``symbols`` table.
    """
    calls = found.filter("fact = 'call'").select("root_id", "rel_path", "line_start", "name").distinct()
    calls = calls.withColumn("last", F.element_at(F.split("name", r"\."), -1)).withColumn("qualifier", F.when(F.col("name").contains("."), F.element_at(F.split("name", r"\."), -2)))
    spans = defs.withColumn("_file", F.concat_ws("\x1f", "root_id", "rel_path"))
    calls = innermost(calls.withColumn("_file", F.concat_ws("\x1f", "root_id", "rel_path")), spans, "_file", "line_start", "symbol_id").drop("_file").withColumnRenamed("symbol_id", "caller")
    calls = calls.join(defs.select(F.col("symbol_id").alias("caller"), F.col("owner").alias("_class")), "caller", "left")
    d = defs.select("root_id", "rel_path", F.col("name").alias("last"), "owner", "kind", F.col("symbol_id").alias("callee"))
    free = d.filter("kind <> 'method'")
    out = calls.join(d.filter("kind = 'method'").withColumnRenamed("owner", "_class"), ["root_id", "rel_path", "last", "_class"]).select(*_CALL, F.lit(1).alias("tier"), F.lit(0).alias("_q"))
    out = out.unionByName(calls.join(free, ["root_id", "rel_path", "last"]).select(*_CALL, F.lit(2).alias("tier"), F.lit(0).alias("_q")))
    out = out.unionByName(calls.join(d.filter("kind = 'method'"), ["root_id", "rel_path", "last"]).select(*_CALL, F.lit(4).alias("tier"), F.lit(0).alias("_q")))
    # the names a file calls meet its imports first, so no name of the whole root is joined to another
    asked = calls.select("root_id", "rel_path", "last").distinct().join(imports.select("root_id", "rel_path", "target").distinct(), ["root_id", "rel_path"])
    there = asked.join(d.withColumnRenamed("rel_path", "target"), ["root_id", "target", "last"])
    hit = calls.join(there.select("root_id", "rel_path", "last", "target", "kind", "callee"), ["root_id", "rel_path", "last"])
    named = F.when(F.regexp_replace(F.regexp_extract("target", r"([^/]+)$", 1), r"\.[^.]*$", "") == F.col("qualifier"), -1).otherwise(0)
    out = out.unionByName(hit.select(*_CALL, F.when(F.col("kind") == "method", 5).otherwise(3).alias("tier"), named.alias("_q")))
    only = free.groupBy("root_id", "last").agg(F.min("callee").alias("callee"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    out = out.unionByName(salted_join(calls, only, ["root_id", "last"], ["rel_path", "line_start"]).select(*_CALL, F.lit(6).alias("tier"), F.lit(0).alias("_q")))
    each = out.groupBy("root_id", "rel_path", "line_start", "name", "caller", "tier", "_q").agg(F.min("callee").alias("a"), F.max("callee").alias("b"))
    first = each.groupBy("root_id", "rel_path", "line_start", "name", "caller").agg(F.min(F.struct("tier", "_q", "a", "b")).alias("m")).filter("m.a = m.b")
    sure = F.when(F.col("m.tier") <= 3, EXTRACTED).otherwise(INFERRED)
    return first.select("root_id", "rel_path", "line_start", "name", "caller", F.col("m.a").alias("callee"), F.col("m.tier").alias("tier"), sure.alias("confidence"))


_CALL = ("root_id", "rel_path", "line_start", "name", "caller", "callee")


def resolve_bases(found: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(root_id, child, parent, confidence) of base facts: a type of the own file, of one imported file, else the only one of that name in the root."""
    types = defs.filter("kind in ('class', 'rule')").select("root_id", "rel_path", F.col("name").alias("base"), F.col("symbol_id").alias("parent"))
    rows = found.filter("fact = 'base'").select("root_id", "rel_path", F.col("owner").alias("_child"), F.element_at(F.split("name", r"[.:\\]+"), -1).alias("base")).distinct()
    own = defs.filter("kind = 'class'").groupBy("root_id", "rel_path", F.col("name").alias("_child")).agg(F.min("symbol_id").alias("child"))
    rows = rows.join(own, ["root_id", "rel_path", "_child"])
    one = rows.join(types, ["root_id", "rel_path", "base"]).select("root_id", "child", "base", "parent", F.lit(1).alias("tier"))
    near = rows.join(imports.select("root_id", "rel_path", "target").distinct(), ["root_id", "rel_path"]).join(types.withColumnRenamed("rel_path", "target"), ["root_id", "target", "base"]).select("root_id", "child", "base", "parent", F.lit(2).alias("tier"))
    only = types.groupBy("root_id", "base").agg(F.min("parent").alias("parent"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    far = salted_join(rows, only, ["root_id", "base"], ["rel_path"]).select("root_id", "child", "base", "parent", F.lit(3).alias("tier"))
    each = one.unionByName(near).unionByName(far).filter("child <> parent").groupBy("root_id", "child", "base", "tier").agg(F.min("parent").alias("a"), F.max("parent").alias("b"))
    first = each.groupBy("root_id", "child", "base").agg(F.min(F.struct("tier", "a", "b")).alias("m")).filter("m.a = m.b")
    return first.select("root_id", "child", F.col("m.a").alias("parent"), F.when(F.col("m.tier") < 3, EXTRACTED).otherwise(INFERRED).alias("confidence"))


def resolve_links(found: DataFrame, paths: DataFrame) -> DataFrame:
    """(root_id, rel_path, target) of link facts: from the root, from the document's folder, then by file name, of several the first in order."""
    rows = found.filter("fact = 'link'").select("root_id", "rel_path", F.regexp_replace("name", r"[#?].*$", "").alias("link")).filter("link <> ''").distinct()
    p = paths.select("root_id", F.col("rel_path").alias("target")).filter("target is not null").distinct()
    up = F.concat(F.regexp_replace("rel_path", r"/?[^/]*$", ""), F.lit("/"), F.col("link"))
    up = F.regexp_replace(up, r"(^|/)(?:\./)+", "$1")
    for _ in range(4):
        up = F.regexp_replace(up, r"(^|/)(?!\.\.)[^/]+/\.\./", "$1")
    keys = F.array(F.struct(F.lit(1).alias("tier"), F.regexp_replace("link", "^/", "").alias("key")), F.struct(F.lit(2).alias("tier"), F.regexp_replace(up, "^/", "").alias("key")))
    asked = rows.select("root_id", "rel_path", "link", F.explode(keys).alias("k")).select("root_id", "rel_path", "link", "k.*")
    hit = asked.join(p.withColumn("key", F.col("target")), ["root_id", "key"]).select("root_id", "rel_path", "link", "tier", "target")
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    base = p.select("root_id", F.explode(F.array_distinct(F.array(name("target"), F.regexp_replace(name("target"), r"\.md$", "")))).alias("key"), "target").groupBy("root_id", "key").agg(F.min("target").alias("target"))
    loose = salted_join(rows.withColumn("key", name("link")), base, ["root_id", "key"], ["rel_path"]).select("root_id", "rel_path", "link", F.lit(3).alias("tier"), "target")
    best = hit.unionByName(loose).groupBy("root_id", "rel_path", "link").agg(F.min(F.struct("tier", "target")).alias("m"))
    return best.select("root_id", "rel_path", F.col("m.target").alias("target")).filter("rel_path <> target").distinct()


def resolve_tables(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """(root_id, rel_path, name, symbol_id): table mentions (root_id, rel_path, name) joined to table definitions of another file; of several the first by path and id."""
    low = tables.select("root_id", F.lower("name").alias("name"), F.col("rel_path").alias("_p"), "symbol_id")
    first = low.groupBy("root_id", "name").agg(F.slice(F.sort_array(F.collect_set(F.struct("_p", "symbol_id"))), 1, 2).alias("s"))  # a table's definitions; two are enough to leave out one's own
    rows = salted_join(refs.select("root_id", "rel_path", F.lower("name").alias("name")).distinct(), first, ["root_id", "name"], ["rel_path"])
    other = F.get(F.filter("s", lambda x: x["_p"] != F.col("rel_path")), F.lit(0))
    return rows.select("root_id", "rel_path", "name", other["symbol_id"].alias("symbol_id")).filter("symbol_id is not null")


def resolve_only(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """(root_id, rel_path, name, symbol_id): whole-name mentions joined to the one definition of that name in any case; names of several give none."""
    one = defs.groupBy("root_id", F.lower("name").alias("name")).agg(F.min("symbol_id").alias("symbol_id"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return salted_join(refs.select("root_id", "rel_path", F.lower("name").alias("name")).distinct(), one, ["root_id", "name"], ["rel_path"])


def respelled(rows: DataFrame, column: str, defined: DataFrame) -> DataFrame:
    """``rows`` with ``column`` in the one spelling in which its root defines it (``defined``: root_id, name), in any case; other names stay."""
    one = defined.select("root_id", "name").distinct().groupBy("root_id", F.lower("name").alias("_low")).agg(F.min("name").alias("_name"), F.max("name").alias("_b")).filter("_name = _b").drop("_b")
    out = salted_join(rows.withColumn("_low", F.lower(column)), one, ["root_id", "_low"], [column], "left")
    return out.withColumn(column, F.coalesce("_name", column)).drop("_low", "_name")


def lineage(revisions: DataFrame) -> DataFrame:
    """(root_id, rel_path, target): migrations (root_id, rel_path, revision, down) joined to the one file of the revision they follow."""
    one = revisions.select("root_id", "revision", F.col("rel_path").alias("target")).distinct().groupBy("root_id", F.col("revision").alias("down")).agg(F.min("target").alias("target"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return revisions.select("root_id", "rel_path", "down").join(one, ["root_id", "down"]).select("root_id", "rel_path", "target").filter("rel_path <> target").distinct()

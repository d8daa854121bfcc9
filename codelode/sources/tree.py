"""File trees, JSON lines, commit logs and office documents as tables."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codelode.functions.text import admits, size_limit, stable_id

# Folders that are never read, and names that hold secrets.
SKIPPED = r"(^|/)(\.git|\.hg|\.svn|node_modules|__pycache__|\.venv|venv|\.tox|\.mypy_cache|\.pytest_cache)/"
SECRET_NAME = r"(?i)(^|/)(\.env(\.\w+)?|id_(rsa|dsa|ecdsa|ed25519)|\.netrc|\.npmrc|\.pypirc|credentials(\.json)?|[^/]*\.(pem|key|p12|pfx|jks|keystore))$"
#: Limits of one document: parts, characters, sheets, and unpacked bytes for each packed one.
MAX_PARTS, MAX_CHARS, MAX_SHEETS, MAX_RATIO = 2000, 2_000_000, 64, 200


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, limit: int = 1_000_000) -> DataFrame:
    """(rel_path, content, length, modification_time, hash) of the admitted files under ``root``.

    The largest size any file may have is a plain filter on ``length``, which the source uses before it opens a file; skipped folders,
    secret names and globs are tested on paths read so. ``listing`` gives the same rows without opening any file. An empty folder gives no rows.
    """
    return _admitted(spark, root, include, exclude, limit).select("rel_path", "content", "length", F.col("modificationTime").alias("modification_time"), F.sha2("content", 256).alias("hash"))


def listing(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, limit: int = 1_000_000) -> DataFrame:
    """(rel_path, path, length, modification_time) of the same files; contents are not read."""
    return _admitted(spark, root, include, exclude, limit).select("rel_path", "path", "length", F.col("modificationTime").alias("modification_time"))


def oversized(spark: SparkSession, root: str, limit: int = 1_000_000) -> DataFrame:
    """(rel_path, length) of files over their size limit, which ``scan`` leaves out; contents are not read."""
    rows = _paths(spark, root).filter(~F.col("rel_path").rlike(SKIPPED) & (F.col("length") > size_limit(F.col("rel_path"), limit)))
    return rows.select("rel_path", "length")


def changed_since(spark: SparkSession, root: str, scanned: DataFrame) -> DataFrame:
    """(rel_path): scanned files that are gone or have another length or time now."""
    now = listing(spark, root).select("rel_path", "length", "modification_time")
    return scanned.select("rel_path", "length", "modification_time").join(now, ["rel_path", "length", "modification_time"], "left_anti").select("rel_path")


def colliding(scanned: DataFrame) -> DataFrame:
    """(canonical, paths): paths that are one after composing their letters; a scan with any is to be refused."""

    @F.pandas_udf(StringType())
    def composed(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)

    rows = scanned.select("rel_path").distinct().withColumn("canonical", composed("rel_path"))
    return rows.groupBy("canonical").agg(F.count("*").alias("paths")).filter("paths > 1")


def _paths(spark: SparkSession, root: str) -> DataFrame:
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    prefix = len(base.removeprefix("file:").lstrip("/"))
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*", "")
    return rows.withColumn("rel_path", F.substring(plain, prefix + 2, 1 << 20))


def _admitted(spark: SparkSession, root: str, include: list[str] | None, exclude: list[str] | None, limit: int) -> DataFrame:
    rows = _paths(spark, root).filter(F.col("length") <= max(limit, 20 * 1024 * 1024))  # a literal, so it is pushed to the source
    rows = rows.filter(~F.col("rel_path").rlike(SKIPPED) & ~F.col("rel_path").rlike(SECRET_NAME) & (F.col("length") <= size_limit(F.col("rel_path"), limit)))
    return rows.filter(admits(F.col("rel_path"), include or [], exclude or []))


def file_rows(scanned: DataFrame, root_id: str) -> DataFrame:
    """The file table of a scan: (file_id, root_id, rel_path, filename, size, mtime, hash)."""
    return scanned.select(
        stable_id(F.lit(root_id), F.col("rel_path")).alias("file_id"), F.lit(root_id).alias("root_id"), "rel_path", F.regexp_extract("rel_path", r"([^/]+)$", 1).alias("filename"),
        F.col("length").alias("size"), F.col("modification_time").alias("mtime"), "hash",
    )


def decode(data: bytes | None) -> str | None:
    """Text of bytes: UTF-16 with its mark, else UTF-8 without its mark; what cannot be decoded is left out."""
    if data is None:
        return None
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return bytes(data).decode("utf-16", "ignore")
    return bytes(data).decode("utf-8-sig", "ignore")


def texts(scanned: DataFrame) -> DataFrame:
    """(rel_path, content) of scanned files, decoded."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rel_path": b["rel_path"], "content": [decode(c) for c in b["content"]]})

    return scanned.select("rel_path", "content").mapInPandas(work, "rel_path string, content string")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; a line that is no such object fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of a dumped log, newest first in the file; ids count from the oldest.

    Records end with 0x1e and begin with sha, date, subject and body, each followed by
    0x1f; the lines after them name files, status first, a rename's old path before its new. Records are split by the reader and parsed in place;
    only their numbering brings records into one order, by the position in the file.
    """
    raw = spark.read.option("lineSep", "\x1e").text(path)
    parts = F.split(F.regexp_replace("value", r"^\s+", ""), "\x1f")
    rows = raw.withColumn("p", parts).filter(F.size("p") >= 5)
    numbered = rows.rdd.zipWithIndex().map(lambda r: (r[1], list(r[0].p))).toDF("at bigint, p array<string>")
    n = numbered.count()
    c = numbered.select((F.lit(n) - F.col("at")).alias("id"), *[F.trim(F.col("p")[i]).alias(k) for i, k in enumerate(("sha", "date", "subject", "body"))], F.col("p")[4].alias("_f"))
    lines = c.select(F.col("id").alias("commit_id"), F.explode(F.split("_f", "\n")).alias("line")).filter(F.col("line").contains("\t")).select("commit_id", F.split("line", "\t").alias("x"))
    files = lines.select("commit_id", F.substring(F.col("x")[0], 1, 1).alias("status"), F.element_at("x", -1).alias("path"), F.when(F.size("x") > 2, F.col("x")[1]).alias("old_path")).filter("status <> ''")
    return c.drop("_f").withColumn("date", F.to_timestamp("date")), files


def commit_tables(spark: SparkSession, text: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``read_log`` of a log at hand, such as a version control command's output: it is written to the shared folder first."""
    from codelode.session import scratch

    at = folder or scratch(spark, "log")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(at)
    return read_log(spark, at)


# ---------------------------------------------------------------- office documents


def _xml(zf: zipfile.ZipFile, name: str) -> ElementTree.Element:
    info = zf.getinfo(name)
    if info.file_size > 1_000_000 and info.file_size > MAX_RATIO * max(1, info.compress_size):
        raise ValueError("unpacks too large")
    data = zf.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("entities are not read")
    return ElementTree.fromstring(data)


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _text(e) -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == "t")


def _docx(zf):
    """Sections at headings of levels one to three; text before the first is titled by its first block."""
    title, block, out = None, [], []
    for p in _xml(zf, "word/document.xml").iter():
        if _tag(p) != "p":
            continue
        style = next((v for s in p.iter() if _tag(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
        text = _text(p).strip()
        if re.fullmatch(r"(?i)heading ?[1-3]|title", style) and text:
            if block or title:
                out.append((title or block[0], "\n".join(block)))
            title, block = text, []
        elif text:
            block.append(text)
    if block or title:
        out.append((title or block[0], "\n".join(block)))
    return out


def _listed(zf, book: str, folder: str, kind: str) -> list[tuple[str | None, str]]:
    """(name, member) of a book's sheets or slides in the order the book lists them; members it does not list are left out."""
    rels = {}
    base = book.rpartition("/")[0]
    for r in _xml(zf, f"{base}/_rels/{book.rpartition('/')[2]}.rels"):
        rels[r.attrib.get("Id")] = r.attrib.get("Target", "")
    out = []
    for e in _xml(zf, book).iter():
        if _tag(e) == kind:
            target = rels.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), None), "")
            member = target.lstrip("/") if target.startswith("/") else f"{base}/{target}"
            if member.startswith(f"{base}/{folder}/") and member in zf.namelist():
                out.append((e.attrib.get("name"), member))
    return out


def _xlsx(zf):
    """One part for each sheet in the workbook's order, shared strings put in; strings that no cell uses are a last part."""
    shared = [_text(si) for si in _xml(zf, "xl/sharedStrings.xml") if _tag(si) == "si"] if "xl/sharedStrings.xml" in zf.namelist() else []
    try:
        sheets = _listed(zf, "xl/workbook.xml", "worksheets", "sheet")
    except KeyError:
        names = [s.attrib.get("name") for s in _xml(zf, "xl/workbook.xml").iter() if _tag(s) == "sheet"]
        files = sorted((n for n in zf.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2]).group()))
        sheets = [(names[i] if i < len(names) else None, f) for i, f in enumerate(files)]
    out, used = [], set()
    for name, sheet in sheets[:MAX_SHEETS]:
        rows = []
        for row in (e for e in _xml(zf, sheet).iter() if _tag(e) == "row"):
            cells = []
            for c in (e for e in row if _tag(e) == "c"):
                v = next((x.text or "" for x in c if _tag(x) == "v"), _text(c))
                if c.attrib.get("t") == "s" and v.isdigit() and int(v) < len(shared):
                    used.add(int(v))
                    v = shared[int(v)]
                cells.append(v)
            rows.append("\t".join(cells))
        out.append((name, "\n".join(rows)))
    rest = [t for i, t in enumerate(shared) if i not in used and t.strip()]
    return out + ([(None, "\n".join(rest))] if rest else [])


def _pptx(zf):
    """One part for each slide in the presentation's order, titled by its first text."""
    try:
        slides = [m for _, m in _listed(zf, "ppt/presentation.xml", "slides", "sldId")]
    except KeyError:
        slides = sorted((n for n in zf.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2]).group()))
    out = []
    for slide in slides:
        paragraphs = [t for p in _xml(zf, slide).iter() if _tag(p) == "p" and (t := _text(p).strip())]
        out.append((paragraphs[0] if paragraphs else None, "\n".join(paragraphs)))
    return out


_PDF_STRING = re.compile(rb"\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>")


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode().ljust(2, "0")[: len(re.sub(rb"\s", b"", raw[1:-1])) // 2 * 2])
    else:
        names = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1).isdigit() else names.get(m.group(1), m.group(1)), raw[1:-1], flags=re.S)
    return data.decode("utf-16", "ignore") if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data.decode("latin-1")


def _pdf(data: bytes):
    """(title, text) of each page that writes its text in plain strings, in page order; encrypted files are refused. Fonts with own encodings come out as their codes."""
    if not data.startswith(b"%PDF") or b"/Encrypt" in data:
        raise ValueError("no readable document")
    objects = {int(m.group(1)): m.group(2) for m in re.finditer(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream", body)
        if not m:
            return b""
        if b"/FlateDecode" not in body:
            return m.group(1)
        d = zlib.decompressobj()
        return d.decompress(m.group(1), MAX_CHARS * 4)

    pages = [o for _, o in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", o)]
    out = []
    for page in pages[:MAX_PARTS]:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        text = []
        for n in re.findall(rb"(\d+)\s+\d+\s+R", m.group(1)) if m else []:
            for op in re.finditer(rb"(?s)((?:\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>|\[(?:\((?:\\.|[^()\\])*\)|[^\]])*\]))\s*(?:Tj|TJ|'|\")|(T\*|Td|TD|ET)\b", stream(objects.get(int(n), b""))):
                text.append("\n" if op.group(2) else "".join(_pdf_string(x) for x in _PDF_STRING.findall(op.group(1))))
        lines = [ln.strip() for ln in "".join(text).split("\n") if ln.strip()]
        out.append((f"Page {len(out) + 1}", "\n".join(lines)))
    return out


def _svg(data: bytes):
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("entities are not read")
    root = ElementTree.fromstring(data)
    found = [(_tag(e), (e.text or "").strip()) for e in root.iter() if _tag(e) in ("title", "desc", "text", "tspan")]
    title = next((t for k, t in found if k == "title"), None)
    return [(title, "\n".join(t for _, t in found if t))]


def document_parts(path: str, data: bytes | None) -> tuple[str, list[tuple]]:
    """(status, [(part_kind, part_number, title, text), ...]) of an office document.

    Status is ``ok``, ``empty``, ``unreadable`` or ``unsupported``; parts and characters are
    capped, and a capped document has the status ``truncated: parts`` or ``truncated: characters``.
    """
    kind = path.rpartition(".")[2].lower()
    readers = {"docx": (_docx, "section"), "xlsx": (_xlsx, "sheet"), "pptx": (_pptx, "slide")}
    if kind not in readers and kind not in ("svg", "pdf"):
        return "unsupported", []
    try:
        if kind == "svg":
            pairs, name = _svg(bytes(data or b"")), "document"
        elif kind == "pdf":
            pairs, name = _pdf(bytes(data or b"")), "page"
        else:
            read, name = readers[kind]
            with zipfile.ZipFile(io.BytesIO(bytes(data or b""))) as zf:
                pairs = read(zf)
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, OSError, zlib.error):
        return "unreadable", []
    pairs = [(t, x) for t, x in pairs if x.strip()]
    if not pairs:
        return "empty", []
    out, size = [], 0
    for n, (title, text) in enumerate(pairs):
        if n >= MAX_PARTS:
            return "truncated: parts", out
        if size + len(text) > MAX_CHARS:
            return "truncated: characters", out
        size += len(text)
        out.append((name, n + 1, title, text))
    return "ok", out


def documents(scanned: DataFrame) -> DataFrame:
    """(rel_path, status, part_kind, part_number, title, text) of scanned office documents; one without parts has one row with nulls."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["rel_path"], b["content"]):
                status, parts = document_parts(path, data)
                rows += [(path, status, *p) for p in parts] or [(path, status, None, None, None, None)]
            yield pd.DataFrame(rows, columns=["rel_path", "status", "part_kind", "part_number", "title", "text"]).astype({"part_number": "Int32"})

    return scanned.select("rel_path", "content").mapInPandas(work, "rel_path string, status string, part_kind string, part_number int, title string, text string")


def document_text(parts: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """(rel_path, text): each document's parts in order as one collapsed line, cut at ``limit``."""
    rows = parts.filter("text is not null").groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct("part_number", "text"))).alias("p"))  # the parts of one document, capped when read
    return rows.select("rel_path", F.substring(F.trim(F.regexp_replace(F.array_join("p.text", " "), r"\s+", " ")), 1, limit).alias("text"))


#: Why a document is known by its name alone.
REASONS = {"empty": "it holds no text", "unreadable": "it could not be read", "unsupported": "its format is not read"}


def document_reports(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rel_path, reason) of documents known by name alone, (rel_path, cut) of those a cap cut), each by path."""
    rows = parts.select("rel_path", "status").distinct()
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("status")]
    cut_at = F.regexp_extract("status", r"^truncated: (.+)$", 1)
    return rows.select("rel_path", reason.alias("reason")).filter("reason is not null").orderBy("rel_path"), rows.select("rel_path", cut_at.alias("cut")).filter("cut <> ''").orderBy("rel_path")

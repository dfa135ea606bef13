"""Documents as text: one file for each row, read with its content hash and parsed in a task."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import arrow_udf

#: What files that are cut off, damaged or locked raise: archives, XML, compressed streams, numbers and places in them.
BROKEN = (zipfile.BadZipFile, zlib.error, ET.ParseError, LookupError, ValueError, RuntimeError, NotImplementedError, EOFError)
SUPPORTED = ("pdf", "docx", "xlsx", "txt", "md", "markdown", "csv")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(content: bytes) -> str:
    """Paragraphs that hold text, those in tables included, then the tables' rows as ``a | b``."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
    said = lambda e: "".join(t.text or "" for t in e.iter(_W + "t"))
    lines = [said(p) for p in body.iter(_W + "p")]
    for row in body.iter(_W + "tr"):
        lines.append(" | ".join(said(c).strip() for c in row.findall(_W + "tc")))
    return "\n".join(x for x in lines if x.strip())


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation ids of a part and the parts they name."""
    folder, _, name = part.rpartition("/")
    at = f"{folder}/_rels/{name}.rels"
    if at not in z.namelist():
        return {}
    relative = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}")
    return {r.get("Id"): relative(r.get("Target", "")) for r in ET.fromstring(z.read(at))}


def xlsx_text(content: bytes) -> str:
    """``## Sheet: name`` and tab-joined rows of each sheet, in the workbook's order and by its relations."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(_S + "si")] if "xl/sharedStrings.xml" in names else []
        targets = _targets(z, "xl/workbook.xml")
        for i, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"), 1):
            name = targets.get(sheet.get(_R + "id"), f"xl/worksheets/sheet{i}.xml")
            if name not in names:
                continue
            out.append(f"## Sheet: {sheet.get('name')}")
            for row in ET.fromstring(z.read(name)).iter(_S + "row"):
                cells = []
                for c in row.findall(_S + "c"):
                    v = c.find(_S + "v")
                    raw = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(_S + "t"))
                    cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw)
                out.append("\t".join(cells))
    return "\n".join(out)


def pdf_text(content: bytes) -> str:
    """Text operators of a PDF's plain and deflated page streams, as ``## Page n`` blocks.

    Simple fonts only: files whose text is held in composite fonts give little or nothing.
    """
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.DOTALL):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        shown = re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", data)
        words = [a or b"".join(re.findall(rb"\(((?:[^()\\]|\\.)*)\)", b)) for a, b in shown]
        text = b"\n".join(words).decode("latin-1")
        pages.append(re.sub(r"\\([()\\])", r"\1", text))
    return "\n\n".join(f"## Page {i}\n{t}" for i, t in enumerate(pages, 1))


def parse(content: bytes, ext: str) -> str | None:
    """The text of one file; null where the format is not supported or the file is broken."""
    try:
        if ext == "docx":
            return docx_text(content)
        if ext == "xlsx":
            return xlsx_text(content)
        if ext == "pdf":
            return pdf_text(content)
        return content.decode("utf-8", "replace") if ext in SUPPORTED else None
    except BROKEN:
        return None


@arrow_udf("string")
def parse_content(contents: pd.Series, exts: pd.Series) -> pd.Series:
    return pd.Series([parse(c, e) for c, e in zip(contents, exts, strict=True)], dtype=object)


def parsed(files: DataFrame) -> DataFrame:
    """(path, length, content) -> (sha256, path, filename, ext, size_bytes, text): files by content, the first of equal ones."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.sha2("content", 256).alias("sha256"), "path", name.alias("filename"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("ext"), F.col("length").alias("size_bytes"), "content")
    first = rows.groupBy("sha256").agg(F.min("path").alias("_first"))
    kept = rows.join(first, ["sha256"]).filter("path = _first")
    return kept.select("sha256", "path", "filename", "ext", "size_bytes", parse_content("content", "ext").alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder, ``parsed``."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))

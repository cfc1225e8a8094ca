"""Text of office documents in archives: docx, pptx, xlsx, odt, ods, odp; PDF where a reader is installed."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

MAX_XML = 256 << 20


def _xml(z: zipfile.ZipFile, name: str):
    if z.getinfo(name).file_size > MAX_XML:
        raise ValueError(f"{name} unpacks to more than {MAX_XML} bytes")
    return ET.fromstring(z.read(name))


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _runs(root, paragraph: str, text: str, breaks: tuple = ()) -> list[str]:
    """Texts of all paragraphs; breaks are elements that stand for a blank."""
    out = []
    for p in root.iter():
        if _local(p) != paragraph:
            continue
        s = ""
        for e in p.iter():
            if _local(e) == text and e.text:
                s += e.text
            elif _local(e) in breaks:
                s += "\t" if _local(e) == "tab" else "\n"
        if s.strip():
            out.append(s)
    return out


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _docx(z):
    return "\n".join(_runs(_xml(z, "word/document.xml"), "p", "t", ("tab", "br")))


def _pptx(z):
    parts = []
    for k, n in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml"), 1):
        text = "\n".join(_runs(_xml(z, n), "p", "t", ("br",)))
        if text:
            parts.append(f"--- Slide {k} ---\n{text}")
    return "\n\n".join(parts)


def _xlsx(z):
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _xml(z, "xl/sharedStrings.xml") if _local(si) == "si"]
    parts = []
    for k, n in enumerate(_numbered(z, r"xl/worksheets/sheet(\d+)\.xml"), 1):
        rows = []
        for row in _xml(z, n).iter():
            if _local(row) != "row":
                continue
            cells = []
            for c in row:
                v = next((e.text or "" for e in c.iter() if _local(e) == "v"), None)
                if c.get("t") == "s" and v is not None:
                    v = shared[int(v)] if v.isdigit() and int(v) < len(shared) else ""
                elif c.get("t") == "inlineStr":
                    v = "".join(e.text or "" for e in c.iter() if _local(e) == "t")
                cells.append(v or "")
            if any(cells):
                rows.append("\t".join(cells))
        if rows:
            parts.append(f"--- Sheet {k} ---\n" + "\n".join(rows))
    return "\n\n".join(parts)


def _odf(z):
    root, out = _xml(z, "content.xml"), []
    body = next((e for e in root.iter() if _local(e) == "body"), root)
    tables = [t for t in body.iter() if _local(t) == "table"]
    if any(_local(e) == "spreadsheet" for e in body):
        for k, t in enumerate(tables, 1):
            rows = []
            for r in t.iter():
                if _local(r) == "table-row":
                    cells = ["".join(c.itertext()).strip() for c in r if _local(c) == "table-cell"]
                    if any(cells):
                        rows.append("\t".join(cells).rstrip("\t"))
            if rows:
                out.append(f"--- Sheet {k} ---\n" + "\n".join(rows))
        return "\n\n".join(out)
    pages = [p for p in body.iter() if _local(p) == "page"]
    if pages:
        for k, p in enumerate(pages, 1):
            text = "\n".join(s for e in p.iter() if _local(e) in ("p", "h") and (s := "".join(e.itertext()).strip()))
            if text:
                out.append(f"--- Slide {k} ---\n{text}")
        return "\n\n".join(out)
    return "\n".join(s for e in body.iter() if _local(e) in ("p", "h") and (s := "".join(e.itertext()).strip()))


def _pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError:
        return ""
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


_READERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "odt": _odf, "ods": _odf, "odp": _odf}


def office_text(path: str, data: bytes | None) -> str | None:
    """The text, None where the file is no archive of its kind or broken."""
    ext = path.rsplit(".", 1)[-1].lower()
    try:
        if ext == "pdf":
            return _pdf(bytes(data or b""))
        with zipfile.ZipFile(io.BytesIO(bytes(data or b""))) as z:
            return _READERS[ext](z)
    except (KeyError, ValueError, OSError, zipfile.BadZipFile, ET.ParseError):
        return None


def document_text(path: Column, content: Column) -> Column:
    @F.pandas_udf("string")
    def read(p: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([office_text(a, b) for a, b in zip(p, c)], dtype=object)

    return read(path, content)


def documents(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, text) of all office documents among the files."""
    ship(files.sparkSession)
    kinds = "|".join([*_READERS, "pdf"])
    src = files.where(F.col(path).rlike(rf"(?i)\.({kinds})$"))
    return src.select(F.col(path).alias("path"), document_text(F.col(path), F.col(content)).alias("text"))

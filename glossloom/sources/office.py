"""Strings of zip-based documents: docx, xlsx, pptx, epub; and the documents with new strings.

A unit's place is (container, seq): the part of the zip and the number of the string in it, kept from extraction to
rebuilding, so a change of settings between them can't misplace texts.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import escape, unescape
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.functions.predicates import is_translatable_doc
from glossloom.functions.text import trim

# Fixed values of the formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PAGES = re.compile(r"\.(x?html?|xhtm)$", re.IGNORECASE)
SHEETS = re.compile(r"^xl/worksheets/sheet\d+\.xml$")
SLIDES = re.compile(r"^ppt/slides/slide(\d+)\.xml$")
PAGE_TOKEN = re.compile(r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+|<", re.IGNORECASE | re.DOTALL)

STRINGS = "path string, doc_type string, container string, seq int, text string, error string"


def holders(root: ET.Element, outer: str, inner: str, first_only: bool = False) -> Iterator[list[ET.Element]]:
    """The text elements of each outer element that has any."""
    for node in root.iter(outer):
        texts = list(node.iter(inner))
        if texts:
            yield texts[:1] if first_only else texts


def parts(kind: str, z: zipfile.ZipFile) -> Iterator[tuple[str, Callable[[ET.Element], Iterator[list[ET.Element]]]]]:
    """The XML parts that hold a document's strings, and how to find them there."""
    names = z.namelist()
    if kind == "docx":
        yield "word/document.xml", lambda r: holders(r, f"{WORD}p", f"{WORD}t")
    elif kind == "xlsx":
        if "xl/sharedStrings.xml" in names:
            yield "xl/sharedStrings.xml", lambda r: holders(r, f"{SHEET}si", f"{SHEET}t")
        for n in filter(SHEETS.match, names):
            yield n, lambda r: holders(r, f"{SHEET}is", f"{SHEET}t", True)
    elif kind == "pptx":
        for n in sorted(filter(SLIDES.match, names), key=lambda n: int(SLIDES.match(n)[1])):
            yield n, lambda r: holders(r, f"{DRAWING}p", f"{DRAWING}t")


def tokens_of(html: str) -> list[str]:
    return [m[0] for m in PAGE_TOKEN.finditer(html)]


def strings(kind: str, data: bytes) -> Iterator[tuple[str, int, str]]:
    """container, seq, text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if kind == "epub":
            for name in filter(PAGES.search, z.namelist()):
                toks = tokens_of(z.read(name).decode("utf-8", "replace"))
                body = next((i for i, t in enumerate(toks) if t.lower().startswith("<body")), 0)
                for i, t in enumerate(toks):
                    if i >= body and not t.startswith("<"):
                        yield name, i, unescape(t)
            return
        for name, find in parts(kind, z):
            for i, texts in enumerate(find(ET.fromstring(z.read(name)))):
                yield name, i, "".join(t.text or "" for t in texts)


def rebuilt(kind: str, data: bytes, new: dict[tuple[str, int], str]) -> bytes:
    """The document with new strings by place: the first text element gets the string, the others of it become empty."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        finders = dict(parts(kind, z)) if kind != "epub" else {}
        for name in z.namelist():
            raw = z.read(name)
            if name in finders:
                root = ET.fromstring(raw)
                for i, texts in enumerate(finders[name](root)):
                    if (name, i) in new:
                        for k, t in enumerate(texts):
                            t.text = new[name, i] if k == 0 else ""
                raw = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            elif kind == "epub" and PAGES.search(name):
                toks = tokens_of(raw.decode("utf-8", "replace"))
                for i, t in enumerate(toks):
                    if (name, i) in new:
                        toks[i] = t[: len(t) - len(t.lstrip())] + escape(new[name, i], False) + t[len(t.rstrip()) :]
                raw = "".join(toks).encode()
            w.writestr(z.getinfo(name), raw)
    return out.getvalue()


def office_strings(files: DataFrame) -> DataFrame:
    """All strings of documents (path, doc_type, content). A broken document gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, kind, data in zip(pdf["path"], pdf["doc_type"], pdf["content"], strict=True):
                try:
                    rows = [(path, kind, c, i, t, "") for c, i, t in strings(kind, data)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    rows = [(path, kind, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "doc_type", "container", "seq", "text", "error"])

    return files.filter(F.col("doc_type").isin("docx", "xlsx", "pptx", "epub")).select("path", "doc_type", "content").mapInPandas(run, STRINGS)


def office_units(files: DataFrame, target: str = "zh-CN") -> DataFrame:
    """path, doc_type, container, seq, original of the strings that need a translation."""
    got = office_strings(files).filter(F.col("error") == "").filter(is_translatable_doc(F.col("text"), target))
    return got.select("path", "doc_type", "container", "seq", trim(F.col("text")).alias("original"))


def rebuild_office(files: DataFrame, units: DataFrame) -> DataFrame:
    """path, content with the units' `new` strings put in their places."""
    held = units.groupBy("path").agg(F.collect_list(F.struct("container", "seq", "new")).alias("us"))

    @F.pandas_udf("binary")
    def put(kind: pd.Series, content: pd.Series, us: pd.Series) -> pd.Series:
        return pd.Series([rebuilt(k, c, {(u["container"], u["seq"]): u["new"] for u in (x if x is not None else [])}) for k, c, x in zip(kind, content, us, strict=True)])

    joined = files.select("path", "doc_type", "content").join(held, "path", "left")
    return joined.select("path", put("doc_type", "content", "us").alias("content"))


# The smallest set of parts that makes a docx file.
DOCX_TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>"""
DOCX_LINKS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>"""


def make_docx(heading: str, paragraphs: list[tuple[str, bool]]) -> bytes:
    """A docx file of a heading and of paragraphs (text, whether it is a title), headings in larger bold type."""

    def paragraph(text: str, half_points: int, bold: bool) -> str:
        return f'<w:p><w:r><w:rPr>{"<w:b/>" if bold else ""}<w:sz w:val="{half_points}"/></w:rPr><w:t xml:space="preserve">{escape(text, False)}</w:t></w:r></w:p>'

    body = paragraph(heading, 40, True) + "".join(paragraph(t, 28 if title else 22, title) for t, title in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", DOCX_TYPES)
        z.writestr("_rels/.rels", DOCX_LINKS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def export_docx(paragraphs: DataFrame, translations: DataFrame, heading: str) -> DataFrame:
    """doc_id, content: each document's paragraphs (doc_id, seq, original, title) with their translations as a docx file."""
    joined = paragraphs.join(translations.select("doc_id", "seq", "translated"), ["doc_id", "seq"], "left")
    shown = F.coalesce(F.nullif(F.col("translated"), F.lit("")), F.col("original"))
    got = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", shown.alias("t"), "title"))).alias("g"))

    @F.pandas_udf("binary")
    def write(groups: pd.Series) -> pd.Series:
        return pd.Series([make_docx(heading, [(p["t"], bool(p["title"])) for p in g]) for g in groups])

    return got.select("doc_id", write("g").alias("content"))

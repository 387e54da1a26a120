"""Documents of all types: one table of units from them, and the documents with translated units.

Formats with a reader here: plain texts, html pages, docx, xlsx, pptx and epub. For pdf files and images the bytes have to be
read by a library that isn't here: a RowReader is given from outside, and its positioned rows go the same way as all.

A unit's place is (container, place): the part of a zip and the string's number in it, the line of a plain text, the node of a
page, or the paragraph of a document that was read by a RowReader.

Cases: a document of an unknown type, or of one without a reader, is one row with an error and no original, as is one that can't
be read; empty documents have no units; null contents are empty documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.functions.charset import read_text
from glossloom.functions.predicates import is_translatable_doc
from glossloom.functions.text import trim
from glossloom.operators import layout, render
from glossloom.operators.extract import doc_plain_units
from glossloom.operators.html import html_units, rebuild_html
from glossloom.sources import office

ZIPPED = ("docx", "xlsx", "pptx", "epub")
UNITS = ("path", "doc_type", "container", "place", "seq", "original", "error")
ROWS = "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double, size double, text string, error string"

#: page, x0, y0, x1, y1, size (null for recognised text), text; in the order of reading.
Row = tuple[int, float, float, float, float, float | None, str]


class RowReader(Protocol):
    """Reads the positioned text of a pdf file or an image, from its text layer or by recognition. It must be picklable."""

    recognises: bool

    def rows(self, path: str, content: bytes) -> list[Row]: ...


def positioned_rows(documents: DataFrame, reader: RowReader) -> DataFrame:
    """The rows of documents (path, content) in the shape that layout takes, and one row with an error for each that fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    got = [(path, p, i, x0, y0, x1, y1, size, text, None) for i, (p, x0, y0, x1, y1, size, text) in enumerate(reader.rows(path, content or b""))]
                except Exception as e:  # noqa: BLE001 - whatever a library raises is the document's error
                    got = [(path, *[None] * 8, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(got, columns=[c.split()[0] for c in ROWS.split(", ")]).astype(object)

    return documents.select("path", "content").mapInPandas(run, ROWS)


def row_units(documents: DataFrame, reader: RowReader) -> DataFrame:
    """Units of documents that a reader reads: its paragraphs that aren't noise."""
    rows = positioned_rows(documents, reader)
    good = rows.filter(F.col("error").isNull()).drop("error")
    found = layout.ocr_paragraphs(good) if reader.recognises else layout.paragraphs(good)
    failed = rows.filter(F.col("error").isNotNull()).select("doc_id", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("original"), "error")
    return found.select("doc_id", "seq", "original", F.lit("").alias("error")).unionByName(failed)


def unit_rows(df: DataFrame, path: str, container: str | None, place: str | None) -> DataFrame:
    col = lambda c, kind: F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    error = F.col("error") if "error" in df.columns else F.lit("")
    return df.select(F.col(path).alias("path"), "doc_type", col(container, "string").alias("container"), col(place, "long").alias("place"), F.col("seq").cast("long").alias("seq"), "original", error.alias("error"))


def document_units(documents: DataFrame, target: str = "zh-CN", readers: Mapping[str, RowReader] | None = None) -> DataFrame:
    """path, doc_type, container, place, seq, original, error of documents (path, doc_type, content)."""
    readers = readers or {}
    of = lambda kind: documents.filter(F.col("doc_type") == kind)
    text = lambda kind: of(kind).select(F.col("path").alias("file"), read_text(F.coalesce("content", F.lit(b"")))["text"].alias("text"))
    plain = doc_plain_units(text("plain"), target).withColumn("doc_type", F.lit("plain"))
    html = html_units(text("html"), "file", "text", target).withColumn("doc_type", F.lit("html"))
    zipped = documents.filter(F.col("doc_type").isin(*ZIPPED))
    strings = office.office_strings(zipped).withColumn("original", trim(F.col("text")))
    strings = strings.filter((F.col("error") != "") | is_translatable_doc(F.col("original"), target, trimmed=True))
    parts = [
        unit_rows(plain, "file", None, "line_index"),
        unit_rows(html, "file", None, "node"),
        unit_rows(strings, "path", "container", "seq"),
    ]
    parts += [unit_rows(row_units(of(kind), reader).withColumn("doc_type", F.lit(kind)), "doc_id", None, "seq") for kind, reader in readers.items()]
    known = ("plain", "html", *ZIPPED, *readers)
    other = documents.filter(~F.coalesce(F.col("doc_type").isin(*known), F.lit(False)))
    error = F.when(F.col("doc_type").isNull(), F.lit("unknown document type")).otherwise(F.concat(F.lit("no reader for "), "doc_type"))
    parts.append(unit_rows(other.select("path", "doc_type", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("original"), error.alias("error")), "path", None, None))
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return got.select(*UNITS)


def rebuild_documents(documents: DataFrame, units: DataFrame, mode: str = "translated") -> DataFrame:
    """path, content, error: each document with its units' translations in a view. Plain texts and pages come out in UTF-8; types
    without a writer give an error. units: as document_units gives them, with translated."""
    units = units.filter(F.col("original").isNotNull())
    of = lambda kind: documents.filter(F.col("doc_type") == kind).select(F.col("path").alias("file"), read_text(F.coalesce("content", F.lit(b"")))["text"].alias("text"))
    mine = lambda kind, name: units.filter(F.col("doc_type") == kind).select(F.col("path").alias("file"), F.col("place").cast("int").alias(name), "original", "translated")
    plain = render.rebuild_plain(of("plain"), mine("plain", "line_index"), mode)
    html = rebuild_html(of("html"), mine("html", "node"), mode, "file", "text")
    zipped = documents.filter(F.col("doc_type").isin(*ZIPPED))
    new = units.filter(F.col("doc_type").isin(*ZIPPED)).select("path", "container", F.col("place").alias("seq"), render.view_text(F.col("original"), F.col("translated"), mode).alias("new"))
    other = documents.filter(~F.coalesce(F.col("doc_type").isin("plain", "html", *ZIPPED), F.lit(False)))
    texts = plain.unionByName(html).select(F.col("file").alias("path"), F.encode("text", "UTF-8").alias("content"), F.lit("").alias("error"))
    problem = F.when(F.col("doc_type").isNull(), F.lit("unknown document type")).otherwise(F.concat(F.lit("no writer for "), "doc_type"))
    return texts.unionByName(office.rebuild_office(zipped, new).select("path", "content", F.lit("").alias("error"))).unionByName(other.select("path", F.lit(None).cast("binary").alias("content"), problem.alias("error")))

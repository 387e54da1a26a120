"""Whole runs: a folder of text files, its archives and its documents, to translated files."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.functions.charset import write_text
from glossloom.operators import extract, memory, render
from glossloom.operators.profile import files_with_units
from glossloom.sources import files as source
from glossloom.sources import office, xp3

Keep = Callable[[DataFrame], DataFrame]


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut; the folder is the one that the cluster shares (spark.checkpoint.dir)."""
    return df.checkpoint()


def translate_texts(texts: DataFrame, mem: DataFrame, provider: memory.Provider, target: str, mode: str = "translated", keep: Keep = checkpointed, ts: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, units, memory) from text files (file, text, encoding, skipped).

    files: file, content in the file's own encoding, warning; only files that aren't skipped and have units.
    """
    units = extract.extract_files(texts.filter(~F.coalesce(F.col("skipped"), F.lit(False))), target)
    units = units.withColumns({"translated": F.lit(""), "error": F.lit("")})
    units, mem = memory.translate(units, mem, provider, target, keep, ts)
    chosen = files_with_units(texts, units)
    rebuilt = render.rebuild(chosen, units, mode).join(chosen.select("file", "encoding"), "file")
    got = rebuilt.withColumn("w", write_text("text", "encoding"))
    return got.select("file", "w.content", "w.warning"), units, mem


def translate_folder(spark: SparkSession, folder: str, mem: DataFrame, provider: memory.Provider, target: str, mode: str = "translated", max_mb: int = source.DEFAULT_MB, keep: Keep = checkpointed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text files below a folder."""
    return translate_texts(source.text_files(source.scan(spark, folder, max_mb)), mem, provider, target, mode, keep)


def translate_archives(spark: SparkSession, folder: str, mem: DataFrame, provider: memory.Provider, target: str, mode: str = "translated", keep: Keep = checkpointed) -> tuple[DataFrame, DataFrame]:
    """(archives, memory): each xp3 archive below a folder packed again with its text members translated.

    Members are named by archive and path, so archives with equal member names don't mix.
    """
    found = source.scan(spark, folder)
    inside = source.archive_texts(found).withColumn("file", F.concat_ws("\x1f", "archive", "rel"))
    out, _, mem = translate_texts(inside, mem, provider, target, mode, keep)
    parts = F.split("file", "\x1f")
    new = out.select(parts[0].alias("archive"), parts[1].alias("rel"), "content")
    old = xp3.unpack_archives(found.filter(F.col("kind") == "archive")).filter(F.col("error") == "")
    return xp3.pack_archives(xp3.merge_members(old, new)), mem


def translate_office(documents: DataFrame, mem: DataFrame, provider: memory.Provider, target: str, mode: str = "translated", keep: Keep = checkpointed) -> tuple[DataFrame, DataFrame]:
    """(documents, memory): docx, xlsx, pptx and epub files (path, doc_type, content) with their strings in a view."""
    units = office.office_units(documents, target).withColumns({"translated": F.lit(""), "error": F.lit("")})
    units, mem = memory.translate(units, mem, provider, target, keep)
    new = units.withColumn("new", render.view_text(F.col("original"), F.col("translated"), mode))
    return office.rebuild_office(documents.filter(F.col("doc_type").isin("docx", "xlsx", "pptx", "epub")), new), mem


def write_zips(files: DataFrame, folder: str, parts: int = 8, name: str = "file", content: str = "content") -> DataFrame:
    """Zips of all files in a folder that every executor can write to (a path, or a URI that pyarrow knows): path, files,
    bytes of each, written when that table is. Each task writes one zip, of a range of names in order; one file at a time is in memory. A zip is written
    aside and renamed, so a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        number = TaskContext.get().partitionId()
        path, aside, n, size = f"{base}/part-{number:05d}.zip", f"{base}/.part-{number:05d}-{uuid.uuid4().hex}", 0, 0
        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    system.create_dir(base, recursive=True)
                    stream = system.open_output_stream(aside)
                    out = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                data = batch.column(1)[i].as_py() or b""
                out.writestr(batch.column(0)[i].as_py().removeprefix("file:").lstrip("/"), data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            stream.close()
            system.move(aside, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "files": [n], "bytes": [size]})

    dealt = files.select(name, content).repartitionByRange(parts, name).sortWithinPartitions(name)
    return dealt.mapInArrow(run, "path string, files long, bytes long")


def write_zip(files: DataFrame, path: str, name: str = "file", content: str = "content") -> int:
    """One zip of all files, in the order of their names; the driver holds one partition of them at a time. Number of files."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for row in files.select(name, content).orderBy(name).toLocalIterator():
            z.writestr(row[0].removeprefix("file:").lstrip("/"), bytes(row[1]))
            n += 1
    return n

"""Files from folders, with Spark's own reader: any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.functions.charset import read_text
from glossloom.functions.text import base_name, ext_of
from glossloom.operators.extract import TEXT_EXT, doc_type_of
from glossloom.sources.xp3 import unpack_archives

MEGABYTE = 1024 * 1024
DEFAULT_MB, ARCHIVE_MARK = 8, "【xp3】"


def scan(spark: SparkSession, folder: str, max_mb: int = DEFAULT_MB) -> DataFrame:
    """path, name, ext, kind (text, program, archive, document), size, skipped, doc_type, content of all files below.

    Empty text files are left out; larger ones than max_mb are marked as skipped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = base_name(F.col("path"))
    ext = ext_of(name)
    doc = doc_type_of(name)
    kind = F.when(ext == "exe", "program").when(ext == "xp3", "archive").when(ext.isin(*TEXT_EXT), "text").when(doc.isNotNull(), "document")
    got = raw.select("path", name.alias("name"), ext.alias("ext"), kind.alias("kind"), F.col("length").alias("size"), (F.col("length") > max_mb * MEGABYTE).alias("skipped"), doc.alias("doc_type"), "content")
    return got.filter(F.col("kind").isNotNull() & ((F.col("kind") != "text") | (F.col("size") > 0)))


def listing(files: DataFrame) -> DataFrame:
    """kind, path, name, ext, size, skipped of all files, by kind and path in the order of bytes, without what they hold."""
    return files.select("kind", "path", "name", "ext", "size", "skipped").orderBy("kind", "path")


def text_files(files: DataFrame) -> DataFrame:
    """file, text, encoding, skipped of text files that aren't skipped."""
    got = files.filter((F.col("kind") == "text") & ~F.col("skipped"))
    return got.withColumn("t", read_text("content")).select(F.col("path").alias("file"), F.col("t.text").alias("text"), F.col("t.encoding").alias("encoding"), "skipped")


def archive_texts(files: DataFrame, max_mb: int = DEFAULT_MB) -> DataFrame:
    """Text files inside archives, as text_files gives them, with archive and rel; their path is marked."""
    inside = unpack_archives(files.filter(F.col("kind") == "archive")).filter(F.col("error") == "").filter(ext_of(F.col("rel")).isin(*TEXT_EXT))
    inside = inside.withColumn("skipped", F.length("content") > max_mb * MEGABYTE).filter(~F.col("skipped"))
    return inside.withColumn("t", read_text("content")).select(F.concat(F.lit(ARCHIVE_MARK), F.col("rel")).alias("file"), F.col("t.text").alias("text"), F.col("t.encoding").alias("encoding"), "skipped", "archive", "rel")


def documents(files: DataFrame) -> DataFrame:
    """path, doc_type, content of documents of a known type."""
    return files.filter(F.col("doc_type").isNotNull()).select("path", "doc_type", "content")

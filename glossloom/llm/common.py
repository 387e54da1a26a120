"""Pieces that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows in one Arrow batch: with texts of some KB, tens of MB in a Python worker.
ARROW_ROWS = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the Arrow batches that Python workers get, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset, a local session, as in tests, gets a folder
    of its own; on a cluster that is an error, as other machines couldn't read it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        at = tempfile.mkdtemp(prefix="glossloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Folders that scopes will delete, innermost scope last.
SCOPES: list[list[str]] = []


def new_dir(spark: SparkSession, tag: str) -> str:
    at = f"{shared_dir(spark)}/glossloom-{tag}-{uuid.uuid4().hex[:12]}"
    if SCOPES:
        SCOPES[-1].append(at)
    return at


def delete(spark: SparkSession, at: str) -> None:
    """Deletes a folder of the shared folder, in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside when it ends. What was made of them must be in a table of its own by then.

    Without a scope they stay, as a result that is read later needs them; the cluster empties its folder after the session.
    """
    SCOPES.append([])
    try:
        yield
    finally:
        for at in SCOPES.pop():
            delete(spark, at)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    at = new_dir(spark, tag)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Texts of one byte a character take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def own_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with a suffix where df has such a column already (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, wanted
    while name.lower() in taken:
        name += "_"
    return name

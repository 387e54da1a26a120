"""Translation of files as they arrive: resumable, as the memory is what has been done.

The reference's own runs can be stopped and started again; here each micro-batch asks the provider only for what the
memory table lacks and appends the answers to it, so a batch that is repeated after a failure asks for nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossloom.functions.charset import read_text
from glossloom.operators import extract, memory


def incoming_texts(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """file, text, encoding of files that come into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return raw.withColumn("t", read_text("content")).select(F.col("path").alias("file"), "t.text", "t.encoding")


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """The memory table, or an empty one before the first batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(memory.MEMORY).parquet(path) if there else memory.empty_memory(spark)


def fill_memory(spark: SparkSession, folder: str, memory_path: str, checkpoint: str, provider: memory.Provider, target: str) -> StreamingQuery:
    """Starts a query that answers the units of incoming files; it ends when all files that are there are done."""

    def batch(files: DataFrame, epoch: int) -> None:
        units = extract.extract_files(files, target)
        mem = read_memory(files.sparkSession, memory_path)
        got = memory.call_provider(memory.misses(units, mem, provider.name, target), provider, target).filter(F.col("error") == "")
        new = got.select(F.lit(provider.name).alias("provider"), F.lit(target).alias("target_lang"), "original", "t", F.lit(epoch).cast("long").alias("ts"))
        new.write.mode("append").parquet(memory_path)

    return incoming_texts(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

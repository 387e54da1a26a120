"""Session settings shared by tests, benchmarks and scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "glossloom", memory: str = "8g") -> SparkSession:
    """A local session. On a cluster, pass the session the cluster made instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


#: Bytes of a table that a core reads at once.
SPLIT_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it is too small to fill them: a small file is one row group, and so one task. Larger inputs
    stay as they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SPLIT_BYTES * cores else df

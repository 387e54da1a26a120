"""Counts and progress of units by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percent(done: Column, total: Column) -> Column:
    """Rounded half up; 100 when there is nothing to do."""
    return F.when(total == 0, 100).otherwise(F.floor(100.0 * done / total + 0.5)).cast("long")


def is_done(translated: str = "translated") -> Column:
    return F.coalesce(F.col(translated), F.lit("")) != ""


def by_file(units: DataFrame, *keys: str) -> DataFrame:
    """Units, translated, failed, remaining and progress of each group."""
    got = units.groupBy(*keys).agg(F.count("*").alias("units"), F.count_if(is_done()).alias("done"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("failed"))
    return got.withColumns({"remaining": F.col("units") - F.col("done"), "progress": percent(F.col("done"), F.col("units"))})


def totals(units: DataFrame) -> DataFrame:
    return by_file(units)


def running_counts(units: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """units with done (how many of the group are worked on so far, this one included), failed (of these) and total, in the
    given order. A group is one task's: count by file or job, not over a whole corpus."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    failed = F.count_if(F.coalesce(F.col("error"), F.lit("")) != "")
    return units.withColumns({"done": F.count("*").over(so_far), "failed": failed.over(so_far), "total": F.count("*").over(every)})


def files_with_units(files: DataFrame, units: DataFrame) -> DataFrame:
    """Files that aren't skipped and have units."""
    return files.filter(~F.coalesce(F.col("skipped"), F.lit(False))).join(units.select("file").distinct(), "file", "left_semi")


def gather(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """The values of each group as an array in the given order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("g")).select(*keys, F.col(f"g.{value}").alias(out))


def kinds_present(units: DataFrame, by: str, kind: str) -> DataFrame:
    """The different kinds of each group, and whether any unit of it is done."""
    return units.groupBy(by).agg(F.sort_array(F.collect_set(kind)).alias("kinds"), F.bool_or(is_done()).alias("any_done"))

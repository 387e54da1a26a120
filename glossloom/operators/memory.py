"""Translation memory: look-ups, misses, provider calls, writes and trimming.

Units: a DataFrame with `original` and perhaps `translated`, `error`. A memory has provider, target_lang, original, t, ts
(epoch milliseconds). The key is the text itself with provider and language: no hash, so nothing collides and a change of
language never serves old texts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossloom.functions.predicates import validate

MEMORY = "provider string, target_lang string, original string, t string, ts long"
CAPACITY, TRIM_TO = 20_000, 15_000
ATTEMPTS = 3


class Provider(Protocol):
    """Translates a batch; must give as many texts as it gets."""

    name: str

    def translate(self, texts: list[str], target_lang: str) -> list[str]: ...


class PseudoProvider:
    """Offline and deterministic: the text in brackets with the language."""

    name = "pseudo"

    def translate(self, texts: list[str], target_lang: str) -> list[str]:
        return [f"[{target_lang}] {t}" for t in texts]


def empty_memory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MEMORY)


def pending(units: DataFrame) -> DataFrame:
    """Units without a translation."""
    return units.filter(F.coalesce(F.col("translated"), F.lit("")) == "")


def image_pending(boxes: DataFrame) -> DataFrame:
    """Boxes without translation and without error: failed ones aren't tried again."""
    return boxes.filter((F.coalesce(F.col("translated"), F.lit("")) == "") & (F.coalesce(F.col("error"), F.lit("")) == ""))


def distinct_originals(units: DataFrame) -> DataFrame:
    return units.select("original").distinct()


def entries(memory: DataFrame, provider: str, target_lang: str) -> DataFrame:
    """original, t: the newest valid entry of each text. Filters reach the scan."""
    m = memory.filter((F.col("provider") == provider) & (F.col("target_lang") == target_lang) & (F.coalesce(F.col("t"), F.lit("")) != ""))
    return m.groupBy("original").agg(F.max_by("t", F.struct(F.coalesce("ts", F.lit(0)), "t")).alias("t"))


def look_up(units: DataFrame, memory: DataFrame, provider: str, target_lang: str) -> DataFrame:
    """units with `hit`, the memory's translation or null."""
    return units.join(entries(memory, provider, target_lang).withColumnRenamed("t", "hit"), "original", "left")


def misses(units: DataFrame, memory: DataFrame, provider: str, target_lang: str) -> DataFrame:
    """The different texts that the memory lacks."""
    return distinct_originals(units).join(entries(memory, provider, target_lang), "original", "left_anti")


def call_provider(texts: DataFrame, provider: Provider, target_lang: str, concurrency: int = 3, batch: int = 32, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """original, t, error for different texts. Each of `concurrency` partitions calls in turn; a failing batch is tried
    ATTEMPTS times, waiting longer after rate limits. Results are validated once, outside the retries."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts, out, error = part["original"].tolist(), None, ""
                for attempt in range(1, ATTEMPTS + 1):
                    try:
                        out = provider.translate(texts, target_lang)
                        if len(out) != len(texts):
                            raise ValueError("the provider gave another number of texts")
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a provider is a unit's error
                        out, error = None, str(e)
                        if attempt < ATTEMPTS:
                            pause((4.0 if "429" in error or "403" in error else 0.6) * attempt)
                yield pd.DataFrame({"original": texts, "t": out or [""] * len(texts), "error": ["" if out else error or "failed"] * len(texts)})

    called = texts.select("original").repartition(concurrency).mapInPandas(run, "original string, t string, error string")
    v = validate(F.col("original"), F.col("t"))
    return called.withColumn("v", F.when(F.col("error") == "", v)).select("original", F.when(F.col("v.ok"), F.col("t")).otherwise("").alias("t"), F.coalesce("v.error", "error").alias("error"))


def translate(units: DataFrame, memory: DataFrame, provider: Provider, target_lang: str, materialise: Callable[[DataFrame], DataFrame], ts: int = 0) -> tuple[DataFrame, DataFrame]:
    """(units with translated and error, memory with what is new).

    Only misses reach the provider, each different text once. `materialise` must store the provider's results (a table or
    checkpoint): else they'd be asked for again wherever they're used. Units that have a translation keep it.
    """
    todo = pending(units)
    got = materialise(call_provider(misses(todo, memory, provider.name, target_lang), provider, target_lang))
    known = entries(memory, provider.name, target_lang).select("original", "t", F.lit("").alias("error"))
    answers = known.unionByName(got).withColumnsRenamed({"t": "answer", "error": "problem"})
    joined = units.join(answers, "original", "left")
    has = F.coalesce(F.col("translated"), F.lit("")) != ""
    out = joined.withColumns({"translated": F.when(has, F.col("translated")).otherwise(F.coalesce("answer", F.lit(""))), "error": F.when(has, F.lit("")).otherwise(F.coalesce("problem", F.lit("")))}).select(*units.columns)
    new = got.filter(F.col("error") == "").select(F.lit(provider.name).alias("provider"), F.lit(target_lang).alias("target_lang"), "original", "t", F.lit(ts).cast("long").alias("ts"))
    return out, memory.unionByName(new)


def evict_oldest(memory: DataFrame, capacity: int = CAPACITY, trim_to: int = TRIM_TO) -> DataFrame:
    """The newest trim_to entries by write time once there are more than capacity; ties by original.

    The cut is found by a top-k on (ts, original) and applied as a filter, so the memory itself isn't sorted.
    """
    n = memory.count()
    if n <= capacity:
        return memory
    key = F.struct(F.coalesce(F.col("ts"), F.lit(0)).alias("ts"), F.col("original"), F.col("provider"), F.col("target_lang"))
    cut = memory.select(key.alias("k")).orderBy(F.col("k").desc()).limit(trim_to).agg(F.min("k").alias("least"))
    return memory.join(F.broadcast(cut), key >= F.col("least")).drop("least")


def realign_numbered(reply: Column, n: Column) -> Column:
    """The n texts of a reply of lines "[k] text", by number from 0; a missing one is empty."""
    line = F.lit("(?m)^\\s*\\[([0-9]+)\\][ \\t]*([^\\n]*)")
    numbers = F.transform(F.regexp_extract_all(reply, line, F.lit(1)), lambda k: k.cast("int"))
    texts = F.regexp_extract_all(reply, line, F.lit(2))
    return F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda i: F.coalesce(F.get(texts, F.array_position(numbers, i).cast("int") - 1), F.lit("")))

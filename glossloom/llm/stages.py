"""Stages of the corpus pipeline: each applies one operator to all its input and carries out the decision.

The operators decide on narrow rows, which are named by id and by the MD5 of the text, so null and repeated ids do no
harm; the decision then joins back to the documents. Rows that are equal in both are told apart by number where it matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossloom.llm import decontam, mixing, quality, sharding, simhash_dedup
from glossloom.llm.common import own_name, read_table, small_batches, written

MIX_WEIGHTS = (3.0, 1.0, 2.0)
MIX_SHARE, MIX_MOST = 1.5, 2.0
SHARDS = 40


def digest(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def copies_of_rows(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """docs with each row as often as copies says: doc_id, md, n (equal rows), times (for all of them together)."""
    md, times, i, left = (own_name(docs, x) for x in ("_md", "_times", "_i", "_left"))
    named = docs.withColumn(md, digest())
    one = copies.select(F.col("doc_id").alias(f"{md}i"), F.col("md").alias(f"{md}m"), "n", F.col("times").alias(times))
    on = F.col("doc_id").eqNullSafe(F.col(f"{md}i")) & (F.col(md) == F.col(f"{md}m"))
    repeat = F.explode(F.sequence(F.lit(1), F.col(left))).alias(i)
    single = named.join(one.filter((F.col("n") == 1) & (F.col(times) > 0)), on).withColumn(left, F.col(times).cast("int"))
    got = single.select(*docs.columns, repeat).select(*docs.columns)
    several = written(one.filter("n > 1"), "repeated")
    if several.isEmpty():
        return got
    w = Window.partitionBy("doc_id", md).orderBy(F.lit(0))
    many = named.join(several, on).withColumn(i, F.row_number().over(w))
    many = many.withColumn(left, (F.floor(F.col(times) / F.col("n")) + F.when(F.col(i) <= F.col(times) % F.col("n"), 1).otherwise(0)).cast("int")).drop(i)
    return got.unionByName(many.filter(F.col(left) > 0).select(*docs.columns, repeat).select(*docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    small_batches(spark)
    heads = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    p = own_name(docs, "p")
    return quality.classify(docs, heads, out=p).filter(quality.is_kept(p)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id (of equal ids, the smallest MD5 of the text)."""
    small_batches(spark)
    rows = simhash_dedup.with_fingerprint(docs.select("doc_id", "text"), out="fp").select("doc_id", digest().alias("md"), "fp")
    rows = written(rows, "fingerprints")
    per_fp = simhash_dedup.component_roots(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    first = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "md")
    # per fingerprint first: a group of copies is one row before it meets its component
    best = rows.groupBy("fp").agg(F.min(first).alias("b")).join(per_fp.select(F.col("fp").alias("f"), "root"), F.col("fp") == F.col("f"))
    best = best.groupBy("root").agg(F.min("b").alias("b")).select("b.doc_id", "b.md")
    equal = rows.groupBy("doc_id", "md").agg(F.count("*").alias("n"))
    kept = best.select(F.col("doc_id").alias("i"), F.col("md").alias("m"))
    equal = equal.join(kept, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("md") == F.col("m")), "left_semi")
    return copies_of_rows(docs, equal.withColumn("times", F.lit(1)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. One goes if a window of full length occurs in it, however long it is, or if
    exact and near matches, those of shorter items included, are a twentieth of its words."""
    got = decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    bad = got.filter(F.col("whole") | decontam.is_contaminated(F.col("n_near_hit"), F.col("n_words"))).select(F.col("key").alias("bad_md")).distinct()
    return docs.join(bad, digest() == F.col("bad_md"), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = mixing.sample_keys(docs.withColumn("md", digest()).select("doc_id", "text", "source", "md"), carry=("md",))
    rows = written(rows, "mix")
    targets = mixing.source_targets(rows, "source", "size", MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
    got = mixing.mix(rows, "size", "source", "key", targets, ["doc_id", "md"])
    times = F.sum(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)).cast("long").alias("times")
    return copies_of_rows(docs, got.groupBy("doc_id", "md").agg(F.count("*").alias("n"), times))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, rows of a shard together."""
    return sharding.shard_table(docs, "doc_id", [1.0] * SHARDS)

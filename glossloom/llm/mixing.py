"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each source gets a budget of words. Whole epochs come first: with a budget of e full sizes and a rest, every document of
the source is taken e times; the rest is filled with a weighted sample without replacement. For the sample a document
gets the exponential key -ln(u) / quality, with u from a hash of its id and a seed; documents are taken by ascending key
while the prefix sum stays within the rest, and the one that reaches over it is taken if that ends nearer to the budget.

The prefix sums need no sort of a whole source: documents fall in blocks by the logarithm of their key, block totals give
the block in which the budget ends, and only that block is sorted. Of exponential keys of any rates, and so of documents of any
qualities, at most a share of d / e falls in a step of d of the logarithm, so no block is much larger than BLOCK_ROWS.
Equal rows are one row with a count until the end, so many copies of a row aren't one large block either.

The windows of source_targets run over one row a source in one task: a long, two doubles and a name each.

Cases: null texts and texts without words have size 0 and are taken 0 times; null ids and repeated rows hash alike and
are told apart by text; a null or non-positive quality counts as the least quality; null sources form the last source;
an empty table gives an empty result. A source of only empty documents has budget 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossloom.llm.common import own_name, written

#: Documents of a source in one block, on average.
BLOCK_ROWS = 20_000
#: Sources whose targets are broadcast; with more they are joined by shuffle.
MOST_BROADCAST = 100_000
LEAST_QUALITY = 0.05
SEED = "mix-1"
#: Words are runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A quality weight from the text alone: the share of characters that are not ASCII symbols or digits, squared."""
    text = F.coalesce(text, F.lit(""))
    n = F.char_length(text)
    plain = n - F.char_length(F.regexp_replace(text, "[^#-&*@|~^<>=_0-9]+", ""))
    return F.when(n == 0, F.lit(LEAST_QUALITY)).otherwise(F.greatest(F.lit(LEAST_QUALITY), (plain / n) * (plain / n)))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts and SEED."""
    d = F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(d, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row for each source: its size and its target.

    Sources in the order of their names' code points (null last) have the weights in turn. Together they get share of
    all sizes; none gets more than most times its own size, and what it can't take goes to the others by weight. That
    is min(most * size, level * weight) with one level for all, found from the sources in the order of size over weight.
    The windows run over one row a source.
    """
    per = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    turn = Window.orderBy(F.col(source).asc_nulls_last())
    k = (F.row_number().over(turn) - 1) % len(weights)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    full = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_total": F.sum("source_size").over(every) * F.lit(float(share)), "_used": F.coalesce(F.sum("_cap").over(full), F.lit(0.0)), "_out": F.coalesce(F.sum("_w").over(full), F.lit(0.0)), "_all": F.sum("_w").over(every)})
    # the first source whose cap isn't reached sets the level; with none, all are full
    per = per.withColumn("_level", (F.col("_total") - F.col("_used")) / (F.col("_all") - F.col("_out")))
    open_ = F.col("_level") * F.col("_w") <= F.col("_cap")
    per = per.withColumn("_level", F.min_by(F.when(open_, F.col("_level")), F.when(open_, F.col("_cap") / F.col("_w"))).over(every))
    return per.select(source, "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap")).alias("target"))


def mix(df: DataFrame, size: str, source: str, key: str, targets: DataFrame, tie: Sequence[str]) -> DataFrame:
    """df with source_size, target and taken (words, repeats counted), under names of their own if df has such columns.
    df is narrow: no texts.

    key: the exponential key, above 0 (rows with another one, or null, come first, in its order); tie: columns that order equal keys, and with them name all that tells rows apart.
    """
    block, total, before, inside, epochs, fill, n, i, of, per = (own_name(df, x) for x in ("_block", "_total", "_before", "_inside", "_epochs", "_fill", "_n", "_i", "_of", "_per"))
    source_size, target, taken = (own_name(df, x) for x in ("source_size", "target", "taken"))
    t = written(targets.select(F.col(source).alias(of), F.col("source_size").alias(source_size), F.col("target").alias(target)), "targets")
    t = F.broadcast(t) if t.count() <= MOST_BROADCAST else t
    rows = df.count()
    # blocks of one source have BLOCK_ROWS rows at most, all but by chance
    steps = max(1, math.ceil(rows / BLOCK_ROWS / math.e))
    got = df.groupBy(*df.columns).agg(F.count("*").alias(n))
    got = got.join(t, F.col(source).eqNullSafe(F.col(of))).drop(of)
    got = got.withColumn(epochs, F.when(F.col(source_size) > 0, F.floor(F.col(target) / F.col(source_size))).otherwise(0).cast("long"))
    got = got.withColumn(fill, F.col(target) - F.col(epochs) * F.col(source_size))
    got = got.withColumn(block, F.coalesce(F.floor(F.log(key) * steps).cast("long"), F.lit(-(1 << 62))))
    sums = got.groupBy(source, block).agg(F.sum(F.col(size) * F.col(n)).alias(total))
    earlier = Window.partitionBy(source).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(total).over(earlier), F.lit(0))).withColumnsRenamed({source: of, block: per})
    got = got.join(sums, F.col(source).eqNullSafe(F.col(of)) & (F.col(block) == F.col(per))).drop(of, per)
    ends_here = (F.col(before) < F.col(fill)) & (F.col(before) + F.col(total) > F.col(fill))
    order = Window.partitionBy(source, block).orderBy(F.col(key), *[F.col(c).asc_nulls_last() for c in tie]).rowsBetween(Window.unboundedPreceding, -1)
    copies = F.explode(F.sequence(F.lit(1), F.col(n))).alias(i)
    cut = got.filter(ends_here).withColumn(inside, F.col(before) + F.coalesce(F.sum(F.col(size) * F.col(n)).over(order), F.lit(0)))
    cut = cut.select("*", copies).withColumn(inside, F.col(inside) + (F.col(i) - 1) * F.col(size))
    takes = (F.col(inside) < F.col(fill)) & ((F.col(inside) + F.col(size) <= F.col(fill)) | (F.col(inside) + F.col(size) - F.col(fill) <= F.col(fill) - F.col(inside)))
    cut = cut.withColumn(taken, F.col(size) * (F.col(epochs) + F.when(takes, 1).otherwise(0)))
    whole = got.filter(~ends_here).select("*", copies).withColumn(taken, F.col(size) * (F.col(epochs) + F.when(F.col(before) < F.col(fill), 1).otherwise(0)))
    return whole.select(*df.columns, source_size, target, taken).unionByName(cut.select(*df.columns, source_size, target, taken))


def sample_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, carry, source, size and the Efraimidis-Spirakis key of each row. Repeated ids with other texts get other keys."""
    q = quality if quality is not None else text_quality(F.col(text))
    q = F.greatest(F.lit(LEAST_QUALITY), F.coalesce(q, F.lit(LEAST_QUALITY)))
    return docs.select(F.col(doc_id), *carry, F.col(source), word_count(F.col(text)).alias("size"), (-F.log(uniform(F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit(""))))) / q).alias("key"))

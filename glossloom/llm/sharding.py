"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair gets a uniform number u that only the two decide, and the score -ln(u) / weight; the key goes to
the shard with the smallest score. A new shard can only win keys for itself, so a record moves into the new shard or
stays. Assigning is row-local: no shuffle and nothing broadcast.

Cases: a null key hashes as the text "null" and so stays in one shard; equal keys share a shard; a shard of weight 0
gets nothing; an empty table stays empty. Added columns get a suffix where the input has their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossloom.llm.common import own_name

PRIME = 2**31 - 1
#: Records that one task numbers, on average.
SLOT_BLOCK = 50_000


def shard_constants(shard: int) -> tuple[int, int, int]:
    """Three multipliers of a shard, from its number alone: shards keep theirs when others come or go."""
    d = hashlib.md5(f"shard-{shard}".encode()).hexdigest()
    return tuple(1 + int(d[i : i + 8], 16) % (PRIME - 1) for i in (0, 8, 16))


def key_parts(key: Column) -> tuple[Column, Column]:
    """Two numbers below PRIME from the MD5 of the key as text."""
    d = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return tuple((F.conv(F.substring(d, at, 8), 16, 10).cast("long") % PRIME) for at in (1, 9))


def rendezvous(x: Column, y: Column, weights: Sequence[float]) -> Column:
    """The winning shard for the key's two parts. Ties go to the lower shard."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a weight above 0")
    scores = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        a, b, c = shard_constants(shard)
        z = (x * a + y * b % PRIME + c) % PRIME
        z = (z * z + x) % PRIME  # not linear in the key
        u = (z.cast("double") + 0.5) / float(PRIME)
        score = z if len(set(weights)) == 1 else F.log(u) / F.lit(-float(weight))
        # equal weights: the largest u has the smallest -ln(u), so compare the integers
        scores.append(F.struct((PRIME - score if len(set(weights)) == 1 else score).alias("s"), F.lit(shard).alias("i")))
    return F.least(*scores)["i"] if len(scores) > 1 else scores[0]["i"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """df with the shard of each row."""
    x, y, name = own_name(df, "_x"), own_name(df, "_y"), own_name(df, out)
    parts = key_parts(F.col(key))
    got = df.withColumns({x: parts[0], y: parts[1]})
    return got.withColumn(name, rendezvous(F.col(x), F.col(y), weights)).drop(x, y)


def block_of(keys: Sequence[Column], blocks: int) -> Column:
    """One of so many blocks, from the MD5 of the keys' text."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % blocks


def number_slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """A gapless number from 0 in each shard, for the rows of df.

    Rows are dealt to blocks of about SLOT_BLOCK rows by a hash of all columns; the block's first number is the
    count of the shard's rows in earlier blocks. So no task sorts a whole shard. Equal rows are counted first and share
    one row until they get their numbers, so that many copies of a row aren't one block. df is scanned twice.
    """
    keys = list(dict.fromkeys([shard, *order]))
    n, block, start, at = (own_name(df, x) for x in ("_n", "_block", "_start", "_at"))
    rest = [c for c in df.columns if c not in keys]
    if rest:
        raise ValueError(f"order must name every column besides the shard; missing: {rest}")
    blocks = max(1, math.ceil(df.count() / SLOT_BLOCK))
    distinct = df.groupBy(*keys).agg(F.count("*").alias(n)).withColumn(block, block_of([F.col(c) for c in keys], blocks))
    # one row for each shard and block
    starts = distinct.groupBy(shard, block).agg(F.sum(n).alias(start))
    before = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0)))
    inside = Window.partitionBy(shard, block).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn(at, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    joined = ranked.join(starts.withColumnsRenamed({shard: f"{start}s", block: f"{start}b"}), F.col(shard).eqNullSafe(F.col(f"{start}s")) & (F.col(block) == F.col(f"{start}b")))
    first = F.col(start) + F.col(at)
    return joined.select(*df.columns, F.explode(F.sequence(first, first + F.col(n) - 1)).alias(own_name(df, out)))


def shard_table(df: DataFrame, key: str, weights: Sequence[float]) -> DataFrame:
    """df dealt to one partition set by shard: rows of a shard are together, a hot shard may take several partitions."""
    got = assign_shards(df, key, weights)
    return got.hint("rebalance", got.columns[-1])

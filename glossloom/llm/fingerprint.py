"""Document fingerprints by SimHash, in DataFrame operators only.

Terms are pairs of neighbouring words of the text in lower case (the last word stands alone). A term's XXH64 votes for
or against each of 64 bits, weighted by the length of its first word; a bit is set with more than half of the weight.
Two bits share one long sum (bit j and bit j + 32, in its halves), which holds as a text has fewer than 2^31 characters.

Fingerprints within a Hamming radius are found with permuted block tables: the 64 bits are cut into `blocks` blocks, and
for each choice of blocks - radius of them, a table is keyed by those bits. Fingerprints that differ in at most radius
bits agree on all blocks but radius, and so meet in a table; each meeting is verified on all bits.

Cases: null and empty texts, and texts of white space only, have fingerprint 0; equal texts have equal fingerprints;
repeated rows each get theirs; very long texts are read whole; empty tables give no rows. Ids may be
anywhere among 64-bit numbers, null ids come last in the order; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from decimal import Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossloom.llm.common import own_name

RADIUS = 3
BLOCKS = 6
BETWEEN = "[\\x20\\x09-\\x0D]+"
HALVES = 0x100000001
#: Documents in one range of ids, about.
RANGE_ROWS = 1000
#: Most quantiles of the ids; each is cut further by width.
LEVELS = 256
#: About so many ranges at most; beyond, they hold more documents.
MOST_RANGES = 100_000


def fingerprints(df: DataFrame, keys: Sequence[str], text: str, carry: Sequence[str] = ()) -> DataFrame:
    """keys, fp and carry, a row for each value of keys. Rows with equal keys must be one text; carry: numbers by key."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN)
    terms = df.select(*keys, *carry, words.alias("_words")).select(*keys, *carry, "_words", F.posexplode("_words").alias("_pos", "_word"))
    terms = terms.select(*keys, *carry, F.xxhash64("_word", F.get("_words", F.col("_pos") + 1)).alias("_h"), F.char_length("_word").cast("long").alias("_w"))
    votes = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(F.lit(HALVES)) * F.col("_w")).alias(f"_s{j}") for j in range(32)]
    sums = terms.groupBy(*keys).agg(F.sum("_w").alias("_total"), *votes, *[F.max(c).alias(c) for c in carry])
    fp = None
    for j in range(32):
        low, high = F.col(f"_s{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_s{j}", 32)
        for votes_for, bit in ((low, j), (high, j + 32)):
            one = F.when(2 * votes_for > F.col("_total"), F.lit((1 << bit) if bit < 63 else -(1 << 63))).otherwise(F.lit(0))
            fp = one if fp is None else fp.bitwiseOR(one)
    return sums.select(*keys, fp.alias("fp"), *carry)


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def block_tables(df: DataFrame, fp: str, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """df with a row for each table: tab and its key in it."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for i, some in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in some)
        keys.append(F.struct(F.lit(i).alias("tab"), F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return df.select("*", F.explode(F.array(*keys)).alias("_t")).select(*df.columns, "_t.tab", "_t.key")


def within_radius(queries: DataFrame, corpus: DataFrame, fp: str = "fp", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """q, fp, distance: for each different fingerprint of queries all different fingerprints of corpus in the radius."""
    q = block_tables(queries.select(F.col(fp).alias("q")).distinct(), "q", radius, blocks)
    c = block_tables(corpus.select(F.col(fp).alias("fp")).distinct(), "fp", radius, blocks)
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("fp")))
    return q.join(c, ["tab", "key"]).filter(distance <= radius).select("q", "fp", distance.alias("distance")).distinct()


def count_near(queries: DataFrame, corpus: DataFrame, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """q, n: for each different fingerprint of queries the number of corpus rows in the radius. Copies are counted, not met."""
    copies = corpus.groupBy(F.col(fp).alias("c")).agg(F.count("*").alias("copies"))
    found = within_radius(queries, corpus, fp, radius)
    return found.join(copies, F.col("fp") == F.col("c")).groupBy("q").agg(F.sum("copies").cast("long").alias("n"))


def range_of(df: DataFrame, doc_id: str, md: str, out: str) -> DataFrame:
    """df with the number of the row's range, in the order of the walk: high ids first, then null ones.

    Quantiles of the ids, at most LEVELS, cut them first, and an id that holds several quantiles' rows is cut off by itself.
    What lies between two cuts is cut further by width; a single id, and the null ids, by the MD5 of the text.
    """
    lo, hi, n, n_ids = df.agg(F.min(doc_id), F.max(doc_id), F.count("*"), F.count(doc_id)).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    rows = max(RANGE_ROWS, math.ceil(n / MOST_RANGES))
    levels = max(1, min(LEVELS, math.ceil(n_ids / rows)))
    # from the lowest on, as a number of 64 bits isn't exact in a double
    above = (F.col(doc_id).cast("decimal(20,0)") - F.lit(Decimal(lo))).cast("double")
    cuts = df.agg(F.percentile_approx(above, [i / levels for i in range(1, levels)], F.lit(20 * LEVELS)).alias("q")).first().q if levels > 1 else []
    cuts = [min(hi, lo + int(x)) for x in cuts] + [hi]
    times = Counter(cuts)
    highs = sorted({c for c in times if c >= lo} | {c - 1 for c in times if times[c] > 1 and c > lo})
    lows = [lo, *(c + 1 for c in highs[:-1])]
    parts = [math.ceil(max(1, times[c]) * n_ids / levels / rows) or 1 for c in highs]
    widths = [(high - low) // k + 1 for high, low, k in zip(highs, lows, parts, strict=True)]

    def found(a: int, b: int) -> Column:
        """The place of the id's cut, by halves."""
        mid = (a + b) // 2
        return F.lit(a) if a == b else F.when(F.col(doc_id) <= F.lit(highs[mid]), found(a, mid)).otherwise(found(mid + 1, b))

    of_cut = lambda values, kind: F.element_at(F.array(*[F.lit(Decimal(v)).cast(kind) for v in values]), F.col(at) + 1)
    by_hash = lambda k: F.floor(F.conv(F.substring(md, 1, 8), 16, 10).cast("long") * k / F.lit(1 << 32)).cast("long")
    at = own_name(df, "_cut")
    number = lambda cut, part: cut * F.lit(1 << 32) + part
    # as decimals: the distance of two ids may not fit a long
    inside = F.call_function("div", of_cut(highs, "decimal(20,0)") - F.col(doc_id).cast("decimal(20,0)"), of_cut(widths, "decimal(20,0)"))
    single = of_cut([high == low for high, low in zip(highs, lows, strict=True)], "int") == 1
    rng = number(F.lit(len(highs)).cast("long") - F.col(at), F.when(single, by_hash(of_cut(parts, "long"))).otherwise(inside))
    of_null = number(F.lit(len(highs) + 1).cast("long"), by_hash(F.lit(max(1, math.ceil((n - n_ids) / rows)))))
    return df.withColumn(at, found(0, len(highs) - 1)).withColumn(out, F.when(F.col(doc_id).isNull(), of_null).otherwise(rng)).drop(at)


def by_descending_id(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """rng, rn, last, doc_id, text, next_text: each document with the text of the next by descending id (ties by the MD5
    of the text, null ids at the end; after the last the first). Rows with last = 1 repeat a range's successor.

    Ids fall in ranges of about equal numbers of documents, so the shuffle deals whole texts once, and far or frequent ids make
    no range large (but rows with the same id and text are in one). The first document of a range goes to the range before
    it, too, where it ends the order.
    """
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("md", F.md5("text"))
    d = range_of(d, "doc_id", "md", "rng")
    first = F.struct(F.col("doc_id").isNull().alias("null"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down"), "md", "doc_id")
    heads = d.groupBy("rng").agg(F.min(first).alias("h"))
    walk = Window.orderBy("rng")
    every = walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("h.doc_id").alias("h_id"), F.col("h.md").alias("h_md"), F.col("rng").alias("h_rng"), F.coalesce(F.lag("rng").over(walk), F.last("rng").over(every)).alias("to"))
    # about MOST_RANGES rows at most, an id, a hash and two numbers each
    both = d.join(F.broadcast(heads), F.col("rng") == F.col("h_rng"))
    is_head = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("md") == F.col("h_md"))
    own = F.struct(F.col("rng"), F.lit(0).alias("last"))
    places = F.when(is_head, F.array(own, F.struct(F.col("to").alias("rng"), F.lit(1).alias("last")))).otherwise(F.array(own))
    dealt = both.select("doc_id", "text", "md", F.explode(places).alias("p")).select("p.rng", "p.last", "doc_id", "text", "md")
    w = Window.partitionBy("rng").orderBy("last", F.col("doc_id").desc_nulls_last(), "md")
    return dealt.select("rng", F.row_number().over(w).alias("rn"), "last", "doc_id", "text", F.lead("text").over(w).alias("next_text"))

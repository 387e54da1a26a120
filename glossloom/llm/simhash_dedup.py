"""SimHash near-duplicates with a segment-popcount embedding.

Fingerprint: each 3-word shingle's XXH64 votes on 64 bits; a bit is set with more than half of the votes.

Links (at most RADIUS differing bits) are found between the different fingerprints only; copies share theirs. A
fingerprint is cut into segments of SEGMENT_BITS and embedded as its segments' bit counts. The Manhattan distance of two
embeddings is at most their Hamming distance, so linked fingerprints are within RADIUS of each other in the embedding.
The segments form BLOCKS blocks, of which at least BLOCKS - RADIUS then have equal counts. Each choice of so many blocks is a
grid whose cell is the counts of those blocks: linked fingerprints share a cell of some grid. Within a cell runs a range
join: only fingerprints whose whole bit counts are at most RADIUS apart meet (these differ by no more than the Manhattan
distance), those within RADIUS by the Manhattan distance are candidates, and candidates are verified on the bits.

A cell yields a spanning forest of its links, not its pairs. Cells of up to DENSE fingerprints are compared so. The
fingerprints of larger cells are dealt again on finer grids of the embedding, of FINE_BLOCKS blocks. Segments with one bit
set look alike in the embedding, so a cell may stay large even there; its fingerprints are dealt on the bits of the same
blocks, where all but 12 bits are equal and a cell holds at most 4096 fingerprints, whatever the data.

Components come from the forest by passing on smallest fingerprints with pointer jumping, one checkpoint a round; no
links or labels reach the driver.

Cases: null texts are empty; texts without words have fingerprint zero and link like any other; a text of one or two
words is one shingle; repeated rows and copies share a component; null ids are in components but are never the smallest
unless all are null; very long texts are read whole, in slices; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import delete, new_dir, own_name, written

RADIUS = 3
BLOCKS = 6
#: Bits of a segment; segment_counts counts pairs.
SEGMENT_BITS = 2
DENSE = 4096
FINE_BLOCKS = 16
#: Shingles whose bits are unpacked at once.
SLICE = 65_536


def fingerprint_bytes(data: bytes, shingle: int = 3) -> int:
    """The fingerprint of a text in UTF-8."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)), strict=False)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(grams), SLICE):
        h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams[at : at + SLICE]], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(grams)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """df with the fingerprint of the text, as a signed 64-bit number, under a name of its own if df has a column out."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        got = np.array([fingerprint_bytes(t.encode("utf-8", "surrogatepass"), shingle) if t else 0 for t in texts], dtype=np.uint64)
        return pd.Series(got.view(np.int64))

    return df.withColumn(own_name(df, out), fingerprint(F.col(text)))


def segment_counts(fp: Column) -> Column:
    """The embedding in one number: the bit count of each segment (a pair of bits), in two bits."""
    odd, pairs = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    # of the bits in a pair: one of two, and both
    return fp.bitwiseXOR(pairs).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(pairs).bitwiseAND(odd), 1))


def unary_counts(fps: np.ndarray) -> np.ndarray:
    """The embedding with counts in unary, 0 as 00, 1 as 01 and 2 as 11: the Manhattan distance is the number of bits that differ."""
    odd = np.uint64(0x5555555555555555)
    pairs = fps >> np.uint64(1)
    return ((fps | pairs) & odd) | ((fps & pairs & odd) << np.uint64(1))


def grid_masks(blocks: int, radius: int) -> list[int]:
    """For each grid the bits of its blocks, which are all but radius of them; blocks consist of whole segments."""
    step = 64 // SEGMENT_BITS
    cuts = [round(i * step / blocks) * SEGMENT_BITS for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in some) for some in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def grid_cells(fps: DataFrame, key: Column, blocks: int, radius: int = RADIUS) -> DataFrame:
    """fp with each grid and the cell of key (of a number of 64 bits) it lies in."""
    got = fps.select("fp", key.alias("k"), F.posexplode(F.array(*[F.lit(m) for m in grid_masks(blocks, radius)])).alias("grid", "mask"))
    return got.select("fp", "grid", F.col("k").bitwiseAND(F.col("mask")).alias("cell"))


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest of the links between different fingerprints, as two columns of fingerprints."""
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    totals = np.bitwise_count(fps).astype(np.int64)
    ends = np.searchsorted(totals, totals + radius, "right")
    unary = unary_counts(fps)
    parent = np.arange(len(fps))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(len(fps) - 1):
        near = np.nonzero(np.bitwise_count(unary[i + 1 : ends[i]] ^ unary[i]) <= radius)[0] + i + 1
        for j in near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, int(j)))
    return fps[np.array(links, np.int64).reshape(-1, 2)]


def cell_links(cells: DataFrame, radius: int) -> DataFrame:
    """a, b: the forest links of each cell. The cells hold a bounded number of fingerprints each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty((3, 0), np.int64)]
        a_out: list[np.ndarray] = []

        def close(block: np.ndarray) -> None:
            """Links of whole cells, given as sorted columns."""
            if not block.shape[1]:
                return
            edge = np.nonzero(np.any(block[:2, 1:] != block[:2, :-1], axis=0))[0] + 1
            starts = np.concatenate([[0], edge])
            ends = np.concatenate([edge, [block.shape[1]]])
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                found = forest(block[2, s:e].view(np.uint64), radius)
                if len(found):
                    a_out.append(found.view(np.int64))

        def out() -> Iterator[pa.RecordBatch]:
            if a_out:
                got = np.concatenate(a_out)
                a_out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(got.min(axis=1)), pa.array(got.max(axis=1))], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]))
            block = np.concatenate(held, axis=1)
            # the last cell may go on in the next batch
            last = np.nonzero((block[0] != block[0, -1]) | (block[1] != block[1, -1]))[0] if block.shape[1] else []
            cut = int(last[-1]) + 1 if len(last) else 0
            close(np.ascontiguousarray(block[:, :cut]))
            held = [block[:, cut:]]
            yield from out()
        close(np.ascontiguousarray(np.concatenate(held, axis=1)))
        yield from out()

    placed = cells.select(F.col("grid").cast("long"), "cell", "fp").repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp")
    return placed.mapInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """a < b: links that connect whatever is linked, over a table of different fingerprints (column fp)."""
    links = fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    for blocks in (BLOCKS, FINE_BLOCKS):
        cells = grid_cells(fps, segment_counts(F.col("fp")), blocks, radius)
        crowded = written(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > dense), "crowded")
        if crowded.isEmpty():
            return links.unionByName(cell_links(cells, radius)).distinct()
        named = crowded.select(F.col("grid").alias("g2"), F.col("cell").alias("c2"))
        same = (F.col("grid") == F.col("g2")) & (F.col("cell") == F.col("c2"))
        links = links.unionByName(cell_links(cells.join(named, same, "left_anti"), radius))
        fps = written(cells.join(named, same, "left_semi").select("fp").distinct(), "crowd")
    return links.unionByName(cell_links(grid_cells(fps, F.col("fp"), FINE_BLOCKS, radius), radius)).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node that links reach from it), for the nodes of the links.

    Large-star and small-star steps: each node hangs its larger neighbours, then its smaller ones, on the smallest it
    knows; the links thin out to stars in a logarithmic number of rounds. Each round is written to the shared folder.
    """
    spark = links.sparkSession
    at = new_dir(spark, "links")
    links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct().write.parquet(f"{at}/0")
    now, before, k = spark.read.parquet(f"{at}/0"), None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.*").filter("u <> v").distinct()
        k += 1
        small.write.parquet(f"{at}/{k}")
        delete(spark, f"{at}/{k - 1}")
        now = spark.read.schema(small.schema).parquet(f"{at}/{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def component_roots(smallest: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root (a fingerprint that names the component), component_id, for a table of different fingerprints with the
    smallest id of each (fp, least_id)."""
    smallest = written(smallest, "distinct")
    roots = components(fingerprint_links(smallest.select("fp"), radius))
    placed = smallest.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "r")
    return placed.join(named, F.col("root") == F.col("r")).select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """One row for each row of df: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    rows = written(with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle).select("doc_id", "fp"), "fingerprints")
    # as a table of its own: its rows can then be joined to the copies of a hot fingerprint in parts
    per_fp = written(component_roots(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), radius), "classes").withColumnRenamed("fp", "f")
    return rows.join(per_fp, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Sorted arrays in the shared folder, which workers memory-map.

A mapped array needs no room in a worker's own memory, and the workers of a machine share its pages. The folder must be one that
workers can open, or one that pyarrow can read: then a file is copied to an unnamed temporary file of the worker.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import new_dir

#: Keys of a bucket of a HashTable, about.
BUCKET_KEYS = 1_000_000
#: Words that workers hold as they are.
MOST_HELD = 50_000


def local_path(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def store(uri: str, arrays: list[np.ndarray]) -> None:
    """One file with the arrays one after the other; written aside and renamed, so a repeated task does no harm."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_output_stream(path) as f:
            for a in arrays:
                f.write(a.tobytes())
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    aside = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(aside, "wb") as f:
        for a in arrays:
            f.write(a.tobytes())
    os.replace(aside, path)


@lru_cache(maxsize=1024)
def mapped(uri: str) -> np.ndarray:
    """The bytes of a stored file, memory-mapped."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    aside = tempfile.TemporaryFile()
    with system.open_input_stream(path) as f:
        while block := f.read(1 << 24):
            aside.write(block)
    aside.flush()
    return np.memmap(aside, np.uint8, "r") if aside.tell() else np.empty(0, np.uint8)


def columns(uri: str, n: int, kinds: list[str]) -> list[np.ndarray]:
    raw, at, out = mapped(uri), 0, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(raw[at : at + size].view(k))
        at += size
    return out


def hash_of(word: str) -> int:
    """What Spark's xxhash64 gives for a string, unsigned."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


@dataclass
class HashTable:
    """Different words, each with a number from 0 up. Few words go to the workers as they are (held); more lie in the shared
    folder by hash, in buckets by the hash's first bits."""

    at: str = ""
    bits: int = 0
    sizes: dict[int, int] = field(default_factory=dict)
    held: dict[str, int] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.sizes or self.held)

    def among(self, words: set[str]) -> dict[str, int]:
        """Those of the words that are in the table, with their numbers."""
        if not self.sizes:
            return {w: self.held[w] for w in self.held.keys() & words}
        some = list(words)
        values = self.look_up(some)
        return {some[i]: int(values[i]) for i in np.nonzero(values >= 0)[0]}

    def look_up(self, words: list[str]) -> np.ndarray:
        """The words' numbers, -1 for words that aren't there."""
        out = np.full(len(words), -1, np.int64)
        if not words:
            return out
        hashes = np.array([hash_of(w) for w in words], np.uint64)
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for b in np.unique(bucket).tolist():
            if b in self.sizes:
                keys, values = columns(f"{self.at}/{b}", self.sizes[b], ["<u8", "<i8"])
                mine = np.nonzero(bucket == b)[0]
                at = np.minimum(np.searchsorted(keys, hashes[mine]), len(keys) - 1)
                out[mine] = np.where(keys[at] == hashes[mine], values[at], -1)
        return out


def hash_table(words: DataFrame, word: str, value: str, tag: str) -> HashTable:
    """A table of words (different ones) and their numbers. Up to MOST_HELD words come to the driver; with more, buckets are
    written by tasks and the driver gets their sizes."""
    spark = words.sparkSession
    n = words.count()
    if n <= MOST_HELD:
        return HashTable(held={w: v for w, v in words.select(word, F.col(value).cast("long")).collect()})
    at = new_dir(spark, tag)
    bits = max(0, int(np.ceil(np.log2(n / BUCKET_KEYS))))
    bucket = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")

    def keep(table: pa.Table) -> pa.Table:
        keys = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        b = table.column("b")[0].as_py()
        store(f"{at}/{b}", [keys[order], table.column("v").to_numpy()[order].astype(np.int64)])
        return pa.table({"b": [b], "n": [len(keys)]})

    rows = words.select(F.xxhash64(word).alias("h"), F.col(value).cast("long").alias("v")).select(bucket.alias("b"), "h", "v")
    return HashTable(at, bits, dict(map(tuple, rows.groupBy("b").applyInArrow(keep, "b long, n long").collect())))

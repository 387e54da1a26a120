"""The xp3 archive format: reading members and packing archives.

Layout, little endian: magic of 7 bytes, version u32, index offset u64, index size u64. Index: count u32, then for each
member its name's length u16 and name (UTF-16, NUL at the end), number of segments u32, segments (offset, original and
stored size u64, flags u32; bit 0: deflated), and a u32 more where the version has bit 16.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC = b"XP3\r\n\x1a\n"
HEADER = struct.Struct("<IQQ")
SEGMENT = struct.Struct("<QQQI")
PLAIN_VERSION, WITH_INFO = 0x0C, 0x10000
FIRST = len(MAGIC) + HEADER.size


class ArchiveError(ValueError):
    pass


class Reader:
    """Bounded reads from bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ArchiveError("the index ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, kind: str | struct.Struct):
        s = kind if isinstance(kind, struct.Struct) else struct.Struct(kind)
        got = s.unpack(self.bytes(s.size))
        return got if len(got) > 1 else got[0]


def members(data: bytes) -> Iterator[tuple[str, list[tuple[int, int, int, int]], int | None]]:
    """Name, segments and info of each member."""
    if len(data) < FIRST or not data.startswith(MAGIC):
        raise ArchiveError("not an xp3 archive")
    version, at, size = HEADER.unpack_from(data, len(MAGIC))
    if at + size > len(data):
        raise ArchiveError("the index lies outside the archive: it is encrypted or damaged")
    index = Reader(data[at : at + size])
    for _ in range(index.unpack("<I")):
        try:
            name = index.bytes(index.unpack("<H")).decode("utf-16-le").rstrip("\0")
        except UnicodeDecodeError as e:
            raise ArchiveError("a name can't be read: the archive is encrypted or of another kind") from e
        segments = [index.unpack(SEGMENT) for _ in range(index.unpack("<I"))]
        info = index.unpack("<I") if version & WITH_INFO and index.at + 4 <= size else None
        yield name, segments, info


def content_of(data: bytes, segments: list[tuple[int, int, int, int]]) -> bytes:
    parts = []
    for at, original, stored, flags in segments:
        raw = data[at : at + stored]
        if len(raw) < stored:
            raise ArchiveError("a segment lies outside the archive")
        parts.append(zlib.decompress(raw) if flags & 1 else raw[:original])
    return b"".join(parts)


def safe_name(name: str) -> str:
    """With forward slashes; names that lead out of the archive are refused."""
    name = name.replace("\\", "/").lstrip("/")
    if ".." in name.split("/"):
        raise ArchiveError(f"a member's name leads out of the archive: {name}")
    return name


def pack(files: dict[str, bytes], compress: bool = True, version: int = PLAIN_VERSION) -> bytes:
    """An archive of the files by name, each in one segment."""
    body, entries = bytearray(), []
    for name in sorted(files):
        stored = zlib.compress(files[name], 6) if compress else files[name]
        raw = name.replace("/", "\\").encode("utf-16-le") + b"\0\0"
        entries.append(struct.pack("<H", len(raw)) + raw + struct.pack("<I", 1) + SEGMENT.pack(FIRST + len(body), len(files[name]), len(stored), int(compress)))
        body += stored
    index = struct.pack("<I", len(entries)) + b"".join(entries)
    return MAGIC + HEADER.pack(version, FIRST + len(body), len(index)) + bytes(body) + index


def unpack_archives(archives: DataFrame) -> DataFrame:
    """archive, rel, content, stored_size, error from archives (path, content). A broken archive gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    for name, segments, _ in members(data):
                        rows.append((path, safe_name(name), content_of(data, segments), sum(s[2] for s in segments), ""))
                except (ArchiveError, zlib.error, struct.error) as e:
                    rows = [(path, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "rel", "content", "stored_size", "error"])

    return archives.select("path", "content").mapInPandas(run, "archive string, rel string, content binary, stored_size long, error string")


def pack_archives(members_df: DataFrame) -> DataFrame:
    """archive, content from members (archive, rel, content): one archive's members are one group, as they become one value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "content": [pack(dict(zip(pdf["rel"], pdf["content"], strict=True)))]})

    return members_df.select("archive", "rel", "content").groupBy("archive").applyInPandas(run, "archive string, content binary")


def merge_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members with the new contents in place of the old, and what is only new."""
    n = new.select("archive", "rel", F.col("content").alias("new_content"))
    return old.select("archive", "rel", "content").join(n, ["archive", "rel"], "full").select("archive", "rel", F.coalesce("new_content", "content").alias("content"))

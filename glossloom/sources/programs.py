"""Windows programs: version information and printable strings."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.operators.fingerprint import detect_engine

# The scan's bounds and the published layout's numbers.
SCAN_BYTES, MOST_STRINGS = 64 * 1024 * 1024, 4000
VERSION_RESOURCE = 16
ASCII_RUN = re.compile(rb"[ -~]{6,}(?=[^ -~])", re.DOTALL)
WIDE_RUN = re.compile(rb"(?:[ -~]\x00){5,}(?=(?![ -~]\x00)[\x00-\xff]{2})", re.DOTALL)
INFO = "name string, product string, company string, version string, description string, error string"


def printable_strings(data: bytes) -> list[str]:
    """Runs of at least 6 ASCII characters, then of at least 5 in UTF-16 at even places, from the first SCAN_BYTES; runs
    that reach the end are left out."""
    head = data[:SCAN_BYTES]
    out = []
    for m in ASCII_RUN.finditer(head):
        out.append(m[0].decode("ascii"))
        if len(out) >= MOST_STRINGS:
            return out
    at = 0
    while m := WIDE_RUN.search(head, at):
        if m.start() % 2:
            at = m.start() + 1
            continue
        out.append(m[0].decode("utf-16-le"))
        if len(out) >= MOST_STRINGS:
            return out
        at = m.end()
    return out


class Image:
    """A PE file's sections and resources."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        if len(data) < 64 or data[:2] != b"MZ":
            raise ValueError("no DOS header")
        pe = self.at("<I", 0x3C)
        if data[pe : pe + 4] != b"PE\0\0":
            raise ValueError("no PE header")
        n_sections, optional = self.at("<H", pe + 6), self.at("<H", pe + 20)
        wide = self.at("<H", pe + 24) == 0x20B
        self.resources = self.at("<I", pe + 24 + (112 if wide else 96) + 16)
        first = pe + 24 + optional
        # virtual address, place in the file, size in the file
        self.sections = [(self.at("<I", s + 12), self.at("<I", s + 20), self.at("<I", s + 16)) for s in range(first, first + 40 * n_sections, 40)]

    def at(self, kind: str, place: int) -> int:
        return struct.unpack_from(kind, self.data, place)[0]

    def place(self, rva: int) -> int:
        for va, raw, size in self.sections:
            if va <= rva < va + size:
                return rva - va + raw
        raise ValueError("an address outside all sections")

    def version_block(self) -> bytes:
        """The first version resource."""
        root = self.place(self.resources)

        def entries(directory: int):
            n = self.at("<H", directory + 12) + self.at("<H", directory + 14)
            return [(self.at("<I", e), self.at("<I", e + 4)) for e in range(directory + 16, directory + 16 + 8 * n, 8)]

        below = next((o for i, o in entries(root) if i == VERSION_RESOURCE), None)
        if below is None:
            raise ValueError("no version resource")
        while below & 0x80000000:
            below = entries(root + (below & 0x7FFFFFFF))[0][1]
        rva, size = struct.unpack_from("<II", self.data, root + below)
        start = self.place(rva)
        return self.data[start : start + size]


def align(n: int) -> int:
    return n + 3 & ~3


def version_strings(block: bytes, at: int = 0, end: int | None = None) -> dict[str, str]:
    """Key and value of all text leaves of a version block: length, value length, type, key, padding, value, children."""
    out: dict[str, str] = {}
    end = len(block) if end is None else end
    while at + 6 <= end:
        size, value, text = struct.unpack_from("<HHH", block, at)
        if size < 6:
            break
        stop = min(at + size, end)
        key_end = at + 6
        while key_end + 2 <= stop and block[key_end : key_end + 2] != b"\0\0":
            key_end += 2
        key = block[at + 6 : key_end].decode("utf-16-le", "replace")
        body = align(key_end + 2)
        if text and value:
            out[key] = block[body : min(body + 2 * value, stop)].decode("utf-16-le", "replace").rstrip("\0")
        else:
            out |= version_strings(block, align(body + value), stop)
        at = align(at + size)
    return out


def program_info(path: str, data: bytes) -> tuple:
    """Name and version information; what can't be read of the latter stays empty."""
    name = path.rsplit("/", 1)[-1]
    try:
        image = Image(data)
    except (ValueError, struct.error) as e:
        return name, "", "", "", "", str(e)
    try:
        v = version_strings(image.version_block())
    except (ValueError, struct.error, IndexError):
        v = {}
    return name, v.get("ProductName", ""), v.get("CompanyName", ""), v.get("FileVersion", "") or v.get("ProductVersion", ""), v.get("FileDescription", ""), ""


def programs(files: DataFrame) -> DataFrame:
    """path, size, name, product, company, version, description, error, strings, engine of programs (path, content)."""

    @F.pandas_udf(f"struct<{INFO.replace(' string', ':string')},strings:array<string>>")
    def read(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = [(*program_info(p, c), printable_strings(c)) for p, c in zip(path, content, strict=True)]
        return pd.DataFrame(rows, columns=["name", "product", "company", "version", "description", "error", "strings"])

    got = files.select("path", F.length("content").alias("size"), read("path", "content").alias("i")).select("path", "size", "i.*")
    joined = F.concat_ws("\n", F.array_join("strings", "\n"), "name", "product", "company", "version", "description")
    engines = detect_engine(got.select("path", joined.alias("joined")), "path", "joined").select(F.col("path").alias("p"), "engine")
    return got.join(engines, F.col("path") == F.col("p"), "left").drop("p")

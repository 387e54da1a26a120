"""Encodings of text files: detection, decoding and encoding, on bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KANA = re.compile("[぀-ヿ]")
# Byte order marks and the codecs that stand for our names.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
DECODERS = {"utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "shift_jis": "cp932", "gbk": "gb18030"}
ENCODERS = {"utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "shift_jis": "shift_jis", "gbk": "gbk"}

TEXT_AND_ENCODING = T.StructType().add("text", "string").add("encoding", "string")
BYTES_AND_WARNING = T.StructType().add("content", "binary").add("warning", "string")


#: What the codec makes of single bytes that the format leaves undefined.
UNDEFINED = {"shift_jis": re.compile("[\xa0\uf8f1-\uf8f3]")}


def strictly(data: bytes, encoding: str) -> str | None:
    try:
        text = data.decode(DECODERS[encoding])
    except UnicodeDecodeError:
        return None
    return None if encoding in UNDEFINED and UNDEFINED[encoding].search(text) else text


def detect_bytes(data: bytes | None) -> str:
    """A byte order mark decides; then ASCII and valid UTF-8; then Shift-JIS or GBK, by which gives more kana."""
    data = data or b""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    if data.isascii() or strictly(data, "utf-8") is not None:
        return "utf-8"
    sjis, gbk = strictly(data, "shift_jis"), strictly(data, "gbk")
    if sjis is not None and gbk is not None:
        return "shift_jis" if len(KANA.findall(sjis)) > len(KANA.findall(gbk)) else "gbk"
    return "shift_jis" if sjis is not None else "gbk" if gbk is not None else "utf-8"


def decode_bytes(data: bytes | None, encoding: str) -> str:
    """Text without byte order mark; undecodable bytes become U+FFFD."""
    return (data or b"").decode(DECODERS.get(encoding, "utf-8"), "replace").removeprefix("﻿")


def encode_text(text: str, encoding: str) -> tuple[bytes, str]:
    """Bytes, with a mark for UTF-16, and a warning: what the encoding lacks is written in UTF-8 instead."""
    try:
        data = text.encode(ENCODERS.get(encoding, "utf-8"))
    except UnicodeEncodeError:
        return text.encode("utf-8"), f"not in {encoding}; written as utf-8"
    return ({"utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff"}.get(encoding, b"") + data), ""


@F.pandas_udf(TEXT_AND_ENCODING)
def read_text(content: pd.Series) -> pd.DataFrame:
    kinds = [detect_bytes(c) for c in content]
    return pd.DataFrame({"text": [decode_bytes(c, k) for c, k in zip(content, kinds, strict=True)], "encoding": kinds})


@F.pandas_udf(T.StringType())
def detect_encoding(content: pd.Series) -> pd.Series:
    return pd.Series([detect_bytes(c) for c in content])


@F.pandas_udf(BYTES_AND_WARNING)
def write_text(text: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    got = [encode_text(t or "", e) for t, e in zip(text, encoding, strict=True)]
    return pd.DataFrame({"content": [g[0] for g in got], "warning": [g[1] for g in got]})


def has_mark(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")

"""Fitting text into boxes, with a given width function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes that are tried, line height, margin.
LARGEST, SMALLEST, LINE_HEIGHT, MARGIN, MOST_LINES = 16, 5, 1.25, 2.0, 3

Width = Callable[[str, float], float]


def plain_width(text: str, size: float) -> float:
    """A rough width without a font: wide characters take the size, others half of it."""
    return sum(size if ord(c) >= 0x2E80 else size / 2 for c in text)


def wrapped(text: str, size: float, room: float, width: Width) -> Iterator[str]:
    """Lines that are as long as fits; a character wider than the room has a line of its own."""
    line = ""
    for c in text:
        if line and width(line + c, size) > room:
            yield line
            line = c
        else:
            line += c
    if line:
        yield line


def shortened(line: str, size: float, room: float, width: Width) -> str:
    if width(line, size) <= room:
        return line
    while line and width(line + "…", size) > room:
        line = line[:-1]
    return line + "…"


def fit(text: str, w: float, h: float, width: Width = plain_width, most: int = MOST_LINES) -> tuple[list[str], int]:
    """Lines and the largest size at which all of the text takes at most `most` lines and the box's height; at the
    smallest size what fits in so many lines."""
    room = w - MARGIN
    for size in range(LARGEST, SMALLEST - 1, -1):
        lines = []
        for line in wrapped(text, size, room, width):
            lines.append(line)
            if len(lines) > most:
                break
        if lines and len(lines) <= most and len(lines) * size * LINE_HEIGHT <= h:
            return [*lines[:-1], shortened(lines[-1], size, room, width)], size
    lines = [line for line, _ in zip(wrapped(text, SMALLEST, room, width), range(most), strict=False)]
    return [*lines[:-1], shortened(lines[-1], SMALLEST, room, width)] if lines else [], SMALLEST


def with_layout(df: DataFrame, text: str, w: str, h: str, width: Width = plain_width, out: str = "layout") -> DataFrame:
    """df with struct(lines, size) for the text in a box of w by h."""

    @F.pandas_udf("struct<lines:array<string>,size:int>")
    def lay(texts: pd.Series, ws: pd.Series, hs: pd.Series) -> pd.DataFrame:
        got = [fit(t or "", a, b, width) for t, a, b in zip(texts, ws, hs, strict=True)]
        return pd.DataFrame({"lines": [g[0] for g in got], "size": [g[1] for g in got]})

    return df.withColumn(out, lay(F.col(text), F.col(w), F.col(h)))

"""Secret scans: keyword, key-id and hex patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of the characters that keys are written in, at least WINDOW long. A window slides over it;
the counts of its characters, and with them the sum of c * log2(c), change by one character in and one out, so each step
costs the same. A window counts when its entropy reaches the threshold of the candidate's character class; overlapping
windows that count make one span. Candidates that match the allow list are suppressed, and so are spans inside a span of
the patterns. The allow list never takes away what the patterns find.

Cases: null and empty texts have no spans; repeated rows get equal spans; very long texts are read whole, in time
proportional to their length; rows and other columns pass unchanged; an empty table has no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import own_name

WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy")
#: Bits a character that a window must reach, by character class. A window of 20 has at most 4.32.
THRESHOLDS = {"hex": 3.0, "lower": 3.6, "mixed": 3.7}
#: Full matches of a candidate that are no secrets: UUIDs, dates and times, versions, runs in order, the key of the public examples.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-].*",
    r"[0-9_=+/-]+",
    r"[A-Za-z_=+/-]+",
    r".*(?:abcdefghij|ABCDEFGHIJ|0123456789).*",
    r".*EXAMPLE.*",
)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")

SPANS = "array<struct<kind:string,start:int,end:int>>"


def char_class(text: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", text):
        return "hex"
    return "lower" if text.lower() == text else "mixed"


def entropy_windows(text: str, window: int, threshold: float) -> Iterator[tuple[int, int]]:
    """Unions of the windows whose entropy reaches the threshold, as (start, end)."""
    plogp = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    total, first, last = 0.0, -1, -1
    enough = window * (math.log2(window) - threshold) + 1e-9
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += plogp[n + 1] - plogp[n]
        if i >= window:
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += plogp[n - 1] - plogp[n]
        at = i - window + 1
        if at >= 0 and total <= enough:
            if first >= 0 and at <= last:
                last = i + 1
            else:
                if first >= 0:
                    yield first, last
                first, last = at, i + 1
    if first >= 0:
        yield first, last


def find_secrets(text: str | None, allow: Sequence[re.Pattern], window: int = WINDOW, thresholds: dict = THRESHOLDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    if not text:
        return []
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    base = sorted(found)
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not DIGIT.search(run) or not LETTER.search(run) or any(a.fullmatch(run) for a in allow):
            continue
        for a, b in entropy_windows(run, window, thresholds[char_class(run)]):
            a, b = a + m.start(), b + m.start()
            if not any(x <= a and b <= y for x, y, _ in base):
                found.append((a, b, "entropy"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def with_secrets(df: DataFrame, text: str = "text", out: str = "secrets", allow: Sequence[str] = ALLOW, window: int = WINDOW, thresholds: dict = THRESHOLDS) -> DataFrame:
    """df with its secrets as an array of (kind, start, end), under a name of its own if df has a column out."""
    patterns = list(allow)

    @F.pandas_udf(SPANS)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [re.compile(p) for p in patterns]
        for batch in texts:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in find_secrets(t, compiled, window, thresholds)] for t in batch])

    return df.withColumn(own_name(df, out), scan(F.col(text)))

"""Information-theoretic sanitisation of personal data.

Protected entities are found by pattern: e-mail and IP addresses, payment cards and phone numbers. A term of the text can
disclose an entity without naming it. From the corpus we count, for a term t near an entity e (within CONTEXT words),
in how many different contexts they meet, n(e, t), and in how many different texts t occurs, n(t). With
P(e | t) = n(e, t) / n(t) and P(e) = n(e) / N, the term reveals log2(P(e | t) / P(e)) bits of e. Terms that meet e in
at least `support` contexts, reveal at least `bits` and reach P(e | t) >= `generalise` are replaced by their class;
from `remove` on they are removed. Copies of a text or of a context count once.

However many candidates and flagged terms there are, the corpus is read three times (contexts, counts, result): up to MOST_HELD
of them go to the workers as they are, more lie in hash tables in the shared folder, which workers memory-map.

Cases: null and empty texts have no spans and stay as they are; repeated rows get equal spans; very long texts are read
whole; an empty table has no entities, no flagged terms and no rows; other columns pass unchanged.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.arrays import HashTable, hash_table
from glossloom.llm.common import own_name, written

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 8
SUPPORT, BITS, GENERALISE, REMOVE = 3, 4.0, 0.5, 0.8
#: Different terms that a task counts before it sends.
MOST_COUNTED = 1_000_000
#: What is done with a term, by the number that hash tables have for it.
ACTS = ("generalise", "remove")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+")

SPANS = "array<struct<kind:string,start:int,end:int,act:string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: each run before an @ is read once."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def small(part: str) -> bool:
    """At most 255, without reading a long number."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def find_entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    if not text:
        return []
    found = [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(small(p) for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def entity_value(kind: str, text: str) -> str:
    """One spelling of an entity, hashed: the values themselves aren't passed on."""
    plain = text.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", text)
    return hashlib.md5(f"{kind}:{plain}".encode()).hexdigest()[:16]


def contexts(text: str | None, context: int = CONTEXT) -> list[dict]:
    """For each entity, the hashed value, the hash of its context and the terms of the context."""
    spans = find_entities(text)
    if not spans:
        return []
    words = [m for m in WORD.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in spans)]
    starts = [m.start() for m in words]
    out = []
    for a, b, kind in spans:
        left = bisect.bisect_left(starts, a)
        near = [m[0].lower() for m in words[max(0, left - context) : left + context]]
        terms = sorted({w for w in near if len(w) > 2})
        out.append({"entity": entity_value(kind, text[a:b]), "context": hashlib.md5(" ".join(near).encode()).hexdigest()[:16], "terms": terms})
    return out


def with_terms(df: DataFrame, text: str, terms: HashTable, out: str) -> DataFrame:
    """df with the spans of the entities and of the given terms (in lower case, their numbers are places in ACTS)."""

    @F.pandas_udf(SPANS)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            rows = []
            for t in batch:
                spans = [(x, y, k, "replace") for x, y, k in find_entities(t)]
                # each different word is looked up once
                acts = terms.among({w.lower() for w in WORD.findall(t)}) if terms and t else {}
                if acts:
                    hits = [m for m in WORD.finditer(t) if m[0].lower() in acts]
                    taken = [(x, y) for x, y, _, _ in spans]
                    spans += [(*m.span(), "term", ACTS[acts[m[0].lower()]]) for m in hits if not any(x < m.end() and m.start() < y for x, y in taken)]
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"kind": k, "start": x, "end": y, "act": a} for x, y, k, a in spans])
            yield pd.Series(rows)

    return df.withColumn(out, scan(F.col(text)))


def text_counts(df: DataFrame, text: str, wanted: HashTable) -> DataFrame:
    """term, n_t: in how many different texts each wanted term occurs. Tasks count before they send. Terms that only share a
    wanted one's hash are counted, too, and fall out where the counts meet the terms."""

    @F.pandas_udf("array<string>")
    def has(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(wanted.among({w.lower() for w in WORD.findall(t)})) if t and wanted else [] for t in texts])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for pdf in batches:
            for terms in pdf["terms"]:
                n.update(terms)
            if len(n) > MOST_COUNTED:
                yield pd.DataFrame({"term": list(n), "n": list(n.values())}).astype({"term": object, "n": "int64"})
                n.clear()
        yield pd.DataFrame({"term": list(n), "n": list(n.values())}).astype({"term": object, "n": "int64"})

    one = df.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("id"), has(F.col(text)).alias("terms")).filter(F.size("terms") > 0).dropDuplicates(["id"])
    return one.select("terms").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_terms(df: DataFrame, text: str = "text", context: int = CONTEXT, support: int = SUPPORT, bits: float = BITS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row for each term that discloses an entity: term, bits, p (the largest over entities), act."""

    @F.pandas_udf("array<struct<entity:string,context:string,terms:array<string>>>")
    def near(texts: pd.Series) -> pd.Series:
        return pd.Series([contexts(t, context) for t in texts])

    found = df.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("id"), F.explode(near(F.col(text))).alias("m")).select("id", "m.*")
    met = written(found.groupBy("entity", "context").agg(F.min("id").alias("id"), F.first("terms").alias("terms")), "contexts")
    per_entity = met.groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = met.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support)
    # the texts of a term's contexts are some of its texts; where these alone are too many for P(e | t), the rest needs no count
    least = met.select("id", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n_least"))
    pairs = written(pairs.join(least, "term").filter(F.col("n_et") >= generalise * F.col("n_least")).drop("n_least"), "pairs")
    counts = text_counts(df, text, hash_table(pairs.select("term", F.lit(0).alias("v")).distinct(), "term", "v", "candidates"))
    n_texts = df.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("id")).distinct().count()
    p = F.least(F.lit(1.0), F.col("n_et") / F.col("n_t"))
    scored = pairs.join(counts, "term").join(per_entity, "entity").select("term", p.alias("p"), F.log2(p / (F.col("n_e") / F.lit(float(max(n_texts, 1))))).alias("bits"))
    scored = scored.filter((F.col("bits") >= bits) & (F.col("p") >= generalise))
    return scored.groupBy("term").agg(F.max("bits").alias("bits"), F.max("p").alias("p")).withColumn("act", F.when(F.col("p") >= remove, "remove").otherwise("generalise"))


def with_private_spans(df: DataFrame, text: str = "text", out: str = "private", **thresholds) -> DataFrame:
    """df with the spans of entities and disclosing terms, and what is to be done with each, under a name of its own if df has a column out."""
    flagged = written(disclosing_terms(df, text, **thresholds), "terms")
    act = F.array_position(F.array(*[F.lit(a) for a in ACTS]), F.col("act")) - 1
    return with_terms(df, text, hash_table(flagged.select("term", act.alias("v")), "term", "v", "flagged"), own_name(df, out))


def sanitised(df: DataFrame, text: str = "text", spans: str = "private", out: str = "clean_text") -> DataFrame:
    """df with the text whose entities are replaced by their kind, disclosing terms by their class or by nothing."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        rows = []
        for t, f in zip(texts, found, strict=True):
            if t is None or f is None or not len(f):
                rows.append(t)
                continue
            parts, at = [], 0
            for s in f:
                if s["start"] < at:
                    at = max(at, s["end"])
                    continue
                parts.append(t[at : s["start"]])
                word = t[s["start"] : s["end"]]
                parts.append(f"[{s['kind'].upper()}]" if s["act"] == "replace" else "" if s["act"] == "remove" else "[NUMBER]" if word[0].isdigit() else "[NAME]" if word[0].isupper() else "[WORD]")
                at = s["end"]
            rows.append("".join([*parts, t[at:]]))
        return pd.Series(rows)

    return df.withColumn(out, cut(F.col(text), F.col(spans)))

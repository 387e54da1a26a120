"""Quality classifier by co-training two views of a document.

The text view sees which words and symbol runs occur; the metadata view sees source, language, length, lines and the
shares of symbols, digits and capitals. For each label (quality, toxic) both views are fitted on the labelled documents.
Over ROUNDS rounds each view labels a pool of unlabelled documents, and those of which it is sure by its calibration go
to the other view as training data. At the end both views' scores are combined and calibrated on labelled documents that
neither was fitted on. A document is kept when it is more likely good than not and more likely clean than toxic.

Fitting takes a bounded sample: about FIT_ROWS labelled and POOL_ROWS unlabelled documents, picked by a hash of the id, and of
each class of a label at least CLASS_ROWS or all there are; the classes' rates are taken out of the result again. It runs on
the driver over hashed features. All documents are scored, whole.

Each round a view passes on PASSED_ON documents at most; the pool's size is the same at any input, as what the views can
learn from each other grows slowly with it, and the driver holds it. An id counts once in the sample, however many rows it has.

Cases: null and empty texts, null sources and languages are values like others; null ids can't be labelled; repeated
labels of an id count once (the lowest), null labels are left out; a label with one class only, or no labels at all,
gives the share of the good class with no more evidence, and 1 with no labels, so all is kept; a label with fewer than eight
documents of its rarer class is calibrated on those it was fitted on, as too few can be set aside; other columns pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 4000
POOL_ROWS = 2000
#: Of each class of each label, so many are fitted on, or all.
CLASS_ROWS = 500
ROUNDS = 3
SURE = 0.97
#: Most documents that a view passes on in a round.
PASSED_ON = 200
TEXT_FEATURES = 300
LEAST_DOCUMENTS = 8
RIDGE = 2.0

TOKEN = re.compile(r"[^\W_]+|[^\w\s]{2,}|[^\w\s.,]")
HASHED = 48


def text_features(tokens: list[str]) -> np.ndarray:
    """Hashes of the different tokens."""
    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in set(tokens)], np.uint64).view(np.int64)


def metadata_features(text: str, tokens: list[str], lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(8 + 2 * HASHED)
    n = max(1, len(text))
    words = max(1, len(tokens))
    symbols = sum(len(t) for t in tokens if not t[0].isalnum())
    digits = sum(len(t) for t in tokens if t[0].isdigit())
    lines = text.count("\n") + 1
    out[:8] = (math.log1p(len(text)) / 8, math.log1p(lines) / 4, math.log1p(n / lines) / 6, min(1.0, 4 * symbols / n), min(1.0, 10 * digits / n), len(set(tokens)) / words, n / words / 10, 1.0 if not text else 0.0)
    out[8 + xxhash.xxh32_intdigest(f"l:{lang}") % HASHED] = 1.0
    out[8 + HASHED + xxhash.xxh32_intdigest(f"s:{source}") % HASHED] = 1.0
    return out


def features(text: str | None, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    text = text or ""
    tokens = TOKEN.findall(text.lower())
    return text_features(tokens), metadata_features(text, tokens, lang, source)


# ---- logistic regression


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method with a ridge penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def informative(sets: list[np.ndarray], y: np.ndarray, most: int = TEXT_FEATURES) -> np.ndarray:
    """The hashes whose occurrence tells most about y, by mutual information."""
    every = np.concatenate([*sets, np.empty(0, np.int64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kinds, back, n = np.unique(every, return_inverse=True, return_counts=True)
    n1 = np.bincount(back, weights=y[owner], minlength=len(kinds))
    total, ones = len(y), y.sum()
    gain = np.zeros(len(kinds))
    for a, b, c in ((n1, n, ones), (n - n1, n, total - ones), (ones - n1, total - n, ones), (total - ones - n + n1, total - n, total - ones)):
        with np.errstate(divide="ignore", invalid="ignore"):
            gain += np.where(a > 0, a / total * np.log(a * total / np.maximum(b * c, 1e-12)), 0)
    gain[(n < LEAST_DOCUMENTS) | (n > total - LEAST_DOCUMENTS)] = -1
    best = np.lexsort((kinds, -gain))[:most]
    return np.sort(kinds[best[gain[best] > 0]])


def presence(sets: list[np.ndarray], kinds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(kinds)))
    if len(kinds):
        for i, s in enumerate(sets):
            at = np.searchsorted(kinds, s)
            at[at == len(kinds)] = 0
            out[i, at[kinds[at] == s]] = 1.0
    return out


@dataclass
class Head:
    """What one label's classifier needs: both views' weights and how to combine them. kinds None: a constant only."""

    constant: float
    kinds: np.ndarray | None = None
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    both: np.ndarray | None = None
    passed_on: int = 0

    def probability(self, sets: list[np.ndarray], meta: np.ndarray) -> np.ndarray:
        if self.kinds is None:
            return np.full(len(sets), self.constant)
        views = np.stack([apply(self.text, presence(sets, self.kinds)), apply(self.meta, meta)], axis=1)
        return sigmoid(apply(self.both, views))


def co_train(sets: list[np.ndarray], meta: np.ndarray, y: np.ndarray, pool_sets: list[np.ndarray], pool_meta: np.ndarray, rounds: int = ROUNDS, odds: float = 1.0) -> Head:
    """One label's classifier. Every fourth labelled document of a class calibrates; the others are fitted on. odds: how much
    oftener the sample takes a document with the label than one without."""
    rarer = min(y.sum(), len(y) - y.sum())
    if rarer < 1:
        return Head(float(y.mean()) if len(y) else math.nan)
    nth = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y <= 0))
    aside = nth % 4 == 0 if rarer >= 8 else np.ones(len(y), bool)
    fit = ~aside if rarer >= 8 else aside
    fit_sets = [s for s, f in zip(sets, fit, strict=True) if f]
    kinds = informative(fit_sets, y[fit])
    x = {"text": presence(sets, kinds), "meta": meta}
    pool = {"text": presence(pool_sets, kinds), "meta": pool_meta}
    given = {v: (x[v][fit], y[fit]) for v in x}
    free = {v: np.ones(len(pool_sets), bool) for v in x}
    passed = 0
    for _ in range(rounds + 1):
        weights = {v: fit_logistic(*given[v]) for v in x}
        if _ == rounds:
            break
        for view, other in (("text", "meta"), ("meta", "text")):
            z = apply(weights[view], x[view][aside])[:, None]
            scale = fit_logistic(z, y[aside], 1e-2)
            p = sigmoid(apply(scale, apply(weights[view], pool[view])[:, None])) if len(pool_sets) else np.empty(0)
            # as many of either class as their shares, the surest first
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                share = y[fit].mean() if label else 1 - y[fit].mean()
                rows = np.nonzero(free[other] & (sure >= SURE))[0]
                rows = rows[np.argsort(-sure[rows], kind="stable")][: max(1, int(PASSED_ON * share))]
                free[other][rows] = False
                passed += len(rows)
                gx, gy = given[other]
                given[other] = (np.vstack([gx, pool[other][rows]]), np.concatenate([gy, np.full(len(rows), label)]))
    views = np.stack([apply(weights[v], x[v][aside]) for v in ("text", "meta")], axis=1)
    both = fit_logistic(views, y[aside], 1e-1)
    both[-1] -= math.log(odds)
    return Head(float(y.mean()), kinds, weights["text"], weights["meta"], both, passed)


# ---- on tables

#: Both views' features as bytes of 64-bit numbers: the driver holds them as arrays, not as objects.
FEATURES = "struct<words:binary,meta:binary>"


def with_features(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    @F.pandas_udf(FEATURES)
    def extract(texts: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.DataFrame:
        rows = [features(*r) for r in zip(texts, langs, sources, strict=True)]
        return pd.DataFrame({"words": [r[0].tobytes() for r in rows], "meta": [r[1].tobytes() for r in rows]})

    return df.withColumn("f", extract(F.col(text), F.col(lang), F.col(source)))


def place(doc_id: str):
    """A hash of the id, in millionths."""
    return F.pmod(F.xxhash64(F.lit("fit"), F.col(doc_id).cast("string")), F.lit(1_000_000))


def picked(doc_id: str, rate: float):
    """Whether a hash of the id falls below the rate."""
    return place(doc_id) < int(rate * 1_000_000)


def one_each(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """For each id the row whose text has the smallest MD5, so that an id with many rows is one document of the sample."""
    rest = [c for c in docs.columns if c != doc_id]
    return docs.groupBy(doc_id).agg(F.min_by(F.struct(*rest), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_r")).select(doc_id, "_r.*")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", names: tuple[str, ...] = ("quality", "toxic"), rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS) -> dict[str, Head]:
    """A classifier for each label column."""
    labelled = labels.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(*[F.min(n).alias(f"y_{n}") for n in names])
    docs = docs.select(doc_id, text, lang, source)
    sizes = [F.count(F.when(c, 1)) for n in names for c in (F.col(f"y_{n}") <= 0, F.col(f"y_{n}") > 0)]
    (n_labels, *n_class), n_docs = labelled.agg(F.count("*"), *sizes).first(), docs.count()
    # of a class with few documents, a larger share
    below = [int(min(1.0, max(rows / max(1, n_labels), CLASS_ROWS / max(1, n))) * 1_000_000) for n in n_class]
    below = {n: below[2 * i : 2 * i + 2] for i, n in enumerate(names)}
    most = F.greatest(F.lit(0), F.lit(0), *[F.when(F.col(f"y_{n}") > 0, b[1]).when(F.col(f"y_{n}") <= 0, b[0]) for n, b in below.items()])
    few = labelled.withColumn("place", place(doc_id)).filter(F.col("place") < most)
    pool = docs.filter(F.col(doc_id).isNotNull() & picked(doc_id, min(1.0, pool_rows / max(1, n_docs))))
    known = with_features(one_each(docs.join(F.broadcast(few), doc_id), doc_id, text), text, lang, source).select(doc_id, *[f"y_{n}" for n in names], "place", "f").orderBy(doc_id).collect()
    near = labels.filter(F.col(doc_id).isNotNull() & picked(doc_id, min(1.0, pool_rows / max(1, n_docs)))).select(doc_id)
    unknown = with_features(one_each(pool.join(near, doc_id, "left_anti"), doc_id, text), text, lang, source).select(doc_id, "f").orderBy(doc_id).collect()
    width = 8 + 2 * HASHED
    meta, pool_meta = (np.frombuffer(b"".join(r["f"]["meta"] for r in rs), np.float64).reshape(-1, width) for rs in (known, unknown))
    sets, pool_sets = ([np.frombuffer(r["f"]["words"], np.int64) for r in rs] for rs in (known, unknown))
    out = {}
    for n in names:
        has = [i for i, r in enumerate(known) if r[f"y_{n}"] is not None and r["place"] < below[n][r[f"y_{n}"] > 0]]
        out[n] = co_train([sets[i] for i in has], meta[has], np.array([float(known[i][f"y_{n}"] > 0) for i in has]), pool_sets, pool_meta, odds=below[n][1] / below[n][0])
    return out


def classify(docs: DataFrame, heads: dict[str, Head], text: str = "text", lang: str = "lang", source: str = "source", out: str = "p") -> DataFrame:
    """docs with a struct of the labels' probabilities."""
    names = list(heads)

    @F.pandas_udf(f"struct<{','.join(f'{n}:double' for n in names)}>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs, sources in batches:
            rows = [features(*r) for r in zip(texts, langs, sources, strict=True)]
            sets, meta = [r[0] for r in rows], np.array([r[1] for r in rows]).reshape(len(rows), -1)
            yield pd.DataFrame({n: heads[n].probability(sets, meta) for n in names})

    return docs.withColumn(out, score(F.col(text), F.col(lang), F.col(source)))


def is_kept(p: str = "p"):
    """More likely good than not, and not more likely toxic than clean. Without labels there is nothing against a document."""
    good = F.coalesce(F.nanvl(F.col(f"{p}.quality"), F.lit(1.0)), F.lit(1.0))
    toxic = F.coalesce(F.nanvl(F.col(f"{p}.toxic"), F.lit(0.0)), F.lit(0.0))
    return (good >= 0.5) & (toxic <= 0.5)

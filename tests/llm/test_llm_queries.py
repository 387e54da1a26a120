"""Queries as a whole: against their SQL in DuckDB, or against plain Python."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from glossloom.llm import arrays, knlm, pii, queries, secrets

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def sorted_rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == sorted_rows(names, want.fetchall())


@pytest.fixture(scope="module")
def own_tables(spark, tmp_path_factory):
    """The documents of SF and some with secrets, personal data and a term that discloses an address; nulls and copies."""
    at = str(tmp_path_factory.mktemp("own"))
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect())]
    rows += [(1000 + i, f"word{i} alpha{i} Zorblax manager called bob@x.org today filler{i} number{i}") for i in range(6)]
    rows += [(2000, None), (2001, ""), (2002, rows[0][1]), (None, "password: hunter22 and AKIA" + "Q" * 20), (2003, 'API_KEY="Zx9Kq2Lm8Vt4Rp7Yw3Bn6" ' + "0123456789abcdef" * 2), (2004, "see zorblax now, +49 30 1234567, 4111 1111 1111 1111, 10.0.0.1 and a@b.co")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(2).write.parquet(f"{at}/documents.parquet")
    return at, rows


def digest(spans, kinds):
    order = sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in order)


def slow_secret_spans(t):
    """Base spans by the stated patterns; then unions of the windows of 20 characters whose entropy is high enough."""
    base = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            base.append((m.start(), m.end(), "assign"))
    base += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
        run = m[0]
        if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or any(re.fullmatch(a, run) for a in secrets.ALLOW):
            continue
        kind = "hex" if re.fullmatch("[0-9a-fA-F]+", run) else "lower" if run == run.lower() else "mixed"
        high = set()
        for i in range(len(run) - 19):
            counts = Counter(run[i : i + 20])
            if -sum(c / 20 * math.log2(c / 20) for c in counts.values()) >= secrets.THRESHOLDS[kind] - 1e-9:
                high |= set(range(i, i + 20))
        spans, at = [], None
        for i in sorted(high):
            # windows that meet only at their ends are one span, as are overlapping ones
            if at is None or i > spans[-1][1]:
                spans.append([i, i + 1])
                at = i
            else:
                spans[-1][1] = i + 1
        for a, b in spans:
            a, b = a + m.start(), b + m.start()
            if not any(x <= a and b <= y for x, y, _ in base):
                more.append((a, b, "entropy"))
    return base, more


def test_secret_scans_query(spark, own_tables):
    at, rows = own_tables
    got = {r.doc_id: r for r in queries.op1_secret_scans(spark, at).collect()}
    assert len(got) == len(rows)
    found = Counter()
    for i, t in rows:
        base, more = slow_secret_spans(t or "")
        n = Counter(k for _, _, k in base)
        found += n + Counter(k for _, _, k in more)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.n_entropy) == (n["assign"], n["access"], n["hex"], len(more))
        assert r.base_sha256 == hashlib.sha256(digest(base, secrets.KINDS).encode()).hexdigest()
        assert r.spans == digest(base + more, secrets.KINDS)
    assert found["assign"] and found["access"] and found["hex"]


def slow_private_terms(texts):
    """The terms that disclose an entity: shares of contexts and texts, counted by the definition."""
    texts = {hashlib.md5((t or "").encode()).hexdigest(): t or "" for t in texts}
    met, holds = defaultdict(set), defaultdict(set)
    for key, t in texts.items():
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)]
        for _, _, w in words:
            holds[w].add(key)
        spans = pii.find_entities(t)
        free = [w for w in words if not any(a < w[1] and w[0] < b for a, b, _ in spans)]
        for a, b, kind in spans:
            before = [w for w in free if w[0] < a][-pii.CONTEXT :]
            after = [w for w in free if w[0] >= a][: pii.CONTEXT]
            met[kind, pii.entity_value(kind, t[a:b])].add(tuple(w[2] for w in [*before, *after]))
    acts = {}
    for contexts in met.values():
        for w, n in Counter(w for c in contexts for w in set(c) if len(w) > 2).items():
            p = min(1.0, n / len(holds[w]))
            if n >= pii.SUPPORT and p >= pii.GENERALISE and math.log2(p / (len(contexts) / len(texts))) >= pii.BITS:
                acts[w] = max(acts.get(w, 0), p)
    return acts


@pytest.mark.parametrize("held", [arrays.MOST_HELD, 0])
def test_pii_query(spark, own_tables, monkeypatch, held):
    monkeypatch.setattr(arrays, "MOST_HELD", held)
    at, rows = own_tables
    flagged = slow_private_terms([t for _, t in rows])
    # one of seven texts with the word is no context of the address
    assert flagged.get("zorblax") == pytest.approx(6 / 7)
    got = {r.doc_id: r for r in queries.op6_pii(spark, at).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = pii.find_entities(t)
        more = [(m.start(), m.end(), "term") for m in re.finditer(r"[^\W_]+", t or "") if m[0].lower() in flagged and not any(a < m.end() and m.start() < b for a, b, _ in base)]
        n = Counter(k for _, _, k in base)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_term) == (n["email"], n["ip"], n["card"], n["phone"], len(more))
        assert r.base_sha256 == hashlib.sha256(digest(base, pii.KINDS).encode()).hexdigest()
        assert r.spans == digest(base + more, pii.KINDS)
    assert got[2004].n_email == got[2004].n_ip == got[2004].n_card == got[2004].n_phone == got[2004].n_term == 1


def test_lm_query_columns(spark, own_tables):
    at, rows = own_tables
    got = queries.op5_lm_scoring(spark, at)
    model = knlm.train(spark.read.parquet(f"{at}/documents.parquet").filter(~knlm.is_held_out(F.col("doc_id"))))
    want = {r.doc_id: r for r in knlm.with_scores(spark.read.parquet(f"{at}/documents.parquet"), model).collect()}
    for r in got.collect():
        assert r.train_tokens == model.tokens and r.n_tokens == want[r.doc_id].n_tokens
        assert (r.base_score, r.score) == pytest.approx((want[r.doc_id].base_score, want[r.doc_id].score))


@pytest.mark.parametrize("name", ["op3_sharding", "op5_lm_scoring", "op8_quality_classifier", "op9_mixing", "op10_fingerprints"])
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("held", "bucket"), [(50_000, 10), (0, 1_000_000), (0, 10)])
def test_hash_tables(spark, monkeypatch, held, bucket):
    monkeypatch.setattr(arrays, "MOST_HELD", held)
    monkeypatch.setattr(arrays, "BUCKET_KEYS", bucket)
    words = [f"wörd{i}" for i in range(200)]
    table = arrays.hash_table(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, v int"), "w", "v", "test")
    assert bool(table.held) == bool(held) and len(table.sizes) == (0 if held else 1 if bucket > 10 else len(table.sizes))
    assert table.among({*words[::3], "other", ""}) == {w: 3 * i for i, w in enumerate(words[::3])}
    assert not arrays.hash_table(spark.createDataFrame([], "w string, v int"), "w", "v", "test")

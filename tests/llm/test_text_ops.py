"""Secrets, personal data and chat formatting against brute force and round trips."""

import hashlib
import math
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossloom.llm import chat, pii, secrets

DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def texts(spark):
    return [r[0] for r in spark.read.parquet(DOCS).select("text").collect()] + ["", None, "x" * 100_000, "password=" * 2000, "1" * 50_000, "a" * 50_000 + "@", "1.2.3.4.5.6.7.8.9", "+1 (555) 123-4567 x +"]


def slow_secrets(t):
    """The patterns as they are stated."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_patterns_match_brute_force(texts):
    allow = [re.compile(p) for p in secrets.ALLOW]
    found = 0
    for t in texts:
        got = [s for s in secrets.find_secrets(t, allow) if s[2] != "entropy"]
        assert got == slow_secrets(t or "")
        found += len(got)
    assert found >= 3


@settings(max_examples=200, deadline=None)
@given(st.text("ab1XY9+/", min_size=0, max_size=60), st.floats(1.0, 3.0))
def test_windows_match_entropies(text, threshold):
    w = 8
    high = [i for i in range(len(text) - w + 1) if -sum(c / w * math.log2(c / w) for c in pd.Series(list(text[i : i + w])).value_counts()) >= threshold - 1e-12]
    want = sorted({k for i in high for k in range(i, i + w)})
    got = [k for a, b in secrets.entropy_windows(text, w, threshold) for k in range(a, b)]
    assert got == want


def test_entropy_and_allow_list():
    allow = [re.compile(p) for p in secrets.ALLOW]
    assert secrets.find_secrets("use Zx9Kq2Lm8Vt4Rp7Yw3Bn6 now", allow) == [(4, 25, "entropy")]
    assert secrets.find_secrets("1" * 40 + "a", allow) == [(0, 41, "hex")]
    assert secrets.find_secrets("id 123e4567-e89b-12d3-a456-426614174000 thatwordisverylongindeed", allow) == []


def test_secret_rows_and_columns_stay(spark):
    df = spark.createDataFrame([(1, "token: abcdef1", "x"), (1, "token: abcdef1", "x"), (None, None, None)], "doc_id long, text string, kind string")
    got = secrets.with_secrets(df)
    assert got.columns == ["doc_id", "text", "kind", "secrets"]
    assert sorted(len(r.secrets) for r in got.collect()) == [0, 1, 1]
    assert secrets.with_secrets(df.limit(0)).count() == 0
    again = secrets.with_secrets(df.withColumn("secrets", F.lit("own")))
    assert again.columns[-2:] == ["secrets", "secrets_"] and {r.secrets for r in again.collect()} == {"own"}


def slow_entities(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_entities_match_brute_force(texts):
    found = 0
    for t in texts:
        if t and len(t) >= 50_000:
            pii.find_entities(t)
            continue
        got = pii.find_entities(t)
        assert got == slow_entities(t or "")
        found += len(got)
    assert found >= 3


@settings(max_examples=300, deadline=None)
@given(st.text("a1.@-+ (_2é", max_size=60))
def test_entities_of_random_text(text):
    assert pii.find_entities(text) == slow_entities(text)


def test_disclosing_terms(spark):
    rows = [(i, f"word{i} alpha{i} Zorblax manager called bob@x.org today filler{i} number{i}") for i in range(6)]
    rows += [(10 + i, f"plain text number {i} manager called today") for i in range(94)] + [(200, None), (201, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.term: r for r in pii.disclosing_terms(df, bits=3.0).collect()}
    assert set(terms) == {"zorblax"}
    # 6 contexts of 6 texts; 102 different texts
    assert terms["zorblax"].p == 1.0 and terms["zorblax"].bits == pytest.approx(math.log2(1 / (6 / 101)), abs=0.1)
    got = {r.doc_id: r for r in pii.sanitised(pii.with_private_spans(df, bits=3.0)).collect()}
    assert got[1].clean_text == "word1 alpha1  manager called [EMAIL] today filler1 number1"
    assert got[200].clean_text is None and got[201].clean_text == ""
    assert pii.with_private_spans(df.limit(0)).count() == 0


TEXT = st.text(st.sampled_from(list("<|im_start|>\\/a\nü")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_chat_round_trip(turns):
    out, spans = chat.render_turns(turns, chat.chatml)
    assert chat.parse_chatml(out) == turns
    assert [chat.unescape(out[a:b]) for _, _, a, b, _ in spans] == [t for _, t in turns]
    assert [out[a:b] for a, b, *_ in spans] == [chat.chatml([t]) for t in turns]
    assert not any(s[4] for s in spans)


def test_rewriting_templates_are_found():
    template = lambda turns: f"{len(turns)}:" + "".join(t for _, t in turns)
    assert [s[4] for s in chat.render_turns([("user", "a"), ("assistant", "b")], template)[1]] == [True, True]
    stripping = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else t.strip()}" for i, (r, t) in enumerate(turns))
    assert [s[4] for s in chat.render_turns([("user", "a "), ("user", "b")], stripping)[1]] == [False, True]


def test_chat_tables(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (None, 0, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")] + [(3, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_digests(df).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, None: 1, 2: 2, 3: 300}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb<|im_end|>\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b<|im_end|>").hexdigest() and got[1].loss_chars == 11
    assert got[3].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(0, 300, 2)).encode()).hexdigest()
    assert not any(r.rewrites_history for r in got.values())
    pieces = chat.format_turns(df.filter("conv_id = 3")).orderBy("n").collect()
    assert "".join(r.piece for r in pieces) == chat.chatml([(r[2], r[3]) for r in sorted(rows[5:], key=lambda r: r[1])])
    assert [r.piece[r.text_start : r.text_end] for r in pieces] == [f"t{i}" for i in range(300)]
    assert chat.format_digests(df.limit(0)).count() == 0
    assert chat.format_turns(df.filter(F.col("conv_id").isNull())).first().conv_id is None


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_ids_of_conversations(spark, kind):
    ids = {"long": [None, 2**53, 2**53 + 1, -(2**63), 2**63 - 1], "int": [None, 1, -1], "string": [None, "", "a"]}[kind]
    df = spark.createDataFrame([(i, 0, "assistant", f"text of {i}") for i in ids], f"conv_id {kind}, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: (r.n_turns, r.loss_sha256) for r in chat.format_digests(df).collect()}
    assert got == {i: (1, hashlib.sha256(f"text of {i}".encode()).hexdigest()) for i in ids}
    assert {r.conv_id: r.piece for r in chat.format_turns(df).collect()} == {i: chat.chatml([("assistant", f"text of {i}")]) for i in ids}

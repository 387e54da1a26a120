"""Golden cases of the scalar functions and predicates."""

import pytest
from pyspark.sql import functions as F

from glossloom.functions import charset, predicates, text


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_djb2(spark):
    assert column(spark, ["", "abc", "mymemory|Hello"], text.djb2) == ["45h", "3772q3", "fo2d10"]


def test_trim_takes_wide_spaces(spark):
    assert column(spark, ["　 a b﻿\t", "\n", None], text.trim) == ["a b", "", None]


def test_names(spark):
    assert column(spark, ["a/b.TXT", "x", "a.tar.Gz"], text.ext_of) == ["txt", "", "gz"]
    assert column(spark, ["a/b.TXT", "x"], text.base_name) == ["b.TXT", "x"]


def test_escapes(spark):
    assert column(spark, ['<a href="x">&\'</a>'], text.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;&lt;/a&gt;"]
    assert column(spark, ['a"b\\c\n'], text.escape_json) == ['a\\"b\\\\c\\n']
    assert column(spark, ["caf\\u00e9", "\\ud83d\\ude00!", 'say \\"hi\\"', "a\\\\b", "x\\u12"], text.decode_escapes) == ["café", "😀!", 'say "hi"', "a\\b", "x\\u12"]


def test_sizes_and_times(spark):
    sizes = lambda c: text.fmt_bytes(c.cast("long"))
    assert column(spark, ["5", "2048", "5242880", "3221225472"], sizes) == ["5 B", "2.0 KB", "5.0 MB", "3.00 GB"]
    assert column(spark, ["1500", "125000"], lambda c: text.fmt_time(c.cast("long"))) == ["2s", "2m5s"]


@pytest.mark.parametrize(("s", "old", "new", "n", "want"), [("aaa", "aa", "X", 1, "aX"), ("a.b.c", ".", "-", 1, "a.b-c"), ("abc", "z", "-", 0, "abc"), ("abc", "", "-", 0, "abc"), ("xx", "x", "yy", 5, "xx")])
def test_replace_nth(spark, s, old, new, n, want):
    df = spark.createDataFrame([(s, old, new, n)], "s string, o string, w string, n int")
    assert df.select(text.replace_nth(F.col("s"), F.col("o"), F.col("w"), F.col("n"))).first()[0] == want


def test_colors(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0], [0.1, 0.1, 0.1])], "p array<double>, i array<double>")
    r = df.select(text.contrast_color(*[F.lit(v) for v in (1.0, 1.0, 1.0)]), text.contrast_color(*[F.lit(v) for v in (0.1, 0.1, 0.1)]), text.pick_background(F.col("i"), F.col("p")), text.pick_background(F.col("p"), F.col("p")), text.px_to_pt(F.lit(150))).first()
    assert list(r) == [[0.05] * 3, [1.0] * 3, [0.1] * 3, [1.0] * 3, 72.0]


def test_language_codes(spark):
    assert column(spark, ["ja", "xx"], lambda c: text.language_code(c, "baidu")) == ["jp", "zh"]
    assert column(spark, ["ja", "xx"], lambda c: text.language_code(c, "mymemory")) == ["ja", "xx"]


LINES = ["Hello", "勇者", "回復薬", "你好世界", "这是", "こんにちは、", "한국어", "12:30", "http://a.b", "/usr/bin", "a   b", "x" * 801, None, " "]


def test_line_units(spark):
    assert column(spark, LINES, predicates.is_translatable) == [True, True, True, False, False, True, True, False, False, False, False, False, False, False]
    pure = lambda c: predicates.is_translatable(c, skip_pure_han=True)
    assert column(spark, LINES[:3], pure) == [True, False, False]


def test_document_units(spark):
    assert column(spark, ["http://a.b", "a   b", "你好世界", "12"], predicates.is_translatable_doc) == [True, True, False, False]
    assert column(spark, ["你好世界"], lambda c: predicates.is_translatable_doc(c, "en")) == [True]


def test_noise(spark):
    assert column(spark, ["42", "1.2", "...", "a", "", None, "１２"], predicates.is_pdf_noise) == [True, False, True, False, True, True, True]
    assert column(spark, ["42 ", "a", "-"], predicates.is_image_junk) == [True, False, True]


@pytest.mark.parametrize(("o", "r", "ok"), [("Hello", "你好", True), ("Hello", "", False), ("Hello", "  ", False), ("Hello", "hello", False), ("OK", "ok", True), ("123", "123", True), ("Hello", "MYMEMORY WARNING: quota", False), ("Hello", None, False)])
def test_validation(spark, o, r, ok):
    df = spark.createDataFrame([(o, r)], "o string, r string")
    assert df.select(predicates.validate(F.col("o"), F.col("r")).ok).first()[0] is ok


@pytest.mark.parametrize(
    ("data", "want"),
    [(b"abc", "utf-8"), ("é".encode(), "utf-8"), (b"\xef\xbb\xbfa", "utf-8"), (b"\xff\xfea\0", "utf-16le"), (b"\xfe\xff\0a", "utf-16be"), ("日本語テスト".encode("shift_jis"), "shift_jis"), ("中文的测试".encode("gbk"), "gbk"), (b"\xff\xff\xff", "utf-8"), (b"", "utf-8"), (None, "utf-8")],
)
def test_encodings(data, want):
    assert charset.detect_bytes(data) == want


def test_reading_and_writing_bytes(spark):
    df = spark.createDataFrame([("中文的测试".encode("gbk"),), ("a".encode("utf-16"),)], "content binary")
    got = [r[0] for r in df.select(charset.read_text("content")).collect()]
    assert [(g.text, g.encoding) for g in got] == [("中文的测试", "gbk"), ("a", "utf-16le")]
    out = spark.createDataFrame([("한", "shift_jis"), ("a", "utf-16be")], "t string, e string").select(charset.write_text("t", "e")).collect()
    assert bytes(out[0][0].content) == "한".encode() and "shift_jis" in out[0][0].warning
    assert bytes(out[1][0].content) == b"\xfe\xff\0a"

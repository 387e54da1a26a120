"""Rebuilding, memory, archives, documents and programs on small inputs."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossloom.functions import fit
from glossloom.operators import extract, fingerprint, html, layout, memory, profile, render
from glossloom.plans.document_queries import small_program
from glossloom.plans.documents import document_units
from glossloom.sources import files as file_source
from glossloom.sources import office, programs, xp3


def units_of(spark, fmt, text, translations):
    f = spark.createDataFrame([("f", text)], "file string, text string")
    u = extract.extract(f, fmt)
    t = F.create_map(*[F.lit(x) for kv in translations.items() for x in kv])
    return f, u.withColumn("translated", F.coalesce(F.try_element_at(t, F.col("original")), F.lit("")))


@pytest.mark.parametrize(
    ("fmt", "text", "translations", "translated", "bilingual"),
    [
        ("json", '"a": "Hello"', {"Hello": 'X"Y'}, '"a": "X\\"Y"', '"a": "Hello（X\\"Y）"'),
        ("rpy", 'e "Hi you"', {"Hi you": "你"}, 'e "你"', 'e "Hi you（你）"'),
        ("ini", "k = v w", {"v w": "Z"}, "k=Z", "k=v w（Z）"),
        ("srt", "Hi", {"Hi": "你"}, "你", "你\nHi"),
        ("rpy", 'm "A b" "A b"', {"A b": "甲"}, 'm "甲" "甲"', 'm "A b（甲）" "A b（甲）"'),
        ("plain", "one\r\n  two\r\n", {"two": "$1"}, "one\r\n  $1\r\n", "one（one）\r\n  two（$1）\r\n"),
        ("yaml", "t: 'New $5'", {"New $5": "$&"}, "t: '$&'", "t: 'New $5（$&）'"),
        ("ks", "「こんにちは」", {"こんにちは": "hi"}, "「hi」", "「こんにちは（hi）」"),
        ("ass", "Dialogue: 0,1,2,D,,0,0,0,,{\\i1}Hello, {\\b1}you", {"Hello, you": "T"}, "Dialogue: 0,1,2,D,,0,0,0,,{\\i1}{\\b1}T", "Dialogue: 0,1,2,D,,0,0,0,,{\\i1}{\\b1}T\nDialogue: 0,1,2,D,,0,0,0,,{\\i1}Hello, {\\b1}you"),
    ],
)
def test_rebuild(spark, fmt, text, translations, translated, bilingual):
    f, u = units_of(spark, fmt, text, translations)
    assert render.rebuild(f, u, "translated").first().text == translated
    assert render.rebuild(f, u, "bilingual").first().text == bilingual


def test_rebuild_without_translations_keeps_files(spark):
    from glossloom.plans.queries import FIXTURES

    for fmt in ("json", "srt", "rpy", "ks", "plain"):
        text = "\n".join(FIXTURES.get(fmt, ["a b", "", " c "]))
        f, u = units_of(spark, fmt, text, {"-": "-"})
        assert render.rebuild(f, u, "original").first().text == text


def test_extract_files_routes_by_extension(spark):
    f = spark.createDataFrame([("a.txt", "Hello\n12", "utf-8"), ("b.csv", "Hello", "utf-8"), ("c.xml", "<a>Hello</a>", "utf-8"), ("d.INI", "k=Some text", "gbk"), ("e.txt", "勇者", "gbk"), ("g.txt", "勇者", "shift_jis")], "file string, text string, encoding string")
    got = {(r.file, r.original) for r in extract.extract_files(f).collect()}
    assert got == {("a.txt", "Hello"), ("d.INI", "Some text"), ("g.txt", "勇者")}


def test_doc_views(spark):
    f = spark.createDataFrame([("d", "One line\n\n42\nTwo  ")], "file string, text string")
    u = extract.doc_plain_units(f).withColumn("translated", F.when(F.col("seq") == 0, "Eins").otherwise(""))
    assert [(r.seq, r.line_index, r.original) for r in u.orderBy("seq").collect()] == [(0, 0, "One line"), (1, 3, "Two")]
    assert render.doc_text(u, "translated").first().text == "Eins\nTwo"
    assert render.rebuild_plain(f, u, "bilingual").first().text == "One line（Eins）\n\n42\nTwo（）"


def test_exports(spark):
    p = spark.createDataFrame([("d", 0, "T", True), ("d", 1, "Body", False)], "doc_id string, seq int, original string, title boolean")
    t = spark.createDataFrame([("d", 1, "Text"), ("d", 0, "")], "doc_id string, seq int, translated string")
    assert render.export_translated(p, t, "txt").first().text == "T\nText\n"
    assert render.export_translated(p, t, "md").first().text == "# 译文文档\n\n## T\n\nText\n"
    b = spark.createDataFrame([("i.png", 0, "Hi", "Salut"), ("i.png", 1, "42", "")], "image string, ord int, text string, translated string")
    assert render.image_text(b, "bilingual", True).first().text == "# 图片文字识别与翻译（i.png）\n\n- **原文**：Hi\n- **译文**：Salut\n"


def test_html_round_trip(spark):
    page = '<html><head><title>No</title></head><body><p>One &amp; two</p><script>var a = "<p>no</p>";</script><!-- no --><b> 42 </b> Three </body></html>'
    p = spark.createDataFrame([("p", page)], "file string, html string")
    u = html.html_units(p)
    assert [(r.seq, r.original) for r in u.orderBy("seq").collect()] == [(0, "One & two"), (1, "Three")]
    t = u.withColumn("translated", F.when(F.col("seq") == 1, "<Drei>").otherwise(F.col("original")))
    assert html.rebuild_html(p, t).first().html == page.replace("Three", "&lt;Drei&gt;")


def kept(spark):
    """Stores a DataFrame's rows on the driver: enough for these few."""
    return lambda df: spark.createDataFrame(df.collect(), df.schema)


def test_memory_run_and_rerun(spark):
    u = spark.createDataFrame([("Hello", "", ""), ("Hello", "", ""), ("World", "Monde", ""), ("12 monkeys", "", "")], "original string, translated string, error string")
    out, mem = memory.translate(u, memory.empty_memory(spark), memory.PseudoProvider(), "fr", kept(spark), 7)
    assert sorted(r.translated for r in out.collect()) == ["Monde", "[fr] 12 monkeys", "[fr] Hello", "[fr] Hello"]
    assert sorted(r.original for r in mem.collect()) == ["12 monkeys", "Hello"]
    assert memory.misses(memory.pending(u), mem, "pseudo", "fr").count() == 0
    assert memory.misses(u, mem, "pseudo", "de").count() == 3


def test_provider_failures_are_errors(spark):
    class Failing:
        name = "failing"

        def translate(self, texts, target_lang):
            raise RuntimeError("429")

    t = spark.createDataFrame([("bad",)], "original string")
    got = memory.call_provider(t, Failing(), "fr", 1, 1, pause=lambda s: None).collect()
    assert [(r.t, r.error) for r in got] == [("", "429")]


def test_eviction_keeps_the_newest(spark):
    m = spark.createDataFrame([("p", "fr", str(i), "t", i // 2) for i in range(10)], memory.MEMORY)
    assert sorted(int(r.original) for r in memory.evict_oldest(m, 9, 3).collect()) == [7, 8, 9]
    assert memory.evict_oldest(m, 10, 3).count() == 10


def test_numbered_reply(spark):
    df = spark.createDataFrame([("[0] a\nnoise\n[2] c",)], "r string")
    assert df.select(memory.realign_numbered(F.col("r"), F.lit(3))).first()[0] == ["a", "", "c"]


def test_progress(spark):
    u = spark.createDataFrame([("a", "x", ""), ("a", "", "e"), ("a", "", ""), ("b", None, "")], "file string, translated string, error string")
    got = {r.file: (r.units, r.done, r.failed, r.remaining, r.progress) for r in profile.by_file(u, "file").collect()}
    assert got == {"a": (3, 1, 1, 2, 33), "b": (1, 0, 0, 1, 0)}
    f = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "file string, skipped boolean")
    assert [r.file for r in profile.files_with_units(f, u).collect()] == ["a"]


def test_boxes(spark):
    df = spark.createDataFrame([("d", "x", "y", [[0.0, 0.0, 9.0, 5.0], [2.0, 4.0, 20.0, 9.0]]), ("d", "x", "x", [[0.0, 0.0, 9.0, 9.0]]), ("d", "x", "y", [[0.0, 0.0, 1.0, 9.0]])], "doc_id string, original string, translated string, rects array<array<double>>")
    assert df.select(layout.union_rects(F.col("rects"))).first()[0] == [0.0, 0.0, 20.0, 9.0]
    assert layout.exportable(df).count() == 1
    px = spark.createDataFrame([("p", 250, 250, 250), ("p", 251, 240, 255), ("p", 0, 0, 0)], "page string, r int, g int, b int")
    assert [round(v, 3) for v in layout.color_mode(px, ["page"]).first().color] == [0.973, 0.973, 0.973]


def test_program_ranking(spark):
    p = spark.createDataFrame([("a/big.exe", 9, "X"), ("s.exe", 1, None), ("m.exe", 5, None), ("b/c.exe", 8, "Y")], "path string, size int, engine string")
    assert [r.path for r in fingerprint.rank_programs(p).collect()] == ["m.exe", "s.exe", "a/big.exe"]
    assert fingerprint.first_parsed(p).first().engine == "X"


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text(st.characters(codec="utf-16", exclude_characters="\0/\\"), min_size=1, max_size=8), st.binary(max_size=200), max_size=4), st.booleans())
def test_archive_round_trip(files, compress):
    data = xp3.pack(files, compress)
    assert {n: xp3.content_of(data, s) for n, s, _ in xp3.members(data)} == files


def test_archives_as_tables(spark):
    data = xp3.pack({"a/b.txt": b"Hello there", "c.bin": b"\0"})
    df = spark.createDataFrame([("x.xp3", data), ("bad.xp3", data[:30]), ("evil.xp3", xp3.pack({"../e.txt": b"x"}))], "path string, content binary")
    got = xp3.unpack_archives(df)
    assert {(r.archive, r.rel, r.error != "") for r in got.collect()} == {("x.xp3", "a/b.txt", False), ("x.xp3", "c.bin", False), ("bad.xp3", None, True), ("evil.xp3", None, True)}
    new = spark.createDataFrame([("x.xp3", "a/b.txt", b"Bonjour"), ("x.xp3", "n.txt", b"new")], "archive string, rel string, content binary")
    again = xp3.pack_archives(xp3.merge_members(got.filter("error = ''"), new)).first().content
    assert {n: xp3.content_of(bytes(again), s) for n, s, _ in xp3.members(bytes(again))} == {"a\\b.txt": b"Bonjour", "c.bin": b"\0", "n.txt": b"new"}


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = {
    "docx": zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:p><w:r><w:t>42</w:t></w:r></w:p></w:body></w:document>"}),
    "pptx": zipped({f"ppt/slides/slide{i}.xml": f"<a:s {A}><a:p><a:r><a:t>Slide {'one' if i == 1 else 'ten'}</a:t></a:r></a:p></a:s>" for i in (10, 1)}),
    "xlsx": zipped({"xl/sharedStrings.xml": f"<sst {S}><si><t>Shared</t><t> cell</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet {S}><is><t>Inline cell</t></is></worksheet>"}),
    "epub": zipped({"c1.xhtml": "<html><body><p>Chapter &amp; verse</p></body></html>", "s.css": "p{}"}),
}


def test_office_documents(spark):
    df = spark.createDataFrame([(f"d.{k}", k, v) for k, v in OFFICE.items()] + [("x.docx", "docx", b"no zip")], "path string, doc_type string, content binary")
    u = office.office_units(df)
    assert {(r.path, r.original) for r in u.collect()} == {("d.docx", "One text"), ("d.pptx", "Slide one"), ("d.pptx", "Slide ten"), ("d.xlsx", "Shared cell"), ("d.xlsx", "Inline cell"), ("d.epub", "Chapter & verse")}
    assert office.office_strings(df).filter("error <> ''").count() == 1
    new = u.withColumn("new", F.upper("original"))
    again = office.rebuild_office(df.filter("path <> 'x.docx'"), new).join(df.select("path", "doc_type"), "path")
    assert {r.original for r in office.office_units(again).collect()} == {"ONE TEXT", "SLIDE ONE", "SLIDE TEN", "SHARED CELL", "INLINE CELL", "CHAPTER & VERSE"}


def test_docx_export(spark):
    p = spark.createDataFrame([("d", 1, "Body & all", False), ("d", 0, "T", True)], "doc_id string, seq int, original string, title boolean")
    t = spark.createDataFrame([("d", 0, "Titre")], "doc_id string, seq int, translated string")
    data = bytes(office.export_docx(p, t, "Heading").first().content)
    assert [s for _, _, s in office.strings("docx", data)] == ["Heading", "Titre", "Body & all"]


def test_text_fits_boxes(spark):
    assert fit.fit("ab", 100, 30) == (["ab"], 16)
    lines, size = fit.fit("word " * 12, 100, 40)
    assert "".join(lines) == "word " * 12 and len(lines) <= 3 and len(lines) * size * 1.25 <= 40
    assert fit.fit("x" * 1000, 20, 10) == (["x" * 7] * 3, 5)
    assert fit.fit("宽", 4, 10) == (["…"], 8) and fit.fit("", 9, 9) == ([], 5)
    df = spark.createDataFrame([("ab", 100.0, 30.0)], "t string, w double, h double")
    assert fit.with_layout(df, "t", "w", "h").first().layout.lines == ["ab"]


def tiny_program():
    return small_program({"ProductName": "My Game", "CompanyName": "Us"}, b"UnityPlayer.dll\0" + "il2cpp".encode("utf-16-le"))


def test_programs(spark):
    df = spark.createDataFrame([("g/a.exe", tiny_program()), ("b.exe", b"MZ")], "path string, content binary")
    got = {r.path: r for r in programs.programs(df).collect()}
    assert (got["g/a.exe"].product, got["g/a.exe"].company, got["g/a.exe"].engine) == ("My Game", "Us", "Unity")
    assert got["b.exe"].error and got["b.exe"].engine is None


def test_printable_strings():
    assert programs.printable_strings(b"abcdef\0abc\0\0" + "wide text".encode("utf-16-le") + b"\0\0open end") == ["abcdef", "wide text"]


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("中文 and Hello".encode("gbk"))
    (tmp_path / "sub/empty.txt").write_bytes(b"")
    (tmp_path / "sub/x.xp3").write_bytes(xp3.pack({"t/s.txt": b"Inner line"}))
    (tmp_path / "d.docx").write_bytes(OFFICE["docx"])
    (tmp_path / "skip.bin").write_bytes(b"1")
    f = file_source.scan(spark, str(tmp_path))
    assert sorted((r.name, r.kind) for r in f.collect()) == [("a.txt", "text"), ("d.docx", "document"), ("x.xp3", "archive")]
    t = file_source.text_files(f).drop("skipped").unionByName(file_source.archive_texts(f).select("file", "text", "encoding"))
    units = extract.extract_files(t)
    assert {r.original for r in units.collect()} == {"Inner line", "中文 and Hello"}
    assert {(r.doc_type, r.original) for r in document_units(file_source.documents(f)).collect()} == {("docx", "One text"), ("plain", "中文 and Hello")}
    assert [r.name for r in file_source.listing(f).collect()] == ["x.xp3", "d.docx", "a.txt"]


def test_null_texts_stay(spark):
    f = spark.createDataFrame([("a.txt", None), ("b.txt", ""), ("c.txt", "One line\r\n\r\nx y\n")], "file string, text string")
    u = extract.extract_files(f).withColumn("translated", F.concat(F.lit("T"), "original"))
    assert {r.file: r.text for r in render.rebuild(f, u).collect()} == {"a.txt": None, "b.txt": "", "c.txt": "TOne line\r\n\r\nTx y\n"}
    plain = extract.doc_plain_units(f).withColumn("translated", F.lit("T"))
    assert {r.file: r.text for r in render.rebuild_plain(f, plain).collect()} == {"a.txt": None, "b.txt": "", "c.txt": "T\n\nT\n"}
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p> One text </p>")], "file long, html string")
    units = html.html_units(pages).withColumn("translated", F.lit("a<b"))
    assert {r.file: r.html for r in html.rebuild_html(pages, units).collect()} == {1: None, 2: "", 3: "<p> a&lt;b </p>"}
    assert render.rebuild(f.limit(0), u.limit(0)).count() == 0


def test_units_without_their_line_are_left_out(spark):
    f = spark.createDataFrame([("a", "One line")], "file string, text string")
    u = spark.createDataFrame([("a", 7, "x", "y"), ("b", 0, "x", "y")], "file string, line_index int, original string, translated string")
    assert [tuple(r) for r in render.rebuild_plain(f, u).collect()] == [("a", "One line")]


def test_box_units(spark):
    box = "array<struct<text:string,box:array<int>,translated:string,error:string>>"
    df = spark.createDataFrame([("i", [("a", [1], "", None), ("b", [2], "t", ""), ("c", [3], None, "e"), ("d", [4], None, None)]), ("j", None), ("k", [])], f"image string, boxes {box}")
    assert [tuple(r) for r in layout.box_units(df).collect()] == [("i", 0, "a", [1]), ("i", 1, "d", [4])]


def test_running_counts(spark):
    df = spark.createDataFrame([("f", i, "e" if i == 1 else None) for i in range(3)], "file string, seq int, error string")
    assert [(r.done, r.failed, r.total) for r in profile.running_counts(df, ["file"], ["seq"]).orderBy("seq").collect()] == [(1, 0, 3), (2, 1, 3), (3, 1, 3)]


def test_rows_of_text_layers_and_recognised_text(spark):
    schema = "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double, spans array<struct<text:string,size:double>>"
    at = (0.0, 1.0, 2.0, 3.0)
    lines = spark.createDataFrame([("d", 0, 0, *at, [(" One ", 9.0), ("line ", 12.5)]), ("d", 0, 1, *at, []), ("d", 0, 2, *at, None), ("d", 0, 3, *at, [("  ", 9.0), (None, 1.0)]), ("d", 0, 4, *at, [("x", None)])], schema)
    assert [(r.ord, r.text, r["size"]) for r in layout.text_layer_rows(lines).collect()] == [(0, "One line", 12.5), (4, "x", 0.0)]
    square = [[1.0, 2.0], [9.5, 2.5], [9.0, 8.0], [0.5, 7.5]]
    found = spark.createDataFrame([("d", 0, i, square, t, 0.98765) for i, t in enumerate([" Some text ", "42", "-- .", "", None, "x" * 801])], "doc_id string, page int, ord int, polygon array<array<double>>, text string, score double")
    assert [tuple(r) for r in layout.recognised_rows(found).collect()] == [("d", 0, 0, 0.5, 2.0, 9.5, 8.0, "Some text")]
    boxes = layout.image_boxes(found.withColumnRenamed("doc_id", "image").filter("length(text) < 99")).first().boxes
    assert [(list(b.box), b.text, b.score) for b in boxes] == [([0, 2, 10, 8], t, 0.988) for t in ("Some text", "42", "-- .")]

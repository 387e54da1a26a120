"""Whole runs on small folders."""

import zipfile

from pyspark.sql import functions as F

from glossloom.operators import memory
from glossloom.plans import documents as all_documents
from glossloom.plans import translate
from glossloom.sources import office, xp3
from glossloom.sources.files import documents, scan
from glossloom.streaming.translate import fill_memory, read_memory

from test_operators import OFFICE, kept


def test_folder_to_zip(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_bytes("日本語テスト、です\r\nplain".encode("shift_jis"))
    (src / "b.json").write_text('{"k": "Hello there", "n": "12"}')
    (src / "c.txt").write_text("42")
    out, units, mem = translate.translate_folder(spark, str(src), memory.empty_memory(spark), memory.PseudoProvider(), "en", keep=kept(spark))
    assert translate.write_zip(out, str(tmp_path / "o.zip")) == 2
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        got = {n.rsplit("/", 1)[-1]: z.read(n) for n in z.namelist()}
    assert got["b.json"] == b'{"k": "[en] Hello there", "n": "12"}'
    assert got["a.txt"].decode("shift_jis") == "[en] 日本語テスト、です\r\n[en] plain"
    assert units.filter("error <> ''").count() == 0 and mem.count() == 3


def test_archives(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.xp3").write_bytes(xp3.pack({"s.txt": f"Line of {n}".encode(), "x.bin": b"\0\1"}))
    out, _ = translate.translate_archives(spark, str(tmp_path), memory.empty_memory(spark), memory.PseudoProvider(), "fr", keep=kept(spark))
    got = {r.archive[-5:]: {n: xp3.content_of(bytes(r.content), s) for n, s, _ in xp3.members(bytes(r.content))} for r in out.collect()}
    assert got == {f"{n}.xp3": {"s.txt": f"[fr] Line of {n}".encode(), "x.bin": b"\0\1"} for n in "ab"}


def test_office_documents(spark, tmp_path):
    for kind, data in OFFICE.items():
        (tmp_path / f"d.{kind}").write_bytes(data)
    docs = documents(scan(spark, str(tmp_path)))
    out, _ = translate.translate_office(docs, memory.empty_memory(spark), memory.PseudoProvider(), "fr", "bilingual", kept(spark))
    again = office.office_units(out.join(docs.select("path", "doc_type"), "path"), "fr")
    assert {r.original for r in again.collect()} >= {"One text（[fr] One text）", "Chapter & verse（[fr] Chapter & verse）"}


def test_incoming_files_fill_the_memory(spark, tmp_path):
    src, mem, at = tmp_path / "in", str(tmp_path / "mem"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.txt").write_text("One line\nTwo lines")
    for _ in range(2):
        fill_memory(spark, str(src), mem, at, memory.PseudoProvider(), "fr").awaitTermination()
    (src / "b.txt").write_text("One line\nThree lines")
    fill_memory(spark, str(src), mem, at, memory.PseudoProvider(), "fr").awaitTermination()
    got = read_memory(spark, mem)
    assert sorted(r.original for r in got.collect()) == ["One line", "Three lines", "Two lines"]
    assert got.filter(F.col("t") == F.concat(F.lit("[fr] "), F.col("original"))).count() == 3


def line_reader(recognises):
    """A reader of made-up documents: each line is a row of text; a cross can't be read. Its class is made here, so that it
    reaches the workers by value."""

    class Lines:
        def __init__(self):
            self.recognises = recognises

        def rows(self, path, content):
            if content == b"x":
                raise ValueError("no text")
            return [(0, 0.0, 50.0 * i, 90.0, 50.0 * i + 12, None if self.recognises else 12.0, t) for i, t in enumerate(content.decode().split("\n"))]

    return Lines()


def test_documents_of_all_types(spark):
    rows = [("a.txt", "plain", b"One line\n42"), ("b.html", "html", b"<p>Two words</p>"), *[(f"c.{k}", k, d) for k, d in OFFICE.items()], ("d.pdf", "pdf", b"Some text\nMore text"), ("e.pdf", "pdf", b"x"), ("f.png", "image", b"Sign text"), ("g.bin", None, b"1"), ("h.docx", "docx", b"broken"), ("i.txt", "plain", None)]
    docs = spark.createDataFrame([(p, k, None if c is None else bytearray(c)) for p, k, c in rows], "path string, doc_type string, content binary")
    units = all_documents.document_units(docs, readers={"pdf": line_reader(False), "image": line_reader(True)})
    got = {}
    for r in units.collect():
        got.setdefault(r.path, []).append(r.original or r.error)
    assert got["a.txt"] == ["One line"] and got["b.html"] == ["Two words"] and "One text" in got["c.docx"]
    assert sorted(got["d.pdf"]) == ["More text", "Some text"] and got["e.pdf"] == ["ValueError: no text"] and got["f.png"] == ["Sign text"]
    assert got["g.bin"] == ["unknown document type"] and "BadZipFile" in got["h.docx"][0] and "i.txt" not in got
    assert {r.error for r in all_documents.document_units(docs.filter("path = 'd.pdf'")).collect()} == {"no reader for pdf"}
    good = docs.filter("path <> 'h.docx'")
    out = all_documents.rebuild_documents(good, all_documents.document_units(good).withColumn("translated", F.concat(F.lit("T"), "original")))
    out = {r.path: (bytes(r.content) if r.content is not None else None, r.error) for r in out.collect()}
    assert out["a.txt"] == (b"TOne line\n42", "") and out["b.html"] == (b"<p>TTwo words</p>", "") and out["i.txt"] == (b"", "")
    assert out["d.pdf"] == (None, "no writer for pdf") and out["g.bin"] == (None, "unknown document type")
    again = office.office_units(spark.createDataFrame([("c.docx", "docx", bytearray(out["c.docx"][0]))], "path string, doc_type string, content binary"))
    assert [r.original for r in again.collect()] == ["TOne text"]
    assert all_documents.document_units(docs.limit(0)).count() == 0


def test_zips_by_partition(spark, tmp_path):
    files = spark.createDataFrame([(f"file:/d/{i:03d}.txt", bytearray(b"text %d" % i)) for i in range(50)], "file string, content binary")
    for _ in range(2):
        done = translate.write_zips(files, str(tmp_path / "out"), 3).collect()
        names = [n for r in sorted(done) for n in zipfile.ZipFile(r.path).namelist()]
        assert names == [f"d/{i:03d}.txt" for i in range(50)] and sum(r.files for r in done) == 50
    assert len(list((tmp_path / "out").iterdir())) == len(done)
    assert zipfile.ZipFile(sorted(done)[0].path).read("d/000.txt") == b"text 0"
    assert translate.write_zips(files.limit(0), str(tmp_path / "none")).count() == 0

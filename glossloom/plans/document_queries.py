"""Queries over documents of all types, image boxes, running counts, rebuilt lines and programs, with their SQL.

The answers for literal rows are typed in: they state what each format's rule gives, and share no pattern with the operators.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.functions.predicates import is_image_junk, is_pdf_noise, is_translatable, is_translatable_doc
from glossloom.operators import extract, layout, profile, render
from glossloom.operators.html import TOKEN
from glossloom.plans import documents
from glossloom.plans.queries import DOC_PLAIN_UNITS, FIXTURES, HTML_TEXT_UNITS, fixture, lines_sql, long_ints, q, s_doc_unit, s_entities, s_trim
from glossloom.session import spread, table
from glossloom.sources import programs


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, doc_type, content: all documents as plain texts, all pages, and the benchmark as a type without a reader."""
    part = lambda name, key, ext, kind, text: spread(table(spark, sf_dir, name).select(F.concat(F.col(key).cast("string"), F.lit(ext)).alias("path"), F.lit(kind).alias("doc_type"), F.encode(text, "UTF-8").alias("content")))
    got = part("documents", "doc_id", ".txt", "plain", "text").unionByName(part("pages", "page_id", ".html", "html", "html"))
    return got.unionByName(part("benchmark", "item_id", ".pdf", "pdf", "text"))


def document_dispatch_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_units(mixed_documents(spark, sf_dir))


DOCUMENT_DISPATCH_UNITS = f"""
SELECT file || '.txt' AS path, 'plain' AS doc_type, CAST(NULL AS VARCHAR) AS container, line_index AS place, seq, original, '' AS error FROM ({DOC_PLAIN_UNITS})
UNION ALL SELECT page_id || '.html', 'html', NULL, node, seq, original, '' FROM ({HTML_TEXT_UNITS})
UNION ALL SELECT item_id || '.pdf', 'pdf', NULL, NULL, NULL, NULL, 'no reader for pdf' FROM benchmark
"""


def document_dispatch_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with each unit shown with its number, by the digest of what comes out."""
    docs = mixed_documents(spark, sf_dir)
    units = documents.document_units(docs).withColumn("translated", F.concat(F.lit("<&"), F.col("seq").cast("string")))
    return documents.rebuild_documents(docs, units, "bilingual").select("path", F.sha2("content", 256).alias("sha"), "error")


DOCUMENT_DISPATCH_REBUILD = f"""
WITH l AS ({lines_sql('documents', 'doc_id', 'text')}),
u AS (SELECT *, {s_doc_unit('line')} AS unit FROM l),
s AS (SELECT *, sum(CASE WHEN unit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_index) - 1 AS seq FROM u),
d AS (SELECT doc_id, string_agg(CASE WHEN unit THEN {s_trim('line')} || '（<&' || seq || '）' ELSE line END, chr(10) ORDER BY line_index) AS text FROM s GROUP BY doc_id),
t AS (SELECT page_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, {q(TOKEN)}) AS ts FROM pages)),
b AS (SELECT page_id, min(i) AS body FROM t WHERE regexp_matches(ts[i], '(?i)^<body\\b') GROUP BY page_id),
k AS (SELECT page_id, i, ts[i] AS tok, i >= coalesce(body, 0) AND NOT starts_with(ts[i], '<') AND {s_doc_unit(s_entities('ts[i]'))} AS unit FROM t LEFT JOIN b USING (page_id)),
n AS (SELECT *, sum(CASE WHEN unit THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) - 1 AS seq FROM k),
p AS (SELECT page_id, string_agg(CASE WHEN unit THEN regexp_extract(tok, '^[ \\t\\n\\x0B\\f\\r]*') || replace(replace(replace({s_trim(s_entities('tok'))}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '（&lt;&amp;' || seq || '）' || regexp_extract(tok, '[ \\t\\n\\x0B\\f\\r]*\\z') ELSE tok END, '' ORDER BY i) AS html FROM n GROUP BY page_id)
SELECT doc_id || '.txt' AS path, sha256(text) AS sha, '' AS error FROM d
UNION ALL SELECT page_id || '.html', sha256(html), '' FROM p
UNION ALL SELECT item_id || '.pdf', NULL, 'no writer for pdf' FROM benchmark
"""


def image_box_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as images, their turns as boxes: every third has a translation, every fifth an error."""
    box = F.struct("turn", "text", F.array(F.lit(0), "turn", F.lit(9), F.col("turn") + 1).alias("box"), F.when(F.col("turn") % 3 == 0, "done").otherwise("").alias("translated"), F.when(F.col("turn") % 5 == 0, "failed").alias("error"))
    images = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return long_ints(layout.box_units(images, "conv_id").select("conv_id", "seq", "original", F.element_at("box", 2).alias("y0")))


IMAGE_BOX_UNITS = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS seq, text AS original, turn AS y0 FROM conversations WHERE turn % 3 <> 0 AND turn % 5 <> 0
"""


def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as units of their conversation, the users' as failed ones."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "failed").alias("error"))
    return long_ints(profile.running_counts(turns, ["conv_id"], ["turn"]).drop("error"))


RUNNING_PROGRESS = """
SELECT conv_id, turn, count(*) OVER w AS done, count(*) FILTER (WHERE role = 'user') OVER w AS failed, count(*) OVER (PARTITION BY conv_id) AS total
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
"""

# What FIXTURES become when each unit is translated to itself with a T before it.
REBUILT = {
    "json": ['"a": "THello", "b": "12"', '["Hello"]', '"k": "Tsay \\"hi\\"", "k2": "Tsay \\"hi\\""', '"u": "Tcafé bar"', '"z" : "你好世界"', '"e": ""'],
    "ini": ["title=TNew Game", "; c = x", "n=42", "[part] = z", "=novalue", "a=Tb = c", "  spaced=Tvalue here"],
    "srt": ["12", "00:00:01,000 --> 00:00:02,000", "TGood morning", "", "  TTwo words  "],
    "ass": ["Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\i1}{\\i0}THello, you", "Comment: 0,a,b,c,d,e,f,g,h,Hi", "Dialogue: 0,a,b", "Dialogue: 0,1,2,D,,0,0,0,,{\\b1}"],
    "yaml": ['title: "TNew Game"', "title: New Game", '# t: "New Game"', "a: 'Tit is'", 'k: ""'],
    "rpy": ['    e "TGood morning, {name}."', "label start:", '    e happy "hello"', '    m "TA b" "TC d"', '# "No no"', '    m "TA b" "TA b"', "    「T一 二」", '$ x = "No no"', 'e "{w=1 b}"'],
    "ks": ["[name]「Tこんにちは」", '@bg file="x y"', "He said 'Tgo on' now", "*label", ';"No no"', '"TA b" and "TA b"', "『Tこん にちは』"],
}


def line_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal files of all formats with their units put back."""
    files = None
    for fmt in FIXTURES:
        files = fixture(spark, fmt) if files is None else files.unionByName(fixture(spark, fmt))
    units = extract.extract_files(files).withColumn("translated", F.concat(F.lit("T"), "original"))
    return render.rebuild(files, units)


def line_rebuilds_sql() -> str:
    rows = ", ".join(f"({q(f'f.{fmt}')}, {' || chr(10) || '.join(q(x) for x in lines)})" for fmt, lines in REBUILT.items())
    return f"SELECT * FROM (VALUES {rows}) v(file, text)"


# What the rules say of each line: a unit of a text file, one where lines of Han only are skipped, a unit of a document, noise in a
# pdf file, junk in an image.
CASES = [
    ("Hello", True, True, True, False, False),
    ("勇者", True, False, True, False, False),
    ("回復薬", True, False, True, False, False),
    ("你好世界", False, False, False, False, False),
    ("这是", False, False, False, False, False),
    ("こんにちは、", True, True, True, False, False),
    ("한국어", True, True, True, False, False),
    ("12:30", False, False, False, False, True),
    ("http://a.b", False, False, True, False, False),
    ("/usr/bin", False, False, True, False, False),
    ("a   b", False, False, True, False, False),
    ("42", False, False, False, True, True),
    ("...", False, False, False, True, True),
    ("", False, False, False, True, True),
    ("x" * 801, False, False, False, True, False),
]


def line_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(c[0],) for c in CASES], "line string")
    c = F.col("line")
    return d.select("line", is_translatable(c).alias("unit"), is_translatable(c, skip_pure_han=True).alias("no_han"), is_translatable_doc(c).alias("doc"), is_pdf_noise(c).alias("noise"), is_image_junk(c).alias("junk"))


LINE_CASES = f"SELECT * FROM (VALUES {', '.join(f'({q(c[0])}, {str(c[1:])[1:-1]})' for c in CASES)}) v(line, unit, no_han, doc, noise, junk)"


def version_node(key: str, value: str, children: bytes = b"") -> bytes:
    """A node of a version block: sizes, key, padding, value, children."""
    raw = key.encode("utf-16-le") + b"\0\0"
    raw += b"\0" * (-(6 + len(raw)) % 4)
    body = value.encode("utf-16-le") + b"\0\0" if value else b""
    body += b"\0" * (-len(body) % 4)
    size = 6 + len(raw) + len(body) + len(children)
    return struct.pack("<HHH", size, len(value) + 1 if body else 0, 1) + raw + body + children


def small_program(values: dict[str, str], strings: bytes) -> bytes:
    """A program of one section with a version resource, and strings after it."""
    table = version_node("040904b0", "", b"".join(version_node(k, v) for k, v in values.items()))
    block = version_node("VS_VERSION_INFO", "", version_node("StringFileInfo", "", table))
    level = struct.pack("<IIHHHH", 0, 0, 0, 0, 0, 1)
    rsrc = level + struct.pack("<II", 16, 0x80000018) + level + struct.pack("<II", 1, 0x80000030) + level + struct.pack("<II", 1033, 0x48)
    rsrc += struct.pack("<IIII", 0x1000 + 0x58, len(block), 0, 0) + block
    optional = struct.pack("<H", 0x10B) + b"\0" * 110 + struct.pack("<II", 0x1000, len(rsrc)) + b"\0" * 104
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 0) + optional
    section = b".rsrc\0\0\0" + struct.pack("<IIII", len(rsrc), 0x1000, len(rsrc), len(head) + 40) + b"\0" * 16
    return head + section + rsrc + b"\0" + strings + b"\0\0\0"


def program_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = small_program({"ProductName": "My Game", "CompanyName": "Us", "FileVersion": "1.2", "FileDescription": "A game"}, b"UnityPlayer.dll\0" + "il2cpp".encode("utf-16-le"))
    d = spark.createDataFrame([("g/a.exe", bytearray(made)), ("g/b.exe", bytearray(b"MZ")), ("c.exe", bytearray(made[:200]))], "path string, content binary")
    return programs.programs(d).select("path", "name", "product", "company", "version", "description", "engine", (F.col("error") != "").alias("broken"))


PROGRAM_VERSIONS = """
SELECT * FROM (VALUES ('g/a.exe', 'a.exe', 'My Game', 'Us', '1.2', 'A game', 'Unity', false), ('g/b.exe', 'b.exe', '', '', '', '', NULL, true), ('c.exe', 'c.exe', '', '', '', '', NULL, true)) v(path, name, product, company, version, description, engine, broken)
"""


def queries() -> dict:
    return {f.__name__: f for f in (document_dispatch_units, document_dispatch_rebuild, image_box_units, running_progress, line_rebuilds, line_cases, program_versions)}


def oracle_sql() -> dict[str, str]:
    out = {n: globals()[n.upper()] for n in queries() if n != "line_rebuilds"}
    return out | {"line_rebuilds": line_rebuilds_sql()}

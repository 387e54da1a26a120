"""Queries of single steps: what waits, exports, gathered values, colours, byte formats, archives; with their SQL.

Answers for literal rows are typed in and state what the rules give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.functions import charset, fit
from glossloom.functions import text as T
from glossloom.operators import extract, fingerprint, layout, memory, profile, render
from glossloom.plans.queries import TURN_LINES, long_ints, q, turn_lines
from glossloom.session import spread, table
from glossloom.sources import files as source
from glossloom.sources import xp3


def image_pending_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as boxes: every third has a translation, every fifth an error."""
    boxes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "t").alias("translated"), F.when(F.col("turn") % 5 == 0, "e").otherwise("").alias("error"))
    return memory.image_pending(boxes).select("conv_id", "turn")


IMAGE_PENDING_BOXES = "SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0 AND turn % 5 <> 0"


def kinds_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different sources of each language's documents, and whether any of them counts as done."""
    units = table(spark, sf_dir, "documents").select("lang", "source", F.when(F.col("doc_id") == 7, "t").otherwise("").alias("translated"))
    return profile.kinds_present(units, "lang", "source").withColumn("kinds", F.array_join("kinds", "|"))


KINDS_BY_LANGUAGE = "SELECT lang, string_agg(DISTINCT source, '|' ORDER BY source) AS kinds, bool_or(doc_id = 7) AS any_done FROM documents GROUP BY lang"


def overlay_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as paragraphs on one of two pages, joined to the pages."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 2).alias("page"), "turn")
    pages = turns.select("doc_id", "page").distinct().filter("page = 0").withColumn("width", F.col("doc_id") * 2)
    return fingerprint.overlay_box(turns, pages)


OVERLAY_PAGES = "SELECT conv_id AS doc_id, turn % 2 AS page, turn, conv_id * 2 AS width FROM conversations WHERE turn % 2 = 0"


def page_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pixels of their type: the most frequent colour of 16 steps a channel."""
    e = table(spark, sf_dir, "events").select("event_type", *[((F.col("event_id") * k) % 256).cast("int").alias(c) for c, k in (("r", 37), ("g", 101), ("b", 11))])
    return layout.color_mode(e, ["event_type"]).select("event_type", *[F.col("color")[i].alias(c) for i, c in enumerate("rgb")])


PAGE_COLORS = """
WITH p AS (SELECT event_type, (event_id * 37 % 256) // 16 AS r, (event_id * 101 % 256) // 16 AS g, (event_id * 11 % 256) // 16 AS b FROM events),
c AS (SELECT event_type, r, g, b, count(*) AS n FROM p GROUP BY ALL),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, r, g, b) = 1)
SELECT event_type, (r * 16 + 8) / 255.0::DOUBLE AS r, (g * 16 + 8) / 255.0::DOUBLE AS g, (b * 16 + 8) / 255.0::DOUBLE AS b FROM f
"""


def tm_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory after a run over the turns."""
    units = turn_lines(spark, sf_dir).select("original", F.lit("").alias("translated"), F.lit("").alias("error"))
    _, mem = memory.translate(units, memory.empty_memory(spark), memory.PseudoProvider(), "fr", lambda df: df, 5)
    return mem


TM_WRITE = f"SELECT DISTINCT 'pseudo' AS provider, 'fr' AS target_lang, original, '[fr] ' || original AS t, CAST(5 AS BIGINT) AS ts FROM ({TURN_LINES})"


def gathered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.gather(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "roles").withColumn("roles", F.array_join("roles", ","))


GATHERED_TURNS = "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id"


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents in both formats: first turns as titles, every other turn translated."""
    turns = table(spark, sf_dir, "conversations")
    paragraphs = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("text").alias("original"), (F.col("turn") == 0).alias("title"))
    translations = turns.filter("turn % 2 = 0").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.concat(F.lit("T:"), "text").alias("translated"))
    md, txt = (render.export_translated(paragraphs, translations, fmt).withColumn("fmt", F.lit(fmt)) for fmt in ("md", "txt"))
    return md.unionByName(txt)


EXPORTS = """
WITH p AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 2 = 0 THEN 'T:' || text ELSE text END AS t FROM conversations)
SELECT doc_id, '# 译文文档' || chr(10) || chr(10) || string_agg(CASE WHEN turn = 0 THEN '## ' ELSE '' END || t, chr(10) || chr(10) ORDER BY turn) || chr(10) AS text, 'md' AS fmt FROM p GROUP BY doc_id
UNION ALL SELECT doc_id, string_agg(t, chr(10) ORDER BY turn) || chr(10), 'txt' FROM p GROUP BY doc_id
"""


def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as images, their turns as boxes, in both languages and both formats."""
    boxes = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("image"), F.col("turn").alias("ord"), "text", F.concat(F.lit("T:"), "role").alias("translated"))
    md, plain = (render.image_text(boxes, "bilingual", md).withColumn("md", F.lit(md)) for md in (True, False))
    return md.unionByName(plain)


IMAGE_TEXTS = """
SELECT CAST(conv_id AS VARCHAR) AS image, '# 图片文字识别与翻译（' || conv_id || '）' || chr(10) || chr(10) || string_agg('- **原文**：' || text || chr(10) || '- **译文**：T:' || role, chr(10) || chr(10) ORDER BY turn) || chr(10) AS text, true AS md FROM conversations GROUP BY conv_id
UNION ALL SELECT CAST(conv_id AS VARCHAR), '图片文字识别与翻译（' || conv_id || '）' || chr(10) || repeat('=', 20) || chr(10) || string_agg(text || chr(10) || 'T:' || role, chr(10) || chr(10) ORDER BY turn) || chr(10), false FROM conversations GROUP BY conv_id
"""


def encoding_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as bytes of three encodings, read back. UTF-16 has its mark, so both are detected."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("encoding", F.element_at(F.array(*[F.lit(e) for e in ("utf-8", "utf-16le", "utf-16be")]), (F.col("doc_id") % 3 + 1).cast("int")))
    out = docs.select("doc_id", charset.write_text("text", "encoding")["content"].alias("content"))
    return out.select("doc_id", charset.read_text("content").alias("r")).select("doc_id", F.col("r.encoding").alias("encoding"), F.sha2("r.text", 256).alias("sha"))


ENCODING_ROUNDTRIP = "SELECT doc_id, ['utf-8', 'utf-16le', 'utf-16be'][doc_id % 3 + 1] AS encoding, sha256(text) AS sha FROM documents"

REPLIES = [(1, "[0] a\n[1] b c\n[2]  d ", 3), (2, "Sure!\n [1] x\n[0] y", 3), (3, "", 2), (4, "[0]\n[1] z", 2)]


def realigned_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(REPLIES, "id int, reply string, n int")
    return long_ints(d.select("id", F.array_join(memory.realign_numbered(F.col("reply"), F.col("n")), "|").alias("texts")))


REALIGNED_REPLIES = "SELECT * FROM (VALUES (1::BIGINT, 'a|b c|d '), (2, 'y|x|'), (3, '|'), (4, '|z')) v(id, texts)"

PROGRAM_PATHS = [("g/big.exe", 900, "Unity"), ("a.exe", 10, None), ("b.exe", 50, "Godot"), ("c.exe", 50, None), ("g/x.exe", 5, "Unity")]


def ranked_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most likely programs, and of these the first with an engine."""
    d = spark.createDataFrame(PROGRAM_PATHS, "path string, size long, engine string")
    first = fingerprint.first_parsed(d).select(F.col("path").alias("first"))
    return fingerprint.rank_programs(d).join(first, F.col("path") == F.col("first"), "left").select("path", "size", F.col("first").isNotNull().alias("chosen"))


RANKED_PROGRAMS = "SELECT * FROM (VALUES ('b.exe', 50::BIGINT, true), ('c.exe', 50, false), ('a.exe', 10, false)) v(path, size, chosen)"

NAMES = [("a.docx", "docx", None), ("b.HTM", "html", None), ("c.txt", "plain", "plain"), ("d.md", "plain", "plain"), ("e.pdf", "pdf", None), ("f.rpy", None, "rpy"), ("g.ssa", None, "ass"), ("h.tsv", None, "csv"), ("i", None, None), ("j.exe", None, None), ("k.yml", None, "yaml")]


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document type and extractor by extension; a file of values without an extractor of its own has no units."""
    d = spark.createDataFrame([(n,) for n, _, _ in NAMES], "name string")
    units = extract.extract_files(d.select(F.col("name").alias("file"), F.lit("Some words, some more").alias("text"))).groupBy("file").agg(F.count("*").alias("units"))
    got = d.join(units, F.col("name") == F.col("file"), "left")
    return got.select("name", extract.doc_type_of(F.col("name")).alias("doc_type"), extract.format_of(F.col("name")).alias("extractor"), F.coalesce("units", F.lit(0)).cast("long").alias("units"))


FILE_TYPES = "SELECT name, doc_type, extractor, CAST(CASE WHEN extractor = 'plain' THEN 1 ELSE 0 END AS BIGINT) AS units FROM (VALUES " + ", ".join(f"({q(n)}, {q(d) if d else 'NULL'}, {q(e) if e else 'NULL'})" for n, d, e in NAMES) + ") v(name, doc_type, extractor)"


def archive_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark in archives of text files: read as text files, every seventh replaced, packed again and read once more."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("a"), F.col("item_id") % 3, F.lit(".xp3")).alias("archive"), F.concat(F.lit("t/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("rel"), F.encode("text", "UTF-8").alias("content"), "item_id")
    packed = lambda df: xp3.pack_archives(df.select("archive", "rel", "content")).select(F.col("archive").alias("path"), "content", F.lit("archive").alias("kind"))
    before = packed(items)
    new = source.archive_texts(before).filter(F.regexp_extract("rel", "([0-9]+)", 1).cast("int") % 7 == 0).select("archive", "rel", F.encode(F.concat(F.lit("T:"), "text"), "UTF-8").alias("content"))
    after = packed(xp3.merge_members(xp3.unpack_archives(before), new))
    return source.archive_texts(after).select("archive", "rel", "file", F.sha2("text", 256).alias("sha"))


ARCHIVE_EXPORT = "SELECT 'a' || (item_id % 3) || '.xp3' AS archive, 't/' || item_id || '.txt' AS rel, '【xp3】t/' || item_id || '.txt' AS file, sha256(CASE WHEN item_id % 7 = 0 THEN 'T:' || text ELSE text END) AS sha FROM benchmark"

COLOURS = [(1, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0), (2, 0.2, 0.1, 0.1, 0.2, 0.1, 0.2), (3, 0.5, 0.6, 0.5, 0.5, 0.6, 0.9)]


def colour_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance, the text colour on a background, and which of a page's and a box's colour counts."""
    d = spark.createDataFrame(COLOURS, "id int, r double, g double, b double, x double, y double, z double")
    page, inner = F.array("r", "g", "b"), F.array("x", "y", "z")
    c = T.contrast_color(F.col("r"), F.col("g"), F.col("b"))
    return long_ints(d.select("id", F.round(T.luminance(F.col("r"), F.col("g"), F.col("b")), 6).alias("luminance"), c[0].alias("ink"), (T.pick_background(inner, page) == page).alias("page"), T.px_to_pt(F.lit(150.0)).alias("points")))


COLOUR_CASES = "SELECT * FROM (VALUES (1::BIGINT, 1.0::DOUBLE, 0.05::DOUBLE, false, 72.0::DOUBLE), (2, 0.1299, 1.0, true, 72.0), (3, 0.5587, 0.05, true, 72.0)) v(id, luminance, ink, page, points)"

BOXES = [("ab", 100.0, 30.0), ("x" * 1000, 20.0, 10.0), ("宽", 4.0, 10.0), ("", 9.0, 9.0)]


def fitted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and size of texts in boxes."""
    d = spark.createDataFrame(BOXES, "t string, w double, h double")
    got = fit.with_layout(d, "t", "w", "h")
    return got.select(F.length("t").cast("long").alias("chars"), F.array_join("layout.lines", "|").alias("lines"), F.col("layout.size").cast("double").alias("size"))


FITTED_TEXTS = "SELECT * FROM (VALUES (2::BIGINT, 'ab', 16.0::DOUBLE), (1000, 'xxxxxxx|xxxxxxx|xxxxxxx', 5.0), (1, '…', 8.0), (0, '', 5.0)) v(chars, lines, size)"


NAMES_OF_STEPS = ("image_pending_boxes", "kinds_by_language", "overlay_pages", "page_colors", "tm_write", "gathered_turns", "exports", "image_texts", "encoding_roundtrip", "realigned_replies", "ranked_programs", "file_types", "archive_export", "colour_cases", "fitted_texts")


def queries() -> dict:
    return {n: globals()[n] for n in NAMES_OF_STEPS}


def oracle_sql() -> dict[str, str]:
    return {n: globals()[n.upper()] for n in NAMES_OF_STEPS}

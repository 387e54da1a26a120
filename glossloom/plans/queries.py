"""Queries over the driver's tables and over literal rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossloom.functions import text as T
from glossloom.functions.predicates import BAD_RESULT, CHINESE_MARKS, CHINESE_WORDS, JUNK, PDF_NOISE, URL, is_pdf_noise, is_translatable, is_translatable_doc, rejection, validate
from glossloom.operators import extract as X
from glossloom.operators import fingerprint, layout, memory, profile, render
from glossloom.operators.html import ENTITIES, TOKEN, html_units
from glossloom.session import spread, table


def q(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def epoch_micros(ts: Column) -> Column:
    """Of a timestamp without zone, whatever the session's zone is."""
    seconds = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


# ---- the predicates again, in SQL


def s_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q('^' + T.WS + '+')}, ''), {q(T.WS + '+' + chr(92) + 'z')}, '')"


def s_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def s_chinese(t: str) -> str:
    return f"(CASE WHEN {s_count(t, T.HAN)} = 0 THEN false WHEN regexp_matches({t}, {q(T.KANA)}) THEN false WHEN regexp_matches({t}, {q(CHINESE_MARKS)}) OR regexp_matches({t}, {q(CHINESE_WORDS)}) THEN true ELSE {s_count(t, T.HAN)} >= 4 END)"


def s_rejection(x: str, skip: bool = False) -> str:
    t = s_trim(x)
    pure = f"({s_count(t, T.HAN)} > 0 AND {s_count(t, T.KANA_HANGUL)} = 0 AND {s_count(t, T.HAN)} / greatest(length({t}), 1) > 0.3)" if skip else "false"
    return f"(CASE WHEN {t} = '' THEN 'empty' WHEN length({t}) > 800 THEN 'long' WHEN regexp_matches({t}, {q(URL)}) THEN 'url' WHEN regexp_matches({t}, {q(JUNK)}) THEN 'junk' WHEN regexp_matches({t}, {q(T.WS + '{3}')}) THEN 'spaces' WHEN {s_chinese(t)} OR {pure} THEN 'target' END)"


def s_doc_unit(x: str) -> str:
    t = s_trim(x)
    return f"({t} <> '' AND length({t}) <= 800 AND NOT regexp_matches({t}, {q(JUNK)}) AND NOT {s_chinese(t)})"


def s_decode(x: str) -> str:
    part = "CASE WHEN regexp_matches(p, '^\\\\u[0-9a-fA-F]{4}$') THEN chr(CAST('0x' || p[3:] AS INTEGER)) ELSE p END"
    joined = f"array_to_string(list_transform(regexp_extract_all({x}, '\\\\u[0-9a-fA-F]{{4}}|[\\s\\S]'), lambda p: {part}), '')"
    return f"replace(replace(replace({joined}, '\\\"', '\"'), '\\''', ''''), '\\\\', '\\')"


def lines_sql(tab: str, key: str, text: str) -> str:
    return f"SELECT {key}, i - 1 AS line_index, ls[i] AS line FROM (SELECT {key}, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT {key}, regexp_split_to_array({text}, '\\r?\\n') AS ls FROM {tab}))"


def long_ints(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if k in ("int", "smallint", "tinyint") else F.col(c) for c, k in df.dtypes])


# ---- units of documents


def doc_units_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the lines of all documents that need a translation, by language."""
    files = spread(table(spark, sf_dir, "documents").select("lang", "text"))
    units = X.trimmed_lines(files, "lang").filter(is_translatable(F.col("original"), trimmed=True))
    return units.groupBy("lang").agg(F.count("*").alias("units"), F.countDistinct("original").alias("distinct_units"), F.sum(F.length("original")).cast("long").alias("chars"))


DOC_UNITS_BY_LANG = f"""
WITH l AS ({lines_sql('documents', 'lang', 'text')})
SELECT lang, count(*) AS units, count(DISTINCT {s_trim('line')}) AS distinct_units, CAST(sum(length({s_trim('line')})) AS BIGINT) AS chars
FROM l WHERE {s_rejection('line')} IS NULL GROUP BY lang
"""


def doc_plain_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text"))
    return long_ints(X.doc_plain_units(files).select("file", "seq", "line_index", "original"))


DOC_PLAIN_UNITS = f"""
WITH l AS ({lines_sql('documents', 'doc_id', 'text')})
SELECT doc_id AS file, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) - 1 AS seq, line_index, {s_trim('line')} AS original
FROM l WHERE {s_doc_unit('line')}
"""


def unit_ids_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents, each numbered among its equals in the document."""
    docs = spread(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text"))
    words = docs.select("doc_id", F.posexplode_outer(F.split("text", " ")).alias("pos", "raw"))
    return long_ints(X.with_occurrence(words, ["doc_id", "raw"], "pos").select(F.concat_ws("|", "doc_id", "pos", "occurrence").alias("id"), "pos", "raw"))


UNIT_IDS_OCCURRENCE = """
WITH w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
r AS (SELECT doc_id, i - 1 AS pos, ws[i] AS raw FROM w)
SELECT doc_id || '|' || pos || '|' || (row_number() OVER (PARTITION BY doc_id, raw ORDER BY pos) - 1) AS id, pos, raw FROM r
"""


def html_text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_ints(html_units(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "page_id"))


def s_entities(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


HTML_TEXT_UNITS = f"""
WITH t AS (SELECT page_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, {q(TOKEN)}) AS ts FROM pages)),
b AS (SELECT page_id, min(i) AS body FROM t WHERE regexp_matches(ts[i], '(?i)^<body\\b') GROUP BY page_id),
n AS (SELECT page_id, i - 1 AS node, {s_entities('ts[i]')} AS s FROM t LEFT JOIN b USING (page_id) WHERE i >= coalesce(body, 0) AND NOT starts_with(ts[i], '<'))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY node) - 1 AS seq, node, {s_trim('s')} AS original FROM n WHERE {s_doc_unit('s')}
"""


def translatable_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why lines of three tables are no units."""
    parts = [spread(table(spark, sf_dir, n).filter("text is not null").select(F.lit(n).alias("tab"), "text")) for n in ("documents", "conversations", "benchmark")]
    every = X.trimmed_lines(parts[0].unionByName(parts[1]).unionByName(parts[2]), "tab")
    t = F.col("original")
    got = every.select("tab", F.coalesce(rejection(t, trimmed=True), F.lit("unit")).alias("reason"), is_translatable_doc(t, trimmed=True).alias("d"), is_pdf_noise(F.col("line")).alias("p"))
    return got.groupBy("tab", "reason").agg(F.count("*").alias("n"), F.count_if("d").alias("doc_units"), F.count_if("p").alias("pdf_noise"))


TRANSLATABLE_BREAKDOWN = f"""
WITH l AS (SELECT tab, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line FROM (
  SELECT 'documents' AS tab, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark))
SELECT tab, coalesce({s_rejection('line')}, 'unit') AS reason, count(*) AS n, count(*) FILTER (WHERE {s_doc_unit('line')}) AS doc_units,
  count(*) FILTER (WHERE line = '' OR length(line) > 800 OR regexp_matches(line, {q(PDF_NOISE)})) AS pdf_noise
FROM l GROUP BY ALL
"""


# ---- units of literal files

FIXTURES = {
    "json": ['"a": "Hello", "b": "12"', '["Hello"]', '"k": "say \\"hi\\"", "k2": "say \\"hi\\""', '"u": "caf\\u00e9 bar"', '"z" : "你好世界"', '"e": ""'],
    "ini": ["title = New Game", "; c = x", "n=42", "[part] = z", "=novalue", "a=b = c", "  spaced  =  value here "],
    "srt": ["12", "00:00:01,000 --> 00:00:02,000", "Good morning", "", "  Two words  "],
    "ass": ["Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\i1}Hello, you{\\i0}", "Comment: 0,a,b,c,d,e,f,g,h,Hi", "Dialogue: 0,a,b", "Dialogue: 0,1,2,D,,0,0,0,,{\\b1}"],
    "yaml": ['title: "New Game"', "title: New Game", '# t: "New Game"', "a: 'it is'", 'k: ""'],
    "rpy": ['    e "Good morning, {name}."', "label start:", '    e happy "hello"', '    m "A b" "C d"', '# "No no"', '    m "A b" "A b"', "    「一 二」", '$ x = "No no"', 'e "{w=1 b}"'],
    "ks": ["[name]「こんにちは」", '@bg file="x y"', "He said 'go on' now", "*label", ';"No no"', '"A b" and "A b"', "『こん にちは』"],
}


def fixture(spark: SparkSession, fmt: str) -> DataFrame:
    return spark.createDataFrame([(f"f.{fmt}", "\n".join(FIXTURES[fmt]))], "file string, text string")


def line_units(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long_ints(X.extract(fixture(spark, fmt), fmt).select("file", "line_index", "occurrence", "original", "raw"))

    return run


def fixture_sql(fmt: str) -> str:
    rows = ", ".join(f"({i}, {q(x)})" for i, x in enumerate(FIXTURES[fmt]))
    return f"SELECT 'f.{fmt}' AS file, line_index, line FROM (VALUES {rows}) v(line_index, line)"


def units_sql(fmt: str, matches: str, where: str = "true") -> str:
    """matches: SQL that gives file, line_index, pos, original, raw from l."""
    return f"""
WITH l AS ({fixture_sql(fmt)}), m AS ({matches})
SELECT file, CAST(line_index AS BIGINT) AS line_index, row_number() OVER (PARTITION BY file, line_index, raw ORDER BY pos) - 1 AS occurrence, original, raw
FROM m WHERE original <> '' AND {s_rejection('original')} IS NULL AND {where}
"""


INI_VALUE = s_trim("substr(line, instr(line, '=') + 1)")
INI_KEY = s_trim("substr(line, 1, instr(line, '=') - 1)")
ASS_FIELD = "array_to_string(string_split(line, ',')[10:], ',')"
QUOTED_ROWS = f"SELECT file, line_index, i AS pos, rs[i] AS raw FROM (SELECT *, unnest(range(1, len(rs) + 1)) AS i FROM (SELECT *, regexp_extract_all(line, {q(X.QUOTED)}) AS rs FROM l WHERE %s))"
LINE_UNITS_SQL = {
    "json_units": units_sql("json", f"SELECT file, line_index, i AS pos, {s_decode('vs[i]')} AS original, rs[i] AS raw FROM (SELECT *, unnest(range(1, len(rs) + 1)) AS i FROM (SELECT *, regexp_extract_all(line, {q(X.JSON_VALUE)}) AS rs, regexp_extract_all(line, {q(X.JSON_VALUE)}, 1) AS vs FROM l))"),
    "ini_units": units_sql("ini", f"SELECT file, line_index, 0 AS pos, {INI_VALUE} AS original, line AS raw FROM l WHERE instr(line, '=') > 0 AND NOT regexp_matches(line, {q('^' + T.WS + '*[;#' + chr(92) + '[]')}) AND {INI_KEY} <> ''"),
    "srt_units": units_sql("srt", f"SELECT file, line_index, 0 AS pos, {s_trim('line')} AS original, {s_trim('line')} AS raw FROM l WHERE NOT contains(line, '-->') AND NOT regexp_matches({s_trim('line')}, '^[0-9]+$')"),
    "ass_units": units_sql("ass", f"SELECT file, line_index, 0 AS pos, {s_trim(f'regexp_replace({ASS_FIELD}, {q(X.ASS_TAG)}, {q(str())}, {q(chr(103))})')} AS original, {s_trim(f'regexp_replace({ASS_FIELD}, {q(X.ASS_TAG)}, {q(str())}, {q(chr(103))})')} AS raw FROM l WHERE starts_with(line, 'Dialogue:') AND len(string_split(line, ',')) >= 10"),
    "yaml_units": units_sql("yaml", f"SELECT file, line_index, 0 AS pos, {s_decode(f'(regexp_extract(line, {q(X.YAML_VALUE)}, 1) || regexp_extract(line, {q(X.YAML_VALUE)}, 2))')} AS original, line AS raw FROM l WHERE regexp_matches(line, {q(X.YAML_VALUE)})"),
    "rpy_units": units_sql("rpy", f"SELECT file, line_index, pos, {s_trim(s_decode('raw[2:-2]'))} AS original, raw FROM ({QUOTED_ROWS % f'NOT regexp_matches({s_trim(chr(108) + chr(105) + chr(110) + chr(101))}, {q(X.RPY_CODE)})'})", f"NOT regexp_matches(original, {q(X.BRACED)}) AND NOT regexp_matches(original, {q(X.IDENTIFIER)})"),
    "ks_units": units_sql("ks", f"SELECT file, line_index, pos, {s_decode('raw[2:-2]')} AS original, raw FROM ({QUOTED_ROWS % f'NOT regexp_matches({s_trim(chr(108) + chr(105) + chr(110) + chr(101))}, {q(chr(94) + chr(91) + chr(59) + chr(42) + chr(64) + chr(93))})'})"),
}


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String values in the events' properties: the table holds numbers only, so there are none; each line is still read."""
    files = table(spark, sf_dir, "events").select(F.col("event_id").alias("file"), F.col("props").alias("text"))
    units = X.extract(files, "json").groupBy("file").agg(F.count("*").alias("units")).withColumnRenamed("file", "f")
    got = files.join(units, F.col("file") == F.col("f"), "left")
    return got.agg(F.count("*").alias("files"), F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("units"))


JSON_PROPS = f"SELECT count(*) AS files, CAST(coalesce(sum(len(list_filter(regexp_extract_all(props, {q(X.JSON_VALUE)}, 1), lambda v: v <> ''))), 0) AS BIGINT) AS units FROM events"


# ---- translation memory


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.trimmed_lines(spread(table(spark, sf_dir, "conversations")), "conv_id", "turn").filter(is_translatable(F.col("original"), trimmed=True))


TURN_LINES = f"SELECT role, conv_id, turn, line_index, {s_trim('line')} AS original FROM (SELECT role, conv_id, turn, i - 1 AS line_index, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, regexp_split_to_array(text, '\\r?\\n') AS ls FROM conversations))) WHERE {s_rejection('line')} IS NULL"


def tm_dedupe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = turn_lines(spark, sf_dir).groupBy("original").agg(F.count("*").alias("n"))
    return got.agg(F.sum("n").cast("long").alias("units"), F.count("*").alias("distinct_units"), F.sum(F.col("n") - 1).cast("long").alias("calls_saved"))


TM_DEDUPE_RATIO = f"SELECT count(*) AS units, count(DISTINCT original) AS distinct_units, count(*) - count(DISTINCT original) AS calls_saved FROM ({TURN_LINES})"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.trimmed_lines(spread(table(spark, sf_dir, "documents")), "doc_id", "lang").select("doc_id", "lang", "original", F.lit("").alias("translated")).filter("original <> ''")


def tm_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines against a memory of the benchmark's: hits and different misses, by language."""
    m = X.trimmed_lines(table(spark, sf_dir, "benchmark")).select(F.lit("pseudo").alias("provider"), F.lit("zh-CN").alias("target_lang"), "original", F.concat(F.lit("zh:"), "original").alias("t"), F.lit(1).cast("long").alias("ts"))
    got = memory.look_up(doc_lines(spark, sf_dir), m, "pseudo", "zh-CN")
    return got.groupBy("lang").agg(F.count_if(F.col("hit").isNotNull()).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"), F.countDistinct(F.when(F.col("hit").isNull(), F.col("original"))).alias("calls"))


TM_HIT_MISS = f"""
WITH d AS (SELECT lang, {s_trim('line')} AS original FROM ({lines_sql('documents', 'lang', 'text')})),
m AS (SELECT DISTINCT {s_trim('line')} AS original, true AS hit FROM ({lines_sql('benchmark', 'item_id', 'text')}))
SELECT lang, count(hit) AS hits, count(*) - count(hit) AS misses, count(DISTINCT CASE WHEN hit IS NULL THEN original END) AS calls
FROM d LEFT JOIN m USING (original) WHERE original <> '' GROUP BY lang
"""


def tm_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run with the offline provider over an empty memory: every unit gets a translation or an error."""
    units = turn_lines(spark, sf_dir).select("conv_id", "turn", F.col("line_index").cast("long"), "original", F.lit("").alias("translated"), F.lit("").alias("error"))
    out, _ = memory.translate(units, memory.empty_memory(spark), memory.PseudoProvider(), "fr", lambda df: df)
    return out


TM_TRANSLATE = f"SELECT conv_id, turn, line_index, original, '[fr] ' || original AS translated, '' AS error FROM ({TURN_LINES})"


def tm_evict_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.lit("p").alias("provider"), F.lit("fr").alias("target_lang"), F.col("event_id").cast("string").alias("original"), F.col("event_type").alias("t"), F.floor(epoch_micros(F.col("ts")) / 1000).alias("ts"))
    return memory.evict_oldest(m).select("original", "t", "ts")


TM_EVICT_OLDEST = "SELECT original, t, ts FROM (SELECT CAST(event_id AS VARCHAR) AS original, event_type AS t, epoch_us(ts) // 1000 AS ts, count(*) OVER () AS n FROM events) QUALIFY n <= 20000 OR row_number() OVER (ORDER BY ts DESC, original DESC) <= 15000"


def tm_key_djb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.djb2(F.concat(F.lit("mymemory|"), F.col("text"))).alias("key"))


TM_KEY_DJB2 = """
SELECT item_id, lower(to_base(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split('mymemory|' || text, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 33 + c) % 4294967296), 36)) AS key FROM benchmark
"""


def validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's answer taken as its translation, with echoes and provider messages planted by number."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("nxt"))
    r = F.when(F.col("conv_id") % 5 == 0, F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(F.col("conv_id") % 7 == 0, F.lit("QUERY LIMIT reached")).otherwise(F.coalesce("nxt", F.lit(" ")))
    return d.select("conv_id", "turn", validate(F.col("text"), r).alias("v")).select("conv_id", "turn", F.col("v.ok").alias("ok"), F.col("v.error").alias("error"))


VALIDATE_RESULTS = f"""
WITH d AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
r AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 5 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN conv_id % 7 = 0 THEN 'QUERY LIMIT reached' ELSE coalesce(nxt, ' ') END AS res FROM d),
e AS (SELECT conv_id, turn, CASE WHEN {s_trim('res')} = '' THEN 'empty result' WHEN regexp_matches(res, {q(BAD_RESULT)}) THEN 'provider message: ' || substr(res, 1, 50)
  WHEN length({s_trim('text')}) >= 3 AND lower({s_trim('text')}) = lower({s_trim('res')}) AND regexp_matches(lower(text), {q('[a-z]|' + T.HAN)}) THEN 'same as the original' END AS error FROM r)
SELECT conv_id, turn, error IS NULL AS ok, coalesce(error, '') AS error FROM e
"""

# ---- views, progress, layout


def view_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("original"), F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("zh:"), F.col("text"))).alias("translated"))
    got = None
    for mode in render.MODES:
        part = render.doc_text(units, mode, ("conv_id",)).withColumn("view", F.lit(mode))
        got = part if got is None else got.unionByName(part)
    return got.select("conv_id", "view", "text")


VIEW_RENDER = """
WITH u AS (SELECT conv_id, turn, text AS o, CASE WHEN turn % 3 = 0 THEN '' ELSE 'zh:' || text END AS t FROM conversations)
SELECT conv_id, view, string_agg(CASE view WHEN 'original' THEN o WHEN 'translated' THEN CASE WHEN t = '' THEN o ELSE t END ELSE o || '（' || t || '）' END, chr(10) ORDER BY turn) AS text
FROM u, (VALUES ('original'), ('translated'), ('bilingual')) v(view) GROUP BY conv_id, view
"""


def file_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units of their source, labelled ones as done."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("d"), "quality")
    units = table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("d"), "left").select("source", F.col("quality").cast("string").alias("translated"), F.when(F.col("quality") == 0, "low").otherwise("").alias("error"))
    return profile.by_file(units, "source")


FILE_PROGRESS = """
SELECT source, count(*) AS units, count(quality) AS done, count(*) FILTER (WHERE quality = 0) AS failed, count(*) - count(quality) AS remaining, CAST(floor(100.0 * count(quality) / count(*) + 0.5) AS BIGINT) AS progress
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
"""

LAYOUT_ROWS = [
    ("a", 0, 0, 0.0, 100.0, 9.0, 112.0, 12.0, "Intro"),
    ("a", 0, 1, 0.0, 200.0, 9.0, 212.0, 12.0, "First line"),
    ("a", 0, 2, 0.0, 214.0, 9.0, 226.0, 12.0, "second line"),
    ("a", 0, 3, 0.0, 260.0, 9.0, 272.0, 12.0, "中文"),
    ("a", 0, 4, 0.0, 274.0, 9.0, 286.0, 12.0, "续行"),
    ("a", 1, 5, 0.0, 20.0, 9.0, 38.0, 18.0, "Big"),
    ("a", 1, 6, 0.0, 60.0, 9.0, 72.0, 12.0, "42"),
    ("b", 0, 0, 0.0, 760.0, 9.0, 772.0, 12.0, "end of"),
    ("b", 1, 1, 0.0, 50.0, 9.0, 62.0, 12.0, "page"),
    ("c", 0, 0, 0.0, 0.0, 9.0, 20.0, 20.0, "One size and enough characters to make it a text"),
    ("c", 0, 1, 0.0, 90.0, 9.0, 110.0, 10.0, "Another size"),
]
LAYOUT_SCHEMA = "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double, size double, text string"


def layout_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(LAYOUT_ROWS, LAYOUT_SCHEMA)
    kinds = layout.documents(rows).select("doc_id", "total_chars", "base", "pdf_kind")
    return long_ints(layout.paragraphs(rows).drop("rects").join(kinds, "doc_id"))


LAYOUT_VALUES = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in LAYOUT_ROWS)
S_JOINED = "list_reduce(list_filter(list(text ORDER BY ord), lambda t: t <> ''), lambda a, b: CASE WHEN regexp_matches(right(a, 1), '{c}') OR regexp_matches(left(b, 1), '{c}') THEN a || b ELSE a || ' ' || b END)".replace("{c}", T.CJK_WIDE)
LAYOUT_CLUSTERS = f"""
WITH r AS (SELECT * FROM (VALUES {LAYOUT_VALUES}) v(doc_id, page, ord, x0, y0, x1, y1, size, text)),
s AS (SELECT *, CASE WHEN lag(y1) OVER w IS NULL OR y0 - lag(y1) OVER w > greatest(1.5 * greatest(1.4 * lag(size) OVER w, 10), 8) OR abs(size - lag(size) OVER w) > 1.5 THEN 1 ELSE 0 END AS st FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY ord) AS c FROM s),
k AS (SELECT doc_id, c, {S_JOINED} AS text, CAST(max(size) AS DOUBLE) AS size, min_by(page, ord) AS page FROM g GROUP BY doc_id, c),
b AS (SELECT doc_id, size AS base FROM (SELECT doc_id, size, count(*) AS n FROM k GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) = 1),
d AS (SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM k GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS seq, text AS original, size >= 1.25 * base AND length(text) <= 40 AS title, CAST(page AS BIGINT) AS page, total_chars, base,
  CASE WHEN total_chars > 50 THEN 'text' ELSE 'empty' END AS pdf_kind
FROM k JOIN b USING (doc_id) JOIN d USING (doc_id) WHERE NOT (text = '' OR length(text) > 800 OR regexp_matches(text, {q(PDF_NOISE)}))
"""

OCR_ROWS = [
    ("a", 0, 0, 1.0, 10.0, 50.0, 30.0, 0.0, "Heading"),
    ("a", 0, 1, 1.0, 100.0, 50.0, 112.0, 0.0, "some words"),
    ("a", 0, 2, 1.0, 116.0, 50.0, 128.0, 0.0, "go on"),
    ("a", 1, 3, 1.4, 130.0, 50.6, 142.0, 0.0, "next page"),
    ("a", 1, 4, 1.0, 200.0, 50.0, 200.0, 0.0, "flat"),
]


def ocr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(OCR_ROWS, LAYOUT_SCHEMA).drop("size")
    got = layout.ocr_paragraphs(rows)
    return long_ints(got.select("doc_id", "seq", "original", "title", "page", F.size("boxes").alias("n_boxes")))


OCR_VALUES = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in OCR_ROWS)
OCR_CLUSTERS = f"""
WITH r AS (SELECT *, CASE WHEN y1 = y0 THEN 12 ELSE y1 - y0 END AS h FROM (VALUES {OCR_VALUES}) v(doc_id, page, ord, x0, y0, x1, y1, size, text)),
s AS (SELECT *, CASE WHEN lag(y1) OVER w IS NULL OR y0 - lag(y1) OVER w > greatest(1.5 * lag(h) OVER w, 8) THEN 1 ELSE 0 END AS st FROM r WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page ORDER BY ord) AS c FROM s),
k AS (SELECT doc_id, page, c, {S_JOINED} AS text, max(h) AS h, count(*) AS n_boxes FROM g GROUP BY ALL),
m AS (SELECT doc_id, list_sort(list(h))[count(*) // 2 + 1] AS med FROM k GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, c) - 1 AS seq, text AS original, h >= 1.3 * med AND length(text) <= 40 AS title, CAST(page AS BIGINT) AS page, n_boxes FROM k JOIN m USING (doc_id)
"""


def islands_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with gaps of at most an hour: the layout operator's shape on another table."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", epoch_micros(F.col("ts")).alias("us"))
    starts = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id")) > 3_600_000_000
    got = layout.islands(e, ["user_id"], ["us", "event_id"], starts, "run")
    return got.groupBy("user_id", "run").agg(F.count("*").alias("events"), (F.max("us") - F.min("us")).alias("us"))


ISLANDS_EVENTS = """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
s AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 3600000000 THEN 0 ELSE 1 END AS st FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM s)
SELECT user_id, run, count(*) AS events, max(us) - min(us) AS us FROM g GROUP BY user_id, run
"""

PROGRAMS = [("a.exe", "x UnityPlayer.dll il2cpp"), ("b.exe", "kirikiri tvp"), ("c.exe", "godot ue4"), ("d.exe", "nothing"), ("e.exe", "RGSS300.dll")]


def engine_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.detect_engine(spark.createDataFrame(PROGRAMS, "name string, strings string"), "name", "strings")


ENGINE_FINGERPRINT = f"""
WITH p AS (SELECT * FROM (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in PROGRAMS)}) v(name, strings)),
s AS (SELECT * FROM (VALUES {', '.join(f'({i}, {q(n)}, {q(x)})' for i, (n, xs) in enumerate(fingerprint.ENGINES) for x in xs)}) v(rank, engine, sig)),
h AS (SELECT name, rank, engine, count(*) AS score FROM p JOIN s ON contains(lower(strings), sig) GROUP BY ALL)
SELECT name, engine, score FROM h QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, rank) = 1
"""

SECTIONS = [("a", 0, 4096, 1024, 2048), ("a", 1, 8192, 3072, 512), ("a", 2, 8192, 9999, 4096)]
ADDRESSES = [("a", 4096), ("a", 6143), ("a", 6144), ("a", 8200), ("a", 9000), ("b", 4096)]


def rva_to_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame(SECTIONS, "name string, ord int, va long, raw_ptr long, raw_size long")
    return fingerprint.address_offsets(spark.createDataFrame(ADDRESSES, "name string, rva long"), s, "name")


RVA_TO_OFFSET = f"""
WITH s AS (SELECT * FROM (VALUES {', '.join(str(r) for r in SECTIONS)}) v(name, ord, va, raw_ptr, raw_size)), a AS (SELECT * FROM (VALUES {', '.join(str(r) for r in ADDRESSES)}) v(name, rva))
SELECT a.name, CAST(rva AS BIGINT) AS rva, CAST(min_by(rva - va + raw_ptr, ord) AS BIGINT) AS "offset" FROM a LEFT JOIN s ON a.name = s.name AND rva BETWEEN va AND va + raw_size - 1 GROUP BY a.name, rva
"""


def queries() -> dict:
    out = {f.__name__: f for f in (doc_units_by_lang, doc_plain_units, unit_ids_occurrence, html_text_units, translatable_breakdown, json_props, tm_dedupe_ratio, tm_hit_miss, tm_translate, tm_evict_oldest, tm_key_djb2, validate_results, view_render, file_progress, layout_clusters, ocr_clusters, islands_events, engine_fingerprint, rva_to_offset)}
    return out | {f"{fmt}_units": line_units(fmt) for fmt in FIXTURES}


def oracle_sql() -> dict[str, str]:
    names = ("doc_units_by_lang", "doc_plain_units", "unit_ids_occurrence", "html_text_units", "translatable_breakdown", "json_props", "tm_dedupe_ratio", "tm_hit_miss", "tm_translate", "tm_evict_oldest", "tm_key_djb2", "validate_results", "view_render", "file_progress", "layout_clusters", "ocr_clusters", "islands_events", "engine_fingerprint", "rva_to_offset")
    return {n: globals()[n.upper()] for n in names} | LINE_UNITS_SQL

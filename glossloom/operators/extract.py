"""Translation units from the lines of text files: one row for each string.

files: a DataFrame with `file` and `text` (and, if given, `encoding`). Every extractor gives file, line_index,
occurrence (which of the equal raw strings of the line), original, raw (as it stands in the line), ex, tags and quote.
Units of a line are numbered inside the row that holds the line, so extracting needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossloom.functions.predicates import is_translatable, is_translatable_doc
from glossloom.functions.text import WS, decode_escapes, ext_of, trim

# File types by extension.
TEXT_EXT = ("txt", "md", "log", "story", "script", "dialogue", "text", "json", "xml", "yaml", "yml", "ini", "cfg", "conf", "srt", "ass", "ssa", "rpy", "ks", "csv", "tsv")
EXTRACTORS = {
    "plain": ("txt", "md", "log", "story", "script", "dialogue", "text"),
    "json": ("json",),
    "ini": ("ini", "cfg", "conf"),
    "srt": ("srt",),
    "ass": ("ass", "ssa"),
    "rpy": ("rpy",),
    "ks": ("ks",),
    "yaml": ("yaml", "yml"),
    "csv": ("csv", "tsv"),
}
DOC_TYPES = {"docx": "docx", "epub": "epub", "html": "html", "htm": "html", "xlsx": "xlsx", "pptx": "pptx", "pdf": "pdf", "md": "plain", "txt": "plain"}
# What a line of each format holds.
JSON_VALUE = f":{WS}*\"((?:[^\"\\\\]|\\\\[^\\n\\r\\x{{2028}}\\x{{2029}}])*)\""
NO_END = "[^\\n\\r\\x{2028}\\x{2029}]"
QUOTED = f"\"((?:\\\\{NO_END}|[^\"\\n\\r\\x{{2028}}\\x{{2029}}])*?)\"|'((?:\\\\{NO_END}|[^'\\n\\r\\x{{2028}}\\x{{2029}}])*?)'|「([^「」]*?)」|『([^『』]*?)』"
RPY_CODE = f"^(?:#|\\$|label{WS}|init{WS}|python\\b|screen\\b|transform{WS}|image{WS})"
IDENTIFIER = "^[a-zA-Z_][a-zA-Z0-9_.]*\\z"
BRACED = f"^\\{{{NO_END}*\\}}\\z"
YAML_KEY = f"^{WS}*[^#][^:]*?:{WS}*"
YAML_VALUE = f"^{WS}*[^#][^:]*?:{WS}*(?:\"({NO_END}*?)\"|'({NO_END}*?)'){WS}*\\z"
ASS_TAG = "\\{[^}]*\\}"

MATCH = "original string, raw string, tags array<string>, quote string"


def format_of(name: Column) -> Column:
    """The extractor that a file's extension calls for; null if there is none."""
    ext, out = ext_of(name), None
    for fmt, exts in EXTRACTORS.items():
        out = F.when(ext.isin(*exts), fmt) if out is None else out.when(ext.isin(*exts), fmt)
    return out


def doc_type_of(name: Column) -> Column:
    ext, out = ext_of(name), None
    for e, kind in DOC_TYPES.items():
        out = F.when(ext == e, kind) if out is None else out.when(ext == e, kind)
    return out


# Arrays made from a text are exploded by the outer form: before the other one Spark filters for arrays that aren't empty, and
# works each out once more for that.


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row for each line; a null text is one null line."""
    return files.select("file", *keep, F.posexplode_outer(F.split("text", "\\r?\\n")).alias("line_index", "line"))


def trimmed_lines(files: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep, line_index, line and original, the trimmed line, as columns of their own: what is decided on them works on them as they are."""
    both = F.transform(F.split(text, "\\r?\\n"), lambda x: F.struct(x.alias("line"), trim(x).alias("original")))
    return files.select(*keep, F.posexplode_outer(both).alias("line_index", "l")).select(*keep, "line_index", "l.line", "l.original")


def one(original: Column, raw: Column, tags: Column | None = None, quote: Column | None = None) -> Column:
    return F.struct(
        original.alias("original"), raw.alias("raw"), (tags if tags is not None else F.lit(None).cast("array<string>")).alias("tags"), (quote if quote is not None else F.lit(None).cast("string")).alias("quote")
    )


def nothing() -> Column:
    return F.array().cast(f"array<struct<{MATCH.replace(' ', ':', 1).replace(', raw ', ',raw:').replace(', tags ', ',tags:').replace(', quote ', ',quote:')}>>")


def plain_matches(line: Column) -> Column:
    return F.array(one(trim(line), trim(line)))


def json_matches(line: Column) -> Column:
    raws, values = (F.regexp_extract_all(line, F.lit(JSON_VALUE), F.lit(g)) for g in (0, 1))
    return F.zip_with(raws, values, lambda r, v: one(decode_escapes(v), r))


def ini_matches(line: Column) -> Column:
    eq = F.instr(line, "=")
    key, value = trim(F.substring(line, F.lit(1), eq - 1)), trim(F.substring(line, eq + 1, F.length(line)))
    skip = line.rlike(f"^{WS}*[;#\\[]") | (eq == 0) | (key == "")
    return F.when(skip, nothing()).otherwise(F.array(one(value, line)))


def srt_matches(line: Column) -> Column:
    t = trim(line)
    return F.when((t == "") | t.rlike("^[0-9]+\\z") | (F.instr(t, "-->") > 0), nothing()).otherwise(F.array(one(t, t)))


def ass_matches(line: Column) -> Column:
    parts = F.split(line, ",")
    field = F.array_join(F.slice(parts, 10, 1_000_000), ",")
    text = trim(F.regexp_replace(field, ASS_TAG, ""))
    tags = F.regexp_extract_all(field, F.lit(ASS_TAG), F.lit(0))
    return F.when(~line.startswith("Dialogue:") | (F.size(parts) < 10) | (text == ""), nothing()).otherwise(F.array(one(text, text, tags)))


def quoted(line: Column, inner: Callable[[Column], Column]) -> Column:
    raws = F.regexp_extract_all(line, F.lit(QUOTED), F.lit(0))
    return F.transform(raws, lambda r: one(inner(decode_escapes(F.substring(r, F.lit(2), F.length(r) - 2))), r, quote=F.substring(r, 1, 1)))


def rpy_matches(line: Column) -> Column:
    t = trim(line)
    found = F.filter(quoted(line, trim), lambda m: ~(m["original"].rlike(BRACED) | m["original"].rlike(IDENTIFIER)))
    return F.when((t == "") | t.rlike(RPY_CODE), nothing()).otherwise(found)


def ks_matches(line: Column) -> Column:
    t = trim(line)
    return F.when((t == "") | t.rlike("^[;*@]"), nothing()).otherwise(quoted(line, lambda c: c))


def yaml_matches(line: Column) -> Column:
    a, b = (F.regexp_extract(line, YAML_VALUE, g) for g in (1, 2))
    value = decode_escapes(F.when(a != "", a).otherwise(b))
    return F.when(line.rlike(YAML_VALUE), F.array(one(value, line))).otherwise(nothing())


MATCHERS: dict[str, Callable[[Column], Column]] = {"plain": plain_matches, "json": json_matches, "ini": ini_matches, "srt": srt_matches, "ass": ass_matches, "rpy": rpy_matches, "ks": ks_matches, "yaml": yaml_matches, "csv": lambda line: nothing()}


def numbered(found: Column) -> Column:
    """Each match with the number of earlier ones in the line that have its raw string."""
    same = lambda m, i: F.size(F.filter(F.slice(found, F.lit(1), i), lambda x: x["raw"] == m["raw"]))
    return F.transform(found, lambda m, i: F.struct(m.alias("m"), F.when(i == 0, 0).otherwise(same(m, i)).alias("occurrence")))


def units_of(rows: DataFrame, matches: Column, ex: Column, target: str, skip_pure_han: Column) -> DataFrame:
    """The units of lines (file, line_index, line and what the columns need)."""
    # the trimmed text is worked out once for each match
    fits = lambda m: F.exists(F.array(trim(m["original"])), lambda t: is_translatable(t, target, skip_pure_han, trimmed=True))
    found = F.filter(matches, lambda m: (m["original"] != "") & fits(m))
    rows = rows.select("file", "line_index", ex.alias("ex"), found.alias("found")).select("file", "line_index", "ex", numbered(F.col("found")).alias("us"))
    rows = rows.select("file", "line_index", "ex", F.explode_outer("us").alias("u")).filter(F.col("u").isNotNull())
    return rows.select("file", "line_index", F.col("u.occurrence").alias("occurrence"), "u.m.original", "u.m.raw", "ex", "u.m.tags", "u.m.quote")


def extract(files: DataFrame, fmt: str, target: str = "zh-CN", skip_pure_han: bool | Column = False) -> DataFrame:
    """The units of files of one format."""
    skip = skip_pure_han if isinstance(skip_pure_han, Column) else F.lit(skip_pure_han)
    return units_of(lines(files), MATCHERS[fmt](F.col("line")), F.lit(fmt), target, skip)


def extract_files(files: DataFrame, target: str = "zh-CN") -> DataFrame:
    """The units of files of any text format, in one pass. Files without an extractor have none. GBK files skip lines of
    Han only."""
    gbk = F.coalesce(F.col("encoding") == "gbk", F.lit(False)) if "encoding" in files.columns else F.lit(False)
    routed = files.select("file", "text", format_of(F.col("file")).alias("fmt"), gbk.alias("gbk")).filter(F.col("fmt").isNotNull() & (F.col("fmt") != "csv"))
    matches = F.when(F.col("fmt") == "plain", plain_matches(F.col("line")))
    for fmt in EXTRACTORS:
        if fmt not in ("plain", "csv"):
            matches = matches.when(F.col("fmt") == fmt, MATCHERS[fmt](F.col("line")))
    return units_of(lines(routed, "fmt", "gbk"), matches, F.col("fmt"), target, F.col("gbk"))


def unit_id(df: DataFrame) -> Column:
    return F.concat_ws("|", "file", F.col("line_index").cast("string"), F.col("occurrence").cast("string"))


def doc_plain_units(files: DataFrame, target: str = "zh-CN") -> DataFrame:
    """Units of plain documents: file, seq (dense, from 0), line_index, original, raw. Numbered inside the document's row."""
    all_lines = F.transform(F.split("text", "\\r?\\n"), lambda x, i: F.struct(i.alias("line_index"), x.alias("raw"), trim(x).alias("original")))
    kept = F.filter(all_lines, lambda u: is_translatable_doc(u["original"], target, trimmed=True))
    rows = files.select("file", F.posexplode_outer(kept).alias("seq", "u")).filter(F.col("u").isNotNull())
    return rows.select("file", "seq", "u.line_index", "u.original", "u.raw")


def dense_seq(df: DataFrame, by: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """df with a dense number from 0 in each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def with_occurrence(df: DataFrame, by: list[str], order: str, name: str = "occurrence") -> DataFrame:
    """df with the number of earlier rows that have equal values in `by`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)

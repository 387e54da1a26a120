"""Views and rebuilt files from translated units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions.predicates import is_image_junk
from glossloom.functions.text import WS, escape_json

MODES = ("original", "translated", "bilingual")


def shown(translated: Column, original: Column) -> Column:
    """The translation, or the original where there is none."""
    return F.coalesce(F.nullif(translated, F.lit("")), original)


def view_text(original: Column, translated: Column, mode: str) -> Column:
    """A document unit's text in a view. Both are shown as original（translation）."""
    if mode == "original":
        return original
    if mode == "translated":
        return shown(translated, original)
    return F.concat(original, F.lit("（"), F.coalesce(translated, F.lit("")), F.lit("）"))


def line_text(original: Column, translated: Column, mode: str) -> Column:
    """A line unit's new text."""
    t = shown(translated, original)
    return original if mode == "original" else t if mode == "translated" else F.concat(original, F.lit("（"), t, F.lit("）"))


def json_raw(raw: Column, text: Column) -> Column:
    """raw with what stands between its first and last quote replaced, escaped."""
    i, back = F.instr(raw, '"'), F.instr(F.reverse(raw), '"')
    j = F.length(raw) - back + 1
    return F.when((i == 0) | (j <= i), raw).otherwise(F.concat(F.substring(raw, F.lit(1), i), escape_json(text), F.substring(raw, j, F.length(raw))))


def quoted_raw(raw: Column, text: Column) -> Column:
    """raw with the text between its quotes replaced; ASCII quotes are escaped in it."""
    q, q2 = F.substring(raw, 1, 1), F.substring(raw, -1, 1)
    safe = F.when(q.isin('"', "'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), q, F.concat(F.lit("\\"), q))).otherwise(text)
    return F.concat(q, safe, q2)


def ini_raw(raw: Column, text: Column) -> Column:
    key = F.substring(raw, F.lit(1), F.instr(raw, "=") - 1)
    return F.concat(F.regexp_replace(key, f"{WS}+\\z", ""), F.lit("="), text)


def yaml_raw(raw: Column, original: Column, text: Column) -> Column:
    """The original's first occurrence replaced, literally."""
    at = F.call_function("locate", original, raw)
    return F.when(at == 0, raw).otherwise(F.concat(F.substring(raw, F.lit(1), at - 1), text, F.substring(raw, at + F.length(original), F.length(raw))))


def ass_line(line: Column, tags: Column, text: Column) -> Column:
    """The subtitle's nine fields, its tags, then the text: also where tags stood inside the text."""
    head = F.array_join(F.slice(F.split(line, ","), 1, 9), ",")
    return F.concat(head, F.lit(","), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ""), text)


def new_raw(u: Column, line: Column, mode: str) -> Column:
    """What replaces a unit's raw string. Subtitles in both languages show the translation, and the original below."""
    t = line_text(u["original"], u["translated"], mode)
    alone = line_text(u["original"], u["translated"], "translated" if mode == "bilingual" else mode)
    return (
        F.when(u["ex"] == "json", json_raw(u["raw"], t))
        .when(u["ex"] == "ini", ini_raw(u["raw"], t))
        .when(u["ex"].isin("rpy", "ks"), quoted_raw(u["raw"], t))
        .when(u["ex"] == "yaml", yaml_raw(u["raw"], u["original"], t))
        .when(u["ex"] == "ass", ass_line(line, u["tags"], alone))
        .when(u["ex"] == "srt", alone)
        .otherwise(t)
    )


def nth_position(line: Column, raw: Column, n: Column) -> Column:
    """Where occurrence n of raw starts (from 1); 0 if there is none."""
    steps = F.sequence(F.lit(0), n.cast("int"))
    return F.aggregate(steps, F.lit(0), lambda p, i: F.when((i > 0) & (p == 0), F.lit(0)).otherwise(F.call_function("locate", raw, line, p + 1)))


def put_back(pieces: DataFrame, edits: DataFrame, key: str, at: str, of_piece: list[str], of_edit: list[str], text: Column, between: str, out: str) -> DataFrame:
    """key, out: the pieces of each key, changed by text, joined in the order of at. text is over the columns of_piece and
    of_edit of one piece; where a piece has no edit, these are null.

    Pieces and edits are dealt by key in one shuffle of both; a key's pieces meet their edits and are joined where they lie. A
    key whose only piece has a null place had a null text, and gets one back. Edits without a piece are left out. Keys must be
    different: pieces of two texts with one key would mix.
    """
    here = F.lit(True)
    none = [F.lit(None).cast(t).alias(c) for c, t in edits.dtypes if c in of_edit]
    every = pieces.select(key, at, *of_piece, here.alias("_here"), *none)
    none = [F.lit(None).cast(t).alias(c) for c, t in pieces.dtypes if c in of_piece]
    every = every.unionByName(edits.select(key, at, *none, F.lit(None).cast("boolean").alias("_here"), *of_edit))
    one = every.repartition(key).groupBy(key, at).agg(*[F.first(c, ignorenulls=True).alias(c) for c in [*of_piece, *of_edit, "_here"]])
    got = one.filter("_here").select(key, at, text.alias("_t")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, "_t"))).alias("_g"), F.max(at).alias("_last"))
    return got.select(key, F.when(F.col("_last").isNotNull(), F.array_join("_g._t", between)).alias(out))


def rebuild(files: DataFrame, units: DataFrame, mode: str = "translated") -> DataFrame:
    """file, text: each file with its units replaced. Line ends stay as they are; null texts stay null.

    Positions are those in the original line, so replacing one copy of a string doesn't move the others. Units need
    file, line_index, occurrence, original, raw, translated, ex, tags.
    """
    if mode == "original":
        return files.select("file", "text")
    cut = files.select("file", F.split("text", "\\r?\\n").alias("line"), F.regexp_extract_all("text", F.lit("\\r?\\n"), F.lit(0)).alias("end"))
    rows = cut.select("file", F.posexplode_outer(F.arrays_zip("line", "end")).alias("line_index", "l")).select("file", "line_index", "l.line", "l.end")
    held = units.groupBy("file", "line_index").agg(F.collect_list(F.struct("occurrence", "original", "raw", "translated", "ex", "tags")).alias("us"))
    line = F.col("line")

    def edit(u: Column) -> Column:
        whole = u["ex"] == "ass"
        at = F.when(whole, F.lit(1)).otherwise(nth_position(line, u["raw"], u["occurrence"]))
        size = F.when(whole, F.length(line)).otherwise(F.length(u["raw"]))
        return F.struct(at.alias("at"), size.alias("size"), new_raw(u, line, mode).alias("new"))

    edits = F.array_sort(F.filter(F.transform("us", edit), lambda e: e["at"] > 0))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def splice(acc: Column, e: Column) -> Column:
        kept = F.substring(line, acc["at"], e["at"] - acc["at"])
        return F.when(e["at"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], kept, e["new"]).alias("out"), (e["at"] + e["size"]).alias("at")))

    done = F.aggregate(edits, start, splice, lambda acc: F.concat(acc["out"], F.substring(line, acc["at"], F.length(line))))
    lower = F.lit("")
    if mode == "bilingual":
        below = lambda u: F.when(u["ex"] == "ass", line).otherwise(u["original"])
        extra = F.transform(F.filter("us", lambda u: u["ex"].isin("srt", "ass")), lambda u: F.concat(F.lit("\n"), below(u)))
        lower = F.coalesce(F.array_join(extra, ""), F.lit(""))
    whole = F.concat(F.when(F.col("us").isNull(), line).otherwise(done), lower, F.coalesce("end", F.lit("")))
    return put_back(rows, held, "file", "line_index", ["line", "end"], ["us"], whole, "", "text")


def rebuild_plain(files: DataFrame, units: DataFrame, mode: str = "translated") -> DataFrame:
    """file, text: each line that is a unit replaced as a whole by its view. Null texts stay null."""
    rows = files.select("file", F.posexplode_outer(F.split("text", "\\r?\\n")).alias("line_index", "line"))
    new = units.select("file", "line_index", view_text(F.col("original"), F.col("translated"), mode).alias("new"))
    return put_back(rows, new, "file", "line_index", ["line"], ["new"], F.coalesce("new", "line"), "\n", "text")


def doc_text(units: DataFrame, mode: str, by: tuple[str, ...] = ("file",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The units of each document in order, one a line."""
    text = view_text(F.col("original"), F.col("translated"), mode)
    got = units.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))).alias("g"))
    return got.select(*by, F.array_join("g.t", "\n").alias("text"))


# Headings of exported files.
DOCUMENT_HEADING = "# 译文文档"
IMAGE_HEADING = "图片文字识别与翻译"


def export_translated(paragraphs: DataFrame, translations: DataFrame, fmt: str) -> DataFrame:
    """doc_id, text in 'md' or 'txt': paragraphs by seq with their translation where there is one; titles are headings in md."""
    if fmt not in ("md", "txt"):
        raise ValueError(f"no such format: {fmt}")
    joined = paragraphs.join(translations.select("doc_id", "seq", "translated"), ["doc_id", "seq"], "left")
    head = F.when(F.col("title"), F.lit("## ")).otherwise(F.lit("")) if fmt == "md" else F.lit("")
    got = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(head, shown(F.col("translated"), F.col("original"))).alias("t")))).alias("g"))
    body = F.array_join("g.t", "\n\n" if fmt == "md" else "\n")
    return got.select("doc_id", F.concat(F.lit(DOCUMENT_HEADING + "\n\n" if fmt == "md" else ""), body, F.lit("\n")).alias("text"))


def image_text(boxes: DataFrame, mode: str, md: bool) -> DataFrame:
    """image, text: the boxes that aren't junk, in order (image, ord, text, translated)."""
    o, t = F.col("text"), shown(F.col("translated"), F.col("text"))
    both = F.concat(F.lit("- **原文**：" if md else ""), o, F.lit("\n- **译文**：" if md else "\n"), t)
    item = o if mode == "original" else t if mode == "translated" else both
    got = boxes.filter(~is_image_junk(o)).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("t")))).alias("g"))
    head = F.concat(F.lit(("# " if md else "") + IMAGE_HEADING + "（"), F.col("image"), F.lit("）\n" + ("\n" if md else "=" * 20 + "\n")))
    return got.select("image", F.concat(head, F.array_join("g.t", "\n\n"), F.lit("\n")).alias("text"))

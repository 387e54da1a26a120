"""Paragraphs from positioned text rows.

Rows: doc_id, page, ord (document order), x0, y0, x1, y1, size (or h, for recognised text), text. Lines near each other
form a paragraph; large short ones are titles. A document's rows are windowed by doc_id: one document is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossloom.functions.predicates import is_pdf_noise
from glossloom.functions.text import CJK_WIDE, trim

# What makes titles and text documents.
TITLE_RATIO, OCR_TITLE_RATIO, TITLE_LENGTH = 1.25, 1.3, 40
TEXT_CHARS, BASE_SIZE, BASE_HEIGHT = 50, 12.0, 20.0


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, out: str) -> DataFrame:
    """df with the number of the run that each row is in; `starts` tells whether a row begins one (null: it does)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_s", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).withColumn(out, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_s")


def join_lines(texts: Column) -> Column:
    """Lines joined; a space goes between two of them unless CJK stands on either side. Empty lines are left out."""

    def add(whole: Column, line: Column) -> Column:
        tight = (whole == "") | F.substring(whole, -1, 1).rlike(CJK_WIDE) | F.substring(line, 1, 1).rlike(CJK_WIDE)
        return F.when(line == "", whole).when(tight, F.concat(whole, line)).otherwise(F.concat(whole, F.lit(" "), line))

    return F.aggregate(texts, F.lit(""), lambda whole, line: add(whole, F.coalesce(line, F.lit(""))))


def base_size(clusters: DataFrame) -> DataFrame:
    """doc_id, base: the most frequent size, the smaller one of equally frequent."""
    counts = clusters.groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("n"), F.col("size"))).alias("base"))


def clusters(rows: DataFrame, split_pages: bool = False) -> DataFrame:
    """doc_id, cluster, text, size, page, rects. Lines go on while the gap and the change of size are small; a page break
    alone doesn't end a paragraph unless split_pages."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    gap = F.col("y0") - F.lag("y1").over(w)
    line = F.greatest(F.lag("size").over(w) * 1.4, F.lit(10.0))
    starts = (gap > F.greatest(line * 1.5, F.lit(8.0))) | (F.abs(F.col("size") - F.lag("size").over(w)) > 1.5)
    if split_pages:
        starts = starts | (F.col("page") != F.lag("page").over(w))
    got = islands(rows, ["doc_id"], ["ord"], starts, "cluster")
    item = F.struct("ord", "text", "page", F.array("x0", "y0", "x1", "y1").alias("rect"))
    got = got.groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(item)).alias("g"), F.max("size").alias("size"))
    return got.select("doc_id", "cluster", join_lines(F.col("g.text")).alias("text"), "size", F.col("g")[0]["page"].alias("page"), F.col("g.rect").alias("rects"))


def paragraphs(rows: DataFrame, split_pages: bool = False) -> DataFrame:
    """doc_id, seq, original, title, page, rects of the paragraphs that aren't noise."""
    c = clusters(rows, split_pages)
    got = c.join(base_size(c), "doc_id").withColumn("original", trim(F.col("text"))).filter(~is_pdf_noise(F.col("original")))
    title = (F.col("size") >= F.coalesce("base", F.lit(BASE_SIZE)) * TITLE_RATIO) & (F.length("original") <= TITLE_LENGTH)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("cluster")) - 1
    return got.select("doc_id", seq.alias("seq"), "original", title.alias("title"), "page", "rects")


def documents(rows: DataFrame, has_images: DataFrame | None = None) -> DataFrame:
    """doc_id, total_chars (before noise is left out), base, pdf_kind; has_images: doc_id, has_images."""
    c = clusters(rows)
    got = c.groupBy("doc_id").agg(F.sum(F.length("text")).alias("total_chars")).join(base_size(c), "doc_id")
    got = got.join(has_images, "doc_id", "full") if has_images is not None else got.withColumn("has_images", F.lit(False))
    chars = F.coalesce("total_chars", F.lit(0))
    kind = F.when(chars > TEXT_CHARS, "text").when(F.coalesce("has_images", F.lit(False)), "image").otherwise("empty")
    return got.select("doc_id", chars.cast("long").alias("total_chars"), F.coalesce("base", F.lit(BASE_SIZE)).alias("base"), kind.alias("pdf_kind"))


def ocr_paragraphs(rows: DataFrame) -> DataFrame:
    """doc_id, seq, original, title, page, boxes from recognised rows: by page, and by gap alone."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    rows = rows.withColumn("h", F.coalesce(F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)), F.lit(12.0)))
    starts = F.col("y0") - F.lag("y1").over(w) > F.greatest(F.lag("h").over(w) * 1.5, F.lit(8.0))
    got = islands(rows, ["doc_id", "page"], ["ord"], starts, "cluster")
    box = F.transform(F.array("x0", "y0", "x1", "y1"), lambda v: F.bround(v).cast("int"))
    got = got.groupBy("doc_id", "page", "cluster").agg(F.array_sort(F.collect_list(F.struct("ord", "text", box.alias("box")))).alias("g"), F.max("h").alias("h"))
    got = got.withColumn("original", join_lines(F.col("g.text")))
    heights = got.groupBy("doc_id").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    median = F.element_at("hs", F.floor(F.size("hs") / 2).cast("int") + 1)
    got = got.join(heights.select("doc_id", median.alias("median")), "doc_id")
    title = (F.col("h") >= F.coalesce("median", F.lit(BASE_HEIGHT)) * OCR_TITLE_RATIO) & (F.length("original") <= TITLE_LENGTH)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "cluster")) - 1
    return got.select("doc_id", seq.alias("seq"), "original", title.alias("title"), "page", F.col("g.box").alias("boxes"))


def text_layer_rows(lines: DataFrame) -> DataFrame:
    """Rows from the lines of a text layer (doc_id, page, ord, x0, y0, x1, y1, spans: array of text and size): a line's text is
    that of its spans, its size their largest. Lines without spans or text are left out; null sizes count as 0."""
    text = trim(F.array_join(F.transform("spans", lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    size = F.array_max(F.transform("spans", lambda s: F.coalesce(s["size"], F.lit(0.0)).cast("double")))
    return lines.select("doc_id", "page", "ord", "x0", "y0", "x1", "y1", size.alias("size"), text.alias("text")).filter(F.coalesce(F.col("text"), F.lit("")) != "")


def recognised_rows(results: DataFrame) -> DataFrame:
    """Rows from recognised text of pages (doc_id, page, ord, polygon: array of points, text): trimmed, without noise, with the
    box around the polygon."""
    box = bounding_box(F.col("polygon"))
    got = results.withColumn("text", trim(F.col("text"))).filter(~is_pdf_noise(F.col("text")))
    return got.select("doc_id", "page", "ord", *[box[i].cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], "text")


def image_boxes(results: DataFrame) -> DataFrame:
    """image, boxes (box, text, score; in order) from recognised text of images (image, ord, polygon, text, score): trimmed, empty
    texts left out, boxes rounded to whole numbers (halves to even), scores to three digits."""
    box = F.transform(bounding_box(F.col("polygon")), lambda v: F.bround(v).cast("int"))
    got = results.withColumn("text", trim(F.col("text"))).filter(F.coalesce(F.col("text"), F.lit("")) != "")
    got = got.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ord", box.alias("box"), "text", F.round("score", 3).alias("score")))).alias("g"))
    return got.select("image", F.transform("g", lambda b: F.struct(b["box"].alias("box"), b["text"].alias("text"), b["score"].alias("score"))).alias("boxes"))


def box_units(images: DataFrame, key: str = "image", boxes: str = "boxes") -> DataFrame:
    """key, seq, original, box: the boxes of each image's array (structs with text, box, translated, error) that wait for a
    translation, numbered from 0. Null and empty arrays give none. Numbered in the image's row, without a shuffle."""
    blank = lambda b, c: F.coalesce(b[c], F.lit("")) == ""
    waiting = F.filter(boxes, lambda b: blank(b, "translated") & blank(b, "error"))
    got = images.select(key, F.posexplode_outer(waiting).alias("seq", "b")).filter(F.col("b").isNotNull())
    return got.select(key, "seq", F.col("b.text").alias("original"), F.col("b.box").alias("box"))


def bounding_box(points: Column) -> Column:
    """[x0, y0, x1, y1] of an array of [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def union_rects(rects: Column) -> Column:
    """The box around an array of [x0, y0, x1, y1]."""
    side = lambda f, i: f(F.transform(rects, lambda r: r[i]))
    return F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 2), side(F.array_max, 3))


def exportable(paragraphs: DataFrame, least: float = 4.0) -> DataFrame:
    """Paragraphs that an export writes: translated, changed, and with a box of some size (column rects)."""
    box = union_rects(F.col("rects"))
    t = F.coalesce(F.col("translated"), F.lit(""))
    return paragraphs.filter((t != "") & (t != F.col("original")) & (F.size("rects") > 0) & (box[2] - box[0] >= least) & (box[3] - box[1] >= least))


def color_mode(pixels: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent colour of 16 steps a channel, as the middle of its bucket from 0 to 1; pixels: r, g, b in 0..255."""
    bucket = [F.shiftright(F.col(c), 4).alias(c) for c in "rgb"]
    counts = pixels.select(*by, *bucket).groupBy(*by, "r", "g", "b").agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min_by(F.struct("r", "g", "b"), F.struct(-F.col("n"), "r", "g", "b")).alias("m"))
    return best.select(*by, F.array(*[(F.col(f"m.{c}") * 16 + 8) / 255.0 for c in "rgb"]).alias("color"))

"""Which engine made a program, from its strings; and ranges that hold addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Strings that give engines away, in the order in which ties are decided.
ENGINES = (
    ("Unity", ("unityplayer", "unityengine", "globalgamemanagers", "il2cpp", "mono")),
    ("Unreal Engine", ("unrealengine", "ue4", "ue5")),
    ("Ren'Py", ("renpy", "librenpython")),
    ("吉里吉里 (KiriKiri)", ("kirikiri", "tvp", "xp3")),
    ("RPG Maker MV/MZ", ("rgpmv", "pixi", "nwjs")),
    ("RPG Maker XP/VX/Ace", ("rgss",)),
    ("Godot", ("godot", "godotengine")),
    ("TyranoBuilder", ("tyrano",)),
    ("GameMaker", ("gamemaker", "yyg")),
    ("Electron", ("electron", "app.asar")),
    ("Wolf RPG Editor", ("wolf rpg", "wolflib")),
)


def signatures(spark: SparkSession) -> DataFrame:
    """rank, engine, sig."""
    return spark.createDataFrame([(i, name, s) for i, (name, sigs) in enumerate(ENGINES) for s in sigs], "rank int, engine string, sig string")


def detect_engine(programs: DataFrame, key: str, text: str) -> DataFrame:
    """key, engine, score: the engine with most of its strings in the text, the earlier one of equals. Rows without any
    have none. The dimension has a fixed few dozen rows, so it is broadcast."""
    sigs = F.broadcast(signatures(programs.sparkSession))
    hits = programs.select(key, F.lower(F.col(text)).alias("_t")).join(sigs, F.col("_t").contains(F.col("sig")))
    scores = hits.groupBy(key, "rank", "engine").agg(F.countDistinct("sig").alias("score"))
    return scores.groupBy(key).agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "engine")).alias("m")).select(key, "m.engine", F.col("m.score").cast("long").alias("score"))


def rank_programs(programs: DataFrame, most: int = 3) -> DataFrame:
    """The most likely main programs: those at the top first, then by size; a top-k."""
    return programs.orderBy(F.instr("path", "/") > 0, F.desc("size"), "path").limit(most)


def first_parsed(programs: DataFrame, parsed: str = "engine") -> DataFrame:
    """Of ranked programs the first that parsed."""
    return rank_programs(programs).filter(F.col(parsed).isNotNull()).orderBy(F.instr("path", "/") > 0, F.desc("size"), "path").limit(1)


def address_offsets(addresses: DataFrame, sections: DataFrame, by: str) -> DataFrame:
    """addresses (by, rva) with the file offset from the first section that holds them: va <= rva < va + raw_size.

    sections: by, ord, va, raw_ptr, raw_size. The ranges are joined within `by`; sections of a program are few.
    """
    inside = (F.col("rva") >= F.col("va")) & (F.col("rva") < F.col("va") + F.col("raw_size"))
    s = sections.withColumnRenamed(by, "_by")
    joined = addresses.join(s, (F.col(by) == F.col("_by")) & inside, "left")
    keys = [F.col(c) for c in addresses.columns]
    return joined.groupBy(*keys).agg(F.min_by(F.col("rva") - F.col("va") + F.col("raw_ptr"), "ord").alias("offset"))


def overlay_box(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page's paragraphs: an equi-join on document and page instead of a loop over both."""
    return pages.join(paragraphs, ["doc_id", "page"])


def kana_vote(sjis: Column, gbk: Column) -> Column:
    """The encoding under which a text has more kana; GBK if equal."""
    n = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[\\x{3040}-\\x{30FF}]"))
    return F.when(n(sjis) > n(gbk), "shift_jis").otherwise("gbk")

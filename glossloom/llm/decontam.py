"""Benchmark decontamination with a positional inverted index.

A benchmark item's windows are its runs of WINDOW consecutive words. A document has a window exactly where the same
words follow each other, and nearly where a run of at most as many words holds NEAR_SHARE of the window's different words
in any order; k, the number that may be missing, is 2 for 13 words.

1. The items' terms are counted over all documents. For each window the k + 1 rarest are its anchors: of any near match
   at most k terms are missing, so an anchor is in it. Terms that no document has count among the k + 1.
2. Each token that is an anchor looks at the words in its reach, as a mask of 64 bits of which each word sets one. Where
   no window of the anchor can be near by its mask, nothing is stored. Elsewhere the tokens in reach go into the index:
   postings of term, document and position.
3. Matches are intersections of the index's lists. Candidates come from the anchors' own lists. An exact match is a
   document, a window and a shift at which the lists of all of the window's terms meet, each moved by the term's offset;
   the shifts come from the rarest anchor's list. A near match is a run in the merged lists of a window's terms in a document
   with enough different terms; lists are cut into stretches of STRETCH positions, so none grows with a document.

Words are their XXH64 hashes from the index on: two words count as equal if these are (one pair in 2^64).

Documents are cut into chunks of CHUNK words and what stands around, so what goes along with a token is bounded. Neither
documents nor texts are shuffled; what moves are postings. Everything runs in DataFrame operations. Items go in blocks of
about BLOCK_WORDS words, so what a block broadcasts (its terms, anchors and words) is bounded; each block reads the
documents twice, once to count and once to post.

Documents are told apart by the MD5 of their text: copies share their postings and matches, which join back to each row.

Cases: null and empty texts have no words; items without words have no windows; items with equal words are searched once
and all reported; repeated documents and null or repeated ids each get their row; empty tables on either side give no
hits; very long texts are read whole; other columns of either table don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossloom.llm.common import lower_ascii, written

WINDOW = 13
NEAR_SHARE = 0.8
BLOCK_WORDS = 200_000
CHUNK = 64
STRETCH = 256
#: What stands between words; A-Z counts as a word's, as words are put in lower case after the split.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Closes each document's list of words, so that each document has a posting. No word is equal to it.
LAST = "\x00"


# Arrays that come from a text are exploded by the outer form only: before the other one, Spark filters the scan for arrays
# that aren't empty, and for that splits each text several times more.


def with_words(df: DataFrame, text: str, *carry: Column) -> DataFrame:
    """carry, ascii and words: the words of the text; those of texts with other than ASCII characters aren't in lower case yet."""
    plain = F.coalesce(F.col(text), F.lit(""))
    df = df.select(*carry, plain.alias("_text"), (F.octet_length(plain) == F.char_length(plain)).alias("ascii"))
    own = [c for c in df.columns if c != "_text"]
    # whole texts are faster put in lower case at once, but only those of ASCII come out the same
    df = df.select(*own, F.split(F.when(F.col("ascii"), F.lower("_text")).otherwise(F.col("_text")), BETWEEN).alias("_w"))
    lead = F.when(F.element_at("_w", 1) == "", 1).otherwise(0)
    tail = F.when((F.size("_w") > 1) & (F.element_at("_w", -1) == ""), 1).otherwise(0)
    return df.select(*own, F.slice("_w", lead + 1, F.size("_w") - lead - tail).alias("words"))


def term(word: Column) -> Column:
    return F.when(F.col("ascii"), F.xxhash64(word)).otherwise(F.xxhash64(lower_ascii(word)))


def bit(hashed: Column) -> Column:
    """One of 64 bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(F.lit(63)).cast("int"))


def bits(hashed: Column) -> Column:
    """The bits of an array of terms. Never null: else Spark asks for that of all tokens, and works it out for each."""
    return F.coalesce(F.aggregate(hashed, F.lit(0).cast("long"), lambda b, h: b.bitwiseOR(bit(h))), F.lit(0).cast("long"))


def item_groups(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """One row for each different sequence of words: grp, terms (of the words, in order), item_ids (as strings)."""
    got = with_words(items, text, F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item")).filter(F.size("words") > 0)
    got = got.select("item", F.transform("words", lower_ascii).alias("words")).groupBy("words").agg(F.collect_set("item").alias("item_ids"))
    return got.select(F.md5(F.array_join("words", " ")).alias("grp"), F.transform("words", lambda w: F.xxhash64(w)).alias("terms"), "item_ids")


def needed(kinds: Column, near_share: float) -> Column:
    """How many of a window's different words a near match shares."""
    return F.greatest(F.lit(1), F.ceil(kinds * F.lit(near_share) - F.lit(1e-9))).cast("int")


def find_anchors(docs: DataFrame, groups: DataFrame, window: int, near_share: float) -> DataFrame:
    """The windows' rarest terms: grp, start (of the window), len, term, off (of the term, in the window), first (whether it
    is the rarest), mask (the window's bits), need (different words of a near match) and lacks (how many it may lack)."""
    length = F.least(F.lit(window), F.size("terms"))
    spans = groups.select("grp", "terms", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("terms") - length)).alias("start"))
    spans = spans.select("grp", "start", "len", F.slice("terms", F.col("start") + 1, F.col("len")).alias("own"))
    terms = spans.select("grp", "start", F.posexplode("own").alias("off", "term"))
    counted = docs.select("ascii", F.explode_outer("words").alias("w")).select(term(F.col("w")).alias("term"))
    # the block's terms: at most BLOCK_WORDS and a group's words
    counted = counted.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    # a term that comes twice in a window counts once; those that no document has are the rarest
    ranked = terms.join(counted, "term", "left").groupBy("grp", "start", "term").agg(F.min("off").alias("off"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    of_window = Window.partitionBy("grp", "start")
    ranked = ranked.withColumn("rank", F.row_number().over(of_window.orderBy("n", "off"))).withColumn("kinds", F.count("*").over(of_window))
    ranked = ranked.withColumn("need", needed(F.col("kinds"), near_share)).filter((F.col("rank") <= F.col("kinds") - F.col("need") + 1) & (F.col("n") > 0))
    masks = spans.select("grp", "start", "len", bits(F.col("own")).alias("mask"))
    return ranked.join(masks, ["grp", "start"]).select("grp", "start", "len", "term", "off", (F.col("rank") == 1).alias("first"), "mask", "need", (F.col("kinds") - F.col("need")).alias("lacks"))


def may_match() -> Column:
    """A bit of the window that nothing in reach sets is at least one word that lacks."""
    return F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not(F.col("held")))) <= F.col("lacks")


def places(docs: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """Where anchors stand and may be in a match: doc_id, key, pos, term, held, begin and around (the terms in reach, from
    position begin on). And for each document a row with n_words, its length; others have null there."""
    reach = window - 1
    closing = F.xxhash64(F.lit(LAST))
    h = F.when(F.col("ascii"), F.transform("words", lambda w: F.xxhash64(w))).otherwise(F.transform("words", lambda w: F.xxhash64(lower_ascii(w))))
    d = docs.select("doc_id", "key", F.array_append(h, closing).alias("h"))
    lo = lambda i: F.greatest(i - reach, F.lit(0))
    chunk = lambda i: F.struct(i.alias("at"), F.slice("h", lo(i) + 1, i + CHUNK + reach - lo(i)).alias("near"))
    d = d.select("doc_id", "key", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("h") - 1, F.lit(CHUNK)), chunk)).alias("c")).select("doc_id", "key", "c.at", "c.near")
    d = d.select("doc_id", "key", "at", "near", F.posexplode_outer(F.slice("near", F.col("at") - lo(F.col("at")) + 1, CHUNK)).alias("i", "term"))
    none = docs.sparkSession.range(1)
    wanted = anchors.select("term").distinct().unionByName(none.select(closing.alias("term")))
    d = d.join(F.broadcast(wanted), "term", "left_semi").withColumn("pos", F.col("at") + F.col("i"))
    begin = lo(F.col("pos"))
    d = d.select("doc_id", "key", "term", "pos", begin.alias("begin"), F.slice("near", begin - lo(F.col("at")) + 1, F.col("pos") + reach + 1 - begin).alias("around")).withColumn("held", bits(F.col("around")))
    masks = anchors.select("term", "mask", "lacks").distinct().unionByName(none.select(closing.alias("term"), F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("lacks")))
    masks = masks.withColumnRenamed("term", "t")
    d = d.join(F.broadcast(masks), (F.col("term") == F.col("t")) & may_match(), "left_semi")
    return d.select("doc_id", "key", "pos", "term", "held", "begin", "around", F.when(F.col("term") == closing, F.col("pos")).cast("long").alias("n_words"))


def matches(found: DataFrame, anchors: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact occurrences (key, grp, start, end, len) and spans of near ones (key, grp, start, end), in document words."""
    spots = found.filter(F.col("n_words").isNull()).dropDuplicates(["key", "pos"])
    terms = groups.select(F.explode("terms").alias("term")).distinct()
    index = spots.select("key", F.posexplode("around").alias("i", "term"), "begin").select("key", (F.col("begin") + F.col("i")).alias("pos"), "term")
    index = written(index.join(F.broadcast(terms), "term", "left_semi").distinct(), "postings")
    a = anchors.withColumnRenamed("term", "t")
    hits = spots.select("key", "pos", "term", "held").join(F.broadcast(a), (F.col("term") == F.col("t")) & may_match())
    of_grp = groups.select(F.col("grp").alias("g"), "terms")
    own = F.slice("terms", F.col("start") + 1, F.col("len"))
    # the lists of all terms of a window, each moved by its offset, meet at shifts of the rarest one's list
    exact = hits.filter(F.col("first") & (F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not(F.col("held")))) == 0) & (F.col("pos") >= F.col("off")))
    exact = exact.select("key", "grp", F.col("start").alias("win"), "start", "len", (F.col("pos") - F.col("off")).alias("shift"))
    exact = exact.join(F.broadcast(of_grp), F.col("grp") == F.col("g")).select("key", "grp", "win", "len", "shift", F.posexplode(own).alias("off", "term"))
    exact = exact.select("key", "grp", "win", "len", "shift", "term", (F.col("shift") + F.col("off")).alias("pos")).join(index, ["key", "pos", "term"])
    exact = exact.groupBy("key", "grp", "win", "shift").agg(F.count("*").alias("n"), F.first("len").alias("len")).filter(F.col("n") == F.col("len"))
    exact = exact.select("key", "grp", F.col("shift").alias("start"), (F.col("shift") + F.col("len")).alias("end"), "len")
    # near: the merged lists of a window's different terms, in stretches that overlap by what a run may reach over
    near = hits.select("key", "grp", "start", "len", "need").distinct().join(F.broadcast(of_grp), F.col("grp") == F.col("g"))
    near = near.select("key", "grp", "start", "len", "need", F.explode(F.array_distinct(own)).alias("term")).join(index, ["key", "term"])
    earliest = F.greatest(F.col("pos") - F.col("len") + 1, F.lit(0))
    near = near.withColumn("part", F.explode(F.sequence(F.floor(earliest / STRETCH), F.floor(F.col("pos") / STRETCH))))
    near = near.groupBy("key", "grp", "start", "part").agg(F.first("len").alias("len"), F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("list")).filter(F.size("list") >= F.col("need"))
    # a run's postings are at most len of those from its first on
    run = lambda i: F.filter(F.slice("list", i + 1, F.col("len")), lambda p: p["pos"] < F.element_at("list", i + 1)["pos"] + F.col("len"))
    runs = F.transform(F.sequence(F.lit(0), F.size("list") - F.col("need")), lambda i: run(i))
    runs = F.filter(runs, lambda r: F.size(F.array_distinct(F.transform(r, lambda p: p["term"]))) >= F.col("need"))
    near = near.select("key", "grp", F.explode(runs).alias("r")).select("key", "grp", F.element_at("r", 1)["pos"].alias("start"), (F.element_at("r", -1)["pos"] + 1).alias("end"))
    return exact, near.distinct()


def covered(spans: DataFrame, by: list[str]) -> DataFrame:
    """spans (start, end) with seen: where the earlier ones of the same group end."""
    earlier = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("seen", F.coalesce(F.max("end").over(earlier), F.lit(0)))


def n_covered(spans: DataFrame, name: str) -> DataFrame:
    """For each key, the words inside any span: each counts from where the earlier ones end."""
    spans = covered(spans.groupBy("key", "start").agg(F.max("end").alias("end")), ["key"])
    return spans.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).cast("long").alias(name))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, near_share: float = NEAR_SHARE) -> DataFrame:
    """One row for each document: key (MD5 of its text, in hex), doc_id, n_words, n_hit (words inside occurrences), items (ids of
    items with occurring windows, sorted as strings), n_near (items with a near or exact window), n_near_hit (words inside
    near or exact ones), near (of each such item the spans of words where they are, overlapping ones as one: item, start,
    end; sorted), whole (whether a window of full length occurs)."""
    docs = with_words(docs, text, F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"))
    groups = written(item_groups(items, item_id, item_text), "items")
    n_words = groups.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = -(-n_words // BLOCK_WORDS) or 1
    rows, exact, every = None, None, None
    for block in range(n_blocks):
        some = groups.filter(F.pmod(F.xxhash64("grp"), F.lit(n_blocks)) == block) if n_blocks > 1 else groups
        anchors = written(find_anchors(docs, some, window, near_share), "anchors")
        found = written(places(docs, anchors, window), "places")
        rows = rows if rows is not None else found.filter(F.col("n_words").isNotNull()).select("doc_id", "key", "n_words")
        got = [written(x, "matches") for x in matches(found, anchors, some)]
        exact, every = got if exact is None else (exact.unionByName(got[0]), every.unionByName(got[1]))
    every = every.unionByName(exact.drop("len"))
    # overlapping spans of an item are one
    every = covered(every.groupBy("key", "grp", "start").agg(F.max("end").alias("end")), ["key", "grp"])
    every = every.withColumn("part", F.sum(F.when(F.col("start") >= F.col("seen"), 1).otherwise(0)).over(Window.partitionBy("key", "grp").orderBy("start")))
    every = every.groupBy("key", "grp", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ids = groups.select("grp", "item_ids")
    where = every.join(ids, "grp").select("key", F.explode("item_ids").alias("item"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    where = where.groupBy("key").agg(F.count_distinct("item").alias("n_near"), F.sort_array(F.collect_list(F.struct("item", "start", "end"))).alias("near"))
    occurring = exact.groupBy("key", "grp").agg(F.max(F.col("len") == window).alias("whole")).join(ids, "grp")
    occurring = occurring.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("items"), F.max("whole").alias("whole"))
    result = n_covered(every, "n_near_hit").join(where, "key", "full").join(n_covered(exact, "n_hit"), "key", "full").join(occurring, "key", "full")
    # as a table of its own: its rows can then be joined to the copies of a hot text in parts
    result = written(result.withColumnRenamed("key", "k"), "result")
    return rows.join(result, F.col("key") == F.col("k"), "left").select(
        "doc_id",
        F.lower(F.hex("key")).alias("key"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("n_near_hit", F.lit(0)).alias("n_near_hit"),
        F.coalesce("near", F.array().cast("array<struct<item:string,start:int,end:int>>")).alias("near"),
        F.coalesce("whole", F.lit(False)).alias("whole"),
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are inside occurrences."""
    return (n_hit > 0) & (20 * n_hit >= n_words)

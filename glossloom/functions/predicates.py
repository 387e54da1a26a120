"""Which strings need a translation, and which translations are valid. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossloom.functions.text import HAN, KANA, WS, han_count, kana_hangul_count, trim

# Patterns that decide which strings are units.
URL = "(?i)^(?:https?://|www\\.|ftp:|//|[0-9A-Za-z_]+:\\\\|/)"
JUNK = f"^(?:[0-9.,%+*/=<>:;|!?()\\[\\]{{}}\"'`~\\^#$@&-]|{WS})+\\z"
JUNK_OR_EMPTY = JUNK.replace(")+\\z", ")*\\z")
CHINESE_MARKS = "[，。！？；：「」“”、《》【】]"
CHINESE_WORDS = "[的吧了是在这那吗呢和被与就都还很从到对]"
PDF_NOISE = "^(?:[ .,%+*/=<>:;|!?()\\[\\]{}'\"\\\\`~\\^#$@&-]+|[\\p{Nd}\\x{B2}\\x{B3}\\x{B9}\\x{2070}\\x{2074}-\\x{2079}\\x{2080}-\\x{2089}]+)\\z"
BAD_RESULT = "(?i)PLEASE SELECT|QUERY LIMIT|MYMEMORY WARNING|INVALID REQUEST|TOO MANY"

LONGEST = 800
EMPTY_RESULT, PROVIDER_MESSAGE, ECHO = "empty result", "provider message", "same as the original"


def is_chinese(t: Column) -> Column:
    """Han without kana, and a Chinese mark, a Chinese function word or at least four Han characters."""
    return F.when(han_count(t) == 0, False).when(t.rlike(KANA), False).when(t.rlike(CHINESE_MARKS) | t.rlike(CHINESE_WORDS), True).otherwise(han_count(t) >= 4)


def plain(s: Column, trimmed: bool) -> Column:
    """The text that a decision is about. It stands in an expression many times over, so callers that decide on many lines
    put the trimmed text in a column and say so."""
    s = F.coalesce(s, F.lit(""))
    return s if trimmed else trim(s)


def rejection(s: Column, target: str = "zh-CN", skip_pure_han: bool | Column = False, trimmed: bool = False) -> Column:
    """Why a line is no unit: empty, long, url, junk, spaces, target; null if it is one."""
    t = plain(s, trimmed)
    out = F.when(t == "", "empty").when(F.length(t) > LONGEST, "long").when(t.rlike(URL), "url").when(t.rlike(JUNK), "junk").when(t.rlike(f"{WS}{{3}}"), "spaces")
    if target.startswith("zh"):
        skip = skip_pure_han if isinstance(skip_pure_han, Column) else F.lit(skip_pure_han)
        pure = skip & (han_count(t) > 0) & (kana_hangul_count(t) == 0) & (han_count(t) / F.greatest(F.length(t), F.lit(1)) > 0.3)
        out = out.when(is_chinese(t) | pure, "target")
    return out


def is_translatable(s: Column, target: str = "zh-CN", skip_pure_han: bool | Column = False, trimmed: bool = False) -> Column:
    """Lines of text files."""
    return rejection(s, target, skip_pure_han, trimmed).isNull()


def is_translatable_doc(s: Column, target: str = "zh-CN", trimmed: bool = False) -> Column:
    """Text of documents: without the rules for addresses and runs of spaces."""
    t = plain(s, trimmed)
    kept = (t != "") & (F.length(t) <= LONGEST) & ~t.rlike(JUNK)
    return kept & ~is_chinese(t) if target.startswith("zh") else kept


def is_pdf_noise(t: Column) -> Column:
    t = F.coalesce(t, F.lit(""))
    return (t == "") | (F.length(t) > LONGEST) | t.rlike(PDF_NOISE)


def is_image_junk(t: Column) -> Column:
    t = F.coalesce(t, F.lit(""))
    return (t == "") | t.rlike(JUNK_OR_EMPTY)


def validate(original: Column, result: Column) -> Column:
    """struct(ok, error): a blank result, a provider's message and an echo of the original are invalid."""
    r = F.coalesce(result, F.lit(""))
    o, low = F.lower(trim(F.coalesce(original, F.lit("")))), F.lower(trim(r))
    echo = (F.length(o) >= 3) & (o == low) & o.rlike(f"[a-z]|{HAN}")
    error = F.when(low == "", EMPTY_RESULT).when(r.rlike(BAD_RESULT), F.concat(F.lit(f"{PROVIDER_MESSAGE}: "), F.substring(r, 1, 50))).when(echo, ECHO)
    return F.struct(error.isNull().alias("ok"), F.coalesce(error, F.lit("")).alias("error"))

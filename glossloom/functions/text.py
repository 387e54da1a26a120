"""Scalar text functions as Column expressions. Patterns are valid in Java's regex engine and in RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text formats see it: Java's \s has only the ASCII part of it.
WS = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
#: The same characters as a string.
WHITE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
HAN = "[\\x{4E00}-\\x{9FFF}]"
KANA = "[\\x{3040}-\\x{30FF}\\x{FF61}-\\x{FF9F}]"
KANA_HANGUL = "[\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"
CJK_WIDE = "[\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]"
DIGITS36 = "0123456789abcdefghijklmnopqrstuvwxyz"
#: Letters with a capital of one character for which Spark's upper gives several: ß, and Greek letters with an iota below.
CAPITALS = {"ß": "\u1e9e", "\u1fb3": "\u1fbc", "\u1fc3": "\u1fcc", "\u1ff3": "\u1ffc"} | {chr(c): chr(c + 8) for a in (0x1F80, 0x1F90, 0x1FA0) for c in range(a, a + 8)}
#: Letters whose capitals came with Unicode 16: upper has them or not by the version of its library.
NEW_CAPITALS = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITE))


def capital(ch: Column) -> Column:
    """One character's capital as one character. What has none stays as it is (ŉ and ligatures have several), and so do
    letters whose capital came with Unicode 16."""
    up = F.upper(ch)
    return F.when((F.length(up) == 1) & ~ch.isin(*NEW_CAPITALS), up).otherwise(F.translate(ch, "".join(CAPITALS), "".join(CAPITALS.values())))


def han_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(HAN))


def kana_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit("[\\x{3040}-\\x{30FF}]"))


def kana_hangul_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(KANA_HANGUL))


def is_cjk(ch: Column) -> Column:
    """Han, CJK punctuation or full-width form; kana and hangul aren't counted."""
    return ch.rlike(f"^{CJK_WIDE}\\z")


def ext_of(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, "\\."), -1))).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def djb2(s: Column) -> Column:
    """h * 33 + c modulo 2^32 over the characters from 5381, in base 36. Equal to the UTF-16 form in the basic plane."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)) % F.lit(4294967296))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_json(s: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def decode_escapes(s: Column) -> Column:
    """Unicode escapes, then quotes, then backslashes. Runs of escapes decode together, so pairs of surrogates work."""
    parts = F.regexp_extract_all(s, F.lit("(?:\\\\u[0-9a-fA-F]{4})+|[^\\\\]+|\\\\"), F.lit(0))
    one = lambda p: F.when(F.length(p) >= 6, F.when(p.startswith("\\u"), F.decode(F.unhex(F.replace(p, F.lit("\\u"), F.lit(""))), "UTF-16BE")).otherwise(p)).otherwise(p)
    s = F.when(F.instr(s, "\\u") > 0, F.array_join(F.transform(parts, one), "")).otherwise(s)
    for a, b in (('\\"', '"'), ("\\'", "'"), ("\\\\", "\\")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def fmt_bytes(n: Column) -> Column:
    n = n.cast("double")
    size = lambda unit, digits, name: F.concat(F.format_string(f"%.{digits}f", n / unit), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1048576, size(1024, 1, "KB")).when(n < 1073741824, size(1048576, 1, "MB")).otherwise(size(1073741824, 2, "GB"))


def fmt_time(ms: Column) -> Column:
    s = F.floor(ms / 1000 + 0.5).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m"), (s % 60).cast("string"), F.lit("s")))


def replace_nth(s: Column, old: Column, new: Column, n: Column) -> Column:
    """s with occurrence n (from 0; occurrences may overlap) of old replaced; s if there is none, or old is empty."""
    steps = F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int"))
    found = lambda p: F.coalesce(F.nullif(F.call_function("locate", old, s, p + 1), F.lit(0)), F.lit(-1))
    at = F.aggregate(steps, F.lit(0), lambda p, i: F.when((p < 0) | (F.length(old) == 0), F.lit(-1)).otherwise(found(p)))
    return F.when(at < 1, s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.length(old), F.length(s))))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def contrast_color(r: Column, g: Column, b: Column) -> Column:
    """Near black on light backgrounds, white on dark ones."""
    shade = F.when(luminance(r, g, b) >= 0.55, F.lit(0.05)).otherwise(F.lit(1.0))
    return F.array(shade, shade, shade)


def pick_background(inner: Column, page: Column) -> Column:
    """The page's color, unless the box differs from it by 0.9 or more in sum."""
    diff = F.aggregate(F.zip_with(inner, page, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: s + d)
    return F.when(diff < 0.9, page).otherwise(inner)


def px_to_pt(px: Column, dpi: int = 150) -> Column:
    return px * 72.0 / dpi


# What each provider calls our language codes, and what it gets for others.
LANGUAGE_CODES = {
    "baidu": {"zh-CN": "zh", "zh-TW": "cht", "en": "en", "ja": "jp"},
    "deepl": {"zh-CN": "ZH-HANS", "zh-TW": "ZH-HANT", "en": "EN-US", "ja": "JA"},
    "openai": {"zh-CN": "简体中文", "zh-TW": "繁体中文", "en": "英语", "ja": "日语"},
}
OTHER_LANGUAGE = {"baidu": "zh", "deepl": "ZH-HANS"}


def language_code(lang: Column, provider: str) -> Column:
    """The provider's code for the language; its default or the code itself where there is none."""
    known = LANGUAGE_CODES.get(provider)
    if not known:
        return lang
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, lang), F.lit(OTHER_LANGUAGE[provider]) if provider in OTHER_LANGUAGE else lang)

"""Text functions as Spark columns. They follow Python's string semantics (Unicode white space, all line ends, code points)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space and the four separators that Python counts too.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CJK = r"[一-龥]"
#: Characters that no keyword may hold.
STOPS = "的了是在和有与一这个为中对上以到其都也被从及等将但不已就很再次并该些那之所因由于如果只还另外除"
FIELD_WORDS = ("HYPERLINK", "PAGEREF", "MERGEFORMAT", "TOC", "EMBED", r"Visio\.Drawing\.\d+", r"Toc\d+", "FORMTEXT", "MACROBUTTON")


def strip(t: Column) -> Column:
    return F.btrim(t, F.lit(_BLANKS))


def rstrip(t: Column) -> Column:
    return F.rtrim(t, F.lit(_BLANKS))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used: array functions aren't part of generated code, which would see to that."""
    return F.get(F.transform(F.array(value), use), 0)


def lines(t: Column) -> Column:
    """All lines; no empty one after a final line end, none of an empty text."""
    return bind(F.split(t, _LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def count_of(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern)).cast("long")


def chars_of(t: Column, kinds: str) -> Column:
    """Characters of a class; what lies between them is taken out a run at a time."""
    return F.length(F.regexp_replace(t, f"[^{kinds}]+", "")).cast("long")


def words(t: Column) -> Column:
    return count_of(t, r"(?U)[^\s\x1c-\x1f]+")


def size(a: Column) -> Column:
    return F.size(a).cast("long")


def normalize(t: Column) -> Column:
    """NUL to blank, no blanks at line ends, at most one empty line in a row, none around."""
    t = F.replace(t, F.lit("\x00"), F.lit(" "))
    joined = F.array_join(F.transform(lines(t), rstrip), "\n")
    return strip(F.regexp_replace(joined, r"\n\n\n+", "\n\n"))


def signal(t: Column) -> Column:
    return chars_of(t, "一-鿿A-Za-z0-9")


def meaningful(normal: Column, min_signal: Column | int) -> Column:
    """Of a normalized text: enough letters or digits, or 20 characters."""
    least = min_signal if isinstance(min_signal, Column) else F.lit(min_signal)
    return (normal != "") & ((signal(normal) >= least) | (F.length(normal) >= 20))


def ocr_score(normal: Column) -> Column:
    """Of a normalized text; null where it is empty, which ranks below all."""
    filled = size(F.filter(lines(normal), lambda x: strip(x) != ""))
    score = (
        chars_of(normal, "一-鿿") * 2.0 + chars_of(normal, "A-Za-z") + chars_of(normal, r"\p{Nd}") * 0.8 + filled * 3.0
        - count_of(normal, "�") * 15.0 - count_of(normal, r"[_=~\-]{4,}") * 10.0
    )
    return F.when(normal != "", score)


def clean_legacy(t: Column) -> Column:
    """Text of old word-processor pieces without control characters and field codes."""
    t = F.translate(t, "\r\x0b\x0c\x07\xa0\x13\x14\x15", "\n\n\n\t ")
    t = F.regexp_replace(t, r"[\x7f-\x9f\x00-\x08\x0e-\x1f]+", "")
    t = F.regexp_replace(t, "|".join(FIELD_WORDS), " ")
    t = F.regexp_replace(t, r"[ \t]{3,}", "  ")
    t = F.regexp_replace(t, r"\n[ \t]+", "\n")
    return F.regexp_replace(t, r"\n\n\n+", "\n\n")


def good_line(line: Column) -> Column:
    """Of a stripped line: varied and textual enough."""
    n = F.length(line)
    kinds = F.size(F.array_distinct(F.split(line, "")))
    ratio = chars_of(line, r"一-鿿a-zA-Z\p{Nd}") / n
    dull = (kinds < n * 0.25) & (n > 10)
    return (n > 0) & ~dull & ((ratio > 0.5) | ((n > 10) & (ratio > 0.35)))


def good_lines(t: Column) -> Column:
    kept = F.filter(F.transform(F.split(t, "\n", -1), strip), lambda x: F.when(x == "", False).otherwise(good_line(x)))
    return strip(F.array_join(kept, "\n"))


def paragraphs(t: Column, by: str) -> Column:
    """Pieces between ``by`` (a regular expression) that aren't blank."""
    return size(F.filter(F.split(t, by, -1), lambda x: strip(x) != ""))


def collapse_adjacent(a: Column) -> Column:
    """An array without entries equal to the one before."""
    before = F.concat(F.array(F.lit(None).cast("string")), a)  # one longer; its last has no partner
    return F.filter(F.zip_with(a, before, lambda x, y: F.when(y.isNull() | (x != y), x)), lambda x: x.isNotNull())


def tail(t: Column, limit: int) -> Column:
    return F.right(strip(t), F.lit(limit))


def heading(style: Column, t: Column) -> Column:
    """A paragraph by its style: headings get as many # as their level, 1 where it has no number."""
    last = F.element_at(F.split(strip(style), r"\s+"), -1)
    level = F.when(last.rlike(r"^\p{Nd}+$"), last).otherwise(F.lit("1")).cast("int")
    return F.when(F.contains(style, F.lit("Heading")), F.concat(F.lit("\n"), F.repeat(F.lit("#"), level), F.lit(" "), t)).otherwise(t)


def log_level(line: Column) -> Column:
    found = F.regexp_extract(line, r"\[(DEBUG|INFO|ERROR|WARNING)\]", 1)
    return F.when(found == "", "INFO").when(found == "WARNING", "WARN").otherwise(found)


def path_name(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def path_suffix(p: Column) -> Column:
    """With its dot and as written; empty for none and for names that only begin with a dot."""
    return F.regexp_extract(path_name(p), r"^.+(\.[^.]+)$", 1)


def path_stem(p: Column) -> Column:
    name = path_name(p)
    return F.substring(name, F.lit(1), F.length(name) - F.length(path_suffix(p)))


def html_escape(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def or_dash(t: Column) -> Column:
    return F.when(t.isNull() | (t == ""), "-").otherwise(html_escape(t))


def number(v: Column) -> Column:
    """Thousands marked; two decimals unless integral."""
    return F.when(v == F.floor(v), F.format_number(v.cast("long"), 0)).otherwise(F.format_number(v, 2))


def one_line(t: Column, limit: int) -> Column:
    return F.substring(F.replace(t, F.lit("\n"), F.lit(" ")), 1, limit)

"""Line and text predicates as Column functions: no shuffle, no Python.

All are null-safe in the sense that a null text gives a null result for text functions and
false (or 0) for predicates and counts. Predicates clean the text first; ``clean=True`` says
that it is clean already, as the text of a line table is, so that a plan with many predicates
over one column cleans nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Patterns and word lists that decide what counts as a heading.
NUMBERS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
NUMBERS_TO_12 = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
ROMAN = "[ivxlcdm]+"
FRONT_WORDS = "foreword|preface|introduction|contents|table of contents|copyright|dedication|translator'?s note|note on the text|acknowledg(?:e)?ments?"
BACK_WORDS = "afterword|appendix|appendices|notes|endnotes|bibliography|glossary|about the author|about this book|discussion questions|reading group guide|credits|index"
BAD_PREFIXES = ("copyright", "isbn", "library of congress", "printed in", "published by", "summary:")
DOMAIN = r"(?i)\b[a-z0-9.-]+\.(com|net|org|ru|io|co)\b"
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*"
TAIL = r"(?:\b(?:\s*[:.-]\s*.*|\s+.*)?)?"
STRUCTURED = rf"(?i)^(?:(?:chapter|section|part|book|act|scene)\s+(?:\d+|{ROMAN}|{NUMBERS}){TAIL}|(?:prologue|epilogue|interlude)(?:\b(?:\s*[:.-]\s*.*)?)?)$"
DASHED = rf"(?i)^[\s\-–—]*chapter\s+(?:\d+|{ROMAN}|{NUMBERS})[\s\-–—]*$"
SECTION = rf"(?i)^(?:part|book|act)\s+(?:\d+|{ROMAN}|{NUMBERS_TO_12}){TAIL}$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def strip(c: Column, chars: str = r"\s") -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"(?U)^[{chars}]+", ""), rf"(?U)[{chars}]+$", "")


def _replaced(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def _plain(c: Column) -> Column:
    """No NBSP and no soft hyphens (``translate`` would look up every character)."""
    return _replaced(_replaced(c, "\u00a0", " "), "\u00ad", "")


def normalize_whitespace(c: Column | str) -> Column:
    c = _replaced(_replaced(_c(c), "\r\n", "\n"), "\r", "\n")
    return strip(F.regexp_replace(_plain(c), r" *[\t\f\x0B][ \t\f\x0B]*| {2,}", " "))


def clean_line(c: Column | str) -> Column:
    """Any white space, NBSP too, to single spaces; no soft hyphens; trimmed."""
    return F.trim(F.regexp_replace(_plain(_c(c)), r"(?U)\s+", " "))


def _cleaned(c: Column | str, clean: bool) -> Column:
    return _c(c) if clean else clean_line(c)


def counting_key(c: Column | str, clean: bool = False) -> Column:
    return strip(F.lower(_cleaned(c, clean)), " \\-—–_")


def is_page_number(c: Column | str, clean: bool = False) -> Column:
    t = _cleaned(c, clean)
    return F.coalesce(t == "", F.lit(True)) | matches(t, rf"(?i)^(?:(?:page\s+)?\d{{1,4}}|(?:page\s+)?\d{{1,4}}\s+(?:of|/)\s+\d{{1,4}}|{ROMAN})$")


def is_numeric_only(c: Column | str, clean: bool = False, digits: int = 3) -> Column:
    t = F.rtrim(F.regexp_replace(_cleaned(c, clean), r"[.)]+$", ""))
    return matches(t, rf"(?i)^(?:\d{{1,{digits}}}|{ROMAN})$")


def is_all_caps(c: Column | str, clean: bool = False) -> Column:
    t = _cleaned(c, clean)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return F.coalesce((letters > 0) & (F.regexp_count(t, F.lit(r"\p{Lu}")) >= letters * 0.8), F.lit(False))


def is_title_case(c: Column | str, clean: bool = False) -> Column:
    words = F.filter(F.split(_cleaned(c, clean), " "), lambda w: w.rlike("[A-Za-z]"))
    good = F.filter(words, lambda w: w.rlike(r"^[^\p{L}\p{N}]*\p{Lu}"))
    return F.coalesce((F.size(words) > 0) & (F.size(good) >= F.size(words) * 0.7), F.lit(False))


def count_words(c: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_c(c), F.lit(WORD)), F.lit(0)).cast("long")


def _matter(c: Column | str, words: str, clean: bool) -> Column:
    t = _cleaned(c, clean)
    return matches(t, rf"(?i)^(?:{words})\b") & ((count_words(t) <= 4) | is_all_caps(t, True) | is_title_case(t, True))


def is_front_heading(c: Column | str, clean: bool = False) -> Column:
    return _matter(c, FRONT_WORDS, clean)


def is_back_heading(c: Column | str, clean: bool = False) -> Column:
    return _matter(c, BACK_WORDS, clean)


def is_section_marker(c: Column | str, clean: bool = False) -> Column:
    return matches(_cleaned(c, clean), SECTION)


def is_structured_heading(c: Column | str, clean: bool = False) -> Column:
    t = _cleaned(c, clean)
    return matches(t, STRUCTURED) | matches(t, DASHED)


def prefixed_title(section: Column, title: Column) -> Column:
    wanted = section.isNotNull() & (section != "") & matches(title, r"(?i)^chapter\b")
    return F.when(wanted, F.concat_ws(" - ", section, title)).otherwise(title)


def matches_optional(c: Column, pattern: str | None) -> Column:
    """Search by a user's pattern, of Java's dialect; ValueError if it does not compile; none
    matches nothing."""
    if not pattern:
        return F.lit(False)
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # of the gateway, around Java's
        raise ValueError(f"invalid pattern {pattern!r}") from e
    return matches(c, f"(?i){pattern}")


def has_bad_prefix(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^(?:" + "|".join(BAD_PREFIXES) + ")"), F.lit(False))


def is_heading_line(c: Column | str, clean: bool = False, digits: int = 3) -> Column:
    t = _cleaned(c, clean)
    words = F.size(F.split(t, " "))
    fits = (F.length(t) > 0) & (F.length(t) <= 120) & (words <= 16) & ~has_bad_prefix(t)
    structured, numeric = is_structured_heading(t, True), is_numeric_only(t, True, digits)
    sentence = matches(t, r"[.?!;]$") & ~structured & ~numeric & (words > 8) & ~is_all_caps(t, True)
    kinds = numeric | structured | is_front_heading(t, True) | is_back_heading(t, True) | is_section_marker(t, True) | is_all_caps(t, True) | is_title_case(t, True)
    return F.coalesce(fits & ~sentence & kinds, F.lit(False))


def is_body_like(c: Column | str, clean: bool = False) -> Column:
    t = _cleaned(c, clean)
    return F.coalesce((F.length(t) >= 80) | ((F.size(F.split(t, " ")) >= 14) & matches(t, r'[.,;:?!"]$')), F.lit(False))


def candidate_kind(c: Column | str, clean: bool = False) -> Column:
    return F.when(is_front_heading(c, clean), "front").when(is_back_heading(c, clean), "back").otherwise("chapter")


def excerpt(c: Column | str, chars: int = 900, clean: bool = False) -> Column:
    t = _cleaned(c, clean)
    cut = F.regexp_replace(F.substring(t, 1, chars), " [^ ]*$", "")
    return F.when(F.length(t) <= chars, t).otherwise(F.concat(F.rtrim(cut), F.lit("...")))


def parse_flag(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_c(c))).isin("1", "true", "on", "yes"), F.lit(False))


def detect_language(c: Column | str, chars: int = 2000, script: str = r"[Ѐ-ӿ]", label: str = "ru", other: str = "en", share: float = 0.3) -> Column:
    sample = F.substring(_c(c), 1, chars)
    letters = F.regexp_count(sample, F.lit(r"\p{L}"))
    return F.when((letters > 0) & (F.regexp_count(sample, F.lit(script)) > letters * share), label).otherwise(other)


def normalize_headings(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?im)^(\s*(?:chapter|part|book|section|act|scene)\s+\S+?)\s*,\s+", "$1. ")


def detect_format(filename: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(filename), r"\.([^.\\/]*)$", 1))


def iso_utc(c: Column | str) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")

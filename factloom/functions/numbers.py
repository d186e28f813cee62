"""Numbers, years and durations in text, as Column expressions (X-01..X-08, X-11, X-17, X-23, X-27)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.runtime import py_trim

#: What counts as one number; exotic spellings (nan, inf, 1_000) are no numbers here.
PLAIN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DIGITS = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"


def _double(c: Column) -> Column:
    return F.when(c.rlike(PLAIN), c.try_cast("double"))


def standard_number(c: Column) -> Column:
    """X-01: a number in either convention. VND, % and blanks go; brackets or a leading minus make it negative. Of two
    separators the last is decimal; a lone comma with up to two digits after it is decimal, other commas group; two or
    more points group. '' and text without a number: null."""
    s = F.regexp_replace(py_trim(c), "VND|%| ", "")
    paren = s.rlike(r"^\(.*\)$")
    s = F.regexp_replace(s, r"^\((.*)\)$", "$1")
    dash = s.startswith("-")
    s = F.regexp_replace(s, "^-", "")
    comma, point = s.contains(","), s.contains(".")
    body = (
        F.when(comma & point & s.rlike(r",[^,.]*$"), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & point, F.replace(s, F.lit(","), F.lit("")))
        .when(comma & s.rlike(r"^[^,]*,[^,]{0,2}$"), F.replace(s, F.lit(","), F.lit(".")))
        .when(comma, F.replace(s, F.lit(","), F.lit("")))
        .when(s.rlike(r"\..*\."), F.replace(s, F.lit("."), F.lit("")))
        .otherwise(s)
    )
    n = _double(body)
    return F.when(paren | dash, -n).otherwise(n)


def parse_number(c: Column) -> Column:
    """X-02: the whole string as a number, else its first blank-separated part that is one."""
    parts = F.filter(F.transform(F.split(py_trim(c), r"(?U)\s+"), standard_number), lambda x: x.isNotNull())
    return F.coalesce(standard_number(c), F.get(parts, F.lit(0)))


def clean_number(c: Column) -> Column:
    """X-05: without the characters , . ( ) - % blanks and the letters of VND."""
    return F.regexp_replace(c, r"VND|[,.()\-% ]", "")


def is_numeric(c: Column) -> Column:
    """X-03: some blank-separated part is digits once cleaned, has two digits or more and at most one point."""
    ok = lambda p: clean_number(p).rlike(DIGITS) & (F.length(F.regexp_replace(p, r"\D+", "")) >= 2) & (F.length(F.regexp_replace(p, r"[^.]+", "")) <= 1)
    return F.coalesce(F.exists(F.split(py_trim(c), r"(?U)\s+"), ok), F.lit(False))


def is_numeric_lenient(c: Column) -> Column:
    """X-04: some blank-separated part is digits once cleaned."""
    return F.coalesce(F.exists(F.split(py_trim(c), r"(?U)\s+"), lambda p: clean_number(p).rlike(DIGITS)), F.lit(False))


def is_number(c: Column) -> Column:
    """X-06: the string is one number once its commas are gone. Null is none."""
    return F.coalesce(F.replace(py_trim(c), F.lit(","), F.lit("")).rlike(PLAIN), F.lit(False))


def extract_year(c: Column) -> Column:
    """X-07: the first 19xx or 20xx anywhere in the text, even inside a longer number."""
    return F.regexp_extract(c, r"(19|20)\d{2}", 0).try_cast("int")


def last_year(c: Column) -> Column:
    """X-08: the last 20xx, after FY, CY or nothing."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(FY|CY|FY_)?(20\d{2})"), F.lit(2)), F.lit(-1)).try_cast("int")


def plain_number(c: Column) -> Column:
    """X-11: commas and blanks removed, then a number or null."""
    return _double(F.regexp_replace(c, "[, ]", ""))


def is_digit(c: Column) -> Column:
    """X-23: a digit stands somewhere in the cell."""
    return F.coalesce(c.rlike(r"\d"), F.lit(False))


def format_duration(c: Column) -> Column:
    """X-17: seconds as m:ss or h:mm:ss; null and negative as --:--."""
    s = F.floor(c).cast("int")
    short = F.format_string("%d:%02d", (s / 60).cast("int"), s % 60)
    long = F.format_string("%d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60)
    return F.when(c.isNull() | (c < 0), "--:--").when(s < 3600, short).otherwise(long)


def scaled_number(c: Column) -> Column:
    """X-27: '5.2 million' as 5200000: the first number with the scale word right after it."""
    m = F.lower(F.regexp_extract(c, r"(?i)\d[\d.,]*\s*(thousand|million|billion|nghìn|triệu|tỷ)", 1))
    scale = F.when(m.isin("thousand", "nghìn"), 1e3).when(m.isin("million", "triệu"), 1e6).when(m.isin("billion", "tỷ"), 1e9).otherwise(1.0)
    return standard_number(F.regexp_replace(F.regexp_extract(c, r"\d[\d.,]*", 0), r"[.,]$", "")) * scale

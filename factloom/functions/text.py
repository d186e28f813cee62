"""Text functions and predicates as Column expressions (X-09..X-22, X-26, F-09..F-12)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.numbers import plain_number
from factloom.lexicon import CONTEXT, DEFAULT, N, UNIT_PATTERNS, Config
from factloom.runtime import py_trim

false = lambda c: F.coalesce(c, F.lit(False))


def normalize_text(c: Column) -> Column:
    """X-09: runs of white space as one blank, trimmed; null as empty."""
    return py_trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """X-14: one of the phrases stands in the lower-case text, as a substring. Phrases that hold another one of the list
    say nothing more and are left out; a chain of contains() stays inside generated code."""
    least = [w for w in words if not any(v != w and v in w for v in words)]
    low = F.lower(c)
    return false(reduce(or_, [F.contains(low, F.lit(w)) for w in dict.fromkeys(least)]))


def value_unit(c: Column) -> Column:
    """X-10: struct(value, unit) of the first unit, in the order of the list, that has a number of plain digits before it."""

    def one(unit: str, pattern: str) -> Column:
        n = F.regexp_extract(c, rf"(?iU)(?<![\p{{L}}\p{{N}}_.]){N}\s*(?:[-–—]\s*)?(?:{pattern})(?![\p{{L}}\p{{N}}_])", 1)
        return F.when(n != "", F.struct(plain_number(n).alias("value"), F.lit(unit).alias("unit")))

    found = F.coalesce(*[one(u, p) for u, p in UNIT_PATTERNS], F.lit(None).cast("struct<value:double,unit:string>"))
    return F.when(c.rlike("[0-9]"), found)


def explicit_scopes(c: Column) -> Column:
    """X-12: the scopes 1 to 3 a text names, distinct and sorted; none: an empty array."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?iU)\bscope\s*([123])\b"), F.lit(1))
    named = F.transform(F.array_sort(F.array_distinct(found)), lambda x: F.concat(F.lit("Scope "), x))
    return F.when(F.contains(F.lower(c), F.lit("scope")), named).otherwise(F.array().cast("array<string>"))


def scope_context(c: Column) -> Column:
    """X-13: a word of emissions or energy stands in the text."""
    return false(c.rlike(rf"(?iU)\b(?:{CONTEXT})\b"))


def eligible(c: Column) -> Column:
    """F-09: three characters or more, and a scope, a context word or a measurement."""
    return false(F.length(py_trim(c)) >= 3) & ((F.size(explicit_scopes(c)) > 0) | scope_context(c) | value_unit(c).isNotNull())


def meaningful(c: Column, config: Config = DEFAULT) -> Column:
    """F-10: text worth labelling: three characters, two letters, no page furniture, no broken OCR."""
    t = F.lower(normalize_text(c))
    words = F.size(F.split(t, " "))
    return (F.length(t) >= 3) & (F.length(F.regexp_replace(t, r"\P{L}+", "")) >= 2) & ~t.rlike("^[^a-z0-9]+$") & ~t.rlike("|".join(config.noise_patterns)) & ~t.rlike(r"([a-z]{1,2}\s){6,}") & ~((F.length(F.regexp_replace(t, r"[^.]+", "")) > 8) & (words < 5))


def words_of(c: Column) -> Column:
    """Blank-separated words; an empty text has none."""
    t = normalize_text(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def paragraph_cell(c: Column) -> Column:
    """F-11: 15 words or more, at most two of them with digits, two or more of the marks , . ;"""
    w = words_of(c)
    return (F.size(w) >= 15) & (F.size(F.filter(w, lambda x: x.rlike(r"\d"))) <= 2) & (F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^,.;]+", "")) >= 2)


def is_heading(c: Column, config: Config = DEFAULT) -> Column:
    """F-12: a section word, or more than 80 per cent of the letters are capitals."""
    t = normalize_text(c)
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(t, r"\P{Lu}+", ""))
    return (t != "") & (contains_any(t, config.section_words) | false(F.try_divide(capitals, letters) > 0.8))


def is_total(c: Column, config: Config = DEFAULT) -> Column:
    return contains_any(c, config.total_words)


def invalid_metric(c: Column, config: Config = DEFAULT) -> Column:
    return F.lower(normalize_text(c)).isin(*config.invalid_metrics)


def fingerprint(*columns: Column | str) -> Column:
    """X-15: SHA-256 over the canonical JSON of the columns, in the order given; null fields as null."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def table_fingerprint(page: Column, table_id: Column, table_data: Column, bbox: Column | None = None, segments: Column | None = None) -> Column:
    """X-15: SHA-256 over the canonical JSON of what makes a table: its fields in alphabetical order, null ones as null;
    missing segments and cells as empty lists."""
    empty = F.array().cast("array<string>")
    fields = {
        "bbox": F.lit(None).cast("string") if bbox is None else bbox, "page": page, "segments": empty if segments is None else F.coalesce(segments, F.array()),
        "table_data": F.coalesce(table_data, F.array()), "table_id": table_id,
    }
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}), 256)


def safe_filename(c: Column) -> Column:
    """X-16: letters, digits and ._- and blank only, 100 characters at most, never empty."""
    kept = py_trim(F.left(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\p{Alnum}._\- ]", ""), F.lit(100)))
    return F.when(kept == "", "untitled").otherwise(kept)


def company_name(c: Column) -> Column:
    """X-18: what stands before the year of a report name, in snake case."""
    head = F.regexp_replace(c, r"(?s)[\s\-_]*20\d{2}.*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(head, r"(?U)[^\p{Alnum}]+", "_"), "^_+|_+$", ""))


def clean_name(c: Column) -> Column:
    """X-19: without the mark of the download site."""
    return py_trim(F.replace(c, F.lit("(SustainabilityReports.com)"), F.lit("")))


def kb_clean(c: Column) -> Column:
    """X-20: the six clean-up steps of a knowledge-base page, in order."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")
    for pattern, to in ((r"(?U)\b\d+\b(?=\s*$)", ""), ("_+", " "), (r"\.{2,}", "."), (",{2,}", ","), (";{2,}", ";")):
        t = F.regexp_replace(t, pattern, to)
    return py_trim(t)


def prediction_label(scope: Column, confidence: Column, value: Column, unit: Column) -> Column:
    """X-22: 'Scope 1 (0.93) | 12 tCO2e'."""
    head = F.format_string("%s (%.2f)", scope, confidence)
    return F.when(value.isNull(), head).otherwise(F.concat(head, F.lit(" | "), value.cast("string"), F.lit(" "), F.coalesce(unit, F.lit(""))))


def normalize_terms(c: Column) -> Column:
    """X-26: one spelling of gases and purchased energy."""
    t = F.regexp_replace(c, "CO₂", "CO2")
    t = F.regexp_replace(t, r"(?i)\bco2\s*[- ]?\s*eq?(uivalents?)?\b", "CO2e")
    t = F.regexp_replace(t, r"(?i)\belectricity purchased\b", "purchased electricity")
    return F.regexp_replace(t, r"(?i)\bgreen\s?house gas(es)?\b", "GHG")

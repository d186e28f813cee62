"""Queries of the scalar functions and predicates: one per function, over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import geometry as g
from factloom.functions import numbers as n
from factloom.functions import text as t
from factloom.functions import vectors as v
from factloom.lexicon import CONTEXT, DEFAULT, UNIT_PATTERNS
from factloom.plans.inputs import BUILD, NAME, SQL
from factloom.runtime import table

_S = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"  # Unicode white space in RE2
_L = r"\p{L}\p{N}_"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _norm(x: str) -> str:
    return _trim(f"regexp_replace(coalesce({x}, ''), '{_S}+', ' ', 'g')")


def _double(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{n.PLAIN}') THEN TRY_CAST({x} AS DOUBLE) END)"


def _std(x: str) -> str:
    """X-01 in SQL, with x bound once by a one-element list."""
    body = "CASE WHEN contains(s,',') AND contains(s,'.') AND regexp_matches(s,',[^,.]*$') THEN replace(replace(s,'.',''),',','.') WHEN contains(s,',') AND contains(s,'.') THEN replace(s,',','') WHEN regexp_matches(s,'^[^,]*,[^,]{0,2}$') THEN replace(s,',','.') WHEN contains(s,',') THEN replace(s,',','') WHEN regexp_matches(s,'\\..*\\.') THEN replace(s,'.','') ELSE s END"
    raw = f"regexp_replace({_trim(x)}, 'VND|%| ', '', 'g')"
    inner = f"list_transform([{raw}], lambda r: list_transform([regexp_replace(regexp_replace(r, '^\\((.*)\\)$', '\\1'), '^-', '')], lambda s: (CASE WHEN regexp_matches(r, '^\\(.*\\)$|^-|^\\(-') THEN -1 ELSE 1 END) * {_double('(' + body + ')')})[1])[1]"
    return inner


def _clean(x: str) -> str:
    return f"regexp_replace({x}, 'VND|[,.()\\-% ]', '', 'g')"


def _has(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


def _value_unit(x: str) -> str:
    number = r"([+-]?\d+(?:,\d{3})*(?:\.\d+)?)"
    parts = []
    for unit, pattern in UNIT_PATTERNS:
        m = f"regexp_extract({x}, '(?i)(?:^|[^{_L}.]){number}{_S}*(?:[-–—]{_S}*)?(?:{pattern.replace(chr(92) + 's', _S)})(?:$|[^{_L}])', 1)"
        parts.append((unit, m))
    return parts


def _first(parts, what: str) -> str:
    whens = " ".join(f"WHEN {m} <> '' THEN " + (f"'{u}'" if what == "unit" else f"TRY_CAST(replace({m}, ',', '') AS DOUBLE)") for u, m in parts)
    return f"(CASE {whens} END)"


_VU = _value_unit("text")
_SCOPES = f"list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)\\bscope{_S}*([123])\\b', 1), lambda x: 'Scope ' || x)))"
_CONTEXT = f"coalesce(regexp_matches(text, '(?i)\\b(?:{CONTEXT.replace(chr(92) + 's', _S)})\\b'), false)"
_ELIGIBLE = f"(coalesce(length({_trim('text')}) >= 3, false) AND (len({_SCOPES}) > 0 OR {_CONTEXT} OR {_first(_VU, 'unit')} IS NOT NULL))"
_letters = lambda x: f"length(regexp_replace({x}, '\\P{{L}}', '', 'g'))"
_HEADING = f"({_norm('text')} <> '' AND ({_has(_norm('text'), DEFAULT.section_words)} OR coalesce(CASE WHEN {_letters(_norm('text'))} > 0 THEN length(regexp_replace({_norm('text')}, '\\P{{Lu}}', '', 'g')) / {_letters(_norm('text'))} > 0.8 END, false)))"
_LOW = f"lower({_norm('text')})"
_MEANINGFUL = f"""(length({_LOW}) >= 3 AND length(regexp_replace({_LOW}, '\\P{{L}}', '', 'g')) >= 2 AND NOT regexp_matches({_LOW}, '^[^a-z0-9]+$') AND NOT regexp_matches({_LOW}, '{"|".join(DEFAULT.noise_patterns)}')
    AND NOT regexp_matches({_LOW}, '([a-z]{{1,2}}\\s){{6,}}') AND NOT (length(regexp_replace({_LOW}, '[^.]', '', 'g')) > 8 AND len(string_split({_LOW}, ' ')) < 5))"""

_FIRST_NUMBER = "regexp_replace(regexp_extract(text, '\\d[\\d.,]*', 0), '[.,]$', '')"

C = F.col
CELL, BLOCK, PAGE, WORD = ["table_key", "row_no", "col_no"], ["block_key"], ["raw_id", "page_no"], ["page", "ocr_index"]
_b = lambda: g.box(C("x0"), C("y0"), C("x1"), C("y1"))
_W, _H = lambda: F.lit(920), lambda: F.lit(1210)


def _clamped(v: str, most: int) -> str:
    return f"greatest(0.0, least(CAST({v} AS DOUBLE), {most}.0))"


#: name -> (input, keys, [(alias, Column when called, SQL)])
PROJECTIONS: dict[str, tuple[str, list[str], Callable[[], list[tuple[str, Callable[[], Column], str]]]]] = {
    "x01_standard_number": ("cells", CELL, lambda: [("value", lambda: n.standard_number(C("text")), _std("text"))]),
    "x02_parse_number": ("cells", CELL, lambda: [("value", lambda: n.parse_number(C("text")), f"coalesce({_std('text')}, list_filter(list_transform(regexp_split_to_array({_trim('text')}, '{_S}+'), lambda p: {_std('p')}), lambda q: q IS NOT NULL)[1])")]),
    "x03_is_numeric": ("cells", CELL, lambda: [("hit", lambda: n.is_numeric(C("text")), f"coalesce(len(list_filter(regexp_split_to_array({_trim('text')}, '{_S}+'), lambda p: regexp_matches({_clean('p')}, '{n.DIGITS}') AND length(regexp_replace(p, '\\D', '', 'g')) >= 2 AND length(regexp_replace(p, '[^.]', '', 'g')) <= 1)) > 0, false)")]),
    "x04_is_numeric_lenient": ("cells", CELL, lambda: [("hit", lambda: n.is_numeric_lenient(C("text")), f"coalesce(len(list_filter(regexp_split_to_array({_trim('text')}, '{_S}+'), lambda p: regexp_matches({_clean('p')}, '{n.DIGITS}'))) > 0, false)")]),
    "x05_clean_number": ("cells", CELL, lambda: [("cleaned", lambda: n.clean_number(C("text")), _clean("text"))]),
    "x06_is_number": ("cells", CELL, lambda: [("hit", lambda: n.is_number(C("text")), f"coalesce(regexp_matches(replace({_trim('text')}, ',', ''), '{n.PLAIN}'), false)")]),
    "x07_extract_year": ("cells", CELL, lambda: [("year", lambda: n.extract_year(C("text")), "TRY_CAST(regexp_extract(text, '(19|20)\\d{2}', 0) AS INT)")]),
    "x08_last_year": ("cells", CELL, lambda: [("year", lambda: n.last_year(C("text")), "TRY_CAST(list_last(regexp_extract_all(text, '(FY|CY|FY_)?(20\\d{2})', 2)) AS INT)")]),
    "x09_normalize_text": ("blocks", BLOCK, lambda: [("clean", lambda: t.normalize_text(C("text")), _norm("text"))]),
    "x10_value_unit": ("blocks", BLOCK, lambda: [("value", lambda: t.value_unit(C("text"))["value"], _first(_VU, "value")), ("unit", lambda: t.value_unit(C("text"))["unit"], _first(_VU, "unit"))]),
    "x11_plain_number": ("cells", CELL, lambda: [("value", lambda: n.plain_number(C("text")), _double("regexp_replace(text, '[, ]', '', 'g')"))]),
    "x12_explicit_scopes": ("blocks", BLOCK, lambda: [("scopes", lambda: t.explicit_scopes(C("text")), _SCOPES)]),
    "x13_scope_context": ("blocks", BLOCK, lambda: [("hit", lambda: t.scope_context(C("text")), _CONTEXT)]),
    "x14_keywords": ("cells", CELL, lambda: [("hit", lambda: t.contains_any(C("text"), DEFAULT.table_words), f"coalesce({_has('text', DEFAULT.table_words)}, false)")]),
    "x15_fingerprint": ("blocks", BLOCK, lambda: [("sha", lambda: t.fingerprint("page", "block_id", "report_id"), "sha256('{\"page\":' || coalesce('\"' || page || '\"', 'null') || ',\"block_id\":' || block_id || ',\"report_id\":' || coalesce('\"' || report_id || '\"', 'null') || '}')")]),
    "x16_safe_filename": ("blocks", BLOCK, lambda: [("name", lambda: t.safe_filename(C("report_id")), "CASE WHEN coalesce(trim(left(regexp_replace(report_id, '[^\\p{L}\\p{Nd}._\\- ]', '', 'g'), 100)), '') = '' THEN 'untitled' ELSE trim(left(regexp_replace(report_id, '[^\\p{L}\\p{Nd}._\\- ]', '', 'g'), 100)) END")]),
    "x17_format_duration": ("words", WORD, lambda: [("shown", lambda: n.format_duration(C("x0") * 13 - 100), "CASE WHEN x0 * 13 - 100 < 0 THEN '--:--' WHEN x0 * 13 - 100 < 3600 THEN printf('%d:%02d', (x0 * 13 - 100) // 60, (x0 * 13 - 100) % 60) ELSE printf('%d:%02d:%02d', (x0 * 13 - 100) // 3600, ((x0 * 13 - 100) % 3600) // 60, (x0 * 13 - 100) % 60) END")]),
    "x20_kb_clean": ("pages", PAGE, lambda: [("clean", lambda: t.kb_clean(C("text")), _trim(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{_S}+', ' ', 'g'), '\\b\\d+( ?)$', '\\1'), '_+', ' ', 'g'), '\\.{{2,}}', '.', 'g'), ',{{2,}}', ',', 'g'), ';{{2,}}', ';', 'g')"))]),
    "x21_evidence": ("blocks", BLOCK, lambda: [("evidence", lambda: F.left(C("text"), F.lit(300)), "left(text, 300)"), ("summary", lambda: F.left(C("text"), F.lit(200)), "left(text, 200)")]),
    "x22_label": ("blocks", BLOCK, lambda: [("label", lambda: t.prediction_label(F.lit("Scope 1"), F.lit(0.5), C("num_words").cast("double"), C("type")), "CASE WHEN num_words IS NULL THEN 'Scope 1 (0.50)' ELSE 'Scope 1 (0.50) | ' || CAST(CAST(num_words AS DOUBLE) AS STRING) || ' ' || coalesce(type, '') END")]),
    "x23_is_digit": ("cells", CELL, lambda: [("hit", lambda: n.is_digit(C("text")), "coalesce(regexp_matches(text, '\\d'), false)")]),
    "x24_softmax": ("esg_text", ["page", "block_id"], lambda: [("p", lambda: F.transform(v.softmax(F.array(*[C(f"a{i}").cast("double") for i in range(4)]), DEFAULT.temperature), lambda x: F.round(x, 6)), "[" + ", ".join(f"round(exp(a{i} / 5.0) / (exp(a0 / 5.0) + exp(a1 / 5.0) + exp(a2 / 5.0) + exp(a3 / 5.0)), 6)" for i in range(4)) + "]"), ("best", lambda: v.argmax(F.array(*[C(f"a{i}").cast("double") for i in range(4)])), "CAST(list_position([a0, a1, a2, a3], greatest(a0, a1, a2, a3)) - 1 AS INT)")]),
    "x26_terms": ("blocks", BLOCK, lambda: [("terms", lambda: t.normalize_terms(C("text")), "regexp_replace(regexp_replace(regexp_replace(replace(text, 'CO₂', 'CO2'), '(?i)\\bco2\\s*[- ]?\\s*eq?(uivalents?)?\\b', 'CO2e', 'g'), '(?i)\\belectricity purchased\\b', 'purchased electricity', 'g'), '(?i)\\bgreen\\s?house gas(es)?\\b', 'GHG', 'g')")]),
    "x27_scaled_number": ("blocks", BLOCK, lambda: [("value", lambda: n.scaled_number(C("text")), f"{_std(_FIRST_NUMBER)} * (CASE lower(regexp_extract(text, '(?i)\\d[\\d.,]*\\s*(thousand|million|billion|nghìn|triệu|tỷ)', 1)) WHEN 'thousand' THEN 1e3 WHEN 'nghìn' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'triệu' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'tỷ' THEN 1e9 ELSE 1.0 END)")]),
    "f09_eligible": ("blocks", BLOCK, lambda: [("hit", lambda: t.eligible(C("text")), _ELIGIBLE)]),
    "f10_meaningful": ("blocks", BLOCK, lambda: [("hit", lambda: t.meaningful(C("text")), _MEANINGFUL)]),
    "f11_paragraph_cell": ("blocks", BLOCK, lambda: [("hit", lambda: t.paragraph_cell(C("text")), f"({_norm('text')} <> '' AND len(string_split({_norm('text')}, ' ')) >= 15 AND len(list_filter(string_split({_norm('text')}, ' '), lambda x: regexp_matches(x, '\\d'))) <= 2 AND length(regexp_replace(coalesce(text, ''), '[^,.;]', '', 'g')) >= 2)")]),
    "f12_metric_predicates": ("cells", CELL, lambda: [("heading", lambda: t.is_heading(C("text")), _HEADING), ("total", lambda: t.is_total(C("text")), f"coalesce({_has('text', DEFAULT.total_words)}, false)"), ("invalid", lambda: t.invalid_metric(C("text")), f"lower({_norm('text')}) IN ({', '.join(map(repr, DEFAULT.invalid_metrics))})")]),
    "o01_normalize": ("words", WORD, lambda: _with_sql(lambda: g.normalize(g.box(C("x1"), C("y0") - 40, C("x0"), C("y1")), _W(), _H()), {"x0": f"CAST(round_even(least({_clamped('x1', 920)}, {_clamped('x0', 920)}) / 920 * 1000, 0) AS INT)", "y0": f"CAST(round_even(least({_clamped('y0 - 40', 1210)}, {_clamped('y1', 1210)}) / 1210 * 1000, 0) AS INT)", "x1": f"CAST(round_even(greatest({_clamped('x1', 920)}, {_clamped('x0', 920)}) / 920 * 1000, 0) AS INT)", "y1": f"CAST(round_even(greatest({_clamped('y0 - 40', 1210)}, {_clamped('y1', 1210)}) / 1210 * 1000, 0) AS INT)"})),
    "o02_from_quad": ("words", WORD, lambda: _with_sql(lambda: g.from_quad(F.array(*[F.struct(C(x).alias("x"), C(y).alias("y")) for x, y in (("x0", "y1"), ("x1", "y0"), ("x1", "y1"), ("x0", "y0"))])), {c: c for c in ("x0", "y0", "x1", "y1")})),
    "o03_from_coco": ("words", WORD, lambda: _with_sql(lambda: g.from_coco(C("x0"), C("y0"), C("x1"), C("y1")), {"x0": "x0", "y0": "y0", "x1": "x0 + x1", "y1": "y0 + y1"})),
    "o05_area": ("words", WORD, lambda: [("area", lambda: g.area(_b()), "(x1 - x0) * (y1 - y0)"), ("flipped", lambda: g.area(g.box(C("x1"), C("y0"), C("x0"), C("y1"))), "CAST(0 AS BIGINT)")]),
    "o06_expand": ("words", WORD, lambda: _with_sql(lambda: g.expand(_b(), 40, 25, _W(), _H()), {"x0": "greatest(0, x0 - 40)", "y0": "greatest(0, y0 - 25)", "x1": "least(920, x1 + 40)", "y1": "least(1210, y1 + 25)"})),
    "o07_denormalize": ("blocks", BLOCK, lambda: _with_sql(lambda: g.denormalize(C("bbox"), F.lit(2480), F.lit(3508)), {c: f"CAST(trunc(bbox.{c} * {m} / 1000.0) AS INT)" for c, m in (("x0", 2480), ("y0", 3508), ("x1", 2480), ("y1", 3508))})),
    "o08_center_in": ("words", WORD, lambda: [("hit", lambda: g.center_in(_b(), g.box(100, 100, 500, 700)), "(x0 + x1) / 2 BETWEEN 100 AND 500 AND (y0 + y1) / 2 BETWEEN 100 AND 700")]),
    "o09_intervals": ("words", WORD, lambda: [("common", lambda: g.overlap(C("x0"), C("x1"), F.lit(200), F.lit(400)), "greatest(0, least(x1, 400) - greatest(x0, 200))"), ("apart", lambda: g.gap(C("x0"), C("x1"), F.lit(200), F.lit(400)), "greatest(0, greatest(x0, 200) - least(x1, 400))")]),
    "o10_overlap_ratio": ("words", WORD, lambda: [("ratio", lambda: F.round(g.overlap_ratio(_b(), g.box(0, 0, 450, 600)), 6), "round(greatest(0, least(x1, 450) - greatest(x0, 0)) * greatest(0, least(y1, 600) - greatest(y0, 0)) / least((x1 - x0) * (y1 - y0), 270000), 6)")]),
    "o11_translate": ("words", WORD, lambda: _with_sql(lambda: g.translate(_b(), F.lit(50), F.lit(60)), {"x0": "x0 - 50", "y0": "y0 - 60", "x1": "x1 - 50", "y1": "y1 - 60"})),
    "o12_valid": ("blocks", BLOCK, lambda: [("hit", lambda: g.valid(C("bbox")), "coalesce(bbox.x0 BETWEEN 0 AND 1000 AND bbox.y0 BETWEEN 0 AND 1000 AND bbox.x1 BETWEEN 0 AND 1000 AND bbox.y1 BETWEEN 0 AND 1000 AND bbox.x0 <= bbox.x1 AND bbox.y0 <= bbox.y1, false)")]),
}


def _with_sql(b: Callable[[], Column], sql: dict[str, str]) -> list[tuple[str, Callable[[], Column], str]]:
    return [(f"b_{c}", lambda c=c: b()[c], sql[c]) for c in ("x0", "y0", "x1", "y1")]


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, keys, make = PROJECTIONS[name]
    return lambda spark, d: BUILD[source](spark, d).select(*keys, *[c().alias(a) for a, c, _ in make()])


def o04_union(spark: SparkSession, d: str) -> DataFrame:
    return BUILD["words"](spark, d).groupBy("page", "layout_label").agg(g.union(_b()).alias("b")).select("page", "layout_label", "b.x0", "b.y0", "b.x1", "b.y1")


def o13_out_of_bounds(spark: SparkSession, d: str) -> DataFrame:
    hit = g.out_of_bounds(_b(), F.lit(900), F.lit(1200))
    return BUILD["words"](spark, d).groupBy("page").agg(F.count_if(hit).alias("n_out"), F.round(100 * F.count_if(hit) / F.count("*"), 4).alias("pct_out"))


def x18_x19_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.pdf$", "")
    return table(spark, d, "report_files").select("report_id", t.company_name(name).alias("company_key"), t.clean_name(F.concat(name, F.lit(" (SustainabilityReports.com)"))).alias("clean"))


def x25_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = C("embedding")
    two = F.array(e, F.transform(e, lambda x: -x), e)
    mean = v.masked_mean(F.transform(two, lambda a: F.transform(a, lambda x: x.cast("double"))), F.array(F.lit(1), F.lit(0), F.lit(1)))
    return table(spark, d, "embeddings").select("vec_id", F.round(v.norm(v.l2_normalize(F.transform(e, lambda x: x * 3))), 6).alias("norm"), F.round(v.total(mean), 5).alias("mean_sum"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in PROJECTIONS} | {f.__name__: f for f in (o04_union, o13_out_of_bounds, x18_x19_names, x25_vectors)}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (source, keys, make) in PROJECTIONS.items():
        columns = ", ".join([*keys, *[f"{sql} AS {a}" for a, _, sql in make()]])
        out[name] = f"WITH {SQL[source]} SELECT {columns} FROM {NAME.get(source, source)}"
    return out | {
        "o04_union": f"WITH {SQL['words']} SELECT page, layout_label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY ALL",
        "o13_out_of_bounds": f"WITH {SQL['words']} SELECT page, count(*) FILTER (x1 > 900 OR y1 > 1200) AS n_out, round(100.0 * count(*) FILTER (x1 > 900 OR y1 > 1200) / count(*), 4) AS pct_out FROM words GROUP BY page",
        "x18_x19_names": r"""SELECT report_id, lower(regexp_replace(regexp_replace(regexp_replace(f, '(?s)[\s\-_]*20\d{2}.*$', ''), '[^\p{L}\p{Nd}]+', '_', 'g'), '^_+|_+$', '', 'g')) AS company_key, f AS clean
            FROM (SELECT report_id, regexp_replace(regexp_replace(path, '^.*/', ''), '\.pdf$', '') AS f FROM report_files)""",
        "x25_vectors": "SELECT vec_id, CAST(1.0 AS DOUBLE) AS norm, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS mean_sum FROM embeddings",
    }

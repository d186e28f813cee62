"""Queries of the page, table and scope operators (J-*, W-*, T-*, R-*, F-*), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.lexicon import DEFAULT
from factloom.operators import facts, grid, layout, report, scope, spatial
from factloom.plans import inputs as i
from factloom.plans.functions import _CONTEXT, _ELIGIBLE, _SCOPES, _VU, _first, _has, _norm, _std
from factloom.runtime import table

C = F.col
S = SparkSession
_P = lambda: F.transform(F.array(*[F.pow(f"a{k}", F.lit(3)) for k in range(4)]), lambda x: x / (F.pow("a0", F.lit(3)) + F.pow("a1", F.lit(3)) + F.pow("a2", F.lit(3)) + F.pow("a3", F.lit(3))))
WORD = ["page", "ocr_index"]


# Joins.
def j01_positional(s: S, d: str) -> DataFrame:
    w = i.words(s, d)
    return spatial.positional(w.select(*WORD, "text").filter("ocr_index % 50 <> 7"), w.select(*WORD, "layout_label").filter("ocr_index % 60 <> 11"), WORD)


def j02_word_regions(s: S, d: str) -> DataFrame:
    return spatial.word_regions(i.words(s, d), i.regions(s, d), WORD).select(*WORD, "region_label")


def j03_tokens_in(s: S, d: str) -> DataFrame:
    return spatial.tokens_in(i.words(s, d), i.regions(s, d)).drop("text")


def j04_adjacent_headers(s: S, d: str) -> DataFrame:
    w = i.words(s, d)
    return spatial.adjacent_headers(i.regions(s, d), w, spatial.median_heights(w.filter("layout_label = 'table'")))


def j05_grid_slot(s: S, d: str) -> DataFrame:
    slots = i.regions(s, d).filter("label = 'table'").select("page", C("y0").alias("s0"), (C("y0") + 60).alias("s1"))
    return spatial.grid_slot(i.words(s, d), slots, WORD, "y0", "y1")


def j06_segments(s: S, d: str) -> DataFrame:
    seg = table(s, d, "all_tables").select("table_key", F.floor(C("table_key") / 3).alias("group_id"), (C("table_key") % 3).alias("seg_no"))
    return grid.combine_segments(i.cells(s, d), seg)


# Layout.
def w01_reading_order(s: S, d: str) -> DataFrame:
    return layout.reading_order(i.words(s, d)).select(*WORD, "reading_no")


def w02_vertical_groups(s: S, d: str) -> DataFrame:
    return layout.vertical_groups(i.words(s, d)).select(*WORD, "v_group")


def w03_column_groups(s: S, d: str) -> DataFrame:
    return layout.column_groups(i.words(s, d), i.PAGE_WIDTH).select(*WORD, "h_group")


def w04_virtual_panels(s: S, d: str) -> DataFrame:
    return layout.virtual_panels(i.words(s, d), 960, 600).select(*WORD, "panel")


def w07_continuations(s: S, d: str) -> DataFrame:
    r = i.regions(s, d).withColumn("panel", (C("x0") >= 350).cast("int")).withColumn("has_header", C("label") == "table")
    return layout.continuation_groups(r, 1200, 600).select("page", "ann_idx", "region_group")


def w08_region_headers(s: S, d: str) -> DataFrame:
    words = tuple(dict.fromkeys(DEFAULT.header_words + DEFAULT.metric_words))
    c = i.cells(s, d)
    year = F.count_if(C("text").rlike(r"(19|20)\d{2}"))
    key = F.bool_or(t.contains_any(C("text"), words))
    return c.groupBy("table_key").agg(((year >= 2) | F.coalesce(key, F.lit(False))).alias("has_header"))


def w10_text_columns(s: S, d: str) -> DataFrame:
    return layout.text_columns(i.words(s, d)).select(*WORD, "text_column")


def w14_chunk_starts(s: S, d: str) -> DataFrame:
    return layout.chunk_starts(i.words(s, d).groupBy("page").agg(F.count("*").alias("n")), "n")


def w15_overlap_vote(s: S, d: str) -> DataFrame:
    e = i.esg_text(s, d).select("page", (C("block_id") % 30).alias("word_no"), F.floor(C("block_id") / 30).alias("chunk"), _P().alias("p"))
    return layout.overlap_vote(e, ["page", "word_no"], "chunk", "p")


def w16_majority(s: S, d: str) -> DataFrame:
    return layout.majority_vote(i.words(s, d), ["page", "y0"], "layout_label", "ocr_index")


# Tables.
def t02_assemble(s: S, d: str) -> DataFrame:
    tokens = i.words(s, d).select(C("page").alias("table_key"), F.floor(C("y0") / 100).cast("int").alias("row_no"), F.floor(C("x0") / 200).cast("int").alias("col_no"), "x0", "y0", "y1", "ocr_index", "text")
    return grid.assemble(tokens)


def t03_densify(s: S, d: str) -> DataFrame:
    sizes = table(s, d, "all_tables").select("table_key", (C("rows") + 1).alias("n_rows"), (C("cols") + 1).alias("n_cols"))
    return grid.densify(i.cells(s, d), sizes)


def t04_clean(s: S, d: str) -> DataFrame:
    return grid.clean(i.cells(s, d))


def t05_continuations(s: S, d: str) -> DataFrame:
    return grid.join_continuations(i.cells(s, d))


def t07_header_rows(s: S, d: str) -> DataFrame:
    return grid.header_rows(grid._cell(i.cells(s, d), DEFAULT))


def t08_header_columns(s: S, d: str) -> DataFrame:
    m = grid._cell(i.cells(s, d), DEFAULT)
    return grid.header_columns(m, grid.header_rows(m)).select("table_key", "metric_col", "unit_col", "n_years")


def t10_facts(s: S, d: str) -> DataFrame:
    return grid.table_facts(table(s, d, "all_tables"))


def t11_table_text(s: S, d: str) -> DataFrame:
    return scope.table_text(i.cells(s, d))


def t12_row_texts(s: S, d: str) -> DataFrame:
    return scope.row_texts(i.cells(s, d))


def f05_structure(s: S, d: str) -> DataFrame:
    return grid.structure_ok(i.cells(s, d))


def f08_route(s: S, d: str) -> DataFrame:
    return scope.route(i.blocks(s, d)).select("block_key", "section")


# Scope.
def r01_resolve(s: S, d: str) -> DataFrame:
    r = scope.resolved(i.esg_text(s, d), "text", _P())
    return r.select("page", "block_id", "r.scope", "r.scope_id", F.round("r.confidence", 3).alias("confidence"), "r.scope_source", "r.decision_reason")


def r02_table_scope(s: S, d: str) -> DataFrame:
    r = scope.resolved(i.esg_text(s, d), "text", _P()).select(C("page").alias("table_key"), "r.scope", "r.confidence")
    return scope.table_scope(r).withColumn("confidence", F.round("confidence", 2))


def r04_activity_scope(s: S, d: str) -> DataFrame:
    return i.blocks(s, d).select("block_key", scope.activity_scope(C("text")).alias("scope"), scope.carbon_candidate(C("text")).alias("candidate"))


def r05_merge_sources(s: S, d: str) -> DataFrame:
    src = F.when(C("type").rlike("(?i)table"), "table").when(C("type").rlike("(?i)chart|figure"), "chart").otherwise("text")
    r = table(s, d, "layoutlmv3_layout").filter("site_code is not null").select("site_code", "indicator", "year", src.alias("source"), "value")
    return scope.merge_sources(r, ["site_code", "indicator", "year"])


def r07_trend(s: S, d: str) -> DataFrame:
    r = table(s, d, "layoutlmv3_layout").filter("value is not null and indicator is not null").groupBy("indicator", "year").agg(F.avg("value").alias("value"))
    return scope.trend(r, ["indicator"]).withColumn("slope", F.round("slope", 2))


def a04_scope_shares(s: S, d: str) -> DataFrame:
    return report.shares(scope.resolved(i.esg_text(s, d), "text", _P()).select("r.scope"), "scope")


def a05_scope_rollup(s: S, d: str) -> DataFrame:
    return report.totals(scope.resolved(i.esg_text(s, d), "text", _P()).select("page", "r.scope"), "page", "scope")


def q_scope_values(s: S, d: str) -> DataFrame:
    """Emission values by scope from text."""
    r = scope.resolved(i.esg_text(s, d), "text", _P())
    return r.groupBy("r.scope", "v.unit").agg(F.count("*").alias("n"), F.round(F.sum("v.value"), 3).alias("total"))


def q_facts(s: S, d: str) -> DataFrame:
    """Facts of all tables with scope, company, year and page."""
    return facts.scoped_facts(table(s, d, "all_tables"), table(s, d, "report_files"))


OWN = [f for name, f in list(globals().items()) if callable(f) and name[0] in "jwtfraq" and name[1:3].isdigit()] + [q_scope_values, q_facts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OWN}


_p = [f"power(a{k}, 3) / (power(a0, 3) + power(a1, 3) + power(a2, 3) + power(a3, 3))" for k in range(4)]
_RESOLVED = f"""scored AS (SELECT page, block_id, text, {_SCOPES} AS named, [{', '.join(_p)}] AS p, {_ELIGIBLE} AS ok, {_first(_VU, 'unit')} AS unit, {_first(_VU, 'value')} AS value, {_CONTEXT} AS context FROM esg_text),
tops AS (SELECT *, list_position(p, list_max(p)) - 1 AS best, round(list_max(p), 4) AS top, round(p[1], 4) AS other FROM scored),
resolved AS (SELECT page, block_id, unit, value,
  CASE WHEN len(named) > 1 THEN 'Mixed' WHEN len(named) = 1 THEN named[1] WHEN best = 0 OR NOT ok OR top <= 0.60 THEN 'Other' ELSE 'Scope ' || best END AS scope,
  CASE WHEN len(named) > 1 THEN -1 WHEN len(named) = 1 THEN CAST(right(named[1], 1) AS INT) WHEN best = 0 OR NOT ok OR top <= 0.60 THEN 0 ELSE best END AS scope_id,
  CASE WHEN len(named) > 0 THEN 1.0 WHEN best = 0 THEN top WHEN NOT ok THEN other WHEN top > 0.60 THEN top ELSE other END AS confidence,
  CASE WHEN len(named) > 1 THEN 'explicit_mentions' WHEN len(named) = 1 THEN 'explicit_mention' WHEN best = 0 THEN 'model' WHEN NOT ok THEN 'eligibility_gate' WHEN top > 0.60 THEN (CASE WHEN unit IS NOT NULL THEN 'model_with_measurement_and_esg_context' ELSE 'model_with_esg_context' END) ELSE 'policy_filter' END AS scope_source,
  CASE WHEN len(named) > 1 THEN 'multiple_explicit_scopes' WHEN len(named) = 1 THEN 'single_explicit_scope' WHEN best = 0 THEN 'model_predicted_other' WHEN NOT ok THEN 'not_esg_eligible' WHEN top > 0.60 THEN 'supported_non_other_prediction' WHEN unit IS NOT NULL OR context THEN 'low_confidence' ELSE 'low_confidence,missing_esg_evidence' END AS decision_reason
  FROM tops)"""

_NUM = "regexp_matches(replace(x, ',', ''), '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$')"
_MARKED = f"""marked AS (SELECT table_key, row_no, col_no, x, TRY_CAST(regexp_extract(x, '(19|20)\\d{{2}}', 0) AS INT) AS year, {_has('x', DEFAULT.header_words)} AS head, {_has('x', DEFAULT.metric_words)} AS metric,
  {_has('x', DEFAULT.unit_words)} AS unit, {_NUM} AS number, TRY_CAST(list_last(regexp_extract_all(x, '(FY|CY|FY_)?(20\\d{{2}})', 2)) AS INT) AS fy FROM (SELECT table_key, row_no, col_no, {_norm('text')} AS x FROM cells)),
row_scores AS (SELECT table_key, row_no, sum(CASE WHEN year IS NOT NULL OR head THEN 3 ELSE 0 END + CASE WHEN x = '' THEN 0 ELSE CASE WHEN head THEN 5 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN number THEN -1 ELSE 1 END END) AS s,
  count(*) FILTER (x <> '') AS n, bool_or(metric) AS metric FROM marked GROUP BY ALL),
heads AS (SELECT table_key, coalesce(arg_min(row_no, -s * 100000 + row_no) FILTER (n > 1 AND s > -1), 0) AS header_row, min(row_no) FILTER (metric AND row_no < 4) AS k, max(row_no) + 1 AS n_rows FROM row_scores GROUP BY table_key),
head2 AS (SELECT table_key, header_row, coalesce(k, header_row) AS key_row, n_rows FROM heads),
roles AS (SELECT h.table_key, header_row, key_row, n_rows, arg_min(col_no, -(CASE WHEN metric THEN 100 ELSE 0 END - CASE WHEN year IS NOT NULL THEN 100 ELSE 0 END - CASE WHEN unit THEN 50 ELSE 0 END + CASE WHEN x <> '' AND NOT number THEN 5 ELSE 0 END) * 1000 + col_no) AS metric_col,
  max(col_no) FILTER (unit) AS unit_col, count(*) FILTER (year IS NOT NULL) AS n_years FROM marked m JOIN head2 h ON m.table_key = h.table_key AND m.row_no = h.key_row GROUP BY ALL)"""


def _metric_ok(x: str) -> str:
    letters = f"length(regexp_replace({x}, '\\P{{L}}', '', 'g'))"
    heading = f"({_has(x, DEFAULT.section_words)} OR ({letters} > 0 AND length(regexp_replace({x}, '\\P{{Lu}}', '', 'g')) / {letters} > 0.8))"
    return f"lower({x}) NOT IN ({', '.join(map(repr, DEFAULT.invalid_metrics))}) AND NOT {heading} AND NOT {_has(x, DEFAULT.total_words)}"


_FACTS = f"""{_MARKED}, many AS (SELECT *, greatest(header_row, key_row) + 1 AS start FROM roles WHERE n_rows > 1),
own AS (SELECT m.table_key, m.col_no, m.year FROM marked m JOIN many r ON m.table_key = r.table_key AND m.row_no = r.key_row WHERE m.year IS NOT NULL),
above AS (SELECT m.table_key, m.col_no, arg_max(fy, row_no) AS year FROM marked m JOIN many r ON m.table_key = r.table_key WHERE r.n_years = 0 AND m.row_no < r.start AND fy IS NOT NULL GROUP BY ALL),
dated AS (SELECT * FROM own UNION ALL SELECT * FROM above),
vals AS (SELECT table_key, col_no, year, 'table_header' AS year_source FROM dated UNION ALL
  SELECT m.table_key, m.col_no, NULL, 'fallback_no_year_column' FROM marked m JOIN many r ON m.table_key = r.table_key AND m.row_no = r.header_row WHERE m.table_key NOT IN (SELECT table_key FROM dated) AND m.col_no <> r.metric_col AND (r.unit_col IS NULL OR m.col_no <> r.unit_col)),
rowsx AS (SELECT m.table_key, m.row_no, max(x) FILTER (col_no = metric_col) AS metric_text, coalesce(max(x) FILTER (col_no = unit_col), '') AS unit FROM marked m JOIN many r ON m.table_key = r.table_key WHERE m.row_no >= r.start GROUP BY ALL),
good AS (SELECT * FROM rowsx WHERE metric_text IS NOT NULL AND {_metric_ok('metric_text')}),
numbers AS (SELECT m.table_key, m.row_no, m.col_no, g.metric_text, {_std('m.x')} AS value, g.unit, v.year, v.year_source FROM marked m JOIN vals v ON m.table_key = v.table_key AND m.col_no = v.col_no JOIN good g ON m.table_key = g.table_key AND m.row_no = g.row_no WHERE m.number),
firsts AS (SELECT *, CAST(row_number() OVER (PARTITION BY table_key, col_no, lower(metric_text), year, value ORDER BY row_no) AS INT) AS k FROM numbers WHERE value IS NOT NULL),
one AS (SELECT m.table_key, arg_min(x, col_no) AS metric_text, min(col_no) AS metric_col FROM marked m JOIN head2 h ON m.table_key = h.table_key WHERE h.n_rows = 1 AND NOT number AND x <> '' GROUP BY ALL),
facts AS (SELECT table_key, row_no, col_no, metric_text, value, unit, year, year_source, {_has("(metric_text || ' ' || unit)", DEFAULT.table_words)} AS is_esg FROM firsts WHERE k = 1
  UNION ALL SELECT m.table_key, m.row_no, m.col_no, o.metric_text, {_std('m.x')}, '', NULL, 'single_row_table_report_year', {_has('o.metric_text', DEFAULT.table_words)} FROM marked m JOIN one o ON m.table_key = o.table_key WHERE m.col_no <> o.metric_col AND m.number AND {_metric_ok('o.metric_text')})"""

_NO_DIGIT = "NOT regexp_matches(regexp_replace({0}, '[,.\\- ]', '', 'g'), '^\\d+$')"
_ROWTEXT = f"""picked AS (SELECT table_key, row_no, coalesce(trim(max(text) FILTER (col_no = 0)), '') AS c0, coalesce(trim(max(text) FILTER (col_no = 1)), '') AS c1, coalesce(trim(max(text) FILTER (col_no = 2)), '') AS c2 FROM cells WHERE col_no < 3 GROUP BY ALL),
row_texts AS (SELECT table_key, row_no, c0 AS label, concat_ws(' ', c0, CASE WHEN c1 <> '' AND {_NO_DIGIT.format('c1')} THEN c1 END, CASE WHEN c2 <> '' AND {_NO_DIGIT.format('c2')} THEN c2 END) AS context FROM picked WHERE c0 <> '' AND {_NO_DIGIT.format('c0')})"""


def _activity(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(x, words)} THEN '{sc}'" for sc, words in scope.ACTIVITIES) + " END"


def oracle_sql() -> dict[str, str]:
    cy, cx = "(y0 + y1) / 2", "(x0 + x1) / 2"
    out = {
        "j01_positional": "words", "j02_word_regions": "words regions", "j03_tokens_in": "words regions", "j04_adjacent_headers": "words regions", "j05_grid_slot": "words regions", "j06_segments": "cells",
        "w01_reading_order": "words", "w02_vertical_groups": "words", "w03_column_groups": "words", "w04_virtual_panels": "words", "w07_continuations": "regions", "w08_region_headers": "cells", "w10_text_columns": "words", "w14_chunk_starts": "words", "w15_overlap_vote": "esg_text", "w16_majority": "words",
        "t02_assemble": "words", "t03_densify": "cells", "t04_clean": "cells", "t07_header_rows": "cells", "t08_header_columns": "cells", "t10_facts": "cells", "t11_table_text": "cells", "t12_row_texts": "cells", "f05_structure": "cells", "f08_route": "blocks",
        "r01_resolve": "esg_text", "r02_table_scope": "esg_text", "a04_scope_shares": "esg_text", "a05_scope_rollup": "esg_text", "q_scope_values": "esg_text", "r04_activity_scope": "blocks", "q_facts": "cells",
    }
    numeric = "len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda q: regexp_matches(regexp_replace(q, 'VND|[,.()\\-% ]', '', 'g'), '^[\\p{Nd}²³¹⁰⁴-⁹₀-₉]+$') AND length(regexp_replace(q, '\\D', '', 'g')) >= 2 AND length(regexp_replace(q, '[^.]', '', 'g')) <= 1)) > 0"
    body = {
        "j01_positional": "SELECT page, ocr_index, a.text, b.layout_label, a.text IS NULL OR b.layout_label IS NULL AS error FROM (SELECT page, ocr_index, text FROM words WHERE ocr_index % 50 <> 7) a FULL JOIN (SELECT page, ocr_index, layout_label FROM words WHERE ocr_index % 60 <> 11) b USING (page, ocr_index)",
        "j02_word_regions": f", best AS (SELECT w.page, w.ocr_index, arg_min(r.label, (r.x1 - r.x0) * (r.y1 - r.y0) * 10000000 + r.ann_idx) AS label FROM words w JOIN regions r ON w.page = r.page AND (w.x0 + w.x1) / 2 BETWEEN r.x0 AND r.x1 AND (w.y0 + w.y1) / 2 BETWEEN r.y0 AND r.y1 GROUP BY ALL) SELECT page, ocr_index, coalesce(label, 'O') AS region_label FROM words LEFT JOIN best USING (page, ocr_index)",
        "j03_tokens_in": "SELECT w.page, r.ann_idx, w.ocr_index, w.x0 - r.x0 AS x0, w.y0 - r.y0 AS y0, w.x1 - r.x0 AS x1, w.y1 - r.y0 AS y1 FROM words w JOIN regions r ON w.page = r.page AND (w.x0 + w.x1) / 2 BETWEEN r.x0 AND r.x1 AND (w.y0 + w.y1) / 2 BETWEEN r.y0 AND r.y1",
        "j04_adjacent_headers": """, med AS (SELECT page, greatest(1, list_sort(list(y1 - y0))[count(*) // 2 + 1]) AS h FROM words WHERE layout_label = 'table' GROUP BY page),
            hit AS (SELECT r.page, r.ann_idx, r.x0, r.y0, r.x1, r.y1, w.x0 AS wx0, w.y0 AS wy0, w.x1 AS wx1, w.y1 AS wy1 FROM regions r JOIN med USING (page) LEFT JOIN words w ON w.page = r.page AND w.layout_label IN ('figure', 'table_text') AND least(w.x1, r.x1) > greatest(w.x0, r.x0) AND w.y0 <= r.y1 AND greatest(0, r.y0 - w.y1) <= 4 * h)
            SELECT page, ann_idx, min(least(x0, coalesce(wx0, x0))) AS x0, min(least(y0, coalesce(wy0, y0))) AS y0, max(greatest(x1, coalesce(wx1, x1))) AS x1, max(greatest(y1, coalesce(wy1, y1))) AS y1, count(wx0) AS n_headers FROM hit GROUP BY page, ann_idx""",
        "j05_grid_slot": """, slots AS (SELECT page, y0 AS s0, y0 + 60 AS s1, CAST(row_number() OVER (PARTITION BY page ORDER BY (y0 + y0 + 60) / 2, y0) - 1 AS INT) AS slot FROM regions WHERE label = 'table'),
            pairs AS (SELECT w.page, w.ocr_index, slot, greatest(0, least(y1, s1) - greatest(y0, s0)) / greatest(1.0, y1 - y0) AS score, abs((y0 + y1) / 2 - (s0 + s1) / 2) AS away, greatest(1.0, y1 - y0) AS size, row_number() OVER (PARTITION BY w.page, ocr_index ORDER BY greatest(0, least(y1, s1) - greatest(y0, s0)) / greatest(1.0, y1 - y0) DESC, abs((y0 + y1) / 2 - (s0 + s1) / 2), slot) AS k FROM words w JOIN slots s ON w.page = s.page)
            SELECT page, ocr_index, slot FROM pairs WHERE k = 1 AND (score >= 0.2 OR away <= size)""",
        "j06_segments": """, sizes AS (SELECT table_key, max(row_no) + 1 AS n, table_key // 3 AS group_id FROM cells GROUP BY table_key), offs AS (SELECT table_key, group_id, sum(n) OVER (PARTITION BY group_id ORDER BY table_key % 3) - n AS o FROM sizes)
            SELECT group_id, CAST(row_no + o AS INT) AS row_no, col_no, text FROM cells JOIN offs USING (table_key)""",
        "w01_reading_order": f"SELECT page, ocr_index, CAST(row_number() OVER (PARTITION BY page ORDER BY round_even({cy} / 8, 0), x0, ocr_index) - 1 AS INT) AS reading_no FROM words",
        "w02_vertical_groups": f""", med AS (SELECT page, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS h FROM words GROUP BY page), f AS (SELECT page, ocr_index, {cy} AS cy, CASE WHEN {cy} - lag({cy}) OVER (PARTITION BY page ORDER BY {cy}, ocr_index) > greatest(3.0 * h, 20) THEN 1 ELSE 0 END AS new FROM words JOIN med USING (page))
            SELECT page, ocr_index, CAST(sum(new) OVER (PARTITION BY page ORDER BY cy, ocr_index) AS BIGINT) AS v_group FROM f""",
        "w03_column_groups": f""", f AS (SELECT page, ocr_index, {cx} AS cx, CASE WHEN x0 - max(x1) OVER (PARTITION BY page ORDER BY {cx}, ocr_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > greatest(2 * list_sort(list(x1 - x0) OVER (PARTITION BY page))[count(*) OVER (PARTITION BY page) // 2 + 1], 0.05 * 960) THEN 1 ELSE 0 END AS new FROM words)
            SELECT page, ocr_index, CAST(sum(new) OVER (PARTITION BY page ORDER BY cx, ocr_index) AS BIGINT) AS h_group FROM f""",
        "w04_virtual_panels": f""", f AS (SELECT *, x0 - max(x1) OVER o AS gap, (x0 + max(x1) OVER o) / 2 AS mid FROM words WINDOW o AS (PARTITION BY page ORDER BY x0, x1, ocr_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            seams AS (SELECT page, max(struct_pack(gap := gap, mid := mid)) AS s FROM f WHERE gap >= 0.04 * 960 AND mid BETWEEN 0.4 * 960 AND 0.6 * 960 GROUP BY page),
            sided AS (SELECT f.page, ocr_index, {cx} AS cx, s.mid AS seam, count(*) FILTER ({cx} < s.mid) OVER (PARTITION BY f.page) AS l, count(*) FILTER ({cx} >= s.mid) OVER (PARTITION BY f.page) AS r FROM f LEFT JOIN seams USING (page))
            SELECT page, ocr_index, CASE WHEN seam IS NOT NULL AND l >= 5 AND r >= 5 AND cx >= seam THEN 1 ELSE 0 END AS panel FROM sided""",
        "w07_continuations": """, f AS (SELECT *, CASE WHEN x0 >= 350 THEN 1 ELSE 0 END AS panel, label = 'table' AS hh FROM regions),
            g AS (SELECT page, ann_idx, panel, y0, x0, CASE WHEN lag(panel) OVER o <> panel AND lag(y1) OVER o >= 900 AND y0 <= 360 AND lag(hh) OVER o AND NOT hh AND abs((x1 - x0) - (lag(x1) OVER o - lag(x0) OVER o)) / 600.0 <= 0.25 THEN 0 ELSE 1 END AS new FROM f WINDOW o AS (PARTITION BY page ORDER BY panel, y0, x0))
            SELECT page, ann_idx, CAST(sum(new) OVER (PARTITION BY page ORDER BY panel, y0, x0 ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS region_group FROM g""",
        "w08_region_headers": f"SELECT table_key, count(*) FILTER (regexp_matches(text, '(19|20)\\d{{2}}')) >= 2 OR coalesce(bool_or({_has('text', tuple(dict.fromkeys(DEFAULT.header_words + DEFAULT.metric_words)))}), false) AS has_header FROM cells GROUP BY table_key",
        "w10_text_columns": """, flow AS (SELECT *, row_number() OVER o AS n, lead(x0) OVER o AS nxt, max(x1) OVER (PARTITION BY page ORDER BY x0, ocr_index ROWS UNBOUNDED PRECEDING) AS rgt FROM words WHERE layout_label IN ('text', 'header', 'toc', 'figure') WINDOW o AS (PARTITION BY page ORDER BY x0, ocr_index)),
            cuts AS (SELECT page, max(struct_pack(gap := nxt - x0, k := -n, at := (x0 + nxt) / 2)) AS a, max(struct_pack(gap := nxt - rgt, k := -n, at := (rgt + nxt) / 2)) AS b, count(*) + 1 AS nf FROM flow WHERE nxt IS NOT NULL GROUP BY page),
            j AS (SELECT w.page, w.ocr_index, w.x0, a, b, nf, count(*) OVER p AS nw, count(*) FILTER (w.x0 < a.at) OVER p AS al, count(*) FILTER (w.x0 >= a.at) OVER p AS ar, count(*) FILTER (w.x0 < b.at) OVER p AS bl, count(*) FILTER (w.x0 >= b.at) OVER p AS br FROM words w LEFT JOIN cuts USING (page) WINDOW p AS (PARTITION BY w.page)),
            c AS (SELECT *, CASE WHEN nw < 10 OR nf < 8 THEN NULL WHEN a.gap >= 50 AND al >= 3 AND ar >= 3 THEN a.at WHEN b.gap >= 50 AND bl >= 3 AND br >= 3 THEN b.at END AS cut FROM j)
            SELECT page, ocr_index, CASE WHEN coalesce(x0 >= cut, false) THEN 1 ELSE 0 END AS text_column FROM c""",
        "w14_chunk_starts": "SELECT page, n, unnest(CASE WHEN n <= 60 THEN [CAST(0 AS BIGINT)] ELSE list_distinct(list_concat(range(0, n - 59, 30), [n - 60])) END) AS chunk_start FROM (SELECT page, count(*) AS n FROM words GROUP BY page)",
        "w15_overlap_vote": f""", l AS (SELECT page, block_id % 30 AS word_no, block_id // 30 AS chunk, CAST(unnest(range(4)) AS INT) AS cls, unnest([{', '.join(_p)}]) AS p FROM esg_text), a AS (SELECT page, word_no, chunk, cls, avg(p) AS p FROM l GROUP BY ALL), b AS (SELECT page, word_no, cls, avg(p) AS p FROM a GROUP BY ALL),
            k AS (SELECT *, CAST(row_number() OVER (PARTITION BY page, word_no ORDER BY round(p, 9) DESC, cls) AS INT) AS k FROM b) SELECT page, word_no, cls, round(p, 6) AS score FROM k WHERE k = 1""",
        "w16_majority": ", a AS (SELECT page, y0, layout_label, count(*) AS n, min(ocr_index) AS f FROM words GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY page, y0 ORDER BY n DESC, f) AS INT) AS k FROM a) SELECT page, y0, layout_label, n AS votes FROM k WHERE k = 1",
        "t02_assemble": "SELECT page AS table_key, CAST(y0 // 100 AS INT) AS row_no, CAST(x0 // 200 AS INT) AS col_no, string_agg(text, ' ' ORDER BY round_even((y0 + y1) / 2 / 8, 0), x0, ocr_index) AS text FROM words GROUP BY ALL",
        "t03_densify": ", f AS (SELECT table_key, CAST(r AS INT) AS row_no, CAST(unnest(range(cols + 1)) AS INT) AS col_no FROM (SELECT table_key, cols, unnest(range(rows + 1)) AS r FROM all_tables)) SELECT table_key, row_no, col_no, coalesce(text, '') AS text FROM f LEFT JOIN cells USING (table_key, row_no, col_no)",
        "t04_clean": f""", c AS (SELECT table_key, row_no, col_no, coalesce(text, '') AS text FROM cells),
            r AS (SELECT table_key, row_no, count(*) FILTER (regexp_matches(text, '\\S')) AS n, bool_or({numeric}) AS num, bool_or(regexp_matches(text, '\\S') AND len(string_split({_norm('text')}, ' ')) >= 15 AND len(list_filter(string_split({_norm('text')}, ' '), lambda q: regexp_matches(q, '\\d'))) <= 2 AND length(regexp_replace(text, '[^,.;]', '', 'g')) >= 2) AS par, max(col_no) FILTER (regexp_matches(text, '\\S')) AS last FROM c GROUP BY ALL),
            k AS (SELECT table_key, row_no, CAST(row_number() OVER (PARTITION BY table_key ORDER BY row_no) - 1 AS INT) AS nr, max(last) OVER (PARTITION BY table_key) AS m FROM r WHERE n > 0 AND NOT (n = 1 AND NOT num AND par)),
            f AS (SELECT table_key, row_no, nr, CAST(unnest(range(m + 1)) AS INT) AS col_no FROM k) SELECT table_key, nr AS row_no, col_no, coalesce(text, '') AS text FROM f LEFT JOIN c USING (table_key, row_no, col_no)""",
        "t07_header_rows": f", {_MARKED} SELECT table_key, header_row, key_row, n_rows FROM head2",
        "t08_header_columns": f", {_MARKED} SELECT table_key, metric_col, unit_col, n_years FROM roles",
        "t10_facts": f", {_FACTS} SELECT *, table_key || '_' || row_no || '_' || col_no AS metric_id FROM facts WHERE value IS NOT NULL",
        "t11_table_text": f"SELECT table_key, string_agg(x, ' ' ORDER BY row_no, col_no) AS content FROM (SELECT table_key, row_no, col_no, {_norm('text')} AS x FROM cells) WHERE x <> '' GROUP BY table_key",
        "t12_row_texts": f", {_ROWTEXT} SELECT * FROM row_texts",
        "f05_structure": f"SELECT table_key, max(row_no) + 1 AS n_rows, max(col_no) + 1 AS n_cols, CASE WHEN max(row_no) + 1 < 1 THEN 'few_rows' WHEN max(col_no) + 1 < 2 THEN 'few_cols' WHEN NOT bool_or(coalesce({numeric}, false)) THEN 'no_numeric_cell' END AS reason FROM cells GROUP BY table_key",
        "f08_route": f", b AS (SELECT block_key, lower(coalesce(type, 'text')) AS k, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text FROM blocks) SELECT block_key, CASE WHEN k = 'toc' THEN 'toc' WHEN k IN ('table', 'table_text') OR length(text) < 5 THEN (CASE WHEN k IN ('header', 'footer') THEN k ELSE 'skipped' END) WHEN k IN ('header', 'footer') AND NOT {_ELIGIBLE} THEN k ELSE 'classified' END AS section FROM b",
        "r01_resolve": f", {_RESOLVED} SELECT page, block_id, scope, scope_id, round(confidence, 3) AS confidence, scope_source, decision_reason FROM resolved",
        "r02_table_scope": f""", {_RESOLVED}, v AS (SELECT page AS table_key, CASE WHEN scope <> 'Other' THEN scope END AS s, CASE WHEN scope <> 'Other' THEN confidence END AS c FROM resolved),
            a AS (SELECT table_key, count(DISTINCT s) AS n, min(s) AS one, min(c) AS low, avg(c) AS mean FROM v GROUP BY table_key)
            SELECT table_key, CASE WHEN n > 1 THEN 'Mixed' WHEN n = 1 THEN one ELSE 'Other' END AS scope, round(round(CASE WHEN n > 1 THEN low WHEN n = 1 THEN mean ELSE 0.0 END, 3), 2) AS confidence, CASE WHEN n > 1 THEN 'row_consensus_mixed' WHEN n = 1 THEN 'row_consensus' ELSE 'unresolved' END AS scope_source FROM a""",
        "a04_scope_shares": f", {_RESOLVED}, c AS (SELECT scope, count(*) AS n FROM resolved GROUP BY scope) SELECT scope, n, round(100.0 * n / sum(n) OVER (), 4) AS pct, CAST(row_number() OVER (ORDER BY n DESC, scope) AS INT) AS place FROM c",
        "a05_scope_rollup": f", {_RESOLVED} SELECT page, scope, grouping(page, scope) AS level, count(*) AS n FROM resolved GROUP BY ROLLUP (page, scope)",
        "q_scope_values": f", {_RESOLVED} SELECT scope, unit, count(*) AS n, round(sum(value), 3) AS total FROM resolved GROUP BY ALL",
        "r04_activity_scope": f"SELECT block_key, {_activity('text')} AS scope, coalesce({_has('text', scope.CARBON_SIGNALS)} AND regexp_matches(text, '\\d'), false) AS candidate FROM blocks",
        "q_facts": f""", {_FACTS}, {_ROWTEXT} SELECT f.table_key, f.row_no, f.col_no, r.company, coalesce(f.year, r.year) AS year, r.year AS report_year, a.page, f.metric_text, f.value, f.unit,
            coalesce({_activity("concat_ws(' ', f.metric_text, x.context)")}, 'Other') AS scope, f.is_esg FROM facts f LEFT JOIN row_texts x USING (table_key, row_no) LEFT JOIN all_tables a ON a.table_key = f.table_key LEFT JOIN report_files r ON r.report_id = a.report_id WHERE f.value IS NOT NULL""",
    }
    sql = {name: "WITH " + ", ".join(i.SQL[n] for n in out[name].split()) + " " + b for name, b in body.items()}
    for name in ("j01_positional", "j02_word_regions"):  # read twice or joined on ranges: each relation is made once
        sql[name] = sql[name].replace("words AS (", "words AS MATERIALIZED (", 1).replace("regions AS (", "regions AS MATERIALIZED (", 1)
    return sql | {
        "r05_merge_sources": """WITH r AS (SELECT site_code, indicator, year, CASE WHEN regexp_matches(type, '(?i)table') THEN 'table' WHEN regexp_matches(type, '(?i)chart|figure') THEN 'chart' ELSE 'text' END AS source, value FROM layoutlmv3_layout WHERE site_code IS NOT NULL AND value IS NOT NULL),
            k AS (SELECT *, CAST(row_number() OVER (PARTITION BY site_code, indicator, year ORDER BY CASE source WHEN 'table' THEN 1 WHEN 'chart' THEN 2 ELSE 3 END, value) AS INT) AS k FROM r),
            a AS (SELECT site_code, indicator, year, count(*) AS n_support, list_sort(list(DISTINCT source)) AS sources, max(value) - min(value) > 1e-9 AS conflict FROM r GROUP BY ALL)
            SELECT site_code, indicator, year, value, source, n_support, sources, conflict FROM a JOIN (SELECT * FROM k WHERE k = 1) USING (site_code, indicator, year)""",
        "r07_trend": """WITH p AS (SELECT indicator, year, avg(value) AS value FROM layoutlmv3_layout WHERE value IS NOT NULL AND indicator IS NOT NULL GROUP BY ALL),
            a AS (SELECT indicator, regr_slope(value, year) AS slope, count(*) AS n FROM p GROUP BY indicator) SELECT indicator, round(slope, 2) AS slope, n, CASE WHEN slope IS NULL OR slope = 0 THEN 'flat' WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction FROM a""",
    }



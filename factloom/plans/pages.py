"""Queries of pages whose SQL needs recursion: lines, paragraphs, blocks, promoted labels, table regions and page logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.lexicon import BLOCK_LABELS, DEFAULT
from factloom.operators import layout, regions
from factloom.plans import inputs as i
from factloom.plans.functions import _S, _clean, _trim
from factloom.functions import numbers as n

S = SparkSession
WORD = ["page", "ocr_index"]
SIZE = (i.PAGE_WIDTH, i.PAGE_HEIGHT)


def w05_aligned_groups(s: S, d: str) -> DataFrame:
    w = layout.vertical_groups(i.words(s, d))
    return layout.aligned_groups(layout.column_groups(w, i.PAGE_WIDTH, within=("page", "v_group")), ("v_group",))


def w11_lines(s: S, d: str) -> DataFrame:
    return layout.lines(i.words(s, d))


def w12_paragraphs(s: S, d: str) -> DataFrame:
    w = i.words(s, d)
    return layout.paragraphs(w, layout.lines(w))


def w13_promoted(s: S, d: str) -> DataFrame:
    return layout.promoted_labels(i.words(s, d))


def a02_blocks(s: S, d: str) -> DataFrame:
    w = i.words(s, d)
    ln = layout.lines(w)
    return layout.blocks(w, layout.paragraphs(w, ln), ln)


def f07_text_blocks(s: S, d: str) -> DataFrame:
    w = i.words(s, d).withColumn("confidence", F.expr("(x0 % 101) / 100"))
    return layout.text_blocks(w).withColumn("confidence", F.round("confidence", 6))


def f02_table_groups(s: S, d: str) -> DataFrame:
    return regions.table_groups(i.words(s, d), *SIZE).select(*WORD, "panel", "v_group", "n_cluster", "row_group")


def f03_f04_regions(s: S, d: str) -> DataFrame:
    return regions.table_regions(i.words(s, d), *SIZE).withColumn("area_ratio", F.round("area_ratio", 6))


def a09_page_log(s: S, d: str) -> DataFrame:
    return regions.page_log(i.words(s, d), *SIZE)


OWN = (w05_aligned_groups, w11_lines, w12_paragraphs, w13_promoted, a02_blocks, f07_text_blocks, f02_table_groups, f03_f04_regions, a09_page_log)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OWN}


_WORDS = i.SQL["words"].replace("words AS (", "words AS MATERIALIZED (", 1)


def _lines(words: str) -> str:
    """W-11 over a relation of words: a recursion along the reading order of each page."""
    return f"""o AS MATERIALIZED (SELECT page, ocr_index, x0, x1, (y0 + y1) / 2 AS cy,
          row_number() OVER (PARTITION BY page ORDER BY round_even((y0 + y1) / 2 / 8, 0), x0, ocr_index) AS k FROM {words}),
        st AS MATERIALIZED (SELECT page, greatest(5.0, median(y1 - y0) * 0.5) AS near, median(x1 - x0) * 2.0 AS wide FROM {words} GROUP BY page),
        band(page, k, band, mean, size) AS (
          SELECT page, k, 0, CAST(cy AS DOUBLE), 1 FROM o WHERE k = 1
          UNION ALL SELECT o.page, o.k, band + CASE WHEN abs(cy - mean) <= near THEN 0 ELSE 1 END,
            CASE WHEN abs(cy - mean) <= near THEN mean + (cy - mean) / (size + 1) ELSE cy END, CASE WHEN abs(cy - mean) <= near THEN size + 1 ELSE 1 END
          FROM band JOIN o ON o.page = band.page AND o.k = band.k + 1 JOIN st ON st.page = o.page),
        across AS (SELECT o.page, ocr_index, band, x0, o.k,
          CASE WHEN lag(band) OVER w IS NULL OR band = lag(band) OVER w AND x0 - lag(x1) OVER w <= wide THEN 0 ELSE 1 END AS new
          FROM band JOIN o ON o.page = band.page AND o.k = band.k JOIN st ON st.page = o.page WINDOW w AS (PARTITION BY o.page ORDER BY band, x0, o.k)),
        lines AS MATERIALIZED (SELECT page, ocr_index, CAST(sum(new) OVER (PARTITION BY page ORDER BY band, x0, k ROWS UNBOUNDED PRECEDING) AS INT) AS line_no FROM across)"""


def _paragraphs(words: str) -> str:
    """W-12 over words and lines."""
    return f"""ln AS (SELECT page, line_no, min(x0) AS x0, min(y0) AS y0, max(y1) AS y1, avg(y1 - y0) AS h, trim(string_agg(text, ' ' ORDER BY x0, ocr_index)) AS text
          FROM {words} JOIN lines USING (page, ocr_index) GROUP BY page, line_no),
        lg AS (SELECT *, y0 - lag(y1) OVER w AS gap, lag(h) OVER w AS bh, lag(x0) OVER w AS bx, lag(text) OVER w AS bt FROM ln WINDOW w AS (PARTITION BY page ORDER BY line_no)),
        ty AS (SELECT *, coalesce(median(CASE WHEN gap >= 0 THEN gap END) OVER (PARTITION BY page), 2.0) AS typical FROM lg),
        pn AS (SELECT *, CASE WHEN coalesce(gap <= greatest(3.0, least(bh * 0.9, typical * 2.5 + 2)) AND abs(bx - x0) <= 40
            AND NOT (starts_with(text, '>') OR starts_with(text, '•') OR starts_with(text, '- ') OR regexp_matches(text, '(?i)^[\\s:;,.•·\\-–—>*]*scope\\s*[123]\\b'))
            AND NOT (regexp_matches(bt, '[.!?:]$') AND gap > typical + 1), false) THEN 0 ELSE 1 END AS new FROM ty),
        paras AS (SELECT page, line_no, CAST(sum(new) OVER (PARTITION BY page ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS paragraph_no, text FROM pn)"""


_BLOCKS = """bw AS (SELECT w.*, line_no, paragraph_no FROM {0} w JOIN lines USING (page, ocr_index) JOIN paras USING (page, line_no)),
    votes AS (SELECT page, paragraph_no, layout_label, count(*) AS n, min(ocr_index) AS f FROM bw GROUP BY ALL),
    top AS (SELECT page, paragraph_no, layout_label FROM (SELECT *, row_number() OVER (PARTITION BY page, paragraph_no ORDER BY n DESC, f) AS k FROM votes) WHERE k = 1),
    bl AS (SELECT page, paragraph_no, string_agg(text, ' ' ORDER BY line_no, x0, ocr_index) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
      count(DISTINCT line_no) AS num_lines, count(*) AS num_words{1} FROM bw GROUP BY ALL)"""

_PROMOTED = """h AS (SELECT page, greatest(1, list_sort(list(y1 - y0))[count(*) // 2 + 1]) AS h FROM words WHERE layout_label = 'table' GROUP BY page),
    fig AS MATERIALIZED (SELECT page, ocr_index, x0, y0, x1, y1, h FROM words JOIN h USING (page) WHERE layout_label = 'figure'),
    edge AS MATERIALIZED (SELECT a.page, a.ocr_index AS a, b.ocr_index AS b FROM fig a JOIN fig b ON a.page = b.page
      AND greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) <= 8 * a.h AND greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) <= 3 * a.h),
    reach(page, a, b) AS (SELECT page, ocr_index, ocr_index FROM fig UNION SELECT r.page, r.a, e.b FROM reach r JOIN edge e ON e.page = r.page AND e.a = r.b),
    comp AS (SELECT page, a AS ocr_index, min(b) AS c FROM reach GROUP BY ALL),
    cb AS (SELECT page, c, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, any_value(h) AS h FROM comp JOIN fig USING (page, ocr_index) GROUP BY ALL),
    near AS (SELECT DISTINCT cb.page, c FROM cb JOIN words t ON t.page = cb.page AND t.layout_label = 'table'
      AND greatest(0, greatest(cb.x0, t.x0) - least(cb.x1, t.x1)) <= 8 * h AND greatest(0, greatest(cb.y0, t.y0) - least(cb.y1, t.y1)) <= 4 * h)
    SELECT w.page, w.ocr_index, CASE WHEN near.c IS NOT NULL THEN 'table' ELSE layout_label END AS layout_label
    FROM words w LEFT JOIN comp USING (page, ocr_index) LEFT JOIN near ON near.page = w.page AND near.c = comp.c"""


def _vertical(words: str, out: str) -> str:
    """W-02 over pages of one panel."""
    return f"""{out}_m AS (SELECT page, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS mh FROM {words} GROUP BY page),
        {out}_f AS (SELECT w.*, CASE WHEN (y0 + y1) / 2 - lag((y0 + y1) / 2) OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, ocr_index) > greatest(3.0 * mh, 20) THEN 1 ELSE 0 END AS vn FROM {words} w JOIN {out}_m USING (page)),
        {out} AS MATERIALIZED (SELECT * EXCLUDE (vn), CAST(sum(vn) OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, ocr_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v_group FROM {out}_f)"""


def _aligned(words: str) -> str:
    """W-03 and W-05 over words with v_group: groups by wide gaps, joined again along a recursion over the groups."""
    part = "PARTITION BY page, v_group"
    return f"""cg AS (SELECT page, v_group, ocr_index, y0, y1, CASE WHEN x0 - max(x1) OVER ({part} ORDER BY (x0 + x1) / 2, ocr_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            > greatest(2 * list_sort(list(x1 - x0) OVER ({part}))[count(*) OVER ({part}) // 2 + 1], {DEFAULT.column_gap} * {i.PAGE_WIDTH}) THEN 1 ELSE 0 END AS new, (x0 + x1) / 2 AS cx FROM {words}),
        hg AS MATERIALIZED (SELECT page, v_group, ocr_index, y0, y1, CAST(sum(new) OVER ({part} ORDER BY cx, ocr_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS h_group FROM cg),
        gl AS MATERIALIZED (SELECT page, row_number() OVER (PARTITION BY page ORDER BY v_group, h_group) AS k, v_group, h_group, min(y0) AS t, max(y1) AS b,
            list_sort(list((y0 + y1) / 2)) AS mids, list(y1 - y0) AS hs FROM hg GROUP BY page, v_group, h_group),
        fold(page, k, v_group, t, b, mids, hs, row_group) AS (
          SELECT page, k, v_group, t, b, mids, hs, 0 FROM gl WHERE k = 1
          UNION ALL SELECT page, k, v_group, CASE WHEN j THEN least(t, ft) ELSE t END, CASE WHEN j THEN greatest(b, fb) ELSE b END,
            CASE WHEN j THEN list_sort(list_concat(fm, mids)) ELSE mids END, CASE WHEN j THEN list_concat(fh, hs) ELSE hs END, CASE WHEN j THEN rg ELSE rg + 1 END
          FROM (SELECT *, same AND common >= 0.65 AND coalesce(list_filter(reached, lambda x: x.i > second.i AND x.j > second.j)[1] IS NOT NULL, false) AS j FROM
            (SELECT *, list_filter(reached, lambda x: x.i > reached[1].i AND x.j > reached[1].j)[1] AS second FROM
              (SELECT *, list_filter(flatten(list_transform(range(1, len(fm) + 1), lambda p: list_transform(range(1, len(mids) + 1), lambda q: {{'i': p, 'j': q, 'd': abs(fm[p] - mids[q])}}))), lambda x: x.d <= near) AS reached FROM
                (SELECT g.*, f.t AS ft, f.b AS fb, f.mids AS fm, f.hs AS fh, f.row_group AS rg, f.v_group = g.v_group AS same,
                    greatest(0, least(f.b, g.b) - greatest(f.t, g.t)) / greatest(1.0, least(f.b - f.t, g.b - g.t)) AS common,
                    greatest(12.0, 0.75 * list_sort(list_concat(f.hs, g.hs))[len(list_concat(f.hs, g.hs)) // 2 + 1]) AS near
                  FROM fold f JOIN gl g ON g.page = f.page AND g.k = f.k + 1))))),
        ag AS MATERIALIZED (SELECT hg.page, hg.ocr_index, CAST(row_group AS INT) AS row_group FROM hg JOIN gl USING (page, v_group, h_group) JOIN (SELECT page, k, row_group FROM fold) USING (page, k))"""


_LENIENT = f"coalesce(len(list_filter(regexp_split_to_array({_trim('text')}, '{_S}+'), lambda p: regexp_matches({_clean('p')}, '{n.DIGITS}'))) > 0, false)"
_SEED = """seed AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page) AS n_page FROM words WHERE layout_label = 'table') WHERE n_page >= 5)"""
_GROUPS = f"""{_SEED}, {_vertical('seed', 'vg')}, cl AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY page, v_group) AS n_cluster FROM vg),
    lc AS MATERIALIZED (SELECT * FROM cl WHERE n_cluster >= 5), {_aligned('lc')}, tg AS MATERIALIZED (SELECT cl.*, row_group FROM cl LEFT JOIN ag USING (page, ocr_index))"""
_REGIONS = f"""{_GROUPS}, rg AS (SELECT page, row_group, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_tokens, count(*) FILTER ({_LENIENT}) AS n_numeric,
      greatest(1, list_sort(list(y1 - y0))[count(*) // 2 + 1]) AS mh FROM tg WHERE row_group IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
    hd AS (SELECT page, ocr_index, x0 AS wx0, y0 AS wy0, x1 AS wx1, y1 AS wy1 FROM words WHERE layout_label IN ('figure', 'table_text')),
    bx AS (SELECT r.page, r.row_group, min(least(x0, coalesce(wx0, x0))) AS x0, min(least(y0, coalesce(wy0, y0))) AS y0, max(greatest(x1, coalesce(wx1, x1))) AS x1, max(greatest(y1, coalesce(wy1, y1))) AS y1
      FROM rg r LEFT JOIN hd ON hd.page = r.page AND least(wx1, x1) > greatest(wx0, x0) AND wy0 <= y1 AND greatest(0, y0 - wy1) <= 4 * mh GROUP BY ALL),
    ar AS (SELECT b.*, n_tokens, n_numeric, (least({SIZE[0]}, b.x1 + 40) - greatest(0, b.x0 - 40)) * (least({SIZE[1]}, b.y1 + 40) - greatest(0, b.y0 - 40)) / {SIZE[0] * SIZE[1]}.0 AS area_ratio
      FROM bx b JOIN rg USING (page, row_group)),
    regs AS MATERIALIZED (SELECT *, CASE WHEN area_ratio > 0.85 THEN 'region_too_large' WHEN n_numeric < 2 THEN 'no_numeric_content' END AS reason FROM ar)"""


def oracle_sql() -> dict[str, str]:
    labels = ", ".join(f"'{x}'" for x in BLOCK_LABELS)
    # W-10 over the prose words of a page, then one stream of lines for each column and one for the words of tables
    prose = f"""vw AS (SELECT *, (x0 % 101) / 100 AS confidence FROM words WHERE layout_label IN ({labels})),
        pw AS (SELECT * FROM vw WHERE layout_label IN ('text', 'figure')),
        flow AS (SELECT *, row_number() OVER o AS n, lead(x0) OVER o AS nxt, max(x1) OVER (PARTITION BY page ORDER BY x0, ocr_index ROWS UNBOUNDED PRECEDING) AS rgt FROM pw WINDOW o AS (PARTITION BY page ORDER BY x0, ocr_index)),
        cuts AS (SELECT page, max(struct_pack(gap := nxt - x0, k := -n, at := (x0 + nxt) / 2)) AS a, max(struct_pack(gap := nxt - rgt, k := -n, at := (rgt + nxt) / 2)) AS b, count(*) + 1 AS nf FROM flow WHERE nxt IS NOT NULL GROUP BY page),
        jj AS (SELECT w.page, w.ocr_index, w.x0, a, b, nf, count(*) OVER p AS nw, count(*) FILTER (w.x0 < a.at) OVER p AS al, count(*) FILTER (w.x0 >= a.at) OVER p AS ar, count(*) FILTER (w.x0 < b.at) OVER p AS bl, count(*) FILTER (w.x0 >= b.at) OVER p AS br FROM pw w LEFT JOIN cuts USING (page) WINDOW p AS (PARTITION BY w.page)),
        cc AS (SELECT *, CASE WHEN nw < 10 OR nf < 8 THEN NULL WHEN a.gap >= 50 AND al >= 3 AND ar >= 3 THEN a.at WHEN b.gap >= 50 AND bl >= 3 AND br >= 3 THEN b.at END AS cut FROM jj),
        parts AS (SELECT page, ocr_index, CASE WHEN coalesce(x0 >= cut, false) THEN 1 ELSE 0 END AS part FROM cc UNION ALL SELECT page, ocr_index, 2 FROM vw WHERE layout_label NOT IN ('text', 'figure')),
        sw AS MATERIALIZED (SELECT vw.* REPLACE (vw.page * 3 + part AS page) FROM vw JOIN parts USING (page, ocr_index))"""
    sql = {
        "w05_aligned_groups": f"{_vertical('words', 'vg')}, {_aligned('vg')} SELECT * FROM ag",
        "w11_lines": f"{_lines('words')} SELECT * FROM lines",
        "w12_paragraphs": f"{_lines('words')}, {_paragraphs('words')} SELECT * FROM paras",
        "a02_blocks": f"{_lines('words')}, {_paragraphs('words')}, {_BLOCKS.format('words', '')} SELECT bl.* RENAME (paragraph_no AS block_id), layout_label FROM bl JOIN top USING (page, paragraph_no)",
        "w13_promoted": _PROMOTED,
        "f07_text_blocks": f"""{prose}, {_lines('sw')}, {_paragraphs('sw')}, {_BLOCKS.format('sw', ', round(avg(confidence), 6) AS confidence')}
            SELECT bl.page // 3 AS page, CAST(bl.page % 3 AS INT) AS part, paragraph_no AS block_id, text, x0, y0, x1, y1, num_lines, num_words, confidence, layout_label FROM bl JOIN top USING (page, paragraph_no)""",
        "f02_table_groups": f"{_GROUPS} SELECT page, ocr_index, 0 AS panel, v_group, n_cluster, row_group FROM tg",
        "f03_f04_regions": f"{_REGIONS} SELECT page, row_group, x0, y0, x1, y1, n_tokens, n_numeric, round(area_ratio, 6) AS area_ratio, reason FROM regs",
        "a09_page_log": f"""{_REGIONS}, pg AS (SELECT page, count(*) FILTER (layout_label = 'table') AS n_table_tokens FROM words GROUP BY page),
            sm AS (SELECT page, count(DISTINCT v_group) AS too_few_table_tokens FROM cl WHERE n_cluster < 5 GROUP BY page),
            rs AS (SELECT page, count(*) FILTER (reason IS NULL) AS n_regions, count(*) FILTER (reason = 'region_too_large') AS region_too_large, count(*) FILTER (reason = 'no_numeric_content') AS no_numeric_content FROM regs GROUP BY page)
            SELECT page, n_table_tokens, coalesce(n_regions, 0) AS n_regions, coalesce(too_few_table_tokens, 0) AS too_few_table_tokens, coalesce(region_too_large, 0) AS region_too_large,
              coalesce(no_numeric_content, 0) AS no_numeric_content, n_table_tokens < 5 AS too_few FROM pg LEFT JOIN sm USING (page) LEFT JOIN rs USING (page)""",
    }
    return {name: f"WITH RECURSIVE {_WORDS}, {body}" for name, body in sql.items()}

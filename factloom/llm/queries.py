"""Queries of the operators in this subpackage over the project's tables, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import copies, lookalikes, mixing, overlap, personal, sampling, scanned, splitting, tokens
from factloom.runtime import table


def _sample(spark: SparkSession, d: str) -> sampling.Sample:
    return sampling.sample(table(spark, d, "scope_dataset_balanced"), table(spark, d, "sampling_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report.filter("short").select("plan_id", "scope")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).rows


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.corpus(table(spark, d, "layoutlmv3_layout", heavy=True), table(spark, d, "raw_documents", heavy=True))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.found(_texts(spark, d), ["tbl", "row_key", "page_no"])


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.normalise(_texts(spark, d), ["tbl", "row_key", "page_no"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.pairs(table(spark, d, "scope_dataset_balanced", heavy=True))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "scope_dataset_balanced", heavy=True))


def p3_exact(spark: SparkSession, d: str) -> DataFrame:
    return overlap.exact_report(table(spark, d, "scope_dataset_balanced", heavy=True))


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "layoutlmv3_layout", heavy=True), table(spark, d, "all_tables", heavy=True), table(spark, d, "report_files")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.found(*_scans(spark, d))


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    return scanned.repair(*_scans(spark, d))[0]


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    return scanned.repair(*_scans(spark, d))[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.groups(table(spark, d, "label_scope_dataset", heavy=True)).filter("row_id <> first_row_id").select("first_row_id", "row_id")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "label_scope_dataset", heavy=True))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    pages = splitting.pages(table(spark, d, "raw_documents", heavy=True), table(spark, d, "split_limits"))
    return splitting.split(pages, ["raw_id", "page_no"], "text", "max_chars", "overlap_chars")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter("n_pieces > 1 and piece_no = 0").select("raw_id", "page_no")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokens.offsets(table(spark, d, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).documents


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.items(table(spark, d, "documents"), table(spark, d, "name_lexicon")).select("doc_id", "kind", "start_pos")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_report, p1_sample, p2_found, p2_texts, p3_found, p3_report, p3_exact, p4_found, p4_blocks, p4_tables, p6_found, p6_records, p7_found, p7_pieces, p8_ids, p8_offsets, p9_mix, p9_report, p10_found, p10_redacted)
    return {f.__name__: f for f in own}


_CAT = r"coalesce(regexp_replace(lower({}), '[\s\-_]+', '', 'g'), 'other')"

_PLANS = f"""
goal AS (SELECT plan_id, scope, {_CAT.format("scope")} AS cat, target_pct, min_rows, sample_pct, min_quality FROM sampling_targets),
total AS (SELECT count(*) AS n FROM scope_dataset_balanced),
hit AS (SELECT g.plan_id, g.scope, g.target_pct, g.min_rows, r.row_id,
          row_number() OVER (PARTITION BY g.plan_id, g.cat ORDER BY md5('1|' || CAST(r.row_id AS VARCHAR)), r.row_id) AS rn
        FROM scope_dataset_balanced r JOIN goal g ON {_CAT.format("r.scope")} = g.cat AND r.quality_score >= g.min_quality),
plan AS (SELECT g.plan_id, g.scope, g.target_pct, g.min_rows, (t.n * g.sample_pct) // 100 AS sample_size,
           coalesce(h.eligible, 0) AS eligible,
           greatest(g.min_rows, (g.target_pct * ((t.n * g.sample_pct) // 100) + 99) // 100) AS needed
         FROM goal g CROSS JOIN total t
         LEFT JOIN (SELECT plan_id, scope, count(*) AS eligible FROM hit GROUP BY ALL) h USING (plan_id, scope)),
size AS (SELECT plan_id, greatest(max(sample_size), sum(least(min_rows, eligible))) AS n FROM plan GROUP BY plan_id),
ordered AS (SELECT plan_id, scope, row_id, row_number() OVER (PARTITION BY plan_id
              ORDER BY rn > min_rows, (CAST(rn AS DOUBLE) - 0.5) / target_pct, scope) AS place FROM hit),
kept AS (SELECT o.plan_id, o.scope, o.row_id FROM ordered o JOIN size s USING (plan_id) WHERE o.place <= s.n)
"""


def _squeeze(x: str) -> str:
    """Squeezed form in RE2, which has no look-around: marks between digits become private characters first."""
    for _ in range(2):
        x = f"regexp_replace(regexp_replace({x}, '(\\p{{Nd}}),(\\p{{Nd}})', '\\1\ue000\\2', 'g'), '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1\ue001\\2', 'g')"
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\ue000\ue001]+', '', 'g')"


_NAME = r"\p{L}[\p{L}\p{M} _]*\s*[:=]"
_COPIES = f"""
base AS (SELECT row_id, {_squeeze("lower(block_id)")} AS block, text, {_squeeze("lower(text)")} AS prose,
           list_filter(string_split(regexp_replace(text, '[|;\n]+(\\s*{_NAME})', '\ue002\\1', 'g'), '\ue002'), lambda p: {_squeeze("lower(p)")} <> '') AS parts
         FROM label_scope_dataset),
canon AS (SELECT row_id, block, CASE WHEN contains(text, ':') OR contains(text, '=') THEN
            CASE WHEN len(parts) >= 2 AND len(list_filter(parts, lambda p: NOT regexp_matches(p, '^\\s*[^\\p{{L}}\n]{{0,3}}\\s*{_NAME}'))) = 0
              THEN array_to_string(list_sort(list_transform(parts, lambda p: {_squeeze("lower(regexp_extract(p, '(?s)^(.*?)[:=]', 1))")} || '=' || {_squeeze("lower(regexp_extract(p, '(?s)^.*?[:=](.*)$', 1))")})), '|')
              ELSE prose END ELSE prose END AS t FROM base),
grouped AS (SELECT row_id, CASE WHEN block <> '' AND t <> '' THEN min(row_id) OVER (PARTITION BY block, t) ELSE row_id END AS first_row_id FROM canon)
"""


def oracle_sql() -> dict[str, str]:
    inner, hyphen = r"'(\p{Nd})[.,](\p{Nd})', '\1\2', 'g'", r"'([\p{L}\p{N}])-([\p{L}\p{N}])', '\1\2', 'g'"
    canon = "regexp_replace(lower(text), '[''’`]', '', 'g')"
    for step in (inner, inner, hyphen, hyphen):  # twice each, as matches may share a character
        canon = f"regexp_replace({canon}, {step})"
    canon = f"trim(regexp_replace({canon}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"
    return {
        "p1_found": f"WITH {_PLANS} SELECT plan_id, scope FROM plan WHERE eligible < needed",
        "p1_report": f"""WITH {_PLANS}, got AS (SELECT plan_id, scope, count(*) AS seats FROM kept GROUP BY ALL)
            SELECT plan_id, scope, target_pct, sample_size, eligible, CAST(needed AS BIGINT) AS needed, coalesce(seats, 0) AS seats,
              round(100.0 * coalesce(seats, 0) / greatest(1, sum(coalesce(seats, 0)) OVER (PARTITION BY plan_id)), 4) AS actual_pct, eligible < needed AS short
            FROM plan LEFT JOIN got USING (plan_id, scope)""",
        "p1_sample": f"WITH {_PLANS} SELECT plan_id, row_id, scope FROM kept",
        "p3_exact": f"""WITH c AS (SELECT split, source, {canon} AS canon FROM scope_dataset_balanced),
            seen AS (SELECT DISTINCT canon FROM c WHERE split = 'train' AND canon <> '')
            SELECT split, source, count(*) AS n_rows, count(s.canon) AS n_in_train FROM c LEFT JOIN seen s USING (canon)
            WHERE split <> 'train' GROUP BY split, source""",
        "p6_found": f"WITH {_COPIES} SELECT first_row_id, row_id FROM grouped WHERE row_id <> first_row_id",
        "p6_records": f"WITH {_COPIES} SELECT first_row_id AS row_id, count(*) AS copies FROM grouped GROUP BY first_row_id",
        "p7_found": """WITH p AS (SELECT raw_id, standard, unnest(pages) AS p FROM raw_documents)
            SELECT raw_id, p.page AS page_no FROM p LEFT JOIN split_limits l USING (standard)
            WHERE length(p.text) > coalesce(l.max_chars, (SELECT max_chars FROM split_limits WHERE standard = 'DEFAULT'))""",
    }

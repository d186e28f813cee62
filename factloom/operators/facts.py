"""The final record: facts of tables with scope, report and standard (Q-8, Q-9, Q-ESG)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import grid, scope


def scoped_facts(tables: DataFrame, reports: DataFrame) -> DataFrame:
    """(table_key, row_no, col_no, company, year, report_year, page, metric_text, value, unit, scope, is_esg).

    tables: table_key, report_id, page and the nested table_data, from which facts and row contexts are read together.
    Scope by activity words of metric and row context; a fact without year takes the report's. Facts of tables without
    report keep null company."""
    f = grid.table_facts(tables, carried=("report_id", "page"), context=True)
    f = f.join(reports.select("report_id", "company", F.col("year").alias("report_year")), "report_id", "left")
    s = F.coalesce(scope.activity_scope(F.concat_ws(" ", "metric_text", "context")), F.lit("Other"))
    return f.select("table_key", "row_no", "col_no", "company", F.coalesce("year", "report_year").alias("year"), "report_year", "page", "metric_text", "value", "unit", s.alias("scope"), "is_esg")

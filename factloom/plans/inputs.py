"""Relations over which the queries run, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.runtime import table

PAGE_WIDTH, PAGE_HEIGHT = 960, 1220  # of the derived words
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def cells(spark: SparkSession, d: str) -> DataFrame:
    """A row per table cell: table_key, row_no, col_no, text. Null rows have no cells."""
    rows = table(spark, d, "all_tables", heavy=True).select("table_key", F.posexplode("table_data").alias("row_no", "r"))
    return rows.select("table_key", "row_no", F.posexplode("r").alias("col_no", "text"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "layoutlmv3_layout", heavy=True).select("block_key", "report_id", "page", "block_id", "type", "text", "bbox", "confidence", "num_words")


def pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_documents", heavy=True).select("raw_id", "document", "standard", F.explode("pages").alias("p"))
    return p.select("raw_id", "document", "standard", F.col("p.page").alias("page_no"), F.col("p.text").alias("text"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """Words with boxes, about 64 a page, from order lines by integer arithmetic."""
    w = table(spark, d, "lineitem").withColumn("page", F.floor(F.col("l_orderkey") / 16)).withColumn("w", F.col("l_quantity").cast("int"))
    w = w.withColumn("x0", (F.col("l_partkey") * 37) % 900).withColumn("y0", (F.col("l_suppkey") * 91 + F.col("l_linenumber") * 13) % 1200)
    label = F.expr("case l_partkey % 6 when 0 then 'figure' when 1 then 'text' when 2 then 'table_text' when 3 then 'header' else 'table' end")
    text = F.expr("case when l_suppkey % 3 = 0 then cast(w * 1000 as string) else concat('w', l_partkey) end")
    return w.select(
        "page", (F.row_number().over(Window.partitionBy("page").orderBy(*ORDER)) - 1).alias("ocr_index"), "x0", "y0",
        (F.col("x0") + 20 + F.col("w")).alias("x1"), (F.col("y0") + 12 + F.col("l_linenumber")).alias("y1"), label.alias("layout_label"), text.alias("text"),
    )


def regions(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").withColumn("x0", (F.col("o_custkey") * 53) % 700).withColumn("y0", (F.col("o_orderkey") * 71) % 900)
    label = F.expr("case o_custkey % 4 when 0 then 'table' when 1 then 'text' when 2 then 'figure' else 'table_text' end")
    return r.select(F.floor(F.col("o_orderkey") / 16).alias("page"), F.col("o_orderkey").alias("ann_idx"), label.alias("label"), "x0", "y0", (F.col("x0") + 100 + F.col("o_orderkey") % 200).alias("x1"), (F.col("y0") + 100 + F.col("o_custkey") % 300).alias("y1"))


def esg_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of every branch of the scope rules, with class scores, from order lines."""
    w = table(spark, d, "lineitem", heavy=True).withColumn("q", F.col("l_quantity").cast("int").cast("string")).withColumn("q3", F.expr("lpad(q, 3, '0')"))
    text = F.expr("""case l_orderkey % 9 when 0 then concat('Scope 1 emissions were ', q, ' tCO2e in 2024')
        when 1 then concat('Scope 1 and Scope 2 combined: 1,', q3, ' tCO2e') when 2 then concat('Purchased electricity ', q, ' MWh')
        when 3 then concat('Office rent rose by ', q, '%') when 4 then 'The weather is nice today' when 5 then 'Fuel and refrigerant use increased'
        when 6 then 'SCOPE 3 business travel' when 7 then 'ok' else concat('Heat ', q, '.5 GJ') end""")
    page = F.floor(F.col("l_orderkey") / 16)
    return w.select(
        page.alias("page"), (F.row_number().over(Window.partitionBy(page).orderBy(*ORDER)) - 1).alias("block_id"), text.alias("text"),
        (F.col("l_partkey") % 7 + 1).alias("a0"), (F.col("l_suppkey") % 7 + 1).alias("a1"), (F.col("l_linenumber") % 7 + 1).alias("a2"), (F.col("l_orderkey") % 7 + 1).alias("a3"),
    )


BUILD = {"cells": cells, "blocks": blocks, "pages": pages, "words": words, "regions": regions, "esg_text": esg_text}

_ORDER = ", ".join(ORDER)
SQL = {
    "cells": """cells AS (SELECT table_key, row_no, CAST(unnest(range(len(rw))) AS INT) AS col_no, unnest(rw) AS text FROM
        (SELECT table_key, CAST(unnest(range(len(table_data))) AS INT) AS row_no, unnest(table_data) AS rw FROM all_tables))""",
    "blocks": "blocks AS (SELECT block_key, report_id, page, block_id, type, text, bbox, confidence, num_words FROM layoutlmv3_layout)",
    "pages": "pages_ AS (SELECT raw_id, document, standard, p.page AS page_no, p.text AS text FROM (SELECT raw_id, document, standard, unnest(pages) AS p FROM raw_documents))",
    "words": f"""words AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY {_ORDER}) - 1 AS INT) AS ocr_index, x0, y0, x0 + 20 + w AS x1, y0 + 12 + l_linenumber AS y1,
        CASE l_partkey % 6 WHEN 0 THEN 'figure' WHEN 1 THEN 'text' WHEN 2 THEN 'table_text' WHEN 3 THEN 'header' ELSE 'table' END AS layout_label,
        CASE WHEN l_suppkey % 3 = 0 THEN CAST(w * 1000 AS STRING) ELSE 'w' || l_partkey END AS text
        FROM (SELECT *, CAST(floor(l_orderkey / 16) AS BIGINT) AS page, (l_partkey * 37) % 900 AS x0, (l_suppkey * 91 + l_linenumber * 13) % 1200 AS y0, CAST(l_quantity AS INT) AS w FROM lineitem))""",
    "regions": """regions AS (SELECT CAST(floor(o_orderkey / 16) AS BIGINT) AS page, o_orderkey AS ann_idx,
        CASE o_custkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'text' WHEN 2 THEN 'figure' ELSE 'table_text' END AS label, (o_custkey * 53) % 700 AS x0, (o_orderkey * 71) % 900 AS y0,
        (o_custkey * 53) % 700 + 100 + o_orderkey % 200 AS x1, (o_orderkey * 71) % 900 + 100 + o_custkey % 300 AS y1 FROM orders)""",
    "esg_text": f"""esg_text AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY {_ORDER}) - 1 AS INT) AS block_id,
        CASE l_orderkey % 9 WHEN 0 THEN 'Scope 1 emissions were ' || q || ' tCO2e in 2024' WHEN 1 THEN 'Scope 1 and Scope 2 combined: 1,' || q3 || ' tCO2e'
        WHEN 2 THEN 'Purchased electricity ' || q || ' MWh' WHEN 3 THEN 'Office rent rose by ' || q || '%' WHEN 4 THEN 'The weather is nice today'
        WHEN 5 THEN 'Fuel and refrigerant use increased' WHEN 6 THEN 'SCOPE 3 business travel' WHEN 7 THEN 'ok' ELSE 'Heat ' || q || '.5 GJ' END AS text,
        l_partkey % 7 + 1 AS a0, l_suppkey % 7 + 1 AS a1, l_linenumber % 7 + 1 AS a2, l_orderkey % 7 + 1 AS a3
        FROM (SELECT *, CAST(floor(l_orderkey / 16) AS BIGINT) AS page, CAST(CAST(l_quantity AS INT) AS STRING) AS q, lpad(CAST(CAST(l_quantity AS INT) AS STRING), 3, '0') AS q3 FROM lineitem))""",
}
NAME = {"pages": "pages_"}

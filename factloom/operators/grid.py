"""Table grids as long cells (table_key, row_no, col_no, text) and the facts in them (T-02..T-10, F-05, F-06, F-12)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers as n
from factloom.functions import text as t
from factloom.lexicon import DEFAULT, Config
from factloom.operators import unpivot

KEY = ["table_key", "row_no", "col_no"]


def assemble(tokens: DataFrame) -> DataFrame:
    """T-02: cells from tokens (table_key, row_no, col_no, x0, y0, y1, ocr_index, text), joined in reading order."""
    order = F.struct(F.bround((F.col("y0") + F.col("y1")) / 2 / 8, 0).alias("k"), "x0", "ocr_index", "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), " ")
    return tokens.groupBy(*KEY).agg(text.alias("text"))


def densify(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """T-03: every cell of the grid, '' where there was none. sizes: table_key, n_rows, n_cols."""
    full = sizes.filter("n_rows > 0 and n_cols > 0").select("table_key", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_no"), "n_cols")
    full = full.select("table_key", "row_no", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col_no"))
    return full.join(cells, KEY, "left").withColumn("text", F.coalesce("text", F.lit("")))


def clean(cells: DataFrame) -> DataFrame:
    """T-04: without empty rows, rows of one paragraph cell and trailing empty columns; short rows padded, rows renumbered.

    Null cells count as ''. A table whose cells are all empty vanishes."""
    c = cells.withColumn("text", F.coalesce("text", F.lit("")))
    some = F.col("text").rlike(r"\S")
    rows = c.groupBy("table_key", "row_no").agg(F.count_if(some).alias("n"), F.bool_or(n.is_numeric(F.col("text"))).alias("numeric"), F.bool_or(some & t.paragraph_cell(F.col("text"))).alias("paragraph"), F.max(F.when(some, F.col("col_no"))).alias("last"))
    rows = rows.filter((F.col("n") > 0) & ~((F.col("n") == 1) & ~F.col("numeric") & F.col("paragraph")))
    page = Window.partitionBy("table_key")
    rows = rows.withColumn("new_row", F.row_number().over(page.orderBy("row_no")) - 1).withColumn("last", F.max("last").over(page))
    full = rows.select("table_key", "row_no", "new_row", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("col_no"))
    return full.join(c, KEY, "left").select("table_key", F.col("new_row").alias("row_no"), "col_no", F.coalesce("text", F.lit("")).alias("text"))


def join_continuations(cells: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """T-05: physical rows that belong to one logical row merged, from three rows on and below a row with a key column.

    A row without key goes to the row below, in front, if it has cells only left of the key column or shares a text
    column with it; else to the row above. A row with a key only goes to the row above if that one's key has an open
    bracket or ends with - , or /, or its own key begins in lower case. Each merge changes what later rows see, so it
    is a fold over the rows of one table."""
    keys = tuple(dict.fromkeys([*config.metric_words, "name", "building"]))
    numeric = lambda s: any(x.strip(",.()-%").replace(",", "").replace(".", "").isdigit() for x in s.split())

    def run(p: pd.DataFrame) -> pd.DataFrame:
        width = int(p.col_no.max()) + 1
        grid = [[""] * width for _ in range(int(p.row_no.max()) + 1)]
        for r, c, x in zip(p.row_no, p.col_no, p.text):
            grid[r][c] = x or ""
        head = next(((r, c) for r in range(min(4, len(grid))) for c in range(width) if any(k in " ".join(grid[r][c].split()).lower() for k in keys)), None)
        if len(grid) >= 3 and head:
            done, key = grid[: head[0] + 1], head[1]
            below = grid[head[0] + 1 :]
            first = len(done)
            while below:
                row, rest = below[0], below[1:]
                above = done[-1] if len(done) > first else None
                own = row[key].strip()
                filled = [c for c, x in enumerate(row) if x.strip()]
                if not own and rest and (filled and max(filled) < key or rest[0][key].strip() and any(row[c].strip() and rest[0][c].strip() and not numeric(row[c]) and not numeric(rest[0][c]) for c in range(width))):
                    below = [[" ".join(x for x in (a.strip(), b.strip()) if x) if a.strip() else b for a, b in zip(row, rest[0])], *rest[1:]]
                    continue
                upper = above[key].strip() if above else ""
                hanging = upper.count("(") > upper.count(")") or upper.endswith(("-", ",", "/")) or own[:1].islower()
                if upper and (not own or not any(x.strip() for x in row[key + 1 :]) and hanging):
                    done[-1] = [" ".join(x for x in (a.strip(), b.strip()) if x) if b.strip() else a for a, b in zip(above, row)]
                else:
                    done.append(row)
                below = rest
            grid = done
        out = [(p.table_key.iloc[0], r, c, x) for r, row in enumerate(grid) for c, x in enumerate(row)]
        return pd.DataFrame(out, columns=["table_key", "row_no", "col_no", "text"]).astype({"row_no": "int32", "col_no": "int32"})

    return cells.select(*KEY, "text").groupBy("table_key").applyInPandas(run, "table_key long, row_no int, col_no int, text string")


def combine_segments(cells: DataFrame, segments: DataFrame) -> DataFrame:
    """T-06, J-06: tables of one group stacked in order of seg_no, rows renumbered. segments: table_key, group_id, seg_no."""
    sizes = cells.groupBy("table_key").agg((F.max("row_no") + 1).alias("n_rows")).join(segments, "table_key")
    w = Window.partitionBy("group_id").orderBy("seg_no", "table_key")
    offset = sizes.withColumn("offset", F.sum("n_rows").over(w) - F.col("n_rows")).select("table_key", "group_id", "offset")
    return cells.join(offset, "table_key").select("group_id", (F.col("row_no") + F.col("offset")).cast("int").alias("row_no"), "col_no", "text")


def pad(cells: DataFrame, by: str) -> DataFrame:
    """T-06: every row of a group as wide as its widest one, '' where there was no cell; null cells stay null."""
    size = cells.groupBy(by).agg(F.max("col_no").alias("_last"))
    rows = cells.groupBy(by, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("_row")).join(size, by)
    full = rows.select(by, "row_no", "_row", F.explode(F.sequence(F.lit(0), "_last")).alias("col_no"))
    return full.select(by, "row_no", "col_no", F.when(F.map_contains_key("_row", F.col("col_no")), F.element_at("_row", F.col("col_no"))).otherwise("").alias("text"))


def segment_totals(cells: DataFrame, segments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """T-06: of each group the number of segments, rows, columns and numeric cells, the sum of their times, and whether a
    cell of any segment holds one of the table words. segments: table_key, group_id, tatr_time."""
    c = cells.groupBy("table_key").agg(
        (F.max("row_no") + 1).alias("n_rows"), (F.max("col_no") + 1).alias("n_cols"), F.count_if(n.is_numeric_lenient(F.col("text"))).alias("n_numeric"),
        F.bool_or(t.contains_any(F.col("text"), config.table_words)).alias("is_esg"),
    )
    j = segments.join(c, "table_key")
    sums = [F.sum(x).alias(x) for x in ("n_rows", "n_numeric")]
    return j.groupBy("group_id").agg(F.count("*").alias("n_segments"), *sums, F.max("n_cols").alias("n_cols"), F.sum("tatr_time").alias("tatr_time"), F.bool_or("is_esg").alias("is_esg"))


def _cell(c: DataFrame, config: Config) -> DataFrame:
    clean_ = t.normalize_text(F.col("text"))
    return c.select(
        *KEY, clean_.alias("x"), n.extract_year(clean_).alias("year"), t.contains_any(clean_, config.header_words).alias("head"), t.contains_any(clean_, config.metric_words).alias("metric"), t.contains_any(clean_, config.unit_words).alias("unit"), n.is_number(clean_).alias("number"),
        F.coalesce(n.last_year(F.col("text")), F.lit(None)).alias("fy"),
    )


def header_rows(marked: DataFrame) -> DataFrame:
    """T-07: (table_key, header_row, n_rows, width): the row of best header score, the earliest of equals, 0 if none."""
    hit = F.col("year").isNotNull() | F.col("head")
    score = 3 * hit.cast("int") + F.when(F.col("x") == "", 0).otherwise(5 * F.col("head").cast("int") + 3 * F.col("year").isNotNull().cast("int") + F.when(F.col("number"), -1).otherwise(1))
    rows = marked.groupBy("table_key", "row_no").agg(F.sum(score).alias("s"), F.count_if(F.col("x") != "").alias("n"), F.count("*").alias("width"), F.bool_or("metric").alias("metric"))
    ok = (F.col("n") > 1) & (F.col("s") > -1)
    best = F.max(F.when(ok, F.struct(F.col("s"), (-F.col("row_no")).alias("k"))))["k"]
    key_row = F.min(F.when(F.col("metric") & (F.col("row_no") < 4), F.col("row_no")))
    return rows.groupBy("table_key").agg(F.coalesce(-best, F.lit(0)).alias("header_row"), key_row.alias("key_row"), (F.max("row_no") + 1).alias("n_rows")).withColumn("key_row", F.coalesce("key_row", "header_row"))


def header_columns(marked: DataFrame, heads: DataFrame) -> DataFrame:
    """T-08: (table_key, header_row, key_row, n_rows, metric_col, unit_col, year_cols map): roles of the columns by the
    header cells; first maximum is the metric column, the last unit-like one the unit column."""
    score = 100 * F.col("metric").cast("int") - 100 * F.col("year").isNotNull().cast("int") - 50 * F.col("unit").cast("int") + 5 * ((F.col("x") != "") & ~F.col("number")).cast("int")
    h = marked.join(heads, "table_key").filter("row_no = key_row")
    return h.groupBy("table_key", "header_row", "key_row", "n_rows").agg(
        F.min(F.struct((-score).alias("s"), "col_no"))["col_no"].alias("metric_col"), F.max(F.when(F.col("unit"), F.col("col_no"))).alias("unit_col"), F.count_if(F.col("year").isNotNull()).alias("n_years")
    )


def facts(cells: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """T-09, T-10: wide tables to long facts.

    (table_key, row_no, col_no, metric_text, value, unit, year, year_source, is_esg, metric_id). Years come from the
    header row, else from all rows above the data (last 20xx of a cell, lower rows win), else none and every column but
    metric and unit is a value column. Rows without metric, of headings, totals and table words are skipped; of equal
    (metric, year, value, column) the first row stays. A table of one row takes its first text cell as metric."""
    return _marked_facts(unpivot.facts(cells, config, nested=False), config)


def table_facts(tables: DataFrame, config: Config = DEFAULT, carried: tuple[str, ...] = (), context: bool = False) -> DataFrame:
    """The facts of nested tables (table_key, table_data), which are never taken apart into a row per cell; carried, context: see unpivot."""
    return _marked_facts(unpivot.facts(tables, config, True, carried, context), config)


def _marked_facts(f: DataFrame, config: Config) -> DataFrame:
    rest = f.columns[8:]
    esg = t.contains_any(F.concat("metric_text", F.lit(" "), "unit"), config.table_words)
    return f.select(*f.columns[:8], esg.alias("is_esg"), F.concat_ws("_", *KEY).alias("metric_id"), *rest)


def structure_ok(cells: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """F-05, F-06, E13: (table_key, n_rows, n_cols, reason): reason is null for tables worth reading."""
    a = cells.groupBy("table_key").agg((F.max("row_no") + 1).alias("n_rows"), (F.max("col_no") + 1).alias("n_cols"), F.bool_or(n.is_numeric(F.col("text"))).alias("numeric"))
    return a.select("table_key", "n_rows", "n_cols", F.when(F.col("n_rows") < config.least_rows, "few_rows").when(F.col("n_cols") < config.least_cols, "few_cols").when(~F.col("numeric"), "no_numeric_cell").alias("reason"))

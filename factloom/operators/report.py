"""Summaries, top-k lists and unions behind the reports (A-01..A-18, K-01..K-11, S-13, S-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as t


def type_counts(blocks: DataFrame, page: list[str]) -> DataFrame:
    """A-01: (page, n_blocks, types): counts by lower-case type as a sorted array of (type, n)."""
    a = blocks.groupBy(*page, F.lower(F.coalesce("type", F.lit("text"))).alias("type")).agg(F.count("*").alias("n"))
    return a.groupBy(*page).agg(F.sum("n").alias("n_blocks"), F.array_sort(F.collect_list(F.concat_ws(":", "type", "n"))).alias("types"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """A-04, A-10, A-13: counts, their share in per cent, and the place by count."""
    a = df.groupBy(by).agg(F.count("*").alias("n"))
    return a.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4)).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), F.asc_nulls_first(by))))


def totals(df: DataFrame, *by: str) -> DataFrame:
    """A-05, A-08: counts at every level of a roll-up; level tells how many keys are summed over."""
    return df.rollup(*by).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def first_words(words: DataFrame, n: int = 80) -> DataFrame:
    """A-06, K-03: number of words of a page, and its first n."""
    w = words.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("ocr_index")))
    return w.groupBy("page").agg(F.count("*").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= n, F.struct("k", "text")))), lambda x: x["text"]), " ").alias("first_words"))


def label_counts(words: DataFrame) -> DataFrame:
    """A-06: (page, labels): counts of the layout labels of a page, as a sorted array of label:n."""
    a = words.groupBy("page", "layout_label").agg(F.count("*").alias("n"))
    return a.groupBy("page").agg(F.array_sort(F.collect_list(F.concat_ws(":", "layout_label", "n"))).alias("labels"))


def first_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """K-03: the first n rows of each group."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("k") <= n)


def table_summary(tables: DataFrame) -> DataFrame:
    """A-07, Q-3: (n_tables, n_pages, n_cells, n_esg); pages are counted, not tables."""
    return tables.agg(F.count("*").alias("n_tables"), F.count_distinct("report_id", "page").alias("n_pages"), F.sum(F.col("rows").cast("long") * F.col("cols")).alias("n_cells"), F.count_if("is_esg").alias("n_esg"))


def length_stats(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """A-11, A-12: mean, least, greatest, quartiles of the number of words."""
    n = F.size(t.words_of(F.col(text)))
    q = lambda p: F.round(F.percentile(n, p), 4)
    return df.groupBy(*by).agg(F.round(F.avg(n), 4).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """A-11: (bin, n) of equal bins over low..high; values outside fall into bin 0 and bins + 1."""
    return df.select(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def best_per_class(df: DataFrame, by: str, score: str, key: str) -> DataFrame:
    """K-06: the key of the best score of each class, ties to the smaller key."""
    return df.groupBy(by).agg(F.min(F.struct((-F.col(score)).alias("s"), key)).alias("b")).select(by, F.col(f"b.{key}").alias(key), (-F.col("b.s")).alias(score))


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """K-07: n rows at random, the same ones on every run: those of the smallest md5(seed|key)."""
    return df.orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), key).limit(n)


def flat_rows(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """S-14, K-08: text blocks and tables as one relation of nine columns for CSV."""
    b = blocks.select("page", F.lit("text_block").alias("source"), F.col("block_id").cast("string").alias("block_id"), "type", "text", F.col("value").cast("string").alias("value"), "unit", "scope", F.col("confidence").cast("string").alias("confidence"))
    none = F.lit(None).cast("string")
    tb = tables.select("page", F.lit("table").alias("source"), F.col("table_key").cast("string").alias("block_id"), F.lit("table").alias("type"), F.col("content").alias("text"), none.alias("value"), none.alias("unit"), "scope", F.col("confidence").cast("string").alias("confidence"))
    return b.unionByName(tb)


def progress(steps: DataFrame) -> DataFrame:
    """A-18: percent done after each step: weights up to it by all weights, truncated."""
    w = Window.partitionBy(F.lit(1))
    return steps.withColumn("pct", (100 * F.sum("weight").over(w.orderBy("idx")) / F.sum("weight").over(w)).cast("int"))


def eta(elapsed: Column, pct: Column) -> Column:
    """W-18: seconds left, from 5 per cent on."""
    return F.when(pct > 5, F.round(elapsed / pct * (100 - pct), 3))

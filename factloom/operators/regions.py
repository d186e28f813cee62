"""Table regions of a page from its labelled words, and the log of what was skipped (F-01..F-04, A-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import geometry as g
from factloom.functions.numbers import is_numeric_lenient
from factloom.lexicon import DEFAULT, Config
from factloom.operators import layout, spatial

BOX = ("x0", "y0", "x1", "y1")
PART = ("page", "panel", "v_group")


def table_groups(words: DataFrame, width: int, height: int, config: Config = DEFAULT) -> DataFrame:
    """F-01, F-02: the words labelled table of pages and clusters that have enough of them, with panel, v_group (cluster),
    n_cluster and row_group, the group within the page. Words of clusters that are too small keep a null row_group."""
    seed = words.filter("layout_label = 'table'").withColumn("n_page", F.count("*").over(Window.partitionBy("page")))
    seed = seed.filter(F.col("n_page") >= config.least_tokens)
    w = layout.vertical_groups(layout.virtual_panels(seed, width, height), config, within=("page", "panel"))
    w = w.withColumn("n_cluster", F.count("*").over(Window.partitionBy(*PART)))
    large = w.filter(F.col("n_cluster") >= config.least_tokens)
    grouped = layout.aligned_groups(layout.column_groups(large, width, config, within=PART), PART[1:])
    return w.join(grouped, ["page", "ocr_index"], "left")


def table_regions(words: DataFrame, width: int, height: int, config: Config = DEFAULT, grouped: DataFrame | None = None) -> DataFrame:
    """(page, row_group, x0, y0, x1, y1, n_tokens, n_numeric, area_ratio, reason): a row per group of enough table words.

    The box takes in the header words above it (J-04) and a margin (O-06). reason: region_too_large above 85 per cent of
    the page (F-03), else no_numeric_content below two words with numbers (F-04), else null: a region worth reading."""
    w = table_groups(words, width, height, config) if grouped is None else grouped
    heights = g.upper_median(F.collect_list(F.col("y1") - F.col("y0")))
    a = w.filter("row_group is not null").groupBy("page", "row_group").agg(
        *[F.min(c).alias(c) for c in BOX[:2]], *[F.max(c).alias(c) for c in BOX[2:]], F.count("*").alias("n_tokens"),
        F.count_if(is_numeric_lenient(F.col("text"))).alias("n_numeric"), F.greatest(F.lit(1), heights).alias("median_h"),
    )
    a = a.filter(F.col("n_tokens") >= config.least_tokens)
    box = spatial.adjacent_headers(a, words, order="row_group").drop("n_headers")
    crop = g.expand(F.struct(*BOX), config.expand, config.expand, F.lit(width), F.lit(height))
    r = a.drop(*BOX, "median_h").join(box, ["page", "row_group"]).withColumn("area_ratio", g.area(crop) / F.lit(width * height))
    too_large, no_numbers = F.col("area_ratio") > config.most_region_area, F.col("n_numeric") < 2
    return r.withColumn("reason", F.when(too_large, "region_too_large").when(no_numbers, "no_numeric_content"))


def page_log(words: DataFrame, width: int, height: int, config: Config = DEFAULT) -> DataFrame:
    """A-09: a row per page: table words, regions worth reading, and how often each reason for skipping held; too_few: the
    page has too few table words to be looked at."""
    pages = words.groupBy("page").agg(F.count_if(F.col("layout_label") == "table").alias("n_table_tokens"))
    w = table_groups(words, width, height, config)
    small = w.filter(F.col("n_cluster") < config.least_tokens).groupBy("page").agg(F.count_distinct("panel", "v_group").alias("too_few_table_tokens"))
    r = table_regions(words, width, height, config, w).groupBy("page").agg(
        F.count_if(F.col("reason").isNull()).alias("n_regions"),
        *[F.count_if(F.col("reason") == x).alias(x) for x in ("region_too_large", "no_numeric_content")],
    )
    counts = ["n_regions", "too_few_table_tokens", "region_too_large", "no_numeric_content"]
    log = pages.join(small, "page", "left").join(r, "page", "left").fillna(0, counts)
    return log.select("page", "n_table_tokens", *counts, (F.col("n_table_tokens") < config.least_tokens).alias("too_few"))

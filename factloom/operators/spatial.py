"""Joins between words and regions of a page (J-01..J-05, J-07..J-13): equal page, then boxes as residual condition.

Words and regions meet per page only, so a join's size is bounded by the words of a page times its regions. No side is
broadcast by hint: Spark decides by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.geometry import overlap, upper_median

BOX = ("x0", "y0", "x1", "y1")


def _as(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


def word_regions(words: DataFrame, regions: DataFrame, key: list[str], order: str = "ann_idx", label: str = "label") -> DataFrame:
    """J-02: each word with the label of the smallest region that holds its centre; ties go to the earlier region; 'O'
    for words in none. `key`: columns that identify a word, the page first."""
    r = _as(regions.select("page", order, label, *BOX), "r_", ["page"]).withColumn("r_area", (F.col("r_x1") - F.col("r_x0")) * (F.col("r_y1") - F.col("r_y0")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = words.select(*key, *BOX).join(r, "page").filter(cx.between(F.col("r_x0"), F.col("r_x1")) & cy.between(F.col("r_y0"), F.col("r_y1")))
    best = hit.groupBy(*key).agg(F.min_by(f"r_{label}", F.struct("r_area", f"r_{order}")).alias("region_label"))
    return words.join(best, key, "left").withColumn("region_label", F.coalesce("region_label", F.lit("O")))


def tokens_in(words: DataFrame, regions: DataFrame, order: str = "ann_idx") -> DataFrame:
    """J-03: pairs of a region and each word whose centre it holds, the word in the region's frame."""
    r = _as(regions.select("page", order, *BOX), "r_", ["page", order])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = words.join(r, "page").filter(cx.between(F.col("r_x0"), F.col("r_x1")) & cy.between(F.col("r_y0"), F.col("r_y1")))
    return hit.select("page", order, "ocr_index", "text", *[(F.col(c) - F.col("r_x0" if c[0] == "x" else "r_y0")).alias(c) for c in BOX])


def adjacent_headers(regions: DataFrame, words: DataFrame, median_height: DataFrame | None = None, order: str = "ann_idx") -> DataFrame:
    """J-04: regions extended upward by the figure or table_text words above them that share some width and end at most
    four median heights away. Without `median_height` by page, each region brings its own median_h."""
    w = words.filter(F.col("layout_label").isin("figure", "table_text")).select("page", *[F.col(c).alias(f"w_{c}") for c in BOX])
    r = (regions if median_height is None else regions.join(median_height, "page")).join(w, "page", "left")
    near = (overlap(F.col("w_x0"), F.col("w_x1"), F.col("x0"), F.col("x1")) > 0) & (F.col("w_y0") <= F.col("y1")) & (F.greatest(F.lit(0), F.col("y0") - F.col("w_y1")) <= 4 * F.col("median_h"))
    pick = lambda c: F.when(near, F.col(f"w_{c}"))
    low, high = (lambda c: F.min(F.least(F.col(c), F.coalesce(pick(c), F.col(c))))), (lambda c: F.max(F.greatest(F.col(c), F.coalesce(pick(c), F.col(c)))))
    return r.groupBy("page", order).agg(low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"), F.count_if(near).alias("n_headers"))


def median_heights(words: DataFrame) -> DataFrame:
    """Upper median of the word heights of a page, 1 at least."""
    return words.groupBy("page").agg(F.greatest(F.lit(1), upper_median(F.collect_list(F.col("y1") - F.col("y0")))).alias("median_h"))


def grid_slot(tokens: DataFrame, slots: DataFrame, key: list[str], low: str, high: str, slot_low: str = "s0", slot_high: str = "s1", name: str = "slot") -> DataFrame:
    """J-05: index of the row or column each token falls into: the slot of largest overlap by token size, ties to the
    nearer centre, then the earlier slot; below 0.2 overlap only if the centre is within the token's size, else none.

    `slots`: page, slot_low, slot_high; their index is their place by centre."""
    center = (F.col(slot_low) + F.col(slot_high)) / 2
    s = slots.withColumn("slot_no", F.row_number().over(Window.partitionBy("page").orderBy(center, slot_low, slot_high)) - 1)
    size = F.greatest(F.lit(1.0), F.col(high) - F.col(low))
    score = overlap(F.col(low), F.col(high), F.col(slot_low), F.col(slot_high)) / size
    away = F.abs((F.col(low) + F.col(high)) / 2 - center)
    pair = tokens.join(s, "page").select(*key, "slot_no", score.alias("score"), away.alias("away"), size.alias("size"))
    best = pair.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("away").alias("d"), "slot_no", "size")).alias("b"))
    ok = (-F.col("b.s") >= 0.2) | (F.col("b.d") <= F.col("b.size"))
    return best.filter(ok).select(*key, F.col("b.slot_no").alias(name))


def positional(words: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """J-01: words with their labels by position; `error` marks positions that only one side has."""
    both = words.select(*key, F.lit(1).alias("_w"), *[c for c in words.columns if c not in key]).join(labels.withColumn("_l", F.lit(1)), key, "full_outer")
    return both.withColumn("error", F.col("_w").isNull() | F.col("_l").isNull()).drop("_w", "_l")



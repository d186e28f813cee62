"""Problem 9: one mix of several sources whose sizes in tokens follow target weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import tokens
from factloom.runtime import durable

BITS = 12  # buckets of a histogram: 4096, so no histogram has more than sources x 4096 rows


@dataclass(frozen=True)
class Mix:
    documents: DataFrame  #: doc key, source, n_tokens, copies (1 or more)
    report: DataFrame  #: one row per source of the targets


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = 9, path: str = f"{tokens.FOLDER}/{tokens.BYTE_BPE}") -> Mix:
    """Documents with their number of copies, so that each source gives its target share of the tokens.

    `targets`: source, target_pct, max_repeats. Without `total_tokens` the mix is as large as it can be while every
    source that has tokens meets its target within max_repeats. With it, a source that can't supply its share gives
    all it has max_repeats times and the report shows the shortfall; nothing is moved to other sources.
    A source's whole copies come first; the last, partial copy takes documents in hash order while they fit, so a
    source stays below its budget by less than one document and copy n+1 is nested in copy n. Budgets are cut by
    hash threshold: tokens are summed by hash bucket, only the boundary bucket is refined, nothing is sorted globally.
    Rows of other or null sources are no part of the mix. Null and empty texts have 0 tokens and are left out.
    Equal documents under different keys are different rows. Sources without documents: 0 tokens, share 0.
    """
    goal = targets.select(F.col(source).alias("source"), "target_pct", "max_repeats").dropna().dropDuplicates(["source"])
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = rows.join(goal.select("source"), "source", "left_semi")
    counted = tokens.count(rows, "key", "text", ["source"], path).filter("n_tokens > 0")
    hashed = durable(counted.withColumn("h", F.xxhash64(F.lit(seed), "key")).withColumn("b", F.shiftrightunsigned("h", 64 - BITS)))

    available = hashed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    plan = [r.asDict() for r in goal.join(available, "source", "left").fillna(0, ["docs", "tokens"]).collect()]  # a row per target
    can = [r for r in plan if r["tokens"] and r["target_pct"] > 0]
    total = total_tokens if total_tokens is not None else min((r["tokens"] * r["max_repeats"] * 100 // r["target_pct"] for r in can), default=0)
    for r in plan:
        budget = min(total * r["target_pct"] // 100, r["tokens"] * r["max_repeats"])
        r["budget"], r["whole"] = budget, budget // r["tokens"] if r["tokens"] else 0
        r["rest"] = budget - r["whole"] * r["tokens"]
    spark = df.sparkSession
    cuts = spark.createDataFrame([(r["source"], r["target_pct"], r["max_repeats"], r["docs"], r["tokens"], r["budget"], r["whole"], r["rest"]) for r in plan], "source string, target_pct int, max_repeats int, docs long, tokens long, budget long, whole long, rest long")

    # Level 1: the boundary bucket of each source. Level 2: the boundary sub-bucket in it. Level 3: order in that one.
    def boundary(hist: DataFrame, by: list[str], bucket: str, left: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(bucket)
        return hist.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))

    h1 = hashed.groupBy("source", "b").agg(F.sum("n_tokens").alias("n")).join(cuts.select("source", "rest"), "source")
    h1 = boundary(h1, ["source"], "b", "rest").filter("before <= rest and upto > rest").select("source", F.col("b").alias("b1"), (F.col("rest") - F.col("before")).alias("rest1"))
    marked = hashed.join(cuts.select("source", "whole", "rest", "tokens"), "source").join(h1, "source", "left")
    # no boundary: the rest holds every document (never so, as rest < tokens, unless the source is empty)
    marked = marked.withColumn("state", F.expr("case when b1 is null or b > b1 then 0 when b < b1 then 1 else 2 end"))
    inner = marked.filter("state = 2").withColumn("c", F.shiftrightunsigned(F.shiftleft("h", BITS), 64 - BITS))
    h2 = inner.groupBy("source", "c", "rest1").agg(F.sum("n_tokens").alias("n"))
    h2 = boundary(h2, ["source"], "c", "rest1").filter("before <= rest1 and upto > rest1").select("source", F.col("c").alias("c1"), (F.col("rest1") - F.col("before")).alias("rest2"))
    inner = inner.join(h2, "source", "left")
    inner = inner.withColumn("part", F.expr("case when c1 is null or c > c1 then 0 when c < c1 then 1 else 2 end"))
    last = inner.filter("part = 2").withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("source", "b", "c").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)))
    last = last.withColumn("part", F.expr("case when upto <= rest2 then 1 else 0 end"))
    columns = ["key", "source", "n_tokens", "whole"]
    chosen = marked.filter("state < 2").select(*columns, F.col("state").alias("extra")).unionByName(inner.filter("part < 2").select(*columns, F.col("part").alias("extra"))).unionByName(last.select(*columns, F.col("part").alias("extra")))
    documents = chosen.withColumn("copies", (F.col("whole") + F.col("extra")).cast("int")).filter("copies > 0").select("key", "source", "n_tokens", "copies")

    got = documents.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("used_docs"))
    report = cuts.join(got, "source", "left").fillna(0, ["mixed_tokens", "most_copies", "used_docs"])
    share = F.round(100 * F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))), 4)
    report = report.withColumn("actual_pct", F.coalesce(share, F.lit(0.0))).withColumn("short_tokens", F.greatest(F.lit(0), F.floor(F.lit(total).cast("long") * F.col("target_pct") / 100) - F.col("mixed_tokens")).cast("long"))
    report = report.select("source", "target_pct", "max_repeats", "docs", F.col("tokens").alias("available_tokens"), "used_docs", "most_copies", "mixed_tokens", "actual_pct", "short_tokens")
    return Mix(documents.withColumnsRenamed({"key": key, "source": source}), report.withColumnRenamed("source", source))

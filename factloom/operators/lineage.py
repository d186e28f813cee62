"""Integrity and resume: fingerprints, differences of key sets, work left to do (X-15, J-07, J-11..J-13, K-09, S-20, Z-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint_diff(a: DataFrame, b: DataFrame, keys: list[str], sha: str = "sha") -> DataFrame:
    """J-07: keys whose fingerprints differ or that only one side has; an empty result means both are equal."""
    j = a.select(*keys, F.col(sha).alias("sha_a")).join(b.select(*keys, F.col(sha).alias("sha_b")), keys, "full_outer")
    why = F.when(F.col("sha_a").isNull(), "only_b").when(F.col("sha_b").isNull(), "only_a").otherwise("changed")
    return j.filter(~F.col("sha_a").eqNullSafe(F.col("sha_b"))).withColumn("why", why)


def remaining(names: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """J-11, K-10, S-20: what isn't done yet."""
    return names.join(done.select(*keys), keys, "left_anti")


def label_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """K-09: labels of one side only, with the side."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.join(y, column, "left_anti").withColumn("side", F.lit("unknown")).unionByName(y.join(x, column, "left_anti").withColumn("side", F.lit("missing")))


def alignment(annotated: DataFrame, on_disk: DataFrame, key: str) -> DataFrame:
    """J-12: (key, problem): images without file, files without annotation, and sizes that disagree."""
    j = annotated.select(key, F.col("width").alias("w1"), F.col("height").alias("h1")).join(on_disk.select(key, F.col("width").alias("w2"), F.col("height").alias("h2")), key, "full_outer")
    problem = F.when(F.col("w2").isNull(), "no_file").when(F.col("w1").isNull(), "no_annotation").when((F.col("w1") != F.col("w2")) | (F.col("h1") != F.col("h2")), "size_differs")
    return j.select(key, problem.alias("problem")).filter("problem is not null")


def lookup(wanted: DataFrame, known: DataFrame, name: str, key_of) -> DataFrame:
    """J-13: wanted names with whether a known name has the same normalised form. key_of: Column -> Column."""
    k = known.select(key_of(F.col(name)).alias("k")).distinct().withColumn("found", F.lit(True))
    return wanted.withColumn("k", key_of(F.col(name))).join(k, "k", "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("k")


def next_step(done: DataFrame) -> DataFrame:
    """Z-10: (run_id, next_step): the step after the greatest completed one."""
    return done.groupBy("run_id").agg((F.max("step_index") + 1).alias("next_step"))

"""Labelled data sets: cleaning, de-duplication, scoring, balancing and splitting (D-01..D-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.lexicon import DEFAULT, Config


def complete(df: DataFrame, columns: tuple[tuple[str, str], ...], default_scope: str = "Other") -> DataFrame:
    """D-01: missing columns as nulls of their type, a missing scope as `default_scope`."""
    for name, kind in columns:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumn("scope", F.coalesce("scope", F.lit(default_scope)))


def keep_text(df: DataFrame, text: str = "text", config: Config = DEFAULT) -> DataFrame:
    """D-02: meaningful texts, and any that holds one of the words that rescue a short one."""
    return df.filter(t.meaningful(F.col(text), config) | t.contains_any(t.normalize_text(F.col(text)), config.rescue_words))


def _first(df: DataFrame, by: Column, tie: str) -> DataFrame:
    """The first row of each group as an aggregate, so a group that holds much of the table is combined before it moves."""
    score = F.col("semantic_score")
    order = F.struct(F.col("scope"), score.isNull().alias("n"), (-score).alias("s"), F.col(tie).alias("t"), F.struct(*df.columns).alias("row"))
    return df.groupBy(by.alias("_by")).agg(F.min(order)["row"].alias("row")).select("row.*")


def unique_texts(df: DataFrame, text: str = "text", tie: str = "row_id") -> DataFrame:
    """D-03: one row per normalised text: first by scope, then by score, nulls last, then by key."""
    return _first(df, F.lower(t.normalize_text(F.col(text))), tie)


def unique_blocks(df: DataFrame, block: str = "block_id", tie: str = "row_id") -> DataFrame:
    """D-04: one row per trimmed block id, in the same order; null and blank ids are one block."""
    return _first(df, t.py_trim(F.coalesce(F.col(block), F.lit(""))), tie)


def with_quality(df: DataFrame, name: str = "quality_score", config: Config = DEFAULT) -> DataFrame:
    """D-06: rows with their additive score from text, matched chunk, type, scope and semantic score."""
    low = lambda c: F.lower(t.normalize_text(F.col(c)))
    df = df.withColumn("_txt", low("text")).withColumn("_chunk", low("matched_chunk"))
    return df.withColumn(name, _quality(F.col("_txt"), F.col("_chunk"), config)).drop("_txt", "_chunk")


def _quality(txt: Column, chunk: Column, config: Config) -> Column:
    both = F.concat(txt, F.lit(" "), chunk)
    count = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))
    when = lambda cond, x: F.when(cond, x).otherwise(0.0)
    known = t.contains_any(both, config.dataset_words)
    kind = F.lower(t.py_trim(F.coalesce(F.col("type"), F.lit(""))))
    other = F.coalesce(F.col("scope") == "Other", F.lit(False))
    return (
        F.coalesce(F.col("semantic_score") * 2.0, F.lit(0.0))
        + F.when(count(txt) >= 6, 0.2).when(count(txt) >= 3, 0.1).otherwise(0.0)
        + when(known, 0.35) + when(t.contains_any(both, config.strong_words), 0.5)
        + F.when(kind == "text", 0.15).when(kind == "figure", -0.15).otherwise(0.0)
        + when((count(chunk) >= 3) & t.contains_any(chunk, config.dataset_words), 0.2)
        + when(F.length(txt) <= 8, -0.3) + when((F.length(txt) <= 20) & ~t.contains_any(txt, config.short_words), -0.2)
        + when(other & t.contains_any(both, config.other_words), 0.4) + when(other & t.contains_any(txt, config.other_topics), 0.3) + when(other & ~known, -0.4)
    )


def downsample(df: DataFrame, tie: str = "row_id", config: Config = DEFAULT) -> DataFrame:
    """D-07: the best rows of each class up to its target, with their rank; classes without target are left out.

    A tournament: rows meet in 4,096 parts of their class by the hash of their key, the best of each part in 64, the best
    of those in their class, and each round keeps no more than the target of a group. So no task sees more than a
    4,096th of a class, or 64 targets."""
    target = F.try_element_at(F.create_map(*[F.lit(x) for pair in config.class_targets for x in pair]), F.col("scope"))
    order = (F.desc("quality_score"), F.desc_nulls_last("semantic_score"), F.col(tie))
    kept = df.filter(target.isNotNull())
    for parts in (4096, 64, 1):
        part = F.pmod(F.xxhash64(tie), F.lit(parts))
        kept = kept.withColumn("class_rank", F.row_number().over(Window.partitionBy("scope", part).orderBy(*order))).filter(F.col("class_rank") <= target)
    return kept


def oversample(df: DataFrame, seed: int = 42, tie: str = "row_id", config: Config = DEFAULT) -> DataFrame:
    """D-08: (row key, scope, copies): how often each row of Scope 1 and Scope 2 is drawn again, with replacement and
    with its quality as weight, to reach the class target.

    The draws are the points (k + u) / need of systematic sampling on the cumulative weights, u from the seed: the
    same expectation as independent draws, reproducible, and a count per row without any join."""
    target = F.create_map(*[F.lit(x) for pair in config.class_targets for x in pair])
    w = F.greatest(F.coalesce("quality_score", F.lit(0.0)), F.lit(0.01))
    cls = Window.partitionBy("scope")
    some = df.filter(F.col("scope").isin("Scope 1", "Scope 2"))
    short = some.groupBy("scope").agg(F.count("*").alias("have")).withColumn("need", F.try_element_at(target, F.col("scope")) - F.col("have")).filter("need > 0")
    d = some.join(short.select("scope", "need"), "scope").withColumn("w", w)  # classes below their target only, hence small
    d = d.withColumn("upto", F.sum("w").over(cls.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(tie).cast("string"))), tie)) / F.sum("w").over(cls))
    u = (seed * 0.6180339887498949) % 1.0
    before = F.coalesce(F.lag("upto").over(cls.orderBy("upto", tie)), F.lit(0.0))
    d = d.withColumn("copies", (F.ceil(F.col("upto") * F.col("need") - u) - F.ceil(before * F.col("need") - u)).cast("int"))
    return d.filter("copies > 0").select(tie, "scope", "copies")


def _hex(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")))


def split(df: DataFrame, key: str = "row_id", seed: str = "42", train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """D-11, plain: train, validation and test by the hash of the key: no row moves, and a row keeps its part when others
    come or go."""
    h = F.conv(F.substring(_hex(seed, key), 1, 8), 16, 10).cast("double") / 2.0**32
    return df.withColumn("fold", F.when(h < train, "train").when(h < train + validation, "validation").otherwise("test"))


def stratified_split(df: DataFrame, by: str = "scope", key: str = "row_id", seed: str = "42", train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """D-11, stratified: the same shares in every class, exact to one row: of the n rows of a class in the order of their
    hash, those with (rank - 0.5) / n below the share go to train, and so on. A null class is a class of its own; equal
    keys are ordered anyhow.

    A rank is the number of rows in the hash buckets before, from a histogram of 4,096 buckets a class, and the place in
    the own bucket; no class is sorted as a whole."""
    rows = df.withColumn("_h", _hex(seed, key)).withColumn("_b", F.substring("_h", 1, 3))
    hist = rows.groupBy(F.col(by).alias("_by"), "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_by")
    hist = hist.withColumn("_before", F.sum("_n").over(whole.orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(whole)).withColumnRenamed("_b", "_bucket")
    j = rows.join(hist, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_bucket")))
    at = (F.col("_before") + F.row_number().over(Window.partitionBy(by, "_b").orderBy("_h", key)) - 0.5) / F.col("_all")
    return j.withColumn("fold", F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test")).select(*df.columns, "fold")


def split_leaks(df: DataFrame, text: str = "text", fold: str = "split") -> DataFrame:
    """D-12: (fold, n, n_leaked): rows of each fold and those whose normalised text also stands in another fold. Null folds
    and null or blank texts leak nothing. Repeated texts are combined by (text, fold) before folds are compared."""
    own = df.select(F.col(fold).alias("fold"), F.md5(F.lower(t.normalize_text(F.col(text)))).alias("key"), (t.normalize_text(F.col(text)) != "").alias("some"))
    a = own.groupBy("key", "some", "fold").agg(F.count("*").alias("n"))
    folds = F.count("fold").over(Window.partitionBy("key"))  # a row per fold
    a = a.withColumn("leaked", F.when(F.col("some") & F.col("fold").isNotNull() & (folds > 1), F.col("n")).otherwise(0))
    return a.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("leaked").alias("n_leaked"))


def encode_labels(df: DataFrame, labels: tuple[str, ...], column: str = "scope") -> DataFrame:
    """D-10: label ids by position; unknown labels: null."""
    return df.withColumn("label_id", F.try_element_at(F.create_map(*[F.lit(x) for k, s in enumerate(labels) for x in (s, k)]), F.col(column)))

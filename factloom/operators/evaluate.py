"""Evaluation of predictions as aggregates (M-01..M-13). Predictions: truth, pred, and for some p, an array."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Counts by (truth, pred); rows with a null side are masked out."""
    return df.dropna(subset=[truth, pred]).groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, labels: tuple) -> DataFrame:
    """M-01, M-03: (label, precision, recall, f1, jaccard, support) for each of a fixed list of labels; 0 where nothing
    was predicted or nothing is true."""
    c = confusion(df)
    tp = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    by_truth = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), tp.alias("tp"))
    by_pred = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    base = df.sparkSession.createDataFrame([(x,) for x in labels], ["label"])
    j = base.join(by_truth, "label", "left").join(by_pred, "label", "left").fillna(0, ["support", "tp", "predicted"])
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = div(F.col("tp"), F.col("predicted")), div(F.col("tp"), F.col("support"))
    return j.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(div(2.0 * F.col("tp"), F.col("predicted") + F.col("support")), 6).alias("f1"), F.round(div(F.col("tp"), F.col("predicted") + F.col("support") - F.col("tp")), 6).alias("jaccard"), "support")


def averages(classes: DataFrame, leave_out: tuple = ()) -> DataFrame:
    """M-01, M-02: macro and weighted means of per_class, one row; `leave_out`: labels that don't count."""
    c = classes.filter(~F.col("label").isin(*leave_out)) if leave_out else classes
    mean = [F.round(F.avg(m), 6).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [F.round(F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)), 6).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return c.agg(*mean, *weighted)


def agreement(df: DataFrame) -> DataFrame:
    """M-01, M-09: accuracy, balanced accuracy, Cohen's kappa, Matthews' coefficient and Hamming loss, one row."""
    c = confusion(df)
    rows = c.groupBy("truth").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy("pred").agg(F.sum("n").alias("p"))
    m = rows.join(cols, F.col("truth") == F.col("pred"), "full_outer").fillna(0)
    s = m.agg(F.sum("tp").cast("double").alias("c"), F.sum("t").cast("double").alias("s"), F.sum(F.col("t").cast("double") * F.col("p")).alias("tp_"), F.sum(F.pow("t", F.lit(2))).alias("tt"), F.sum(F.pow("p", F.lit(2))).alias("pp"), F.avg(F.when(F.col("t") > 0, F.col("tp") / F.col("t"))).alias("bal"))
    acc, chance = F.col("c") / F.col("s"), F.col("tp_") / F.pow("s", F.lit(2))
    mcc = F.try_divide(F.col("c") * F.col("s") - F.col("tp_"), F.sqrt(F.pow("s", F.lit(2)) - F.col("pp")) * F.sqrt(F.pow("s", F.lit(2)) - F.col("tt")))
    return s.select(F.round(acc, 6).alias("accuracy"), F.round("bal", 6).alias("balanced_accuracy"), F.round(F.try_divide(acc - chance, 1 - chance), 6).alias("kappa"), F.round(mcc, 6).alias("mcc"), F.round(1 - acc, 6).alias("hamming"))


def confusion_matrix(df: DataFrame, labels: tuple) -> DataFrame:
    """M-04: a row per true label, a column per predicted one."""
    return df.groupBy("truth").pivot("pred", list(labels)).count().fillna(0)


def top_k_accuracy(df: DataFrame, ks: tuple[int, ...] = (2, 3)) -> DataFrame:
    """M-05: share of rows whose true class is among the k likeliest (ties: smaller class first)."""
    order = F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    rank = F.array_position(F.transform(order, lambda z: z["i"]), F.col("truth").cast("int"))
    return df.withColumn("_r", rank).agg(*[F.round(F.avg(((F.col("_r") > 0) & (F.col("_r") <= k)).cast("double")), 6).alias(f"top_{k}") for k in ks])


def calibration_error(df: DataFrame, bins: int = 15) -> DataFrame:
    """M-06: expected calibration error over right-closed bins of the top probability."""
    c = df.select(F.array_max("p").alias("conf"), (F.col("truth") == F.col("pred")).cast("double").alias("hit"))
    b = c.groupBy(F.greatest(F.lit(1), F.ceil(F.col("conf") * bins)).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("hit").alias("acc"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"))


def proper_scores(df: DataFrame) -> DataFrame:
    """M-07, M-08: Brier score, log loss (clipped at 1e-15) and mean confidence of right and wrong predictions."""
    brier = F.aggregate(F.transform("p", lambda x, i: F.pow(x - F.when(i == F.col("truth"), 1.0).otherwise(0.0), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    own = F.greatest(F.lit(1e-15), F.get("p", F.col("truth").cast("int")))
    hit, conf = F.col("truth") == F.col("pred"), F.array_max("p")
    return df.agg(F.round(F.avg(brier), 6).alias("brier"), F.round(F.avg(-F.log(own)), 6).alias("log_loss"), F.round(F.avg(F.when(hit, conf)), 6).alias("conf_right"), F.round(F.avg(F.when(~hit, conf)), 6).alias("conf_wrong"))


def score_pivot(scores: DataFrame, row: str, column: str, values: list, score: str) -> DataFrame:
    """M-11: score by row and column."""
    return scores.groupBy(row).pivot(column, values).agg(F.round(F.max(score), 6))


def rank_runs(runs: DataFrame) -> DataFrame:
    """K-05, A-17, M-10: runs by validation score, then by loss, with their place."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "loss", "run")))


def throughput(runs: DataFrame, by: str, tokens: str, seconds: str) -> DataFrame:
    """M-10: tokens a second of each group; groups without time: null."""
    return runs.groupBy(by).agg(F.sum(tokens).alias("n_tokens"), F.round(F.try_divide(F.sum(tokens), F.sum(seconds)), 4).alias("tokens_per_second"))


def generalisation_gap(scores: DataFrame, by: str, part: str, score: str) -> DataFrame:
    """M-10: mean score on train less that on validation, by group; null where one of them is missing."""
    mean = lambda x: F.avg(F.when(F.col(part) == x, F.col(score)))
    return scores.groupBy(by).agg(F.round(mean("train"), 6).alias("train"), F.round(mean("validation"), 6).alias("validation"), F.round(mean("train") - mean("validation"), 6).alias("gap"))


def extraction_accuracy(expected: DataFrame, got: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """M-13: shares of expected records found, of found ones expected, and of equal fields among both."""
    e, g = expected.withColumn("_e", F.lit(1)), got.withColumnsRenamed({f: f"got_{f}" for f in fields}).withColumn("_g", F.lit(1))
    j = e.join(g, keys, "full_outer")
    both = F.col("_e").isNotNull() & F.col("_g").isNotNull()
    return j.agg(F.round(F.count_if(both) / F.count("_e"), 6).alias("recall"), F.round(F.count_if(both) / F.count("_g"), 6).alias("precision"), *[F.round(F.avg(F.when(both, F.col(f).eqNullSafe(F.col(f"got_{f}")).cast("double"))), 6).alias(f"same_{f}") for f in fields])

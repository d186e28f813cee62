"""Emission scope of texts and tables by rules over model scores (R-01..R-06, F-08, X-24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.functions import vectors as v
from factloom.lexicon import DEFAULT, SCOPES, Config


def _scope_of(i: Column) -> Column:
    return F.get(F.array(*map(F.lit, SCOPES)), i)


def resolve(text: Column, p: Column, config: Config = DEFAULT, named: Column | None = None, measured: Column | None = None, context: Column | None = None) -> Column:
    """R-01: struct(scope, scope_id, confidence, scope_source, decision_reason, evidence, model_scope, model_confidence).

    First rule that holds: several scopes named: Mixed; one named: that one; the model says Other; the text isn't
    eligible; the model is surer than the threshold; else Other. p: class probabilities, Other first. named, measured
    and context may be given as columns that are there already."""
    named = t.explicit_scopes(text) if named is None else named
    measured = t.value_unit(text).isNotNull() if measured is None else measured
    context = t.scope_context(text) if context is None else context
    eligible = t.false(F.length(t.py_trim(text)) >= 3) & ((F.size(named) > 0) | context | measured)
    best = v.argmax(p)
    top = F.round(F.get(p, best), 4)
    other = F.round(F.get(p, F.lit(0)), 4)
    evidence = F.left(text, F.lit(300))

    def out(scope, i, confidence, source, reason, shown=True) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            lit(scope).alias("scope"), lit(i).cast("int").alias("scope_id"), lit(confidence).cast("double").alias("confidence"), lit(source).alias("scope_source"), lit(reason).alias("decision_reason"),
            (evidence if shown else F.lit(None).cast("string")).alias("evidence"), _scope_of(best).alias("model_scope"), top.alias("model_confidence"),
        )

    first = F.get(named, F.lit(0))
    weak = F.when(measured | context, "low_confidence").otherwise("low_confidence,missing_esg_evidence")
    return (
        F.when(F.size(named) > 1, out("Mixed", -1, 1.0, "explicit_mentions", "multiple_explicit_scopes"))
        .when(F.size(named) == 1, out(first, F.right(first, F.lit(1)).cast("int"), 1.0, "explicit_mention", "single_explicit_scope"))
        .when(best == 0, out("Other", 0, top, "model", "model_predicted_other", False))
        .when(~eligible, out("Other", 0, other, "eligibility_gate", "not_esg_eligible", False))
        .when(top > config.scope_confidence, out(_scope_of(best), best, top, F.when(measured, "model_with_measurement_and_esg_context").otherwise("model_with_esg_context"), "supported_non_other_prediction"))
        .otherwise(out("Other", 0, other, "policy_filter", weak, False))
    )


def resolved(blocks: DataFrame, text: str, p: Column, config: Config = DEFAULT) -> DataFrame:
    """Blocks with v, the struct of value and unit, and r, the struct of `resolve`; each pattern runs once a row."""
    c = F.col(text)
    b = blocks.withColumn("_p", p).withColumn("v", t.value_unit(c)).withColumn("_named", t.explicit_scopes(c)).withColumn("_context", t.scope_context(c))
    return b.withColumn("r", resolve(c, F.col("_p"), config, F.col("_named"), F.col("v").isNotNull(), F.col("_context"))).drop("_p", "_named", "_context")


def classify(blocks: DataFrame, text: str, logits: Column, temperature: float | None = None, config: Config = DEFAULT) -> DataFrame:
    """Blocks with value, unit and the resolved scope; `logits` are the scores of a model, an input here."""
    b = resolved(blocks, text, v.softmax(logits, config.temperature if temperature is None else temperature), config)
    return b.select(*blocks.columns, "v.value", "v.unit", "r.*")


def route(blocks: DataFrame, text: str = "text", kind: str = "type") -> DataFrame:
    """F-08: section of each block: toc, header and footer are kept as structure; tables, texts under 5 characters and
    headers or footers that aren't eligible are skipped, the rest is classified. Null texts and types: skipped, text."""
    k, s = F.lower(F.coalesce(F.col(kind), F.lit("text"))), t.py_trim(F.coalesce(F.col(text), F.lit("")))
    section = (
        F.when(k == "toc", "toc")
        .when(k.isin("table", "table_text") | (F.length(s) < 5), F.when(k.isin("header", "footer"), k).otherwise("skipped"))
        .when(k.isin("header", "footer") & ~t.eligible(s), k)
        .otherwise("classified")
    )
    return blocks.withColumn("section", section)


def row_texts(cells: DataFrame, table_id: str = "table_key") -> DataFrame:
    """T-12, R-03: (table, row_no, label, context): the first cell with the texts of the next two, for rows with a label."""
    c = cells.filter("col_no < 3").groupBy(table_id, "row_no").pivot("col_no", [0, 1, 2]).agg(F.first("text"))
    number = lambda x: F.regexp_replace(x, "[,.\\- ]", "").rlike(r"^\d+$")
    c = c.select(table_id, "row_no", *[t.py_trim(F.coalesce(F.col(str(i)), F.lit(""))).alias(f"c{i}") for i in range(3)]).filter((F.col("c0") != "") & ~number(F.col("c0")))
    keep = [F.when((F.col(f"c{i}") != "") & ~number(F.col(f"c{i}")), F.col(f"c{i}")) for i in (1, 2)]
    return c.select(table_id, "row_no", F.col("c0").alias("label"), F.concat_ws(" ", "c0", *keep).alias("context"))


def table_text(cells: DataFrame, table_id: str = "table_key") -> DataFrame:
    """T-11: the cells of a table that hold text, in reading order, as one text."""
    some = cells.withColumn("text", t.normalize_text(F.col("text"))).filter("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("row_no", "col_no", "text")))
    return some.groupBy(table_id).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("content"))


def table_scope(rows: DataFrame, table_id: str = "table_key") -> DataFrame:
    """R-02: scope of a table from its rows (scope, confidence): rows other than Other vote; several scopes: Mixed with
    the least confidence, one: that with the mean; none: Other, 0, unresolved."""
    vote = F.when(F.col("scope") != "Other", F.col("scope"))
    sure = F.when(F.col("scope") != "Other", F.col("confidence"))
    a = rows.groupBy(table_id).agg(F.when(F.min(vote) != F.max(vote), 2).when(F.min(vote).isNotNull(), 1).otherwise(0).alias("n"), F.min(vote).alias("one"), F.min(sure).alias("low"), F.avg(sure).alias("mean"))
    return a.select(
        table_id,
        F.when(F.col("n") > 1, "Mixed").when(F.col("n") == 1, F.col("one")).otherwise("Other").alias("scope"),
        F.round(F.when(F.col("n") > 1, F.col("low")).when(F.col("n") == 1, F.col("mean")).otherwise(0.0), 3).alias("confidence"),
        F.when(F.col("n") > 1, "row_consensus_mixed").when(F.col("n") == 1, "row_consensus").otherwise("unresolved").alias("scope_source"),
    )


#: R-04 (fixed values): activities and the scope they belong to, in order of priority.
ACTIVITIES = (
    ("Scope 3", ("business travel", "commut", "purchased goods", "upstream", "downstream", "supply chain", "value chain", "waste disposal", "leased assets", "product use", "investment")),
    ("Scope 2", ("purchased electricity", "electricity", "purchased steam", "district heating", "cooling purchased", "location-based", "market-based")),
    ("Scope 1", ("fuel", "diesel", "natural gas", "refrigerant", "company vehicle", "stationary combustion", "mobile combustion", "process gas", "fugitive")),
)
CARBON_SIGNALS = ("co2", "ghg", "greenhouse", "emission", "carbon", "scope 1", "scope 2", "scope 3")


def activity_scope(text: Column) -> Column:
    """R-04: scope by activity words, without a model; none: null."""
    out = F.lit(None).cast("string")
    for scope, words in reversed(ACTIVITIES):
        out = F.when(t.contains_any(text, words), scope).otherwise(out)
    return out


def carbon_candidate(text: Column) -> Column:
    """R-06: the text has a carbon signal and a digit."""
    return t.contains_any(text, CARBON_SIGNALS) & F.coalesce(text.rlike(r"\d"), F.lit(False))


def merge_sources(records: DataFrame, keys: list[str], source: str = "source", value: str = "value") -> DataFrame:
    """R-05: one record per key: of table, chart and text the first wins; how many support it, whether they conflict.

    Ties within a source go to the smaller value. Null values support nothing."""
    rank = F.expr(f"case {source} when 'table' then 1 when 'chart' then 2 when 'text' then 3 else 4 end")
    best = F.min(F.struct(rank.alias("r"), F.col(value).alias("v"), F.col(source).alias("s")))
    a = records.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("b"), F.count("*").alias("n_support"), F.array_sort(F.collect_set(source)).alias("sources"), (F.max(value) - F.min(value)).alias("spread"))
    return a.select(*keys, F.col("b.v").alias(value), F.col("b.s").alias(source), "n_support", "sources", (F.col("spread") > 1e-9).alias("conflict"))


def trend(points: DataFrame, keys: list[str], x: str = "year", y: str = "value") -> DataFrame:
    """R-07: slope of a series by least squares, its direction, and the sign of each last step."""
    a = points.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.count("*").alias("n"))
    return a.withColumn("direction", F.expr("case when slope is null or slope = 0 then 'flat' when slope > 0 then 'up' else 'down' end"))

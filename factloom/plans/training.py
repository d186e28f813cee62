"""Queries of the general training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import quantities
from factloom.runtime import table


def _converted(spark: SparkSession, d: str) -> DataFrame:
    return quantities.convert(table(spark, d, "layoutlmv3_layout", heavy=True), table(spark, d, "unit_factors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities.same_amounts(_converted(spark, d))


def p5_amounts(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p5_found": p5_found, "p5_amounts": p5_amounts}


def oracle_sql() -> dict[str, str]:
    return {}

"""Session helpers shared by all operators: table access, durable intermediate results and per-worker resources."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

X = TypeVar("X")


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """One of the Parquet tables below `sf_dir`. heavy: what follows costs far more than reading, so a table too small to
    give every core a task is spread by its first column, its key."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.columns[0]) if heavy else df


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share: the one that is set, else that of
    `spark.checkpoint.dir`. Only a local session without either (tests on a single machine) gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="factloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def once(key: object, make: Callable[[], X]) -> X:
    """A resource made once per Python worker and kept between tasks (tokenizers, automata, models)."""
    kept = sys.__dict__.setdefault("_factloom_kept", {})
    if key not in kept:
        if len(kept) > 16:  # old models of a long session
            kept.clear()
        kept[key] = make()
    return kept[key]


def spread(df: DataFrame, column: str, force: bool = False) -> DataFrame:
    """Spread rows over all cores before Python work when the input is so small that its scan gives too few tasks."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(wanted, column) if force or int(str(size)) < wanted * (4 << 20) else df


def py_trim(c: Column) -> Column:
    """Unicode trim, as Python's str.strip()."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

"""Problem 6: exact copies behind different formatting, counted by scanning externally sorted canonical records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.runtime import durable

#: A separator of named fields: a bar, semicolon or line end before the next "name:" or "name=".
FIELD_SPLIT = r"[|;\n]+(?=\s*+\p{L}[\p{L}\p{M} _]*+\s*+[:=])"
FIELD = r"^\s*[^\p{L}\n]{0,3}\s*\p{L}[\p{L}\p{M} _]*+\s*+[:=].*"


def squeeze(c: Column) -> Column:
    """Lower case without white space and punctuation; a comma or point between two digits stays."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9\p{L}\p{N}\p{M}.,]+|[.,](?:(?!\p{Nd})|(?<!\p{Nd}[.,]))", "")


def canonical(text: Column) -> Column:
    """Canonical form of a text: of named fields (two or more, nothing else), each squeezed and in sorted order; of
    prose, squeezed as one. Null stays null, blank or mere punctuation becomes empty."""
    parts = F.filter(F.split(text, FIELD_SPLIT), lambda p: F.length(squeeze(p)) > 0)
    fields = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike("(?s)" + FIELD))
    name = lambda p: squeeze(F.regexp_extract(p, r"(?s)^(.*?)[:=]", 1))
    value = lambda p: squeeze(F.regexp_extract(p, r"(?s)^.*?[:=](.*)$", 1))
    joined = F.array_join(F.array_sort(F.transform(parts, lambda p: F.concat(name(p), F.lit("="), value(p)))), "|")
    return F.when(text.rlike("[:=]") & fields, joined).otherwise(squeeze(text))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal (block, text) in sorted rows. The first run of the partition and the last one carry their key at
    their first row, as they may go on in a neighbouring partition."""
    last, first, opened = None, None, False  # key and first id of the open run; whether a second run has begun

    def out(ids, firsts, blocks, texts):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(firsts), pa.array(blocks, pa.string()), pa.array(texts, pa.string())], ["row_id", "first_id", "edge_block", "edge_text"])

    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block, text, ids = batch.column("block"), batch.column("text"), batch.column("id").to_numpy(zero_copy_only=False)
        same = np.zeros(len(ids), bool)
        if len(ids) > 1:
            same[1:] = pc.and_(pc.equal(block[1:], block[:-1]), pc.equal(text[1:], text[:-1])).to_numpy(zero_copy_only=False)
        key0 = (block[0].as_py(), text[0].as_py())
        same[0] = key0 == last
        heads = np.flatnonzero(~same)
        at = np.where(~same, np.arange(len(ids)), -1)
        at = np.maximum.accumulate(at)
        firsts = np.where(at >= 0, ids[np.maximum(at, 0)], first if first is not None else 0)
        blocks, texts = [None] * len(ids), [None] * len(ids)
        if not opened and len(heads):  # the partition's first run
            blocks[heads[0]], texts[heads[0]] = block[int(heads[0])].as_py(), text[int(heads[0])].as_py()
            opened = True
        if len(heads):
            tail = (int(ids[heads[-1]]), block[int(heads[-1])].as_py(), text[int(heads[-1])].as_py())
            first = ids[heads[-1]]
        last = (block[-1].as_py(), text[-1].as_py())
        yield out(ids, firsts.astype(np.int64), blocks, texts)
    if tail is not None:  # the last run's key, as a row of its own without row_id
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([tail[0]]), pa.array([tail[1]], pa.string()), pa.array([tail[2]], pa.string())], ["row_id", "first_id", "edge_block", "edge_text"])


def groups(df: DataFrame, key: str = "row_id", block: str = "block_id", text: str = "text") -> DataFrame:
    """(row_id, first_row_id) of every row of `df` with a key: the smallest key of its group of copies.

    Copies: equal canonical block and text. Rows with null block or text, or nothing left of either, are copies of
    nothing and stand for themselves. Repeated keys fall into one group if their texts do.
    Records are range-partitioned on (hash, block, text, key) and sorted there (Spark's sort spills); a group that
    holds much of the table spans several partitions, whose edge runs - two a partition - are merged afterwards.
    """
    canon = df.select(F.col(key).alias("id"), squeeze(F.col(block)).alias("block"), canonical(F.col(text)).alias("text")).filter("id is not null")
    usable = (F.col("block") != "") & (F.col("text") != "")
    order = [F.xxhash64("block", "text").alias("h"), "block", "text", "id"]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = canon.filter(usable).select(*order).repartitionByRange(n, "h", "block", "text", "id").sortWithinPartitions("h", "block", "text", "id")
    runs = durable(rows.select(F.col("id").cast("long").alias("id"), "block", "text").mapInArrow(_scan, "row_id long, first_id long, edge_block string, edge_text string"))
    edges = runs.filter("edge_block is not null").select("edge_block", "edge_text", "first_id").distinct()
    whole = edges.groupBy("edge_block", "edge_text").agg(F.min("first_id").alias("true_first"))
    moved = edges.join(whole, ["edge_block", "edge_text"]).filter("first_id <> true_first").select("first_id", "true_first")
    found = runs.filter("row_id is not null").select("row_id", "first_id").join(F.broadcast(moved), "first_id", "left")  # at most two rows a partition
    found = found.select("row_id", F.coalesce("true_first", "first_id").alias("first_row_id"))
    alone = canon.filter(~F.coalesce(usable, F.lit(False))).select(F.col("id").cast("long").alias("row_id"), F.col("id").cast("long").alias("first_row_id"))
    return found.unionByName(alone)


def collapse(df: DataFrame, key: str = "row_id", block: str = "block_id", text: str = "text") -> DataFrame:
    """(row_id, copies): one representative, the smallest key, of each group with its exact number of copies."""
    return groups(df, key, block, text).groupBy(F.col("first_row_id").alias("row_id")).agg(F.count("*").alias("copies"))

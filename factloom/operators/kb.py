"""Knowledge base: page cleaning, chunking, and exact vector search in blocks (V-01..V-08, K-04, J-14, J-15)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.lexicon import DEFAULT, Config

SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ")
BLOCK = 4096


def _parts(text: str, limit: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces no longer than `limit` where the separators allow it; a separator stays in front of what follows it."""
    if len(text) <= limit or not separators:
        return [text]
    sep, rest = separators[0], separators[1:]
    if sep not in text:
        return _parts(text, limit, rest)
    head, *tail = text.split(sep)
    return [p for x in [head, *(sep + y for y in tail)] if x for p in _parts(x, limit, rest)]


def chunks(text: str, limit: int, overlap: int) -> list[str]:
    """V-02: pieces joined up to `limit`; the next chunk begins with the last pieces of this one, `overlap` at most."""
    out, held, size = [], [], 0
    for p in _parts(text, limit, SEPARATORS):
        if held and size + len(p) > limit:
            out.append("".join(held).strip())
            while held and (size > overlap or size + len(p) > limit):
                size -= len(held.pop(0))
        held.append(p)
        size += len(p)
    out.append("".join(held).strip())
    return [x for x in out if x]


def chunk_pages(pages: DataFrame, keys: list[str], text: str = "text", config: Config = DEFAULT, least_words: int = 20) -> DataFrame:
    """V-01..V-03, X-20, F-13: (*keys, local_chunk, num_words, num_chars, text) of the cleaned pages; local_chunk is the
    place before short chunks are dropped. Null and empty pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, out = [], [], []
            for k, x in enumerate(batch.column(len(keys)).to_pylist()):
                for i, c in enumerate(chunks(x, config.chunk_size, config.chunk_overlap)):
                    at.append(k), no.append(i), out.append(c)
            own = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(no, pa.int32()), pa.array(out, pa.string())], [*batch.schema.names[:-1], "local_chunk", "text"])

    narrow = pages.select(*keys, t.kb_clean(F.col(text)).alias("text")).filter("text <> ''")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keys)])
    c = narrow.mapInArrow(run, f"{kinds}, local_chunk int, text string").withColumn("num_words", F.size(t.words_of(F.col("text")))).withColumn("num_chars", F.length("text"))
    return c.filter(F.col("num_words") >= least_words)


def _pack(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Vectors in blocks of up to BLOCK rows, each a row of two binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], [f"{name}_ids", f"{name}_x"])

    return df.select(F.col(key), F.col(vector)).dropna().mapInArrow(run, f"{name}_ids binary, {name}_x binary")


def top_k(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """V-05..V-07, K-04, J-14: (query_id, match_id, score, rank): the k rows of greatest cosine for each query, the query
    itself left out, ties to the smaller key.

    Exact: blocks of queries meet blocks of the corpus, each pair of blocks is one matrix product that leaves k rows per
    query, and those are ranked. Vectors are normalised; null vectors are in no result, zero vectors have score 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qi, ci = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                q, c = (np.frombuffer(r[x], np.float32).reshape(len(i), -1).astype(np.float64) for x, i in (("q_x", qi), ("c_x", ci)))
                q, c = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) for x in (q, c))
                order = np.argsort(ci, kind="stable")
                ci, c = ci[order], c[order]
                s = q @ c.T
                s[qi[:, None] == ci[None]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                got = np.take_along_axis(s, best, 1)
                ok = np.isfinite(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, ok.sum(1))), pa.array(ci[best][ok]), pa.array(got[ok])], ["query_id", "match_id", "score"])

    pairs = _pack(queries, key, vector, "q").crossJoin(_pack(corpus, key, vector, "c"))  # blocks, not rows
    hits = pairs.mapInArrow(run, "query_id long, match_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "match_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_match(matches: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """V-07, J-15: the first match of each query with the metadata of its row, and all matches as an array."""
    top = matches.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "match_id", "score"))).alias("top_matches"))
    return top.withColumn("best_id", F.get("top_matches", F.lit(0))["match_id"]).join(metadata.withColumnRenamed(key, "best_id"), "best_id", "left")

"""Problem 8: encoding a corpus with a public byte-level BPE tokenizer, token offsets and exact decoding."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.runtime import once, spread

FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"


def load(path: str):
    """The tokenizer of `path`, made once per worker; special tokens' strings in a text are ordinary text."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.no_padding()
        t.no_truncation()
        return t

    return once(("tokenizer", path), make)


def byte_table(path: str) -> list[bytes]:
    """Bytes of each id: printable bytes stand for themselves, the others for code points from 256 on, in order."""

    def make():
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in shown}
        to_byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocabulary = load(path).get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            table[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        return table

    return once(("bytes", path), make)


def ids_of(texts: list[str], path: str) -> list[list[int]]:
    return [e.ids for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]


def decode(ids: list[int], table: list[bytes]) -> str:
    """The text of ids. Characters split over several tokens are joined as bytes first, so whole sequences are exact;
    a sequence cut inside a character shows U+FFFD there."""
    return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")


def starts(ids: list[int], table: list[bytes]) -> np.ndarray:
    """Code-point position at which each token starts; a token starting inside a character has that character's."""
    joined = np.frombuffer(b"".join(table[i] for i in ids), np.uint8)
    size = np.fromiter((len(table[i]) for i in ids), np.int64, len(ids))
    begins = np.cumsum((joined & 0xC0) != 0x80) - 1  # the character of each byte
    return begins[np.cumsum(size) - size].astype(np.int32) if len(ids) else np.zeros(0, np.int32)


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter((len(v) for v in values), np.int32, len(values))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate([np.asarray(v, np.int32) for v in values]) if len(values) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _batches(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts in pieces of at most `most` characters (or one text), so that long texts stay within memory."""
    keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield keys.slice(begin, k - begin), texts[begin:k]
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield keys.slice(begin), texts[begin:]


def encode(df: DataFrame, key: str, text: str, path: str = f"{FOLDER}/{BYTE_BPE}") -> DataFrame:
    """(key, ids array<int>) of every row, repeated rows included, without special tokens.

    Null, empty: ids is an empty list, never null. Blank texts are encoded as they stand. Whole texts are encoded,
    however long. Other columns of `df` are left out, whatever their names. A null key stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _batches(batch):
                yield pa.RecordBatch.from_arrays([keys, _lists(ids_of(texts, path), pa.int32())], ["key", "ids"])

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return spread(narrow, "key").mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count(df: DataFrame, key: str, text: str, keep: list[str], path: str = f"{FOLDER}/{BYTE_BPE}") -> DataFrame:
    """(key, *keep, n_tokens int) of every row; null and empty texts have 0 tokens. `keep` names columns carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) for _, texts in _batches(batch) for x in ids_of(texts, path)]
            names = ["key", *[f"k{i}" for i in range(len(keep))], "n_tokens"]
            columns = [batch.column(0), *[batch.column(2 + i) for i in range(len(keep))], pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = ", ".join([f"key {kinds['key']}", *[f"k{i} {kinds[f'k{i}']}" for i in range(len(keep))], "n_tokens int"])
    out = spread(narrow, "key").mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")


def offsets(df: DataFrame, key: str, text: str, path: str = f"{FOLDER}/{BYTE_BPE}") -> DataFrame:
    """(key, starts array<int>, same boolean): where each token starts in code points, and whether decoding the ids
    gives the text back. Null and empty texts: no tokens, same is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = byte_table(path)
        for batch in batches:
            for keys, texts in _batches(batch):
                ids = ids_of(texts, path)
                same = [decode(x, known) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([keys, _lists([starts(x, known) for x in ids], pa.int32()), pa.array(same)], ["key", "starts", "same"])

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return spread(narrow, "key").mapInArrow(run, f"key {kind}, starts array<int>, same boolean").withColumnRenamed("key", key)

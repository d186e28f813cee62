"""Problem 3: records of evaluation splits that stand, word for word or nearly, in the training split."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.runtime import durable

WORDS_PER_EDIT = 10
LONG = 120  # words; texts up to here are matched by segments, longer ones by windows of n-grams
RUN, GRAM = 8, 5
SALT = 64
HOT = 20_000


def canonical(c: Column) -> Column:
    """Words in lower case, one space apart: marks between digits, hyphens inside words and apostrophes vanish, other
    signs part words."""
    joined = F.regexp_replace(F.lower(c), r"[.,](?=\p{Nd})(?<=\p{Nd}[.,])|['’`]|-(?=[\p{L}\p{N}])(?<=[\p{L}\p{N}]-)", "")
    return F.trim(F.regexp_replace(joined, r"[^a-z0-9\p{L}\p{N}\p{M}]+", " "))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(canon: str, digits: str, probe: bool) -> list[int]:
    """Hash keys under which two texts within the allowed edits share at least one.

    Up to LONG words: a text of La words that may differ by K edits falls into K+1 segments; one of them is unchanged
    in the other text and shifted by no more than the edits beside it. The index side gives its own segments, the
    probing side the word runs that could be such a segment of any length La that is near enough.
    Pairs with a longer text have at least RUN words in a row in common, hence RUN - GRAM + 1 neighbouring word n-grams,
    hence the least hash among them: each side gives the least hash of every such window."""
    at = [0]
    for word in canon.split(" "):
        at.append(at[-1] + len(word) + 1)
    n, out = len(at) - 1, set()
    if n > LONG - LONG // (WORDS_PER_EDIT - 1) - 2:
        grams = [xxhash.xxh3_64_intdigest(f"{digits}|{canon[at[i] : at[i + GRAM] - 1]}") for i in range(n - GRAM + 1)]
        wide, queue = RUN - GRAM + 1, deque()
        for i, g in enumerate(grams):
            while queue and queue[-1][0] >= g:
                queue.pop()
            queue.append((g, i))
            if queue[0][1] <= i - wide:
                queue.popleft()
            if i >= wide - 1:
                out.add(queue[0][0])
    if n > LONG:
        return [_signed(x) for x in out]
    low, high = (n, n) if not probe else (n - n // WORDS_PER_EDIT, min(LONG, n * WORDS_PER_EDIT // (WORDS_PER_EDIT - 1) + 1))
    for la in range(low, high + 1):
        most = range(la // WORDS_PER_EDIT, la * WORDS_PER_EDIT // (WORDS_PER_EDIT - 1) // WORDS_PER_EDIT + 1) if not probe else [max(la, n) // WORDS_PER_EDIT]
        for k in most:
            if k == 0 or probe and abs(la - n) > k:
                continue
            for i in range(k + 1):
                begin, end = i * la // (k + 1), (i + 1) * la // (k + 1)
                if not probe:
                    shifts = [0]
                else:  # i edits at most lie left of the segment, k - i right of it
                    d = n - la
                    shifts = range(max(-i, d - (k - i), -begin), min(i, d + k - i, n - end) + 1)
                head = f"{digits}|{la}|{k}|{i}|"
                for s in shifts:
                    out.add(xxhash.xxh3_64_intdigest(head + canon[at[begin + s] : at[end + s] - 1]))
    return [_signed(x) for x in out]


def _keys(probe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for r, (canon, digits) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = segments(canon, digits, probe)
                rows += [r] * len(found)
                keys += found
                if len(keys) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0).take(pa.array(rows))], ["k", "cls"])
                    rows, keys = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0).take(pa.array(rows, pa.int32()))], ["k", "cls"])

    return run


def within(a: list[str], b: list[str], k: int) -> bool:
    """Whether at most k changed, added or dropped words make b of a: for 0, 1, ... edits, how far each diagonal of the
    edit table reaches; near texts end after few rounds, however long they are."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    reach: dict[int, int] = {}
    for e in range(k + 1):
        new: dict[int, int] = {}
        for d in range(max(-e, -n), min(e, m) + 1):  # d: words of b ahead of a
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1) if e else 0
            if i < 0:
                continue
            i = min(i, n, m - d)
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            new[d] = i
        if new.get(m - n, -1) >= n:
            return True
        reach = new
    return False


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("canon_a").to_pylist(), batch.column("canon_b").to_pylist()
        good = []
        for x, y in zip(a, b):
            x, y = x.split(" "), y.split(" ")
            good.append(within(x, y, max(len(x), len(y)) // WORDS_PER_EDIT))
        yield batch.select(["cls_a", "cls_b"]).filter(pa.array(good, pa.bool_()))


def classes(df: DataFrame, key: str, text: str, split: str) -> DataFrame:
    """A row per record that can match: id, train or not, class (128-bit hash of the canonical text), canon, digits."""
    canon = df.select(F.col(key).alias("id"), (F.col(split) == "train").alias("train"), canonical(F.col(text)).alias("canon"), F.regexp_replace(F.col(text), "[^0-9]+", "").alias("digits"))
    canon = canon.filter((F.col("canon") != "") & F.col("train").isNotNull() & F.col("id").isNotNull())
    return canon.withColumn("cls", F.unhex(F.md5(F.col("canon"))))


def pairs(df: DataFrame, key: str = "row_id", text: str = "text", split: str = "split") -> DataFrame:
    """(row_id_a, row_id_b), smaller first: every pair of a train row and a validation or test row whose texts have
    the same digits in the same order and are the same words but for one edit per ten words of the longer text.

    Case, punctuation and spacing don't count. Null, empty or wordless texts, null splits and null keys are never in
    a pair. Exact copies are one class while matching, so a text that a third of all rows repeat is compared once; the
    pairs of rows come from the classes at the end, hot classes salted. No pair is lost: the segments are a complete
    filter for the edit distance and every candidate is verified on its whole text.
    """
    rows = classes(df, key, text, split)
    members = durable(rows.select("id", "train", "cls"))
    own = durable(rows.groupBy("cls").agg(F.any_value("canon").alias("canon"), F.any_value("digits").alias("digits"), F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval")))
    # Texts whose digits stand on one side only match nothing; those without digits go on as they are.
    shared = own.filter("digits <> ''").groupBy("digits").agg(F.sum("n_train").alias("t"), F.sum("n_eval").alias("e")).filter("t > 0 and e > 0").select("digits")
    able = own.filter("digits = ''").unionByName(own.filter("digits <> ''").join(shared, "digits", "left_semi"))
    index = able.filter("n_train > 0").select("cls", "canon", "digits").mapInArrow(_keys(False), "k long, cls binary")
    probe = able.filter("n_eval > 0").select("cls", "canon", "digits").mapInArrow(_keys(True), "k long, cls binary")
    hit = index.withColumnRenamed("cls", "cls_a").join(probe.withColumnRenamed("cls", "cls_b"), "k").filter("cls_a <> cls_b").select("cls_a", "cls_b").distinct()
    texts = own.select("cls", "canon")
    hit = hit.join(texts.withColumnsRenamed({"cls": "cls_a", "canon": "canon_a"}), "cls_a").join(texts.withColumnsRenamed({"cls": "cls_b", "canon": "canon_b"}), "cls_b")
    near = hit.select("cls_a", "cls_b", "canon_a", "canon_b").mapInArrow(_verify, "cls_a binary, cls_b binary")
    same = own.filter("n_train > 0 and n_eval > 0").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    links = near.unionByName(same).join(own.select(F.col("cls").alias("cls_a"), "n_train"), "cls_a")
    return _rows(links, members)


def _rows(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of rows from pairs of classes. The train rows of a hot class are cut into salted parts."""
    links = durable(links)
    train = rows.filter("train").select(F.col("cls").alias("cls_a"), F.col("id").alias("train_id"))
    test = rows.filter(~F.col("train")).select(F.col("cls").alias("cls_b"), F.col("id").alias("eval_id"))
    cold = links.filter(F.col("n_train") <= HOT).select("cls_a", "cls_b").join(test, "cls_b").join(train, "cls_a")
    hot = links.filter(F.col("n_train") > HOT).select("cls_a", "cls_b").join(test, "cls_b")
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).join(train.withColumn("salt", F.pmod(F.xxhash64("train_id"), F.lit(SALT)).cast("int")), ["cls_a", "salt"])
    both = cold.select("train_id", "eval_id").unionByName(hot.select("train_id", "eval_id"))
    return both.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


def exact_report(df: DataFrame, key: str = "row_id", text: str = "text", split: str = "split", source: str = "source") -> DataFrame:
    """(split, source, n_rows, n_in_train) of the validation and test rows: those whose canonical text stands in train.

    Rows without words count as rows, never as overlaps. A null source is a source of its own."""
    canon = df.select(F.col(split).alias("split"), F.col(source).alias("source"), F.md5(canonical(F.col(text))).alias("cls"), (canonical(F.col(text)) != "").alias("some"))
    seen = canon.filter("split = 'train' and some").select("cls").distinct().withColumn("seen", F.lit(1))
    return canon.filter("split <> 'train'").join(seen, "cls", "left").groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count_if((F.col("seen") == 1) & F.col("some")).alias("n_in_train"))


def report(df: DataFrame, key: str = "row_id", text: str = "text", split: str = "split", source: str = "source") -> DataFrame:
    """(split, source, overlapping_rows, pairs): validation and test rows with at least one match in train, and matches."""
    found = pairs(df, key, text, split)
    side = df.select(F.col(key).alias("id"), F.col(split).alias("split"), F.col(source).alias("source")).filter("split <> 'train'")
    both = found.select(F.explode(F.array("row_id_a", "row_id_b")).alias("id"))
    hits = both.groupBy("id").agg(F.count("*").alias("n"))
    return side.join(hits, "id").groupBy("split", "source").agg(F.count("*").alias("overlapping_rows"), F.sum("n").alias("pairs"))

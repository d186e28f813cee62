"""Problem 10: personal items inside free text, found by a character tagger and replaced by typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import personal_rules as rules
from factloom.llm.tagger import TAGS, Tagger
from factloom.runtime import once, spread

MODEL = Path(__file__).parent / "personal_model.npz" if "__file__" in globals() else None
WIDTH, STEP = 192, 128  # a window is at most so wide, and read for at most STEP characters in its middle
BATCH = 128

CAPITAL = re.compile(r"(?<![\w@])[A-ZĐÀ-Ỹ][^\W\d_]+(?:[-'’][^\W\d_]+)*")
AFTER_SITE = re.compile(r"(?<![\w@])[A-ZĐÀ-Ỹ][^\W\d_]+\s$")


def flags_of(text: str, given: set[str], family: set[str]) -> np.ndarray:
    """Lexicon flag of each character: whether its word is listed as a given or family name."""
    out = np.zeros(len(text), np.int8)
    for m in rules.WORD.finditer(text):
        w = m.group()
        if w[0].isupper():
            f = (w.lower() in given) + 2 * (w.lower() in family)
            if f:
                out[m.start() : m.end()] = f
    return out


def windows(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, first, last) of overlapping windows over all n characters of a text. Each position is read in one of
    them, from first to before last: the one whose edges are farther away, those of the text aside."""
    pieces, margin = -(-n // STEP), (WIDTH - STEP) // 2
    for k in range(pieces):
        first, last = n * k // pieces, n * (k + 1) // pieces
        yield max(0, first - margin), min(n, last + margin), first, last


PLACE_WORDS = set(rules.PLACES.lower().split("|"))


class Finder:
    """The tagger with the name lexicon; finds the items of many texts at once."""

    def __init__(self, tagger: Tagger, plain: set[str], lexicon: list[tuple[str, str]]):
        self.tagger, self.plain = tagger, plain
        self.given = {w.lower() for w, k in lexicon if k == "given"}
        self.family = {w.lower() for w, k in lexicon if k == "family"}
        self.names = self.given | self.family

    def tag(self, texts: list[str]) -> list[dict[int, str]]:
        """Per text, the tag of each position that is part of an item; all positions are looked at. Where windows overlap, the
        one whose edges are farther away decides."""
        flags = [flags_of(t, self.given, self.family) for t in texts]
        out: list[dict[int, str]] = [{} for _ in texts]
        for some in batched(((k, *w) for k, t in enumerate(texts) for w in windows(len(t))), 32 * BATCH):
            jobs = sorted(some, key=lambda j: j[1] - j[2])
            for i in range(0, len(jobs), BATCH):
                own = jobs[i : i + BATCH]
                tags = self.tagger.decode([self.tagger.ids(texts[k][a:b]) for k, a, b, _, _ in own], [flags[k][a:b] for k, a, b, _, _ in own])
                for (k, a, _, first, last), found in zip(own, tags):
                    out[k].update((a + p, TAGS[found[p]]) for p in (np.flatnonzero(found[first - a : last - a]) + first - a).tolist())
        return out

    def spans(self, tags: dict[int, str]) -> list[tuple[int, int, str]]:
        out: list[list] = []
        for p in sorted(tags):
            t = tags[p]
            if t[0] == "I" and out and out[-1][1] == p and out[-1][2] == t[2:]:
                out[-1][1] = p + 1
            else:
                out.append([p, p + 1, t[2:]])
        return [tuple(x) for x in out]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of each item: the tagged spans, set to their exact edges."""
        return [self.check(text, self.spans(tags)) if tags else [] for text, tags in zip(texts, self.tag(texts))]

    def check(self, text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """The items that the tagged spans stand for. The tagger says that there is an item and of which kind; the usual
        shape of that kind, where it stands there, only sets the edges. A span without a usual shape keeps its own edges,
        unless nothing of its kind is in it. Of overlapping items the one that begins first stays, then the longer one."""
        out: list[tuple[int, int, str]] = []
        for a, b, kind in spans:
            got = [name_edges(text, a, b, self.plain, self.names)] if kind == "name" else edges(text, a, b, kind)
            out += [(x[0], x[1], kind) for x in got if x]
        kept: list[tuple[int, int, str]] = []
        for a, b, kind in sorted(set(out), key=lambda x: (x[0], -x[1])):
            if kept and a < kept[-1][1]:
                continue
            if kind == "name" and kept and kept[-1][2] == "address" and a - kept[-1][1] <= 4:
                continue  # the city at its end
            kept.append((a, b, kind))
        return kept


SHAPES = {"email": rules.emails, "id_number": rules.ids, "phone": rules.phones, "address": rules.addresses}


def edges(text: str, a: int, b: int, kind: str) -> list[tuple[int, int]]:
    """A tagged span set to the edges of the shapes of its kind that it overlaps; the text beside the span is taken in until
    no shape touches the end of what was looked at. Without a shape: the span without white space and signs around it, if
    it holds what its kind needs."""
    wide = 128
    while True:
        low, high = max(0, a - wide), min(len(text), b + wide)
        hits = [(x + low, y + low) for x, y in SHAPES[kind](text[low:high]) if x + low < b and a < y + low]
        if any(low and x < low + 48 or y == high < len(text) for x, y in hits):
            wide *= 2
            continue
        break
    if hits:
        return hits
    own = re.search({"address": r"\d(?s:.*)", "phone": r"[+(\d](?s:.*)"}.get(kind, r"\w(?s:.*)"), text[a:b])
    if not own:
        return []
    a, piece = a + own.start(), own.group().rstrip(" \n\t,;:.(<[|")
    numbers = sum(c.isdigit() for c in piece)
    needs = {"email": re.search(r"(?i)[\w)\]]\s?(?:@|\W?\bat\b\W?)\s?[\w\-]+\s?(?:\.|\W?\bdot\b\W?)\s?\w", piece), "address": numbers and re.search(r"[^\W\d_]{3}", piece)}.get(kind, numbers >= 7)
    if not needs or re.search(r"\d[.,]?$", text[max(0, a - 2) : a]) or kind in ("phone", "id_number") and rules.NOT_BEFORE_NUMBER.search(text[max(0, a - 40) : a]):
        return []
    return [(a, a + len(piece))]


def name_edges(text: str, a: int, b: int, plain: set[str], names: set[str]) -> tuple[int, int] | None:
    """A tagged name set to whole words, without title and with name words right beside it, or None if it isn't
    capitalised words, holds plain words only, or names a place or firm."""
    while a > 0 and (text[a - 1].isalpha() or text[a - 1] in "-'’") and text[a].isalpha():
        a -= 1
    while b < len(text) and (text[b].isalpha() or text[b] in "-'’" and text[b + 1 : b + 2].isalpha()) and text[b - 1].isalpha():
        b += 1
    m = re.match(rf"\s*(?:(?:{rules.TITLES})\.?\s+)*", text[a:b])
    a += m.end()
    while b > a and text[b - 1] in " ,;:)(\n" or text[b - 1 : b] == "." and not re.search(r"(?<!\w)[A-ZĐ]\.$", text[a:b]):
        b -= 1
    own = lambda w: w.lower() in names or w.lower() not in plain
    while (m := re.match(r"([^\W\d_]+)\s+(?=\S)", text[a:b])) and len(m.group(1)) > 1 and not own(m.group(1)):
        a += m.end()  # words before the name
    while m := re.search(r"(?<![\w@.\-])([A-ZĐÀ-Ỹ][^\W\d_]*(?:[-'’][^\W\d_]+)?)(\.?),?\s$", text[max(0, a - 24) : a]):
        w = m.group(1)
        if re.fullmatch(rules.TITLES, w) or len(w) == 1 and not m.group(2) or len(w) > 1 and (m.group(2) or not own(w) or w.lower() in PLACE_WORDS) or "," in m.group() and len(rules.WORD.findall(text[a:b])) > 1:
            break
        a -= len(m.group())
    while m := re.match(r",?\s([A-ZĐÀ-Ỹ][^\W\d_]*(?:[-'’][^\W\d_]+)?)(\.?)(?![\w@]|[\w.+\-]*@|\.\w)", text[b : b + 60]):
        w = m.group(1)
        if len(w) == 1 and not m.group(2) or len(w) > 1 and not w.lower() in names or re.fullmatch(rf"{rules.PLACES}|{rules.FIRMS}|{rules.STREETS}", w):
            break
        b += m.end() if len(w) == 1 else m.end(1)
    words = rules.WORD.findall(text[a:b])
    if not words or not text[a].isupper() or any(not w[0].isupper() for w in words):
        return None
    titled = bool(rules.TITLE.search(text[max(0, a - 14) : a]))
    if not any(len(w) > 1 and own(w) for w in words) or len(words) == 1 and not titled and words[0].lower() not in names:
        return None
    if re.match(rf"\s(?:{rules.FIRMS}|{rules.STREETS}|{rules.PLACES})(?!\w)", text[b : b + 24]) or re.search(r"\d[A-Z]?\s$", text[max(0, a - 6) : a]):
        return None
    if not titled and words[0].lower() in PLACE_WORDS and AFTER_SITE.search(text[max(0, a - 40) : a]):
        return None
    if not titled and len(words) <= 2 and words[-1].lower() in PLACE_WORDS:
        return None
    return a, b


def finder(spark, lexicon: DataFrame, path: Path | None = None):
    """A function that gives each worker its Finder. The model has a fixed size, the lexicon is a small fixed table."""
    listed = [(r.name_token, r.name_kind) for r in lexicon.select("name_token", "name_kind").dropna().collect()]
    tagger = Tagger.load(path or MODEL)
    plain = (path or MODEL).with_name("personal_plain.txt").read_text().split("\n")
    shared = spark.sparkContext.broadcast((tagger, set(plain), listed))
    stamp = f"{shared._jbroadcast.id()}-{spark.sparkContext.applicationId}"
    return lambda: once(("finder", stamp), lambda: Finder(*shared.value))


def _chunks(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def items(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", path: Path | None = None) -> DataFrame:
    """(key, kind, start_pos, end_pos) of every personal item; positions count code points.

    Null, empty and blank texts have none. Repeated rows give repeated items. Every position of a text is
    tagged, however long the text is; overlapping windows are reconciled before spans are read."""
    get = finder(df.sparkSession, lexicon, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                at, kind, begin, end = [], [], [], []
                for k, found in enumerate(own.find(texts[a:b])):
                    for x, y, what in found:
                        at.append(a + k), kind.append(what), begin.append(x), end.append(y)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(kind, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["key", "kind", "start_pos", "end_pos"])

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    kind = narrow.schema["key"].dataType.simpleString()
    return spread(narrow, "key").mapInArrow(run, f"key {kind}, kind string, start_pos int, end_pos int").withColumnRenamed("key", key)


def redact(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", path: Path | None = None) -> DataFrame:
    """(key, text, n_items int) of every row, each personal item replaced by its kind in brackets, as in [PHONE]."""
    get = finder(df.sparkSession, lexicon, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            texts, out, count = batch.column(1).to_pylist(), [], []
            full = [t or "" for t in texts]
            for a, b in _chunks(full):
                for t, found in zip(texts[a:b], own.find(full[a:b])):
                    count.append(len(found))
                    for x, y, what in reversed(found):
                        t = f"{t[:x]}[{what.upper()}]{t[y:]}"
                    out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(count, pa.int32())], ["key", "text", "n_items"])

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return spread(narrow, "key").mapInArrow(run, f"key {kind}, text string, n_items int").withColumnRenamed("key", key).withColumnRenamed("text", text)

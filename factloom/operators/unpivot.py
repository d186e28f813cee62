"""Wide tables to long facts (T-09, T-10): whole tables meet once, by key, and each Arrow batch of them is read as flat arrays of cells."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.lexicon import Config
from factloom.runtime import once

SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")  # what (?U)\s is in the JVM
EDGES = re.compile(rf"^{SPACE.pattern}|{SPACE.pattern}\Z")
NUMBER = re.compile(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?")
YEAR, LATE_YEAR = re.compile("(?:19|20)[0-9]{2}"), re.compile("(?:FY|CY|FY_)?(20[0-9]{2})")
DIGITS = re.compile("[0-9]+(?:\r\n|[\n\r\x85\u2028\u2029])?")  # as $ in the JVM, which leaves out a last line end
FILLED, HEAD, METRIC, UNIT, IS_NUMBER = 1, 2, 4, 8, 16
SOURCES = pa.array(["table_header", "fallback_no_year_column", "single_row_table_report_year"])
KEPT = 200_000  # readings of distinct cells that a worker remembers
LEAST = np.iinfo(np.int64).min


def _normal(s: str | None) -> str:
    return SPACE.sub(" ", s).strip(" ") if s else ""


def _standard(x: str) -> float:
    """X-01 for a text that is a number once its commas are gone; nan where the commas make it none."""
    s = x.removeprefix("-")
    comma, point = "," in s, "." in s
    if comma and point:
        s = s.replace(".", "").replace(",", ".") if s.rfind(",") > s.rfind(".") else s.replace(",", "")
    elif comma:
        s = s.replace(",", ".") if s.count(",") == 1 and len(s) - s.index(",") <= 3 else s.replace(",", "")
    elif s.count(".") > 1:
        s = s.replace(".", "")
    n = float(s) if NUMBER.fullmatch(s) else np.nan
    return -n if x.startswith("-") else n


def _reading(s: str | None, config: Config) -> tuple[str, int, int, int, float]:
    """Normal text, marks, first year of it (0: none), last 20xx of the text itself, value."""
    x = _normal(s)
    low, number = x.lower(), NUMBER.fullmatch(x.replace(",", "")) is not None
    marks = FILLED * (x != "") | IS_NUMBER * number
    for mark, words in ((HEAD, config.header_words), (METRIC, config.metric_words), (UNIT, config.unit_words)):
        if any([w in low for w in words]):
            marks |= mark
    first, late = YEAR.search(x), LATE_YEAR.findall(s) if s else ()
    return x, marks, int(first[0]) if first else 0, int(late[-1]) if late else 0, _standard(x) if number else np.nan


def _metric_ok(x: str, config: Config) -> bool:
    """F-12 and its like: no heading, no total, none of the words that name no metric."""
    low = x.lower()
    if low in config.invalid_metrics or any(w in low for w in (*config.section_words, *config.total_words)):
        return False
    kinds = [unicodedata.category(c) for c in x]
    letters = sum(k[0] == "L" for k in kinds)
    return x == "" or not letters or kinds.count("Lu") / letters <= 0.8


def _label(s: str | None) -> str:
    """A cell as part of a row's context (T-12): trimmed, '' if it is a number."""
    x = EDGES.sub("", s or "")
    return "" if DIGITS.fullmatch(re.sub("[,.\\- ]", "", x)) else x


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def _chosen(at: np.ndarray, group: np.ndarray, code: np.ndarray, size: int, texts: list, last: bool = True) -> np.ndarray:
    """By group the code of its cell among `at`, -1 if none; of several (a key that came twice) the greatest or least text."""
    out = np.full(size, -1, np.int64)
    g = group[at]
    out[g] = code[at]
    for i in np.flatnonzero(g[1:] == g[:-1]):
        one, other = texts[code[at[i]]], texts[out[g[i]]]
        if other is None or one is not None and (one > other) == last:
            out[g[i]] = code[at[i]]
    return out


def _facts(t: np.ndarray, r: np.ndarray, c: np.ndarray, texts: pa.Array, config: Config, context: bool) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Tables (as in t) of the facts, and their columns. t, r, c: table, row and column of each cell, in this order."""
    encoded = texts.dictionary_encode(null_encoding="encode")
    code, words = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()
    kept = once(("cells read", config), dict)
    if len(kept) > KEPT:
        kept.clear()
    read = []
    for s in words:
        if (one := kept.get(s)) is None:
            one = kept[s] = _reading(s, config)
        read.append(one)
    x = [one[0] for one in read]
    marks, year, late = (np.array([one[k] for one in read], np.int64)[code] for k in (1, 2, 3))
    value = np.array([one[4] for one in read], np.float64)[code]
    has = lambda m: (marks & m) > 0
    filled, number, dated = has(FILLED), has(IS_NUMBER), year > 0

    # Rows and tables; a cell knows both by place.
    row_at = _starts(t, r)
    row_of = np.repeat(np.arange(len(row_at)), np.diff(np.append(row_at, len(t))))
    row_no = r[row_at]
    table_at = _starts(t[row_at])
    tab_of_row = np.repeat(np.arange(len(table_at)), np.diff(np.append(table_at, len(row_at))))
    tab, n_tabs = tab_of_row[row_of], len(table_at)
    n_rows = np.maximum.reduceat(row_no, table_at) + 1

    # T-07: the header row has the best score, the earliest of equals; the key row the first metric word of four rows.
    score = 3 * (dated | has(HEAD)) + filled * (5 * has(HEAD) + 3 * dated + np.where(number, -1, 1))
    s, n = np.add.reduceat(score, row_at), np.add.reduceat(filled.astype(np.int64), row_at)
    best = np.maximum.reduceat(np.where((n > 1) & (s > -1), (s << 32) - row_no, LEAST), table_at)
    header = np.where(best == LEAST, 0, -best & 0xFFFFFFFF)
    named = np.logical_or.reduceat(has(METRIC), row_at) & (row_no < 4)
    key = np.minimum.reduceat(np.where(named, row_no, 4), table_at)
    key = np.where(key == 4, header, key)
    start = np.maximum(header, key) + 1

    # T-08: roles of the columns by the cells of the key row; a table without such cells has no facts.
    at = np.flatnonzero((n_rows[tab] > 1) & (r == key[tab]))
    runs = _starts(tab[at])
    own = tab[at[runs]]
    many, metric_col, unit_col, n_years = np.zeros(n_tabs, bool), np.full(n_tabs, -1), np.full(n_tabs, -1), np.zeros(n_tabs, np.int64)
    many[own] = True
    if len(at):
        score = 1000 + (100 * has(METRIC) - 100 * dated - 50 * has(UNIT) + 5 * (filled & ~number))[at]
        metric_col[own] = -np.maximum.reduceat((score << 32) - c[at], runs) & 0xFFFFFFFF
        unit_col[own] = np.maximum.reduceat(np.where(has(UNIT)[at], c[at], -1), runs)
        n_years[own] = np.add.reduceat(dated[at].astype(np.int64), runs)

    # Value columns: those of the years in the key row, else of years above the data (lower rows win), else all but two.
    slot = tab << 32 | c
    mine = at[dated[at]]
    above = np.flatnonzero(many[tab] & (n_years[tab] == 0) & (r < start[tab]) & (late > 0))
    above = above[np.argsort(slot[above], kind="stable")]
    above = above[np.append(_starts(slot[above])[1:], len(above)) - 1] if len(above) else above
    any_year = np.zeros(n_tabs, bool)
    any_year[tab[mine]] = any_year[tab[above]] = True
    bare = np.flatnonzero((many & ~any_year)[tab] & (r == header[tab]) & (c != metric_col[tab]) & (c != unit_col[tab]))
    v_slot, v_year = np.concatenate([slot[mine], slot[above], slot[bare]]), np.concatenate([year[mine], late[above], np.zeros(len(bare), np.int64)])
    order = np.lexsort((v_year, v_slot))
    order = order[_starts(v_slot[order], v_year[order])]
    v_slot, v_year = v_slot[order], v_year[order]

    # Data rows with a metric, and their numbers in value columns.
    data = many[tab] & (r >= start[tab])
    metric = _chosen(np.flatnonzero(data & (c == metric_col[tab])), row_of, code, len(row_at), x)
    unit = _chosen(np.flatnonzero(data & (c == unit_col[tab])), row_of, code, len(row_at), x)
    ok = np.zeros(len(words) + 1, bool)
    single = (n_rows == 1)[tab]
    head = np.flatnonzero(single & filled & ~number)
    first = np.full(n_tabs, -1)
    first[tab[head[::-1]]] = c[head[::-1]]
    label = _chosen(head[c[head] == first[tab[head]]], tab, code, n_tabs, x, last=False)
    verdicts = once(("metrics", config), dict)
    if len(verdicts) > KEPT:
        verdicts.clear()
    for k in np.unique(np.concatenate([metric, label])):
        if k >= 0:
            if (one := verdicts.get(x[k])) is None:
                one = verdicts[x[k]] = _metric_ok(x[k], config)
            ok[k] = one
    countable = number & ~np.isnan(value)
    cell = np.flatnonzero(countable & ok[metric][row_of])
    low, high = np.searchsorted(v_slot, slot[cell], "left"), np.searchsorted(v_slot, slot[cell], "right")
    times = high - low
    cell, low = np.repeat(cell, times), np.repeat(low, times)
    low += np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
    f_year = v_year[low]

    # Of equal (metric, year, value, column) the first row stays.
    lower: dict[str, int] = {}
    ids = np.zeros(len(words) + 1, np.int64)
    for k in np.unique(metric):
        if k >= 0:
            ids[k] = lower.setdefault(x[k].lower(), len(lower))
    same = (value[cell] + 0.0, f_year, ids[metric[row_of[cell]]], slot[cell])
    order = np.lexsort(same)  # stable: cells come in the order of their rows
    keep = np.sort(order[_starts(*(k[order] for k in same))])
    cell, f_year = cell[keep], f_year[keep]

    # Tables of one row take its first text cell as metric; every number is a fact.
    alone = np.flatnonzero(single & countable & ok[label][tab] & (c != first[tab]))
    row = row_of[cell]
    all_cells = np.concatenate([cell, alone])
    years = np.concatenate([f_year, np.zeros(len(alone), np.int64)])
    source = np.concatenate([np.where(f_year > 0, 0, 1), np.full(len(alone), 2)])
    plain = pa.array([*x, ""], pa.string())
    out = {
        "row_no": pa.array(r[all_cells], pa.int32()), "col_no": pa.array(c[all_cells], pa.int32()),
        "metric_text": plain.take(pa.array(np.concatenate([metric[row], label[tab[alone]]]))), "value": pa.array(value[all_cells]),
        "unit": plain.take(pa.array(np.where((u := np.concatenate([unit[row], np.full(len(alone), -1)])) < 0, len(x), u))),
        "year": pa.array(years, pa.int32(), mask=years == 0), "year_source": SOURCES.take(pa.array(source)),
    }
    if context:
        rows, back = np.unique(row_of[all_cells], return_inverse=True)
        parts = [_chosen(np.flatnonzero(c == k), row_of, code, len(row_at), words)[rows] for k in range(3)]
        shown = {k: _label(words[k]) if k >= 0 else "" for k in np.unique(np.concatenate(parts)).tolist()}
        told = [" ".join(filter(None, [shown[i], shown[j], shown[k]])) if shown[i] else None for i, j, k in zip(*(p.tolist() for p in parts))]
        out["context"] = pa.array(told, pa.string()).take(pa.array(back))
    return t[all_cells], out


def _by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches whose first column is sorted, cut so that no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = b.column(0)[-1]
        cut = pc.index(b.column(0), last).as_py()
        if held and (cut or held[0].column(0)[0] != last):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _places(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each item of the lists: the list it is in, and its place there."""
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.bincount(parent, minlength=len(lists))
    return parent, np.arange(len(parent)) - (np.cumsum(size) - size)[parent]


def facts(df: DataFrame, config: Config, nested: bool, carried: tuple[str, ...] = (), context: bool = False) -> DataFrame:
    """Facts of cells (table_key, row_no, col_no, text), or nested: of tables (table_key, table_data array<array<string>>).

    One exchange, by table_key: rows of one key make one table, as their cells do. Null keys, tables, rows and empty ones
    have no facts; null cells are ''. carried: columns of the tables that each fact takes along; of a key that came
    several times every fact goes with each of them. context: the T-12 text of the row, null for rows without label."""
    columns = ["table_key", *(("table_data",) if nested else ("row_no", "col_no", "text")), *carried]
    schema = T.StructType([df.schema["table_key"], *(T.StructField(n, k) for n, k in (
        ("row_no", T.IntegerType()), ("col_no", T.IntegerType()), ("metric_text", T.StringType()), ("value", T.DoubleType()), ("unit", T.StringType()), ("year", T.IntegerType()), ("year_source", T.StringType()),
    )), *([T.StructField("context", T.StringType())] if context else []), *(df.schema[n] for n in carried)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _by_key(batches):
            whole = whole.combine_chunks()
            key = whole.column("table_key").chunk(0)
            table = key.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if nested:
                data = whole.column("table_data").chunk(0)
                outer, r = _places(data)
                inner, c = _places(rows := pc.list_flatten(data))
                t, r, texts = table[outer][inner], r[inner], pc.list_flatten(rows)
            else:
                t, texts = table, whole.column("text").chunk(0)
                r, c = (whole.column(n).to_numpy().astype(np.int64) for n in ("row_no", "col_no"))
            if not len(t):
                continue
            if not nested or len(_starts(table)) < len(table):
                order = np.lexsort((c, r, t))
                t, r, c, texts = t[order], r[order], c[order], texts.take(pa.array(order))
            of, out = _facts(t, r, c, texts, config, context)
            at = _starts(table)
            if carried:
                times = np.diff(np.append(at, len(table)))[of]
                fact = np.repeat(np.arange(len(of)), times)
                origin = pa.array(at[of][fact] + np.arange(len(fact)) - np.repeat(np.cumsum(times) - times, times))
                out = {n: a.take(pa.array(fact)) for n, a in out.items()} | {n: whole.column(n).chunk(0).take(origin) for n in carried}
            else:
                origin = pa.array(at[of])
            yield pa.RecordBatch.from_pydict({"table_key": key.take(origin), **out})

    whole = df.select(*columns).filter(F.col("table_key").isNotNull()).repartition("table_key").sortWithinPartitions("table_key")
    return whole.mapInArrow(run, schema)

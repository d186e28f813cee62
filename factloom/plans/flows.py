"""Queries of scorers, limits, readers and writers (each writes below the shared folder and reads back) and run states."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.functions import vectors as v
from factloom.lexicon import DEFAULT, SCOPES
from factloom.operators import evaluate, grid, report, scope, scorer
from factloom.plans import documents
from factloom.plans import inputs as i
from factloom.plans.functions import _has, _norm
from factloom.plans.pages import _LENIENT
from factloom.runtime import shared_folder, table
from factloom.sources import files
from factloom.streaming import events as ev

C = F.col
S = SparkSession
STATES = ("uploaded", "starting", "running", "completed", "failed", "cancelled", "idle")


def _new(s: S, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


# Models as scorers.
def u03_predict_scope(s: S, d: str) -> DataFrame:
    b = scorer.scored(i.blocks(s, d), scorer.ActivityScorer, "block_key", name="logits")
    r = scope.classify(b, "text", C("logits"))
    return r.select("block_key", "scope", F.round("confidence", 3).alias("confidence"), "scope_source")


def v04_embeddings(s: S, d: str) -> DataFrame:
    e = scorer.scored(i.pages(s, d).withColumn("k", F.struct("raw_id", "page_no")), scorer.LetterEmbedder, "k", name="x")
    return e.select("k.raw_id", "k.page_no", F.transform("x", lambda x: F.round(x, 6)).alias("embedding"))


# Limits, order, unions.
def k02_line_order(s: S, d: str) -> DataFrame:
    return report.first_rows(i.words(s, d), ["page"], ["y0", "x0", "ocr_index"], 1 << 30).select("page", "ocr_index", C("k").alias("place"))


def k03_word_limits(s: S, d: str) -> DataFrame:
    """Words of a page (180), rows of a table (120) and metrics of a table (50) that reports show."""
    words = report.first_rows(i.words(s, d), ["page"], ["ocr_index"], 180).select(F.lit("words").alias("what"), C("page").alias("key"))
    rows = table(s, d, "all_tables").select("table_key", F.posexplode(F.transform("table_data", F.size)).alias("row_no", "width")).filter("width > 0")
    rows = rows.select("table_key", "row_no").repartition("table_key").distinct()  # what follows needs the rows by table, too
    rows = report.first_rows(rows, ["table_key"], ["row_no"], 120).select(F.lit("rows").alias("what"), C("table_key").alias("key"))
    facts = report.first_rows(documents.t10_facts(s, d), ["table_key"], ["row_no", "col_no"], 50).select(F.lit("metrics").alias("what"), C("table_key").alias("key"))
    return words.unionByName(rows).unionByName(facts).groupBy("what", "key").agg(F.count("*").alias("n"))


def k03_predictions(s: S, d: str) -> DataFrame:
    """The first 100 predictions in the order of their confidence."""
    return documents.r01_resolve(s, d).orderBy(F.desc("confidence"), "page", "block_id").limit(100).select("page", "block_id", "scope", "confidence")


def a04_all_scopes(s: S, d: str) -> DataFrame:
    """Scopes of blocks and of tables together."""
    resolved = documents.r01_resolve(s, d).select("scope")
    return report.shares(resolved.unionByName(documents.r02_table_scope(s, d).select("scope")), "scope")


def a06_label_counts(s: S, d: str) -> DataFrame:
    return report.label_counts(i.words(s, d))


def f14_texts(s: S, d: str) -> DataFrame:
    """Texts that aren't empty, and whether they are long enough to be shown as samples: more than ten words."""
    b = i.blocks(s, d).filter(t.normalize_text(C("text")) != "")
    return b.select("block_key", (F.size(t.words_of(C("text"))) > 10).alias("sample"))


def t06_combined(s: S, d: str) -> DataFrame:
    return grid.pad(documents.j06_segments(s, d), "group_id")


def t06_facts(s: S, d: str) -> DataFrame:
    """Facts read again from the tables that segments were combined to."""
    whole = grid.pad(documents.j06_segments(s, d), "group_id").withColumnRenamed("group_id", "table_key")
    return grid.facts(whole).groupBy("table_key").agg(F.count("*").alias("n"), F.sum(C("value").cast("decimal(24,4)")).cast("double").alias("total"))


def t06_totals(s: S, d: str) -> DataFrame:
    seg = table(s, d, "all_tables").select("table_key", F.floor(C("table_key") / 3).alias("group_id"), "tatr_time")
    return grid.segment_totals(i.cells(s, d), seg).withColumn("tatr_time", F.round("tatr_time", 3))


def m10_speed(s: S, d: str) -> DataFrame:
    b = table(s, d, "layoutlmv3_layout").withColumn("seconds", (F.unix_micros(C("loaded_at").cast("timestamp")) - F.unix_micros(C("ocr_at").cast("timestamp"))) / 1e6)
    return evaluate.throughput(b, "run_id", "num_words", "seconds")


def m10_gap(s: S, d: str) -> DataFrame:
    return evaluate.generalisation_gap(table(s, d, "scope_dataset_balanced"), "source", "split", "quality_score")


# Run states.
def _states(s: S, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in STATES])
    return table(s, d, "events").select(C("user_id").alias("run_id"), "event_id", F.get(names, (C("event_id") % len(STATES)).cast("int")).alias("status"))


def z06_until_final(s: S, d: str) -> DataFrame:
    return ev.until_final(_states(s, d))


def z08_transitions(s: S, d: str) -> DataFrame:
    return ev.transitions(_states(s, d))


# Files, written and read back.
def s04_s06_ocr_words(s: S, d: str) -> DataFrame:
    word = F.struct("text", F.array(*[C(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("bbox"), (C("x0") % 100 / 100).alias("conf"), "ocr_index")
    page = i.words(s, d).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(word), lambda a, b: a["ocr_index"] - b["ocr_index"]), lambda w: w.dropFields("ocr_index")).alias("words"))
    file = page.groupBy(F.floor(C("page") / 500).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(C("page").cast("string"), "words")))).alias("value"))
    path = _new(s, "ocr")
    file.write.partitionBy("part").text(path)
    return files.ocr_words(s, f"{path}/*/*.txt").withColumn("page", C("page").cast("long"))


def s07_coco(s: S, d: str) -> DataFrame:
    r = i.regions(s, d).withColumn("part", F.floor(C("page") / 500))
    box = F.array("x0", "y0", C("x1") - C("x0"), C("y1") - C("y0")).cast("array<double>")
    kinds = F.array(*[F.struct(F.lit(k).cast("long").alias("id"), F.lit(x).alias("name")) for k, x in enumerate(("table", "text", "figure"))])
    a = r.groupBy("part").agg(
        F.array_distinct(F.collect_list(F.struct(C("page").alias("id"), F.concat("page", F.lit(".jpg")).alias("file_name"), F.lit(920).alias("width"), F.lit(1210).alias("height")))).alias("images"),
        F.array_sort(F.collect_list(F.struct(C("page").alias("image_id"), F.expr("cast(case label when 'table' then 0 when 'text' then 1 when 'figure' then 2 else 9 end as long)").alias("category_id"), box.alias("bbox"), "ann_idx"))).alias("annotations"),
    )
    path = _new(s, "coco")
    a.select("part", F.to_json(F.struct("images", "annotations", kinds.alias("categories"))).alias("value")).write.partitionBy("part").text(path)
    return files.coco(s, f"{path}/*/*.txt").drop("ann_idx")


def s08_s09_csv(s: S, d: str) -> DataFrame:
    path = _new(s, "csv")
    files.write_csv(table(s, d, "label_scope_dataset").select("row_id", "block_id", "text", "semantic_score"), path)
    return files.csv(s, path, "row_id long, block_id string, text string, semantic_score double")


def s05_s18_json(s: S, d: str) -> DataFrame:
    path = _new(s, "json")
    files.write_json(table(s, d, "scope_dataset_balanced").select("row_id", "text", "scope", "quality_score"), path)
    return s.read.schema("row_id long, text string, scope string, quality_score double").json(path)


def s10_page_rows(s: S, d: str) -> DataFrame:
    return files.page_rows(table(s, d, "raw_documents"))


def s12_runs(s: S, d: str) -> DataFrame:
    """Blocks by run; the blocks of one type are written a second time with other values and replace their partition only."""
    path = _new(s, "runs")
    b = table(s, d, "layoutlmv3_layout").select("block_key", F.coalesce(F.lower("type"), F.lit("none")).alias("run"), "num_words")
    files.write_run(b, path, "run")
    files.write_run(b.filter("run = 'text'").withColumn("num_words", C("num_words") + 1), path, "run")
    return s.read.parquet(path).groupBy("run").agg(F.count("*").alias("n"), F.sum("num_words").alias("n_words"))


def s13_pending(s: S, d: str) -> DataFrame:
    return files.pending(table(s, d, "scope_dataset_balanced").withColumn("needs_classification", C("scope").isNull())).select("row_id")


def s19_vectors(s: S, d: str) -> DataFrame:
    path = _new(s, "vectors")
    files.write_vectors(table(s, d, "embeddings").select("vec_id", "embedding"), path)
    return s.read.parquet(path).select("vec_id", F.round(v.norm(C("embedding")), 4).alias("norm"))


OWN = [f for name, f in list(globals().items()) if callable(f) and name[1:3].isdigit() and name[0] in "uvkaftmzs"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OWN}


def oracle_sql() -> dict[str, str]:
    own = documents.oracle_sql()
    tail = lambda name, new: own[name] + new
    hits = ["1.0"] + [" + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 2.0 ELSE 0.0 END" for w in dict(scope.ACTIVITIES)[x]) for x in SCOPES[1:]]
    z = [f"exp(({h}) / {DEFAULT.temperature})" for h in hits]
    logits = documents._RESOLVED.replace("FROM esg_text", "FROM scored_in").replace(", ".join(documents._p), ", ".join(f"z{k} / (z0 + z1 + z2 + z3)" for k in range(4)))
    seg = "SELECT table_key, table_key // 3 AS group_id, tatr_time FROM all_tables"
    states = f"st AS (SELECT user_id AS run_id, event_id, ([{', '.join(repr(x) for x in STATES)}])[event_id % {len(STATES)} + 1] AS status FROM events)"
    allowed = " OR ".join(f"before = '{a}' AND status IN ({', '.join(repr(x) for x in to)})" for a, to in ev.NEXT.items() if to)
    combined = own["j06_segments"]
    return {
        "u03_predict_scope": f"""WITH scored_in AS (SELECT block_key AS page, 0 AS block_id, text, {', '.join(f'{x} AS z{k}' for k, x in enumerate(z))} FROM layoutlmv3_layout WHERE text IS NOT NULL), {logits}
            SELECT page AS block_key, scope, round(confidence, 3) AS confidence, scope_source FROM resolved""",
        "v04_embeddings": f"""WITH {i.SQL['pages']} SELECT raw_id, page_no, list_transform(string_split('{" ".join(scorer.LetterEmbedder.letters)}', ' '),
            lambda c: round((length(lower(text)) - length(replace(lower(text), c, ''))) / greatest(1, len(list_filter(regexp_split_to_array(lower(text), '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{b}}]+'), lambda w: w <> ''))), 6)) AS embedding FROM pages_ WHERE text IS NOT NULL""",
        "k02_line_order": f"WITH {i.SQL['words']} SELECT page, ocr_index, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, ocr_index) AS INT) AS place FROM words",
        "k03_word_limits": f"""WITH {i.SQL['words']}, {i.SQL['cells']}, facts_ AS ({own['t10_facts']}), rows_ AS (SELECT DISTINCT table_key, row_no FROM cells)
            SELECT 'words' AS what, page AS key, least(count(*), 180) AS n FROM words GROUP BY page UNION ALL SELECT 'rows', table_key, least(count(*), 120) FROM rows_ GROUP BY table_key
            UNION ALL SELECT 'metrics', table_key, least(count(*), 50) FROM facts_ GROUP BY table_key""",
        "k03_predictions": f"SELECT page, block_id, scope, confidence FROM ({own['r01_resolve']}) ORDER BY confidence DESC, page, block_id LIMIT 100",
        "a04_all_scopes": f"""WITH a AS (SELECT scope FROM ({own['r01_resolve']}) UNION ALL SELECT scope FROM ({own['r02_table_scope']})), c AS (SELECT scope, count(*) AS n FROM a GROUP BY scope)
            SELECT scope, n, round(100.0 * n / sum(n) OVER (), 4) AS pct, CAST(row_number() OVER (ORDER BY n DESC, scope) AS INT) AS place FROM c""",
        "a06_label_counts": f"WITH {i.SQL['words']}, a AS (SELECT page, layout_label, count(*) AS n FROM words GROUP BY ALL) SELECT page, list_sort(list(layout_label || ':' || n)) AS labels FROM a GROUP BY page",
        "f14_texts": f"SELECT block_key, len(string_split({_norm('text')}, ' ')) > 10 AS sample FROM layoutlmv3_layout WHERE {_norm('text')} <> ''",
        "t06_combined": f"""WITH j AS ({combined}), w AS (SELECT group_id, max(col_no) AS last FROM j GROUP BY group_id), f AS (SELECT group_id, row_no, CAST(unnest(range(last + 1)) AS INT) AS col_no FROM (SELECT DISTINCT group_id, row_no FROM j) JOIN w USING (group_id))
            SELECT group_id, row_no, col_no, CASE WHEN j.group_id IS NULL THEN '' ELSE text END AS text FROM f LEFT JOIN j USING (group_id, row_no, col_no)""",
        "t06_facts": f"""WITH j AS ({combined}), w AS (SELECT group_id, max(col_no) AS last FROM j GROUP BY group_id), f AS (SELECT group_id, row_no, CAST(unnest(range(last + 1)) AS INT) AS col_no FROM (SELECT DISTINCT group_id, row_no FROM j) JOIN w USING (group_id)),
            cells AS (SELECT f.group_id AS table_key, row_no, col_no, CASE WHEN j.group_id IS NULL THEN '' ELSE text END AS text FROM f LEFT JOIN j USING (group_id, row_no, col_no)), {documents._FACTS}
            SELECT table_key, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(24,4))) AS DOUBLE) AS total FROM facts WHERE value IS NOT NULL GROUP BY table_key""",
        "t06_totals": f"""WITH {i.SQL['cells']}, c AS (SELECT table_key, max(row_no) + 1 AS n_rows, max(col_no) + 1 AS n_cols, count(*) FILTER ({_LENIENT}) AS n_numeric, bool_or(coalesce({_has('text', DEFAULT.table_words)}, false)) AS is_esg FROM cells GROUP BY table_key)
            SELECT group_id, count(*) AS n_segments, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_numeric) AS BIGINT) AS n_numeric, max(n_cols) AS n_cols, round(sum(tatr_time), 3) AS tatr_time, bool_or(is_esg) AS is_esg FROM ({seg}) JOIN c USING (table_key) GROUP BY group_id""",
        "m10_speed": "SELECT run_id, CAST(sum(num_words) AS BIGINT) AS n_tokens, round(sum(num_words) / nullif(sum((epoch_us(loaded_at) - epoch_us(ocr_at)) / 1e6), 0), 4) AS tokens_per_second FROM layoutlmv3_layout GROUP BY run_id",
        "m10_gap": "SELECT source, round(avg(quality_score) FILTER (split = 'train'), 6) AS train, round(avg(quality_score) FILTER (split = 'validation'), 6) AS validation, round(avg(quality_score) FILTER (split = 'train') - avg(quality_score) FILTER (split = 'validation'), 6) AS gap FROM scope_dataset_balanced GROUP BY source",
        "z06_until_final": f"WITH {states} SELECT run_id, event_id, status FROM (SELECT *, max(CASE WHEN status IN {ev.FINAL!r} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM st) WHERE coalesce(e, 0) = 0",
        "z08_transitions": f"WITH {states}, b AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY run_id ORDER BY event_id), '') AS before FROM st) SELECT *, before = status OR {allowed} AS allowed FROM b",
        "s04_s06_ocr_words": f"WITH {i.SQL['words']} SELECT page, ocr_index, text, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, x0 % 100 / 100 AS conf FROM words",
        "s07_coco": f"WITH {i.SQL['regions']} SELECT page AS image_id, page || '.jpg' AS file_name, 920 AS width, 1210 AS height, CASE WHEN label IN ('table', 'text', 'figure') THEN label END AS label, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM regions",
        "s08_s09_csv": "SELECT row_id, nullif(block_id, '') AS block_id, nullif(text, '') AS text, semantic_score FROM label_scope_dataset",
        "s05_s18_json": "SELECT row_id, text, scope, quality_score FROM scope_dataset_balanced",
        "s10_page_rows": "SELECT document, p.page AS page, p.text AS text FROM (SELECT document, unnest(pages) AS p FROM raw_documents)",
        "s12_runs": "SELECT coalesce(lower(type), 'none') AS run, count(*) AS n, CAST(sum(num_words + CASE WHEN lower(type) = 'text' THEN 1 ELSE 0 END) AS BIGINT) AS n_words FROM layoutlmv3_layout GROUP BY 1",
        "s13_pending": "SELECT row_id FROM scope_dataset_balanced WHERE scope IS NULL",
        "s19_vectors": "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS norm FROM embeddings",
    }

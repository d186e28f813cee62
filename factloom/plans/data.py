"""Queries of summaries, knowledge base, data sets, evaluation, lineage, streams and files, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.lexicon import DEFAULT, LABELS, SCOPES, STEPS
from factloom.operators import dataset, evaluate, kb, lineage, report
from factloom.plans import inputs as i
from factloom.plans.functions import _LOW, _MEANINGFUL, _S, _has, _norm
from factloom.runtime import table
from factloom.sources import files
from factloom.streaming import events as ev

C = F.col
S = SparkSession


# Summaries.
def a01_type_counts(s: S, d: str) -> DataFrame:
    return report.type_counts(i.blocks(s, d).filter("report_id is not null"), ["report_id", "page"])


def a06_first_words(s: S, d: str) -> DataFrame:
    return report.first_words(i.words(s, d))


def a07_table_summary(s: S, d: str) -> DataFrame:
    return report.table_summary(table(s, d, "all_tables"))


def a08_page_totals(s: S, d: str) -> DataFrame:
    return report.totals(table(s, d, "all_tables").select("report_id", "is_esg"), "report_id", "is_esg")


def a10_label_shares(s: S, d: str) -> DataFrame:
    return report.shares(i.words(s, d), "layout_label")


def a11_length_stats(s: S, d: str) -> DataFrame:
    return report.length_stats(i.pages(s, d), "text", ["standard"])


def a12_histogram(s: S, d: str) -> DataFrame:
    return report.histogram(i.pages(s, d).filter("text is not null"), F.length("text").cast("double"), 0, 6000, 30)


def a13_value_counts(s: S, d: str) -> DataFrame:
    return report.shares(table(s, d, "label_scope_dataset"), "scope")


def a14_standards(s: S, d: str) -> DataFrame:
    return table(s, d, "label_scope_dataset").groupBy("semantic_standard").agg(F.count("*").alias("n"), F.round(F.avg("semantic_score"), 6).alias("mean_score"))


def a15_page_counts(s: S, d: str) -> DataFrame:
    r = table(s, d, "raw_documents").groupBy("document").agg(F.sum(F.coalesce(F.size("pages"), F.lit(0))).alias("n_pages"), F.count("*").alias("n_files"))
    return r.withColumn("empty", C("n_pages") <= 0)


def a16_empty_pages(s: S, d: str) -> DataFrame:
    return i.pages(s, d).agg(F.count("*").alias("n_pages"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("n_empty"))


def a17_runs(s: S, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy("event_type", (C("user_id") % 5).alias("seed")).agg(F.avg("value").alias("m"))
    return e.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("std"))


def a18_progress(s: S, d: str) -> DataFrame:
    steps = s.createDataFrame([(k, n, w) for k, (n, _, w) in enumerate(STEPS)], "idx int, step string, weight int")
    return report.progress(steps)


def w18_eta(s: S, d: str) -> DataFrame:
    return i.words(s, d).select("page", "ocr_index", report.eta(C("y0").cast("double"), C("x0") % 101).alias("eta"))


# Top-k, samples, sets.
def k03_limits(s: S, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("report_id", "page").orderBy("table_key")
    return table(s, d, "all_tables").filter("report_id is not null").select("report_id", "page", "table_key", F.row_number().over(w).alias("k")).filter("k <= 20")


def k05_ranking(s: S, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy(C("user_id").cast("string").alias("run")).agg(F.round(F.avg("value"), 2).alias("score"), F.count("*").alias("loss"))
    return evaluate.rank_runs(e)


def k06_best_per_class(s: S, d: str) -> DataFrame:
    return report.best_per_class(table(s, d, "label_scope_dataset").filter("semantic_score is not null and semantic_standard is not null"), "semantic_standard", "semantic_score", "row_id")


def k07_hash_sample(s: S, d: str) -> DataFrame:
    return report.hash_sample(table(s, d, "documents").select("doc_id"), "doc_id", 100)


def k08_flat_rows(s: S, d: str) -> DataFrame:
    b = table(s, d, "layoutlmv3_layout").select("page", "block_id", "type", "text", "value", "unit", F.lit("Other").alias("scope"), "confidence")
    c = table(s, d, "all_tables").select("page", "table_key", C("source_label").alias("content"), F.lit("Other").alias("scope"), "tatr_time").withColumnRenamed("tatr_time", "confidence")
    return report.flat_rows(b, c).groupBy("source", "type").agg(F.count("*").alias("n"), F.count("text").alias("n_text"))


def k09_label_diff(s: S, d: str) -> DataFrame:
    known = s.createDataFrame([(x,) for x in LABELS], "type string")
    return lineage.label_diff(i.blocks(s, d).filter("type is not null").select("type"), known, "type")


# Lineage.
def _fingerprints(df: DataFrame) -> DataFrame:
    return df.select("table_key", t.table_fingerprint(C("page"), C("table_id"), C("table_data")).alias("sha"))


def x15_table_fingerprint(s: S, d: str) -> DataFrame:
    return _fingerprints(table(s, d, "all_tables"))


def j07_fingerprint_diff(s: S, d: str) -> DataFrame:
    """A second source without some tables and with one cell changed in others."""
    cell = F.transform("table_data", lambda r, i: F.transform(r, lambda x, j: F.when((i == 0) & (j == 0) & (C("table_key") % 5 == 0), F.concat(x, F.lit("x"))).otherwise(x)))
    other = table(s, d, "all_tables").filter("table_key % 7 <> 0").withColumn("table_data", cell)
    return lineage.fingerprint_diff(_fingerprints(table(s, d, "all_tables")), _fingerprints(other), ["table_key"]).select("table_key", "why")


def j08_page_names(s: S, d: str) -> DataFrame:
    return i.blocks(s, d).select("block_key", F.regexp_replace("page", r"\.[^.]*$", "").alias("page_key"))


def j09_page_documents(s: S, d: str) -> DataFrame:
    strip = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    b = i.blocks(s, d).select("report_id", strip("page").alias("page"), "block_key").groupBy("report_id", "page").agg(F.array_sort(F.collect_list("block_key")).alias("text_blocks"))
    tb = table(s, d, "all_tables").select("report_id", strip("page").alias("page"), "table_key").groupBy("report_id", "page").agg(F.array_sort(F.collect_list("table_key")).alias("tables"))
    keys = b.select("report_id", "page").union(tb.select("report_id", "page")).filter("report_id is not null").distinct()
    return keys.join(b, ["report_id", "page"], "left").join(tb, ["report_id", "page"], "left")


def j11_remaining(s: S, d: str) -> DataFrame:
    return lineage.remaining(table(s, d, "documents").select("doc_id"), table(s, d, "documents").filter("doc_id % 3 = 0"), ["doc_id"])


def j12_alignment(s: S, d: str) -> DataFrame:
    p = i.words(s, d).groupBy("page").agg(F.max("x1").cast("int").alias("width"), F.max("y1").cast("int").alias("height"))
    return lineage.alignment(p.filter("page % 11 <> 3"), p.filter("page % 13 <> 4").withColumn("width", F.expr("width + cast(page % 17 = 0 as int)")), "page")


def j13_lookup(s: S, d: str) -> DataFrame:
    r = table(s, d, "report_files")
    wanted = r.select("report_id", F.upper("company").alias("company"))
    return lineage.lookup(wanted, r.filter("year < 2018"), "company", lambda c: F.lower(F.trim(c)))


# Knowledge base.
def v01_standards(s: S, d: str) -> DataFrame:
    return i.pages(s, d).select("raw_id", "page_no", F.substring_index("document", "_", 1).alias("standard_of"))


def v02_chunks(s: S, d: str) -> DataFrame:
    return kb.chunk_pages(i.pages(s, d), ["raw_id", "page_no"])


def v06_top_k(s: S, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    r = kb.top_k(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)
    return r.select("query_id", "match_id", "rank", F.round("score", 5).alias("score"))


def v07_best_match(s: S, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    b = kb.best_match(kb.top_k(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 5), e.select("vec_id", C("label").alias("best_label")), "vec_id")
    return b.select("query_id", "best_id", "best_label", F.size("top_matches").alias("n_matches"))


def v08_label_ready(s: S, d: str) -> DataFrame:
    return table(s, d, "label_scope_dataset").select("row_id", t.py_trim(F.coalesce("block_id", F.lit(""))).alias("block_id"), "page", "type", "semantic_standard", F.round("semantic_score", 4).alias("semantic_score"), "matched_page", F.lit(None).cast("string").alias("scope"))


# Data sets.
def _labelled(s: S, d: str) -> DataFrame:
    return dataset.complete(table(s, d, "label_scope_dataset", heavy=True), ()).select("row_id", "block_id", "type", "semantic_score", "matched_chunk", "text", "scope")


def _cleaned(s: S, d: str) -> DataFrame:
    u = dataset.unique_blocks(dataset.unique_texts(dataset.keep_text(_labelled(s, d))))
    return u.filter(t.meaningful(C("text")))


def d01_complete(s: S, d: str) -> DataFrame:
    return dataset.complete(table(s, d, "label_scope_dataset"), (("annotator", "string"),)).select("row_id", "scope", "annotator")


def d02_keep_text(s: S, d: str) -> DataFrame:
    return dataset.keep_text(_labelled(s, d)).select("row_id")


def d03_unique_texts(s: S, d: str) -> DataFrame:
    return dataset.unique_texts(_labelled(s, d)).select("row_id", "scope")


def d04_unique_blocks(s: S, d: str) -> DataFrame:
    return dataset.unique_blocks(_labelled(s, d)).select("row_id", "scope")


def d05_cleaned(s: S, d: str) -> DataFrame:
    return _cleaned(s, d).select("row_id", "scope")


def d06_quality(s: S, d: str) -> DataFrame:
    return dataset.with_quality(_labelled(s, d), "q").select("row_id", F.round("q", 4).alias("quality"))


def _scored(s: S, d: str) -> DataFrame:
    return dataset.with_quality(_cleaned(s, d)).withColumn("quality_score", F.round("quality_score", 6))


def d07_downsample(s: S, d: str) -> DataFrame:
    return dataset.downsample(_scored(s, d)).select("row_id", "scope", "class_rank")


def d08_oversample(s: S, d: str) -> DataFrame:
    return dataset.oversample(_scored(s, d))


def d09_report(s: S, d: str) -> DataFrame:
    before = _scored(s, d).groupBy("scope").agg(F.count("*").alias("before"))
    after = dataset.downsample(_scored(s, d)).groupBy("scope").agg(F.count("*").alias("after"))
    return before.join(after, "scope", "left").fillna(0)


def d10_encode(s: S, d: str) -> DataFrame:
    return dataset.encode_labels(table(s, d, "scope_dataset_balanced"), SCOPES).select("row_id", "label_id")


def d11_split(s: S, d: str) -> DataFrame:
    return dataset.split(table(s, d, "scope_dataset_balanced").select("row_id", "scope")).select("row_id", "fold")


def d11_stratified(s: S, d: str) -> DataFrame:
    return dataset.stratified_split(table(s, d, "scope_dataset_balanced").select("row_id", "scope")).select("row_id", "fold")


def d12_split_leaks(s: S, d: str) -> DataFrame:
    return dataset.split_leaks(table(s, d, "scope_dataset_balanced").select("text", "split"))


def d13_token_stats(s: S, d: str) -> DataFrame:
    return report.length_stats(table(s, d, "scope_dataset_balanced"), "text", ["split"])


# Evaluation.
def _predictions(s: S, d: str) -> DataFrame:
    e = i.esg_text(s, d)
    total = sum((F.pow(f"a{k}", F.lit(3)) for k in range(4)), F.lit(0.0))
    p = F.array(*[F.pow(f"a{k}", F.lit(3)) / total for k in range(4)])
    pred = F.array_position(F.array(*[C(f"a{k}") for k in range(4)]), F.greatest(*[C(f"a{k}") for k in range(4)])) - 1
    return e.select(((C("page") + C("block_id")) % 4).cast("int").alias("truth"), pred.cast("int").alias("pred"), p.alias("p"), "page")


def m01_averages(s: S, d: str) -> DataFrame:
    return evaluate.averages(evaluate.per_class(_predictions(s, d), (0, 1, 2, 3, 4)))


def m02_without(s: S, d: str) -> DataFrame:
    return evaluate.averages(evaluate.per_class(_predictions(s, d), (0, 1, 2, 3)), (0,))


def m03_per_class(s: S, d: str) -> DataFrame:
    return evaluate.per_class(_predictions(s, d), (0, 1, 2, 3, 4))


def m04_confusion(s: S, d: str) -> DataFrame:
    return evaluate.confusion_matrix(_predictions(s, d), (0, 1, 2, 3)).withColumnsRenamed({str(k): f"pred_{k}" for k in range(4)})


def m05_top_k(s: S, d: str) -> DataFrame:
    return evaluate.top_k_accuracy(_predictions(s, d))


def m06_calibration(s: S, d: str) -> DataFrame:
    return evaluate.calibration_error(_predictions(s, d))


def m07_m08_scores(s: S, d: str) -> DataFrame:
    return evaluate.proper_scores(_predictions(s, d))


def m09_agreement(s: S, d: str) -> DataFrame:
    return evaluate.agreement(_predictions(s, d))


def m10_throughput(s: S, d: str) -> DataFrame:
    e = i.blocks(s, d)
    return e.groupBy("type").agg(F.sum("num_words").alias("n_words"), F.round(F.sum("num_words") / F.greatest(F.lit(1), F.count("*")), 4).alias("words_per_block"))


def m11_pivot(s: S, d: str) -> DataFrame:
    p = _predictions(s, d).withColumn("checkpoint", (C("page") % 3).cast("int"))
    f = p.groupBy("truth", "checkpoint").agg(F.avg((C("truth") == C("pred")).cast("double")).alias("recall"))
    return evaluate.score_pivot(f, "truth", "checkpoint", [0, 1, 2], "recall").withColumnsRenamed({str(k): f"checkpoint_{k}" for k in range(3)})


def m12_frame(s: S, d: str) -> DataFrame:
    return _predictions(s, d).groupBy("truth", "pred", (C("truth") == C("pred")).alias("correct")).agg(F.count("*").alias("n"), F.round(F.avg(F.array_max("p")), 6).alias("confidence"))


def m13_extraction(s: S, d: str) -> DataFrame:
    c = i.cells(s, d)
    return evaluate.extraction_accuracy(c.filter("table_key % 9 <> 0"), c.filter("table_key % 8 <> 0").withColumn("text", F.expr("case when table_key % 10 = 0 then '' else text end")), ["table_key", "row_no", "col_no"], ["text"])


# Streams.
def _events(s: S, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("ts", C("ts").cast("timestamp"))


def z01_event_json(s: S, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", ev.event_json("event_id", "event_type").alias("line"))


def z02_z03_lines(s: S, d: str) -> DataFrame:
    line = F.expr("case event_type when 'error' then concat('Error on page ', event_id % 9, '/9') when 'click' then concat('page ', event_id % 9, ' of 9') when 'view' then concat('Warning: slow page ', user_id) else concat('Done ', event_id) end")
    e = table(s, d, "events").select("event_id", line.alias("line"))
    return e.select("event_id", ev.classify_line(C("line")).alias("kind"), ev.line_progress(C("line"))["current"].alias("current"))


def z04_last_events(s: S, d: str) -> DataFrame:
    return ev.last_events(table(s, d, "events")).select("user_id", "event_id", "k")


def z04_ring_buffer(s: S, d: str) -> DataFrame:
    out = ev.run_to_table(ev.ring_buffer(ev.read(s, d)), "z04_ring_buffer", "update")
    return out.groupBy("user_id").agg(F.max_by("n", "newest").alias("n"), F.max_by("oldest", "newest").alias("oldest"), F.max("newest").alias("newest"))


def z05_after(s: S, d: str) -> DataFrame:
    return ev.after(table(s, d, "events"), 500).select("event_id", "event_type")


def z06_tumbling(s: S, d: str) -> DataFrame:
    r = ev.run_to_table(ev.tumbling(ev.read(s, d)), "z06_tumbling")
    return r.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def z06_sessions(s: S, d: str) -> DataFrame:
    r = ev.sessions(_events(s, d), "2 hours")
    return r.select("user_id", F.unix_micros("session_window.start").alias("begin"), "n")


def z07_step_status(s: S, d: str) -> DataFrame:
    runs = s.createDataFrame([(st, k) for st in ("idle", "running", "completed", "failed", "cancelled") for k in range(-1, 7)], "status string, current int")
    steps = s.createDataFrame([(k, n) for k, (n, _, _) in enumerate(STEPS)], "idx int, step string")
    return runs.crossJoin(steps).select("status", "current", "step", ev.step_status(C("status"), C("current"), C("idx")).alias("step_status"))


def z08_run_state(s: S, d: str) -> DataFrame:
    return ev.run_state(table(s, d, "events"))


def z10_next_step(s: S, d: str) -> DataFrame:
    return lineage.next_step(table(s, d, "events").select(C("user_id").alias("run_id"), (C("event_id") % 7).cast("int").alias("step_index")))


# Files.
def s11_manifest(s: S, d: str) -> DataFrame:
    return files.manifest(table(s, d, "all_tables").select("table_key", "rows", "cols"))


def s22_upload_ok(s: S, d: str) -> DataFrame:
    r = table(s, d, "report_files")
    content = F.when(F.length("report_id") % 3 == 0, F.lit(b"PK123")).otherwise(F.lit(b"%PDF-1.7"))
    return r.select("report_id", files.upload_ok(F.when(C("year") % 4 == 0, F.concat("path", F.lit(".exe"))).otherwise(C("path")), content).alias("ok"))


OWN = [f for name, f in list(globals().items()) if callable(f) and name[0] in "awkjvdmzsx" and name[1:3].isdigit()]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OWN}


_json = lambda x: f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"
_SHA = "sha256('{{\"bbox\":null,\"page\":' || " + _json("page") + " || ',\"segments\":[],\"table_data\":' || coalesce(CAST(to_json({}) AS VARCHAR), '[]') || ',\"table_id\":' || " + _json("table_id") + " || '}}')"
_WORDS = f"len(CASE WHEN {_norm('text')} = '' THEN [] ELSE string_split({_norm('text')}, ' ') END)"
_STATS = f"round(avg({_WORDS}), 4) AS mean, CAST(min({_WORDS}) AS INT) AS least, CAST(max({_WORDS}) AS INT) AS most, round(quantile_cont({_WORDS}, 0.25), 4) AS q1, round(quantile_cont({_WORDS}, 0.5), 4) AS median, round(quantile_cont({_WORDS}, 0.75), 4) AS q3"
_LABELLED = "labelled AS (SELECT row_id, block_id, type, semantic_score, matched_chunk, text, coalesce(scope, 'Other') AS scope FROM label_scope_dataset)"
_KEEP = f"({_MEANINGFUL} OR {_has(_norm('text'), DEFAULT.rescue_words)})"


def _uniq(source: str, by: str) -> str:
    return f"SELECT * EXCLUDE k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY scope, semantic_score DESC NULLS LAST, row_id) AS INT) AS k FROM {source}) WHERE k = 1"


_BLOCK = f"regexp_replace(coalesce(block_id, ''), '^{_S}+|{_S}+$', '', 'g')"
_CHUNK = f"lower({_norm('matched_chunk')})"
_BOTH = f"({_LOW} || ' ' || {_CHUNK})"
_count = lambda x: f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)"
_if = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE 0.0 END"
_KIND = "lower(trim(coalesce(type, '')))"
_QUALITY = " + ".join([
    "coalesce(semantic_score * 2.0, 0.0)", f"CASE WHEN {_count(_LOW)} >= 6 THEN 0.2 WHEN {_count(_LOW)} >= 3 THEN 0.1 ELSE 0.0 END", _if(_has(_BOTH, DEFAULT.dataset_words), 0.35), _if(_has(_BOTH, DEFAULT.strong_words), 0.5),
    f"CASE WHEN {_KIND} = 'text' THEN 0.15 WHEN {_KIND} = 'figure' THEN -0.15 ELSE 0.0 END", _if(f"{_count(_CHUNK)} >= 3 AND {_has(_CHUNK, DEFAULT.dataset_words)}", 0.2), _if(f"length({_LOW}) <= 8", -0.3),
    _if(f"length({_LOW}) <= 20 AND NOT {_has(_LOW, DEFAULT.short_words)}", -0.2), _if(f"scope = 'Other' AND {_has(_BOTH, DEFAULT.other_words)}", 0.4), _if(f"scope = 'Other' AND {_has(_LOW, DEFAULT.other_topics)}", 0.3), _if(f"scope = 'Other' AND NOT {_has(_BOTH, DEFAULT.dataset_words)}", -0.4),
])
_CLEANED = f"{_LABELLED}, kept AS (SELECT * FROM labelled WHERE {_KEEP}), ut AS ({_uniq('kept', _LOW)}), ub AS ({_uniq('ut', _BLOCK)}), cleaned AS (SELECT * FROM ub WHERE {_MEANINGFUL}), scored AS (SELECT *, round({_QUALITY}, 6) AS quality_score FROM cleaned)"
_TARGET = "CASE scope " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEFAULT.class_targets) + " END"
_RANKED = f"ranked AS (SELECT row_id, scope, CAST(row_number() OVER (PARTITION BY scope ORDER BY quality_score DESC, semantic_score DESC NULLS LAST, row_id) AS INT) AS class_rank FROM scored), chosen AS (SELECT * FROM ranked WHERE class_rank <= {_TARGET})"
_SPLIT = "f AS (SELECT row_id, CAST('0x' || left(md5('42|' || row_id), 8) AS BIGINT) / 4294967296.0 AS s FROM scope_dataset_balanced), folds AS (SELECT row_id, CASE WHEN s < 0.8 THEN 'train' WHEN s < 0.8 + 0.1 THEN 'validation' ELSE 'test' END AS fold FROM f)"
_q = ", ".join(f"power(a{k}, 3) / (power(a0, 3) + power(a1, 3) + power(a2, 3) + power(a3, 3))" for k in range(4))
_PRED = f"{i.SQL['esg_text']}, pr AS (SELECT CAST((page + block_id) % 4 AS INT) AS truth, CAST(list_position([a0, a1, a2, a3], greatest(a0, a1, a2, a3)) - 1 AS INT) AS pred, [{_q}] AS p, page FROM esg_text)"
_CLASSES = "t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = pred) AS tp FROM pr GROUP BY truth), q AS (SELECT pred AS label, count(*) AS predicted FROM pr GROUP BY pred), c AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM (SELECT CAST(unnest([{}]) AS BIGINT) AS label) LEFT JOIN t USING (label) LEFT JOIN q USING (label)), pc AS (SELECT label, round(coalesce(CASE WHEN predicted > 0 THEN tp / predicted END, 0.0), 6) AS precision, round(coalesce(CASE WHEN support > 0 THEN tp / support END, 0.0), 6) AS recall, round(coalesce(CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) END, 0.0), 6) AS f1, round(coalesce(CASE WHEN predicted + support - tp > 0 THEN tp / (predicted + support - tp) END, 0.0), 6) AS jaccard, support FROM c)"
_AVERAGES = ", ".join([f"round(avg({m}), 6) AS macro_{m}" for m in ("precision", "recall", "f1")] + [f"round(sum({m} * support) / sum(support), 6) AS weighted_{m}" for m in ("precision", "recall", "f1")])


def oracle_sql() -> dict[str, str]:
    w = i.SQL["words"]
    pages = i.SQL["pages"]
    strip = lambda c: f"regexp_replace({c}, '\\.[^.]*$', '')"
    steps = "steps AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {x})" for k, (n, _, x) in enumerate(STEPS)) + ") AS v(idx, step, weight))"
    top = """sims AS (SELECT q.vec_id AS query_id, c.vec_id AS match_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, match_id) AS INT) AS rank FROM sims)"""
    return {
        "a01_type_counts": "WITH a AS (SELECT report_id, page, lower(coalesce(type, 'text')) AS type, count(*) AS n FROM layoutlmv3_layout WHERE report_id IS NOT NULL GROUP BY ALL) SELECT report_id, page, CAST(sum(n) AS BIGINT) AS n_blocks, list_sort(list(type || ':' || n)) AS types FROM a GROUP BY ALL",
        "a06_first_words": f"WITH {w}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY ocr_index) AS INT) AS k FROM words) SELECT page, count(*) AS n_words, string_agg(text, ' ' ORDER BY k) FILTER (k <= 80) AS first_words FROM k GROUP BY page",
        "a07_table_summary": "SELECT count(*) AS n_tables, count(DISTINCT CASE WHEN report_id IS NOT NULL AND page IS NOT NULL THEN (report_id, page) END) AS n_pages, CAST(sum(rows * cols) AS BIGINT) AS n_cells, count(*) FILTER (is_esg) AS n_esg FROM all_tables",
        "a08_page_totals": "SELECT report_id, is_esg, grouping(report_id, is_esg) AS level, count(*) AS n FROM all_tables GROUP BY ROLLUP (report_id, is_esg)",
        "a10_label_shares": f"WITH {w}, c AS (SELECT layout_label, count(*) AS n FROM words GROUP BY 1) SELECT layout_label, n, round(100.0 * n / sum(n) OVER (), 4) AS pct, CAST(row_number() OVER (ORDER BY n DESC, layout_label) AS INT) AS place FROM c",
        "a11_length_stats": f"WITH {pages} SELECT standard, {_STATS} FROM pages_ GROUP BY standard",
        "a12_histogram": f"WITH {pages} SELECT CASE WHEN length(text) >= 6000 THEN 31 ELSE length(text) // 200 + 1 END AS bin, count(*) AS n FROM pages_ WHERE text IS NOT NULL GROUP BY 1",
        "a13_value_counts": "WITH c AS (SELECT scope, count(*) AS n FROM label_scope_dataset GROUP BY 1) SELECT scope, n, round(100.0 * n / sum(n) OVER (), 4) AS pct, CAST(row_number() OVER (ORDER BY n DESC, scope NULLS FIRST) AS INT) AS place FROM c",
        "a14_standards": "SELECT semantic_standard, count(*) AS n, round(avg(semantic_score), 6) AS mean_score FROM label_scope_dataset GROUP BY 1",
        "a15_page_counts": "SELECT document, CAST(sum(coalesce(len(pages), 0)) AS BIGINT) AS n_pages, count(*) AS n_files, sum(coalesce(len(pages), 0)) <= 0 AS empty FROM raw_documents GROUP BY document",
        "a16_empty_pages": f"WITH {pages} SELECT count(*) AS n_pages, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty FROM pages_",
        "a17_runs": "WITH e AS (SELECT event_type, user_id % 5 AS seed, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM e GROUP BY event_type",
        "a18_progress": f"WITH {steps} SELECT idx, step, weight, CAST(trunc(100.0 * sum(weight) OVER (ORDER BY idx) / sum(weight) OVER ()) AS INT) AS pct FROM steps",
        "w18_eta": f"WITH {w} SELECT page, ocr_index, CASE WHEN x0 % 101 > 5 THEN round(y0 / (x0 % 101) * (100 - x0 % 101), 3) END AS eta FROM words",
        "k03_limits": "SELECT * FROM (SELECT report_id, page, table_key, CAST(row_number() OVER (PARTITION BY report_id, page ORDER BY table_key) AS INT) AS k FROM all_tables WHERE report_id IS NOT NULL) WHERE k <= 20",
        "k05_ranking": "WITH e AS (SELECT CAST(user_id AS STRING) AS run, round(avg(value), 2) AS score, count(*) AS loss FROM events GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY score DESC, loss, run) AS INT) AS place FROM e",
        "k06_best_per_class": "SELECT semantic_standard, row_id, semantic_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY semantic_standard ORDER BY semantic_score DESC, row_id) AS INT) AS k FROM label_scope_dataset WHERE semantic_score IS NOT NULL AND semantic_standard IS NOT NULL) WHERE k = 1",
        "k07_hash_sample": "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100",
        "k08_flat_rows": "SELECT source, type, count(*) AS n, count(text) AS n_text FROM (SELECT 'text_block' AS source, type, text FROM layoutlmv3_layout UNION ALL SELECT 'table', 'table', source_label FROM all_tables) GROUP BY ALL",
        "k09_label_diff": "WITH a AS (SELECT DISTINCT type FROM layoutlmv3_layout WHERE type IS NOT NULL), b AS (SELECT unnest([" + ", ".join(map(repr, LABELS)) + "]) AS type) SELECT type, 'unknown' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT type, 'missing' FROM (FROM b EXCEPT FROM a)",
        "x15_table_fingerprint": f"SELECT table_key, {_SHA.format('table_data')} AS sha FROM all_tables",
        "j07_fingerprint_diff": f"""WITH a AS (SELECT table_key, {_SHA.format('table_data')} AS sha, {_SHA.format('changed')} AS other FROM (SELECT *, CASE WHEN table_key % 5 = 0
            THEN list_transform(table_data, lambda r, i: list_transform(r, lambda x, j: CASE WHEN i = 1 AND j = 1 THEN x || 'x' ELSE x END)) ELSE table_data END AS changed FROM all_tables))
            SELECT table_key, CASE WHEN table_key % 7 = 0 THEN 'only_a' ELSE 'changed' END AS why FROM a WHERE table_key % 7 = 0 OR sha <> other""",
        "j08_page_names": f"SELECT block_key, {strip('page')} AS page_key FROM layoutlmv3_layout",
        "j09_page_documents": f"WITH b AS (SELECT report_id, {strip('page')} AS page, list_sort(list(block_key)) AS text_blocks FROM layoutlmv3_layout WHERE report_id IS NOT NULL GROUP BY ALL), t AS (SELECT report_id, {strip('page')} AS page, list_sort(list(table_key)) AS tables FROM all_tables WHERE report_id IS NOT NULL GROUP BY ALL) SELECT coalesce(b.report_id, t.report_id) AS report_id, coalesce(b.page, t.page) AS page, text_blocks, tables FROM b FULL JOIN t ON b.report_id = t.report_id AND b.page IS NOT DISTINCT FROM t.page",
        "j11_remaining": "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0",
        "j12_alignment": f"WITH {w}, p AS (SELECT DISTINCT page FROM words) SELECT page, CASE WHEN page % 13 = 4 THEN 'no_file' WHEN page % 11 = 3 THEN 'no_annotation' ELSE 'size_differs' END AS problem FROM p WHERE (page % 13 = 4) <> (page % 11 = 3) OR (page % 17 = 0 AND page % 13 <> 4 AND page % 11 <> 3)",
        "j13_lookup": "SELECT report_id, upper(company) AS company, lower(company) IN (SELECT lower(company) FROM report_files WHERE year < 2018) AS found FROM report_files",
        "v01_standards": f"WITH {pages} SELECT raw_id, page_no, string_split(document, '_')[1] AS standard_of FROM pages_",
        "v06_top_k": f"WITH {top} SELECT query_id, match_id, rank, round(score, 5) AS score FROM hits WHERE rank <= 5",
        "v07_best_match": f"WITH {top} SELECT h.query_id, h.match_id AS best_id, e.label AS best_label, 5 AS n_matches FROM hits h JOIN embeddings e ON e.vec_id = h.match_id WHERE h.rank = 1",
        "v08_label_ready": f"SELECT row_id, {_BLOCK} AS block_id, page, type, semantic_standard, round(semantic_score, 4) AS semantic_score, matched_page, CAST(NULL AS VARCHAR) AS scope FROM label_scope_dataset",
        "d01_complete": "SELECT row_id, coalesce(scope, 'Other') AS scope, CAST(NULL AS VARCHAR) AS annotator FROM label_scope_dataset",
        "d02_keep_text": f"WITH {_LABELLED} SELECT row_id FROM labelled WHERE {_KEEP}",
        "d03_unique_texts": f"WITH {_LABELLED} SELECT row_id, scope FROM ({_uniq('labelled', _LOW)})",
        "d04_unique_blocks": f"WITH {_LABELLED} SELECT row_id, scope FROM ({_uniq('labelled', _BLOCK)})",
        "d05_cleaned": f"WITH {_CLEANED} SELECT row_id, scope FROM cleaned",
        "d06_quality": f"WITH {_LABELLED} SELECT row_id, round({_QUALITY}, 4) AS quality FROM labelled",
        "d07_downsample": f"WITH {_CLEANED}, {_RANKED} SELECT row_id, scope, class_rank FROM chosen",
        "d09_report": f"WITH {_CLEANED}, {_RANKED}, a AS (SELECT scope, count(*) AS before FROM scored GROUP BY scope), b AS (SELECT scope, count(*) AS after FROM chosen GROUP BY scope) SELECT scope, before, coalesce(after, 0) AS after FROM a LEFT JOIN b USING (scope)",
        "d10_encode": "SELECT row_id, CASE scope " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(SCOPES)) + " END AS label_id FROM scope_dataset_balanced",
        "d11_split": f"WITH {_SPLIT} SELECT row_id, fold FROM folds",
        "d11_stratified": """WITH r AS (SELECT row_id, (row_number() OVER (PARTITION BY scope ORDER BY md5('42|' || row_id), row_id) - 0.5) / count(*) OVER (PARTITION BY scope) AS q FROM scope_dataset_balanced)
            SELECT row_id, CASE WHEN q < 0.8 THEN 'train' WHEN q < 0.8 + 0.1 THEN 'validation' ELSE 'test' END AS fold FROM r""",
        "d12_split_leaks": f"""WITH o AS (SELECT split AS fold, {_LOW} AS key FROM scope_dataset_balanced), k AS (SELECT key FROM o WHERE key <> '' GROUP BY key HAVING count(DISTINCT fold) > 1)
            SELECT fold, count(*) AS n, CAST(count(*) FILTER (fold IS NOT NULL AND key IN (FROM k)) AS BIGINT) AS n_leaked FROM o GROUP BY fold""",
        "d08_oversample": f"""WITH {_CLEANED}, sh AS (SELECT scope, {_TARGET} - count(*) AS need FROM scored WHERE scope IN ('Scope 1', 'Scope 2') GROUP BY scope),
            w AS (SELECT row_id, scored.scope, need, greatest(coalesce(quality_score, 0.0), 0.01) AS w FROM scored JOIN sh USING (scope) WHERE need > 0),
            u AS (SELECT row_id, scope, need, w, sum(w) OVER (PARTITION BY scope ORDER BY md5('42|' || row_id), row_id ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY scope) AS upto FROM w),
            c AS (SELECT row_id, scope, CAST(ceil(upto * need - {(42 * 0.6180339887498949) % 1.0!r}) - ceil(coalesce(lag(upto) OVER (PARTITION BY scope ORDER BY upto, row_id), 0.0) * need - {(42 * 0.6180339887498949) % 1.0!r}) AS INT) AS copies FROM u)
            SELECT row_id, scope, copies FROM c WHERE copies > 0""",
        "d13_token_stats": f"SELECT split, {_STATS} FROM scope_dataset_balanced GROUP BY split",
        "m01_averages": f"WITH {_PRED}, {_CLASSES.format('0, 1, 2, 3, 4')} SELECT {_AVERAGES} FROM pc",
        "m02_without": f"WITH {_PRED}, {_CLASSES.format('0, 1, 2, 3')} SELECT {_AVERAGES} FROM pc WHERE label <> 0",
        "m03_per_class": f"WITH {_PRED}, {_CLASSES.format('0, 1, 2, 3, 4')} SELECT * FROM pc",
        "m04_confusion": f"WITH {_PRED} SELECT truth, " + ", ".join(f"count(*) FILTER (pred = {k}) AS pred_{k}" for k in range(4)) + " FROM pr GROUP BY truth",
        "m05_top_k": f"WITH {_PRED}, r AS (SELECT len(list_filter(range(4), lambda j: p[j + 1] > p[truth + 1] OR p[j + 1] = p[truth + 1] AND j <= truth)) AS r FROM pr) SELECT round(avg(CAST(r <= 2 AS DOUBLE)), 6) AS top_2, round(avg(CAST(r <= 3 AS DOUBLE)), 6) AS top_3 FROM r",
        "m06_calibration": f"WITH {_PRED}, c AS (SELECT list_max(p) AS conf, CAST(truth = pred AS DOUBLE) AS hit FROM pr), b AS (SELECT greatest(1, ceil(conf * 15)) AS bin, count(*) AS n, avg(conf) AS conf, avg(hit) AS acc FROM c GROUP BY 1) SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b",
        "m07_m08_scores": f"WITH {_PRED} SELECT round(avg(list_sum(list_transform(p, lambda x, j: power(x - CASE WHEN j - 1 = truth THEN 1.0 ELSE 0.0 END, 2)))), 6) AS brier, round(avg(-ln(greatest(1e-15, p[truth + 1]))), 6) AS log_loss, round(avg(list_max(p)) FILTER (truth = pred), 6) AS conf_right, round(avg(list_max(p)) FILTER (truth <> pred), 6) AS conf_wrong FROM pr",
        "m09_agreement": f"""WITH {_PRED}, t AS (SELECT truth AS k, count(*) AS t, count(*) FILTER (truth = pred) AS tp FROM pr GROUP BY 1), q AS (SELECT pred AS k, count(*) AS p FROM pr GROUP BY 1), m AS (SELECT coalesce(t, 0) AS t, coalesce(tp, 0) AS tp, coalesce(p, 0) AS p FROM t FULL JOIN q USING (k)),
            s AS (SELECT CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(t) AS DOUBLE) AS s, CAST(sum(t * p) AS DOUBLE) AS x, CAST(sum(t * t) AS DOUBLE) AS tt, CAST(sum(p * p) AS DOUBLE) AS pp, avg(tp / t) FILTER (t > 0) AS bal FROM m)
            SELECT round(c / s, 6) AS accuracy, round(bal, 6) AS balanced_accuracy, round((c / s - x / (s * s)) / (1 - x / (s * s)), 6) AS kappa, round((c * s - x) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 6) AS mcc, round(1 - c / s, 6) AS hamming FROM s""",
        "m10_throughput": "SELECT type, CAST(sum(num_words) AS BIGINT) AS n_words, round(sum(num_words) / greatest(1, count(*)), 4) AS words_per_block FROM layoutlmv3_layout GROUP BY type",
        "m11_pivot": f"WITH {_PRED} SELECT truth, " + ", ".join(f"round(avg(CAST(truth = pred AS DOUBLE)) FILTER (page % 3 = {k}), 6) AS checkpoint_{k}" for k in range(3)) + " FROM pr GROUP BY truth",
        "m12_frame": f"WITH {_PRED} SELECT truth, pred, truth = pred AS correct, count(*) AS n, round(avg(list_max(p)), 6) AS confidence FROM pr GROUP BY ALL",
        "m13_extraction": f"WITH {i.SQL['cells']}, e AS (SELECT * FROM cells WHERE table_key % 9 <> 0), g AS (SELECT table_key, row_no, col_no, CASE WHEN table_key % 10 = 0 THEN '' ELSE text END AS gt FROM cells WHERE table_key % 8 <> 0), j AS (SELECT e.table_key AS ek, g.table_key AS gk, text, gt FROM e FULL JOIN g USING (table_key, row_no, col_no)) SELECT round(count(*) FILTER (ek IS NOT NULL AND gk IS NOT NULL) / count(ek), 6) AS recall, round(count(*) FILTER (ek IS NOT NULL AND gk IS NOT NULL) / count(gk), 6) AS precision, round(avg(CAST(text IS NOT DISTINCT FROM gt AS DOUBLE)) FILTER (ek IS NOT NULL AND gk IS NOT NULL), 6) AS same_text FROM j",
        "z01_event_json": "SELECT event_id, '{\"event_id\":' || event_id || CASE WHEN event_type IS NULL THEN '' ELSE ',\"event_type\":\"' || event_type || '\"' END || '}' AS line FROM events",
        "z02_z03_lines": "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' WHEN 'click' THEN 'progress' ELSE 'info' END AS kind, CASE WHEN event_type IN ('error', 'click') THEN CAST(event_id % 9 AS INT) END AS current FROM events",
        "z04_last_events": "SELECT * FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INT) AS k FROM events) WHERE k <= 500",
        "z04_ring_buffer": "SELECT user_id, CAST(count(*) AS INT) AS n, min(event_id) AS oldest, max(event_id) AS newest FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INT) AS k FROM events) WHERE k <= 500 GROUP BY user_id",
        "z05_after": "SELECT event_id, event_type FROM events WHERE event_id > 500",
        "z06_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
        "z06_sessions": """WITH f AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM f)
            SELECT user_id, epoch_us(min(ts)) AS begin, count(*) AS n FROM g GROUP BY user_id, g""",
        "z07_step_status": f"""WITH {steps}, runs AS (SELECT s.status, r.current FROM (SELECT unnest(['idle', 'running', 'completed', 'failed', 'cancelled']) AS status) s CROSS JOIN (SELECT unnest(range(-1, 7)) AS current) r)
            SELECT status, CAST(current AS INT) AS current, step, CASE WHEN status = 'completed' THEN 'completed' WHEN status = 'failed' THEN CASE WHEN idx = current THEN 'failed' WHEN idx < current THEN 'completed' ELSE 'queued' END WHEN status = 'cancelled' THEN CASE WHEN idx >= current THEN 'cancelled' ELSE 'completed' END WHEN idx < current THEN 'completed' WHEN idx = current AND status = 'running' THEN 'running' ELSE 'queued' END AS step_status FROM runs CROSS JOIN steps""",
        "z08_run_state": "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY user_id",
        "z10_next_step": "SELECT user_id AS run_id, CAST(max(event_id % 7) + 1 AS INT) AS next_step FROM events GROUP BY user_id",
        "s11_manifest": "SELECT '1.0' AS schema_version, 'table_key,rows,cols' AS columns, count(*) AS n_rows FROM all_tables",
        "s22_upload_ok": "SELECT report_id, year % 4 <> 0 AND length(report_id) % 3 <> 0 AS ok FROM report_files",
    }

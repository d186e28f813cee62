"""Operators against plain restatements on small tables, empty tables included."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import dataset, evaluate, grid, kb, layout, lineage, quantities, scope, spatial
from factloom.plans import data, documents, flows, inputs
from factloom.streaming import events as ev

WORDS = "page long, ocr_index int, x0 int, y0 int, x1 int, y1 int, layout_label string, text string"


def words(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = rng.randrange(900), rng.randrange(300)
        rows.append((k % 3, k // 3, x, y, x + rng.randrange(5, 60), y + rng.randrange(8, 20), rng.choice(["table", "figure", "text"]), f"w{k}"))
    return spark.createDataFrame(rows, WORDS), rows


def test_scope_rules(spark):
    p = [0.1, 0.7, 0.1, 0.1]
    cases = [
        ("Scope 1 and scope 2", p, "Mixed", "explicit_mentions"), ("scope 2 use", p, "Scope 2", "explicit_mention"), ("carbon", [0.9, 0.1, 0.0, 0.0], "Other", "model"), ("nice day", p, "Other", "eligibility_gate"),
        ("carbon plan", p, "Scope 1", "model_with_esg_context"), ("carbon 5 MWh", p, "Scope 1", "model_with_measurement_and_esg_context"), ("carbon", [0.2, 0.3, 0.5, 0.0], "Other", "policy_filter"),
    ]
    df = spark.createDataFrame([(k, t, q) for k, (t, q, *_) in enumerate(cases)], "k int, text string, p array<double>")
    got = df.select("k", scope.resolve(F.col("text"), F.col("p")).alias("r")).orderBy("k").collect()
    assert [(r.r.scope, r.r.scope_source) for r in got] == [c[2:] for c in cases]


def test_table_scope(spark):
    df = spark.createDataFrame([(1, "Scope 1", 0.9), (1, "Scope 2", 0.7), (2, "Scope 3", 0.8), (2, "Other", 0.1), (3, "Other", 1.0)], "table_key long, scope string, confidence double")
    assert {r.table_key: (r.scope, r.confidence) for r in scope.table_scope(df).collect()} == {1: ("Mixed", 0.7), 2: ("Scope 3", 0.8), 3: ("Other", 0.0)}


def test_all_rows_vote_in_table_scope(spark, folder):
    votes = {}
    for r in documents.r01_resolve(spark, folder).collect():
        votes.setdefault(r.page, set()).add(r.scope)
    got = {r.table_key: (r.scope, r.scope_source) for r in documents.r02_table_scope(spark, folder).collect()}
    want = {k: sorted(v - {"Other"}) for k, v in votes.items()}
    assert got == {k: ("Mixed", "row_consensus_mixed") if len(v) > 1 else (v[0], "row_consensus") if v else ("Other", "unresolved") for k, v in want.items()}
    assert any(k % 2 and v for k, v in want.items())
    none = scope.table_scope(spark.createDataFrame([(1, "Other", 0.9), (1, "Other", 0.2)], "table_key long, scope string, confidence double")).first()
    assert (none.scope, none.confidence, none.scope_source) == ("Other", 0.0, "unresolved")


def test_lines_against_brute_force(spark):
    df, rows = words(spark)
    got = {(r.page, r.ocr_index): r.line_no for r in layout.lines(df).collect()}
    for page in range(3):
        own = [r for r in rows if r[0] == page]
        cy = lambda r: (r[3] + r[5]) / 2
        own.sort(key=lambda r: (round(cy(r) / 8), r[2], r[1]))
        med = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
        near, wide = max(5, med([r[5] - r[3] for r in own]) * 0.5), med([r[4] - r[2] for r in own]) * 2
        lines, mean = [], None
        for r in own:
            if lines and abs(cy(r) - mean) <= near:
                lines[-1].append(r)
                mean = sum(map(cy, lines[-1])) / len(lines[-1])
            else:
                lines.append([r])
                mean = cy(r)
        no = 0
        for ln in lines:
            ln.sort(key=lambda r: r[2])
            for a, b in zip([None, *ln], ln):
                no += a is not None and b[2] - a[4] > wide
                assert got[page, b[1]] == no
            no += 1


def test_promotion_is_a_closure(spark):
    rows = [(1, 0, 0, 0, 20, 10, "table", "t"), (1, 1, 60, 0, 80, 10, "figure", "a"), (1, 2, 130, 0, 150, 10, "figure", "b"), (1, 3, 900, 900, 920, 910, "figure", "far")]
    got = {r.ocr_index: r.layout_label for r in layout.promoted_labels(spark.createDataFrame(rows, WORDS)).collect()}
    assert got == {0: "table", 1: "table", 2: "table", 3: "figure"}


def test_chunk_starts(spark):
    df = spark.createDataFrame([(1, 60), (2, 61), (3, 120), (4, 130)], "page long, n long")
    got = {}
    for r in layout.chunk_starts(df, "n").collect():
        got.setdefault(r.n, []).append(r.chunk_start)
    assert {k: sorted(v) for k, v in got.items()} == {60: [0], 61: [0, 1], 120: [0, 30, 60], 130: [0, 30, 60, 70]}


def test_virtual_panels_look_at_all_words(spark, folder):
    rows = [(1, k, 20 + 40 * (k % 10) + 520 * (k % 2), 10 * k, 50 + 40 * (k % 10) + 520 * (k % 2), 10 * k + 9, "text", "w") for k in range(40)]
    two = {r.ocr_index: r.panel for r in layout.virtual_panels(spark.createDataFrame(rows, WORDS), 960, 600).collect()}
    assert two == {k: k % 2 for k in range(40)}
    bridge = (1, 40, 300, 10, 600, 19, "text", "fills the gap")
    assert {r.panel for r in layout.virtual_panels(spark.createDataFrame([*rows, bridge], WORDS), 960, 600).collect()} == {0}
    got = documents.w04_virtual_panels(spark, folder)
    assert got.count() == inputs.words(spark, folder).count() and got.agg(F.max("ocr_index")).first()[0] > 24


CELL = "table_key long, row_no int, col_no int, text string"


def as_cells(spark, *tables):
    return spark.createDataFrame([(k, r, c, x) for k, t in enumerate(tables) for r, row in enumerate(t) for c, x in enumerate(row)], CELL)


def test_facts(spark):
    t = [["Indicator", "Unit", "2023", "FY2024"], ["Electricity use", "MWh", "1,234", "1.234,5"], ["GHG", "t", "5", "6"], ["Total energy", "", "1", "2"], ["Fuel", "", "n/a", "7"], ["Fuel", "", "", "7"]]
    one = [["Fuel use", "12", "x"]]
    bare = [["Item", "Amount"], ["Fuel combustion", "42"]]
    got = {(r.table_key, r.row_no, r.col_no): (r.value, r.year, r.year_source, r.unit) for r in grid.facts(as_cells(spark, t, one, bare)).collect()}
    assert got == {
        (0, 1, 2): (1234, 2023, "table_header", "MWh"), (0, 1, 3): (1234.5, 2024, "table_header", "MWh"), (0, 4, 3): (7, 2024, "table_header", ""),
        (1, 0, 1): (12, None, "single_row_table_report_year", ""), (2, 1, 1): (42, None, "fallback_no_year_column", ""),
    }
    assert grid.facts(as_cells(spark, t).filter("false")).count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def odd_tables(spark, folder):
    """A key that came twice, one without value, null and empty tables, rows and cells, odd blanks."""
    rows = [
        (1, "r1", "p1", [["Indicator", "Unit", "FY2024"], ["Fuel\u3000use", "MWh", "1.234,5"], ["Fuel use", None, "1,234.5"], None, [], ["fuel use", "t", "7"]]), (2, "r2", "p2", [["Diesel\n", "12", None]]),
        (3, None, "p3", [["Item", "2023"], ["Scope 1 emissions", "5"]]), (3, "r1", "p4", [["Item", "2023"], ["Scope 1 emissions", "5"]]), (None, "r1", "p5", [["Diesel", "3"]]), (4, "r1", "p6", None), (5, "r1", "p7", []), (6, "r1", "p8", [[]]),
    ]
    spark.createDataFrame(rows, "table_key long, report_id string, page string, table_data array<array<string>>").write.parquet(f"{folder}/all_tables.parquet")
    spark.createDataFrame([("r1", "A", 2024), ("r2", "B", 2022)], "report_id string, company string, year int").write.parquet(f"{folder}/report_files.parquet")
    return str(folder)


def test_facts_take_one_pass(spark, tmp_path):
    got = documents.t10_facts(spark, odd_tables(spark, tmp_path))
    assert exchanges(got) == 1 and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(1, 1, 2, "Fuel use", 1234.5, "MWh", 2024), (1, 5, 2, "fuel use", 7, "t", 2024), (2, 0, 1, "Diesel", 12, "", None), (3, 1, 1, "Scope 1 emissions", 5, "", 2023)]
    assert sorted(tuple(r)[:7] for r in got.collect()) == want
    assert sorted(tuple(r) for r in grid.facts(inputs.cells(spark, str(tmp_path))).collect()) == sorted(tuple(r) for r in got.collect())


def test_scoped_facts_take_one_pass(spark, tmp_path):
    got = documents.q_facts(spark, odd_tables(spark, tmp_path))
    assert exchanges(got) == 2  # the tables by key, the reports to all
    rows = sorted((r.table_key, r.row_no, r.company, r.year, r.page, r.metric_text, r.scope) for r in got.fillna("", ["company"]).collect())
    assert rows == [
        (1, 1, "A", 2024, "p1", "Fuel use", "Scope 1"), (1, 5, "A", 2024, "p1", "fuel use", "Scope 1"), (2, 0, "B", 2022, "p2", "Diesel", "Scope 1"),
        (3, 1, "", 2023, "p3", "Scope 1 emissions", "Other"), (3, 1, "A", 2023, "p4", "Scope 1 emissions", "Other"),
    ]


def test_word_limits(spark, tmp_path):
    long = [["Item", "2023"], *([f"Fuel use {k}", str(k)] for k in range(130)), None, []]
    rows = [(1, long), (2, [["Item", "2023"], None, ["Fuel use", "5"], []]), (2, [["Item", "2023"], None, ["Fuel use", "5"], []]), (3, None), (4, [["Item"]])]
    spark.createDataFrame(rows, "table_key long, table_data array<array<string>>").write.parquet(f"{tmp_path}/all_tables.parquet")
    lines = spark.range(200).selectExpr("if(id < 190, 3, 40) AS l_orderkey", "id AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "1.0 AS l_extendedprice", "2.0 AS l_quantity")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = flows.k03_word_limits(spark, str(tmp_path))
    assert exchanges(got) <= 5  # words by page, rows and whole tables by key, facts by key, the counts
    assert {(r.what, r.key): r.n for r in got.collect()} == {("words", 0): 180, ("words", 2): 10, ("rows", 1): 120, ("rows", 2): 2, ("rows", 4): 1, ("metrics", 1): 50, ("metrics", 2): 1}


def test_region_headers_look_at_all_rows(spark, tmp_path):
    rows = [(1, [["a", "1"], ["b", "2"], ["c", "2023"], ["d", "FY2024"]]), (2, [["a", "1"], ["b", "2"], ["c", "Unit"]]), (3, [["a", "1"], ["b", "2"], ["c", "2023"], [None, ""]]), (4, [["Year", "2"]])]
    spark.createDataFrame(rows, "table_key long, table_data array<array<string>>").write.parquet(f"{tmp_path}/all_tables.parquet")
    assert {r.table_key: r.has_header for r in documents.w08_region_headers(spark, str(tmp_path)).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_join_continuations(spark):
    t = [["Site", "Indicator", "2023"], ["", "Water (fresh", ""], ["", "and reused)", ""], ["North", "", ""], ["South", "Fuel", "3"], ["", "", "4"]]
    got = {}
    for r in grid.join_continuations(as_cells(spark, t)).orderBy("row_no", "col_no").collect():
        got.setdefault(r.row_no, []).append(r.text)
    assert list(got.values()) == [["Site", "Indicator", "2023"], ["", "Water (fresh and reused)", ""], ["North South", "Fuel", "3 4"]]


def test_clean_drops_empty_parts(spark):
    t = [["a", "1", ""], ["", "", ""], ["b", None, ""]]
    rows = [(r.row_no, r.col_no, r.text) for r in grid.clean(as_cells(spark, t)).orderBy("row_no", "col_no").collect()]
    assert rows == [(0, 0, "a"), (0, 1, "1"), (1, 0, "b"), (1, 1, "")]


def test_word_regions(spark):
    w, _ = words(spark, 30)
    r = spark.createDataFrame([(0, 1, "big", 0, 0, 1000, 400), (0, 2, "small", 0, 0, 500, 400), (0, 3, "small_later", 0, 0, 500, 400)], "page long, ann_idx int, label string, x0 int, y0 int, x1 int, y1 int")
    got = spatial.word_regions(w, r, ["page", "ocr_index"]).collect()
    for x in got:
        inside = (x.x0 + x.x1) / 2 <= 500
        assert x.region_label == ("O" if x.page else "small" if inside else "big")


def test_top_k_is_exact(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.match_id for r in kb.top_k(df.filter("vec_id % 10 = 0"), df, "vec_id", "embedding", 3).collect()}
    norm = lambda a: sum(x * x for x in a) ** 0.5 or 1
    for q in range(0, 60, 10):
        s = sorted(((-round(sum(a * b for a, b in zip(rows[q][1], v)) / norm(v) / norm(rows[q][1]), 6), k) for k, v in rows if v and k != q))
        assert [got[q, i] for i in (1, 2, 3)] == [k for _, k in s[:3]]


def test_chunks_cover_text():
    text = ". ".join(f"Sentence number {k} of a long page" for k in range(200))
    out = kb.chunks(text, 300, 60)
    assert all(len(x) <= 300 for x in out) and out[0].startswith("Sentence number 0") and out[-1].endswith("199 of a long page")
    assert kb.chunks("", 300, 60) == []


def test_dataset_and_evaluation(spark):
    rows = [(k, f"b{k % 4}", "text", float(k), None, f"Energy use text {k // 2} of the site", ["Scope 1", "Other", None][k % 3]) for k in range(12)]
    df = dataset.complete(spark.createDataFrame(rows, "row_id long, block_id string, type string, semantic_score double, matched_chunk string, text string, scope string"), ())
    u = dataset.unique_texts(df).collect()
    assert len(u) == 6 and all(r.row_id == min((x for x in df.collect() if x.text == r.text), key=lambda x: (x.scope, -x.semantic_score)).row_id for r in u)
    o = dataset.oversample(df.withColumn("quality_score", F.lit(1.0)))
    assert o.agg(F.sum("copies")).first()[0] == 1000 - df.filter("scope = 'Scope 1'").count()
    p = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (None, 1)], "truth int, pred int")
    c = {r.label: (r.precision, r.recall) for r in evaluate.per_class(p, (0, 1, 2)).collect()}
    assert c == {0: (0.5, 1.0), 1: (1.0, 0.5), 2: (0.0, 0.0)}
    assert evaluate.agreement(p).first().accuracy == pytest.approx(2 / 3, abs=1e-6)


def test_lineage(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, sha string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (4, "w")], "k int, sha string")
    assert {(r.k, r.why) for r in lineage.fingerprint_diff(a, b, ["k"]).collect()} == {(2, "changed"), (3, "only_a"), (4, "only_b")}


def test_stream_equals_batch(spark, folder):
    batch = ev.tumbling(spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    stream = ev.run_to_table(ev.tumbling(ev.read(spark, folder)), "t_tumbling")
    key = lambda r: (r.window.start, r.event_type, r.n)
    assert sorted(map(key, batch.collect())) == sorted(map(key, stream.collect()))


def test_last_events_keep_500(spark, tmp_path):
    rows = [(k, 1) for k in range(600)] + [(1000 + k, 2) for k in range(30)]
    e = spark.createDataFrame(rows, "event_id long, user_id long").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = data.z04_last_events(spark, str(tmp_path)).groupBy("user_id").agg(F.count("*"), F.min("event_id"), F.max("event_id"))
    want = {(1, 500, 100, 599), (2, 30, 1000, 1029)}
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in data.z04_ring_buffer(spark, str(tmp_path)).select("user_id", "n", "oldest", "newest").collect()} == want


# Problem 5.
FACTORS = [("tCO2e", "emissions", "tCO2e", 1.0), ("kgCO2e", "emissions", "tCO2e", 0.001), ("MWh", "energy", "MWh", 1.0), ("kWh", "energy", "MWh", 0.001), ("GWh", "energy", "MWh", 1000.0), ("MMBtu", "energy", "MWh", 0.29307107), ("gal_us", "water", "m3", 0.003785), ("t", "waste", "t", 1.0)]


def test_units_and_numbers():
    units = {"kW.h": ("kWh", 1), "thousand MWh": ("MWh", 1e3), "million Btu": ("MMBtu", 1), "triệu kg CO2e": ("kgCO2e", 1e6), "'000 KG CO2-eq ": ("kgCO2e", 1e3), "metric tons of CO2 equivalent": ("tCO2e", 1), "tCO₂e": ("tCO2e", 1), "gal (US)": ("gal_us", 1), "m³": ("m3", 1), "": None, "apples": None, None: None}
    assert {k: quantities.parse_unit(k) for k in units} == units
    numbers = {"1,234": 1234, "1.234": 1234, "12,97": 12.97, "38,4271": 38.4271, "1.234.567": 1234567, "12,974.03": 12974.03, "12.974,03": 12974.03, "7": 7}
    assert {k: quantities.number(k) for k in numbers} == numbers
    assert quantities.read_text("Fuel (thousand kWh): 1.234 for X in 2014.") == (1234, ("kWh", 1e3))
    assert quantities.read_text("In 2014 X reported 5,5 GWh under fuel.") == (5.5, ("GWh", 1))
    assert quantities.read_text(None) == (None, None)


def layout_rows(spark, rows):
    return spark.createDataFrame([(k, s, i, y, v, u, "text", None, t, 0) for k, s, i, y, v, u, t in rows], "block_key long, site_code string, indicator string, year int, value double, unit string, type string, report_id string, text string, extra int")


def test_same_amounts_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(160):
        mwh = rng.choice([100.0, 100.05, 101.0, 250.0])
        unit, f = rng.choice([("MWh", 1.0), ("kWh", 1000.0), ("mwh", 1.0), ("GWh", 0.001), ("thousand kWh", 1.0)])
        shown = round(mwh * f, 6)
        rows.append((k, rng.choice(["s", "hot", "hot"]), "use", 2020, shown, unit, "shown") if k % 2 else (k, "hot", "use", 2020, None, None, f"X 2020 | Use | {shown:.5f} {unit}"))
    rows += [(900, None, "use", 2020, 1.0, "MWh", ""), (901, "hot", "use", 2020, None, None, None), (902, "hot", "use", 2020, 3.0, "apples", "none")]
    df, factors = layout_rows(spark, rows), spark.createDataFrame(FACTORS, "unit string, dimension string, common_unit string, factor double")
    conv = quantities.convert(df, factors)
    got = {(r.block_key_a, r.block_key_b) for r in quantities.same_amounts(conv).collect()}
    c = [r for r in conv.collect() if r.common_value is not None]
    want = {(a.block_key, b.block_key) for a in c for b in c if a.block_key < b.block_key and a.site_code == b.site_code and a.common_unit == b.common_unit and abs(a.common_value - b.common_value) <= 0.001 * max(a.common_value, b.common_value) and abs(a.unit_amount - b.unit_amount) > 1e-9 * max(a.unit_amount, b.unit_amount)}
    assert got == want and want
    assert {r.block_key for r in conv.collect() if r.review} >= {901, 902}
    assert quantities.same_amounts(quantities.convert(df.filter("false"), factors)).count() == 0


def test_same_amounts_of_negative_values(spark):
    rng = random.Random(7)
    amounts = [sign * 100.0 * 1.0004**k for k in range(40) for sign in (1, -1)] + [0.0, 0.0]
    rows = [(k, "s", "credits", 2020, "MWh", x, rng.choice([1.0, 1000.0])) for k, x in enumerate(amounts)]
    conv = spark.createDataFrame(rows, "block_key long, site_code string, indicator string, year int, common_unit string, common_value double, unit_amount double")
    got = sorted((r.block_key_a, r.block_key_b) for r in quantities.same_amounts(conv).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[5] - b[5]) <= 0.001 * max(abs(a[5]), abs(b[5])) and a[6] != b[6])
    assert got == want and any(amounts[a] < 0 for a, _ in want)


def test_classifier_predicts_missing_units(spark):
    rng = random.Random(2)
    rows = []
    for k in range(600):
        if k % 2:
            rows.append((k, f"s{k}", "electricity", 2020, rng.uniform(1e6, 9e6), "kWh" if k < 560 else None, "in the figure"))
        else:
            rows.append((k, f"s{k}", "emissions", 2020, rng.uniform(10, 90), "tCO2e" if k < 560 else None, "in the figure"))
    factors = spark.createDataFrame(FACTORS, "unit string, dimension string, common_unit string, factor double")
    held = [r for r in quantities.convert(layout_rows(spark, rows), factors).collect() if r.block_key >= 560]
    assert all(r.unit == ("kWh" if r.block_key % 2 else "tCO2e") and r.unit_source == "predicted" and r.probability >= 0.9 for r in held)


def test_the_classifier_decides_missing_units(spark, folder, monkeypatch):
    """The text's unit is evidence for the forests, not a way around them: with forests that know one class only, other units
    are not assigned."""
    layout_, factors = spark.read.parquet(f"{folder}/layoutlmv3_layout.parquet"), spark.read.parquet(f"{folder}/unit_factors.parquet")
    real = {tuple(r) for r in quantities.same_amounts(quantities.convert(layout_, factors)).collect()}
    train = quantities.forest.train
    monkeypatch.setattr(quantities.forest, "train", lambda x, y, **more: train(x, ["MWh" if y[0] in UNIT_NAMES else "1"] * len(y)))
    constant = {tuple(r) for r in quantities.same_amounts(quantities.convert(layout_, factors)).collect()}
    assert real and constant != real and constant < real


UNIT_NAMES = {u for x in quantities.SPELLINGS for u in (x, f"{x}CO2e")}


def test_hot_amounts_pair_in_parts(spark, monkeypatch):
    monkeypatch.setattr(quantities, "HOT", 5)
    rows = [(k, "s", "use", 2020, "MWh", 100.0, 1.0 if k % 3 else 0.001) for k in range(40)]
    conv = spark.createDataFrame(rows, "block_key long, site_code string, indicator string, year int, common_unit string, common_value double, unit_amount double")
    got = sorted((r.block_key_a, r.block_key_b) for r in quantities.same_amounts(conv).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[6] != b[6])

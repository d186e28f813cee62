"""The training-data operators on small tables: brute force, exact round trips, nulls, ties, hot groups, odd columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import copies, lookalikes, mixing, overlap, personal, sampling, scanned, splitting, tokens
from factloom.llm import personal_rules as rules

# Problem 1.
PLAN = "plan_id int, scope string, target_pct int, min_rows int, sample_pct int, min_quality double"


def test_sample_takes_smallest_priorities(spark):
    rng = random.Random(1)
    names = ["Scope 1", "scope_1", "SCOPE-1 ", "Other", None, "Scope 2", "Scope 2"]
    rows = [(k, rng.choice(names), rng.choice([None, rng.random()]), "x") for k in range(600)] + [(None, "Other", 1.0, "x")]
    df = spark.createDataFrame(rows, "row_id long, scope string, quality_score double, plan_id string")
    plan = [(1, "Scope 1", 60, 5, 20, 0.2), (1, "Scope 2", 30, 5, 20, 0.2), (1, "Other", 10, 30, 20, 0.2), (1, "Avoided", 0, 1, 20, 0.2), (2, "Scope 1", 100, 5, 90, 0.5)]
    s = sampling.sample(df, spark.createDataFrame(plan, PLAN))
    got = {p: sorted(r.row_id for r in s.rows.collect() if r.plan_id == p) for p in (1, 2)}
    key = lambda x: re.sub(r"[\s\-_]+", "", x.lower()) if x else "other"
    import hashlib

    for p in (1, 2):
        queue = []
        for _, name, target, floor, _, least in (x for x in plan if x[0] == p):
            own = sorted((hashlib.md5(f"1|{k}".encode()).hexdigest(), k) for k, c, q, _ in rows if k is not None and q is not None and q >= least and key(c) == key(name))
            queue += [(rank > floor, (rank - 0.5) / target if target else float("inf"), name, k) for rank, (_, k) in enumerate(own, 1)]
        size = len(rows) * plan[0 if p == 1 else 4][4] // 100
        assert got[p] == sorted(k for *_, k in sorted(queue)[:size])
    short = {(r.plan_id, r.scope) for r in s.report.collect() if r.short}
    assert (1, "Avoided") in short and (2, "Scope 1") in short
    empty = sampling.sample(df.filter("false"), spark.createDataFrame(plan, PLAN))
    assert empty.rows.count() == 0 and empty.report.filter("short").count() == 5


# Problem 2.
@pytest.mark.parametrize(
    "text,want,odd",
    [
        ("ｋｗｈ ８７％", "kwh 87%", True), ("e\u0301ne\u0323\u0302", "éneệ"[:1] + "nệ", True), ("fu\u200bel\u00ad", "fuel", True), ("a\u00a0b\u2007c", "a b c", True), ("mеthаne", "methane", True), ("ﬁle oﬃce", "file office", True),
        ("Верескал Λαμπέρα", "Верескал Λαμπέρα", False), ("CO₂e m³ 25 °C ±2 – “x” é ệ\n; …", "CO₂e m³ 25 °C ±2 – “x” é ệ\n; …", False), ("", "", False), ("μg/L", "μg/L", False), ("Κεστω\u0301νη", "Κεστώνη", True),
    ],
)
def test_rewrite(text, want, odd):
    assert lookalikes.Rewriter().rewrite(text) == (want, odd)


def test_ordinary_ranges_hold_no_suspect():
    ordinary = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", lookalikes.ORDINARY) + "]")
    assert not [a for a, _ in lookalikes.rules()[0] if len(a) == 1 and ordinary.match(a)]


def test_normalise_keeps_rows(spark):
    df = spark.createDataFrame([(1, "fu\u200bel", "x"), (1, "fu\u200bel", "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 200_000 + "\u00a0", "x"), (5, "plain", None)], "k long, text string, odd string")
    got = lookalikes.normalise(df, ["k"]).collect()
    assert sorted((r.k, r.odd) for r in got) == [(1, True), (1, True), (2, False), (3, False), (4, True), (5, False)]
    assert {r.text for r in got if r.k == 1} == {"fuel"}
    assert lookalikes.found(df.filter("false"), ["k"]).count() == 0


# Problem 3.
def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_overlap_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{chr(97 + k)}" for k in range(13)] + ["low-w"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 10, 11, 19, 20, 21, 35, 60, 108, 119, 122, 140]))] for _ in range(32)]
    rows = []
    for k in range(330):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 7, 12, 14])):
            at = rng.randrange(len(w) + 1)
            op = rng.choice("cad")
            w[at : at + (op != "a")] = [] if op == "d" else [rng.choice(vocabulary)]
        text = rng.choice([" ".join, ", ".join, "\n ".join])(w)
        text = rng.choice([text, text.upper(), text + ".", text + rng.choice([" 12", " 1,2", " 13"])])
        rows.append((k, text, rng.choice(["train", "train", "validation", "test", None]), "s"))
    rows += [(900, None, "train", "s"), (901, "", "test", "s"), (902, "!!", "train", "s"), (903, "?", "test", "s")]
    rows += [(1000 + k, "the very same text here", "train" if k % 2 else "test", "s") for k in range(20)]
    df = spark.createDataFrame(rows, "row_id long, text string, split string, source string")
    got = {(r.row_id_a, r.row_id_b) for r in overlap.pairs(df).collect()}
    canon = lambda t: re.sub(r"[^\w]+|_", " ", re.sub(r"(?<=\d)[.,](?=\d)|(?<=\w)-(?=\w)", "", t.lower())).split()
    want = set()
    for a in rows:
        for b in rows:
            if a[2] == "train" and b[2] in ("validation", "test") and a[1] and b[1]:
                x, y = canon(a[1]), canon(b[1])
                if x and y and re.sub(r"\D", "", a[1]) == re.sub(r"\D", "", b[1]) and edit(x, y) <= max(len(x), len(y)) // 10:
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == want and len(want) > 100
    hot, overlap.HOT = overlap.HOT, 5  # the salted path gives the same rows
    try:
        assert {(r.row_id_a, r.row_id_b) for r in overlap.pairs(df).collect()} == want
    finally:
        overlap.HOT = hot
    assert overlap.pairs(df.filter("false")).count() == 0


# Problem 4.
WORDS = {w: 1000 for w in "the water withdrawal of mill was reviewed by steam network and diesel emissions in march carbon low-carbon external volumes fuel use".split()}
TITLES = (("Brisel Energy",), ("Annual Report", "ESG Databook"))


@pytest.mark.parametrize(
    "kind,text,noisy,want",
    [
        ("text", "the water with-\ndrawal of the mill", True, "the water withdrawal of the mill"), ("text", "the low-\ncarbon mill", False, "the low-carbon mill"), ("text", "the vo1umes of 2O23", True, "the volumes of 2023"),
        ("text", "the extemal fuel", True, "the external fuel"), ("text", "the water\nPage 12 of 80\nof the mill", True, "the water of the mill"), ("Footer", "Page 12", False, "Page 12"), ("text", "158", False, "158"),
        ("text", "the steam with-\nBRISEL ENERGY ANNUAL REPORT 2020\ndrawal", True, "the steam withdrawal"), ("text", "CO2e in FY2022 of PM10 and Q4", False, "CO2e in FY2022 of PM10 and Q4"), ("text", "", False, ""), ("text", "  \n ", False, ""),
        ("text", "the water\nof the mill", False, "the water of the mill"), (None, "the mill was re¬\nviewed", True, "the mill was reviewed"),
    ],
)
def test_repair_block(kind, text, noisy, want):
    assert scanned.Page(WORDS, TITLES).block(kind, text) == (noisy, want)


def test_repair_table():
    page = scanned.Page(WORDS, TITLES)
    assert page.table([["fuel", "2020"], ["", "Page 3 of 9"], ["die5el\nuse", None]]) == (True, [["fuel", "2020"], ["diesel use", None]])
    assert page.table([["fuel", "12"], ["use", "158"]]) == (False, [["fuel", "12"], ["use", "158"]])
    assert page.table([["Page 3"]])[0] is False and page.table([]) == (False, []) and page.table([None, []]) == (False, [[], []])


def test_decoder_splits_and_merges():
    d = scanned.Decoder(WORDS)
    assert [p.word for p in d.decode("thewater")] == ["the", "water"]
    assert [p.word for p in d.decode("with\ndrawal")] == ["withdrawal"] and d.decode("zzzqx") is None


def test_paragraph_of_many_lines():
    lines = ["the water withdrawal of the mill and"] * 200
    assert scanned.paragraphs("\n".join(lines)) == " ".join(lines)
    assert scanned.paragraphs("\n".join([*lines, "", *lines])) == " ".join(lines) + "\n\n" + " ".join(lines)


@pytest.mark.parametrize(
    "text,noisy,want",
    [
        ("use of Thewater network", True, "use of The water network"), ("fuel ofwaler (ofwaler).", True, "fuel of water (of water)."), ("the with drawal of the mill", True, "the withdrawal of the mill"), ("the wi thdrawal of", True, "the withdrawal of"), ("the emis\nsions was", True, "the emissions was"),
        ("the emis\n\nsions", False, "the emis\n\nsions"), ("the emis. sions", False, "the emis. sions"), ("the ern issions.", True, "the emissions."), ("Tant in fuelmarch", False, "Tant in fuelmarch"), ("low carbon fuel", False, "low carbon fuel"),
        ("ofthewaterofthewaterofthewaterofthewaterofthewaterofthewaterofthewater", True, " ".join(["of the water"] * 7)),
    ],
)
def test_repair_spaces(text, noisy, want):
    page = scanned.Page(WORDS, TITLES, frozenset({"the water", "of water", "of the", "water of"}))
    assert page.block("text", text) == (noisy, want)


def test_repair_over_tables(spark):
    rows = [(k, "text", "the water withdrawal of the mill was reviewed and the steam network", "r", "x") for k in range(30)] + [(100, "text", "the water with-\ndrawal", "r", "x"), (100, "text", "the water with-\ndrawal", "r", "x"), (101, None, None, "r", "x"), (102, "text", "the wa+er", "r", "x")]
    layout = spark.createDataFrame(rows, "block_key long, type string, text string, report_id string, noisy string")
    tables = spark.createDataFrame([(1, [["water", "1"], ["", "- 104 -"]]), (2, [["water", None]]), (3, None)], "table_key long, table_data array<array<string>>")
    reports = spark.createDataFrame([("r", "Brisel Energy", "Annual Report")], "report_id string, company string, report_type string")
    got = sorted((r.tbl, r.row_key) for r in scanned.found(layout, tables, reports).collect())
    assert got == [("all_tables", 1), ("layoutlmv3_layout", 100), ("layoutlmv3_layout", 100), ("layoutlmv3_layout", 102)]
    assert scanned.found(layout.filter("false"), tables.filter("false"), reports).count() == 0


def test_rare_misreadings_leave_the_lexicon(spark):
    places = {"theo": "báo cáo {} luật", "khí": "lượng {} thải", "carbon": "low {} fuel", "emissions": "total {} of", "trong": "nước {} năm", "với": "so {} năm"}
    odd = {"thco": "theo", "khl": "khí", "carbori": "carbon", "ernissions": "emissions", "vớl": "với"}
    rows = [t.format(w) for w, t in places.items() for _ in range(1200)] + [places[w].format(x) for x, w in odd.items() for _ in range(12)] + ["xem {} 7 nhé".format("trang")] * 60
    layout = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "block_key long, text string")
    tables = spark.createDataFrame([], "table_key long, table_data array<array<string>>")
    words = scanned.clean_lexicon(layout, tables)
    assert not set(odd) & set(words) and "trang" in words and set(places) <= set(words)
    page = scanned.Page(words, TITLES)
    assert {x: page.verdict(x) for x in odd} == odd


# Problem 6.
def test_copies_against_plain_grouping(spark):
    rng = random.Random(6)
    rows = []
    for k in range(500):
        kind = rng.randrange(4)
        block = rng.choice(["a_b1", "A/B1", "ab1.", "c_2", None, ""])
        if kind == 0:
            fields = ["Unit: kWh", "Site: North Bay", f"Value: {rng.choice(['1,5', '15'])}"]
            rng.shuffle(fields)
            text = rng.choice([" | ", "\n", " || "]).join(fields)
            text = rng.choice([text, text.upper(), text.replace(": ", " = ")])
        else:
            text = rng.choice(["Fuel use rose, again.", "fuel  USE rose again", "fuel rose use again", "1.5 t", "15 t", None, " ", "hot text", "hot text!", "Hot-Text"])
        rows.append((k, block, text, "x"))
    df = spark.createDataFrame(rows, "row_id long, block_id string, text string, first_row_id string")

    def squeeze(s):
        return re.sub(r"[.,](?!\d)|(?<!\d)[.,]|[^\w.,]|_", "", s.lower())

    def canon(t):
        parts = [p for p in re.split(r"[|\n]+", t) if p.strip()]
        if len(parts) > 1 and all(re.match(r"\s*\w[\w ]*\s*[:=]", p) for p in parts):
            return "|".join(sorted("=".join(squeeze(x) for x in re.split("[:=]", p, maxsplit=1)) for p in parts))
        return squeeze(t)

    groups = {}
    for k, b, t, _ in rows:
        if b and t and squeeze(b) and squeeze(t):
            groups.setdefault((squeeze(b), canon(t)), []).append(k)
    want = {k: min(g) for g in groups.values() for k in g}
    got = {r.row_id: r.first_row_id for r in copies.groups(df).collect()}
    assert got == {k: want.get(k, k) for k, *_ in rows}
    counts = {r.row_id: r.copies for r in copies.collapse(df).collect()}
    assert all(counts[min(g)] == len(g) for g in groups.values()) and sum(counts.values()) == len(rows)
    assert copies.groups(df.filter("false")).count() == 0


# Problem 7.
@pytest.mark.parametrize("limit,overlap", [(50, 10), (120, 0), (30, 29), (1, 5), (80, 100)])
def test_cuts(limit, overlap):
    rng = random.Random(limit)
    text = "".join(rng.choice(["word ", "stop. ", "end.\n\n", "line\n", "part, ", "x" * 9, "ệé "]) for _ in range(300))
    out = splitting.cuts(text, limit, overlap)
    over = max(0, min(overlap, limit - 1))
    assert out[0][0] == 0 and out[-1][1] == len(text) and all(b - a <= limit for a, b in out)
    s = splitting.strengths(text)
    for (a, b), (c, _) in zip(out, out[1:]):
        assert c == b - over and c > a
        window = range(a + max(over + 1, limit // 2), a + limit + 1)
        assert b == max(window, key=lambda p: (s[p], p))
    assert splitting.cuts("", 5, 1) == [(0, 0)]


def test_long_page_uses_tiles():
    text = "one two three. " * 20_000
    out = splitting.cuts(text, 1000, 100)
    assert all(text[b - 2 : b] == ". " for _, b in out[:-1]) and len(out) < 600


# Problems 8 and 9.
TEXTS = ["Scope 1: 5 tCO₂e", "", None, "Điện tiêu thụ 🌍🌍 ệ", "<|endoftext|> is text", "  \n\n x", "a" * 50_000]


def test_tokens_round_trip(spark):
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    table = tokens.byte_table(f"{tokens.FOLDER}/{tokens.BYTE_BPE}")
    for k, t in enumerate(TEXTS):
        assert tokens.decode(got[k], table) == (t or "") and 50256 not in got[k]
    assert got[1] == got[2] == []
    off = {r.doc_id: r for r in tokens.offsets(df, "doc_id", "text").collect()}
    assert all(r.same for r in off.values()) and len(off[3].starts) == len(got[3])
    cut = got[3][:-1]
    assert tokens.decode(cut, table) != TEXTS[3]
    for k, starts in ((k, off[k].starts) for k in off):
        assert list(starts) == sorted(starts) and all(0 <= s < max(1, len(TEXTS[k] or "")) for s in starts)
    assert tokens.encode(df.filter("false"), "doc_id", "text").count() == 0


def test_mix(spark):
    rows = [(k, "word " * (k % 7 + 1), "abcd"[k % 4] if k % 9 else None) for k in range(400)] + [(900, None, "a"), (901, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal = spark.createDataFrame([("a", 50, 1), ("b", 30, 3), ("c", 15, 2), ("gone", 5, 4)], "source string, target_pct int, max_repeats int")
    m = mixing.mix(df, goal)
    rep = {r.source: r for r in m.report.collect()}
    sizes = {r.doc_id: r.n_tokens for r in tokens.count(df, "doc_id", "text", []).collect()}
    docs = m.documents.collect()
    assert all(r.copies <= {"a": 1, "b": 3, "c": 2}[r.source] and sizes[r.doc_id] == r.n_tokens > 0 for r in docs) and len({r.doc_id for r in docs}) == len(docs)
    for s, t in (("a", 50), ("b", 30), ("c", 15)):
        got = sum(r.n_tokens * r.copies for r in docs if r.source == s)
        assert got == rep[s].mixed_tokens and abs(100 * got / rep["a"].mixed_tokens / (t / 50) - 100) < 8
    assert rep["gone"].mixed_tokens == 0
    big = {r.source: r for r in mixing.mix(df, goal, total_tokens=10**9).report.collect()}
    assert all(big[s].mixed_tokens == big[s].available_tokens * r for s, r in (("a", 1), ("b", 3), ("c", 2))) and big["a"].short_tokens > 0
    assert mixing.mix(df.filter("false"), goal).documents.count() == 0


# Problem 10.
LEXICON = [("Morwin", "given"), ("Jasperin", "family"), ("Quilla", "given"), ("Keldane", "family"), ("Bay", "given")]
CASES = [
    "Write to morwin.jasperin@staff.silvane.test; copies go to esg.desk [at] norvex [dot] invalid.", "The hotline is answered by Ms. Keldane on 059 555 01 60.", "Liên hệ ông Quilla Keldane, điện thoại +84 92 555 0151.", "Bà Keldane (CCCD số 000 274 249 501) đã ký biên bản.",
    "A resident of 73/19 Quillmere Rd, Neverbec District reported noise near the Fenlune South depot.", "Work order 024-555-0131 was closed by our tenants. Certificate 000-94-4410 covers the Brisul Bay smelter. Follow @GreenHorizonPlan for updates.",
    "Unit price: 5 kg @ 12.33 USD. Lot 7 Copper Road works were piloted in 2020. Meter no. 12345678901 was read. Phase 12 Street lighting saved 52,472 kWh.",
]


def test_personal_items(spark):
    df = spark.createDataFrame([*enumerate(CASES), (90, None), (91, ""), (92, "plain words " * 30_000 + CASES[1])], "doc_id long, text string").withColumn("kind", F.lit("x"))
    lexicon = spark.createDataFrame(LEXICON, "name_token string, name_kind string")
    got = {}
    for r in personal.items(df, lexicon).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.start_pos))
    at = lambda k, *items: {(kind, CASES[k].index(s)) for kind, s in items}
    assert got[0] == at(0, ("email", "morwin"), ("email", "esg.desk"))
    assert got[1] == at(1, ("name", "Keldane"), ("phone", "059"))
    assert got[2] == at(2, ("name", "Quilla"), ("phone", "+84"))
    assert got[3] == at(3, ("name", "Keldane"), ("id_number", "000"))
    assert got[4] == at(4, ("address", "73/19"))
    assert not {5, 6, 90, 91} & set(got)
    shift = len("plain words ") * 30_000
    assert got[92] == {(k, p + shift) for k, p in got[1]}
    red = {r.doc_id: r.text for r in personal.redact(df, lexicon).collect()}
    assert red[1] == "The hotline is answered by Ms. [NAME] on [PHONE]." and red[90] is None and red[91] == "" and red[5] == CASES[5]
    assert personal.items(df.filter("false"), lexicon).count() == 0


def test_tagger_gradients():
    import numpy as np

    from factloom.llm.tagger import TAGS, Tagger

    rng = np.random.default_rng(0)
    t = Tagger({"a": 2, "b": 3, "c": 4}, hidden=5, emb=4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x = rng.integers(2, 5, (7, 3))
    x[5:, 1] = 0
    f, y = rng.integers(0, 4, (7, 3)), rng.integers(0, len(TAGS), (7, 3))
    _, g = t.loss(x, f, y)
    for name in ("E", "L", "Wxf", "Whb", "Wo", "A", "bf"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, eps = t.p[name][at], 1e-3
        t.p[name][at] = old + eps
        up = t.loss(x, f, y)[0]
        t.p[name][at] = old - eps
        down = t.loss(x, f, y)[0]
        t.p[name][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[name][at], rel=0.02, abs=1e-4)


def test_shapes():
    assert rules.phones("phone ((026) 555 0151) or") == [(7, 21)] and rules.phones("Work order 024-555-0131") == []
    assert rules.emails("5 kg @ 12.33 USD") == [] and rules.ids("Batch X12345678") == []


def test_queries_have_contract_columns(spark, folder):
    from factloom.llm import queries as q

    want = {"p1_found": ["plan_id", "scope"], "p2_found": ["tbl", "row_key", "page_no"], "p3_found": ["row_id_a", "row_id_b"], "p4_found": ["tbl", "row_key"], "p6_found": ["first_row_id", "row_id"], "p7_found": ["raw_id", "page_no"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "kind", "start_pos"]}
    for name, columns in want.items():
        df = q.queries()[name](spark, folder)
        assert df.columns == columns and df.count() > 0, name


def test_the_tagger_decides_where_shapes_say_otherwise():
    from factloom.llm.tagger import Tagger

    plain = set(personal.MODEL.with_name("personal_plain.txt").read_text().split("\n"))
    finder = personal.Finder(Tagger.load(personal.MODEL), plain, [])
    text = "Mr Voskar Tembell (ID card 412-77-9043) signed the waste transfer note."
    assert [k for _, _, k in rules.shapes_of(text)] == ["phone"]
    assert ("412-77-9043", "id_number") in [(text[a:b], k) for a, b, k in finder.find([text])[0]]
    finder.tagger.p["bo"] = finder.tagger.p["bo"] + (100.0 * (finder.tagger.p["bo"] * 0 + 1)) * ([1.0] + [0.0] * (len(finder.tagger.p["bo"]) - 1))
    assert finder.find([text]) == [[]]  # a tagger that sees nothing: nothing is found


def test_every_position_is_tagged():
    import numpy as np

    from factloom.llm.tagger import LEAN, TAGS, Tagger

    plain = set(personal.MODEL.with_name("personal_plain.txt").read_text().split("\n"))
    finder = personal.Finder(Tagger.load(personal.MODEL), plain, [])
    around = "the pump was moved. "
    for before, item, after, kind in (
        ("Please write to ", "selmar.ostrick at post.vorwood.org", " before the meeting. ", "email"), ("Call ", "+84 - 24 - 382 - 1234", " for help. ", "phone"),
        ("Call ", "024\u2011555\u20110131", " for help. ", "phone"),
    ):
        for lines in (0, 3, 30, 36, 40, 106, 400):  # at an edge of two windows, too
            text = around * lines + before + item + after + around * lines
            assert [(text[a:b], k) for a, b, k in finder.find([text])[0]] == [(item, kind)], (item, lines)
    for n in (0, 1, personal.STEP, personal.STEP + 1, 5 * personal.STEP + 7, 100_003):
        wins = list(personal.windows(n))
        assert [p for _, _, first, last in wins for p in range(first, last)] == list(range(n))
        assert all(0 <= a <= first < last <= b <= n and b - a <= personal.WIDTH and (a == 0 or first - a == 32) and (b == n or b - last == 32) for a, b, first, last in wins)

    # batches of any lengths: the same as a plain pass and Viterbi over each sequence alone
    t, p = finder.tagger, finder.tagger.p
    texts = ["Ask Mr Voskar Tembell, 024 555 0131, or mail voskar@vorwood.org; \U0001f600.", "Call 024 555 0131.", "Mr Tembell", "x"]
    flags = [np.arange(len(x)) % 4 for x in texts]
    a = p["A"].copy()
    a[0, [k for k, x in enumerate(TAGS) if x[0] == "B"]] += LEAN
    for text, f, got in zip(texts, flags, t.decode([t.ids(x) for x in texts], flags)):
        x = np.array([t.chars.get(c, 1) for c in text])
        assert (t.ids(text) == x).all()
        forth, back = t._run(x[:, None], f[:, None], "f", False)[0][1:, 0], t._run(x[::-1, None], f[::-1, None], "b", False)[0][:0:-1, 0]
        e = np.concatenate([forth, back], 1) @ p["Wo"] + p["bo"]
        score, ways = e[0], []
        for row in e[1:]:
            ways.append((score[:, None] + a).argmax(0))
            score = (score[:, None] + a).max(0) + row
        best = [int(score.argmax())]
        for way in reversed(ways):
            best.append(int(way[best[-1]]))
        assert got.tolist() == best[::-1] and (len(text) < 9 or any(best))


def test_edges_of_long_items_and_of_items_without_shape():
    street = "12 " + "Vorwood " * 2 + "Road" + ", Selmar Ward"
    text = "x " * 400 + street + " y" * 400
    assert personal.edges(text, 805, 808, "address") == [(800, 800 + len(street))]
    text = "Ask 12 34 56 7 now"
    assert rules.shapes_of(text) == [] and personal.edges(text, 3, 14, "phone") == [(4, 14)]
    assert personal.edges("5 kg @ 12 USD", 0, 13, "email") == [] and personal.edges("see 12", 0, 6, "phone") == []
    names = "Ostrick Havelor Benedan Quilmar Sunder Mirlane"
    assert personal.name_edges(f"by {names}.", 3, 3 + len(names), {"by"}, set()) == (3, 3 + len(names))


def scan_page():
    words = {w: 500 for w in "the water of mill emissions in march withdrawal was low reported by plant management energy".split()}
    return scanned.Page(words, (("Acme",), ("Annual Report",)), frozenset({"the water", "emissions in", "water of"}))


@pytest.mark.parametrize(
    "text, fixed",
    [
        ("reported thewater of the mill", "reported the water of the mill"),
        ("reported the wa ter of the mill", "reported the water of the mill"),
        ("emissionsin march was low", "emissions in march was low"),
        ("the withdraw-\nal was low", "the withdrawal was low"),
        ("the withdraw-\n\nal was low", "the withdrawal was low"),
        ("the with-\ndraw-\nal was low", "the withdrawal was low"),
        ("the withdrawa1 of wa ter was low", "the withdrawal of water was low"),
        ("the manage-\nrnent was low", "the management was low"),
    ],
)
def test_one_path_splits_merges_joins_and_corrects(text, fixed):
    assert scan_page().block("text", text) == (True, fixed)


def test_words_as_they_stand_are_no_traces():
    p = scan_page()
    for text in ("the water of the mill", "the mill was low\nin march", "", " ", "co-plant energy", "low-\nenergy plant", "x" * 5000, "water" * 3000 + "zz"):
        assert not p.block("text", text)[0], text[:40]
    assert p.block("text", "low-\nenergy plant")[1] == "low-energy plant"


def test_long_paragraphs_stay_whole():
    lines = "\n".join(["the water of the mill was low in march and more of it was"] * 130)
    assert "\n\n" not in scan_page().block("text", lines)[1]


def test_field_names_of_any_length(spark):
    long = "the yearly average of all purchased and self generated heat"
    rows = [(1, "b", f"{long}: 5; site: x"), (2, "B", f"Site: x;\n{long.upper()} = 5"), (3, "b", f"{long}: 6; site: x")]
    df = spark.createDataFrame(rows, "row_id long, block_id string, text string")
    assert {r.row_id: r.first_row_id for r in copies.groups(df).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("odd, plain", [("Ꭺir", "Air"), ("ᴀir", "air"), ("use ɢas", "use gas"), ("Ⲟil", "Oil"), ("ᗪiesel", "Diesel"), ("ſteam", "steam"), ("a\U0001fbf5", "a5")])
def test_letters_of_rare_scripts(odd, plain):
    assert lookalikes.Rewriter().rewrite(odd) == (plain, True)


def test_rewriting_goes_on_until_nothing_changes():
    text = "e" + "​̂​́" + "x"
    got, odd = lookalikes.Rewriter().rewrite(text)
    assert odd and lookalikes.Rewriter().rewrite(got) == (got, False)

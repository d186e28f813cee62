"""Problem 5: amounts recorded in different units and scales, converted to common units."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import forest
from factloom.runtime import durable, once

# Spellings of the units; a blank stands for any blanks, points and hyphens or none.
SPELLINGS = {
    "kWh": "kw h|kilowatt hours|kilowatt hour|kwh", "MWh": "mw h|megawatt hours|megawatt hour", "GWh": "gw h|gigawatt hours|gigawatt hour",
    "GJ": "gj|gigajoules|gigajoule", "TJ": "tj|terajoules|terajoule", "MJ": "mj|megajoules|megajoule",
    "toe": "toe|tonnes of oil equivalent|tonne of oil equivalent|tons of oil equivalent|tấn dầu quy đổi", "MMBtu": "mmbtu|mm btu|million btu|triệu btu",
    "m3": "m3|cubic metres|cubic metre|cubic meters|cubic meter|cu m|cbm|mét khối|khối", "L": "l|litres|litre|liters|liter|lít", "ML": "ml|megalitres|megalitre|megaliters|megaliter",
    "gal_us": "us gallons|us gallon|us gal|u s gallons|gal (us)|gallons (us)|gallons|gallon|gal",
    "t": "t|tonnes|tonne|metric tons|metric ton|metric tonnes|metric tonne|tons|ton|mt|tấn", "kg": "kg|kgs|kilograms|kilogram|kilogrammes|kilos", "kt": "kt|kilotonnes|kilotonne|kilotons|kiloton",
    "lb": "lb|lbs|pounds|pound", "short_ton": "us short tons|us short ton|short tons|short ton|us tons",
}
SCALES = {1e3: "thousand|thousands|nghìn|ngàn|'000|’000|000s|k", 1e6: "million|millions|mn|mio|mln|triệu", 1e9: "billion|billions|bn|tỷ|tỉ"}
CARBON = r"[\s.\-]*(?:of[\s.\-]*|khí[\s.\-]*)?co2[\s.\-]*(?:equivalents?|eq|e)?"
MASSES = ("t", "kg", "kt", "lb")
LONGEST = 60  # characters of a number
NUMBER = r"\d[\d.,]*\d|\d"
SURE = 0.9
#: How likely a text is to state another unit than the one its amount is in; weighs the classifier against the text.
MISSTATED = 0.001
SAMPLE = 20_000  # labelled rows, at most, that the classifier is fitted on


def _pattern(spelling: str) -> str:
    return r"[\s.\-]*".join(re.escape(w) for w in spelling.split(" "))


def _compile() -> tuple[re.Pattern, dict[str, str], dict[str, float]]:
    squeeze = lambda s: re.sub(r"[\s.\-()]", "", s)
    units = {squeeze(s): u for u, all_ in SPELLINGS.items() for s in all_.split("|")}
    scales = {s: f for f, all_ in SCALES.items() for s in all_.split("|")}
    spelled = sorted((s for all_ in SPELLINGS.values() for s in all_.split("|")), key=len, reverse=True)
    scale = "|".join(sorted(map(re.escape, scales), key=len, reverse=True))
    unit = "|".join(map(_pattern, spelled))
    return re.compile(rf"(?<![^\W\d_])(?:(?P<scale>{scale})[\s.\-]*)?(?P<unit>{unit})(?P<carbon>{CARBON})?(?![^\W_])", re.I), units, scales


PHRASE, UNITS, SCALE_OF = _compile()


def plain(text: str) -> str:
    """Compatibility form without invisible characters, for matching only."""
    text = unicodedata.normalize("NFKC", text)
    return "".join(c for c in text if unicodedata.category(c) != "Cf") if not text.isascii() else text


def number(s: str) -> float | None:
    """Value of a number in either convention: of two separators the last is decimal; one kind more than once groups; a
    lone one before exactly three final digits groups thousands, otherwise it is decimal."""
    s = s.strip().strip(".,")
    if not re.fullmatch(r"\d[\d.,]*", s):
        return None
    commas, points = s.count(","), s.count(".")
    if commas and points:
        decimal = "," if s.rfind(",") > s.rfind(".") else "."
        if s.count(decimal) > 1:
            return None
        s = s.replace("." if decimal == "," else ",", "").replace(decimal, ".")
    elif commas + points > 1 or re.fullmatch(r"\d+[.,]\d{3}", s):
        s = s.replace(",", "").replace(".", "")
    else:
        s = s.replace(",", ".")
    return float(s)


def read_unit(m: re.Match) -> tuple[str, float] | None:
    unit = UNITS.get(re.sub(r"[\s.\-()]", "", m["unit"].lower()))
    if unit is None:
        return None
    if m["carbon"]:
        if unit not in MASSES:
            return None
        unit += "CO2e"
    return unit, SCALE_OF[m["scale"].lower()] if m["scale"] else 1.0


def parse_unit(unit: str | None) -> tuple[str, float] | None:
    """(unit of unit_factors, scale) of a unit as recorded."""
    unit = plain(unit or "").strip()
    m = PHRASE.fullmatch(unit)
    return read_unit(m) if m else None


def read_text(text: str | None) -> tuple[float | None, tuple[str, float] | None]:
    """(number, (unit, scale)) that a text states: the first unit with a number right before it, or after it as in
    "name (unit): number"; else the first unit after which no letter follows a digit, without number."""
    text, first = plain(text or ""), None
    for m in PHRASE.finditer(text):
        unit = read_unit(m)
        if unit is None:
            continue
        before = re.search(rf"({NUMBER})[\s ]*$", text[: m.start()])
        if before:
            return number(before.group(1)), unit
        after = re.match(rf"[\s)]*[:=]\s*({NUMBER})", text[m.end() : m.end() + 60])
        if after:
            return number(after.group(1)), unit
        if first is None and len(m["unit"]) > 1:
            first = unit
    return None, first


@dataclass
class Model:
    """The classifier: one forest for the unit, one for the scale word before it, with the vocabulary of their features."""

    units: list[str]
    indicators: dict[str, int]
    unit: forest.Forest | None = None
    scale: forest.Forest | None = None

    def features(self, value, indicator, kind, report, text_unit, text_number, text) -> list[float]:
        """Magnitude, category, source and neighbouring fields of one block: what its text states is one of them."""
        own = [0.0] * (len(self.units) + 10)
        own[0] = np.log10(abs(value)) if value else -9.0
        own[1] = float(self.indicators.get(indicator or "", -1))
        own[2] = float(sum(map(ord, report or "")) % 64)
        own[3] = float(bool(re.search("[À-ỹ]", text or "")))
        own[4] = float(len(kind or ""))
        own[5] = np.log10(text_unit[1]) if text_unit else -1.0
        own[6] = float(text_number is not None)
        own[7] = np.log10(abs(text_number)) if text_number else -9.0
        own[8] = own[0] - own[7] if value and text_number else -19.0
        own[9] = -1.0
        if text_unit and text_unit[0] in self.units:
            own[9] = float(self.units.index(text_unit[0]))
            own[10 + self.units.index(text_unit[0])] = 1.0
        return own

    def assign(self, x: np.ndarray, stated: list[tuple[str, float] | None]) -> list[tuple[tuple[str, float], float, float]]:
        """The likeliest (unit, scale) of each row, its probability given what the text states, and the forests' own
        probability of it. A text states the true unit but for MISSTATED of all cases, whatever the unit; so the forests
        decide alone where nothing is stated, and overrule a text only where they are that sure of another unit."""
        out = []
        for pu, ps, said in zip(self.unit.predict(x), self.scale.predict(x), stated):
            joint = pu[:, None] * ps[None]
            weighed = joint
            if said is not None:
                weighed = joint * MISSTATED
                at = np.flatnonzero(self.unit.classes == said[0]), np.flatnonzero(self.scale.classes == f"{said[1]:g}")
                if len(at[0]) and len(at[1]):
                    weighed[at[0][0], at[1][0]] = joint[at[0][0], at[1][0]]
            u, s = np.unravel_index(int(weighed.argmax()), weighed.shape)
            out.append(((str(self.unit.classes[u]), float(self.scale.classes[s])), float(weighed[u, s] / weighed.sum()), float(joint[u, s])))
        return out


def fit(blocks: DataFrame, factors: DataFrame, most: int = SAMPLE) -> Model:
    """Fits the classifier on at most `most` blocks with a recorded, readable unit, chosen by hash of their key."""
    units = [r.unit for r in factors.select("unit").orderBy("unit").collect()]  # fixed table
    labelled = blocks.filter("unit is not null and value is not null")
    share = 1.5 * most / max(1, labelled.count())  # by hash first, so that all tasks together send little more than `most`
    near = labelled.filter(F.pmod(F.xxhash64("block_key"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20))) if share < 1 else labelled
    rows = near.orderBy(F.xxhash64("block_key"), "block_key").select("value", "unit", "indicator", "type", "report_id", "text").limit(most).collect()
    model = Model(units, {x: k for k, x in enumerate(sorted({r.indicator or "" for r in rows}))})
    x, unit, scale = [], [], []
    for r in rows:
        known = parse_unit(r.unit)
        if known:
            n, u = read_text(r.text)
            x.append(model.features(r.value, r.indicator, r.type, r.report_id, u, n, r.text))
            unit.append(known[0])
            scale.append(f"{known[1]:g}")
    if x:
        model.unit, model.scale = forest.train(np.asarray(x, float), unit), forest.train(np.asarray(x, float), scale, trees=16)
    return model


KEYS = ["block_key", "site_code", "indicator", "year"]
AMOUNT = {
    "value": pa.float64(), "unit": pa.string(), "scale": pa.float64(), "common_unit": pa.string(), "common_value": pa.float64(), "unit_amount": pa.float64(),
    "unit_source": pa.string(), "probability": pa.float64(), "review": pa.bool_(),
}


def convert(layout: DataFrame, factors: DataFrame, sure: float = SURE, most: int = SAMPLE) -> DataFrame:
    """A row per block that states a quantity (site_code, indicator and year set), its amount in the common unit.

    (block_key, site_code, indicator, year, value, unit, scale, common_unit, common_value, unit_amount, unit_source,
    probability, review). A recorded unit is read as it stands. Every other block gets its unit and scale from the
    classifier, for which the unit that the text states is evidence: the likeliest one is assigned if it is at least
    `sure`, otherwise the block goes to review without amount. A null value is the number beside the unit in the text. An
    assigned unit that isn't the stated one is assigned but reviewed. unit_amount is what one unit as recorded is in
    the common unit. unit_source: recorded; text, if the assigned unit is the stated one; predicted, if not; none.
    Unreadable recorded units count as not recorded; where the text states none either, the block goes to review. Where there is too little to train on, only recorded units count.
    Nulls in any other column are allowed; no quantity, no row.
    """
    blocks = layout.filter("site_code is not null and indicator is not null and year is not null").select(*KEYS, "value", "unit", "type", "report_id", "text")
    model = fit(blocks, factors, most)
    table = {r.unit: (r.common_unit, r.factor) for r in factors.select("unit", "common_unit", "factor").collect()}
    shared = layout.sparkSession.sparkContext.broadcast((model, table))  # bounded by the sample
    stamp = f"{shared._jbroadcast.id()}-{layout.sparkSession.sparkContext.applicationId}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = once(("units", stamp), lambda: shared.value)
        for batch in batches:
            rows = batch.select(["value", "unit", "indicator", "type", "report_id", "text"]).to_pylist()
            found, ask, stated = [], [], []
            for k, r in enumerate(rows):
                recorded = parse_unit(r["unit"]) if r["value"] is not None else None
                n, u = (None, None) if recorded else read_text(r["text"])
                value = r["value"] if r["value"] is not None else n
                found.append([value, recorded, "recorded" if recorded else "none", 1.0 if recorded else None, not recorded])
                strange = not recorded and u is None and r["value"] is not None and (r["unit"] or "").strip()
                if not recorded and value is not None and not strange:
                    ask.append((k, own.features(value, r["indicator"], r["type"], r["report_id"], u, n, r["text"])))
                    stated.append(u)
            if ask and own.unit and own.scale:
                assigned = own.assign(np.asarray([x for _, x in ask], float), stated)
                for (k, _), said, (unit, weighed, chance) in zip(ask, stated, assigned):
                    found[k][3] = chance
                    if weighed >= sure:
                        found[k][1:3] = unit, "text" if unit == said else "predicted"
                        found[k][4] = said is not None and unit != said
            out = {c: [] for c in AMOUNT}
            for value, unit, source, p, review in found:
                common = known.get(unit[0]) if unit else None
                amount = common[1] * unit[1] if common else None
                whole = value * amount if common and value is not None else None
                cells = (value, *(unit or (None, None)), common[0] if common else None, whole, amount, source, p, review or whole is None)
                for c, v in zip(out, cells):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEYS], *[pa.array(v, AMOUNT[c]) for c, v in out.items()]], [*KEYS, *out])

    kinds = {pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean"}
    schema = ", ".join(["block_key long, site_code string, indicator string, year int", *[f"{c} {kinds[k]}" for c, k in AMOUNT.items()]])
    return blocks.mapInArrow(run, schema)


#: Blocks of one amount and unit from which the pairs of rows are made in SALT parts.
HOT, SALT = 10_000, 64


def same_amounts(converted: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(block_key_a, block_key_b), smaller first: blocks of one site, indicator and year whose amounts agree within
    `tolerance` of the larger, in units that stand for different amounts of the common unit.

    Blocks of one group with the same amount in the same unit are one class; classes of one sign meet in logarithmic
    buckets, and pairs of blocks come from the pairs of classes, those of a hot class in salted parts. Blocks without amount
    are in no pair; two zeros agree. Blocks in the same unit are never paired."""
    keys = ["site_code", "indicator", "year", "common_unit"]
    amount = [*keys, "common_value", "unit_amount"]
    width = float(-np.log1p(-tolerance) * 1.001)
    bucket = F.when(F.col("common_value") == 0, F.lit(-(10**9))).otherwise(F.floor(F.log(F.abs("common_value")) / width))
    rows = converted.filter("common_value is not null and block_key is not null").withColumn("common_value", F.col("common_value") + 0.0)  # no negative zero
    rows = durable(rows.select("block_key", *amount, F.unhex(F.md5(F.to_json(F.struct(*amount)))).alias("cls")))
    some = rows.groupBy("cls", *amount).agg(F.count("*").alias("n"))
    some = some.withColumn("sign", F.signum("common_value").cast("int")).withColumn("b", bucket.cast("long"))
    a = some.withColumnsRenamed({"cls": "cls_a", "common_value": "va", "unit_amount": "ua", "n": "na"}).withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    b = some.withColumnsRenamed({"cls": "cls_b", "common_value": "vb", "unit_amount": "ub", "n": "nb"})
    agree = (F.abs(F.col("va") - F.col("vb")) <= tolerance * F.greatest(F.abs("va"), F.abs("vb"))) & (F.abs(F.col("ua") - F.col("ub")) > 1e-9 * F.greatest("ua", "ub"))
    links = durable(a.join(b, [*keys, "sign", "b"]).filter((F.col("cls_a") < F.col("cls_b")) & agree).select("cls_a", "cls_b", "na", "nb"))
    left, right = (rows.select(F.col("cls").alias(f"cls_{x}"), F.col("block_key").alias(f"k{x}"), F.pmod(F.xxhash64("block_key"), F.lit(SALT)).cast("int").alias(f"s{x}")) for x in "ab")
    hot = F.greatest("na", "nb") > HOT
    cold = links.filter(~hot).select("cls_a", "cls_b").join(left, "cls_a").join(right, "cls_b")
    parts = F.sequence(F.lit(0), F.lit(SALT - 1))
    salted = links.filter(hot).select("cls_a", "cls_b", F.explode(parts).alias("sa")).join(left, ["cls_a", "sa"])
    salted = salted.withColumn("sb", F.explode(parts)).join(right, ["cls_b", "sb"])
    hit = cold.select("ka", "kb").unionByName(salted.select("ka", "kb"))
    return hit.select(F.least("ka", "kb").alias("block_key_a"), F.greatest("ka", "kb").alias("block_key_b"))

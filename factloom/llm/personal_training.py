"""Trains the tagger of personal.py: python -m factloom.llm.personal_training FOLDER_OF_TABLES [STEPS]

Spans are known because they are generated: sentences from templates, filled with invented names, mailboxes, numbers and
addresses, stand among sentences of the corpus that hold nothing personal. No pattern labels anything. Sentences of the
corpus are taken from a bounded sample of documents by the hash of their text, and only if every capitalised word in them
is explained: it begins the sentence, belongs to the name of a site or firm, or is frequent. The labels that
personal_rules.shapes_of would give on held-out documents are only compared at the end."""

from __future__ import annotations

import random
import re
import sys
import unicodedata
import zlib
from collections import Counter
from multiprocessing import Pool
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from factloom.llm import personal
from factloom.llm import personal_rules as rules
from factloom.llm.tagger import TAGS, Tagger, alphabet

SENTENCES = 40_000  # of the corpus, at most
GENERATED = 30_000
WORKERS = 6
DOCUMENTS = 5_000  # that a trained tagger labels for its second training, at most
T = 176
SYLLABLES = "ba be bri ca cor da den dra el fa fen ga gor ha hol is jo ka kel la lor ma mer na nor o pel qua ra ri sa sol ta tor u va vel wi xan ya zor thú bảo nguyễ đà lê phạ".split()
TAILS = "n l r s th dor lan vik mir sen mont wood ley ridge dale na ra lo vin rel orr".split()

TEMPLATES = """
Contact {name}, {email} or {phone}.|For access cards contact {name}, {email} or {phone}.|Call {phone} for help.|Write to {email}; copies go to {email}.
Please send comments to {email} before the meeting.|Email: {email}|Tel.: {phone}|Phone {phone} ext. {n}|Fax {phone}, attn. {name}
{phone} is the night line of the {site} plant.|The hotline is answered by {titled} on {phone}.|Our desk can be called at {phone} ext. {n}.
Whistleblowers reach the office by phone ({phone}) or mail <{email}>.|Complaints may be sent to {email} or told to {titled}.
The resident at {addr} and can be called at {phone}.|A resident of {addr} reported noise near the gate.|Letters may be sent to {addr}.
Parcels went to {addr}, care of {name}.|Contractor {name} lives at No. {addr} and can be called at {phone}.|Survey reply from {name}, {addr}: the smell is worse at night.
{name} asked that our tenants stop the works next to {addr}.|Home address: {addr}|Room bookings: {name} | {phone} | {addr}
{name} of {addr} signed the petition.|The complaint by {name} about dust was closed.|We thank {name} and {name} for their reviews of the boilers.
According to {name}, the kiln was stopped.|Signed: {name}|Prepared by {name}; approved by {titled}.|Our site lead, {name}, joined in 20{n}.
In March {name} asked that the pump be moved.|Badge holders {titled} and {titled} left early.|{titled} signed the waste transfer note.|Minutes: {name}, {name}; absent: {titled}.
{titled} (ID card {id}) signed the waste transfer note.|National ID no. {id} was entered for driver {name}.|Passport {id} of the visiting auditor {name} was copied.
The trainee's papers (passport {id}, issued in 20{n}) were returned to {name}.|Commuter record: {name}; {phone}; {email}; {id} (citizen ID).
Driver {name} holds licence {id}.|The unit modernised sensors; {titled} was absent.|Visitors report to {titled}, room {n}.|Dear {titled}, thank you for the letter of 3 May.
Our nurse {name} measured noise near the {site} kiln.|{name} (mobile {phone}) watches the {site} tanks.|{name} replaced {name} as energy manager.|Interview with {name}, {n} May.
Liên hệ ông {name}, điện thoại {phone}.|Hỗ trợ: {phone} hoặc {email}|Thư góp ý gửi về {email}.|Gọi {phone} khi hệ thống có sự cố.|Đường dây nóng: {phone}
Địa chỉ nhận hồ sơ: {vaddr}.|Người dân tại số {vaddr} phản ánh về tiếng ồn.|Nhà riêng của anh {name} ở {vaddr} bị ngập vào ca đêm.|Theo chị {name}, nhà máy đã tối ưu hợp đồng.
{name} lives at No. {addr}.|The foreman lives at No. {addr} and can be called at {phone}.|We thank {name} and {name} for their reviews of the audit.|We thank {name} for the data.
The site team met; {titled} was absent.|We met {titled} and {titled}.|{titled} and {name} took part.|Gọi {phone} khi lò hơi có sự cố.|Gọi {phone} để được hỗ trợ.|{phone} is the number of the guard.|Or mail {email}.|Hỗ trợ: {email} hoặc {phone}
Call {phone} or write to {email}.|{email}; {id} (citizen ID).|{phone}; {id} (ID).|ID: {id}|Tel.: {phone}|Hotline {phone}|on {phone}.|Điện thoại {phone}|Gọi {phone} khi cần.|A resident of {addr} called.|Works next to {addr} go on.|next to {addr}.|Papers (passport {id}, issued in 20{n}) were lost.|Guard {name} (ID card {id}) signed.|National ID no. {id} was entered for {titled}.|Passport {id}, issued in 20{n}.|Parcels went to {addr}, care of {name}.|CCCD {id}, cấp năm 20{n}.|Bà {titled} ở {vaddr} phản ánh.|{titled} asked for a meeting.|Read by {name}.
Bà {name} (CCCD số {id}) đã ký biên bản.|Bà {name} (CCCD số {id}) đã ký.|Số căn cước {id} được ghi nhầm cho anh {name}.|Hộ chiếu {id} của chuyên gia {name} đã được lưu.|{name} đã kiểm tra lò hơi tại {site}.
Cảm ơn {name} và {name} đã góp ý.|Tài xế {name}, số điện thoại {phone}, ở {vaddr}.|Bà {name} cho biết kho lạnh đã sửa.|Email: {email}, gặp cô {name}.
"""
#: The same contexts without anything personal.
PLAIN = """
Meter no. {long} was recalibrated in August.|Work order {long} was closed.|Certificate {long} covers the {site} plant.|Batch {long} weighed 1,25{n} kg at {n}.52 USD.|Grid reference {long} was moved.
The invoice {long} was paid.|Lot no. {long} left the {site} quay.|ISO 14064-1 and ISO 50001 data list {n}3,805 records.|Phase {n} works on {site} went on.|Công tơ {long} đã được thay.|Đơn hàng {long} đã giao.
Batch X{long} of refrigerant was logged.|Batch X0{n}44217 of refrigerant was returned.|Unit price: {n} kg @ {n}.{n} USD.|Grid reference {n}.0{n} 105.8{n} marks the {site} depot.|Lot {n} {word} Road works were tested.|Phase {n} Street lighting saved 255,654 kWh.|Use from leased assets was {n},406 tCO2e in 20{n}.|The {n} Hour Road Safety campaign reached {site}.|The {n} {word} {word} campaign began.|The {n} Street lighting upgrade at {site} was closed.|The {n} {word} Road works ended.|Follow @{handle} for news.|Our account @{handle} posted {n} times.|{firm} and {firm} share the {site} refinery.|The {firm} plant at {site} was closed.|Through the {word} {word} programme, the fleet was renewed.
Energy use fell to {n}9,467 MWh in 20{n}.|Tăng lên 4676{n}3 MWh cùng kỳ.|Emissions were 1{n}0,988 t CO2e in 20{n}.|Prices of Copper rose by {n}%.|The {word} bay was dredged.|Between 20{n} and 2030 the {word} {word} initiative grew.
{site} and {site} were merged.|Ở {site}, lò hơi giảm {n}.2% trong quý hai.|Tại {site}, phòng kỹ thuật đã kiểm tra hệ thống.|In November 20{n}, the crew serviced the {site} line.|See section {n}.4 and Table {n}.|Article {n} of the Water Act holds.
"""
FAKE_DOMAINS = "example test invalid org net com vn".split()
ROLES = "grievance esg.desk hotline info support office press hr complaints feedback".split()
CITIES = "Orugrad Yarporth Keslune Thumira Drapesk Halvik Monfell".split()
ROADS = "Street St Road Rd Lane Ln Avenue Ave Close Drive Row".split()
VN_NAMES = "Sông Hạ Lụa|Cầu Sương|Đồi Gió Xanh|Lam Khê Thượng|Trăng Nhỏ|Bến Mây|Hồ Sen|Núi Đỏ|Vườn Cau".split("|")
SITES = "Harbour Ridge Quay Bay Delta South North East West Plains Valley Junction".split()

BEFORE, AFTER = 48, 64  # characters of a window around a trigger
#: Generous signs that a personal item may be near; they only pick what the second training learns from.
TRIGGER = re.compile(
    r"@|[\[({<]\s?(?:at|AT)\s?[\])}>]|\s(?:dot|DOT)\s|(?<![\d.,])[+(]*\d(?:[ .()/\-]{0,2}\d){6,}|[A-Z]\d{6,}"
    rf"|\d[A-Z]?,?\s(?:[A-ZĐÀ-Ỹ][\w'’\-]*\s){{1,3}}(?:{rules.STREETS})(?!\w)|\d[A-Z]?\s(?:{rules.VN_STREETS})\s"
    rf"|(?<!\w)(?:{rules.TITLES})\.?\s[A-ZĐÀ-Ỹ]"
)
SITE = re.compile(rf"\s(?:{rules.PLACES}|{rules.FIRMS})(?!\w)")


class Maker:
    """Invents items and sentences around them, all from one random source."""

    def __init__(self, seed: int, given: list[str], family: list[str], places: list[str]):
        self.rng, self.given, self.family, self.places = random.Random(seed), given, family, places

    def word(self) -> str:
        w = "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.choice((1, 2, 2)))) + self.rng.choice(TAILS)
        if self.rng.random() < 0.05:
            w += "-" + self.rng.choice(SYLLABLES).capitalize()
        return w[0].upper() + w[1:]

    def digits(self, n: int) -> str:
        return "".join(str(self.rng.randrange(10)) for _ in range(n))

    def name(self) -> str:
        r = self.rng
        given, family = (r.choice(listed) if listed and r.random() < 0.6 else self.word() for listed in (self.given, self.family))
        initial = r.choice("ABCDEGHKLMNOPRSTVY") + "."
        return r.choice([
            f"{given} {family}", f"{given} {family}", f"{given} {family}", f"{family} {given}", f"{family.upper()} {given}", f"{family}, {given}",
            f"{given.upper()} {family.upper()}", f"{given} {initial} {family}", f"{initial} {family}", f"{given} {self.word()} {family}",
        ])

    def titled(self) -> str:
        r = self.rng
        title = r.choice(["Mr", "Mrs", "Ms", "Ms.", "Dr", "Dr.", "Prof.", "Mr.", "Miss", "Bà", "ông", "anh", "chị"])
        return f"{title} " + "\1" + (r.choice(self.family) if self.family and r.random() < 0.5 else self.word() if r.random() < 0.6 else self.name()) + "\2"

    def ascii(self, w: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", w.lower().replace("đ", "d")) if c.isascii() and c.isalnum())

    def email(self) -> str:
        r = self.rng
        a, b = self.ascii(r.choice(self.given) if self.given and r.random() < 0.6 else self.word()), self.ascii(r.choice(self.family) if self.family and r.random() < 0.6 else self.word())
        box = r.choice([f"{a}.{b}", f"{a}_{b}{r.randrange(99)}", f"{a}-{b}", f"{b}.{a}", f"{a[0]}{b}", f"{a}+{r.choice(('esg', 'news', 'hr'))}", f"{b}{r.randrange(999)}", r.choice(ROLES), r.choice(ROLES)])
        domain = [self.ascii(self.word()) + r.choice(("", "", "-group")), r.choice(FAKE_DOMAINS)]
        if r.random() < 0.5:
            domain.insert(0, r.choice(("mail", "post", "dept", "staff")))
        at, dot = r.choice([("@", "."), ("@", "."), ("@", "."), (" at ", " dot "), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" @ ", "."), (" {at} ", ".")])
        out = box + at + dot.join(domain)
        return out.upper() if r.random() < 0.3 and "@" in out else out

    def phone(self) -> str:
        r, d = self.rng, self.digits
        s = r.choice((" ", " ", "-", ".", ""))
        area = r.choice("123456789") + d(1)
        return r.choice([
            f"+84{s}{area}{s}{d(3)}{s}{d(4)}", f"+84-(0){area}-{d(3)}-{d(4)}", f"0084 {area} {d(3)} {d(4)}", f"(0{area}) {d(3)} {d(4)}", f"0{area}{s}{d(3)}{s}{d(4)}", f"0{area} {d(3)} {d(2)} {d(2)}",
            f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{r.choice(('44', '33', '65'))}{s}{d(2)}{s}{d(4)}{s}{d(4)}", f"0{area}{d(7)}", f"+84{area}{d(7)}",
        ])

    def id(self) -> str:
        d = self.digits
        head = "000" if self.rng.random() < 0.85 else self.rng.choice("12345678") + d(2)
        return self.rng.choice([f"{head}{d(6)}", f"{head}{d(9)}", f"{head} {d(3)} {d(3)} {d(3)}", f"{head}-{d(2)}-{d(4)}", f"{self.rng.choice('XXBCNP')}{d(8)}", f"{self.rng.choice('XBCNP')}{d(7)}"])

    def house(self) -> str:
        r = self.rng
        return r.choice([f"{r.randrange(1, 400)}", f"{r.randrange(1, 99)}{r.choice('ABC')}", f"{r.randrange(1, 99)}/{r.randrange(1, 40)}"])

    def addr(self) -> str:
        r = self.rng
        street = f"{self.house()}{r.choice(('', '', '', ','))} {self.word()}{r.choice(('', '', ' ' + self.word()))} {r.choice(ROADS)}"
        street += r.choice(("", "", f", {self.word()} {r.choice(('Ward', 'District', 'Quarter'))}"))
        return street + r.choice(("", f", {r.choice(CITIES)}", f", {r.choice(CITIES)} {self.digits(5)}"))

    def vaddr(self) -> str:
        r = self.rng
        road = r.choice(VN_NAMES) if r.random() < 0.7 else f"{self.word()} {self.word()}"
        return f"{self.house()} {r.choice(('đường', 'phố', 'phố', 'ngõ', 'hẻm'))} {road}" + r.choice(("", f", {r.choice(('quận', 'phường'))} {self.word()}")) + r.choice(("", f", {r.choice(CITIES)}"))

    def site(self) -> str:
        return self.rng.choice(self.places) if self.places and self.rng.random() < 0.7 else f"{self.word()} {self.rng.choice(SITES)}"

    def filled(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        kinds = {"name": "name", "titled": "name", "email": "email", "phone": "phone", "id": "id_number", "addr": "address", "vaddr": "address"}
        out, spans = "", []
        for text, field in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
            out += text
            if not field:
                continue
            if field in kinds:
                piece = getattr(self, field)()
                before, mark, rest = piece.partition("\1")
                out += before if mark else ""
                piece = rest.rstrip("\2") if mark else piece
                spans.append((len(out), len(out) + len(piece), kinds[field]))
                out += piece
            else:
                r = self.rng
                out += {"n": lambda: str(r.randrange(10, 31)), "long": lambda: self.digits(r.choice((8, 9, 10, 11))), "site": self.site, "word": self.word, "handle": lambda: self.ascii(self.word()) + "_" + self.ascii(self.word()),
                        "firm": lambda: f"{self.word()} {r.choice(('Steel', 'Foods', 'Textiles', 'Energy', 'Packaging', 'Logistics'))}"}[field]()
        return out, spans


def sentences(texts: list[str], listed: set[str]) -> tuple[list[str], set[str]]:
    """Sentences of the corpus with nothing personal in them, and the words that recur in them: every capitalised word
    is the first, belongs to a site or firm, or recurs in lower case; nothing looks like an email or a long number."""
    parts = [s for t in texts for s in re.split(r"(?<=[.!?:;])\s+|\n+", t) if 20 < len(s) < 300]
    parts = [s for s in parts if not ("@" in s or re.search(r"\d[\d .()-]{6,}\d|\bdot\b|\[at\]|[A-Z]\d{6}", s))]
    lower = Counter(w for s in parts for w in set(re.findall(r"(?<![\w.+-])[a-zà-ỹđ][^\W\d_]+", s)))
    kept, seen = [], Counter()
    sites = re.compile(rf"\s(?:{rules.PLACES}|{rules.FIRMS})(?!\w)")
    places = {w.lower() for w in f"{rules.PLACES}|{rules.FIRMS}".split("|")}
    frequent = Counter(w for s in parts for w in set(personal.CAPITAL.findall(s)))
    common = {w for w, n in frequent.items() if n >= len(parts) * 0.002}
    for s in parts:
        ok = True
        for m in personal.CAPITAL.finditer(s):
            w = m.group()
            explained = lower[w.lower()] > 2 or w in common or w.lower() in places or sites.match(s, m.end())
            if not explained or w.lower() in listed and not sites.match(s, m.end()):
                ok = False
                break
        if ok:
            kept.append(s)
            seen.update({w.lower() for w in personal.CAPITAL.findall(s)})
    seen.update({w: n for w, n in lower.items() if n > 2})
    own = {w.lower() for w in personal.CAPITAL.findall(re.sub(r"\{\w+\}", "", TEMPLATES + PLAIN) + rules.MONTHS)}
    return kept, {w for w, n in seen.items() if n >= 3 and w not in listed} | own - listed


class Batches:
    """Endless shuffled batches of windows, cut so that items stand anywhere in them."""

    def __init__(self, samples, tagger: Tagger, given: set[str], family: set[str], total: int, size: int = 24, seed: int = 3):
        self.samples, self.tagger, self.given, self.family, self.total, self.size = samples, tagger, given, family, total, size
        self.rng = random.Random(seed)

    def __iter__(self):
        index = {t: k for k, t in enumerate(TAGS)}
        for _ in range(self.total):
            x, f, y = (np.zeros((T, self.size), np.int32) for _ in range(3))
            listed = [{w for w in sorted(names) if self.rng.random() < 0.65} for names in (self.given, self.family)]  # lexicons are incomplete
            for col in range(self.size):
                text, spans = self.rng.choice(self.samples)
                begin = self.rng.randrange(max(1, len(text) - T // 2))
                part = text[begin : begin + T]
                x[: len(part), col] = [self.tagger.chars.get(c, 1) for c in part]
                f[: len(part), col] = personal.flags_of(text, *listed)[begin : begin + T]
                for a, b, k in spans:
                    a, b = a - begin, b - begin
                    if b <= 0 or a >= T:
                        continue
                    y[max(a, 0) : b, col] = index[f"I-{k}"]
                    if a >= 0:
                        y[a, col] = index[f"B-{k}"]
            yield x, f, y


def samples(maker: Maker, carriers: list[str], n: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n texts of a few sentences each: generated ones with and without items, and sentences of the corpus around them."""
    rng = maker.rng
    full, plain = ([t for t in x.strip().replace("\n", "|").split("|") if t] for x in (TEMPLATES.replace(" | ", " \3 "), PLAIN))
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.choice((2, 3))):
            r = rng.random()
            s, found = maker.filled(rng.choice(full).replace("\3", "|")) if r < 0.5 else maker.filled(rng.choice(plain)) if r < 0.65 else (rng.choice(carriers), [])
            spans += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += s + rng.choice((" ", " ", " ", "\n", "\n\n"))
        out.append((text, spans))
    return out


def near_triggers(text: str, names: set[str], plain: set[str]) -> list[tuple[int, int]]:
    """Merged stretches of a text around triggers, words of the name lexicon and capitalised words that aren't plain."""
    at = [m.span() for m in TRIGGER.finditer(text)]
    doubtful = {w for w in set(personal.CAPITAL.findall(text)) if w.lower() in names or w.lower() not in plain}
    for m in personal.CAPITAL.finditer(text) if doubtful else ():
        if m.group() not in doubtful:
            continue
        w = m.group().lower()
        if w not in names and SITE.match(text, m.end()):
            continue
        if w in personal.PLACE_WORDS and personal.AFTER_SITE.search(text, max(0, m.start() - 40), m.start()):
            continue  # the second word of a site
        at.append(m.span())
    out: list[list[int]] = []
    for a, b in sorted(at):
        a, b = max(0, a - BEFORE), min(len(text), b + AFTER)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def taught(own: personal.Finder, texts: list[str]) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Windows of documents with the items that the tagger itself has found in them."""
    out = []
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        for text, found in zip(part, own.find(part)):
            for a, b in near_triggers(text, own.names, own.plain):
                a, b = max(0, a - 40), min(len(text), b + 40)
                inside = [(max(x, a) - a, min(y, b) - a, kind) for x, y, kind in found if x < b and a < y]
                out += [(text[a:b], inside)] * (3 if inside else 1)
    return out


def main(folder: str, steps: int = 900, more: int = 0) -> None:
    """`more`: other than 0, training goes on from the stored weights, on generated texts and on documents as the stored
    tagger reads them."""
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist()
    texts = sorted({t for t in texts if t and t.strip()}, key=lambda t: zlib.crc32(t.encode()))
    held, texts = texts[: len(texts) // 10], texts[len(texts) // 10 :]
    lexicon = [(r["name_token"], r["name_kind"]) for r in pq.read_table(f"{folder}/name_lexicon.parquet").to_pylist()]
    listed = {w.lower() for w, _ in lexicon}
    carriers, plain = sentences(texts, listed)
    carriers = carriers[:SENTENCES]
    places = sorted({m.group() for s in carriers for m in re.finditer(rf"[A-Z]\w+ (?:{'|'.join(SITES)})(?!\w)", s)})
    maker = Maker(7, [w for w, k in lexicon if k == "given"], [w for w, k in lexicon if k == "family"], places)
    made = samples(maker, carriers, GENERATED)
    tagger = Tagger.load(personal.MODEL) if more else Tagger(alphabet([t for t, _ in made]))
    own = personal.Finder(tagger, plain, lexicon)
    if more:
        made += taught(own, texts[:DOCUMENTS])
    print(len(carriers), "sentences of the corpus,", len(plain), "plain words", flush=True)
    with Pool(WORKERS) as pool:
        tagger.fit(Batches(made, tagger, own.given, own.family, steps * WORKERS), rate=1e-3 if more else 4e-3, log=lambda s: print(s, flush=True), pool=pool, at_once=WORKERS)
    tagger.save(personal.MODEL)
    personal.MODEL.with_name("personal_plain.txt").write_text("\n".join(sorted(plain)))
    compare(held, lexicon, plain)


def compare(held: list[str], lexicon: list[tuple[str, str]], plain: set[str]) -> None:
    """Recall on generated items the training hasn't seen, and agreement with the shapes on held-out documents."""
    own = personal.Finder(Tagger.load(personal.MODEL), plain, lexicon)
    right, all_, got_ = Counter(), Counter(), Counter()
    fresh = samples(Maker(99, [], [], []), ["The weather was mild."], 2000)
    for (_, spans), found in zip(fresh, own.find([t for t, _ in fresh])):
        truth, got = {(a, k) for a, _, k in spans}, {(a, k) for a, _, k in found}
        right.update(k for _, k in truth & got), all_.update(k for _, k in truth), got_.update(k for _, k in got)
    print("generated, invented names only:", {k: f"{right[k]} of {all_[k]}, {got_[k] - right[k]} extra" for k in rules.KINDS})
    both, shapes, mine = Counter(), Counter(), Counter()
    for t, found in zip(held, own.find(held)):
        a, b = {(x, k) for x, _, k in rules.shapes_of(t)}, {(x, k) for x, _, k in found if k != "name"}
        both.update(k for _, k in a & b), shapes.update(k for _, k in a), mine.update(k for _, k in b)
    print("held-out documents, items of a shape:", {k: f"{both[k]} of {shapes[k]}, {mine[k] - both[k]} extra" for k in rules.KINDS if k != "name"})


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:4]))

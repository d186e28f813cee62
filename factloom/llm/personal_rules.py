"""Shapes of personal items, which set the edges of what the tagger has found.

Everything here is a fixed value of the languages at hand (titles, street words, shapes of numbers)."""

from __future__ import annotations

import re
import unicodedata

KINDS = ("email", "phone", "id_number", "address", "name")
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Madam|Bà|bà|Ông|ông|Anh|anh|Chị|chị|Cô|cô|Chú|chú|bác|Bác|chuyên gia|tài xế|driver|Driver"
TITLES += "|" + unicodedata.normalize("NFD", TITLES)  # accents may stand apart
MONTHS = "January February March April May June July August September October November December"
STREETS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Drive|Row|Boulevard|Blvd|Crescent"
VN_STREETS = "đường|phố|ngõ|ngách|hẻm|Đường|Phố"
PLACES = "Harbour|Ridge|Quay|Bay|Delta|South|North|East|West|Plains|Valley|Junction|Ward|District|Quarter"
FIRMS = "Textiles|Foods|Steel|Energy|Paper|Packaging|Plastics|Cement|Seafood|Logistics|Group|Holdings|Ltd|Inc|JSC|plant|programme|program|Programme|project|campaign"

MAILBOX = r"[\w.+\-]+"
EMAIL = re.compile(rf"(?<![\w.+\-])({MAILBOX})(?:\s?@\s?|\s?[\[({{<]\s?(?:at|AT|@)\s?[\])}}>]\s?|\s(?:at|AT)\s(?=\w+(?:[\w\-]*\s(?:dot|DOT)\s)))[\w\-]+(?:(?:\.|\s?[\[({{<]\s?(?:dot|DOT|\.)\s?[\])}}>]\s?|\s(?:dot|DOT)\s)[\w\-]+)+")
ID = re.compile(r"(?<![\w\-./])(?:000(?:[ ]?\d{3}){3}|000\d{6}|000-\d\d-\d{4}|[A-Z]\d{7,8})(?![\w\-/]|[.,]\d)")
PHONE = re.compile(r"(?<![\w\-./,])(?:\+\d{1,3}[ .\-]?|00\d{2}[ .\-]?)?(?:\(0?\)?\d{0,3}\)?[ .\-]?)?\(?\d{2,3}\)?(?:[ .\-]?\d{2,4}){1,3}(?![\w\-/]|[.,]\d)")
ADDRESS = re.compile(rf"(?<![\w./\-])\d{{1,4}}[A-Z]?(?:/\d{{1,4}}[A-Z]?)*,?\s(?:(?:[A-ZĐÀ-Ỹ][\w'’\-]*\s){{1,3}}(?:{STREETS})(?!\w)|(?:{VN_STREETS})\s[A-ZĐÀ-Ỹ])")
NOT_BEFORE_NUMBER = re.compile(r"(?i)(?:work order|certificate|meter|batch|grid reference|grid|order|lot|phase|invoice|standard|iso|serial|ticket|permit|po|no\. of|tag|số lô|đơn hàng|công tơ|lô)[\s:#.]*(?:no\.?|number|số)?[\s:#]*$")
NOT_AFTER_ADDRESS = re.compile(r"\s(?:works|lighting|Safety|campaign|project|programme|upgrade)")
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[’'\-](?=[^\W\d_]))*")
TITLE = re.compile(rf"(?<!\w)(?:{TITLES})\.?\s$")


def digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def emails(text: str) -> list[tuple[int, int]]:
    return [(m.start(1), m.end()) for m in EMAIL.finditer(text) if re.search(r"[^\W\d_]{2,}$", m.group())]


def ids(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ID.finditer(text) if not NOT_BEFORE_NUMBER.search(text[max(0, m.start() - 40) : m.start()])]


def phones(text: str) -> list[tuple[int, int]]:
    out = []
    for m in PHONE.finditer(text):
        n = digits(m.group())
        if 9 <= n <= 13 and not m.group().startswith("000") and not NOT_BEFORE_NUMBER.search(text[max(0, m.start() - 40) : m.start()]):
            if "(" in m.group() or m.group()[0] in "+0" or re.match(r"\d{3}[ .\-]", m.group()):
                end = m.end()
                opened = m.group().count("(") - m.group().count(")")
                out.append((m.start() + (1 if opened > 0 and m.group()[0] == "(" else 0), end))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in ADDRESS.finditer(text):
        if NOT_BEFORE_NUMBER.search(text[max(0, m.start() - 40) : m.start()]) or NOT_AFTER_ADDRESS.match(text[m.end() :]):
            continue
        end = m.end()
        if m.group()[-1:].isupper() or re.search(VN_STREETS, m.group()):
            tail = re.match(r"[\w’'\-]*(?:\s[A-ZĐÀ-Ỹ][\w’'\-]*)*", text[end - 1 :])
            end = end - 1 + tail.end()
        more = re.match(rf"(?:,\s(?:phường|quận|xã|huyện)\s[A-ZĐÀ-Ỹ]\w*|,\s[A-ZĐÀ-Ỹ]\w*\s(?:Ward|District|Quarter))?(?:,\s[A-ZĐÀ-Ỹ]\w*(?:\s\d{{5}})?)?", text[end:])
        out.append((m.start(), end + more.end()))
    return out


def shapes_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items that have a usual shape, overlaps resolved in the order of kinds; names have none."""
    out: list[tuple[int, int, str]] = []
    for kind, spans in (("email", emails(text)), ("id_number", ids(text)), ("phone", phones(text)), ("address", addresses(text))):
        out += [(a, b, kind) for a, b in spans if not any(a < y and x < b for x, y, _ in out)]
    return sorted(out)

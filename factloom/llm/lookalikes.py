"""Problem 2: texts that look alike but differ in their characters, brought to one form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.runtime import once

# Letters of other scripts that are drawn like Latin letters, each followed by the Latin one.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX УY ԌG ԚQ ԜW аa еe оo рp сc хx іi јj ѕs уy һh ԁd ԛq ԝw ӏl ѵv"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ιi ρp αa υu κk"
ARMENIAN_AND_OTHER = "օo ցg հh սu ոn Տ​S ɑa ɡg ɩi ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ".replace("​", "")
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᎩY ᏃZ"
COPTIC = "ⲀA ⲂB ⲈE ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲬX ⲟo ⲣp ⲥc"
SYLLABICS = "ᗅA ᗷB ᑕC ᗞD ᗪD ᖴF ᕼH ᒍJ ᒪL ᗰM ᑭP ᖇR ᑌU ᐯV ᗯW ᙭X ᘔZ"
SIGNS = "\u2024. \u2236: \u2215/ \u2044/ \u037e; \ufe50, \u2217* \u2223|"
MUCH = 10
#: Characters without any ink that aren't spaces, besides Unicode's format characters (Cf).
INKLESS = "͏ᅟᅠ឴឵ㅤﾠ"


def rules() -> tuple[list[tuple[str, str]], set[str]]:
    """Pairs (odd string, ordinary string) that look alike, and the odd ones that count only beside Latin letters.

    Derived from Unicode's own data: format characters and variation selectors look like nothing; spaces like a
    space; wide, narrow, font and ligature forms like their compatibility form; a base with separate accents like the
    composed letter, in every order that is canonically the same."""
    pairs: list[tuple[str, str]] = []
    for cp in [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA), *range(0xE0001, 0xE01F0)]:
        c = chr(cp)
        kind = unicodedata.category(c)
        how = unicodedata.decomposition(c)
        if kind == "Cf" and not 0x600 <= cp <= 0x8FF or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp or c in INKLESS:
            pairs.append((c, ""))
        elif kind == "Zs":
            pairs.append((c, " "))
        elif how.startswith(("<wide>", "<narrow>", "<font>")) or how == "<compat> 0073" or how.startswith("<compat>") and (0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F or 0x1C4 <= cp <= 0x1CC or 0x132 <= cp <= 0x133):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c:
                pairs.append((c, plain))
        elif how and how[0] != "<" and kind[0] == "L":
            full = unicodedata.normalize("NFD", c)
            if len(full) == 1:
                if full.isascii() or full.isalpha() and "LATIN" in unicodedata.name(full, ""):
                    pairs.append((c, full))  # Kelvin sign
                continue
            composed = unicodedata.normalize("NFC", c)
            if composed != c:
                continue
            for order in permutations(full[1:]):
                for begin in (full[0], unicodedata.normalize("NFC", full[0] + order[0])):
                    rest = "".join(order) if begin == full[0] else "".join(order[1:])
                    odd = begin + rest
                    if rest and odd != c and unicodedata.normalize("NFC", odd) == c:
                        pairs.append((odd, c))
    scripts = [(x[0], x[1]) for x in f"{CYRILLIC} {GREEK} {ARMENIAN_AND_OTHER} {CHEROKEE} {COPTIC} {SYLLABICS}".split()]
    for cp in [*range(0x1D00, 0x1D23), *range(0x262, 0x2A0), *range(0xA730, 0xA7B0)]:  # small capitals, by their names
        m = re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(chr(cp), ""))
        if m:
            scripts.append((chr(cp), m.group(1).lower()))
    return list(dict.fromkeys([*pairs, *scripts, *[(x[0], x[1]) for x in SIGNS.split()]])), {odd for odd, _ in scripts}


def classes(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Transitive look-alike classes by union-find over strings: root -> members."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    out: dict[str, list[str]] = {}
    for x in parent:
        out.setdefault(root(x), []).append(x)
    return out


def suspects() -> str:
    """Java/Python character class of every character that an odd string holds and an ordinary text rarely does."""
    marks = {c for odd, _ in rules()[0] for c in odd if len(odd) > 1 and unicodedata.category(c) == "Mn"}
    single = {odd for odd, _ in rules()[0] if len(odd) == 1}
    points = sorted(ord(c) for c in marks | single) + [0x10FFFF + 2]
    spans, begin, last = ["\\x{300}-\\x{36F}"], points[0], points[0]
    for p in points[1:]:
        if p != last + 1:
            spans.append(f"\\x{{{begin:X}}}-\\x{{{last:X}}}")
            begin = p
        last = p
    return "[" + "".join(spans) + "]"


#: Ranges of ordinary characters that hold no suspect; a text of nothing else needs no closer look.
ORDINARY = r"\x{0}-\x{7F}\x{A1}-\x{AC}\x{AE}-\x{131}\x{134}-\x{17E}\x{180}-\x{1C3}\x{1E00}-\x{1EFF}\x{2010}-\x{2023}\x{2030}-\x{2043}\x{2070}-\x{209C}"


class Rewriter:
    """Greedy leftmost-longest rewriting of look-alike strings to their class's representative."""

    def __init__(self, counts: dict[str, int] | None = None):
        import ahocorasick

        pairs, self.contextual = rules()
        odd = {a for a, _ in pairs}
        seen = lambda s: min((counts.get(c, 0) for c in s), default=1 << 62) if counts else 0
        self.to: dict[str, str] = {}
        for members in classes(pairs).values():
            # The most frequent string of the class, an odd one only if it is MUCH more frequent than any ordinary one; of
            # equal ones the shortest, then the first code point.
            best = max(members, key=lambda s: (s == "", (seen(s) + 1) * (1 if s in odd else MUCH), -len(s), [-ord(c) for c in s]))
            for x in members:
                if x and (x != best or x in odd):  # an odd string is told even where it is the common form
                    self.to[x] = best
        self.odd = odd
        self.automaton = ahocorasick.Automaton()
        for x in self.to:
            if len(x) > 1 or x in odd or ord(x) > 127:
                self.automaton.add_word(x, x)
        self.automaton.make_automaton()
        script = "".join(re.escape(c) for c in self.contextual if ord(c) > 127)
        skip = "".join(re.escape(a) for a, b in pairs if b == "" and len(a) == 1)
        self.script = re.compile(f"[{script}]")
        self.part = re.compile(rf"[\w\u0300-\u036f{skip}]*")
        self.one = re.compile(rf"[\w\u0300-\u036f{skip}]")
        self.mark = re.compile(r"(?<=[^\W\d_])[̀-ͯ]")
        self.latin = re.compile("[A-Za-zÀ-ɏḀ-ỿＡ-Ｚａ-ｚﬀ-ﬆ]")

    def _foreign(self, text: str) -> list[tuple[int, int]]:
        """Words with letters of another script and no Latin ones; each word is looked at once, so time is linear."""
        out, end = [], 0
        for m in self.script.finditer(text):
            begin = m.start()
            if begin < end:
                continue
            low, end = begin, self.part.match(text, begin).end()
            while low > 0 and self.one.match(text, low - 1):
                low -= 1
            if not self.latin.search(text, low, end):
                out.append((low, end))
        return out

    def _once(self, text: str) -> tuple[str, bool]:
        keep = self._foreign(text)  # words wholly in another script
        out, at, odd, k = [], 0, False, 0
        for end, x in self.automaton.iter_long(text):
            begin = end - len(x) + 1
            while k < len(keep) and keep[k][1] <= begin:
                k += 1
            if x in self.contextual and k < len(keep) and keep[k][0] <= begin:
                continue
            out += [text[at:begin], self.to[x]]
            at = end + 1
            odd |= x in self.odd
        return "".join([*out, text[at:]]), odd

    def rewrite(self, text: str) -> tuple[str, bool]:
        """The text in one form, and whether it held a character that is invisible or only drawn like another."""
        text, odd = self._once(text)
        seen = set()
        while text not in seen:  # an accent after a rewritten base joins it in the next round
            seen.add(text)
            text, more = self._once(text)
            odd |= more
        return text, odd or bool(self.mark.search(text))


def character_counts(texts: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each character that belongs to a class occurs in all texts; as many entries as Unicode rules, no more."""
    wanted = sorted({ord(c) for pair in rules()[0] for s in pair for c in s})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            column = batch.column(0).drop_null().to_pylist()
            for i in range(0, len(column), 500):
                codes = np.frombuffer("".join(column[i : i + 500]).encode("utf-32-le", "surrogatepass"), np.uint32)
                found = np.bincount(codes)
                total[: len(found)] += found
        at = np.asarray(wanted)
        yield pa.RecordBatch.from_arrays([pa.array(at[total[at] > 0]), pa.array(total[at][total[at] > 0])], ["cp", "n"])

    got = texts.select(F.col(text)).mapInArrow(run, "cp long, n long").groupBy("cp").agg(F.sum("n").alias("n"))
    return {chr(r.cp): r.n for r in got.collect()}


def normalise(texts: DataFrame, keys: list[str], text: str = "text", counts: dict[str, int] | None = None) -> DataFrame:
    """(*keys, text, odd boolean) of every row, the text in one consistent form.

    odd: the text held an invisible or look-alike character or a base letter with a separate accent. Letters of other
    scripts count only in words that hold Latin letters, too. Null texts stay null, empty ones empty, odd false.
    Texts without any suspect character are not rewritten in Python; every text is read there once for the counts of
    characters, an array per batch, unless `counts` are given. Repeated rows stay repeated.
    """
    odd = F.col("text").rlike(f"[^{ORDINARY}]") & F.col("text").rlike(suspects())
    narrow = texts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text"))
    counts = character_counts(narrow) if counts is None else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = once(("rewriter", tuple(sorted(counts.items()))), lambda: Rewriter(counts))
        for batch in batches:
            done = [rewriter.rewrite(t) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([t for t, _ in done], pa.string()), pa.array([o for _, o in done], pa.bool_())], [*[f"k{i}" for i in range(len(keys))], "text", "odd"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields)
    changed = narrow.filter(odd).mapInArrow(run, f"{kinds}, odd boolean")
    rest = narrow.filter(~F.coalesce(odd, F.lit(False))).withColumn("odd", F.lit(False))
    return changed.unionByName(rest).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def found(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys of the texts that `normalise` finds odd."""
    narrow = texts.filter(F.col(text).isNotNull())
    return normalise(narrow, keys, text).filter("odd").select(*keys)


def corpus(layout: DataFrame, raw_documents: DataFrame) -> DataFrame:
    """(tbl, row_key, page_no, text) of all block and page texts."""
    blocks = layout.select(F.lit("layoutlmv3_layout").alias("tbl"), F.col("block_key").alias("row_key"), F.lit(0).alias("page_no"), "text")
    pages = raw_documents.select(F.lit("raw_documents").alias("tbl"), F.col("raw_id").alias("row_key"), F.explode("pages").alias("p")).select("tbl", "row_key", F.col("p.page").alias("page_no"), F.col("p.text").alias("text"))
    return blocks.unionByName(pages)



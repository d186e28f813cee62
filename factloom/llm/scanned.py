"""Problem 4: text of scanned pages repaired into continuous, readable paragraphs and clean table cells."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.lookalikes import Rewriter, suspects
from factloom.runtime import durable, once

#: A word belongs to the lexicon if it is at least every SHARE-th token, so a lexicon has at most SHARE words.
SHARE = 100_000
LEAST = 3  # occurrences, for small tables
CLEARLY = 10  # a correction must be so many times as frequent as the word with a sign or digit that it corrects
FAR = 400  # the same for a word of letters only, which may well be a word of its own; fewer take the evidence of its neighbours
ALIKE = 1 / 3  # share of a word's places with both neighbours as around its correction: misreadings have 0.4 and more, words 0.02

# What a scanner reads -> what may stand on the page.
CONFUSED = {
    "0": "oôơóòõọỏốồổỗộớờởỡợ", "1": "liíìỉĩịrt", "5": "s", "6": "bgó", "8": "bg", "9": "gqđ", "2": "z", "3": "e", "4": "aá", "7": "t",
    "+": "t", "|": "li", "!": "li", "$": "s", "€": "e", "@": "a", "c": "e", "e": "c", "l": "tiíìỉĩị", "i": "l", "t": "l", "f": "t", "v": "y", "u": "v", "n": "u", "a": "o", "o": "a", "h": "b", "q": "g",
}
CONFUSED_LONG = {"rn": "m", "m": "rn", "vv": "w", "cl": "d", "li": "h", "ii": "u", "nn": "m", "ri": "n", "in": "m", "lc": "k", "n": "ri", "rm": "nn", "d": "cl", "h": "li", "w": "vv"}
DIGITS = {"o": "0", "l": "1", "i": "1", "|": "1", "!": "1", "s": "5", "b": "8", "g": "9", "q": "9", "z": "2"}

HYPHENS = "-‐‑¬­"
EDGE = ".,;:()[]{}“”\"'‘’?!…"
NUMBER = re.compile(r"[(\[]?[-+±–−<>~≈]*\d[\d.,/:–-]*\d*[)\]]?[%°]?\)?|[\d\W_]+")
FINE = re.compile(r"(?:fy|cy|h|q|iso|pm|co|ch|sf|nf|n|hfc-?)\d[\d.]*(?:e|o|eq)?|\d+(?:st|nd|rd|th|kg|t|ml|kwh|mwh|gwh|gj|mj|tj|km|m²|m³|m3|ha|h|%)|(?:19|20)\d0s")
BAD_NUMBER = re.compile(r"[(\[-]?(?=[^\d]*\d)(?=\d*[.,\d]*[olisbgqz|!])[\dolisbgqz|!][\dolisbgqz|!.,]*[\dolisbgqz|!%)]*")
ODD = re.compile(r"[^\W\d_](?:[^\W_]|[+|!$€@])*")  # what may be words without their spaces or a part of one
PAGE = re.compile(
    r"^[^\S\n]*(?:[-–—|\[(]*[^\S\n]*(?:page|trang|pg\.?|p\.|seite)[^\S\n]*[|:.]?[^\S\n]*\d{1,4}(?:[^\S\n]*(?:of|/|trên)[^\S\n]*\d{1,4})?|[-–—][^\S\n]*\d{1,4}[^\S\n]*[-–—]|\[[^\S\n]*\d{1,4}[^\S\n]*\]|\d{1,3}[^\S\n]*/[^\S\n]*\d{1,3}|\d{1,3}|[ivxl]{2,7})[^\S\n]*[-–—|\])]*[^\S\n]*$",
    re.I | re.M,
)
BARE = re.compile(r"\s*\d{1,3}\s*|\s*\d{1,3}\s*/\s*\d{1,3}\s*")
CUT = re.compile(rf"[^\W\d_][{HYPHENS}]$")
UNKNOWN, UNKNOWN_LETTER = 10.0, 3.0  # cost of a token that is no word, and of each of its letters


@dataclass
class Piece:
    word: str
    edits: int
    joins: int  # hyphens and breaks taken out


@dataclass
class Decoder:
    """Joint word segmentation of a character stream without line breaks, over a lexicon with word costs: `decode` of a
    single token or the halves of a word at a line end, `stretch` of neighbouring tokens.

    The best path over the stream may read a character for a confused one, drop a hyphen with the line break after it,
    split a run of letters into words or merge letters across a space; each has its cost. A path that ends in no word
    of the lexicon leaves the stream as it is.
    """

    words: dict[str, int]
    edit_cost: float = 4.0
    split_cost: float = 6.0
    merge_cost: float = 7.0
    most_edits: int = 4
    trie: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        total = sum(self.words.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in self.words.items()}
        #: No reading as one word is longer: a confusion reads two characters for one, each edit may drop a sign more.
        self.longest = 2 * max(map(len, self.words), default=0) + self.most_edits + 1
        for w in self.words:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def arcs(self, s: str, begin: int, most: int) -> list[tuple[int, str, int, int]]:
        """(end, word, edits, joins) of the lexicon words that may be read from s[begin:] with at most `most` edits."""
        out, stack, seen = [], [(begin, self.trie, 0, 0)], set()
        while stack:
            at, node, edits, joins = stack.pop()
            if (at, id(node), edits, joins) in seen:
                continue
            seen.add((at, id(node), edits, joins))
            if "" in node:
                out.append((at, node[""], edits, joins))
            if at == len(s):
                continue
            c = s[at]
            if c in node:
                stack.append((at + 1, node[c], edits, joins))
            if c == "\n" or c == " ":  # the stream marks a hyphen with its line break by \n
                stack.append((at + 1, node, edits, joins + 1))
            if edits < most:
                for x in CONFUSED.get(c, ""):
                    if x in node:
                        stack.append((at + 1, node[x], edits + 1, joins))
                for long, x in CONFUSED_LONG.items():
                    if s.startswith(long, at):
                        to = node
                        for y in x:
                            to = to.get(y)
                            if to is None:
                                break
                        if to is not None:
                            stack.append((at + len(long), to, edits + 1, joins))
                if c.isdigit() and at > begin and s[at - 1].isalpha():  # a speck read as a digit
                    stack.append((at + 1, node, edits + 1, joins))
        return out

    def decode(self, s: str) -> list[Piece] | None:
        """The cheapest words for the whole stream, or None if no sequence of lexicon words gives it."""
        for most in (0, 1, 2, self.most_edits):  # few edits first: the search grows with them
            best: list[tuple[float, int, Piece | None]] = [(0.0, 0, None)] + [(math.inf, 0, None)] * len(s)
            for begin in range(len(s)):
                here = best[begin][0]
                if here == math.inf:
                    continue
                for end, w, edits, joins in self.arcs(s, begin, most):
                    if end == begin:
                        continue
                    merges = s.count(" ", begin, end)
                    whole = end - begin >= 3 or begin == 0 and end == len(s)
                    cost = here + self.cost[w] + edits * self.edit_cost + merges * self.merge_cost + (self.split_cost if end < len(s) else 0) + (0 if whole else 8)
                    if cost < best[end][0]:
                        best[end] = (cost, begin, Piece(w, edits, joins))
            if best[-1][0] < math.inf:
                out, at = [], len(s)
                while at:
                    out.append(best[at][2])
                    at = best[at][1]
                return out[::-1]
        return None

    def stretch(self, s: str, phrases: frozenset[str], extra: dict[int, list[tuple[int, str, float]]] | None = None) -> list[tuple[int, int, str | None, int]]:
        """(begin, end, word, edits) of the cheapest reading of the tokens of `s`, which a space or, where a line ends in a
        hyphen, a line break parts.

        `extra`: further arcs (end, word, cost) by where they begin: a token corrected in itself, the parts of a word that
        hyphens have cut, or such parts as they stand; nothing else reaches over a line break, and a token with such an
        arc has no other. A token may stay unknown (word None), tokens may merge to a word if one of them is unknown, and
        an unknown one may split into words that are `phrases` of the corpus two by two; up to one character of a word is
        confused there. Tokens of the lexicon aren't edited."""
        extra = extra or {}
        known = {}  # begin of each token -> (end, whether it is a word)
        at = 0
        for x in re.split("[ \n]", s):
            known[at] = (at + len(x), x in self.words or at in extra)
            at += len(x) + 1
        begins, owner = sorted(known), {}
        for b in begins:
            owner.update(dict.fromkeys(range(b, known[b][0] + 1), b))
        best: dict[tuple[int, str], tuple[float, tuple[int, str] | None, tuple[int, int, str | None, int] | None]] = {(0, ""): (0.0, None, None)}
        for begin in range(len(s)):  # word "": the next word stands at the begin of a token
            here = [(k, v[0]) for k, v in best.items() if k[0] == begin]
            if not here:
                continue
            arcs: list[tuple[int, str | None, int, float | None]] = [(e, w, 1, c) for e, w, c in extra.get(begin, [])]
            if not arcs:
                arcs = [(e, w, n, None) for e, w, n, _ in self.arcs(s, begin, 1) if s[e - 1] not in " \n" and "\n" not in s[begin:e]]
            if begin in known and not known[begin][1]:
                arcs.append((known[begin][0], None, 0, None))
            for end, w, edits, cost in arcs:
                if end <= begin:
                    continue
                own = [b for b in begins if owner[begin] <= b < end]
                whole = begin in known and end == known[own[-1]][0]
                new = any(not known[b][1] for b in own)
                if cost is not None:
                    pass
                elif w is None:
                    cost = UNKNOWN + UNKNOWN_LETTER * (end - begin)
                elif any(b in extra for b in own):
                    continue
                elif whole and len(own) == 1:
                    if edits:
                        continue
                    cost = self.cost[w]
                elif not new or len(w) < (6 if edits and len(own) > 1 else 4 if len(own) > 1 else 2) or len(own) > 1 and not whole:
                    continue
                else:
                    cost = self.cost[w] + edits * self.edit_cost + (len(own) - 1) * self.merge_cost + (self.split_cost if not whole else 0.0)
                for key, before in here:
                    if key[1] and f"{key[1]} {w}" not in phrases:
                        continue
                    to = (end + 1, "") if end in (len(s), known[own[-1]][0]) else (end, w or "")
                    if before + cost < best.get(to, (math.inf,))[0]:
                        best[to] = (before + cost, key, (begin, end, w, edits))
        out, key = [], (len(s) + 1, "")
        while best[key][1] is not None:
            out.append(best[key][2])
            key = best[key][1]
        return out[::-1]

    def price(self, word: str) -> float:
        """Cost of a word as it stands."""
        return self.cost.get(word, UNKNOWN + UNKNOWN_LETTER * len(word))


class Page:
    """What one worker knows about the corpus: lexicon, titles, and the verdicts on words it has met."""

    def __init__(self, words: dict[str, int], titles: tuple[tuple[str, ...], tuple[str, ...]], phrases: frozenset[str] = frozenset()):
        self.phrases, self.unknown, self.streams, self.joined = phrases, set(), {}, {}
        self.words, self.decoder, self.rewriter = words, Decoder(words), Rewriter()
        self.suspect = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", suspects()))
        self.fine: set[str] = set()
        self.bad: dict[str, str] = {}
        company, kind = ("|".join(sorted(map(re.escape, x), key=len, reverse=True)) or "(?!)" for x in titles)
        self.title_parts = re.compile(rf"(?P<c>{company})|(?P<k>{kind})|(?P<y>(?:19|20)\d\d)|\d{{1,4}}|[\s|·•—–:,./-]+", re.I)
        self.kinds = re.compile(kind, re.I)

    def title(self, line: str) -> bool:
        """A line of nothing but the report's company, kind, year and page number."""
        at, seen = 0, set()
        line = line.strip()
        while at < len(line):
            m = self.title_parts.match(line, at)
            if not m or m.end() == at:
                return False
            seen.add(m.lastgroup)
            at = m.end()
        return "k" in seen and ("c" in seen or "y" in seen)

    def verdict(self, token: str) -> str | None:
        """The corrected token if it holds a wrongly read character, else None. `token` is in lower case."""
        core = token.strip(EDGE)
        if not core or core in self.words or NUMBER.fullmatch(core) or FINE.fullmatch(core):
            return None
        if not core.isascii():
            core = "".join(self.rewriter.rewrite(core)[0].lower().split())
            if not core or core in self.words or NUMBER.fullmatch(core) or FINE.fullmatch(core):
                return None
        core = core.strip(EDGE.replace("!", "") if len(core) > 2 else EDGE)
        parts = [p for p in re.split(r"[-–—/|=@_.]+", core) if p]
        if parts and all(p in self.words or p.isdigit() for p in parts):
            return None
        if any(c.isdigit() for c in core) and BAD_NUMBER.fullmatch(core) and len(core) >= 2 and any(c in DIGITS for c in core):
            return "".join(DIGITS.get(c, c) for c in core)
        whole = [p for p in re.split(r"[-–—/]+", core) if p]
        fixed = []
        for p in whole:
            if p in self.words or p.isdigit():
                fixed.append(p)
                continue
            if len(p) < 3 or len(p) > self.decoder.longest:
                return None
            path = self.decoder.decode(p)
            if not path or len(path) != 1 or not path[0].edits:
                return None
            fixed.append(path[0].word)
        return "-".join(fixed) if fixed != whole else None

    def misread(self, tokens: set[str]) -> dict[str, str]:
        """token -> correction, for the tokens, in lower case, that hold wrongly read characters."""
        out = {}
        for w in tokens - self.fine:
            got = self.bad.get(w)
            if got is None:
                got = self.verdict(w)
                if got is None:
                    if len(self.fine) > 1_500_000:  # numbers are without end
                        self.fine.clear()
                        self.unknown.clear()
                    self.fine.add(w)
                    core = w.strip(EDGE)
                    same = core if core.isascii() else self.rewriter.rewrite(core)[0].lower()
                    if same not in self.words and ODD.fullmatch(core) and not FINE.fullmatch(core):
                        self.unknown.add(w)
                    continue
                if len(self.bad) > 300_000:
                    self.bad.clear()
                self.bad[w] = got
            out[w] = got
        return out

    def read(self, text: str) -> tuple[bool, str]:
        """Whether the words of a text carry traces of the scanned page, and the text with its words as they were.

        The text is one stream of tokens across its lines. The cheapest path over it takes each token as it stands, corrected,
        merged with its neighbours, split, or joined over the hyphen at a line end; the readings of a stretch compete.
        Words of the lexicon with nothing odd beside them have one reading, so only the stretches between them are decoded:
        unknown tokens with the words beside them up to the next sign, number or blank line, corrected tokens, and parts
        cut by hyphens."""
        parts = re.split(r"(\s+)", text)  # tokens at even places
        tokens = parts[::2]
        low = [x.lower() for x in tokens]
        fixed = self.misread(set(low))
        n = len(tokens)
        cut = [k + 1 < n and "\n" in parts[2 * k + 1] and bool(tokens[k + 1]) and bool(CUT.search(tokens[k])) for k in range(n)]
        odd = [x in self.unknown for x in low]
        if not (fixed or any(cut) or any(odd)):
            return False, text
        beside = [o or len(x) == len(y) and y.strip(EDGE) in self.words for o, x, y in zip(odd, tokens, low)]
        apart = [k == 0 or not (beside[k - 1] and beside[k]) or tokens[k - 1][-1] in EDGE or tokens[k][0] in EDGE or parts[2 * k - 1].count("\n") > 1 for k in range(n)] + [True]
        hit, k = False, 0
        while k < n:
            if not (odd[k] and len(tokens[k]) == len(low[k]) or cut[k] or low[k] in fixed):
                k += 1
                continue
            first = last = k
            if odd[k] and not apart[k] and not cut[k - 1]:
                first = k - 1
            while last + 1 < n and (cut[last] or not apart[last + 1] and (odd[last] or odd[last + 1])):
                last += 1
            k = last + 1
            found = self.island(tokens, parts, cut, fixed, first, last)
            if found is not None:
                hit |= found[0]
                parts[2 * first : 2 * last + 1] = [found[1]] + [""] * (2 * (last - first))
        return hit, "".join(parts)

    def island(self, tokens: list[str], parts: list[str], cut: list[bool], fixed: dict[str, str], first: int, last: int) -> tuple[bool, str] | None:
        """A trace or not, and the text of the tokens first..last on their cheapest path; None if they stay as they are."""
        own, edge = [], []
        for k in range(first, last + 1):
            x = tokens[k]
            left = len(x) - len(x.lstrip(EDGE))
            mark = 1 if cut[k] and k < last else 0
            core = x[left:].rstrip(EDGE) if not mark else x[left:-mark]
            own.append(core or x)
            edge.append((x[:left], x[left + len(core) :] if core else ""))
        joint = ["\n" if cut[k] else " " for k in range(first, last)]
        s = own[0] + "".join(j + x for j, x in zip(joint, own[1:]))
        if len(s.lower()) != len(s):
            return None
        starts = [0]
        for x in own[:-1]:
            starts.append(starts[-1] + len(x) + 1)
        extra: dict[int, list[tuple[int, str, float]]] = {}
        at = 0
        while at < len(own):
            end, word = at, tokens[first + at]
            while end < len(joint) and joint[end] == "\n":  # a word may be cut more than once
                got = self.carried(word[: -1], word[-1], tokens[first + end + 1], parts[2 * (first + end) + 1].count("\n") > 1)
                keep = sum(map(self.decoder.price, (word[:-1].lower(), own[end + 1].lower())))
                b, e = starts[at], starts[end + 1] + len(own[end + 1])
                arcs = extra.setdefault(b, [])
                arcs.append((e, "\1", keep + self.decoder.split_cost))  # the word's own hyphen: only the break goes
                if got is not None:
                    arcs.append((e, "\2", min(keep, self.decoder.price(got))))
                    word = word[:-1] + tokens[first + end + 1]
                    end += 1
                else:
                    word = word + tokens[first + end + 1]
                    end += 1
            if end == at and (w := fixed.get(tokens[first + at].lower())):
                extra[starts[at]] = [(starts[at] + len(own[at]), w, self.decoder.price(w))]
            for k in range(at + 1, end + 1):
                extra.setdefault(starts[k], [(starts[k] + len(own[k]), own[k].lower(), self.decoder.price(own[k].lower()))])
            at = end + 1
        key = (s.lower(), tuple(sorted((b, tuple(a)) for b, a in extra.items())))
        got = self.streams.get(key)
        if got is None:
            if len(self.streams) > 300_000:
                self.streams.clear()
            got = self.streams[key] = self.decoder.stretch(s.lower(), self.phrases, extra)
        hit, out, place = False, "", {b: k for k, b in enumerate(starts)}
        for i, (b, e, w, edits) in enumerate(got):
            if i and s[b - 1] in " \n" and b in place:
                out += parts[2 * (first + place[b]) - 1]
            elif i:
                out += " "
                hit = True
            if b in extra and b in place:
                k = place[b]
                to = next(j for j in range(k, len(own)) if starts[j] + len(own[j]) == e)
                whole = [tokens[first + j] for j in range(k, to + 1)]
                if w == "\2":
                    piece = "".join(x[:-1] for x in whole[:-1]) + whole[-1]
                    piece = recase(piece, self.misread({piece.lower()}).get(piece.lower()))
                    hit = True
                elif w == "\1":
                    piece = "".join(whole)
                else:
                    piece = recase(whole[0], w) if whole[0].lower() in fixed else whole[0]
                    hit |= whole[0].lower() in fixed
                out += piece
                continue
            spaces = s.count(" ", b, e)
            piece = s[b:e].replace(" ", "")
            head = edge[place[b]][0] if b in place else ""
            final = next((k for k, x in enumerate(starts) if x + len(own[k]) == e), None)
            hit |= bool(spaces)
            out += head + (recase(piece, w) if edits else piece) + (edge[final][1] if final is not None else "")
        return hit, out

    def carried(self, left: str, mark: str, right: str, far: bool = False) -> str | None:
        """The word that a hyphen at a line end has cut, or None where the hyphen belongs to the word. `far`: a blank line
        lies between; then only a word of the lexicon is whole."""
        key = f"{left}\n{mark}{right}{far}"
        if key in self.joined:
            return self.joined[key] or None
        a, b = left.lower().lstrip(EDGE), right.lower().strip(EDGE)
        b = re.split(r"[-–—/]", b)[0]
        a = re.split(r"[-–—/]", a)[-1]
        joined = a + b
        if not joined.isascii():
            joined = self.rewriter.rewrite(joined)[0].lower()
        if not b or not b[0].isalpha():
            got = ""
        elif joined in self.words:
            got = joined
        elif f"{a}-{b}" in self.words or a in self.words and b in self.words or far:
            got = ""
        else:
            path = self.decoder.decode(f"{a}\n{b}") if len(joined) < self.decoder.longest else None
            # fragments of a rarer word: at least one of them is no word
            got = path[0].word if path and len(path) == 1 else joined
        if len(self.joined) > 300_000:
            self.joined.clear()
        self.joined[key] = got
        return got or None

    def noise(self, text: str) -> set[int]:
        """Numbers of the lines that hold a running title or page number."""
        lines = text.split("\n")
        if len(lines) < 2:
            return set()
        if not text.isascii() and self.suspect.search(text):
            lines = [self.rewriter.rewrite(x)[0] if self.suspect.search(x) else x for x in lines]
            text = "\n".join(lines)
        out = set()
        if PAGE.search(text):
            out = {k for k, x in enumerate(lines) if x.strip() and PAGE.match(x) and PAGE.fullmatch(x.rstrip("\n"))}
        if self.kinds.search(text):
            out |= {k for k, x in enumerate(lines) if self.kinds.search(x) and self.title(x)}
        content = [k for k, x in enumerate(lines) if x.strip() and k not in out]
        return out if content else set()

    def block(self, kind: str | None, text: str) -> tuple[bool, str]:
        """Whether a block carries traces of the scanned page, and its text in continuous paragraphs."""
        running = (kind or "").strip().lower() in ("header", "footer")
        noise = set() if running else self.noise(text)
        if noise:
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in noise)
        traces, text = self.read(text)
        return bool(noise or traces) and not running, paragraphs(text)

    def table(self, rows: list[list[str | None] | None]) -> tuple[bool, list[list[str | None]]]:
        """Whether a table carries traces of the scanned page, and its rows without them, each cell on one line."""
        found, out = False, []
        full = [r for r in rows if r and any((x or "").strip() for x in r)]
        for r in rows:
            r = list(r or [])
            some = [k for k, x in enumerate(r) if (x or "").strip()]
            odd = [k for k in some if self.title(r[k]) or PAGE.fullmatch(r[k].strip()) and not BARE.fullmatch(r[k])]
            if odd and len(full) > 1:
                found = True
                for k in odd:
                    r[k] = ""
                if len(odd) == len(some):
                    continue
            for k in some:
                if r[k] and not (k in odd):
                    hit, text = self.block(None, r[k]) if not PAGE.fullmatch(r[k].strip()) else (bool(self.misread(set(r[k].lower().split()))), r[k])
                    found |= hit
                    r[k] = " ".join(text.split()) if text else r[k]
            out.append(r)
        return found, out


def recase(token: str, fixed: str | None) -> str:
    """The corrected core of a token within its own edge signs, with the case of the original."""
    if fixed is None:
        return token
    core = token.strip(EDGE) or token
    upper = sum(c.isupper() for c in core) > max(1, len(core) // 2)
    new = fixed.upper() if upper else fixed[:1].upper() + fixed[1:] if core[:1].isupper() and not core[:1].isdigit() else fixed
    return token.replace(core, new, 1)


def paragraphs(text: str) -> str:
    """Lines joined into paragraphs, boundaries chosen by dynamic programming over all lines.

    A boundary is cheap at a blank line, or where a short line ends a sentence and the next begins with a capital or
    bullet; a paragraph that ends without a full stop, and one of a single short line, cost more."""
    lines = [x.strip() for x in text.split("\n")]
    if len(lines) == 1:
        return " ".join(text.split()) if "  " in text or "\t" in text else text.strip()
    wide = max(map(len, lines)) or 1
    n = len(lines)
    ends = [bool(re.search(r"[.!?…:][\"”')\]]*$", x)) for x in lines]
    starts = [bool(re.match(r"[\"“(]?[A-ZÀ-ÞĐ•>*–-]", x)) for x in lines]

    def gap(k: int) -> float:  # cost of a boundary before line k
        if not lines[k - 1] or not lines[k]:
            return -4.0
        short = len(lines[k - 1]) < 0.75 * wide
        return 3.0 - 2.5 * ends[k - 1] - 1.5 * starts[k] - 2.0 * (short and ends[k - 1]) + 3.0 * (not ends[k - 1]) + (1.0 if not short else 0.0) - 2.0 * bool(re.match(r"[•>*]|- ", lines[k]))

    # the least cost up to line k, by whether line k is alone in its paragraph so far, and where that paragraph begins
    alone, more = (1.0, 0), (math.inf, 0)
    before = [0] * n  # begin of the paragraph that ends before line k, should one begin there
    for k in range(1, n):
        cost, before[k] = min(alone, more)
        more = min((alone[0] - 1.0, alone[1]), more)
        alone = (cost + gap(k) + 1.0, k)
    out, at, begin = [], n, min(alone, more)[1]
    while at:
        out.append(" ".join(" ".join(x for x in lines[begin:at] if x).split()))
        at, begin = begin, before[begin]
    return "\n\n".join(x for x in out[::-1] if x)


def texts_of(layout: DataFrame, tables: DataFrame) -> DataFrame:
    """(text) of all blocks, and of all tables with a line for each cell."""
    cells = tables.select(F.array_join(F.flatten(F.transform(F.coalesce("table_data", F.array()), lambda r: F.coalesce(r, F.array()))), "\n").alias("text"))
    return layout.select("text").unionByName(cells)


def tokens_of(layout: DataFrame, tables: DataFrame) -> DataFrame:
    """(word, n) over all block texts and cells: lower-case words without edge signs, without numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out: Counter[str] = Counter()
            numbers = 0
            for w, n in raw.items():
                core = w.strip(EDGE)
                if core and not NUMBER.fullmatch(core):
                    out[core] += n
                else:
                    numbers += n
            out[""] = numbers
            raw.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array(list(out.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            raw.update("\n".join(batch.column(0).drop_null().to_pylist()).lower().split())
            if len(raw) > 400_000:
                yield flush()
        yield flush()

    return texts_of(layout, tables).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(layout: DataFrame, tables: DataFrame) -> dict[str, int]:
    """Words that are at least every SHARE-th token of all tokens, hence at most SHARE of them, with their counts."""
    counts = durable(tokens_of(layout, tables))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.filter((F.col("word") != "") & (F.col("n") * SHARE >= total) & (F.col("n") >= LEAST) & ~F.col("word").rlike(r"^[^\d]+[-‐‑¬­]$"))
    return {r.word: r.n for r in kept.select("word", "n").collect()}


def doubtful(words: dict[str, int]) -> tuple[set[str], list[tuple[str, str]]]:
    """Words that one confusion turns into a word so much more frequent that they are misreadings that recur, and pairs
    (word, correction) that their neighbours have to tell: the correction is CLEARLY more frequent, but not FAR more."""
    known, sure, open_ = Decoder(words), set(), []
    for w, n in words.items():
        signs = any(c.isdigit() or c in "+|!$€@" for c in w) and any(c.isalpha() for c in w)
        if FINE.fullmatch(w) or not signs and len(w) < 3:
            continue
        to = {x: words[x] for end, x, edits, _ in known.arcs(w, 0, 2 if signs else 1) if end == len(w) and edits and words[x] > CLEARLY * n}
        if signs and to or any(m > FAR * n for m in to.values()) and w.isascii():
            sure.add(w)
        else:
            open_ += [(w, x) for x in to]
    return sure, open_


def alike(layout: DataFrame, tables: DataFrame, words: dict[str, int], pairs: list[tuple[str, str]]) -> set[str]:
    """Words of `pairs` that stand where their correction stands: at least ALIKE of their places have the two
    neighbours of a place of the correction. Numbers count as one neighbour, words out of the lexicon as another."""
    if not pairs:
        return set()
    spark = layout.sparkSession
    need = {y for p in pairs for y in p}
    shared = spark.sparkContext.broadcast((frozenset(words), frozenset(need)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shared.value
        seen: Counter[tuple[str, str, str]] = Counter()

        def beside(tokens: list[str], k: int) -> str:
            if not 0 <= k < len(tokens):
                return ""
            core = tokens[k].strip(EDGE)
            return core if core in known else "#" if NUMBER.fullmatch(core) else "?"

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in keys], pa.string()) for k in range(3)], pa.array(list(seen.values()), pa.int64())], ["word", "before", "after", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).drop_null().to_pylist():
                tokens = text.lower().split()
                for k, x in enumerate(tokens):
                    if x in wanted or (x := x.strip(EDGE)) in wanted:
                        seen[x, beside(tokens, k - 1), beside(tokens, k + 1)] += 1
            if len(seen) > 400_000:
                yield flush()
        yield flush()

    places = durable(texts_of(layout, tables).mapInArrow(run, "word string, before string, after string, n long").groupBy("word", "before", "after").agg(F.sum("n").alias("n")))
    own = places.join(spark.createDataFrame(pairs, "word string, fixed string"), "word")
    there = places.select(F.col("word").alias("fixed"), "before", "after", F.lit(1).alias("there"))
    share = own.join(there, ["fixed", "before", "after"], "left").groupBy("word", "fixed").agg((F.sum(F.when(F.col("there") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    return {r.word for r in share.filter(F.col("share") >= ALIKE).select("word").distinct().collect()}


def clean_lexicon(layout: DataFrame, tables: DataFrame) -> dict[str, int]:
    """The lexicon without misreadings that recur; each correction is more frequent, so it never goes by the word it corrects."""
    words = lexicon(layout, tables)
    sure, pairs = doubtful(words)
    out = sure | alike(layout, tables, words, pairs)
    return {w: n for w, n in words.items() if w not in out}


def phrases_of(layout: DataFrame, tables: DataFrame, words: dict[str, int]) -> frozenset[str]:
    """Pairs of lexicon words that are at least every SHARE-th pair of neighbouring ones, hence at most SHARE pairs."""
    shared = layout.sparkSession.sparkContext.broadcast(frozenset(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        raw: Counter[tuple[str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            out: Counter[str] = Counter()
            for (a, b), n in raw.items():
                if (a := a.lstrip(EDGE)) in known and (b := b.rstrip(EDGE)) in known:
                    out[f"{a} {b}"] += n
            raw.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["pair", "n"])

        for batch in batches:
            for text in batch.column(0).drop_null().to_pylist():
                tokens = text.lower().split()
                raw.update(zip(tokens, tokens[1:]))
            if len(raw) > 400_000:
                yield flush()
        yield flush()

    counts = durable(texts_of(layout, tables).mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.pair for r in counts.filter((F.col("n") * SHARE >= total) & (F.col("n") >= LEAST)).select("pair").collect())


def _titles(report_files: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Company names and report kinds; the table of report files is fixed in size."""
    got = report_files.select(F.collect_set("company").alias("c"), F.collect_set("report_type").alias("k")).first()
    return tuple(sorted(got.c)), tuple(sorted(got.k))


def repair(layout: DataFrame, tables: DataFrame, report_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_key, text, noisy) of the blocks and (row_key, table_data, noisy) of the tables.

    Text comes out in continuous paragraphs: the words are read as one stream (Page.read), so that words cut by a hyphen at a
    line end are joined, wrongly read characters corrected, words that run together or are broken by a space set right;
    running titles and page numbers amid other content are removed, line breaks within paragraphs gone. noisy: at least one
    such trace was there. Blocks of type header or footer and blocks of one item only keep their title or
    page number. Null texts and tables: no row; empty and blank ones come out empty, not noisy. Ties and repeated rows
    are treated alike. Word counts come from all texts and cells of both tables.
    """
    words = clean_lexicon(layout, tables)
    titles = _titles(report_files)
    spark = layout.sparkSession
    shared = spark.sparkContext.broadcast((words, titles, phrases_of(layout, tables, words)))  # at most SHARE words and pairs
    stamp = str(shared._jbroadcast.id()) + spark.sparkContext.applicationId

    def page() -> Page:
        return once(("page", stamp), lambda: Page(*shared.value))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = page()
        for batch in batches:
            done = [p.block(k, t) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for _, t in done], pa.string()), pa.array([n for n, _ in done], pa.bool_())], ["row_key", "text", "noisy"])

    def grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = page()
        for batch in batches:
            done = [p.table(d) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for _, t in done], pa.list_(pa.list_(pa.string()))), pa.array([n for n, _ in done], pa.bool_())], ["row_key", "table_data", "noisy"])

    a = layout.select("block_key", "type", "text").filter("text is not null and block_key is not null").mapInArrow(blocks, "row_key long, text string, noisy boolean")
    b = tables.select("table_key", "table_data").filter("table_data is not null and table_key is not null").mapInArrow(grids, "row_key long, table_data array<array<string>>, noisy boolean")
    return a, b


def found(layout: DataFrame, tables: DataFrame, report_files: DataFrame) -> DataFrame:
    """(tbl, row_key) of the blocks and tables with at least one trace of the scanned page."""
    a, b = repair(layout, tables, report_files)
    return a.filter("noisy").select(F.lit("layoutlmv3_layout").alias("tbl"), "row_key").unionByName(b.filter("noisy").select(F.lit("all_tables").alias("tbl"), "row_key"))

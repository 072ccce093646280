"""Personal data, also disguised: texts are normalised by transducers that remember where each
character came from, identifiers are found in the normalised text, and spans are mapped back.

Base kinds (email, ip, card, phone) are found in the text as it is. The transducers then rewrite
homoglyphs and foreign digits to ASCII and drop invisible characters; of the result, they turn spelled
digits into digits and marked at/dot disguises into @ and dots; and of that, plain at and dot. An identifier in the rewritten text that touches a rewritten part and
is not within a base span of its kind is added, as a span of the source text.

Null texts count as empty. Whole texts are read, in time linear in their length. Repeated rows stay, an empty table gives no rows;
other columns are ignored by `digest` and kept by `scan` and `redacted`.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobspark.llm.common import in_batches

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. No part of a run is tried again, as none but the whole can match.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

#: Letters of other scripts that look like ASCII ones, in matching order.
LOOKALIKES = {
    "АВЕКМНОРСТХУІЈЅ": "ABEKMHOPCTXYIJS",
    "аеорсухіјѕһԁԛԝ": "aeopcyxijshdqw",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "οανιρυ": "oavipu",
    "․。．｡＠﹫": "....@@",
}
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
GLYPHS = {a: b for k, v in LOOKALIKES.items() for a, b in zip(k, v, strict=True)}
GLYPHS |= dict.fromkeys(SPACES, " ") | dict.fromkeys(DASHES, "-") | dict.fromkeys(INVISIBLE, "")
GLYPHS = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | GLYPHS
GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + r"]|(?![0-9])\d")

#: Digits as words, in the languages of the corpus.
DIGITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "oh": 0,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
JOINERS = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "plus": "+", "dash": "-"}
SPELLED = "|".join(sorted(DIGITS, key=len, reverse=True))
ITEM = rf"(?:(?:double |triple )?(?:{SPELLED})++|[0-9]+|{'|'.join(JOINERS)})"
#: Seven or more in a row, so that prose with a number word or two is left alone, or four after "plus" and a number. Words run together where an invisible character stood.
SPELLING = re.compile(rf"(?<![^\W_])(?:(?:plus[ ,-]{{1,2}})?(?:double |triple )?(?:{SPELLED})++(?![^\W_])(?:[ ,.-]{{1,2}}{ITEM}(?![^\W_])){{6,}}+|(?:{SPELLED}){{7,}}+(?![^\W_])|plus[ ,-]{{1,2}}[0-9]++(?![^\W_])(?:[ ,.-]{{1,2}}{ITEM}(?![^\W_])){{3,}}+)", re.I)
MIXED = re.compile(rf"(double |triple )?({SPELLED}|[0-9]+|{'|'.join(JOINERS)})", re.I)
#: john (at) mail (dot) org, john[at]mail.org, john &#64; mail, john at mail dot org
AT = re.compile(r" ?[\[({<] ?(?:at|@|arroba|ät) ?[\])}>] ?| ?&#(?:64|x40); ?|%40", re.I)
DOT = re.compile(r" ?[\[({<] ?(?:dot|\.|punkt|point|punto) ?[\])}>] ?| ?&#(?:46|x2e); ?", re.I)
SAID = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++( at | ?@ ?)[A-Za-z0-9-]++((?: dot [A-Za-z0-9-]++|\.[A-Za-z0-9-]++)+)", re.I)
SAID_LABEL = re.compile(r"( dot |\.)([A-Za-z0-9-]+)", re.I)
#: Without brackets, only with a usual last label, or after a name that is no word: "look at the dot there" is prose.
NO_WORD = re.compile(r"[._+0-9]")
LAST = frozenset("com org net edu gov mil int info biz name io ai app dev me tv co uk us ca au nz ie eu de at ch fr be nl es pt it se no dk fi pl cz ru ua cn jp kr in br mx ar cl za example test".split())

Span = tuple[int, int, int]
Edit = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def identifiers(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((0, s, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = NO_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _spelled(m: re.Match) -> list[Edit]:
    """Edits that turn a run of spelled digits into digits: each item, and what separates them."""
    edits, last = [], m.start()
    for x in MIXED.finditer(m[0]):
        word = x[2].lower()
        times = {"double ": 2, "triple ": 3}.get((x[1] or "").lower(), 1)
        new = JOINERS.get(word) or (str(DIGITS[word]) * times if word in DIGITS else word)
        s, e = m.start() + x.start(), m.start() + x.end()
        if s > last:
            edits.append((last, s, ""))
        edits.append((s, e, new))
        last = e
    return edits


class Rewritten:
    """A text with edits (start, end, new) of it, in order and not overlapping, made."""

    def __init__(self, text: str, changes: list[Edit]):
        self.text, self.changes, self.begins, self.ends = text, changes, [], []
        parts, last, at = [], 0, 0
        for s, e, new in changes:
            parts += [text[last:s], new]
            self.begins.append(at + s - last)
            at = self.begins[-1] + len(new)
            self.ends.append(at)
            last = e
        self.plain = "".join([*parts, text[last:]]) if changes else text

    def back(self, x: int, end: bool) -> int:
        """The source place of a boundary; within a rewritten part, that part's own boundary."""
        i = bisect_right(self.begins, x - end) - 1
        if i < 0:
            return x
        s, e, _ = self.changes[i]
        if x < self.ends[i] or end and x == self.ends[i] > self.begins[i]:
            return e if end else s
        return e + x - self.ends[i]

    def touched(self, s: int, e: int) -> bool:
        """Whether the plain text from s to e holds a rewritten part."""
        i = bisect_right(self.begins, e - 1) - 1
        return i >= 0 and self.ends[i] >= s and not (self.ends[i] == s and self.begins[i] < s)

    def then(self, found: list[Edit]) -> Rewritten:
        """With edits of the plain text made as well; of those that overlap the first holds."""
        fresh, last = [], 0
        for s, e, new in sorted(found):
            if s >= last:
                fresh.append((self.back(s, False), self.back(e, True), new))
                last = e
        if not fresh:
            return self
        out, i = [], 0
        for s, e, new in fresh:
            while i < len(self.changes) and self.changes[i][1] <= s:
                out.append(self.changes[i])
                i += 1
            while i < len(self.changes) and self.changes[i][0] < e:
                i += 1
            out.append((s, e, new))
        return Rewritten(self.text, out + self.changes[i:])


def _said(r: Rewritten) -> list[Edit]:
    """Edits that turn plain at and dot into @ and dots, where a dot at least is disguised."""
    found = []
    for m in SAID.finditer(r.plain):
        dots, most = [], 0
        for d in SAID_LABEL.finditer(m[2]):
            s = m.start(2) + d.start()
            dots.append((s, m.start(2) + d.end(1), d[1] != "."))
            usual = d[2].lower() in LAST or d[2].isalpha() and len(d[2]) > 1 and NO_WORD.search(m[0], 0, m.start(1) - m.start())
            if usual and any(said or r.touched(a, b) for a, b, said in dots):
                most = len(dots)
        if most:
            if m[1] != "@":
                found.append((*m.span(1), "@"))
            found += [(a, b, ".") for a, b, said in dots[:most] if said]
    return found


def normalised(text: str) -> Rewritten:
    """The text as the transducers leave it, each reading what those before it wrote."""
    r = Rewritten(text, [])
    if not text.isascii():
        r = r.then([(*m.span(), GLYPHS[m[0]] if m[0] in GLYPHS else str(int(m[0]))) for m in GLYPH.finditer(text)])
    plain, found = r.plain, []
    for m in SPELLING.finditer(plain):
        found += _spelled(m)
    marked = False
    if "(" in plain or "[" in plain or "{" in plain or "<" in plain or "&#" in plain or "%40" in plain:
        found += [(*m.span(), "@") for m in AT.finditer(plain)]
        dots = [(*m.span(), ".") for m in DOT.finditer(plain)]
        found, marked = found + dots, bool(dots)
    r = r.then(found)
    return r.then(_said(r)) if marked or " dot " in r.plain.lower() else r


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, as spans of the source."""
    r = normalised(text)
    if not r.changes:
        return []
    out = []
    for kind, s, e in identifiers(r.plain):
        if not r.touched(s, e):
            continue
        a, b = r.back(s, False), r.back(e, True)
        if not any(k == kind and x <= a and b <= y for k, x, y in base):
            out.append((kind, a, b))
    return out


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all, by kind, then start."""
    text = text or ""
    base = identifiers(text)
    more = disguised(text, base)
    return base, sorted(base + more) if more else base


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def digest(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column(1).to_pylist():
                base, every = spans(t)
                row = [sum(k == i for k, _, _ in base) for i in range(4)]
                for c, x in zip(cols, [*row, sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)], strict=True):
                    c.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    names = [id, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_disguised"]
    schema = f"{id} long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_disguised long"
    return in_batches(docs.select(F.col(id).cast("long").alias(id), text), run, schema)


def redact(text: str | None) -> str | None:
    """The text with each stretch of personal data replaced by its kind in angle brackets."""
    if not text:
        return text
    _, every = spans(text)
    if not every:
        return text
    parts, last = [], 0
    for s, e, kind in sorted((s, -e, k) for k, s, e in every):
        if s >= last:
            parts += [text[last:s], f"<{KINDS[kind].upper()}>"]
        last = max(last, -e)
    return "".join([*parts, text[last:]])


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """docs with personal data in `text` replaced; all other columns stay, but n_chars, if named, is the new length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            yield b.set_column(at, b.schema.field(at), pa.array([redact(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    out = in_batches(docs, run, schema)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars else out

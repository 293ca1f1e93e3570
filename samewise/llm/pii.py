"""Operator 5, personal data: offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. Then a transducer rewrites disguises - homoglyph and
full-width characters, spelled digits, "at" and "dot" in brackets or between spaces - while it keeps, for
each character it writes, the span of source characters that it stands for; identifiers of the rewritten
text are mapped back to source characters. Spans are in code points, end exclusive. A mapped span that
lies in a base span of its kind is left out; others are added, and base spans stay as they are.

Null and empty texts have no spans. Texts are used whole; every scan is linear in the text's length.
Repeated rows give repeated results; an empty table gives an empty result; other columns are not read,
or kept as they are by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Characters that look like ASCII ones (fixed values).
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "‧": ".", "＋": "+", "－": "-", "（": "(", "）": ")",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ",
    "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "", "\u00ad": "",
}
#: Names of the digits (fixed values).
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
#: Names of the digits in other languages, which are read as digits only in runs of four or more (fixed values).
MORE_DIGITS = {
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_GLYPHS = dict(HOMOGLYPHS) | {chr(0xFF10 + i): str(i) for i in range(10)} | {chr(0xFF21 + i): chr(65 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0x660 + i): str(i) for i in range(10)} | {chr(0x6F0 + i): str(i) for i in range(10)}
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + "]")
_NAMES = "|".join(DIGITS)
_SPELLED = re.compile(rf"(?<![A-Za-z@])(?:plus[ -](?=[0-9]{{1,4}}[ -]{{1,2}}(?:{_NAMES})(?![A-Za-z]))|(?:plus[ -])?(?:{_NAMES})(?:[ ,-]{{1,2}}(?:{_NAMES}))*(?![A-Za-z@]))", re.I)
_ANY = "|".join(sorted([*DIGITS, *MORE_DIGITS], key=len, reverse=True))
_FOREIGN = re.compile(rf"(?<![^\W\d_])(?<!@)(?:plus[ -])?(?:{_ANY})(?:[ ,-]{{1,2}}(?:{_ANY})){{3,}}(?![^\W\d_])(?!@)", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_BEFORE = re.compile(r"(?:[0-9.+][ ,().-]{0,2}| dot )\Z", re.I)
_AFTER = re.compile(r"[ ,().-]{0,2}[0-9.]| dot ", re.I)
_DIGIT_DOT = re.compile(r"(?<=[0-9]) dot (?=[0-9])", re.I)
_NAME = re.compile(rf"plus|{_NAMES}", re.I)
#: Names of the signs in brackets (fixed values).
SIGNS = {"at": "@", "arobase": "@", "arroba": "@", "@": "@", "dot": ".", "point": ".", "punkt": ".", "punto": ".", ".": "."}
_SIGN = "|".join(re.escape(x) for x in sorted(SIGNS, key=len, reverse=True))
_BRACKET = re.compile(rf"[ \t]{{0,3}}(?:\[ ?({_SIGN}) ?\]|\( ?({_SIGN}) ?\)|\{{ ?({_SIGN}) ?\}}|< ?({_SIGN}) ?>)[ \t]{{0,3}}", re.I)
_SPACED = re.compile(r"(?<=[A-Za-z0-9]) (at|AT|At) (?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6} (?:dot|DOT|Dot) [A-Za-z0-9])")
_SPACED_DOT = re.compile(r" (?:dot|DOT|Dot) (?=[A-Za-z0-9])")
_SPREAD = re.compile(r"(?<=[A-Za-z0-9]) ?@ ?(?=[A-Za-z0-9-]{1,63}(?: ?\. ?[A-Za-z0-9-]{1,63}){1,6})")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def base_spans(text: str) -> dict[str, list[Span]]:
    return {k: f(text) for k, f in FINDERS.items()}


class Rewriting:
    """Text and, for each of its characters, the source span [begin, end) it stands for."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, None, None

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, apart); each new character stands for its whole span."""
        if not edits:
            return
        n = len(self.text)
        begin, end = self.begin or range(n), self.end or range(1, n + 1)
        text, b, e, last = [], [], [], 0
        for i, j, new in edits:
            text += [self.text[last:i], new]
            b += [*begin[last:i], *[begin[i]] * len(new)]
            e += [*end[last:i], *[end[j - 1]] * len(new)]
            last = j
        self.text = "".join([*text, self.text[last:]])
        self.begin, self.end = [*b, *begin[last:]], [*e, *end[last:]]

    def back(self, span: Span) -> Span:
        return (self.begin[span[0]], self.end[span[1] - 1]) if self.begin else span


def _spelled(m: re.Match) -> str:
    return "".join("+" if w.lower() == "plus" else DIGITS[w.lower()] for w in _NAME.findall(m[0]))


def _foreign(run: str) -> str:
    words = [w.lower() for w in _WORD.findall(run)]
    return "".join("+" if w == "plus" else DIGITS.get(w) or MORE_DIGITS[w] for w in words)


def _around(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Only edits with a letter or digit on both sides."""
    return [(i, j, s) for i, j, s in edits if i and j < len(text) and text[i - 1].isalnum() and text[j].isalnum()]


def deobfuscate(text: str) -> Rewriting:
    """The transducers one after the other; unchanged (begin is None) where nothing is disguised."""
    out = Rewriting(text)
    if not text.isascii():
        out.apply([(*m.span(), _GLYPHS[m[0]]) for m in _GLYPH.finditer(out.text)])
    now = out.text
    if any(c in now for c in "[({<"):
        out.apply(_around(now, [(*m.span(), SIGNS[m[m.lastindex].lower()]) for m in _BRACKET.finditer(now)]))
    low = out.text.lower()
    if " dot " in low:
        at = [m.span() for m in _SPACED.finditer(out.text)]
        edits = [(a, b, "@") for a, b in at]
        known = [b for _, b in at] + [m.end() for m in re.finditer("@", out.text)]
        for b in known:  # dots of the domain that follows
            i = b
            while m := re.compile(r"[A-Za-z0-9.-]{1,255}").match(out.text, i):
                if not (d := _SPACED_DOT.match(out.text, m.end())):
                    break
                edits.append((*d.span(), "."))
                i = d.end()
        out.apply(sorted(set(edits)))
    if "@" in out.text and (" @" in out.text or "@ " in out.text):
        out.apply([(*m.span(), "@") for m in _SPREAD.finditer(out.text) if m[0] != "@"])
    out.apply([(*m.span(), _foreign(m[0])) for m in _FOREIGN.finditer(out.text)])
    now = out.text
    out.apply([(*m.span(), s) for m in _SPELLED.finditer(now) if len(s := _spelled(m)) > 1 or s == "+" or _BEFORE.search(now, max(0, m.start() - 5), m.start()) or _AFTER.match(now, m.end())])
    if " dot " in low:
        out.apply([(*m.span(), ".") for m in _DIGIT_DOT.finditer(out.text)])
    return out


def all_spans(text: str) -> tuple[dict[str, list[Span]], list[tuple[int, int, str]]]:
    """(base spans by kind, every span as (start, end, kind) by start, then kind)."""
    base = base_spans(text)
    found = [(s, e, KINDS.index(k)) for k in KINDS for s, e in base[k]]
    plain = deobfuscate(text)
    if plain.begin is not None:
        for k in KINDS:
            taken, i = base[k], 0
            for span in FINDERS[k](plain.text):
                s, e = plain.back(span)
                while i < len(taken) and taken[i][1] < e:
                    i += 1
                if i == len(taken) or taken[i][0] > s:
                    found.append((s, e, KINDS.index(k)))
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    return base, [(s, e, KINDS[k]) for s, e, k in found]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, counts of base spans, and the spans themselves (base and all), a row per row of docs."""
    span = "array<struct<start:int,end:int,kind:string>>"
    schema = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base {span}, spans {span}"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, bases, spans = [], [], []
                for t in part.column(1):
                    base, every = all_spans(t.as_py() or "")
                    counts.append([len(base[k]) for k in KINDS])
                    flat = sorted(((s, e, k) for k in KINDS for s, e in base[k]), key=lambda x: (x[0], KINDS.index(x[2])))
                    bases.append([{"start": s, "end": e, "kind": k} for s, e, k in flat])
                    spans.append([{"start": s, "end": e, "kind": k} for s, e, k in every])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(bases, kind), pa.array(spans, kind)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def span_text(column: str):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str) -> str:
    """Each maximal run of found characters becomes the kind of its first span in angle brackets."""
    out, last, until = [], 0, 0
    for s, e, k in all_spans(text)[1]:
        if s >= until:
            out += [text[last:s], f"<{k.upper()}>"]
        until = last = max(until, e)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the personal data of ``text`` replaced; null texts stay null."""
    names = docs.columns
    k = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols = list(part.columns)
                cols[k] = pa.array([None if (t := x.as_py()) is None else redact(t) for x in cols[k]], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))

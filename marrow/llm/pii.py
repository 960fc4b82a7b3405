"""Personal data by offset-preserving deobfuscation.

Plain identifiers are found by fixed patterns.  Disguised ones are found by
rewriting the text with a chain of transducers (look-alike and invisible
characters, spelled digits, at/dot disguises), running the same detectors on
the output, and mapping each hit back through the alignment that every
transducer keeps: each output character knows the source characters it stands
for.  A hit counts as disguised only if it holds a rewritten character and no
plain hit contains it.

Not found: a bare " at " before a host with plain dots ("john at example.com").
It has the form of ordinary prose ("look at home.page"), which must give no hit;
a bare at counts only if the host is disguised too.

Rewriting runs only on texts that hold something to rewrite; plain detection
scans every whole text in time linear in its length.  Everything is per row.

Defined results: a null or empty text has no spans; repeated rows are treated
alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from marrow.llm import core
from marrow.llm import spans as sp

KINDS = ("email", "ip", "card", "phone")

EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match inside a run of digits would also be one from the run's first digit
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def emails(text: str) -> list[sp.Span]:
    """Leftmost non-overlapping addresses; each ``@`` is looked at once, so long runs stay linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        found = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append(("email", start, done))
        else:
            # nothing left of this sign can begin a later match
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return out


def detect(text: str) -> list[sp.Span]:
    """The plain identifiers of a text, in order."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        if text.count(".") >= 3:
            out += [("ip", *m.span()) for m in IP.finditer(text)
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text)
                    if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sp.ordered(out, KINDS)


# --- transducers -----------------------------------------------------------------

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKE = dict(zip(
    "аеорсухіјѕһԁԛԝкмтнвАВЕКМНОРСТУХІЈЅαορνικυεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijshdqwkmthbABEKMHOPCTYXIJSaopvikueABEZHIKMNOPTYX", strict=True))
#: Characters that show nothing (fixed values).
INVISIBLE = frozenset("­​‌‍⁠﻿")


@lru_cache(1 << 16)
def plain(ch: str) -> str | None:
    """The ASCII character that ``ch`` is a disguise of, "" if it shows nothing, None if it is no disguise."""
    if ch in INVISIBLE:
        return ""
    if ch in LOOKALIKE:
        return LOOKALIKE[ch]
    if ord(ch) < 128:
        return None
    if (digit := unicodedata.digit(ch, None)) is not None and unicodedata.category(ch) == "Nd":
        return str(digit)
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 and "!" <= folded <= "~" else None


#: Names of the digits in the languages of the corpus (fixed values).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_NAME = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_GAP = r"[\x20\t,-]{1,3}"
#: Runs under three names count only beside a digit, a written plus or a dot.
SPELLED = re.compile(rf"(?<!\w){_NAME}(?:{_GAP}{_NAME})*(?!\w)", re.I)
NAME = re.compile(_NAME, re.I)
PLUS = re.compile(rf"(?<!\w)plus[\x20-]+(?=[0-9]|{_NAME}(?!\w))", re.I)

_BRACKET = r"[\[({{<]\x20?{0}\x20?[\])}}>]"
AT_MARK = re.compile(rf"\x20?(?:{_BRACKET.format('(?:at|@)')}|&#64;|&commat;)\x20?", re.I)
DOT_MARK = re.compile(rf"\x20?(?:{_BRACKET.format('(?:dot|punkt|point|punto|[.])')}|&#46;|&period;)\x20?", re.I)
#: Bare words count only in the whole form: name at host dot domain.
BARE = re.compile(
    r"(?<![\w.%+-])[\w.%+-]+(?P<at>\x20at\x20|@|\x20@\x20)[A-Za-z0-9-]+"
    r"(?P<rest>(?:(?:\x20dot\x20|\.)[A-Za-z0-9-]+)+)(?!\w)", re.I)
BARE_DOT = re.compile(r"\x20dot\x20", re.I)
DIGIT_DOT = re.compile(r"(?<=[0-9])\x20(?:dot|point)\x20(?=[0-9])", re.I)

WORD = re.compile(r"[^\W\d_]+")
DOT_WORD = re.compile(r"(?<!\w)dot(?!\w)")
OPENED = re.compile(r"[\[({<]\x20?(?:at|@|[.]|dot|punkt|point|punto)\x20?[\])}>]")
ENTITY = re.compile(r"&(?:#(?:64|46)|commat|period);")


def rewritable(text: str) -> bool:
    """Whether any transducer may rewrite something (a cheap test of the whole text)."""
    if not text.isascii() and any(plain(c) is not None for c in set(text) if c > "\x7f"):
        return True
    low = text.lower()
    if "dot" in low and DOT_WORD.search(low) or OPENED.search(low) or "&" in low and ENTITY.search(low):
        return True
    names = sum(w in DIGIT_WORDS for w in WORD.findall(low))
    return names >= 3 or names > 0 and bool("plus" in low or DIGIT.search(low))


class Aligned:
    """A text with, for each character, the source span it stands for and whether it was rewritten."""

    def __init__(self, text: str, begin=None, end=None, changed=None):
        self.text = text
        self.begin = begin if begin is not None else list(range(len(text)))
        self.end = end if end is not None else list(range(1, len(text) + 1))
        self.changed = changed if changed is not None else [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """Replace spans [start, end) by at most one character each; edits are ascending and disjoint."""
        if not edits:
            return self
        text, begin, end, changed, done = [], [], [], [], 0
        for s, e, new in edits:
            text.append(self.text[done:s])
            begin += self.begin[done:s]
            end += self.end[done:s]
            changed += self.changed[done:s]
            if new:
                text.append(new)
                begin.append(self.begin[s])
                end.append(self.end[e - 1])
                changed.append(True)
            done = e
        text.append(self.text[done:])
        return Aligned("".join(text), begin + self.begin[done:], end + self.end[done:], changed + self.changed[done:])


def fold_lookalikes(a: Aligned) -> Aligned:
    if a.text.isascii():
        return a
    return a.rewrite([(i, i + 1, p) for i, ch in enumerate(a.text) if ch > "\x7f" and (p := plain(ch)) is not None])


def fold_digits(a: Aligned) -> Aligned:
    """Spelled digits to digits; the gaps inside a run go, so the digits of a number stand together."""
    edits = [(m.start(), m.end(), "+") for m in PLUS.finditer(a.text)]
    for m in SPELLED.finditer(a.text):
        s, e = m.span()
        run = NAME.findall(m.group())
        near = (a.text[max(0, s - 8):s] + "|" + a.text[e:e + 8]).lower()
        if len(run) < 3 and not re.search(r"[0-9][\x20.-]?\||\|[\x20.-]?[0-9]|dot\x20\||\|\x20dot|plus\x20\|", near):
            continue
        last = None
        for w in NAME.finditer(a.text, s, e):
            if last is not None:
                edits.append((last, w.start(), ""))
            edits.append((w.start(), w.end(), DIGIT_WORDS[w.group().lower()]))
            last = w.end()
    return a.rewrite(sorted(edits))


def fold_marks(a: Aligned) -> Aligned:
    """At and dot disguises to ``@`` and ``.``"""
    a = a.rewrite([(*m.span(), ".") for m in DOT_MARK.finditer(a.text)])
    a = a.rewrite([(*m.span(), "@") for m in AT_MARK.finditer(a.text)])
    a = a.rewrite([(*m.span(), ".") for m in DIGIT_DOT.finditer(a.text)])
    edits = []
    for m in BARE.finditer(a.text):
        dots = list(BARE_DOT.finditer(a.text, *m.span("rest")))
        # a bare "at" before plain dots is ordinary prose
        if dots or any(a.changed[m.start("rest"):m.end("rest")]):
            edits.append((*m.span("at"), "@"))
            edits += [(*d.span(), ".") for d in dots]
    return a.rewrite(edits)


TRANSDUCERS = (fold_lookalikes, fold_marks, fold_digits, fold_marks)


def disguised(text: str, base: list[sp.Span]) -> list[sp.Span]:
    """Identifiers that show only after rewriting, as spans of the source text."""
    if not rewritable(text):
        return []
    a = Aligned(text)
    for step in TRANSDUCERS:
        a = step(a)
    out = []
    for kind, s, e in detect(a.text):
        if any(a.changed[s:e]):
            begin, end = a.begin[s], a.end[e - 1]
            if not any(b <= begin and end <= f for _, b, f in base):
                out.append((kind, begin, end))
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the plain spans (``base``), all spans (``spans``), and both
    written out with the plain ones' digest."""

    def each(batch: pa.RecordBatch):
        base, every, counts, digests, texts = [], [], {k: [] for k in KINDS}, [], []
        for t in batch.column(1):
            t = t.as_py() or ""
            found = detect(t)
            both = sp.ordered([*found, *disguised(t, found)], KINDS)
            base.append(sp.structs(found))
            every.append(sp.structs(both))
            digests.append(sp.digest(found))
            texts.append(sp.written(both))
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base, sp.SPANS),
             pa.array(every, sp.SPANS), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            names=["key", *(f"n_{k}" for k in KINDS), "base", "found", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(key, text).mapInArrow(core.over_batches(each), (
        f"key {kind}, {counts}, base {sp.SPANS_DDL}, found {sp.SPANS_DDL}, base_sha256 string, spans string"
    )).withColumnRenamed("key", key)


def mask(text: str, spans: list[sp.Span], sign: str = "*") -> str:
    """The text with every span's characters replaced, so offsets stay."""
    out = list(text)
    for _, s, e in spans:
        out[s:e] = sign * (e - s)
    return "".join(out)

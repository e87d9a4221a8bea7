"""Personal data with offsets in the source text, also where it is disguised.

Plain identifiers are found in the text as it is. A chain of transducers then rewrites what hides others:
look-alike letters and digits, at and dot in words or brackets, spelled digits. Each rewritten character
keeps the span of source characters it stands for, so that what is found in the rewritten text is given in
source offsets.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import pick

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and domain, from one @ to the next: a local part cannot hold an @."""
    free = 0
    while (at := text.find("@", free)) >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free


def _is_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def _is_card(found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    if not 16 <= len(digits) <= 19:
        return False
    doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _is_phone(found: str) -> bool:
    return 8 <= sum(c.isdigit() for c in found) <= 15


def plain_spans(text: str) -> list[Span]:
    """Spans by kind and start; leftmost, not overlapping within a kind, matches that fail their rule left out."""
    out = [("email", s, e) for s, e in _emails(text)]
    for kind, pattern, rule in (("ip", IP, _is_ip), ("card", CARD, _is_card), ("phone", PHONE, _is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if rule(m[0])]
    return out


# Letters that look like a Latin one, by alphabet. Compatibility forms and digits follow from Unicode.
LOOKALIKES = {
    "а": "a", "в": "B", "е": "e", "к": "k", "м": "M", "н": "H", "о": "o", "р": "p", "с": "c", "т": "T", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n", "ԛ": "q", "ѡ": "w", "ѵ": "v", "ӏ": "l", "ɡ": "g", "ɑ": "a",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".",
}
UNSEEN = frozenset("­​‌‍‎‏⁠﻿")

# The digits 0 to 9 in words of the four languages.
DIGIT_WORDS = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(words.split())
}
_NUMBER = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_DOT_IN = rf"{_OPEN}(?:dot|\.|punkt|point|punto){_CLOSE}"
_DOT = rf"(?:{_DOT_IN}|[ \t]+dot[ \t]+)"
_AT_IN = rf"{_OPEN}(?:at|@|arobase|arroba){_CLOSE}"
_LABEL = r"[A-Za-z0-9-]+"

ODD = re.compile(r"[^\x00-\xac\xae-\xb6\xb8-İĲ-ɏ]")
BRACKETED = re.compile(rf"{_AT_IN}|{_DOT_IN}", re.I)
# Last labels before which a bare "at" may stand for an @.
_LAST = "(?:com|org|net|edu|gov|info|biz|io|co|uk|eu|us|de|fr|es)"
# A bare "at" counts only before a domain whose last dot is disguised too; a bare "dot" between letters or digits.
SIGNS = re.compile(
    rf"(?P<at>{_AT_IN}|(?<=[A-Za-z0-9])[ \t]+at[ \t]+(?={_LABEL}(?:(?:{_DOT}|\.){_LABEL})*?{_DOT}{_LAST}(?![A-Za-z0-9-])))|(?P<dot>(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9]))", re.I
)
# A run of digits and digit words; a digit word alone is left as it is.
_DIGITS = rf"(?:{_NUMBER}(?!\w)|[0-9]+)"
RUN = re.compile(rf"(?<!\w)(?:plus[ \t]+|\+)?{_DIGITS}(?:[ \t.,()-]{{1,3}}{_DIGITS})+", re.I)
RUN_PART = re.compile(rf"(?P<plus>plus[ \t]+)|(?P<word>{_NUMBER})(?!\w)|[0-9]+", re.I)


class Rewritten:
    """A text with the source span [first, last) of each of its characters."""

    def __init__(self, text: str, first: list[int] | None = None, last: list[int] | None = None):
        self.text = text
        self.first = list(range(len(text))) if first is None else first
        self.last = list(range(1, len(text) + 1)) if last is None else last

    def through(self, edits: Iterator[tuple[int, int, str]]) -> Rewritten:
        """With the ranges of the edits replaced; a new character stands for all source characters of its range."""
        parts, first, last, done = [], [], [], 0
        for start, end, new in edits:
            parts += [self.text[done:start], new]
            first += self.first[done:start] + [self.first[start]] * len(new)
            last += self.last[done:start] + [self.last[end - 1]] * len(new)
            done = end
        if not parts:
            return self
        parts.append(self.text[done:])
        return Rewritten("".join(parts), first + self.first[done:], last + self.last[done:])


def _fold(char: str) -> str:
    if char in UNSEEN:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if plain.isascii() else char


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """Digit words as digits; what parts two of them goes, but for a dot."""
    for run in RUN.finditer(text):
        end, after_word = run.start(), False
        parts = list(RUN_PART.finditer(text, run.start(), run.end()))
        if all(p["word"] is None for p in parts):
            continue
        for part in parts:
            if part["word"] and after_word and "." not in text[end : part.start()]:
                yield end, part.start(), ""
            if part["plus"]:
                yield part.start(), part.end(), "+"
            elif part["word"]:
                yield part.start(), part.end(), DIGIT_WORDS[part["word"].lower()]
            end, after_word = part.end(), part["word"] is not None


def rewrite(text: str) -> Rewritten | None:
    """The text without disguises, None where it has none."""
    out = Rewritten(text)
    if ODD.search(text):
        out = out.through((m.start(), m.end(), new) for m in ODD.finditer(text) if (new := _fold(m[0])) != m[0])
    low = out.text.lower()
    if ("dot" in low or any(c in low for c in "[({<")) and SIGNS.search(out.text):
        out = out.through((m.start(), m.end(), "@" if m["at"] is not None else ".") for m in SIGNS.finditer(out.text))
    if not DIGIT_WORDS.keys().isdisjoint(re.split(r"[\s,.()+-]+", low)):
        out = out.through(_spelled(out.text))
    return None if out.text is text else out


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, spans found only without disguises), both by kind and start in source code points.

    An added span never overlaps a plain one.
    """
    plain = plain_spans(text)
    plainer = rewrite(text)
    if plainer is None:
        return plain, []
    added = []
    for kind, start, end in plain_spans(plainer.text):
        start, end = plainer.first[start], plainer.last[end - 1]
        if not any(start < e and s < end for _, s, e in plain):
            added.append((kind, start, end))
    return plain, added


_SPANS = "array<struct<kind string, start int, end int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, plain and added, two arrays of (kind, start, end) by kind and start.

    Whole texts are read; a NULL or empty text has no spans; repeated rows are rows like any other; further
    columns are ignored; an empty table gives no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for batch in batches:
            found = [find(t) if t else ([], []) for t in batch.column("text").to_pylist()]
            columns = [pa.array([as_rows(f[i]) for f in found], _SPAN_TYPE) for i in (0, 1)]
            yield pa.record_batch([batch.column("id"), *columns], names=["id", "plain", "added"])

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    return rows.mapInArrow(run, f"id long, plain {_SPANS}, added {_SPANS}")


def masked_text(text: str) -> str:
    """The text with every span, plain or added, replaced by its kind; spans that overlap are one."""
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for spans in find(text) for k, s, e in spans):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its identifiers replaced in the text; NULL stays NULL, all columns stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked_text(t) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)

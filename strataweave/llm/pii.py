"""Personal data: plain identifiers, and disguised ones found through offset-preserving transducers.

The base patterns run on the text itself. A text that shows signs of disguise also passes
through a transducer that rewrites homoglyphs, full-width and other digits, other blanks, invisible characters, spelled digits,
letters that stand for digits in a number, and at/dot disguises, and keeps for every character it puts out the source span
it stands for. The same patterns then run on the rewritten text, and their spans are mapped back;
those that do not overlap a base span of their kind are added.

Defined results: null text has no spans; offsets are code points, ends exclusive; spans are ordered by kind, then start.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import flatten, row_slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: No match can begin inside a run of digits at whose start there is none, so only starts of runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("АВЕКМНОРСТХУІЈЅаеорсухіјѕԁɡһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEKMHOPCTXYIJSaeopcyxijsdghqwABEZHIKMNOPTYXoav"))
HOMOGLYPHS |= {"＠": "@", "﹫": "@", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}
#: No-break, en to hair, narrow no-break, mathematical and ideographic blanks.
HOMOGLYPHS |= dict.fromkeys("\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " ")
#: Letters that stand for digits inside a number.
DIGIT_LOOKS = {"O": "0", "o": "0", "I": "1", "l": "1"}
INVISIBLE = frozenset("​‌‍⁠﻿­")
#: Digit names.
DIGIT_NAMES = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0", "nought": "0"}

_NAME = "(?:" + "|".join(sorted(DIGIT_NAMES, key=len, reverse=True)) + ")"
DIGITS_RUN = re.compile(rf"\b{_NAME}(?:(?:[ ,-]{{1,2}}){_NAME})+\b", re.I)
NAME = re.compile(_NAME, re.I)
BEFORE_DOT = re.compile(rf"\b{_NAME}(?=\.[0-9])", re.I)
AFTER_DOT = re.compile(rf"(?<=[0-9]\.){_NAME}\b", re.I)
LOOKS = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]+[OoIl]|[OoIl]+[0-9])[0-9OoIl]*+(?![A-Za-z])")
LOOK = re.compile(r"[OoIl]")
PLUS = re.compile(rf"\bplus\s(?=[0-9]|{_NAME}\b)", re.I)
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
AT = re.compile(rf"\s?{OPEN}\s?(?:at|@)\s?{CLOSE}\s?|\s(?:at|@)\s(?=[A-Za-z0-9-]+(?:\s(?:dot|\.)\s|\s?{OPEN}\s?(?:dot|\.)))", re.I)
DOT = re.compile(rf"\s?{OPEN}\s?(?:dot|\.)\s?{CLOSE}\s?|(?<=[A-Za-z0-9])\s(?:dot|\.)\s(?=[A-Za-z0-9])", re.I)
BRACKETED = re.compile(rf"{OPEN}\s?(?:at|dot|@|\.)\s?{CLOSE}", re.I)
#: What AT and DOT need where neither "dot" nor a closed bracket is there, and what BEFORE_DOT and AFTER_DOT need.
BLANK_DOT = re.compile(rf"\.(?:(?<=\s\.)\s|(?<={OPEN}\.)|(?<={OPEN}\s\.))")
DOTTED = re.compile(r"\.(?:(?<=[A-Za-z]\.)[0-9]|(?<=[0-9]\.)[A-Za-z])")
#: Letters that match i and s where case is ignored.
FOLDED = frozenset("\u0130\u0131\u017f")

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x30, 0x3A), 0x40, 0x2B]] = True
#: Lead bytes of the scripts and blocks that hold homoglyphs, other digits and invisible characters.
_ODD = np.zeros(256, bool)
_ODD[[0xC2, 0xC9, *range(0xCD, 0xD7), 0xD9, 0xDB, 0xE0, 0xE1, 0xE2, 0xE3, 0xEF, 0xF0]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ so that long runs cost no retries."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        floor = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", floor)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


class Tape:
    """A text with, for each character, the source span it stands for; rewriting passes compose."""

    def __init__(self, text: str):
        self.text, self.at, self.to = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by a string, in order; the new characters stand for the whole of what they replace."""
        if not edits:
            return
        text, at, to, last = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[last:a], new]
            at += self.at[last:a] + [self.at[a]] * len(new)
            to += self.to[last:a] + [self.to[b - 1]] * len(new)
            last = b
        self.text = "".join([*text, self.text[last:]])
        self.at, self.to = at + self.at[last:], to + self.to[last:]


@functools.cache
def _char(c: str) -> str | None:
    """What a single character is rewritten to; None: it stays."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if 0xFF01 <= ord(c) <= 0xFF5E:
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None)
    return None if digit is None else str(digit)


def normalised(text: str) -> Tape:
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(i, i + 1, new) for i, c in enumerate(text) if c > "\x7f" and (new := _char(c)) is not None])
    tape.rewrite([(*m.span(), "@") for m in AT.finditer(tape.text)])
    edits = []
    for run in DIGITS_RUN.finditer(tape.text):
        last = None
        for m in NAME.finditer(tape.text, *run.span()):
            start = m.start() if last is None else last
            edits.append((start, m.end(), DIGIT_NAMES[m.group().lower()]))
            last = m.end()
    tape.rewrite(edits)
    tape.rewrite([(*m.span(), DIGIT_LOOKS[m.group()]) for run in LOOKS.finditer(tape.text) for m in LOOK.finditer(tape.text, *run.span())])
    tape.rewrite([(*m.span(), "+") for m in PLUS.finditer(tape.text)])
    tape.rewrite([(*m.span(), ".") for m in DOT.finditer(tape.text)])
    for single in (BEFORE_DOT, AFTER_DOT, AFTER_DOT, AFTER_DOT):
        tape.rewrite([(*m.span(), DIGIT_NAMES[m.group().lower()]) for m in single.finditer(tape.text)])
    return tape


def disguised(text: str) -> bool:
    """Whether the transducer could change the text: true wherever one of its passes has a match.

    As long as no pass matches, each still sees the text itself, so what each needs can be asked of the text. Tests on
    substrings come first; they are never narrower than the patterns behind them.
    """
    if not text.isascii() and any(c in FOLDED or _char(c) is not None for c in set(text) if c > "\x7f"):
        return True
    if LOOKS.search(text):
        return True
    low = text.lower()
    if "dot" in low or BLANK_DOT.search(text) or any(c in text for c in "[({<") and BRACKETED.search(text):
        return True
    if "plus" in low and PLUS.search(text):
        return True
    if sum(low.count(w) for w in DIGIT_NAMES) >= 2 and DIGITS_RUN.search(text):
        return True
    return DOTTED.search(text) is not None and bool(BEFORE_DOT.search(text) or AFTER_DOT.search(text))


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) by kind as listed, then start."""
    base = plain_spans(text)
    out = [(*s, True) for s in base]
    if disguised(text):
        tape = normalised(text)
        if tape.text != text:
            taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
            for kind, a, b in plain_spans(tape.text):
                a, b = tape.at[a], tape.to[b - 1]
                if all(b <= x or y <= a for x, y in taken[kind]):
                    out.append((kind, a, b, False))
        out.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return out


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, redact: bool = False) -> DataFrame:
    """Adds pii (array of kind, start, end, base); with redact, text has each span replaced by its kind in brackets."""
    docs = docs.drop("pii")
    names, at = list(docs.columns), docs.columns.index("text")
    schema = ", ".join([f"`{n}` {'string' if n == 'text' else t}" for n, t in docs.dtypes] + [f"pii {SPANS}"])

    def hide(text: str, found: list[tuple[str, int, int, bool]]) -> str:
        out, last = [], 0
        for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
            if b <= last:
                continue
            out += [text[last : max(a, last)], f"[{kind}]"]
            last = b
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in row_slices(batch.column(at), 1 << 20):
                part = batch.slice(x, y - x)
                data, offs = flatten(part.column(at))
                per_text = lambda mask: np.add.reduceat(mask.view(np.uint8), offs[:-1], dtype=np.int64) > 0  # noqa: B023, E731
                look = per_text(_PLAIN[data] | _ODD[data])
                texts = part.column(at).to_pylist()
                found = [spans(t) if t and (look[i] or disguised(t)) else [] for i, t in enumerate(texts)]
                columns = list(part.columns)
                if redact:
                    columns[at] = pa.array([hide(t, f) if f else t for t, f in zip(texts, found)], pa.string())
                values = [[{"kind": k, "start": a, "end": b, "base": c} for k, a, b, c in f] for f in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values, _SPANS)], [*names, "pii"])

    return docs.mapInArrow(run, schema)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(docs).select(
        "doc_id", *[n(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        (F.size("pii") - F.size(base)).cast("long").alias("n_disguised"),
    )

"""Quality rules as a short-circuit cascade.

The base counts are made for every text. Texts that pass the base test go through the rules one after the other,
each rule seeing only what the ones before it let through. The order is chosen once from
a sample: a rule's cost (seconds a text) and rejected share are measured there, and rules run by
rejections per second, highest first. The order changes the work, never the verdict.

Defined results: null and empty texts have no words, fail the base test and are not kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import SEP, SpanHash, flatten, mix64, ranges, row_slices, word_spans

U64 = np.uint64
SLICE = 1 << 20


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


SYMBOLS = _table("#*$%&|<>")
BANGS = _table("!?")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = UPPER + _table("abcdefghijklmnopqrstuvwxyz")
LETTER[0x80:] = 1


class View:
    """A slice of texts with its base counts."""

    def __init__(self, col: pa.Array):
        self.data, self.offs = data, offs = flatten(col, "\n")
        n = self.n = len(offs) - 1
        self.starts, self.ends, self.first = word_spans(data, offs)
        self.n_words = np.diff(self.first)
        per_text = lambda mask: np.add.reduceat(mask, offs[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
        solid = ~SEP[data]
        self.word_chars = per_text((solid & ((data & 0xC0) != 0x80)).view(np.uint8))
        self.n_symbols = per_text(SYMBOLS[data])
        line_end = np.flatnonzero(data == 0x0A)
        line_start = np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else line_end
        worded = np.searchsorted(self.starts, line_end) > np.searchsorted(self.starts, line_start)
        line_start, line_end = line_start[worded], line_end[worded]
        owner = np.searchsorted(offs, line_start, "right") - 1
        salt = mix64(np.arange(n, dtype=U64))
        hashed = SpanHash(data, 41)
        key = hashed.spans(line_start, line_end) + salt[owner]
        self.n_lines = np.bincount(owner, minlength=n)
        _, one = np.unique(key, return_index=True)
        self.n_dup_lines = self.n_lines - np.bincount(owner[one], minlength=n)
        words = hashed.spans(self.starts, self.ends)
        at = ranges(self.first[:-1], np.maximum(self.n_words - 2, 0))
        owner = np.repeat(np.arange(n), np.maximum(self.n_words - 2, 0))
        key = SpanHash(words, 43).spans(at, at + 3) + salt[owner]
        order = np.argsort(key)
        k = key[order]
        twice = np.zeros(len(k), bool)
        twice[1:] = k[1:] == k[:-1]
        twice[:-1] |= twice[1:]
        hit = at[order[twice]]
        cover = np.zeros(len(self.starts) + 1, bool)
        for i in range(3):
            cover[hit + i] = True
        total = np.concatenate(([0], np.cumsum(cover[:-1])))
        self.n_repeat_words = np.diff(total[self.first])
        self.base_failed = (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)

    def count(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Bytes of the picked texts that are set in a table."""
        if not len(rows):
            return np.zeros(0, np.int64)
        sizes = np.diff(self.offs)[rows]
        part = table[self.data[ranges(self.offs[rows], sizes)]]
        return np.add.reduceat(part, np.cumsum(sizes) - sizes, dtype=np.int64)


@dataclass(frozen=True)
class Rule:
    """``rejects(view, rows)``: which of the picked rows the rule rejects."""

    name: str
    rejects: Callable[[View, np.ndarray], np.ndarray]


def _letterless(v: View, rows: np.ndarray) -> np.ndarray:
    """More than half of the words hold no letter."""
    has = np.concatenate(([0], np.cumsum(LETTER[v.data])))
    good = np.concatenate(([0], np.cumsum(has[v.ends] > has[v.starts])))
    return 2 * (good[v.first[rows + 1]] - good[v.first[rows]]) < v.n_words[rows]


#: Thresholds are per word, per line or per letter, so they hold for texts of any length.
RULES = (
    Rule("symbols", lambda v, r: 10 * v.n_symbols[r] > v.n_words[r]),
    Rule("word_length", lambda v, r: (2 * v.word_chars[r] < 5 * v.n_words[r]) | (v.word_chars[r] > 15 * v.n_words[r])),
    Rule("dup_lines", lambda v, r: 5 * v.n_dup_lines[r] > 2 * v.n_lines[r]),
    Rule("bangs", lambda v, r: 2 * v.count(BANGS, r) > v.n_words[r]),
    Rule("shouting", lambda v, r: 5 * v.count(UPPER, r) > 2 * v.count(LETTER, r)),
    Rule("letterless", _letterless),
)


def measured(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int) -> list[tuple[str, float, float]]:
    """Rule name, seconds a text and rejected share, on a sample of about sample_rows texts, drawn by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in row_slices(batch.column(0), SLICE):
                view = View(batch.column(0).slice(x, y - x))
                rows = np.flatnonzero(~view.base_failed)
                took, lost = [], []
                for rule in rules:
                    began = time.perf_counter()
                    lost.append(int(rule.rejects(view, rows).sum()))
                    took.append(time.perf_counter() - began)
                k = len(rules)
                yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(took), pa.array(lost, pa.int64()), pa.array([len(rows)] * k, pa.int64())], ["rule", "s", "lost", "n"])

    share = min(1.0, sample_rows / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000).select(F.col("text").cast("string").alias("text"))
    sums = some.mapInArrow(run, "rule string, s double, lost long, n long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("lost").alias("lost"), F.sum("n").alias("n")).collect()
    return [(r.rule, r.s / max(1, r.n), r.lost / max(1, r.n)) for r in sums]


def cascade_order(rules: tuple[Rule, ...], figures: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Rules by rejections per second; ties and rules without figures by name."""
    worth = {name: share / max(cost, 1e-12) for name, cost, share in figures}
    return tuple(sorted(rules, key=lambda r: (-worth.get(r.name, 0.0), r.name)))


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """All columns of docs but those named as the results, then the counts, base_failed, kept and the rule that rejected ('base': the base test)."""
    ordered = cascade_order(rules, measured(docs, rules, sample_rows))
    made = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    docs = docs.drop(*made)
    names = [*docs.columns, *made]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in row_slices(batch.column(at), SLICE):
                part = batch.slice(x, y - x)
                v = View(part.column(at))
                by = np.full(v.n, None, object)
                by[v.base_failed] = "base"
                rows = np.flatnonzero(~v.base_failed)
                for rule in ordered:
                    bad = rule.rejects(v, rows)
                    by[rows[bad]] = rule.name
                    rows = rows[~bad]
                kept = np.zeros(v.n, bool)
                kept[rows] = True
                counts = [pa.array(c.astype(np.int64)) for c in (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words)]
                yield pa.RecordBatch.from_arrays([*part.columns, *counts, pa.array(v.base_failed), pa.array(kept), pa.array(by, pa.string())], names)

    fields = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [SCHEMA])
    return docs.mapInArrow(run, fields)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).drop("text")

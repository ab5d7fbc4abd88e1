"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character language model (trigrams of letters and word borders) is counted over all texts. Words that mix letters with
look-alike digits and signs, letters repeated three times or more, and letters set apart by
blanks or dots become lattices of what each sign may stand for; a Viterbi search under
the language model picks the likeliest reading. It replaces the word unless a uniform
model explains it much better. The restored text is scored by a logistic model on the words it holds, each counted once.

Labels are learnt from at most about ``max_train_docs`` distinct texts, drawn by a hash of doc_id from
rows that may be learnt from; words that tell the classes apart are found by counts over that sample.

Defined results: a text that several rows label is toxic if one of them says so; null and empty texts get the score of a text without telling words; without any label to
learn, scores are 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import SpanHash, flatten, row_slices
from .language_id import FOLD, held_out
from .scratch import stored

SLICE = 1 << 20
SYMBOLS = 28  # word border, a to z, any other letter

#: What a sign may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li"}
LEET = frozenset(LOOK_ALIKES)
SIGN_COST, REPEAT_COST, BORDER_COST = -1.0, -0.5, -4.0
#: What it costs to leave a sign at a word's end as it is: an exclamation mark mostly is one, the others seldom.
TAIL_COST = {"!": -1.0, "$": -6.0, "|": -6.0}
END_SIGNS = "".join(TAIL_COST)
#: Nats a letter by which a reading may fall short of a uniform model.
SLACK = 1.5

_CODE = np.zeros(256, np.int64)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0x41:0x5B] = np.arange(1, 27)
_CODE[0x80:] = 27
_LETTER = _CODE > 0
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True

MIXED = re.compile(r"(?<!\S)[^\s0-9@$!|]*+[0-9@$!|]\S*+")
REPEATED = re.compile(r"(?<![A-Za-z])(?=[A-Za-z]*?([A-Za-z])\1\1)[A-Za-z]++")
SPACED = re.compile(r"(?<!\S)[A-Za-z0-9@$!|](?:[ .*_-][A-Za-z0-9@$!|](?![A-Za-z0-9@$|])){2,}+")
ORNAMENT = re.compile(r"(.)\1\1")
TAIL, HEAD = ".,;:?!%&*#|$\"'()[]", ".,;:?%&*#|\"'()["


def letter_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of all trigrams of letters and word borders over all texts: SYMBOLS**3 sums, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for x, y in row_slices(batch.column(0), SLICE):
                data, _ = flatten(batch.column(0).slice(x, y - x))
                c = np.concatenate(([0, 0], _CODE[data]))
                total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3, np.int64)
    for r in sums:
        out[r.code] = r.n
    return out


class Channel:
    """The character model and the search for the likeliest reading."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + SYMBOLS)
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        self.log = np.log((tri + 5 * p2) / (tri.sum(2, keepdims=True) + 5)).tolist()
        self._read: dict[tuple[str, bool], str | None] = {}

    @staticmethod
    def code(c: str) -> int:
        low = c.lower()
        return ord(low) - 96 if "a" <= low <= "z" else 27 if c.isalpha() else 0

    @staticmethod
    def lattice(token: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """For each step the readings and what they cost; signs at a word's end may also stand for themselves."""
        out: list[list[tuple[str, float]]] = []
        end = len(token.rstrip(END_SIGNS))
        at = 0
        while at < len(token):
            c, to = token[at], at + 1
            while not spaced and c.isalpha() and to < len(token) and token[to].lower() == c.lower():
                to += 1
            if spaced and at % 2:
                out.append([("", 0.0), (" ", BORDER_COST)])
            elif c in LEET:
                out.append([(x, SIGN_COST) for x in LOOK_ALIKES[c]])
                if at >= end and not spaced:
                    out[-1].append((c, TAIL_COST[c]))
            elif to - at >= 3:
                out.append([(c, REPEAT_COST), (c * 2, 2 * REPEAT_COST)])
            elif c.isalpha():
                out.append([(token[at:to], 0.0)])
            else:
                out.append([("", SIGN_COST)])
            at = to
        return out

    def decode(self, token: str, spaced: bool) -> str | None:
        key = (token, spaced)
        if key not in self._read:
            if len(self._read) > 50_000:
                self._read.clear()
            self._read[key] = self._decode(token, spaced)
        return self._read[key]

    def _decode(self, token: str, spaced: bool) -> str | None:
        """The likeliest reading, or None if a uniform model explains it much better."""
        log = self.log
        states: dict[tuple[int, int], tuple[float, int, tuple]] = {(0, 0): (0.0, 0, ())}
        for step in self.lattice(token, spaced):
            after: dict[tuple[int, int], tuple[float, int, tuple]] = {}
            for (a, b), (score, n, path) in states.items():
                for text, cost in step:
                    s, x, y = score + cost, a, b
                    for c in text:
                        z = self.code(c)
                        s, x, y = s + log[x][y][z], y, z
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = (s, n + len(text), (path, text) if text else path)
            states = after
        best = max(((s + log[a][b][0], n, path) for (a, b), (s, n, path) in states.items()), key=lambda t: t[0])
        signs = sum(max(cost for _, cost in step) for step in self.lattice(token, spaced))
        if best[0] - signs < (best[1] + 1) * (math.log(1 / SYMBOLS) - SLACK):
            return None
        parts, path = [], best[2]
        while path:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))

    def restore(self, text: str) -> str:
        def spaced(m):
            return self.decode(m.group(), True) or m.group()

        def mixed(m):
            word = m.group()
            core = word.rstrip(TAIL)
            tail = word[len(core) :]
            signs = tail[: len(tail) - len(tail.lstrip(END_SIGNS))]
            if (signs.strip("!") or any(c in LEET for c in core)) and not ORNAMENT.search(signs):  # exclamation marks alone disguise nothing
                core, tail = core + signs, tail[len(signs) :]
            core2 = core.lstrip(HEAD)
            head, core = core[: len(core) - len(core2)], core2
            if "@" in core and "." in core.split("@")[-1]:  # an address
                return word
            if not any(c.isalpha() for c in core) or not any(c in LEET for c in core):
                return word
            return head + (self.decode(core, False) or core) + tail

        text = SPACED.sub(spaced, text)
        text = MIXED.sub(mixed, text)
        return REPEATED.sub(lambda m: self.decode(m.group(), False) or m.group(), text)


def suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts that may hold a disguised word: a sign next to a letter, a letter three times, or letters on their own."""
    letter, nxt = _LETTER[data], np.roll(data, -1)
    low = FOLD[data]
    odd = _SIGN[data] & _LETTER[nxt] | letter & _SIGN[nxt]
    odd |= letter & (data < 0x80) & (low == np.roll(low, 1)) & (low == np.roll(low, -1))
    lone = (letter | _SIGN[data]) & ~_LETTER[nxt] & ~_LETTER[np.roll(data, 1)] & (data < 0x80)
    odd |= lone & np.roll(lone, -2) & np.roll(lone, 2)
    return np.add.reduceat(odd.view(np.uint8), offs[:-1], dtype=np.int64) > 0


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters, ASCII case ignored) and the text each is in."""
    inside = _LETTER[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    return SpanHash(FOLD[data], 51).spans(starts, ends), np.searchsorted(offs, starts, "right") - 1


def restored_column(col: pa.Array, channel: Channel) -> tuple[pa.Array, np.ndarray]:
    """The texts with disguised words read, and which of them changed."""
    data, offs = flatten(col)
    rows = np.flatnonzero(suspects(data, offs))
    changed = np.zeros(len(col), bool)
    if not len(rows):
        return col, changed
    texts = col.to_pylist()
    for i in rows:
        new = channel.restore(texts[i] or "")
        if new != (texts[i] or ""):
            texts[i], changed[i] = new, True
    return (pa.array(texts, pa.string()) if changed.any() else col), changed


class Scorer:
    """bias and weights of words by sorted hash."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias

    def hits(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text and word number of each known word of a text, once."""
        h, owner = word_hashes(*flatten(col))
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ok = self.hashes[at] == h
        both = np.unique(owner[ok] * len(self.hashes) + at[ok])
        return both // len(self.hashes), both % len(self.hashes)

    def scores(self, col: pa.Array) -> np.ndarray:
        owner, word = self.hits(col)
        z = self.bias + np.bincount(owner, self.weights[word], minlength=len(col))
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[np.ndarray], y: np.ndarray, n_words: int, l2: float = 0.05, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Logistic regression on word sets by accelerated gradient descent."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    w, b = np.zeros(n_words), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    pw, pb = w.copy(), b
    rate = 4.0 / (max(1.0, np.bincount(doc, minlength=1).max() if len(doc) else 1.0) * max(1.0, np.bincount(word, minlength=1).max() if len(word) else 1.0) + l2) ** 0.5
    rate = min(rate, 0.05)
    for k in range(steps):
        mix = k / (k + 3)
        vw, vb = w + mix * (w - pw), b + mix * (b - pb)
        z = vb + np.bincount(doc, vw[word], minlength=len(y))
        g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        pw, pb = w, b
        w = vw - rate * (np.bincount(word, g[doc], minlength=n_words) + l2 * vw)
        b = vb - rate * g.mean()
    return w, b


def train(docs: DataFrame, labels: DataFrame, channel, max_train_docs: int = 20_000, max_words: int = 4000, least: int = 5, z: float = 3.5) -> Scorer:
    """``channel``: a broadcast Channel."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    n = marks.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < min(1.0, max_train_docs / max(1, n)) * 1_000_000
    sample = F.broadcast(marks.where(drawn))  # about max_train_docs rows at most
    train_rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "doc_id")
    # One row a text, toxic if any of its labels is; stored, as three passes learn from it.
    train_rows = stored(train_rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic"), "labelled")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in row_slices(batch.column(0), SLICE):
                col, _ = restored_column(batch.column(0).slice(x, y - x), channel.value)
                h, owner = word_hashes(*flatten(col))
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                label = batch.column(1).slice(x, y - x).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(label[owner[new]].astype(np.int64))], ["word", "toxic"])

    totals = train_rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    if not totals.n or not totals.t or totals.t == totals.n:
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), math.inf if totals.n and totals.t else -math.inf)
    t, u = float(totals.t), float(totals.n - totals.t)
    counts = train_rows.mapInArrow(words, "word long, toxic long").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= least)
    odds = F.log((F.col("t") + 0.5) / (t - F.col("t") + 0.5)) - F.log((F.col("n") - F.col("t") + 0.5) / (u - F.col("n") + F.col("t") + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    best = counts.select("word", F.abs(odds / spread).alias("z")).where(F.col("z") >= z).orderBy(F.desc("z"), "word").limit(max_words).collect()
    hashes = np.sort(np.array([r.word for r in best], np.int64).view(np.uint64))
    blank = docs.sparkSession.sparkContext.broadcast(Scorer(hashes, np.zeros(len(hashes)), 0.0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in row_slices(batch.column(0), SLICE):
                col, _ = restored_column(batch.column(0).slice(x, y - x), channel.value)
                owner, word = blank.value.hits(col)
                at = np.searchsorted(owner, np.arange(len(col) + 1))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(x, y - x), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(word))], ["toxic", "words"])

    rows = sorted(train_rows.mapInArrow(features, "toxic int, words array<long>").collect())  # in one order, so sums round alike
    w, b = fit([np.array(r.words, np.int64) for r in rows], np.array([r.toxic for r in rows], float), len(hashes))
    return Scorer(hashes, w, b)


def score(docs: DataFrame, channel, scorer: Scorer) -> DataFrame:
    """Adds restored (the text with disguised words read; null where nothing changed), score and predicted."""
    docs = docs.drop("restored", "score", "predicted")
    names, at = list(docs.columns), docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + ["restored string, score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in row_slices(batch.column(at), SLICE):
                part = batch.slice(x, y - x)
                col, changed = restored_column(part.column(at), channel.value)
                s = shared.value.scores(col)
                new = pa.array([col[i].as_py() if c else None for i, c in enumerate(changed)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, new, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "restored", "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    channel = spark.sparkContext.broadcast(Channel(letter_trigrams(docs)))
    scorer = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), channel)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), channel, scorer).select("doc_id", "held_out", "score", "predicted")

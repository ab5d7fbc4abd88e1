"""Language identification by prediction by partial matching over bytes.

For each language a context tree of up to three bytes predicts the next byte; escape probabilities (method C, with
exclusion) hand over to shorter contexts, down to a uniform one. The statistics are
frozen after training, so the code length of every byte after every known context is worked out once:
a text's exact code length is a sum of table entries, for all languages at once. The language with the
shortest code wins.

Training takes whole texts of at most about ``docs_per_lang`` documents a language, chosen by
a hash of doc_id among rows that may be learnt from. The model keeps at most ``max_contexts`` contexts.

Defined results: 'und' with score 0 for null texts and texts without a letter, and where nothing could be learnt; equal code lengths:
the first language by name. ASCII case is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import flatten, row_slices

SLICE = 1 << 20
DEPTH = 3
PAD = "\n" * DEPTH
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def held_out() -> Column:
    """Rows that nothing is learnt from: crc32 of doc_id as text divides by five (null doc_id: the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _codes(data: np.ndarray) -> np.ndarray:
    """For each byte the number formed by it and the DEPTH bytes before; what stands before the buffer counts as padding."""
    b = np.concatenate((np.full(DEPTH, 0x0A, np.uint8), data)).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, code (four bytes), n over texts of docs (columns lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                col = batch.column(1).filter(pa.array([x == lang for x in langs]))
                for x, y in row_slices(col, SLICE):
                    data, _ = flatten(col.slice(x, y - x), PAD)
                    code, n = np.unique(_codes(FOLD[data]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])

    return docs.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Model:
    """langs; sym: byte to symbol; ctx: three symbols to context; bits: code length by context, symbol and language."""

    def __init__(self, rows: list[tuple[str, int, int]], max_contexts: int):
        self.langs = sorted({r[0] for r in rows})
        lang = np.array([self.langs.index(r[0]) for r in rows], np.int64)
        code = np.array([r[1] for r in rows], np.int64)
        n = np.array([r[2] for r in rows], np.float64)
        by = np.stack([code >> 24 & 255, code >> 16 & 255, code >> 8 & 255, code & 255])
        known = np.unique(by)
        self.sym = np.full(256, len(known), np.uint8 if len(known) < 256 else np.uint16)
        self.sym[known] = np.arange(len(known))
        size = self.size = len(known) + 1
        s = self.sym[by].astype(np.int64)
        langs = len(self.langs)
        uniform = np.full((langs, size), 1.0 / size)
        tables = [self._blend(np.zeros(len(n), np.int64), 1, s[3], lang, n, uniform[None])]
        parent_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        base = 1
        key_all = np.zeros(len(n), np.int64)
        self.ctx = np.zeros(size**DEPTH, np.uint16)
        for depth in range(1, DEPTH + 1):
            key_all = key_all + s[DEPTH - depth] * size ** (depth - 1)  # nearest symbol counts least
            keys, inv = np.unique(key_all, return_inverse=True)
            total = np.bincount(inv, n)
            room = max_contexts - base
            keep = np.sort(np.argsort(-total, kind="stable")[:room])
            pick = np.isin(inv, keep)
            local = np.searchsorted(keep, inv[pick])
            parents = self._find(depth - 1, keys[keep], parent_of, size)
            tables.append(self._blend(local, len(keep), s[3][pick], lang[pick], n[pick], np.concatenate(tables)[parents]))
            ids = base + np.arange(len(keep))
            parent_of[depth] = (keys[keep], ids)
            spread = np.arange(size ** (DEPTH - depth), dtype=np.int64) * size**depth
            for k, i in zip(keys[keep], ids):
                self.ctx[k + spread] = i
            base += len(keep)
        p = np.concatenate(tables)
        self.bits = np.ascontiguousarray(-np.log2(np.maximum(p, 1e-12)).transpose(0, 2, 1)).astype(np.float32).reshape(-1, langs)

    @staticmethod
    def _find(depth: int, keys: np.ndarray, held: dict, size: int) -> np.ndarray:
        """The longest kept context that each key (its nearest ``depth`` symbols) ends with."""
        out = np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        while depth and len(todo):
            known, ids = held[depth]
            key = keys[todo] % size**depth
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[at] == key if len(known) else np.zeros(len(todo), bool)
            out[todo[hit]] = ids[at[hit]]
            todo, depth = todo[~hit], depth - 1
        return out

    @staticmethod
    def _blend(ctx, n_ctx, sym, lang, n, parent) -> np.ndarray:
        """Probabilities (context, language, symbol): seen symbols by count, the others by escape to the parent without the seen ones."""
        langs, size = parent.shape[1:]
        count = np.zeros((n_ctx, langs, size))
        np.add.at(count, (ctx, lang, sym), n)
        seen = count > 0
        total, kinds = count.sum(2, keepdims=True), seen.sum(2, keepdims=True)
        left = 1.0 - (parent * seen).sum(2, keepdims=True)
        escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        return np.where(seen, count / np.maximum(total + kinds, 1), escape * parent / np.maximum(left, 1e-9))

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each text in each language; texts are padded with PAD."""
        if len(offs) < 2:
            return np.zeros((0, len(self.langs)))
        s = self.sym[FOLD[data]].astype(np.int64)
        pad = int(self.sym[0x0A])
        s = np.concatenate((np.full(DEPTH, pad), s))
        at = self.ctx[(s[:-3] * self.size + s[1:-2]) * self.size + s[2:-1]].astype(np.int64) * self.size + s[3:]
        edges = np.stack([offs[:-1], offs[1:] - DEPTH], 1).ravel()
        sums = np.add.reduceat(self.bits[at], edges, axis=0, dtype=np.float64)[::2]
        sums[offs[1:] - offs[:-1] == DEPTH] = 0
        return sums


def train(docs: DataFrame, docs_per_lang: int = 2000, max_contexts: int = 12000) -> Model | None:
    """None if no row has a language to learn."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("ppm")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    grams = gram_counts(rows.where(drawn).select("lang", "text")).collect()
    return Model([tuple(r) for r in grams], max_contexts) if grams else None


def identify(docs: DataFrame, model: Model | None, evidence: int = 64) -> DataFrame:
    """Adds lang_pred and score: the winner's share of 2**-bits, a text's mean bits counting for at most ``evidence`` bytes."""
    docs = docs.drop("lang_pred", "score")
    names, at = list(docs.columns), docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for x, y in row_slices(batch.column(at), SLICE):
                part = batch.slice(x, y - x)
                col = part.column(at)
                data, offs = flatten(col, PAD)
                letters = np.add.reduceat(ASCII_LETTER[data].view(np.uint8), offs[:-1], dtype=np.int64) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = any(c.isalpha() for c in col[i].as_py() or "")
                if m is None:
                    pred, score = ["und"] * len(col), np.zeros(len(col))
                else:
                    bits = m.code_lengths(data, offs)
                    size = np.maximum(offs[1:] - offs[:-1] - DEPTH, 1)
                    rel = (bits - bits.min(1, keepdims=True)) * (np.minimum(size, evidence) / size)[:, None]
                    share = np.exp2(-np.minimum(rel, 1000))
                    score = np.where(letters, 1 / share.sum(1), 0.0)
                    pred = [m.langs[k] if ok else "und" for k, ok in zip(bits.argmin(1), letters)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")

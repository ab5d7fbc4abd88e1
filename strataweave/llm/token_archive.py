"""Token ids in binary files: frequency-ranked, variable-length bytes with separate control bytes.

Encoding. A tokenizer of the tokenizers library whose pre-tokenizer throws white space away encodes a text word by word, so
each distinct word of some megabytes of text is encoded once (and kept in a bounded cache a worker) and the words' ids are
gathered with numpy. Words are cut before ASCII punctuation after an ASCII letter, where a token always ends, and lower-cased
if they are ASCII, as the normalizer would. A text that holds a special token's string is cut at white space only. Tokenizers
of any other shape encode whole texts.

Files. A first pass counts the ids (one row an id, so no more than the vocabulary). Ids are numbered by falling count (ties: by id; ids that
do not occur follow), so frequent ids fit a byte. Documents are dealt out by ranges of doc_id and sorted; tasks write shards of about
``shard_bytes``, one file each, by Spark's text writer:

    header   magic, part, seq, documents, ids, control bytes, data bytes, CRC-32 of what follows
    index    doc_id of each document (int64), whether it has one (uint8), its number of ids (uint32)
    control  a byte for four ids: two bits each, the id's bytes less one; each document is filled up to four with rank 0
    data     the ranks' bytes, little-endian, without leading zeros
    end      a line feed

and the id of each rank beside them (a Parquet table). Files ordered by (part, seq) hold the documents in ascending doc_id order.
Reading looks control bytes up in a table that names, for each of the sixteen bytes of four ids, where in the data it stands.

Defined results: null and empty texts have the end id alone; null doc_ids come first; documents of one doc_id are ordered by a hash of
their text, and equal rows are written as often as they occur. A long text is encoded in slices cut at white space and lies in one shard. An
empty table gives an archive without documents. Columns beside doc_id and text are not stored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _byte_chars
from .bytesops import SEP, flatten, ranges, row_slices
from .scratch import fresh_path, stored

SLICE = 4 << 20
CACHED = 200_000
#: The parts of a tokenizer under which a text's words are encoded independently.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
BLANK, LETTER, PUNCT = 1, 2, 4
KINDS = bytes(BLANK if SEP[b] else LETTER if chr(b).isalpha() and b < 128 else PUNCT if 0x20 < b < 0x7F and not chr(b).isdigit() else 0 for b in range(256))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class WordEncoder:
    """Ids of many texts at once, word by word where the tokenizer allows it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self.by_words = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["post_processor"] is None and not any(set(s) & set(b" \t\n\v\f\r") for s in self.specials)
        self.model, self.known, self.older = self.tok.model, {}, {}
        shown = {b: c for c, b in _byte_chars().items()}
        self.chars = {c: "".join(shown[b] for b in chr(c).encode()) for c in [*range(0x61, 0x7B), *range(0xDF, 0x100)] if c != 0xF7}
        self.plain = frozenset(map(chr, self.chars))

    def fresh(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # lower-case ASCII letters: one pre-token, shown as itself
            ids = [t.id for t in self.model.tokenize(word.decode())]
        elif self.plain.issuperset(text := word.decode()):  # lower-case letters of Latin-1: one pre-token
            ids = [t.id for t in self.model.tokenize(text.translate(self.chars))]
        else:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def words_ids(self, words: list[bytes]) -> list[bytes]:
        got = list(map(self.known.get, words))
        for i in [i for i, g in enumerate(got) if g is None]:
            word = words[i]
            got[i] = self.older.get(word) or self.fresh(word)
            if len(word) <= 64:
                if len(self.known) >= CACHED:
                    self.known, self.older = {}, self.known
                self.known[word] = got[i]
        return got

    def units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text its number of units; each unit's distinct word; and of the distinct words all ids end to end, and how many each has."""
        whole = data.tobytes()
        kinds = np.frombuffer(whole.translate(KINDS), np.uint8)
        inside = kinds != BLANK
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        if not any(s in whole for s in self.specials):
            first[1:] |= (kinds[1:] == PUNCT) & (kinds[:-1] == LETTER)
            data = np.frombuffer(whole.translate(LOWER), np.uint8)
        starts = np.flatnonzero(first)
        per_text = np.diff(np.searchsorted(starts, offs))
        ends = np.zeros(len(starts) + 1, np.int32)
        if len(starts):
            total = np.cumsum(inside, dtype=np.int32)
            ends[1:] = total[np.append(starts[1:] - 1, len(data) - 1)]
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
        coded = packed.dictionary_encode()
        got = self.words_ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        counts = np.fromiter(map(len, got), np.int64, len(got)) // 4
        return per_text, coded.indices.to_numpy(), np.frombuffer(b"".join(got), "<u4"), counts

    def slices(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Row ranges of a column with the number of ids of each text and the ids, end to end."""
        for x, y in row_slices(col, SLICE):
            if not self.by_words:
                ids = [e.ids for e in self.tok.encode_batch([t or "" for t in col[x:y].to_pylist()], add_special_tokens=False)]
                yield x, y, np.array([len(i) for i in ids], np.int64), np.concatenate([np.array(i, "<u4") for i in ids] or [np.zeros(0, "<u4")])
                continue
            data, offs = flatten(col.slice(x, y - x))
            counts, ids = np.zeros(y - x, np.int64), []
            for a, b in _cuts(data):
                per_text, at, flat, sizes = self.units(data[a:b], np.clip(offs, a, b) - a)
                n = sizes[at]
                ids.append(flat[ranges((np.cumsum(sizes) - sizes)[at], n)])
                ends = np.concatenate(([0], np.cumsum(n)))
                counts += np.diff(ends[np.concatenate(([0], np.cumsum(per_text)))])
            yield x, y, counts, np.concatenate(ids) if ids else np.zeros(0, "<u4")

    def occurrences(self, col: pa.Array) -> np.ndarray:
        """How often each id occurs in a column's texts."""
        total = np.zeros(self.size, np.int64)
        for x, y in row_slices(col, SLICE):
            if not self.by_words:
                for e in self.tok.encode_batch([t or "" for t in col[x:y].to_pylist()], add_special_tokens=False):
                    total += np.bincount(e.ids, minlength=self.size)
                continue
            data, offs = flatten(col.slice(x, y - x))
            for a, b in _cuts(data):
                _, at, flat, sizes = self.units(data[a:b], np.clip(offs, a, b) - a)
                times = np.repeat(np.bincount(at, minlength=len(sizes)), sizes)
                total += np.bincount(flat, weights=times, minlength=self.size).astype(np.int64)
        return total


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE bytes that end after white space."""
    at = 0
    while at < len(data):
        to = min(len(data), at + SLICE)
        while to < len(data) and not SEP[data[to - 1]]:
            more = np.flatnonzero(SEP[data[to : to + SLICE]])
            to = to + int(more[0]) + 1 if len(more) else min(len(data), to + SLICE)
        yield at, to
        at = to


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# Four values a control byte: two bits each, the value's bytes less one.
_SIZES = np.stack([((np.arange(256) >> (2 * k)) & 3) + 1 for k in range(4)], axis=1)
_TOTAL = _SIZES.sum(axis=1).astype(np.uint8)
#: For each control byte and each of 16 bytes (4 values of 4): its place in the group's data, and whether it is there.
_FROM = ((np.cumsum(_SIZES, axis=1) - _SIZES)[:, :, None] + np.arange(4)).reshape(256, 16)
_THERE = (np.arange(4) < _SIZES[:, :, None]).reshape(256, 16)
_FROM = np.where(_THERE, _FROM, 0)
_THERE = _THERE.astype(np.uint8) * np.uint8(255)


def code(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes, and the data bytes of each group; the number of values is a multiple of four."""
    size = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = (size - 1).reshape(-1, 4)
    control = (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8)
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    data[at] = values & 0xFF
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        data[at[more] + k] = (values[more] >> np.uint32(8 * k)) & 0xFF
    return control, data, size.reshape(-1, 4).sum(axis=1)


def decode(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """All values of whole groups, by table lookup."""
    total = _TOTAL[control]
    starts = np.cumsum(total, dtype=np.int64) - total
    out = np.empty(len(control) * 4, "<u4")
    for x in range(0, len(control), 1 << 16):
        c = control[x : x + (1 << 16)]
        got = data[_FROM[c] + starts[x : x + len(c), None]] & _THERE[c]
        out[4 * x : 4 * (x + len(c))] = got.view("<u4").ravel()
    return out


HEADER = np.dtype([("magic", "S4"), ("part", "<u4"), ("seq", "<u4"), ("docs", "<u8"), ("ids", "<u8"), ("control", "<u8"), ("data", "<u8"), ("crc", "<u4")])
MAGIC = b"FVB1"


class Shard:
    """Documents of one file, gathered until it is written."""

    def __init__(self, part: int, seq: int):
        self.part, self.seq, self.held, self.docs, self.ids = part, seq, [[], [], [], [], []], 0, 0
        self.size = 0

    def add(self, doc_ids: np.ndarray, there: np.ndarray, counts: np.ndarray, control: np.ndarray, data: np.ndarray) -> None:
        for held, x in zip(self.held, (doc_ids.astype("<i8"), there.astype(np.uint8), counts.astype("<u4"), control, data)):
            held.append(x)
        self.docs, self.ids = self.docs + len(doc_ids), self.ids + int(counts.sum())
        self.size += len(control) + len(data) + 13 * len(doc_ids)

    def bytes(self) -> bytes:
        body = b"".join(x.tobytes() for held in self.held for x in held)
        head = np.array((MAGIC, self.part, self.seq, self.docs, self.ids, sum(map(len, self.held[3])), sum(map(len, self.held[4])), zlib.crc32(body)), HEADER)
        return head.tobytes() + body  # the writer's line feed ends the file


def id_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """id and n over all texts; each task sends one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        total = np.zeros(enc.size, np.int64)
        for batch in batches:
            total += enc.occurrences(batch.column(0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def ranked(counts: np.ndarray) -> np.ndarray:
    """The id of each rank: by falling count, then by id."""
    return np.lexsort((np.arange(len(counts)), -counts)).astype("<u4")


def write_archive(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_bytes: int = 16 << 20) -> None:
    """Writes doc_id and text of ``docs`` to ``path``/shards and the ranks to ``path``/ranks."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs = docs.count()
    counts = np.zeros(max(encoder(tokenizer).size, end_id + 1), np.int64)
    for r in id_counts(docs, tokenizer).collect():  # at most one row an id of the vocabulary
        counts[r["id"]] = r["n"]
    counts[end_id] += n_docs
    ids = ranked(counts)
    spark.createDataFrame(pa.table({"rank": pa.array(range(len(ids)), pa.int64()), "id": pa.array(ids.astype(np.int64))})).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.empty(len(ids), "<u4")
    rank_of[ids] = np.arange(len(ids))
    shards = -(-int(counts.sum()) * 3 // (2 * shard_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_row")]
    dealt = docs.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(max(1, shards, spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        shard = Shard(part, 0)
        out = lambda s: pa.RecordBatch.from_arrays([pa.array([s.bytes()], pa.binary())], ["value"])
        for batch in batches:
            keys = batch.column(0)
            there = keys.is_valid().to_numpy(zero_copy_only=False)
            keys = keys.fill_null(0).to_numpy()
            for x, y, n, flat in enc.slices(batch.column(1)):
                padded = -(-(n + 1) // 4) * 4
                first = np.cumsum(padded) - padded
                values = np.zeros(int(padded.sum()), "<u4")
                values[ranges(first, n)] = rank_of[flat]
                values[first + n] = rank_of[end_id]
                control, data, sizes = code(values)
                # Rows go in runs of about a shard's bytes.
                ends = np.cumsum(padded) // 4
                bytes_to = np.concatenate(([0], np.cumsum(sizes)))[ends]
                a = 0
                while a < y - x:
                    base = bytes_to[a - 1] if a else 0
                    b = max(a + 1, int(np.searchsorted(bytes_to, base + max(1, shard_bytes - shard.size), "right")))
                    c0 = ends[a - 1] if a else 0
                    shard.add(keys[x + a : x + b], there[x + a : x + b], n[a:b] + 1, control[c0 : ends[b - 1]], data[base : bytes_to[b - 1]])
                    a = b
                    if shard.size >= shard_bytes:
                        yield out(shard)
                        shard = Shard(part, shard.seq + 1)
        if shard.docs:
            yield out(shard)

    files = dealt.select("doc_id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(f"{path}/shards")


def _parsed(content: pa.Scalar) -> tuple[np.void, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(content.as_buffer(), np.uint8)
    head = raw[: HEADER.itemsize].view(HEADER)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a shard of token ids")
    at, parts = HEADER.itemsize, []
    for kind, n in (("<i8", head["docs"]), ("u1", head["docs"]), ("<u4", head["docs"]), ("u1", head["control"]), ("u1", head["data"])):
        size = int(n) * np.dtype(kind).itemsize
        parts.append(np.frombuffer(raw[at : at + size].tobytes() if kind != "u1" else raw[at : at + size], kind))
        at += size
    if at + 1 != len(raw) or zlib.crc32(raw[HEADER.itemsize : at]) != head["crc"]:
        raise ValueError(f"shard {head['part']}/{head['seq']} is damaged")
    return head, *parts


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq and the number of ids in all files before; a row a file, of the headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = np.frombuffer(b"".join(batch.column(0).to_pylist()), HEADER)
            yield pa.RecordBatch.from_arrays([pa.array(heads[k].astype(np.int64)) for k in ("part", "seq", "ids")], ["part", "seq", "ids"])

    heads = spark.read.format("binaryFile").load(f"{path}/shards/part-*").select(F.expr(f"substring(content, 1, {HEADER.itemsize})").alias("head"))
    files = stored(heads.mapInArrow(run, "part long, seq long, ids long"), "token-files")
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", before(Window.orderBy("part")).alias("base"))
    return stored(files.withColumn("inside", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base")), "token-starts")


def read_archive(spark: SparkSession, path: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit integers) of an archive."""
    id_of = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")  # the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                head, doc_ids, there, counts, control, data = _parsed(content)
                n = counts.astype(np.int64)
                groups = np.cumsum(-(-n // 4))
                starts, bytes_to = np.cumsum(n) - n, np.cumsum(np.add.reduceat(_TOTAL[control], np.concatenate(([0], groups[:-1])), dtype=np.int64))
                a = 0
                while a < len(n):
                    g0 = groups[a - 1] if a else 0
                    b = max(a + 1, int(np.searchsorted(groups, g0 + (1 << 18), "right")))
                    values = decode(control[g0 : groups[b - 1]], data[bytes_to[a - 1] if a else 0 : bytes_to[b - 1]])
                    first = (np.concatenate(([g0], groups[a : b - 1])) - g0) * 4
                    ids = id_of[values[ranges(first, n[a:b])]]
                    ends = np.concatenate(([0], np.cumsum(n[a:b] * 4))).astype(np.int32)
                    blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                    keys = pa.array(doc_ids[a:b], pa.int64(), mask=there[a:b] == 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, head[k], np.int64)) for k in ("part", "seq")] + [keys, pa.array(starts[a:b]), pa.array(n[a:b]), blobs], ["part", "seq", "doc_id", "inside", "n_tokens", "ids"])
                    a = b

    starts = shard_starts(spark, path)
    rows = spark.read.format("binaryFile").load(f"{path}/shards/part-*").select("content").mapInArrow(run, "part long, seq long, doc_id long, inside long, n_tokens long, ids binary")
    side = F.broadcast(starts) if starts.count() <= broadcast_rows else starts
    return rows.join(side, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids")


def op13_token_archive(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_archive(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_archive(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Substring dedup: a Count-min prefilter, then exact grouping of the windows it calls repeated.

Pass 1 hashes every window of ``window`` words to one cell in each of ``depth`` sketch
rows. Tasks send their cell hits, sorted and gap-coded, to the row's shards; shards add
them up and keep one bit a cell: hit twice or more. The estimate (the least of the rows)
never falls below the true count, so no repeated window is lost. Pass 2 groups exactly the
windows whose bits are all set: document groups exchange 96-bit hashes with the least doc_id that
holds each (see ``packed``), each group learns which of its windows start in a smaller doc_id elsewhere, and
settles the rest among its own documents.

The sketch has about two cells a window up to ``max_bits`` (2**28 cells a row: 32 MB a
row broadcast). Beyond that more windows pass to the exact step; results stay the same.

Defined results: null text has no words; fewer words than a window: nothing removed;
rows sharing a doc_id count as one document; a null doc_id sorts after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as pk
from .bytesops import SpanHash, flatten, ranges, word_spans
from .scratch import stored

U64 = np.uint64
FLUSH = 2_000_000


def window_hashes(data: np.ndarray, offs: np.ndarray, window: int, second: bool = True):
    """Word starts, ends, first words per text, window starts (word indexes), and two hashes a window."""
    starts, ends, first = word_spans(data, offs)
    at = ranges(first[:-1], np.maximum(np.diff(first) - (window - 1), 0))
    out = []
    for seed in (11, 23)[: 1 + second]:
        words = SpanHash(data, seed).spans(starts, ends)
        out.append(SpanHash(words, seed + 1).spans(at, at + window))
    return starts, ends, first, at, out[0], out[-1]


def gaps_encode(cells: np.ndarray) -> bytes:
    """Sorted cells as gaps in base 255 with one byte a digit: 255 means 'add 255 and go on'."""
    gap = np.diff(cells, prepend=0)
    more = gap // 255
    out = np.full(len(gap) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return out.tobytes()


def gaps_decode(blob: np.ndarray) -> np.ndarray:
    return np.cumsum(blob, dtype=np.int64)[blob < 255]


class Sketch:
    """One bit a cell and row: estimated count of two or more."""

    def __init__(self, rows: list[np.ndarray], bits: int):
        self.rows, self.bits = rows, bits

    def repeated(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for bitmap, h in zip(self.rows, (a, b)):
            cell = (h >> U64(64 - self.bits)).astype(np.int64)
            ok &= (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return ok


def build_sketch(groups: DataFrame, total_bytes: int, window: int, depth: int, max_bits: int) -> Sketch:
    bits = int(min(max_bits, max(16, round(np.log2(max(1, total_bytes / 3))))))
    shards = 1 << max(0, bits - 22)
    width = (1 << bits) // shards

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(depth)]
        size = 0

        def flush():
            row, shard, blob = [], [], []
            for r in range(depth):
                cells = np.sort(np.concatenate(held[r]))
                cuts = np.searchsorted(cells, np.arange(shards + 1, dtype=np.int64) * width)
                for s in np.flatnonzero(np.diff(cuts)):
                    row.append(r)
                    shard.append(s)
                    blob.append(gaps_encode(cells[cuts[s] : cuts[s + 1]].astype(np.int64) - s * width))
                held[r].clear()
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], ["row", "shard", "blob"])

        for batch in batches:
            for blob in batch.column(0):
                *_, a, b = window_hashes(*flatten(pk.unpack(blob)[1]), window, depth > 1)
                for r, h in enumerate((a, b)[:depth]):
                    held[r].append((h >> U64(64 - bits)).astype(np.uint32))
                size += len(a)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[tuple[int, int], np.ndarray] = {}
        twice: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r, s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                one = once.setdefault((r, s), np.zeros(width, bool))
                two = twice.setdefault((r, s), np.zeros(width, bool))
                cells = gaps_decode(np.frombuffer(blob.as_buffer(), np.uint8))
                two[cells[1:][cells[1:] == cells[:-1]]] = True
                cells = cells[np.concatenate(([True], cells[1:] != cells[:-1]))]
                two[cells[one[cells]]] = True
                one[cells] = True
        for (r, s), two in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([s], pa.int32()), pa.array([np.packbits(two, bitorder="little").tobytes()], pa.binary())], ["row", "shard", "blob"])

    schema = "row int, shard int, blob binary"
    found = groups.select("blob").mapInArrow(hits, schema)
    merged = found.repartition(depth * shards, "row", "shard").mapInArrow(merge, schema)
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(depth)]
    step = width // 8
    for x in merged.toLocalIterator():
        rows[x.row][x.shard * step : (x.shard + 1) * step] = np.frombuffer(x.blob, np.uint8)
    return Sketch(rows, bits)


#: A window's hash and the least doc_id that holds it (from the least of all on, or as it is; null: the largest value).
HELD = np.dtype([*pk.ENTRY.descr, ("id", "<u4")])
HELD_FAR = np.dtype([*pk.ENTRY.descr, ("id", "<i8")])


def in_smaller_id(rec: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray]:
    """Records of windows that another group holds with a smaller doc_id."""
    new = np.ones(len(rec), bool)
    new[1:] = (rec["a"][1:] != rec["a"][:-1]) | (rec["b"][1:] != rec["b"][:-1])
    least = np.minimum.reduceat(rec["id"], np.flatnonzero(new))
    return (rec["id"] > least[np.cumsum(new) - 1],)


def join_kept(data, starts, ends, first, kept) -> pa.Array:
    """Per text its kept words joined by one space."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[kept]
    s, lens = starts[kept], (ends - starts)[kept] + 1
    last = np.ones(len(s), bool)
    last[:-1] = owner[1:] != owner[:-1]
    lens = lens - last
    out = data[ranges(s, lens)]
    out[(np.cumsum(lens) - 1)[~last]] = 0x20
    offs = np.zeros(len(first), np.int64)
    np.cumsum(np.bincount(owner, lens, minlength=len(first) - 1).astype(np.int64), out=offs[1:])
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offs), pa.py_buffer(out)).cast(pa.string())


def dedup_substrings(docs: DataFrame, window: int = 13, depth: int = 2, max_bits: int = 28, group_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each text without the words of windows that start in a smaller doc_id too."""
    spark = docs.sparkSession
    packed, size = pk.packed_docs(docs, group_bytes)
    sketch = spark.sparkContext.broadcast(build_sketch(packed, size.bytes, window, depth, max_bits))
    buckets = max(1, size.bytes // (4 << 20))
    near = size.high - size.low < 2**32 - 1
    record, low = (HELD, size.low) if near else (HELD_FAR, 0)

    def repeated(blob):
        """The documents by doc_id, their words, and of the windows that the sketch calls repeated: first word, hashes, document."""
        ids, text, null = pk.unpack(blob)
        order = np.argsort(ids, kind="stable")
        data, offs = flatten(text.take(pa.array(order)))
        starts, ends, first, at, a, b = window_hashes(data, offs, window)
        pick = np.flatnonzero(sketch.value.repeated(a, b))
        at = at[pick]
        return ids[order], null[order], (data, starts, ends, first), at, a[pick], b[pick].astype(np.uint32), np.searchsorted(first, at, "right") - 1

    def entries(grp, blob):
        ids, null, _, _, a, b, doc = repeated(blob)
        order, head = pk.sorted_runs(a, b)
        rec = pk.records(record, a[order[head]], b[order[head]])
        doc = doc[order[head]]  # the least: documents come by doc_id
        rec["id"] = np.where(null[doc], np.iinfo(record["id"]).max, ids[doc] - low)
        yield pk.entry_rows(grp, rec, buckets)

    answers = stored(pk.answer_entries(pk.by_group(packed, entries, pk.ENTRIES), record, in_smaller_id), "windows")

    def settle(grp, blob, back):
        ids, null, (data, starts, ends, first), at, a, b, doc = repeated(blob)
        order, head = pk.sorted_runs(a, b)
        run = np.cumsum(np.bincount(head, minlength=len(a))) - 1
        elsewhere = pk.answered(back, a[order[head]], buckets)
        gone = np.zeros(len(a), bool)
        gone[order] = elsewhere[run] | (ids[doc[order]] > ids[doc[order[head]]][run])
        cover = np.zeros(len(starts) + 1, np.int64)
        begin = at[gone]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + window, -1)
        removed = np.cumsum(cover)[:-1] > 0
        counts = np.diff(np.concatenate(([0], np.cumsum(removed)))[first])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null), pa.array(np.diff(first).astype(np.int64)), pa.array(counts.astype(np.int64)), join_kept(data, starts, ends, first, ~removed)],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )

    return pk.by_group_with(packed, answers, settle, "doc_id long, n_words long, n_removed long, kept_text string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

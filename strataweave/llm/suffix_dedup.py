"""Suffix dedup: every byte covered by a ``length``-byte string that starts anywhere else goes.

Induced sorting of sampled suffixes. Of the grams inside the first ``WINDOW`` bytes of a ``length``-byte string the
least one (leftmost of equals) is its sample, so equal strings have equal samples at equal
offsets. A sample stands for a run of neighbouring string starts and carries two names: of the prefix
that all strings of the run share (core), and of the span that covers them all (cover).

1. A core found once: none of the run's strings repeats. A cover found twice: all do.
2. Runs of equal cores and different covers go to the core's bucket as suffix tuples (core, suffix from the sample, bytes
   before it). There the sampled suffixes are sorted with their common-prefix values, and the
   order and the common prefixes of the suffixes one byte further left are induced from them, byte by byte, up to the
   start of the run: tuples fall into classes by the byte in front, and a class's common prefixes are the least ones
   between its members in the order before. A suffix whose neighbour shares ``length`` bytes repeats.
3. A core in more than ``hot_groups`` document groups could fill a bucket; its runs' strings are named one by one instead
   and matched by name, each name once a group.

Sorting whole texts' suffixes the same way would need more disk than the texts' budget (see README); the samples,
one in a hundred positions, stand for them without losing any match. Names are 96-bit hashes or longer.
Spark's shuffle and sort bring a bucket's tuples together and spill; inside a bucket they are sorted in memory.

Defined results: null text is empty; shorter texts than ``length`` lose nothing; rows with equal
doc_ids are separate texts; matches never cross texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as pk
from .bytesops import SpanHash, byte_table, flatten, mix64, ranges
from .scratch import stored

U64 = np.uint64
GRAM, WINDOW = 12, 200


def _sample_of_starts(data: np.ndarray, window: int) -> np.ndarray:
    """For each start, the position of the least gram among the next ``window`` positions."""
    v = byte_table(5)[data]
    m = 0x9E3779B97F4A7C15
    p = lambda k: U64(pow(m, k, 1 << 64))
    g2 = v[:-1] * p(1) + v[1:]
    g4 = g2[:-2] * p(2) + g2[2:]
    g8 = g4[:-4] * p(4) + g4[4:]
    g12 = g8[:-4] * p(4) + g4[8:]
    key = (mix64(g12) & U64(0xFFFFFFFF00000000)) | np.arange(len(g12), dtype=U64)
    span = 1
    while span * 2 <= window:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < window:
        key = np.minimum(key[: span - window], key[window - span :])
    return (key & U64(0xFFFFFFFF)).astype(np.int64)


class Runs:
    """The samples of a group's texts: position x, first and last start (lo, hi), core and cover names."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int):
        self.length = length
        window = min(WINDOW, length - GRAM)
        starts = ranges(offs[:-1], np.maximum(np.diff(offs) - (length - 1), 0))
        self.hash = [SpanHash(data, 31), SpanHash(data, 37)] if len(starts) else []
        if not len(starts):
            self.x = self.lo = self.hi = np.zeros(0, np.int64)
            self.core = self.cover = self.cover2 = np.zeros(0, U64)
            return
        x = _sample_of_starts(data, window)[starts]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (starts[1:] != starts[:-1] + 1)))
        first = np.flatnonzero(new)
        self.x, self.lo, self.hi = x[first], starts[first], starts[np.append(first[1:], len(x)) - 1]
        shape = mix64((self.x - self.lo).astype(U64) << U64(32) | (self.hi - self.lo).astype(U64))
        self.core = self.hash[0].spans(self.x, self.x + length - window + 1)
        self.cover = self.hash[0].spans(self.lo, self.hi + length) ^ shape
        self.cover2 = self.hash[1].spans(self.lo, self.hi + length) ^ shape

    def strings(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all strings of the picked runs, and their names."""
        s = ranges(self.lo[pick], (self.hi - self.lo)[pick] + 1)
        if not len(s):
            return s, np.zeros(0, U64), np.zeros(0, np.uint32)
        return s, self.hash[0].spans(s, s + self.length), self.hash[1].spans(s, s + self.length).astype(np.uint32)


PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def _cores(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """A group's cores with at most two of their covers each, sorted."""
    a, b, _ = pk.distinct_sorted(runs.core, runs.cover)
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    return a[nth < 2], b[nth < 2]


def _mixed(hot_groups: int):
    """Masks of the cores that stand with two covers or more, and of those among them that too many groups hold."""

    def masks(rec: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = rec["a"], rec["b"]
        new = np.concatenate(([True], a[1:] != a[:-1]))
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        mixed = np.zeros(len(first), bool)
        mixed[run[b != b[first][run]]] = True
        groups = np.unique(run.astype(np.int64) << 32 | owner) >> 32
        hot = mixed & (np.bincount(groups, minlength=len(first)) > hot_groups)
        return mixed[run], hot[run]

    return masks


def induced(core: np.ndarray, right: np.ndarray, size: np.ndarray, before: list[np.ndarray], least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """Marks (tuple, distance): the ``length``-byte string that starts so far left of the sample occurs at another tuple too.

    right: bytes from the sample on, one row a tuple, ``size`` of them real; before: bytes before it, nearest last.
    Distances from least to most are asked for.
    """
    n = len(core)
    out = np.zeros((n, int(most.max(initial=0)) + 1), bool)
    key = np.concatenate([core[:, None].astype(">u8").view(np.uint8).reshape(n, 8), right, size[:, None].astype(">u2").view(np.uint8).reshape(n, 2)], 1)
    order = np.argsort(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), kind="stable")
    # Common prefixes of neighbours; -1 between different cores.
    x, y = right[order[:-1]], right[order[1:]]
    differ = x != y
    common = np.where(differ.any(1), differ.argmax(1), length)
    common = np.minimum(common, np.minimum(size[order[:-1]], size[order[1:]]))
    same = core[order[1:]] == core[order[:-1]]
    prefix = np.concatenate(([-1], np.where(same, common, -1), [-1]))
    cls = np.concatenate(([0], np.cumsum(~same)))
    left = np.zeros((n, out.shape[1]), np.uint8)
    for i, bytes_ in enumerate(before):
        left[i, 1 : len(bytes_) + 1] = bytes_[::-1]
    for d in range(out.shape[1]):
        near = np.maximum(prefix[:-1], prefix[1:])
        hit = (near >= length - d) & (least[order] <= d)
        out[order[hit], d] = True
        go = np.flatnonzero((most[order] > d) & (near >= length - most[order]))
        if len(go) < 2:
            break
        byte = left[order[go], d + 1].astype(np.int64)
        at = go[np.argsort(cls[go] * 256 + byte, kind="stable")]
        full = cls[at] * 256 + left[order[at], d + 1]
        same = full[1:] == full[:-1]
        spans = np.stack([at[:-1] + 1, at[1:] + 1], 1)
        spans[~same] = 0, 1
        least_common = np.minimum.reduceat(prefix, spans.ravel())[::2]
        prefix = np.concatenate(([-1], np.where(same, least_common, -1), [-1]))
        order, cls = order[at], np.concatenate(([0], np.cumsum(~same)))
    return out


TUPLE = np.dtype([("core", "<u8"), ("least", "<u2"), ("most", "<u2"), ("size", "<u2")])


def tuple_rows(grp: int, data: np.ndarray, ends: np.ndarray, runs: Runs, pick: np.ndarray, buckets: int, offset: int) -> pa.RecordBatch:
    """The picked runs (sorted by core) as suffix tuples, one row a bucket: the count, the heads, then the bytes of each."""
    x, core = runs.x[pick], runs.core[pick]
    head = np.zeros(len(pick), TUPLE)
    head["core"], head["least"], head["most"] = core, x - runs.hi[pick], x - runs.lo[pick]
    head["size"] = np.minimum(runs.length, ends - x)
    found, at = np.unique(pk.bucket_of(core, buckets), return_index=True)
    blobs = []
    for a, b in zip(at, [*at[1:], len(pick)]):
        lo, n = runs.lo[pick[a:b]], head["most"][a:b].astype(np.int64) + head["size"][a:b]
        blobs.append(np.uint32(b - a).tobytes() + head[a:b].tobytes() + data[ranges(lo, n)].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), grp, np.int64)), pa.array(found.astype(np.int32) + offset), pa.array(blobs, pa.binary())], ["grp", "bucket", "blob"])


def answer_tuples(tuples: DataFrame, length: int) -> DataFrame:
    """Rows (grp, bucket, blob): for each tuple sent, a bit for each of its starts, the leftmost first."""

    def answer(table: pa.Table) -> pa.Table:
        heads, right, before, counts = [], [], [], []
        for v in table.column("blob"):
            raw = np.frombuffer(v.as_buffer(), np.uint8)
            n = int(raw[:4].view("<u4")[0])
            head = raw[4 : 4 + n * TUPLE.itemsize].view(TUPLE)
            body = raw[4 + n * TUPLE.itemsize :]
            most, size = head["most"].astype(np.int64), head["size"].astype(np.int64)
            begin = np.cumsum(most + size) - most - size
            rows = np.zeros((n, length), np.uint8)
            where = ranges(np.arange(n) * length, size)
            rows.reshape(-1)[where] = body[ranges(begin + most, size)]
            right.append(rows)
            before += [body[b : b + m] for b, m in zip(begin, most)]
            heads.append(head)
            counts.append(n)
        head = np.concatenate(heads)
        least, most = head["least"].astype(np.int64), head["most"].astype(np.int64)
        marks = induced(head["core"], np.concatenate(right), head["size"].astype(np.int64), before, least, most, length)
        span = most - least + 1
        flat = marks[np.repeat(np.arange(len(head)), span), np.repeat(most, span) - ranges(np.zeros(len(span), np.int64), span)]
        cuts = np.concatenate(([0], np.cumsum(span)))[np.concatenate(([0], np.cumsum(counts)))]
        full = [i for i in range(len(counts)) if flat[cuts[i] : cuts[i + 1]].any()]
        bits = [np.packbits(flat[cuts[i] : cuts[i + 1]]).tobytes() for i in full]
        return pa.table({"grp": table.column("grp").take(pa.array(full, pa.int64())), "bucket": table.column("bucket").take(pa.array(full, pa.int64())), "blob": pa.array(bits, pa.binary())})

    return tuples.groupBy("bucket").applyInArrow(answer, pk.ENTRIES)


def tuple_hits(back: pa.Table, runs: Runs, pick: np.ndarray, buckets: int, offset: int) -> np.ndarray:
    """The answers to the picked runs, one for each of their starts."""
    ends = np.concatenate(([0], np.cumsum((runs.hi - runs.lo)[pick] + 1)))
    out = np.zeros(int(ends[-1]), bool)
    for i, j, v in pk.shares(back, runs.core[pick], buckets, offset):
        x, y = ends[i], ends[j]
        out[x:y] = np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8), count=int(y - x))
    return out


def repeated_bytes(docs: DataFrame, length: int = 400, group_bytes: int = 1 << 20, hot_groups: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, starts and ends of the removed byte runs, kept (the bytes left)."""
    packed, size = pk.packed_docs(docs, group_bytes)
    buckets = max(1, size.bytes // (8 << 20))

    def names(grp, blob):
        _, text, _ = pk.unpack(blob)
        runs = Runs(*flatten(text, ""), length)
        a, b, _ = pk.distinct_sorted(runs.cover, runs.cover2.astype(np.uint32))
        cores = pk.entry_rows(grp, pk.records(PAIR, *_cores(runs)), buckets, buckets)
        yield from (pk.entry_rows(grp, pk.records(pk.ENTRY, a, b), buckets), cores)

    named = stored(pk.by_group(packed, names, pk.ENTRIES), "names")
    covers = pk.answer_entries(named.where(F.col("bucket") < buckets), pk.ENTRY, pk.in_other_group)
    first = stored(covers.unionByName(pk.answer_entries(named.where(F.col("bucket") >= buckets), PAIR, _mixed(hot_groups), 2 * buckets)), "covers")

    def decide(text, back):
        """The runs, which repeat as a whole, and of those whose core has several covers (one of each cover that repeats) the cold and the hot ones."""
        data, offs = flatten(text, "")
        runs = Runs(data, offs, length)
        b32 = runs.cover2.astype(np.uint32)
        a, b, n = pk.distinct_sorted(runs.cover, b32)
        again = (n > 1) | pk.answered(back, a, buckets)
        twice = pk.is_in(runs.cover, b32, a[again], b[again])
        cores, _ = _cores(runs)
        mixed = np.isin(runs.core, cores[pk.answered(back, cores, buckets, buckets)])
        hot = np.isin(runs.core, cores[pk.answered(back, cores, buckets, 3 * buckets)])
        whole = np.flatnonzero(mixed & twice)
        _, rep = np.unique(runs.cover[whole], return_index=True)
        pick = np.concatenate([np.flatnonzero(mixed & ~twice), whole[rep]])
        cold = pick[~hot[pick]]
        return data, offs, runs, twice, cold[np.argsort(runs.core[cold], kind="stable")], pick[hot[pick]]

    def strings(grp, blob, back):
        _, text, _ = pk.unpack(blob)
        data, offs, runs, _, cold, hot = decide(text, back)
        _, a, b = runs.strings(hot)
        a, b, _ = pk.distinct_sorted(a, b)
        ends = offs[np.searchsorted(offs, runs.x[cold], "right")]
        yield from (pk.entry_rows(grp, pk.records(pk.ENTRY, a, b), buckets, 2 * buckets), tuple_rows(grp, data, ends, runs, cold, buckets, 4 * buckets))

    sent = stored(pk.by_group_with(packed, first, strings, pk.ENTRIES), "tuples")
    named_back = pk.answer_entries(sent.where(F.col("bucket") < 4 * buckets), pk.ENTRY, pk.in_other_group)
    second = stored(named_back.unionByName(answer_tuples(sent.where(F.col("bucket") >= 4 * buckets), length)), "strings")

    def settle(grp, blob, back):
        ids, text, null = pk.unpack(blob)
        data, offs, runs, twice, cold, hot = decide(text, back)
        s, a, b = runs.strings(hot)
        ua, ub, n = pk.distinct_sorted(a, b)
        again = (n > 1) | pk.answered(back, ua, buckets, 2 * buckets)
        hit = pk.is_in(a, b, ua[again], ub[again])
        t = ranges(runs.lo[cold], (runs.hi - runs.lo)[cold] + 1)
        s, hit = np.concatenate([s, t]), np.concatenate([hit, tuple_hits(back, runs, cold, buckets, 4 * buckets)])
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, np.concatenate([runs.lo[twice], s[hit]]), 1)
        np.add.at(edge, np.concatenate([runs.hi[twice], s[hit]]) + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        step = np.diff(gone.view(np.int8), prepend=np.int8(0))
        step_end = np.diff(gone.view(np.int8), append=np.int8(0))
        inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
        begins, ends = step == 1, step_end == -1
        if len(inner):  # a text's first byte always begins a run, the last ends one
            begins[inner] |= gone[inner]
            ends[inner - 1] |= gone[inner - 1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        at = np.searchsorted(begins, offs)
        base = np.repeat(offs[:-1], np.diff(at))
        kept = data[~gone]
        total = np.concatenate(([0], np.cumsum(gone)))[offs]
        removed = np.diff(total)
        koffs = offs - total
        lists = lambda v: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((v - base).astype(np.int64)))
        kept_col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(koffs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null), pa.array(np.diff(offs)), pa.array(removed.astype(np.int64)), pa.array(np.diff(at).astype(np.int64)), lists(begins), lists(ends), kept_col.cast(pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept"],
        )

    return pk.by_group_with(packed, first.unionByName(second), settle, "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

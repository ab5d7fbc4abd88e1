"""Documents packed in groups, and an exchange that tells each group which of its hashes others hold.

A group is a run of rows as one task reads them, about ``group_bytes`` of text (a longer text is a group of its own), whatever their
doc_ids. The groups are stored once, so all passes see the same rows in the same order, after a lost executor too.
Groups send each distinct hash once to the hash's bucket, so a hash that a third of all
documents share reaches its bucket once a group, not once a document. Buckets answer the
groups; no group or bucket holds more than its bounded share and nothing passes through the driver but three sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .bytesops import row_slices
from .scratch import stored

NULL_ID = np.iinfo(np.int64).max


def stored_groups(docs: DataFrame, group_bytes: int, spread: bool = True) -> tuple[DataFrame, Row]:
    """A stored table (grp, blob) of all rows, and their number, bytes of text, least and largest doc_id (0 where there is none).

    A blob is a zstd-compressed Arrow stream of the columns of docs (text is one of them). With ``spread`` an input of few partitions is dealt out first.
    """
    if spread and docs.rdd.getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism:
        docs = docs.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    at = docs.columns.index("text")
    id_at = docs.columns.index("doc_id") if "doc_id" in docs.columns else None

    def one(parts: list[pa.RecordBatch]) -> bytes:
        sink, options = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_stream(sink, parts[0].schema, options=options) as out:
            for part in parts:
                out.write_batch(part)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush():
            bounds = [pc.min_max(p.column(id_at)).as_py() for p in held] if id_at is not None else []
            low, high = [x for b in bounds for x in (b["min"],) if x is not None], [x for b in bounds for x in (b["max"],) if x is not None]
            values = (grp, one(held), sum(p.num_rows for p in held), size, min(low, default=None), max(high, default=None))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["grp", "blob", "rows", "bytes", "low", "high"])

        for batch in batches:
            for x, y in row_slices(batch.column(at), group_bytes):
                part = batch.slice(x, y - x)
                more = pc.sum(pc.binary_length(part.column(at))).as_py() or 0
                if held and size + more > group_bytes:
                    yield flush()
                    grp, held, size = grp + 1, [], 0
                held.append(part)
                size += more
        if held:
            yield flush()

    groups = stored(docs.mapInArrow(run, "grp long, blob binary, rows long, bytes long, low long, high long"), "groups")
    total = lambda f, c: F.coalesce(f(c), F.lit(0)).alias(c)
    return groups.select("grp", "blob"), groups.agg(total(F.sum, "rows"), total(F.sum, "bytes"), total(F.min, "low"), total(F.max, "high")).first()


def table_of(blob: pa.Scalar) -> pa.Table:
    """The rows of a group, in the order stored."""
    return pa.Table.from_batches(list(pa.ipc.open_stream(blob.as_buffer())))


def packed_docs(docs: DataFrame, group_bytes: int) -> tuple[DataFrame, Row]:
    """doc_id and text in stored groups."""
    return stored_groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), group_bytes)


def unpack(blob: pa.Scalar) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """doc_ids (null: the largest long), texts and null flags of a group, in the order stored."""
    t = table_of(blob)
    ids = t.column("doc_id").combine_chunks()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    return ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False), t.column("text").cast(pa.large_string()).combine_chunks(), null


ENTRY = np.dtype([("a", "<u8"), ("b", "<u4")])
ENTRIES = "grp long, bucket int, blob binary"


def entry_rows(grp: int, rec: np.ndarray, buckets: int, offset: int = 0) -> pa.RecordBatch:
    """One row per bucket with a group's distinct records. They must be sorted by ``a``; buckets are ranges of it."""
    found, at = np.unique(bucket_of(rec["a"], buckets), return_index=True)
    ends = [*at[1:], len(rec)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(found), grp, np.int64)), pa.array(found.astype(np.int32) + offset), pa.array([rec[x:y].tobytes() for x, y in zip(at, ends)], pa.binary())],
        ["grp", "bucket", "blob"],
    )


def records(dtype: np.dtype, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    rec = np.empty(len(a), dtype)
    rec["a"], rec["b"] = a, b
    return rec


def bucket_of(a: np.ndarray, buckets: int) -> np.ndarray:
    return ((a >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def sorted_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a, then b (stable), and where in it each distinct pair begins."""
    order = np.argsort(a, kind="stable")
    sa, sb = a[order], b[order]
    if np.any((sa[1:] == sa[:-1]) & (sb[1:] != sb[:-1])):
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    return order, np.flatnonzero(new)


def distinct_sorted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) in order of a then b, and how many there were of each."""
    order, first = sorted_runs(a, b)
    return a[order[first]], b[order[first]], np.diff(np.append(first, len(a)))


def answer_entries(entries: DataFrame, dtype: np.dtype, hits: Callable, step: int = 0) -> DataFrame:
    """Rows (grp, bucket, blob): one bit for each record that the group sent to the bucket, in the order sent.

    ``hits(rec, owner)`` gets a bucket's records in order of a (then b where a repeats with
    different b, then group; groups as numbers from 0) and returns masks of those to answer with 1; the k-th mask's rows have ``bucket + k * step``.
    """

    def answer(table: pa.Table) -> pa.Table:
        grps, blobs = table.column("grp").to_numpy(), table.column("blob")
        recs = [np.frombuffer(blobs[i].as_buffer(), dtype) for i in range(len(grps))]
        sizes = np.array([len(r) for r in recs])
        rec, owner = np.concatenate(recs), np.repeat(np.arange(len(grps)), sizes)
        at = np.argsort(rec["a"], kind="stable")
        a, b = rec["a"][at], rec["b"][at]
        if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
            at = np.lexsort((owner, rec["b"], rec["a"]))
        bucket = table.column("bucket")[0].as_py()
        to, where, bits = [], [], []
        for k, mask in enumerate(hits(rec[at], owner[at])):
            out = np.zeros(len(rec), bool)
            out[at] = mask
            for g, x in zip(grps, np.split(out, np.cumsum(sizes)[:-1])):
                if x.any():
                    to.append(g)
                    where.append(bucket + k * step)
                    bits.append(np.packbits(x).tobytes())
        return pa.table({"grp": pa.array(to, pa.int64()), "bucket": pa.array(where, pa.int32()), "blob": pa.array(bits, pa.binary())})

    return entries.groupBy("bucket").applyInArrow(answer, ENTRIES)


def in_other_group(rec: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray]:
    """Records that any other group holds too."""
    same = (rec["a"][1:] == rec["a"][:-1]) & (rec["b"][1:] == rec["b"][:-1])
    return (np.concatenate(([False], same)) | np.concatenate((same, [False])),)


def shares(table: pa.Table, a: np.ndarray, buckets: int, offset: int) -> Iterator[tuple[int, int, pa.Scalar]]:
    """Of sorted ``a`` the range that each answering bucket stands for, and the answer; work grows with the answers, not with the buckets."""
    mine = bucket_of(a, buckets)
    for k, v in zip(table.column("bucket").to_pylist(), table.column("blob")):
        if offset <= k < offset + buckets:
            yield int(np.searchsorted(mine, k - offset)), int(np.searchsorted(mine, k - offset, "right")), v


def answered(table: pa.Table, a: np.ndarray, buckets: int, offset: int = 0) -> np.ndarray:
    """The answers to the records with sorted ``a`` that a group had sent."""
    out = np.zeros(len(a), bool)
    for x, y, v in shares(table, a, buckets, offset):
        out[x:y] = np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8), count=y - x)
    return out


def is_in(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Whether each (a, b) is among the sorted distinct (sa, sb)."""
    if not len(sa):
        return np.zeros(len(a), bool)
    at = np.searchsorted(sa, a)
    out = np.zeros(len(a), bool)
    todo = np.flatnonzero(at < len(sa))
    while len(todo):
        todo = todo[sa[at[todo]] == a[todo]]
        ok = sb[at[todo]] == b[todo]
        out[todo[ok]] = True
        todo = todo[~ok]
        at[todo] += 1
        todo = todo[at[todo] < len(sa)]
    return out


def by_group(groups: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(grp, blob)`` of each group, without a shuffle; it yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from fn(grp, blob)

    return groups.mapInArrow(run, schema)


def by_group_with(groups: DataFrame, answers: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(grp, blob, answers)`` of each group; it yields record batches."""

    def run(key, left, right):
        return pa.Table.from_batches(list(fn(key[0].as_py(), left.column("blob")[0], right)))

    return groups.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(run, schema)

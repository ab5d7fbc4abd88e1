"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts become one vertex (partial aggregates; a text a third of all rows share is no hot spot), stored in groups of about ``group_bytes``.
2. Shingles of five words are hashed to a sketch (merged in shards). Counts never fall short, so a shingle that it counts once stands
   in one text only. For all others groups exchange hashes (see ``packed``) and learn the exact number of distinct texts that
   hold the shingle, in steps of an eighth of an octave. Weights are term frequency times 1 + (1 - log df / log N). A text with
   more than 1 - threshold of its weight in shingles of its own has no partner and is left out, which loses nothing.
3. The other texts get ``bands`` x ``rows`` samples, equal with probability equal to the weighted Jaccard similarity.
4. Texts that share a band are compared by exact weighted Jaccard similarity, in blocks of about ``block`` texts: first with the least text of the
   band (its hub), which takes part in each block; what it holds together needs no further comparison. Only bands
   that are larger than a block and still in several parts are then compared block by block, all pairs. Links of the threshold or more join classes.

The sketch has two cells a shingle up to ``max_bits`` (2**28 cells: 32 MB broadcast); beyond, more hashes go to the exact count; results stay the same.

Defined results: null text is empty; texts of fewer words than a shingle are one shingle; texts without a word match only equal
texts; a class is named by its least doc_id (nulls last).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as pk
from .bytesops import SpanHash, flatten, mix64, ranges, row_slices, word_spans
from .components import components
from .scratch import stored
from .substring_dedup import gaps_decode, gaps_encode

U64 = np.uint64
SLICE = 1 << 20
FLUSH = 2_000_000
STEPS = 8  # levels of document frequency in an octave


def shingles(col: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each shingle; texts with 1 to words - 1 words are one shingle."""
    data, offs = flatten(col)
    starts, ends, first = word_spans(data, offs)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = ranges(first[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    h = SpanHash(SpanHash(data, 61).spans(starts, ends), 62).spans(at, np.minimum(at + words, first[1:][owner]))
    return h, owner


def elements(col: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle, text and term frequency, in order of text and shingle."""
    h, owner = shingles(col, words)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return h[at], owner[at], np.diff(np.append(at, len(h)))


class Seen:
    """One bit a cell: its shingles stand in two texts or more, together."""

    def __init__(self, twice: np.ndarray, bits: int):
        self.twice, self.bits = twice, bits

    def again(self, h: np.ndarray) -> np.ndarray:
        cell = (h >> U64(64 - self.bits)).astype(np.int64)
        return (self.twice[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def build_sketch(groups: DataFrame, total_bytes: int, words: int, max_bits: int) -> Seen:
    bits = int(min(max_bits, max(16, round(np.log2(max(1, total_bytes / 3))))))
    shards = 1 << max(0, bits - 22)
    width = (1 << bits) // shards

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            cells = np.sort(np.concatenate(held))
            held.clear()
            cuts = np.searchsorted(cells, np.arange(shards + 1, dtype=np.int64) * width)
            full = np.flatnonzero(np.diff(cuts))
            blobs = [gaps_encode(cells[cuts[s] : cuts[s + 1]].astype(np.int64) - s * width) for s in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for batch in batches:
            for blob in batch.column(0):
                h, _, _ = elements(pk.table_of(blob).column("text").combine_chunks(), words)
                held.append((h >> U64(64 - bits)).astype(np.uint32))
                size += len(h)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                total = counts.setdefault(s, np.zeros(width, np.uint8))
                cells, n = np.unique(gaps_decode(np.frombuffer(blob.as_buffer(), np.uint8)), return_counts=True)
                total[cells] = np.minimum(2, total[cells] + np.minimum(n, 2))
        for s, total in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(total >= 2, bitorder="little").tobytes()], pa.binary())], ["shard", "twice"])

    found = groups.select("blob").mapInArrow(hits, "shard int, blob binary")
    merged = found.repartition(shards, "shard").mapInArrow(merge, "shard int, twice binary")
    twice = np.zeros((1 << bits) // 8, np.uint8)
    for x in merged.toLocalIterator():
        twice[x.shard * width // 8 : (x.shard + 1) * width // 8] = np.frombuffer(x.twice, np.uint8)
    return Seen(twice, bits)


COUNT = np.dtype([("a", "<u8"), ("n", "<u4")])


def frequency_levels(groups: DataFrame, seen, words: int, buckets: int) -> DataFrame:
    """Rows (grp, bucket, blob): a byte for each shingle that the group sent to the bucket, STEPS * log2 of the number of texts that hold it."""

    def send(grp, blob):
        h, _, _ = elements(pk.table_of(blob).column("text").combine_chunks(), words)
        a, n = np.unique(h[seen.value.again(h)], return_counts=True)
        rec = np.empty(len(a), COUNT)
        rec["a"], rec["n"] = a, n
        yield pk.entry_rows(grp, rec, buckets)

    def answer(table: pa.Table) -> pa.Table:
        recs = [np.frombuffer(v.as_buffer(), COUNT) for v in table.column("blob")]
        rec = np.concatenate(recs)
        _, run = np.unique(rec["a"], return_inverse=True)
        df = np.bincount(run, rec["n"])
        level = np.minimum(255, np.round(STEPS * np.log2(df))).astype(np.uint8)[run]
        cuts = np.cumsum([len(r) for r in recs])[:-1]
        return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "blob": pa.array([x.tobytes() for x in np.split(level, cuts)], pa.binary())})

    return pk.by_group(groups, send, pk.ENTRIES).groupBy("bucket").applyInArrow(answer, pk.ENTRIES)


def weight_table(n_texts: int) -> np.ndarray:
    """Weight of an occurrence by level."""
    return 1 + np.maximum(0, 1 - np.arange(256) / STEPS * np.log(2) / np.log(n_texts + 2))


class Icws:
    """Improved consistent weighted sampling; r and c (Gamma(2, 1)) and beta (uniform) are drawn from the hash of shingle and sample."""

    def __init__(self, samples: int):
        self.samples = samples

    @staticmethod
    def uniform(x: np.ndarray, shift: int) -> np.ndarray:
        """24 bits of x as a number in (0, 1)."""
        return (((x >> U64(shift)) & U64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)

    def signatures(self, h: np.ndarray, log_w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row a text: for each sample 32 bits that name the chosen shingle and its level."""
        out = np.zeros((len(starts), self.samples), np.uint32)
        log_w = log_w.astype(np.float32)
        for k in range(self.samples):
            x = mix64(h + U64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
            y = mix64(x + U64(0xD1B54A32D192ED03))
            r = -np.log(self.uniform(x, 0) * self.uniform(x, 24))
            log_c = np.log(-np.log(self.uniform(y, 0) * self.uniform(y, 24)))
            beta = (((x >> U64(48)) ^ (y >> U64(48))).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
            t = np.floor(log_w / r + beta)
            log_a = log_c - r * (t - beta) - r
            bits = log_a.view(np.uint32)
            key = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(U64) << U64(32)  # ordered as the floats are
            name = mix64(x + t.astype(np.int64).view(U64)) & U64(0xFFFFFFFF)
            out[:, k] = (np.minimum.reduceat(key | name, starts) & U64(0xFFFFFFFF)).astype(np.uint32)
        return out


def candidates(groups: DataFrame, levels: DataFrame, seen, n_texts: int, words: int, bands: int, rows: int, threshold: float, buckets: int) -> DataFrame:
    """v, text, levels (a byte for each distinct shingle in order of its hash) and bands (array of long) of the texts that can have a partner."""

    def run(grp, blob, back):
        part = pk.table_of(blob).combine_chunks()
        h, owner, tf = elements(part.column("text").combine_chunks(), words)
        again = seen.value.again(h)
        sent = np.unique(h[again])
        got = np.zeros(len(sent), np.uint8)
        for x, y, v in pk.shares(back, sent, buckets, 0):
            got[x:y] = np.frombuffer(v.as_buffer(), np.uint8)
        level = np.zeros(len(h), np.uint8)
        level[again] = got[np.searchsorted(sent, h[again])]
        w = weight_table(n_texts)[level] * tf
        n = part.num_rows
        keep = np.bincount(owner, w * (level > 0), minlength=n) >= threshold * np.bincount(owner, w, minlength=n) * (1 - 1e-9)
        keep &= np.bincount(owner, minlength=n) > 0
        if not keep.any():
            yield pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.binary(), pa.string(), pa.binary(), pa.list_(pa.int64()))], ["v", "text", "levels", "bands"])
            return
        ok = keep[owner]
        h, w, owner, level = h[ok], w[ok], owner[ok], level[ok]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        sig = Icws(bands * rows).signatures(h, np.log(w), starts)
        at = np.arange(len(sig)) * rows
        band = np.stack([mix64(SpanHash(sig[:, b * rows : (b + 1) * rows].astype(U64).ravel(), 71).spans(at, at + rows) + U64(b)) for b in range(bands)], 1)
        kept = part.filter(pa.array(keep))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * bands), pa.array(band.view(np.int64).ravel()))
        parts = pa.array([x.tobytes() for x in np.split(level, starts[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([kept.column("v").combine_chunks(), kept.column("text").combine_chunks(), parts, lists], ["v", "text", "levels", "bands"])

    return pk.by_group_with(groups, levels, run, "v binary, text string, levels binary, bands array<long>")


def overlaps(doc: np.ndarray, elem: np.ndarray, w: np.ndarray, m: int, dense_from: int = 48, chunk: int = 2048) -> np.ndarray:
    """Weight shared by each two of m documents. ``elem`` is sorted; each document holds an element once.

    Elements of many documents are multiplied as dense blocks, those of few by their pairs.
    """
    out = np.zeros((m, m), np.float32)
    new = np.concatenate(([True], elem[1:] != elem[:-1]))
    first = np.flatnonzero(new)
    df = np.diff(np.append(first, len(elem)))
    run = np.cumsum(new) - 1
    rare = df[run] < dense_from
    e, d, x = elem[rare], doc[rare], w[rare]
    flat = out.reshape(-1)
    for k in range(1, dense_from):
        same = np.flatnonzero(e[k:] == e[:-k])
        if not len(same):
            break
        flat += np.bincount(d[same] * m + d[same + k], x[same], minlength=m * m).astype(np.float32)
    common = np.flatnonzero(df >= dense_from)
    for at in range(0, len(common), chunk):
        part = common[at : at + chunk]
        rows = ranges(first[part], df[part])
        block = np.zeros((m, len(part)), np.float32)
        block[doc[rows], np.repeat(np.arange(len(part)), df[part])] = np.sqrt(w[rows])
        product = block @ block.T
        np.fill_diagonal(product, 0)
        out += np.triu(product)
    return out + out.T


def linked(ids: list[bytes], col: pa.Array, levels: np.ndarray, weights: np.ndarray, words: int, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links of the threshold or more among distinct texts, as stars of what they connect."""
    slack = 1 - 1e-6
    h, owner, tf = elements(col, words)
    w = weights[levels]
    total = np.bincount(owner, w * tf, minlength=len(ids))
    # The k-th occurrence of a shingle is an element of its own, so shared weight is a sum over shared elements.
    nth = ranges(np.zeros(len(tf), np.int64), tf)
    h, owner, w = mix64(np.repeat(h, tf) + nth.astype(U64)), np.repeat(owner, tf), np.repeat(w, tf)
    while True:
        order = np.argsort(h, kind="stable")
        h, owner, w = h[order], owner[order], w[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        df = np.bincount(run) if len(h) else np.zeros(0, np.int64)
        shared = df[run] > 1 if len(h) else np.zeros(0, bool)
        keep = np.bincount(owner, w * shared, minlength=len(ids)) >= threshold * total * slack
        keep &= total > 0
        ok = shared & keep[owner]
        if ok.all():
            break
        h, owner, w = h[ok], owner[ok], w[ok]
    docs = np.flatnonzero(np.bincount(owner, minlength=len(ids)) > 0)
    if len(docs) < 2:
        return []
    local = np.searchsorted(docs, owner)
    both = overlaps(local, h, w, len(docs))
    t = total[docs]
    link = both >= threshold * (t[:, None] + t[None, :] - both) * slack
    label = np.arange(len(docs))
    while True:
        near = np.where(link, label[None, :], len(docs)).min(1)
        after = np.minimum(label, near)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    return [(ids[docs[i]], ids[docs[k]]) for i, k in enumerate(label) if i != k]


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 12, rows: int = 3, max_bits: int = 28, block: int = 256, group_bytes: int = 1 << 20) -> DataFrame:
    """v (MD5 of the text), class_id (the least doc_id of the class; null if all are) and class_v (the v of that document) for every distinct text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("v", F.unhex(F.md5(F.col("text").cast("binary"))))
    groups, size = pk.stored_groups(keyed.groupBy("v").agg(F.first("text").alias("text")), group_bytes, spread=False)
    seen = spark.sparkContext.broadcast(build_sketch(groups, size.bytes, words, max_bits))
    buckets = max(1, size.bytes // (4 << 20))
    levels = stored(frequency_levels(groups, seen, words, buckets), "levels")
    cands = stored(candidates(groups, levels, seen, size.rows, words, bands, rows, threshold, buckets), "candidates")
    weights = weight_table(size.rows)

    def verify(table):
        found = linked(table.column("v").to_pylist(), table.column("text").combine_chunks(), np.frombuffer(b"".join(table.column("levels").to_pylist()), np.uint8), weights, words, threshold)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    def links(members: DataFrame, *key: str) -> DataFrame:
        rows = members.select("v", *key).join(cands.select("v", "text", "levels"), "v")
        return stored(rows.groupBy(*key).applyInArrow(verify, "a binary, b binary"), "links")

    in_band = cands.select("v", F.explode("bands").alias("band"))
    bucket = in_band.groupBy("band").agg(F.min("v").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    in_band = stored(in_band.join(bucket, "band"), "bands")
    # Every text meets the hubs of its bands; a hub of many texts stands in each of their blocks.
    stars = in_band.where("v <> hub").select("hub", "v").distinct()
    hubs = stored(stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "hubs")
    mine = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    own = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"), F.col("hub").alias("v"))
    met = links(stars.join(hubs, "hub").select("hub", mine.alias("k"), "v").unionByName(own), "hub", "k")
    # Bands of several blocks whose texts are not all connected yet: all pairs, block by block.
    parts = components(met)
    wide = in_band.join(hubs.where("blocks > 1").select("hub"), "hub", "left_semi").join(parts, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    apart = wide.groupBy("band", "hub", "n").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum(F.xxhash64("v").cast("decimal(20,0)")).alias("set")).where("x <> y and n > 2")
    apart = stored(apart.groupBy("hub", "n", "set").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "apart")
    if not apart.isEmpty():
        sent = in_band.select("v", "band").join(apart, "band").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.unionByName(links(sent.select("v", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")), "band", "i", "j"))
        parts = components(met)
    named = keyed.groupBy("v").agg(F.min("doc_id").alias("doc_id")).join(parts, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    named = stored(named, "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v"))
    least = named.groupBy("comp").agg(first.alias("first")).select("comp", F.col("first.doc_id").alias("class_id"), F.col("first.v").alias("class_v"))
    return named.join(least, "comp").select("v", "class_id", "class_v")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of each class one row with its least doc_id (nulls last, then least MD5 of the text)."""
    classed = with_class(docs, **options)
    return classed.where(F.expr("_v = class_v and doc_id <=> class_id")).dropDuplicates(["_v"]).select(*docs.columns)


def with_class(docs: DataFrame, **options) -> DataFrame:
    """docs with _v, class_id and class_v; columns of these names give way."""
    classes = stored(near_duplicates(docs, **options).withColumnRenamed("v", "_v"), "near")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.drop("_v", "class_id", "class_v").withColumn("_v", F.unhex(F.md5(text.cast("binary")))).join(classes, "_v")


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_class(docs).select("doc_id", "class_id", F.coalesce(F.col("doc_id") != F.col("class_id"), F.lit(False)).alias("is_duplicate"))

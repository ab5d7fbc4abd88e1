"""Spelling variants: words one edit apart, found by asymmetric chunks, and the frequent form that each rare one stands for.

Counting. Runs of letters are found on flat bytes; those that the rule picks (a CRC-32 of doc_id and run) lose one code point. Distinct
words are counted in slices of some megabytes, so a word that makes up a third of a corpus is shuffled once a slice.

Joining. A word of length L contributes two disjoint chunks, its halves. Any other word contributes its positional grams: the starts and
ends that a word of its own length or of one more could have as halves. One edit leaves a half whole, and the other word has it at the same place
from the start or from the end, so within shift one. The broken half is chunked again: one of its halves is whole too, so words meet on a
chunk and half of the other one, which keeps groups small where many words share a chunk. Four own keys and four grams a word are shuffled and
sorted by key; tasks read sorted rows as a stream and compare only own rows with the rows of their key. Each
pair is counted under one key, the one whose open quarter holds the (leftmost) edit.
A key with over ``hot`` rows is not compared there: its rows go on with one key for each place of the open quarter, so that words meet only if they are near.

Forms have at least ten times the word's count, so chains of forms are as long as the counts have digits, and roots take the logarithm of that in rounds of pointer jumping.

Defined results: null texts have no words; a null doc_id counts as an empty one in the rule; repeated rows count as often as they occur; ties of forms go to the word smallest in
code-point order; an empty table gives an empty one. Runs and words of any length are handled; long texts are read in slices cut between runs. Other columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import SpanHash, flatten, mix64, ranges, row_slices
from .conversation_trie import CRC_TABLE
from .scratch import stored

SLICE = 8 << 20
WIDE = 64
PAIRS = 1 << 19
LETTERS = bytes(1 if chr(b).isalpha() and b < 128 else 2 if b == 0xC3 else 0 for b in range(256))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1)).astype(np.uint32)
    return t


CRC = _crc_table()


def span_crcs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of spans, each continued from the CRC-32 of what comes before it; a byte of all spans at a time, the longest first."""
    order = np.argsort(-lens, kind="stable")
    at, n, reg = starts[order], lens[order], before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for k in range(min(int(n[0]) if len(n) else 0, WIDE)):
        m = int(np.searchsorted(-n, -k, "left"))
        reg[:m] = CRC[(reg[:m] ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (reg[:m] >> np.uint32(8))
    out = np.empty(len(lens), np.uint32)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    for i in order[: int(np.searchsorted(-n, -WIDE, "left"))]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lens[i]].tobytes(), int(before[i]))
    return out


def runs_of(data: np.ndarray, offs: np.ndarray, keys: list[bytes], every: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts laid end to end: Latin-1 bytes and offsets."""
    raw = data.tobytes()
    kinds = np.frombuffer(raw.translate(LETTERS), np.uint8)
    lead = kinds == 2
    inside = kinds != 0
    inside[1:] |= lead[:-1]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate((np.flatnonzero(inside[:1]), edge, [len(inside)] if len(inside) and inside[-1] else [])).astype(np.int64)
    starts, ends = edge[0::2], edge[1::2]
    wide = np.cumsum(lead, dtype=np.int32)
    points = ends - starts - (wide[ends - 1] - wide[starts] + lead[starts])
    some = np.flatnonzero(points >= shortest)
    starts, ends, points = starts[some], ends[some], points[some]
    low = np.frombuffer(raw.translate(LOWER), np.uint8)
    seeds = np.array([zlib.crc32(k) for k in keys], np.uint32)
    h = span_crcs(low, starts, ends - starts, seeds[np.searchsorted(offs, starts, "right") - 1])
    cut = h % np.uint32(every) == 0
    some = np.flatnonzero(~cut | (points > shortest))
    starts, ends, points, cut, h = starts[some], ends[some], points[some], cut[some], h[some]
    mark = np.zeros(len(low) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    use = np.cumsum(mark[:-1], dtype=np.int8).view(bool) & ~lead
    latin = low[use]
    latin[np.concatenate(([False], lead[:-1]))[use]] += np.uint8(0x40)
    first = np.cumsum(points) - points
    keep = np.ones(len(latin), bool)
    hit = np.flatnonzero(cut)
    keep[first[hit] + (h[hit].astype(np.int64) % points[hit])] = False
    return latin[keep], np.concatenate(([0], np.cumsum(points - cut)))


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE bytes that end at an ASCII byte that is no letter."""
    at, ends = 0, np.frombuffer(bytes(1 if b < 128 and not chr(b).isalpha() else 0 for b in range(256)), np.uint8)
    while at < len(data):
        to = min(len(data), at + SLICE)
        while to < len(data) and not ends[data[to - 1]]:
            more = np.flatnonzero(ends[data[to : to + SLICE]])
            to = to + int(more[0]) + 1 if len(more) else min(len(data), to + SLICE)
        yield at, to
        at = to


def words(docs: DataFrame, every: int = 31, shortest: int = 7, least: int = 2) -> DataFrame:
    """word (binary, Latin-1) and n of the words that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in row_slices(batch.column(1), SLICE):
                keys = [f"{k}:".encode() for k in batch.column(0).slice(x, y - x).to_pylist()]
                data, offs = flatten(batch.column(1).slice(x, y - x))
                for a, b in _cuts(data):
                    latin, ends = runs_of(data[a:b], np.clip(offs, a, b) - a, keys, every, shortest)
                    coded = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(latin)]).dictionary_encode()
                    yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))], ["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def quarters(length: np.ndarray) -> np.ndarray:
    """(5, n): where the quarters of words begin, and their ends: the halves of the halves."""
    half = length // 2
    return np.stack([np.zeros_like(length), half // 2, half, half + (length - half) // 2, length])


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a binary column."""
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)


def _key(hashes: SpanHash, starts: np.ndarray, lens: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    """Of what a word of ``length`` keeps before its place a and from b on, where this word may be one shorter."""
    gap = length - lens
    kept = hashes.spans(starts, starts + a) * np.uint64(3) + hashes.spans(starts + b - gap, starts + lens)
    return mix64(kept + mix64((length * 64 + tag).astype(np.uint64))).view(np.int64)


KEYED = "key long, gram boolean, quarter int, word binary, n long"


def _keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Four own rows and four grams of each word."""
    data, starts, lens = _flat(batch.column(0))
    hashes = SpanHash(data, 29)
    for gram in (False, True):
        length = lens + gram
        q = quarters(length)
        for k in range(4):
            key = _key(hashes, starts, lens, q[k], q[k + 1], length, k)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), gram)), pa.array(np.full(len(key), k, np.int32)), *batch.columns], ["key", "gram", "quarter", "word", "n"])


def _edit(s: bytes, t: bytes) -> int:
    """Where t has another code point than s, or first lacks one; -1 if they are not one edit apart (s is as long, or one longer)."""
    a, b = np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)
    if len(a) == len(b):
        d = np.flatnonzero(a != b)
        return int(d[0]) if len(d) == 1 else -1
    d, e = np.flatnonzero(a[:-1] != b), np.flatnonzero(a[1:] != b)
    low, high = int(e[-1]) + 1 if len(e) else 0, int(d[0]) if len(d) else len(b)
    return low if low <= high else -1


NEAR = "word binary, n_near long, form_n long, form binary"


class Comparer:
    """Compares the rows of each key in a stream sorted by key, own rows first."""

    def __init__(self, hot: int, by_place: bool = False):
        self.hot, self.by_place = hot, by_place

    def stream(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        size, passing = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            if passing is not None:  # the rest of a key that is too large
                to = int(np.searchsorted(keys != passing, True))
                if to:
                    yield "hot", batch.slice(0, to)
                batch, keys = batch.slice(to), keys[to:]
                if not len(keys):
                    continue
                passing = None
            last = len(keys) - int(np.argmax((keys != keys[-1])[::-1])) if keys[0] != keys[-1] else 0
            if last == 0 and (not held or held[0].column(0)[0].as_py() == keys[0]):
                held.append(batch)
                size += len(keys)
            else:
                yield from self.compared(held + [batch.slice(0, last)] if last else held)
                held, size = [batch.slice(last)], len(keys) - last
            if size > self.hot:
                yield from (("hot", b) for b in held)
                passing, held, size = held[0].column(0)[0].as_py(), [], 0
        yield from self.compared(held)

    def compared(self, held: list[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        keys, gram, quarter = t["key"].to_numpy(), t["gram"].to_numpy(), t["quarter"].to_numpy()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(keys)))
        big = sizes > self.hot
        for a, n in zip(starts[big], sizes[big]):
            yield "hot", t.slice(a, n).combine_chunks().to_batches()[0]
        partners = np.repeat(starts + sizes, sizes) - np.arange(len(keys)) - 1
        partners[gram | np.repeat(big, sizes)] = 0
        col = t["word"].combine_chunks()
        data, first, lens = _flat(col.chunk(0) if isinstance(col, pa.ChunkedArray) else col)
        counts, ends = t["n"].to_numpy(), np.cumsum(partners)
        at = 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            own = np.repeat(np.arange(at, to), partners[at:to])
            other = ranges(np.arange(at, to) + 1, partners[at:to])
            at = to
            if len(own):
                yield from (("near", b) for b in self.near(data, first, lens, counts, quarter, own, other))

    def near(self, data, first, lens, counts, quarter, own, other) -> Iterator[pa.RecordBatch]:
        long = (lens[own] > WIDE) | (lens[other] > WIDE)
        word = lambda i: data[first[i] : first[i] + lens[i]].tobytes()
        if long.any():
            found = [(i, j) for i, j in zip(own[long].tolist(), other[long].tolist()) if self.here(_edit(word(i), word(j)), lens[i : i + 1], quarter[i : i + 1])[0]]
            both = found + [(j, i) for i, j in found]
            if both:
                yield pa.RecordBatch.from_arrays([pa.array([word(i) for i, _ in both], pa.binary()), pa.array([1] * len(both), pa.int64()), pa.array([int(counts[j]) for _, j in both], pa.int64()), pa.array([word(j) for _, j in both], pa.binary())], ["word", "n_near", "form_n", "form"])
            own, other = own[~long], other[~long]
            if not len(own):
                return
        rows, back = np.unique(np.concatenate((own, other)), return_inverse=True)
        width = int(lens[rows].max()) + 1
        chars = np.zeros((len(rows), width), np.uint8)
        chars[np.repeat(np.arange(len(rows)), lens[rows]), ranges(np.zeros(len(rows), np.int64), lens[rows])] = data[ranges(first[rows], lens[rows])]
        i, j = back[: len(own)], back[len(own) :]
        a, b = chars[i], chars[j]
        differ = a != b
        place = differ.argmax(axis=1)
        same = lens[own] == lens[other]
        ok = same & (np.count_nonzero(differ, axis=1) == 1)
        shift = np.flatnonzero(~same)
        later = a[shift, 1:] != b[shift, :-1]
        low = np.where(later.any(axis=1), width - 1 - later[:, ::-1].argmax(axis=1), 0)
        ok[shift] = low <= place[shift]
        place[shift] = low
        ok &= self.here(place, lens[own], quarter[own])
        i, j = i[ok], j[ok]
        if not len(i):
            return
        who, near = np.concatenate((i, j)), np.concatenate((j, i))
        names = np.ascontiguousarray(chars).view(f"S{width}").ravel()
        n = counts[rows]
        order = np.lexsort((names[near], -n[near], who))
        who, near = who[order], near[order]
        begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(names[who[begin]].tolist(), pa.binary()), pa.array(np.diff(np.append(begin, len(who)))), pa.array(n[near[begin]]), pa.array(names[near[begin]].tolist(), pa.binary())], ["word", "n_near", "form_n", "form"])

    def here(self, place, length: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """Whether an edit at a place of words of a length is counted under this key."""
        place = np.broadcast_to(place, length.shape)
        if self.by_place:
            return place == quarter
        q = quarters(length)
        at = np.arange(len(length))
        return (q[quarter, at] <= place) & (place < q[quarter + 1, at])


def _by_place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of large keys again, with a key for each place of the open quarter; ``quarter`` becomes that place."""
    data, starts, lens = _flat(batch.column(3))
    length = lens + batch.column(1).to_numpy(zero_copy_only=False)
    q, quarter, at = quarters(length), batch.column(2).to_numpy(), np.arange(len(lens))
    begin, n = q[quarter, at], q[quarter + 1, at] - q[quarter, at]
    row, place = np.repeat(at, n), ranges(begin, n)
    key = _key(SpanHash(data, 29), starts[row], lens[row], place, place + 1, length[row], 4)
    key = mix64(key.view(np.uint64) + place.astype(np.uint64)).view(np.int64)
    again = batch.take(pa.array(row))
    yield pa.RecordBatch.from_arrays([pa.array(key), again.column(1), pa.array(place.astype(np.int32)), again.column(3), again.column(4)], ["key", "gram", "quarter", "word", "n"])


def near_words(counted: DataFrame, n_words: int, hot: int = 4096, rows_a_task: int = 1_000_000) -> DataFrame:
    """word, n_near, form_n and form: how many words are one edit away, and of them the one of largest n (ties: smallest). Words with none have no row."""
    spark = counted.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-8 * n_words // rows_a_task))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _keys(batch)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, batch in Comparer(hot).stream(batches):
            n = batch.num_rows
            if kind == "near":
                columns = [pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int32()), *batch.columns]
            else:
                columns = [batch.column(1), batch.column(2), batch.column(3), pa.nulls(n, pa.int64()), batch.column(4), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "quarter", "word", "n_near", "form_n", "form"])

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 2000):
                yield from _by_place(batch.slice(x, 2000))

    def compare_finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in Comparer(1 << 62, by_place=True).stream(batches):
            yield batch

    rows = counted.select("word", "n").mapInArrow(keyed, KEYED).repartition(tasks, "key").sortWithinPartitions("key", "gram")
    first = stored(rows.mapInArrow(compare, "gram boolean, quarter int, " + NEAR), "spelling-near")
    found = first.where("n_near is not null").select("word", "n_near", "form_n", "form")
    left = first.where("n_near is null")
    if not left.isEmpty():
        again = left.select(F.lit(0).cast("long").alias("key"), "gram", "quarter", "word", F.col("form_n").alias("n")).mapInArrow(finer, KEYED)
        found = found.unionByName(again.repartition(tasks, "key").sortWithinPartitions("key", "gram").mapInArrow(compare_finer, NEAR))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """word and root of words with a form; each form has ``times`` its word's n, at least 2, and none has over ``most``."""
    found = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    longest, n = 1, 2 * times * times
    while n <= most:
        longest, n = longest + 1, n * times
    reached = 1
    while reached < longest:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = stored(found.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        reached *= 2
    return found


def spelling_variants(docs: DataFrame, every: int = 31, shortest: int = 7, least: int = 2, times: int = 10, hot: int = 4096) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word."""
    counted = stored(words(docs, every, shortest, least), "spelling-words")
    size = counted.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    near = near_words(counted, size["words"], hot)
    formed = F.col("form_n") >= times * F.col("n")
    joined = stored(counted.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n"), F.when(formed, F.col("form")).alias("form")), "spelling-joined")
    rooted = roots(joined.where("form is not null"), size["most"], times)
    text = lambda c: F.decode(c, "ISO-8859-1")
    return joined.join(rooted, "word", "left").select(text(F.col("word")).alias("word"), text(F.col("form")).alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
a AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
b AS (SELECT d, w, count(*) AS n FROM a WHERE length(w) >= 7 GROUP BY 1, 2),
c AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(d || w, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [195, CAST(ord(ch) AS BIGINT) - 64] END))),
  lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM b, crc_table),
e AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
p AS (SELECT word, n, i, left(word, CAST(i - 1 AS INTEGER)) AS x, substr(word, CAST(i + 1 AS INTEGER)) AS y FROM v, unnest(range(1, length(word) + 1)) u(i)),
k AS (SELECT p.word, q.word AS near, q.n AS near_n FROM p JOIN p q ON p.i = q.i AND p.x = q.x AND p.y = q.y AND p.word <> q.word),
s AS (SELECT DISTINCT p.word AS a, p.n AS a_n, v.word AS b, v.n AS b_n FROM p JOIN v ON v.word = p.x || p.y),
m AS (SELECT word, near, near_n FROM k UNION ALL SELECT a, b, b_n FROM s UNION ALL SELECT b, a, a_n FROM s),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS form_n FROM m GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.form_n >= 10 * v.n THEN g.form_n END AS form_n,
  CASE WHEN g.form_n >= 10 * v.n THEN (SELECT min(near) FROM m WHERE m.word = v.word AND m.near_n = g.form_n) END AS form FROM v LEFT JOIN g ON g.word = v.word),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
z AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, f.form, z.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN z ON z.word = f.word
"""

"""The prefix trie of rebuilt conversations, from composable fingerprints.

A conversation is rebuilt from the first turns of its family's base and its own later turns. No rebuilt text is put together: a sequence
of turns has a fingerprint (length, hash), and fingerprints multiply, (k, a) (m, b) = (k + m, a M^m + b), with four primes of 31 bits. Turns are
sorted once by ranges; each task multiplies along its part of a conversation, and what parts of one conversation need from the parts
before them is one factor a part. If a conversation keeps its own turns after the h-th, and the base's head has the product B, the prefix with m own turns is
B O^-1 P, where P is its own original prefix and O its first h turns: (B - O) M^m + P, one number a conversation.

A node is a group of equal (depth, fingerprint). Every group is verified: the turns that it stands for (references to
original turns, whose role and text are read where they are stored) must be equal, and so must their parents' fingerprints; by induction
the prefixes are then equal. Should a group fail, all is computed again with other multipliers, so the result is exact.

Sums over subtrees need no recursion. A node stands once at its smallest member, so the sum below a node is the sum of its members'
sums along their own path; along a path it is a running sum, taken in blocks. Only nodes with two members or more take part: below any other
there is one leaf and nothing to save.

A node's conversations that end there are hashed in order of their ids, sorted across tasks and put together in pieces of bounded size; the hash itself is sequential.

Defined results: null roles and texts are empty; turns of a conversation with equal (or null) numbers follow in order of the MD5 of role
and text, repeated rows count as turns; rows without conv_id belong to no conversation and are left out; an empty table has no nodes. Other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Primes under 2^31: products of two residues fit 62 bits.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.int64)
KEY = ["depth", "fa", "fb"]
BLOCK = 1024
PIECE = 1 << 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def multipliers(seed: int) -> np.ndarray:
    raw = np.frombuffer(hashlib.blake2b(f"turns {seed}".encode(), digest_size=32).digest(), "<u8")
    return (raw % (PRIMES - 1000).astype(np.uint64)).astype(np.int64) + 500


def power(base: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """(4, n): base ** exponents, modulo each prime."""
    out, b, e = np.ones((4, len(exponents)), np.int64), base.copy(), np.maximum(exponents, 0).astype(np.int64)
    while e.any():
        odd = np.flatnonzero(e & 1)
        out[:, odd] = out[:, odd] * b[:, None] % PRIMES[:, None]
        b, e = b * b % PRIMES, e >> 1
    return out


def packed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h[0] << 31 | h[1], h[2] << 31 | h[3]


def unpacked(fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    low = (1 << 31) - 1
    return np.stack([fa >> 31, fa & low, fb >> 31, fb & low])


def product(left: np.ndarray, right: np.ndarray, length: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """The hash of left followed by right, which has ``length`` turns."""
    return (left * power(mult, length) + right) % PRIMES[:, None]


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _scan(ordered: DataFrame, seed: int) -> DataFrame:
    """Adds to turns in order: part, at (position in this part of the conversation, from 1), and the products before (pa, pb) and with (fa, fb) the turn, within the part."""
    mult = multipliers(seed)
    inverse = np.array([pow(int(m), -1, int(p)) for m, p in zip(mult, PRIMES)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, held, before = TaskContext.get().partitionId(), None, 0, np.zeros((4, 1), np.int64)
        key = f"turn {seed}".encode()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            convs = batch.column(0).to_numpy()
            raw = b"".join(hashlib.blake2b(len(r.encode()).to_bytes(8, "little") + r.encode() + t.encode(), digest_size=32, key=key).digest() for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            g = (np.frombuffer(raw, "<u8").reshape(n, 4).T % PRIMES[:, None].astype(np.uint64)).astype(np.int64)
            index = np.arange(n)
            sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(g * power(inverse, index) % PRIMES[:, None], axis=1)], axis=1)
            new = np.ones(n, bool)
            new[1:] = convs[1:] != convs[:-1]
            first = np.maximum.accumulate(np.where(new, index, 0))
            inside = (sums[:, 1:] - sums[:, first]) % PRIMES[:, None] * power(mult, index) % PRIMES[:, None]
            at = index - first + 1
            if convs[0] == conv:
                lead = int(np.searchsorted(first, 1)) if first[-1] else n
                inside[:, :lead] = product(np.repeat(before, lead, 1), inside[:, :lead], at[:lead], mult)
                at[:lead] += held
            prior = np.concatenate([before, inside[:, :-1]], axis=1)
            prior[:, at == 1] = 0
            conv, held, before = convs[-1], int(at[-1]), inside[:, -1:]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(at.astype(np.int64)), *map(pa.array, packed(prior)), *map(pa.array, packed(inside))], [*batch.schema.names, "part", "at", "pa", "pb", "fa", "fb"])

    return ordered.mapInArrow(run, "conv_id long, role string, text string, part long, at long, pa long, pb long, fa long, fb long")


def fingerprinted(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """conv_id, role, text, pos (from 1), and the products of the conversation's turns before (pa, pb) and up to (fa, fb) each."""
    spark = conversations.sparkSession
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie"), F.col("_row")]
    ordered = turns.withColumn("tie", F.concat(F.md5("role"), F.md5("text"))).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(_scan(ordered.select("conv_id", "role", "text"), seed), "trie-turns")
    # A conversation that goes on in later parts is the last of one part and the first of the next; a row a part.
    bounds = sorted((r["part"], r["low"], r["high"]) for r in parts.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).collect())
    across = sorted({a[2] for a, b in zip(bounds, bounds[1:]) if a[2] == b[1]})
    carried: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    mult = multipliers(seed)
    if across:
        found = parts.where(F.col("conv_id").isin(across)).groupBy("conv_id", "part").agg(F.max(F.struct("at", "fa", "fb")).alias("end"))
        at: dict[int, tuple[int, np.ndarray]] = {}
        for r in sorted(found.collect(), key=lambda r: (r["conv_id"], r["part"])):  # two rows a part at most
            n, h = at.get(r["conv_id"], (0, np.zeros((4, 1), np.int64)))
            if n:
                carried[r["part"], r["conv_id"]] = n, h
            end = r["end"]
            at[r["conv_id"]] = n + end["at"], product(h, unpacked(np.array([end["fa"]]), np.array([end["fb"]])), np.array([end["at"]]), mult)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, part, at, a0, b0, a1, b1 = _numbers(batch, "conv_id", "part", "at", "pa", "pb", "fa", "fb")
            pos, prior, inside = at.copy(), unpacked(a0, b0), unpacked(a1, b1)
            for k in sorted(set(zip(part.tolist(), convs.tolist())) & set(carried)) if carried else ():
                n, h = carried[k]
                here = np.flatnonzero((part == k[0]) & (convs == k[1]))
                old = np.repeat(h, len(here), 1)
                prior[:, here] = product(old, prior[:, here], at[here] - 1, mult)
                inside[:, here] = product(old, inside[:, here], at[here], mult)
                pos[here] += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pos), *map(pa.array, packed(prior)), *map(pa.array, packed(inside))], ["conv_id", "role", "text", "pos", "pa", "pb", "fa", "fb"])

    return parts.mapInArrow(run, "conv_id long, role string, text string, pos long, pa long, pb long, fa long, fb long") if carried else parts.drop("part").withColumnRenamed("at", "pos")


def head_length(conv_id: Column, most: int = 9) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % most


def rebuilt(turns: DataFrame, seed: int = 0, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The references: original turns that stand in rebuilt conversations (conv_id, pos, depth, fingerprints; kept: among the conversation's own later turns),
    and the prefixes of all rebuilt conversations (conv_id, depth from 0, fingerprints of prefix and parent, bytes of the last turn, last)."""
    mult = multipliers(seed)
    turns = turns.withColumn("bytes", F.octet_length("text").cast("long")).drop("role", "text")
    h = head_length(F.col("conv_id"), most)
    at_h = F.when(F.col("pos") == h, F.struct("fa", "fb"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max(at_h).alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "pa", "pb", "fa", "fb", "bytes"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce(F.size("head"), F.lit(0))).cast("long"))
    convs = convs.withColumn("size", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).withColumn("kept_head", F.when(F.col("taken") > 0, F.col("head")[(F.col("taken") - 1).cast("int")]))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    convs = stored(convs.select("conv_id", "base", "h", "taken", "size", "head", zero(F.col("kept_head.fa")).alias("ba"), zero(F.col("kept_head.fb")).alias("bb"), zero(F.col("own.fa")).alias("oa"), zero(F.col("own.fb")).alias("ob")), "trie-conversations")

    used = turns.join(convs.drop("head"), "conv_id").where("pos > h or conv_id = base").withColumn("kept", F.expr("pos > h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, h, taken, kept, base = _numbers(batch, "pos", "h", "taken", "kept", "ours")
            a0, b0, a1, b1, ba, bb, oa, ob = _numbers(batch, "pa", "pb", "fa", "fb", "ba", "bb", "oa", "ob")
            change = (unpacked(ba, bb) - unpacked(oa, ob)) % PRIMES[:, None]
            change[:, base] = 0  # a base is rebuilt as it was
            prior = (unpacked(a0, b0) + change * power(mult, pos - 1 - h)) % PRIMES[:, None]
            here = (unpacked(a1, b1) + change * power(mult, pos - h)) % PRIMES[:, None]
            depth = np.where(base, pos, taken + pos - h)
            conv, size, octets = _numbers(batch, "conv_id", "size", "bytes")
            yield pa.RecordBatch.from_arrays([*map(pa.array, (conv, pos, depth, kept, *packed(prior), *packed(here), octets, depth == size))], ["conv_id", "pos", "depth", "kept", "pa", "pb", "fa", "fb", "bytes", "last"])

    references = used.withColumn("ours", F.expr("conv_id = base")).mapInArrow(run, "conv_id long, pos long, depth long, kept boolean, pa long, pb long, fa long, fb long, bytes long, last boolean")
    references = stored(references, "trie-references")
    columns = ["conv_id", "depth", "pa", "pb", "fa", "fb", "bytes", "last"]
    own = references.where("kept").select(columns)
    head = convs.select("conv_id", "size", F.explode(F.expr("slice(head, 1, cast(taken as int))")).alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.pa", "t.pb", "t.fa", "t.fb", "t.bytes", (F.col("t.pos") == F.col("size")).alias("last"))
    nothing = [F.lit(0).cast("long").alias(c) for c in columns[1:7]]
    root = convs.select("conv_id", *nothing, (F.col("size") == 0).alias("last"))
    return references, stored(own.unionByName(head).unionByName(root), "trie-prefixes")


def unequal(turns: DataFrame, references: DataFrame) -> bool:
    """Whether any group of equal fingerprints stands for different turns, or has different parents."""
    ends = lambda c: F.min(c) != F.max(c)
    read = references.select("conv_id", "pos", *KEY, "pa", "pb").join(turns.select("conv_id", "pos", "role", "text"), ["conv_id", "pos"])
    return not read.groupBy(*KEY).agg(ends("role").alias("a"), ends("text").alias("b"), ends("pa").alias("c"), ends("pb").alias("d")).where("a or b or c or d").isEmpty()


def _ends(prefixes: DataFrame) -> DataFrame:
    """The SHA-256 of the ids, ascending and joined by commas, of the conversations that end at each node."""
    order = [*KEY, "conv_id"]
    ordered = prefixes.where("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {}
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                out.setdefault(tuple(key), []).append(conv)
            rows = [(*key, ids[x], ",".join(map(str, ids[x : x + (PIECE >> 5)]))) for key, ids in out.items() for x in range(0, len(ids), PIECE >> 5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])], [*order, "ids"]) if rows else pa.RecordBatch.from_pydict({c: [] for c in [*order, "ids"]})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for *this, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if this != key:
                    if state is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = this, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*KEY, "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], [*KEY, "ends_sha256"])

    made = ordered.mapInArrow(pieces, "depth long, fa long, fb long, conv_id long, ids string")
    return made.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(hashed, "depth long, fa long, fb long, ends_sha256 string")


def trie(prefixes: DataFrame) -> DataFrame:
    """A row a node."""
    nodes = prefixes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = stored(nodes, "trie-nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")]
    kids = nodes.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"), F.sum(F.expr("if(n_convs = 1, 1L, 0L)")).alias("alone"))
    nodes = stored(nodes.join(kids, KEY, "left").fillna(0, ["n_children", "alone"]), "trie-nodes")

    weights = [F.expr("(n_convs - 1) * bytes").alias("saved"), F.expr("alone + if(n_children = 0, 1, 0)").alias("leaves")]
    shared = stored(nodes.where("n_convs > 1").select(*KEY, F.col("conv_id").alias("smallest"), *weights), "trie-shared")
    whole = shared.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).first()
    # Each weight stands at the node's smallest member; sums run up its path, in blocks of depths.
    paths = prefixes.where("depth > 0").select(*KEY, "conv_id").join(shared, KEY).select(*KEY, "conv_id", F.floor(F.col("depth") / BLOCK).alias("block"), *[F.expr(f"if(conv_id = smallest, {c}, 0L)").alias(c) for c in ("saved", "leaves")])
    paths = stored(paths, "trie-paths")
    blocks = paths.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.sum("saved").over(later).alias("saved_later"), F.sum("leaves").over(later).alias("leaves_later")).where("saved_later > 0 or leaves_later > 0")
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    paths = paths.select(*KEY, "conv_id", "block", F.sum("saved").over(down).alias("saved"), F.sum("leaves").over(down).alias("leaves")).join(blocks, ["conv_id", "block"], "left")
    sums = paths.groupBy(*KEY).agg(F.sum(F.expr("saved + coalesce(saved_later, 0)")).alias("saved"), F.sum(F.expr("leaves + coalesce(leaves_later, 0)")).alias("leaves"))

    root = F.col("depth") == 0
    parents = nodes.select(*[F.col(c).alias(f"p_{c}") for c in KEY], F.col("conv_id").alias("parent_conv_id"))
    found = stored(nodes.where("depth > 0").join(parents, F.expr("p_depth = depth - 1 and p_fa = pa and p_fb = pb")).select(*KEY, "parent_conv_id"), "trie-parents")
    out = nodes.join(sums, KEY, "left").join(found, KEY, "left").join(_ends(prefixes), KEY, "left")
    alone = F.col("n_convs") == 1
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(alone, F.lit(1)).when(root, F.lit(whole["leaves"] or 0)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.when(alone, F.lit(0)).when(root, F.lit(whole["saved"] or 0)).otherwise(F.col("saved")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """The trie of conversations rebuilt with heads of less than ``most`` turns from the base of each ``family`` ids."""
    seed = 0
    while True:
        turns = fingerprinted(conversations, seed)
        references, prefixes = rebuilt(turns, seed, family, most)
        if not unequal(turns, references):
            return trie(prefixes)
        seed += 1


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 of a text of ASCII characters: the table by its rule, then a byte at a time.
CRC_TABLE = "crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"

OP12_SQL = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY pos) AS xs FROM t GROUP BY 1),
k AS (SELECT conv_id, xs, conv_id - conv_id % 5 AS base, {CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM o, crc_table),
r AS (SELECT k.conv_id, list_concat(coalesce(b.xs, [])[1:h], k.xs[h + 1:]) AS ys FROM k LEFT JOIN o b ON b.conv_id = k.base),
p AS (SELECT conv_id, d AS depth, ys[1:d] AS prefix, ys[1:d - 1] AS parent, CASE WHEN d > 0 THEN octet_length(encode(ys[d].text)) ELSE 0 END AS n, d = len(ys) AS ends FROM r, unnest(range(len(ys) + 1)) u(d)),
g AS (SELECT depth, prefix, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
c AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1, 2),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children, q.conv_id AS parent_conv_id FROM g LEFT JOIN c ON c.depth = g.depth AND c.prefix = g.prefix LEFT JOIN g q ON q.depth = g.depth - 1 AND q.prefix = g.parent),
s AS (SELECT d AS depth, prefix[1:d] AS prefix, sum((n_convs - 1) * n) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM v, unnest(range(depth + 1)) u(d) GROUP BY 1, 2)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, v.parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.prefix = v.prefix
"""

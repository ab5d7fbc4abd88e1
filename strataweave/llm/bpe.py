"""Byte-level BPE encoding and decoding with tree concatenation of long texts.

Texts up to ``long_bytes`` are encoded whole. Longer ones are cut into pieces that are
rows of their own, so tasks share one text: cuts are made where the pre-tokenizer always ends a token
(a letter or digit before another kind of character, or anything before white space), and
pieces between such cuts simply follow one another. Text that no such cut
splits (a long run of one kind) is halved until its parts are short; the parts are encoded
apart and joined pairwise, as a tree: a window of tokens around the join is encoded again, twice as
wide each time, until its first and last tokens are those that both sides had. A BPE sequence is right if each two
neighbours are, so the join is then exact.

Defined results: null and empty texts encode as no tokens. Rows are encoded each for itself, so repeated rows and equal or null
ids give as many rows. An empty table gives an empty one. Special tokens' strings in a text become their ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE_CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")
PIECES = regex.compile(PATTERN)


def _byte_chars() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items()}
        for i, m in enumerate(spec["model"]["merges"]):
            if vocab["".join(m.split(" ") if isinstance(m, str) else m)] != 256 + i:
                raise ValueError("token ids must follow the order of the merges")
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.size = np.zeros(1 + max([*ranks.values(), *self.special.values()]), np.int64)
        for b, i in ranks.items():
            self.size[i] = len(b)

    def split_special(self, text: str) -> Iterator[tuple[bool, str]]:
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield False, text[at : m.start()]
            yield True, m.group()
            at = m.end()
        yield False, text[at:]

    def encode(self, text: str) -> list[int]:
        if not any(s in text for s in self.special):
            return self.enc.encode_ordinary(text)
        out: list[int] = []
        for special, part in self.split_special(text):
            out += [self.special[part]] if special else self.enc.encode_ordinary(part)
        return out

    def run(self, part: bytes) -> list[int]:
        """Part of one pre-token: plain BPE."""
        return self.enc._encode_single_piece(part)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring parts of one pre-token."""
        if not left or not right:
            return left or right
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.run(self.enc.decode_bytes(left[i:] + right[:j]))
            if (i == 0 or window[:1] == left[i : i + 1]) and (j == len(right) or window[-1:] == right[j - 1 : j]):
                return left[:i] + window + right[j:]
            k *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def pieces(self, text: str, leaf: int) -> Iterator[tuple[int, bytes]]:
        """(run number or -1, piece) in order; pieces of one run are parts of one pre-token, special tokens have -2."""
        run = 0
        for special, part in self.split_special(text):
            if special:
                yield -2, part.encode()
                continue
            at = 0
            while at < len(part):
                if len(part) - at <= leaf:
                    yield -1, part[at:].encode()
                    break
                end = next((m.start() for m in SAFE_CUT.finditer(part, at + leaf // 2, at + leaf) if m.start() > at + leaf // 2), None)
                if end is not None:
                    yield -1, part[at:end].encode()
                    at = end
                    continue
                stop = next((m.start() for m in SAFE_CUT.finditer(part, at + leaf // 2) if m.start() > at), len(part))
                for m in PIECES.finditer(part[at:stop]):
                    whole = m.group().encode()
                    if len(whole) <= leaf:
                        yield -1, whole
                    else:
                        n = -(-len(whole) // (leaf // 2))
                        cuts = [len(whole) * i // n for i in range(n + 1)]
                        for a, b in zip(cuts, cuts[1:]):
                            yield run, whole[a:b]
                        run += 1
                at = stop

    def encode_piece(self, run: int, piece: bytes) -> list[int]:
        if run == -2:
            return [self.special[piece.decode()]]
        return self.run(piece) if run >= 0 else self.enc.encode_ordinary(piece.decode())

    def assemble(self, runs: list[int], parts: list[list[int]]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(runs):
            to = at + 1
            while runs[at] >= 0 and to < len(runs) and runs[to] == runs[at]:
                to += 1
            out += self.join_all(parts[at:to])
            at = to
        return out

    def encode_tree(self, text: str, leaf: int) -> list[int]:
        """What the distributed encoding of a long text does, in one place."""
        got = list(self.pieces(text, leaf))
        return self.assemble([r for r, _ in got], [self.encode_piece(r, p) for r, p in got])

    def decode(self, ids: list[int]) -> str:
        return self.enc.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def packed_ids(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def bpe_encode(docs: DataFrame, path: str, long_bytes: int = 1 << 15, leaf_chars: int = 1 << 13) -> DataFrame:
    """Adds n_tokens (long) and ids (binary, little-endian unsigned 32-bit integers); columns of these names and _uid give way."""
    docs = docs.drop("n_tokens", "ids", "_uid")
    names, text_at = list(docs.columns), docs.columns.index("text")
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + ["n_tokens long", "ids binary"])
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [c.encode(t or "") for t in part.column(text_at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(i) for i in ids], pa.int64()), pa.array(map(packed_ids, ids), pa.binary())], [*names, "n_tokens", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = list(c.pieces(text, leaf_chars))
                k = len(got)
                yield pa.RecordBatch.from_arrays([pa.array([key] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([r for r, _ in got], pa.int32()), pa.array([p for _, p in got], pa.binary())], ["uid", "seq", "run", "piece"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [packed_ids(c.encode_piece(r, p)) for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["uid", "seq", "run", "ids"])

    def put_together(key, table):
        t = table.sort_by("seq")
        parts = [np.frombuffer(b, "<u4").tolist() for b in t.column("ids").to_pylist()]
        ids = codec(path).assemble(t.column("run").to_pylist(), parts)
        return pa.table({"uid": pa.array([key[0].as_py()], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "ids": pa.array([packed_ids(ids)], pa.binary())})

    short = docs.where(~is_long).mapInArrow(whole, schema)
    # Numbered once and stored: both the pieces and the join back read the same numbers.
    long_docs = stored(docs.where(is_long).withColumn("_uid", F.monotonically_increasing_id()), "long-texts")
    pieces = long_docs.select(F.col("_uid").alias("uid"), "text").mapInArrow(cut, "uid long, seq int, run int, piece binary")
    encoded = pieces.repartition("uid", "seq").mapInArrow(encode, "uid long, seq int, run int, ids binary")
    joined = encoded.groupBy("uid").applyInArrow(put_together, "uid long, n_tokens long, ids binary")
    return short.unionByName(long_docs.join(joined.withColumnRenamed("uid", "_uid"), "_uid").drop("_uid"))


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds decoded (string), from ids as ``bpe_encode`` gives them; null ids decode as the empty text."""
    encoded = encoded.drop("decoded")
    names, at = list(encoded.columns), encoded.columns.index("ids")
    schema = ", ".join([f"`{n}` {t}" for n, t in encoded.dtypes] + ["decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [c.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = bpe_encode(docs, path).drop("text")
    return bpe_decode(encoded, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Vectorised helpers on flat UTF-8 buffers, used inside Arrow tasks.

Texts of a batch are laid end to end, each followed by one space, so words and
document borders fall out of one byte mask. Span hashes come from prefix sums of
``T[byte] * M**i`` (mod 2**64, M odd and so invertible): any span costs two gathers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEP = np.zeros(256, dtype=bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _odd(seed: int) -> int:
    return int(mix64(np.array([seed + 0x9E3779B97F4A7C15], dtype=U64))[0]) | 1


MULTIPLIER = _odd(17)
_held: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``M**i`` and ``M**-i`` for i in [0, n); one table a process, grown as needed."""
    if n > len(_held[0]):
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _held[k] = np.cumprod(p, dtype=U64)
    return _held[0][:n], _held[1][:n]


@lru_cache(maxsize=8)
def byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 7919 + 1))


class SpanHash:
    """64-bit hashes of spans of one sequence (bytes, or 64-bit item hashes)."""

    def __init__(self, items: np.ndarray, seed: int):
        up, self._down = powers(len(items) + 1)
        vals = byte_table(seed)[items] if items.dtype == np.uint8 else mix64(items + U64(seed))
        self._sum = np.zeros(len(items) + 1, dtype=U64)
        np.cumsum(vals * up[: len(items)], dtype=U64, out=self._sum[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self._sum[ends] - self._sum[starts]) * self._down[starts] + (ends - starts).astype(U64))


def flatten(col: pa.Array, sep: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """The texts of a column (null: empty), each followed by ``sep``: bytes and the n+1 start offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if sep:
        col = pc.binary_join_element_wise(col, pa.scalar("", pa.large_string()), pa.scalar(sep, pa.large_string()))
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per text, the index of its first word (n+1)."""
    inside = ~SEP[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start+1, ... (count of them) for each pair, laid end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - firsts, counts)


def row_slices(col: pa.Array, max_bytes: int):
    """Row ranges of about max_bytes of text each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield at, to
        at = to

"""Pairs of texts one of which holds the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_parts(wholes: DataFrame, whole: str, parts: DataFrame, part: str, block: int = 1000) -> DataFrame:
    """The distinct pairs of texts where that of ``wholes`` holds that of ``parts``, by an equi-join; empty texts are in none.

    Each whole is cut into its parts of those lengths that texts on the other side have, not into all its parts: a text of n characters
    gives at most n parts a length. The lengths are read from the data first and taken ``block`` at a time, which bounds the parts that a row holds at once.
    """
    x, y = wholes.select(whole).where(F.col(whole) != "").distinct(), parts.select(part).where(F.col(part) != "").distinct()
    lengths = [r[0] for r in y.select(F.length(part)).distinct().orderBy(F.length(part)).collect()]
    out = x.select(whole, F.lit(None).cast("string").alias(part)).limit(0)
    for at in range(0, len(lengths), block):
        known = F.filter(F.lit(lengths[at : at + block]), lambda k: k <= F.length(whole))
        pieces = F.flatten(F.transform(known, lambda k: F.transform(F.sequence(F.lit(1), F.length(whole) - k + 1), lambda i: F.substr(F.col(whole), i, k))))
        found = x.select(whole, F.explode(F.array_distinct(pieces)).alias(part)).join(y, part).select(whole, part)
        out = found if at == 0 else out.unionByName(found)
    return out


def holding_pairs(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """The distinct pairs of texts (columns a of left and b of right) where one holds the other; empty texts are in none."""
    return held_parts(left, a, right, b).select(a, b).unionByName(held_parts(right, b, left, a).select(a, b)).distinct()

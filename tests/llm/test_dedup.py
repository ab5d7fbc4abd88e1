"""Substring, suffix and near-duplicate removal against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.llm.minhash_dedup import STEPS, Icws, near_duplicates, one_of_each, weight_table, with_class
from strataweave.llm.substring_dedup import dedup_substrings, gaps_decode, gaps_encode
from strataweave.llm.suffix_dedup import repeated_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark, words):
    base, passage = words(1, 300), words(2, 120)
    rows = [(1, base), (2, base), (3, words(3, 50) + " " + passage), (4, passage + "\n" + words(4, 40)), (5, words(5, 200)), (6, None), (7, ""), (8, "éö ß " * 200), (9, "a" * 5000), (11, words(8, 9000)), (12, "x " + words(8, 9000)), (10, words(2, 80) + " x " + words(2, 80))]
    rows += [(20 + i, words(2, 30) + f" tail{i} " + words(30 + i, 20)) for i in range(40)] + [(None, base), (5, words(5, 200)), (99, words(9, 12)), (100, words(9, 13)), (101, words(9, 13))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


def test_gap_code():
    import numpy as np

    cells = np.sort(np.array([0, 0, 3, 254, 255, 256, 511, 70_000, 70_000, 1_000_000]))
    assert gaps_decode(np.frombuffer(gaps_encode(cells), np.uint8)).tolist() == cells.tolist()


@pytest.mark.parametrize("max_bits, group_bytes", [(28, 1 << 20), (4, 700)])
def test_substrings(docs, max_bits, group_bytes):
    check_substrings(*docs, max_bits=max_bits, group_bytes=group_bytes)


def same_ids(rows, kind):
    """The rows with one doc_id for all, two far apart, or none."""
    return [({"one": 7, "far": (-(1 << 61), 1 << 61)[i % 2], "none": None}[kind], t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("kind", ["one", "far", "none"])
def test_repeated_ids(spark, docs, kind):
    rows = same_ids(docs[1], kind)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_substrings(df, rows, group_bytes=900)
    check_suffixes(df, rows, group_bytes=900, hot_groups=2)


def check_substrings(df, rows, **options):
    big = 1 << 62
    split = [(big if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(d, first.get(k, big))
    want = Counter()
    for (d, w), (real, _) in zip(split, rows):
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < d:
                gone[j : j + 13] = [True] * 13
        want[real, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    got = Counter(tuple(r) for r in dedup_substrings(df, **options).collect())
    assert got == want


@pytest.mark.parametrize("group_bytes, hot_groups", [(1 << 20, 64), (900, 64), (900, 0), (900, 2)])
def test_suffixes(docs, group_bytes, hot_groups):
    check_suffixes(*docs, group_bytes=group_bytes, hot_groups=hot_groups)


def check_suffixes(df, rows, **options):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + 400] for _, b in raw for i in range(len(b) - 399))
    want = Counter()
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        runs = re.findall(b"\1+", bytes(gone))
        want[d, len(b), sum(gone), len(runs), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    out = repeated_bytes(df, **options)
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == want
    assert all(len(r.starts) == r.n_spans and sum(r.ends) - sum(r.starts) == r.n_removed for r in out.collect())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(empty).count() == 0
    assert repeated_bytes(empty).count() == 0
    assert near_duplicates(empty).count() == 0


def variant(text: str, *at: int) -> str:
    w = text.split()
    for i in at:
        w[i] = f"other{i}"
    return " ".join(w)


def test_near_duplicates(spark, words):
    a, b = words(11, 400), words(12, 400)
    rows = [(1, a), (2, variant(a, 200)), (3, variant(a, 100)), (4, a), (5, b), (6, variant(b, *range(0, 400, 9))), (7, words(13, 400)), (8, None), (9, ""), (10, "one two"), (11, "one two"), (12, "one two three"), (None, a), (4, a)]
    rows += [(100 + i, variant(b, 10 + i)) for i in range(120)]  # a large group of near copies, over several blocks
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, class_id string, n_chars long")
    got = {r.doc_id: r.class_id for r in with_class(df.drop("class_id"), block=16).collect()}
    assert got[1] == got[2] == got[3] == got[4] == got[None] == 1
    assert got[5] == 5 and all(got[100 + i] == 5 for i in range(120))
    assert [got[k] for k in (6, 7, 8, 9, 10, 11, 12)] == [6, 7, 8, 8, 10, 10, 12]
    left = one_of_each(df, block=16)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 5, 6, 7, 8, 10, 12]


def plain_classes(texts, threshold=0.8):
    """Classes over all pairs by exact weighted Jaccard similarity, with document frequencies over distinct texts."""
    bags = {t: Counter(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in set(texts)}
    df = Counter(s for bag in bags.values() for s in bag)
    table = weight_table(len(bags))
    w = {s: table[min(255, round(STEPS * math.log2(n)))] for s, n in df.items()}
    weight = lambda bag: sum(w[s] * n for s, n in bag.items())
    name = {t: t for t in bags}
    links = 0
    for x, y in itertools.combinations(sorted(bags), 2):
        if bags[x].keys() & bags[y].keys() and weight(bags[x] & bags[y]) >= threshold * weight(bags[x] | bags[y]):
            links += 1
            old, new = name[x], name[y]
            name = {t: new if k == old else k for t, k in name.items()}
    return name, links


@pytest.mark.parametrize("block, max_bits", [(256, 28), (8, 4)])
def test_classes_equal_all_pairs(spark, words, block, max_bits):
    rng = random.Random(5)
    base = [words(200 + i, 150) for i in range(12)]
    texts = base + [variant(t, *rng.sample(range(150), k)) for t in base for k in (0, 1, 1, 2, 2, 3, 4, 6, 8)] + [words(300 + i, 120) for i in range(30)] + [base[0] + " " + words(400 + i, 40) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    # With 40 bands of one sample no pair of the threshold can reasonably be missed, so the classes must be those of all pairs.
    got = {r.doc_id: r.class_id for r in with_class(docs, block=block, max_bits=max_bits, bands=40, rows=1, group_bytes=4000).collect()}
    name, links = plain_classes(texts)
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(name[t], i)
    assert links > 60 and got == {i: least[name[t]] for i, t in enumerate(texts)}


def test_samples_meet_as_often_as_texts_are_alike():
    """The share of equal samples is the weighted Jaccard similarity, for several similarities."""
    rng = np.random.default_rng(3)
    icws = Icws(4000)
    for common in (30, 60, 90):
        h = rng.integers(0, 1 << 63, 200 - common, dtype=np.uint64)
        w = rng.uniform(0.5, 6, len(h))
        a, b = np.arange(100), np.r_[np.arange(common), np.arange(100, len(h))]
        wb = w.copy()
        wb[:common] *= rng.uniform(0.5, 1.5, common)
        sig = icws.signatures(np.concatenate([h[a], h[b]]), np.log(np.concatenate([w[a], wb[b]])), np.array([0, len(a)]))
        want = np.minimum(w[:common], wb[:common]).sum() / (np.maximum(w[:common], wb[:common]).sum() + w[common:100].sum() + wb[100:].sum())
        assert abs((sig[0] == sig[1]).mean() - want) < 0.03

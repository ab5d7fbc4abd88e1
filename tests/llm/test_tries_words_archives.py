"""Conversation tries, spelling variants, token archives and long benchmark items against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataweave.llm import conversation_trie as trie
from strataweave.llm import spelling_variants as spelling
from strataweave.llm import token_archive as archive

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append(((turn is not None, turn or 0), hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest(), (role, text)))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in by.items()}
    rebuilt = {c: tuple(turns.get(c - int(math.fmod(c, 5)), [])[: (h := zlib.crc32(str(c).encode()) % 9)] + own[h:]) for c, own in turns.items()}
    members = defaultdict(list)
    for c, seq in sorted(rebuilt.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, v in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c in v if len(rebuilt[c]) == len(k))
        out.append((v[0], len(k), members[k[:-1]][0] if k else None, len(v), kids[k], sum(not kids[x] for x in below), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, pa string, depth string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_trie_of_odd_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü" * 9, "", None])) for c in range(-12, 70) for t in range(rng.choice([1, 2, 3, 9, 12]))]
    rows += [(80, None, "user", "z"), (80, None, "user", "z"), (80, 1, "user", "b"), (80, 1, "user", "a"), (None, 0, "user", "a"), (93, 0, None, None)]
    rows += [(c, t, "user", f"shared {t}") for c in (100, 101, 102, 105, 110) for t in range(30)]
    assert shown(trie.conversation_trie(frame(spark, rows))) == plain_trie(rows)
    assert trie.conversation_trie(frame(spark, rows).limit(0)).count() == 0


def test_trie_of_a_conversation_that_holds_most_turns(spark, monkeypatch):
    """It lies in several tasks, and its path in several blocks of depths."""
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(c, t, "user", str(t // 2)) for c in (0, 5, 11) for t in range(120)] + [(c, 0, "user", "0") for c in range(20, 60)]
    assert shown(trie.conversation_trie(frame(spark, rows).repartition(7))) == plain_trie(rows)


def test_trie_with_colliding_fingerprints(spark, monkeypatch):
    """Where all prefixes have one fingerprint the groups fail, and all is computed again."""
    seen = []

    def unequal(turns, references, f=trie.unequal):
        seen.append(f(turns, references))
        return seen[-1]

    monkeypatch.setattr(trie, "unequal", unequal)
    scan = trie._scan
    blind = {c: F.lit(0).cast("long") for c in ("pa", "pb", "fa", "fb")}
    monkeypatch.setattr(trie, "_scan", lambda df, seed: scan(df, seed).withColumns({} if seed else blind))
    rows = [(c, t, "user", f"{c} {t}") for c in range(10) for t in range(3)]
    assert shown(trie.conversation_trie(frame(spark, rows))) == plain_trie(rows)
    assert seen == [True, False]


def test_trie_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    got = trie.op12_conversation_trie(spark, "/root/testdata/sf0.001")
    assert shown(got) == sorted(duck.sql(trie.OP12_SQL).select(*got.columns).fetchall(), key=repr)


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in spelling_runs(text or ""):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a))):
                near[a].add(b)
                near[b].add(a)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def spelling_runs(text):
    import re

    return [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall("[A-Za-zÀ-ÿ]+", text)]


@pytest.mark.parametrize("hot", [2, 4096])
def test_variants_equal_all_pairs(spark, hot):
    rng = random.Random(11)
    stems = ["straße×ñandú", "banana", "anananan", "chatterbox", "ÀÉÎõüabc", "q" * 70, "xyxyxyxyxyx", "z" * 63]
    docs = []
    for k in range(120):
        out = []
        for s in stems:
            for _ in range(rng.choice([1, 3, 12])):
                w = list(s)
                if rng.random() < 0.4:
                    i = rng.randrange(len(w))
                    rng.choice([lambda: w.pop(i), lambda: w.insert(i, rng.choice("abß")), lambda: w.__setitem__(i, rng.choice("xyz"))])()
                out.append("".join(w))
        docs.append((rng.choice([k, None]), rng.choice([" ", "\n", "ā", "1"]).join(out)))
    docs += [(7, None), (8, ""), *[(9, "wordword " * 2000)] * 2, (10, "wordwort wordwort"), *[(11, "wordwords " * 1)] * 30]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    got = sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_variants(df, hot=hot).collect()), key=repr)
    assert got == plain_variants(docs)
    assert sum(g[1] is not None for g in got) > 5
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_chains_of_forms_reach_their_root(spark):
    forms = spark.createDataFrame([(bytes([97 + i]), bytes([98 + i])) for i in range(9)], "word binary, form binary")
    assert {bytes(r.root) for r in spelling.roots(forms, 10**10, 10).collect()} == {b"j"}


def test_variants_equal_their_sql(spark):
    duck = duckdb.connect()
    duck.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    got = spelling.op11_spelling_variants(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(duck.sql(spelling.OP11_SQL).select(*got.columns).fetchall(), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBéÉßÿ÷×Σσς'sdtre. ,-_12́  \x1c\t\n<|>İ日本"), max_size=40), max_size=6), st.sampled_from(["", "<|endoftext|>", "x<|startoftext|>"]))
def test_words_are_encoded_as_the_library_does(texts, special):
    import pyarrow as pa

    enc, tok = archive.encoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [*texts, "it's we'll " + special + " Word,word"]
    got = [(int(k), i.tolist()) for x, y, n, ids in enc.slices(pa.array(texts)) for k, i in zip(n, np.split(ids, np.cumsum(n)[:-1]))]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert got == [(len(w), w) for w in want]
    assert enc.occurrences(pa.array(texts)).tolist() == np.bincount(np.concatenate([np.array(w, int) for w in want]), minlength=enc.size).tolist()


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=4, max_size=80))
def test_codes_are_read_back(values):
    values = np.array(values[: len(values) // 4 * 4], "<u4")
    control, data, sizes = archive.code(values)
    assert archive.decode(control, data).tolist() == values.tolist()
    assert sizes.sum() == len(data)


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_archives_hold_all_documents_in_order(spark, words, tmp_path, shard_bytes, monkeypatch):
    monkeypatch.setattr(archive, "SLICE", 1 << 12)
    rows = [(k % 40 if k % 7 else None, words(k % 60, k % 13 * 9) if k % 5 else None if k % 2 else "", "x") for k in range(200)] + [(3, "long " * 9000 + "y" * 9000, "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    archive.write_archive(df, f"file://{tmp_path}/a", WORDS, shard_bytes=shard_bytes)
    got = sorted(((r.start, r.n_tokens, r.doc_id, bytes(r.ids)) for r in archive.read_archive(spark, f"file://{tmp_path}/a").collect()), key=lambda r: r[0])
    tok = Tokenizer.from_file(WORDS)
    want = Counter((d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t, _ in rows)
    assert Counter((d, i) for _, _, d, i in got) == want
    assert [g[0] for g in got] == [0, *np.cumsum([g[1] for g in got])[:-1].tolist()]
    keys = [(d is not None, d or 0) for _, _, d, _ in got]
    assert keys == sorted(keys)
    shards = list(tmp_path.glob("a/shards/part-*"))
    assert (len(shards) > 100) == (shard_bytes == 200)


def test_archive_of_no_documents(spark, tmp_path):
    archive.write_archive(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", WORDS)
    assert archive.read_archive(spark, f"file://{tmp_path}/none").count() == 0


def test_damaged_archives_are_refused(spark, tmp_path):
    archive.write_archive(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), f"file://{tmp_path}/d", WORDS)
    (shard,) = tmp_path.glob("d/shards/part-*")
    raw = bytearray(shard.read_bytes())
    raw[-2] ^= 1
    for old in tmp_path.glob("d/shards/.*crc"):
        old.unlink()
    shard.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        archive.read_archive(spark, f"file://{tmp_path}/d").collect()


def test_long_items_are_laid_once_a_diagonal(spark, words):
    """Hits on long items carry no words; the result is that of items whose hits do."""
    from strataweave.llm import decontamination

    items = [(k, words(k, n)) for k, n in enumerate((7, 9, 13, 40, 700, 3000))]
    docs = [(k, f"{words(50, 5)} {t} {words(51, 9)}") for k, t in items] + [(None, items[4][1]), (9, None), (10, items[5][1][2000:9000]), (10, words(60, 900))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted(map(tuple, decontamination.contaminated(d, b, carried=n).collect()), key=repr) for n in (1, 512, 1 << 20)]
    assert found[0] == found[1] == found[2]
    assert {r[:2] for r in found[0]} >= {(k, k) for k, _ in items} | {(None, 4), (10, 5)}

"""Rules, personal data, tokens, languages, toxicity, decontamination, archives."""

import collections
import hashlib
import functools
import gzip
import itertools
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataweave.llm import bpe, decontamination, language_id, pii, quality_rules, toxicity, warc

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


# Quality rules


def base_counts(text):
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    threes = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    mark = [False] * len(w)
    for i in range(len(w) - 2):
        if threes[tuple(w[i : i + 3])] > 1:
            mark[i : i + 3] = [True] * 3
    n, r = len(w), sum(mark)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, r, n < 50 or 100 * r > 50 * n


def test_quality_counts(spark, words):
    texts = [None, "", " \n\t ", "a b c a b c a b c", "x\nx\n\nx \nx", "é " * 60, words(1, 80), "#" * 500, words(2, 60) + "\r\n" + words(2, 60), "word " * 20_000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t or "")
    assert got[6].kept and not got[7].kept
    assert quality_rules.apply_rules(df.where("doc_id < 0")).count() == 0


def test_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdicts = []
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        fixed = quality_rules.apply_rules(docs.limit(300), rules, sample_rows=1)
        verdicts.append({r.doc_id: r.kept for r in fixed.select("doc_id", "kept").collect()})
    assert verdicts[0] == verdicts[1]
    order = quality_rules.cascade_order(quality_rules.RULES, [("symbols", 1.0, 0.5), ("shouting", 0.1, 0.4), ("bangs", 0.1, 0.0)])
    assert [r.name for r in order][:2] == ["shouting", "symbols"]


def test_clean_documents_stay(spark):
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    rows = quality_rules.apply_rules(spark.read.parquet(f"{SF}/documents.parquet")).join(good, "doc_id").where("not base_failed")
    assert rows.where("not kept").count() == 0


# Personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.one_of(*[st.text(a, max_size=50) for a in ("a@.b-1 ", "1.23 ", "0123456789- ", "+1 ()-.23", "é4111 -")]))
def test_base_spans(text):
    assert pii.plain_spans(text) == brute_spans(text)
    assert [s[:3] for s in pii.spans(text) if s[3]] == brute_spans(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john [at] mail7 [dot] example [dot] com now", "email", "john [at] mail7 [dot] example [dot] com"),
        ("write jane at mail dot example dot com", "email", "jane at mail dot example dot com"),
        ("jоhn@mаil.exаmple.com", "email", "jоhn@mаil.exаmple.com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("from one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("card ４１１１ 1111 1111 1111.", "card", "４１１１ 1111 1111 1111"),
    ],
)
def test_disguised_spans(text, kind, found):
    assert [(k, text[a:b]) for k, a, b, base in pii.spans(text) if not base] == [(kind, found)]


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("alice @ example . org", "email", "alice @ example . org"),
        ("call plus 44 20 7946 0958", "phone", "plus 44 20 7946 0958"),
        ("192.168.one.1", "ip", "192.168.one.1"),
        ("+1 555 one two 4 5678", "phone", "+1 555 one two 4 5678"),
        ("ip one.2.3.4 here", "ip", "one.2.3.4"),
        ("card 4111\u00a01111\u20091111\u202f1111", "card", "4111\u00a01111\u20091111\u202f1111"),
        ("call +44 2O 7946 O958 now", "phone", "+44 2O 7946 O958"),
        ("card 4l11 1111 1l11 1111", "card", "4l11 1111 1l11 1111"),
    ],
)
def test_disguises_are_looked_for_on_their_own(text, kind, found):
    assert [(k, text[a:b]) for k, a, b, base in pii.spans(text) if not base] == [(kind, found)]


PIECES = ["at", "@", "dot", ".", "plus", "one", "OH", "nought", "six", "7", "44", "a", "x.", "é", "о", "１", "\xad", "\xa0", "(", "]", "O", "l", " ", " ", ", ", "-", "\t"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=9).map("".join))
def test_whatever_is_rewritten_is_looked_for(text):
    assert pii.disguised(text) or pii.normalised(text).text == text


def test_pii_table(spark):
    df = spark.createDataFrame([(1, "x a@b.co y +1 (555) 123-4567"), (2, None), (3, "the dot was at home"), (4, "1" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df, redact=True).collect()}
    assert got[1].text == "x [email] y [phone]" and [s.kind for s in got[1].pii] == ["email", "phone"]
    assert got[2].text is None and not got[2].pii and not got[3].pii and not got[4].pii


# Tokens


def test_tree_equals_the_tokenizer():
    tok, codec, rng = Tokenizer.from_file(BPE), bpe.codec(BPE), random.Random(5)
    letters = "abz \n\t'sdt1١²éñ日🙂-_.!?　 ​́"
    stems = "theandofpneumonoultramicroscopicsilicovolcanoconiosis"
    for k in range(600):
        some = rng.sample(letters, rng.choice([1, 2, 5, len(letters)]))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 200))) if k % 4 else "".join(stems[rng.randint(0, 40) :][: rng.randint(1, 9)] for _ in range(200))
        text += "<|endoftext|>" * (k % 7 == 0)
        want = tok.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want and codec.encode_tree(text, 8) == want
        assert codec.decode(want) == tok.decode(want, skip_special_tokens=False)


def test_bpe_table(spark, words):
    texts = [None, "", "one <|endoftext|> two", words(3, 20_000), "ab" * 60_000, " " * 50_000 + "x", words(4, 100)]
    df = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tok = Tokenizer.from_file(BPE)
    want = sorted((i % 6, tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts))
    out = bpe.bpe_decode(bpe.bpe_encode(df, BPE), BPE).collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in out) == want
    assert all(r.decoded == (r.text or "") for r in out)


# Languages


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    rows = language_id.identify(docs.where(language_id.held_out()), model).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 %%"), (4, "é")], "doc_id long, text string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).where("doc_id < 4").collect()} == dict.fromkeys((1, 2, 3), ("und", 0.0))
    assert language_id.train(docs.limit(0)) is None


def test_code_lengths_are_exact():
    """Table sums against the recursion, byte by byte."""
    grams = collections.Counter()
    texts = {"x": "abracadabra abracadabra", "y": "hocus pocus hocus"}
    for lang, t in texts.items():
        b = b"\n\n\n" + t.encode()
        for i in range(3, len(b)):
            grams[lang, int.from_bytes(b[i - 3 : i + 1], "big")] += 1
    model = language_id.Model([(k[0], k[1], n) for k, n in grams.items()], 1000)
    total = np.exp2(-model.bits.reshape(-1, model.size, 2)).sum(1)
    assert np.allclose(total, 1, atol=1e-4)  # each context's code is complete

    def p(lang, ctx, c):
        table = collections.Counter()
        for (name, code), n in grams.items():
            g = code.to_bytes(4, "big")
            if name == lang and g[3 - len(ctx) : 3] == ctx:
                table[g[3:]] += n
        lower = (lambda x: 1 / model.size) if not ctx else (lambda x: p(lang, ctx[1:], x))
        n, d = sum(table.values()), len(table)
        if not n:
            return lower(c)
        if table[c]:
            return table[c] / (n + d)
        return d / (n + d) * lower(c) / (1 - sum(lower(x) for x in table))

    data = np.frombuffer(b"abra pocus" + b"\n\n\n", np.uint8)
    got = model.code_lengths(data, np.array([0, len(data)]))[0]
    b = b"\n\n\nabra pocus"
    # A context that one language alone knows still ends, for the other, in the other's own shorter ones.
    want = [sum(-np.log2(p(lang, b[i - 3 : i], b[i : i + 1])) for i in range(3, len(b))) for lang in model.langs]
    assert np.allclose(got, want, rtol=1e-3)


# Toxicity


def test_restoring(spark):
    docs = spark.createDataFrame([(i, "you are an idiot and a moron said the clown to the loser again") for i in range(30)], "doc_id long, text string")
    channel = toxicity.Channel(toxicity.letter_trigrams(docs))
    for seen, want in (("1d10t", "idiot"), ("m0r0n!", "moron!"), ("i d i o t here", "idiot here"), ("l.o.s.e.r", "loser"), ("idiooooot", "idiot"), ("cl0wn", "clown"), ("a@b.com", "a@b.com"), ("plain words", "plain words"), ("", "")):
        assert channel.restore(seen) == want


def test_signs_at_a_words_end(spark):
    docs = spark.createDataFrame([(i, "what a mass of grass, pass the glass and miss the class at last, an ass said to a boss") for i in range(50)], "doc_id long, text string")
    channel = toxicity.Channel(toxicity.letter_trigrams(docs))
    for seen, want in (("a$$", "ass"), ("a$$!", "ass!"), ("a$$$", "a$$$"), ("gra$$$$$", "gra$$$$$"), ("gra$$, no", "grass, no"), ("last!!", "last!!"), ("boss|", "boss|"), ("5$ 10$!", "5$ 10$!"), ("$$$", "$$$")):
        assert channel.restore(seen) == want


def readings(token, spaced):
    """Every path through the lattice, with its cost."""
    for path in itertools.product(*toxicity.Channel.lattice(token, spaced)):
        yield "".join(x for x, _ in path), sum(c for _, c in path)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("a1!b@l0$", min_size=1, max_size=7), st.lists(st.sampled_from("ab1l0"), min_size=3, max_size=4).map(" ".join)), st.booleans())
def test_the_likeliest_of_all_readings_is_found(token, spaced):
    spaced = spaced and " " in token
    channel = toxicity_channel()

    def cost(reading):
        log, x, y = 0.0, 0, 0
        for c in reading + " ":
            z = channel.code(c)
            log, x, y = log + channel.log[x][y][z], y, z
        return log

    best = max(cost(r) + c for r, c in readings(token, spaced))
    got = channel._decode(token, spaced)
    signs = sum(max(c for _, c in step) for step in channel.lattice(token, spaced))
    if got is None:  # a uniform model explains every best reading much better
        assert any(cost(r) + c >= best - 1e-9 and best - signs < (len(r) + 1) * (-np.log(toxicity.SYMBOLS) - toxicity.SLACK) for r, c in readings(token, spaced))
    else:
        assert any(r == got and cost(r) + c >= best - 1e-9 for r, c in readings(token, spaced))


@functools.cache
def toxicity_channel():
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    c = np.concatenate(([0, 0], toxicity._CODE[np.frombuffer(b"all bail lab oil boil alibi " * 50, np.uint8)]))
    np.add.at(counts, (c[:-2] * toxicity.SYMBOLS + c[1:-1]) * toxicity.SYMBOLS + c[2:], 1)
    return toxicity.Channel(counts)


def test_clashing_labels_give_one_model(spark):
    rows = [(i, f"you {'clown' if i % 3 else 'friend'} {i % 40}", i % 3 > 0) for i in range(400)] + [(1000 + i, f"you {'clown' if i % 3 else 'friend'} {i % 40}", i % 2 == 0) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, _, t in rows], "doc_id long, toxic int")
    channel = spark.sparkContext.broadcast(toxicity_channel())
    models = [toxicity.train(docs.repartition(n), labels.repartition(n), channel) for n in (1, 3, 7)]
    assert all(np.array_equal(m.hashes, models[0].hashes) and np.allclose(m.weights, models[0].weights) for m in models)


def test_toxicity_learns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    channel = spark.sparkContext.broadcast(toxicity.Channel(toxicity.letter_trigrams(docs)))
    scorer = toxicity.train(docs, labels, channel)
    rows = toxicity.score(docs, channel, scorer).join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.6 * sum(r.toxic for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "aaaa " * 5000)], "doc_id long, text string")
    assert toxicity.score(odd, channel, scorer).where("predicted = 1").count() == 0
    none = toxicity.train(docs, labels.limit(0), channel)
    assert toxicity.score(odd, channel, none).where("score > 0").count() == 0


def test_signs_at_the_end_of_a_word_are_looked_at():
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    c = np.concatenate(([0, 0], toxicity._CODE[np.frombuffer(b"puta casa " * 200, np.uint8)]))
    np.add.at(counts, (c[:-2] * toxicity.SYMBOLS + c[1:-1]) * toxicity.SYMBOLS + c[2:], 1)
    channel = toxicity.Channel(counts)
    got, changed = toxicity.restored_column(pa.array(["put@", "cas@ puta", "casa"]), channel)
    assert got.to_pylist() == ["puta", "casa puta", "casa"] and changed.tolist() == [True, True, False]


# Decontamination


def test_substituted_passages_are_found(spark, words):
    item = words(50, 30).split()
    changed = [w if i % 9 != 4 else "zzz" for i, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, words(51, 30))], "item_id long, text string")
    docs = spark.createDataFrame([(1, words(60, 40) + " " + " ".join(item)), (2, words(61, 40) + " " + " ".join(changed) + " " + words(62, 9)), (3, words(63, 300)), (4, None), (5, ""), (6, " ".join(item[:9])), (None, " ".join(item).upper() + "!")], "doc_id long, text string")
    for limit in (1_000_000, 40):
        got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench, broadcast_rows=limit).collect()}
        assert set(got) == {(1, 1), (2, 1), (None, 1)}
        assert got[1, 1].first_word == 40 and got[1, 1].equal_words == 13 and got[2, 1].first_word == 40


def by_rule(text, item, window=13, least=11):
    """The rule alone, on every diagonal, without seeds."""
    d, b = text.split(), item.split()
    need = least if len(b) >= window else -(-len(b) * least // window)
    for at in range(-len(b) + 1, len(d)):
        eq = [0 <= i + at < len(d) and d[i + at] == x for i, x in enumerate(b)]
        if max(sum(eq[k : k + window]) for k in range(max(1, len(eq) - window + 1))) >= need:
            return True
    return False


def test_every_accepted_substitution_is_found(spark, words):
    items = {n: " ".join(f"{w}{n}{i}" for i, w in enumerate(words(70 + n, n).split())) for n in (7, 8, 9, 12, 13, 16)}
    texts = []
    for n, item in items.items():
        for some in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in (0, 1, 2, 3)):
            if len(some) < 3 or n == 13:
                w = ["zzz" if i in some else x for i, x in enumerate(item.split())]
                texts += [" ".join(w), "aaa bbb " + " ".join(w) + " ccc"] if len(some) < 2 else ["aaa bbb " + " ".join(w)]
        texts += [" ".join(item.split()[1:]) + " ccc", "aaa " + " ".join(item.split()[:-1]), " ".join(item.split()[:-2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {(k, n) for k, t in enumerate(texts) for n, item in items.items() if by_rule(t, item)}
    for some in (items, {n: t for n, t in items.items() if n > 7}):
        bench = spark.createDataFrame(list(some.items()), "item_id int, text string")
        got = decontamination.contaminated(docs, bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(k, n) for k, n in want if n in some}
    assert len(want) < len(texts)


def test_six_words_match_nothing(spark):
    text = "one two three four five six"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert decontamination.contaminated(rows, rows.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_decontamination_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = decontamination.op6_decontamination(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(decontamination.oracle_sql()).select(*got.columns).fetchall())


# Archives


def test_a_payload_that_most_pages_share(spark, tmp_path):
    hot, rows = "<p>" + "hot " * 400, []
    for i in range(600):
        rows.append((i, f"http://h/{i}", hot if i % 3 else f"<p>{i} " + "own " * 300, "x", "y"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, original string").repartition(5)
    warc.write_warc(pages, f"file://{tmp_path}/w", records_per_file=40)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolved(warc.read_warc(spark, f"file://{tmp_path}/w")).collect()}
    last = max(i for i in range(600) if i % 3)
    assert got == {i: ("response", None, len(h)) if i == last or not i % 3 else ("revisit", last, len(hot)) for i, _, h, _, _ in rows}


def test_warc_round_trip(spark, tmp_path):
    big, other = "x" * 1200 + "WARC/1.1\r\n", "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, "http://a/3", big), (4, None, other), (5, "u", other), (6, "u", "small"), (7, "u", "small"), (8, "u", None), (9, "u", ""), (None, "u", big), (10, "u", "y" * 1000), (10, "u", "y" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages, path, records_per_file=2)
    parsed = warc.read_warc(spark, path)
    assert parsed.count() == len(rows) and parsed.where("record_type = 'response' and not checked").count() == 0
    out = {(r.page_id, r.record_type): r for r in warc.resolved(parsed).collect()}
    best = {hashlib.sha1(big.encode()).hexdigest(): 3, hashlib.sha1(other.encode()).hexdigest(): 5}
    for page, _, html in rows:
        data = (html or "").encode()
        digest = hashlib.sha1(data).hexdigest()
        revisit = len(data) >= 1000 and digest in best and page != best[digest]
        r = out[page, "revisit" if revisit else "response"]
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(data), digest, best[digest] if revisit else None) and r.checked
    assert parsed.where(F.col("payload").isNotNull()).count() == len([1 for r in rows]) - 4


def test_warc_marks_inside_payloads_and_foreign_archives(spark, tmp_path):
    """A record goes on over marks inside it; members of a gzip file and plain files read alike; a cut record is an error."""
    inner = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0WARC/1.</p>" * 9
    pages = spark.createDataFrame([(1, "http://a/WARC/1.1", inner), (2, "http://b", inner), (3, "http://c", "WARC/1."), (4, "http://d", "")], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), f"file://{tmp_path}/marks", min_bytes=500)
    got = {r.page_id: r for r in warc.read_warc(spark, f"file://{tmp_path}/marks").collect()}
    assert {k: None if r.payload is None else bytes(r.payload).decode() for k, r in got.items()} == {1: None, 2: inner, 3: "WARC/1.", 4: ""}
    assert got[1].record_type == "revisit" and got[1].refers_to_id == got[2].record_id and got[2].checked
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "marks").glob("*.gz")))
    cuts = [i for i in range(len(whole)) if whole.startswith(b"WARC/1.1\r\nWARC-Type: ", i) and b"WARC-Record-ID" in whole[i : i + 80]]
    members = [whole[a:b] for a, b in zip(cuts, [*cuts[1:], len(whole)])]
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    (tmp_path / "foreign" / "plain.warc").write_bytes(whole)
    again = warc.read_warc(spark, f"file://{tmp_path}/foreign").collect()
    assert sorted(r.record_id for r in again) == sorted([r.record_id for r in got.values()] * 2)
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.records([("f", b""), ("f", whole[7:300])]))

"""Columns that clash with results, ties, repeated rows, and empty tables, for the operators that keep a table's columns."""

import public_tokenizers
import pytest

from strataweave.llm import bpe, decontamination, language_id, minhash_dedup, pii, quality_rules, toxicity, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = "doc_id long, text string, lang string, uid string, seq int, n_words string, kept string, pii int, ids string, decoded int, score string, predicted string, restored int, lang_pred int, class_id string, v string, band int"


@pytest.fixture(scope="module")
def odd(spark):
    def row(k, t):
        return (k, t, "en", "u", 1, "w", "k", 1, "i", 1, "s", "p", 1, 1, "c", "v", 1)

    return spark.createDataFrame([row(1, "the quick brown fox " * 3), row(1, "the quick brown fox " * 3), row(2, None), row(None, ""), row(3, "word " * 9000)], COLUMNS)


def operators(spark):
    channel = spark.sparkContext.broadcast(toxicity.Channel(toxicity.letter_trigrams(spark.createDataFrame([("abc",)], "text string"))))
    none = toxicity.Scorer(*map(__import__("numpy").zeros, (0, 0)), -float("inf"))
    return {
        "quality": (quality_rules.apply_rules, quality_rules.SCHEMA),
        "pii": (pii.find_pii, "pii x"),
        "bpe": (lambda d: bpe.bpe_decode(bpe.bpe_encode(d, BPE), BPE), "n_tokens x, ids x, decoded x"),
        "language": (lambda d: language_id.identify(d, language_id.train(d)), "lang_pred x, score x"),
        "toxicity": (lambda d: toxicity.score(d, channel, none), "restored x, score x, predicted x"),
        "near": (minhash_dedup.with_class, "_v x, class_id x, class_v x"),
    }


@pytest.mark.parametrize("name", ["quality", "pii", "bpe", "language", "toxicity", "near"])
def test_shapes(spark, odd, name):
    run, made = operators(spark)[name]
    made = [x.split(" ")[0] for x in made.split(", ")]
    out = run(odd)
    assert sorted(out.columns) == sorted([c for c in odd.columns if c not in made] + made)
    assert out.count() == odd.count()
    assert run(odd.limit(0)).count() == 0


def test_empty_pairs(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.contaminated(odd.limit(0), bench).count() == 0


def test_empty_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/none")
    assert warc.resolved(warc.read_warc(spark, f"file://{tmp_path}/none")).count() == 0

"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed hashes the words at the 1s of a fixed mask and ignores those at the 0s, so a hit
survives substituted words there. Seeds of every position of the benchmark meet those of every position
of the documents in one hash join; at each hit the whole item is laid over the document on the hit's
diagonal (once a diagonal), and the pair counts if some ``window`` aligned words hold at least ``least_equal`` equal ones.

The seeds of the benchmark are broadcast while they are fewer than ``broadcast_rows``; a larger
benchmark is handled in as many parts, each a pass over the documents. Hits gather by document, item and diagonal with partial
aggregates; hot passages only mean more hits in each document. Hits on items of over ``carried`` words carry no words with them: their diagonals are
gathered first, and the texts join again.

Words are runs between white space, lower-cased and without .,;:!?"'() around or in them. Defined results: null and
empty texts match nothing; items of fewer words than the window must match in all but the share of
words that the window allows; items shorter than the shortest mask match nothing. Rows with one doc_id and different texts are matched each for
itself, and ``contaminated`` gives one row for all of them and an item (the best).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks of weight six.
MASKS = ("1110111", "11011011", "110101011")
#: What MASKS miss: two neighbouring words changed in the middle, or one in an item of eight words; then one in an item of seven.
#: With them no substitution that the rule accepts is without a hit (enumerated in the tests for a window of 13 and 11 equal words).
CONTIGUOUS = ("111111",)
OF_SEVEN = ("1011111", "1101111", "1111011", "1111101")


def word_hashes(text: Column) -> Column:
    """array<long>: a hash of each word."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ".,;:!?\"'()", "")
    return F.transform(F.split(F.btrim(plain, F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w))


def _seed(words: str, at: str, number: int, mask: str) -> str:
    return f"xxhash64({number}, {', '.join(f'get({words}, {at} + {k})' for k, c in enumerate(mask) if c == '1')})"


def _by_mask(values: list[str]) -> str:
    return f"CASE {' '.join(f'WHEN mask_no = {k} THEN {v}' for k, v in enumerate(values[:-1]))} ELSE {values[-1]} END"


def seeds(df: DataFrame, words: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """A row for each position and mask that fits: mask_no, pos, seed, next to the columns of df."""
    m, shortest = len(masks), min(map(len, masks))
    numbers = f"CASE WHEN size({words}) >= {shortest} THEN sequence(0, (size({words}) - {shortest - 1}) * {m} - 1) ELSE CAST(array() AS array<int>) END"
    rows = df.withColumn("_k", F.explode(F.expr(numbers)))
    rows = rows.withColumn("mask_no", F.expr(f"_k % {m}")).withColumn("pos", F.expr(f"CAST(_k div {m} AS int)")).drop("_k")
    fits = _by_mask([f"size({words}) >= pos + {len(x)}" for x in masks])
    return rows.where(F.expr(fits)).withColumn("seed", F.expr(_by_mask([_seed(words, "pos", k, x) for k, x in enumerate(masks)])))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, least_equal: int = 11, masks: tuple[str, ...] = MASKS, broadcast_rows: int = 1_000_000, carried: int = 512) -> DataFrame:
    """doc_id, item_id, equal_words (most in a window), first_word (where the item would begin in the document), seed_hits (of ``masks``)."""
    laid = _laid(docs, benchmark, window, least_equal, masks, broadcast_rows, carried)
    best = F.max(F.struct("equal_words", (-F.col("first_word")).alias("o")))
    out = laid.groupBy("doc_id", "item_id").agg(best.alias("best"), F.sum("seed_hits").alias("seed_hits"))
    return out.select("doc_id", "item_id", F.col("best.equal_words").cast("long").alias("equal_words"), (-F.col("best.o")).cast("long").alias("first_word"), "seed_hits")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs whose own text holds no passage of the benchmark, whatever other rows share their doc_id."""
    found = _laid(docs, benchmark, **options).select(F.col("doc_id").alias("_hit"), F.col("dkey").alias("_hit_key")).distinct()
    keyed = docs.withColumn("_dkey", _text_key(word_hashes(F.col("text").cast("string"))))
    return keyed.join(found, F.expr("doc_id <=> _hit and _dkey = _hit_key"), "left_anti").select(*docs.columns)


def _text_key(words: Column) -> Column:
    return F.xxhash64(words)


def _laid(docs: DataFrame, benchmark: DataFrame, window: int = 13, least_equal: int = 11, masks: tuple[str, ...] = MASKS, broadcast_rows: int = 1_000_000, carried: int = 512) -> DataFrame:
    """The diagonals that count: doc_id, dkey (of the text), item_id, first_word, equal_words, seed_hits."""
    counted, shortest = len(masks), min(map(len, masks))
    items = benchmark.select("item_id", word_hashes(F.col("text").cast("string")).alias("iw")).where(F.size("iw") >= shortest)
    total = items.agg(F.sum(F.size("iw")).alias("n"), F.min(F.size("iw")).alias("least"), F.max(F.size("iw")).alias("most")).first()
    masks = masks + CONTIGUOUS + (OF_SEVEN if total.least == 7 else ())
    positions = (total.n or 0) * len(masks)
    parts = max(1, -(-positions // broadcast_rows))
    texts = docs.select("doc_id", word_hashes(F.col("text").cast("string")).alias("dw")).withColumn("dkey", _text_key(F.col("dw")))
    found = []
    for k in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else items
        known = seeds(some, "iw", masks).select("seed", (F.col("mask_no") < counted).alias("counts"), F.col("pos").alias("ipos"), "item_id", F.size("iw").alias("n"))
        found.append(seeds(texts, "dw", masks).join(F.broadcast(known), "seed"))  # at most about broadcast_rows rows
    hits = reduce(DataFrame.unionByName, found).withColumn("first_word", F.col("pos") - F.col("ipos"))
    # Up to here all is generated code and a position is no row of its own. A hit on a short item takes along the words under the item; hits on long ones
    # are gathered by diagonal first, and the texts that they name are read again, so that a long item's words are laid over each diagonal once.
    cut = lambda words: F.expr(f"slice({words}, greatest(0, first_word) + 1, least(n - greatest(0, -first_word), size({words}) - greatest(0, first_word)))").alias("under")
    key = ["doc_id", "dkey", "item_id", "first_word"]
    near = hits.where(F.col("n") <= carried).select(*key, "counts", cut("dw")).groupBy(*key).agg(F.first("under").alias("under"), F.count_if("counts").alias("seed_hits"))
    if (total.most or 0) > carried:
        far = hits.where(F.col("n") > carried).select(*key, "n", "counts").groupBy(*key, "n").agg(F.count_if("counts").alias("seed_hits"))
        named = far.withColumnRenamed("doc_id", "_doc").withColumnRenamed("dkey", "_key")
        again = texts.dropDuplicates(["doc_id", "dkey"]).join(named, F.expr("doc_id <=> _doc and dkey = _key"))
        near = near.unionByName(again.select(*key, cut("dw"), "seed_hits"))
    laid = near.join(items, "item_id")
    eq = F.expr("zip_with(under, slice(iw, greatest(0, -first_word) + 1, size(under)), (x, y) -> CASE WHEN x = y THEN 1 ELSE 0 END)")
    # The equal words of each window: the words from the first, second, ... place on, added place by place (a slice copies its array, so one a window would be quadratic).
    places = F.expr(f"greatest(1, size(eq) - {window - 1})")
    shifted = [F.slice("eq", F.lit(k + 1), places) for k in range(window)]
    sums = reduce(lambda x, y: F.zip_with(x, y, lambda p, q: p + F.coalesce(q, F.lit(0))), shifted)
    need = F.expr(f"CASE WHEN size(iw) >= {window} THEN {least_equal} ELSE ceil(size(iw) * {least_equal} / {window}D) END")
    return laid.withColumn("eq", eq).withColumn("equal_words", F.array_max(sums)).where(F.col("equal_words") >= need)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle_sql(window: int = 13, least_equal: int = 11, masks: tuple[str, ...] = MASKS) -> str:
    """The same by word lists and string seeds, with every mask; those beside ``masks`` find diagonals but do not count as seed_hits."""
    counted, masks = len(masks), masks + CONTIGUOUS + OF_SEVEN
    words = """list_filter(string_split_regex(translate(lower(coalesce(text, '')), '.,;:!?"''()', ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"""
    seed = lambda col: "CASE m " + " ".join(f"WHEN {k} THEN concat_ws(' ', {', '.join(f'{col}[p + {i + 1}]' for i, c in enumerate(x) if c == '1')})" for k, x in enumerate(masks)) + " END"
    fits = lambda col: "CASE m " + " ".join(f"WHEN {k} THEN len({col}) >= p + {len(x)}" for k, x in enumerate(masks)) + " END"
    every = lambda t, key, col: f"(SELECT {key}, {col}, p, m, {seed(col)} AS s FROM (SELECT *, unnest(range(0, len({col}))) AS p FROM {t}) CROSS JOIN (SELECT unnest(range(0, {len(masks)})) AS m) WHERE {fits(col)})"
    return f"""
WITH d AS (SELECT doc_id, {words} AS dw FROM documents), b AS (SELECT item_id, {words} AS iw FROM benchmark),
h AS (SELECT doc_id, item_id, dw, iw, x.m AS m, x.p - y.p AS first_word FROM {every('d', 'doc_id', 'dw')} x JOIN {every('b', 'item_id', 'iw')} y ON x.s = y.s AND x.m = y.m),
g AS (SELECT doc_id, item_id, first_word, any_value(dw) AS dw, any_value(iw) AS iw, count(*) FILTER (WHERE m < {counted}) AS n FROM h GROUP BY 1, 2, 3),
e AS (SELECT doc_id, item_id, first_word, n, len(iw) AS size,
        [CASE WHEN dw[first_word + k + 1] = iw[k + 1] THEN 1 ELSE 0 END FOR k IN range(greatest(0, -first_word), least(len(iw), len(dw) - first_word))] AS eq FROM g),
w AS (SELECT *, list_max([list_sum(eq[k + 1 : k + {window}]) FOR k IN range(0, greatest(0, len(eq) - {window}) + 1)]) AS equal_words FROM e)
SELECT doc_id, item_id, CAST(max(equal_words) AS BIGINT) AS equal_words,
  CAST(min(first_word) FILTER (WHERE equal_words = top) AS BIGINT) AS first_word, CAST(sum(n) AS BIGINT) AS seed_hits
FROM (SELECT *, max(equal_words) OVER (PARTITION BY doc_id, item_id) AS top FROM w
      WHERE equal_words >= CASE WHEN size >= {window} THEN {least_equal} ELSE ceil(size * {least_equal} / {window}.0) END)
GROUP BY 1, 2
"""

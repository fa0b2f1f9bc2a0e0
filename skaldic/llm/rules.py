"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text (operator 8). DataFrame functions only.

Words and pairs of adjacent words fall into BUCKETS hash buckets. Counts over the trusted documents and over
all documents give two smoothed multinomials; a document's ratio is the sum of log p_trusted - log p_raw over its
n-grams, in whole millionths so that sums do not depend on order, divided by their number. Documents that
pass the base rules are kept if the ratio reaches a threshold, by default a low quantile of the trusted documents'
own ratios, counted in steps over all of them; nothing is drawn at random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bounded, materialize, shifted, words_fast

BUCKETS = 10_000
SYMBOLS = "[#*$%&|<>]"
REPEAT = 8
#: The threshold is the ratio that this share of the trusted documents that pass the base rules stays below, to a step of 1 / STEPS nats.
SHARE, STEPS = 0.001, 1000


def _buckets(pair: Column) -> list[Column]:
    one, two = pair["0"], pair["1"]
    return [F.pmod(F.xxhash64(one), F.lit(BUCKETS)), F.when(two.isNotNull(), F.pmod(F.xxhash64(one, two), F.lit(BUCKETS)))]


def _pairs(words: Column) -> Column:
    return F.arrays_zip(*[x.alias(str(k)) for k, x in enumerate(shifted(words, 2))])


def bucket_counts(docs: DataFrame) -> dict[int, int]:
    """N-grams of all rows by bucket: at most BUCKETS counts reach the driver."""
    pairs = docs.select(words_fast(F.col("text")).alias("words")).select(F.explode_outer(_pairs(F.col("words"))).alias("p")).where("p is not null")
    grams = pairs.select(F.explode(F.array(*_buckets(F.col("p")))).alias("bucket")).where("bucket is not null")
    return {r.bucket: r.n for r in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


def weights(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """log p_trusted - log p_raw of each bucket in millionths; add-one smoothing. All 0 without a trusted text."""
    ids = trusted.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()
    ids = bounded(materialize(ids.withColumn("__id", F.col("__id").cast("long")), "trusted"))  # the texts are not shuffled for a set of ids that is proven small
    good = bucket_counts(docs.join(ids, F.col("doc_id") == F.col("__id"), "left_semi"))
    if not good:
        return [0] * BUCKETS
    raw = bucket_counts(docs)
    n_good, n_raw = sum(good.values()) + BUCKETS, sum(raw.values()) + BUCKETS
    return [round(1e6 * (math.log((good.get(b, 0) + 1) / n_good) - math.log((raw.get(b, 0) + 1) / n_raw))) for b in range(BUCKETS)]


def threshold_of(scored: DataFrame, trusted: DataFrame, share: float = SHARE) -> float:
    """The ratio below which `share` of the trusted rows that pass the base rules lie, rounded down to a step; -inf without such rows."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null").distinct()
    good = scored.where("not base_failed").join(ids, F.col("doc_id") == F.col("__id"), "left_semi")
    steps = sorted((r.step, r.n) for r in good.groupBy(F.floor(F.col("llr") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())  # ratios are a few nats wide
    left = share * sum(n for _, n in steps)
    for step, n in steps:
        left -= n
        if left < 0:
            return step / STEPS
    return -math.inf


def judge(docs: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """The base counts, the ratio `llr` (nats per n-gram; 0 without n-grams) and `kept` for every row of `docs`.

    Without a threshold, threshold_of() gives it. Null text counts as no words; very long texts count whole; repeated
    rows and a null doc_id are ordinary rows; no trusted document means that only the base rules decide; an empty
    table gives an empty result. Other columns are ignored.
    """
    table = F.split(F.lit(",".join(map(str, weights(docs, trusted)))), ",").cast("array<bigint>")  # folded to one literal
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("words", words_fast(F.col("text")))
    n = F.size("words")
    some = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    windows = F.transform(F.arrays_zip(*[x.alias(str(k)) for k, x in enumerate(shifted(F.col("words"), REPEAT))]), lambda s: F.xxhash64(s))
    df = df.select(
        "doc_id", "words", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        some.alias("lines"), F.when(n >= REPEAT, F.slice(windows, F.lit(1), n - (REPEAT - 1))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    ratio = F.aggregate(_pairs(F.col("words")), F.lit(0).cast("long"), lambda a, p: a + F.get(table, _buckets(p)[0].cast("int")) + F.coalesce(F.get(table, _buckets(p)[1].cast("int")), F.lit(0)))
    order = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        ratio.alias("ratio"), F.when(F.size(F.array_distinct("h")) < F.size("h"), order).alias("s"),
    )
    twice = F.filter("s", lambda e, k: (e["x"] == F.get("s", k - 1)["x"]) | (e["x"] == F.get("s", k + 1)["x"]))
    df = df.withColumn("at", F.array_sort(F.transform(twice, lambda e: e["i"])))
    steps = F.zip_with(F.col("at"), F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(REPEAT)), F.lit(REPEAT)))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    df = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "ratio")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("llr", F.col("ratio") / 1e6 / F.greatest(2 * F.col("n_words") - 1, F.lit(1)))
    df = materialize(df.drop("ratio"), "scored")  # numbers only
    least = threshold_of(df, trusted) if threshold is None else threshold
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(least)))

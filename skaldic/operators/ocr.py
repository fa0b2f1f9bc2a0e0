"""OCR output: ordered rules, token reports, error rates, letter recalls, latencies and gates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .morphology import numbered

#: Substitutions that are safe on any page, in order.
SAFE_RULES = [("ſ", "s"), ("(?m)^\\s*S\\s*(\\d{1,3})\\.\\s*", "§ \\1. "), ("(?m)^\\s*5\\s*(\\d{1,3})\\.\\s*", "§ \\1. "), ("\\r\\n", "\n"), ("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n")]
LETTERS = {"thorn": "þÞðÐ", "thorn_letter": "þÞ", "eth": "ðÐ", "ae": "æÆǣǢ", "macron": "āēīōūȳǣĀĒĪŌŪȲǢ"}


def clean(pages: DataFrame, rules: list[tuple[str, str]] = SAFE_RULES) -> DataFrame:
    return pages.withColumn("text", S.apply_rules(F.col("text"), rules))


def join_pages(pages: DataFrame, key: str, order: str = "path") -> DataFrame:
    """One text for each key: pages that aren't blank, by path, with a blank line between."""
    rows = pages.where(S.strip(F.col("text")) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("ps"))
    return rows.select(key, F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n").alias("text"))


def unknown_tokens(docs: DataFrame, words: DataFrame, pattern: str = "(?U)([^\\W\\d_]+)", longer_than: int = 2) -> DataFrame:
    """(token, n) of lower-cased tokens that are longer and not in words (token): counted before the anti-join."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern))).alias("t")).select(F.lower("t").alias("token"))
    counts = found.where(F.length("token") > longer_than).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(words.select(F.lower("token").alias("token")).distinct(), "token", "left_anti")


def _distance(a: list, b: list) -> int:
    codes: dict = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in s], np.int64) for s in (a, b))
    row = np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for w in x:
        low = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(np.concatenate(([row[0] + 1], low)) - steps) + steps
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def word_distance(expected: pd.Series, observed: pd.Series) -> pd.Series:
    """Edit distance over words."""
    return pd.Series([None if a is None or b is None else _distance(a.split(), b.split()) for a, b in zip(expected, observed)], dtype="Int32")


def _align(a: str, b: str) -> list[tuple[str, str]]:
    """Pairs of characters, "" for a gap; substitutions go before deletions, those before insertions."""
    y = np.array([ord(c) for c in b], np.int64)
    steps = np.arange(len(b) + 1)
    table = np.empty((len(a) + 1, len(b) + 1), np.int32)
    table[0] = steps
    for i, c in enumerate(a, 1):
        low = np.minimum(table[i - 1, 1:] + 1, table[i - 1, :-1] + (y != ord(c)))
        table[i] = np.minimum.accumulate(np.concatenate(([i], low)) - steps) + steps
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
            out.append((a[i], ""))
        else:
            j -= 1
            out.append(("", b[j]))
    return out[::-1]


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("expected", "observed")]))
def alignment(expected: pd.Series, observed: pd.Series) -> pd.DataFrame:
    pairs = [_align(a or "", b or "") for a, b in zip(expected, observed)]
    return pd.DataFrame({"expected": [[x for x, _ in p] for p in pairs], "observed": [[y for _, y in p] for p in pairs]})


def _of(letters: str, kept: str = ""):
    """A test of an aligned pair: the expected letter is one of these and, if asked, the observed one too or the same."""

    def test(p: Column) -> Column:
        one = lambda c: (c != "") & F.lit(letters).contains(c)
        return one(p["x"]) & (p["x"] == p["y"] if kept == "same" else one(p["y"]) if kept else F.lit(True))

    return test


def scores(pairs: DataFrame) -> DataFrame:
    """Error rates and letter recalls of (expected, observed) texts, other columns kept."""
    df = pairs.withColumn("e", S.page_text(F.col("expected"))).withColumn("o", S.page_text(F.col("observed"))).withColumn("al", alignment("e", "o"))
    df = df.withColumn("char_distance", F.levenshtein("e", "o")).withColumn("word_distance", word_distance("e", "o"))
    words = F.size(F.filter(F.split("e", "\\s+"), lambda w: w != ""))
    df = df.withColumn("expected_chars", F.length("e")).withColumn("expected_words", words)
    df = df.withColumn("cer", F.col("char_distance") / F.greatest("expected_chars", F.lit(1))).withColumn("wer", F.col("word_distance") / F.greatest("expected_words", F.lit(1)))
    pairs_ = F.arrays_zip(F.col("al.expected").alias("x"), F.col("al.observed").alias("y"))
    count = lambda test: F.size(F.filter(pairs_, test))
    for name, letters in LETTERS.items():
        df = df.withColumn(f"{name}_expected", count(_of(letters))).withColumn(f"{name}_preserved", count(_of(letters, "same" if name == "macron" else "any")))
        df = df.withColumn(f"{name}_recall", ratio(F.col(f"{name}_preserved"), F.col(f"{name}_expected"), 1.0))
        if name in ("thorn_letter", "eth", "ae"):
            seen = F.length("o") - F.length(F.translate("o", letters, ""))
            df = df.withColumn(f"{name}_observed", seen).withColumn(f"{name}_precision", F.when(seen > 0, F.col(f"{name}_preserved") / seen).otherwise(F.when(F.col(f"{name}_expected") == 0, 1.0).otherwise(0.0)))
    to_p = count(lambda p: _of(LETTERS["thorn"])(p) & p["y"].isin("p", "P"))
    return df.withColumn("thorn_to_p_rate", ratio(to_p, F.col("thorn_expected"), 0.0)).drop("e", "o", "al")


def ratio(a: Column, b: Column, otherwise: float) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))


def latencies(rows: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """n, mean, median, p95 (element int(0.95 (n - 1)) of the sorted values, from 0), deviation and pages per minute.

    The p95 is read at its place in sorted ranges, so that no group has to fit into one row or task; null values don't count.
    """
    some = rows.where(F.col(seconds).isNotNull()).select(*keys, F.col(seconds).alias("__s"))
    out = some.groupBy(*keys).agg(F.count("__s").alias("n"), F.coalesce(F.avg("__s"), F.lit(0.0)).alias("mean_s"), F.median("__s").alias("median_s"), F.coalesce(F.stddev_pop("__s"), F.lit(0.0)).alias("stdev_s"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    placed, wanted = numbered(some, ["__s"], keys).alias("p"), out.select(*keys, F.floor(F.lit(0.95) * (F.col("n") - 1)).alias("__at")).alias("w")
    p95 = placed.join(wanted, reduce(lambda x, y: x & y, [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]) & (F.col("p.counter") == F.col("w.__at"))).select(*[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.__s").alias("p95_s"))
    return out.join(p95, same(out, p95)).select(*[out[k] for k in keys], "n", "mean_s", "median_s", "stdev_s", "p95_s", F.when(F.col("mean_s") > 0, 60 / F.col("mean_s")).otherwise(0.0).alias("pages_per_min"))


def mean_or(c: Column, otherwise: float = 0.0) -> Column:
    """The mean, or a default where there is nothing to average."""
    return F.coalesce(F.avg(c), F.lit(otherwise))


def failure_histogram(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason, n) of the failed pages (failure_reason; null: none)."""
    return pages.where("failure_reason is not null").groupBy(*keys, F.col("failure_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def by_trait(fixtures: DataFrame) -> DataFrame:
    """Per trait, of rows (fixture, traits, mean_s, p95_s, pages_measured, failed_pages, quality_pass): means and worst p95 over fixtures with measured pages."""
    rows = fixtures.select(F.explode("traits").alias("trait"), *[c for c in fixtures.columns if c != "traits"])
    measured = F.col("pages_measured") > 0
    return rows.groupBy("trait").agg(
        F.count(F.lit(1)).alias("fixtures"), F.sum("pages_measured").alias("pages_measured"), F.sum("failed_pages").alias("failed_pages"), mean_or(F.when(measured, F.col("mean_s"))).alias("mean_s"),
        F.coalesce(F.max(F.when(measured, F.col("p95_s"))), F.lit(0.0)).alias("p95_s"), F.every(F.coalesce("quality_pass", F.lit(False))).alias("quality_pass"),
    )


def gate(rows: DataFrame, overrides: DataFrame, key: str, defaults: dict[str, float]) -> DataFrame:
    """Add quality_pass: cer, wer, thorn and macron recall and thorn-to-p rate against a row's own limits or the defaults."""
    joined = rows.join(overrides, key, "left")
    limit = lambda c: F.coalesce(F.col(c), F.lit(defaults[c]))
    ok = (F.col("cer") <= limit("max_cer")) & (F.col("wer") <= limit("max_wer")) & (F.col("thorn_recall") >= limit("min_thorn_recall")) & (F.col("thorn_to_p_rate") <= limit("max_thorn_to_p_rate")) & (F.col("macron_recall") >= limit("min_macron_recall"))
    return joined.withColumn("quality_pass", ok).drop(*defaults)


#: Metrics that must not rise, recalls that must not fall.
RATES, RECALLS = ("mean_cer", "mean_wer"), ("ae_recall", "eth_recall", "thorn_recall", "macron_recall")


def baseline_of(rows: DataFrame, preferred: Column, order: str) -> DataFrame:
    """The first valid row in order that is preferred, else the first valid one; none if no row is valid."""
    return rows.where("valid").orderBy(~F.coalesce(preferred, F.lit(False)), order).limit(1)


def veto(rows: DataFrame, baseline: DataFrame, relative: float = 0.05, absolute: float = 0.02) -> DataFrame:
    """Add reasons, sorted: what makes a row (valid, rates, recalls) worse than the one baseline row.

    A row that is not valid has only `model_verification_failed`, without a baseline `baseline_unavailable`. Absent rates
    count as 0, absent recalls as 1.
    """
    names = (*RATES, *RECALLS)
    base = baseline.limit(1).agg(*[F.first(F.coalesce(F.col(c), F.lit(0.0 if c in RATES else 1.0))).alias(f"b_{c}") for c in names], F.count(F.lit(1)).alias("b_n"))
    joined = rows.crossJoin(F.broadcast(base))  # one row
    reasons = []
    for c in RATES:
        now, was = F.coalesce(F.col(c), F.lit(0.0)), F.col(f"b_{c}")
        reasons.append(F.when(was <= 0, F.when(now > was, F.lit(f"{c}_exceeds_zero_baseline"))).when(now > was * (1 + relative), F.format_string(f"{c}_regressed>%.2f%%", (now / was - 1) * 100)))
    for c in RECALLS:
        now, was = F.coalesce(F.col(c), F.lit(1.0)), F.col(f"b_{c}")
        reasons.append(F.when(now < was - absolute, F.format_string(f"{c}_dropped>%.4f", was - now)))
    found = F.when(~F.col("valid"), F.array(F.lit("model_verification_failed"))).when(F.col("b_n") == 0, F.array(F.lit("baseline_unavailable"))).otherwise(F.array_sort(F.array_compact(F.array(*reasons))))
    return joined.withColumn("reasons", found).drop("b_n", *[f"b_{c}" for c in names])


def best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of each key: those that pass the gate first, then fewest failed pages, then the shortest mean."""
    return rows.groupBy(*keys).agg(F.min_by("candidate", F.struct(~F.col("quality_pass"), "failed", "mean_s", "candidate")).alias("candidate"))

"""Benchmark decontamination by spaced-seed hashing (operator 2). DataFrame functions only.

Fixed masks over token positions select some tokens each; a substitution at a position that the mask ignores
does not change the hash. Between them MASKS hit every run of WINDOW aligned tokens with at most SUBSTITUTIONS
substituted ones, and SHORT_MASK every run of SHORT tokens with one (both checked exhaustively in the tests).
Items of SHORT tokens or more but under WINDOW may have one substituted token, items under SHORT tokens must match
exactly: their mask takes all their tokens. The hashes of the benchmark's seeds are joined with the hashes of every
token position of the corpus; around each hit the item is laid over the document and the overlap is verified
token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shifted

MASKS = ("11110011", "11010111")
WINDOW, SUBSTITUTIONS = 13, 2
SHORT, SHORT_MASK = 8, "11011"
#: Up to so many benchmark seeds are broadcast (about 50 bytes each); beyond, hashes are joined by shuffle.
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null and text without any: empty."""
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks that find items of n tokens."""
    return MASKS if n >= WINDOW else (SHORT_MASK,) if n >= SHORT else ("1" * n,)


def _seeds(df: DataFrame, words: str, keep: list[str], masks: list[str], of_item: Column | None = None) -> DataFrame:
    """A row (keep..., pos, hash) for each position and mask that fits there; pos counts from 0. of_item: only the masks for a text of so many tokens."""
    at = df.select(*keep, F.posexplode_outer(F.arrays_zip(*[x.alias(f"t{k}") for k, x in enumerate(shifted(F.col(words), max(map(len, masks))))])).alias("pos", "t"))
    at = at.where(F.col(f"t.t{min(map(len, masks)) - 1}").isNotNull())
    hashes = []
    for mask in masks:
        fits = F.col(f"t.t{len(mask) - 1}").isNotNull()
        if of_item is not None:
            fits = fits & (of_item.isin([n for n in range(1, WINDOW + 1) if mask in masks_of(n)]))
        hashes.append(F.when(fits, F.xxhash64(F.lit(mask), *[F.col(f"t.t{i}") for i, c in enumerate(mask) if c == "1"])))
    return at.select(*keep, "pos", F.explode(F.array(*hashes)).alias("hash")).where("hash is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, text_hash, item_id, at, matched): items laid over documents so that a run of WINDOW tokens matches up to
    SUBSTITUTIONS, or the whole of a shorter item up to one (none under SHORT tokens); `at` is the token of the document
    under the item's first (negative: it starts before), matched the equal tokens of the item."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).where((F.size("item") > 0) & F.col("item_id").isNotNull()).distinct()
    items = materialize(items, "items")
    size = F.least(F.size("item"), F.lit(WINDOW))
    lengths = [r.n for r in items.select(size.alias("n")).distinct().collect()]  # at most WINDOW numbers
    masks = sorted({m for n in lengths for m in masks_of(n)}) or list(MASKS)
    seeds = _seeds(items.withColumn("size", size), "item", ["item_id", "size"], masks, F.col("size"))
    seeds = materialize(seeds.select(F.col("item_id"), F.col("pos").alias("ipos"), F.col("hash").alias("seed")).distinct(), "seeds")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("words"))
    small = seeds.count() <= BROADCAST_SEEDS
    at = (F.col("pos") - F.col("ipos")).alias("at")
    segment = F.slice("words", F.greatest(F.col("at"), F.lit(0)) + 1, F.greatest(F.size("item") + F.least(F.col("at"), F.lit(0)), F.lit(0))).alias("segment")
    keys = ["doc", "text_hash", "item_id", "at"]
    if small:
        lengths = items.select("item_id", F.size("item").alias("n"))
        of_seed = seeds.join(lengths, "item_id")
        hits = _seeds(texts, "words", ["doc", "text_hash", "words"], masks).join(F.broadcast(of_seed), F.col("hash") == F.col("seed"))
        cut = F.slice("words", F.greatest(F.col("pos") - F.col("ipos"), F.lit(0)) + 1, F.greatest(F.col("n") + F.least(F.col("pos") - F.col("ipos"), F.lit(0)), F.lit(0)))
        hits = hits.select("doc", "text_hash", "item_id", at, cut.alias("segment")).groupBy(*keys).agg(F.first("segment").alias("segment")).join(items, "item_id")
    else:
        hits = _seeds(texts, "words", ["doc", "text_hash"], masks).join(seeds, F.col("hash") == F.col("seed")).select("doc", "text_hash", "item_id", at).distinct()
        hits = hits.join(texts, ["doc", "text_hash"]).join(items, "item_id").select(*keys, segment, "item").dropDuplicates(keys)
    size = F.size("item")
    shift = F.greatest(-F.col("at"), F.lit(0))
    same = F.transform("item", lambda w, k: F.coalesce(F.get("segment", k - shift) == w, F.lit(False)).cast("int"))
    hits = hits.withColumn("same", same).withColumn("run", F.least(size, F.lit(WINDOW))).withColumn("least", F.when(size < SHORT, size).when(size < WINDOW, size - 1).otherwise(F.lit(WINDOW - SUBSTITUTIONS)))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    enough = F.exists(F.sequence(F.lit(1), size - F.col("run") + 1), lambda s: total(F.slice("same", s, F.col("run"))) >= F.col("least"))
    return hits.where(enough).select(*keys, total(F.col("same")).alias("matched"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, text_hash, n_overlaps, items sorted) for each document with an overlap."""
    found = overlaps(docs, benchmark).groupBy("doc", "text_hash")
    return found.agg(F.count(F.lit(1)).alias("n_overlaps"), F.array_sort(F.collect_set("item_id")).alias("items"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("__text", F.xxhash64("text"))


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_overlaps, items) for every row of `docs`.

    Null and empty texts have no overlap, items without a token or with a null item_id find none; rows that share a
    doc_id (or have none) are told apart by their text, equal rows each get their document's result; repeated items
    count once for each different text; empty tables are fine; other columns are ignored.
    """
    found = contaminated(docs, benchmark)
    rows = _keyed(docs.select("doc_id", "text")).select("doc_id", "__doc", "__text")
    out = rows.join(found, (F.col("__doc") == F.col("doc")) & (F.col("__text") == F.col("text_hash")), "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("n_overlaps", F.lit(0)).cast("long").alias("n_overlaps"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without an overlap, with all their columns of any name; odd rows as in flag()."""
    found = materialize(contaminated(docs, benchmark).select(F.col("doc").alias("__d"), F.col("text_hash").alias("__t")), "contaminated")
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text"))
    return rows.join(found, (F.col("__doc") == F.col("__d")) & (F.col("__text") == F.col("__t")), "left_anti").select("__row.*")

"""Line dedup by content-defined line chunks (operator 10). DataFrame functions only.

Lines are hashed, and a polynomial rolling hash runs over two line hashes. A chunk ends after a line whose
rolling hash is smaller than both neighbours', so that boundaries depend on the lines around them and not on
their place, and a passage of several lines is cut alike wherever it stands. A chunk of two lines or more that
occurs before (smaller doc_id, or earlier in the document) is removed; equality is decided on the bytes. The
chunks at both ends of a shared passage hold foreign lines too: so each removed chunk is extended line by line to
both sides, as far as the lines equal those around its first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, bounded, materialize

#: Base and modulus of the rolling hash over two line hashes.
BASE, PRIME = 31, 2147483647
#: Lines before a chunk's predecessor that are compared as well: an end depends on two lines before its last one.
REACH = 2
#: Occurrences of one chunk that are compared with its first occurrence in one task.
SPREAD = 1024


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def with_ends(df: DataFrame) -> DataFrame:
    """Add `__lines`, the lines of the text, and `__ends`, the number (from 1) of the last line of each chunk."""
    h = F.transform(F.col("__lines"), lambda x: F.pmod(F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long"), F.lit(PRIME)))
    df = df.withColumn("__lines", _lines(F.col("text"))).withColumn("__h", h)
    n = F.size("__lines")
    two = lambda a, b: F.pmod(a * BASE + b, F.lit(PRIME))
    df = df.withColumn("__r", F.zip_with(F.slice("__h", 1, F.greatest(n - 1, F.lit(0))), F.slice("__h", 2, F.greatest(n - 1, F.lit(0))), two))
    r = F.col("__r")
    ends = F.filter(F.when(F.size(r) > 2, F.sequence(F.lit(2), F.size(r) - 1)).otherwise(F.array().cast("array<int>")), lambda j: (F.get(r, j - 1) < F.get(r, j - 2)) & (F.get(r, j - 1) < F.get(r, j)))
    return df.withColumn("__ends", F.concat(F.transform(ends, lambda j: j + 1), F.array(n))).drop("__h", "__r")


def with_chunks(df: DataFrame, context: bool = False) -> DataFrame:
    """Add `__chunks`: array of (first line from 1, lines, body) of the text; with `context` also the lines before and after a chunk that it may be extended by."""

    def chunk(end: Column, k: Column) -> Column:
        start = lambda i: F.coalesce(F.get("__ends", i - 1), F.lit(0)) + 1
        first, low = start(k), F.greatest(start(k - 1) - REACH, F.lit(1))
        own = [first.alias("first"), (end - first + 1).alias("lines"), F.array_join(F.slice("__lines", first, end - first + 1), "\n").alias("body")]
        around = [F.slice("__lines", low, first - low).alias("before"), F.slice("__lines", end + 1, F.coalesce(F.get("__ends", k + 1), end) - end).alias("after")]
        return F.struct(*own, *(around if context else []))

    return with_ends(df).withColumn("__chunks", F.transform("__ends", chunk)).drop("__ends", "__lines")


def _keyed(docs: DataFrame) -> DataFrame:
    """Add the key of a row: doc_id (null: the least) and a hash of the text, for a doc_id that repeats."""
    return docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("__text", F.xxhash64("text"))


def _alike(a: Column, b: Column) -> Column:
    """How many lines two arrays have in common from the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def removals(docs: DataFrame) -> DataFrame:
    """(__doc, __text, __gone): for each row that loses chunks, their (first line, first and last line that go with it).

    Only hashes are counted over all chunks; bodies and the lines around them travel for the chunks whose hash repeats.
    The first place of a body is found by a minimum that is taken before the shuffle too, and handed to the other places
    in as many copies as its count asks for (SPREAD), so that a very common chunk meets nowhere.
    """

    def rows(context: bool) -> DataFrame:
        # explode_outer: for explode, the optimizer would filter on a copy of the whole chunk expression
        found = with_chunks(_keyed(docs.select("doc_id", "text")), context).select("__doc", "__text", F.explode_outer("__chunks").alias("c")).select("__doc", "__text", "c.*")
        return found.where((F.col("lines") > 1) & (F.btrim("body", F.lit(" \t\n\x0b\x0c\r")) != "")).withColumn("k", F.xxhash64("body"))

    often = materialize(rows(False).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", F.ceil(F.col("n") / SPREAD).alias("parts")), "often")
    place = ["__doc", "__text", "first"]
    again = rows(True).join(bounded(often, BROADCAST_KEYS // 2), "k").withColumn("part", F.pmod(F.xxhash64(*place), F.col("parts")))
    again = materialize(again, "again")
    firsts = again.groupBy("k", "body").agg(F.min(F.struct(*place, "before", "after")).alias("at"), F.max("parts").alias("parts"))
    firsts = firsts.select("k", "body", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    later = again.drop("parts").join(firsts, ["k", "part", "body"]).where(F.struct(*place) != F.struct(*[F.col("at")[c].alias(c) for c in place]))
    low = F.col("first") - _alike(F.reverse("before"), F.reverse(F.col("at")["before"]))
    high = F.col("first") + F.col("lines") - 1 + _alike(F.col("after"), F.col("at")["after"])
    return later.groupBy("__doc", "__text").agg(F.collect_set(F.struct("first", low.alias("low"), high.alias("high"))).alias("__gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, text without its repeated chunks, and n_lines, n_chunks, n_removed_chunks, n_removed_lines.

    n_removed_lines counts the lines that removed chunks are extended by too. Every removed line stands, beside the same
    chunk, in an earlier place. The extension ends with the chunk's neighbour (REACH lines before it on the left). Kept lines
    are joined by \\n; a document may end up empty. Null text counts as empty and stays null; rows with a null doc_id come
    first in the order; rows that share a doc_id (or have none) but not the text are ordered by a hash of the text; equal rows
    (doc_id and text) are one document and all get its result. Chunks without a word are never removed by themselves, only as
    an extension. An empty table gives an empty result. Other columns stay as they are; ones named like the four counts are
    replaced.
    """
    gone = materialize(removals(docs), "gone")
    keys = materialize(gone.select(F.xxhash64("__doc", "__text").alias("__key")), "keys")
    # the row travels as one struct, so that no column of docs can clash with those used here; only rows that lose something are shuffled
    found = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text")).drop("doc_id", "text").withColumn("__key", F.xxhash64("__doc", "__text"))
    small = bounded(keys)
    rest = found.join(small, "__key", "left_anti").select("__row", F.lit(None).cast(gone.schema["__gone"].dataType).alias("__gone"))
    hit = found.join(small, "__key", "left_semi").join(gone, ["__doc", "__text"], "left").select("__row", "__gone")
    found = with_ends(rest.unionByName(hit).withColumn("text", F.col("__row")["text"]))
    none = F.array().cast("array<int>")
    lost = F.coalesce(F.flatten(F.transform("__gone", lambda g: F.sequence(g["low"], g["high"]))), none)
    found = found.withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.array_except(F.sequence(F.lit(1), F.size("__lines")), lost)))
    kept = F.array_join(F.transform("__kept", lambda i: F.get("__lines", i - 1)), "\n")
    n = F.size("__lines")
    counts = {"n_lines": n, "n_chunks": F.size("__ends"), "n_removed_chunks": F.coalesce(F.array_size("__gone"), F.lit(0)), "n_removed_lines": F.coalesce(n - F.array_size("__kept"), F.lit(0))}
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept).alias("text")
    own = [text if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns if c not in counts]
    return found.select(*own, *[v.alias(k) for k, v in counts.items()])

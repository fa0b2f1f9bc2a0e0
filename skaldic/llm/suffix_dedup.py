"""Suffix-array dedup (operator 4): bytes covered by strings of WIDTH bytes that also start earlier are removed.

A whole corpus in one suffix array would be one task's work. Equal strings of WIDTH bytes have equal least hashes
of the KMER-byte strings in them, so every run of neighbouring windows with the same least hash (its anchor) can
be dealt to a shard by that hash, and no equal pair is torn apart. Anchors that occur once hold nothing that
repeats and go. Equal runs are one string, of which all but the first occurrence are covered. Different strings
of an anchor may still share windows: those, shard by shard, are sorted by external induced sorting (see induced),
and neighbours with a common prefix of WIDTH bytes are equal windows. Under anchors with more than CROWD different
strings (a passage in very many contexts) windows are compared by 128-bit hash instead, so that no shard is
flooded. Only sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .induced import suffix_sort

WIDTH, KMER = 100, 32
#: Longest run of one string; bytes of a shard; different strings of an anchor that one shard sorts.
LONGEST, SHARD, CROWD = 512, 1_000_000, 2000
_FACTOR = 0x9E3779B97F4A7C15
_U = np.uint64


class Powers:
    """Powers of the hash factor and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate((np.ones(1, _U), np.cumprod(np.full(n, _FACTOR, _U))))
                self.down = np.concatenate((np.ones(1, _U), np.cumprod(np.full(n, pow(_FACTOR, -1, 1 << 64), _U))))
        return self.up, self.down


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[:-rest], x[rest:]) if rest else x


def runs(text: bytes, size: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, anchor, first window, windows, and whether the anchor is near itself in some text, for each run of the texts that stand end to end in `text`."""
    n = len(text)
    if n < WIDTH:
        return (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    up, down = powers.get(n)
    sums = np.zeros(n + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(np.multiply(np.frombuffer(text, np.uint8), up[:n]), out=sums[1:])
        h = sums[KMER:] - sums[:-KMER]
        h *= down[: n - KMER + 1]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
    width = WIDTH - KMER + 1
    begin = np.cumsum(size) - size
    # windows that lie in one text; the others have no anchor
    inside = np.ones(n + 1, bool)
    for k in begin.tolist():
        inside[max(k - WIDTH + 1, 0) : k] = False
    inside = inside[: n - WIDTH + 1]
    padded = np.zeros(len(h) + width - 1, _U)
    least = padded[width - 1 : len(h)]
    np.multiply(_slide(h, width, np.minimum), inside, out=least)
    cut = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])))
    count = np.diff(np.append(cut, len(least)))
    start, count = cut[inside[cut]], count[inside[cut]]
    of = np.searchsorted(begin, start, "right") - 1
    anchor, start = least[start], start - begin[of]
    # a place holds its windows' anchor if the largest least of those windows is its own hash
    places = np.flatnonzero(h == _slide(padded, width, np.maximum))
    within, key = np.searchsorted(begin, places, "right"), h[places]
    twice = key[1:][(key[1:] == key[:-1]) & (within[1:] == within[:-1])]
    if (count > LONGEST).any():
        parts = -(-count // LONGEST)
        of, anchor, whole = (np.repeat(x, parts) for x in (of, anchor, start + count))
        start = np.repeat(start, parts) + LONGEST * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        count = np.minimum(whole - start, LONGEST)
    return of, anchor, start, count, np.isin(anchor, twice) if len(twice) else np.zeros(len(anchor), bool)


#: Bytes of texts that are hashed in one go; a longer text is alone.
TOGETHER = 1 << 15


def _together(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """First and end of stretches of texts of about TOGETHER bytes."""
    at = total = 0
    for k, text in enumerate(texts):
        more = len(text or b"")
        if k > at and total + more > TOGETHER:
            yield at, k
            at, total = k, 0
        total += more
    if at < len(texts):
        yield at, len(texts)


def _rows(whole: bool):
    """Runs of (doc, th, text): anchors only, or whole rows with the hash of their string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            doc, th, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in _together(texts):
                some = [text or b"" for text in texts[a:b]]
                size = np.array([len(text) for text in some])
                of, anchor, start, n, own = runs(b"".join(some), size, powers)
                if not len(of):
                    continue
                out = {"anchor": pa.array(anchor.view(np.int64)), "own": pa.array(own)}
                if whole:
                    strings = [xxhash.xxh3_64_intdigest(some[k][s:e]) for k, s, e in zip(of.tolist(), start.tolist(), (start + n + WIDTH - 1).tolist())]
                    strings = np.array(strings, _U).view(np.int64)
                    out = {"doc": pa.array(doc[a:b][of]), "th": pa.array(th[a:b][of]), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "string": pa.array(strings)} | out
                yield pa.RecordBatch.from_pydict(out)

    return run


ROW = "doc long, th long, start int, n int, string long, anchor long, own boolean"


def _cut_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed runs of each text. Equal rows of a batch go in once; copies that are left share their places, which is no repeat."""
    for batch in batches:
        seen: dict[tuple, int] = {}
        for k, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            seen.setdefault(row, k)
        if len(seen) < len(batch):
            batch = batch.take(pa.array(list(seen.values())))
        for at in range(0, len(batch), 500):
            doc, th, text, wanted = batch.slice(at, 500).columns
            of, listed, text = pc.list_parent_indices(wanted), wanted.flatten(), text.to_pylist()
            start, n, anchor, crowded = (listed.field(k) for k in ("start", "n", "anchor", "crowded"))
            cut = [text[k][s : s + m + WIDTH - 1] for k, s, m in zip(of.to_pylist(), start.to_pylist(), n.to_pylist())]
            yield pa.RecordBatch.from_arrays([doc.take(of), th.take(of), start, n, anchor, crowded, pa.array(cut, pa.binary())], ["doc", "th", "start", "n", "anchor", "crowded", "bytes"])


STRING = "doc long, th long, start int, n int, anchor long, crowded boolean, bytes binary"
INTERVAL = "doc long, th long, start int, n int"


def repeated_windows(doc: np.ndarray, th: np.ndarray, start: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, first window and windows of the stretches in `strings` that repeat an earlier window."""
    text = b"\xff".join(strings)  # a byte that no UTF-8 text has
    raw = np.concatenate((np.frombuffer(text, np.uint8), np.zeros(WIDTH + 16, np.uint8)))
    sa, lcp = suffix_sort(np.append(raw[: len(text)].astype(np.uint16) + 1, 0), raw, WIDTH)
    size = np.array([len(s) for s in strings])
    begin = np.cumsum(size + 1) - size - 1
    # by position in the text: whether a window starts there, and its place in the order of documents (copies share theirs)
    window = np.repeat(np.tile([True, False], len(size)), np.stack([size - WIDTH + 1, np.full(len(size), WIDTH)], 1).ravel())
    order = np.lexsort((start, th, doc))
    fresh = np.zeros(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (th[order][1:] != th[order][:-1]) | (start[order][1:] != start[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) * (size.max() + 1)
    place = np.repeat(rank - begin, size + 1) + np.arange(len(window))
    # a group is a window and all neighbours that share WIDTH bytes with it
    group = np.cumsum(lcp < WIDTH)
    ok = window[sa]
    group, sa = group[ok], sa[ok]
    place = place[sa]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    first = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(group))))
    late = np.sort(sa[place != first])
    if not len(late):
        return late, late, late
    fresh = np.append(0, np.flatnonzero(np.diff(late) != 1) + 1)
    owner = np.searchsorted(begin, late[fresh], "right") - 1
    return owner, late[fresh] - begin[owner], np.diff(np.append(fresh, len(late)))


def _sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a shard's strings that repeat an earlier window: each partition is a shard or a few."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    order = np.argsort(table["anchor"].to_numpy(), kind="stable")
    strings = table["bytes"].to_pylist()
    doc, th, start, anchor = (table[c].to_numpy() for c in ("doc", "th", "start", "anchor"))
    del table, parts
    size = np.cumsum([len(strings[k]) for k in order.tolist()])
    edges = [0]
    for k in np.flatnonzero(np.diff(anchor[order])).tolist():  # an anchor's strings stay together
        if size[k] - (size[edges[-1] - 1] if edges[-1] else 0) >= SHARD:
            edges.append(k + 1)
    for a, b in zip(edges, [*edges[1:], len(order)]):
        some = order[a:b]
        owner, at, n = repeated_windows(doc[some], th[some], start[some].astype(np.int64), [strings[k] for k in some.tolist()])
        if len(owner):
            k = some[owner]
            yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(th[k]), pa.array((start[k] + at).astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "th", "start", "n"])


def _hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, th, start, n, _, _, text in zip(*(c.to_pylist() for c in batch.columns)):
            keys = [xxhash.xxh3_128_digest(text[k : k + WIDTH]) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(range(start, start + n), pa.int32()), pa.array(keys, pa.binary())], ["doc", "th", "start", "key"])


def intervals(texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc, th, start, n) of (doc, th, text binary): n windows from byte `start` on that repeat an earlier window."""
    anchors = texts.mapInArrow(_rows(False), "anchor long, own boolean").groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("o"))
    often = materialize(anchors.where("c > 1 or o").select("anchor"), "anchors")
    rows = materialize(texts.mapInArrow(_rows(True), ROW).join(often, "anchor", "left_semi").select("doc", "th", "start", "n", "string", "anchor", "own"), "runs")  # equal rows give equal places
    place = F.struct("doc", "th", "start", "n")
    firsts = materialize(rows.groupBy("anchor", "string").agg(F.min(place).alias("first"), F.max("own").alias("own"), F.count(F.lit(1)).alias("c")), "strings")
    other = firsts.where("c > 1").select(F.col("anchor").alias("a"), F.col("string").alias("s"), "first")
    later = rows.join(other, (F.col("anchor") == F.col("a")) & (F.col("string") == F.col("s")) & (place != F.col("first"))).select("doc", "th", "start", "n")
    shared = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.max("own").alias("o")).where("k > 1 or o").select(F.col("anchor").alias("a"), (F.col("k") > crowd).alias("crowded"))
    wanted = firsts.join(shared, F.col("anchor") == F.col("a")).groupBy(F.col("first.doc").alias("d"), F.col("first.th").alias("t"))
    wanted = wanted.agg(F.collect_list(F.struct(F.col("first.start").alias("start"), F.col("first.n").alias("n"), "anchor", "crowded")).alias("wanted"))
    strings = materialize(texts.join(wanted, (F.col("doc") == F.col("d")) & (F.col("th") == F.col("t"))).select("doc", "th", "text", "wanted").mapInArrow(_cut_strings, STRING), "bytes")
    total = strings.where("not crowded").agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    sorted_ = strings.where("not crowded").repartition(1 + total // SHARD, "anchor").mapInArrow(_sort_shard, INTERVAL)
    windows = materialize(strings.where("crowded").mapInArrow(_hash_windows, "doc long, th long, start int, key binary"), "windows")
    early = windows.groupBy("key").agg(F.min(F.struct("doc", "th", "start")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"), "first")
    hashed = windows.join(early, (F.col("key") == F.col("k")) & (F.struct("doc", "th", "start") != F.col("first"))).select("doc", "th", "start", F.lit(1).alias("n"))
    return later.unionByName(sorted_).unionByName(hashed)


def listed(texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(d, t, found) by document: its intervals, each once, as all copies of an equal row find the same ones."""
    return intervals(texts, crowd).groupBy(F.col("doc").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct("start", "n")).alias("found"))


def _spans(of: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and end of the maximal byte ranges that the windows of each text cover, in order."""
    if not len(of):
        return of, start, n
    order = np.lexsort((start, of))
    of, start, end = of[order], start[order], (start + n + WIDTH - 1)[order]
    far = np.maximum.accumulate(of * (1 << 32) + end)  # a text's ends exceed all of the texts before
    fresh = np.flatnonzero(np.append(True, of[1:] * (1 << 32) + start[1:] > far[:-1]))
    return of[fresh], start[fresh], far[np.append(fresh[1:], len(of)) - 1] - of[fresh] * (1 << 32)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, found = batch.column(1).to_pylist(), batch.column(2)
        listed = found.flatten()
        of, start, end = _spans(pc.list_parent_indices(found).to_numpy().astype(np.int64), *(listed.field(k).to_numpy().astype(np.int64) for k in ("start", "n")))
        count = np.bincount(of, minlength=len(texts))
        offsets = np.append(0, np.cumsum(count))
        gone = np.append(0, np.cumsum(end - start))[offsets]
        digests = []
        first, last = start.tolist(), end.tolist()
        for k, (x, y) in enumerate(pairwise(offsets.tolist())):
            text = texts[k] or b""
            kept, at = hashlib.sha256(), 0
            for j in range(x, y):
                kept.update(text[at : first[j]])
                at = last[j]
            kept.update(text[at:])
            digests.append(kept.hexdigest())
        spans = pa.ListArray.from_arrays((2 * offsets).astype(np.int32), np.stack([start, end], 1).ravel().astype(np.int32))
        cols = [batch.column(0), pa.array([len(text or b"") for text in texts], pa.int64()), pa.array(np.diff(gone)), pa.array(count.astype(np.int64)), pa.array(digests, pa.string()), spans]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of `docs` (doc_id, text).

    spans: first byte and end of each maximal removed run. Null text counts as empty; a null doc_id comes before
    all others; equal rows (doc_id and text) are one document and all get its result; rows that share a doc_id but
    not the text are ordered by a hash of the text. Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    found = listed(texts.select("doc", "th", "text"), crowd)
    joined = texts.join(found, (F.col("doc") == F.col("d")) & (F.col("th") == F.col("t")), "left").select(F.col("doc_id").cast("long"), "text", "found")
    return joined.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>")

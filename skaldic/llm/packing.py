"""Best-fit packing by exact-complement hashing (operator 1).

Texts are cut into pieces of at most `capacity` tokens. Only the histogram of piece lengths reaches the driver:
`capacity` lengths x BUCKETS hash buckets, and one bucket more for each GROUP pieces of a length. There a plan is made: for every length the gap to
a full sequence is looked up among single lengths, sums of two and sums of three, and combinations that fill
it exactly are consumed as often as the counts allow; what is left goes through best-fit decreasing, also on
counts. The plan says which ranks of a length go to which sequences and offsets, and the ranks are dealt out
in parallel: by length and by a hash bucket, so that no length, however common, meets in one task.
"""

from __future__ import annotations

import ctypes
import os
import re
import threading
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Sub-groups of one length, at least, and pieces of a sub-group, about: ranks are counted in each and then added up.
BUCKETS, GROUP = 64, 1_000_000
#: Entries of the word cache of a Python worker before it is emptied.
CACHE = 400_000
#: Encoders of this worker process by path: its next tasks know the words already. Workers outlive their tasks, so
#: encoders that no task has used for IDLE seconds go, and other operators' tasks have the memory.
_ENCODERS: dict[str, WordEncoder] = {}
IDLE = 2.0


def _classes() -> tuple[bytes, bytes, bytes]:
    """Latin-1 letters, numbers and all other characters but the tokenizer's white space, escaped for a set in a pattern."""
    kinds: dict[str, list[int]] = {"L": [], "N": [], "": []}
    for b in range(256):
        if b not in SPACE_BYTES:
            kind = unicodedata.category(chr(b))[0]
            kinds[kind if kind in kinds else ""].append(b)
    return tuple(b"".join(b"\\x%02x" % b for b in found) for found in kinds.values())


#: White space of the tokenizer within Latin-1; bytes.split() knows all but the last two.
SPACE_BYTES = frozenset(b" \t\n\x0b\x0c\r\x85\xa0")
#: The tokenizer's own split of a lowered word into parts, over Latin-1 bytes.
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[%b]+|[%b]|[%b]+" % _classes()).findall


def _byte_level() -> dict[int, str]:
    """What the tokenizer's byte level makes of each Latin-1 character: its UTF-8 bytes, those that can't be printed moved to 256 and up."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in printed]
    names = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(moved)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(256)}


_BYTE_LEVEL = _byte_level()


class Words(dict[bytes, bytes]):
    """Ids of lowered Latin-1 words. A word asked for the first time is parted, its parts are encoded by the tokenizer's model."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize = tokenize

    def __missing__(self, word: bytes) -> bytes:
        parts = _PARTS(word)
        if len(parts) == 1:
            ids = array("I", [t.id for t in self.tokenize(word.decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
        else:
            ids = b"".join([self[p] for p in parts])
        self[word] = ids
        return ids


class WordEncoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to the tokenizer's own.

    The tokenizer drops white space and never joins across it or across the parts of a word, so every different
    part is encoded by the tokenizer's own model, without its slow normalizing and splitting of whole texts, and words
    are remembered. Texts with characters beyond Latin-1 or with `<|` (special tokens) go to the tokenizer as they are.
    """

    #: Latin-1 lowered; its two spaces beyond ASCII become blanks.
    LOWER = bytes(ord(chr(b).lower()) if b not in (0x85, 0xA0) else 32 for b in range(256))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.word = Words(self.tokenizer.model.tokenize)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        try:
            latin = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if b"<|" in latin:
            return self.whole(text)
        if len(self.word) >= CACHE:
            self.word.clear()
        return b"".join(map(self.word.__getitem__, latin.translate(self.LOWER).split()))


def _drop() -> None:
    """Forget the encoders and hand what they took back to the system, where the C library can."""
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


@contextmanager
def lent(path: str) -> Iterator[WordEncoder]:
    """This process's encoder for a task; it is dropped if no other task asks for one within IDLE seconds."""
    for waiting in [t for t in threading.enumerate() if t.name == "idle encoders"]:
        waiting.cancel()
    try:
        yield _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordEncoder(path))
    finally:
        end = threading.Timer(IDLE, _drop)
        end.name, end.daemon = "idle encoders", True
        end.start()


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(path) as encoder:
            yield from pieces(batches, encoder)

    def pieces(batches: Iterator[pa.RecordBatch], encoder: WordEncoder) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = encoder.encode(text or "") + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order, how many sequences) that use up exactly the counted lengths.

    Exact complements first (one, two, then three lengths that fill the gap of a length, longest first),
    then best-fit decreasing. Both work on counts: the number of steps depends on `capacity`, not on the rows.
    """
    have = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        have[n] += k
    plan: list[tuple[list[int], int]] = []

    def take(lengths: list[int]) -> bool:
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        times = min(int(have[n]) // k for n, k in need.items())
        if times:
            for n, k in need.items():
                have[n] -= k * times
            plan.append((lengths, times))
        return times > 0

    def pairs(total: int) -> np.ndarray:
        """First members a <= total - a of the available pairs of this sum, longest partner first."""
        low = np.arange(1, total // 2 + 1)
        return low[(have[low] > 0) & (have[total - low] > 0)] if total > 1 else low

    for n in range(capacity, 0, -1):
        if not have[n]:
            continue
        gap = capacity - n
        if gap == 0:
            take([n])
            continue
        take([n, gap])
        if have[n]:
            for a in pairs(gap).tolist():
                take([n, gap - a, a])
                if not have[n]:
                    break
        if have[n] and gap > 2:
            for a in np.flatnonzero(have[1 : gap // 3 + 1]).tolist():
                for b in pairs(gap - a - 1).tolist():
                    take([n, gap - a - 1 - b, b, a + 1])
                    if not have[n] or not have[a + 1]:
                        break
                if not have[n]:
                    break
    bins: dict[int, list[tuple[list[int], int]]] = {}
    gaps: list[int] = []

    def put(lengths: list[int], times: int, gap: int) -> None:
        if gap == 0:
            plan.append((lengths, times))
            return
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((lengths, times))

    for n in range(capacity, 0, -1):
        left = int(have[n])
        while left:
            k = bisect_left(gaps, n)
            if k < len(gaps):
                gap = gaps[k]
                lengths, times = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap], gaps[k]
            else:
                gap, lengths, times = capacity, [], left
            each = gap // n
            full = min(times, left // each)
            if full:
                put(lengths + [n] * each, full, gap - n * each)
                left -= full * each
                rest = times - full
            else:
                put(lengths + [n] * left, 1, gap - n * left)
                left, rest = 0, times - 1
            if rest and lengths:
                put(lengths, rest, gap)
    return plan + [x for g in gaps for x in bins[g]]


def _places(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), first sequence and offset for each slot of the plan."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            rows.append(((n << 44) + rank.get(n, 0), sequence, offset))
            rank[n] = rank.get(n, 0) + times
            offset += n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """The pieces of every text: its ids and a closing 0, cut only where longer than `capacity`.

    Null text counts as empty (one piece, the closing 0); doc_id may be null or repeat.
    """
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer_path, capacity), PIECES)


def pack(pieces: DataFrame, capacity: int = 2048, buckets: int = BUCKETS, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Every piece gets one place; the pieces of a sequence adjoin from offset 0 and end by `capacity`. Equal
    rows are interchangeable. An empty table gives an empty result. Extra columns of `pieces` are dropped.
    """
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    by_length = dict(pieces.groupBy("length").count().collect())  # at most capacity rows
    parts = F.lit(",".join(str(max(buckets, by_length.get(n, 0) // group)) for n in range(1, capacity + 1)))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.get(F.split(parts, ",").cast("array<bigint>"), F.col("length").cast("int") - 1))
    pieces = pieces.withColumn("bucket", bucket)
    by_bucket = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity * buckets rows, and one for each `group` pieces
    counts: dict[int, int] = {}
    before: dict[int, int] = {}
    for r in sorted(by_bucket):
        before[(r.length << 44) + r.bucket] = counts.get(r.length, 0)
        counts[r.length] = counts.get(r.length, 0) + r.n
    keys, sequences, offsets = _places(plan_sequences(counts, capacity))
    groups = np.array(sorted(before), np.int64)
    bases = np.array([before[g] for g in groups.tolist()], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, bucket, nth = (batch.column(k).to_numpy() for k in (3, 5, 6))
            ranks = bases[np.searchsorted(groups, (length << 44) + bucket)] + nth - 1
            wanted = (length << 44) + ranks
            at = np.searchsorted(keys, wanted, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences[at] + wanted - keys[at]), pa.array(offsets[at])], [*batch.schema.names[:5], "sequence_id", "offset"])

    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return pieces.withColumn("nth", F.row_number().over(order).cast("long")).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """cut, written once to the shared folder (the texts are tokenized once), then pack.

    Null and empty texts are one piece of one id; very long texts become as many pieces as they need; equal rows and
    rows that share a doc_id or have none are packed each on its own; an empty table gives an empty result; other
    columns are ignored.
    """
    return pack(materialize(cut(docs, tokenizer_path, capacity), "pieces"), capacity)

"""Quality classifier (operator 9): random Fourier features of document statistics, ridge, isotonic calibration.

Every text becomes a vector of STATS statistics. cos(Wx + b) with Gaussian W approximates a Gaussian kernel
over the standardised vectors. Each partition sums Z'Z and Z'y of its labelled rows; those sums, of a size
that does not depend on the corpus, are added up and solved on the driver. Raw scores of labelled rows that
the ridge did not see are counted in bins, and pool-adjacent-violators over the bins turns raw scores into
probabilities. All labelled rows are used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, bounded, fold, materialize

FEATURES, RIDGE, BANDWIDTH, BINS = 256, 1e-3, 6.0, 2048
#: Very common short words of the languages at hand: their share tells prose from lists and junk.
STOP = frozenset("the of and to in is that for it as was with on be by la le les de des et un une du que qui en dans pour est der die das und ist ein eine zu den von mit el los las y se por con su al".encode().split())
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"#*$%&|<>@^~_=+{}[]\\/", b"\"'()-"), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 10
STATS = 11 + 17


def statistics(raw: bytes) -> np.ndarray:
    """STATS numbers about a whole text (UTF-8); an empty text gives zeros."""
    out = np.zeros(STATS)
    if not raw:
        return out
    n = len(raw)
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=11)
    out[:11] = np.sqrt(kinds / n)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lower = [x.lower() for x in words]
    upper = sum(x.isupper() for x in words)
    out[11:] = (
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()),
        len(seen) / w, max(seen.values(), default=0) / w, sum(x in STOP for x in lower) / w, upper / w,
        len(set(zip(words, words[1:]))) / w, len(set(zip(words, words[1:], words[2:], words[3:]))) / w, len(set(lines)) / k,
        np.log1p(len(words) / k), len(zlib.compress(raw, 1)) / n, raw.count(b". ") / w, sum(x[:1].isupper() for x in words) / w,
    )
    return out


def _stats(texts: list) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts]).reshape(-1, STATS)


def _stats_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys: long, stats array<float>) for every row of (keys..., text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stats(batch.column(len(keys)).to_pylist()).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * STATS, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], [*keys, "stats"])

    return docs.select(*keys, F.col("text").cast("binary")).mapInArrow(run, "".join(f"{k} long, " for k in keys) + "stats array<float>")


def document_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<float>) for every row."""
    return _stats_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATS).astype(np.float64)


#: Vectors that one task adds up.
FAN = 64


def partition_sum(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of a vector of `size` numbers: by partition, then twice FAN at a time, then here, always in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for s in parts.sort_values("part").sums:
            total += np.frombuffer(s)
        return pd.DataFrame({"part": [parts.part.iloc[0] // FAN], "sums": [total.tobytes()]})

    rows = df.mapInArrow(run, "part int, sums binary")
    for _ in range(2):
        rows = rows.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(add, "part int, sums binary")
    return sum((np.frombuffer(r.sums) for r in sorted(rows.collect())), np.zeros(size))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    at: np.ndarray
    probability: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.weights + self.phase) * np.sqrt(2 / FEATURES)
        return np.hstack([z, x / np.sqrt(STATS), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.probability), 0, 1)


def isotonic(at: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: block centres and their rates, not falling."""
    blocks: list[list[float]] = []
    for a, h, k in zip(at.tolist(), hits.tolist(), n.tolist()):
        blocks.append([a * k, h, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 0) -> Model:
    """Learn from the labelled rows whose crc32(doc_id) mod 5 is not `held_out`.

    Rows with a null label are not used; a doc_id with several labels or rows counts once for each. Without
    labelled rows every score is 0.5.
    """
    labels = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("labelled"), F.col(label).cast("double").alias("y"))
    train = stats.join(labels, stats.doc_id == F.col("labelled")).select("stats", "y", fold(F.col("doc_id")).alias("fold"))
    train = materialize(train.where(F.col("fold") != held_out), "train").select("stats", "y", "fold")
    calibrate = (held_out + 4) % 5
    rng = np.random.default_rng(9)
    model = Model(np.zeros(STATS), np.ones(STATS), rng.normal(size=(STATS, FEATURES)) / BANDWIDTH, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + STATS + 1), np.array([0.0]), np.array([0.5]))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    m = partition_sum(train, moments, 1 + 2 * STATS)
    if not m[0]:
        return model
    model.mean = m[1 : 1 + STATS] / m[0]
    model.scale = np.sqrt(np.maximum(m[1 + STATS :] / m[0] - model.mean**2, 1e-6))
    d = FEATURES + STATS + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(z)]])

    learn = train.where(F.col("fold") != calibrate)
    sums = partition_sum(learn, normal, d * d + d + 1)
    if not sums[-1]:
        sums = partition_sum(train, normal, d * d + d + 1)
    model.ridge = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * sums[-1] * np.eye(d), sums[d * d : -1])

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip((model.raw(_matrix(batch.column(0))) + 0.5) * (BINS / 2), 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=batch.column(1).to_numpy(), minlength=BINS)])

    counted = partition_sum(train.where(F.col("fold") == calibrate), histogram, 2 * BINS)
    if not counted.any():
        counted = partition_sum(train, histogram, 2 * BINS)
    used = np.flatnonzero(counted[:BINS])
    model.at, model.probability = isotonic((used + 0.5) / (BINS / 2) - 0.5, counted[BINS:][used], counted[:BINS][used])
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text; other columns are ignored).

    Null text counts as empty, which has a score like any other; null doc_id is in fold 0. Repeated rows stay;
    equal texts have equal scores; very long texts count whole; without labels every score is 0.5; an empty table gives
    an empty result.
    """
    stats = materialize(document_stats(docs), "stats")
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with all their columns of any name; odd rows as in classify().

    Every text is read for its statistics once; the rows that go are found again by their keys.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    stats = materialize(_stats_of(keyed, ["doc_id", "th"]), "stats")
    model = fit(stats.select("doc_id", "stats"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = model.score(_matrix(batch.column(2))) < threshold
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["__doc", "__th"]).filter(pa.array(low))

    gone = materialize(stats.mapInArrow(run, "__doc long, __th long").distinct().withColumn("__place", F.xxhash64("__doc", "__th")), "rejected")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("__d"), F.xxhash64("text").alias("__t")).withColumn("__p", F.xxhash64("__d", "__t"))
    same = (F.col("__p") == F.col("__place")) & F.col("__d").eqNullSafe(F.col("__doc")) & (F.col("__t") == F.col("__th"))
    return rows.join(bounded(gone, BROADCAST_KEYS // 3), same, "left_anti").select("__row.*")

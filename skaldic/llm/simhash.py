"""SimHash near-duplicates found with pivot distance tables (operator 6).

Fingerprints have 64 bits over word shingles. For each fingerprint the Hamming distances to many reference
fingerprints (pivots) are computed once: to LANE_PIVOTS references in each of four 16-bit lanes, and to
PIVOTS references over all 64 bits. Two bits that differ leave at least two lanes untouched, so linked
fingerprints agree in all pivot distances of some pair of lanes: that pair of distance vectors is the key
under which candidates meet, and no link is missed. Candidates whose distances to some full reference differ
by more than the limit are discarded (triangle inequality) before the survivors are verified bit by bit.

Equal fingerprints are one node, so copies never meet as pairs. Keys with more than `crowd` different
fingerprints emit no pairs: within such a key, fingerprints are at most two bits apart exactly if they share
a neighbour at one bit or fewer, so each is listed under its 33 neighbours in the open lanes, and under any
neighbour at most 33 meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, bounded, materialize
from .graph import components

LANE_PAIRS = [(a, b) for a in range(4) for b in range(a)]
LANE_PIVOTS, PIVOTS, CROWD = 8, 8, 48
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included; fewer words: of all of them; none: empty."""
    words = text.lower().split()  # of bytes: lowers A-Z only, splits at ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    return majority(shingles(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()), "<u8", len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _reference(k: int) -> int:
    """The k-th reference fingerprint, as a signed 64-bit integer."""
    x = xxhash.xxh64_intdigest(f"pivot {k}", 0)
    return x - (1 << 64) if x >> 63 else x


def _lane(fp: Column, lane: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * lane).bitwiseAND(F.lit(0xFFFF))


def _lane_distances(fp: Column, lane: int) -> Column:
    """Distances of a lane to its references, 5 bits each in one long."""
    out = F.lit(0).cast("long")
    for k in range(LANE_PIVOTS):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(_lane(fp, lane).bitwiseXOR(F.lit(_reference(k) & 0xFFFF))).cast("long"), 5 * k))
    return out


def _pivots(fp: Column) -> Column:
    """Distances to the full references, 7 bits each in one long."""
    out = F.lit(0).cast("long")
    for k in range(PIVOTS):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_reference(LANE_PIVOTS + k)))).cast("long"), 7 * k))
    return out


def _near(x: Column, y: Column, most: int) -> Column:
    """No coordinate of two packed pivot vectors differs by more than `most`."""
    at = lambda c, k: F.shiftrightunsigned(c, 7 * k).bitwiseAND(F.lit(127))
    out = F.lit(True)
    for k in range(PIVOTS):
        out = out & (F.abs(at(x, k) - at(y, k)) <= most)
    return out


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) of `nodes` (fp, rep), fp unique, that hold the same components as all links at 2 or fewer differing bits."""
    fp = F.col("fp")
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.xxhash64(F.lit(k), F.element_at("lanes", a + 1), F.element_at("lanes", b + 1)).alias("key")) for k, (a, b) in enumerate(LANE_PAIRS)])
    rows = nodes.select("fp", "rep", _pivots(fp).alias("pv"), F.array(*[_lane_distances(fp, k) for k in range(4)]).alias("lanes"))
    rows = materialize(rows.select("fp", "rep", "pv", F.explode(tables).alias("e")).select("fp", "rep", "pv", "e.t", "e.key"), "lanes")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes, "sizes")
    some = rows.join(sizes.where(F.col("n") <= crowd).select("key"), "key", "left_semi")
    x, y = some.alias("x"), some.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _near(F.col("x.pv"), F.col("y.pv"), 2))
    pairs = pairs.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2).select(F.col("x.rep").alias("u"), F.col("y.rep").alias("v"))
    many = rows.join(sizes.where(F.col("n") > crowd).select("key"), "key", "left_semi")
    flips = None
    for k, (a, b) in enumerate(LANE_PAIRS):
        own = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long") for i in range(64) if i // 16 not in (a, b)])
        flips = F.when(F.col("t") == k, own) if flips is None else flips.when(F.col("t") == k, own)
    stars = many.select("rep", "t", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("z"))
    meet = stars.groupBy("t", "z").agg(F.collect_list("rep").alias("reps")).where(F.size("reps") > 1)  # at most 33 each
    meet = meet.select(F.array_min("reps").alias("u"), F.explode("reps").alias("v")).where("u <> v")
    return pairs.unionByName(meet)


def near_duplicates(docs: DataFrame, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text; other columns are ignored).

    Fingerprints at 2 or fewer differing bits link; component_id is the smallest doc_id reachable, the own
    one included. Null text counts as blank (fingerprint 0, linked like any other); rows with a null doc_id
    keep their fingerprint and its component; repeated rows stay. An empty table gives an empty result.
    """
    found = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    known = components(links(nodes.where("rep is not null"), crowd))
    named = nodes.join(known, nodes.rep == known.node, "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    return found.join(named, found.fp == named.of).select("doc_id", "fp", "component_id")


#: Min-hash blocking of one_of_each: BANDS keys of ROWS minima; at 0.8 a pair shares a key with probability 0.997.
BANDS, ROWS = 8, 3
#: Sets at Jaccard 0.8 have fingerprints at 9.7 bits on average, standard deviation 2.9: one pair in ten millions is beyond.
FARTHEST = 26
#: Texts a block of a crowded key, about; two blocks are compared at once.
BLOCK = 256
_RNG = np.random.default_rng(6)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
SKETCH = "doc_id long, th long, node long, n long, fp long, keys array<long>"


def _sketch(shingle: int):
    """Of (doc_id, th, text): the node (a hash of the lower-cased words), the number and the fingerprint of its different shingles, its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                text = text or b""
                h = np.unique(shingles(text, shingle))
                keys: list[int] = []
                if len(h):
                    low = np.array([(h * a + b).min() for a, b in zip(_A, _B)]).reshape(BANDS, ROWS)
                    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) >> 1 for k, row in enumerate(low)]
                rows.append((int.from_bytes(xxhash.xxh3_64_digest(b" ".join(text.lower().split())), "big", signed=True), len(h), np.uint64(majority(h)).view(np.int64), keys))
            cols = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "th", "node", "n", "fp", "keys"])

    return run


def _jaccard(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.unique(shingles(a or b"", shingle)), np.unique(shingles(b or b"", shingle))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * max(1, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(t or b"", shingle)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    return run


def linked(sets: list[np.ndarray], least: float, width: int = 8192) -> np.ndarray:
    """For each set the smallest place of its component, where sets at Jaccard `least` or more are linked."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    row, both = np.repeat(np.arange(n), sizes), np.zeros((n, n), np.int64)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for k in range(0, len(known), width):  # all pairs by matrix products over `width` shingles at a time
        a, b = np.searchsorted(at, (k, k + width))
        some = np.zeros((n, width), np.float32)
        some[row[a:b], at[a:b] - k] = 1
        both += (some @ some.T).astype(np.int64)
    near = (both >= least * np.maximum(1, sizes[:, None] + sizes - both)) | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(near, label, n).min(axis=1)
        if (new == label).all():
            return label
        label = new


def _compare(least: float):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("node").to_pylist()
        first = linked([np.frombuffer(s, "<u8") for s in group.column("shingles").to_pylist()], least)
        pairs = {(ids[k], v) for k, v in zip(first.tolist(), ids) if ids[k] != v}
        return pa.table({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})

    return run


def _crowded(many: DataFrame, star: DataFrame, texts: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """Links that join what all pairs under the crowded keys would join: many (band, key, head, node), star (u, v): links to heads.

    Texts linked to the head are joined already, so only the others, the strays, are compared with every text
    of the key: in blocks, of which each with strays meets every other one.
    """
    marked = many.join(star, (F.least("head", "node") == star.u) & (F.greatest("head", "node") == star.v), "left")
    marked = marked.select("band", "key", "node", (F.col("v").isNull() & (F.col("node") != F.col("head"))).alias("stray"))
    marked = materialize(marked, "marked")
    counts = marked.groupBy("band", "key").agg(F.count_if("stray").alias("s"), F.count_if(~F.col("stray")).alias("m")).where("s > 0")
    ns, nm = F.ceil(F.col("s") / block), F.ceil(F.col("m") / block)
    placed = marked.join(counts.select("band", "key", ns.alias("ns"), nm.alias("nm")), ["band", "key"])
    h = F.xxhash64("node")
    placed = placed.withColumn("own", F.when(F.col("stray"), F.pmod(h, F.col("ns"))).otherwise(F.col("ns") + F.pmod(h, F.col("nm"))))
    met = F.filter(F.sequence(F.lit(0).cast("long"), F.col("ns") + F.col("nm") - 1), lambda x: (x != F.col("own")) & (F.least(x, F.col("own")) < F.col("ns")))
    met = placed.select("band", "key", "node", "own", F.explode(F.when(F.size(met) > 0, met).otherwise(F.array("own"))).alias("other"))
    met = met.select("band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("node").alias("of"))
    met = materialize(met, "blocks")
    own = texts.join(met.select("of").distinct(), F.col("node") == F.col("of"), "left_semi")
    sets = materialize(own.mapInArrow(_sets(shingle), "node long, shingles binary"), "sets")
    full = met.join(sets, met.of == sets.node).select("band", "key", "x", "y", "node", "shingles")
    return full.groupBy("band", "key", "x", "y").applyInArrow(_compare(similarity), "u long, v long")


def _at_two_bits(nodes: DataFrame, crowd: int) -> DataFrame:
    """Candidates (u, v) among `nodes` (node, fp): operator 6's search, so all links at 2 or fewer differing bits are joined by them."""
    fps = materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("k")), "fps")
    same = nodes.select("fp", "node").join(fps.where("k > 1").select("fp", "rep"), "fp").where("node <> rep")
    found = links(fps.select("fp", "rep"), crowd).unionByName(same.select(F.col("rep").alias("u"), F.col("node").alias("v")))
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def grouped(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, component_id, kept) for every row with a doc_id; th is a hash of the text, for doc_ids that repeat.

    Texts with equal lower-cased words are one node. Candidates are the links of operator 6's search by pivot
    distance tables over the fingerprints (`links`: 2 or fewer differing bits, none missed), and, as similar texts
    often differ in more bits than any such search can afford, also nodes that share a min-hash key. Of the latter,
    those whose numbers of shingles can't reach the similarity go, then those whose distances to some reference
    fingerprint differ by more than FARTHEST (pivot tables) or whose fingerprints do. All survivors are verified on
    the whole texts: pair by pair under keys of up to `crowd` nodes; under larger ones first against the key's
    smallest node, then in blocks (_crowded). `kept` marks the rows with the smallest (doc_id, th) of their component.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    found = materialize(rows.mapInArrow(_sketch(shingle), SKETCH), "sketches")
    nodes = found.groupBy("node").agg(F.min(F.struct("doc_id", "th", "n", "fp", "keys")).alias("f"))
    nodes = materialize(nodes.select("node", "f.*"), "nodes")
    keyed = nodes.select("node", "n", "fp", _pivots(F.col("fp")).alias("pv"), F.posexplode("keys").alias("band", "key"))
    keyed = materialize(keyed, "bands")
    sizes = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("head")).where("k > 1")
    sizes = materialize(sizes, "sizes")
    few = keyed.join(sizes.where(F.col("k") <= crowd).select("band", "key"), ["band", "key"], "left_semi")
    x, y = few.alias("x"), few.alias("y")
    alike = lambda a, b: F.least(f"{a}.n", f"{b}.n") >= similarity * F.greatest(f"{a}.n", f"{b}.n")
    close = lambda a, b: _near(F.col(f"{a}.pv"), F.col(f"{b}.pv"), FARTHEST) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= FARTHEST)
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & alike("x", "y") & close("x", "y"))
    pairs = pairs.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
    many = materialize(keyed.select("band", "key", "node").join(sizes.where(F.col("k") > crowd).select("band", "key", "head"), ["band", "key"]), "many")
    pairs = pairs.unionByName(many.select(F.col("head").alias("u"), F.col("node").alias("v")).where("u < v"))
    pairs = materialize(pairs.unionByName(_at_two_bits(nodes, crowd)).distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).unionByName(many.select(F.col("node").alias("id"))).distinct()
    wanted = nodes.join(ids, F.col("node") == F.col("id"), "left_semi").select(F.xxhash64("doc_id", "th").alias("place"), "doc_id", "th", "node")
    wanted = materialize(wanted, "wanted")
    # most texts have no candidate: they are filtered by key before any shuffle
    some = rows.withColumn("place", F.xxhash64("doc_id", "th")).join(bounded(wanted.select("place")), "place", "left_semi")
    texts = some.drop("place").join(wanted.drop("place"), ["doc_id", "th"]).dropDuplicates(["node"]).select("node", "text")
    texts = materialize(texts, "texts")
    left, right = texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), texts.select(F.col("node").alias("v"), F.col("text").alias("tv"))
    checked = pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv").mapInArrow(_jaccard(shingle, similarity), "u long, v long")
    checked = materialize(checked, "checked")
    known = components(checked.unionByName(_crowded(many, checked, texts, shingle, similarity, block)))
    named = nodes.select("node", "doc_id", "th").join(known.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"), "left")
    named = materialize(named.select("node", "doc_id", "th", F.coalesce("component", "node").alias("component")), "named")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    named = named.join(first, "component").select(F.col("node").alias("of"), "first")
    out = found.select("doc_id", "th", "node").join(named, F.col("node") == F.col("of"))
    return out.select("doc_id", "th", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "th") == F.col("first")).alias("kept"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for every row with a doc_id: texts linked at Jaccard `similarity` of their word shingles.

    Shingles are taken after lower-casing A-Z; a text of fewer words is one shingle. Null, empty and blank texts are
    equal and so one group. Rows that share a doc_id but not the text are told apart by the text; rows with a null
    doc_id are left out; an empty table gives an empty result; other columns are ignored. component_id is the smallest doc_id.
    """
    return grouped(docs, shingle, similarity, crowd, block).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, with all their columns, that have the smallest (doc_id, hash of the text) of their group.

    Equal rows (doc_id and text) are one document and stay or go together; rows with a null doc_id stay; an empty
    table gives an empty result; columns of any name travel untouched.
    """
    gone = materialize(grouped(docs, shingle, similarity).where("not kept").select("doc_id", "th").distinct().select(F.xxhash64("doc_id", "th").alias("__place"), F.col("doc_id").alias("__doc"), F.col("th").alias("__th")), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("__d"), F.xxhash64("text").alias("__t")).withColumn("__p", F.xxhash64("__d", "__t"))
    same = (F.col("__p") == F.col("__place")) & (F.col("__d") == F.col("__doc")) & (F.col("__t") == F.col("__th"))
    return rows.join(bounded(gone, BROADCAST_KEYS // 3), same, "left_anti").select("__row.*")

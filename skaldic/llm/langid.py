"""Language ID by compression (operator 7): the language whose dictionary makes the text smallest.

For each language a bounded sample of labelled texts becomes a zstandard raw-content dictionary. A text's
words (letters only, lower case) are compressed in blocks of BLOCK bytes with each dictionary; all blocks count,
and the language with the smallest total wins. A narrow margin over the second marks the row as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Bounds of the labelled sample: about so many texts for each language, each whole and of up to so many characters, and so many bytes of dictionary.
TEXTS, CHARS, DICTIONARY = 400, 20_000, 160_000
BLOCK, LEVEL = 4096, 7
#: A second language within this share of the smallest size makes the verdict narrow.
MARGIN = 0.01
_WORDS = re.compile(r"[^\W\d_]+").findall
_JUNK = bytes(32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if b < 91 else b for b in range(256))


def letters(text: str) -> bytes:
    """The words of a text without anything but letters, in lower case, as UTF-8."""
    if text.isascii():
        return b" ".join(text.encode().translate(_JUNK).split())
    return " ".join(_WORDS(text.lower())).encode()


def dictionaries(docs: DataFrame, learn: Column, texts: int = TEXTS) -> dict[str, bytes]:
    """Dictionary content by language, from the rows where `learn` holds, lang and text are not null and the text has up to CHARS characters.

    Whole texts fill the dictionary of DICTIONARY bytes in order of a hash; one that no longer fits is passed over.
    The driver receives one count per language and about `texts` texts of each.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") <= CHARS)).select("lang", "text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)).alias("h"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    limit = F.lit(0).cast("long")
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1 << 30, max(1, (texts << 30) // n)))).otherwise(limit)
    some = rows.where(F.col("h") < limit).select("lang", "text", "h")
    found: dict[str, list[tuple[int, bytes]]] = {lang: [] for lang in counts}
    for r in some.orderBy("h", "lang", "text").limit(2 * texts * len(counts)).collect():
        found[r.lang].append((r.h, letters(r.text)))
    out = {}
    for lang, parts in found.items():
        seen: dict[bytes, None] = {}
        room = DICTIONARY
        for _, part in parts:
            if part not in seen and len(part) < room:
                seen[part] = None
                room -= len(part) + 1
        out[lang] = b" ".join(seen)
    return {k: v for k, v in sorted(out.items(), key=lambda x: (-counts[x[0]], x[0])) if len(v) >= 8}


def identify(docs: DataFrame, known: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) for every row of `docs`.

    lang_pred is `und` with score 0 where the text is null or has no letter, or where no language is known; the
    score is the winner's share of exp(-excess size / 2 % of the smallest). Ties go to the language
    that comes first in `known`, the most frequent one (then the first by name). Very long texts count whole, block by
    block; repeated rows and null doc_ids are ordinary rows; an empty table gives an empty result.
    """
    names = list(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        packers = []
        for content in known.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                raw = letters(text or "")
                if not raw or not names:
                    out.append(("und", 0.0, 0.0, True))
                    continue
                blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
                sizes = [sum(len(pack(b)) for b in blocks) for pack in packers]
                best = min(sizes)
                at = sizes.index(best)
                second = min((s for k, s in enumerate(sizes) if k != at), default=2 * best)
                shares = sum(math.exp((best - s) / (0.02 * best)) for s in sizes)
                out.append((names[at], 1 / shares, second / best - 1, second < best * (1 + margin)))
            cols = list(zip(*out)) or [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def predict(docs: DataFrame) -> DataFrame:
    """identify with held_out: fold 0 of crc32(doc_id) mod 5 is never learned from."""
    known = dictionaries(docs, fold(F.col("doc_id")) != 0)
    return identify(docs, known).withColumn("held_out", fold(F.col("doc_id")) == 0)

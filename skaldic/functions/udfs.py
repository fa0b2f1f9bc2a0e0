"""Functions that need Python: Unicode forms, syllables, tolerant JSON. All work on Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vowels, diphthongs, word-initial clusters, suffixes that open a syllable.
DIPHTHONGS = "ēa ēo īo ea eo io".split()
VOWELS = "aāæǣeēiīoōuūyȳ"
ONSETS = frozenset("pl pr bl br tr dr cl cr gl gr fl fr sl sm sn sp st sw sc þr hw hl hn hr wr".split())
SUFFIXES = "lic līc licc līcc nes nis nys nesse nissedom dōm ung ing ere en an full leas lēas".split()
_NUCLEUS = re.compile("|".join(DIPHTHONGS) + f"|[{VOWELS}]")


def normalizer(form: str):
    """A column function for a Unicode normal form: NFC, NFD, NFKC or NFKD."""

    @F.pandas_udf("string")
    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normalize


def _cut(cluster: str) -> int:
    """How many consonants between two vowels close the first syllable."""
    if "ng" in cluster:
        return len(cluster)
    for k in range(len(cluster)):
        if cluster[k:] in ONSETS:
            return k
    return 0 if len(cluster) <= 1 else len(cluster) - 1


def syllables(word: str, compat: bool = True) -> list[dict[str, str]]:
    """Onset, nucleus and coda of each syllable of a lower-case word; a known suffix is split off first.

    With compat, an onset after the first is the coda before it, and a single consonant at the end of a part is lost.
    """
    ending = next((s for s in SUFFIXES if word.endswith(s)), "")
    out = []
    for part in [word[: len(word) - len(ending)], ending] if ending else [word]:
        found = list(_NUCLEUS.finditer(part))
        start = 0
        for k, m in enumerate(found):
            until = found[k + 1].start() if k + 1 < len(found) else len(part)
            coda = _cut(part[m.end() : until])
            if not compat and k + 1 == len(found):
                coda = until - m.end()
            onset = out[-1]["coda"] if compat and k else part[start : m.start()]
            out.append({"onset": onset, "nucleus": m[0], "coda": part[m.end() : m.end() + coda]})
            start = m.end() + coda
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("onset", "nucleus", "coda")])))
def syllabify(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else syllables(w))


def tolerant_json(raw: str) -> str | None:
    """The JSON object in a model's answer, written anew: plain, fenced, quoted, escaped or inside other text; else null."""
    text = raw.strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    tries = [text, *([fenced[1]] if fenced else [])]
    tries += [t.encode().decode("unicode_escape", "ignore") if "\\" in t else t for t in tries]
    decoder = json.JSONDecoder(strict=False)
    for t in tries:
        try:
            found = json.loads(t, strict=False)
            found = json.loads(found) if isinstance(found, str) else found
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False, sort_keys=True)
        except ValueError:
            pass
        for m in re.finditer(r"\{", t):
            try:
                found, _ = decoder.raw_decode(t, m.start())
            except ValueError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False, sort_keys=True)
    return None


@F.pandas_udf(T.StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else tolerant_json(t))

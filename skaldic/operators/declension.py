"""Adjectives, numerals and r-stem nouns: words joined with ending tables.

Attribution: the paradigms and rules follow work under CC BY 4.0 on the generation of Old English word forms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .morphology import _finish

# Strong endings as `function ending probability`. < is the plain stem, > the changed one; what stands before the hyphen belongs to the stem.
STRONG = {
    "glæd": (
        "<SgMaNo -0 0, <SgMaAc -ne 0, <SgMaAc -0 1, >SgMaGe -es 0, >SgMaDa -um 0, >SgMaDa -0 1, >SgMaIs -e 0, <SgNeNo -0 0, <SgNeAc -0 0, >SgNeGe -es 0, >SgNeDa -um 0, >SgNeDa -0 1, >SgNeIs -e 0, >SgFeNo -u 0, "
        ">SgFeNo -o 1, >SgFeAc -0 0, <SgFeGe -re 0, <SgFeGe -0 1, <SgFeDa -re 0, <SgFeDa -0 1, >PlMaNo -e 0, >PlMaNo -0 1, >PlMaAc -e 0, >PlMaAc -0 1, <PlMaGe -ra 0, <PlMaGe -0 1, >PlMaDa -um 0, >PlNeNo -u 0, "
        ">PlNeNo -o 1, >PlNeAc -u 0, >PlNeAc -o 1, <PlNeGe -ra 0, <PlNeGe -0 1, >PlNeDa -um 0, >PlFeNo -a 0, >PlFeNo -o 1, >PlFeAc -a 0, >PlFeAc -o 1, <PlFeGe -ra 0, <PlFeGe -0 1, >PlFeDa -um 0"
    ),
    "blind": (
        "<SgMaNo -0 0, <SgMaAc -ne 0, <SgMaAc -0 1, <SgMaGe -es 0, <SgMaDa -um 0, <SgMaDa -0 1, <SgMaIs -e 0, <SgNeNo -0 0, <SgNeAc -0 0, <SgNeGe -es 0, <SgNeDa -um 0, <SgNeDa -0 1, <SgNeIs -e 0, "
        "<SgFeNo -0 0, <SgFeAc -e 0, <SgFeGe -re 0, <SgFeGe -0 1, <SgFeDa -re 0, <SgFeDa -0 1, <PlMaNo -e 0, <PlMaNo -0 1, <PlMaAc -e 0, <PlMaAc -0 1, <PlMaGe -ra 0, <PlMaGe -0 1, <PlMaDa -um 0, "
        "<PlNeNo -0 0, <PlNeAc -0 0, <PlNeGe -ra 0, <PlNeGe -0 1, <PlNeDa -um 0, <PlFeNo -a 0, <PlFeNo -e 1, <PlFeAc -a 0, <PlFeAc -e 1, <PlFeGe -ra 0, <PlFeGe -0 1, <PlFeDa -um 0"
    ),
    "hēah": (
        ">SgMaNo h-0 0, >SgMaAc -ne 0, >SgMaAc n-ne 1, >SgMaGe -s 0, >SgMaGe -es 0, >SgMaDa -m 0, >SgMaDa -um 1, >SgMaIs -0 0, >SgNeNo h-0 0, >SgNeAc h-0 0, >SgNeGe -s 0, >SgNeGe -es 0, >SgNeDa -m 0, "
        ">SgNeDa -um 1, >SgNeIs -0 0, >SgFeNo -0 0, >SgFeAc -0 0, >SgFeGe -re 0, >SgFeGe r-re 1, >SgFeDa -re 0, >SgFeDa r-re 1, >PlMaNo -0 0, >PlMaAc -0 0, >PlMaGe -ra 0, >PlMaGe r-ra 1, >PlMaDa -m 0, "
        ">PlMaDa -um 1, >PlNeNo -0 0, >PlNeAc -0 0, >PlNeGe -ra 0, >PlNeGe r-ra 1, >PlNeDa -m 0, >PlNeDa -um 1, >PlFeNo -0 0, >PlFeAc -0 0, >PlFeGe -ra 0, >PlFeGe r-ra 1, >PlFeDa -m 0, >PlFeDa -um 1"
    ),
    "manig": (
        "<SgMaNo -0 0, <SgMaAc -ne 0, <SgMaGe -es 0, <SgMaDa -um 0, <SgMaIs -e 0, <SgNeNo -0 0, <SgNeAc -0 0, <SgNeGe -es 0, <SgNeDa -um 0, <SgNeIs -e 0, <SgFeNo -0 0, <SgFeAc -e 0, <SgFeGe -re 0, <SgFeDa -re 0, "
        "<PlMaNo -e 0, <PlMaAc -e 0, <PlMaGe -ra 0, <PlMaDa -um 0, <PlNeNo -0 0, <PlNeAc -0 0, <PlNeGe -ra 0, <PlNeDa -um 0, <PlFeNo -a 0, <PlFeNo -e 1, <PlFeAc -a 0, <PlFeAc -e 1, <PlFeGe -ra 0, <PlFeDa -um 0"
    ),
    "hālig": (
        "<SgMaNo -0 0, <SgMaAc -ne 0, >SgMaGe -es 0, <SgMaGe -es 1, >SgMaDa -um 0, <SgMaDa -um 1, >SgMaIs -e 0, <SgMaIs -e 1, <SgNeNo -0 0, <SgNeAc -0 0, >SgNeGe -es 0, <SgNeGe -es 1, >SgNeDa -um 0, <SgNeDa -um 1, "
        ">SgNeIs -e 0, <SgNeIs -e 1, <SgFeNo -u 0, <SgFeNo -o 1, >SgFeAc -e 0, <SgFeAc -e 1, <SgFeGe -re 0, <SgFeDa -re 0, >PlMaNo -e 0, <PlMaNo -e 1, >PlMaAc -e 0, <PlMaAc -e 1, <PlMaGe -ra 0, >PlMaDa -um 0, "
        "<PlMaDa -um 1, <PlNeNo -u 0, <PlNeNo -o 1, <PlNeAc -u 0, <PlNeAc -o 1, <PlNeGe -ra 0, >PlNeDa -um 0, <PlNeDa -um 1, <PlFeNo -a 0, <PlFeNo -e 1, <PlFeAc -a 0, <PlFeAc -e 1, <PlFeGe -ra 0, >PlFeDa -um 0, <PlFeDa -um 1"
    ),
    "wilde": (
        ">SgMaNo -e 0, >SgMaAc -ne 0, >SgMaGe -es 0, >SgMaDa -um 0, >SgMaIs -e 0, >SgNeNo -e 0, >SgNeAc -e 0, >SgNeGe -es 0, >SgNeDa -um 0, >SgNeIs -e 0, >SgFeNo -u 0, >SgFeNo -o 1, >SgFeAc -e 0, >SgFeGe -re 0, "
        ">SgFeDa -re 0, >PlMaNo -e 0, >PlMaAc -e 0, >PlMaGe -ra 0, >PlMaDa -um 0, >PlNeNo -u 0, >PlNeNo -o 1, >PlNeAc -u 0, >PlNeAc -o 1, >PlNeGe -ra 0, >PlNeDa -um 0, >PlFeNo -a 0, >PlFeNo -e 0, >PlFeAc -a 0, "
        ">PlFeAc -e 0, >PlFeGe -ra 0, >PlFeDa -um 0"
    ),
    "gearu": (
        ">SgMaNo -u 0, >SgMaNo -o 1, >SgMaAc -one 0, >SgMaGe -wes 0, >SgMaGe -uwes 1, >SgMaGe -owes 2, >SgMaDa -wum 0, >SgMaIs -we 0, >SgNeNo -u 0, >SgNeNo -o 1, >SgNeAc -u 0, >SgNeAc -o 1, >SgNeGe -wes 0, "
        ">SgNeDa -wum 0, >SgNeIs -we 0, >SgFeNo -u 0, >SgFeNo -o 1, >SgFeAc -we 0, >SgFeGe -ore 0, >SgFeDa -ore 0, >PlMaNo -e 0, >PlMaAc -e 0, >PlMaGe -ora 0, >PlMaDa -wum 0, >PlNeNo -u 0, >PlNeNo -o 1, "
        ">PlNeAc -u 0, >PlNeAc -o 1, >PlNeGe -ora 0, >PlNeDa -wum 0, >PlFeNo -wa 0, >PlFeNo -we 0, >PlFeAc -wa 0, >PlFeAc -we 0, >PlFeGe -ora 0, >PlFeDa -wum 0"
    ),
}
# Weak endings; R is ra for the positive and a for the other degrees.
WEAK = (
    "SgMaNo a, SgMaAc an, SgMaGe an, SgMaDa an, SgNeNo e, SgNeAc e, SgNeGe an, SgNeDa an, SgFeNo e, SgFeAc an, SgFeGe an, SgFeDa an, PlMaNo an, PlMaAc an, PlMaGe R, PlMaGe ena, PlMaDa um, "
    "PlNeNo an, PlNeAc an, PlNeGe R, PlNeGe ena, PlNeDa um, PlFeNo an, PlFeAc an, PlFeGe R, PlFeGe ena, PlFeDa um"
)
# Strong superlative endings, with what is added to the rank where the probability changes.
SUPERLATIVE = (
    "SgMaNo 0, SgMaAc ne, SgMaAc 0 1, SgMaGe es, SgMaDa um, SgMaDa 0 1, SgNeNo 0, SgNeAc 0, SgNeGe es, SgNeDa um, SgNeDa 0 1, SgFeNo 0, SgFeAc e, SgFeGe re, SgFeGe 0 1, SgFeDa re, SgFeDa 0 1, "
    "PlMaNo e, PlMaNo 0 1, PlMaAc e, PlMaAc 0 1, PlMaGe ra, PlMaGe 0 1, PlMaDa um, PlNeNo e, PlNeNo 0 1, PlNeAc e, PlNeAc 0 1, PlNeGe ra, PlNeGe 0 2, PlNeDa um, PlFeNo a, PlFeNo e 1, PlFeNo 0 2, "
    "PlFeAc a, PlFeAc e 1, PlFeAc 0 2, PlFeGe ra, PlFeGe 0 2, PlFeDa um"
)
# Irregular stems of comparison.
COMPARATIVE_STEMS = {"gód": "beter betr bettr sélr selr", "yfel": "wiers", "micel": "már", "lytel": "lǽss"}
SUPERLATIVE_STEMS = {"gód": "betst betest best sélest", "yfel": "wierrest wyrst", "micel": "mǽst", "lytel": "lǽst"}
# Endings of numerals as nouns; * runs over the stem and the stem without e or a, + over the latter only.
NUMERAL_NOUNS = {
    "wine": "*PlMaNo 0, +PlMaNo e, *PlMaAc 0, +PlMaAc e, +PlMaGe a, +PlMaDa um",
    "cwēne": "*PlFeNo 0, +PlFeNo e, *PlFeAc 0, +PlFeAc e, +PlFeGe a, +PlFeDa um",
    "spere": "*PlNeNo 0, +PlNeNo u, +PlNeNo o, *PlNeAc 0, +PlNeAc u, +PlNeAc o, +PlNeGe a, +PlNeDa um",
}
# Forms of the r-stems.
R_STEMS = {
    "fæder": "SgMaNo fæder, SgMaAc fæder, SgMaGe fæder fæderes, SgMaDa fæder fædere, PlMaNo fæderas, PlMaAc fæderas, PlMaGe fædera, PlMaDa fæderum",
    "brōþor": (
        "SgMaNo brōþor brōþur brōdor brōdur, SgMaAc brōþor brōþur brōdor brōdur, SgMaGe brōþor brōþur brōdor brōdur, SgMaDa brōþer brēþer brōder brēder, "
        "PlMaNo brōþor brōþru brōþur brōþro brōþer brōþra brōdor brōdru brōdur brōdro brōder brōdra, PlMaAc brōþor brōþru brōþur brōþro brōþer brōþra brōdor brōdru brōdur brōdro brōder brōdra, "
        "PlMaGe brōþra brōdra, PlMaDa brōþrum brōdrum"
    ),
    "mōdor": "SgFeNo mōdor, SgFeAc mōdor, SgFeGe mōdor, SgFeDa mēder, PlFeNo mōdor mōdru mōdra, PlFeAc mōdor mōdru mōdra, PlFeGe mōdra, PlFeDa mōdrum",
    "dōhtor": "SgFeNo dōhtor, SgFeAc dōhtor, SgFeGe dōhtor, SgFeDa dēhter, PlFeNo dōhtor dōhtru dōhtra, PlFeAc dōhtor dōhtru dōhtra, PlFeGe dōhtra, PlFeDa dōhtrum",
    "sweostor": "SgFeNo sweostor, SgFeAc sweostor, SgFeGe sweostor, SgFeDa sweostor, PlFeNo sweostor, PlFeAc sweostor, PlFeGe sweostra, PlFeDa sweostrum",
}
KEEP = ("nid", "title", "stem", "prefix", "wright")


def _row(ord_: int, function: str, s: Column, ending: str, probability: Column | str, rank: Column | int = 0) -> Column:
    return F.struct(F.lit(ord_).alias("ord"), F.lit(function).alias("function"), s.alias("s"), F.lit(ending).alias("ending"), (F.lit(probability) if isinstance(probability, str) else probability).alias("probability"), (F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("rank"))


def _rows(words: DataFrame, rows: Column, more: dict[str, Column]) -> DataFrame:
    found = words.select(*KEEP, *[c.alias(k) for k, c in more.items()], F.explode(rows).alias("e"))
    return found.select("*", "e.*").drop("e")


def _syncope(s: Column) -> Column:
    return F.regexp_replace(s, f"({S.VOWEL}.*){S.VOWEL}(.*)$", "$1$2")


def alternants(stem: Column, halig: Column, drop_h: bool = True) -> Column:
    """The stem, then what each step changes: closing u to w, closing vowel off, a middle vowel off (hālig), closing h off."""
    steps = [lambda s: F.regexp_replace(s, "u$", "w"), lambda s: F.regexp_replace(s, f"{S.VOWEL}$", ""), lambda s: F.when(halig, _syncope(s)).otherwise(s)]
    steps += [lambda s: F.regexp_replace(s, "h$", "")] if drop_h else []
    chain = reduce(lambda done, step: [*done, step(done[-1])], steps, [stem])
    return F.array_compact(F.array(chain[0], *[F.when(b != a, b) for a, b in zip(chain, chain[1:])]))


def degree_stems(stem: Column, halig: Column, irregular: dict[str, str], drop_h: bool) -> Column:
    """Different stems of a degree in code point order: irregular ones, else the alternants of each i-mutated stem."""
    pattern = f"^(.*?)({S.VOWEL}[eao]?)(.*)$"
    vowel = F.regexp_extract(stem, pattern, 2)
    mutated = F.transform(S.i_mutation(vowel), lambda v: F.concat(F.regexp_extract(stem, pattern, 1), v, F.regexp_extract(stem, pattern, 3)))
    usual = F.when(vowel == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(mutated, lambda m: alternants(m, halig, drop_h))))))
    out = F.when(F.lit(False), usual)
    for word, stems in irregular.items():
        out = out.when(stem == word, F.array_sort(F.array(*map(F.lit, stems.split()))))
    return out.otherwise(usual)


def _table(entries: list[tuple]) -> Column:
    """A constant array of (ord, function, kind, before, ending, added): only literals, so one value in the plan."""
    names = ("ord", "function", "kind", "before", "ending", "added")
    return F.array(*[F.struct(*[(F.lit(x) if x is not None else F.lit(None).cast("int")).alias(n) for n, x in zip(names, e)]) for e in entries])


def _inflect(entries: list[tuple], stem_of, probability_of, rank: Column | int = 0) -> Column:
    """Rows of a table, its stem and probability being functions of an entry."""
    rank = (F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("rank")
    return F.transform(_table(entries), lambda e: F.struct(e["ord"].alias("ord"), e["function"].alias("function"), stem_of(e).alias("s"), e["ending"].alias("ending"), probability_of(e).alias("probability"), rank))


def _weak_rows(degree: str, stems: Column, joint: Column, rank) -> Column:
    """The weak table over stems; from the first ena on, the probability is the rank of the stem plus one."""
    entries = [(k, degree + e.split()[0], "", "", e.split()[1].replace("R", "ra" if degree == "Po" else "a"), int(k >= 15)) for k, e in enumerate(WEAK.split(", "))]

    def run(s: Column, i: Column) -> Column:
        return _inflect(entries, lambda e: F.concat_ws("-", s, joint), lambda e: F.when(e["added"] == 1, (rank(i) + 1).cast("string")).otherwise(""), i)

    return F.flatten(F.transform(stems, run))


def _choose(plain: Column, changed: Column):
    return lambda e: F.concat(F.when(e["kind"] == "<", plain).otherwise(changed), e["before"])


def adjective_forms(words: DataFrame) -> DataFrame:
    """All adjective forms of words (nid, title, stem, prefix, wright, paradigm, adjective, numeral, pronoun, papart, pspart).

    Participles count as adjectives and numerals don't. Every word has weak forms, a strong table where its label
    has one; words that are neither numeral nor pronoun are compared.
    """
    words = words.where(((F.col("adjective") == 1) | (F.col("papart") + F.col("pspart") > 0)) & (F.col("numeral") != 1))
    label = F.coalesce("paradigm", F.when(F.col("papart") + F.col("pspart") > 0, "wilde"), F.lit(""))
    past, present, long = F.col("papart") == 1, F.col("pspart") == 1, S.stem_length(F.col("stem")) == 1
    table = (
        F.when(label.contains("manig") | (past & ~long), "manig").when(label.contains("hālig") | past, "hālig").when(label.contains("wilde") | present, "wilde")
        .when(label.rlike("(?i)glæd|til"), "glæd").when(label.contains("blind"), "blind").when(label.rlike("hēah|weorh"), "hēah").when(label.contains("gearu"), "gearu")
    )
    words = words.withColumn("label", label).withColumn("table", table)
    stem = F.col("stem")
    lengthened = F.regexp_replace(F.regexp_replace(stem, "e([ao])", "ē$1"), "([^ē])o", "$1ō")
    changed = {
        "glæd": F.when(F.col("label").rlike("[æÆ]|ea"), F.regexp_replace(stem, "æ|Æ|(?i:ea)", "a")).otherwise(stem), "blind": stem, "manig": stem,
        "hēah": F.regexp_replace(F.when(F.col("label").contains("weorh"), lengthened).otherwise(stem), "h$", ""), "hālig": F.when(past | present, stem).otherwise(_syncope(stem)),
        "wilde": F.regexp_replace(stem, "e$", ""), "gearu": F.regexp_replace(stem, ".$", ""),
    }
    strong = None
    for name, ends in STRONG.items():
        entries = [(k, f"Po{e[1:].split()[0]}", e[0], e.split()[1].split("-")[0], e.split()[1].split("-")[1], int(e.split()[2])) for k, e in enumerate(ends.split(", "))]
        rows = _inflect(entries, _choose(stem, changed[name]), lambda e: e["added"].cast("string"))
        strong = F.when(F.col("table") == name, rows) if strong is None else strong.when(F.col("table") == name, rows)
    kind = F.when(past | present, "participle").when(F.col("pronoun") == 1, "pronoun").otherwise("adjective")
    shared = {"kind": kind, "class2": F.when(past, "past").when(present, "present").otherwise("")}
    out = _rows(words.where("table is not null"), strong, {**shared, "class1": F.lit("strong"), "paradigm": F.col("label"), "part": F.lit(0)})
    halig = F.col("label").contains("hālig") & ~past & ~present
    weak = {**shared, "class1": F.lit("weak"), "paradigm": F.lit("blinda")}
    out = out.unionByName(_rows(words, _weak_rows("Po", alternants(stem, halig), F.lit(None).cast("string"), lambda i: i), {**weak, "part": F.lit(1)}))
    compared = words.where("numeral = 0 and pronoun = 0")
    rank = lambda i: F.abs(i - 2)
    joint = lambda irregular, usual: F.when(stem.isin(*irregular), "0").otherwise(usual)
    more = _weak_rows("Co", degree_stems(stem, halig, COMPARATIVE_STEMS, True), joint(COMPARATIVE_STEMS, "r"), rank)
    most_stems, most = degree_stems(stem, halig, SUPERLATIVE_STEMS, False), joint(SUPERLATIVE_STEMS, "ost")
    out = out.unionByName(_rows(compared, more, {**weak, "part": F.lit(2)})).unionByName(_rows(compared, _weak_rows("Sp", most_stems, most, rank), {**weak, "part": F.lit(3)}))

    entries, added = [], None
    for k, e in enumerate(SUPERLATIVE.split(", ")):
        function, ending, *change = e.split()
        added = int(change[0]) if change else added
        entries.append((k, f"Sp{function}", "", "", ending, added))

    def strong_most(s: Column, i: Column) -> Column:
        return _inflect(entries, lambda e: F.concat_ws("-", s, most), lambda e: F.coalesce((rank(i) + e["added"]).cast("string"), F.lit("")), i)

    out = out.unionByName(_rows(compared, F.flatten(F.transform(most_stems, strong_most)), {**shared, "class1": F.lit("strong"), "paradigm": F.col("label"), "part": F.lit(4)}))
    return _finish(out, 3, "adjective").withColumn("wordclass", F.col("kind")).drop("kind")


def numeral_forms(words: DataFrame, carried: int | None = None) -> DataFrame:
    """Numerals (nid, title, stem, prefix, wright, noun) as nouns of three genders, where they are nouns, and as weak adjectives.

    The probability of ena forms is 1, or in the full flow one more than what the adjectives left (`carried`); there it stays for the forms after.
    """
    stem = F.col("stem")
    bare = F.regexp_replace(stem, "[ea]$", "")
    out = None
    for p, (name, ends) in enumerate(NUMERAL_NOUNS.items()):
        rows = []
        for k, e in enumerate(ends.split(", ")):
            function, ending = e[1:].split()
            rows += [_row(2 * k + j, function, s, ending, "") for j, s in enumerate([stem, bare] if e[0] == "*" else [bare])]
        found = _rows(words.where("noun = 1"), F.filter(F.array(*rows), lambda r: r["s"] != ""), {"paradigm": F.lit(name), "class1": F.lit("strong"), "part": F.lit(p)})
        out = found if out is None else out.unionByName(found)
    cut = F.regexp_replace(stem, "[eao]$", "")
    rows, seen = [], False
    for k, e in enumerate(e for g in ("Ma", "Ne", "Fe") for e in (f"Pl{g}No an", f"Pl{g}Ac an", f"Pl{g}Ge ra", f"Pl{g}Ge ena", f"Pl{g}Da um")):
        function, ending = e.split()
        seen = seen or ending == "ena"
        value = str((carried or 0) + 1) if ending == "ena" or carried is not None and seen else ""
        rows.append(_row(k, f"Po{function}", cut, ending, value))
    out = out.unionByName(_rows(words, F.array(*rows), {"paradigm": F.lit("blinda"), "class1": F.lit("weak"), "part": F.lit(3)}))
    return _finish(out, 5, "numeral")


def r_stem_forms(words: DataFrame) -> DataFrame:
    """Listed forms of nouns whose paradigm is an r-stem (nid, title, stem, prefix, wright, paradigm)."""
    rows = None
    for name, functions in R_STEMS.items():
        listed = [(f.split()[0], w) for f in functions.split(", ") for w in f.split()[1:]]
        own = F.array(*[_row(k, function, F.lit(w), "", "") for k, (function, w) in enumerate(listed)])
        rows = F.when(F.col("paradigm") == name, own) if rows is None else rows.when(F.col("paradigm") == name, own)
    return _finish(_rows(words.where(F.col("paradigm").isin(*R_STEMS)), rows, {"paradigm": F.col("paradigm"), "class1": F.lit("strong")}), 6, "noun")

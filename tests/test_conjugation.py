"""Verb forms against hand-written lists."""

from pyspark.sql import functions as F

from skaldic.operators import conjugation, morphology
from skaldic.plans.catalog import _PARADIGM_COLUMNS

WORD = "nid int, title string, stem string, prefix string, wright string, para_id string"


def part(para, kind, class2, name, vowel, post, dental, ending, var=0, prefix="0", pre="x", boundary="0", ord_=0):
    return (para, "t", kind, class2, "", var, ord_, name, prefix, pre, vowel, post, boundary, dental, ending)


def forms(spark, words, parts):
    found = conjugation.conjugate(spark.createDataFrame(words, WORD), spark.createDataFrame(parts, _PARADIGM_COLUMNS))
    rows = found.where("dup = 0").orderBy("nid", "part_ord", "block", "vowel_ord", "ord", "change").collect()
    return found, [(r.function, r.form, r.probability) for r in rows]


def test_strong_infinitive(spark):
    found, rows = forms(spark, [(1, "bindan", "bindan", "", "", "3")], [part("3", "s", "3", "if", "i", "nd", "0", "an", prefix="")])
    assert rows[:16] == [
        ("if", "bindan", ""), ("IdIf", "bindanne", ""), ("IdIf", "bindenne", ""), ("PsPt", "bindende", ""), ("PsInSg1", "binde", ""), ("PsInSg1", "bindu", "1"), ("PsInSg1", "bindo", "1"), ("PsInSg1", "bindæ", "1"),
        ("PsInPl", "bindaþ", ""), ("PsInPl", "bindeþ", "1"), ("PsInPl", "bindes", "1"), ("PsInPl", "bindas", "1"), ("PsSuSg", "binde", ""), ("PsSuPl", "binden", ""), ("ImPl", "bindaþ", ""), ("ImSg", "bind", ""),
    ]
    mutated = [("PsInSg2", x, p) for x, p in (("bindstu", 1), ("bindest", 1), ("bindist", 1), ("binds", 1), ("bindst", 0), ("bintst", 1), ("binst", 1))] + [("PsInSg3", x, p) for x, p in (("bindeþ", 1), ("bindiþ", 1), ("bindþ", 0), ("bintt", 1), ("bint", 1))]
    assert rows[16:] == [(f, x, str(p + k)) for k in (0, 1) for f, x, p in mutated]
    assert [(r.title, r.stem, r.pspart, r.papart) for r in conjugation.participles(found).collect()] == [("bindende", "bindende", 1, 0)]


def test_strong_vowel_infinitive_and_past(spark):
    parts = [part("4", "s", "5", "if", "éo", "0", "0", "on"), part("4", "s", "5", "painsg1", "ea", "h", "0", "0", ord_=1), part("4", "s", "5", "painpl", "āw", "0", "0", "on", ord_=2), part("4", "s", "5", "papt", "ew", "0", "0", "en", ord_=3)]
    _, rows = forms(spark, [(1, "sēon", "sēon", "0", "", "4")], parts)
    assert [r for r in rows if r[0] not in ("PsInSg2", "PsInSg3")] == [
        ("if", "séoon", ""), ("IdIf", "séonne", ""), ("PsPt", "séonde", ""), ("PsInSg1", "séo", ""), ("PsInPl", "séoþ", ""), ("PsSuSg", "séo", ""), ("PsSuPl", "séon", ""), ("ImPl", "séoþ", ""), ("ImSg", "séo", ""),
        ("painsg1", "sea", ""), ("PaInSg3", "sea", ""), ("painpl", "sāwon", ""), ("PaInSg2", "sāwe", ""), ("PaSuSg", "sāwe", ""), ("PaSuPl", "sāwen", ""), ("papt", "sewen", ""),
    ]


def test_weak_infinitive_of_a_consonant_stem(spark):
    _, rows = forms(spark, [(1, "fremman", "fremman", "", "", "50")], [part("50", "w", "1", "if", "e", "mm", "0", "an", prefix="")])
    assert rows == [
        ("if", "fremman", "0"), ("if", "fremman", "0"), ("IdIf", "fremmanne", "0"), ("IdIf", "fremmenne", "0"), ("PsInSg1", "fremme", "0"), ("PsInSg1", "fremmu", "1"), ("PsInSg1", "fremmo", "1"), ("PsInSg1", "fremmæ", "1"),
        ("PsInPl", "fremmaþ", "0"), ("PsInPl", "fremmeþ", "1"), ("PsInPl", "fremmes", "1"), ("PsInPl", "fremmas", "1"), ("PsSuSg", "fremme", "0"), ("PsSuPl", "fremmen", "0"), ("ImPl", "fremmaþ", "0"), ("PsPt", "fremmende", "0"),
    ]


def test_weak_infinitive_of_a_vowel_stem_has_more_rows(spark):
    found, rows = forms(spark, [(1, "hēan", "hēan", "", "", "51")], [part("51", "w", "2", "if", "ēa", "0", "0", "ian", prefix="")])
    by = {}
    for f, x, p in rows[1:]:
        by.setdefault(f, []).append((x, p))
    assert by["if"] == [("hēaian", "0"), ("hēan", "0")] and by["IdIf"] == [("hēaianne", "0"), ("hēaienne", "0"), ("hēainne", "0")]
    assert by["PsInSg1"][-1] == ("hēa", "0") and by["PsInPl"][-1] == ("hēaiþ", "0") and by["ImPl"] == [("hēaiaþ", "0"), ("hēaþ", "0")]
    assert by["PsSuPl"] == [("hēaien", "0")] and by["PsPt"] == [("hēaiende", "0"), ("hēainde", "0")]
    assert [r.stem for r in conjugation.participles(found).collect()] == ["hēainde"]


def test_weak_present_and_past(spark):
    parts = [part("52", "w", "1", "if", "e", "tt", "0", "an"), part("52", "w", "1", "psinsg2", "e", "tt", "0", "est", ord_=1), part("52", "w", "1", "painsg1", "ea", "tt", "ed", "e", ord_=2)]
    found, rows = forms(spark, [(1, "settan", "settan", "0", "", "52")], parts)
    second = [r for r in rows if r[0] in ("psinsg2", "PsInSg2", "PsInSg3", "ImSg")]
    assert second == [
        ("psinsg2", "settest", "0"), ("PsInSg2", "setest", "1"), ("PsInSg2", "setes", "1"), ("PsInSg2", "setist", "1"), ("PsInSg2", "sets", "1"), ("PsInSg2", "setst", "0"), ("PsInSg2", "sest", "1"),
        ("PsInSg3", "seteþ", "1"), ("PsInSg3", "setieþ", "1"), ("PsInSg3", "setiþ", "1"), ("PsInSg3", "setþ", "1"), ("PsInSg3", "sett", "1"), ("PsInSg3", "set", "1"), ("ImSg", "sete", "0"), ("ImSg", "setie", "0"), ("ImSg", "set", "0"),
    ]
    past = [r for r in rows if r[0] in ("painsg1", "PaInSg1", "PaInSg2", "PaInSg3", "PaInPl", "PaSuSg", "PaSuPl", "PaPt")]
    one = lambda v, k: [
        ("PaInSg1", f"s{v}tede", k), ("PaInSg2", f"s{v}tedest", k), ("PaInSg2", f"s{v}tedes", k + 1), ("PaInSg3", f"s{v}tede", k), ("PaInPl", f"s{v}tedon", k), ("PaSuSg", f"s{v}tede", k), ("PaSuPl", f"s{v}teden", k),
        ("PaPt", f"s{v}ted", k), ("PaPt", f"s{v}tt", k + 1), ("PaPt", f"s{v}t", k + 1),
    ]
    assert past == [("painsg1", "settede", "")] + [(f, x, str(p)) for f, x, p in one("ea", 0) + one("e", 1)]
    assert sorted((r.stem, r.papart) for r in conjugation.participles(found).collect()) == [("seated", 1), ("seted", 1), ("settende", 0)]


def test_paradigms_with_their_own_shape_derive_nothing(spark):
    parts = [part(p, "w", "3", "if", "a", "bb", "0", "an", pre="h") for p in ("88", "89", "92", "93")]
    _, rows = forms(spark, [(k, "sorgan", "sorgan", "0", "", p) for k, p in enumerate(("88", "89", "92", "93"))], parts)
    assert [r[1] for r in rows] == ["sorgan", "habban", "habban", "sorgan"]


def test_probability_of_sound_changes(spark):
    rows = spark.createDataFrame([("PsInSg2", "agst", "2"), ("PsInSg2", "agst", ""), ("PsInSg3", "bedþ", "1")], "function string, form string, probability string")
    found = [(r.form, r.probability) for r in morphology.sound_changes(rows).where("function = 'PsInSg2'").collect()]
    assert found == [("agst", "2"), ("ahst", "3"), ("axst", "3"), ("agst", ""), ("ahst", "0"), ("axst", "0")]
    third = morphology.sound_changes(rows, delta=0).where(F.col("function") == "PsInSg3").collect()
    assert [(r.form, r.probability) for r in third] == [("bedþ", "1"), ("bett", "1"), ("bet", "1")]


def test_segments(spark):
    rows = spark.createDataFrame([("findan",), ("éage",), ("xyz",), ("sellan",)], "stem string").select(conjugation.pre_vowel(F.col("stem")).alias("a"), conjugation.root_vowel(F.col("stem")).alias("b"), conjugation.post_vowel(F.col("stem"), F.lit("")).alias("c"))
    assert [tuple(r) for r in rows.collect()][0] == ("f", "i", "nd") and [tuple(r) for r in rows.collect()][3] == ("s", "e", "ll")
    bases = spark.createDataFrame([("0-h-ēa--0",), ("0-fr-e-mm-0",), ("0-l-u-f-i",), ("0-x-a--",)], "b string").select(conjugation.ends_in_vowel(F.col("b")).alias("v"), conjugation.ends_in_bare_vowel(F.col("b")).alias("w"))
    assert [tuple(r) for r in bases.collect()] == [(True, False), (False, False), (False, True), (True, False)]

"""Adjectives, numerals and r-stems on a few words."""

from collections import Counter

from skaldic.operators import declension, morphology

WORD = "nid int, title string, stem string, prefix string, wright string, paradigm string, adjective int, numeral int, pronoun int, papart int, pspart int"


def test_adjectives(spark):
    rows = [(1, "glæd", "glæd", "", "", "glæd", 1, 0, 0, 0, 0), (2, "wilde", "wilde", "", "", "wilde", 1, 0, 1, 0, 0), (3, "gearu", "gearu", "", "", "gearu", 1, 0, 0, 0, 0), (4, "hātende", "hātende", "", "", None, 0, 0, 0, 0, 1), (5, "twā", "twā", "", "", None, 1, 1, 0, 0, 0)]
    found = [r for r in declension.adjective_forms(spark.createDataFrame(rows, WORD)).collect() if not r.dup]
    by = Counter((r.nid, r.part) for r in found)
    assert by[1, 0] == 41 and by[1, 1] == 27 and by[2, 0] == 31 and (2, 2) not in by and not [r for r in found if r.nid == 5]
    forms = {(r.nid, r.part, r.function, r.probability): r.form for r in found}
    assert forms[1, 0, "PoSgMaGe", "0"] == "glades" and forms[1, 0, "PoSgMaAc", "0"] == "glædne" and forms[2, 0, "PoSgMaNo", "0"] == "wilde"
    assert {r.form for r in found if (r.nid, r.part, r.function) == (1, 2, "CoSgMaNo")} == {"glædra", "gledra"}
    assert {r.form for r in found if (r.nid, r.part, r.function) == (1, 3, "SpSgMaNo")} == {"glædosta", "gledosta"}
    assert {r.form for r in found if (r.nid, r.part, r.function) == (3, 1, "PoSgMaNo")} == {"gearua", "gearwa"}
    assert {(r.wordclass, r.class2) for r in found if r.nid == 4} == {("participle", "present")} and {r.wordclass for r in found if r.nid == 2} == {"pronoun"}
    ranks = {(r.rank, r.ord): r.probability for r in found if (r.nid, r.part) == (1, 4)}
    assert ranks[0, 0] == "" and ranks[0, 2] == "3" and ranks[0, 3] == "3" and ranks[0, 29] == "4" and ranks[1, 2] == "2"


def test_numerals(spark):
    words = spark.createDataFrame([(1, "þrīe", "þrīe", "", "", 1), (2, "forma", "forma", "", "", 0)], "nid int, title string, stem string, prefix string, wright string, noun int")
    found = [r for r in declension.numeral_forms(words).collect() if not r.dup]
    assert Counter(r.nid for r in found) == {1: 8 + 8 + 10 + 15, 2: 15}
    assert {r.probability for r in found if r.function == "PoPlMaGe"} == {"", "1"}
    later = {r.ord: r.probability for r in declension.numeral_forms(words, carried=2).where("nid = 2 and dup = 0").collect()}
    assert later[0] == "" and later[3] == "3" and later[4] == "3"


def test_r_stems(spark):
    words = spark.createDataFrame([(1, "mōdor", "mōdor", "", "", "mōdor"), (2, "stān", "stān", "", "", "stān")], "nid int, title string, stem string, prefix string, wright string, paradigm string")
    found = declension.r_stem_forms(words).where("dup = 0").collect()
    assert len(found) == 12 and {r.form for r in found if r.function == "SgFeDa"} == {"mēder"}


def test_noun_labels_by_shape_and_gender(spark):
    rows = [("guma", 1, 0, 0, 0, ["guma"]), ("frēa", 1, 0, 0, 0, ["fréa"]), ("tunge", 0, 1, 0, 0, ["tunge"]), ("ende", 1, 0, 0, 0, ["stán"]), ("wīte", 0, 0, 1, 0, ["hof"]), ("wīgend", 1, 0, 0, 0, ["wígend"])]
    rows += [("dæg", 1, 0, 0, 0, ["dæg"]), ("fæt", 0, 0, 1, 0, ["fæt"]), ("fæt", 0, 1, 0, 0, ["fæt"]), ("stole", 0, 0, 0, 1, ["stán"]), ("word", 0, 0, 1, 0, ["word"]), ("ho", 0, 0, 1, 0, ["hof"]), ("hand", 0, 1, 0, 0, ["ár"])]
    words = spark.createDataFrame([(k, r[0], "", *r[1:5]) for k, r in enumerate(rows)], "nid long, stem string, wright string, n_masc int, n_fem int, n_neut int, n_uncert int")
    assert {r.nid: list(r.paradigms) for r in morphology.noun_paradigms(words).collect()} == {k: r[5] for k, r in enumerate(rows)}

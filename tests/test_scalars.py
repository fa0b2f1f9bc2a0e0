"""Input and expected output of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from skaldic.functions import scalars as S
from skaldic.functions import udfs


def values(spark, function, inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r.y for r in rows.select("k", function(F.col("x")).alias("y")).orderBy("k").collect()]


CASES = [
    (S.normalize_old_english, [" Cyning ", "wīf-mann", "ðǣr", "ġe", None, ""], ["cyning", "wifmann", "þær", "ge", None, ""]),
    (S.palatalize_g, ["giefan", "dæg", "gēs", "fæger", "Gif", "gār", "weg-gifu", "GIFU"], ["ġiefan", "dæġ", "gēs", "fæġer", "Ġif", "gār", "weġ-ġifu", "ĠIFU"]),
    (S.palatalize_c, ["cild", "iċ", "ic", "cyning", "hwelc", "wicu", "ceaster", "dīc", "cynn", "benc", "finc"], ["ċild", "iċ", "iċ", "cyning", "hwelċ", "wicu", "ċeaster", "dīċ", "cynn", "benc", "finċ"]),
    (S.eth_to_thorn, ["ðÐkK", "", None], ["þÞcc", "", ""]),
    (S.move_accents, ["eóh", "beám", "hiéran"], ["ēoh", "bēam", "hīeran"]),
    (S.acute_to_macron, ["gód", "Ǽ"], ["gōd", "Ǣ"]),
    (S.stem_length, ["god", "gōd", "hand", "ofer", "", "wisc", "sele"], [1, 1, 1, 0, 0, 1, 0]),
    (S.syllable_count, ["hand", "ofer", "sele", "", None], [1, 2, 2, 0, 0]),
    (S.normalize_output, ["ȳþ", "fyr", "hīeran", "ǣr", "sie"], ["iþ", "fir", "hiran", "ær", "si"]),
    (S.roman_value, ["XIV", "mcmxc", "abc", "", "ii"], [14, 1990, 100, 0, 2]),
    (S.marker, ["[12] ond", "5. word", "ic wæs", "ond", "XIV. x"], ["12", "5", "ic", None, "XIV"]),
    (S.degeminate, ["mann", "aab"], ["man", "ab"]),
    (S.collapse_spaces, ["  a \n b\t"], ["a b"]),
    (S.empty_if_zero, ["0", None, "x"], ["", "", "x"]),
    (S.without_prefix, ["be-for-gān", "a b", "gān"], ["gān", "b", "gān"]),
    (S.speaker, ["Saturnus cwæð:\nx", "Salomon:\n", "ond þa", "\n\nBeda sæde x"], ["Saturnus", "Salomon", None, "Beda"]),
    (S.is_heading, ["I. THE PASSING", "BEOWULF.", "Chapter 2", "Her 755 was", "ond", ""], [True, True, True, True, False, False]),
    (S.heading_number, ["XII. Title", "Her 755", "Cap. IV x", "A.D. 900", "BEOWULF"], [12, 755, 4, 900, None]),
    (S.heading_title, ["XII. Title", "Her 755", "Cap. IV x", "BEOWULF."], ["Title", None, "x", "BEOWULF"]),
    (S.block_kind, ["a\nb\nc", "One. \nTwo.\nThree.", "one line"], ["verse", "prose", "prose"]),
    (S.leading_number, ["12x", "x", "-1.5e2 y", None], [12.0, 0.0, -150.0, 0.0]),
]


@pytest.mark.parametrize(("function", "inputs", "expected"), CASES, ids=[c[0].__name__ for c in CASES])
def test_values(spark, function, inputs, expected):
    assert values(spark, function, inputs) == expected


def test_sentences_keep_terminators(spark):
    assert values(spark, S.sentences, ['He cwæð. "Ga!" þa for. x']) == [["He cwæð.", '"Ga!"', "þa for.", "x"]]


def test_i_mutation_keeps_its_order(spark):
    assert values(spark, S.i_mutation, ["a", "ea", "o", "q"]) == [["æ", "a", "e"], ["ea", "ie", "i"], ["e", "o"], ["q", "q"]]


def test_case_pattern(spark):
    rows = spark.createDataFrame([("ABC", "xy"), ("Abc", "xy"), ("abC", "xY")], "a string, b string")
    assert [r.c for r in rows.select(S.case_like(F.col("a"), F.col("b")).alias("c")).collect()] == ["XY", "Xy", "xY"]


def test_syllables():
    whole = lambda word, compat: [s["onset"] + s["nucleus"] + s["coda"] for s in udfs.syllables(word, compat)]
    assert whole("cyning", False) == ["cyn", "ing"] and whole("cyning", True) == ["cy", "ing"]
    assert whole("ofer", False) == ["o", "fer"] and whole("ofer", True) == ["o", "e"]
    assert [s["nucleus"] for s in udfs.syllables("ēadiglic")] == ["ēa", "i", "i"]
    assert udfs.syllables("") == []


def test_tolerant_json():
    assert udfs.tolerant_json('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert udfs.tolerant_json('so: {"a": {"b": "}"}} end') == '{"a": {"b": "}"}}'
    assert udfs.tolerant_json('"{\\"a\\": 1}"') == '{"a": 1}'
    assert udfs.tolerant_json("none") is None

"""Operators on small tables."""

from pyspark.sql import functions as F

from skaldic.operators import diacritics, ingest, morphology, ocr
from skaldic.sources import tei


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def sections(spark, text):
    return ingest.sections(ingest.runs(ingest.classify_lines(ingest.lines(docs(spark, text)))).drop("is_heading"))


def test_runs_split_headings_verse_and_prose(spark):
    text = "BEOWULF\nHwæt we Gardena  in geardagum\nþeodcyninga  þrym gefrunon\nThis is one long line of prose that goes on and on for more than eighty characters in all."
    found = ingest.runs(ingest.classify_lines(ingest.lines(docs(spark, text)))).orderBy("block_ix").collect()
    assert [(r.kind, r.is_heading) for r in found] == [("prose", True), ("verse", False), ("prose", False)]


def test_headings_name_the_sections_after_them(spark):
    text = "I. FIRST\nThis is a line of prose that is much longer than a line of verse can be, and it ends in a stop.\nII. SECOND\nAnother line of prose that is much longer than a line of verse can be, and it ends in a stop."
    found = sections(spark, text).orderBy("section_ix").collect()
    assert [(r.number, r.title) for r in found] == [(1, "FIRST"), (2, "SECOND")]


def test_verse_numbers(spark):
    rows = spark.createDataFrame([(1, 0, None, 0, "[5]\nfirst line\nsecond line\n10 third line", "verse")], "doc_id long, section_ix int, speaker string, block_ix int, text string, kind string")
    assert [(r.text, r.number) for r in ingest.verse_rows(rows).orderBy("line_ix").collect()] == [("first line", 5), ("second line", 2), ("third line", 10)]


def test_oe_filter_keeps_its_mode_within_a_document(spark):
    rows = spark.createDataFrame([(1, 0, "þæt wæs god cyning ond se"), (1, 1, "wer ond wif"), (1, 2, "the man that came with the dog"), (1, 3, "xx yy zz qq ww")], "doc_id long, block_ix long, text string")
    assert [r.block_ix for r in ingest.oe_filter(rows).orderBy("block_ix").collect()] == [0, 1]


def test_confidence_is_the_least_below(spark):
    rows = spark.createDataFrame([(1, "/", None), (1, "/0/", 0.9), (1, "/0/0/", 0.2), (1, "/1/", 0.5)], "doc_id long, path string, confidence double")
    assert {r.path: r.confidence for r in ingest.minimum_confidence(rows).collect()} == {"/": 0.2, "/0/": 0.9, "/0/0/": 0.2, "/1/": 0.5}


def test_index_and_restoring(spark):
    source = spark.createDataFrame([("x@<B>Gōd;</B> a@god,good",), ("x@<B>God</B> b@god",), ("x@<B>wīf</B>@wif",), ("bad line",)], "value string")
    index = diacritics.build_index(diacritics.dictionary_forms(source))
    assert {r.key: (list(r.forms), r.is_ambiguous) for r in index.collect()} == {"god": (["god", "gōd"], True), "good": (["gōd"], False), "wif": (["wīf"], False)}
    found = {(r.line_number, r.word_number): r for r in diacritics.look_up(diacritics.tokens(docs(spark, "Wif, god!\n ic")), index).collect()}
    assert found[1, 1].restored == "Wīf" and found[1, 2].options == ["god", "gōd"] and found[2, 1].is_unknown
    assert [r.text for r in diacritics.restore(docs(spark, "Wif, god!\n ic", "", "...", None), index).orderBy("doc_id").collect()] == ["Wīf, god!\n iċ", "", "...", None]


def test_index_changes(spark):
    index = spark.createDataFrame([("a", ["á", "à"], True), ("b", ["b"], False)], "key string, forms array<string>, is_ambiguous boolean")
    added = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "key string, form string")
    after = lambda force: {r.key: list(r.forms) for r in diacritics.add_forms(index, added, force).collect()}
    assert after(False) == {"a": ["á", "à"], "b": ["b"], "c": ["z"]} and after(True)["b"] == ["y"]
    acts = spark.createDataFrame([("a", 1, "delete", "á"), ("b", 1, "choose", "q"), ("b", 2, "add", "r")], "key string, at int, action string, form string")
    assert {r.key: (list(r.forms), r.is_ambiguous) for r in diacritics.fold_actions(index, acts).collect()} == {"a": (["à"], True), "b": (["q", "r"], True)}


def test_ocr_scores_and_gate(spark):
    pairs = spark.createDataFrame([(1, "þæt wæs", "pæt wæs"), (2, "ab cd", "ab cd")], "page int, expected string, observed string")
    found = {r.page: r for r in ocr.scores(pairs).collect()}
    assert found[1].char_distance == 1 and found[1].word_distance == 1 and found[1].thorn_recall == 0 and found[1].thorn_to_p_rate == 1
    assert found[1].ae_recall == 1 and found[2].cer == 0 and found[2].thorn_recall == 1 and found[2].eth_precision == 1
    assert ocr._align("abc", "ac") == [("a", "a"), ("b", ""), ("c", "c")]


def test_floor_index_p95(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)], "g string, s double")
    assert {r.g: r.p95_s for r in ocr.latencies(rows, ["g"], "s").collect()} == {"a": 1.0, "b": 2.0}


def test_noun_and_adverb_forms(spark):
    words = spark.createDataFrame([(1, "guma", "guma", "", "", ["guma"]), (2, "mann", "mann", "", "", ["cynn"]), (3, "x", "x", "", "", ["stán"])], "nid int, title string, stem string, prefix string, wright string, paradigms array<string>")
    found = morphology.noun_forms(words).collect()
    assert [r.form for r in sorted((r for r in found if r.nid == 1 and not r.dup), key=lambda r: r.ord)] == ["guma", "guman", "guman", "guman", "guman", "guman", "gumena", "gumum"]
    assert ("man", "1") in {(r.formi, r.probability) for r in found if r.nid == 2 and r.dup} and not [r for r in found if r.nid == 3]
    assert [r for r in morphology.noun_forms(words, compat=False).collect() if r.nid == 3]
    adverbs = spark.createDataFrame([(1, "georne", "georne", "", ""), (2, "wel", "wel", "", "")], "nid int, title string, stem string, prefix string, wright string")
    rows = morphology.adverb_forms(adverbs).where("dup = 0").collect()
    assert [r.form for r in sorted((r for r in rows if r.nid == 1), key=lambda r: r.ord)] == ["georne", "geornor", "geornur", "geornar", "geornost", "geornust", "geornast", "geornst"]
    assert [r.form for r in rows if r.nid == 2] == ["wel"]


def test_sound_changes_are_cumulative(spark):
    rows = spark.createDataFrame([("PsInSg2", "findst"), ("PsInSg3", "bīdþ"), ("PaPt", "sended"), ("Inf", "x")], "function string, form string")
    found = {}
    for r in morphology.sound_changes(rows).orderBy("change").collect():
        found.setdefault(r.function, []).append(r.form)
    assert found == {"PsInSg2": ["findst", "fintst", "finst"], "PsInSg3": ["bīdþ", "bītt", "bīt"], "PaPt": ["sended"], "Inf": ["x"]}


def test_counter_follows_the_order(spark):
    rows = spark.range(50).select((F.col("id") * 7 % 50).alias("k"))
    assert {r.k: r.counter for r in morphology.numbered(rows, ["k"]).collect()} == {k: k for k in range(50)}


def test_tei_round_trip(spark):
    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>T</title></titleStmt></teiHeader><text><body><div n="1"><head>H</head><p><s>a b</s><s n="2">c</s></p><sp who="#X"><lg><l n="3">v</l></lg></sp><div><p>deep</p></div></div></body></text></TEI>'
    first = tei.read(docs(spark, xml, "<broken"))
    again = tei.read(tei.write(first.where("doc_id = 0")), "doc_id", "xml")
    rows = lambda df: sorted((r.kind, r.path, r.ord, r.number or "", r.speaker or "", r.text or "") for r in df.where("doc_id = 0 and kind in ('sentence', 'line')").collect())
    assert rows(first) == rows(again) and len(rows(first)) == 4
    assert [r.kind for r in first.where("doc_id = 1").collect()] == ["error"]

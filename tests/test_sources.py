"""Readers and writers on small files, and the operators that no query over the driver's tables reaches."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from skaldic.functions import scalars as S
from skaldic.operators import declension, diacritics, ingest, morphology, ocr, verbs
from skaldic.sources import files, sinks, tei
from skaldic.streaming import streams


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def col(spark, c, *values):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").orderBy("k").select(c).collect()]


def test_dispatch(spark):
    assert col(spark, files.source_format(F.col("x")), "https://a/b", "a.TEI", "a.xml", "<TEI/>", "a.md", "b.PHP") == ["http", "tei", "tei", "tei", "file", "file"]
    with pytest.raises(Exception, match="unsupported source"):
        col(spark, files.source_format(F.col("x")), "a.doc")


def test_texts_and_pre_blocks(spark, tmp_path):
    put(tmp_path / "t/a.txt", "one\n\ntwo\n")
    assert [r.text for r in files.texts(spark, str(tmp_path / "t")).collect()] == ["one\n\ntwo\n"]
    pages = spark.createDataFrame([(1, "<p>x</p><PRE class=a>one <b>line</b>\n\n \n\ntwo\nthree</PRE><pre>\n\n</pre><pre>four</pre>"), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    assert [(r.page_id, r.block_ix, r.text) for r in files.pre_blocks(pages).orderBy("page_id", "block_ix").collect()] == [(1, 0, "one line"), (1, 1, "two\nthree"), (1, 2, "four")]


def test_html_elements(spark):
    page = "<html><head><title>no</title></head><body><script>var a;</script><h1>Head &amp; more</h1><p>One <b>bold</b>\n line<br>after</p><!-- <p>x</p> --><ul><li>a<li> b </ul></body></html>"
    rows = files.html_elements(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")).orderBy("element_ix").collect()
    assert [(r.page_id, r.element_ix, r.text) for r in rows] == [(1, 0, "Head & more"), (1, 1, "One bold line"), (1, 2, "after"), (1, 3, "a"), (1, 4, "b")]


def test_dictionary(spark, tmp_path):
    row = lambda *x: "\t".join(map(str, x))
    flags = [0] * 20
    path = put(tmp_path / "d.txt", "\n".join([row(1, "Ðeód-Kyning", "335", *([1] + flags[1:])), row(2, "bindende", "", *[0, 0, 0, 0, 1, *flags[5:]]), row(3, "gebunden", "", *[0, 0, 0, 0, 1, "x", *flags[6:]]), "short\tline"]))
    rows = {r.nid: r for r in files.dictionary(spark, path).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].title == "þēod-cyning" and rows[1].noun == 1 and rows[3].adverb == 0
    assert (rows[2].pspart, rows[2].papart) == (1, 0) and (rows[3].pspart, rows[3].papart) == (0, 1)
    words = {r.nid: r for r in files.preprocess(files.dictionary(spark, path), ["þēod", "ge"]).collect()}
    assert (words[1].prefix, words[1].stem, words[1].syllables) == ("þēod", "cyning", 2)


def test_manual_forms(spark, tmp_path):
    path = put(tmp_path / "m.txt", "000001\tge-bēon\tu\t0-bēo-n\tu\t0\t1\tif\t5\tbēon\t7\tverb\ta\t\t\tnote\n000002\tis\tu\tis\n")
    rows = files.manual_forms(spark, path).orderBy("bt").collect()
    assert [(r.bt, r.stem, r.form_parts, r.form, r.function, r.comment) for r in rows] == [("000001", "bēon", "0-bēo-n", "0bēo-n", "if", "note"), ("000002", "is", "is", "is", "", "")]
    out = morphology.manual_rows(files.manual_forms(spark, put(tmp_path / "n.txt", "000003\tmann\tu\tmann\tu\t\t\tSgMaNo\n"))).orderBy("dup").collect()
    assert [(r.formi, r.probability) for r in out] == [("mann", ""), ("man", "1")]


def test_verb_paradigms(spark, tmp_path):
    line = lambda part, vowel, var=0: "\t".join(["1", "helpan", "s", "3", "", "", "500", str(var), part, "0", "h", vowel, "lp", "0", "0", "an"])
    rows = files.verb_paradigms(spark, put(tmp_path / "p.txt", "\n".join([line("if", "e"), line("painsg1", "ea"), line("if", "i"), line("if", "y", 2)]))).orderBy("variant_id", "part_ord").collect()
    assert [(r.variant_id, r.part, r.vowel) for r in rows] == [(0, "if", "i"), (0, "painsg1", "ea"), (2, "if", "y")]


def test_lists_and_rules(spark, tmp_path):
    assert files.prefix_list(spark, put(tmp_path / "a", " ge \n\nbe\n")) == ["ge", "be"]
    assert sorted(r.token for r in files.word_list(spark, put(tmp_path / "b", "The\n# no\n\nand\nTHE\n")).collect()) == ["and", "the"]
    assert files.rules(spark, put(tmp_path / "c", "# x\na\tb\n\n(c)\t\\1d\n")) == [("a", "b"), ("(c)", "\\1d")]
    assert col(spark, S.apply_rules(F.col("x"), [("a", "b"), ("(b)", "\\1c"), ("c+", "c")]), "aab") == ["bcbcbc"]
    with pytest.raises(ValueError):
        files.rules(spark, put(tmp_path / "d", "lonely\n"))


def test_index_round_trip(spark, tmp_path):
    index = spark.createDataFrame([("god", ["god", "gōd"], True), ("wif", ["wīf"], False), ("man", ["man", "mān"], True)], "key string, forms array<string>, is_ambiguous boolean")
    done = spark.createDataFrame([("god",), ("wif",)], "key string")
    sinks.write_index(index, str(tmp_path / "i"), done, {"source": "x"})
    rows = {r.key: (list(r.forms), r.is_ambiguous, r.completed) for r in files.macron_index(spark, str(tmp_path / "i")).collect()}
    assert rows == {"god": (["god", "gōd"], True, True), "man": (["man", "mān"], True, False), "wif": (["wīf"], False, False)}
    assert {r.name: r.value for r in files.index_meta(spark, str(tmp_path / "i")).collect()} == {"source": "x", "unique_count": "1", "ambiguous_count": "2"}
    whole = json.loads(sinks.index_document(index, done).first().value)
    assert list(whole["ambiguous"]) == ["god", "man"] and whole["ambiguous_completed"] == ["god"]


def test_index_actions(spark):
    index = spark.createDataFrame([("a", ["á", "à"], True), ("b", ["b", "ḃ"], True), ("c", ["c"], False)], "key string, forms array<string>, is_ambiguous boolean")
    senses = spark.createDataFrame([("a", "á", "N", "x"), ("a", "à", "V", "y"), ("b", "b", "N", "z"), ("a", "á", "N", "w")], "key string, form string, pos string, meaning string")
    assert [r.key for r in diacritics.completable(index, senses).collect()] == ["a"]
    acts = lambda *x: spark.createDataFrame(list(x), "key string, at int, action string, form string")
    none = spark.createDataFrame([], "key string")
    completed = lambda a, old=none: sorted(r.key for r in diacritics.fold_completed(index, senses, old, a).collect())
    assert completed(acts(("a", 1, "mark", None), ("b", 2, "mark", None))) == ["a"]
    assert completed(acts(("a", 1, "mark", None), ("a", 2, "add", "q"))) == []
    assert completed(acts(("a", 1, "define", None)), spark.createDataFrame([("b",), ("c",)], "key string")) == ["b"]
    after = diacritics.define(senses, spark.createDataFrame([("b", "ḃ", "ADJ", "new"), ("c", "c", "N", "not defined")], senses.schema), spark.createDataFrame([("b",)], "key string"))
    assert sorted((r.key, r.form, r.meaning) for r in after.collect()) == [("a", "à", "y"), ("a", "á", "w"), ("a", "á", "x"), ("b", "ḃ", "new")]
    named = diacritics.annotate(spark.createDataFrame([("a", "á"), ("b", "ḃ")], "key string, form string"), senses).orderBy("key").collect()
    assert named[0].parts_of_speech == "noun" and sorted(named[0].meanings) == ["w", "x"] and named[1].meanings is None
    kept, missing = diacritics.delete_forms(index, spark.createDataFrame([("a",), ("z",)], "key string"))
    assert sorted(r.key for r in kept.collect()) == ["b", "c"] and [r.key for r in missing.collect()] == ["z"]
    source = spark.createDataFrame([("x@y@z",), ("bad",), ("a@b@c@d",)], "value string")
    assert tuple(diacritics.index_counters(source, index).first()) == (3, 2, 1, 2)


def test_c_and_g(spark):
    assert col(spark, S.palatalize_c(F.col("x")), "cild", "cyning", "ic", "iċ", "cēosan", "hwelc", "Cild") == ["ċild", "cyning", "iċ", "iċ", "ċēosan", "hwelċ", "Ċild"]
    assert col(spark, S.palatalize_g(F.col("x")), "gear", "dæg", "dagas", "god", "GE") == ["ġear", "dæġ", "dagas", "god", "ĠE"]


def test_search_pages(spark):
    page = """<article><div class="btd--search-entry"><header><h3><a href="/137">ÁC</a></h3><div class="btd--search-entry-wordclass">(n.)</div></header>
      <div class="btd--search-description"><p>OAK ⬩ quercus ⬩ robur</p><p>later</p></div></div><div class="btd--search-entry"><header></header></div>
      <div class="btd--search-entry"><header><h3><a href="/37406">ac</a></h3></header></div></article><div class="btd--search-entry"><header><h3><a>outside</a></h3></header></div>"""
    found = files.search_entries(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"))
    rows = found.orderBy("order_index").collect()
    assert [(r.order_index, r.headword, r.headword_macronized, r.pos, list(r.meanings), r.entry_url) for r in rows] == [
        (0, "ÁC", "ĀC", "n.", ["OAK", "quercus", "robur"], "https://bosworthtoller.com/137"), (2, "ac", "ac", "", [], "https://bosworthtoller.com/37406"),
    ]
    assert [r.headword for r in files.entries_of_form(found, "ac").orderBy("order_index").collect()] == ["ÁC", "ac"]
    twice = files.search_entries(spark.createDataFrame([(2, page), (1, page.replace("ÁC", "ác"))], "page_id int, html string"))
    merged = files.merge_entries(twice, ["page_id", "order_index"]).orderBy("order_index").collect()
    assert [(r.order_index, r.page_id, r.headword) for r in merged] == [(0, 1, "ác"), (1, 1, "ac")]


def test_log_counters(spark):
    logs = spark.createDataFrame([("x prompt_tokens=12 request_s=1.75",), ("prompt_tokens=3 request_s=2 y=z",), (None,)], "line string")
    assert {r.name: (r.n, r.total) for r in files.log_counters(logs).collect()} == {"prompt_tokens": (2, 15.0), "request_s": (2, 3.75)}


def test_markdown_pages(spark, tmp_path):
    put(tmp_path / "o/b/2.md", "two"), put(tmp_path / "o/a/1.md", "one"), put(tmp_path / "o/3.md", "  \n"), put(tmp_path / "o/4.txt", "no")
    pages = files.markdown_pages(spark, str(tmp_path / "o")).withColumn("book", F.lit("x"))
    assert [r.text for r in ocr.join_pages(pages, "book").collect()] == ["one\n\ntwo"]
    put(tmp_path / "e/1.md", " ")
    with pytest.raises(ValueError):
        files.markdown_pages(spark, str(tmp_path / "e"))


def test_form_sinks(spark, tmp_path):
    nouns = spark.createDataFrame([(2, "mann", "mann", "", "335", ["hand"]), (1, "ac", "ac", "", "", ["hand"])], "nid int, title string, stem string, prefix string, wright string, paradigms array<string>")
    verbs_ = spark.createDataFrame([("000001", "if", "bēon", "x")], "bt string, function string, form string, formi string")
    rows = morphology.stage_rows({"noun": morphology.noun_forms(nouns), "manual": verbs_})
    assert rows.columns == ["stage_ord", *morphology.FORM_COLUMNS] and {r.stage_ord for r in rows.collect()} == {1, 6}
    sinks.write_forms(rows, str(tmp_path / "f"), ["stage_ord", "BT", "function", "formi", "probability"])
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert sorted(int(x[0]) for x in lines) == list(range(len(lines))) and {len(x) for x in lines} == {18}
    assert min(lines, key=lambda x: int(x[0]))[5] == "bēon" and len(lines) == 1 + 8 + 16
    sinks.write_snapshot(rows, str(tmp_path / "s"))
    found = [json.loads(x) for p in sorted((tmp_path / "s").glob("part-*.gz")) for x in gzip.open(p, "rt", encoding="utf-8")]
    assert found == sorted(found, key=lambda r: [r[c] for c in morphology.CANONICAL]) and list(found[0]) == sorted(morphology.FORM_COLUMNS) and len(found) == len(lines)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_snapshot(rows, str(tmp_path / "s"))
    sinks.write_snapshot(rows, str(tmp_path / "s"), update=True)
    assert [r.nid for r in morphology.first_words(nouns, 1).collect()] == [1]


def test_restore_sinks(spark, tmp_path):
    index = spark.createDataFrame([("god", ["god", "gōd"], True), ("wif", ["wīf"], False)], "key string, forms array<string>, is_ambiguous boolean")
    docs = spark.createDataFrame([(1, "wif god xyz")], "doc_id long, text string")
    at = sinks.write_restored(diacritics.restore(docs, index), diacritics.look_up(diacritics.tokens(docs), index), str(tmp_path / "in.txt"))
    assert at == {"text": str(tmp_path / "in.fixed.txt"), "ambiguities": str(tmp_path / "in.anomalies.json"), "unknowns": str(tmp_path / "in.unknown.json")}
    assert [r.value for r in spark.read.text(at["text"]).collect()] == ["wīf god xyz"]
    assert [(r.word, r.options) for r in spark.read.json(at["ambiguities"]).collect()] == [("god", ["god", "gōd"])] and [r.word for r in spark.read.json(at["unknowns"]).collect()] == ["xyz"]
    counts = spark.createDataFrame([("b", 2, 5), ("a", 2, 1), ("c", 9, 7)], "token string, n long, first_seen long")
    sinks.write_unknown(counts, str(tmp_path / "u"))
    assert [r.value for r in sinks.unknown_table(counts).orderBy("place").collect()] == ["token\tcount", "c\t9", "a\t2", "b\t2"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "u")).collect()) == ["a\t2", "b\t2", "c\t9", "token\tcount"]


def test_document_json(spark):
    docs = spark.createDataFrame([(1, "I. FIRST\nThis is a line of prose that is much longer than a line of verse can be, and it ends in a stop."), (2, None)], "doc_id long, text string")
    found = ingest.sections(ingest.runs(ingest.classify_lines(ingest.lines(docs))).drop("is_heading"))
    rows = {r.doc_id: json.loads(r.value) for r in sinks.document_json(found, spark.createDataFrame([(1, "T"), (2, "U")], "doc_id long, title string")).collect()}
    assert rows[1]["metadata"] == {"title": "T"} and [(s["number"], s["title"], len(s["blocks"])) for s in rows[1]["sections"]] == [(1, "FIRST", 1)] and rows[2]["sections"] == []


def test_veto(spark):
    cols = "name string, valid boolean, mean_cer double, mean_wer double, ae_recall double, eth_recall double, thorn_recall double, macron_recall double"
    rows = spark.createDataFrame([("ok", True, 0.1, 0.2, 1.0, 1.0, 1.0, 1.0), ("worse", True, 0.2, 0.2, 1.0, 0.5, 1.0, None), ("bad", False, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], cols)
    base = spark.createDataFrame([("base", True, 0.1, 0.0, 1.0, 1.0, 1.0, 1.0)], cols)
    assert {r.name: list(r.reasons) for r in ocr.veto(rows, base).collect()} == {
        "ok": ["mean_wer_exceeds_zero_baseline"], "worse": ["eth_recall_dropped>0.5000", "mean_cer_regressed>100.00%", "mean_wer_exceeds_zero_baseline"], "bad": ["model_verification_failed"],
    }
    assert {r.name: list(r.reasons) for r in ocr.veto(rows, base.limit(0)).collect()} == {"ok": ["baseline_unavailable"], "worse": ["baseline_unavailable"], "bad": ["model_verification_failed"]}
    assert ocr.baseline_of(rows, F.col("name") == "worse", "name").first().name == "worse" and ocr.baseline_of(rows, F.col("name") == "bad", "name").first().name == "ok"


def test_failures_and_traits(spark):
    pages = spark.createDataFrame([("a", "timeout"), ("a", "timeout"), ("a", None), ("b", "run_failed")], "fixture string, failure_reason string")
    assert {(r.fixture, r.reason): r.n for r in ocr.failure_histogram(pages, ["fixture"]).collect()} == {("a", "timeout"): 2, ("b", "run_failed"): 1}
    rows = spark.createDataFrame([("a", ["x", "y"], 2.0, 3.0, 1, 0, True), ("b", ["x"], 9.0, 9.0, 0, 2, None)], "fixture string, traits array<string>, mean_s double, p95_s double, pages_measured int, failed_pages int, quality_pass boolean")
    assert {r.trait: (r.fixtures, r.pages_measured, r.failed_pages, r.mean_s, r.p95_s, r.quality_pass) for r in ocr.by_trait(rows).collect()} == {"x": (2, 1, 2, 2.0, 3.0, False), "y": (1, 1, 0, 2.0, 3.0, True)}
    empty = spark.createDataFrame([(None,)], "s double").agg(ocr.mean_or(F.col("s")).alias("a"), ocr.mean_or(F.col("s"), 7.0).alias("b")).first()
    assert tuple(empty) == (0.0, 7.0)


def test_page_furniture(spark):
    rows = spark.createDataFrame([(1, 0, "12"), (1, 1, "THE GREAT BOOK\nA line of prose that is long enough to be kept as it stands here, and a stop."), (1, 2, None), (1, 3, "ONE TWO THREE FOUR FIVE SIX SEVEN\nx"), (1, 4, " (3) ")], "doc_id long, element_ix int, text string")
    kept = {r.element_ix: r.text for r in ingest.without_page_furniture(rows).collect()}
    assert set(kept) == {1, 3} and not kept[1].startswith("THE") and kept[3].startswith("ONE TWO")
    blocks = ingest.element_blocks(rows).orderBy("block_ix").collect()
    assert [(r.block_ix, r.is_heading) for r in blocks] == [(0, False), (1, True), (2, False)]


def test_headings_only_are_content(spark):
    docs = spark.createDataFrame([(1, "I. FIRST\nII. SECOND"), (2, "I. FIRST\nThis is a line of prose that is much longer than a line of verse can be, and it ends in a stop.")], "doc_id long, text string")
    rows = ingest.sections(ingest.runs(ingest.classify_lines(ingest.lines(docs))).drop("is_heading")).orderBy("doc_id", "block_ix").collect()
    assert [(r.doc_id, r.section_ix, r.title, r.text.split("\n")[0][:5]) for r in rows] == [(1, 0, None, "I. FI"), (1, 0, None, "II. S"), (2, 0, "FIRST", "This ")]


def test_headings_and_speakers(spark):
    assert col(spark, S.heading_number(F.col("x")), "XII. Title", "A.D. 871", "Her 899", "Cap. IV", "no") == [12, 871, 899, 4, None]
    assert col(spark, S.is_heading(F.col("x")), "XII. Title", "BEOWULF", "---", "Hwæt", "Chapter 1") == [True, True, True, False, True]
    assert col(spark, S.speaker(F.col("x")), "Adam cwæð þæt", "\nEua:\nx", "Adam eode") == ["Adam", "Eua", None]


def nouns(spark, *rows):
    names = "nid int, stem string, wright string, n_masc int, n_fem int, n_neut int, n_uncert int"
    return spark.createDataFrame([(k, s, w, int(g == "m"), int(g == "f"), int(g == "n"), int(g == "u")) for k, (s, w, g) in enumerate(rows)], names)


def labels(df):
    return [r.paradigms for r in df.orderBy("nid").collect()]


def test_noun_labels(spark):
    rows = nouns(spark, ("x", "401", "m"), ("guma", "", "m"), ("frēa", "", "m"), ("tunge", "", "f"), ("ende", "", "m"), ("rice", "", "n"), ("wigend", "", "m"), ("frēondscipe", "", "m"), ("gōdness", "", "f"), ("stæf", "", "m"), ("bæc", "", "n"), ("word", "", "n"), ("lim", "", "n"), ("hring", "", "u"), ("lār", "", "f"), ("hond", "398", "f"))
    assert labels(morphology.noun_paradigms(rows)) == [["guma"], ["guma"], ["fréa"], ["tunge"], ["stán"], ["hof"], ["wígend"], ["stán", "stán"], ["ár"], ["dæg"], ["fæt"], ["word"], ["word"], ["stán"], ["ár"], ["hand", "duru"]]


def test_labels_are_handed_on(spark):
    rows = nouns(spark, ("cyn", "", "n"), ("cin", "356", "n"), ("gecyn", "", "n"), ("cien", "", "m"), ("hond", "", "f"), ("hond", "398", "f"), ("stan", "", "m"))
    assert labels(morphology.noun_paradigms(rows, ["ge"])) == [["cynn"], ["cynn"], ["cynn"], ["stán"], ["hand"], ["hand", "duru"], ["stán"]]
    assert labels(morphology.noun_paradigms(nouns(spark, ("cin", "", "n"), ("cien", "356", "n")), [])) == [["cynn"], ["cynn"]]


def test_r_stems_and_pairs(spark):
    rows = nouns(spark, ("fæder", "335;415", "m"), ("mōdor", "", "f"))
    assert labels(morphology.noun_paradigms(rows, r_stems=True)) == [["fæder"], ["mōdor"]] and labels(morphology.noun_paradigms(rows))[0] == ["stán"]
    forms = declension.r_stem_forms(spark.createDataFrame([(1, "fæder", "fæder", "", "415", "fæder")], "nid int, title string, stem string, prefix string, wright string, paradigm string"))
    assert {r.form for r in forms.where("dup = 0").collect()} == {"fæder", "fæderes", "fædere", "fæderas", "fædera", "fæderum"}
    paired = morphology.positional_pairs(nouns(spark, ("dæg", "", "m"), ("x", "", "m")), spark.createDataFrame([(9, "long"), (4, "tohopa")], "nid int, stem string"))
    assert {r.stem: r.pair_stem for r in paired.collect()} == {"dæg": "tohopa", "x": "long"}
    assert labels(morphology.noun_paradigms(paired)) == [["stán"], ["stán"]]
    assert col(spark, morphology.section_token(F.col("x"), "415"), "335;415", "4150", None) == [True, False, False]
    assert col(spark, morphology.is_ge_collective(F.lit("ge"), F.col("x")), "ge-brōþor", "gebrōþor") == [True, False]


def test_adjective_labels(spark):
    rows = spark.createDataFrame([(1, "glæd", "425", 1), (2, "twifeald", "", 1), (3, "hēah", "", 0), (4, "wilde", "", 0), (5, "gearu", "", 0), (6, "manig", "430", 0), (7, "þweorh", "426", 0), (8, "langsum", "", 0)], "nid int, stem string, wright string, numeral int")
    found = {r.nid: (r.paradigm, r.numeral) for r in morphology.adjective_paradigms(rows).collect()}
    assert found == {1: ("glæd", 1), 2: ("blind", 0), 3: ("héah", 0), 4: ("wilde", 0), 5: ("gearu", 0), 6: ("manig", 0), 7: ("þweorh", 0), 8: ("til", 0)}


def test_ranks_within_groups(spark):
    rows = spark.createDataFrame([("a", x) for x in range(30)] + [(None, 5), ("b", 1)], "g string, x int").repartition(5)
    assert sorted((r.g or "", r.x, r.counter) for r in morphology.numbered(rows, ["x"], ["g"]).collect()) == [("", 5, 0)] + [("a", k, k) for k in range(30)] + [("b", 1, 0)]


def test_streams(spark, tmp_path):
    put(tmp_path / "in/x", "")
    rows = spark.createDataFrame([(1, "wif xyz xyz", "2024-01-01 00:10:00"), (2, "xyz", "2024-01-01 01:10:00")], "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "rows"))
    index = spark.createDataFrame([("wif", ["wīf"], False)], "key string, forms array<string>, is_ambiguous boolean")
    for name, made, mode in (("looked", streams.looked_up, "append"), ("counted", streams.unknown_counts, "complete")):
        q = made(streams.texts(spark, str(tmp_path / "rows")), index).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
        q.stop()
    assert sorted((r.word, r.restored, r.is_unknown) for r in spark.table("looked").collect()) == [("wif", "wīf", False)] + [("xyz", "xyz", True)] * 3
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 2]


def test_tei_parts(spark):
    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title> </title><author>A</author></titleStmt></teiHeader><text><body><div n="2"><head>H</head><p>whole text</p><p><s>one</s><s n="4">two</s></p><sp who="#Adam"><p><s>said</s></p><lg><l n="x">no number</l><l n="7">seven</l></lg></sp></div><div><p>second div</p></div></body></text></TEI>'
    rows = tei.read(spark.createDataFrame([(1, xml)], "doc_id long, text string")).orderBy("path", "ord").collect()
    texts = [(r.kind, r.text, r.number, r.speaker) for r in rows if r.kind in ("sentence", "line")]
    assert [t[1] for t in texts] == ["whole text", "one", "two", "said", "no number", "seven"] or {t[1] for t in texts} == {"whole text", "one", "two", "said", "no number", "seven"}
    by = {t[1]: t for t in texts}
    assert by["two"][2] == "4" and by["seven"][2] == "7" and not by["no number"][2] and "Adam" in by["said"][3] and "Adam" in by["seven"][3] and not by["one"][3]
    assert "second div" not in by and any(r.kind == "meta" and r.title == "title" and r.text == "unknown" for r in rows) and any(r.title == "Verse" for r in rows)


def test_verb_shapes(spark):
    names = ", ".join(f"{f} int" for f in verbs.FLAGS)
    rows = spark.createDataFrame([(k, x, 1, 0, 0, 0, 0) for k, x in enumerate(["delfan", "bindan", "faran", "beran"])], f"k int, stem string, {names}")
    assert [r[0] for r in rows.orderBy("k").select(verbs.heuristic_id(F.col("stem"))).collect()] == ["13", "10", "31", "19"]


def test_folding_helpers(spark):
    assert col(spark, S.leading_number(F.col("x")), "12a", " 3.5x", "ge", None) == [12.0, 3.5, 0.0, 0.0]
    assert col(spark, S.empty_if_zero(F.col("x")), "0", "a", None) == ["", "a", ""]
    assert col(spark, S.without_prefix(F.col("x")), "ge-bindan", "a b", "x") == ["bindan", "b", "x"]
    assert col(spark, S.degeminate(F.col("x")), "mann", "aabb") == ["man", "ab"]
    assert col(spark, S.collapse_spaces(F.col("x")), "  a \n b ") == ["a b"]
    assert col(spark, S.eth_to_thorn(F.col("x")), "Ðe kð", None) == ["Þe cþ", ""] and col(spark, S.remove_macrons(F.col("x")), "gōd Ǣ") == ["god Æ"]
    assert col(spark, S.move_accents(F.col("x")), "beón eác hiéran") == ["bēon ēac hīeran"] and col(spark, S.acute_to_macron(F.col("x")), "ác ǽnig") == ["āc ǣnig"]
    assert col(spark, S.i_mutation(F.col("x")), "a", "ū", "q") == [["æ", "a", "e"], ["ȳ", "ū"], ["q", "q"]]
    assert col(spark, S.case_like(F.col("x"), F.lit("gōd")), "GOD", "God", "god", "gOd") == ["GŌD", "Gōd", "gōd", "gōd"]
    assert col(spark, S.stem_variants(F.col("x"), ["ge"]), "gecynin") == [["cynin", "cinin", "cynyn", "cienien"]]
    assert col(spark, S.backoff_seconds(F.lit(1.0), F.col("x").cast("int")), "1", "3", "9") == [1.0, 4.0, 5.0]
    assert col(spark, S.page_text(F.col("x")), "a  \r\nb\n\n\n\n\nc") == ["a\nb\n\n\nc\n"]

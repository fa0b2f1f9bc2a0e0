"""Verb phases and request rules on small tables."""

import json

from pyspark.sql import functions as F

from skaldic.operators import completions, verbs


def test_verb_phases(spark):
    rows = [
        (1, "bindan", "NULL", 1, 0, 0, 0, 0), (2, "bindan", "NULL", 0, 0, 0, 0, 1), (3, "gebindan", "NULL", 1, 0, 0, 0, 0), (4, "faran", "475;476", 1, 0, 0, 0, 0), (5, "bīndan", "NULL", 0, 1, 0, 0, 0),
        (6, "lufian", "NULL", 0, 1, 0, 0, 0), (7, "xx", "NULL", 1, 0, 0, 0, 0), (8, "xx", "NULL", 0, 1, 0, 0, 0), (9, "byndan", "NULL", 1, 0, 0, 0, 0),
    ]
    words = spark.createDataFrame(rows, "nid int, stem string, wright string, vb_strong int, vb_weak int, vb_pretpres int, vb_anomalous int, vb_uncertain int")
    paradigms = spark.createDataFrame([("10", 1, "bindan", "s", "0"), ("31", 2, "x", "s", "47[56]"), ("87", 3, "y", "w", "0"), ("13", 4, "z", "s", "0")], "para_id string, ord int, title string, type string, wright string")
    found = {r.nid: (list(r.ids), r.phase, r.stem) for r in verbs.assign(words, paradigms, ["ge", "be"]).collect()}
    assert found == {
        1: (["10"], 0, "bindan"), 2: (["10"], 1, "bindan"), 3: (["10"], 4, "bindan"), 4: (["31", "31"], 2, "faran"), 5: (["10"], 6, "bīndan"),
        6: (["87"], 5, "lufian"), 7: (["13"], 8, "xx"), 8: (["76"], 8, "xx"), 9: (["10"], 4, "byndan"),
    }


def test_requests(spark):
    payload = json.dumps({"model": "m", "max_tokens": 9000, "messages": [{"content": "hi"}, {"content": [{"type": "text", "text": "x"}, {"type": "image_url", "image_url": {"url": "abcd"}}]}]})
    found = completions.summary(spark.createDataFrame([(payload,), ("{}",)], "payload string")).collect()
    assert [(r.message_count, r.text_segments, r.image_segments, r.image_url_total_chars) for r in found] == [(2, 2, 1, 4), (0, 0, 0, 0)] and found[0].max_tokens == "9000"
    rows = spark.createDataFrame([("9000", None, None, None), (None, None, "0.5", None), ("100", "50", None, None)], "max_tokens string, max_completion_tokens string, temperature string, top_p string")
    done = completions.clamp(rows, 1000, temperature=0.1).collect()
    assert [r.max_tokens for r in done] == [1000, 1000, 100] and done[0].notes[0] == "clamped max_tokens 9000 -> 1000" and done[1].notes[0] == "set max_tokens to cap 1000 (field missing)"
    assert all(r.temperature == 0.1 for r in done) and completions.clamp(rows, 1000, both=True).collect()[2].max_tokens == 50


def test_finish_reason(spark):
    rows = spark.createDataFrame([("length", "---\na: 1\n---\n" + "x" * 30), ("length", "---\n- a\n---\n" + "x" * 30), ("length", "x" * 50), ("stop", "y"), ("length", "---\na: 1\n---\nshort")], "reason string, content string")
    out = rows.select(completions.finish_reason(F.col("reason"), F.col("content"), 20, 3).alias("r")).collect()
    assert [r.r for r in out] == ["stop", "length", "length", "stop", "length"]


def test_verse_repair_and_realigning(spark):
    chunks = spark.createDataFrame([(1, "verse", "a\n\nb ", ["p"], "X"), (2, "prose", "a", ["p"], None)], "chunk_id int, kind string, source string, paragraphs array<string>, speaker string")
    assert [(r.number, r.text, r.speaker) for r in completions.verse_repair(chunks).collect()] == [(1, "a", "X"), (3, "b", "X")]
    pairs = spark.createDataFrame([("a b.(c", "x\n a \t b.(c y"), ("no", "x"), ("", "x")], "text string, raw string")
    assert [r.aligned for r in completions.realign(pairs).collect()] == ["\n a \t b.(c ", "no", ""]

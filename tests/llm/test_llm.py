"""The training-data operators against brute force, and on odd rows."""

import collections
import hashlib
import random
import re
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skaldic.llm import chat, decontaminate, graph, html_extract, induced, langid, line_dedup, packing, quality, rules, simhash, suffix_dedup
from skaldic.llm.queries import word_bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __doc string, k int"
WORDS = "the of and to a in is it you that he was for on are with as his they at be this have from or one had by word but not what all were we when".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (f"{rng.randrange(999)}" if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long, equal rows, ties, and columns whose names the operators use themselves."""
    long = prose(1, 60_000)
    texts = [(1, long), (2, long), (3, None), (4, ""), (5, " \n\t"), (None, "null id here"), (None, None), (7, "a"), (8, prose(2, 80)), (8, prose(2, 80)), (9, prose(2, 79) + " changed"), (10, "x\n" * 500), (11, "þ\x00é 中文 <|im_start|>")]
    return spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 3 // 2, 0) for k in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_packing_round_trip(spark, odd, empty):
    rows = packing.pack_documents(odd, word_bpe()).collect()
    encoder = packing.WordEncoder(word_bpe())
    wanted = collections.Counter()
    for r in odd.collect():
        raw = encoder.whole(r.text or "") + b"\0\0\0\0"
        for k in range(0, len(raw), 8192):
            wanted[r.doc_id, k // 8192, k // 4, len(raw[k : k + 8192]) // 4, zlib.crc32(raw[k : k + 8192])] += 1
    assert wanted == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack_documents(empty, word_bpe()).count() == 0
    pieces = packing.cut(odd, word_bpe())
    again = packing.pack(pieces, buckets=1, group=3).collect()
    assert len(again) == len(rows) and len({(r.sequence_id, r.offset) for r in again}) == len(again)


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_up_the_counts(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randrange(1, 65), 64, 1, 33]) for _ in range(rng.randrange(400)))
    plan, used = packing.plan_sequences(counts, 64), collections.Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert used == counts


def test_word_encoder_equals_the_tokenizer():
    encoder = packing.WordEncoder(word_bpe())
    for text in ["", " ", "İstanbul ΣΑΣ", "a\x1cb", "²½ª it's I'LL a_b 3.14 x y\x85z\xa0q", "<|endoftext|> hi <|", "don't WE'VE 'S 'tis", "ÀÉ¼¾µ ß ÿ", "中文 abc", "é x", prose(4, 300).upper()]:
        assert encoder.encode(text) == encoder.whole(text), text


def brute_groups(items, linked):
    root = {k: k for k, _ in items}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, x in items:
        for j, y in items:
            if j < k and linked(x, y):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k, _ in items}


def brute_fingerprint(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    import xxhash

    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, odd, empty):
    found = [r for r in simhash.near_duplicates(odd).collect()]
    rows = odd.select("doc_id", "text").collect()
    assert collections.Counter((r.doc_id, r.fp % (1 << 64)) for r in found) == collections.Counter((r.doc_id, brute_fingerprint(r.text)) for r in rows)
    known = sorted({(r.doc_id, r.fp % (1 << 64)) for r in found if r.doc_id is not None})
    wanted = brute_groups(known, lambda x, y: (x ^ y).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == wanted
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowd", [0, 6, 1000])
def test_crowded_keys_lose_no_link(spark, crowd):
    rng = random.Random(5)
    base, some = rng.getrandbits(64), set()
    for _ in range(150):
        x = base
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        some.add(x)
    nodes = list(enumerate(sorted(some)))
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for k, x in nodes], "fp long, rep long")
    found = {r.node: r.component for r in graph.components(simhash.links(rows, crowd)).collect()}
    assert {k: found.get(k, k) for k, _ in nodes} == brute_groups(nodes, lambda x, y: (x ^ y).bit_count() <= 2)


def test_similar_groups(spark, odd, empty):
    texts = [(k, prose(k // 4, 60 + k % 4)) for k in range(24)] + [(24, None), (25, ""), (26, "a b"), (27, "A B")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = [(k, set(zip(*[(t or "").lower().split()[j:] for j in range(5)])) or {(t or "").lower()}) for k, t in texts]
    wanted = brute_groups(sets, lambda x, y: len(x & y) >= 0.8 * len(x | y))
    for crowd in (48, 2):
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs, crowd=crowd).collect()} == wanted
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 7, 8, 8, 10, 11]
    assert simhash.one_of_each(empty).count() == 0


def near_groups(texts):
    """Brute force: components at Jaccard 0.8 of five-word shingles."""
    sets = [(k, set(zip(*[t.split()[j:] for j in range(5)]))) for k, t in texts]
    return brute_groups(sets, lambda x, y: len(x & y) >= 0.8 * len(x | y))


@pytest.mark.parametrize("block", [256, 16])
def test_crowds_of_variants_lose_no_group(spark, block):
    rng, texts = random.Random(4), []
    for k in range(60):  # variants of one template below 0.8, and two light copies of each
        words = prose(7, 100).split()
        for at in rng.sample(range(100), 4):
            words[at] = f"v{k}x{at}"
        for c in range(2):
            copy = words.copy()
            copy[rng.randrange(100)] = f"c{k}x{c}"
            texts.append((2 * k + c, " ".join(copy)))
    wanted = near_groups(texts)
    found = simhash.similar_groups(spark.createDataFrame(texts, "doc_id long, text string"), crowd=8, block=block)
    assert len(set(wanted.values())) > 20 and {r.doc_id: r.component_id for r in found.collect()} == wanted


def test_repeated_shingles_lose_no_pair(spark):
    texts = []
    for k in range(8):
        body = prose(100 + k, 600)
        texts += [(2 * k + c, f"{body} " + f"{prose(200 + 2 * k + c, 8)} " * 300) for c in range(2)]
    wanted = near_groups(texts)
    assert len(set(wanted.values())) == 8
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == wanted


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(5, 5), (100, 99), (100, 99), (None, 3)], "u long, v long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {k: 0 for k in range(61)} | {99: 99, 100: 99}


def test_masks_hit_every_window():
    import itertools

    masks = [[k for k, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    assert all("0" in m for m in decontaminate.MASKS)
    for lost in itertools.combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(not {at + k for k in m} & set(lost) for m in masks for at in range(decontaminate.WINDOW - m[-1]))
    short = [k for k, c in enumerate(decontaminate.SHORT_MASK) if c == "1"]
    assert all(any(lost not in {at + k for k in short} for at in range(decontaminate.SHORT - short[-1])) for lost in range(decontaminate.SHORT))


def test_decontamination_tolerates_substitutions(spark, odd, empty, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron".split()
    hit, twice, short = item.copy(), item.copy(), "one two three four five six seven"
    hit[4] = hit[9] = "wrong"
    for k in (1, 5, 9, 13):
        twice[k] = "wrong"
    texts = [(1, "Before it, " + " ".join(item).upper() + "! after"), (2, " ".join(hit)), (3, " ".join(twice)), (4, short), (5, short.replace("four", "for")), (6, prose(3, 50)), (7, None), (8, " ".join(item[2:]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, short), (3, "too short"), (4, None), (None, short)], "item_id long, text string")
    for limit in (500_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
        assert {r.doc_id: list(r["items"]) for r in decontaminate.flag(docs, items).collect()} == {1: [1], 2: [1], 3: [], 4: [2], 5: [], 6: [], 7: [], 8: [1]}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 5, 6, 7]
    assert decontaminate.clean(odd, items).columns == odd.columns and decontaminate.clean(odd, items).count() == odd.count()
    assert decontaminate.flag(empty, items).count() == 0 and decontaminate.clean(odd, items.limit(0)).count() == odd.count()


def test_line_dedup(spark, odd, empty):
    shared = [prose(k, 12) for k in range(20, 32)]
    texts = [(1, "\n".join(["first", *shared, "end"])), (2, "\n".join(["other", "start", "here", *shared, "more", "lines"])), (3, "\n".join(shared)), (4, "one\ntwo"), (5, "one\ntwo"), (6, "one"), (7, "one"), (8, "\n\n\n"), (9, "\n\n\n")]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[1].text == texts[0][1] and found[4].text == "one\ntwo" and found[5].text == "" and found[7].text == "one" and found[9].text == "\n\n\n"
    assert found[2].n_removed_lines >= 6 and found[2].text.startswith("other\nstart") and found[2].text.endswith("more\nlines")
    out = line_dedup.dedup_lines(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == odd.count()
    assert [r.text for r in out.where("doc_id = 3").collect()] == [None] and len({r.text for r in out.where("doc_id = 8").collect()}) == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_takes_whole_passages(spark):
    """A shared passage that holds a chunk goes as a whole, whatever stands around it, and nothing else goes."""
    rng, texts, left = random.Random(9), [], {}
    for k in range(60):
        passage = [prose(3000 + 20 * k + j, 9) for j in range(rng.randrange(9, 14))]
        for c in range(3):
            own = [prose(9000 + 100 * k + 30 * c + j, 7) for j in range(rng.randrange(2, 12))]
            at = rng.randrange(len(own) + 1)
            doc = 3 * k + c
            texts.append((doc, "\n".join([*own[:at], *passage, *own[at:]])))
            left[doc] = texts[-1][1] if c == 0 else "\n".join(own)
    found = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(found[d].text == t for d, t in left.items() if d % 3 == 0 or found[d].n_removed_chunks)
    assert sum(found[d].text == t for d, t in left.items()) >= 170


def test_suffix_order_and_prefixes(monkeypatch):
    rng = random.Random(2)
    for trial in range(120):
        monkeypatch.setattr(induced, "SPILL", rng.choice([0, 10, 10**6]))
        text = bytes(rng.choice(b"abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(rng.randrange(50))) * rng.choice([1, 1, 3])
        raw = np.concatenate((np.frombuffer(text, np.uint8), np.zeros(36, np.uint8)))
        sa, lcp = induced.suffix_sort(np.append(raw[: len(text)].astype(np.uint16) + 1, 0), raw, 20)
        order = sorted(range(len(text) + 1), key=lambda k: text[k:])
        assert sa.tolist() == order
        both = lambda a, b: next((k for k in range(20) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text)), 20)
        assert lcp.tolist() == [0, *map(both, order, order[1:])]


def brute_suffix(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [2000, 2])
def test_suffix_dedup(spark, empty, crowd):
    passage = prose(9, 70)
    rows = [(k, prose(k, 30) + passage[k * 7 :] + prose(k + 50, 20 + k)) for k in range(12)]
    rows += [(20, "ab" * 400), (21, "a" * 700), (22, None), (23, ""), (24, "x" * 99), (25, "a" * 100), (26, "é" * 130), (27, passage), (28, passage), (29, passage[:120] + "!" + passage[100:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, crowd).collect()}
    assert found == brute_suffix(rows)
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_sort_takes_whole_arrays():
    """F1 of round 2: the sort of a shard must not take its suffixes one at a time in Python."""
    passage = prose(3, 400)
    strings = [(prose(k, 20) + passage[5 * k : 5 * k + 600]).encode() for k in range(60)]
    text = b"\xff".join(strings)
    raw = np.concatenate((np.frombuffer(text, np.uint8), np.zeros(116, np.uint8)))
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return count if frame.f_code.co_filename == induced.__file__ else None

    before = sys.gettrace()
    sys.settrace(count)
    try:
        sa, lcp = induced.suffix_sort(np.append(raw[: len(text)].astype(np.uint16) + 1, 0), raw, 100)
    finally:
        sys.settrace(before)
    order = sorted(range(len(text) + 1), key=lambda k: text[k:])
    assert sa.tolist() == order
    assert lines < len(text) / 2


def test_suffix_runs_of_texts_together():
    """Texts hashed end to end have the runs that each has alone, and no run reaches over an end."""
    texts = [t.encode() for t in (prose(1, 300), "", "x" * 99, "x" * 100, prose(2, 40), "ab" * 900, prose(1, 300), "", "é" * 700, "\0" * 150)]
    powers = suffix_dedup.Powers()
    alone = [(k, *r) for k, t in enumerate(texts) for r in zip(*(c.tolist() for c in suffix_dedup.runs(t, np.array([len(t)]), powers)[1:]))]
    together = list(zip(*(c.tolist() for c in suffix_dedup.runs(b"".join(texts), np.array([len(t) for t in texts]), powers))))
    assert [r[:4] for r in together] == [r[:4] for r in alone]
    assert all(t[4] or not a[4] for t, a in zip(together, alone))
    for k, t in enumerate(texts):
        assert [w for of, _, start, n, _ in together if of == k for w in range(start, start + n)] == list(range(len(t) - 99))


def test_suffix_copies_share_a_place():
    """A string that comes twice with the same place (equal rows) is not a repeat of itself."""
    one, two = prose(4, 60).encode()[:200], prose(5, 60).encode()[:150]
    row = lambda *docs: (np.array(docs), np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64))
    assert len(suffix_dedup.repeated_windows(*row(1, 1, 2), [one, one, two])[0]) == 0
    owner, at, n = suffix_dedup.repeated_windows(*row(2, 2, 1), [one, one, one[20:]])
    assert owner.tolist() == [0, 1] and at.tolist() == [20, 20] and n.tolist() == [81, 81]


def test_suffix_equal_rows_list_an_interval_once(spark):
    text = bytearray(prose(6, 90).encode())
    found = suffix_dedup.listed(spark.createDataFrame([(1, 1, text)] + [(2, 1, text)] * 40, "doc long, th long, text binary")).collect()
    assert [r.d for r in found] == [2]
    assert len(found[0].found) == len({(w.start, w.n) for w in found[0].found}) < 40


def test_suffix_dedup_odd_rows(spark, odd):
    found = suffix_dedup.dedup(odd).collect()
    assert len(found) == odd.count()
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append((r.n_bytes, r.n_removed))
    assert by[2][0][0] == by[2][0][1] and by[3] == [(0, 0)] and len(set(by[8])) == 1


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "hello"), (1, 3, "ann lee", None), (2, 0, "system", "alone"), (None, 0, None, "x"), (3, None, "user", "a"), (3, 300, "user", "b"), (3, 300, "user", "b"), (4, 0, "a b", "x"), (4, 1, "a_b", "y"), (4, 2, "", "z" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("size", F.lit("x"))
    found = chat.perspectives(turns).collect()
    assert {(r.conv_id, r.perspective) for r in found} == {(1, "user"), (1, "assistant"), (1, "ann lee"), (None, "unknown"), (3, "user"), (4, "a b"), (4, "a_b"), (4, "")}
    assert len({r.segment.split("\n")[0] for r in found if r.conv_id == 4}) == 4
    for key in {(r.conv_id, r.perspective) for r in found}:
        mine = sorted((r for r in found if (r.conv_id, r.perspective) == key), key=lambda r: r.position)
        whole = "".join(r.segment for r in mine)
        assert [r.position for r in mine] == list(range(len(mine)))
        for r in mine:
            assert whole[r.start : r.end] == r.segment
            covered = whole[r.loss_start : r.loss_end]
            assert covered == ((r.segment.split("\n", 1)[1][:-1]) if r.role == r.perspective else "")
    one = "".join(r.segment for r in sorted((r for r in found if r.perspective == "assistant"), key=lambda r: r.position))
    assert one == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=user\nhi <​|im_end|><|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user name=ann+lee\n<|im_end|>\n"
    assert chat.perspectives(turns.limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site of the best</a></header><nav><ul><li><a href=1>One</a></ul></nav>
<div id="cookie-notice">We use cookies and it is for the best of you and of the site and all of us here.</div>
<div class="post"><h1>Title &amp; more</h1><p>This is the   first paragraph of the article&nbsp;that is long enough to be seen as the main text of it.<p>Short one.
<script>document.write("</div><p>the of and to")</script><div class="ad">Buy now the thing of the year and be happy with it all of the time</div>
<p>Another one &#233; with a <a href=x>link</a> in it and <b>bold</b> text that is of the same kind as the one that was before it.</p></div>
<section class="comments"><p>I think that this is the best of the articles that I have read and it was good for me.</p></section><footer>The end of it &copy;</footer>"""


def test_html_blocks():
    assert html_extract.main_text(PAGE).split("\n") == [
        "Title & more", "This is the first paragraph of the article that is long enough to be seen as the main text of it.", "Short one.",
        "Another one é with a link in it and bold text that is of the same kind as the one that was before it.",
    ]
    assert html_extract.main_text("<article><p>Hi</p></article><footer>x</footer>") == "Hi"
    for odd in (None, "", "<", "<p", "plain", "<!-- open", "<script>never closed", "<a href=x>" * 50, "&#xFFFFFFF; &bogus;", "<div " + "x" * 5000):
        html_extract.main_text(odd)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "", ""), (4, "v", "<p>" + "the of and to in is " * 20_000 + "</p>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    found = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert found[2].text == "" and found[None].n_chars == 0 and found[4].n_chars == len(found[4].text) == 399_999
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_language_id(spark, odd, empty):
    words = {"en": "the and that with from this have", "fr": "les des une dans pour est avec", "de": "der und nicht mit ein eine auch"}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(words[lang].split(), k=40)), lang) for k in range(200) for lang in words]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)] + [(900, None, "en"), (901, "12 !?", "de"), (902, "x", None)]
    found = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[k].lang_pred == lang for k, t, lang in rows[:600]) and found[900].lang_pred == found[901].lang_pred == "und"
    assert found[902].lang_pred in words and all(0 <= r.score <= 1 for r in found.values())
    assert {k for k, r in found.items() if r.held_out} == {k for k in found if zlib.crc32(str(k).encode()) % 5 == 0}
    assert langid.predict(odd).count() == odd.count() and langid.predict(empty).count() == 0


def test_quality_rules(spark, odd, empty, labels):
    texts = [(k, prose(k, 60)) for k in range(40)] + [(100 + k, " ".join(f"{w}%%%" for w in prose(k, 60).split())) for k in range(20)] + [(200, "again and again we go on and on " * 5), (201, "a # b\n\na # b\n c\n"), (202, None), (203, "too short")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(40)], "doc_id long")
    found = {r.doc_id: r for r in rules.judge(docs, trusted).collect()}
    for k, text in texts:
        words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        windows = collections.Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        covered = {j + i for j in range(len(words) - 7) if windows[tuple(words[j : j + 8])] > 1 for i in range(8)}
        lines = [x for x in (text or "").split("\n") if x.strip()]
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
    assert all(found[k].kept for k in range(40)) and not any(found[100 + k].kept for k in range(20))
    assert rules.judge(odd, labels).count() == odd.count() and rules.judge(empty, labels).count() == 0
    assert all(r.llr == 0 for r in rules.judge(odd, labels.limit(0)).collect())


def test_all_trusted_rows_are_counted(spark, monkeypatch):
    monkeypatch.setattr(rules, "TRUSTED", 1, raising=False)
    docs = spark.createDataFrame([(k, f"a{k} b{k}") for k in range(6)], "doc_id long, text string")
    assert set(rules.weights(docs, docs.select("doc_id"))) == {0}  # all are trusted: equal counts


def test_quality_classifier(spark, odd, empty, labels):
    rows = [(k, prose(k, 60) if k % 3 else " ".join(f"{w.upper()}!!" for w in prose(k, 60).split())) for k in range(300)]
    docs = spark.createDataFrame([*rows, (300, ""), (301, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(5, None)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.classify(docs, marks).collect()}
    assert all(found[k].predicted == int(k % 3 > 0) for k in range(300)) and all(0 <= r.score <= 1 for r in found.values()) and len(found) == 302
    kept = {r.doc_id for r in quality.accepted(docs, marks).collect()}
    assert kept == {k for k, r in found.items() if r.predicted}
    assert quality.classify(odd, labels).count() == odd.count() and quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(odd, labels.limit(0)).columns == odd.columns


def test_isotonic_does_not_fall():
    at, rate = quality.isotonic(np.arange(6.0), np.array([1, 0, 2, 1, 3, 3.0]), np.array([2, 2, 3, 3, 3, 3.0]))
    assert (np.diff(rate) >= 0).all() and np.isclose(rate[0], 0.25)


def brute_chunks(lines):
    """Chunk boundaries by the stated rule, line by line."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % line_dedup.PRIME for x in lines]
    r = [(a * line_dedup.BASE + b) % line_dedup.PRIME for a, b in zip(h, h[1:])]
    ends = [j + 2 for j in range(1, len(r) - 1) if r[j] < r[j - 1] and r[j] < r[j + 1]] + [len(lines)]
    return list(zip([0, *ends], ends))


def alike(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_line_dedup(rows):
    """The texts after removal, by row key; `rows` (place, text) in the order that decides which occurrence stays."""
    first, out = {}, {}
    for place, text in sorted(rows):
        lines, gone = (text or "").split("\n"), set()
        chunks = brute_chunks(lines)
        for k, (a, b) in enumerate(chunks):
            body = "\n".join(lines[a:b])
            if b - a < 2 or not body.strip(" \t\n\x0b\x0c\r"):
                continue
            before = lines[max(0, chunks[k - 1][0] - line_dedup.REACH) : a][::-1] if k else []
            after = lines[b : chunks[k + 1][1]] if k + 1 < len(chunks) else []
            if body not in first:
                first[body] = before, after
            else:
                gone |= set(range(a - alike(before, first[body][0]), b + alike(after, first[body][1])))
        out[place] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_line_dedup_equals_brute_force(spark, monkeypatch, limit):
    from skaldic.llm import common

    monkeypatch.setattr(common, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(line_dedup, "SPREAD", 1024 if limit else 2)
    rng, passages = random.Random(3), [[prose(70 + k, 6) for k in range(j, j + 9)] for j in (0, 9, 18)]
    texts = []
    for k in range(40):
        lines = [prose(1000 + 50 * k + j, 5) for j in range(rng.randrange(8))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = p
        texts.append((rng.choice([k, k, 7, None]), "\n".join(lines)))
    texts += [(90, texts[3][1]), (90, texts[3][1] + "\nmore"), (None, texts[3][1]), (None, texts[4][1] + "\nx\ny")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    keys = {(r.doc_id, r.text): r.th for r in docs.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()}
    place = lambda d, t: (d is not None, d or 0, keys[d, t])
    wanted = brute_line_dedup({(place(*r), r[1]) for r in texts})
    found = collections.Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).select("doc_id", "text").collect())
    assert found == collections.Counter((d, wanted[place(d, t)]) for d, t in texts)
    assert sum(t != wanted[place(d, t)] for d, t in texts) > 10


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_one_of_each_tells_rows_of_one_doc_id_apart(spark, monkeypatch, limit):
    from skaldic.llm import common

    monkeypatch.setattr(common, "BROADCAST_KEYS", limit)
    copy, unique, other, third = prose(501, 50), prose(502, 50), prose(503, 50), prose(504, 50)
    rows = [(1, copy), (2, copy), (2, unique), (3, other), (3, third), (4, other.upper()), (5, third + " end"), (6, third + " end"), (None, copy), (7, ""), (8, None), (9, unique)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, __row string, node int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter([(1, copy), (2, unique), (3, other), (3, third), (None, copy), (7, "")])


def test_similar_groups_equal_brute_force_on_near_copies(spark):
    rng, texts = random.Random(8), []
    for k in range(30):
        words = prose(600 + k, 120).split()
        for c in range(4):
            copy = words.copy()
            for at in rng.sample(range(120), c):
                copy[at] = f"z{k}q{c}"
            texts.append((4 * k + c, " ".join(copy)))
    wanted = near_groups(texts)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == wanted


@pytest.mark.parametrize("crowd", [48, 2])
def test_pivot_tables_alone_find_every_link_at_two_bits(spark, monkeypatch, crowd):
    """Without any min-hash key, the groups are those of all pairs at 2 bits and Jaccard 0.8."""
    sketch = simhash._sketch

    def keyless(shingle):
        def run(batches):
            for batch in sketch(shingle)(batches):
                none = pa.array([[]] * len(batch), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], none], batch.schema.names)

        return run

    monkeypatch.setattr(simhash, "_sketch", keyless)
    rng, texts = random.Random(12), []
    for k in range(12):
        words = prose(800 + k, 900).split()
        for c in range(6):
            copy = words.copy()
            if c > 3:  # the opening words once more: a few shingles more
                copy += words[: 5 * c]
            elif c:
                copy[rng.randrange(900)] = f"y{k}x{c}"
            texts.append((6 * k + c, " ".join(copy)))
    sets = [(k, set(zip(*[t.split()[j:] for j in range(5)]))) for k, t in texts]
    fps = {k: simhash.majority(np.unique(simhash.shingles(t.encode(), 5))) for k, t in texts}
    wanted = brute_groups([(k, (s, fps[k])) for k, s in sets], lambda x, y: (x[1] ^ y[1]).bit_count() <= 2 and len(x[0] & y[0]) >= 0.8 * len(x[0] | y[0]))
    assert 12 <= len(set(wanted.values())) < 50
    found = simhash.similar_groups(spark.createDataFrame(texts, "doc_id long, text string"), crowd=crowd)
    assert {r.doc_id: r.component_id for r in found.collect()} == wanted


def brute_overlaps(texts, items):
    """Items of each document by laying every item over every place."""
    out = {}
    toks = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    for doc, text in texts:
        d, out[doc] = toks(text), []
        for item, content in items:
            b = toks(content)
            n, run = len(b), min(len(b), 13)
            most = 0 if n < 8 else 1 if n < 13 else 2
            for at in range(-n + 1, len(d)):
                same = [0 <= at + k < len(d) and d[at + k] == b[k] for k in range(n)]
                if n and any(sum(same[s : s + run]) >= run - most for s in range(n - run + 1)):
                    out[doc].append(item)
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    rng = random.Random(12)
    items = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(n))) for k, n in enumerate([1, 2, 3, 5, 6, 7, 8, 8, 9, 12, 13, 14, 20, 30])] + [(50, ""), (51, None), (52, "--")]
    texts = []
    for k in range(120):
        words = [f"x{rng.randrange(40)}" for _ in range(rng.randrange(30))]
        if k % 4:
            b = items[rng.randrange(14)][1].split()
            for at in rng.sample(range(len(b)), min(len(b), rng.randrange(4))):
                b[at] = "other"
            cut = b[rng.randrange(3) :] if k % 3 == 0 else b
            words[len(words) // 2 : len(words) // 2] = cut
        texts.append((k, " ".join(words)))
    docs, bench = spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_overlaps, list(r["items"])) for r in decontaminate.flag(docs, bench).collect()}
    wanted = brute_overlaps([*texts, (900, None), (901, "")], items)
    assert found == {k: (len(v), sorted(set(v))) for k, v in wanted.items()} and sum(map(bool, wanted.values())) > 30


def test_decontamination_tells_rows_of_one_doc_id_apart(spark):
    item = prose(77, 20)
    docs = spark.createDataFrame([(1, item), (1, "clean text"), (None, item), (None, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted(((r.doc_id or 0), r.text) for r in decontaminate.clean(docs, bench).collect()) == [(0, "clean"), (1, "clean text")]


def test_normal_equations_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(quality, "FAN", 2)
    rows = [(k, prose(k, 20 + k % 7) if k % 3 else prose(k, 9).upper()) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    marks = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(120)], "doc_id long, quality int")
    model = quality.fit(quality.document_stats(docs), marks)
    folds = {k: zlib.crc32(str(k).encode()) % 5 for k, _ in rows}
    train = [(quality.statistics(t.encode()).astype(np.float32).astype(float), k % 3 > 0, folds[k]) for k, t in rows if folds[k]]
    x = np.array([a for a, _, _ in train])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum((x * x).mean(0) - x.mean(0) ** 2, 1e-6)))
    z = model.features(np.array([a for a, _, f in train if f != 4]))
    y = np.array([b for _, b, f in train if f != 4], float)
    assert np.allclose(model.ridge, np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y), atol=1e-6)


def test_ratios_and_threshold_equal_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(rules, "BUCKETS", 50)
    texts = [(k, prose(k, 30 + k)) for k in range(30)] + [(100 + k, " ".join(f"{w}%" for w in prose(k, 40).split())) for k in range(10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(25)], "doc_id long")
    pairs = sorted({(w, None) for _, t in texts for w in t.split()} | {p for _, t in texts for p in zip(t.split(), t.split()[1:])}, key=str)
    one = {r.w: r.b for r in spark.createDataFrame([(w,) for w, v in pairs if v is None], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(50)).alias("b")).collect()}
    two = {(r.w, r.v): r.b for r in spark.createDataFrame([p for p in pairs if p[1] is not None], "w string, v string").select("w", "v", F.pmod(F.xxhash64("w", "v"), F.lit(50)).alias("b")).collect()}
    grams = {k: [one[w] for w in t.split()] + [two[p] for p in zip(t.split(), t.split()[1:])] for k, t in texts}
    good, raw = collections.Counter(b for k in range(25) for b in grams[k]), collections.Counter(b for g in grams.values() for b in g)
    n_good, n_raw = sum(good.values()) + 50, sum(raw.values()) + 50
    table = [round(1e6 * (np.log((good[b] + 1) / n_good) - np.log((raw[b] + 1) / n_raw))) for b in range(50)]
    llr = {k: sum(table[b] for b in g) / 1e6 / len(g) for k, g in grams.items()}
    least = np.floor(min(llr[k] * 1000 for k in range(25))) / 1000
    found = {r.doc_id: r for r in rules.judge(docs, trusted).collect()}
    assert all(abs(found[k].llr - llr[k]) < 1e-5 for k in llr)
    assert {k for k, r in found.items() if r.kept} == {k for k in llr if not found[k].base_failed and llr[k] >= least}


def test_sequences_reach_the_bound(spark):
    rng = random.Random(6)
    for trial in range(6):
        counts = collections.Counter(min(2048, 1 + int(rng.expovariate(1 / 300))) for _ in range(3000))
        used = sum(t for _, t in packing.plan_sequences(counts, 2048))
        bound = -(-sum(n * k for n, k in counts.items()) // 2048)
        assert bound <= used <= bound + 1


def test_dictionaries_hold_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "DICTIONARY", 100)
    monkeypatch.setattr(langid, "CHARS", 50)
    rows = [(k, f"alpha beta gamma{chr(97 + k)} " * (1 + k % 3), "en") for k in range(20)] + [(30, "x" * 60, "de"), (31, "y" * 40, "de"), (32, "y" * 40, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.dictionaries(docs, F.lit(True))
    assert found["de"] == b"y" * 40 and len(found["en"]) <= 100
    parts = {langid.letters(t) for _, t, lang in rows if lang == "en"}
    rest = found["en"]
    for part in sorted(parts, key=len, reverse=True):
        rest = rest.replace(part, b"", 1)
    assert not rest.strip()
    tie = langid.identify(spark.createDataFrame([(1, "zz")], "doc_id long, text string"), {"b": b"same words", "a": b"same words"}).first()
    assert tie.lang_pred == "b" and tie.rejected


LONG_TEXT = "this is the text of the article and it is as long as it has to be to be taken for what it is by all of the rules that there are for it"


@pytest.mark.parametrize(
    "page, wanted",
    [
        (f"<div><p>{LONG_TEXT} one</p><article><p>Teaser</p></article><p>{LONG_TEXT} two</p></div>", [f"{LONG_TEXT} one", "Teaser", f"{LONG_TEXT} two"]),
        (f"<div class='post tags-news'><h1>Head</h1><p>{LONG_TEXT}</p></div>", ["Head", LONG_TEXT]),
        (f"<div class='search results'><h1>Head</h1><p>{LONG_TEXT}</p></div>", ["Head", LONG_TEXT]),
        (f"<table><tr><td class='sidebar'><p>{LONG_TEXT} side</p><p>{LONG_TEXT} side two</p><td><p>{LONG_TEXT}</p><p>{LONG_TEXT} two</p><p>{LONG_TEXT} three</p></table>", [LONG_TEXT, f"{LONG_TEXT} two", f"{LONG_TEXT} three"]),
        (f"<ul><li class='ad'><div>{LONG_TEXT} buy</div><div>{LONG_TEXT} now</div><li><div>{LONG_TEXT}</div><div>{LONG_TEXT} too</div></ul>", [LONG_TEXT, f"{LONG_TEXT} too"]),
        (f"<div>{LONG_TEXT}</div><div class='postComments'>" + f"<p>{LONG_TEXT} I think</p>" * 9 + "</div>", [LONG_TEXT]),
        (f"<main><h1>Head</h1><p>Short.</p></main><div class='site-footer'>{LONG_TEXT}</div>", ["Head", "Short."]),
        (f"<p>{LONG_TEXT}</p><p class='widget'>{LONG_TEXT} w</p><p hidden>{LONG_TEXT} h</p><p>{LONG_TEXT} end</p>", [LONG_TEXT, f"{LONG_TEXT} end"]),
    ],
)
def test_html_pages(page, wanted):
    text = html_extract.main_text(page)
    assert [x for x in text.split("\n") if x != "Teaser"] == [x for x in wanted if x != "Teaser"]


def brute_inherit(found, void):
    """The second pass by looking from every open block to every decided one."""
    out = []
    for k, b in enumerate(found):
        if b.label:
            out.append(b.label)
            continue
        near = [j for j, x in enumerate(found) if x.label and not x.bad and all(m in void for m in x.marked) and x.main == b.main]
        left, right = max((j for j in near if j < k), default=None), min((j for j in near if j > k), default=None)
        if b.main and left is None and right is None:
            out.append("good")
            continue
        edge = "good" if b.main else "bad"
        x = (k - left, found[left].label) if left is not None else (k + 1, edge)
        y = (right - k, found[right].label) if right is not None else (len(found) - k, edge)
        out.append(x[1] if x[1] == y[1] else y[1] if b.heading else min(x, y)[1] if x[0] != y[0] else edge)
    return out


def test_html_second_pass_equals_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        found = [html_extract.Block("x", 0, False, rng.choice([0, 0, 1, 2]), rng.random() < 0.2, rng.choice([(), (), (1,), (2,)]), rng.choice(["", "", "good", "bad"])) for _ in range(rng.randrange(12))]
        for b in found:
            b.bad = b.label == "bad" and rng.random() < 0.3
        wanted = brute_inherit(found, {1})
        html_extract.inherit(found, {1})
        assert [b.label for b in found] == wanted


def test_html_long_and_repeated_pages(spark):
    import time

    began = time.process_time()
    text = html_extract.main_text("".join(f"<div><p>Short {k}<li>x" for k in range(50_000)) + "</b>" * 50_000 + f"<p>{LONG_TEXT}")
    assert LONG_TEXT in text and time.process_time() - began < 30
    pages = spark.createDataFrame([(1, "u", PAGE)] * 3 + [(1, "u", f"<p>{LONG_TEXT}")], "page_id long, url string, html string")
    rows = html_extract.extract(pages).collect()
    assert len(rows) == 4 and len({r.text for r in rows}) == 2


def test_remembered_words_equal_the_tokenizer(monkeypatch):
    rng = random.Random(11)
    for cache in (400_000, 50):
        monkeypatch.setattr(packing, "CACHE", cache)
        encoder = packing.WordEncoder(word_bpe())
        for _ in range(300):
            words = ["".join(rng.choice("abcdefghiéßäøµªº") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", ".", ",", "!", "'s", "...", "9", "-x", "?."]) for _ in range(rng.randrange(40))]
            text = " ".join(rng.choice([w, w.upper(), w.title()]) for w in words)
            assert encoder.encode(text) == encoder.whole(text), text


def test_idle_encoders_go(monkeypatch):
    """An encoder stays for a task that follows at once and is dropped when none does."""
    monkeypatch.setattr(packing, "IDLE", 0.3)
    path = word_bpe()
    with packing.lent(path) as first:
        first.encode("one word")
    with packing.lent(path) as second:
        assert second is first
        time.sleep(0.6)
        assert packing._ENCODERS[path] is first
    time.sleep(0.9)
    assert path not in packing._ENCODERS


def test_latin_words_need_only_the_tokenizers_model():
    """All pairs of Latin-1 characters within a word, without a call of the tokenizer's normalizing and splitting."""
    encoder, other = packing.WordEncoder(word_bpe()), packing.WordEncoder(word_bpe())
    encoder.tokenizer = None
    some = [chr(c) for c in range(256)]
    for a in some:
        text = " ".join(f"{a}{b} q{a}{b}s" for b in some if a + b != "<|")
        assert encoder.encode(text) == other.whole(text), repr(a)

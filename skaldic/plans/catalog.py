"""Every registered query over the driver's tables, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import udfs
from ..operators import completions, conjugation, declension, diacritics, ingest, morphology, ocr
from ..sources import tei
from ..storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("""
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents),
     known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark)
SELECT token, count(*) AS n FROM t WHERE length(token) > 2 AND token NOT IN (SELECT token FROM known) GROUP BY token""")
def unknown_token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lambda table: read(spark, sf_dir, table).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    counts = tokens("documents").where(F.length("token") > 2).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(tokens("benchmark").distinct(), "token", "left_anti")


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233)"
LINES = f"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents WHERE text IS NOT NULL), t AS (SELECT *, trim(line, {WS}) AS t FROM l)"
NUMBER = r"regexp_full_match(t, '[\[(]?\d+[\])\.]?')"
HEADING = r"(t <> '' AND (regexp_matches(t, '^[IVXLCDM]+\.?(\s+|$)') OR (length(t) >= 3 AND upper(t) = t AND NOT regexp_matches(t, '[0-9]')) OR regexp_matches(t, '^(Cap\.|CAP\.|Chapter\b|CHAPTER\b)') OR regexp_matches(t, '^(?:A\.D\.|AD)\s*\d{3,4}\b') OR regexp_matches(t, '^Her\s+\d{3,4}\b')))"
VERSE = f"(length(t) <= 80 AND (starts_with(line, '    ') OR length(t) < 20 OR NOT (ends_with(t, '.') AND NOT contains(t, '  '))))"
WORDS = r"unnest(regexp_extract_all(line, '\p{L}+(?:[-–—]\p{L}+)*')) AS word, generate_subscripts(regexp_extract_all(line, '\p{L}+(?:[-–—]\p{L}+)*'), 1) AS word_number"
KEY = r"regexp_replace(strip_accents(replace(lower(word), 'ð', 'þ')), '[-–—]', '', 'g')"
VOWELS, CONSONANTS = S.VOWEL, S.CONSONANT


def _lines(spark, sf_dir):
    return ingest.lines(read(spark, sf_dir, "documents"))


@query(f"WITH {LINES} SELECT doc_id, line_number, CASE WHEN t = '' THEN 'blank' WHEN {HEADING} THEN 'heading' WHEN {NUMBER} THEN 'number' WHEN {VERSE} THEN 'verse' ELSE 'prose' END AS line_class FROM t")
def line_classes(spark, sf_dir):
    """First-match classification of every line."""
    return ingest.classify_lines(_lines(spark, sf_dir)).select("doc_id", "line_number", "line_class")


@query(f"WITH {LINES}, w AS (SELECT doc_id, line_number, {WORDS} FROM t) SELECT doc_id, line_number, word_number, word FROM w")
def token_positions(spark, sf_dir):
    """Lexical tokens with line and word numbers from 1."""
    return diacritics.tokens(read(spark, sf_dir, "documents"))


@query("""
WITH c AS (SELECT conv_id, turn, role, (role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS fresh FROM conversations),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
SELECT conv_id, run::BIGINT AS run, min(role) AS role, min(turn) AS first_turn, count(*) AS turns FROM r GROUP BY conv_id, run""")
def speaker_runs(spark, sf_dir):
    """Runs of turns by one speaker."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumn("fresh", (~F.col("role").eqNullSafe(F.lag("role").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(w))
    return rows.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events QUALIFY carried IS NOT NULL")
def carry_forward(spark, sf_dir):
    """The last heading-like event so far, carried to each event of a user."""
    rows = read(spark, sf_dir, "events").withColumn("head", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return ingest.gap_fill(rows, "user_id", "event_id", "head").select("event_id", "carried").where("carried is not null")


@query(rf"""WITH s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(trim(text, {WS}), '([.?!]["'')]?)\s+', '\1' || chr(1), 'g'), chr(1))), {WS}) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_chars FROM s WHERE s <> '' GROUP BY doc_id""")
def sentence_counts(spark, sf_dir):
    """Sentences of every document."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(S.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


_WORD = r"\p{L}+(?:[-–—]\p{L}+)*"
_INDEX = f"v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM documents), i AS MATERIALIZED (SELECT {KEY} AS key, list_sort(list(DISTINCT lower(word))) AS forms FROM v GROUP BY 1)"


def _index(spark, sf_dir):
    """Spellings of all documents: different words are found before they are normalised."""
    words = diacritics.words(read(spark, sf_dir, "documents")).distinct()
    return diacritics.build_index(words.select(S.normalize_old_english(F.col("word")).alias("key"), F.lower("word").alias("form")))


@query(f"WITH {_INDEX} SELECT key, array_to_string(forms, ',') AS forms, len(forms) > 1 AS is_ambiguous FROM i")
def spelling_index(spark, sf_dir):
    """Key to spellings over all documents."""
    return _index(spark, sf_dir).withColumn("forms", F.array_join("forms", ","))


@query(f"""WITH {_INDEX}, w AS (SELECT conv_id, unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM conversations), k AS (SELECT conv_id, {KEY} AS key FROM w)
SELECT conv_id, count(*) AS tokens, count(*) FILTER (len(forms) = 1) AS restored, count(*) FILTER (len(forms) > 1) AS ambiguous, count(*) FILTER (forms IS NULL) AS unknown
FROM k LEFT JOIN i USING (key) GROUP BY conv_id""")
def index_lookup(spark, sf_dir):
    """Tokens of every conversation against the index of all documents: ambiguous wins over unique, a miss is unknown."""
    return diacritics.lookup_counts(read(spark, sf_dir, "conversations"), _index(spark, sf_dir), "conv_id")


@query()
def restored_texts(spark, sf_dir):
    """Every text with diacritics restored from the spellings of all documents; checked by tests, as the rules need lookbehind."""
    return diacritics.restore(read(spark, sf_dir, "documents"), _index(spark, sf_dir))


@query(f"""WITH {_INDEX}, words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS word FROM benchmark), added AS (SELECT {KEY} AS key, max(lower(word)) AS form FROM words GROUP BY 1),
ok AS MATERIALIZED (SELECT a.key, a.form FROM added a LEFT JOIN i USING (key) WHERE i.key IS NULL OR len(i.forms) = 1)
SELECT i.key, array_to_string(forms, ',') AS forms, len(forms) > 1 AS is_ambiguous FROM i LEFT JOIN ok USING (key) WHERE ok.key IS NULL UNION ALL SELECT key, form, false FROM ok""")
def index_add(spark, sf_dir):
    """Forms of the benchmark added with force: ambiguous keys stay as they are."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"))).alias("word")).distinct()
    added = words.select(S.normalize_old_english(F.col("word")).alias("key"), F.lower("word").alias("form")).distinct()
    return diacritics.add_forms(stored(_index(spark, sf_dir)), added, force=True).withColumn("forms", F.array_join("forms", ","))


@query(f"WITH {_INDEX} SELECT key FROM i WHERE len(forms) > 1 AND key NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark)")
def unresolved_keys(spark, sf_dir):
    """Ambiguous keys without the completed ones."""
    done = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("key")).distinct()
    return diacritics.unresolved(_index(spark, sf_dir), done)


@query("SELECT p_brand, p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS order_index FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1)")
def keep_first(spark, sf_dir):
    """The first part of each brand and type, numbered anew."""
    return diacritics.keep_first(read(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey").select("p_brand", "p_partkey", "p_name", "order_index")


@query("SELECT p_type, count(*) AS n, min(p_partkey) AS first_seen, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS place FROM part GROUP BY p_type")
def most_common(spark, sf_dir):
    """Frequency order, ties by first occurrence."""
    rows = read(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_seen"))
    rows = morphology.numbered(rows.withColumn("down", -F.col("n")), ["down", "first_seen"])
    return rows.select("p_type", "n", "first_seen", (F.col("counter") + 1).alias("place"))


@query("SELECT o_custkey, arg_min(o_orderkey, {'a': o_orderstatus <> 'F', 'b': o_totalprice, 'c': o_orderkey}) AS candidate FROM orders GROUP BY o_custkey")
def best_candidate(spark, sf_dir):
    """Min-by over a pass flag, then a cost."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("candidate"), (F.col("o_orderstatus") == "F").alias("quality_pass"), F.lit(0).alias("failed"), F.col("o_totalprice").alias("mean_s"))
    return ocr.best(rows, ["o_custkey"])


@query("SELECT d.source, d.lang, coalesce(min(l.quality), -1) AS confidence, count(l.quality) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def minimum_rollup(spark, sf_dir):
    """The least value that is not null."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source", "lang").agg(F.coalesce(F.min("quality"), F.lit(-1)).alias("confidence"), F.count("quality").alias("n"))


@query("""WITH o(lang, max_cer, max_wer, min_thorn) AS (VALUES ('fr', 0.5, NULL, 0.6), ('de', 0.02, 0.9, NULL)),
r AS (SELECT doc_id, lang, (n_chars % 100) / 100.0 AS cer, (n_chars % 37) / 37.0 AS wer, (n_chars % 11) / 10.0 AS thorn, (n_chars % 7) / 7.0 AS to_p, (n_chars % 5) / 4.0 AS macron FROM documents)
SELECT doc_id, cer <= coalesce(max_cer, 0.8) AND wer <= coalesce(max_wer, 0.7) AND thorn >= coalesce(min_thorn, 0.2) AND to_p <= 0.9 AND macron >= 0.25 AS quality_pass FROM r LEFT JOIN o USING (lang)""")
def quality_gate(spark, sf_dir):
    """Five measures against the limits of a group, or the default limits."""
    part = lambda m, d, name: ((F.col("n_chars") % m) / float(d)).alias(name)
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", part(100, 100, "cer"), part(37, 37, "wer"), part(11, 10, "thorn_recall"), part(7, 7, "thorn_to_p_rate"), part(5, 4, "macron_recall"))
    limits = spark.createDataFrame([("fr", 0.5, None, 0.6, None, None), ("de", 0.02, 0.9, None, None, None)], "lang string, max_cer double, max_wer double, min_thorn_recall double, max_thorn_to_p_rate double, min_macron_recall double")
    return ocr.gate(rows, limits, "lang", {"max_cer": 0.8, "max_wer": 0.7, "min_thorn_recall": 0.2, "max_thorn_to_p_rate": 0.9, "min_macron_recall": 0.25}).select("doc_id", "quality_pass")


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_distance(spark, sf_dir):
    """Character edit distance of neighbouring names (ASCII)."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(after, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").cast("long").alias("distance"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(text, 'ſ', 's'), '(?m)^\s*S\s*(\d{1,3})\.\s*', '§ \1. ', 'g'), '(?m)^\s*5\s*(\d{1,3})\.\s*', '§ \1. ', 'g'),
  chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents""")
def ordered_rules(spark, sf_dir):
    """Ordered substitutions, each on the result of the one before."""
    return ocr.clean(read(spark, sf_dir, "documents")).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?is)<pre[^>]*>(.*?)</pre>', 1))::INT AS n_pre FROM pages")
def page_titles(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(?is)<pre[^>]*>(.*?)</pre>"), F.lit(1))).alias("n_pre"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, json_valid(props) AS is_json FROM events")
def event_fields(spark, sf_dir):
    """A field out of JSON text."""
    key = F.json_object_keys("props")[0]
    value = F.element_at(F.from_json("props", "map<string,string>"), key)
    return read(spark, sf_dir, "events").select("event_id", value.alias("first_value"), F.json_object_keys("props").isNotNull().alias("is_json"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS xs, avg(value) AS m, stddev_pop(value) AS d, median(value) AS md FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, len(xs)::BIGINT AS n, round(m, 4) AS mean_s, round(md, 4) AS median_s, round(d, 4) AS stdev_s, xs[floor(0.95 * (len(xs) - 1))::INT + 1] AS p95_s, round(CASE WHEN m > 0 THEN 60 / m ELSE 0 END, 4) AS pages_per_min FROM s""")
def latency_stats(spark, sf_dir):
    """Mean, median, floor-index p95 and deviation by group."""
    out = ocr.latencies(read(spark, sf_dir, "events").where("value is not null"), ["event_type"], "value")
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean_s", "median_s", "stdev_s")], "p95_s", F.round("pages_per_min", 4).alias("pages_per_min"))


_WORDS = "w AS (SELECT p_partkey AS nid, lower(regexp_extract(p_name, '([A-Za-z]+)$', 1)) AS stem FROM part)"


def _words(spark, sf_dir):
    stem = F.lower(F.regexp_extract("p_name", "([A-Za-z]+)$", 1))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), stem.alias("title"), stem.alias("stem"), F.lit("0").alias("prefix"), F.lit("").alias("wright"))


_DOUBLE = "[bcdfghjklmnpqrstvwxz]"
_REDUCED = "regexp_replace(" * 20 + "formi" + "".join(f", '{c}{c}', '{c}', 'g')" for c in "bcdfghjklmnpqrstvwxz")
_V, _C = S.VOWEL, S.CONSONANT
_syllables = lambda x: f"(len(regexp_extract_all({x}, '{_V}{_C}')) + len(regexp_extract_all({x}, '{_V}$')))"
_twice = lambda x: "regexp_replace(" * 20 + x + "".join(f", '{c}{c}$', '{c}')" for c in "bcdfghjklmnpqrstvwxz")
_short = lambda x: f"CASE WHEN {_syllables(x)} > 1 THEN regexp_replace({x}, '{_V}({_C})$', '\\1') ELSE {x} END"
_fronted = lambda x: f"regexp_replace({x}, 'o({_C})$', 'e\\1')"
_cut = lambda x: f"regexp_replace(stem, '{x}$', '')"
_some = lambda first, *more: f"list_filter([{first}, {', '.join(f'CASE WHEN {m} <> {first} THEN {m} END' for m in more) or 'NULL'}], lambda q: q IS NOT NULL AND q <> '')"
_again = lambda x: f"list_concat({x}, ({x})[2:])"
_bare = f"regexp_replace({_cut('e')}, '[hH]$', '')"
#: The stems of each builder as SQL.
_BUILDERS = {
    "plain": _some("stem"), "geminate": _some("stem", _twice("stem")), "syncope": _some(_bare, _short(_bare)), "plural": _some(_bare, _twice(_bare), _short(_bare), _fronted(_bare)),
    "plural_again": _again(_some(_bare, _twice(_bare), _short(_bare), _fronted(_bare))), "oblique": _some(_bare, _short(_bare), _fronted(_bare)), "short": _some("stem", _short("stem")),
    "short_e": _some(_cut("e"), _short(_cut("e"))), "short_u": _some(_cut("u"), _short(_cut("u"))), "plural_u": _some(_cut("u"), _short(_cut("u")), _twice(_cut("u"))),
    "plural_u_again": _again(_some(_cut("u"), _short(_cut("u")), _twice(_cut("u")))), "back": _some("stem", "translate(stem, 'æǣ', 'aā')"),
    "drop_e": _some(_cut("e")), "drop_u": _some(_cut("u")), "drop_a": _some(_cut("a")), "drop_uw": _some(_cut("[uw]")),
}
_TABLES = list(morphology.NOUN_ENDINGS)
_SHAPES = ["stan", "hoppa", "cyneh", "rice", "bearu", "heofon", "mann"]
_NOUNS = f"w AS (SELECT p_partkey AS nid, {_TABLES}[p_partkey % {len(_TABLES)} + 1] AS name, lower(regexp_extract(p_name, '([A-Za-z]+)$', 1)) || {_SHAPES}[p_partkey % {len(_SHAPES)} + 1] AS stem FROM part)"


@query(f"""WITH {_NOUNS}, e(name, step, builder, ord, function, ending) AS (VALUES {", ".join(f"('{n}', {k}, '{b}', {j}, '{f}', '{x}')" for n, k, b, es in morphology.steps() for j, f, x in es)}),
t AS (SELECT DISTINCT name, step, builder FROM e), s AS (SELECT nid, w.name, step, CASE builder {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _BUILDERS.items())} END AS stems FROM w JOIN t USING (name)),
u AS (SELECT nid, name, step, unnest(stems) AS x, generate_subscripts(stems, 1) - 1 AS stem_ord FROM s),
f AS (SELECT nid, u.name, u.step, stem_ord, ord, function, x || CASE ending WHEN '0' THEN '' ELSE ending END AS form FROM u JOIN e ON u.name = e.name AND u.step = e.step), g AS (SELECT *, regexp_replace(form, 'y|ie?', 'i', 'g') AS formi FROM f)
SELECT nid, name AS paradigm, step, stem_ord::INT AS stem_ord, ord, function, form, formi, 0 AS dup, '' AS probability FROM g UNION ALL SELECT nid, name, step, stem_ord::INT, ord, function, form, {_REDUCED}, 1, '1' FROM g WHERE {_REDUCED} <> formi""")
def noun_forms(spark, sf_dir):
    """Words x all noun tables with their stem builders, with the reduced second row."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    stem = F.concat(F.lower(F.regexp_extract("p_name", "([A-Za-z]+)$", 1)), pick(_SHAPES))
    words = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), stem.alias("title"), stem.alias("stem"), F.lit("0").alias("prefix"), F.lit("").alias("wright"), F.array(pick(_TABLES)).alias("paradigms"))
    return morphology.noun_forms(words, compat=False).select("nid", "paradigm", "step", "stem_ord", "ord", "function", "form", "formi", "dup", "probability")


_ADVERB = ", ".join(f"({k}, '{f}', '{'' if e == '0' else e}', '{p}', {int(c)})" for k, (f, e, p, c) in enumerate(morphology.ADVERB))


@query(f"""WITH {_WORDS}, e(ord, function, ending, probability, cut) AS (VALUES {_ADVERB})
SELECT nid, ord, function, CASE cut WHEN 1 THEN regexp_replace(stem, 'e$', '') ELSE stem END || ending AS form, probability FROM w, e""")
def adverb_forms(spark, sf_dir):
    return morphology.adverb_forms(_words(spark, sf_dir)).where("dup = 0").select("nid", "ord", "function", "form", "probability")


def _change_sql(form: str, rules: list[tuple[str, str]], literal: bool) -> str:
    """The list of forms that ordered changes derive, as SQL."""
    made, now = [], form
    for old, new in rules:
        after = f"replace({now}, '{old}', '{new}')" if literal else f"regexp_replace({now}, '{old}', '{new}', 'g')"
        made.append(f"CASE WHEN {after} <> {now} THEN {after} END")
        now = after
    return f"list_filter([{', '.join(made)}], lambda x: x IS NOT NULL)"


_CHANGED = [("PsInSg2", e) for e in ("dst", "þst", "tst", "ngst", "gst", "st")] + [("PsInSg3", e) for e in ("dþ", "tþ", "þþ", "ngþ", "gþ", "sþ")] + [("PaPt", e) for e in ("ted", "tt", "en")]


@query(f"""WITH {_WORDS}, f AS (SELECT nid, {[f for f, _ in _CHANGED]}[nid % {len(_CHANGED)} + 1] AS function, stem || {[e for _, e in _CHANGED]}[nid % {len(_CHANGED)} + 1] AS x FROM w),
c AS (SELECT nid, function, list_concat([x], CASE function WHEN 'PsInSg2' THEN {_change_sql("x", morphology.SECOND_PERSON, True)} WHEN 'PsInSg3' THEN {_change_sql("x", morphology.THIRD_PERSON, False)} ELSE {_change_sql("x", morphology.PAST_PARTICIPLE, False)} END) AS forms FROM f),
u AS (SELECT nid, function, unnest(forms) AS form, generate_subscripts(forms, 1) - 1 AS change FROM c)
SELECT nid, function, change::INT AS change, form, CASE WHEN change = 0 THEN (nid % 3)::VARCHAR ELSE (nid % 3 + 1)::VARCHAR END AS probability FROM u""")
def sound_changes(spark, sf_dir):
    """Ordered, cumulative changes of three functions; each that fires makes a row with a higher probability."""
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _CHANGED]), (F.col("nid") % len(_CHANGED) + 1).cast("int"))
    forms = _words(spark, sf_dir).select("nid", pick(0).alias("function"), F.concat("stem", pick(1)).alias("form"), (F.col("nid") % 3).cast("string").alias("probability"))
    return morphology.sound_changes(forms).select("nid", "function", "change", "form", "probability")


#: Paradigms of the query below: a strong and a weak one, all parts.
_PARADIGMS = [
    ("9", "helpan", "s", "3", "", 0, 0, "if", "0", "h", "e", "lp", "0", "0", "an"), ("9", "helpan", "s", "3", "", 0, 1, "painsg1", "0", "h", "ea", "lp", "0", "0", "0"),
    ("9", "helpan", "s", "3", "", 0, 2, "painpl", "0", "h", "u", "lp", "0", "0", "on"), ("9", "helpan", "s", "3", "", 0, 3, "papt", "ge", "h", "o", "lp", "0", "0", "en"),
    ("50", "fremman", "w", "1", "", 0, 0, "if", "0", "fr", "e", "mm", "0", "0", "an"), ("50", "fremman", "w", "1", "", 0, 1, "psinsg2", "0", "fr", "e", "m", "0", "0", "est"),
    ("50", "fremman", "w", "1", "", 0, 2, "painsg1", "0", "fr", "ea", "m", "0", "ed", "e"), ("50", "fremman", "w", "1", "", 1, 3, "papt", "0", "fr", "e", "m", "0", "ed", "0"),
    ("90", "habban", "w", "3", "", 0, 0, "if", "0", "h", "a", "bb", "0", "0", "an"), ("90", "habban", "w", "3", "", 0, 1, "pspt", "0", "h", "ae", "bb", "0", "0", "ende"),
    ("60", "lufian", "w", "2", "", 0, 0, "if", "0", "l", "u", "0", "i", "0", "ian"),
]
_PARADIGM_COLUMNS = "para_id string, paradigm string, type string, class2 string, class3 string, variant_id int, part_ord int, part string, prefix string, pre_vowel string, vowel string, post_vowel string, boundary string, dental string, ending string"
_value = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
_values = lambda rows: ", ".join(f"({', '.join(map(_value, r))})" for r in rows)
_BASE = "concat_ws('-', prefix, pre_vowel, active, post_vowel, boundary)"


def _verbs(spark, sf_dir):
    stem = F.lower(F.regexp_extract("p_name", "([A-Za-z]+)$", 1))
    stem = F.when(F.col("p_partkey") % 4 == 2, F.concat(stem, F.lit("ian"))).otherwise(F.concat(stem, F.lit("an")))
    para = F.element_at(F.array(*[F.lit(x) for x in ("9", "50", "60", "90")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    words = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), stem.alias("title"), stem.alias("stem"), F.lit("0").alias("prefix"), F.lit("").alias("wright"), para.alias("para_id"))
    return conjugation.conjugate(words, spark.createDataFrame(_PARADIGMS, _PARADIGM_COLUMNS))


_VERBS = f"""
WITH words AS (SELECT p_partkey AS nid, lower(regexp_extract(p_name, '([A-Za-z]+)$', 1)) || CASE WHEN p_partkey % 4 = 2 THEN 'ian' ELSE 'an' END AS stem, ['9', '50', '60', '90'][p_partkey % 4 + 1] AS para_id FROM part),
p(para_id, paradigm, type, class2, class3, var, part_ord, part, item_prefix, item_pre, item_vowel, item_post, boundary, item_dental, item_ending) AS (VALUES {_values(_PARADIGMS)}),
e(branch, block, ord, ending, function, added, delta, dental, need, vowels) AS (VALUES {_values(conjugation.ending_rows())}),
seeds AS (SELECT para_id, max(CASE WHEN var = 0 AND part = 'if' AND boundary <> '0' THEN boundary ELSE '' END) AS boundary_inf, max(CASE WHEN var = 0 AND part = 'if' THEN item_vowel ELSE '' END) AS vowel_inf,
  max(CASE WHEN var = 0 AND part = 'painsg1' THEN item_vowel ELSE '' END) AS vowel_pa FROM p GROUP BY para_id),
s AS (SELECT *, CASE WHEN item_prefix = '0' THEN '0' ELSE '0-' || item_prefix END AS prefix, regexp_extract(stem, '^({S.VOWEL}*?.*?)({S.VOWEL}{{1,2}})', 1) AS pre0, regexp_extract(stem, '^({S.VOWEL}*?.*?)({S.VOWEL}{{1,2}})', 2) AS root,
  CASE WHEN item_post = '0' THEN '' WHEN boundary_inf = '' THEN regexp_extract(stem, '{S.VOWEL}{S.VOWEL}*?({S.CONSONANT}.*?){S.VOWEL}+n$', 1) ELSE regexp_extract(stem, '{S.VOWEL}{S.VOWEL}*?({S.CONSONANT}.*?)' || boundary_inf || '{S.VOWEL}+n$', 1) END AS post0,
  type <> 's' AND para_id::INT BETWEEN 89 AND 92 AS shaped FROM words JOIN p USING (para_id) JOIN seeds USING (para_id)),
b AS (SELECT *, unnest(list_filter(['principal', CASE WHEN type = 's' AND part = 'if' THEN CASE WHEN contains(item_ending, 'an') THEN 'strong_if_an' ELSE 'strong_if' END WHEN type = 's' AND part IN ('painsg1', 'painpl') THEN 'strong_' || part
  WHEN type <> 's' AND NOT shaped AND (part = 'if' AND class2 IN ('', '1', '2') OR part IN ('psinsg2', 'painsg1')) THEN 'weak_' || part END], lambda x: x IS NOT NULL)) AS branch FROM s),
j AS (SELECT b.*, e.* EXCLUDE (branch), CASE WHEN b.branch = 'principal' AND shaped THEN item_pre ELSE pre0 END AS pre_vowel, CASE WHEN b.branch = 'principal' AND shaped THEN item_post ELSE post0 END AS post1,
  CASE WHEN type = 's' OR b.branch = 'principal' AND shaped THEN item_vowel ELSE root END AS own FROM b JOIN e ON b.branch = e.branch),
v AS (SELECT *, CASE WHEN branch IN ('weak_psinsg2', 'weak_painsg1') THEN {"regexp_replace(" * 26}post1{"".join(f", '{c}{c}', '{c}', 'g')" for c in "abcdefghijklmnopqrstuvwxyz")} ELSE post1 END AS post_vowel,
  CASE WHEN vowels = 'mutated' THEN [CASE own WHEN 'e' THEN 'i' ELSE own END, own] WHEN vowels = 'past' AND vowel_inf <> '' AND vowel_pa <> '' AND vowel_inf <> vowel_pa THEN [vowel_pa, own] ELSE [own] END AS actives FROM j),
a AS (SELECT *, unnest(actives) AS active, generate_subscripts(actives, 1) - 1 AS vowel_ord FROM v),
n AS (SELECT *, regexp_matches({_BASE}, '{conjugation.FINAL_VOWEL}') AS open, {_BASE} AS base FROM a WHERE need = '' OR need = 'vowel' AND regexp_matches({_BASE}, '{conjugation.FINAL_VOWEL}') OR need = 'bare vowel' AND regexp_matches({_BASE}, '(?i){S.VOWEL}$')),
f AS (SELECT *, coalesce(function, part) AS fn, concat_ws('-', base, CASE WHEN type = 's' OR dental = 'none' THEN NULL WHEN dental = 'i' THEN CASE WHEN starts_with(item_ending, 'i') THEN 'i' ELSE '' END ELSE item_dental END,
  CASE ending WHEN 'own' THEN item_ending WHEN 'none' THEN NULL ELSE ending END) AS form_parts,
  CASE WHEN branch = 'principal' AND (type = 's' OR NOT shaped AND part = 'painsg1' AND var = 0) OR branch <> 'principal' AND type = 's' AND vowels = 'own' AND added = 0 THEN '' ELSE (vowel_ord + added)::VARCHAR END AS prob,
  CASE WHEN branch = 'principal' AND part = 'papt' THEN 'past' WHEN branch = 'principal' AND type <> 's' AND part = 'pspt' THEN 'present'
    WHEN branch <> 'principal' AND function = 'PsPt' AND (type = 's' OR ending = CASE WHEN open THEN 'nde' ELSE 'ende' END) THEN 'present' WHEN branch = 'weak_painsg1' AND function = 'PaPt' THEN 'past' END AS participle FROM n),
m AS (SELECT *, translate(form_parts, '0-', '') AS source FROM f),
c AS (SELECT *, list_concat([source], CASE WHEN delta IS NULL THEN []::VARCHAR[] WHEN fn = 'PsInSg2' THEN {_change_sql("source", morphology.SECOND_PERSON, True)} WHEN fn = 'PsInSg3' THEN {_change_sql("source", morphology.THIRD_PERSON, False)}
  WHEN fn = 'PaPt' THEN {_change_sql("source", morphology.PAST_PARTICIPLE, False)} ELSE []::VARCHAR[] END) AS forms FROM m),
o AS (SELECT *, unnest(forms) AS form, generate_subscripts(forms, 1) - 1 AS change FROM c)"""


@query(f"""{_VERBS}
SELECT nid, para_id, var, part_ord, block, vowel_ord::INT AS vowel_ord, ord, change::INT AS change, fn AS function, form_parts, form, CASE WHEN change = 0 THEN prob WHEN prob = '' THEN '0' ELSE (prob::INT + delta)::VARCHAR END AS probability FROM o""")
def verb_forms(spark, sf_dir):
    """Words as verbs of a strong, three weak paradigms and their parts, with sound changes."""
    return _verbs(spark, sf_dir).where("dup = 0").select("nid", "para_id", "var", "part_ord", "block", "vowel_ord", "ord", "change", "function", "form_parts", "form", "probability")


@query(f"""{_VERBS}, q AS (SELECT *, CASE WHEN position(prefix IN form_parts) > 0 THEN substr(form_parts, position(prefix IN form_parts) + length(prefix)) ELSE form_parts END AS rest FROM o WHERE change = 0 AND participle IS NOT NULL)
SELECT nid, translate(prefix || translate(rest, '0-', ''), '0-', '') AS title, translate(rest, '0-', '') AS stem, (participle = 'present')::INT AS pspart, (participle = 'past')::INT AS papart FROM q""")
def verb_participles(spark, sf_dir):
    """The participles of those verbs, as they go on to the adjectives."""
    return conjugation.participles(_verbs(spark, sf_dir)).select("nid", "title", "stem", "pspart", "papart")


_SUFFIXES = ["sum", "lic", "isc", "cund", "feald", "full", "iht", "ihte", "ede", "wende", "u", "o"]


@query(f"""WITH w AS (SELECT p_partkey AS nid, lower(regexp_extract(p_name, '([A-Za-z]+)$', 1)) || {_SUFFIXES}[p_partkey % {len(_SUFFIXES)} + 1] AS stem, p_partkey % 2 AS numeral FROM part)
SELECT nid, CASE WHEN regexp_matches(stem, '(sum|lic|isc)$') THEN 'til' WHEN regexp_matches(stem, '(cund|feald|full|iht)$') THEN 'blind' WHEN regexp_matches(stem, '(ihte|ede|wende)$') THEN 'wilde' ELSE 'gearu' END AS paradigm,
  CASE WHEN contains(stem, 'feald') THEN 0 ELSE numeral END::INT AS numeral FROM w""")
def adjective_suffixes(spark, sf_dir):
    """Adjective labels that the ending decides, and the numeral flag that one of them clears."""
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("nid") % len(_SUFFIXES) + 1).cast("int"))
    words = _words(spark, sf_dir).withColumn("stem", F.concat("stem", suffix)).withColumn("numeral", (F.col("nid") % 2).cast("int"))
    return morphology.adjective_paradigms(words).select("nid", "paradigm", "numeral")


@query(f"""WITH w0 AS (SELECT p_partkey AS nid, lower(regexp_extract(p_name, '([A-Za-z]+)$', 1)) AS s FROM part), w AS (SELECT nid, CASE nid % 3 WHEN 0 THEN translate(s, 'aeiou', 'āēīōū') WHEN 1 THEN s || 'scēge' ELSE s END AS stem FROM w0),
r AS (SELECT nid, stem, regexp_extract(stem, '^.*?({VOWELS}{VOWELS}?)({CONSONANTS}*)(.*)$', ['v', 'c', 'r']) AS x FROM w)
SELECT nid, (len(regexp_extract_all(stem, '{VOWELS}{CONSONANTS}')) + len(regexp_extract_all(stem, '{VOWELS}$')))::INT AS syllables,
  CASE WHEN x.v = '' THEN 0 WHEN regexp_matches(x.v, '{S.LONG_VOWEL}') OR length(replace(replace(x.c, 'sc', 's'), 'cg', 'c')) > 1 OR (x.r = '' AND x.c <> '') THEN 1 ELSE 0 END AS long_stem FROM r""")
def stem_shapes(spark, sf_dir):
    """Syllables and stem length."""
    stem = F.when(F.col("nid") % 3 == 0, F.translate("stem", "aeiou", "āēīōū")).when(F.col("nid") % 3 == 1, F.concat("stem", F.lit("scēge"))).otherwise(F.col("stem"))
    return _words(spark, sf_dir).withColumn("stem", stem).select("nid", S.syllable_count(F.col("stem")).alias("syllables"), S.stem_length(F.col("stem")).alias("long_stem"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, line_number, line, regexp_extract(line, '^\\s*([\\[\\(]?[0-9]+[\\]\\.\\)]?|[IVXLCDMivxlcdm]+[\\]\\.\\)]?)(?:\\s+|$)', 1) AS m FROM t)
SELECT doc_id, line_number, trim(m, '[]().') AS marker FROM m WHERE m <> ''""")
def line_markers(spark, sf_dir):
    """Numbers that lines start with, also words that look Roman."""
    return _lines(spark, sf_dir).select("doc_id", "line_number", S.marker(F.col("line")).alias("marker")).where("marker is not null")


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), r AS (SELECT w, list_filter(list_transform(string_split(w, ''), lambda x: CASE x WHEN 'm' THEN 1000 WHEN 'd' THEN 500 WHEN 'c' THEN 100 WHEN 'l' THEN 50 WHEN 'x' THEN 10 WHEN 'v' THEN 5 WHEN 'i' THEN 1 END), lambda x: x IS NOT NULL) AS n FROM w)
SELECT w AS word, coalesce(list_sum(list_transform(range(1, len(n) + 1), lambda k: CASE WHEN k = len(n) OR n[k] >= n[k + 1] THEN n[k] ELSE -n[k] END)), 0)::INT AS value FROM r""")
def roman_values(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word")).distinct()
    return words.select("word", S.roman_value(F.col("word")).alias("value"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, count(*) AS n, sum(length(t)) AS s, count(*) FILTER (ends_with(t, '.')) AS stops FROM t WHERE t <> '' GROUP BY doc_id)
SELECT doc_id, CASE WHEN n >= 2 AND s <= 60 * n AND stops < 0.8 * n THEN 'verse' ELSE 'prose' END AS kind FROM k""")
def block_kinds(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.where(S.strip(F.col("text")) != "").select("doc_id", S.block_kind(F.col("text")).alias("kind"))


@query("""WITH b AS (SELECT lang, doc_id // 1000 AS block, sha256(string_agg(doc_id || ':' || n_chars, chr(10) ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang, sha256(string_agg(digest, chr(10) ORDER BY block)) AS digest, sum(n)::BIGINT AS n FROM b GROUP BY lang""")
def ordered_digest(spark, sf_dir):
    """sha256 over ordered rows of a group: of the digests of blocks of 1000 ids, so that no group has to fit into a row."""
    block = F.floor(F.col("doc_id") / 1000).alias("block")
    rows = read(spark, sf_dir, "documents").groupBy("lang", block).agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("rs"), F.count(F.lit(1)).alias("n"))
    rows = rows.select("lang", "block", F.sha2(F.array_join(F.transform("rs", lambda r: F.concat_ws(":", r["doc_id"], r["n_chars"])), "\n"), 256).alias("digest"), "n")
    out = rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("ds"), F.sum("n").alias("n"))
    return out.select("lang", F.sha2(F.array_join(F.transform("ds", lambda d: d["digest"]), "\n"), 256).alias("digest"), "n")


@query("SELECT CASE WHEN role = 'system' THEN 1 WHEN role = 'user' THEN 2 ELSE 3 END AS stage, count(*) AS n FROM conversations GROUP BY 1")
def stage_counts(spark, sf_dir):
    """Rows by stage of a concatenation."""
    rows = read(spark, sf_dir, "conversations").withColumn("stage", F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query()
def section_rows(spark, sf_dir):
    """Lines to blocks to sections: splits, heading carry, speaker and kind islands."""
    blocks = ingest.runs(ingest.classify_lines(_lines(spark, sf_dir)))
    return ingest.sections(blocks.drop("is_heading"))


@query()
def sentence_rows(spark, sf_dir):
    return ingest.sentence_rows(section_rows(spark, sf_dir))


@query()
def verse_rows(spark, sf_dir):
    return ingest.verse_rows(section_rows(spark, sf_dir))


@query()
def oe_blocks(spark, sf_dir):
    """Blocks that the Old English filter keeps."""
    return ingest.oe_filter(ingest.runs(ingest.classify_lines(_lines(spark, sf_dir))))


@query()
def palatalized(spark, sf_dir):
    """Dotted g and c of every different token."""
    words = diacritics.tokens(read(spark, sf_dir, "documents")).select("word").distinct()
    return words.select("word", S.palatalize_c(S.palatalize_g(F.col("word"))).alias("dotted"))


@query()
def syllables(spark, sf_dir):
    words = diacritics.tokens(read(spark, sf_dir, "documents")).select(F.lower("word").alias("word")).distinct()
    return words.select("word", udfs.syllabify("word").alias("syllables"))


@query()
def ocr_scores(spark, sf_dir):
    """Error rates and letter recalls of each benchmark item against its text without doubled letters."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("expected"), S.degeminate(F.col("text")).alias("observed"))
    return ocr.scores(items).drop("expected", "observed")


@query()
def tei_round_trip(spark, sf_dir):
    """Verse and prose of documents written as TEI and read back."""
    rows = sentence_rows(spark, sf_dir).select("doc_id", F.lit("sentence").alias("kind"), F.lit("/0/").alias("path"), F.col("sentence_ix").alias("ord"), F.lit(None).cast("string").alias("title"), F.col("number").cast("string").alias("number"), "speaker", "text")
    head = read(spark, sf_dir, "documents").select("doc_id", F.lit("section").alias("kind"), F.lit("/0/").alias("path"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("text"))
    return tei.read(tei.write(head.unionByName(rows)), "doc_id", "xml")


_NUMERAL = ", ".join(f"({k}, 'PoPl{g}{c}', '{e}', '{p}')" for k, (g, c, e, p) in enumerate((g, *x) for g in ("Ma", "Ne", "Fe") for x in (("No", "an", ""), ("Ac", "an", ""), ("Ge", "ra", ""), ("Ge", "ena", "1"), ("Da", "um", ""))))


@query(f"""WITH {_WORDS}, e(ord, function, ending, probability) AS (VALUES {_NUMERAL})
SELECT nid, ord, function, regexp_replace(stem, '[eao]$', '') || ending AS form, probability FROM w, e""")
def numeral_forms(spark, sf_dir):
    """Words as weak numerals."""
    words = _words(spark, sf_dir).withColumn("noun", F.lit(0))
    return declension.numeral_forms(words).where("dup = 0").select("nid", "ord", "function", "form", "probability")


_PLAIN = [k for k, v in declension.STRONG.items() if ">" not in v]
_STRONG = ", ".join(f"('{k}', {j}, 'Po{e[1:].split()[0]}', '{e.split()[1].split('-')[1]}', '{e.split()[2]}')" for k in _PLAIN for j, e in enumerate(declension.STRONG[k].split(", ")))


@query(f"""WITH {_WORDS}, e(paradigm, ord, function, ending, probability) AS (VALUES {_STRONG})
SELECT nid, paradigm, ord, function, stem || CASE ending WHEN '0' THEN '' ELSE ending END AS form, probability FROM w JOIN e ON e.paradigm = {_PLAIN}[nid % {len(_PLAIN)} + 1]""")
def adjective_strong_forms(spark, sf_dir):
    """Words declined as strong adjectives of the tables that leave the stem as it is."""
    paradigm = F.element_at(F.array(*map(F.lit, _PLAIN)), (F.col("nid") % len(_PLAIN) + 1).cast("int"))
    return _adjectives(spark, sf_dir, paradigm).where("dup = 0 and part = 0").select("nid", "paradigm", "ord", "function", "form", "probability")


def _adjectives(spark, sf_dir, paradigm=None):
    flags = {"adjective": 1, "numeral": 0, "pronoun": 0, "papart": 0, "pspart": 0}
    return declension.adjective_forms(_words(spark, sf_dir).withColumn("paradigm", F.lit("blind") if paradigm is None else paradigm).withColumns({k: F.lit(v) for k, v in flags.items()}))


@query()
def adjective_forms(spark, sf_dir):
    """All degrees, strong and weak."""
    return _adjectives(spark, sf_dir).select("nid", "part", "rank", "ord", "dup", "function", "form", "formi", "probability")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN NULL ELSE length(text) * 10 END AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n IS NULL THEN 2000 ELSE least(n, 2000) END AS max_tokens, n IS NULL OR n > 2000 AS changed FROM m""")
def clamped_requests(spark, sf_dir):
    """Token limits on requests."""
    n = F.length("text")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(n % 3 != 0, (n * 10).cast("string")).alias("max_tokens"), *[F.lit(None).cast("string").alias(c) for c in ("max_completion_tokens", "temperature", "top_p")])
    return completions.clamp(rows, 2000).select("conv_id", "turn", "max_tokens", (F.size("notes") > 0).alias("changed"))

"""Readers and writers: texts, dictionaries, paradigms, indexes, pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators.morphology import numbered

#: Columns of the tab-separated inputs.
DICTIONARY = "nid title wright noun pronoun adjective verb participle adverb preposition conjunction interjection numeral vb_weak vb_strong vb_contracted vb_pretpres vb_anomalous vb_uncertain n_masc n_fem n_neut n_uncert".split()
MANUAL = "bt title unused1 form_parts unused2 var probability function wright paradigm para_id wordclass class1 class2 class3 comment".split()
PARADIGM = "para_id title type class subdivision subclass wright variant_id part prefix pre_vowel vowel post_vowel boundary dental ending".split()


def source_format(path: Column) -> Column:
    """How a path is read: http, tei or file; a path with an unknown suffix is an error where it is used."""
    return F.when(path.rlike("(?i)^https?://"), "http").when(path.rlike("(?i)\\.(xml|tei)$") | path.contains("<TEI"), "tei").when(path.rlike("(?i)\\.(txt|text|md|html|htm|php|pdf)$"), "file").otherwise(F.raise_error(F.concat(F.lit("unsupported source: "), path)))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pre_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, block_ix, text): the blocks between blank lines of every <pre>, tags taken out."""
    pres = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<pre[^>]*>(.*?)</pre>"), F.lit(1))).alias("p", "pre"))
    parts = pres.select(key, "p", F.posexplode(F.split(F.regexp_replace("pre", "<[^>]*>", ""), "\n\\s*\n")).alias("b", "text")).where(S.strip(F.col("text")) != "")
    return parts.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("p", "b")) - 1).alias("block_ix"), F.rtrim("text").alias("text"))


def _fields(spark: SparkSession, path: str, names: list[str], tidy=lambda c: c) -> DataFrame:
    """Numbered lines split at tabs, padded with empty fields."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.split(tidy(F.col("value")), "\t").alias("f"))
    return rows.select("ord", F.size("f").alias("n"), *[F.coalesce(F.get("f", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(names)])


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Words of a dictionary: lower case, thorn and c, long diphthongs; short lines are dropped, flags that aren't numbers are 0."""
    rows = _fields(spark, path, DICTIONARY, lambda c: S.move_accents(S.eth_to_thorn(F.lower(c)))).where(F.col("n") >= len(DICTIONARY))
    flags = {c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in DICTIONARY if c not in ("title", "wright")}
    rows = rows.withColumns(flags).drop("n")
    present = F.col("title").rlike("nde$")
    return rows.withColumn("pspart", F.when(present, F.col("participle")).otherwise(0)).withColumn("papart", F.when(present, 0).otherwise(F.col("participle")))


def preprocess(words: DataFrame, prefixes: list[str]) -> DataFrame:
    """Add prefix, stem and syllables: a known prefix before a hyphen or blank goes, then what stands before the last one."""
    known = "|".join(prefixes) or "0"
    title = F.col("title")
    prefix = F.regexp_extract(title, f"^({known})[\\- ]", 1)
    stem = S.without_prefix(title)
    return words.withColumn("prefix", prefix).withColumn("stem", stem).withColumn("syllables", S.syllable_count(stem))


def manual_forms(spark: SparkSession, path: str) -> DataFrame:
    """Listed forms: the stem is the last part of the title, the form loses its first hyphen only."""
    rows = _fields(spark, path, MANUAL)
    return rows.withColumn("stem", F.element_at(F.split("title", "-"), -1)).withColumn("form", F.regexp_replace("form_parts", "^([^-]*)-", "$1")).drop("n", "unused1", "unused2")


def verb_paradigms(spark: SparkSession, path: str) -> DataFrame:
    """Paradigm parts; of parts listed twice the later one holds, in the place of the first."""
    rows = _fields(spark, path, PARADIGM).drop("n").withColumn("variant_id", F.col("variant_id").try_cast("int"))
    part = Window.partitionBy("para_id", "variant_id", "part")
    whole = part.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("part_ord", F.first("ord").over(whole)).withColumn("last", F.max("ord").over(whole)).where("ord = last").drop("last")


def prefix_list(spark: SparkSession, path: str) -> list[str]:
    """Prefixes in file order: a list of some dozens that is part of a pattern."""
    rows = spark.read.text(path).select(S.strip(F.col("value")).alias("p")).where("p <> ''")
    return [r.p for r in rows.collect()]


def word_list(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.lower(S.strip(F.col("value"))).alias("token"))
    return rows.where((F.col("token") != "") & ~F.col("token").startswith("#")).distinct()


def rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Ordered substitutions: a configuration file, read here; a line without two fields is an error."""
    found = []
    for r in spark.read.text(path).select(S.strip(F.col("value")).alias("v")).where("v <> '' and not v like '#%'").collect():
        parts = r.v.split("\t")
        if len(parts) < 2:
            raise ValueError(f"a rule needs a pattern and a replacement: {r.v!r}")
        found.append((parts[0], parts[1]))
    return found


def macron_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, forms, is_ambiguous, completed) of an index file with maps unique and ambiguous and a list of completed keys."""
    raw = spark.read.json(path, multiLine=True, schema="unique map<string,string>, ambiguous map<string,array<string>>, ambiguous_completed array<string>")
    single = raw.select(F.explode("unique").alias("key", "form")).select("key", F.array("form").alias("forms"), F.lit(False).alias("is_ambiguous"), F.lit(False).alias("completed"))
    done = F.coalesce(F.array_contains("ambiguous_completed", F.col("key")), F.lit(False)).alias("completed")
    many = raw.select("ambiguous_completed", F.explode("ambiguous").alias("key", "forms")).select("key", "forms", F.lit(True).alias("is_ambiguous"), done)
    return single.join(many, "key", "left_anti").unionByName(many)


def index_meta(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of an index file's meta map."""
    return spark.read.json(path, multiLine=True, schema="meta map<string,string>").select(F.explode("meta").alias("name", "value"))


class _Cards(HTMLParser):
    """The fields of the cards of a result page: div.btd--search-entry inside article."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, set[str]]] = []
        self.cards: list[dict] = []
        self.card: int | None = None
        self.field: tuple[str, int] | None = None  # the field that text goes to, and the depth it was opened at

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        names = set((attrs.get("class") or "").split())
        if tag not in VOID:
            self.open.append((tag, names))
        if tag == "div" and "btd--search-entry" in names and any(t == "article" for t, _ in self.open) and self.card is None:
            self.card = len(self.open)
            self.cards.append({"headword": None, "href": "", "pos": None, "meanings": None})
        elif self.card is not None and self.field is None:
            card, last = self.cards[-1], None
            if tag == "a" and self._inside("header", "h3") and card["headword"] is None:
                last, card["href"] = "headword", attrs.get("href") or ""
            elif "btd--search-entry-wordclass" in names and card["pos"] is None:
                last = "pos"
            elif tag == "p" and card["meanings"] is None and any("btd--search-description" in n for _, n in self.open[self.card :]):
                last = "meanings"
            if last:
                card[last], self.field = "", (last, len(self.open))

    def _inside(self, *tags: str) -> bool:
        at = iter(t for t, _ in self.open[self.card :])
        return all(t in at for t in tags)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        if self.field and len(self.open) < self.field[1]:
            self.field = None
        if self.card is not None and len(self.open) < self.card:
            self.card = self.field = None

    def handle_data(self, data):
        if self.field:
            self.cards[-1][self.field[0]] += " " + data


# The site the links of result pages belong to, the mark between meanings, elements without an end.
SITE = "https://bosworthtoller.com"
BETWEEN = "⬩"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def search_entries(pages: DataFrame) -> DataFrame:
    """(page_id, order_index, headword, headword_macronized, pos, meanings, entry_url) of dictionary result pages.

    Cards without a headword give no row but count in order_index. A page is parsed on an Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, text in zip(*(c.to_pylist() for c in batch.columns)):
                parser = _Cards()
                parser.feed(text or "")
                for k, card in enumerate(parser.cards):
                    if word := " ".join((card["headword"] or "").split()):
                        rows.append((page, k, word, " ".join((card["pos"] or "").split()), " ".join((card["meanings"] or "").split()), urljoin(SITE, card["href"]) if card["href"] else SITE))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (batch.column(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "order_index", "headword", "pos", "body", "entry_url"])

    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, order_index int, headword string, pos string, body string, entry_url string")
    bare = F.col("pos").startswith("(") & F.col("pos").endswith(")")
    pos = F.when(bare, S.strip(F.expr("substring(pos, 2, length(pos) - 2)"))).otherwise(F.col("pos"))
    meanings = F.filter(F.transform(F.split("body", BETWEEN), lambda m: S.strip(m)), lambda m: m != "")
    return rows.select("page_id", "order_index", "headword", S.acute_to_macron(F.col("headword")).alias("headword_macronized"), pos.alias("pos"), meanings.alias("meanings"), "entry_url")


def entries_of_form(entries: DataFrame, key: str) -> DataFrame:
    """The entries whose headword has this key."""
    return entries.where(S.normalize_old_english(F.col("headword")) == key)


def merge_entries(entries: DataFrame, order: list[str]) -> DataFrame:
    """Entries of several pages without repeated (url, headword in lower case): the first in `order` stays, numbered anew from 0."""
    same = Window.partitionBy("entry_url", F.lower("headword")).orderBy(*order)
    first = entries.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    rows = numbered(first.withColumnRenamed("order_index", "page_index"), [{"order_index": "page_index"}.get(c, c) for c in order])
    return rows.withColumnRenamed("counter", "order_index").drop("page_index")


def log_counters(logs: DataFrame) -> DataFrame:
    """Sums of `name=number` counters in free log text (line), decimals included."""
    found = logs.select(F.explode(F.regexp_extract_all("line", F.lit("([A-Za-z_]+=[0-9]+(?:\\.[0-9]+)?)"))).alias("kv"))
    return found.groupBy(F.split("kv", "=")[0].alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.split("kv", "=")[1].cast("double")).alias("total"))


def markdown_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all *.md files below a folder that are not blank; none at all is an error."""
    pages = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(S.strip(F.col("value")) != "")
    if pages.isEmpty():
        raise ValueError(f"no page with text under {path}")
    return pages


def html_elements(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, element_ix, text): the pieces of text between block tags of a page, without scripts, styles and the head."""
    body = F.regexp_replace("html", "(?is)<!--.*?-->|<(script|style|head|noscript|template)\\b.*?</\\1\\s*>", " ")
    cut = F.regexp_replace(body, "(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|hr|tr|td|th|table|section|article|header|footer|nav|aside|main|blockquote|pre|dl|dt|dd|body|html|form)\\b[^>]*>", "\u0001")
    parts = pages.select(key, F.posexplode(F.split(F.regexp_replace(cut, "<[^>]*>", ""), "\u0001")).alias("p", "raw"))
    for name, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        parts = parts.withColumn("raw", F.replace("raw", F.lit(name), F.lit(letter)))
    parts = parts.withColumn("text", S.collapse_spaces(F.col("raw"))).where("text <> ''")
    return parts.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("p")) - 1).alias("element_ix"), "text")

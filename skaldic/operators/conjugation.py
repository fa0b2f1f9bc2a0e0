"""Verb inflection: words x paradigm parts x ending tables, joined; duplicates are data and are never removed.

Attribution: the paradigms and rules follow work under CC BY 4.0 on the generation of Old English word forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import spread
from . import morphology

# Rows (ending, function, what is added to the probability) that follow each principal part.
STRONG_IF_AN = [
    ("anne", "IdIf", 0), ("enne", "IdIf", 0), ("ende", "PsPt", 0), ("e", "PsInSg1", 0), ("u", "PsInSg1", 1), ("o", "PsInSg1", 1), ("æ", "PsInSg1", 1),
    ("aþ", "PsInPl", 0), ("eþ", "PsInPl", 1), ("es", "PsInPl", 1), ("as", "PsInPl", 1), ("e", "PsSuSg", 0), ("en", "PsSuPl", 0), ("aþ", "ImPl", 0), ("0", "ImSg", 0),
]
STRONG_IF = [("nne", "IdIf", 0), ("nde", "PsPt", 0), ("0", "PsInSg1", 0), ("þ", "PsInPl", 0), ("0", "PsSuSg", 0), ("n", "PsSuPl", 0), ("þ", "ImPl", 0), ("0", "ImSg", 0)]
#: Over every vowel that i-mutation allows; the last number is what a sound change adds.
STRONG_MUTATED = [("stu", "PsInSg2", 1, None), ("est", "PsInSg2", 1, None), ("ist", "PsInSg2", 1, None), ("s", "PsInSg2", 1, None), ("st", "PsInSg2", 0, 1), ("eþ", "PsInSg3", 1, None), ("iþ", "PsInSg3", 1, None), ("þ", "PsInSg3", 0, 1)]
STRONG_PAINSG1 = [("0", "PaInSg3", 0)]
STRONG_PAINPL = [("e", "PaInSg2", 0), ("e", "PaSuSg", 0), ("en", "PaSuPl", 0)]
#: (ending, function, added, dental, only where): dental i is an i that the infinitive starts with, none leaves the place out.
WEAK_IF = [
    ("own", "if", 0, "none", ""), ("n", "if", 0, "none", "vowel"), ("anne", "IdIf", 0, "i", ""), ("enne", "IdIf", 0, "i", ""), ("nne", "IdIf", 0, "i", "vowel"),
    ("e", "PsInSg1", 0, "i", ""), ("u", "PsInSg1", 1, "i", ""), ("o", "PsInSg1", 1, "i", ""), ("æ", "PsInSg1", 1, "i", ""), ("0", "PsInSg1", 0, "none", "vowel"),
    ("aþ", "PsInPl", 0, "i", ""), ("eþ", "PsInPl", 1, "i", ""), ("es", "PsInPl", 1, "i", ""), ("as", "PsInPl", 1, "i", ""), ("þ", "PsInPl", 0, "i", "vowel"),
    ("e", "PsSuSg", 0, "i", ""), ("0", "PsSuSg", 0, "none", "vowel"), ("en", "PsSuPl", 0, "i", ""), ("n", "PsSuPl", 0, "i", "bare vowel"),
    ("aþ", "ImPl", 0, "i", ""), ("þ", "ImPl", 0, "none", "vowel"), ("ende", "PsPt", 0, "i", ""), ("nde", "PsPt", 0, "i", "vowel"),
]
WEAK_PSINSG2 = [
    ("est", "PsInSg2", 1, None), ("es", "PsInSg2", 1, None), ("ist", "PsInSg2", 1, None), ("s", "PsInSg2", 1, None), ("st", "PsInSg2", 0, 1),
    ("eþ", "PsInSg3", 1, None), ("ieþ", "PsInSg3", 1, None), ("iþ", "PsInSg3", 1, None), ("þ", "PsInSg3", 1, 0), ("e", "ImSg", 0, None), ("ie", "ImSg", 0, None), ("0", "ImSg", 0, None),
]
WEAK_PAINSG1 = [("e", "PaInSg1", 0), ("est", "PaInSg2", 0), ("es", "PaInSg2", 1), ("e", "PaInSg3", 0), ("on", "PaInPl", 0), ("e", "PaSuSg", 0), ("en", "PaSuPl", 0), ("none", "PaPt", 0)]
#: Paradigms whose own stem parts are used instead of the word's.
ITEM_SHAPE = (89, 92)
#: Letters that count as a vowel at the end of a weak stem; hyphens and zeros after them don't matter.
FINAL_VOWEL = "[æaeyouÆAEIYOUǣāēīȳōūǢĀĒĪȲŌŪ][0-]*$"
#: branch, block, ord, ending, function, added, change, dental, need, vowels (own, mutated or past)
COLUMNS = "branch string, block int, ord int, ending string, function string, added int, change int, dental string, need string, vowels string"


def ending_rows() -> list[tuple]:
    """The ending table: about ninety rows, whatever the words."""
    rows: list[tuple] = [("principal", 0, 0, "own", None, 0, None, "item", "", "own")]
    for branch, table in (("strong_if_an", STRONG_IF_AN), ("strong_if", STRONG_IF), ("strong_painsg1", STRONG_PAINSG1), ("strong_painpl", STRONG_PAINPL)):
        rows += [(branch, 1, k, e, f, p, None, "none", "", "own") for k, (e, f, p) in enumerate(table)]
        if branch.startswith("strong_if"):
            rows += [(branch, 2, k, e, f, p, d, "none", "", "mutated") for k, (e, f, p, d) in enumerate(STRONG_MUTATED)]
    rows += [("weak_if", 1, k, e, f, p, None, d, need, "own") for k, (e, f, p, d, need) in enumerate(WEAK_IF)]
    rows += [("weak_psinsg2", 1, k, e, f, p, d, "none", "", "own") for k, (e, f, p, d) in enumerate(WEAK_PSINSG2)]
    rows += [("weak_painsg1", 1, k, e, f, p, 1 if f == "PaPt" else None, "item", "", "past") for k, (e, f, p) in enumerate(WEAK_PAINSG1)]
    return rows


def pre_vowel(stem: Column) -> Column:
    """What stands before the first vowels."""
    return F.regexp_extract(stem, f"^({S.VOWEL}*?.*?)({S.VOWEL}{{1,2}})", 1)


def root_vowel(stem: Column) -> Column:
    """The first one or two vowels."""
    return F.regexp_extract(stem, f"^({S.VOWEL}*?.*?)({S.VOWEL}{{1,2}})", 2)


def post_vowel(stem: Column, boundary: Column) -> Column:
    """The consonants between the root vowel and the infinitive's boundary and ending."""
    rest = F.concat(F.lit(f"{S.VOWEL}{S.VOWEL}*?({S.CONSONANT}.*?)"), F.when(boundary == "", "").otherwise(F.concat(F.lit("\\Q"), boundary, F.lit("\\E"))), F.lit(f"{S.VOWEL}+n$"))
    return F.coalesce(F.call_function("regexp_extract", stem, rest, F.lit(1)), F.lit(""))


def ends_in_vowel(base: Column) -> Column:
    return base.rlike(FINAL_VOWEL)


def ends_in_bare_vowel(base: Column) -> Column:
    return base.rlike(f"(?iu){S.VOWEL}$")


def uses_item_shape(para_id: Column) -> Column:
    return F.coalesce(para_id.rlike("^[0-9]+$") & para_id.try_cast("int").between(*ITEM_SHAPE), F.lit(False))


def stem_parts(verbs: DataFrame, paradigms: DataFrame) -> DataFrame:
    """verbs (nid, title, stem, prefix, wright, para_id) x the parts of their paradigm, with the word's own segments.

    paradigms (para_id, paradigm, type, class2, class3, variant_id, part_ord, part, prefix, pre_vowel, vowel, post_vowel, boundary, dental, ending);
    title, class and subclass, as the reader names them, do for paradigm, class2 and class3.
    """
    paradigms = paradigms.drop("wright", "ord", "subdivision").withColumnsRenamed({"title": "paradigm", "class": "class2", "subclass": "class3"})
    first = lambda part, c: F.max(F.when((F.col("variant_id") == 0) & (F.lower("part") == part), F.col(c)))
    seeds = paradigms.groupBy("para_id").agg(*[S.empty_if_zero(first(p, c)).alias(n) for p, c, n in (("if", "boundary", "boundary_inf"), ("if", "vowel", "vowel_inf"), ("painsg1", "vowel", "vowel_pa"))])
    own = ("prefix", "pre_vowel", "vowel", "post_vowel", "ending", "dental")
    parts = paradigms.withColumnsRenamed({c: f"item_{c}" for c in own}).join(seeds, "para_id")
    df = spread(verbs).select("nid", "title", "stem", F.coalesce("prefix", F.lit("")).alias("word_prefix"), "wright", "para_id").join(parts, "para_id")
    prefix = F.when(F.col("word_prefix") == F.col("item_prefix"), F.col("word_prefix")).otherwise(F.concat_ws("-", "word_prefix", "item_prefix"))
    post = F.when(S.empty_if_zero(F.col("item_post_vowel")) == "", "").otherwise(post_vowel(F.col("stem"), F.col("boundary_inf")))
    return df.withColumns({"prefix": prefix, "pre_vowel": pre_vowel(F.col("stem")), "root": root_vowel(F.col("stem")), "post_vowel": post})


def conjugate(verbs: DataFrame, paradigms: DataFrame) -> DataFrame:
    """A row for each form: verbs and paradigms as in stem_parts; type `s` is strong, everything else weak.

    block, vowel_ord, ord and change order the forms of a part; change counts the sound changes that led to a form.
    `participle` is present or past where the form goes on to be declined as an adjective.
    """
    spark = verbs.sparkSession
    rows = stem_parts(verbs, paradigms)
    strong, part, shaped = F.col("type") == "s", F.lower("part"), uses_item_shape(F.col("para_id")) & (F.col("type") != "s")
    branch = (
        F.when(strong & (part == "if"), F.when(F.col("item_ending").contains("an"), "strong_if_an").otherwise("strong_if")).when(strong & part.isin("painsg1", "painpl"), F.concat(F.lit("strong_"), part))
        .when(~strong & ~shaped & ((part == "if") & F.col("class2").isin("", "1", "2") | part.isin("psinsg2", "painsg1")), F.concat(F.lit("weak_"), part))
    )
    rows = rows.withColumn("branch", F.explode(F.array_compact(F.array(F.lit("principal"), branch))))
    table = spark.createDataFrame(ending_rows(), COLUMNS)
    rows = rows.join(F.broadcast(table), "branch")  # a table of fixed size
    mine = {c: F.when((F.col("branch") == "principal") & shaped, F.col(f"item_{c}")).otherwise(F.col(c)) for c in ("pre_vowel", "post_vowel")}
    simple = F.when(F.col("branch").isin("weak_psinsg2", "weak_painsg1"), S.degeminate(mine["post_vowel"])).otherwise(mine["post_vowel"])
    own = F.when(strong | (F.col("branch") == "principal") & shaped, F.col("item_vowel")).otherwise(F.col("root"))
    two = (F.col("vowel_inf") != "") & (F.col("vowel_pa") != "") & (F.col("vowel_inf") != F.col("vowel_pa"))
    vowels = F.when(F.col("vowels") == "mutated", S.i_mutation(own)).when((F.col("vowels") == "past") & two, F.array("vowel_pa", own)).otherwise(F.array(own))
    rows = rows.withColumns({"pre_vowel": mine["pre_vowel"], "post_vowel": simple}).select("*", F.posexplode(vowels).alias("vowel_ord", "active"))
    base = F.concat_ws("-", "prefix", "pre_vowel", "active", "post_vowel", "boundary")
    needed = (F.col("need") == "") | (F.col("need") == "vowel") & ends_in_vowel(base) | (F.col("need") == "bare vowel") & ends_in_bare_vowel(base)
    rows = rows.where(needed)
    i = F.when(F.lower("item_ending").startswith("i"), "i").otherwise("")
    dental = F.when(strong | (F.col("dental") == "none"), F.lit(None)).when(F.col("dental") == "i", i).otherwise(F.coalesce("item_dental", F.lit("")))
    ending = F.when(F.col("ending") == "own", F.col("item_ending")).when(F.col("ending") != "none", F.col("ending"))
    principal = F.col("branch") == "principal"
    silent = F.when(principal, strong | ~shaped & (part == "painsg1") & (F.col("variant_id") == 0)).otherwise(strong & (F.col("vowels") == "own") & (F.col("added") == 0))
    probability = F.when(silent, "").otherwise((F.col("vowel_ord") + F.col("added")).cast("string"))
    function = F.coalesce("function", "part")
    parts = F.translate(F.concat_ws("-", base, dental, ending), "\n", "")
    last = F.when(ends_in_vowel(base), F.col("ending") == "nde").otherwise(F.col("ending") == "ende")
    participle = (
        F.when(principal & (part == "papt"), "past").when(principal & ~strong & (part == "pspt"), "present").when((function == "PsPt") & ~principal & (strong | last), "present")
        .when((F.col("branch") == "weak_painsg1") & (function == "PaPt"), "past")
    )
    rows = rows.select(
        "nid", "title", "stem", "word_prefix", "prefix", "wright", "para_id", "paradigm", F.col("type").alias("class1"), "class2", "class3", F.col("variant_id").alias("var"), "part_ord", "block", "vowel_ord", "ord",
        function.alias("function"), parts.alias("form_parts"), S.materialize_form(parts).alias("form"), probability.alias("probability"), "change", participle.alias("participle"),
    ).withColumnRenamed("change", "delta")
    rows = rows.withColumn("made", F.when(F.col("delta").isNotNull(), morphology.changed(F.col("function"), F.col("form"))).otherwise(F.array().cast("array<string>")))
    rows = rows.select("*", F.posexplode(F.concat(F.array("form"), "made")).alias("change", "__form")).drop("form", "made").withColumnRenamed("__form", "form")
    raised = F.when(F.col("probability") == "", "0").otherwise((F.col("probability").try_cast("int") + F.col("delta")).cast("string"))
    rows = rows.withColumn("probability", F.when(F.col("change") > 0, raised).otherwise(F.col("probability"))).withColumn("participle", F.when(F.col("change") == 0, F.col("participle"))).drop("delta")
    return morphology.with_reduced(rows.withColumn("wordclass", F.lit("verb")).withColumn("stage", F.lit(2)).withColumn("bt", F.lpad(F.col("nid").cast("string"), 6, "0")))


def participles(forms: DataFrame) -> DataFrame:
    """(nid, title, stem, prefix, wright, pspart, papart, adjective): the participles among the forms of conjugate, to be declined as adjectives.

    Only where the form's prefix and the word's are the same number (text counts as 0), as the stem is what follows the prefix.
    """
    rows = forms.where(F.col("participle").isNotNull() & (F.col("dup") == 0) & (S.leading_number(F.col("prefix")) == S.leading_number(F.col("word_prefix"))))
    at = F.expr("locate(prefix, form_parts)")
    rest = F.when(at > 0, F.expr("substring(form_parts, locate(prefix, form_parts) + length(prefix))")).otherwise(F.col("form_parts"))
    stem = S.materialize_form(rest)
    past = F.col("participle") == "past"
    return rows.select(
        "nid", S.materialize_form(F.concat("prefix", stem)).alias("title"), stem.alias("stem"), "prefix", "wright", (~past).cast("int").alias("pspart"), past.cast("int").alias("papart"),
        F.lit(1).alias("adjective"), "part_ord", "var", "block", "vowel_ord", "ord",
    )

"""Inflected forms: words joined with ending tables. Duplicates are data and are never removed.

Attribution: the paradigms and rules follow work under CC BY 4.0 on the generation of Old English word forms.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import spread, stored

# Endings of the noun paradigms. A step is `builder: function ending, ...`; 0 is no ending.
NOUN_ENDINGS = {
    "stān": "geminate: SgMaNo 0|geminate: SgMaAc 0|syncope: SgMaGe es|syncope: SgMaDa e|plural: PlMaNo as|plural_again: PlMaAc as|oblique: PlMaGe a|oblique: PlMaDa um",
    "cynn": "geminate: SgNeNo 0|geminate: SgNeAc 0|syncope: SgNeGe es|syncope: SgNeDa e|plural: PlNeNo as|plural_again: PlNeAc as|oblique: PlNeGe a|oblique: PlNeDa um",
    "word": "plain: SgNeNo 0, SgNeAc 0|short: SgNeGe es, SgNeDa e|plain: PlNeNo 0, PlNeAc 0|short: PlNeGe a, PlNeDa um",
    "hof": "geminate: SgNeNo 0, SgNeAc 0|short_e: SgNeGe es, SgNeDa e|drop_e: PlNeNo u, PlNeNo o|drop_e: PlNeAc u, PlNeAc o|short_e: PlNeGe a, PlNeDa um",
    "dæg": "plain: SgMaNo 0, SgMaAc 0, SgMaGe es, SgMaDa e|back: PlMaNo as, PlMaAc as, PlMaGe a, PlMaDa um",
    "fæt": "plain: SgNeNo 0, SgNeAc 0, SgNeGe es, SgNeDa e|back: PlNeNo u, PlNeNo o|back: PlNeAc u, PlNeAc o|back: PlNeGe a, PlNeDa um",
    "ár": "geminate: SgFeNo 0, SgFeAc e|short_u: SgFeGe e, SgFeDa e|plural_u: PlFeNo a, PlFeNo e|plural_u_again: PlFeAc a, PlFeAc e|short_u: PlFeGe a, PlFeGe na, PlFeGe ena|short_u: PlFeDa um",
    "strengu": "drop_u: SgFeNo u, SgFeNo o, SgFeAc e, SgFeAc u, SgFeAc o, SgFeGe e, SgFeGe u, SgFeGe o, SgFeDa e, SgFeDa u, SgFeDa o, PlFeNo e, PlFeNo u, PlFeNo o, PlFeAc e, PlFeAc u, PlFeAc o, PlFeGe a, PlFeDa um",
    "hand": "plain: SgFeNo 0, SgFeAc 0, SgFeGe a, SgFeDa a, PlFeNo a, PlFeAc a, PlFeGe a, PlFeDa um",
    "feld": "plain: SgMaNo 0, SgMaAc 0, SgMaGe a, SgMaDa a, PlMaNo a, PlMaAc a, PlMaGe a, PlMaGe um",
    "sunu": "drop_u: SgFeNo u, SgFeNo o, SgFeAc u, SgFeAc o, SgFeGe a, SgFeDa a, PlFeNo a, PlFeAc a, PlFeGe a, PlFeDa um",
    "duru": "drop_u: SgMaNo u, SgMaNo o, SgMaAc u, SgMaAc o, SgMaGe a, SgMaDa a, PlMaNo a, PlMaAc a, PlMaGe a, PlMaGe um",
    "bearu": "drop_uw: SgMaNo u, SgMaAc u, SgMaNo o, SgMaAc o, SgMaGe wes, SgMaDa we, PlMaNo was, PlMaAc was, PlMaGe wa, PlMaDa wum",
    "bealu": "drop_uw: SgNeNo u, SgNeAc u, SgNeNo o, SgNeAc o, SgNeGe wes, SgNeDa we, PlNeNo u, PlNeAc u, PlNeNo o, PlNeAc o, PlNeGe wa, PlNeDa wum",
    "guma": "drop_a: SgMaNo a, SgMaAc an, SgMaGe an, SgMaDa an, PlMaNo an, PlMaAc an, PlMaGe ena, PlMaDa um",
    "fréa": "drop_a: SgMaNo a, SgMaAc an, SgMaGe an, SgMaDa an, PlMaNo an, PlMaAc an, PlMaGe ana, PlMaDa um, PlMaDa am, PlMaDa aum",
    "tunge": "drop_e: SgFeNo e, SgFeAc an, SgFeGe an, SgFeDa an, SgFeAc ean, SgFeGe ean, SgFeDa ean, PlFeNo an, PlFeAc an, PlFeNo ean, PlFeAc ean, PlFeGe ena, PlFeDa um, PlFeDa eum",
    "éage": "drop_e: SgNeNo e, SgNeAc an, SgNeGe an, SgNeDa an, SgNeAc ean, SgNeGe ean, SgNeDa ean, PlNeNo an, PlNeAc an, PlNeNo ean, PlNeAc ean, PlNeGe ena, PlNeDa um, PlNeDa eum",
    "wígend": "plain: SgMaNo 0, SgMaAc 0, SgMaGe es, SgMaDa e, PlMaNo 0, PlMaAc 0, PlMaNo e, PlMaAc e, PlMaNo as, PlMaAc as, PlMaGe ra",
}
#: Columns of the form table after the counter, and the order of a snapshot.
FORM_COLUMNS = "formi BT title stem form formParts var probability function wright paradigm paraID wordclass class1 class2 class3 comment".split()
CANONICAL = "BT wordclass function form formParts var title stem wright paradigm paraID class1 class2 class3 comment probability formi".split()
#: The stages of the whole table in their order.
STAGES = ("manual", "verb", "adjective", "adverb", "numeral", "noun")
#: Stems of the r-stem nouns, labelled by themselves where the caller asks for it.
R_STEM_NOUNS = ("fæder", "brōþor", "mōdor", "dōhtor", "sweostor")
WEAK = ("guma", "fréa", "tunge", "éage", "wígend")
# Labels by the section numbers of the grammar, first match counts.
NOUN_SECTIONS = [
    ("335|339|387|354|386|337|340|341|352", "stán"), ("356", "cynn"), ("343|349|348", "word"), ("344|350|357|393|358", "hof"), ("336", "dæg"), ("345", "fæt"),
    ("367|368|373|376|390|366|372|370|375|378", "ár"), ("383", "strengu"), ("397", "feld"), ("398", "hand;duru"), ("396", "sunu"), ("359|360", "bearu"), ("362|363", "bealu"),
    ("380|381", "beadu"), ("401", "guma"), ("402", "fréa"), ("404", "tunge"), ("405", "béo"), ("407", "éage"), ("418", "wígend"),
]
ADJECTIVE_SECTIONS = [("426", "blind"), ("428", "héah"), ("430", "manig"), ("431", "hálig"), ("434", "wilde"), ("436", "gearu"), ("437", "blind")]
# Ordered changes of second person forms; adverb endings with their probabilities.
SECOND_PERSON = [("dst", "tst"), ("þst", "tst"), ("tst", "st"), ("ngst", "ncst"), ("ncst", "nst"), ("gst", "hst"), ("hst", "xst")]
THIRD_PERSON = [("[td]þ$", "tt"), ("[dt]t$", "t"), ("þþ", "þ"), ("þ$", "t"), ("sþ$", "st"), ("ngþ$", "ncþ"), ("gþ$", "hþ")]
PAST_PARTICIPLE = [("ted$", "tt"), ("tt$", "t")]
ADVERB = [("Po", "0", "0", False), ("Co", "or", "0", True), ("Co", "ur", "1", True), ("Co", "ar", "2", True), ("Su", "ost", "0", True), ("Su", "ust", "1", True), ("Su", "ast", "2", True), ("Su", "st", "2", True)]
IRREGULAR_ADVERBS = ["wel", "yfele", "micle", "lytel"]


def _some(*alternatives: Column) -> Column:
    """The first stem and the later ones that differ from it; empty stems drop out."""
    first = alternatives[0]
    return F.filter(F.array_compact(F.array(first, *[F.when(a != first, a) for a in alternatives[1:]])), lambda s: s != "")


def stem_builder(name: str, stem: Column) -> Column:
    """The stems that a step of a paradigm runs over."""
    twice = lambda s: F.regexp_replace(s, f"({S.CONSONANT})\\1$", "$1")
    short = lambda s: F.when(S.syllable_count(s) > 1, F.regexp_replace(s, f"{S.VOWEL}({S.CONSONANT})$", "$1")).otherwise(s)
    fronted = lambda s: F.regexp_replace(s, f"o({S.CONSONANT})$", "e$1")
    drop = lambda x: F.regexp_replace(stem, f"{x}$", "")
    bare = F.regexp_replace(drop("e"), "[hH]$", "")
    again = lambda stems: F.concat(stems, F.slice(stems, F.lit(2), F.greatest(F.size(stems) - 1, F.lit(0))))
    made = {
        "plain": lambda: _some(stem), "geminate": lambda: _some(stem, twice(stem)), "syncope": lambda: _some(bare, short(bare)), "plural": lambda: _some(bare, twice(bare), short(bare), fronted(bare)),
        "plural_again": lambda: again(_some(bare, twice(bare), short(bare), fronted(bare))), "oblique": lambda: _some(bare, short(bare), fronted(bare)), "short": lambda: _some(stem, short(stem)),
        "short_e": lambda: _some(drop("e"), short(drop("e"))), "short_u": lambda: _some(drop("u"), short(drop("u"))), "plural_u": lambda: _some(drop("u"), short(drop("u")), twice(drop("u"))),
        "plural_u_again": lambda: again(_some(drop("u"), short(drop("u")), twice(drop("u")))), "back": lambda: _some(stem, F.translate(stem, "æǣ", "aā")),
        "drop_e": lambda: _some(drop("e")), "drop_u": lambda: _some(drop("u")), "drop_a": lambda: _some(drop("a")), "drop_uw": lambda: _some(drop("[uw]")),
    }
    return made[name]()


def steps() -> list[tuple]:
    """The noun table: (name, step, builder, [(ord, function, ending)]), some eighty rows whatever the words."""
    rows = []
    for name, table in NOUN_ENDINGS.items():
        for k, step in enumerate(table.split("|")):
            builder, ends = step.split(": ")
            rows.append((name, k, builder, [(j, *e.split()) for j, e in enumerate(ends.split(", "))]))
    return rows


def with_reduced(forms: DataFrame) -> DataFrame:
    """Add formi, the plain form, and a second row with probability + 1 where a doubled consonant can be written once."""
    forms = forms.withColumn("formi", S.normalize_output(F.col("form")))
    forms = forms.withColumn("__reduced", F.regexp_replace("formi", f"({S.CONSONANT})\\1", "$1"))
    own = F.struct(F.lit(0).alias("dup"), F.col("formi").alias("formi"), F.col("probability").alias("probability"))
    second = F.struct(F.lit(1).alias("dup"), F.col("__reduced").alias("formi"), S.raise_probability(F.col("probability")).alias("probability"))
    rows = F.when(F.col("__reduced") != F.col("formi"), F.array(own, second)).otherwise(F.array(own))
    return forms.withColumn("row", F.explode(rows)).drop("formi", "probability", "__reduced").select("*", "row.*").drop("row")


def _finish(rows: DataFrame, stage: int, wordclass: str) -> DataFrame:
    parts = F.concat_ws("-", F.coalesce("prefix", F.lit("")), "s", "ending")
    rows = rows.withColumn("form_parts", parts).withColumn("form", S.materialize_form(F.col("form_parts"))).withColumn("wordclass", F.lit(wordclass)).withColumn("stage", F.lit(stage))
    return with_reduced(rows.withColumn("bt", F.lpad(F.col("nid").cast("string"), 6, "0"))).drop("s", "ending")


def noun_forms(words: DataFrame, compat: bool = True) -> DataFrame:
    """A row for each form of words (nid, title, stem, prefix, wright, paradigms array).

    With compat, labels are taken as the assigner writes them: `stán`, `beadu` and `béo` have no endings, and a
    word whose first label is `word` runs that table once more than it has labels for each label. Without, `stán` is `stān`.
    """
    rows = spread(words).select("nid", "title", "stem", F.coalesce(F.nullif("prefix", F.lit("")), F.lit("0")).alias("prefix"), "wright", "paradigms", F.posexplode("paradigms").alias("para_ord", "paradigm"))
    if not compat:
        rows = rows.withColumn("paradigm", F.when(F.col("paradigm") == "stán", "stān").otherwise(F.col("paradigm")))
    else:
        first = F.col("paradigms")[0].contains("word") & ~F.col("paradigm").rlike("stān|cynn")
        rows = rows.withColumn("copy", F.explode(F.when(first, F.sequence(F.lit(0), F.size("paradigms"))).otherwise(F.array(F.lit(0)))))
        rows = rows.withColumn("table", F.when(first, "word").otherwise(F.col("paradigm"))).withColumn("paradigm", F.when(first, F.coalesce(F.get("paradigms", F.col("copy")), F.lit(""))).otherwise(F.col("paradigm")))
    if "table" not in rows.columns:
        rows = rows.withColumn("copy", F.lit(0)).withColumn("table", F.col("paradigm"))
    name = F.lit(None).cast("string")
    for known in reversed(NOUN_ENDINGS):  # the first table whose name the label holds
        name = F.when(F.col("table").contains(known), known).otherwise(name)
    table = words.sparkSession.createDataFrame(steps(), "name string, step int, builder string, ends array<struct<ord: int, function: string, ending: string>>")
    class1 = F.when(F.col("table").isin(*WEAK), "weak").otherwise("strong").alias("class1")
    rows = rows.select("nid", "title", "stem", "prefix", "wright", "para_ord", "copy", "paradigm", class1, name.alias("name"))
    rows = rows.join(F.broadcast(table), "name")  # a table of fixed size
    stems = F.lit(None).cast("array<string>")
    for builder in sorted({b for _, _, b, _ in steps()}):
        stems = F.when(F.col("builder") == builder, stem_builder(builder, F.col("stem"))).otherwise(stems)
    rows = rows.select("*", F.posexplode(stems).alias("stem_ord", "s")).select("*", F.inline("ends")).drop("name", "builder", "ends")
    return _finish(rows.withColumn("probability", F.lit("")), 6, "noun")


def adverb_forms(words: DataFrame) -> DataFrame:
    """Positive, comparative and superlative of words (nid, title, stem, prefix, wright)."""
    cut = F.when(F.col("stem").isin(IRREGULAR_ADVERBS), F.col("stem")).otherwise(F.regexp_replace("stem", "[eE]$", ""))
    ends = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(f).alias("function"), F.lit(e).alias("ending"), F.lit(p).alias("probability"), (cut if c else F.col("stem")).alias("s")) for k, (f, e, p, c) in enumerate(ADVERB)])
    irregular = F.col("stem").isin(IRREGULAR_ADVERBS)
    rows = spread(words).select("nid", "title", "stem", "prefix", "wright", F.explode(ends).alias("e")).select("*", "e.*").drop("e").where(~irregular | (F.col("function") == "Po"))
    return _finish(rows, 4, "adverb")


def derived(form: Column, rules: list[tuple[str, str]], literal: bool = False) -> Column:
    """The forms after each rule that changes what the rules before have left."""
    made, now = F.array().cast("array<string>"), form
    steps = []
    for old, new in rules:
        after = F.replace(now, F.lit(old), F.lit(new)) if literal else F.regexp_replace(now, old, new)
        steps.append(F.when(after != now, after))
        now = after
    return F.array_compact(F.concat(made, F.array(*steps)))


def changed(function: Column, form: Column) -> Column:
    """What the ordered sound changes of a function make of a form, one after the other."""
    none = F.array().cast("array<string>")
    return F.when(function == "PsInSg2", derived(form, SECOND_PERSON, True)).when(function == "PsInSg3", derived(form, THIRD_PERSON)).when(function == "PaPt", derived(form, PAST_PARTICIPLE)).otherwise(none)


def sound_changes(forms: DataFrame, delta: int = 1) -> DataFrame:
    """Forms of (function, form, ...) and, after each, what the ordered sound changes derive from it, with `change` from 0.

    Where there is a probability, derived forms have `delta` more; an empty one becomes 0.
    """
    keep = [c for c in forms.columns if c not in ("form", "probability")]
    raised = F.when(F.coalesce("probability", F.lit("")) == "", "0").otherwise((F.col("probability").try_cast("int") + delta).cast("string")) if "probability" in forms.columns else None
    extra = [] if raised is None else ["probability"]
    rows = forms.select(*keep, *extra, F.posexplode(F.concat(F.array("form"), changed(F.col("function"), F.col("form")))).alias("change", "form"))
    return rows if raised is None else rows.withColumn("probability", F.when(F.col("change") > 0, raised).otherwise(F.col("probability")))


def section_token(wright: Column, token: str) -> Column:
    """Whether a list of section numbers between semicolons holds exactly this one."""
    return F.array_contains(F.split(F.coalesce(wright, F.lit("")), ";"), token)


def is_ge_collective(prefix: Column, title: Column) -> Column:
    return (prefix == "ge") & title.startswith("ge-")


def positional_pairs(nouns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add pair_stem: the stem of the dictionary row at the same place as the noun, both in order of nid."""
    left, right = numbered(nouns, ["nid"]), numbered(dictionary.select("nid", "stem"), ["nid"])
    return left.join(right.select("counter", F.col("stem").alias("pair_stem")), "counter", "left").drop("counter")


def propagate(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """Add paradigms to rows (nid, stem, own, shape, last: arrays or null) in the order of nid.

    Labelled words hand their first label to words of the same stem, then to words whose stem without prefix, or with
    y and i exchanged, is theirs; each word that gets one hands it on in the same pass. Then shapes label what is left,
    both passes run again, and `last` closes. Only stems that are equal after prefixes, y and ie are levelled can
    meet, so words are grouped by that and each group is walked alone; a group holds the variants of one stem.
    """
    level = lambda c: F.regexp_replace(F.regexp_replace(c, "y", "i"), "ie*", "i")
    known = "|".join(re.escape(re.sub("ie*", "i", p.replace("y", "i"))) for p in prefixes) or "0"
    rows = rows.withColumn("__group", F.regexp_replace(level(F.col("stem")), f"^(?:(?:{known})-?)+", ""))
    strip = re.compile(f"^({'|'.join(map(re.escape, prefixes)) or '0'})-?(.*)")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nid", kind="stable")
        nids, stems = pdf.nid.tolist(), pdf.stem.tolist()
        labels = [None if x is None else list(x) for x in pdf.own]
        first: dict[str, tuple[int, str]] = {}  # the earliest labelled word of each stem

        def hand_on(k: int) -> None:
            first.setdefault(stems[k], (len(first), labels[k][0]))

        for k, x in enumerate(labels):
            if x:
                hand_on(k)

        def passes() -> None:
            for near in (False, True):
                for k, x in enumerate(labels):
                    if x:
                        continue
                    some = [stems[k]]
                    if near:
                        bare = strip.sub(r"\2", stems[k])
                        i = bare.replace("y", "i")
                        some = [bare, i, bare.replace("i", "y"), i.replace("i", "ie")]
                    found = [first[c] for c in some if c in first]
                    if found:
                        labels[k] = [min(found)[1]]
                        hand_on(k)

        passes()
        for k, shape in enumerate(pdf["shape"]):
            if not labels[k] and shape is not None and len(shape):
                labels[k] = list(shape)
                hand_on(k)
        passes()
        for k, last in enumerate(pdf["last"]):
            if not labels[k]:
                labels[k] = [] if last is None else list(last)
        return pd.DataFrame({"nid": nids, "paradigms": labels})

    kind = dict(rows.dtypes)["nid"]
    found = rows.select("__group", "nid", "stem", "own", "shape", "last").groupBy("__group").applyInPandas(walk, f"nid {kind}, paradigms array<string>")
    return rows.drop("__group").join(found, "nid")


def noun_paradigms(words: DataFrame, prefixes: list[str] | None = None, r_stems: bool = False) -> DataFrame:
    """Add paradigms to words (nid unique, stem, wright, n_masc, n_fem, n_neut, n_uncert).

    By section number (with r_stems, r-stem nouns by their stem first), handed on over equal and similar stems, then by
    shape, handed on again, then by gender. With a column pair_stem (positional_pairs) syllables and stem length are
    those of that stem, as the rules pair nouns and dictionary rows by position.
    """
    found = None
    for pattern, label in NOUN_SECTIONS:
        labels = F.split(F.lit(label), ";")
        found = F.when(F.col("wright").rlike(pattern), labels) if found is None else found.when(F.col("wright").rlike(pattern), labels)
    if r_stems:  # a section 415 alone names no stem of the list and so no table
        found = F.when(F.col("stem").isin(*R_STEM_NOUNS), F.array("stem")).otherwise(found)
    stem, masc, fem, neut = F.col("stem"), F.col("n_masc") == 1, F.col("n_fem") == 1, F.col("n_neut") == 1
    pair = F.coalesce("pair_stem", "stem") if "pair_stem" in words.columns else stem
    vowel = F.regexp_extract("stem", f"^({S.VOWEL}?{S.VOWEL}?.*?)({S.VOWEL}{S.VOWEL}?)", 2)
    front = vowel.rlike("[æǽ]") & (S.syllable_count(pair) < 2)
    shape = F.array_compact(F.array(
        F.when(stem.endswith("a"), F.when(vowel.rlike(S.LONG_VOWEL), "fréa").otherwise("guma")),
        F.when(stem.endswith("e") & fem, "tunge"), F.when(stem.endswith("e") & masc, "stán"), F.when(stem.endswith("e") & neut, "hof"),
        F.when(stem.endswith("nd") & masc, "wígend"),
        F.when(stem.rlike("(els|scipe)$"), "stán"), F.when(stem.rlike("incel$"), "hof"), F.when(stem.rlike("(ness|niss|nyss|ung)$"), "ár"),
        F.when(front & masc, "dæg"), F.when(front & neut, "fæt"),
    ))
    gender = F.array_compact(F.array(F.when(masc | (F.col("n_uncert") == 1), "stán"), F.when(neut, F.when(S.stem_length(pair) == 1, "word").otherwise("hof")), F.when(fem, "ár")))
    rows = words.withColumns({"own": found, "shape": shape, "last": gender})
    return propagate(rows, prefixes or []).drop("own", "shape", "last")


def stage_rows(stages: dict[str, DataFrame]) -> DataFrame:
    """The forms of the stages in their fixed order as one table: stage_ord and the 17 columns, absent ones empty."""
    out = None
    for k, name in enumerate(STAGES):
        if name not in stages:
            continue
        rows = stages[name].withColumnsRenamed({"bt": "BT", "form_parts": "formParts", "para_id": "paraID"})
        rows = rows.select(F.lit(k + 1).alias("stage_ord"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in FORM_COLUMNS])
        out = rows if out is None else out.unionByName(rows)
    return out


def canonical_order(forms: DataFrame) -> DataFrame:
    """Rows sorted by all 17 columns: ranges of rows, sorted each, so that files in order are in order."""
    return forms.orderBy(*CANONICAL)


def first_words(words: DataFrame, n: int | None) -> DataFrame:
    """The first n words by nid, taken before anything is handed on between words."""
    return words if n is None else words.orderBy("nid").limit(n)


def manual_rows(manual: DataFrame) -> DataFrame:
    """Listed forms as rows of the first stage, with the reduced second row."""
    return with_reduced(manual.withColumn("BT", F.col("bt")).drop("bt").withColumnsRenamed({"form_parts": "formParts", "para_id": "paraID"}))


def adjective_paradigms(words: DataFrame) -> DataFrame:
    """Add paradigm: by section number, then as an earlier word of the same stem, then by suffix, syllables and stem length."""
    stem = F.col("stem")
    front = F.when(stem.rlike("[æÆ]|ea"), "glæd").otherwise("til")
    found = F.when(F.col("wright").contains("425"), front)
    for section, label in ADJECTIVE_SECTIONS:
        found = found.when(F.col("wright").contains(section), label)
    df = words.withColumn("own", F.when(stem.contains("þweorh"), "þweorh").otherwise(found))
    by_stem = df.where("own is not null").groupBy("stem").agg(F.min_by("own", "nid").alias("shared"))
    long, count = S.stem_length(stem) == 1, S.syllable_count(stem)
    shape = (
        F.when(stem.rlike("(sum|lic|líc|isc)$"), "til").when(stem.rlike("(cund|feald|fæst|léas|full|iht)$"), "blind").when(stem.rlike("(ihte|bǽre|ede|wende)$"), "wilde")
        .when((count < 2) & ~long, front).when((count < 2) & stem.rlike(f"{S.VOWEL}h$"), "héah").when((count < 2) & stem.rlike(f"{S.CONSONANT}h$"), "þweorh").when(count < 2, "blind")
        .when(stem.rlike("[uo]$"), "gearu").when(stem.rlike("e$"), "wilde").when(long, "hálig").otherwise("manig")
    )
    df = df.join(by_stem, "stem", "left").withColumn("paradigm", F.coalesce("own", "shared", shape)).drop("own", "shared")
    return df.withColumn("numeral", F.when(stem.contains("feald"), 0).otherwise(F.col("numeral"))) if "numeral" in df.columns else df


def numbered(forms: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Add counter from 0 in the stated order, in each group of `within` if there are any: sorted ranges are counted, then the ranges' sums."""
    from pyspark.sql.window import Window

    keys = within or []
    # stored: ranges are sampled, and the sizes and the rows must come from the same ones
    ranged = stored(forms.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order))
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return ranged.withColumn("__i", inside).join(before, same).withColumn("counter", F.col("__before") + F.col("__i") - 1).drop("__p", "__q", "__i", "__before", *[f"__k_{k}" for k in keys])

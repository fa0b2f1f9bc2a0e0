"""Which paradigms a verb follows: phases of joins, each against what the phases before have settled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..storage import stored

FLAGS = ("vb_strong", "vb_weak", "vb_pretpres", "vb_anomalous", "vb_uncertain")


def _first_match(words: DataFrame, settled: DataFrame, keys: Column, own_key: Column, residual, new_stem: Column) -> DataFrame:
    """Words with a key equal to a settled word's: the paradigms of the one settled first."""
    known = settled.select(own_key.alias("k"), F.col("ids").alias("found"), F.col("phase").alias("p"), F.col("nid").alias("n"), *[F.col(f).alias(f"s_{f}") for f in FLAGS])
    left = words.withColumn("k", F.explode(F.array_distinct(keys)))
    joined = left.join(known, "k").where(residual)
    first = F.row_number().over(Window.partitionBy("nid").orderBy("p", "n"))
    return joined.withColumn("r", first).where("r = 1").withColumn("stem", new_stem).select(*words.columns, F.col("found").alias("ids"))


def heuristic_id(stem: Column) -> Column:
    """Paradigm by the shape of the stem: the vowel and what follows up to the next for strong verbs, the ending for weak ones."""
    v, c = S.VOWEL, S.CONSONANT
    before, vowel = F.regexp_extract(stem, f"^({v}*?.*?)({v}+)", 1), F.regexp_extract(stem, f"^({v}*?.*?)({v}+)", 2)
    after = F.regexp_extract(stem, f"^{v}*?.*?{v}+({c}.*?){v}", 1)
    one, two = F.length(after) == 1, F.length(after) == 2
    strong = (
        F.when(vowel.isin("í", "ý") & one, F.when(after.startswith("þ"), "2").when(after.startswith("s"), "3").otherwise("1")).when((vowel == "éo") & one, F.when(after.startswith("s"), "6").otherwise("5"))
        .when((vowel == "ú") & one, "9").when((vowel == "e") & after.rlike("^l."), "13").when((vowel == "e") & two, "16").when((vowel == "e") & after.rlike("^[rl]$"), "19")
        .when((vowel == "e") & after.rlike("^[ptcdgfsþ]$"), "22").when((vowel == "a") & one, "31").when((vowel == "eo") & after.rlike("^[rh]."), "14").when((before == "g") & (vowel == "ie") & two, "63")
        .when(vowel.isin("i", "y", "ie") & after.rlike("^[nm]."), "10").when((vowel == "á") & one, "40").when((vowel == "ó") & one, "48")
    )
    weak = (
        F.when(stem.rlike("(swarian|gadrian|timbrian)$"), "87").when(stem.rlike("(rian|rigan|rgan)$"), "73").when(stem.rlike(f"({v})({c}*)(ian|igan)$"), "87")
        .when(vowel.rlike("^[laeiyou]$") & after.rlike(f"^({c})\\1$"), F.when(stem.rlike("(fyllan|fillan)$"), "76").otherwise("74"))
    )
    return F.when(vowel != "", F.when(F.col("vb_strong") == 1, strong).when(F.col("vb_weak") == 1, weak))


def assign(verbs: DataFrame, paradigms: DataFrame, prefixes: list[str]) -> DataFrame:
    """verbs with ids (array, once for each match), phase and, where a prefix was found, a shorter stem.

    verbs: nid, stem, wright and the five class flags; paradigms: para_id, ord, title, type, wright. Phases: exemplar,
    same stem of the same strength, section numbers, same stem of any shared class, stem variants, shape, stems and
    variants without macrons, then 13 for strong and 76 for all other verbs. A word settled earlier counts first.
    """
    paradigms = paradigms.select("para_id", "ord", "title", "type", F.col("wright").alias("sections")).distinct()
    columns = verbs.columns
    named = F.array_sort(F.collect_list(F.struct("ord", "para_id")))

    def settle(found: DataFrame, phase: int) -> DataFrame:
        return found.select(*columns, "ids", F.lit(phase).alias("phase"))

    class_ = ((F.col("type") == "w") & (F.col("vb_weak") == 1)) | ((F.col("type") == "pp") & (F.col("vb_pretpres") == 1)) | ((F.col("type") == "a") & (F.col("vb_anomalous") == 1)) | ((F.col("type") == "s") & (F.col("vb_strong") == 1))
    shared = reduce(lambda a, f: a | (F.col(f) == F.col(f"s_{f}")), FLAGS[1:4], F.col("vb_strong") == F.col("s_vb_strong")) | (F.col("vb_uncertain") == 1)
    same = (F.col("vb_strong") == F.col("s_vb_strong")) | (F.col("vb_uncertain") == 1)
    bare = F.regexp_replace("stem", f"^(?:{'|'.join(prefixes) or '0'})-?", "")
    variants = lambda s: F.array(s, F.replace(s, F.lit("y"), F.lit("i")), F.replace(s, F.lit("i"), F.lit("y")), F.replace(F.replace(s, F.lit("y"), F.lit("i")), F.lit("i"), F.lit("ie")))
    plain, stem = S.remove_macrons, F.col("stem")

    def ids_of(joined: DataFrame) -> DataFrame:
        grouped = joined.groupBy("nid").agg(named.alias("ps")).select(F.col("nid").alias("of"), F.transform("ps", lambda p: p["para_id"]).alias("ids"))
        return verbs.join(grouped, F.col("nid") == F.col("of")).drop("of")

    def by_example(left):
        return ids_of(left.join(F.broadcast(paradigms), F.col("stem") == F.col("title")).where(class_))

    def by_section(left):
        times = F.explode(F.sequence(F.lit(1), F.regexp_count("wright", F.col("sections"))))
        hit = (F.col("sections") != "0") & ~F.col("wright").isin("NULL", "null") & F.rlike("wright", F.col("sections"))
        return ids_of(left.join(F.broadcast(paradigms), hit).select("nid", "ord", "para_id", times.alias("t")))

    def by_shape(left):
        known = paradigms.select(F.col("para_id").alias("h")).distinct()
        return left.withColumn("h", heuristic_id(stem)).join(F.broadcast(known), "h").select(*columns, F.array("h").alias("ids"))

    always = F.lit(True)
    phases = [
        lambda left, done: by_example(left), lambda left, done: _first_match(left, done, F.array(stem), stem, same, stem), lambda left, done: by_section(left),
        lambda left, done: _first_match(left, done, F.array(stem), stem, shared, stem), lambda left, done: _first_match(left, done, variants(bare), stem, shared, bare), lambda left, done: by_shape(left),
        lambda left, done: _first_match(left, done, F.array(plain(stem)), plain(stem), always, stem), lambda left, done: _first_match(left, done, variants(plain(bare)), plain(stem), always, bare),
    ]
    done, left = None, verbs
    for k, phase in enumerate(phases):
        found = settle(phase(left, done), k)
        done = stored(found if done is None else done.unionByName(found))  # every later phase reads it
        left = left.join(done.select("nid"), "nid", "left_anti").select(*columns)
    last = F.when(F.col("vb_strong") == 1, "13").otherwise("76")
    return done.unionByName(settle(left.withColumn("ids", F.array(last)), len(phases)))

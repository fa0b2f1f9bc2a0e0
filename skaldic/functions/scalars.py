"""Scalar functions over Old English text as Spark columns: everything here stays in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the language.
MACRONS = "ǣǢāĀēĒīĪȳȲōŌūŪ"
PLAIN = "æÆaAeEiIyYoOuU"
ACUTES = "áéíóúýǽÁÉÍÓÚÝǼ"
ACUTE_MACRONS = "āēīōūȳǣĀĒĪŌŪȲǢ"
VOWEL = "[æaeiyouœÆAEIYOUŒǣāēīȳōūǢĀĒĪȲŌŪ]"
LONG_VOWEL = "[ǣāēīȳōūǢĀĒĪȲŌŪ]"
CONSONANT = "[^æaeiyouÆAEIYOUǣāēīȳōūǢĀĒĪȲŌŪ]"
FRONT = "īiēeǣæȳy"
BACK = "aāoōuū"
#: Words whose g or c does not follow the rules.
G_HARD_INITIAL = "gǣl gǣf gǣfon gǣlscipe gǣng gǣnge gǣr gǣrlicgǣst gǣstas gǣsthus gǣstlic gǣstlīce gǣt gǣten gaf gafol gafolrǣden gafolgyld galan gangan gār gāt gēar gēara gēoguð geōguþ gēn gēna gēola gēol gēomor gēong gēongra gēs gēsne gēsnian gēsting gēstlīc gēsthus gēat gēatlic gēard gēatas gēatland".split()
G_HARD_FINAL = "plǣg sweg tǣghrēg".split()
C_HARD = "cyning cemban cynn cyme cyll cyst cynd".split()
C_SOFT = "hwelc hwilc swelc swilc swylc ælc þylc".split()
#: I-mutation; the unmutated vowel keeps the second place, except for ea.
IUMLAUT = {
    "e": ["i", "e"], "o": ["e", "o"], "u": ["y", "u"], "æ": ["e", "æ"], "a": ["æ", "a", "e"], "ā": ["ǣ", "ā"], "ō": ["ē", "ō"], "ū": ["ȳ", "ū"],
    "ea": ["ea", "ie", "i"], "eo": ["ie", "eo"], "io": ["ie", "io", "i"], "ēa": ["īe", "ēa", "ī"], "ēo": ["īe", "ēo"], "īo": ["īe", "īo", "ī"],
}
ROMAN = {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}
MARKER = r"^\s*([\[\(]?[0-9]+[\]\.\)]?|[IVXLCDMivxlcdm]+[\]\.\)]?)(?:\s+|$)"
#: Lines end as in Unicode, \r\n counting once.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029"))


def _stripped() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and what is left of them without."""
    found = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if bare != chr(point) and len(bare) == 1 and chr(point).islower():
            found[chr(point)] = bare
    return "".join(found), "".join(found.values())


def normalize_old_english(c: Column) -> Column:
    """Key of a word: trimmed, lower case, ð as þ, without marks and without dashes between letters. Null stays null."""
    marked, bare = _stripped()
    plain = F.regexp_replace(F.translate(F.lower(strip(c)), marked + "ð", bare + "þ"), "\\p{Mn}", "")
    return F.regexp_replace(plain, "(?<=\\S)[-–—](?=\\S)", "")


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def case_like(source: Column, target: Column) -> Column:
    """target in the case of source: all capitals, a capital, or as it is."""
    first, rest = F.substring(source, 1, 1), F.substring(source, 2, 1 << 30)
    return (
        F.when(is_upper(source), F.upper(target))
        .when(is_upper(first) & (F.lower(rest) == rest) & (F.upper(rest) != rest), F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, 2, 1 << 30)))
        .otherwise(target)
    )


def _by_part(word: Column, rule) -> Column:
    return case_like(word, F.array_join(F.transform(F.split(F.lower(word), "-"), rule), "-"))


def palatalize_g(word: Column) -> Column:
    """ġ for g before or after front vowels: first letter, last letter, between two, then the first g left over."""

    def rule(x: Column) -> Column:
        x = F.when(x.isin(G_HARD_INITIAL), x).otherwise(F.regexp_replace(x, f"^g(?=[{FRONT}])", "ġ"))
        x = F.when(x.isin(G_HARD_FINAL), x).otherwise(F.regexp_replace(x, f"(?<=[{FRONT}])g$", "ġ"))
        x = F.regexp_replace(x, f"(?<=[{FRONT}])g(?=[{FRONT}])", "ġ")
        return F.regexp_replace(x, f"^([^g]*[{FRONT}])g", "$1ġ")

    return _by_part(word, rule)


def palatalize_c(word: Column) -> Column:
    """ċ for c before i, at the start before e or i, and after i or in unless a back vowel follows; two exception lists."""

    def rule(x: Column) -> Column:
        key = normalize_old_english(x)
        soft = F.regexp_replace(x, f"c(?=[iī])|^c(?=[eēiī])|(?<=[iī]n?)c(?![{BACK}])", "ċ")
        return F.when(key.isin(C_HARD), x).when(key.isin(C_SOFT), F.regexp_replace(soft, "c$", "ċ")).otherwise(soft)

    return F.when(normalize_old_english(word).isin(C_HARD) & ~word.contains("-"), word).otherwise(_by_part(word, rule))


def eth_to_thorn(c: Column) -> Column:
    return F.coalesce(F.translate(c, "ðÐkK", "þÞcc"), F.lit(""))


def remove_macrons(c: Column) -> Column:
    return F.coalesce(F.translate(c, MACRONS, PLAIN), F.lit(""))


def move_accents(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("eó"), F.lit("ēo")), F.lit("eá"), F.lit("ēa")), F.lit("ié"), F.lit("īe"))


def acute_to_macron(c: Column) -> Column:
    return F.translate(c, ACUTES, ACUTE_MACRONS)


def i_mutation(vowel: Column) -> Column:
    """[mutated, unmutated, sometimes a third]; an unknown vowel twice."""
    known = F.create_map(*[x for k, v in IUMLAUT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(known, vowel), F.array(vowel, vowel))


def stem_length(stem: Column) -> Column:
    """1 for a long stem: long vowel, two consonants after the first vowels, or a closing consonant (sc, cg count once)."""
    pattern = f"^.*?({VOWEL}{VOWEL}?)({CONSONANT}*)(.*)"
    vowels, after, rest = (F.regexp_extract(stem, pattern, k) for k in (1, 2, 3))
    after = F.length(F.replace(F.replace(after, F.lit("sc"), F.lit("s")), F.lit("cg"), F.lit("c")))
    return F.when(vowels == "", 0).when(vowels.rlike(LONG_VOWEL) | (after > 1) | ((rest == "") & (after > 0)), 1).otherwise(0)


def syllable_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"{VOWEL}{CONSONANT}")) + F.regexp_count(c, F.lit(f"{VOWEL}$")), F.lit(0))


def normalize_output(c: Column) -> Column:
    marked, bare = _stripped()
    short = F.regexp_replace(F.regexp_replace(c, "y|ie?", "i"), "ȳ|īe", "ī")
    return F.coalesce(F.regexp_replace(F.translate(short, marked + MACRONS, bare + PLAIN), "\\p{Mn}", ""), F.lit(""))


def roman_value(c: Column) -> Column:
    """Subtractive Roman number; other characters are passed over, none gives 0."""
    digits = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    n = F.filter(F.transform(F.split(F.lower(c), ""), lambda x: F.element_at(digits, x)), lambda x: x.isNotNull())
    following = F.concat(F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0))), F.array(F.lit(0)))
    return F.aggregate(F.zip_with(n, following, lambda a, b: F.when(a >= b, a).otherwise(-a)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def is_roman(c: Column) -> Column:
    return c.rlike("^[IVXLCDMivxlcdm]+\\z")


def marker(text: Column) -> Column:
    """The number a text starts with, without brackets; null if there is none. Words like `ic` and `mid` count as one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, MARKER, 1), "^[\\[\\]().]+|[\\[\\]().]+$", ""), F.lit(""))


def without_marker(text: Column) -> Column:
    return F.regexp_replace(text, MARKER, "")


def marker_number(m: Column) -> Column:
    return F.when(m.rlike("^[0-9]+\\z"), m.try_cast("int")).when(is_roman(m), roman_value(m))


def is_heading(line: Column) -> Column:
    """Roman number, capitals only, chapter word or year."""
    t = strip(line)
    return (t != "") & (t.rlike("^[IVXLCDM]+\\.?(\\s+|$)") | t.rlike("^[A-ZÆÞÐ\\s\\-]{3,}\\.?\\z") | t.rlike("^(Cap\\.|CAP\\.|Chapter\\b|CHAPTER\\b)") | t.rlike("^(?:A\\.D\\.|AD)\\s*\\d{3,4}\\b") | t.rlike("^Her\\s+\\d{3,4}\\b"))


def is_heading_line(line: Column) -> Column:
    """The line splitter's rule: any three characters without lower case and digits count as capitals."""
    t = strip(line)
    caps = (F.length(t) >= 3) & (F.upper(t) == t) & ~t.rlike("[0-9]")
    return (t != "") & (t.rlike("^[IVXLCDM]+\\.?(\\s+|$)") | caps | t.rlike("^(Cap\\.|CAP\\.|Chapter\\b|CHAPTER\\b)") | t.rlike("^(?:A\\.D\\.|AD)\\s*\\d{3,4}\\b") | t.rlike("^Her\\s+\\d{3,4}\\b"))


def is_number_line(line: Column) -> Column:
    return strip(line).rlike("^[\\[(]?\\d+[\\])\\.]?\\z")


def is_verse_line(line: Column, longest: int = 80) -> Column:
    t = strip(line)
    short = line.startswith("    ") | (F.length(t) < 20)
    return (t != "") & ~is_heading_line(line) & ~is_number_line(line) & (F.length(t) <= longest) & (short | ~(t.endswith(".") & ~t.contains("  ")))


def block_kind(text: Column) -> Column:
    """verse for two lines or more of 60 characters or fewer on average, of which under four fifths end in a stop."""
    lines = F.filter(F.transform(F.split(text, LINE_END), lambda x: strip(x)), lambda x: x != "")
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    stops = F.size(F.filter(lines, lambda x: x.endswith(".")))
    return F.when((F.size(lines) >= 2) & (total <= 60 * F.size(lines)) & (stops < 0.8 * F.size(lines)), "verse").otherwise("prose")


def heading_number(t: Column) -> Column:
    t = strip(t)
    year = F.regexp_extract(t, "^(?:A\\.D\\.|AD)\\s*(\\d{3,4})\\b", 1)
    her = F.regexp_extract(t, "^Her\\s+(\\d{3,4})\\b", 1)
    roman = F.regexp_extract(t, "^([IVXLCDM]+)(?:\\.?\\s+.*|\\.?)$", 1)
    cap = F.regexp_extract(t, "^Cap\\.\\s*([IVXLCDM]+|\\d+)\\b", 1)
    return F.when(year != "", year.try_cast("int")).when(her != "", her.try_cast("int")).when(roman != "", roman_value(roman)).when(cap.rlike("^\\d+$"), cap.try_cast("int")).when(cap != "", roman_value(cap))


def heading_title(t: Column) -> Column:
    t = strip(t)
    after = F.regexp_extract(t, "^([IVXLCDM]+)\\.?\\s+(.*)$", 2)
    cap = F.regexp_extract(t, "^Cap\\.\\s*([IVXLCDM]+|\\d+)\\b\\s*(.*)$", 2)
    return (
        F.when(t.rlike("^(?:A\\.D\\.|AD)\\s*\\d{3,4}\\b|^Her\\s+\\d{3,4}\\b"), F.lit(None))
        .when(t.rlike("^[IVXLCDM]+\\.?\\s+"), strip(after)).when(t.rlike("^[IVXLCDM]+\\.?\\z"), F.lit(None))
        .when(t.rlike("^Cap\\.\\s*([IVXLCDM]+|\\d+)\\b"), F.nullif(cap, F.lit(""))).otherwise(F.regexp_replace(t, "\\.+$", ""))
    )


def speaker(text: Column) -> Column:
    """The speaker a block's first line with text names: `Name cwæð ...` or `Name:` alone."""
    first = F.get(F.filter(F.split(text, LINE_END), lambda x: strip(x) != ""), F.lit(0))
    said = F.regexp_extract(first, "(?iu)^\\s*([A-ZÆÞÐ][A-Za-zÆÞÐæþð\\-]+)\\s+(?:(?:and)?cwæ[ðþ]|andswarode|sæde|sprec)(?U:\\b)", 1)
    alone = F.regexp_extract(first, "^\\s*([A-ZÆÞÐ][A-Za-zÆÞÐæþð\\-]+)\\s*:\\s*$", 1)
    return F.coalesce(F.nullif(said, F.lit("")), F.nullif(alone, F.lit("")))


def sentences(text: Column) -> Column:
    """Parts that end in . ? or ! (with a closing quote or bracket) before white space; terminators stay."""
    parts = F.split(strip(text), "(?<=[.?!])\\s+|(?<=[.?!][\"')])\\s+")
    return F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != "")


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?U)\\s+", " "))


def degeminate(c: Column) -> Column:
    return F.regexp_replace(c, "(.)\\1", "$1")


def leading_number(c: Column) -> Column:
    """The number a text starts with, as a double; 0 if none."""
    return F.coalesce(F.regexp_extract(c, "^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)", 1).try_cast("double"), F.lit(0.0))


def empty_if_zero(c: Column) -> Column:
    return F.when(c.isNull() | (c == "0"), "").otherwise(c)


def without_prefix(title: Column) -> Column:
    """What follows the last hyphen or blank."""
    return F.regexp_replace(title, "^.*[\\- ]", "")


def stem_variants(stem: Column, prefixes: list[str]) -> Column:
    """Without prefix, with y as i, with i as y, and the second with i as ie."""
    bare = F.regexp_replace(stem, f"^(?:{'|'.join(prefixes) or '0'})", "")
    second = F.replace(bare, F.lit("y"), F.lit("i"))
    return F.array(bare, second, F.replace(bare, F.lit("i"), F.lit("y")), F.replace(second, F.lit("i"), F.lit("ie")))


def assemble(*parts: Column) -> Column:
    return F.concat_ws("-", *[F.coalesce(p, F.lit("")) for p in parts])


def materialize_form(parts: Column) -> Column:
    return F.translate(parts, "0-\n", "")


def raise_probability(c: Column, by: int = 1, default: int = 0) -> Column:
    return (F.coalesce(F.nullif(c, F.lit("")).try_cast("int"), F.lit(default)) + by).cast("string")


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered substitutions, each on the result of the one before; \\1 in replacements is group 1."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1].replace("\\", "$")), rules, text)


def backoff_seconds(base: Column, attempt: Column, most: float = 5.0) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def page_text(c: Column) -> Column:
    """OCR text before scoring: line ends trimmed, at most two blank lines in a row, one closing line end."""
    trimmed = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "[ \\t\\x0b\\f\\r]+(?=\n|$)", "")
    return F.concat(F.regexp_replace(F.regexp_replace(trimmed, "\n{4,}", "\n\n\n"), "^\\s+|\\s+$", ""), F.lit("\n"))

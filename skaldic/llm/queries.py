"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_extract, langid, line_dedup, packing, quality, rules, simhash, suffix_dedup
from .common import read


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), word_bpe())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    return rules.judge(read(spark, sf_dir, "documents"), trusted)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", "text")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents")).drop("spans")


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(read(spark, sf_dir, "conversations"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontaminate": op2_decontaminate,
    "op3_html_text": op3_html_text,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat_perspectives": op5_chat_perspectives,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
}

#: Runs of four equal tokens find every overlap of items of 8 tokens or more: 13 tokens with 2 substitutions hold one, as do 8 with 1. Shorter items match as a whole.
_OVERLAPS = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - 3)) AS p FROM d WHERE len(w) >= 4),
bp AS (SELECT item_id, w, unnest(range(0, len(w) - 3)) AS p FROM b WHERE len(w) >= 8),
dg AS (SELECT doc_id, p, w[p + 1] AS t1, w[p + 2] AS t2, w[p + 3] AS t3, w[p + 4] AS t4 FROM dp),
bg AS (SELECT item_id, p, w[p + 1] AS t1, w[p + 2] AS t2, w[p + 3] AS t3, w[p + 4] AS t4 FROM bp),
short AS (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND 7),
ds AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, short WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, item_id, dg.p - bg.p AS diag FROM dg JOIN bg USING (t1, t2, t3, t4)
  UNION SELECT doc_id, item_id, p FROM ds JOIN b ON len(b.w) = n AND ds.w[p + 1 : p + n] = b.w),
cells AS (SELECT doc_id, item_id, diag, len(b.w) AS n, unnest(range(0, len(b.w))) AS k, b.w AS bw, d.w AS dw FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
same AS (SELECT doc_id, item_id, diag, n, k, (diag + k >= 0 AND diag + k < len(dw) AND bw[k + 1] = dw[diag + k + 1])::INT AS s FROM cells),
runs AS (SELECT doc_id, item_id, diag, n, k, sum(s) OVER (PARTITION BY doc_id, item_id, diag ORDER BY k ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS m FROM same),
found AS (SELECT doc_id, item_id, diag FROM runs GROUP BY doc_id, item_id, diag, n
  HAVING (n >= 13 AND max(CASE WHEN k >= 12 THEN m END) >= 11) OR (n < 13 AND max(CASE WHEN k = n - 1 THEN m END) >= CASE WHEN n < 8 THEN n ELSE n - 1 END)),
per AS (SELECT doc_id, count(*) AS n_overlaps, list_sort(list(DISTINCT item_id)) AS items FROM found GROUP BY doc_id)
SELECT doc_id, per.doc_id IS NOT NULL AS contaminated, coalesce(n_overlaps, 0) AS n_overlaps, coalesce(array_to_string(items, ','), '') AS items
FROM documents LEFT JOIN per USING (doc_id)"""

_LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
h AS (SELECT doc_id, l, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT % 2147483647) AS h FROM d),
r AS (SELECT doc_id, l, list_transform(range(1, len(l)), lambda i: (h[i] * 31 + h[i + 1]) % 2147483647) AS r FROM h),
e AS (SELECT doc_id, l, list_transform(list_filter(range(2, len(r)), lambda j: r[j] < r[j - 1] AND r[j] < r[j + 1]), lambda j: j + 1) AS e FROM r),
c AS (SELECT doc_id, l, list_concat([1], list_transform(e, lambda x: x + 1)) AS s, list_concat(e, [len(l)]) AS e FROM e),
i AS (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM c),
chunks AS (SELECT doc_id, s[i] AS a, e[i] AS b, array_to_string(l[s[i]:e[i]], chr(10)) AS body,
  CASE WHEN i = 1 THEN [] ELSE list_reverse(l[greatest(1, s[i - 1] - 2):s[i] - 1]) END AS before, CASE WHEN i = len(e) THEN [] ELSE l[e[i] + 1:e[i + 1]] END AS after FROM i),
placed AS (SELECT *, row_number() OVER w AS nth, first_value(before) OVER w AS before0, first_value(after) OVER w AS after0 FROM chunks
  WHERE b > a AND trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' WINDOW w AS (PARTITION BY body ORDER BY doc_id, a)),
later AS (SELECT doc_id, a,
  a - len(list_filter(range(1, least(len(before), len(before0)) + 1), lambda k: before[1:k] = before0[1:k])) AS low,
  b + len(list_filter(range(1, least(len(after), len(after0)) + 1), lambda k: after[1:k] = after0[1:k])) AS high FROM placed WHERE nth > 1),
gone AS (SELECT doc_id, count(DISTINCT a) AS chunks, list_distinct(flatten(list(range(low, high + 1)))) AS gone FROM later GROUP BY doc_id)
SELECT doc_id, len(l)::INT AS n_lines, len(e)::INT AS n_chunks, coalesce(chunks, 0)::INT AS n_removed_chunks, coalesce(len(gone), 0)::INT AS n_removed_lines,
  CASE WHEN gone IS NULL THEN array_to_string(l, chr(10)) ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda k: NOT list_contains(gone, k)), lambda k: l[k]), chr(10)), '') END AS text
FROM c LEFT JOIN gone USING (doc_id)"""

_PERSPECTIVES = """
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
h AS (SELECT conv_id, perspective, turn, role, text, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head FROM r JOIN p USING (conv_id)),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
w AS (SELECT *, (sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, segment ROWS UNBOUNDED PRECEDING))::BIGINT AS e,
  row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, segment) - 1 AS position FROM s)
SELECT conv_id, perspective, position, turn, role, segment, e - length(segment) AS start, e AS "end",
  CASE WHEN role = perspective THEN e - length(segment) + length(head) ELSE e END AS loss_start, CASE WHEN role = perspective THEN e - 1 ELSE e END AS loss_end
FROM w"""

SQL: dict[str, str] = {
    "op5_chat_perspectives": _PERSPECTIVES,
    "op2_decontaminate": _OVERLAPS,
    "op10_line_dedup": _LINE_DEDUP,
}

"""Requests to and answers from a text model, as columns: no call is made here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

PART = "struct<type:string,text:string,image_url:struct<url:string>>"


def whole_number(c: Column) -> Column:
    """A JSON value as a whole number that is not negative: numbers, whole floats and digits in quotes; else null."""
    n = F.regexp_extract(F.trim(c), "^\\+?(\\d+)(?:\\.0+)?$", 1).try_cast("long")
    return n


def summary(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """Counts and settings of chat requests (JSON), without their texts."""
    field = lambda path: F.get_json_object(payload, path)
    messages = F.from_json(field("$.messages"), "array<struct<content:string>>")
    contents = F.transform(messages, lambda m: m["content"])
    parts = F.flatten(F.transform(F.filter(contents, lambda c: c.startswith("[")), lambda c: F.from_json(c, f"array<{PART}>")))
    texts = F.size(F.filter(contents, lambda c: ~c.startswith("["))) + F.size(F.filter(parts, lambda p: p["type"] == "text"))
    images = F.filter(parts, lambda p: p["type"] == "image_url")
    chars = F.aggregate(images, F.lit(0), lambda a, p: a + F.coalesce(F.length(p["image_url"]["url"]), F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = requests.withColumns({k: field(f"$.{k}") for k in ("model", "max_tokens", "max_completion_tokens", "temperature", "top_p")})
    return out.withColumns({"message_count": zero(F.when(messages.isNotNull(), F.size(messages))), "text_segments": zero(F.when(messages.isNotNull(), texts)), "image_segments": zero(F.when(messages.isNotNull(), F.size(images))), "image_url_total_chars": zero(chars)})


def clamp(requests: DataFrame, cap: int, both: bool = False, temperature: float | None = None, top_p: float | None = None) -> DataFrame:
    """Requests (max_tokens, max_completion_tokens, temperature, top_p as JSON text) with limits applied, and notes on what changed."""
    old = {c: whole_number(F.col(c)) for c in ("max_tokens", "max_completion_tokens")}
    missing = old["max_tokens"].isNull() & old["max_completion_tokens"].isNull()
    new = {c: F.when(v.isNotNull(), F.least(v, F.lit(cap))) for c, v in old.items()}
    notes = [F.when(v > cap, F.format_string(f"clamped {c} %d -> {cap}", v)) for c, v in old.items()]
    notes.append(F.when(missing, f"set max_tokens to cap {cap} (field missing)"))
    new["max_tokens"] = F.when(missing, F.lit(cap)).otherwise(new["max_tokens"])
    if both:
        least = F.least(F.lit(cap), new["max_tokens"], new["max_completion_tokens"])
        new = dict.fromkeys(new, least)
        notes.append(F.format_string("synchronized max_tokens and max_completion_tokens to %d", least))
    for c, value in (("temperature", temperature), ("top_p", top_p)):
        if value is not None:
            notes.append(F.when(~F.coalesce(F.col(c).try_cast("double") == value, F.lit(False)), F.concat(F.lit(f"overrode {c} "), F.coalesce(c, F.lit("None")), F.lit(f" -> {value}"))))
            new[c] = F.lit(value)
    kept = [F.col(c) for c in requests.columns if c not in new]
    return requests.select(*kept, *[v.cast("double" if c in ("temperature", "top_p") else "long").alias(c) for c, v in new.items()], F.array_compact(F.array(*notes)).alias("notes"))


def good_enough(content: Column, chars: int, lines: int) -> Column:
    """Front matter of `key: value` lines between --- lines, then a body of so many characters or lines with text."""
    shape = "(?s)^---\n(.*?)\n---\n(.*)$"
    head, body = F.regexp_extract(content, shape, 1), S.strip(F.regexp_extract(content, shape, 2))
    mapping = F.size(F.filter(F.split(head, "\n"), lambda x: x.rlike("^[^\\s:#\\-\\[{][^:]*:(\\s|$)"))) > 0
    clean = F.forall(F.split(head, "\n"), lambda x: x.rlike("^(\\s.*|#.*|-.*|[^\\s:#][^:]*:(\\s.*)?|)$"))
    written = F.size(F.filter(F.split(body, S.LINE_END), lambda x: S.strip(x) != ""))
    return content.rlike("(?s)^---\n.*?\n---\n") & mapping & clean & ((F.length(body) >= chars) | (written >= lines))


def finish_reason(reason: Column, content: Column, chars: int, lines: int, override: bool = True) -> Column:
    """stop for length where the answer is good enough."""
    return F.when(F.lit(override) & (reason == "length") & F.coalesce(good_enough(content, chars, lines), F.lit(False)), "stop").otherwise(reason)


def verse_repair(chunks: DataFrame) -> DataFrame:
    """Rows (chunk_id, line number, text, speaker) for verse chunks (chunk_id, kind, source, paragraphs, speaker) that came back as paragraphs."""
    bad = chunks.where((F.col("kind") == "verse") & (F.size("paragraphs") > 0))
    rows = bad.select("chunk_id", "speaker", F.posexplode(F.split("source", S.LINE_END)).alias("p", "line")).where(S.strip(F.col("line")) != "")
    return rows.select("chunk_id", (F.col("p") + 1).alias("number"), F.rtrim("line").alias("text"), "speaker")


def prompts(chunks: DataFrame, table: DataFrame) -> DataFrame:
    """Add prompt: the model family's, the general and the mode's text of table (family, mode, model_prompt, general, mode_prompt)."""
    joined = chunks.join(F.broadcast(table), ["family", "mode"], "left")
    return joined.withColumn("prompt", F.concat_ws("\n\n", "model_prompt", "general", "mode_prompt")).drop("model_prompt", "general", "mode_prompt")


def realign(pairs: DataFrame) -> DataFrame:
    """Add aligned: the stretch of raw that equals text but for white space, with the white space around it; text if there is none."""
    pattern = F.concat(F.lit("(?s)(\\s*"), F.array_join(F.transform(F.filter(F.split(F.regexp_replace("text", "\\s+", ""), ""), lambda c: c != ""), lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("")), F.lit("\\E"))), "\\s*"), F.lit("\\s*)"))
    found = F.regexp_substr("raw", pattern)
    return pairs.withColumn("aligned", F.when((S.strip(F.col("text")) == "") | found.isNull(), F.col("text")).otherwise(found))

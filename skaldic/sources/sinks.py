"""Writers: form rows, snapshots, indexes, restored texts and their reports, documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.morphology import FORM_COLUMNS, canonical_order, numbered


def write_forms(forms: DataFrame, path: str, order: list[str]) -> None:
    """Form rows as tab-separated text of 18 columns, the counter from 0 first; `order` says how they are counted."""
    rows = numbered(forms, order)
    value = F.concat_ws("\t", *[F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\n", "  ") for c in ("counter", *FORM_COLUMNS)])
    rows.select("counter", value.alias("value")).repartitionByRange("counter").sortWithinPartitions("counter").select("value").write.text(path)


def write_snapshot(forms: DataFrame, path: str, update: bool = False) -> None:
    """Form rows without the counter, in canonical order, as gzipped JSON lines with sorted keys; an old snapshot is an error unless `update`."""
    rows = forms.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(FORM_COLUMNS)])
    canonical_order(rows).write.mode("overwrite" if update else "errorifexists").option("ignoreNullFields", "false").json(path, compression="gzip")


def index_document(index: DataFrame, completed: DataFrame | None = None, meta: dict[str, str] | None = None) -> DataFrame:
    """(value): the index as one JSON document with maps unique and ambiguous, sorted completed keys and counts, as macron_index reads it.

    One row, as the file format has it: for indexes of a dictionary's size, not for a corpus.
    """
    single, many = ~F.col("is_ambiguous"), F.col("is_ambiguous")
    entries = index.agg(
        F.array_sort(F.collect_list(F.when(single, F.struct("key", F.col("forms")[0].alias("form"))))).alias("u"),
        F.array_sort(F.collect_list(F.when(many, F.struct("key", "forms")))).alias("a"),
    )
    keys = index.sparkSession.createDataFrame([], "key string") if completed is None else completed
    done = keys.join(index.where("is_ambiguous"), "key", "left_semi").agg(F.array_sort(F.collect_set("key")).alias("ambiguous_completed"))
    said = F.create_map(*[F.lit(x) for kv in (meta or {}).items() for x in kv]) if meta else F.create_map().cast("map<string,string>")
    counts = F.map_concat(said, F.create_map(F.lit("unique_count"), F.size("u").cast("string"), F.lit("ambiguous_count"), F.size("a").cast("string")))
    whole = F.struct(counts.alias("meta"), F.map_from_entries("u").alias("unique"), F.map_from_entries("a").alias("ambiguous"), "ambiguous_completed")
    return entries.crossJoin(done).select(F.to_json(whole).alias("value"))  # one row each


def write_index(index: DataFrame, path: str, completed: DataFrame | None = None, meta: dict[str, str] | None = None) -> None:
    """index_document as text; the commit protocol makes the write whole or nothing."""
    index_document(index, completed, meta).coalesce(1).write.mode("overwrite").text(path)


def restored_paths(path: str) -> dict[str, str]:
    """Where the three results of restoring go, from the source's path."""
    stem, dot, suffix = path.rpartition(".")
    stem, suffix = (stem, dot + suffix) if dot and "/" not in suffix else (path, "")
    return {"text": f"{stem}.fixed{suffix}", "ambiguities": f"{stem}.anomalies.json", "unknowns": f"{stem}.unknown.json"}


def write_restored(texts: DataFrame, tokens: DataFrame, path: str) -> dict[str, str]:
    """Restored texts (text), and the looked-up tokens with options, or unknown, as JSON lines, under restored_paths."""
    at = restored_paths(path)
    texts.select("text").write.text(at["text"], lineSep="\n")
    places = [c for c in ("doc_id", "line_number", "word_number", "word", "key") if c in tokens.columns]
    tokens.where("options is not null").select(*places, "options").write.json(at["ambiguities"])
    tokens.where("is_unknown").select(*places).write.json(at["unknowns"])
    return at


def unknown_table(counts: DataFrame) -> DataFrame:
    """(value): a header and `token, n` by falling frequency, ties by first_seen, as numbered lines (place)."""
    rows = numbered(counts.withColumn("down", -F.col("n")), ["down", "first_seen"])
    lines = rows.select((F.col("counter") + 1).alias("place"), F.concat_ws("\t", "token", F.col("n").cast("string")).alias("value"))
    return lines.unionByName(counts.sparkSession.createDataFrame([(0, "token\tcount")], "place long, value string"))


def write_unknown(counts: DataFrame, path: str) -> None:
    unknown_table(counts).repartitionByRange("place").sortWithinPartitions("place").select("value").write.text(path)


def document_json(sections: DataFrame, metadata: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, value): each document as JSON, its sections in order with their blocks; metadata is one row for each document."""
    blocks = sections.groupBy(key, "section_ix").agg(
        F.first("title", ignorenulls=True).alias("title"), F.first("number", ignorenulls=True).alias("number"), F.first("speaker", ignorenulls=True).alias("speaker"), F.first("kind").alias("kind"),
        F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "text"))), lambda b: b["text"]).alias("blocks"),
    )
    whole = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_ix", "title", "number", "speaker", "kind", "blocks"))).alias("sections"))
    named = metadata.select(key, F.struct(*[c for c in metadata.columns if c != key]).alias("metadata"))
    return named.join(whole, key, "left").select(key, F.to_json(F.struct("metadata", F.coalesce("sections", F.array().cast(whole.schema["sections"].dataType)).alias("sections")), {"ignoreNullFields": "false"}).alias("value"))

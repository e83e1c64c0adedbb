"""Sinks: spreadsheet-safe CSV, JSON records, event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import text


def csv_rows(rows: DataFrame) -> DataFrame:
    """Every column as text, cells that a spreadsheet would run quoted; arrays joined by |, maps as JSON."""
    out = []
    for f in rows.schema.fields:
        kind = f.dataType.simpleString()
        col = F.col(f"`{f.name}`")
        cell = F.array_join(col.cast("array<string>"), "|") if kind.startswith("array<") and "struct" not in kind else F.to_json(col) if kind[:3] in ("map", "str") and kind != "string" else col.cast("string")
        out.append(text.spreadsheet_safe(cell).alias(f.name))
    return rows.select(*out)


#: Columns of an export, in their order (fixed values).
EXPORT_COLUMNS = [
    "query",
    "source",
    "source_type",
    "acquisition_mode",
    "acquisition_modes_seen",
    "indexed_public_web_coverage",
    "discovery_support",
    "discovery_engines",
    "evidence_completeness",
    "evidence_completeness_score",
    "author",
    "author_handle",
    "author_verified",
    "title",
    "text",
    "language",
    "hashtags",
    "mentions",
    "media_type",
    "like_count",
    "view_count",
    "comment_count",
    "share_count",
    "repost_count",
    "reaction_count",
    "publication_time",
    "fetch_time",
    "original_url",
    "final_score",
    "relevance",
    "freshness",
    "engagement",
    "social_reach",
    "source_confidence",
    "cross_source_presence",
    "duplicate_group",
    "cluster",
]
BOM = "\ufeff"


def iso(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")


def export_rows(items: DataFrame, query: str) -> DataFrame:
    """The export's columns of items found for a query; what items lack is null, further columns are left out."""
    made = {c: F.col(f"`{c}`") for c in items.columns} | {"query": F.lit(query)}
    return items.select(*(made.get(c, F.lit(None).cast("string")).alias(c) for c in EXPORT_COLUMNS))


def export_head(search: dict, analytics: DataFrame, version: str = "1.0") -> DataFrame:
    """The one line that goes with the records of a JSON export: schema, version, the search and its analytics (one row)."""
    asked = F.struct(*(F.lit(v).alias(k) for k, v in search.items()))
    return analytics.select(F.to_json(F.struct(F.lit("search-export").alias("schema"), F.lit(version).alias("version"), asked.alias("search"), F.struct(*analytics.columns).alias("analytics"))).alias("value"))


def write_export(rows: DataFrame, path: str) -> None:
    """CSV files with a header; each begins with a byte order mark, so a spreadsheet reads any of them as UTF-8."""
    first, *rest = rows.columns
    marked = csv_rows(rows).select(F.col(f"`{first}`").alias(BOM + first), *(f"`{c}`" for c in rest))
    marked.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    csv_rows(rows).write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def json_records(rows: DataFrame, version: str = "1.0") -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), F.struct(*rows.columns).alias("record"))).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    json_records(rows).write.mode("overwrite").text(path)


def event_frames(events: DataFrame) -> DataFrame:
    """id / event / data frames of server-sent events, from (sequence, event, data)."""
    return events.select(F.concat(F.lit("id: "), F.col("sequence").cast("string"), F.lit("\nevent: "), F.col("event"), F.lit("\ndata: "), F.coalesce(F.col("data"), F.lit("{}")), F.lit("\n\n")).alias("value"))

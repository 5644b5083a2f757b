"""JSON, time and identifier scalars of the thread tables and the chat client."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askorpus.schemas import SOURCE

_SOURCES_DDL = "array<struct<url:string,title:string,score:double>>"

# Accepted UUID form and the stored timestamp form.
UUID_PATTERN = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z")
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def parse_sources(text: Column) -> Column:
    """JSON list of sources; empty, null or not a list gives null."""
    is_list = F.startswith(F.ltrim(text), F.lit("["))
    return F.when(is_list, F.from_json(text, _SOURCES_DDL))


def encode_sources(sources: Column) -> Column:
    """Sources to JSON text, keeping null titles; null stays null."""
    return F.to_json(sources, {"ignoreNullFields": "false"})


def sources_payload(sources: Column) -> Column:
    """As sent to the client: no sources is an empty list."""
    return F.coalesce(encode_sources(sources), F.lit("[]"))


def empty_sources() -> Column:
    return F.array().cast(f"array<{SOURCE.simpleString()}>")


def one_source(url: Column, title: Column, score: Column) -> Column:
    return F.array(F.struct(
        url.alias("url"), title.alias("title"), score.cast("double").alias("score")))


def parse_time(text: Column) -> Column:
    """ISO text with or without a zone suffix; empty or malformed gives null.

    Text without a zone is UTC, as everything this module renders is.
    """
    trimmed = F.trim(text)
    zoned = F.when(F.rlike(trimmed, F.lit(r"([zZ]|[+-]\d{2}:?\d{2})$")), trimmed).otherwise(
        F.concat(trimmed, F.when(F.contains(trimmed, F.lit(":")), F.lit("Z"))
                 .otherwise(F.lit("T00:00:00Z"))))
    return F.try_to_timestamp(F.when(F.length(trimmed) > 0, zoned))


def render_time(ts: Column) -> Column:
    """UTC text, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), TIMESTAMP_FORMAT)


def uuid_or_null(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(UUID_PATTERN)), text)


def flatten_parts(parts: Column) -> Column:
    """Concatenate the text parts of array<struct<type,text>> content."""
    texts = F.transform(parts, lambda p: F.when(
        p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.lit("")))
    return F.coalesce(F.array_join(texts, ""), F.lit(""))

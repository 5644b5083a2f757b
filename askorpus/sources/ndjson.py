"""Model replies streamed as NDJSON: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askorpus.functions.text import strip

_LINE = "message struct<content:string>, done boolean"


def token_array(body: Column) -> Column:
    """Tokens of one reply in order. Lines that do not parse are skipped, and
    nothing after the line marked done is read."""
    lines = F.transform(F.split(body, "\n"), lambda ln: F.from_json(ln, _LINE))
    done_at = F.coalesce(
        F.nullif(F.array_position(
            F.transform(lines, lambda p: F.coalesce(p["done"], F.lit(False))), True), F.lit(0)),
        F.size(lines))
    tokens = F.transform(F.slice(lines, F.lit(1), done_at), lambda p: p["message"]["content"])
    return F.filter(tokens, lambda t: F.coalesce(F.length(t), F.lit(0)) > 0)


def explode_tokens(replies: DataFrame, body: str) -> DataFrame:
    """One row per token with its position."""
    kept = [c for c in replies.columns if c != body]
    return replies.select(*kept, F.posexplode(token_array(F.col(body))).alias("seq", "token"))


def full_text(body: Column) -> Column:
    """The whole reply, stripped."""
    return strip(F.array_join(token_array(body), ""))

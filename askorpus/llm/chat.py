r"""Chat formatting after collapsing cumulative snapshots, in DataFrame functions only.

A logged conversation is often saved after every turn, so that short copies are prefixes
of longer ones. Every turn gets a rolling hash of all turns up to it: the running sum of
hashes of (position, role, text), which needs no order inside a task and therefore splits
a long conversation over tasks. A conversation whose hash is that of a proper prefix of
another is removed by an anti-join, equal conversations leave the one with the smallest
id, and what remains is rendered.

Turns are ordered by turn (null first), ties by the MD5 of role and text. A rendered
conversation is a row for every ``TURNS_A_ROW`` turns, so no conversation has to fit in
one row; ``part`` counts them from 0.

Defined cases: rows without a conv_id belong to no conversation and are left out; a null
role or text counts as empty; a turn logged twice with the same turn, role and text is
one turn; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.llm.shared import Scratch, table, with_running_totals

TURNS_A_ROW = 256


def _hash40(part: int) -> Column:
    """Forty bits of the hash of position and content: sums of millions stay within a long."""
    digest = F.md5(F.concat_ws(".", F.col("idx").cast("string"), "content").cast("binary"))
    return F.conv(F.substring(digest, 1 + 10 * part, 10), 16, 10).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, content) with nulls filled; content identifies role and text."""
    return conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "content", F.md5(F.concat("role", F.lit("\x01"), "text").cast("binary")))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, content, idx, h1, h2): idx from 0, h1 and h2 over the turns up to this one."""
    bucket = F.coalesce(F.floor(F.col("turn") / TURNS_A_ROW), F.lit(-(1 << 60)))
    order = [F.col("turn").asc_nulls_first(), F.col("content")]
    rows = turns.select("conv_id", "turn", "content").distinct()
    rows = with_running_totals(rows, ["conv_id"], bucket, order, {"idx": F.lit(1)})
    rows = rows.withColumns({"own1": _hash40(0), "own2": _hash40(1)})
    rows = with_running_totals(rows, ["conv_id"], bucket, order,
                               {"before1": F.col("own1"), "before2": F.col("own2")})
    return rows.select("conv_id", "turn", "content", "idx", (F.col("before1") + F.col("own1")).alias("h1"),
                       (F.col("before2") + F.col("own2")).alias("h2"))


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that are no proper prefix of another."""
    whole = hashed.groupBy("conv_id").agg(
        F.max(F.struct("idx", "h1", "h2")).alias("last")).select("conv_id", "last.*")
    kept = whole.groupBy("idx", "h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    longer = (hashed.join(kept.select("conv_id", F.col("idx").alias("end")), "conv_id")
              .where("idx < end").select("idx", "h1", "h2").distinct())
    return kept.join(longer, ["idx", "h1", "h2"], "left_anti").select(
        "conv_id", (F.col("idx") + 1).alias("n_turns"), "copies")


def render(turns: DataFrame, hashed: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations as text: (conv_id, part, n_turns, copies, text)."""
    places = hashed.join(kept, "conv_id").select(
        "conv_id", "content", F.col("turn").alias("at"), "idx", "n_turns", "copies")
    rows = turns.join(places, ["conv_id", "content"]).where(F.col("turn").eqNullSafe(F.col("at")))
    groups = rows.groupBy("conv_id", F.floor(F.col("idx") / TURNS_A_ROW).alias("part")).agg(
        F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"),
        F.array_sort(F.collect_set(F.struct("idx", "role", "text"))).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n")))
    return groups.select("conv_id", "part", "n_turns", "copies", F.array_join(said, "").alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations, rendered."""
    turns = turns_of(conversations)
    hashed = Scratch(conversations.sparkSession, "chat").put(prefix_hashes(turns), "hashed")
    return render(turns, hashed, maximal(hashed))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                   md5(role || chr(1) || text)) - 1 AS idx FROM t),
s AS (SELECT conv_id, count(*) AS n, list(role || chr(1) || text ORDER BY idx) AS c FROM o GROUP BY conv_id),
w AS (SELECT c, min(conv_id) AS conv_id, count(*) AS copies, any_value(n) AS n_turns FROM s GROUP BY c),
p AS (SELECT DISTINCT c[1:i] AS c FROM s, unnest(range(1, n)) t(i)),
m AS (SELECT w.* FROM w ANTI JOIN p ON w.c = p.c)
SELECT o.conv_id, idx // 256 AS part, any_value(n_turns) AS n_turns, any_value(copies) AS copies,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY idx) AS text
FROM o JOIN m ON o.conv_id = m.conv_id GROUP BY o.conv_id, idx // 256
"""

QUERIES = {"op10_chat_format": op10_chat_format}
ORACLES = {"op10_chat_format": SQL}

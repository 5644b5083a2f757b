"""Conversation threads: listing, reading and changing them as table operations."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askorpus import schemas as sc
from askorpus.config import Settings
from askorpus.functions import text as tx
from askorpus.functions import urls
from askorpus.functions import values as vl
from askorpus.operators.ordering import first_per_key, top_n_per_key
from askorpus.operators.partitioning import narrow_to
from askorpus.plans.turns import answers
from askorpus.providers import ChatModel
from askorpus.sources.staging import staged
from askorpus.sources.store import Change, Store, Table

TABLES = {
    "threads": Table(sc.THREAD, "id"),
    "messages": Table(sc.MESSAGE, "id"),
}

# How much of a thread the title model sees, and the request.
TITLE_MESSAGES = 4
TITLE_MESSAGE_CHARS = 400
TITLE_REQUEST = (
    "Resume el tema principal de esta conversación en un título corto "
    "(máx. 6 palabras), en español:\n\n")


class NotFound(Exception):
    """The thread does not exist."""


class BadRequest(ValueError):
    """The request cannot be carried out as it is."""


# -- reading ---------------------------------------------------------------


def counted(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads with ``n_messages`` counted afresh, for tables that do not keep it.

    Messages are counted before the join, so a thread with a third of all messages
    is one row on that side.
    """
    counts = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("n_messages"))
    return threads.drop("n_messages").join(counts, "id", "left").withColumn(
        "n_messages", F.coalesce("n_messages", F.lit(0)))


def before(after: str) -> Column:
    """Rows that come after a cursor: 'created_at' or 'created_at|id'.

    The plain form skips threads created in the same instant, as it always did;
    the cursors this module hands out carry the id and skip nothing.
    """
    stamp, _, last_id = after.partition("|")
    at = vl.parse_time(F.lit(stamp))
    if not last_id:
        return F.col("created_at") < at
    return (F.col("created_at") < at) | (
        (F.col("created_at") == at) & (F.col("id") < F.lit(last_id)))


def list_threads(threads: DataFrame, after: str | None = None,
                 page_size: int = 30, include_archived: bool = True) -> DataFrame:
    """One page, newest first: (id, title, archived, created_at, rank, next_cursor).

    Threads without a message are not shown; how many they have is kept on the thread row
    and added to by every append, so no message is read. One row more than the page
    is read; if it is there, every row of the page carries the cursor of the next one.
    """
    rows = threads.filter(F.col("n_messages") > 0)
    if not include_archived:
        rows = rows.filter(~F.col("archived"))
    if after:
        rows = rows.filter(before(after))
    top = (rows.select("id", "title", "archived", "created_at")
           .orderBy(F.desc("created_at"), F.desc("id")).limit(page_size + 1))
    # at most page_size + 1 rows from here on
    page = Window.orderBy(F.desc("created_at"), F.desc("id"))
    every = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cursor = F.concat(vl.render_time(F.col("created_at")), F.lit("|"), F.col("id"))
    return (top.withColumn("rank", F.row_number().over(page))
            .withColumn("_more", F.count("*").over(every) > page_size)
            .withColumn("next_cursor", F.max(F.when(
                F.col("_more") & (F.col("rank") == page_size), cursor)).over(every))
            .filter(F.col("rank") <= page_size).drop("_more"))


def list_messages(messages: DataFrame, thread_id: str) -> DataFrame:
    return (messages.filter(F.col("conversation_id") == thread_id)
            .orderBy("created_at", "id"))


def rehydrated_sources(messages: DataFrame) -> DataFrame:
    """(id, sources) of assistant messages that cite something."""
    return messages.filter(
        (F.col("role") == "assistant") & (F.size("sources") > 0)).select("id", "sources")


def latest_sources(entries: DataFrame) -> DataFrame:
    """(id, sources) from (id, sources, seq): the last write for a message counts."""
    return entries.groupBy("id").agg(F.max_by("sources", "seq").alias("sources"))


def wire_history(messages: DataFrame) -> DataFrame:
    """Messages a client sends along: user or assistant, with text."""
    return messages.filter(
        F.col("role").isin(*sc.MESSAGE_ROLES) & (F.coalesce("content", F.lit("")) != ""))


# -- titles ----------------------------------------------------------------


def title_requests(messages: DataFrame, order: str = "created_at") -> DataFrame:
    """(conversation_id, prompt) from the first non-blank messages of each thread."""
    spoken = messages.filter(~tx.is_blank(F.col("content")))
    first = top_n_per_key(spoken, ["conversation_id"], [F.col(order), F.col("id")], TITLE_MESSAGES)
    line = F.concat(F.upper("role"), F.lit(": "), F.substring("content", 1, TITLE_MESSAGE_CHARS))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return first.groupBy("conversation_id").agg(F.concat(
        F.lit(TITLE_REQUEST),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("prompt"))


# -- changes ---------------------------------------------------------------


def append_ids(batch: DataFrame, batch_name: str) -> DataFrame:
    """Give messages without id one that does not change when a task is repeated."""
    made = urls.uuid5(F.concat_ws("#", F.lit(batch_name), "conversation_id",
                                  F.col("seq").cast("string")))
    return batch.withColumn("id", F.coalesce("id", made))


@dataclass(frozen=True)
class Append:
    messages: DataFrame  # rows to insert
    threads: DataFrame  # new or touched threads, as they become
    touched: DataFrame  # ids of existing threads they replace
    rejected: DataFrame


def plan_append(batch: DataFrame, threads: DataFrame, messages: DataFrame,
                default_title: str) -> Append:
    """Insert messages whose id is new; make missing threads; bump touched ones.

    ``batch`` has the message columns and ``seq``, the order of arrival. Of two
    messages with one id the earlier is kept.
    """
    valid = F.col("role").isin(*sc.MESSAGE_ROLES) & F.col("content").isNotNull()
    good = batch.filter(F.coalesce(valid, F.lit(False)))
    # both are used several times below, and decided once
    fresh = staged(first_per_key(good, ["id"], ["seq"]).drop("seq")
                   .join(narrow_to(messages.select("id"), good, "id"), "id", "left_anti"),
                   "append-fresh")
    named = good.groupBy(F.col("conversation_id").alias("id")).agg(
        F.min("created_at").alias("first_at"))
    bumped = fresh.groupBy(F.col("conversation_id").alias("id")).agg(
        F.max("created_at").alias("last_at"), F.count("*").alias("added"))
    old = narrow_to(threads, good.select(F.col("conversation_id").alias("id")), "id").select(
        "id", F.lit(True).alias("_old"), "title", "archived",
        F.col("created_at").alias("_created"), F.col("updated_at").alias("_updated"), F.col("n_messages").alias("_had"))
    state = staged(named.join(bumped, "id", "left").join(old, "id", "left").filter(
        F.col("_old").isNull() | F.col("last_at").isNotNull()), "append-threads")
    after = state.select(
        "id", F.coalesce("title", F.lit(default_title)).alias("title"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        F.coalesce("_created", "first_at").alias("created_at"),
        F.greatest(F.coalesce("_updated", "first_at"), "last_at").alias("updated_at"),
        (F.coalesce("_had", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("n_messages"))
    return Append(fresh.select(sc.MESSAGE.fieldNames()), after,
                  state.filter("_old").select("id"),
                  batch.filter(~F.coalesce(valid, F.lit(False))))


def plan_patch(patches: DataFrame, threads: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(threads as they become, problems). ``patches`` is (id, title, archived, seq).

    A later patch of a thread wins field by field.
    """
    size = F.length("title")
    problem = F.when(F.col("title").isNull() & F.col("archived").isNull(), "no changes").when(
        size.isNotNull() & ~size.between(*sc.TITLE_CHARS), "title length")
    checked = patches.withColumn("problem", problem)
    merged = checked.filter(F.col("problem").isNull()).groupBy("id").agg(
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("_title"),
        F.max_by("archived", F.when(F.col("archived").isNotNull(), F.col("seq"))).alias("_archived"))
    after = threads.join(merged, "id").select(
        "id", F.coalesce("_title", "title").alias("title"),
        F.coalesce("_archived", "archived").alias("archived"), "created_at", now.alias("updated_at"), "n_messages")
    missing = merged.select("id").join(
        narrow_to(threads.select("id"), merged, "id"), "id", "left_anti").select(
        "id", F.lit("not found").alias("problem"))
    return after, checked.filter(F.col("problem").isNotNull()).select("id", "problem").unionAll(missing)


def plan_delete(ids: DataFrame, threads: DataFrame,
                messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threads, messages) that remain: messages go with their thread."""
    gone = ids.select("id").distinct()
    return (threads.join(gone, "id", "left_anti"),
            messages.join(gone.select(F.col("id").alias("conversation_id")),
                          "conversation_id", "left_anti"))


# -- a store of threads ----------------------------------------------------


class ThreadStore:
    """The thread operations bound to a store."""

    def __init__(self, store: Store, settings: Settings | None = None) -> None:
        self.store, self.settings = store, settings or Settings()
        self.spark = store.spark

    def threads(self) -> DataFrame:
        return self.store.read("threads")

    def messages(self) -> DataFrame:
        return self.store.read("messages")

    def new_thread(self) -> dict:
        """A fresh id. Nothing is stored until its first message."""
        return {"id": str(uuid4()), "title": self.settings.default_title, "archived": False}

    def list(self, after: str | None = None, include_archived: bool = True) -> DataFrame:
        if after and self.spark.range(1).select(
                vl.parse_time(F.lit(after.partition("|")[0])).isNull()).first()[0]:
            raise BadRequest("invalid cursor")
        return list_threads(self.threads(), after, self.settings.page_size, include_archived)

    def get(self, thread_id: str) -> dict:
        row = self.threads().filter(F.col("id") == thread_id).select(
            "id", "title", "archived").first()
        if row is None:
            raise NotFound(thread_id)
        return row.asDict()

    def list_messages(self, thread_id: str) -> DataFrame:
        self.get(thread_id)
        return list_messages(self.messages(), thread_id)

    def append(self, batch: DataFrame, batch_name: str) -> DataFrame:
        """Append a batch; returns (seq, id) so callers learn generated ids.

        Running the same batch again changes nothing.
        """
        named = staged(append_ids(batch, batch_name), "append")
        plan = plan_append(named, self.threads(), self.messages(), self.settings.default_title)
        self.store.commit({"messages": Change(plan.messages),
                           "threads": Change(plan.threads, plan.touched)})
        return named.select("seq", "id")

    def patch(self, patches: DataFrame, now: Column | None = None) -> DataFrame:
        """Apply patches; returns the ones that could not be (id, problem)."""
        after, problems = plan_patch(
            patches, self.threads(), F.current_timestamp() if now is None else now)
        after, problems = staged(after, "patch"), staged(problems, "patch-problems")
        self.store.commit({"threads": Change(after, after.select("id"))})
        return problems

    def patch_one(self, thread_id: str, title: str | None = None,
                  archived: bool | None = None) -> None:
        patch = self.spark.createDataFrame(
            [(thread_id, title, archived, 0)], "id string, title string, archived boolean, seq int")
        problem = staged(plan_patch(patch, self.threads(), F.current_timestamp())[1], "patch").first()
        if problem is not None:
            raise (NotFound if problem.problem == "not found" else BadRequest)(problem.problem)
        self.patch(patch)

    def delete(self, ids: DataFrame) -> None:
        """Delete threads and their messages; unknown ids are fine."""
        gone = staged(ids.select("id").distinct(), "delete")
        theirs = self.messages().join(
            gone.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
        self.store.commit({"messages": Change(replaced=theirs.select("id")),
                           "threads": Change(replaced=gone)})

    def title(self, chat: ChatModel, ids: DataFrame | None = None,
              now: Column | None = None) -> DataFrame:
        """Title threads: those of ``ids``, or all that still have the default title.

        Returns (id, title). Threads without a non-blank message are left as they are; of
        those asked for by id the default title is returned. Ids that no thread has
        are in no row: ``unknown`` names them.
        """
        untitled = self.threads()
        if ids is None:
            untitled = untitled.filter(F.col("title") == self.settings.default_title)
        else:
            untitled = untitled.join(ids.select("id").distinct(), "id", "left_semi")
        mine = self.messages().join(
            untitled.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
        asked = title_requests(mine).select(
            F.col("conversation_id").alias("turn_id"), F.col("prompt").alias("context"))
        tokens = chat.generate(asked, asked.select(
            "turn_id", F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("pos"),
            F.lit("user").alias("role"), F.col("context").alias("content")))
        titled = staged(answers(tokens).select(
            F.col("turn_id").alias("id"),
            tx.clean_title(F.col("answer"), self.settings.default_title).alias("title")), "titles")
        quiet = None if ids is None else staged(
            untitled.select("id").join(titled.select("id"), "id", "left_anti"), "untitled")
        self.patch(titled.select("id", "title", F.lit(None).cast("boolean").alias("archived"),
                                 F.lit(0).alias("seq")), now)
        if ids is None:
            return titled
        return titled.unionByName(quiet.withColumn("title", F.lit(self.settings.default_title)))

    def unknown(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` that no thread has."""
        return ids.select("id").distinct().join(self.threads().select("id"), "id", "left_anti")

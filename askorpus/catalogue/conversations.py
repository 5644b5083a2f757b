"""Threads, messages, frames and streaming state over the conversations table."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from askorpus import schemas as sc
from askorpus.catalogue.registry import message_id, query, table, thread_id, uuid5_sql
from askorpus.config import Settings
from askorpus.functions import sse
from askorpus.functions import text as tx
from askorpus.functions import values as vl
from askorpus.operators.ordering import last_n_per_key
from askorpus.plans import threads as th
from askorpus.plans import turns as tn
from askorpus.providers import ExtractiveChat
from askorpus.sources import ndjson
from askorpus.sources.staging import shared_dir
from askorpus.sources.store import Store
from askorpus.streaming import history as sh

_TITLE = Settings().default_title
_START = "timestamp '2024-01-01 00:00:00'"
_TID = uuid5_sql("'c' || conv_id")
_MID = uuid5_sql("'m' || conv_id || '.' || turn")
_AT = f"{_START} + to_minutes((conv_id // 2)::INT) + to_seconds(turn)"
_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.000Z')"


def _created(conv, turn):
    """Two threads start in each minute; messages follow by the second."""
    start = 1_704_067_200  # 2024-01-01 UTC
    return F.timestamp_seconds(F.lit(start) + F.floor(conv / 2) * 60 + turn)


def _messages(spark, sf_dir, roles=sc.MESSAGE_ROLES):
    c = table(spark, sf_dir, "conversations").filter(F.col("role").isin(*roles))
    cited = F.when(F.col("role") == "assistant", vl.one_source(
        F.concat(F.lit("https://example.test/"), F.col("turn").cast("string")),
        F.when(F.col("turn") > 2, F.lit("Título")), F.lit(1) / (F.lit(1) + F.col("turn"))))
    return c.select(
        message_id().alias("id"), thread_id().alias("conversation_id"),
        F.lit(None).cast("string").alias("parent_id"),
        "role", F.col("text").alias("content"), cited.alias("sources"),
        _created(F.col("conv_id"), F.col("turn")).alias("created_at"))


def _threads(spark, sf_dir):
    """One thread per conversation, archived if it has a system message."""
    c = table(spark, sf_dir, "conversations")
    one = c.groupBy("conv_id").agg(
        F.bool_or(F.col("role") == "system").alias("archived"), F.max("turn").alias("last"),
        F.count_if(F.col("role") == "assistant").alias("n_messages"))
    return one.select(
        thread_id().alias("id"), F.lit(_TITLE).alias("title"), "archived",
        _created(F.col("conv_id"), F.lit(0)).alias("created_at"),
        _created(F.col("conv_id"), F.col("last")).alias("updated_at"), "n_messages")


_THREADS = f"""
t AS (SELECT {_TID} AS id, bool_or(role = 'system') AS archived, min({_START} + to_minutes((conv_id // 2)::INT)) created_at,
        max({_AT}) AS updated_at, bool_or(role = 'assistant') AS answered
      FROM conversations GROUP BY conv_id)"""


# -- listing ----------------------------------------------------------------


def _page_sql(skip: int) -> str:
    at = _ISO.format(c="created_at")
    return f"""
WITH {_THREADS},
r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) rank FROM t WHERE answered)
SELECT id, '{_TITLE}' AS title, archived, {at} AS created_at, rank - {skip} AS rank,
       (SELECT {at} || '|' || id FROM r WHERE rank = {skip + 30}
        AND EXISTS (SELECT 1 FROM r WHERE rank = {skip + 31})) AS next_cursor
FROM r WHERE rank > {skip} AND rank <= {skip + 30}"""


def _page(spark, sf_dir, after=None):
    """The answers are the messages of these threads, counted on their rows."""
    return th.list_threads(_threads(spark, sf_dir), after)


def _shown(page):
    return page.select("id", "title", "archived", vl.render_time(F.col("created_at")).alias("created_at"),
                       F.col("rank").cast("bigint"), "next_cursor")


@query(_page_sql(0))
def thread_page(spark, sf_dir):
    return _shown(_page(spark, sf_dir))


@query(_page_sql(30))
def thread_page_next(spark, sf_dir):
    """The page after the first, reached through its cursor."""
    first = _page(spark, sf_dir).select("next_cursor").first()
    if first is None or first.next_cursor is None:
        return _shown(_page(spark, sf_dir)).limit(0)
    return _shown(_page(spark, sf_dir, first.next_cursor))


@query(f"""
WITH {_THREADS}
SELECT id, {_ISO.format(c='created_at')} AS created_at FROM t
WHERE NOT archived AND answered ORDER BY t.created_at DESC, id DESC LIMIT 30""")
def thread_page_active(spark, sf_dir):
    page = th.list_threads(_threads(spark, sf_dir), include_archived=False)
    return page.select("id", vl.render_time(F.col("created_at")).alias("created_at"))


@query(f"""
SELECT {_MID} AS id, {_TID} AS conversation_id, role, text AS content, {_ISO.format(c=_AT)} AS created_at
FROM conversations WHERE role IN ('user', 'assistant')""")
def thread_messages(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select("id", "conversation_id", "role", "content",
                    vl.render_time(F.col("created_at")).alias("created_at"))


@query("""
SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""")
def history_window(spark, sf_dir):
    return last_n_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 6)


@query(f"""
SELECT {_TID} AS conversation_id,
       'Resume el tema principal de esta conversación en un título corto (máx. 6 palabras), en español:' ||
       chr(10) || chr(10) || string_agg(upper(role) || ': ' || substr(text, 1, 400), chr(10) ORDER BY turn) AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) rn FROM conversations
      WHERE role <> 'system' AND trim(text) <> '') WHERE rn <= 4 GROUP BY conv_id""")
def title_prompts(spark, sf_dir):
    return th.title_requests(_messages(spark, sf_dir))


@query(r"""
SELECT conv_id, turn, coalesce(nullif(substr(string_split(regexp_replace(regexp_replace(
         trim(text), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g'), chr(10))[1], 1, 80), ''), 'Nueva conversación') AS title
FROM conversations""")
def title_cleanup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit(' "\''), F.col("text"), F.lit('\'" '))
    return c.select("conv_id", "turn", tx.clean_title(raw, _TITLE).alias("title"))


# -- changes ----------------------------------------------------------------


def _append(spark, sf_dir):
    """User messages are stored already; all messages arrive, assistants twice."""
    stored = _messages(spark, sf_dir, roles=["user"])
    known = _threads(spark, sf_dir).filter(~F.col("archived"))
    every = _messages(spark, sf_dir, roles=["user", "assistant", "system"])
    seq = F.unix_timestamp("created_at")
    again = every.filter(F.col("role") == "assistant").withColumn("content", F.lit("replayed"))
    batch = every.withColumn("seq", seq).unionAll(again.withColumn("seq", seq + 1_000_000_000))
    return th.plan_append(batch, known, stored, _TITLE)


@query(f"""
SELECT {_MID} AS id, {_TID} AS conversation_id, role, text AS content FROM conversations WHERE role = 'assistant'""")
def append_messages(spark, sf_dir):
    return _append(spark, sf_dir).messages.select("id", "conversation_id", "role", "content")


@query(f"""
WITH {_THREADS},
m AS (SELECT {_TID} AS id, min({_AT}) FILTER (WHERE role <> 'system') first_at,
        max({_AT}) FILTER (WHERE role = 'assistant') last_at FROM conversations GROUP BY conv_id)
SELECT id, archived AS is_new, {_ISO.format(c="CASE WHEN archived THEN first_at ELSE created_at END")} AS created_at,
       {_ISO.format(c="greatest(CASE WHEN archived THEN first_at ELSE updated_at END, last_at)")} AS updated_at
FROM t JOIN m USING (id) WHERE first_at IS NOT NULL AND (archived OR last_at IS NOT NULL)""")
def append_threads(spark, sf_dir):
    """Threads made or touched by the append; archived ones were not known."""
    plan = _append(spark, sf_dir)
    touched = plan.touched.withColumn("old", F.lit(True))
    return plan.threads.join(touched, "id", "left").select(
        "id", F.col("old").isNull().alias("is_new"),
        vl.render_time(F.col("created_at")).alias("created_at"),
        vl.render_time(F.col("updated_at")).alias("updated_at"))


@query(f"""
SELECT {_MID} AS id, role FROM conversations WHERE role NOT IN ('user', 'assistant')""")
def append_rejected(spark, sf_dir):
    return _append(spark, sf_dir).rejected.select("id", "role")


def _patches(spark, sf_dir):
    """Users rename, assistants archive, system messages change nothing."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        thread_id().alias("id"), F.when(F.col("role") == "user", F.col("text")).alias("title"),
        F.when(F.col("role") == "assistant", F.contains("text", F.lit(","))).alias("archived"),
        F.col("turn").alias("seq"))


@query(f"""
SELECT {_TID} AS id,
  coalesce(arg_max(text, turn) FILTER (WHERE role = 'user' AND length(text) BETWEEN 1 AND 200), '{_TITLE}') AS title,
  coalesce(arg_max(contains(text, ','), turn) FILTER (WHERE role = 'assistant'), bool_or(role = 'system')) AS archived
FROM conversations GROUP BY conv_id
HAVING count(*) FILTER (WHERE role = 'assistant' OR (role = 'user' AND length(text) BETWEEN 1 AND 200)) > 0""")
def patch_threads(spark, sf_dir):
    after, _ = th.plan_patch(_patches(spark, sf_dir), _threads(spark, sf_dir), F.current_timestamp())
    return after.select("id", "title", "archived")


@query(f"""
SELECT {_TID} AS id, CASE WHEN role = 'system' THEN 'no changes' ELSE 'title length' END AS problem, count(*) AS n
FROM conversations WHERE role = 'system' OR (role = 'user' AND length(text) NOT BETWEEN 1 AND 200) GROUP BY ALL""")
def patch_problems(spark, sf_dir):
    _, problems = th.plan_patch(_patches(spark, sf_dir), _threads(spark, sf_dir), F.current_timestamp())
    return problems.groupBy("id", "problem").agg(F.count("*").alias("n"))


@query(f"""
SELECT {_TID} AS id, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS n_messages
FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system')""")
def delete_threads(spark, sf_dir):
    """Archived threads deleted; what is left of threads and messages."""
    t = _threads(spark, sf_dir)
    gone = t.filter("archived").select("id")
    kept, messages = th.plan_delete(gone, t, _messages(spark, sf_dir))
    counts = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("n"))
    return kept.join(counts, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("n_messages"))


@query(f"""
SELECT {_MID} AS id, 'https://example.test/' || turn AS url,
       CASE WHEN turn > 2 THEN 'Título' END AS title, round(1 / (1 + turn), 6) AS score
FROM conversations WHERE role = 'assistant'""")
def sources_json(spark, sf_dir):
    """Citations of assistant messages, through JSON text and back."""
    m = th.rehydrated_sources(_messages(spark, sf_dir))
    back = m.select("id", F.explode(vl.parse_sources(vl.encode_sources(F.col("sources")))).alias("s"))
    return back.select("id", "s.url", "s.title", F.round("s.score", 6).alias("score"))


@query(f"""
SELECT {_MID} AS id, 'https://example.test/' || turn AS url FROM conversations WHERE role = 'assistant'
UNION ALL SELECT {_MID}, 'https://example.test/first' FROM conversations WHERE role = 'user'""")
def sources_map(spark, sf_dir):
    """Sources written per message, assistants twice: the later write counts."""
    early = table(spark, sf_dir, "conversations").filter(F.col("role").isin(*sc.MESSAGE_ROLES)).select(
        message_id().alias("id"), vl.one_source(
            F.lit("https://example.test/first"), F.lit(None).cast("string"), F.lit(0.5)).alias("sources"),
        F.lit(0).alias("seq"))
    late = th.rehydrated_sources(_messages(spark, sf_dir)).withColumn("seq", F.lit(1))
    latest = th.latest_sources(early.unionByName(late))
    return latest.select("id", F.col("sources")[0]["url"].alias("url"))


@query("""
WITH s AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'updates' ELSE 'messages' END AS mode,
  CASE WHEN role = 'assistant' AND turn > 1 THEN 'generate' WHEN role = 'assistant' THEN 'classify'
       WHEN turn > 2 THEN 'retrieve' ELSE 'direct' END AS step,
  contains(text, chr(10)) AS whole FROM conversations)
SELECT conv_id, turn, CASE mode WHEN 'updates' THEN 'sources' ELSE 'token' END AS event, text AS data FROM s
WHERE (mode = 'updates' AND step = 'retrieve') OR (mode = 'messages' AND step = 'generate' AND NOT whole)""")
def event_filter(spark, sf_dir):
    """Messages as steps of turns, of which a client hears some."""
    role, turn = F.col("role"), F.col("turn")
    steps = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("turn_id"), turn.alias("seq"),
        F.when(role == "user", "updates").otherwise("messages").alias("mode"),
        F.when((role == "assistant") & (turn > 1), "generate").when(role == "assistant", "classify")
        .when(turn > 2, "retrieve").otherwise("direct").alias("step"),
        F.when(F.contains("text", F.lit("\n")), "message").otherwise("chunk").alias("kind"),
        F.col("text").alias("data"))
    return tn.emitted(steps).select(
        F.col("turn_id").alias("conv_id"), F.col("seq").alias("turn"), "event", "data")


@query(r"""
SELECT conv_id || '.' || turn AS turn_id, text, CASE WHEN role = 'assistant' THEN turn END AS cited,
       CASE WHEN role = 'system' THEN 'Ups (' || turn || ')' END AS problem
FROM conversations""")
def client_view(spark, sf_dir):
    """Every message as an event stream: sources, a token per word, an end."""
    c = table(spark, sf_dir, "conversations").withColumn("turn_id", F.concat_ws(".", "conv_id", "turn"))
    words = c.select("turn_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\s*\S+\s*)"), F.lit(1)))
                     .alias("seq", "data")).select(
        "turn_id", F.lit(1).alias("part"), "seq", F.lit("token").alias("event"), "data")
    cited = vl.one_source(F.col("turn").cast("string"), F.lit(None).cast("string"), F.lit(1.0))
    sources = c.filter(F.col("role") == "assistant").select(
        "turn_id", F.lit(0).alias("part"), F.lit(0).alias("seq"), F.lit("sources").alias("event"),
        vl.sources_payload(cited).alias("data"))
    failed = F.col("role") == "system"
    end = c.select("turn_id", F.lit(2).alias("part"), F.lit(0).alias("seq"),
                   F.when(failed, "error").otherwise("done").alias("event"),
                   F.when(failed, F.to_json(F.struct(
                       F.lit("Ups").alias("error"), F.col("turn").cast("string").alias("detail"))))
                   .otherwise("ok").alias("data"))
    seen = tn.client_view(words.unionAll(sources).unionAll(end))
    return seen.select("turn_id", "text", F.col("sources")[0]["url"].cast("bigint").alias("cited"), "problem")


@query(r"""
SELECT conv_id, turn, role IN ('user', 'assistant') AND text <> '' AS sent,
       CASE WHEN role = 'user' THEN text || text ELSE text END AS flat
FROM conversations""")
def flatten_content(spark, sf_dir):
    """Messages as arrays of parts, of which only text counts."""
    c = table(spark, sf_dir, "conversations")

    def part(kind, text):
        return F.struct(kind.alias("type"), text.alias("text"))

    second = F.when(F.col("role") == "user", F.lit("text")).otherwise(F.lit("image"))
    parts = F.array(part(F.lit("text"), F.col("text")), part(second, F.col("text")),
                    part(F.lit("text"), F.lit(None).cast("string")))
    flat = c.withColumn("content", vl.flatten_parts(parts))
    kept = th.wire_history(flat).select("conv_id", "turn", F.lit(True).alias("sent"))
    return flat.join(kept, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("sent", F.lit(False)).alias("sent"),
        F.col("content").alias("flat"))


@query(f"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN {_MID} WHEN role = 'system' THEN upper({_MID}) END AS uuid
FROM conversations""")
def uuid_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    shown = F.when(F.col("role") == "user", message_id()).when(
        F.col("role") == "system", F.upper(message_id())).otherwise(F.substr(message_id(), F.lit(2)))
    return c.select("conv_id", "turn", vl.uuid_or_null(shown).alias("uuid"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS shown,
       CASE WHEN event_type = 'click' THEN NULL ELSE epoch_us(ts) // 1000 END AS back_ms
FROM events""")
def time_text(spark, sf_dir):
    """Timestamps rendered as text and parsed back; clicks carry no usable text."""
    e = table(spark, sf_dir, "events")
    at = F.from_utc_timestamp("ts", F.current_timezone())  # the column is UTC without a zone
    shown = vl.render_time(at)
    text = F.when(F.col("event_type") == "click", F.lit("")).otherwise(shown)
    return e.select("event_id", shown.alias("shown"),
                    F.unix_millis(vl.parse_time(text)).alias("back_ms"))


# -- frames and tokens ------------------------------------------------------

_FRAME = """(CASE WHEN role = 'system' THEN '' ELSE 'event: ' || role || chr(10) END ||
  'data: ' || replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(10) || 'data: ') || chr(10) || chr(10))"""


def _frames(spark, sf_dir):
    event = F.when(F.col("role") != "system", F.col("role"))
    return table(spark, sf_dir, "conversations").withColumn(
        "frame", sse.encode_frame(F.col("text"), event))


@query(f"SELECT conv_id, turn, {_FRAME} AS frame FROM conversations")
def sse_frames(spark, sf_dir):
    return _frames(spark, sf_dir).select("conv_id", "turn", "frame")


@query("""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'message' ELSE role END AS event, text AS data, 1 AS n
FROM conversations""")
def sse_decode(spark, sf_dir):
    """Encoded frames with an unfinished one behind them, decoded again."""
    stream = F.concat("frame", F.lit("event: token\ndata: cut"))
    decoded = _frames(spark, sf_dir).withColumn("frames", sse.decode_frames(stream))
    return decoded.select("conv_id", "turn", F.explode("frames").alias("f"), F.size("frames").alias("n")).select(
        "conv_id", "turn", "f.event", "f.data", F.col("n").cast("bigint"))


def _replies(spark, sf_dir):
    """Assistant texts as NDJSON, a word per line, with a broken line, an empty
    token, the end mark and something after it."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    words = F.regexp_extract_all("text", F.lit(r"(\S+\s*)"), F.lit(1))
    lines = F.transform(words, lambda w: F.to_json(F.struct(F.struct(w.alias("content")).alias("message"))))
    tail = F.array(F.lit("{not json"), F.lit('{"message":{"content":""}}'), F.lit('{"done":true}'),
                   F.lit('{"message":{"content":"after the end"}}'))
    return c.select("conv_id", "turn", F.array_join(F.concat(lines, tail), "\n").alias("body"))


@query(r"""
SELECT conv_id, turn, len(regexp_extract_all(text, '\S+\s*')) AS n_tokens,
       regexp_replace(text, '^\s+|\s+$', '', 'g') AS answer
FROM conversations WHERE role = 'assistant'""")
def ndjson_tokens(spark, sf_dir):
    r = _replies(spark, sf_dir)
    return r.select("conv_id", "turn", F.size(ndjson.token_array(F.col("body"))).cast("bigint").alias("n_tokens"),
                    ndjson.full_text(F.col("body")).alias("answer"))


@query(r"""
SELECT conv_id, turn, z.pos - 1 AS seq, z.token FROM conversations,
  unnest(regexp_extract_all(text, '\S+\s*')) WITH ORDINALITY AS z(token, pos) WHERE role = 'assistant'""")
def token_rows(spark, sf_dir):
    rows = ndjson.explode_tokens(_replies(spark, sf_dir), "body")
    return rows.select("conv_id", "turn", F.col("seq").cast("bigint"), "token")


# -- streaming --------------------------------------------------------------


@query("""
SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""")
def stream_history(spark, sf_dir):
    """Last six messages per thread, kept as streaming state over the whole table."""
    from uuid import uuid4

    sh.use_state_store(spark)
    source = table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/conversations.parquet*")
    shaped = stream.select(F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").alias("pos"),
                           F.concat_ws(".", "conv_id", "turn").alias("id"), "role",
                           F.col("text").alias("content"))
    folder = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    run = (sh.last_messages(shaped).writeStream.format("parquet").outputMode("append")
           .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    merged = sh.merge_last(spark.read.parquet(f"{folder}/out"))
    return merged.select(F.col("thread_id").cast("bigint").alias("conv_id"),
                         F.col("pos").alias("turn"), "role", F.col("content").alias("text"))


# -- running replies, titles and unknown threads ------------------------------


@query(r"""
WITH t AS (SELECT conv_id || '.' || turn AS turn_id, regexp_extract_all(text, '\S+\s*') w FROM conversations WHERE role = 'assistant'),
u AS (SELECT turn_id, unnest(w) token, generate_subscripts(w, 1) - 1 seq FROM t)
SELECT turn_id, seq, sha256(string_agg(token, '') OVER (PARTITION BY turn_id ORDER BY seq)) AS shown_hash FROM u""")
def running_reply(spark, sf_dir):
    """What a client shows after each token of every answer."""
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    tokens = said.select(
        F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"),
        F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+\s*)"), F.lit(1))).alias("seq", "token"))
    return tn.running_answers(tokens).select(
        "turn_id", F.col("seq").cast("bigint"), F.sha2("shown", 256).alias("shown_hash"))


@query(f"""
WITH m AS (SELECT {_TID} AS id, bool_or(NOT system) AS spoken FROM (
             SELECT *, bool_or(role = 'system') OVER (PARTITION BY conv_id) AS system FROM conversations)
           WHERE role IN ('user', 'assistant') AND text IS NOT NULL GROUP BY conv_id)
SELECT id, true AS known, CASE WHEN spoken THEN
         substr('Resume el tema principal de esta conversación en un título corto (máx. 6 palabras), en español:', 1, {tx.TITLE_MAX_CHARS})
         ELSE '{_TITLE}' END AS title FROM m
UNION ALL SELECT {_MID}, false, NULL FROM conversations""")
def thread_titles(spark, sf_dir):
    """Titles asked for by id: silent threads (those with a system message here) keep the default
    title, ids that no thread has are named as unknown."""
    store = th.ThreadStore(Store(spark, f"{shared_dir(spark)}/titles-{uuid4().hex}", th.TABLES))
    silent = table(spark, sf_dir, "conversations").filter("role = 'system'").select(thread_id().alias("conversation_id")).distinct()
    messages = _messages(spark, sf_dir).join(silent.withColumn("_silent", F.lit(True)), "conversation_id", "left")
    store.append(messages.withColumn("content", F.expr("IF(_silent AND content IS NOT NULL, ' ', content)")).select(
        *sc.MESSAGE.fieldNames(), F.xxhash64("id").alias("seq")), "titles")
    c = table(spark, sf_dir, "conversations")
    asked = _messages(spark, sf_dir).select(F.col("conversation_id").alias("id")).unionAll(c.select(message_id().alias("id")))
    titled = store.title(ExtractiveChat(), asked)
    return titled.select("id", F.lit(True).alias("known"), "title").unionAll(
        store.unknown(asked).select("id", F.lit(False), F.lit(None).cast("string")))

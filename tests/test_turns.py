"""Chat turns end to end with the offline providers."""

import json
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from askorpus.catalogue.sample import RULES_SAMPLE
from askorpus.config import Settings
from askorpus.functions import sse
from askorpus.plans import ingest as ing
from askorpus.plans import threads as th
from askorpus.plans import turns as tn
from askorpus.providers import ExtractiveChat, HashingEmbedder, RuleRouter
from askorpus.schemas import CHUNK
from askorpus.sources.store import Store
from askorpus.streaming.turns import answer_stream, stored_history

REQUEST = "turn_id string, thread_id string, question string, temperature double, top_k int"
HISTORY = "thread_id string, pos long, role string, content string"
THREADS = {n: str(uuid4()) for n in ("a", "b", "c", "d")}
ABOUT = "la compañía nació hace muchos años en un pueblo pequeño y creció con sus fundadores"


def chunk_rows(spark):
    texts = [(ABOUT, "u0", "Historia"), (ABOUT + " además", None, None), ("otra cosa distinta", "u2", None),
             (ABOUT + " hoy", "u3", None)]
    rows = [(f"c{i}", i, 0, u, t, "s", x, "h", "h") for i, (x, u, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id long, chunk_index int, url string, "
                                     "title string, source string, content string, content_hash string, "
                                     "chunk_hash string")
    return df.withColumn("embedding", HashingEmbedder().column(F.col("content"))).select(CHUNK.fieldNames())


@pytest.fixture
def engine(spark):
    return tn.Engine(chunk_rows(spark), RULES_SAMPLE, HashingEmbedder(), RuleRouter(), ExtractiveChat(),
                     note="", settings=Settings())


def requests(spark, rows):
    return spark.createDataFrame(rows, REQUEST)


def test_routes(spark):
    asked = {
        "Hola, buen día": "direct", "Me llamo Ana": "direct", "¿Cómo me llamo?": "direct",
        "¿y por qué?": "direct", "ok listo": "direct", "¿Me das el número de teléfono?": "structured",
        "¿En qué horario abren ustedes?": "structured", "¿Cuál es el NIT de ustedes?": "structured",
        "¿Cómo fueron los primeros años de la compañía?": "rag",
        "¿Qué hacen ustedes por el medio ambiente?": "rag", "Unidad de medida unitaria general": "rag"}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content")))
    got = {r.q: r.route for r in df.select("q", RuleRouter().column(F.col("q"), history).alias("route")).collect()}
    assert got == asked
    none = F.array().cast("array<struct<role:string,content:string>>")
    alone = spark.createDataFrame([("¿Por qué no repite lo anterior ahora?",)], "q string")
    assert alone.select(RuleRouter().column(F.col("q"), none)).first()[0] == "rag"


def test_three_routes(spark, engine):
    asked = requests(spark, [
        ("1", THREADS["a"], "hola", None, None), ("2", THREADS["b"], "el teléfono por favor ya", 0.5, 3),
        ("3", THREADS["c"], ABOUT, None, None), ("4", THREADS["d"], ABOUT, None, 1),
        ("5", THREADS["a"], "palabras que nadie ha escrito nunca jamás", None, 2)])
    history = spark.createDataFrame([(THREADS["a"], i, "user", f"m{i}") for i in range(9)], HISTORY)
    result = tn.run_turns(asked, history, engine)
    turns = {r.turn_id: r for r in result.turns.collect()}
    assert {k: v.route for k, v in turns.items()} == {
        "1": "direct", "2": "structured", "3": "rag", "4": "rag", "5": "rag"}
    assert turns["1"].context == "hola" and turns["1"].sources == []
    assert [tuple(s) for s in turns["2"].sources] == [
        ("datos_estructurados.json", "Datos oficiales corporativa (herramienta estructurada)", 1.0)]
    assert "Línea de Servicio al Cliente: 01 000 000 001" in turns["2"].context
    # the second-best hit has no url: it is dropped and nothing takes its place
    assert [s.url for s in turns["3"].sources] == ["u0", "u3"] and turns["3"].sources[0].score > 0.999
    assert turns["3"].context.startswith("<contexto>\n[#0 · Historia]\nu0\n" + ABOUT + "\n\n---\n[#0 · u3]")
    assert [s.url for s in turns["4"].sources] == ["u0"]
    assert turns["5"].sources == [] and "(sin resultados relevantes)" in turns["5"].context

    events = {}
    for r in result.events.orderBy("turn_id", "part", "seq").collect():
        events.setdefault(r.turn_id, []).append((r.event, r.data))
    kinds = {k: [e for e, _ in v] for k, v in events.items()}
    assert kinds["1"] == ["token", "done"] and kinds["2"][0] == "sources" == kinds["5"][0]
    assert all(v[-1] == "done" and set(v[1:-1]) <= {"token"} for v in kinds.values())
    assert json.loads(events["5"][0][1]) == []
    assert json.loads(events["3"][0][1])[1] == {"url": "u3", "title": None, "score": turns["3"].sources[1].score}
    shown = {r.turn_id: r.answer for r in tn.answers(result.tokens).collect()}
    assert shown["1"] == "hola" and shown["3"].startswith("[#0 · Historia]")

    steps = tn.running_answers(result.tokens).filter("turn_id = '2'").orderBy("seq").collect()
    assert steps[-1].shown == shown["2"]
    assert all(b.shown.startswith(a.shown) for a, b in zip(steps, steps[1:]))

    wire = tn.frames(result.events).filter("turn_id = '3'").orderBy("part", "seq").collect()
    stream = spark.createDataFrame([("".join(r.frame for r in wire),)], "s string")
    back = stream.select(F.explode(sse.decode_frames(F.col("s"))).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in back] == events["3"]


def test_prompt_rows(spark, engine):
    asked = requests(spark, [("1", THREADS["a"], "hola", None, None)])
    history = spark.createDataFrame([(THREADS["a"], i, "user", f"m{i}") for i in range(9)], HISTORY)
    turns = tn.run_turns(asked, history, engine).turns
    rows = tn.prompt_messages(turns, history, tn.PROMPTS).orderBy("part", "pos").collect()
    assert [r.content for r in rows] == [tn.PROMPTS["direct"], *[f"m{i}" for i in range(9)], "hola"]
    assert tn.prompt_messages(turns, history, tn.PROMPTS, history_limit=2).count() == 4
    recent = tn.recent_history(history, 6).first()
    assert [m.content for m in recent.history] == [f"m{i}" for i in range(3, 9)]


def test_validation(spark, engine):
    t = THREADS["a"]
    rows = [("ok", t, "x", None, None), ("edge", t, "x" * 2000, 1.0, 10), ("empty", t, "", None, None),
            ("long", t, "x" * 2001, None, None), ("null", t, None, None, None), ("thread", None, "x", None, None),
            ("temp", t, "x", 1.1, None), ("k0", t, "x", None, 0), ("k11", t, "x", None, 11)]
    got = {r.turn_id: r.problem for r in tn.validate(requests(spark, rows), Settings()).collect()}
    assert got == {"ok": "", "edge": "", "empty": "question length", "long": "question length",
                   "null": "question length", "thread": "thread_id", "temp": "temperature",
                   "k0": "top_k", "k11": "top_k"}
    empty = spark.createDataFrame([], HISTORY)
    assert tn.run_turns(requests(spark, rows), empty, engine).rejected.count() == 7


def test_failed_generation(spark, engine):
    class Breaks:
        def generate(self, turns, prompts):
            return turns.select("turn_id", F.explode(F.array(
                F.struct(F.lit(0).alias("seq"), F.lit("a").alias("token"), F.lit(None).cast("string").alias("error")),
                F.struct(F.lit(1).alias("seq"), F.lit(None).cast("string").alias("token"),
                         F.lit("sin conexión").alias("error")))).alias("x")).select("turn_id", "x.*")

    broken = tn.Engine(engine.chunks, engine.rules, engine.embedder, engine.router, Breaks())
    asked = requests(spark, [("1", THREADS["a"], "hola", None, None)])
    result = tn.run_turns(asked, spark.createDataFrame([], HISTORY), broken)
    rows = result.events.orderBy("part", "seq").collect()
    assert [r.event for r in rows] == ["token", "error"]
    assert json.loads(rows[1].data) == {"error": tn.ERROR_TEXT, "detail": "sin conexión"}


def test_stream_of_turns(spark, engine, tmp_path):
    store = th.ThreadStore(Store(spark, str(tmp_path / "t"), th.TABLES))
    inbox = str(tmp_path / "in")
    requests(spark, [("1", THREADS["a"], "hola", None, None)]).coalesce(1).write.parquet(inbox)

    def go(checkpoint):
        stream = spark.readStream.schema(requests(spark, []).schema).parquet(inbox)
        answer_stream(stream, engine, store, str(tmp_path / "ev"), str(tmp_path / checkpoint),
                      once=True).awaitTermination()

    go("cp")
    requests(spark, [("2", THREADS["a"], "¿y por qué?", None, None)]).coalesce(1).write.mode("append").parquet(inbox)
    go("cp")
    said = [(r.role, r.content) for r in store.list_messages(THREADS["a"]).collect()]
    assert said == [("user", "hola"), ("assistant", "hola"), ("user", "¿y por qué?"), ("assistant", "¿y por qué?")]
    events = spark.read.parquet(str(tmp_path / "ev"))
    assert events.filter("event = 'done'").count() == 2
    # everything again, from nothing: same ids, so no new messages
    go("other")
    assert store.messages().count() == 4
    assert stored_history(store.messages()).count() == 4


def test_ingested_corpus_can_be_searched(spark, engine, tmp_path):
    from test_ingest import raw, text
    from askorpus.operators.chunking import recursive_splitter

    store = Store(spark, str(tmp_path / "s"), ing.TABLES)
    ing.ingest(store, raw(spark, {"https://d.test/1": text("planta"), "https://d.test/2": text("zinc")}),
               recursive_splitter(), HashingEmbedder())
    live = tn.Engine(store.read("chunks"), RULES_SAMPLE, HashingEmbedder(), RuleRouter(), ExtractiveChat())
    asked = requests(spark, [("1", THREADS["a"], "zinc " + "relleno " * 20, None, 1)])
    turn = tn.run_turns(asked, spark.createDataFrame([], HISTORY), live).turns.first()
    assert [s.url for s in turn.sources] == ["https://d.test/2"]

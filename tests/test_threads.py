"""Thread store: the behaviour a chat client relies on."""

import datetime as dt
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from askorpus import schemas as sc
from askorpus.config import Settings
from askorpus.plans import threads as th
from askorpus.providers import ExtractiveChat
from askorpus.sources.store import Store
from pyspark.sql import types as T

BATCH = T.StructType(list(sc.MESSAGE.fields) + [T.StructField("seq", T.LongType())])
T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


@pytest.fixture
def threads(spark, tmp_path):
    return th.ThreadStore(Store(spark, str(tmp_path / "t"), th.TABLES), Settings(page_size=3))


def msg(thread, content, role="user", mid=None, sources=None, at=0, seq=0, parent=None):
    return (mid, thread, parent, role, content, sources, T0 + dt.timedelta(seconds=at), seq)


def send(threads, *rows, name=None):
    batch = threads.spark.createDataFrame(list(rows), BATCH)
    return [r.id for r in threads.append(batch, name or str(uuid4())).orderBy("seq").collect()]


def ids(page):
    return [r.id for r in page.orderBy("rank").collect()]


def test_history_comes_back_in_order(threads):
    t = threads.new_thread()["id"]
    src = [("https://example.test/s", "Fuente", 1.0), ("https://example.test/t", None, 0.5)]
    user = send(threads, msg(t, "hola"))[0]
    send(threads, msg(t, "respuesta", "assistant", sources=src, at=1, parent=user))
    rows = threads.list_messages(t).collect()
    assert [(r.role, r.content, r.parent_id) for r in rows] == [
        ("user", "hola", None), ("assistant", "respuesta", user)]
    assert rows[0].sources is None and [tuple(s) for s in rows[1].sources] == src
    cited = th.rehydrated_sources(threads.messages()).collect()
    assert [r.id for r in cited] == [rows[1].id]


def test_new_thread_stores_nothing(threads):
    fresh = threads.new_thread()
    assert fresh["title"] == "Nueva conversación" and not fresh["archived"]
    assert threads.threads().count() == 0
    with pytest.raises(th.NotFound):
        threads.get(fresh["id"])
    with pytest.raises(th.NotFound):
        threads.list_messages(fresh["id"])
    send(threads, msg(fresh["id"], "x"))
    assert threads.get(fresh["id"]) == fresh


def test_replay_changes_nothing(threads):
    rows = [msg("t", "a", seq=0), msg("t", "b", seq=1, at=1), msg("t", "c", mid="m", seq=2, at=2)]
    first = send(threads, *rows, name="batch-7")
    before = threads.threads().first().updated_at
    assert send(threads, *rows, name="batch-7") == first and first[2] == "m"
    assert threads.messages().count() == 3
    # a replayed id neither changes the message nor touches the thread
    send(threads, msg("t", "other", mid="m", at=500))
    assert {r.content for r in threads.messages().collect()} == {"a", "b", "c"}
    assert threads.threads().first().updated_at == before


def test_same_id_twice_in_a_batch(threads):
    send(threads, msg("t", "late", mid="m", seq=5), msg("t", "early", mid="m", seq=1), msg("t", "n", seq=2),
         msg("t", "n", seq=3))
    assert sorted(r.content for r in threads.messages().collect()) == ["early", "n", "n"]


def test_roles_are_checked(spark, threads):
    batch = spark.createDataFrame(
        [msg("t", "x", "system", mid="1"), msg("t", None, mid="2"), msg("u", "y", mid="3")], BATCH)
    plan = th.plan_append(batch, threads.threads(), threads.messages(), "D")
    assert [r.id for r in plan.messages.collect()] == ["3"]
    assert [r.id for r in plan.threads.collect()] == ["u"]
    assert sorted(r.id for r in plan.rejected.collect()) == ["1", "2"]


def test_times(threads):
    send(threads, msg("t", "a", at=10))
    send(threads, msg("t", "b", at=20))
    row = threads.threads().first()
    assert (row.created_at, row.updated_at) == (T0 + dt.timedelta(seconds=10), T0 + dt.timedelta(seconds=20))


def test_pages(threads):
    send(threads, *[msg(f"t{i}", "x", at=i) for i in range(7)])
    page = threads.list()
    assert ids(page) == ["t6", "t5", "t4"]
    second = threads.list(after=page.first().next_cursor)
    assert ids(second) == ["t3", "t2", "t1"]
    last = threads.list(after=second.first().next_cursor)
    assert ids(last) == ["t0"] and last.first().next_cursor is None
    with pytest.raises(th.BadRequest):
        threads.list(after="ayer")


def test_exact_page_has_no_next(threads):
    assert threads.list().count() == 0
    send(threads, *[msg(f"t{i}", "x", at=i) for i in range(3)])
    assert threads.list().first().next_cursor is None


def test_ties_at_the_page_end(threads):
    send(threads, *[msg(f"t{i}", "x", at=0) for i in range(5)])
    page = threads.list()
    cursor = page.first().next_cursor
    assert ids(page) + ids(threads.list(after=cursor)) == ["t4", "t3", "t2", "t1", "t0"]
    # the plain form is strict on the time alone
    assert threads.list(after=cursor.split("|")[0]).count() == 0


def test_order_ignores_activity(threads):
    send(threads, msg("old", "x", at=0), msg("new", "x", at=5))
    send(threads, msg("old", "y", at=50))
    threads.patch_one("old", title="Otro")
    assert ids(threads.list()) == ["new", "old"]


def test_patch(threads):
    send(threads, msg("t", "x"))
    threads.patch_one("t", title="Título")
    threads.patch_one("t", archived=True)
    assert threads.get("t") == {"id": "t", "title": "Título", "archived": True}
    threads.patch_one("t", archived=False)
    assert threads.get("t")["archived"] is False
    for bad in ({}, {"title": ""}, {"title": "x" * 201}):
        with pytest.raises(th.BadRequest):
            threads.patch_one("t", **bad)
    with pytest.raises(th.NotFound):
        threads.patch_one("none", title="x")
    assert threads.get("t")["title"] == "Título"


def test_later_patch_wins_field_by_field(spark, threads):
    send(threads, msg("t", "x"))
    patches = spark.createDataFrame(
        [("t", "uno", None, 1), ("t", "dos", True, 2), ("t", None, False, 3), ("gone", "x", None, 1)],
        "id string, title string, archived boolean, seq int")
    problems = threads.patch(patches)
    assert [tuple(r) for r in problems.collect()] == [("gone", "not found")]
    assert threads.get("t") == {"id": "t", "title": "dos", "archived": False}


def test_archived(threads):
    send(threads, msg("a", "x", at=1), msg("b", "x", at=2))
    threads.patch_one("a", archived=True)
    assert ids(threads.list()) == ["b", "a"] and ids(threads.list(include_archived=False)) == ["b"]


def test_delete(spark, threads):
    send(threads, msg("a", "x"), msg("b", "y"))
    threads.delete(spark.createDataFrame([("a",), ("never",)], "id string"))
    assert [r.content for r in threads.messages().collect()] == ["y"]
    assert ids(threads.list()) == ["b"]
    send(threads, msg("a", "again"))
    assert [r.content for r in threads.list_messages("a").collect()] == ["again"]


def test_threads_without_messages_are_not_listed(spark, threads):
    send(threads, msg("a", "x"))
    bare = threads.threads().withColumn("id", F.lit("bare"))
    assert {r.id: r.n_messages for r in th.counted(threads.threads().unionAll(bare), threads.messages()).collect()} == {"a": 1, "bare": 0}
    assert ids(th.list_threads(threads.threads().unionAll(bare.withColumn("n_messages", F.lit(0))))) == ["a"]


def test_counts_are_kept_on_the_thread(spark, threads):
    send(threads, msg("a", "x", seq=0), msg("a", "y", seq=1), msg("b", "z", seq=2))
    send(threads, msg("a", "more", seq=3), msg("c", "new", seq=4))
    threads.patch_one("a", title="T")
    threads.delete(spark.createDataFrame([("b",)], "id string"))
    kept = {r.id: r.n_messages for r in threads.threads().collect()}
    assert kept == {"a": 3, "c": 1}
    assert kept == {r.id: r.n_messages for r in th.counted(threads.threads(), threads.messages()).collect()}


def test_titles(threads):
    send(threads, *[msg("t", f"mensaje {i} " + "z" * 500, at=i, seq=i) for i in range(6)],
         msg("blank", "  \n", seq=9), msg("named", "x", seq=10))
    threads.patch_one("named", title="Puesto")
    asked = {r.conversation_id: r.prompt for r in th.title_requests(threads.messages()).collect()}
    lines = asked["t"].removeprefix(th.TITLE_REQUEST).split("\n")
    assert len(lines) == 4 and all(len(x) == len("USER: ") + 400 for x in lines) and "blank" not in asked

    class Titles:
        def generate(self, turns, prompts):
            return turns.select("turn_id", F.lit(0).alias("seq"), F.lit('"Un tema\nmás"').alias("token"),
                                F.lit(None).cast("string").alias("error"))

    assert [tuple(r) for r in threads.title(Titles()).collect()] == [("t", "Un tema")]
    assert threads.get("t")["title"] == "Un tema"
    assert threads.get("blank")["title"] == "Nueva conversación" and threads.get("named")["title"] == "Puesto"
    assert threads.title(ExtractiveChat()).count() == 0
    # asked for by id, a thread is titled again
    again = threads.title(ExtractiveChat(), threads.threads().filter("id = 'named'")).collect()
    some = threads.threads().sparkSession.createDataFrame([("blank",), ("nowhere",)], "id string")
    assert [tuple(r) for r in threads.title(Titles(), some).collect()] == [("blank", "Nueva conversación")]
    assert threads.get("blank")["title"] == "Nueva conversación"
    assert [r.id for r in threads.unknown(some).collect()] == ["nowhere"]
    assert [r.id for r in again] == ["named"] and threads.get("named")["title"] == again[0].title != "Puesto"

"""The whole application on a small site."""

import json
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from askorpus import __main__ as cli
from askorpus.catalogue.sample import FACTS, RULES_SAMPLE
from askorpus.config import Settings, Site
from askorpus.plans import threads as th
from askorpus.plans import turns as tn
from askorpus.providers import FunctionFetcher, PageTable, chat_call, router_call
from askorpus.service import Service
from test_crawl import extract, urlset
from test_operators import DETAIL, LONG, page

SITES = (Site("news", "https://www.news.test/sitemap.xml", seeds=("https://www.news.test/",), has_news=True),
         Site("web", "https://www.web.test/sitemap.xml"))
REQUEST = "turn_id string, thread_id string, question string, temperature double, top_k int"


@pytest.fixture
def service(spark, tmp_path):
    return Service(spark, str(tmp_path / "root"), RULES_SAMPLE,
                   Settings(sites=SITES, news_site="s", company_name="la empresa"))


def fill(service, tmp_path, pages=None):
    spark = service.spark
    files = spark.createDataFrame([
        ("https://www.news.test/sitemap.xml", urlset("http://news.test/n1", "http://news.test/gone")),
        ("https://www.web.test/sitemap.xml", urlset("http://web.test/a"))], "sitemap string, xml string")
    text = "planta zinc cobre historia " * 10
    rows = pages or [
        ("https://www.news.test/", "<p>x</p>", extract("portada " * 20), None),
        ("https://www.news.test/n1", page(summary=LONG + " vitamina " * 10), None, None),
        ("https://www.web.test/a", None, extract(text), None)]
    table = spark.createDataFrame(rows, "url string, html string, extract string, error string")
    frontier = service.frontier(files, table.select("url", "html"))
    return service.crawl(frontier, PageTable(table), "2024-01-01T00:00:00Z", failure_log=str(tmp_path / "log"))


def test_from_sitemap_to_answer(spark, service, tmp_path):
    statuses = {r.url: (r.status, r.reason) for r in fill(service, tmp_path).collect()}
    assert statuses == {
        "https://www.news.test/": ("fetched", ""), DETAIL: ("fetched", "news summary"),
        "https://www.web.test/a": ("fetched", ""), "https://www.news.test/gone": ("failed", "no extract")}

    plan = {r.url: r.kind for r in service.ingest(dry_run=True).collect()}
    assert set(plan.values()) == {"would-insert"} and len(plan) == 3
    assert {r.kind for r in service.ingest().collect()} == {"inserted"}
    assert {r.kind for r in service.ingest().collect()} == {"unchanged"}
    assert service.ingest(only='"source":"web"').count() == 1
    assert service.note().startswith("La biblioteca científica de s indexada") and "Oral (1)" in service.note()

    thread = str(uuid4())
    asked = spark.createDataFrame([
        ("1", thread, "planta zinc cobre historia planta", None, None),
        ("2", thread, "¿Cuál es su horario de atención?", None, None),
        ("bad", "x", "hola", None, None)], REQUEST)
    result = service.ask(asked, "b1")
    seen = {r.turn_id: r for r in tn.client_view(result.events).collect()}
    assert set(seen) == {"1", "2"} and seen["1"].problem is None
    assert [s.url for s in seen["1"].sources] == ["https://www.web.test/a"]
    assert seen["2"].text.startswith("Información disponible sobre la empresa")
    assert "Conteo" not in service.note() and service.note() in result.turns.filter("route='rag'").first().context
    assert [r.role for r in service.threads.list_messages(thread).collect()].count("assistant") == 2
    again = service.ask(asked, "b1")
    assert service.threads.messages().count() == 4
    # a batch asked again sees its threads as it did the first time
    assert sorted(map(tuple, again.turns.select("turn_id", "route", "context").collect())) == sorted(
        map(tuple, result.turns.select("turn_id", "route", "context").collect()))

    row = service.health(lambda: True).first()
    assert (row.ok, row.db_ok, row.ollama_ok, row.chunk_count) == (True, True, True, service.chunks().count())
    down = service.health(lambda: 1 / 0).first()
    assert (down.ok, down.ollama_ok) == (False, False)

    service.compact()
    assert {r.kind for r in service.ingest().collect()} == {"unchanged"}
    service.reset(confirm=True)
    assert service.chunks().count() == 0 and service.threads.threads().count() == 0
    assert service.raw.read("raw").count() == 3
    assert service.note() == ""


def test_retry(spark, service, tmp_path):
    fill(service, tmp_path)
    body = extract("recuperado " * 10)
    calls = FunctionFetcher(lambda url, source: (None, body, None), per_host=2)
    rows = service.retry(str(tmp_path / "log"), calls, "2024-01-02T00:00:00Z").collect()
    assert [(r.url, r.source, r.status) for r in rows] == [("https://www.news.test/gone", "news", "fetched")]
    # it worked, so the log names it no more; what belongs to no site stays
    assert spark.read.text(str(tmp_path / "log")).count() == 0
    spark.createDataFrame([("https://www.news.test/gone\tlost",), ("https://nowhere.test/x\tlost",)], "value string").write.mode(
        "overwrite").text(str(tmp_path / "log"))
    assert [r.url for r in service.unknown_hosts(str(tmp_path / "log")).collect()] == ["https://nowhere.test/x"]

    def refuse(url, source):
        raise TimeoutError("sin respuesta")

    rows = service.retry(str(tmp_path / "log"), FunctionFetcher(refuse), "2024-01-02T00:00:00Z").collect()
    assert [(r.status, r.reason) for r in rows] == [("failed", "TimeoutError: sin respuesta")]
    left = sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect())
    assert left == ["https://nowhere.test/x\tlost", "https://www.news.test/gone\tTimeoutError: sin respuesta"]


def test_client_view_of_an_error(spark):
    events = spark.createDataFrame([
        ("1", 0, 0, "sources", "[]"), ("1", 1, 1, "token", "b"), ("1", 1, 0, "token", "a"),
        ("1", 2, 0, "error", '{"error":"Ups","detail":"x"}'), ("2", 2, 0, "error", "not json"),
        ("3", 2, 0, "done", "ok")], "turn_id string, part int, seq int, event string, data string")
    got = {r.turn_id: (r.text, r.sources, r.problem) for r in tn.client_view(events).collect()}
    assert got == {"1": ("ab", [], "Ups (x)"), "2": ("", None, tn.ERROR_TEXT), "3": ("", None, None)}


def test_last_sources_win(spark):
    df = spark.createDataFrame([("m", ["a"], 1), ("m", ["b"], 2), ("n", ["c"], 1)],
                               "id string, sources array<string>, seq int")
    assert {r.id: r.sources for r in th.latest_sources(df).collect()} == {"m": ["b"], "n": ["c"]}


def test_model_calls():
    s = Settings(llm_router_model="small")
    assert (chat_call(s).model, chat_call(s, 0.9).temperature, chat_call(s).context_tokens) == (s.llm_model, 0.9, 8192)
    assert (router_call(s).model, router_call(s).temperature, router_call(s).context_tokens) == ("small", 0.0, 2048)


def test_fetch_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "get_settings", lambda: Settings(sites=SITES, news_site="s"))
    text = "planta zinc cobre historia " * 10
    rows = [("https://www.news.test/", "<p>x</p>", extract("portada " * 20), None),
            ("https://www.web.test/a", None, extract(text), None), ("https://www.web.test/b", None, extract(text + "b"), None)]
    schema = "url string, html string, extract string, error string"
    for name, own in (("early", rows[:2]), ("pages", rows)):
        spark.createDataFrame(own, schema).write.parquet(str(tmp_path / name))
    spark.createDataFrame([
        ("https://www.news.test/sitemap.xml", urlset("http://news.test/gone")),
        ("https://www.web.test/sitemap.xml", urlset("http://web.test/a", "http://web.test/b"))],
        "sitemap string, xml string").write.parquet(str(tmp_path / "maps"))

    def run(pages, *args):
        cli.main(["--store", str(tmp_path / "store"), "fetch", "--pages", str(tmp_path / pages), "--log", str(tmp_path / "log"),
                  "--fetched-at", "2024-01-01T00:00:00Z", *args], spark)
        return {tuple(c.strip() for c in line.strip("|").split("|")) for line in capsys.readouterr().out.splitlines() if "|" in line}

    maps = ("--sitemaps", str(tmp_path / "maps"))
    got = run("early", *maps, "--site", "web", "--concurrency", "2")
    assert ("web", "fetched", "1") in got and ("web", "failed", "1") in got and not any(r[0] == "news" for r in got)
    assert ("web", "fetched", "1") in run("pages", "--retry-failed")
    assert ("web", "skipped", "1") in run("pages", *maps, "--site", "web", "--limit", "1")
    assert ("web", "fetched", "2") in run("pages", *maps, "--site", "web", "--force")
    with pytest.raises(SystemExit):
        run("pages")


def test_command_line(spark, tmp_path, capsys):
    store, raw = str(tmp_path / "store"), tmp_path / "raw"
    raw.mkdir()
    (raw / "a.json").write_text(json.dumps({
        "url": "https://d.test/1", "source": "s", "title": "T", "text": "palabra útil " * 20,
        "content_hash": "h1", "fetched_at": "2024"}), "utf-8")
    (raw / "bad.json").write_text("{", "utf-8")
    facts = tmp_path / "facts.json"
    facts.write_text(json.dumps(FACTS), "utf-8")

    def run(*args):
        code = cli.main(["--store", store, *args], spark)
        return code, capsys.readouterr().out

    assert "would-insert" in run("ingest", "--raw", str(raw), "--dry-run")[1]
    assert "inserted" in run("ingest", "--raw", str(raw))[1]
    assert "unchanged" in run("ingest", "--raw", str(raw), "--only", "d.test")[1]
    thread = str(uuid4())
    spark.createDataFrame([("1", thread, "hola", None, None)], REQUEST).write.parquet(str(tmp_path / "rq"))
    events = str(tmp_path / "ev")
    assert run("ask", "--facts", str(facts), "--requests", str(tmp_path / "rq"), "--events", events,
               "--batch", "b")[0] == 0
    assert spark.read.parquet(events).filter(F.col("event") == "done").count() == 1
    assert thread in run("threads")[1]
    assert run("reset")[0] == 1 and thread in run("threads")[1]
    assert run("compact")[0] == 0 and thread in run("threads")[1]
    assert run("reset", "--yes")[0] == 0 and thread not in run("threads")[1]
    assert "NULL" in run("health")[1] or "null" in run("health")[1]

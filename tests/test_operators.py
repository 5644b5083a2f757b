"""Nearest neighbours, packing, ordering, stats and news pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from askorpus.operators import newspage as news
from askorpus.operators import packing, stats, topk
from askorpus.operators.ordering import first_per_key, last_n_per_key, list_per_key, top_n_per_key


def brute(vectors, queries, k):
    out = {}
    for q, x in queries:
        ranked = sorted((float(((np.float32(v).astype(float) - np.array(x)) ** 2).sum()), i)
                        for i, v in vectors if v is not None and len(v) == len(x))
        out[q] = [(i, round(d, 9)) for d, i in ranked[:k]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(200)]
    # a third of the table is one vector, copied
    rows += [(200 + i, [0.5] * 8) for i in range(100)]
    return rows + [(900, None)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 64 * 3])
@pytest.mark.parametrize("cells", [4_000_000, 7])
def test_nearest_batch(spark, vectors, block_bytes, cells, monkeypatch):
    monkeypatch.setattr(topk, "_CELLS", cells)
    rng = np.random.default_rng(4)
    queries = [(f"q{i}", rng.normal(size=8).round(3).tolist()) for i in range(9)] + [("hot", [0.5] * 8)]
    corpus = spark.createDataFrame(vectors, "id long, v array<float>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id string, vector array<double>")
    got = topk.nearest_batch(corpus, asked, 5, "id", "v", block_bytes=block_bytes).collect()
    want = brute(vectors, queries, 5)
    for q, expected in want.items():
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.id, round(r.distance, 9)) for r in rows] == expected


def test_nearest_one_equals_batch(spark, vectors):
    corpus = spark.createDataFrame(vectors[:300], "id long, v array<float>")
    target = [0.1 * i for i in range(8)]
    one = [(r.id, round(r.distance, 9)) for r in topk.nearest_one(corpus, target, 4, "id", "v").collect()]
    assert one == brute(vectors, [("q", target)], 4)["q"]


def test_nearest_fewer_rows_and_string_keys(spark):
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "id string, v array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    got = topk.nearest_batch(corpus, asked, 5, "id", "v").orderBy("rank").collect()
    assert [(r.query_id, r.id, r.distance, r["rank"]) for r in got] == [(1, "a", 0.0, 1), (1, "b", 0.0, 2)]
    none = topk.nearest_batch(corpus, asked.limit(0), 5, "id", "v")
    assert none.count() == 0 and none.columns == ["query_id", "id", "distance", "rank"]


def greedy(blocks, limit):
    used, taken = 0, []
    for b in blocks:
        if used + len(b) > limit:
            break
        taken.append(b)
        used += len(b)
    return taken


def test_packing(spark):
    rng = np.random.default_rng(5)
    groups = {g: ["b" * int(n) for n in rng.integers(10, 80, 12)] for g in range(40)}
    groups[40] = ["x" * 101, "y" * 10]
    groups[41] = ["x" * 60, "y" * 40, "z" * 10]
    groups[42] = ["x" * 60, "y" * 41, "z" * 10]
    rows = [(g, i, b) for g, bs in groups.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "g int, i int, block string")
    packed = packing.join_blocks(packing.pack(df, ["g"], [F.col("i")], 100), ["g"])
    got = {r.g: r.context for r in packed.collect()}
    want = {g: "\n---\n".join(greedy(bs, 100)) for g, bs in groups.items() if greedy(bs, 100)}
    assert got == want


def test_short_and_empty_blocks_are_all_packed(spark):
    blocks = [(i, "ab") for i in range(1500)] + [(i, "") for i in range(1500, 1600)]
    df = spark.createDataFrame([("g", *b) for b in blocks], "g string, i int, block string")
    assert packing.pack(df, ["g"], [F.col("i")], 3000).count() == 1600
    assert packing.pack(df, ["g"], [F.col("i")], 2999).count() == 1499
    one = spark.createDataFrame([("g", i, "x" if i < 50 else "") for i in range(60)], "g string, i int, block string")
    assert packing.pack(one, ["g"], [F.col("i")], 10).count() == 10


def test_vectors_of_another_length_are_an_error(spark):
    corpus = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0]), (3, None)], "id int, v array<double>")
    asked = spark.createDataFrame([(1, [0.0, 0.0])], "query_id int, vector array<double>")
    with pytest.raises(Exception, match="another length"):
        topk.nearest_batch(corpus, asked, 2, "id", "v").collect()
    with pytest.raises(Exception, match="another length"):
        topk.nearest_one(corpus, [0.0, 0.0], 2, "id", "v").collect()
    assert topk.nearest_batch(corpus.filter("id <> 2"), asked, 2, "id", "v").count() == 1


def test_last_rows_do_not_depend_on_their_spread(spark):
    df = spark.createDataFrame([("a", 1, f"m{i}") for i in range(30)], "k string, o int, v string")
    picks = {tuple(sorted(r.v for r in last_n_per_key(df.repartition(n), ["k"], "o", 6).collect())) for n in (1, 3, 7)}
    assert len(picks) == 1


def test_context_block_and_prompt(spark):
    df = spark.createDataFrame(
        [(0, "T", "u", "  c \n"), (1, None, "u", "c"), (2, "", "u", "c")],
        "i int, t string, u string, c string")
    blocks = [r[0] for r in df.orderBy("i").select(
        packing.context_block(F.col("i"), F.col("t"), F.col("u"), F.col("c"))).collect()]
    assert blocks == ["[#0 · T]\nu\nc\n", "[#1 · u]\nu\nc\n", "[#2 · u]\nu\nc\n"]
    shortest = spark.range(1).select(packing.context_block(
        F.lit(0), F.lit("x"), F.lit(""), F.lit(""))).first()[0]
    assert len(shortest) >= packing.SHORTEST_CONTEXT_BLOCK
    prompt = spark.range(1).select(packing.corpus_prompt(
        F.lit("¿q?"), F.lit(None).cast("string"), F.lit("3 notas."))).first()[0]
    assert prompt == ("<datos_del_corpus>\n3 notas.\n</datos_del_corpus>\n\n<contexto>\n"
                      "(sin resultados relevantes)\n</contexto>\n\nPregunta del usuario: ¿q?\n\n"
                      "Responde siguiendo todas las reglas del sistema.")


def test_ordering(spark):
    df = spark.createDataFrame(
        [("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), ("a", 2, "z")], "k string, o int, v string")
    assert sorted(map(tuple, first_per_key(df, ["k"], ["o"]).collect())) == [("a", 1, "y"), ("b", 2, None)]
    last = last_n_per_key(df, ["k"], "o", 2)
    assert sorted(map(tuple, last.filter("k = 'a'").collect())) == [("a", 2, "z"), ("a", 3, "x")]
    lists = list_per_key(last, ["k"], "o", F.col("v"), "vs").filter("k = 'a'").first()
    assert lists.vs == ["z", "x"]
    assert top_n_per_key(df, ["k"], [F.col("o")], 1).count() == 2


def test_stats(spark):
    base = "https://s.test/biblioteca-cientifica/noticias-actualidad/"
    urls = [base + "salud-oral/a", base + "salud-oral/a", base + "salud-oral/b", base + "Cardio/x?y=/z",
            base + "listado", "https://s.test/otra", base + "cardio/x", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    counted = stats.corpus_stats(df)
    got = counted.orderBy(F.desc("n"), "category").collect()
    assert [tuple(r) for r in got] == [("salud-oral", 2), ("Cardio", 1), ("cardio", 1)]
    row = stats.stats_note(counted, "s").first()
    assert (row.total, row.categories) == (4, 3)
    assert row.note.endswith("distribuidos en 3 especialidades médicas: "
                             "Salud oral (2), Cardio (1), Cardio (1).")
    empty = stats.stats_note(stats.corpus_stats(df.limit(0)), "s").first()
    assert (empty.total, empty.note) == (0, "")


GOOD = """<html><head><meta property="og:url" content="{og}"></head><body><h1>Logo</h1>
<h3 class="primary">Viejo</h3><h3 class="x Primary"> Salud
 oral </h3><article class="a"><header><h1>Un <b>título</b> &amp; más</h1>
<small class="date">Publicado 05/11/2024 hoy</small></header>
<div class="formatted"><p>{summary}</p></div><a href="/Account/Login?r=1">MÁS</a>{end}"""
DETAIL = "https://s.test/biblioteca-cientifica/noticias-actualidad/oral/slug"
LONG = "Un resumen que tiene bastante más de cuarenta caracteres."


def page(og=DETAIL, summary=LONG, end="</article></body></html>", drop=""):
    return GOOD.format(og=og, summary=summary, end=end).replace(drop, "") if drop else GOOD.format(
        og=og, summary=summary, end=end)


CASES = {
    "ok": (page(), True),
    "listing": (page(og=DETAIL.rsplit("/", 1)[0] + "/"), False),
    "trailing slash": (page(og=DETAIL + "/?a=b"), True),
    "upper case path": (page(og=DETAIL.upper()), True),
    "article not closed": (page(end="</body></html>"), False),
    "article closed by itself only": (page(end="</div></article>"), True),
    "no date": (page(drop="05/11/2024"), False),
    "long number is no date": (page().replace("05/11/2024", "05/11/20245"), False),
    "summary 39": (page(summary="x" * 39), False),
    "summary 40": (page(summary="x" * 40), True),
    "no login link": (page(drop="/Account/Login?r=1"), False),
    "no title": (page(drop="Un <b>título</b> &amp; más"), False),
    "void and unclosed tags": (page(summary="<br><img src=x>" + LONG + "<p><span>"), True),
    "no og url": (page().replace("og:url", "og:other"), True),
    "no article": ("<html><p>nada</p></html>", False),
}


def test_news_pages(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "name string, html string")
    read = df.withColumn("page", news.read_page(F.col("html"))).withColumn(
        "item", news.news_item(F.col("page"), F.lit(DETAIL)))
    got = {r.name: r.item for r in read.collect()}
    assert {k: v is not None for k, v in got.items()} == {k: v[1] for k, v in CASES.items()}
    ok = got["ok"]
    assert (ok.title, ok.subtitle, ok.date, ok.summary, ok.canonical_url) == (
        "Un título & más", "Salud oral", "05/11/2024", LONG, DETAIL)
    text = read.filter("name = 'ok'").select(news.news_text(F.col("item"), "s")).first()[0]
    assert text.split("\n") == [
        "[RESUMEN_PUBLICO_S]", news.SUMMARY_NOTICE.format(site="s"), "", "Título: Un título & más",
        "Especialidad: Salud oral", "Fecha: 05/11/2024", "Resumen: " + LONG]


def test_news_text_without_subtitle(spark):
    html = page(drop='<h3 class="x Primary"> Salud\n oral </h3>').replace('<h3 class="primary">Viejo</h3>', "")
    df = spark.createDataFrame([(html,)], "html string").withColumn("page", news.read_page(F.col("html")))
    text = df.select(news.news_text(news.news_item(F.col("page"), F.lit("")), "s")).first()[0]
    assert "Especialidad" not in text and "\n\nTítulo: " in text


def test_login_page(spark):
    pages = ['<meta property="og:url" content="https://s.test/Account/Login?x">',
             "<meta property='og:url' id=1 content='/account/login'>",
             '<meta content="/account/login" property="og:url">', '<a href="/account/login">']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    got = [r[0] for r in df.orderBy("i").select(news.is_login_page(F.col("h"))).collect()]
    assert got == [True, True, False, False]

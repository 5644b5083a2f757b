"""Scalars against plain Python on awkward inputs."""

import hashlib
import re
import uuid
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from askorpus.config import Settings
from askorpus.providers import router_call
from askorpus.functions import rules as rl
from askorpus.functions import sse
from askorpus.functions import text as tx
from askorpus.functions import urls
from askorpus.functions import values as vl
from askorpus.functions import vectors as vx
from askorpus.catalogue.sample import FACTS, RULES_SAMPLE

ODD = [
    "", " ", "a", "  Hola  ", " x y\x85", "\x1ca\x1d b\x1f", "ΣΑΣ İß", "a\tb\r\n\nc",
    "　wide　", "emoji 😀 end", "​zero", "tab\x0bvt\x0cff", "ñandú ÁÉÍ",
]


def col_values(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_whitespace_rules_equal_python(spark):
    got = col_values(spark, ODD, tx.strip(F.col("v")), tx.squeeze(F.col("v")),
                     tx.normalise(F.col("v")), F.lower("v"), F.length("v"))
    want = [(v.strip(), re.sub(r"\s+", " ", v), re.sub(r"\s+", " ", v).strip(), v.lower(), len(v))
            for v in ODD]
    assert got == want


def test_whitespace_class_covers_the_plane(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c,) for c in chars], "v string")
    want = {c for c in chars if c.isspace()}
    assert {r.v for r in df.filter(F.length(tx.strip(F.col("v"))) == 0).collect()} == want
    squeezed = tx.squeeze(F.concat(F.lit("a"), "v", "v", F.lit("b")))
    assert {r.v for r in df.filter(squeezed == "a b").collect()} == want


def test_hashes(spark):
    got = col_values(spark, ODD, tx.content_hash(F.col("v")), tx.chunk_hash(F.col("v")))
    want = [(hashlib.sha256(v.encode()).hexdigest(),
             hashlib.sha256(re.sub(r"\s+", " ", v.strip().lower()).encode()).hexdigest()) for v in ODD]
    assert got == want


URLS = [
    "http://example.test/a?b=1#c", "https://WWW.Example.test/x/y/", "http://example.test",
    "HTTP://EXAMPLE.TEST/Ñ", "mailto:a@b", "not a url", "https://other.test/ü?q=é", "//example.test/p",
    "https://user@example.test:80/p", "",
]


def test_url_identifiers(spark):
    got = col_values(spark, URLS, urls.slug(F.col("v")), urls.document_id(F.col("v")),
                     urls.chunk_id(F.col("v"), F.lit(7)), urls.path(F.col("v")))
    want = [(hashlib.sha1(u.encode()).hexdigest(), int(hashlib.sha1(u.encode()).hexdigest()[:12], 16),
             str(uuid.uuid5(uuid.NAMESPACE_URL, f"{u}#7")), urlsplit(u).path) for u in URLS]
    assert got == want


def test_canonical_and_source(spark):
    hosts = {"example.test": "https://www.example.test", "www.example.test": "https://www.example.test"}
    got = [r[0] for r in col_values(spark, URLS, urls.canonical(F.col("v"), hosts))]
    assert got == [
        "https://www.example.test/a?b=1#c", "https://www.example.test/x/y/", "https://www.example.test",
        "https://www.example.test/Ñ", "mailto:a@b", "not a url", "https://other.test/ü?q=é",
        "https://www.example.test/p", "https://user@example.test:80/p", ""]
    src = [r[0] for r in col_values(spark, URLS, urls.source_of(F.col("v"), ["other", "example"]))]
    assert src == ["example"] * 4 + [None, None, "other", "example", "example", None]


def quality(chunk):
    if len(chunk.strip()) < 80:
        return False
    for _ in range(3):
        chunk = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", chunk)
        chunk = re.sub(r"\[[^\]]*\]\([^)]*\)", "", chunk)
    return len(re.sub(r"\s+", " ", chunk).strip()) >= 80


def test_quality(spark):
    w = "palabra "
    cases = [
        "x" * 79, "x" * 80, " " * 30 + "x" * 79 + " " * 30, "![alt](http://img/" + "a" * 90 + ")",
        "[![alt](img)](" + "u" * 90 + ")", w * 10 + "[t](u)", "[" * 3 + "a" * 90 + "](u)" * 3,
        "[a [b [c [d](1)](2)](3)](4)" + "y" * 70, " " * 50 + "z" * 80, "a b" * 40, "é" * 80,
        "](" * 60, "text " * 15 + "![i](p) [l](q) tail tail tail", "x" * 40 + " " * 60 + "y" * 38,
    ]
    assert [r[0] for r in col_values(spark, cases, tx.quality_ok(F.col("v")))] == [quality(c) for c in cases]


def test_titles(spark):
    def clean(raw):
        lines = raw.strip().strip('"').strip("'").splitlines()
        return (lines[0][:80] if lines else "") or "D"

    raws = ['"Hola"', "  'x' ", "line\nsecond", "a" * 100, "", "   ", '""', '"\nfoo"', "'\"both\"'",
            "vt\x0bnext", "sep next", "win\r\nnext", 'it\'s "fine"', "\"'mixed'\""]
    got = [r[0] for r in col_values(spark, raws, tx.clean_title(F.col("v"), "D"))]
    assert got == [clean(r) for r in raws]


def test_prettify(spark):
    slugs = ["salud-oral", "-a-b-", "MIXED-Case", "", "ñandú-X"]
    got = [r[0] for r in col_values(spark, slugs, tx.prettify(F.col("v")))]
    assert got == [s.replace("-", " ").strip().capitalize() for s in slugs]


def test_sources_json(spark):
    texts = [None, "", "null", "{}", '[{"url":"u","title":null,"score":0.5}]', "[]"]
    got = [r[0] for r in col_values(spark, texts, vl.encode_sources(vl.parse_sources(F.col("v"))))]
    assert got == [None, None, None, None, '[{"url":"u","title":null,"score":0.5}]', "[]"]
    payload = col_values(spark, [None], vl.sources_payload(vl.parse_sources(F.col("v"))))
    assert payload == [("[]",)]


def test_times(spark):
    texts = ["2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05", "", None, "nope",
             "2024-01-02T03:04:05+02:00", "2024-01-02", "2024-01-02 03:04:05.5"]
    want = ["2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05.000Z", None, None, None,
            "2024-01-02T01:04:05.000Z", "2024-01-02T00:00:00.000Z", "2024-01-02T03:04:05.500Z"]
    for zone in ("UTC", "America/Bogota", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = col_values(spark, texts, vl.render_time(vl.parse_time(F.col("v"))))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [r[0] for r in got] == want, zone


def test_uuid_or_null(spark):
    good = str(uuid.uuid4())
    values = [good, good.upper(), good + "x", "", None, str(uuid.UUID(int=0))]
    got = [r[0] for r in col_values(spark, values, vl.uuid_or_null(F.col("v")))]
    assert got == [good, good.upper(), None, None, None, None]


def frame(data, event):
    head = f"event: {event}\n" if event else ""
    return head + "\n".join(f"data: {x}" for x in data.replace("\r\n", "\n").split("\n")) + "\n\n"


def test_sse_frames(spark):
    data = ["hola", "a\nb", "a\r\nb\r\n", "", " lead", "x\n\ny"]
    got = col_values(spark, data, sse.encode_frame(F.col("v"), F.lit("token")),
                     sse.encode_frame(F.col("v"), F.lit(None).cast("string")))
    assert got == [(frame(d, "token"), frame(d, None)) for d in data]


def test_sse_decode(spark):
    streams = [
        "event: token\ndata: a\n\ndata:b\n\n", "data:  two spaces\n\n", "event: done\ndata: ok\n\nevent: cut",
        "", "event:x\nevent: y\ndata: 1\ndata: 2\n\n", ": comment\n\n", "data: no end"]
    got = [[tuple(f) for f in r[0]] for r in col_values(spark, streams, sse.decode_frames(F.col("v")))]
    assert got == [
        [("token", "a"), ("message", "b")], [("message", " two spaces")], [("done", "ok")], [],
        [("y", "1\n2")], [("message", "")], []]


def test_frames_round_trip(spark):
    data = ["a", "a\nb", " x", "", "é😀\n", "data: x"]
    back = sse.decode_frames(sse.encode_frame(F.col("v"), F.lit("token")))
    got = [[tuple(f) for f in r[0]] for r in col_values(spark, data, back)]
    assert got == [[("token", d)] for d in data]


def test_flatten_parts(spark):
    df = spark.sql("""SELECT array(named_struct('type','text','text','a'), named_struct('type','image','text','no'),
        named_struct('type','text','text',cast(null as string)), named_struct('type','text','text','b')) p""")
    assert df.select(vl.flatten_parts(F.col("p"))).first()[0] == "ab"
    empty = df.select(vl.flatten_parts(F.lit(None).cast("array<struct<type:string,text:string>>")))
    assert empty.first()[0] == ""


def test_scores_and_distance(spark):
    df = spark.sql("SELECT array(1f,2f) a, array(4f,6f) b")
    row = df.select(vx.distance(F.col("a"), F.col("b")), vx.distance(F.col("a"), F.col("b"), "l2"),
                    vx.score(F.lit(0.0)), vx.score(F.lit(1.5))).first()
    assert tuple(row) == (25.0, 5.0, 1.0, 0.4)
    with pytest.raises(ValueError):
        vx.distance(F.col("a"), F.col("b"), "cosine")


QUESTIONS = {
    "¿Me das el TELÉFONO?": "phone", "tu correo": "email", "¿a qué hora?": "hours", "el nit": "tax_id",
    "¿dónde queda?": "sites", "sus marcas": "brands", "qué productos hay": "business_lines",
    "busco empleo": "jobs", "línea ética": "ethics", "cuéntame algo": "general",
    # the first rule that fires wins, and a keyword may sit inside a word
    "teléfono de la línea ética": "phone", "ahora no": "hours", "unite": "tax_id",
    "mi celular": "general", "": "general",
}


def test_first_rule_wins(spark):
    got = col_values(spark, list(QUESTIONS), rl.matched_rule(F.col("v"), RULES_SAMPLE))
    assert [r[0] for r in got] == list(QUESTIONS.values())


def test_rule_answers(spark):
    asked = ["marcas", "sedes", "xyz", "productos"]
    got = [r[0] for r in col_values(spark, asked, rl.fact_answer(F.col("v"), RULES_SAMPLE))]
    assert got[0] == "Marcas de la empresa: Alfa, Beta, Gama"
    assert got[1] == ("Sedes de la empresa:\n• Norte (Uno): Calle 1 # 2-3\n"
                      "• Sur (Dos): Oficina comercial")
    assert got[2].startswith("Ejemplo S.A. (Ejemplo)\nNIT: 100.200.300-4 | Fundada: 1990")
    assert got[3] == "Líneas de negocio de la empresa:\n• Consumo\n• Industria"


def test_gate(spark):
    asked = ["Quiero LLAMAR", "celular", "hola", "mi rut"]
    got = [r[0] for r in col_values(spark, asked, rl.asks_for_fact(F.col("v")))]
    assert got == [True, True, False, True]


def test_facts_file(spark, tmp_path):
    import json

    from askorpus.sources.facts import read_rules

    path = tmp_path / "facts.json"
    path.write_text(json.dumps(FACTS, ensure_ascii=False, indent=1), "utf-8")
    assert read_rules(spark, str(path), Settings()) == RULES_SAMPLE


def test_branch(spark):
    got = col_values(spark, ["direct", "structured", "rag", "other", None], rl.branch(F.col("v")))
    assert [r[0] for r in got] == ["direct", "structured", "rag", "rag", "rag"]


def test_settings():
    s = Settings.from_env({"TOP_K": "3", "MIN_SCORE": "0.5", "UNKNOWN": "x", "LLM_ROUTER_MODEL": " "})
    assert (s.top_k, s.min_score, router_call(s).model) == (3, 0.5, s.llm_model)

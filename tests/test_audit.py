import pytest
from pyspark.sql import functions as F

from tamizal.functions import predicates as P
from tamizal.functions import text as T
from tamizal.operators import articles as A
from tamizal.operators import evalstats as E
from tamizal.operators import pipeline as L
from tamizal.operators import retrieval as R
from tamizal.operators import segments as G
from tamizal.sources import readers, sinks


def test_number_atoms(spark):
    got = spark.createDataFrame([("S/ 1,50 y 007 más 2.0; 1.5 y 10",), (None,)], "t string").select(T.number_atoms(F.col("t")).alias("a")).collect()
    assert [r["a"] for r in got] == [["1.5", "7", "2", "1.5", "10"], []]


def test_ink(spark):
    df = spark.createDataFrame([(bytearray([0, 229, 230, 255]),), (bytearray(),), (None,)], "p binary")
    assert [r["x"] for r in df.select(P.ink_ratio(F.col("p")).alias("x")).collect()] == [0.5, 0.0, None]


def test_parent_headers(spark):
    h = spark.createDataFrame([("t", 1, 0.0, 10.0, "Programa"), ("t", 2, 10.0, 20.0, "Fase"), ("t", 3, 20.0, 30.0, "Fase Il"), ("t", 4, 30.0, 40.0, "Total")], "tbl string, col int, x0 double, x1 double, text string")
    p = spark.createDataFrame([("t", 10.0, 30.0, "CEPREVAL"), ("t", 30.0, 50.0, "ORDINARIO")], "tbl string, x0 double, x1 double, text string")
    got = {r["col"]: r["label"] for r in G.parent_headers(h, p).collect()}
    assert got == {1: "Programa", 2: "CEPREVAL / Fase I", 3: "CEPREVAL / Fase II", 4: "ORDINARIO / Total"}


def test_clause_depths(spark):
    got = spark.createDataFrame([("1. Uno 1.2. Dos a) Tres",)], "t string").select(G.clause_depths(F.col("t")).alias("c")).first()["c"]
    assert [x["depth"] for x in got] == [0, 1, 1]


def test_event_date_and_sections(spark):
    df = spark.createDataFrame([(["1/1/2027"], "x"), (["1/1/2027", "2/1/2027"], "hasta cuando"), (["1/1/2027", "2/1/2027"], "desde cuando"), (["1/1/2027", "2/1/2027"], "que dia"), ([], "hasta")], "d array<string>, q string")
    assert [r["x"] for r in df.select(A.event_date(F.col("d"), F.col("q")).alias("x")).collect()] == ["1/1/2027", "2/1/2027", "1/1/2027", None, None]
    q = spark.createDataFrame([("a", "¿Qué entra en «Álgebra»?"), ("b", "¿Qué entra en «Física»?"), ("c", "nada")], "key string, query string")
    rows = spark.createDataFrame([(1, "ALGEBRA", "vectores"), (2, "Física", "x"), (3, "física", "y")], "row int, heading string, text string")
    assert [tuple(r) for r in A.topic_sections(q, rows).collect()] == [("a", 1, "vectores")]


def test_dispatch(spark):
    q = spark.createDataFrame([("a", "TEMARIO"), ("b", "REGLAMENTO"), ("c", None)], "key string, category string")
    x = spark.createDataFrame([("a", "REGLAMENTO", "1"), ("a", "VACANTES", "2"), ("b", "VACANTES", "3"), ("b", "REGLAMENTO", "4"), ("c", "OTRA", "5")], "key string, category string, answer string")
    assert sorted(map(tuple, A.dispatch(q, x).collect())) == [("a", "VACANTES", "2"), ("b", "REGLAMENTO", "4")]


def test_running_over_a_hot_key(spark):
    """Most rows in one group, nulls, and a group of one; the ranges cut through the group."""
    df = spark.range(5000).selectExpr("CASE WHEN id < 4990 THEN 'hot' WHEN id < 4995 THEN NULL ELSE 'few' END AS g", "id", "id % 7 AS c").repartition(9)
    got = {(r["g"], r["id"]): r["upto"] for r in E.running(df, ["g"], ["id"], "c").collect()}
    sums: dict = {}
    for i in range(5000):
        g = "hot" if i < 4990 else None if i < 4995 else "few"
        sums[g] = sums.get(g, 0) + i % 7
        assert got[g, i] == sums[g]


def test_describe_like_numpy(spark):
    import numpy as np

    values = np.round(np.random.default_rng(2).gamma(2, 3, 999), 2)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None), ("a", float("nan")), ("b", 4.0), ("b", 2.0)], "g string, v double")
    a, b = sorted(E.describe(df, ["g"], "v").collect(), key=lambda r: r["g"])
    s = np.sort(values)
    assert (a["n"], a["median"], a["p95"], a["upper_median"]) == (999, s[499], s[int(np.ceil(0.95 * 999)) - 1], s[499]) and (b["median"], b["upper_median"], b["p90"]) == (3.0, 4.0, 4.0)


def test_bootstrap_interval(spark):
    """The interval of a share is near the normal one, and the counts are Poisson."""
    import numpy as np

    df = spark.createDataFrame([("s", f"q{i}", float(i % 5 == 0)) for i in range(500)], "system string, id string, good double")
    r = E.bootstrap(df, "system", "id", "good").first()
    half = 1.96 * np.sqrt(0.2 * 0.8 / 500)
    assert r["n"] == 500 and r["mean"] == 0.2 and abs(r["low"] - (0.2 - half)) < 0.006 and abs(r["high"] - (0.2 + half)) < 0.006
    c = E.counts_of(np.arange(3000) * 977, np.arange(400), 1)
    assert abs(c.mean() - 1) < 0.01 and abs(c.var() - 1) < 0.02


def test_wilcoxon_p(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4, 5, -6, 7, 8)] + [("y", v) for v in [0.5] * 40 + [-0.25] * 40], "g string, d double")
    got = {r["g"]: r for r in E.wilcoxon(df, ["g"], "d").collect()}
    assert got["x"]["w_minus"] == 6 and got["x"]["p"] == pytest.approx(2 * 14 / 256, abs=5e-5)  # rounded to four places
    assert got["y"]["w_plus"] == 40 * 60.5 and got["y"]["p"] < 0.01
    z = spark.range(1).select(E.normal_tail(F.lit(1.959964)).alias("p")).first()["p"]
    assert z == pytest.approx(0.025, abs=1e-6)


def test_human_scores(spark):
    rows = [("i1", "A", "correct", "correct", None), ("i2", "A", "wrong", "correct", "partial"), ("i3", "A", "wrong", "wrong", None), ("i4", "A", "correct", "correct", None)]
    r = E.human_scores(spark.createDataFrame(rows, "item string, system string, a string, b string, resolved string"), "item", "system", "a", "b", "resolved", reps=500).first()
    assert (r["items"], r["strict"], r["lenient"], r["kappa"]) == (4, 0.5, 0.75, 0.5) and r["low"] <= 0.5 <= r["high"]


def test_conditions(spark):
    a = spark.createDataFrame([("k", "5"), ("model", "x")], "name string, value string")
    b = spark.createDataFrame([("k", "5"), ("model", "y"), ("seed", "1")], "name string, value string")
    assert sorted(map(tuple, E.same_conditions(a, b).collect())) == [("model", "x", "y"), ("seed", None, "1")] and E.same_conditions(a, a).count() == 0


def test_paired_runs_must_ask_the_same(spark):
    a = spark.createDataFrame([("i", "q", "x")], "id string, query string, answer string")
    assert readers.paired(a, a, "id", "query").count() == 1
    with pytest.raises(Exception, match="query differs"):
        readers.paired(a, a.withColumn("query", F.lit("other")), "id", "query").collect()


def test_intake_and_bytes(spark, tmp_path):
    u = spark.createDataFrame([("a", 0, None), ("b", 2, True), ("c", 2, None)], "name string, ocr_pages int, consent boolean")
    assert [r["status"] for r in readers.intake_status(u).orderBy("name").collect()] == ["processing", "processing_ocr", "awaiting_ocr_consent"]
    path = str(tmp_path / "f.bin")
    sinks.write_bytes(spark, path, b"one")
    sinks.write_bytes(spark, path, b"\x00two")
    assert sinks.read_bytes(spark, path) == b"\x00two"


def test_old_versions_go(spark, tmp_path):
    target = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_replaced(spark, target)
    frames = []
    for n in (1, 2, 3):
        sinks.replace_atomically(spark.range(n), target)
        frames.append(sinks.read_replaced(spark, target))
    assert frames[2].count() == 3 and frames[1].count() == 2 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2


def test_search_index(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "vacantes de historia"), (2, "a", ""), (3, "b", "historia historia música"), (4, "b", None)], "doc_id bigint, ws string, text string")
    index = R.lexical_index(d, "doc_id", "text", "ws")
    q = spark.createDataFrame([(7, "b", "historia de la música"), (8, "c", "historia")], "id bigint, ws string, query string")
    best = R.bm25_top_k(index, q, part="ws", min_score=-99.0).collect()
    assert [(r["id"], r["doc_id"]) for r in best] == [(7, 3)]
    assert {r["mean_length"] for r in index[1].where("part = 'b'").collect()} == {1.5}  # texts without tokens count
    sinks.write_search_index(index, d.select("doc_id", R.hashed_vector(F.col("text")).alias("v")), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index" / "texts")).where("part = 'a'").count() == 2
    with pytest.raises(Exception, match="exists"):
        sinks.write_search_index(index, d.select("doc_id"), str(tmp_path / "index"))


def test_variants(spark):
    """Each variant has the stages it names; what no stage before answers is generated, with the fixed reply where nothing is found."""
    texts = spark.createDataFrame([("s1", "Historia ofrece 5 plazas. Otra cosa.", "f", 1, 1), ("s2", "Sigue en la sede central.", "f", 1, 2)], "segment string, text string, source string, page int, seq bigint")
    search = lambda q, how, k: q.where("query like '%Historia%'").select("id", F.lit("s1").alias("segment"), F.lit(1).alias("rank"))
    cache = spark.createDataFrame([("c", "hola", "buenas")], "key string, query string, answer string").withColumn("vector", R.hashed_vector(F.col("query")))
    sources = L.Sources(search, texts, None, cache, R.hashed_vector)
    q = spark.createDataFrame([("a", "plazas de Historia"), ("b", "¿va a llover?"), ("c", "hola"), ("d", "otra")], "key string, query string")
    got = {r["key"]: (r["phase"], r["answer"]) for r in L.run(q, L.stages(L.VARIANTS["V4"], sources)).collect()}
    assert got["a"] == ("generated", "Historia ofrece 5 plazas.") and got["b"][0] == "router_ood" and got["c"] == ("cache_hit", "buenas") and got["d"][1].startswith("No encontré")
    assert {r["phase"] for r in L.run(q, L.stages(L.VARIANTS["V1"], sources)).collect()} == {"generated"}
    assert [s.phase for s in L.stages(L.VARIANTS["V4d"], sources)] == ["router_ood", "generated"] and set(L.TIMES) >= {"generated", "cache_hit"}


def test_promotion_is_blocked(spark):
    good = spark.createDataFrame([("a", "x", True), ("b", "y", True)], "query string, truth string, ok boolean")
    assert E.promotable(good, ["truth"], "query", F.col("ok")).count() == 2
    for bad, reason in (([("a", None, True)], "missing"), ([("a", "x", True), ("a", "y", True)], "twice"), ([("a", "x", None)], "verified")):
        with pytest.raises(Exception, match=reason):
            E.promotable(spark.createDataFrame(bad, good.schema), ["truth"], "query", F.col("ok")).collect()


def test_route(spark):
    df = spark.createDataFrame([("¿qué temas entran?", "VACANTES"), ("algo", " temario "), ("algo", "no sé"), ("¿va a llover?", None)], "q string, m string")
    got = [tuple(r["r"]) for r in df.select(P.route(F.col("q"), F.col("m"), ["TEMARIO", "VACANTES"]).alias("r")).collect()]
    assert got == [("TEMARIO", "rule:TEMARIO", None), ("TEMARIO", "model", None), (None, None, "invalid label no sé"), ("FUERA_DE_DOMINIO", "rule:FUERA_DE_DOMINIO", None)]


def test_reading_order(spark):
    t = spark.createDataFrame([(1, 0.5, "T")], "page int, y double, text string")
    p = spark.createDataFrame([(1, 0.9, "z"), (1, 0.1, "a"), (1, 0.5, "m"), (2, 0.3, "q")], "page int, y double, text string")
    got = [(r["page"], r["text"]) for r in G.in_reading_order(t, p).orderBy("page", "place").collect()]
    assert got == [(1, "a"), (1, "T"), (1, "m"), (1, "z"), (2, "q")]


def test_hashed_index_grows_its_planes(spark):
    """Clustered vectors, more planes than on small tables: nearly all true neighbours, far from all rows scored."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    v = centres[rng.integers(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id % 200 = 0")
    want = {(r["query"], r["vec_id"]) for r in R.dense_top_k(df, asked).collect()}
    for planes in (None, 12):
        got = {(r["query"], r["vec_id"]) for r in R.lsh_top_k(df, asked, planes=planes).collect()}
        assert len(got & want) >= 0.95 * len(want)

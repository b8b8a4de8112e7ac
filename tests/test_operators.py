import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamizal.operators import articles as A
from tamizal.operators import cache as C
from tamizal.operators import evalstats as E
from tamizal.operators import pipeline as L
from tamizal.operators import retrieval as R
from tamizal.operators import segments as G
from tamizal.operators import table_language as Q
from tamizal.operators import tables as B
from tamizal.sources import readers, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def grid(spark):
    lines = [
        (1, "Programa: Arte Nuevo | G / sede: 3 | G / total: 5 | H / sede: 4 | Total: 9"), (2, "Programa: Danza | G / sede: 7 | G / total: 7 | H / sede: 1 | Total: x"),
        (3, "Programa: Danza Andina | G / sede: 2 | H / sede: 2 | Total: 5"),
    ]
    df = spark.createDataFrame(lines, "line int, text string")
    c = B.cells(df, ("line",), "text")
    from pyspark.sql import Window

    return c.withColumn("entity", F.min(F.when(F.col("label") == "Programa", F.col("value"))).over(Window.partitionBy("line")))


def test_grand_totals(grid):
    found = {r["line"]: (r["total"], r["consistent"]) for r in B.grand_totals(grid, ("line",)).collect()}
    assert found == {1: (9, True), 2: (8, None), 3: (5, False)}


def test_resolve_needs_one_reading(spark, grid):
    q = spark.createDataFrame([("a", "cuántas de sede G en Danza Andina"), ("b", "cuántas plazas en Danza Andina"), ("c", "sede G de Arte Nuevo y Danza"), ("d", "sede de Arte Nuevo")], "id string, query string")
    cells = grid.where("label <> 'Total'").selectExpr("'t' AS tbl", "line AS row", "place", "entity", "label", "number", "value")
    got = Q.column_readings(Q.Asked(q, cells, "id", "query", False)).where("kind = 'column_cell'")
    assert rows(got.select("k", "subject", "label", "number")) == [("a", "Danza Andina", "G / sede", 2)]


def test_label_score(spark):
    score = lambda label, asked: spark.range(1).select(B.label_score(F.lit(label), F.array(*(F.lit(x) for x in asked))).alias("s")).first()["s"]
    assert score("ORDINARIO / Total de Vacantes", ["ordina", "total"]) == 2
    assert score("TOTAL GENERAL", ["cuanta"]) is None
    assert score("FASE / Libre", ["libre", "fase"]) == 3


def test_superlative_keeps_ties(spark):
    df = spark.createDataFrame([("t", "a", 5), ("t", "b", 5), ("t", "c", 1)], "tbl string, entity string, number int")
    assert rows(B.superlative(df, ("tbl",))) == [("t", "a", 5), ("t", "b", 5)]


def test_fusion_and_merge(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q int, d int, rank int")
    got = [r["d"] for r in R.fuse(a, b, ["q", "d"]).orderBy("rank").collect()]
    assert got == [11, 10, 12]


def test_search_recall(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0")
    exact = {(r["query"], r["vec_id"]) for r in R.dense_top_k(e, q).collect()}
    near = {(r["query"], r["vec_id"]) for r in R.lsh_top_k(e, q, planes=4, tables=24).collect()}
    v = {r["vec_id"]: np.array(r["embedding"]) for r in e.collect()}
    brute = {(a, b) for a in v if a % 50 == 0 for b in sorted((x for x in v if x != a), key=lambda x: (-round(float(v[a] @ v[x]), 6), x))[:10]}
    assert exact == brute
    assert len(exact & near) >= 0.9 * len(exact)


def test_registered_search_recall(spark, data):
    from tamizal.plans import catalog

    found = lambda name: {(r["query"], r["vec_id"]) for r in catalog.QUERIES[name](spark, data).collect()}
    exact = found("dense_top10")
    assert len(exact & found("lsh_top10")) >= 0.9 * len(exact)


def test_merge_takes_every_label(spark, tmp_path):
    from tamizal.plans import catalog

    near = [(i, [1.0, i / 1000], "x") for i in range(1, 80) if i != 50]
    far = [(100 + i, [0.5, 0.0], "y") for i in range(1, 5)]
    spark.createDataFrame([(50, [1.0, 0.0], "x"), *near, *far, (201, [0.1, 0.0], None)], "vec_id bigint, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r["vec_id"], r["label"]) for r in catalog.QUERIES["global_merge6"](spark, str(tmp_path)).where("query = 50").orderBy("rank").collect()]
    assert got == [(1, "x"), (2, "x"), (3, "x"), (101, "y"), (102, "y"), (103, "y")]


def test_neighbours_and_continuation(spark):
    r = spark.createDataFrame([("a", "s", 1, 1, "x" * 200), ("b", "s", 1, 2, "y"), ("c", "s", 2, 3, "z" * 200), ("d", "s", 2, 4, "w" * 300)], "id string, source string, page int, seq int, text string")
    hits = spark.createDataFrame([("b", "s", 1, 2)], "hit string, source string, page int, seq int")
    assert rows(R.with_neighbours(hits, r).select("hit", "id", "distance")) == [("b", "a", -1), ("b", "b", 0)]
    assert rows(R.continuations(hits.select("hit", "source", "page"), r).select("hit", "id")) == [("b", "c")]


def test_mcnemar_published_value(spark):
    df = spark.createDataFrame([(15, 7), (10, 0), (0, 0)], "a int, b int")
    assert [round(r[0], 5) for r in df.select(E.mcnemar_p(F.col("a"), F.col("b"))).collect()] == [0.1338, 0.00195, 1.0]


def test_wilcoxon(spark):
    df = spark.createDataFrame([("g", x) for x in (1.0, -2.0, 2.0, 0.0, 3.0, None, float("nan"))], "g string, d double")
    r = E.wilcoxon(df, ["g"], "d").first()
    assert (r["n"], r["w_plus"], r["w_minus"], r["w"]) == (4, 7.5, 2.5, 2.5)
    assert E.wilcoxon_exact_p(5, 0) == 2 / 32


def test_adjudication_fails_unresolved(spark):
    df = spark.createDataFrame([("C", "C", None), ("C", "I", "I")], "a string, b string, r string")
    assert [x["rating"] for x in E.adjudicated(df, "a", "b", "r").collect()] == ["C", "I"]
    with pytest.raises(Exception, match="raters differ"):
        E.adjudicated(spark.createDataFrame([("C", "I", None)], "a string, b string, r string"), "a", "b", "r").collect()


def test_chunks(spark):
    words = " ".join(f"palabra{i}" for i in range(385))
    got = spark.range(1).select(G.chunks(F.lit(words)).alias("c")).first()["c"]
    assert [len(x.split()) for x in got] == [200, 200, 25]
    assert spark.range(1).select(G.chunks(F.lit("corto")).alias("c")).first()["c"] == []


def test_block_graph(spark):
    b = [(1, "t", "TABLE", ["c1", "c2"], None, None, None, None, None, None, 0), (1, "c1", "CELL", ["w1", "w2"], 1, 1, 1, 2, None, None, 0), (1, "c2", "CELL", [], 2, 1, 1, 1, None, None, 0), (1, "w1", "WORD", [], None, None, None, None, "Hola", 0.9, 1), (1, "w2", "WORD", [], None, None, None, None, "tú", 0.4, 2)]
    df = spark.createDataFrame(b, "page int, id string, kind string, children array<string>, row int, col int, row_span int, col_span int, text string, confidence double, place int")
    cells = G.parse_blocks(df)
    assert rows(cells.select("row", "col", "col_end", "text", "confidence")) == [(1, 1, 2, "Hola tú", 0.4), (2, 1, 1, "", None)]
    assert [tuple(r) for r in G.raster(cells, ("page", "tbl")).orderBy("row").select("row", "row_values").collect()] == [(1, ["Hola tú", "Hola tú"]), (2, ["", ""])]


def test_positional(spark):
    df = spark.createDataFrame([("d", 1, "COMPREN"), ("d", 2, "SIÓN lectora"), ("d", 3, "otro")], "d string, seq int, text string")
    assert rows(G.spans_equal(df, ("d",), "seq", "text", F.lit("compren sion lectora"))) == [("d", 1, 2)]
    w = G.wrapped_rows(df, ("d",), "seq", F.col("text") == "SIÓN lectora", "text")
    assert rows(w.select("seq", "text")) == [(1, "COMPREN SIÓN lectora"), (3, "otro")]
    ys = spark.createDataFrame([("p", 1.0, 10.0), ("p", 2.0, 10.0), ("p", 9.0, 10.0)], "p string, y double, h double")
    assert [r["line_no"] for r in G.cluster_lines(ys, ("p",), "y", "h").orderBy("y").collect()] == [1, 1, 2]
    assert rows(G.cluster_boundaries(ys, ("p",), "y", 2.0)) == [("p", 1.5, 2), ("p", 9.0, 1)]


def test_lines_outside_tables(spark):
    l = spark.createDataFrame([(1, 5.0, 5.0), (1, 50.0, 5.0), (2, 5.0, 5.0)], "page int, x double, y double")  # noqa: E741
    t = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert rows(G.lines_outside_tables(l, t)) == [(1, 50.0, 5.0), (2, 5.0, 5.0)]


def test_cache(spark):
    v = lambda *x: [float(i) for i in x]
    cache = spark.createDataFrame([(-1, "plazas de Historia", v(1, 0)), (-2, "fecha del examen 2027", v(0, 1))], "key bigint, query string, vector array<double>")
    asked = spark.createDataFrame([(1, "Plazas  de historia", v(1, 0)), (2, "fecha del examen 2026", v(0, 1)), (3, "plazas historia", v(1, 0)), (4, "otra cosa", v(0.1, 0.1))], "key bigint, query string, vector array<double>")
    got = {r["key"]: (r["cached"], r["how"]) for r in C.lookup(asked, cache).collect()}
    assert got == {1: (-1, "exact"), 3: (-1, "similar")}


def test_cache_upsert(spark):
    s = "query string, answer string, sources array<string>, created_at string, hits bigint"
    old = spark.createDataFrame([("Hola", "a", ["x"], "2026-01-01", 4)], s)
    new = spark.createDataFrame([("hola ", "b", ["x"], "2026-01-02", 9), ("nada", None, ["x"], "2026-01-02", 0)], s)
    assert [(r["answer"], r["hits"]) for r in C.upsert(old, new).collect()] == [("b", 0)]


def test_states(spark):
    h = spark.createDataFrame([("d", 1, "processing"), ("d", 2, "ready"), ("e", 1, "processing"), ("e", 2, "indexing"), ("e", 3, "ready")], "document_id string, at int, status string")
    assert rows(C.invalid_transitions(h)) == [("d", 2, "processing", "ready")]


def test_pipeline_stages(spark):
    q = spark.createDataFrame([("a", "¿va a llover?"), ("b", "hola")], "key string, query string")
    got = {r["key"]: r["phase"] for r in L.run(q, [L.rule_exit()]).collect()}
    assert got == {"a": "router_ood", "b": "unanswered"}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "system": "V1", "answer": "x"}\n\nno json\n{"id": "a", "system": "V1", "answer": "y"}\n')
    assert [r["answer"] for r in readers.read_runs(spark, str(tmp_path / "r.jsonl")).collect()] == ["y"]
    (tmp_path / "b.csv").write_text("﻿id,query\n1,¿Qué?\n", encoding="utf-8")
    assert readers.read_bank_csv(spark, str(tmp_path / "b.csv")).columns == ["id", "query"]
    (tmp_path / "VACANTES.json").write_text('[{"id": "s", "text": "t", "category": "VACANTES"}]')
    assert readers.read_index_json(spark, str(tmp_path), ["VACANTES", "TEMARIO"]).count() == 1
    target = str(tmp_path / "t")
    sinks.replace_atomically(spark.range(3), target)
    sinks.replace_atomically(spark.range(5), target)
    assert sinks.read_replaced(spark, target).count() == 5
    done = str(tmp_path / "done")
    assert sinks.append_pending(spark.range(4), done, ["id"], lambda d: d) == 4
    assert sinks.append_pending(spark.range(6), done, ["id"], lambda d: d) == 2
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, datetime.date(2026, 1, 1)), (2, datetime.date(2026, 1, 9))], "x int, day date").write.partitionBy("day").parquet(log)
    assert sinks.drop_expired(spark, log, "day", datetime.date(2026, 1, 10)) == ["day=2026-01-01"]


def test_uploads(spark):
    u = spark.createDataFrame([("a", bytearray(b"%PDF-1"), 2), ("b", bytearray(b"%PDF-1"), 2), ("c", bytearray(b"zip"), 1), ("d", bytearray(b"%PDF-2"), 900)], "name string, content binary, pages int")
    got = {r["name"]: r["verdict"] for r in readers.validate_uploads(u, spark.createDataFrame([], "sha256 string")).collect()}
    assert got == {"a": "accepted", "b": "duplicate", "c": "no_pdf", "d": "too_many_pages"}
    with pytest.raises(Exception, match="repeated key"):
        readers.one_to_one(spark.createDataFrame([("k", 1), ("k", 2)], "q string, v int"), spark.createDataFrame([("k", 1)], "q string, v int"), "q").collect()


def test_article_over_pages(spark):
    text = [("s", 1, 1, 1, "Artículo 7. La comisión revisa"), ("s", 1, 1, 2, "los expedientes y"), ("s", 2, 2, 1, "los devuelve. UNIVERSIDAD"), ("s", 3, 3, 1, "Artículo 8. Otra cosa."), ("t", 1, 9, 1, "sin artículo")]
    df = spark.createDataFrame(text, "source string, page int, seq int, line_no int, line string")
    got = {r["article"]: (r["text"], r["pages"], r["lines"]) for r in A.article_texts(df).collect()}
    assert got == {7: ("Artículo 7. La comisión revisa\nlos expedientes y\nlos devuelve.", 2, 3), 8: ("Artículo 8. Otra cosa.", 1, 1)}


def test_date_cells(spark):
    r = spark.createDataFrame([("EXAMEN FASE I", "inscripciones", ["1/2/2026", "9/2/2026"]), ("EXAMEN FASE II", "inscripciones", ["3/3/2026"]), ("EXAMEN FASE II", "inscripciones", ["4/3/2026"])], "heading string, item string, dates array<string>")
    a = spark.createDataFrame([("inscripciones", "inscripcion")], "item string, alias string")
    q = spark.createDataFrame([("a", "hasta cuándo es la inscripción de la fase I"), ("b", "inscripción fase I"), ("c", "inscripción de la fase II"), ("d", "inscripción")], "id string, query string")
    got = {x["id"]: x["answer"] for x in A.date_cells(q, r, a).collect()}
    assert got == {"a": "9/2/2026", "b": "Del 1/2/2026 al 9/2/2026"}


def test_outline_and_quantities(spark):
    r = spark.createDataFrame([("d", i, t) for i, t in enumerate(["COMPRENSIÓN", "1. Textos", "texto", "2. Ideas", "LÓGICA", "1. Juicios"])], "d string, seq int, text string")
    got = {x["text"]: x["items"] for x in A.outline(r, ("d",), "seq", "text", F.col("text").rlike("^[A-ZÓ]+$")).collect()}
    assert got == {"COMPRENSIÓN": ["1. Textos", "2. Ideas"], "LÓGICA": ["1. Juicios"]}
    c = spark.createDataFrame([("t", i, p, f"c{p}", str(i * p) if i < 3 else "x") for i in (1, 2, 3) for p in (1, 2)], "tbl string, row int, place int, label string, value string")
    assert rows(A.quantitative(c, ("tbl",), "row")) == [("t", 2, "c1: 1; c2: 2\nc1: 2; c2: 4")]


def test_source_page_hits(spark):
    r = spark.createDataFrame([("a", [("s", 1), ("s", 2)]), ("b", [])], "id string, contexts array<struct<source:string,page:int>>")
    e = spark.createDataFrame([("a", "s", 2), ("b", "s", 2)], "id string, source string, page int")
    assert rows(A.source_page_hits(r, e)) == [("a", True), ("b", False)]


def test_means_of_every_system(spark, data):
    from collections import defaultdict

    from tamizal.plans import catalog

    category = {r["id"]: r["category"] for r in spark.read.parquet(f"{data}/question_bank.parquet").collect()}
    seconds = defaultdict(list)
    for r in spark.read.parquet(f"{data}/runs.parquet").select("id", "system", "elapsed_s").collect():
        if r["id"] in category and r["elapsed_s"] is not None and r["elapsed_s"] == r["elapsed_s"]:
            seconds[category[r["id"]], r["system"]].append(r["elapsed_s"])
    got = {(r["category"], r["system"]): r["mean"] for r in catalog.QUERIES["variant_means"](spark, data).collect()}
    assert got == {k: pytest.approx(sum(v) / len(v), abs=1e-6) for k, v in seconds.items()}


def test_every_attempt_counts(spark, tmp_path):
    from tamizal.plans import catalog

    spark.createDataFrame([("a", "hola"), ("b", "plazas"), ("c", "nadie")], "id string, query string").write.parquet(f"{tmp_path}/question_bank.parquet")
    runs = [("a", "V1", 1, "Hola", "1. Uno 2. Dos"), ("b", "V1", 2, "¿Plazas?", "1. Uno"), ("b", "V1", 3, "¿Plazas?", "1. Uno"), ("b", "V1", 3, "¿Plazas?", "1. Uno"), ("b", "V1", 4, "otra", "nada")]
    spark.createDataFrame(runs, "id string, system string, attempt int, query string, answer string").write.parquet(f"{tmp_path}/runs.parquet")
    assert rows(catalog.QUERIES["clause_counts"](spark, str(tmp_path)).select("id", "system", "attempt", "clauses")) == [("a", "V1", 1, 2), ("b", "V1", 2, 1), ("b", "V1", 3, 1)]
    assert rows(catalog.QUERIES["leakage_overlap"](spark, str(tmp_path))) == [("hola",), ("plazas",)]


def test_classifiers(spark):
    from tamizal.operators import ml as M

    words = {"x": "uno dos tres", "y": "cuatro cinco seis", "z": "siete ocho nueve"}
    df = spark.createDataFrame([(i, k, f"{w} {i % 5}") for k, w in words.items() for i in range(20)], "id int, label string, text string")
    f = M.folds(M.features(df.coalesce(1), "text"), F.col("id"), 2).cache()
    assert f.groupBy("id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    for kind in ("svm", "bayes", "logistic"):
        assert M.cross_validated(f, kind, "label", 2, buckets=256, rounds=4).where("label = predicted").count() == 60


def test_bm25_moves_only_the_best(spark, monkeypatch):
    from tamizal.operators import retrieval as R

    texts = [(i, "curso " * (i % 7 + 1) + f"tema{i % 40} " * 2 + "aula " * (i % 3)) for i in range(600)] + [(None, "curso tema1")]
    d = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    q = spark.createDataFrame([(i, f"tema{i} aula curso tema{i + 1}") for i in range(30)], "id int, query string")
    index = R.lexical_index(d, "doc_id", "text")
    found = R.bm25_top_k(index, q, k=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # no posting moves, each task keeps the best of its texts
    rows = {tuple(r) for r in found.collect()}
    t, terms = (x.collect() for x in index)
    weight = {r["term"]: (r["idf"], r["mean_length"]) for r in terms}
    for i in range(30):
        scores = []
        for r in t:
            s = 0
            for word in (f"tema{i}", "aula", "curso", f"tema{i + 1}"):
                if (tf := r["tokens"].count(word)) and word in weight:
                    idf, mean = weight[word]
                    s += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * r["length"] / mean))
            if round(s, 6) and r["doc_id"] is not None:
                scores.append((-round(s, 6), r["doc_id"]))
        assert [(d, n) for d, n in sorted((r[1], r[3]) for r in rows if r[0] == i)] == sorted((d, n + 1) for n, (_, d) in enumerate(sorted(scores)[:4]))
    monkeypatch.setattr(R, "ASKED_TERMS", 20)  # several passes give the same
    assert {tuple(r) for r in R.bm25_top_k(index, q, k=4).collect()} == rows


def test_once_moves_only_repeated_keys(spark, tmp_path):
    from tamizal.sources.tables import once

    rows = [(f"k{i}", "x") for i in range(50)] + [("k3", "x"), ("k3", "x"), (None, "y"), (None, "y")]
    spark.createDataFrame(rows, "id string, text string").write.parquet(str(tmp_path / "t"))
    df = once(spark.read.parquet(str(tmp_path / "t")), "id")
    assert sorted(map(tuple, df.collect()), key=str) == sorted({(a, b) for a, b in rows}, key=str)
    assert "LeftAnti" in df._jdf.queryExecution().optimizedPlan().toString()  # the other rows stay where they are

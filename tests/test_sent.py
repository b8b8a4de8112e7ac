import random

import pytest
from pyspark.sql import functions as F

from tamizal import session
from tamizal.operators import pipeline as P
from tamizal.operators import table_language as L
from tamizal.session import materialize


@pytest.fixture
def shuffled(spark):
    """A function: MB shuffled by what it runs, where no join is a broadcast one by its size."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6

    def run(work):
        before = total()
        work()
        return total() - before

    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield run
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def _texts(spark, n):
    draw = random.Random(3)
    rows = [(f"s{i}", f"{draw.randbytes(200).hex()}.", f"f{i // 9}", i % 9 // 3, i) for i in range(n)]
    return materialize(spark.createDataFrame(rows, "segment string, text string, source string, page int, seq bigint"), "texts")


def _sources(spark, texts):
    return P.Sources(lambda q, how, k: q.crossJoin(spark.createDataFrame([("s4", 1), ("s12", 2)], "segment string, rank int")), texts)


def test_texts_stay(spark, shuffled):
    """Only the texts that were found move, not all of them."""
    texts = _texts(spark, 10_000)
    q = spark.createDataFrame([("a", "qué"), ("b", "cuál")], "key string, query string")
    got = []
    assert shuffled(lambda: got.extend(P.generation(P.VARIANTS["V4"], _sources(spark, texts)).answer(q).collect())) < 0.5
    first = texts.where("segment = 's4'").first()["text"]
    assert sorted(tuple(r) for r in got) == [("a", first, "s4,s12"), ("b", first, "s4,s12")]


def test_cells_stay(spark, shuffled):
    """A few questions go to the cells; the cells don't move once they are written."""
    draw = random.Random(5)
    named = [(f"t{t}", f"{draw.randbytes(16).hex()}{r}", f"Carrera {draw.randbytes(8).hex()}") for t in range(60) for r in range(40)]
    rows = [(t, r, c, e, f"Grupo / Sede {c}", draw.randrange(900)) for t, r, e in named for c in range(10)]
    cells = spark.createDataFrame(rows, "tbl string, row string, place int, entity string, label string, number bigint").withColumn("value", F.col("number").cast("string"))
    tables = L.Tables(cells)
    q = spark.createDataFrame([("a", "¿Cuánto suman todas las carreras en sede 3?"), ("b", f"¿Cuántas vacantes de sede 3 tiene {rows[0][3]}?"), ("c", "¿Qué programa tiene exactamente 5 vacantes en sede 3?")], "id string, query string")

    def work():
        L.aggregate_readings(L.Asked(q, tables, "id", "query", True)).collect()
        L.column_readings(L.Asked(q, tables, "id", "query", False)).collect()

    assert shuffled(work) < 2


def test_places_stay(spark, shuffled):
    """Only the places next to what was found move."""
    texts = _texts(spark, 10_000)
    q = spark.createDataFrame([("a", "qué")], "key string, query string")
    got = []
    assert shuffled(lambda: got.extend(P.generation(P.VARIANTS["V4d"], _sources(spark, texts), lambda _, fragments: F.array_join(fragments, "|")).answer(q).collect())) < 0.1
    text = {r["segment"]: r["text"] for r in texts.where("seq < 20").collect()}
    assert [tuple(r) for r in got] == [("a", "|".join(text[s] for s in ("s3", "s4", "s5", "s12", "s13")), "s4,s12")]


@pytest.mark.parametrize("rows", [0, 100_000])
def test_either_way(spark, monkeypatch, rows):
    """What is sent or moved gives the same rows."""
    monkeypatch.setattr(session, "SENT_ROWS", rows)
    few, many = spark.range(3).withColumn("x", F.col("id") * 2), spark.range(10).withColumn("y", F.col("id") + 1)
    assert sorted(tuple(r) for r in many.join(session.sent(few), "id").collect()) == [(0, 1, 0), (1, 2, 2), (2, 3, 4)]

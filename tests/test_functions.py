from pyspark.sql import functions as F

from tamizal.functions import predicates as P
from tamizal.functions import text as T


def one(spark, expression, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(expression.alias("x")).first()["x"]


def test_norm(spark):
    assert one(spark, T.norm(F.lit("  ÍNDICE 1.º — Straße_ Ｑué  "))) == "indice 1 o strasse_ que"
    assert one(spark, T.norm(T.norm(F.lit("Ñandú / Óptica")))) == "nandu optica"
    assert one(spark, T.norm(F.lit(None).cast("string"))) is None
    assert one(spark, T.tokens(F.lit("¿Cuántas vacantes hay, en (Historia)?"))) == ["cuántas", "vacantes", "historia"]
    assert one(spark, T.tokens(F.lit(""))) == []


def test_fields_keep_repeated_labels(spark):
    row = "Tabla 2 — fila 3: Programa: Arte | G / a: 1 | G / a: 2 | vacía: "
    assert [tuple(x) for x in one(spark, T.fields(F.lit(row)))] == [("Programa", "Arte"), ("G / a", "1"), ("G / a", "2")]
    assert one(spark, T.number(F.lit(" 007 \r"))) == 7
    assert one(spark, T.number(F.lit("1.5"))) is None


def test_articles(spark):
    assert one(spark, T.is_article_heading(F.lit("ARTÍCULO 012°. Los postulantes"), F.lit("12")))
    assert not one(spark, T.is_article_heading(F.lit("artículo 8° de la Ley"), F.lit("8")))
    assert one(spark, T.cut_at_next_heading(F.lit("Artículo 1. Uno dos. Artículo 2. Tres."))) == "Artículo 1. Uno dos."
    assert one(spark, T.drop_trailing_artifact(F.lit("Termina aquí. UNIVERSIDAD NACIONAL 12"))) == "Termina aquí."
    text = "UNIV. NAC. Página 3 de 9 | REGLAMENTO sigue la frase que venía de antes."
    assert one(spark, T.article_body(F.lit(text), continuation=True)) == "sigue la frase que venía de antes."
    assert one(spark, T.ends_complete(F.lit("Así es.»"))) and not one(spark, T.ends_complete(F.lit("así es,")))


def test_numbers(spark):
    assert one(spark, T.number_tokens(F.lit("1,5 y 1.5 y 20/03"))) == ["1.5", "20/03"]
    assert one(spark, T.standalone_integers(F.lit("el 01/02/2027 hay 12 (pág. 4) y 12 más"))) == ["12"]
    assert one(spark, T.integers(F.lit("007 7 0"))) == ["7", "7", "0"]
    assert one(spark, T.days_between(F.lit("5/7/2026"), F.lit("1/7/2026"))) == 4
    assert one(spark, T.days_between(F.lit("nada"), F.lit("1/7/2026"))) is None


def test_consensus_and_ratio(spark):
    a, b = "uno dos tres cuatro cinco seis", "uno dos tres cuatro cinco siete"
    assert one(spark, T.token_consensus(F.lit(a), F.lit(b))) == "uno dos tres cuatro cinco"
    assert one(spark, T.token_consensus(F.lit("a b"), F.lit("a b"))) is None
    assert one(spark, T.sequence_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75


def test_outcome(spark):
    must = F.array(F.lit("\\b12\\b"))
    judge = lambda answer, abstain=False, kind="lookup": one(spark, P.outcome(must, F.lit(abstain), F.lit(kind), F.lit(answer)))
    assert judge("Hay 12 plazas.") == "correct"
    assert judge("1, 2, 3, 12, 15, 19 y 20") == "wrong"
    assert judge("No figura. 12") == "abstained"
    assert judge("No figura la reserva en el documento; " + "palabra " * 15 + "son 12 plazas.") == "correct"
    assert judge("No encontré esa información", abstain=True) == "correct"
    assert judge(None) == "wrong"


def test_router_precedence(spark):
    route = lambda q: one(spark, P.rule_route(P.rule_text(F.lit(q))))
    assert route("¿Entra el clima en el temario?") == "TEMARIO"
    assert route("¿Va a llover por la inscripción?") == "FUERA_DE_DOMINIO"
    assert route("¿Cuándo es el examen?") == "CRONOGRAMA"
    assert route("hola") is None


def test_quality_and_guards(spark):
    pages = spark.createDataFrame([("corto",), ("Una página con bastantes palabras legibles para el lector de hoy.",), (None,)], "text string")
    got = {r["text"]: r["quality"] for r in P.with_text_quality(pages).collect()}
    assert got["corto"]["reason"] == got[None]["reason"] == "too_little_native_text"
    assert {r["status"] for t, r in got.items() if t and len(t) > 9} == {"native_text"}
    assert one(spark, P.supported_numbers(F.lit("son 12"), F.lit("12 plazas"), F.lit("")))
    assert not one(spark, P.supported_numbers(F.lit("son 13"), F.lit("12 plazas"), F.lit("")))
    assert one(spark, P.reversed_verdict(F.lit("FUERA_DE_DOMINIO"), F.lit("TEMARIO"), F.lit(0.7), F.lit(False))) == "TEMARIO"
    assert one(spark, P.reversed_verdict(F.lit("FUERA_DE_DOMINIO"), F.lit("TEMARIO"), F.lit(0.7), F.lit(True))) == "FUERA_DE_DOMINIO"

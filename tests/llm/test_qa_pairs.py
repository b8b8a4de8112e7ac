import pytest

from tamizal.llm import qa_pairs as Q

ASKED = "¿Cuántas vacantes hay en Historia por Traslado Externo?"
CASES = [
    ("empty", [None, "", "  \n", "​", "—", "N/A", "null", "{}", "«»"]),
    ("copy", [ASKED, ASKED.upper(), f"«{ASKED}»", f"Pregunta: {ASKED}", f"{ASKED} {ASKED}"]),
    ("refusal", ["No encontré esa información en los documentos.", "Lo siento, eso excede mis funciones. Consulte la página oficial.", "Solo atiendo temas de admisión y este no lo es.", "Sorry, I could not find that information."]),
    ("language", ["There are 12 places for Historia under Traslado Externo.", "Há 12 vagas para Historia na modalidade.", "Il y a 12 places pour la filière Historia au campus.", "Ci sono 12 posti per il corso di Historia nella sede."]),
    ("truncated", ["Hay 12 vacantes para la carr", "Del 01/02/2027 al 03/0", "Según el cuadro, hay (", "El plazo vence el…", "Fuente: VACANTES 2027.pdf p."]),
    (None, ["12", "Hola. 12", "Respuesta: S/ 71.00", "Del 01/02/2027 al 03/04/2027", "Historia: 12 vacantes (Traslado Externo)", "No encontré una prórroga publicada, pero el plazo corre del 01/02/2027 al 03/04/2027.", "Hay 12 vacantes; no se indica la reserva."]),
]


@pytest.mark.parametrize(("defect", "answer"), [(d, a) for d, many in CASES for a in many])
def test_rules(defect, answer):
    assert Q.pair_defect(ASKED, answer) == defect


def test_neighbours_across_partitions(spark):
    long = "Las inscripciones van del 01/02/2027 al 03/04/2027. Fuente: REGLAMENTO 2026.pdf Art.42."
    rows = [("q", long[:n]) for n in range(1, len(long) + 1)]
    df = spark.createDataFrame(rows + rows, "id string, answer string").repartition(7)
    got = {r["a"] for r in Q.Compared(df, "id", "answer", None).shortened().collect()}
    assert got == {a for _, a in rows[:-1] if Q.goes_on_inside(a, long)}  # every longer version counts, not only the next
    assert long[: long.index(".pdf")] + "." in got


def test_operator(spark):
    rows = [(f"q{i}", "V1", 1, ASKED, a, "x") for i, a in enumerate(a for _, many in CASES for a in many)]
    rows += rows[:5] + [("z", "V1", 1, None, None, None), ("y", None, None, None, "Hay 3.", None)]
    df = spark.createDataFrame(rows, "id string, system string, attempt int, query string, answer string, a string").selectExpr("*", "1 AS k0", "2 AS defect")
    got = {r["id"]: r["defect"] for r in Q.defects(df).collect()}
    want = {f"q{i}": d for i, d in enumerate(d for d, many in CASES for _ in many) if d} | {"z": "empty"}
    assert got == want
    assert Q.defects(df).count() == len(want)
    assert Q.defects(spark.createDataFrame([], df.schema)).count() == 0


def test_length_limit(spark):
    spiky = [("q", f"{i:04}".translate(str.maketrans("0123456789", "abcdefghij")) * 10) for i in range(60)]
    spread = [("q", "palabra " * 5 + "z" * (i % 37)) for i in range(60)]
    df = spark.createDataFrame(spiky + spread, "id string, answer string")
    assert Q.Compared(df, "id", "answer", None).limits() == [40]


def test_values_of_one_length_are_no_limit(spark):
    """A bare span of dates is complete, however many have its length; lengths beyond any bound count as they are."""
    spans = [("q", f"Del {i % 28 + 1:02}/05/{2000 + i // 28} al 03/06/2027") for i in range(90)]
    long = [("q", f"{i:04}".translate(str.maketrans("0123456789", "abcdefghij")) * 20_000) for i in range(60)]
    df = spark.createDataFrame(spans + long, "id string, answer string")
    assert Q.Compared(df, "id", "answer", None).limits() == [80_000]


def test_a_later_continuation_is_seen(spark):
    """The next in order goes on with a blank, only a later one inside the date."""
    rows = [("q", "Hasta el 12"), ("q", "Hasta el 12 de marzo."), ("q", "Hasta el 12/03/2027."), ("r", "Hasta el 12"), ("r", "Hasta el 12 de marzo.")]
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "id string, answer string").repartition(parts)
        assert [tuple(r) for r in Q.Compared(df, "id", "answer", None).shortened().collect()] == [("q", "Hasta el 12")]


@pytest.mark.parametrize("rows_broadcast", [500_000, 0])
def test_clauses_told_to_unlike_questions(spark, monkeypatch, rows_broadcast):
    monkeypatch.setattr(Q, "BROADCAST_ROWS", rows_broadcast)
    topics, rows = ("A", "B", "C", None), []
    for i in range(24):
        t = topics[i % 4]
        rows += [(f"q{i}", t, f"pregunta {i} de {t}", f"El archivo calla al respecto, Juan{i}."), (f"q{i}", t, f"pregunta {i} de {t}", f"El dato de la clase {str(t).lower()} consta así, según dicen."), (f"q{i}", t, f"pregunta {i} de {t}", f"El archivo calla al respecto, pero son {i + 900}.")]
    df = spark.createDataFrame(rows, "id string, topic string, query string, answer string").selectExpr("*", "monotonically_increasing_id() AS system", "1 AS attempt")
    got = Q.defects(df, topic="topic").join(df.select("id", "system", "answer"), ["id", "system"]).collect()
    assert len(got) == 24 and {r["defect"] for r in got} == {"refusal"} and all("Juan" in r["answer"] for r in got)

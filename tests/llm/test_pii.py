import pytest

from tamizal.llm import pii as P

GIVEN, FAMILY = ["Óscar", "Maruja", "Tadea", "Ciro", "Paulina", "Nicanor"], ["Chuquimar", "Torreblas", "Quispirroca", "Ñahuirima", "Zevallanos", "Larrondo"]


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for i in range(120):
        n = f"{GIVEN[i % 6]} {FAMILY[i // 6 % 6]} {FAMILY[(i // 6 + 1) % 6]}"
        rows.append((i, f"El postulante {n}, DNI 4{i:07}, solicita la devolución.\nLa sede Monteluz ofrece {i} vacantes en Historia y Música. El examen será el 3 de mayo de 2027."))
    cases = {
        500: "Escriba a juan.perez+x@correo.example o a juan (arroba) correo (punto) example",
        501: "Son 15 lapiceros @ 40.50 c/u. Síguenos en @admision_50.",
        502: "Llame al +51 955 601 095 o (053) 375911; nueve ocho tres nueve dos uno seis dos cero",
        503: "Serie 918-652-961 del cuadernillo. Voucher 988557658, expediente 83752449.",
        504: "con C.E. 000106130, pasaporte DP543952 y D.N.I. 63 824 862",
        505: "Vive en Jr. Dos de Agosto 404, int. 12 y en Urb. El Batán Mz. F Lt. 5",
        506: "Calle cerrada por obras en Peñablanca; use la puerta 29.",
        507: "Pabellón Maruja Torreblas, puerta 32. Colegio Ciro Larrondo. Premio «Tadea Zevallanos».",
        508: "Atentamente,\nÓ. TORREBLAS L.\n43216810",
        509: "LARRONDO ZEVALLANOS, PAULINA firmó",
        510: "Remitir a CALLE LA MOLIENDA\n524, sin más",
    }
    df = spark.createDataFrame([*rows, *cases.items(), (600, None), (601, ""), (None, "DNI 41234567"), (602, "palabra " * 50_000)], "doc_id bigint, text string").selectExpr("*", "1 AS k", "2 AS kind", "'x' AS line_no")
    items = P.find(df).collect()
    clean = {r["doc_id"]: r["text"] for r in P.find(df, redact=True).collect()}
    by = {}
    for r in items:
        by.setdefault(r["doc_id"], []).append((r["line_no"], r["kind"]))
    return by, clean, len(rows) + len(cases) + 4


def test_items(found):
    by, _, _ = found
    kinds = lambda k: sorted(x for _, x in by.get(k, []))
    assert all(sorted(by[i]) == [(1, "id_number"), (1, "name")] for i in range(120))
    assert kinds(500) == ["email", "email"] and kinds(501) == [] and kinds(502) == ["phone"] * 3 and kinds(503) == []
    assert kinds(504) == ["id_number"] * 3 and kinds(505) == ["address"] * 2 and kinds(506) == [] and kinds(507) == []
    assert sorted(by[508]) == [(2, "name"), (3, "id_number")] and kinds(509) == ["name"] and by[510] == [(1, "address")]
    assert by[None] == [(1, "id_number")] and 600 not in by and 602 not in by


def test_redacted(found):
    _, clean, n = found
    assert clean[0].split("\n")[0] == "El postulante [NAME], DNI [ID_NUMBER], solicita la devolución."
    assert clean[600] is None and clean[601] == "" and len(clean) == n


def test_empty(spark):
    assert P.find(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_terms_by_join_give_the_same(spark, found, monkeypatch):
    df = spark.createDataFrame([(i, f"El postulante {GIVEN[i % 6]} {FAMILY[i // 6 % 6]}, DNI 4{i:07}, pide.\nTrámite {i}.") for i in range(60)] * 2 + [(99, None), (98, "")], "doc_id bigint, text string")
    by = lambda: sorted(map(tuple, P.find(df).collect()))
    broadcast = by()
    monkeypatch.setattr(P, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(P, "HELD_WORDS", 5)
    assert by() == broadcast and sum(x[-1] == "name" for x in broadcast) == 120

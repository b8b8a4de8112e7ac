import pytest

from tamizal.llm import mojibake as M

SENTENCES = ["La inscripción de Ingeniería será según el número de vacantes.", "El año pasado el niño comió «pingüino» en la sesión.", "Artículo 5.º Revisión médica: óptica, física y química.", "¿Qué ocurrió después? Él también publicó la nómina."]
SOUND = ["Hochschule Weißenbrück (Größe) straße", "├── Sede ── 5 plazas │ fin", "x ≥ 3 y x ≠ 0; √15; ½ pulgada × 3 ±1 mm", "COOPERAÇÃO e INTERCÂMBIO"]


def misread(text, right, wrong):
    table = M.misread_tables()
    back = table[wrong][1]
    raw = text.encode(right)
    return "".join(chr(b) if b < 0x80 else back[b] for b in raw)


@pytest.fixture(scope="module")
def corpus():
    rows = [(f"n{i}", f"{SENTENCES[i % 4]} Fila {i}.\n{SENTENCES[(i + 1) % 4]}") for i in range(400)] + [(f"s{i}", f"{SOUND[i % 4]} {i}") for i in range(60)]
    bad = []
    for i, (right, wrong) in enumerate([("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "mac_roman")]):
        for j in range(2):
            whole = SENTENCES[(i + j) % 4]
            bad.append((f"b{i}{j}", f"{SENTENCES[j]}\n{misread(whole, right, wrong)}", f"{SENTENCES[j]}\n{whole}"))
    twice = misread(misread(SENTENCES[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    bad += [("t1", twice, SENTENCES[0]), ("f1", "La inscripci�n de Ingenier�a", None)]
    return rows, bad


def test_round_trip(spark, corpus):
    rows, bad = corpus
    df = spark.createDataFrame([*rows, *((k, t) for k, t, _ in bad), ("n0", rows[0][1]), ("null", None), ("empty", ""), (None, "x")], "id string, text string").selectExpr("*", "1 AS k", "2 AS damaged", "3 AS a")
    got = {r["id"]: (r["text"], r["damaged"]) for r in M.repaired(df).collect()}
    for k, _, right in bad:
        assert got[k][1], k
        if right is not None:
            assert got[k][0] == right
    assert not any(got[k][1] for k, _ in rows)
    assert got["null"] == (None, False) and got["empty"] == ("", False)
    assert {r["id"] for r in M.damaged_keys(df).collect()} == {k for k, _, _ in bad}


@pytest.mark.parametrize("wrong", ["cp1252", "mac_roman", "cp850"])
def test_a_third_of_the_rows_damaged(spark, corpus, wrong):
    sound, _ = corpus
    df = spark.createDataFrame([(k, misread(t, "utf-8", wrong) if k[0] == "n" and i % 3 == 0 else t) for i, (k, t) in enumerate(sound)], "id string, text string")
    damaged = {k for i, (k, _) in enumerate(sound) if k[0] == "n" and i % 3 == 0}
    got = {r["id"]: (r["text"], r["damaged"]) for r in M.repaired(df).collect()}
    assert {k for k, (_, bad) in got.items() if bad} == damaged
    assert {k: t for k, (t, _) in got.items()} == dict(sound)


def test_empty(spark):
    assert M.repaired(spark.createDataFrame([], "id string, text string")).count() == 0


def test_segments_are_maximal():
    """Against brute force: each segment is the best interval of what the earlier ones leave, till none gains."""
    import numpy as np

    def best(score, a, b):
        options = [(-sum(score[x : y + 1]), y - x, x, y) for x in range(a, b) for y in range(x, b) if sum(score[x : y + 1]) > 0]
        if not options:
            return []
        _, _, x, y = min(options)
        return [*best(score, a, x), (x, y), *best(score, y + 1, b)]

    rng = np.random.default_rng(5)
    for _ in range(200):
        score = np.round(rng.normal(-0.3, 2, rng.integers(1, 18)), 3)
        assert M.segments(score, np.flatnonzero(score > 0)) == best(score.tolist(), 0, len(score))


def test_only_some_keys(spark, corpus):
    rows, bad = corpus
    df = spark.createDataFrame([*rows, *((k, t) for k, t, _ in bad)], "id string, text string")
    few = spark.createDataFrame([("b00",), ("n1",), ("t1",)], "id string")
    assert {r["id"] for r in M.damaged_keys(df, only=few).collect()} == {"b00", "t1"}

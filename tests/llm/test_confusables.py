from hypothesis import given, settings
from hypothesis import strategies as st

from tamizal.llm import confusables as C

SAME = [("Ｐｅñａ １２", "Peña 12"), ("Peña 12", "Peña 12"), ("Pe​ña\xad 12", "Peña 12"), ("Реñа 12", "Peña 12"), ("Peña 12", "Peña 12"), ("a‑b", "a-b"), ("preﬁere", "prefiere"), ("fin \r\nx\t", "fin\nx"), ("≠", "≠"), ("ΟΡΕΝ", "OPEN")]
OTHER = [("Peña", "peña"), ("Peña", "Pena"), ("n.º", "n.o"), ("x²", "x2"), ("¿a?", "a?"), ("a\n", "a"), ("a  b", "a b"), ("вода", "boдa")]


def test_forms():
    for a, b in SAME:
        assert C.form(a) == C.form(b), (a, b)
    for a, b in OTHER[:-1]:
        assert C.form(a) != C.form(b), (a, b)
    assert C.form("водa") == C.form("вода") == "вода"
    assert C.form(None) is None and C.form("") == ""


def test_every_script():
    """Styled letters, Roman numerals and look-alikes of all scripts with letters of Latin shape, mixed and in whole words."""
    for a, b in [("𝐇𝐨𝐥𝐚", "Hola"), ("ℋola", "Hola"), ("Ⅻ", "XII"), ("paypaⅼ", "paypal"), ("ɡato", "gato"), ("հola", "hola"), ("Ꮋola", "Hola"), ("ꓮꓠꓮ", "ANA"), ("ᎪΝА", "ANA"), ("ⲟⲥⲟ", "oco"), ("𝟐𝟎𝟐𝟔", "2026"), ("օսո", "oun"), ("ᴏᴠ", "ov")]:
        assert C.form(a) == b, (a, C.form(a))
    for own in ("①", "ʜola", "Ω", "אב", "日本", "м²"):
        assert C.form(own) == own


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aеοñÑ́̃ \xa0​ﬁＡ１‑\n\r\tвνΩº½ß"), max_size=12))
def test_idempotent(text):
    assert C.form(C.form(text)) == C.form(text)


def test_pairs(spark):
    rows = [(1, "hola peña"), (2, "hola peña"), (3, "hоla peña"), (4, "hola\xa0peña"), (5, "Hola peña"), (6, None), (None, "hola peña"), (7, ""), (3, "hоla peña")]
    df = spark.createDataFrame(rows, "id int, text string").selectExpr("*", "'x' AS key", "'y' AS same", "'z' AS exact")
    got = {(r["key_a"], r["key_b"]) for r in C.look_alikes(df, "id", "text").collect()}
    assert got == {("1", "3"), ("1", "4"), ("2", "3"), ("2", "4"), ("3", "4")}
    assert C.with_form(df, "text", "key").where("id = 3").first()["key"] == "hola peña"
    assert C.look_alikes(spark.createDataFrame([], df.schema), "id", "text").count() == 0
    rows = C.classes(C.spelled_differently(df, "id", "text"))
    assert sorted(map(tuple, rows.collect())) == [(k, "1", 3, 4) for k in "1234"]


def test_a_third_of_the_rows_read_the_same(spark):
    """Copies of one text under many ids: copies aren't paired, each other spelling is paired with every one."""
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN concat('texto ', id) WHEN id = 300 THEN 'lа peña' ELSE 'la peña' END AS text")
    assert C.look_alikes(df, "id", "text").count() == 999

"""One consistent form of texts that look the same but are spelled with other characters.

Per text: canonical decomposition; invisible characters go; wide and narrow
forms, ligatures, letters of mathematical and other styles, Roman numerals, spaces and
hyphens take their plain form; then, token by
token, the script sets of the letters are intersected, where a letter counts for
its own script and for every script that has a letter of the same shape. A token
whose letters share Latin is spelled in Latin, be it mixed or a whole word of
another script made of such shapes; else in the first of the other SCRIPTS that all its
letters share; a token that no script can spell takes the Latin shape wherever
there is one. Blanks at line ends go and the text is recomposed.

Letter case, accents, digits, punctuation and line breaks stay, so texts that
read differently keep different forms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamizal.session import materialize

# fixed values: Latin letters and the Cyrillic or Greek letters of the same shape
LATIN_CYRILLIC = "A А, B В, C С, E Е, H Н, I І, J Ј, K К, M М, O О, P Р, S Ѕ, T Т, X Х, Y У, a а, c с, d ԁ, e е, h һ, i і, j ј, l ӏ, o о, p р, q ԛ, s ѕ, w ԝ, x х, y у"
LATIN_GREEK = "A Α, B Β, E Ε, H Η, I Ι, K Κ, M Μ, N Ν, O Ο, P Ρ, T Τ, X Χ, Y Υ, Z Ζ, o ο, v ν, u υ"
# fixed values: Latin letters and the Armenian, Cherokee, Coptic and Lisu letters of the same shape, and Latin ones of another alphabet or style
LATIN_ARMENIAN = "O Օ, S Տ, U Ս, g ց, h հ, n ո, o օ, q զ, u ս"
LATIN_CHEROKEE = "A Ꭺ, B Ᏼ, C Ꮯ, D Ꭰ, E Ꭼ, G Ꮐ, G Ꮹ, H Ꮋ, J Ꭻ, K Ꮶ, L Ꮮ, M Ꮇ, P Ꮲ, R Ꭱ, R Ꮢ, S Ꮪ, T Ꭲ, V Ꮩ, W Ꮃ, W Ꮤ, Y Ꭹ, Z Ꮓ, b Ꮟ, d Ꮷ, h Ꮒ, i Ꭵ"
LATIN_COPTIC = "B Ⲃ, C Ⲥ, H Ⲏ, I Ⲓ, K Ⲕ, M Ⲙ, N Ⲛ, O Ⲟ, P Ⲣ, T Ⲧ, X Ⲭ, c ⲥ, o ⲟ, p ⲣ"
LATIN_LISU = "A ꓮ, B ꓐ, C ꓚ, D ꓓ, E ꓰ, F ꓝ, G ꓖ, H ꓧ, I ꓲ, J ꓙ, K ꓗ, L ꓡ, M ꓟ, N ꓠ, O ꓳ, P ꓑ, R ꓣ, S ꓢ, T ꓔ, U ꓴ, V ꓦ, W ꓪ, X ꓫ, Y ꓬ, Z ꓜ"
LATIN_LATIN = "a ɑ, c ᴄ, g ɡ, o ᴏ, s ꜱ, u ᴜ, v ᴠ, w ᴡ, z ᴢ"
#: Scripts that have letters of Latin shape, in the order in which a token is spelled in them.
SCRIPTS = {"Latin": LATIN_LATIN, "Greek": LATIN_GREEK, "Cyrillic": LATIN_CYRILLIC, "Armenian": LATIN_ARMENIAN, "Cherokee": LATIN_CHEROKEE, "Coptic": LATIN_COPTIC, "Lisu": LATIN_LISU}
#: Code points whose compatibility form, where it is one letter or digit or a Roman numeral, looks the same.
STYLED = ((0x2100, 0x2150), (0x2160, 0x2180), (0x1D400, 0x1D800))
HYPHENS = "‐‑﹣֊"
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff]")
LINE_END = re.compile(r"[ \t\r\f\v]+(?=\n|\Z)")


def _shapes() -> tuple[dict[str, dict[str, str]], dict[int, str]]:
    """Each letter's spelling by script; plain forms by code point."""
    spelled: dict[str, dict[str, str]] = {}
    alike: dict[str, list[str]] = {}
    for name, pairs in SCRIPTS.items():
        for pair in pairs.split(", "):
            a, b = pair.split(" ")
            own = spelled.setdefault(a, {"Latin": a})
            own.setdefault(name, b)
            alike.setdefault(a, []).append(b)
    for a, others in alike.items():
        for b in others:
            spelled[b] = {**spelled[a]}
    plain = {ord(c): "-" for c in HYPHENS} | {0xB5: "μ"}
    for i in [*range(0x80, 0x3001), *range(0xFB00, 0xFB18), *range(0xFF01, 0xFFEF)]:
        c = chr(i)
        if unicodedata.category(c) == "Zs":
            plain[i] = " "
        elif i > 0xFAFF or c in "ĲĳǄǅǆǇǈǉǊǋǌǱǲǳ":
            form = unicodedata.normalize("NFKC", c)
            if form != c:
                plain[i] = unicodedata.normalize("NFD", form)
    for i in (i for a, b in STYLED for i in range(a, b)):
        form = unicodedata.normalize("NFKC", chr(i))
        if form != chr(i) and form.isalnum() and (len(form) == 1 or 0x2160 <= i < 0x2180):
            plain[i] = unicodedata.normalize("NFD", form)
    return spelled, plain


SPELLED, PLAIN = _shapes()
#: A text of nothing else is already in its form (the accented letters are composed), but for blanks at line ends.
USUAL = re.compile("[\\x00-\x7e\xa1-\xac\xae-\xb4\xb6-ɏ–-„…]*")
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ԰-֏Ꭰ-᏿Ⲁ-⳿ꓐ-꓿" + "".join(p[-1] for p in LATIN_LATIN.split(", ")) + "]")
TOKEN = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")


def script(letter: str) -> str:
    """The letter's script, as its name begins."""
    i = ord(letter)
    if i < 0x250 or 0x1E00 <= i < 0x1F00:
        return "Latin"
    if 0x370 <= i < 0x400 or 0x1F00 <= i < 0x2000:
        return "Greek"
    if 0x400 <= i < 0x530:
        return "Cyrillic"
    return unicodedata.name(letter, "?").split(" ")[0].title()


def spell(token: str) -> str:
    """The token (decomposed) in the script that its letters share; see the module's text."""
    shared: set[str] | None = None
    for c in token:
        if not unicodedata.combining(c):
            scripts = {script(c), *SPELLED.get(c, {})}
            shared = scripts if shared is None else shared & scripts
    chosen = next((x for x in SCRIPTS if x in (shared or ())), None if shared else "Latin")
    return "".join(SPELLED.get(c, {}).get(chosen, c) for c in token) if chosen else token


def form(text: str | None) -> str | None:
    """The consistent form of a text; null for null. form(form(x)) == form(x)."""
    if not text:
        return text
    if not USUAL.fullmatch(text):
        text = INVISIBLE.sub("", unicodedata.normalize("NFD", text).translate(PLAIN))
        if FOREIGN.search(text):
            text = TOKEN.sub(lambda m: spell(m[0]) if FOREIGN.search(m[0]) else m[0], text)
        text = unicodedata.normalize("NFC", text)
    return LINE_END.sub("", text) if text[-1:] in " \t\r\f\v" or " \n" in text or "\r\n" in text or "\t\n" in text or "\f\n" in text or "\v\n" in text else text


def with_form(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column out, the consistent form of the column text; a column named out is replaced."""

    @F.pandas_udf("string")
    def run(column):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([form(x) for x in column], dtype=object)

    return df.withColumn(out, run(F.col(text)))


def hashed_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key (as string), exact and same: 128-bit hashes of the text and of its form. Rows with null key or text are left out."""
    src = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("t")).where("key is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts = batch.column(1).to_pylist()
            exact = [digest(x.encode()) for x in texts]
            same = [digest(y.encode()) for y in map(form, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.binary()), pa.array(same, pa.binary())], names=["key", "exact", "same"])

    return src.mapInArrow(run, "key string, exact binary, same binary")


def spelled_differently(df: DataFrame, key: str, text: str) -> DataFrame:
    """key (as string), exact and same of the rows whose form has several spellings, as a written table.

    Texts are read and brought to their forms once; grouped and joined are hashes only. Repeated rows
    count once. Rows without key or text, and an empty table, give none.
    """
    rows = materialize(hashed_forms(df, key, text).distinct(), "forms")
    several = rows.groupBy("same").agg(F.min("exact").alias("low"), F.max("exact").alias("high")).where("low <> high").select("same")
    return materialize(rows.join(several, "same", "left_semi"), "spellings")


def classes(rows: DataFrame) -> DataFrame:
    """key, representative (the least key of its form), spellings and members of the form, of the rows that spelled_differently gives."""
    each = rows.groupBy("same").agg(F.min("key").alias("representative"), F.countDistinct("exact").alias("spellings"), F.countDistinct("key").alias("members"))
    return rows.select("key", "same").distinct().join(each, "same").select("key", "representative", "spellings", "members")


def pairs(rows: DataFrame) -> DataFrame:
    """Pairs key_a < key_b of different keys with one form and different spellings, of the rows that spelled_differently gives.

    Exact copies are never paired with each other. A form that very many rows share is split by the adaptive join.
    """
    a = rows.select("same", F.col("key").alias("key_a"), F.col("exact").alias("exact_a"))
    b = rows.select("same", F.col("key").alias("key_b"), F.col("exact").alias("exact_b"))
    return a.join(b, "same").where("key_a < key_b and exact_a <> exact_b").select("key_a", "key_b").distinct()


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """pairs() of a table's texts."""
    return pairs(spelled_differently(df, key, text))

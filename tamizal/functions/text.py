"""Scalar text functions as column expressions, all inside whole-stage code generation except where noted."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one ASCII letter or digit (with marks), and that character."""
    source, target = [], []
    for i in [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x208A), *range(0xFF01, 0xFF5F)]:
        bare = [c for c in unicodedata.normalize("NFKD", chr(i).casefold()) if not unicodedata.combining(c)]
        if len(bare) == 1 and bare[0].isascii() and (bare[0].isalnum() or i > 0xFF00):
            source.append(chr(i))
            target.append(bare[0])
    return "".join(source), "".join(target)


#: Characters that fold() replaces one by one, and what by.
FOLD_FROM, FOLD_TO = _fold_table()
MARKS = "[\\x{0300}-\\x{036F}]"

# fixed values: Spanish stop words of the lexical index
STOPWORDS = (
    "a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era erais eran eras eres es esa esas ese eso esos esta "
    "estaba estaban estado estamos estar estas este esto estos fue fueron fui fuimos ha han has hasta hay he hemos hubo la las le les lo los me mi mis mucho muchos muy más ni no nos "
    "nosotras nosotros o os otra otras otro otros para pero poco por porque que quien quienes se ser si sin sobre son su sus también tanto te tengo ti tiene tienen todo todos tu tus un "
    "una unas uno unos vos vosotras vosotros vuestra vuestras vuestro vuestros y ya yo él ésta éstas éste éstos ó"
).split()
#: Signs stripped from the ends of a token.
EDGE_SIGNS = '.,;:¿?¡!"()[]{}'


def fold(c: Column) -> Column:
    """Lower case without accents: compatibility forms of ASCII letters and digits become these, marks go, ß becomes ss."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.lower(c), "ß", "ss"), FOLD_FROM, FOLD_TO), MARKS, "")


def norm(c: Column) -> Column:
    """fold, every run of other signs one space, ends trimmed."""
    return F.trim(F.regexp_replace(fold(c), "[^\\p{L}\\p{N}_]+", " "))


def cache_norm(c: Column) -> Column:
    """Lower case with single spaces; accents stay."""
    return F.trim(F.regexp_replace(F.lower(c), "(?U)\\s+", " "))


def audit_norm(c: Column) -> Column:
    """Folded; only letters, digits and / . , % ° º - stay."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), FOLD_FROM.replace("º", ""), _without("º")), "[^a-z0-9/.,%°º-]+", " "))


def _without(letters: str) -> str:
    return "".join(b for a, b in zip(FOLD_FROM, FOLD_TO) if a not in letters)


def clean(c: Column) -> Column:
    """Single spaces, without bars at the ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, "(?U)\\s+", " ")), "^[| ]+|[| ]+$", "")


def template_key(c: Column, words: int = 4) -> Column:
    """The first words of the text without punctuation, in lower case."""
    bare = F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}_]+", " "))
    return F.array_join(F.slice(F.split(bare, " "), 1, words), " ")


def tokens(c: Column) -> Column:
    """Index tokens: lower case, cut at white space, signs off the ends, no stop words, more than one character."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), "\\s+", " ")), " ")
    return F.filter(F.transform(words, lambda t: F.trim(t, F.lit(EDGE_SIGNS))), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def stems(c: Column, size: int = 6) -> Column:
    """The distinct first letters of the words of norm(c), sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(norm(c), " "), lambda t: t != ""), lambda t: F.substring(t, 1, size))))


def strip(c: Column) -> Column:
    """Without blanks at both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


ROW_PREFIX = "^\\s*Tabla\\s+\\d+\\s*[—-]\\s*fila\\s+\\d+\\s*:\\s*"
FIELD = "(?:^|[;|])\\s*([^:;|]{2,80}?)\\s*:\\s*([^;|]+)"


def fields(c: Column) -> Column:
    """The labelled values of a serialized table row, in order, as array of (label, value); repeated labels stay."""
    body = F.regexp_replace(c, ROW_PREFIX, "")
    label, value = (F.regexp_extract_all(body, F.lit(FIELD), F.lit(i)) for i in (1, 2))
    pairs = F.zip_with(label, value, lambda a, b: F.struct(strip(a).alias("label"), strip(b).alias("value")))
    return F.filter(pairs, lambda p: (p["label"] != "") & (p["value"] != ""))


def group_of(label: Column) -> Column:
    """The part of a header path before its last slash; empty without one."""
    return strip(F.regexp_extract(label, "^(.*)/", 1))


def item_of(label: Column) -> Column:
    """The part of a header path after its last slash."""
    return strip(F.regexp_extract(label, "([^/]*)$", 1))


def number(c: Column) -> Column:
    """The value of a cell that is digits only, else null."""
    bare = strip(c)
    return F.when(bare.rlike("^[0-9]{1,18}$"), bare.cast("bigint"))


def source_label(source: Column, page: Column) -> Column:
    return F.concat(F.coalesce(source, F.lit("?")), F.lit(" (p."), F.coalesce(page.cast("string"), F.lit("?")), F.lit(")"))


def number_tokens(c: Column) -> Column:
    """Distinct numbers with their separators, commas as dots, sorted."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+(?:[./,][0-9]+)*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")))))


def standalone_integers(c: Column) -> Column:
    """Distinct integers outside dates and page references, sorted as text."""
    bare = F.regexp_replace(fold(c), "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}", " ")
    bare = F.regexp_replace(bare, "(pagina|pag\\.?|p\\.)\\s*[0-9]+", " ")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit("(?:^|[^0-9.,])([0-9]+)"), F.lit(1))))


def integers(c: Column) -> Column:
    """All integers in order, without leading zeros (a multiset)."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))


def number_atoms(c: Column) -> Column:
    """All numbers in order in one form (a multiset): a comma is a decimal point, zeros that don't count go."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    dotted = F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit(".")), "^0+(?=[0-9])", ""))
    return F.transform(dotted, lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(F.regexp_replace(x, "0+$", ""), "\\.$", "")).otherwise(x))


def dates(c: Column) -> Column:
    """Dates written day/month/year, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"), F.lit(0))


def days_between(a: Column, b: Column) -> Column:
    """Absolute days between two day/month/year texts; null if one is no date."""
    return F.abs(F.datediff(F.try_to_timestamp(a, F.lit("d/M/yyyy")).cast("date"), F.try_to_timestamp(b, F.lit("d/M/yyyy")).cast("date")))


# fixed values: quotation marks in the order in which they are tried
QUOTES = (("«", "»"), ("“", "”"), ('"', '"'), ("‘", "’"), ("'", "'"))


def quoted_topic(c: Column) -> Column:
    """The first quoted part, by the first quotation style that has one; null without."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, f"{a}([^{b}]+){b}", 1), F.lit("")) for a, b in QUOTES))


def is_article_heading(c: Column, wanted: Column | None = None) -> Column:
    """Whether the text begins with an article's heading (of the wanted number): a capital follows the number."""
    n = F.regexp_extract(c, ARTICLE_START, 1)
    return F.coalesce(n != "", F.lit(False)) if wanted is None else F.coalesce(F.ltrim(n, F.lit("0")) == F.ltrim(wanted.cast("string"), F.lit("0")), F.lit(False))


ARTICLE_START = "^\\s*(?iu:Art[íi]culo)\\s+([0-9]+)\\s*[°º]?\\s*[.:–—]?\\s*\\p{Lu}"
ARTICLE_ANYWHERE = "(?:\\b(?iu:Art[íi]culo)\\s+[0-9]+\\s*[°º]?\\s*[.:–—-]?\\s+\\p{Lu})|(?:\\b(?iu:CAP[IÍ]TULO|SUBCAP[IÍ]TULO|T[IÍ]TULO)\\s+(?:[IVXLCDMivxlcdm]+|[0-9]+)\\b)"


def cut_at_next_heading(c: Column) -> Column:
    """The text before the first heading of an article or chapter that doesn't open it."""
    text = F.trim(c)
    return F.rtrim(F.regexp_replace(text, f"(?s)(?<=.)(?:{ARTICLE_ANYWHERE}).*$", ""))


def drop_trailing_artifact(c: Column) -> Column:
    """Without a page number, footnote marks or capital debris of a running header behind the last sentence."""
    text = F.rtrim(F.regexp_replace(c, "\\s+[0-9]{1,3}\\s*$", ""))
    text = F.rtrim(F.regexp_replace(text, "[⁰¹²³⁴⁵⁶⁷⁸⁹]+s*$", ""))
    tail = F.regexp_extract(text, "(?s)[.!?]([^.!?]*)$", 1)
    letters = F.regexp_replace(tail, "[^\\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, "[^\\p{Lu}]", ""))
    debris = (F.length(letters) > 0) & (capitals >= 0.8 * F.length(letters))
    return F.when(debris, F.rtrim(F.regexp_replace(text, "(?s)([.!?])[^.!?]*$", "$1"))).otherwise(F.rtrim(F.regexp_replace(text, ":\\s+[\\p{Lu}][\\p{Lu}\\s]{2,}$", "")))


def strip_page_furniture(c: Column) -> Column:
    """Without a running header up to `Página n de m`: the text goes on at the first heading or run of prose; empty if there is none."""
    text = F.trim(c)
    marker = "(?siu)^.*?P[aá\\x{FFFD}]gina\\s+[0-9]+\\s+de\\s+[0-9]+"
    rest = F.regexp_replace(F.regexp_replace(text, marker, ""), "^[\\s|:–—-]+", "")
    prose = "(?:\\p{L}*\\p{Ll}\\p{L}*(?<=\\p{L}{2})[^\\p{L}]+\\p{Ll}+[^\\p{L}]+\\p{Ll}+)"
    begin = F.regexp_extract(rest, f"(?s)((?:{ARTICLE_ANYWHERE}|\\b{prose}).*)$", 1)
    return F.when(text.rlike(marker), F.trim(begin)).otherwise(text)


def ends_complete(c: Column) -> Column:
    """Whether the text ends with a sentence's sign, perhaps before closing quotes."""
    return F.coalesce(drop_trailing_artifact(c).rlike("[.!?][\"'»)]*$"), F.lit(False))


def article_body(c: Column, continuation: bool = False) -> Column:
    """An article's own text on a page: furniture off a continuation, cut at the next heading, debris off the end."""
    return drop_trailing_artifact(cut_at_next_heading(strip_page_furniture(c) if continuation else F.trim(c)))


# fixed values: phase numbers as words
ORDINALS = {"primera": "i", "segunda": "ii", "tercera": "iii", "cuarta": "iv", "quinta": "v"}


def phase_rewrite(c: Column) -> Column:
    """`totales` as total and `primera fase` .. `quinta fase` as fase i .. v, in normalized text."""
    out = F.regexp_replace(c, "\\btotales\\b", "total")
    for word, numeral in ORDINALS.items():
        out = F.regexp_replace(out, f"\\b{word} fase\\b", f"fase {numeral}")
    return out


def acceptable(c: Column, least: int = 80, most: int = 2000) -> Column:
    """Length in bounds, five words or more, at most 1 % replacement characters, at least 45 % letters."""
    size = F.length(c)
    letters = F.length(F.regexp_replace(c, "[^\\p{L}]", ""))
    lost = size - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return F.coalesce((size >= least) & (size <= most) & (F.size(F.split(F.trim(F.regexp_replace(c, "\\s+", " ")), " ")) >= 5) & (lost * 100 <= size) & (letters * 100 >= size * 45), F.lit(False))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts (an Arrow-batched Python function: no built-in has it); null if one is null."""

    @F.pandas_udf("double")
    def ratio(x, y):  # noqa: ANN001, ANN202
        import difflib

        import pandas as pd

        return pd.Series([None if s is None or t is None else difflib.SequenceMatcher(None, s, t).ratio() for s, t in zip(x, y)], dtype="float64")

    return ratio(a, b)


def token_consensus(a: Column, b: Column, least: int = 5, share: float = 0.5) -> Column:
    """The tokens two readings of a text share in order, as text; null unless there are enough of them on both sides."""

    @F.pandas_udf("string")
    def agree(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([_agreed(s, t, least, share) for s, t in zip(x, y)], dtype=object)

    return agree(a, b)


def _agreed(a: str | None, b: str | None, least: int, share: float) -> str | None:
    u, v = (a or "").split(), (b or "").split()
    row = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
    for i, s in enumerate(u):
        for j, t in enumerate(v):
            row[i + 1][j + 1] = row[i][j] + 1 if s == t else max(row[i][j + 1], row[i + 1][j])
    n = row[-1][-1]
    if n < least or n < share * len(u) or n < share * len(v):
        return None
    out, i, j = [], len(u), len(v)
    while i and j:
        if u[i - 1] == v[j - 1]:
            out.append(u[i - 1])
            i, j = i - 1, j - 1
        elif row[i - 1][j] >= row[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return " ".join(reversed(out))

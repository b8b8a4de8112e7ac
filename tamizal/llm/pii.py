"""Personal information inside free text.

Structured items (email addresses, telephone and identity numbers, street
addresses) follow written patterns and are found by them. Persons' names have no
pattern; which words disclose persons is estimated from the corpus: one pass
counts, for every word, the passages that hold it and those that also hold a
structured item. The pointwise mutual information of a word with such items,
relative to the most it could be, says how strongly the word reveals a protected
entity. Words above the disclosure threshold that are written as proper nouns
are the terms; a run of such terms (with initials and particles) that isn't part
of an institution, building, prize, square or street is a name.

Words are told apart by 64-bit hashes. The counts are added up in one pass and
only the words that can be terms are written. Up to BROADCAST_TERMS terms go to every
executor as one sorted array; where a corpus has more, each text's own terms
come to it by a join. Either way the rows are the same.

A structured item is a protected entity itself, so what its own words disclose is all
there is to know of it; its kind is what it is generalised to. A name is
generalised to its kind too: the placeholder tells that a person stood there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamizal.llm.boilerplate import _sums, letter_tables
from tamizal.session import materialize

#: Share of the largest possible mutual information from which a word is a term, and the evidence it needs.
DISCLOSURE = 0.55
MIN_PASSAGES, MIN_PROPER, PROPER_SHARE = 3, 2, 0.5
#: Terms that every executor gets at most (8 bytes each); beyond, they are joined to the texts that have them.
BROADCAST_TERMS = 2_000_000
#: Distinct words that a counting task holds before it hands its counts on.
HELD_WORDS = 400_000
KINDS = ("email", "phone", "id_number", "address", "name")

# fixed values: words by which structured items are announced
LABELS = "dni pasaporte passport extranjeria whatsapp celular telefono telefone telf tel correo email mail phone arroba domiciliado domicilio apoderado identidad".split()
# fixed values: words that begin an address or belong to one
STREET = "jr jiron av avda avenida calle psje pje pasaje prolongacion alameda malecon urb urbanizacion ah aahh asentamiento mz manzana lt lote km carretera barrio residencial cooperativa".split()
# fixed values: words before a name that make it part of something else
INSTITUTION = (
    "colegio escuela instituto institución institucion universidad facultad academia i.e ie liceo centro hospital clínica clinica posta pabellón pabellon edificio auditorio aula sala salón salon "
    "biblioteca laboratorio coliseo estadio teatro museo premio concurso copa medalla beca torneo certamen cátedra catedra orden fundación fundacion asociación asociacion "
    "plaza plazuela plazoleta parque óvalo ovalo puente mercado jr jirón jiron av avda avenida calle ca psje pje pasaje urb urbanización urbanizacion "
    "a.h ah aa.hh prolongación prolongacion alameda malecón malecon carretera barrio residencial empresa editorial librería libreria farmacia school college hall building prize award square street"
).split()
# fixed values: digits as words
DIGIT_WORDS = "cero uno una dos tres cuatro cinco seis siete ocho nueve zero um uma dois duas quatro sete oito nove one two three four five six seven eight nine".split()

_AT = r"(?:\s?[@＠]\s?|\s?[(\[{]\s?(?:arroba|at)\s?[)\]}]\s?|\s(?:arroba|at)\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:punto|dot|ponto)\s?[)\]}]\s?|\s(?:punto|dot|ponto)\s)"
EMAIL = re.compile(rf"(?<![\w.+-])[\w+-]+(?:{_DOT}[\w+-]+)*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}(?![\w+-])(?!{_AT})", re.I)
MOBILE = re.compile(r"(?<![\w/.,-])(?<!\d )(?:(?:\(?\+\s?51\)?|0051|\+51)[\s.-]*)?9\d{2}[\s.-]?\d{3}[\s.-]?\d{3}(?![\w/])(?![.,-]\d)(?! \d)")
LANDLINE = re.compile(r"(?<![\w/.,-])(?<!\d )(?:(?:\+\s?51|0051)[\s.-]*)?(?:\(0\d{1,2}\)\s?|0\d{1,2}[\s.-])\d{2,3}[\s.-]?\d{2,4}(?:[\s.-]?\d{2,3})?(?![\w/])(?![.,-]\d)")
SPOKEN = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})(?:[\s,-]+(?:{'|'.join(DIGIT_WORDS)})){{5,}}\b", re.I)
NOT_PHONE = re.compile(r"(?:serie|voucher|operaci[oó]n|c[oó]digos?|expediente|folio|documento interno|recibo|cuenta|ruc|partida|resoluci[oó]n|registro|turno|lote|factura|pedido|ticket|id\s?=|n[uú]mero de (?:serie|operaci[oó]n|cuenta|expediente)|c\.e\.|extranjer[ií]a|dni|identidad)\W{0,3}(?:n\W{0,3}\s?)?$", re.I)
ID_LABEL = re.compile(
    r"(?<!\w)(?:d\.?\s?n\.?\s?i\.?(?!\w)|documento (?:nacional )?de identidad|identificad[oa] con (?:el |la )?(?:n[uú]mero|documento|doc\.?|n[\s.º°ª]{1,4})|c\.\s?e\.|(?-i:CE)(?!\w)|carn[eé] de extranjer[ií]a|pasaporte|passport(?! holder)|c[eé]dula(?: de identidad)?|identity card|bilhete de identidade|doc\. ?(?:de )?ident\w*\.?)"
    r"[\s:,.#]*(?:(?:n[uú]mero|n[úu]m|nro|no|n)(?![a-z])[\s.:º°ª]{0,4})?\s*(?P<n>(?:\d{2}[ .]\d{3}[ .]\d{3}|\d{8})(?:\s?-\s?\d)?|\d{9}|\d{12}|[a-z]{1,3}-?\d{5,8})(?![\w])",
    re.I,
)
BARE_ID = re.compile(r"(?<![\w.,/-])(?:\d{8}|\d{2}[ .]\d{3}[ .]\d{3})(?:-\d)?(?![\w/])(?![.,-]\d)")
_NUM = r"(?:,?\s*(?:n[\s.º°ª]{1,4}|n[uú]mero |nro\.? ?|#\s?|casa |km\.? ?)?\s?\d{1,5}(?:\s?-\s?[a-z]\b)?)"
_NAME_WORDS = r"(?:[^\W\d_]+\.?|\d{1,2} de)(?:\s(?:[^\W\d_]+\.?|\d{1,2} de)){0,5}?"
ADDRESS = re.compile(
    rf"(?<!\w)(?:(?:jr|jir[oó]n|av|avda|avenida|calle|ca|psje|pje|pasaje|prol|prolongaci[oó]n|alameda|malec[oó]n)\.?\s{_NAME_WORDS}{_NUM}(?!\w)"
    rf"|(?:urb|urbanizaci[oó]n|a\.?\s?h|aa\.?\s?hh|asentamiento humano|coop|cooperativa|residencial|barrio|sector|p\.?\s?j)\.?\s{_NAME_WORDS},?\s(?:mz|mza|manzana)\.?\s?[a-z0-9]{{1,2}}'?,?\s(?:lt|lte|lote)\.?\s?\d+"
    r"|(?:mz|mza|manzana)\.?\s?[a-z0-9]{1,2}'?,?\s(?:lt|lte|lote)\.?\s?\d+"
    rf"|km\.?\s?\d+(?:[.,]\d+)?\s(?:de la|da|of the)\s(?:carretera|panamericana|autopista|rodovia|estrada|road|highway)"
    rf"|(?:carretera|panamericana)\s{_NAME_WORDS},?\skm\.?\s?\d+"
    r")",
    re.I,
)
ROAD_END = re.compile(rf"(?<!\w)(?:jr|jir[oó]n|av|avda|avenida|calle|psje|pje|pasaje|prolongaci[oó]n)\.?\s{_NAME_WORDS}$", re.I)
HOUSE = re.compile(r"\s*(?:n[\s.º°ª]{1,4})?\d{1,5}(?:-[a-z])?(?![\w/])", re.I)
CLOSED = re.compile(r"\b(?:cerrad[ao]|obras|use|puerta|entre las)\b", re.I)
WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
PARTICLES = frozenset("de del la las los y e da do das dos di von van".split())
BEFORE = re.compile(r"([\w.]+)[\s«\"“'(.]*$")


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes of words given in folded lower-case letters."""
    letters = np.array([ord(c) for w in words for c in w], dtype=np.uint32)
    return _sums(letters, np.repeat(np.arange(len(words)), [len(w) for w in words]), len(words)).view(np.int64)


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of each hash whether it is among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(hashes), dtype=bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


class _Cut:
    """Words and lines of several texts, as arrays."""

    def __init__(self, texts: list[str]) -> None:
        t = letter_tables()
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
        fold = t["fold"][self.codes]
        self.here = np.flatnonzero(fold)
        self.breaks = self.codes == 10
        line = np.cumsum(self.breaks)
        self.lines = int(line[-1]) + 1 if len(line) else 1
        starts = np.diff(self.here, prepend=-9) > 1
        self.begin = self.here[starts]
        self.size = np.diff(np.append(np.flatnonzero(starts), len(self.here)))
        word = np.cumsum(starts) - 1
        self.word = _sums(fold[self.here], word, len(self.begin)).view(np.int64)
        self.line = line[self.begin] if len(self.begin) else np.zeros(0, dtype=np.int64)
        self.upper = t["upper"][self.codes[self.begin]] if len(self.begin) else np.zeros(0, dtype=bool)

    def digits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups of digits with at most two signs between them: first position, number of digits, first digit."""
        digit = np.flatnonzero((self.codes >= 48) & (self.codes <= 57))
        if not len(digit):
            return digit, digit, digit
        gap = np.diff(digit, prepend=-9)
        between = self.codes[np.maximum(digit - 1, 0)]
        joined = (gap == 1) | (gap <= 3) & np.isin(between, [32, 46, 45, 41])
        first = np.flatnonzero(~joined)
        return digit[first], np.diff(np.append(first, len(digit))), self.codes[digit[first]] - 48


def disclosure_counts(df: DataFrame, text: str) -> DataFrame:
    """By word (hash): n passages, anchored (those with a structured item), inside (right after another word) and proper (of these, with a capital). Word 0 has the passages.

    A task adds up what it has met and hands it on when it holds HELD_WORDS words, so its memory doesn't grow with the vocabulary.
    """
    src = df.select(F.col(text).alias("t")).where("t is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, street = np.sort(word_hashes(LABELS)), np.sort(word_hashes(STREET))
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                held.append(_count(batch.column(0).slice(start, 1000).to_pylist(), labels, street))
                if len(held) > 20:
                    held = [_add(held)]
                    if len(held[0][0]) > HELD_WORDS:
                        yield _counts(held.pop())
        if held:
            yield _counts(_add(held))

    out = src.mapInArrow(run, "word bigint, n bigint, anchored bigint, inside bigint, proper bigint")
    return out.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "anchored", "inside", "proper")))


def _counts(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["word", "n", "anchored", "inside", "proper"])


def _add(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return (keys, *(np.bincount(where, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in range(1, 5)))


def _count(texts: list[str], labels: np.ndarray, street: np.ndarray) -> tuple[np.ndarray, ...]:
    cut = _Cut(texts)
    codes = cut.codes
    following = np.append(codes[1:], 10)
    ends = cut.breaks | np.isin(codes, [46, 59]) & (following == 32)
    passage = np.cumsum(ends)
    passages = int(passage[-1]) + 1
    anchor = np.zeros(passages, dtype=bool)
    before = np.append(10, codes[:-1])
    letter = letter_tables()["fold"]
    at = np.flatnonzero((codes == 64) & ((letter[before] > 0) | (before >= 48) & (before <= 57)) | (codes == 0xFF20))
    anchor[passage[at]] = True
    where, many, first = cut.digits()
    anchor[passage[where[(many == 9) & (first == 9) | (many == 11) & (first == 5)]]] = True
    own = passage[cut.begin]
    label = _among(cut.word, labels)
    anchor[own[label]] = True
    # words of addresses and of anything with digits or signs of an address inside aren't counted
    skip = label
    road = np.flatnonzero(_among(cut.word, street))
    for k in range(5):
        near = road[road + k < len(own)] + k
        skip[near[own[near] == own[near - k]]] = True
    after = np.append(codes, [10, 10])[cut.begin + _lengths(cut)]
    skip |= np.isin(after, [64, 0xFF20, 45, 95]) | (after >= 48) & (after <= 57) | np.isin(before[cut.begin], [64, 0xFF20, 45, 95]) | (cut.size < 3)
    keep = ~skip
    spot = np.maximum(cut.begin - 2, 0)
    inside = (before[cut.begin] == 32) & (letter[codes[spot]] > 0) & keep
    keys, where = np.unique(cut.word[keep], return_inverse=True)
    counts = [np.bincount(where, x, len(keys)).astype(np.int64) for x in (np.ones(keep.sum()), anchor[own[keep]], inside[keep], (inside & cut.upper)[keep])]
    return (np.append(keys, 0), np.append(counts[0], passages), np.append(counts[1], anchor.sum()), np.append(counts[2], 0), np.append(counts[3], 0))


def _lengths(cut: _Cut) -> np.ndarray:
    """Code points each word covers."""
    last = np.append(np.flatnonzero(np.diff(cut.here) > 1), len(cut.here) - 1) if len(cut.here) else np.zeros(0, dtype=np.int64)
    return cut.here[last] - cut.begin + 1 if len(cut.here) else last


def terms(counts: DataFrame) -> DataFrame:
    """The words (hashes) whose disclosure reaches the threshold and that are written as proper nouns, as a written table.

    The counts are made once: what can be a term is written together with the row of the totals.
    """
    can_be = (F.col("n") >= MIN_PASSAGES) & (F.col("anchored") > 0) & (F.col("proper") >= MIN_PROPER) & (F.col("proper") >= PROPER_SHARE * F.col("inside"))
    kept = materialize(counts.where((F.col("word") == 0) | can_be), "words")
    total = kept.where("word = 0").first()
    if total is None or not total["anchored"]:
        return kept.where("false").select("word")
    share = total["n"] / total["anchored"]
    pmi = F.log(F.col("anchored") / F.col("n") * share)
    return kept.where((F.col("word") != 0) & (pmi >= DISCLOSURE * math.log(share))).select("word")


def own_terms(src: DataFrame, chosen: DataFrame) -> DataFrame:
    """src (k, t) with own, the terms among the words of t: for more terms than are broadcast.

    Words of distinct texts are joined by equality; a text that stands in many rows is looked up once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.unique(_Cut([text]).word)
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(words), pa.string()), pa.array(words)], names=["digest", "word"])

    texts = src.where("t is not null").select(F.sha2("t", 256).alias("digest"), "t").dropDuplicates(["digest"])
    hits = texts.mapInArrow(run, "digest string, word bigint").join(chosen, "word").groupBy("digest").agg(F.collect_set("word").alias("own"))
    return src.withColumn("digest", F.sha2("t", 256)).join(hits, "digest", "left").select("k", "t", "own")


class Finder:
    """Finds the items of all kinds in texts, given the terms that may stand in them."""

    def __init__(self) -> None:
        self.flags = {k: np.sort(word_hashes(v)) for k, v in (("street", STREET), ("mail", ["arroba", "at", "punto", "dot"]), ("id", LABELS + ["ce", "cedula", "identity", "identificado", "identificada", "bilhete", "d", "c"]), ("digit", DIGIT_WORDS))}

    def items(self, texts: list[str], known_terms: np.ndarray) -> Iterator[list[tuple[int, int, int, str]]]:
        """Of each text its items: line number (from 1), first and last position in the line, kind."""
        cut = _Cut(texts)
        term = _among(cut.word, known_terms)
        flag = {k: _among(cut.word, v) for k, v in self.flags.items()}
        named = np.bincount(cut.line[term], minlength=cut.lines)
        street = np.bincount(cut.line[flag["street"]], minlength=cut.lines)
        spoken = np.bincount(cut.line[flag["digit"]], minlength=cut.lines)
        label = np.bincount(cut.line[flag["id"]], minlength=cut.lines)
        line_of = np.cumsum(cut.breaks)
        mail = np.bincount(line_of[(cut.codes == 64) | (cut.codes == 0xFF20)], minlength=cut.lines) + (np.bincount(cut.line[flag["mail"]], minlength=cut.lines) > 1)
        where, many, _ = cut.digits()
        number = np.bincount(line_of[where[many >= 6]], minlength=cut.lines) if len(where) else np.zeros(cut.lines, dtype=np.int64)
        wanted = (named > 0) | (street > 0) | (spoken > 5) | (mail > 0) | (number > 0)
        starts = np.concatenate([[0], np.flatnonzero(cut.breaks) + 1])
        first_word = np.searchsorted(cut.line, np.arange(cut.lines + 1))
        size = _lengths(cut)
        at = 0
        for text in texts:
            found: list[tuple[int, int, int, str]] = []
            lines = text.split("\n")
            for i in (np.flatnonzero(wanted[at : at + len(lines)]) if len(lines) > 1 else ([0] if wanted[at] else [])):
                k, line = at + int(i), lines[i]
                known: dict[int, int] = {}
                if named[k]:
                    w = np.arange(first_word[k], first_word[k + 1])[term[first_word[k] : first_word[k + 1]]]
                    known = dict(zip((cut.begin[w] - starts[k]).tolist(), (cut.begin[w] - starts[k] + size[w]).tolist()))
                after_name = i > 0 and bool(found) and found[-1][0] == i and found[-1][3] == "name" and lines[i - 1][found[-1][2] :].strip(" .,") == ""
                found += [(int(i) + 1, *x) for x in self.in_line(line, known, bool(mail[k]), bool(street[k]), spoken[k] > 5, bool(number[k]), bool(label[k]), after_name)]
                if street[k] and i + 1 < len(lines) and HOUSE.match(lines[i + 1]) and (m := ROAD_END.search(line)) and not CLOSED.search(m[0]):
                    found.append((int(i) + 1, m.start(), len(line), "address"))  # the number stands on the next line
            at += len(lines)
            yield found

    def in_line(self, line: str, known: dict[int, int], mail: bool, street: bool, spoken: bool, number: bool, label: bool, after_name: bool) -> list[tuple[int, int, str]]:
        """Items of one line: first and last position, kind, in order."""
        taken: list[tuple[int, int, str]] = []
        free = lambda a, b: all(b <= x or y <= a for x, y, _ in taken)
        if mail:
            taken += [(m.start(), m.end(), "email") for m in EMAIL.finditer(line)]
        if number and label:
            taken += [(m.start("n"), m.end("n"), "id_number") for m in ID_LABEL.finditer(line) if free(*m.span("n"))]
        if street:
            taken += [(m.start(), m.end(), "address") for m in ADDRESS.finditer(line) if free(*m.span()) and not CLOSED.search(m[0])]
        if known:
            taken += [(a, b, "name") for a, b in self.names(line, known) if free(a, b)]
        if number:
            names = [(a, b) for a, b, kind in taken if kind == "name"]
            for m in BARE_ID.finditer(line):
                a, b = m.span()
                near = any(0 <= a - y <= 5 and not re.search(r"[^\W\d_]", line[y:a]) or 0 <= x - b <= 5 and not re.search(r"[^\W\d_]", line[b:x]) for x, y in names)
                if free(a, b) and (near or after_name and not line[:a].strip()):
                    taken.append((a, b, "id_number"))
            for pattern in (MOBILE, LANDLINE):
                for m in pattern.finditer(line):
                    digits = len(re.sub(r"\D", "", m[0]))
                    if free(*m.span()) and 8 <= digits <= 13 and not NOT_PHONE.search(line[max(0, m.start() - 40) : m.start()]):
                        taken.append((m.start(), m.end(), "phone"))
        if spoken:
            taken += [(m.start(), m.end(), "phone") for m in SPOKEN.finditer(line) if free(*m.span())]
        return sorted(taken)

    @staticmethod
    def names(line: str, known: dict[int, int]) -> Iterator[tuple[int, int]]:
        """Runs of terms, initials and particles that are a person's name."""
        run: list[tuple[int, int, str]] = []

        def finish() -> Iterator[tuple[int, int]]:
            while run and run[-1][2] == "particle":
                run.pop()
            while run and run[0][2] == "particle":
                run.pop(0)
            kinds = [k for _, _, k in run]
            if kinds.count("term") >= 2 or "term" in kinds and "initial" in kinds:
                before = BEFORE.search(line[: run[0][0]])
                words = [x.lower().strip(".") for x in re.findall(r"[\w.]+", line[max(0, run[0][0] - 40) : run[0][0]])[-2:]]
                part_of = before is not None and before[1].lower().strip(".") in INSTITUTION
                if not part_of and not (len(words) == 2 and words[0] in INSTITUTION and words[1] in {"nacional", "mayor", "central", "regional", "magna", "privado", "privada", "estatal", "don", "doña", "de", "del"}):
                    yield run[0][0], run[-1][1]
            run.clear()

        last = -9
        for m in WORD.finditer(line):
            a, b = m.span()
            if a in known:
                kind = "term"
            elif b - a == 1 and m[0].isupper() and line[b : b + 1] == ".":
                kind, b = "initial", b + 1
            elif m[0].lower() in PARTICLES:
                kind = "particle"
            else:
                yield from finish()
                last = -9
                continue
            if run and not re.fullmatch(r"\s{1,3}|, ?|-", line[last:a]):
                yield from finish()
            if kind == "particle" and not run:
                continue
            run.append((a, b, kind))
            last = b
        yield from finish()


def find(df: DataFrame, key: str = "doc_id", text: str = "text", redact: bool = False) -> DataFrame:
    """The items of each row: key, line_no, first (position in the line, from 1), length, kind; with redact instead key and text with typed placeholders.

    Null and empty texts have no items and, with redact, stay as they are. Null
    keys and repeated rows stay rows of their own. An empty table gives no rows. Other columns aren't read.
    """
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    chosen = terms(disclosure_counts(df, text))
    if chosen.count() <= BROADCAST_TERMS:
        shared = df.sparkSession.sparkContext.broadcast(np.sort(chosen.toArrow().column("word").to_numpy()))
        src = src.withColumn("own", F.lit(None).cast("array<bigint>"))
    else:
        shared = None
        src = own_terms(src, chosen)
    kind = dict(src.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = part.column(1).to_pylist()
                # a term is one in every text, so those of the texts at hand are all that can be met
                known = shared.value if shared else np.unique(part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                if redact:
                    out = [t and redacted(t, items) for t, items in zip(texts, finder.items([t or "" for t in texts], known))]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["k", "t"])
                    continue
                rows = [(i, *x) for i, items in enumerate(finder.items([t or "" for t in texts], known)) for x in items]
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [pa.array(list(x), y) for x, y in zip(zip(*((r[1], r[2] + 1, r[3] - r[2], r[4]) for r in rows)), (pa.int32(), pa.int32(), pa.int32(), pa.string()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), *columns], names=["k", "line_no", "first", "length", "kind"])

    if redact:
        return src.mapInArrow(run, f"k {kind}, t string").select(F.col("k").alias(key), F.col("t").alias(text))
    return src.where("t is not null").mapInArrow(run, f"k {kind}, line_no int, first int, length int, kind string").withColumnRenamed("k", key)


def redacted(text: str, items: list[tuple[int, int, int, str]]) -> str:
    """The text with a placeholder such as [EMAIL] for each item."""
    lines = text.split("\n")
    for line_no, a, b, kind in reversed(items):
        lines[line_no - 1] = f"{lines[line_no - 1][:a]}[{kind.upper()}]{lines[line_no - 1][b:]}"
    return "\n".join(lines)

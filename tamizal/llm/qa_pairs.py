"""Defective pairs of a prompt and its response, each with the type of its defect.

Responses are sorted by question and text over the whole corpus, so that a
response that was cut off stands before its longer versions: the responses that are
prefixes of the present one are kept open, and one that goes on inside its last word, number or
date is a shortened one. Lengths
at which far more responses end unfinished than at the lengths around them are
limits of the writer, and an unfinished response of such a length is cut off
too. On the same way each response's opening clause is noted, without courtesies, names and numbers:
a clause that opens responses to questions of unlike topics answers none of them, so a response that
begins with it and gives no number of its own declines. Then rules on a pair alone find empty responses, other broken-off ends,
copies of the question, refusals of known wording, and responses in another language.

The types exclude each other and are tried in the order empty, copy, refusal,
language, truncated.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamizal.session import materialize

#: Rows that are broadcast at most (some 30 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: A length is a limit if so many unfinished responses have it and so many times as many as the lengths around it have.
SPIKE_ROWS, SPIKE_TIMES = 50, 8
#: An opening clause is told to unlike questions if so many have it and no topic holds a larger share of these.
CLAUSE_QUESTIONS, TOPIC_SHARE = 5, 0.7

#: The language of a query that shows none.
USUAL = "es"
# fixed values: how systems write that there is no value
PLACEHOLDERS = {"null", "none", "nan", "na", "nil", "undefined", "nulo", "ninguno", "vacio", "sinvalor", "sindato", "sindatos", "sinrespuesta", "norespuesta", "nohay", "nd", "sd", "sn", "empty", "noanswer"}

# fixed values: frequent function words by language
FUNCTION_WORDS = {
    "es": "el la los las de del en y que por para con una un es son se su al lo mas fue sera hay segun pero aunque esta este hasta desde entre sobre tambien cuantas cuantos cuanto cual como cuando puede puedo debe tiene si quiero dia sede plazas cupos piden nada ninguno hoy quien donde me dime todos",
    "en": "the of to and in for with on that this is are be will not it by from at you your can was were there has have which what when where how must should under each these those many do need does about say i",
    "pt": "o a os as do da dos das em no na nos nas e que por para com uma um sao se nao ao pelo pela mais foi sera ha segundo mas ate entre sobre tambem quantas quanto qual quais voce deve esse essa esta diz vagas prova curso inclui custa",
    "it": "il lo la gli le di del della dei delle in nel nella e che per con una un sono si non al dal piu sara ci ma anche fino tra quale quanti questo questa ogni deve puo primo sui posti anno",
    "fr": "le la les des du de en et que pour avec une un est sont se ne pas au aux par plus sera il elle mais aussi dans sur ce cette ces quel quelle vous doit jusqu lieu selon y",
    "de": "der die das den dem des und in im zu mit fur auf ist sind nicht ein eine einen von bei aus wird werden es sie auch nach bis uber an am wie viele kann muss gibt",
}
_LANGUAGES: dict[str, dict[str, float]] = {}
for _name, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _LANGUAGES.setdefault(_w, {})[_name] = 1.0
for _own in _LANGUAGES.values():
    for _name in _own:
        _own[_name] = 1.0 / len(_own)

NO_ALNUM = re.compile(r"[\W_]+")
MARKS = re.compile("[\u0300-\u036f]+")
LETTERS = re.compile(r"[^\W\d_]+")
INVISIBLE = re.compile("[\xad​-‏‪-‮⁠-⁤﻿]")
LEAD = re.compile(
    r"^\W*(?:(?:respuesta|answer|resposta)\s*:|hola[.,!]|buen[oa]s(?: días| tardes| noches)?[.,!]|según los documentos,|de acuerdo con el fragmento \d+:|como asistente[^,.;:]{0,40},|gracias por su consulta[;,.](?: sin embargo,)?|por el momento,?|lamentablemente,?|lo siento[,.;]|disculpe[,.;]|perdón[,.;]|sorry[,.;]|desculpe[,.;]|unfortunately,?|infelizmente,?|i am sorry[,.;]|mi dispiace[,.;])\s*",
    re.I,
)
_NO = r"(?:no|não|non)"
REFUSAL = re.compile(
    r"^(?:"
    rf"{_NO} (?:me |le |te |nos )?(?:puedo|podemos|podría|posso|podemos|posso|es posible|foi possível|é possível|resulta posible|corresponde (?:responder|contestar|opinar))\b"
    rf"|{_NO} (?:estoy|estamos|estou|sono) (?:autorizad|en condiciones|facultad|habilitad|permitid|em condições)"
    rf"|{_NO} (?:sé|sabría|sabemos|sei|saberia|so|saprei)\b"
    rf"|{_NO} (?:dispongo|cuento|disponho|tengo|tenho|poseo|dispomos|contamos|tenemos|ho)\b"
    rf"|{_NO} (?:encontré|encuentro|hallé|hallo|he encontrado|ubiqué|localicé|encontrei|achei|ho trovato|trovo) (?:esa|esta|essa|esse|dicha|nada|ning|nenhum|la |el |los |las |a |o |queste|questa|información|datos|informações|referencia)"
    rf"|{_NO} (?:hay|existe|existen|consta|constan|figura|figuran|há|c'è) (?:información|datos?|nada|ning|informação|registro)"
    r"|carezco\b|carecemos\b|desconozco\b|ignoro\b|me abstengo\b|declino\b|rehúso\b"
    rf"|prefiero {_NO} |prefiro não "
    r"|(?:eso|ello|esto|esa|esta|este|tal|isso|essa|la) ?(?:consulta|pregunta|respuesta|solicitud|tema|pedido|pergunta|información)? ?(?:está|queda|excede|escapa|supera|rebasa|foge|está fora|no (?:es|forma|corresponde))\b.{0,60}(?:fuera|reservad|funciones|alcance|competencia|ámbito|servicio|atribuciones|fora|escopo)"
    r"|(?:solo|sólo|únicamente|solamente|apenas|só) (?:atiendo|respondo|puedo|atendemos|respondemos|atendo)\b"
    r"|(?:los|las|os|as|i|the) (?:fragmentos|documentos|fuentes|textos|trechos|fragments|documents|documenti)[^.;]{0,60}(?:no|não|nothing|non|do not|don't)\b[^.;]*(?:mencionan?|traen?|contienen?|dicen?|indican?|incluyen?|informan?|recogen?|say|mention|contain|trazem|citam|nothing|about)"
    r"|(?:acerca de|sobre|respecto a|en cuanto a)[^.;]{0,120}(?:los|las) (?:documentos|fragmentos|fuentes|textos)[^.;]{0,30}\bno (?:traen|dicen|mencionan|contienen|indican|incluyen|recogen)\b"
    r"|i (?:am unable|am not able|cannot|can not|can't|could not|couldn't|do not|don't|have no|will not|won't|am afraid)\b"
    r"|that (?:question|request|information) is (?:outside|beyond|not)\b|this (?:question|request) is (?:outside|beyond)\b"
    r")",
    re.I,
)
GIVES = re.compile(r"\b(?:pero|aunque|sin embargo|no obstante|but|however|mas|porém|ma|però)\b[^.]*\d", re.I)
VALUE = r"(?:(?:S/|US\$|\$|€)\s?\d+(?:[.,]\d{2})?|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}:\d{2}|\d+(?:[.,]\d+)*\s?%?|sí|si|no)"
COMPLETE = re.compile(
    rf"^\W*(?:.{{0,160}}?:\s*)?(?:(?:del|desde el|from|de)\s+{VALUE}\s+(?:al|hasta el|to|a|até)\s+{VALUE}|{VALUE}(?:\s+(?:vacantes|plazas|cupos|soles|vagas|places|días|puntos))?)\s*$",
    re.I,
)
ENDS = re.compile(r"[.!?»”\")\]]$")
ABBREVIATION = re.compile(r"(?:\b(?:p|pp|pág|págs|art|arts|n|núm|no|inc|lit|cap|etc|vol|ed|sr|sra|dr|dra)\.|N\.º|º)$", re.I)


@lru_cache(maxsize=20_000)
def bare(text: str) -> str:
    """The text's letters and digits, without case and accents."""
    return NO_ALNUM.sub("", unicodedata.normalize("NFKD", text.casefold()))


def plain(text: str) -> str:
    """The text without accents, since queries are often typed so."""
    return text if text.isascii() else MARKS.sub("", unicodedata.normalize("NFD", text))


@lru_cache(maxsize=20_000)
def _language(text: str) -> dict[str, float]:
    """Evidence for each language from words written in lower case; capitalised names prove nothing."""
    found: dict[str, float] = {}
    if text.isupper():
        text = text.lower()
    if "¿" in text or "¡" in text:
        found["es"] = 1.0
    text = plain(text)
    first = True
    for w in LETTERS.findall(text):
        low = w.lower()
        if first or w == low:
            for name, weight in _LANGUAGES.get(low, {}).items():
                found[name] = found.get(name, 0.0) + weight
            if low.endswith(("cao", "coes")):
                found["pt"] = found.get("pt", 0.0) + 1.0
            elif low.endswith(("cion", "ciones")):
                found["es"] = found.get("es", 0.0) + 1.0
        first = False
    return found


def is_empty(answer: str | None) -> bool:
    """Nothing in it but blanks, invisible characters, punctuation or a placeholder."""
    if answer is None:
        return True
    letters = bare(INVISIBLE.sub("", answer))
    return not letters or letters in PLACEHOLDERS


def is_copy(query: str, answer: str) -> bool:
    """Nothing but the question, perhaps named as such, without its opening courtesy, or repeated."""
    q = bare(query)
    a = bare(re.sub(r"^\W*(?:pregunta|consulta|question|pergunta)\s*:", "", answer, flags=re.I))
    if not q or not a:
        return False
    times = len(a) // len(q)
    return (times >= 1 and a == q * times) or (len(a) >= 0.6 * len(q) and q.endswith(a) and len(q) - len(a) <= 20)


def is_refusal(answer: str) -> bool:
    """The whole answer declines or says that the information is missing."""
    core = opened(answer)
    return bool(REFUSAL.match(core)) and not GIVES.search(core)


def language(text: str) -> dict[str, float]:
    """See _language; the caller may change what it gets."""
    return dict(_language(text))


@lru_cache(maxsize=1000)
def opened(answer: str) -> str:
    """The answer without its opening courtesies and labels."""
    core, last = answer.strip(), None
    while core != last:
        last, core = core, LEAD.sub("", core, count=1)
    return core


def is_foreign(query: str, answer: str) -> bool:
    """Written in another language than the query; a query that shows no language counts as USUAL."""
    asked, said = language(query), language(opened(answer))
    asked[USUAL] = asked.get(USUAL, 0.0) + 0.4
    if not said:
        return False
    own = max(asked, key=lambda x: asked[x])
    best = max(said, key=lambda x: said[x])
    return best != own and said[best] >= 1.0 and said[best] >= 1.25 * said.get(own, 0.0) + 0.3


def is_unfinished(answer: str) -> bool:
    """It ends inside a sentence or a bracket and isn't a bare value or `label: value`."""
    text = INVISIBLE.sub("", answer).rstrip()
    if text.endswith(("…", "...")):
        return True
    if text.count("(") > text.count(")") or text.count("«") > text.count("»") or text.count("[") > text.count("]"):
        return True
    if ENDS.search(text):
        return bool(ABBREVIATION.search(text))
    return not (COMPLETE.match(text) or COMPLETE.match(opened(text)))


NUMBER = re.compile(r"\d+(?:[/.:,]\d+)*")
CLAUSE_END = re.compile(r"[.;!?,\n]")


@lru_cache(maxsize=50_000)
def opening(answer: str) -> int | None:
    """The hash of the answer's first clause without courtesies, numbers and capitalised words; null if it doesn't end or says too little."""
    import xxhash

    text = NUMBER.sub("0", opened(INVISIBLE.sub("", answer)))
    end = CLAUSE_END.search(text)
    if end is None:
        return None
    words = [w for i, w in enumerate(LETTERS.findall(text[: end.start()])) if i == 0 or w.islower()]
    return xxhash.xxh3_64_intdigest(" ".join(words).lower()) - (1 << 63) if len(words) > 1 else None


def gives_number(query: str, answer: str) -> bool:
    """Whether the answer has a number that the query hasn't."""
    return not set(NUMBER.findall(opened(answer))) <= set(NUMBER.findall(query))


def pair_defect(query: str | None, answer: str | None, short: bool = False, declined: bool = False) -> str | None:
    """The defect of a pair; short if it is known to be cut off, declined if its opening clause is told to unlike questions."""
    if is_empty(answer):
        return "empty"
    query = query or ""
    if is_copy(query, answer):
        return "copy"
    if is_refusal(answer) or declined and not gives_number(query, answer):
        return "refusal"
    if is_foreign(query, answer):
        return "language"
    return "truncated" if short or is_unfinished(answer) else None


def goes_on_inside(text: str, longer: str) -> bool:
    """Whether longer, which begins with text, goes on inside text's last word, number, date or abbreviation."""
    last, after = text[-1], longer[len(text)]
    if after.isalnum():
        return last.isalnum() or last in "./,-:(" and not text[-2:-1].isspace()
    return last.isdigit() and after in "/.," and longer[len(text) + 1 : len(text) + 2].isdigit()


class Compared:
    """What the distinct answers of a table say of each other; see the module's text.

    The distinct answers are range-partitioned and sorted by question and text. An answer stays open while those
    that follow begin with it. Answers still open at a partition's end, as many as are nested there, are held against all
    others of their question afterwards.
    """

    def __init__(self, df: DataFrame, question: str, answer: str, topic: str | None) -> None:
        src = df.select(F.col(question).alias("q"), F.col(answer).alias("a")).where("q is not null and a is not null and a <> ''").distinct()
        kind = dict(src.dtypes)["q"]
        self.answers = materialize(src, "answers")
        schema = f"q {kind}, a string, clause bigint, size int, open boolean"
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema, prefers_large_types=False)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, stack = None, []
            clauses: set[int] = set()
            for batch in batches:
                rows: list[tuple] = []
                for q, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if q != held:
                        held, stack, clauses = q, [], set()
                    while stack and not a.startswith(stack[-1]):
                        stack.pop()
                    cut = [x for x in stack if goes_on_inside(x, a)]
                    if cut:
                        rows += [(q, x, None, None, False) for x in cut]
                        stack = [x for x in stack if x not in cut]
                    stack.append(a)
                    if is_unfinished(a):
                        rows.append((q, None, None, len(a), None))
                    elif (clause := opening(a)) is not None and clause not in clauses:
                        clauses.add(clause)
                        rows.append((q, None, clause, None, None))
                yield _batch(rows)
            yield _batch([(held, x, None, None, True) for x in stack])

        def _batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

        ordered = self.answers.repartitionByRange("q", "a").sortWithinPartitions("q", "a")
        self.notes = materialize(ordered.mapInArrow(run, schema), "compared")
        self.topics = None
        if topic is not None:
            votes = df.where(F.col(question).isNotNull()).groupBy(F.col(question).alias("q"), F.col(topic).alias("topic")).count()
            self.topics = votes.groupBy("q").agg(F.max_by(F.struct("topic"), F.struct("count", "topic"))["topic"].alias("topic"))

    def shortened(self) -> DataFrame:
        """q and a of the answers that another answer to the same question continues inside a word."""
        late = self.notes.where("open").select("q", F.col("a").alias("x"))
        late = F.broadcast(late) if late.count() <= BROADCAST_ROWS else late
        last, after, second = F.right("x", F.lit(1)), F.substr("a", F.length("x") + 1, F.lit(1)), F.substr("a", F.length("x") + 2, F.lit(1))
        word, blank = r"[\p{L}\p{N}]", F.coalesce(F.substr("x", F.length("x") - 1, F.lit(1)).rlike(r"\s"), F.lit(False)) & (F.length("x") > 1)
        inside = after.rlike(word) & (last.rlike(word) | last.rlike(r"[./,:(-]") & ~blank) | last.rlike(r"\p{Nd}") & after.rlike("[/.,]") & second.rlike(r"\p{Nd}")
        across = self.answers.join(late, "q").where(F.startswith("a", "x") & (F.length("a") > F.length("x")) & inside).select("q", F.col("x").alias("a"))
        return self.notes.where("not open").select("q", "a").union(across).distinct()

    def limits(self) -> list[int]:
        """Lengths at which so many distinct answers end without an end that a limit of the writer must be the reason."""
        count = self.notes.where("size is not null").groupBy("size").count()
        many = count.where((F.col("count") >= SPIKE_ROWS) & (F.col("size") > 20))
        near = many.select("size", "count", F.explode(F.array(*(F.col("size") + d for d in (-4, -3, -2, -1, 1, 2, 3, 4)))).alias("by"))
        near = near.join(count.select(F.col("size").alias("by"), F.col("count").alias("n")), "by", "left")
        found = near.groupBy("size", "count").agg(F.element_at(F.array_sort(F.collect_list(F.coalesce("n", F.lit(0)))), 5).alias("around"))
        return sorted(r["size"] for r in found.where(F.col("count") >= SPIKE_TIMES * F.greatest(F.lit(1), "around")).collect())

    def told_to_all(self) -> DataFrame:
        """The opening clauses that are told to questions of unlike topics; a question's topic is its most frequent one."""
        clauses = self.notes.where("clause is not null").select("q", "clause").distinct()
        if self.topics is None:
            return clauses.where("false").select("clause")
        by_topic = clauses.join(self.topics, "q").groupBy("clause", "topic").agg(F.count("*").alias("n"))
        each = by_topic.groupBy("clause").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
        return each.where((F.col("all") >= CLAUSE_QUESTIONS) & (F.col("most") <= TOPIC_SHARE * F.col("all"))).select("clause")


def defects(df: DataFrame, keys: tuple[str, ...] = ("id", "system", "attempt"), question: str = "id", query: str = "query", answer: str = "answer", topic: str | None = None) -> DataFrame:
    """keys and defect of each distinct defective pair.

    question names the column that says which answers belong to one question, topic one that tells
    what a question is about (most often, if rows differ; null is a topic too; without it no clause counts as told to all).
    A null answer is `empty`, with a null query too; a pair without query can be
    neither copy nor language. Repeated rows count once; if rows repeat a key
    with other contents, the first defect in the order of the types is given. Null keys are
    kept as they are. An empty table gives no rows.
    """
    compared = Compared(df, question, answer, topic)
    rows = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(question).alias("q"), F.col(query).alias("asked"), F.col(answer).alias("a"))
    cut = materialize(compared.shortened().select(F.col("q").alias("cut_q"), F.xxhash64("a").alias("cut_a")).distinct(), "cut")
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut
    at_limit = compared.limits()
    flagged = rows.withColumn("h", F.xxhash64("a")).join(cut, (F.col("q") == F.col("cut_q")) & (F.col("h") == F.col("cut_a")), "left")
    own = [f"k{i}" for i in range(len(keys))]
    src = flagged.select(*own, "asked", "a", F.col("cut_a").isNotNull().alias("short"), F.lit(None).cast("boolean").alias("declined"))
    clauses = materialize(compared.told_to_all(), "clauses")
    few = clauses.count() <= BROADCAST_ROWS
    shared = df.sparkSession.sparkContext.broadcast(set(clauses.toArrow().column("clause").to_pylist())) if few else None
    if not few:  # each row's clause is joined instead

        def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [opening(a) if a else None for a in batch.column("a").to_pylist()]
                yield batch.append_column("clause", pa.array(found, pa.int64()))

        ddl = ", ".join(f"{c} {t}" for c, t in src.dtypes)
        src = src.mapInArrow(noted, f"{ddl}, clause bigint").drop("declined").join(clauses.withColumn("declined", F.lit(True)), "clause", "left").drop("clause")
    kinds = dict(src.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limited = set(at_limit)
        memo: dict[tuple, str | None] = {}
        for batch in batches:
            n = len(own)
            out = []
            for pair in zip(*(batch.column(n + i).to_pylist() for i in range(4))):
                if pair not in memo:
                    if len(memo) > 50_000:
                        memo.clear()
                    asked, a, short, declined = pair
                    declined = opening(a) in shared.value if shared and a else bool(declined)
                    memo[pair] = pair_defect(asked, a, short or a is not None and len(a) in limited and is_unfinished(a), declined)
                out.append(memo[pair])
            found = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(out, pa.string())], names=[*own, "defect"])
            yield found.filter(found.column("defect").is_valid())

    order = F.array(*(F.lit(x) for x in ("empty", "copy", "refusal", "language", "truncated")))
    found = src.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in own) + ", defect string")
    found = found.groupBy(*own).agg(F.min(F.array_position(order, F.col("defect"))).alias("at"))
    return found.select(*(F.col(o).alias(k) for o, k in zip(own, keys)), F.element_at(order, F.col("at").cast("int")).alias("defect"))

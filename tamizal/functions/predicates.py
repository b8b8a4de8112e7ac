"""Predicates and classifications as column expressions. Rules are data: ordered lists of (label, pattern)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamizal.functions import text as T

# fixed values: intents that a query names outright, tried in this order
INTENT_RULES = (
    ("TEMARIO", r"\b(temario|temas entran|contenido entra|que entra|cursos entran)\b"),
    ("REGLAMENTO", r"\b(articulo|reglamento|requisito|documentos para postular|edad minima|pago de inscripcion)\b"),
    ("VACANTES", r"\b(cuantas? (vacantes|plazas)|numero de vacantes|plazas disponibles|vacantes hay)\b"),
    ("CRONOGRAMA", r"\b(cronograma|inscripciones van|inicio de clases|empiezan las clases|evaluacion previa|examen de conocimientos|asignacion de vacantes)\b"),
)
TEMPORAL = r"\b(que dia|cuando|fecha de|hasta que dia)\b"
SUBJECT = r"\b(admision|postul\w*|examen|inscrip\w*|vacantes?|plazas?|clases)\b"
# fixed values: topics outside the domain
OUTSIDE_RULES = (
    r"\b(curriculum|hoja de vida|buscar empleo|buscar trabajo|entrevista laboral|practicas laborales)\b",
    r"\b(futbol|liga 1|partidos?|juega \w+ contra)\b",
    r"\b(restaurante|cafeteria|almorzar|pizzeria|menu economico)\b",
    r"\b(clima|llover|lluvia|temperatura de hoy)\b",
)
LIST_QUERY = r"\b(cuales|todas|todos|lista|listado|enumera|que carreras|que programas|que documentos)\b"
# fixed values: how an answer says that the information is missing, in folded text
ABSTENTION = (
    r"no encontre esa informacion|fuera del alcance|no aparece|no figura|no se encuentra|no hay informacion|no tengo informacion|no corresponde|no puedo (responder|ayudar)|"
    r"no (esta|estan) (en|incluid)|no se (menciona|especifica|indica|proporciona)|no contiene|no cuento|no existe informacion|no hay datos"
)
# fixed values: query words that name no subject
GENERIC_TERMS = "admision proceso examen postulante postular pregunta informacion documento documentos dice saber quiero puedo debo seria serian cual cuales".split()


def first_rule(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first rule whose pattern is found; null if none is."""
    out = F.when(c.rlike(rules[0][1]), rules[0][0])
    for label, pattern in rules[1:]:
        out = out.when(c.rlike(pattern), label)
    return out


def any_rule(c: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns is found."""
    out = c.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))


def rule_text(query: Column) -> Column:
    """The query as the rules read it: folded, single spaces. Make it a column of its own, so that it is computed once."""
    return F.regexp_replace(T.fold(query), "\\s+", " ")


def explicit_intent(q: Column) -> Column:
    """The category a query (as rule_text) names outright, else the schedule if it asks for a time and names the process, else null."""
    return F.coalesce(first_rule(q, INTENT_RULES), F.when(q.rlike(TEMPORAL) & q.rlike(SUBJECT), "CRONOGRAMA"))


def outside_domain(q: Column) -> Column:
    return any_rule(q, OUTSIDE_RULES)


def rule_route(q: Column, outside: str = "FUERA_DE_DOMINIO") -> Column:
    """Rule precedence on rule_text: the syllabus intent, then the topics outside, then other intents; null is left to a model."""
    syllabus = first_rule(q, INTENT_RULES[:1])
    return F.when(syllabus.isNotNull(), syllabus).when(outside_domain(q), outside).otherwise(explicit_intent(q))


def is_list_query(query: Column) -> Column:
    return F.coalesce(T.norm(query).rlike(LIST_QUERY), F.lit(False))


def top_k(query: Column, k: int = 5) -> Column:
    """Twice as many for a query that asks for a list."""
    return F.when(is_list_query(query), 2 * k).otherwise(k)


def with_text_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """df with quality: whether a page's text layer can be used, as struct of status, reason and the measures behind it.

    In steps, so that the text without white space is made once for all measures.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    one = df.withColumn("compact_", F.regexp_replace(c, "(?U)\\s", ""))
    rest = lambda p: F.length(F.regexp_replace("compact_", f"[^{p}]+", ""))
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    two = one.withColumns({
        "n_": F.length("compact_"), "letters_": rest("\\p{L}"), "digits_": rest("\\p{Nd}"), "odd_": rest("\\x{FFFD}\\p{Cc}\\p{Cs}\\p{Co}"), "words_": F.size(F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))),
        "table_": F.size(F.filter(lines, lambda x: F.trim(x, F.lit(" \t\r")).rlike("\\s{2,}|\t"))),
    })
    n, letters, digits, odd, words, table_like = (F.col(x) for x in ("n_", "letters_", "digits_", "odd_", "words_", "table_"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    alnum, dense, lost = ratio(letters + digits, n), ratio(digits, letters + digits), ratio(odd, n)
    reason = (
        F.when(n < 28, "too_little_native_text")
        .when(lost > 0.01, "suspicious_characters")
        .when(alnum < 0.55, "low_alphanumeric_ratio")
        .when((table_like >= 2) & (n >= 40), "readable_layout_or_table_rows")
        .when((words >= 5) & (n >= 48), "enough_readable_word_tokens")
        .when((n >= 80) & (alnum >= 0.85) & (dense >= 0.35), "dense_numeric_or_table_text")
        .otherwise("native_text_below_conservative_threshold")
    )
    three = two.withColumn("reason_", reason)
    usable = F.col("reason_").isin("readable_layout_or_table_rows", "enough_readable_word_tokens", "dense_numeric_or_table_text")
    quality = F.struct(
        F.when(usable, "native_text").otherwise("needs_ocr").alias("status"), F.col("reason_").alias("reason"), n.alias("characters"), words.alias("words"), table_like.alias("table_like_lines"),
        F.round(alnum, 4).alias("alphanumeric_ratio"), F.round(dense, 4).alias("digit_ratio"), F.round(lost, 4).alias("suspicious_ratio"),
    )
    return three.withColumn("quality", quality).drop("compact_", "n_", "letters_", "digits_", "odd_", "words_", "table_", "reason_")


def distinctive_terms(query: Column) -> Column:
    """Index tokens of four letters or more, folded, that aren't generic; distinct."""
    folded = F.transform(T.tokens(query), lambda t: T.fold(t))
    return F.array_distinct(F.filter(folded, lambda t: (F.length(t) >= 4) & ~F.array_contains(F.array(*(F.lit(g) for g in GENERIC_TERMS)), t)))


def folded_tokens(text: Column) -> Column:
    """The index tokens of a text without accents."""
    return F.transform(T.tokens(F.coalesce(text, F.lit(""))), lambda t: T.fold(t))


def anchored(terms: Column, context_tokens: Column) -> Column:
    """Whether a context holds enough of a query's distinctive terms; true if the query has none.

    Takes distinctive_terms and folded_tokens as columns, so that each is computed once.
    """
    n = F.size(terms)
    return (n == 0) | (F.size(F.array_intersect(terms, context_tokens)) >= F.greatest(F.lit(1), F.least(F.lit(2), F.ceil(n * 0.35).cast("int"))))


def same_anchors(a: Column, b: Column) -> Column:
    """Whether two queries may share an answer: the same numbers, and common subject words if both have any."""
    x, y = distinctive_terms(a), distinctive_terms(b)
    words = lambda t: F.filter(t, lambda w: ~w.rlike("[0-9]"))
    overlap = (F.size(words(x)) == 0) | (F.size(words(y)) == 0) | F.arrays_overlap(words(x), words(y))
    return (F.array_join(T.number_tokens(a), " ") == F.array_join(T.number_tokens(b), " ")) & overlap


def abstains(answer: Column) -> Column:
    return F.coalesce(T.fold(answer).rlike(ABSTENTION), F.lit(False))


def outcome(must: Column, abstain: Column, kind: Column, answer: Column, most_numbers: int = 5, short: int = 120) -> Column:
    """correct, abstained or wrong: all patterns found; a lookup must not list many numbers, nor a short answer abstain."""
    a = T.fold(F.coalesce(answer, F.lit("")))
    gives_up = F.coalesce(a.rlike(ABSTENTION), F.lit(False))
    ok = F.forall(F.coalesce(must, F.array().cast("array<string>")), lambda p: F.rlike(a, p))
    many = (kind == "lookup") & (F.size(T.standalone_integers(F.coalesce(answer, F.lit("")))) > most_numbers)
    missed = F.when(gives_up, "abstained").otherwise("wrong")
    return (
        F.when(F.coalesce(abstain, F.lit(False)), F.when(gives_up, "correct").otherwise("wrong"))
        .when(ok & F.coalesce(many, F.lit(False)), "wrong")
        .when(ok & ~(gives_up & (F.length(a) < short)), "correct")
        .otherwise(missed)
    )


def relaxed(must: Column, stems: Sequence[tuple[str, str]]) -> Column:
    """Patterns with parts replaced by looser ones, in order."""
    out = must
    for part, looser in stems:
        out = F.transform(out, lambda p, part=part, looser=looser: F.replace(p, F.lit(part), F.lit(looser)))
    return out


def supported_numbers(answer: Column, *sources: Column) -> Column:
    """Whether every number of the answer stands in one of the sources."""
    allowed = F.array_distinct(F.flatten(F.array(*(T.number_tokens(s) for s in sources))))
    return F.size(F.array_except(T.number_tokens(answer), allowed)) == 0


def reversed_verdict(category: Column, best_category: Column, best_score: Column, by_rule: Column, outside: str = "FUERA_DE_DOMINIO", least: float = 0.5) -> Column:
    """A model's verdict that a query is outside gives way to strong evidence; a rule's never does."""
    return F.when((category == outside) & ~by_rule & (best_score >= least), best_category).otherwise(category)


def ordered_flags(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that hold, in order; `ok` alone if none does."""
    found = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in checks)), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("ok"))).otherwise(found)


# fixed values: what a question must say, in normal form, to be one about days between dates, about topics, or about a consequence
GATES = (
    ("days", r"\b(cuantos|cuantas)\s+dias\b|\bdiferencia\b|\bfaltan\b|\btranscurren\b"),
    ("topics", r"\b(temas|tema|contenido|entra|entran)\b"),
    ("consequence", r"\b(que pasa|que ocurre|que sucede|que pasaria|consecuencia)\b"),
)


def gates(query: Column) -> Column:
    """The names of the gates that a question passes, in order; a question about a consequence isn't sent to the resolvers of articles."""
    n = T.norm(query)
    return F.filter(F.array(*(F.when(n.rlike(pattern), F.lit(name)) for name, pattern in GATES)), lambda x: x.isNotNull())


def fact_agrees(category: Column, query: Column, gold: Column, answer: Column) -> Column:
    """Whether an answer has the fact of the expected one: the date asked for (all dates if none is), else the last number of a table question, else the article's number of a regulation question."""
    want, got = T.dates(gold), T.dates(answer)
    n = T.norm(query)
    dated = F.when(n.contains("hasta"), F.array_contains(got, F.element_at(want, -1))).when(n.contains("desde"), F.array_contains(got, F.element_at(want, 1))).otherwise(F.size(F.array_except(want, got)) == 0)
    numbers, told = T.integers(gold), T.integers(answer)
    article = F.regexp_extract(T.fold(query), r"articulo\s+0*([0-9]+)", 1)
    named = (article != "") & (F.regexp_extract(T.fold(answer), r"articulo\s+0*([0-9]+)", 1) == article)
    fact = F.when(F.size(want) > 0, dated).when(category == "VACANTES", (F.size(numbers) > 0) & F.array_contains(told, F.element_at(numbers, -1))).when(category == "REGLAMENTO", named).otherwise(F.lit(False))
    return F.coalesce(fact, F.lit(False))


def agreement_status(category: Column, resolved: Column, source_matches: Column, agrees: Column, outside: str = "FUERA_DE_DOMINIO") -> Column:
    """The first that holds: outside the domain, nothing resolved, another source, another fact, agreement."""
    return F.when(category == outside, "not_applicable").when(~resolved, "not_resolved").when(~source_matches, "other_source").when(~agrees, "other_fact").otherwise("agrees")


def ink_ratio(pixels: Column, dark: int = 230) -> Column:
    """The share of a page's gray values (binary, a byte each) below dark; 0 for none. An Arrow-batched function, as no built-in counts bytes."""

    @F.pandas_udf("double")
    def share(column):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        return pd.Series([None if x is None else float(np.mean(np.frombuffer(x, dtype=np.uint8) < dark)) if len(x) else 0.0 for x in column], dtype="float64")

    return share(pixels)


def checked_label(label: Column, labels: Sequence[str]) -> Column:
    """A model's label without blanks and in capitals if it is a known one; null for any other, which is an error and never outside the domain."""
    bare = F.upper(F.trim(label))
    return F.when(bare.isin(*labels), bare)


def route(query: Column, model: Column, labels: Sequence[str]) -> Column:
    """struct of category, router and error: by the rules where they decide, else the model's checked label."""
    rule, known = rule_route(rule_text(query)), checked_label(model, labels)
    by = F.when(rule.isNotNull(), F.concat(F.lit("rule:"), rule)).when(known.isNotNull(), F.lit("model"))
    return F.struct(F.coalesce(rule, known).alias("category"), by.alias("router"), F.when(rule.isNull() & known.isNull(), F.concat(F.lit("invalid label "), F.coalesce(model, F.lit("null")))).alias("error"))

"""The staged question pipeline: each stage answers what it can, the rest goes on.

Stages are functions of the pending questions (key, query, ...) to answers (key,
answer, ...). Their order and settings are the configuration; rows are never
looked at by the driver. A stage's pending rows are written before the next one, so that an
expensive stage runs once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamizal.functions import predicates as P
from tamizal.session import materialize, sent


@dataclass(frozen=True)
class Stage:
    """phase: what its answers are marked with. answer: pending questions to key, answer and evidence (what the answer rests on, as text)."""

    phase: str
    answer: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Variant:
    """What a named pipeline takes part of: retrieval (dense, lexical, reranked; two rankings are fused), routing, answers from tables, context expansion, a cache."""

    name: str
    retrieval: Sequence[str] = ("dense",)
    router: bool = False
    structured: bool = False
    neighbours: bool = False
    cache: bool = False
    k: int = 5


# fixed values: the compositions that are compared
VARIANTS = {
    v.name: v
    for v in (
        Variant("V1"), Variant("V2", ("dense", "reranked"), True), Variant("V3", ("dense", "lexical"), True), Variant("V4", ("dense", "lexical", "reranked"), True, True, cache=True),
        Variant("V5", ("dense", "lexical")), Variant("V6", ("dense", "lexical", "reranked")), Variant("V4d", ("dense", "lexical", "reranked"), True, True, True),
        Variant("D", k=8), Variant("H", ("dense", "lexical"), k=8), Variant("F", ("dense", "lexical", "reranked"), k=8), Variant("G", ("dense", "lexical", "reranked"), True, True, cache=True, k=8),
    )
}


@dataclass(frozen=True)
class Sources:
    """What a pipeline draws on.

    search: (questions, retrieval, k) to key, segment and rank. texts: segment, text, source, page, seq. cells: as the table language takes
    them. cache: key, query, vector and answer of earlier questions. vector: a text column's embedding.
    """

    search: Callable[[DataFrame, Sequence[str], int], DataFrame]
    texts: DataFrame
    cells: DataFrame | None = None
    cache: DataFrame | None = None
    vector: Callable[[Column], Column] | None = None


def stages(variant: Variant, sources: Sources) -> list[Stage]:
    """The stages of a variant in order: cache, rules, tables, then retrieval with generation, which answers all that is left."""
    out = []
    if variant.cache and sources.cache is not None:
        out.append(from_cache(sources.cache, sources.vector))
    if variant.router:
        out.append(rule_exit())
    if variant.structured and sources.cells is not None:
        out.append(from_tables(sources.cells))
    return [*out, generation(variant, sources)]


def from_cache(cache: DataFrame, vector: Callable[[Column], Column]) -> Stage:
    """Answers of equal or verified similar earlier questions."""
    from tamizal.operators import cache as C

    def answer(q: DataFrame) -> DataFrame:
        # the keys of both sides are kept apart
        asked = q.select(F.concat(F.lit("?"), "key").alias("key"), "query", vector(F.col("query")).alias("vector"))
        hits = C.lookup(asked, cache.select(F.col("key").cast("string").alias("key"), "query", "vector"))
        return hits.join(cache.select(F.col("key").cast("string").alias("cached"), "answer"), "cached").select(F.substr("key", F.lit(2)).alias("key"), "answer", "how").withColumnRenamed("how", "evidence")

    return Stage("cache_hit", answer)


def from_tables(cells: DataFrame) -> Stage:
    """Answers that the tables give."""
    from tamizal.operators.table_language import table_answers

    return Stage("structured", lambda q: table_answers(q.select("key", "query"), cells, "key").select("key", "answer", F.col("kind").alias("evidence")))


def generation(variant: Variant, sources: Sources, write: Callable[[Column, Column], Column] | None = None) -> Stage:
    """Answers from fetched segments, with their neighbours on the page where the variant has them; the fixed reply where nothing is found. write: question and fragments to an answer, here in place of a model."""
    from tamizal.operators.retrieval import with_neighbours

    def answer(q: DataFrame) -> DataFrame:
        found = materialize(sources.search(q.select(F.col("key").alias("id"), "query"), variant.retrieval, variant.k).select(F.col("id").alias("key"), "segment", "rank"), "found")
        # only what is asked for moves, never all segments or their texts
        context = found.select("key", "segment", "rank", F.lit(0).alias("distance"), F.col("segment").alias("hit"))
        if variant.neighbours:
            places = sources.texts.select(F.col("segment").alias("hit"), "source", "page", "seq")
            hits = sent(places.join(sent(found.select(F.col("segment").alias("hit")).distinct(), "hits"), "hit").select("hit", "source", "page", "seq"), "places")
            near = with_neighbours(hits, sources.texts.select("segment", "source", "page", "seq")).select("hit", "segment", "distance").where("distance <> 0")
            more = found.withColumnRenamed("segment", "hit").join(near, "hit").select("key", "segment", "rank", "distance", "hit")
            context = context.unionByName(more.withColumn("distance", F.col("distance").cast("int")))
        context = materialize(context, "context")
        texts = sources.texts.select("segment", "text").join(sent(context.select("segment").distinct(), "segments_used"), "segment", "left_semi")
        parts = context.join(texts, "segment").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "distance", "segment", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("fragments"))
        used = found.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "segment"))), lambda x: x["segment"]), ",").alias("evidence"))
        both = q.select("key", "query").join(parts, "key", "left").join(used, "key", "left").withColumn("fragments", F.coalesce("fragments", F.array().cast("array<string>")))
        text = (write or extractive)(F.col("query"), F.col("fragments"))
        return both.select("key", F.coalesce(text, prompt(F.col("query"), F.array().cast("array<string>"))).alias("answer"), F.coalesce("evidence", F.lit("")).alias("evidence"))

    return Stage("generated", answer)


def run(questions: DataFrame, stages: Sequence[Stage], key: str = "key") -> DataFrame:
    """key, answer, evidence and phase: the answers of all stages; questions that no stage answers have phase unanswered and nulls. Each stage's time is kept with its phase in TIMES."""
    pending, out = questions, None
    for i, stage in enumerate(stages):
        began = time.perf_counter()
        got = stage.answer(pending)
        got = materialize(got.select(key, "answer", F.col("evidence") if "evidence" in got.columns else F.lit(None).cast("string").alias("evidence")), f"stage{i}")
        TIMES[stage.phase] = time.perf_counter() - began
        part = got.withColumn("phase", F.lit(stage.phase))
        out = part if out is None else out.unionByName(part)
        pending = pending.join(got.select(key), key, "left_anti")
    rest = pending.select(key, F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("evidence"), F.lit("unanswered").alias("phase"))
    return rest if out is None else out.unionByName(rest)


#: Seconds that each phase took when it last ran in this session.
TIMES: dict[str, float] = {}


def rule_exit(text: str = "La consulta está fuera del ámbito de admisión.") -> Stage:
    """Answers questions that a rule puts outside the domain."""
    return Stage("router_ood", lambda q: q.where(P.rule_route(P.rule_text(F.col("query"))) == "FUERA_DE_DOMINIO").select("key", F.lit(text).alias("answer"), F.lit("FUERA_DE_DOMINIO").alias("evidence")))


def prompt(query: Column, fragments: Column, none: str = "No encontré esa información en los documentos.") -> Column:
    """The text a generator gets: numbered fragments and the question; the fixed reply where there is no fragment."""
    numbered = F.array_join(F.transform(fragments, lambda f, i: F.concat(F.lit("["), i + 1, F.lit("] "), f)), "\n")
    return F.when(F.size(fragments) > 0, F.concat_ws("\n\n", numbered, F.concat(F.lit("Pregunta: "), query))).otherwise(F.lit(none))


def extractive(query: Column, fragments: Column) -> Column:
    """The default generator: the first fragment's first sentence that has a word of the question, else its first sentence."""
    from tamizal.functions import text as T

    sentences = F.split(F.element_at(fragments, 1), "(?<=[.!?])\\s+")
    asked = T.tokens(query)
    good = F.filter(sentences, lambda s: F.arrays_overlap(T.tokens(s), asked))
    return F.when(F.size(fragments) > 0, F.coalesce(F.get(good, 0), F.get(sentences, 0)))


def guarded(fact: Column, rephrased: Column, *sources: Column) -> Column:
    """A rephrased fact if it adds no number and isn't shorter, else the fact itself."""
    ok = P.supported_numbers(rephrased, fact, *sources) & (F.length(rephrased) >= F.length(fact))
    return F.when(F.coalesce(ok, F.lit(False)), rephrased).otherwise(fact)

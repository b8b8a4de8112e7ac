"""Queries of the cache, the staged pipeline, supervised routing and windowed events, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.functions import text as T
from tamizal.operators import cache as C
from tamizal.operators import evalstats as E
from tamizal.operators import ml as M
from tamizal.operators import pipeline as L
from tamizal.operators.retrieval import hashed_vector
from tamizal.plans import eval_queries as EQ
from tamizal.plans import retrieval_queries as RQ
from tamizal.plans import sql as S
from tamizal.plans import table_queries as TQ
from tamizal.plans.retrieval_queries import search_segments
from tamizal.plans.table_queries import _asked_cells
from tamizal.sources.tables import table, vacantes
from tamizal.streaming import latency as W


def _paraphrases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, folder, "queries").where("parafrasis is not null")
    v = lambda key, text: q.select(key.cast("bigint").alias("key"), F.col(text).alias("query"), hashed_vector(F.col(text)).alias("vector"), (-F.abs(key)).cast("bigint").alias("other"))
    return v(-F.col("id"), "query"), v(F.col("id"), "parafrasis")


def semantic_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache entry (a query) that answers each paraphrase of every fiftieth query."""
    cached, asked = _paraphrases(spark, folder)
    hits = C.lookup(asked.where("key % 50 = 0"), cached)
    return hits.select("key", (-F.col("cached")).alias("cached"), "cosine", "verified", "how")


def cache_train_test(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage and precision of the cache: originals stored, paraphrases of every fiftieth query asked."""
    cached, asked = _paraphrases(spark, folder)
    asked = asked.where("key % 50 = 0")
    return C.quality(C.lookup(asked, cached), asked.select("key", F.col("other").alias("original")))


def exact_cache(spark: SparkSession, folder: str) -> DataFrame:
    """For every query the lowest id with the same normalized text, where another has it."""
    q = table(spark, folder, "queries").where("query is not null").select("id", T.cache_norm(F.col("query")).alias("norm"))
    first = q.groupBy("norm").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return q.join(first, "norm").where("id <> first").select("id", "first")


def _pipeline(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """key, phase and evidence of each bank question in a variant of the pipeline."""
    q = table(spark, folder, "question_bank").where("query is not null").select(F.col("id").alias("key"), "query")
    v = vacantes(spark, folder, "seq", "source", "page", "text").withColumnRenamed("id", "segment")
    cached = table(spark, folder, "queries").where("query is not null and ground_truth is not null").select(F.col("id").alias("key"), "query", hashed_vector(F.col("query")).alias("vector"), F.col("ground_truth").alias("answer"))
    sources = L.Sources(lambda asked, how, k: search_segments(spark, folder, asked, how, k), v, _asked_cells(spark, folder), cached, hashed_vector)
    return L.run(q, L.stages(L.VARIANTS[name], sources))


def pipeline_v1(spark: SparkSession, folder: str) -> DataFrame:
    """Dense search and generation: the phase of each bank question and the segments its answer rests on."""
    return _pipeline(spark, folder, "V1").select("key", "phase", "evidence")


def pipeline_v5(spark: SparkSession, folder: str) -> DataFrame:
    """Fused search and generation."""
    return _pipeline(spark, folder, "V5").select("key", "phase", "evidence")


def pipeline_v4d(spark: SparkSession, folder: str) -> DataFrame:
    """Rules, tables, then hybrid search with reranking, neighbours and generation."""
    return _pipeline(spark, folder, "V4d").select("key", "phase", "evidence")


def pipeline_v4(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline with the cache before it: how many bank questions each phase answers, and how many answers are empty."""
    return _pipeline(spark, folder, "V4").groupBy("phase").agg(F.count("*").alias("questions"), F.sum((F.coalesce(F.trim("answer"), F.lit("")) == "").cast("int")).alias("empty"))


def router_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of a naive Bayes router by category, paraphrases kept in one fold."""
    q = table(spark, folder, "queries").where("categoria_correcta is not null and query is not null").select("id", "query", "categoria_correcta")
    f = M.folds(M.features(q, "query"), T.template_key(F.col("query")), 3)
    return E.precision_recall(M.cross_validated(f, "bayes", "categoria_correcta", 3), "categoria_correcta", "predicted")


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour and type."""
    w = W.windowed(table(spark, folder, "events").select("ts", "event_type", F.round("value", 4).cast("decimal(20,4)").alias("value")))
    return w.select(F.date_format("begins", "yyyy-MM-dd HH:mm").alias("begins"), "event_type", "n", F.col("total").cast("double").alias("total"), F.col("most").cast("double").alias("most"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user at a gap of 30 minutes: how many of each length."""
    return W.sessions(table(spark, folder, "events")).groupBy("n").agg(F.count("*").alias("sessions"))


QUERIES = {f.__name__: f for f in (semantic_cache, cache_train_test, exact_cache, pipeline_v1, pipeline_v5, pipeline_v4, pipeline_v4d, router_bayes, event_windows, event_sessions)}

_OVERLAP = "round(1 / (1 + exp(-(8 * CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0 END - 4))), 6)"
_ASK = "(SELECT id, parafrasis AS query FROM queries WHERE parafrasis IS NOT NULL AND id % 50 = 0)"
_CACHED = "(SELECT -id AS doc_id, query AS text FROM queries WHERE parafrasis IS NOT NULL)"
_NORM = "trim(regexp_replace(lower({}), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_HITS = f"""exact AS (SELECT a.id AS key, -min(c.doc_id) AS cached FROM {_ASK} a JOIN {_CACHED} c ON {_NORM.format('c.text')} = {_NORM.format('a.query')} GROUP BY a.id),
        rest AS (SELECT * FROM {_ASK} WHERE id NOT IN (SELECT key FROM exact)), {RQ._hashed_sql(3, _CACHED, 'rest')},
        pairs AS (SELECT d.id AS key, -d.doc_id AS cached, d.score AS cosine, r.query AS a, c.text AS b FROM dense d JOIN rest r ON r.id = d.id JOIN {_CACHED} c ON c.doc_id = d.doc_id WHERE d.score >= 0.8),
        same AS (SELECT *, {EQ._words('a')} AS x, {EQ._words('b')} AS y FROM pairs WHERE {S.number_tokens('a')} = {S.number_tokens('b')}),
        checked AS (SELECT key, cached, cosine, {_OVERLAP.format(a=f"list_distinct({S.tokens('a')})", b=f"list_distinct({S.tokens('b')})")} AS verified FROM same WHERE len(x) = 0 OR len(y) = 0 OR list_has_any(x, y)),
        hits AS (SELECT key, cached, 1.0::DOUBLE AS cosine, 1.0::DOUBLE AS verified, 'exact' AS how FROM exact
            UNION ALL SELECT key, cached, cosine, verified, 'similar' FROM checked WHERE verified >= 0.5 QUALIFY row_number() OVER (PARTITION BY key ORDER BY verified DESC, cosine DESC, -cached) = 1)"""
_BANK = "(SELECT id, query FROM question_bank WHERE query IS NOT NULL)"
_LIST = "string_agg(doc_id, ',' ORDER BY rank)"
_RULED = f"(SELECT id FROM (SELECT *, {EQ._RULE} AS rule FROM (SELECT id, {EQ._Q} AS q FROM question_bank)) WHERE rule = 'FUERA_DE_DOMINIO')"

ORACLES = {
    "semantic_cache": f"WITH {_HITS} SELECT key, cached, cosine, verified, how FROM hits",
    "cache_train_test": f"""WITH {_HITS}, t AS (SELECT a.id AS original, h.cached FROM {_ASK} a LEFT JOIN hits h ON h.key = a.id)
        SELECT count(*) AS queries, count(cached) AS hits, sum(coalesce(cached = original, false)::INT)::BIGINT AS "right", count(cached) - sum(coalesce(cached = original, false)::INT)::BIGINT AS wrong,
               round(count(cached) / count(*), 6) AS coverage, round(sum(coalesce(cached = original, false)::INT) / nullif(count(cached), 0), 6) AS precision FROM t""",
    "pipeline_v1": f"WITH {RQ._hashed_sql(10, RQ._SEGMENTS, _BANK)} SELECT id AS key, 'generated' AS phase, {_LIST} AS evidence FROM dense WHERE rank <= 5 GROUP BY id",
    "pipeline_v5": f"WITH {RQ._bm25(chr(39) * 2, chr(39) * 2, 10, '<> 0', RQ._SEGMENTS, _BANK)}, {RQ._hashed_sql(10, RQ._SEGMENTS, _BANK)}, {RQ._fused()} SELECT id AS key, 'generated' AS phase, {_LIST} AS evidence FROM fused WHERE rank <= 5 GROUP BY id",
    "pipeline_v4d": f"""WITH answered AS (SELECT split_part(key, '|', 2) AS id, kind FROM ({TQ.ORACLES['table_answers']}) WHERE starts_with(key, 'bank|')), ruled AS {_RULED},
        fetched AS (SELECT * FROM (WITH {RQ._bm25(chr(39) * 2, chr(39) * 2, 10, '<> 0', RQ._SEGMENTS, _BANK)}, {RQ._hashed_sql(10, RQ._SEGMENTS, _BANK)}, {RQ._fused()}, {RQ._reranked(5, RQ._SEGMENTS, _BANK)} SELECT id, {_LIST} AS evidence FROM reranked GROUP BY id))
        SELECT id AS key, 'router_ood' AS phase, 'FUERA_DE_DOMINIO' AS evidence FROM ruled UNION ALL SELECT id, 'structured', kind FROM answered WHERE id NOT IN (SELECT id FROM ruled)
        UNION ALL SELECT id, 'generated', evidence FROM fetched WHERE id NOT IN (SELECT id FROM ruled) AND id NOT IN (SELECT id FROM answered)""",
    "exact_cache": """WITH q AS (SELECT id, trim(regexp_replace(lower(query), '[\\s\\p{Z}]+', ' ', 'g')) AS norm FROM queries WHERE query IS NOT NULL)
        SELECT id, first FROM (SELECT id, min(id) OVER (PARTITION BY norm) AS first FROM q) WHERE id <> first""",
    "event_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS begins, event_type, count(*) AS n, sum(round(value, 4)::DECIMAL(20,4))::DOUBLE AS total, max(round(value, 4)::DECIMAL(20,4))::DOUBLE AS most FROM events GROUP BY ALL""",
    "event_sessions": """WITH e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true)::INT AS opens FROM events),
        s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e), c AS (SELECT count(*) AS n FROM s GROUP BY user_id, s)
        SELECT n, count(*) AS sessions FROM c GROUP BY n""",
}

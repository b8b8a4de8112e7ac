"""Answer cache: exact and similar hits, last-write-wins upsert, statistics, and the document states.

A batch reads the snapshot of the cache before it, never entries of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions import predicates as P
from tamizal.functions import text as T
from tamizal.operators.retrieval import dense_top_k, overlap_score, ranked


def upsert(cache: DataFrame, new: DataFrame, key: str = "query", at: str = "created_at") -> DataFrame:
    """cache and new together, for each normalized key the row written last; an entry written anew starts with no hits. Entries without answer or sources aren't written."""
    fresh = new.where(F.col("answer").isNotNull() & (F.size("sources") > 0)).withColumn("hits", F.lit(0).cast("bigint"))
    both = cache.select(*cache.columns, F.lit(0).alias("new_")).unionByName(fresh.select(*cache.columns, F.lit(1).alias("new_")))
    w = Window.partitionBy(T.cache_norm(F.col(key))).orderBy(F.desc(at), F.desc("new_"))
    return both.withColumn("place_", F.row_number().over(w)).where("place_ = 1").drop("place_", "new_")


def lookup(asked: DataFrame, cache: DataFrame, least_cosine: float = 0.8, least_verified: float = 0.5, shortlist: int = 3, check_anchors: bool = True, version: str | None = None) -> DataFrame:
    """key, cached, cosine, verified, how: the hit of each query (key, query, vector) in the cache (key, query, vector, ...).

    An equal normalized query is an exact hit; else the best verified of the
    shortlist of nearest entries above least_cosine, if it reaches least_verified.
    Keys of both sides must not meet. Entries of another version don't count.
    """
    c = cache if version is None else cache.where(F.col("version") == version)
    a = asked.select("key", "query", "vector", T.cache_norm(F.col("query")).alias("norm"))
    e = c.select(F.col("key").alias("cached"), F.col("query").alias("cached_query"), F.col("vector").alias("cached_vector"), T.cache_norm(F.col("query")).alias("norm"))
    exact = a.join(e, "norm").groupBy("key").agg(F.min("cached").alias("cached")).select("key", "cached", F.lit(1.0).alias("cosine"), F.lit(1.0).alias("verified"), F.lit("exact").alias("how"))
    rest = a.join(exact.select("key"), "key", "left_anti")
    near = dense_top_k(c.select("key", "vector"), rest.select("key", "vector"), shortlist, "key", "vector").where(F.col("score") >= least_cosine)
    pairs = near.select(F.col("query").alias("asked_key"), F.col("key").alias("cached"), F.col("score").alias("cosine"))
    pairs = pairs.join(a.select(F.col("key").alias("asked_key"), "query"), "asked_key").join(e.select("cached", "cached_query"), "cached")
    if check_anchors:
        pairs = pairs.where(P.same_anchors(F.col("query"), F.col("cached_query")))
    pairs = pairs.withColumn("verified", overlap_score(F.col("query"), F.col("cached_query"))).where(F.col("verified") >= least_verified)
    best = ranked(pairs, ["asked_key"], [F.desc("verified"), F.desc("cosine"), F.asc("cached")], 1)
    return exact.unionByName(best.select(F.col("asked_key").alias("key"), "cached", "cosine", "verified", F.lit("similar").alias("how")))


def quality(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Of queries with a known original (key, original): hit, right and wrong counts, coverage and precision."""
    t = truth.join(hits, "key", "left")
    right = F.sum(F.coalesce((F.col("cached") == F.col("original")).cast("int"), F.lit(0)))
    n, h = F.count("*"), F.count("cached")
    return t.agg(n.alias("queries"), h.alias("hits"), right.alias("right"), (h - right).alias("wrong"), F.round(h / n, 6).alias("coverage"), F.round(F.try_divide(right, h), 6).alias("precision"))


# fixed values: the states of a document and those that may follow
TRANSITIONS = (
    ("awaiting_ocr_consent", "processing_ocr"), ("processing_ocr", "ready"), ("processing_ocr", "error"), ("processing", "indexing"), ("indexing", "ready"), ("indexing", "error"), ("processing", "error"),
)


def invalid_transitions(history: DataFrame, key: str = "document_id", at: str = "at", status: str = "status") -> DataFrame:
    """Steps of documents' histories that no transition allows: key, at, before, status."""
    w = Window.partitionBy(key).orderBy(at)
    allowed = history.sparkSession.createDataFrame(list(TRANSITIONS), "before string, after string")
    steps = history.select(key, at, F.lag(status).over(w).alias("before"), F.col(status).alias("after")).where("before is not null and before <> after")
    return steps.join(F.broadcast(allowed), ["before", "after"], "left_anti").select(key, at, "before", F.col("after").alias(status))

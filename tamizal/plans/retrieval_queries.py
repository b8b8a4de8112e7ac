"""Queries of search and ranking, with the SQL that checks them. Searches take every row whose id is divisible by 50 as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamizal.functions import predicates as P
from tamizal.functions import text as T
from tamizal.operators import retrieval as R
from tamizal.plans import sql as S
from tamizal.session import materialize, standing
from tamizal.sources.tables import lines, once, spread, table, vacantes


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "queries").where("id % 50 = 0 and query is not null")


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, folder, "embeddings")
    return e, e.where("vec_id % 50 = 0")


def dense_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth."""
    return R.dense_top_k(*_vectors(spark, folder))


def dense_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of the same label."""
    return R.dense_top_k(*_vectors(spark, folder), k=5, part="label")


def lsh_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The same search through hashed buckets."""
    return R.lsh_top_k(*_vectors(spark, folder))


def _index(spark: SparkSession, folder: str, part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The lexical index of the documents, built once for the files as they are and read by every search."""
    d = table(spark, folder, "documents").select("doc_id", "text", *([part] if part else [])).where(f"{part} is not null" if part else "true")
    return standing(d, f"lexical-{part}", lambda df: R.lexical_index(spread(df), "doc_id", "text", part))


def bm25_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that match every fiftieth query best."""
    return R.bm25_top_k(_index(spark, folder), _asked(spark, folder))


def bm25_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """The same within documents of the query's category."""
    return R.bm25_top_k(_index(spark, folder, "category"), _asked(spark, folder).where("categoria_correcta is not null"), k=5, part="categoria_correcta", min_score=0.0)


def _hashed(spark: SparkSession, folder: str) -> DataFrame:
    key = lambda c: F.col(c).cast("bigint")
    (rows,) = standing(table(spark, folder, "documents").select("doc_id", "text"), "vectors", lambda df: (R.hashed_counts(spread(df), key("doc_id"), T.tokens(F.coalesce("text", F.lit("")))),))
    # queries and documents are two key spaces: a query's key is kept apart by its sign
    asked = _asked(spark, folder).select((-key("id")).alias("k"), R.hashed_vector(F.col("query")).alias("v"))
    found = R.dense_top_k(R.from_counts(rows), asked, k=10, key="k", vector="v")
    return found.select((-F.col("query")).cast("int").alias("id"), F.col("k").alias("doc_id"), "score", "rank")


def hashed_dense_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents nearest to every fiftieth query in the hashed embedding."""
    return _hashed(spark, folder)


def rrf_fuse20(spark: SparkSession, folder: str) -> DataFrame:
    """Both rankings fused by reciprocal rank."""
    return R.fuse(_hashed(spark, folder), bm25_top10(spark, folder), ["id", "doc_id"])


def rerank_overlap5(spark: SparkSession, folder: str) -> DataFrame:
    """The five best of the fused candidates under the pair score."""
    fused = rrf_fuse20(spark, folder).select("id", "doc_id", F.col("rank").alias("fused_rank"))
    return R.rerank_texts(fused, _asked(spark, folder), table(spark, folder, "documents"), "id", "doc_id").select("id", "doc_id", "fused_rank", "rerank", "rank")


def global_merge6(spark: SparkSession, folder: str) -> DataFrame:
    """Three best of each label, then the six best of these."""
    rows, asked = _vectors(spark, folder)
    near = R.dense_top_k(rows, asked, k=3, part="label", every=True).select("query", "vec_id", "score").join(rows.select("vec_id", "label"), "vec_id")
    return R.merge_parts(near, "query", "label", "vec_id", "score").select("query", "vec_id", "label", "score", "part_rank", "rank")


def anchor_check(spark: SparkSession, folder: str) -> DataFrame:
    """By system, the logged contexts that hold the query's distinctive terms."""
    r = table(spark, folder, "runs").where("query is not null").select("system", "query", F.array_join("contexts", " ").alias("context"))
    r = r.groupBy("system", "query", "context").agg(F.count("*").alias("n")).select("system", "n", P.distinctive_terms(F.col("query")).alias("terms"), P.folded_tokens(F.col("context")).alias("found"))
    return r.groupBy("system").agg(F.sum("n").alias("runs"), F.sum(F.col("n") * P.anchored(F.col("terms"), F.col("found")).cast("int")).alias("anchored"))


def global_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of the query's category, completed by hits of all documents where they lack the query's terms."""
    asked = _asked(spark, folder).where("categoria_correcta is not null")
    texts = table(spark, folder, "documents").select("doc_id", "text")
    primary = bm25_partitioned(spark, folder).select("id", "doc_id", "score", "rank")
    context = primary.join(texts, "doc_id").groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("context"))  # five texts a query
    both = asked.select("id", "query").join(context, "id", "left").select("id", "context", P.distinctive_terms(F.col("query")).alias("terms"), P.folded_tokens(F.col("context")).alias("found"))
    weak = both.where(F.col("context").isNull() | ~P.anchored(F.col("terms"), F.col("found"))).select("id")
    backup = bm25_top10(spark, folder).where("rank <= 2").select("id", "doc_id", "score", "rank")
    return R.resolve_with_fallback(primary, backup, weak, "id", ["doc_id"]).select("id", "doc_id", "score", "scope")


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Prose segments that open an article, with the segments before and after them on the page."""
    v = vacantes(spark, folder, "seq", "source", "page", "text")
    hits = v.where(T.is_article_heading(F.split("text", "\n")[0])).select(F.col("id").alias("hit"), "source", "page", "seq")
    return R.with_neighbours(hits, v.select("id", "source", "page", "seq")).select("hit", "id", F.col("distance").cast("int").alias("distance"))


def next_page_continuation(spark: SparkSession, folder: str) -> DataFrame:
    """For each segment that breaks off, the segment that goes on at the top of the next page."""
    v = vacantes(spark, folder, "seq", "source", "page", "text").where("source is not null and page is not null")
    open_end = v.where(F.length("text") > 0).where(~F.rtrim(F.regexp_replace("text", "[\\r\\n]+$", "")).rlike("[.!?;:]\\s*[\"'»)]*$")).select(F.col("id").alias("hit"), "source", "page")
    return R.continuations(open_end, v)


def article_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """For each article number a bank query names, the first line that is this article's heading."""
    asked = table(spark, folder, "question_bank").select("id", F.regexp_extract(T.fold(F.col("query")), r"\b(?:articulo|art\.?)\s+([0-9]+)\b", 1).alias("number")).where("number <> ''").select("id", F.col("number").cast("int").alias("article"))
    head = lines(vacantes(spark, folder, "seq", "text"), "id", "seq").where(T.is_article_heading(F.col("line"))).select(F.regexp_extract("line", T.ARTICLE_START, 1).cast("int").alias("article"), "seq", F.col("id").alias("segment"), "line_no")
    first = head.groupBy("article").agg(F.min(F.struct("seq", "segment", "line_no")).alias("at"))
    return asked.join(first, "article").select("id", "article", F.col("at.segment").alias("segment"), F.col("at.line_no").alias("line_no"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return vacantes(spark, folder, "seq", "source", "page", "extraction", "workspace_id", "text")


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    """id of the bank questions that name an article with a heading, and the first segment that has it."""
    found = article_anchor(spark, folder).select("id", F.col("segment").alias("hit"))
    return found.join(_segments(spark, folder).select(F.col("id").alias("hit"), "source", "page"), "hit")


def same_page_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Table rows on the pages of the articles that bank questions name."""
    return R.same_page_tables(_anchors(spark, folder).select("hit", "source", "page").distinct(), _segments(spark, folder))


def search_segments(spark: SparkSession, folder: str, questions: DataFrame, retrieval: tuple[str, ...] = ("dense", "lexical", "reranked"), k: int = 5) -> DataFrame:
    """id, segment and rank: the k best segments for each question (id, query) by one ranking or two fused ones, reranked under the pair score if asked for."""
    source = table(spark, folder, "vacantes").select("id", "text")
    index = lambda: standing(source, "segments", lambda df: R.lexical_index(spread(once(df, "id")), "id", "text"))
    found = []
    if "dense" in retrieval:
        said = lambda df: index()[0] if "lexical" in retrieval else spread(once(df, "id")).select("id", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
        (rows,) = standing(source, "segment_vectors", lambda df: (R.hashed_counts(said(df), F.col("id"), F.col("tokens")),))
        asked = questions.select(F.concat(F.lit("?"), "id").alias("k"), R.hashed_vector(F.col("query")).alias("v"))
        dense = R.dense_top_k(R.from_counts(rows), asked, k=10, key="k", vector="v")
        found.append(dense.select(F.substr("query", F.lit(2)).alias("id"), F.col("k").alias("segment"), "rank"))
    if "lexical" in retrieval:
        lexical = R.bm25_top_k(index(), questions.withColumnRenamed("id", "question"), key="id", query_key="question")
        found.append(lexical.select(F.col("question").alias("id"), F.col("id").alias("segment"), "rank"))
    best = found[0] if len(found) == 1 else R.fuse(*found, ["id", "segment"]).select("id", "segment", "rank")
    if "reranked" in retrieval:
        texts = vacantes(spark, folder, "text").withColumnRenamed("id", "segment")
        best = R.rerank_texts(best.select("id", "segment"), questions, texts, "id", "segment", k).select("id", "segment", "rank")
    return best.where(F.col("rank") <= k)


def retrieve_segments(spark: SparkSession, folder: str) -> DataFrame:
    """What is fetched for each bank question: the article it names with its page and continuation, or the five best segments of the hybrid search."""
    bank = table(spark, folder, "question_bank").where("query is not null").select("id", "query")
    anchors = materialize(_anchors(spark, folder), "anchors")
    return R.retrieve(bank, anchors, _segments(spark, folder), lambda q: search_segments(spark, folder, q))


def workspace_retrieve(spark: SparkSession, folder: str) -> DataFrame:
    """The eight best segments of each workspace for every fiftieth query: twenty by vectors and twenty by words within the workspace, forty fused, reranked."""
    source = table(spark, folder, "vacantes").where("workspace_id is not null").select("id", "workspace_id", "text")
    # workspaces and segments go by numbers; only the workspaces' names are put in order in one task
    order = Window.orderBy("workspace_id")
    (spaces,) = standing(source, "workspace_numbers", lambda df: (df.select("workspace_id").distinct().withColumn("part", F.row_number().over(order).cast("bigint")),))
    few = F.broadcast(spaces) if spaces.count() <= R.BROADCAST_KEYS else spaces

    def numbered(df: DataFrame) -> tuple[DataFrame]:
        """A workspace's segments stand together, so that few tasks have hits of it, and their numbers are in the order of their keys."""
        rows = once(df, "id", "workspaces").join(few, "workspace_id").repartitionByRange("part", "id").sortWithinPartitions("part", "id")
        tokens = T.tokens(F.coalesce("text", F.lit("")))
        return (rows.select(F.when(F.col("id").isNotNull(), F.monotonically_increasing_id()).alias("no"), "id", "part", tokens.alias("tokens")).withColumn("length", F.size("tokens")),)

    (rows,) = standing(source, "workspace_texts", numbered)
    (terms,) = standing(source, "workspace_terms", lambda _: (R.lexical_terms(rows),))
    (counts,) = standing(source, "workspace_vectors", lambda _: (R.hashed_counts(rows, F.col("no"), F.col("tokens"), "part"),))
    asked = _asked(spark, folder).select("id", F.col("query"))
    # a query's number is kept apart from the segments' by its sign; a pair is both numbers in one
    apart, place = F.lit(1 << 40), F.lit(1 << 32)
    vectors = asked.select((F.col("id") - apart).alias("k"), R.hashed_vector(F.col("query")).alias("v"))
    dense = R.dense_top_k(R.from_counts(counts), vectors, k=20, key="k", vector="v", part="part", every=True).select((F.col("query") + apart).alias("id"), F.col("k").alias("no"), "rank")
    pair = (F.col("part") * place + F.col("id")).alias("pair")
    dense = dense.join(rows.select("no", "part"), "no").select(pair, "no", "rank")
    each = asked.crossJoin(spaces.select("part")).select(pair, "part", "query")  # the stated queries in every workspace
    lexical = R.bm25_top_k((rows, terms), each, k=20, key="no", query_key="pair", part="part", min_score=0.0).select("pair", "no", "rank")
    part = F.shiftright(F.col("pair") + F.lit(1 << 31), 32)
    fused = R.fuse(dense, lexical, ["pair", "no"], k=40).select("pair", "no", (F.col("pair") - part * place).cast("int").alias("id"))
    best = R.rerank_tokens(fused, asked, rows, "pair", "no", "id", 8).select("no", "rank", part.cast("bigint").alias("part"), (F.col("pair") - part * place).cast("int").alias("id"))
    return best.join(rows.select("no", F.col("id").alias("segment")), "no").join(few, "part").select("id", "workspace_id", "segment", "rank")


def lsh_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Of the ten nearest vectors of every fiftieth, the share that the hashed index finds, and whether it is at least 0.9."""
    exact, found = dense_top10(spark, folder).select("query", "vec_id"), lsh_top10(spark, folder).select("query", "vec_id")
    hits = exact.join(found.withColumn("hit", F.lit(1)), ["query", "vec_id"], "left")
    return hits.agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


QUERIES = {
    f.__name__: f
    for f in (
        dense_top10, dense_partitioned, lsh_top10, lsh_recall, bm25_top10, bm25_partitioned, hashed_dense_top10, rrf_fuse20, rerank_overlap5, global_merge6, anchor_check, global_fallback, neighbours,
        next_page_continuation, article_anchor, same_page_rows, retrieve_segments, workspace_retrieve,
    )
}

_DOT = "round(list_dot_product(list_transform({a}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE)), 6)"
_SCORED = f"""SELECT q.vec_id AS query, e.vec_id, {_DOT.format(a='q.embedding', b='e.embedding')} AS score, e.label, q.label AS query_label
        FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE e.vec_id <> q.vec_id"""
_ASKED = "(SELECT * FROM queries WHERE id % 50 = 0 AND query IS NOT NULL)"


_DOCUMENTS, _SEGMENTS = "documents", "(SELECT DISTINCT id AS doc_id, workspace_id, text FROM vacantes)"


def _bm25(part: str, query_part: str, k: int, zero: str, rows: str = _DOCUMENTS, asked: str = _ASKED, key: str = "id") -> str:
    """CTEs up to best: the k best texts of rows (doc_id, text) for each asked query."""
    where = "" if part == "''" else f"WHERE {part} IS NOT NULL"
    return f"""
        docs AS (SELECT doc_id, {part} AS part, {S.tokens("coalesce(text, '')")} AS ts FROM {rows} {where}),
        idx AS (SELECT part, term, doc_id, count(*) AS tf FROM (SELECT part, doc_id, unnest(ts) AS term FROM docs) GROUP BY ALL),
        lens AS (SELECT part, doc_id, len(ts) AS length FROM docs),
        stats AS (SELECT part, count(*) AS texts, avg(length) AS mean_length FROM lens GROUP BY part),
        raw AS (SELECT i.part, term, ln((texts - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(mean_length) AS mean_length FROM idx i JOIN stats s ON s.part = i.part GROUP BY i.part, term, texts),
        weight AS (SELECT part, term, mean_length, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY part) ELSE idf END AS idf FROM raw),
        ask AS (SELECT {key} AS id, {query_part} AS part, unnest({S.tokens('query')}) AS term FROM {asked}),
        hits AS (SELECT a.id, i.doc_id, round(sum(w.idf * i.tf * 2.5 / (i.tf + 1.5 * (0.25 + 0.75 * l.length / w.mean_length))), 6) AS score
                 FROM ask a JOIN idx i ON i.part = a.part AND i.term = a.term JOIN weight w ON w.part = i.part AND w.term = i.term JOIN lens l ON l.part = i.part AND l.doc_id = i.doc_id GROUP BY a.id, i.doc_id),
        best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM hits WHERE score {zero} QUALIFY rank <= {k})"""


_IN_CATEGORY = f"(SELECT * FROM {_ASKED} WHERE categoria_correcta IS NOT NULL)"


def _vector(key: str, rows: str, text: str) -> str:
    return f"SELECT {key}, b, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM (SELECT {key}, ('0x' || md5(t)[1:6])::INT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({S.tokens(text)}) AS t FROM {rows}) GROUP BY ALL)"


def _hashed_sql(k: int = 10, rows: str = _DOCUMENTS, asked: str = _ASKED, by: str = "id", key: str = "id", same: str = "true") -> str:
    """CTEs up to dense: the k nearest texts of rows for each asked query, in the hashed embedding."""
    return f"""
        dv AS ({_vector('doc_id', rows, "coalesce(text, '')")}), qv AS ({_vector('qid', f"(SELECT DISTINCT {by} AS qid, query FROM {asked})", 'query')}),
        dots AS (SELECT qid, doc_id, sum(q.w * d.w) AS s FROM qv q JOIN dv d ON d.b = q.b GROUP BY ALL),
        near AS (SELECT q.id, d.doc_id, coalesce(round(s, 6), 0) AS score FROM (SELECT {key} AS id, {by} AS qid, * EXCLUDE (id) FROM {asked}) q JOIN {rows} d ON {same} LEFT JOIN dots ON dots.qid = q.qid AND dots.doc_id = d.doc_id),
        dense AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= {k})"""


_HASHED = _hashed_sql()


def _fused(k: int = 20) -> str:
    return f"""
        both_ AS (SELECT id, doc_id, max(a) AS first_rank, max(b) AS second_rank FROM (SELECT id, doc_id, rank AS a, NULL AS b FROM dense UNION ALL SELECT id, doc_id, NULL, rank FROM best) GROUP BY ALL),
        fused AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first_rank NULLS LAST, second_rank NULLS LAST, doc_id) AS rank
                  FROM (SELECT *, round(coalesce(1 / (60 + first_rank), 0) + coalesce(1 / (60 + second_rank), 0), 9) AS score FROM both_) QUALIFY rank <= {k})"""


_FUSED = _fused()


def _reranked(k: int, rows: str, asked: str, key: str = "id") -> str:
    """CTEs up to reranked: the k best of fused under the pair score."""
    return f"""
        pairs AS (SELECT f.id, f.doc_id, f.rank AS fused_rank, list_distinct({S.tokens('q.query')}) AS a, list_distinct({S.tokens("coalesce(d.text, '')")}) AS b FROM fused f JOIN (SELECT {key} AS qk, query FROM {asked}) q ON q.qk = f.id JOIN {rows} d ON d.doc_id = f.doc_id),
        reranked AS (SELECT id, doc_id, fused_rank, rerank, row_number() OVER (PARTITION BY id ORDER BY rerank DESC, doc_id) AS rank
        FROM (SELECT *, round(1 / (1 + exp(-(8 * CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END - 4))), 6) AS rerank FROM pairs) QUALIFY rank <= {k})"""


_ANCHOR = f"""asked_ AS (SELECT id, regexp_extract({S.fold('query')}, '\\b(?:articulo|art\\.?)\\s+([0-9]+)\\b', 1) AS number FROM question_bank),
        head AS (SELECT id AS segment, seq, line_no, regexp_extract(line, '^\\s*(?i:Art[íiÍ]culo)\\s+([0-9]+)\\s*[°º]?\\s*[.:–—]?\\s*\\p{{Lu}}', 1) AS number FROM {S.lines('(SELECT DISTINCT id, seq, text FROM vacantes)', 'id, seq')}),
        anchor AS (SELECT a.id, h.segment AS hit, v.source, v.page, v.seq FROM asked_ a JOIN head h ON h.number <> '' AND a.number <> '' AND h.number::INT = a.number::INT
                   JOIN (SELECT DISTINCT id, source, page, seq FROM vacantes) v ON v.id = h.segment QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY h.seq, h.segment, h.line_no) = 1),
        segs AS (SELECT DISTINCT id, seq, source, page, extraction, text FROM vacantes),
        same AS (SELECT DISTINCT a.hit, s.id, s.seq FROM anchor a JOIN segs s ON s.source = a.source AND s.page = a.page WHERE s.extraction IN ('textract_table_row', 'native_table_row', 'table_row') AND s.id <> a.hit)"""
_GENERIC = ", ".join(f"'{g}'" for g in P.GENERIC_TERMS)


ORACLES = {
    "dense_top10": f"SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM ({_SCORED}) QUALIFY rank <= 10",
    "dense_partitioned": f"SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM ({_SCORED}) WHERE label = query_label QUALIFY rank <= 5",
    "bm25_top10": f"WITH {_bm25(chr(39) * 2, chr(39) * 2, 10, '<> 0')} SELECT id, doc_id, score, rank FROM best",
    "bm25_partitioned": f"WITH {_bm25('category', 'categoria_correcta', 5, '> 0', asked=_IN_CATEGORY)} SELECT id, doc_id, score, rank FROM best",
    "hashed_dense_top10": f"WITH {_HASHED} SELECT id, doc_id, score, rank FROM dense",
    "rrf_fuse20": f"WITH {_bm25(chr(39) * 2, chr(39) * 2, 10, '<> 0')}, {_HASHED}, {_FUSED} SELECT id, doc_id, first_rank, second_rank, score, rank FROM fused",
    "rerank_overlap5": f"WITH {_bm25(chr(39) * 2, chr(39) * 2, 10, '<> 0')}, {_HASHED}, {_FUSED}, {_reranked(5, _DOCUMENTS, _ASKED)} SELECT id, doc_id, fused_rank, rerank, rank FROM reranked",
    "global_fallback": f"""WITH primary_ AS (SELECT * FROM (WITH {_bm25('category', 'categoria_correcta', 5, '> 0', asked=_IN_CATEGORY)} SELECT id, doc_id, score, rank FROM best)),
        backup AS (SELECT * FROM (WITH {_bm25(chr(39) * 2, chr(39) * 2, 10, '<> 0')} SELECT id, doc_id, score, rank FROM best) WHERE rank <= 2),
        terms AS (SELECT DISTINCT id, {S.fold('t')} AS t FROM (SELECT id, unnest({S.tokens('query')}) AS t FROM {_IN_CATEGORY}) WHERE length({S.fold('t')}) >= 4 AND {S.fold('t')} NOT IN ({_GENERIC})),
        seen AS (SELECT DISTINCT id, {S.fold('t')} AS t FROM (SELECT p.id, unnest({S.tokens("coalesce(d.text, '')")}) AS t FROM primary_ p JOIN documents d ON d.doc_id = p.doc_id)),
        need AS (SELECT q.id, count(t.t) AS size, count(s.t) AS hits FROM {_IN_CATEGORY} q LEFT JOIN terms t ON t.id = q.id LEFT JOIN seen s ON s.id = t.id AND s.t = t.t GROUP BY q.id),
        weak AS (SELECT id FROM need WHERE id NOT IN (SELECT p.id FROM primary_ p JOIN documents d ON d.doc_id = p.doc_id WHERE d.text IS NOT NULL) OR NOT (size = 0 OR hits >= greatest(1, least(2, ceil(size * 0.35))))),
        both_ AS (SELECT id, doc_id, score, rank, 'routed' AS scope, 0 AS turn FROM primary_ UNION ALL SELECT id, doc_id, score, rank, 'global_fallback', 1 FROM backup WHERE id IN (SELECT id FROM weak))
        SELECT id, doc_id, score, scope FROM both_ QUALIFY row_number() OVER (PARTITION BY id, doc_id ORDER BY turn, rank) = 1""",
    "lsh_recall": "SELECT sum(least(10, (SELECT count(*) FROM embeddings) - 1))::BIGINT AS wanted, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "same_page_rows": f"WITH {_ANCHOR} SELECT hit, id, seq FROM same",
    "retrieve_segments": f"""WITH {_ANCHOR},
        going AS (SELECT a.hit, s.id, s.seq FROM (SELECT DISTINCT hit, source, page FROM anchor) a JOIN segs s ON s.source = a.source AND s.page = a.page + 1
            WHERE length(s.text) > 180 AND NOT regexp_matches(s.text, '^\\s*(?i:Art[íiÍ]culo)\\s+[0-9]+\\s*[°º]?\\s*[.:–—]?\\s*\\p{{Lu}}') QUALIFY row_number() OVER (PARTITION BY a.hit ORDER BY s.seq, s.id) = 1),
        article AS (SELECT id, hit AS segment, 0 AS turn, seq, 'article' AS how FROM anchor UNION ALL SELECT a.id, s.id, 1, s.seq, 'same_page' FROM anchor a JOIN same s USING (hit) UNION ALL SELECT a.id, g.id, 2, g.seq, 'continuation' FROM anchor a JOIN going g USING (hit)),
        open_ AS (SELECT id, query FROM question_bank WHERE query IS NOT NULL AND id NOT IN (SELECT id FROM anchor)),
        {_bm25(chr(39) * 2, chr(39) * 2, 10, '<> 0', _SEGMENTS, 'open_')}, {_hashed_sql(10, _SEGMENTS, 'open_')}, {_fused()}, {_reranked(5, _SEGMENTS, 'open_')}
        SELECT id, segment, row_number() OVER (PARTITION BY id ORDER BY turn, seq, segment) AS place, how FROM article UNION ALL SELECT id, doc_id, rank, 'hybrid' FROM reranked""",
    "workspace_retrieve": f"""WITH each_ AS (SELECT q.id, q.query, w.workspace_id, q.id || '|' || w.workspace_id AS pair FROM {_ASKED} q, (SELECT DISTINCT workspace_id FROM vacantes WHERE workspace_id IS NOT NULL) w),
        {_bm25('workspace_id', 'workspace_id', 20, '> 0', _SEGMENTS, 'each_', 'pair')}, {_hashed_sql(20, _SEGMENTS, 'each_', 'id', 'pair', 'd.workspace_id = q.workspace_id')}, {_fused(40)}, {_reranked(8, _SEGMENTS, 'each_', 'pair')}
        SELECT split_part(id, '|', 1)::INT AS id, split_part(id, '|', 2) AS workspace_id, doc_id AS segment, rank FROM reranked""",
    "global_merge6": f"""WITH parts AS (SELECT query, vec_id, label, score, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id) AS part_rank FROM ({_SCORED}) QUALIFY part_rank <= 3)
        SELECT query, vec_id, label, score, part_rank, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM parts QUALIFY rank <= 6""",
    "anchor_check": f"""
        WITH r AS (SELECT row_number() OVER () AS k, * FROM (SELECT system, query, array_to_string(contexts, ' ') AS context, count(*) AS n FROM runs WHERE query IS NOT NULL GROUP BY ALL)),
        asked AS (SELECT DISTINCT query, {S.fold('t')} AS t FROM (SELECT DISTINCT query, unnest({S.tokens('query')}) AS t FROM r)),
        terms AS (SELECT query, t FROM asked WHERE length(t) >= 4 AND t NOT IN ({_GENERIC})),
        sized AS (SELECT query, count(*) AS size FROM terms GROUP BY query),
        found AS (SELECT DISTINCT context, {S.fold('t')} AS t FROM (SELECT DISTINCT context, unnest({S.tokens("coalesce(context, '')")}) AS t FROM r)),
        hits AS (SELECT r.k, count(*) AS hits FROM r JOIN terms ON terms.query = r.query JOIN found ON found.context = r.context AND found.t = terms.t GROUP BY r.k)
        SELECT system, sum(n) AS runs, sum(n * (size IS NULL OR coalesce(hits, 0) >= greatest(1, least(2, ceil(size * 0.35))))::INT) AS anchored
        FROM r LEFT JOIN sized s ON s.query = r.query LEFT JOIN hits h ON h.k = r.k GROUP BY system""",
    "neighbours": f"""WITH v AS (SELECT DISTINCT id, seq, source, page, text FROM vacantes)
        SELECT h.id AS hit, r.id, (r.seq - h.seq)::INT AS distance FROM v h JOIN v r ON r.source = h.source AND r.page = h.page AND abs(r.seq - h.seq) <= 1
        WHERE regexp_matches(split_part(h.text, chr(10), 1), '^\\s*(?i:Art[íiÍ]culo)\\s+[0-9]+\\s*[°º]?\\s*[.:–—]?\\s*\\p{{Lu}}')""",
    "next_page_continuation": """WITH v AS (SELECT DISTINCT id, seq, source, page, text FROM vacantes WHERE source IS NOT NULL AND page IS NOT NULL),
        ok AS (SELECT * FROM v WHERE length(text) > 180 AND NOT regexp_matches(text, '^\\s*(?i:Art[íiÍ]culo)\\s+[0-9]+\\s*[°º]?\\s*[.:–—]?\\s*\\p{Lu}')),
        first AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY source, page ORDER BY seq, id) = 1)
        SELECT a.id AS hit, f.id, f.seq FROM v a JOIN first f ON f.source = a.source AND f.page = a.page + 1
        WHERE length(a.text) > 0 AND NOT regexp_matches(rtrim(regexp_replace(a.text, '[\\r\\n]+$', '')), '[.!?;:]\\s*["''»)]*$')""",
    "article_anchor": f"""WITH asked AS (SELECT id, regexp_extract({S.fold('query')}, '\\b(?:articulo|art\\.?)\\s+([0-9]+)\\b', 1) AS number FROM question_bank),
        head AS (SELECT id AS segment, seq, line_no, regexp_extract(line, '^\\s*(?i:Art[íiÍ]culo)\\s+([0-9]+)\\s*[°º]?\\s*[.:–—]?\\s*\\p{{Lu}}', 1) AS number FROM {S.lines('(SELECT DISTINCT id, seq, text FROM vacantes)', 'id, seq')})
        SELECT a.id, a.number::INT AS article, h.segment, h.line_no::INT AS line_no FROM asked a JOIN head h ON h.number <> '' AND a.number <> '' AND h.number::INT = a.number::INT
        QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY h.seq, h.segment, h.line_no) = 1""",
}

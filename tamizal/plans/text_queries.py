"""Queries of the text functions, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.functions import text as T
from tamizal.plans import sql as S
from tamizal.sources.tables import lines, spread, table, vacantes


def text_norms(spark: SparkSession, folder: str) -> DataFrame:
    """The normal forms of every query."""
    q = F.col("query")
    return table(spark, folder, "queries").select(
        "id", T.norm(q).alias("norm"), T.cache_norm(q).alias("cache_norm"), T.fold(q).alias("folded"), T.clean(q).alias("clean"), T.template_key(q).alias("template")
    )


def token_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """How often each index token stands in the documents, and in how many."""
    t = spread(table(spark, folder, "documents").select("doc_id", "text").where("text is not null")).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token", "doc_id").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("uses"), F.count("*").alias("documents"))


def stem_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The six-letter stems of each bank question."""
    return table(spark, folder, "question_bank").select("id", F.array_join(T.stems(F.col("query")), " ").alias("stems"))


def row_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Every labelled value of the serialized table rows of vacantes, with group, item and number."""
    rows = lines(vacantes(spark, folder), "id").where(F.col("line").rlike(r"^(Tabla [0-9]+ — fila [0-9]+:|[A-Z]+ \| )"))
    f = rows.select("id", "line_no", F.posexplode(T.fields(F.col("line"))).alias("place", "f"))
    return f.select("id", "line_no", "place", F.col("f.label").alias("label"), F.col("f.value").alias("value"), T.group_of(F.col("f.label")).alias("grp"), T.item_of(F.col("f.label")).alias("item"), T.number(F.col("f.value")).alias("number"))


def answer_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The numbers of each bank answer: with separators, standalone, and all integers in order."""
    g = F.col("gold")
    return table(spark, folder, "question_bank").where("gold is not null").select(
        "id", F.array_join(T.number_tokens(g), " ").alias("numbers"), F.array_join(T.standalone_integers(g), " ").alias("standalone"), F.array_join(T.integers(g), " ").alias("integers"), F.array_join(T.dates(g), " ").alias("dates")
    )


def quoted_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The first quoted topic of each document that has one."""
    return table(spark, folder, "documents").select("doc_id", T.quoted_topic(F.col("text")).alias("topic")).where("topic is not null")


def query_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """By system, how far the logged queries are from the bank's: edit distance over length, and the exact share."""
    bank = table(spark, folder, "question_bank").select("id", T.norm(F.col("query")).alias("asked"))
    r = table(spark, folder, "runs").where("query is not null").groupBy("id", "system", "query").agg(F.count("*").alias("n")).join(bank, "id")
    got = T.norm(F.col("query"))
    r = r.select("system", "n", F.levenshtein("asked", got).alias("d"), F.length("asked").alias("size"))
    n = F.col("n")
    return r.groupBy("system").agg(F.sum(n).alias("runs"), F.round(F.sum(n * F.col("d")) / F.sum(n * F.col("size")), 6).alias("error_rate"), F.round(F.sum(n * (F.col("d") == 0).cast("int")) / F.sum(n), 6).alias("exact"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of every document's text."""
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def acceptable_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents would do as a passage, by language."""
    ok = T.acceptable(F.col("text"))
    return table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(ok.cast("int")).alias("acceptable"))


def date_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Days between the two dates of every bank answer that has exactly two."""
    d = T.dates(F.col("gold"))
    return table(spark, folder, "question_bank").where(F.size(d) == 2).select("id", T.days_between(d[0], d[1]).alias("days"))


def article_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of vacantes that open with an article's heading, its number, and whether the line ends complete."""
    l = lines(vacantes(spark, folder), "id")  # noqa: E741
    text = F.rtrim(F.regexp_replace("line", "\\r$", ""))
    return l.where(T.is_article_heading(F.col("line"))).select("id", "line_no", F.regexp_extract("line", T.ARTICLE_START, 1).cast("int").alias("article"), text.rlike("[.!?][\"'»)]*$").alias("complete"))


def article_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The body of each article that opens a line of vacantes: cut at the next heading, debris off."""
    l = lines(vacantes(spark, folder), "id")  # noqa: E741
    return l.where(T.is_article_heading(F.col("line"))).select("id", "line_no", T.article_body(F.col("line")).alias("body"))


def phase_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Normalized queries that name a phase, with the phase as a numeral."""
    n = T.norm(F.col("query"))
    return table(spark, folder, "queries").where(n.rlike(r"\bfase\b")).select("id", T.phase_rewrite(n).alias("rewritten"))


def paraphrase_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of each query and its paraphrase: matching-blocks ratio and edit ratio."""
    q = table(spark, folder, "queries").where("parafrasis is not null").select("id", *(F.regexp_replace(T.norm(F.col(c)), "[^a-z0-9 ]", "").alias(x) for c, x in (("query", "a"), ("parafrasis", "b"))))
    edit = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"), F.lit(1))
    return q.select("id", F.round(T.sequence_ratio(F.col("a"), F.col("b")), 6).alias("block_ratio"), F.round(edit, 6).alias("edit_ratio"))


def paraphrase_edit(spark: SparkSession, folder: str) -> DataFrame:
    """The edit ratio of each query and its paraphrase."""
    return paraphrase_ratio(spark, folder).select("id", "edit_ratio")


QUERIES = {f.__name__: f for f in (text_norms, token_frequency, stem_sets, row_fields, answer_numbers, quoted_topics, query_error_rate, digests, acceptable_texts, date_spans, article_headings, article_bodies, phase_queries, paraphrase_ratio, paraphrase_edit)}

_ART = "^\\s*(?i:Art[íiÍ]culo)\\s+([0-9]+)\\s*[°º]?\\s*[.:–—]?\\s*\\p{Lu}"
_V = "(SELECT DISTINCT id, text FROM vacantes)"

ORACLES = {
    "text_norms": f"""
        SELECT id, {S.norm('query')} AS norm, trim(regexp_replace(lower(query), '[\\s\\p{{Z}}]+', ' ', 'g')) AS cache_norm, {S.fold('query')} AS folded,
               regexp_replace(trim(regexp_replace(query, '[\\s\\p{{Z}}]+', ' ', 'g')), '^[| ]+|[| ]+$', '', 'g') AS clean,
               array_to_string(string_split(trim(regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' ')[1:4], ' ') AS template
        FROM queries""",
    "token_frequency": f"""
        SELECT token, count(*) AS uses, count(DISTINCT doc_id) AS documents
        FROM (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token""",
    "stem_sets": f"SELECT id, array_to_string(list_sort(list_distinct(list_transform(string_split({S.norm('query')}, ' '), lambda t: t[1:6]))), ' ') AS stems FROM question_bank",
    "row_fields": f"""
        WITH rows AS (SELECT id, line_no::INT AS line_no, regexp_replace(line, '^\\s*Tabla\\s+[0-9]+\\s*[—-]\\s*fila\\s+[0-9]+\\s*:\\s*', '') AS body FROM {S.lines(_V, 'id')} WHERE regexp_matches(line, '^(Tabla [0-9]+ — fila [0-9]+:|[A-Z]+ \\| )')),
        parts AS (SELECT id, line_no, unnest(regexp_extract_all(body, '(?:^|[;|])\\s*([^:;|]{{2,80}}?)\\s*:\\s*([^;|]+)', 1)) AS a, unnest(regexp_extract_all(body, '(?:^|[;|])\\s*([^:;|]{{2,80}}?)\\s*:\\s*([^;|]+)', 2)) AS b, unnest(range(len(regexp_extract_all(body, '(?:^|[;|])\\s*([^:;|]{{2,80}}?)\\s*:\\s*([^;|]+)', 1)))) AS i FROM rows),
        kept AS (SELECT id, line_no, i, {S.strip('a')} AS label, {S.strip('b')} AS value FROM parts WHERE {S.strip('a')} <> '' AND {S.strip('b')} <> '')
        SELECT id, line_no, (row_number() OVER (PARTITION BY id, line_no ORDER BY i) - 1)::INT AS place, label, value,
               CASE WHEN contains(label, '/') THEN {S.strip("regexp_extract(label, '^(.*)/', 1)")} ELSE '' END AS grp, {S.strip("split_part(label, '/', -1)")} AS item,
               CASE WHEN regexp_full_match(trim(value), '[0-9]{{1,18}}') THEN trim(value)::BIGINT END AS number
        FROM kept""",
    "answer_numbers": f"""
        WITH g AS (SELECT id, gold, regexp_replace(regexp_replace({S.fold('gold')}, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}', ' ', 'g'), '(pagina|pag\\.?|p\\.)\\s*[0-9]+', ' ', 'g') AS bare FROM question_bank WHERE gold IS NOT NULL)
        SELECT id, array_to_string({S.number_tokens('gold')}, ' ') AS numbers,
               array_to_string(list_sort(list_distinct(regexp_extract_all(bare, '(?:^|[^0-9.,])([0-9]+)', 1))), ' ') AS standalone,
               array_to_string(list_transform(regexp_extract_all(gold, '[0-9]+'), lambda n: (n::HUGEINT)::VARCHAR), ' ') AS integers,
               array_to_string(regexp_extract_all(gold, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}'), ' ') AS dates
        FROM g""",
    "quoted_topics": """
        SELECT doc_id, topic FROM (SELECT doc_id, coalesce(nullif(regexp_extract(text, '«([^»]+)»', 1), ''), nullif(regexp_extract(text, '“([^”]+)”', 1), ''), nullif(regexp_extract(text, '"([^"]+)"', 1), ''),
               nullif(regexp_extract(text, '‘([^’]+)’', 1), ''), nullif(regexp_extract(text, '''([^'']+)''', 1), '')) AS topic FROM documents) WHERE topic IS NOT NULL""",
    "query_error_rate": f"""
        WITH d AS (SELECT r.system, levenshtein({S.norm('b.query')}, {S.norm('r.query')}) AS d, length({S.norm('b.query')}) AS size FROM runs r JOIN question_bank b ON b.id = r.id WHERE r.query IS NOT NULL)
        SELECT system, count(*) AS runs, round(sum(d) / sum(size), 6) AS error_rate, round(avg((d = 0)::INT), 6) AS exact FROM d GROUP BY system""",
    "digests": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "acceptable_texts": """
        SELECT lang, count(*) AS documents, sum(coalesce(length(text) BETWEEN 80 AND 2000 AND len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) >= 5
               AND (length(text) - length(replace(text, chr(65533), ''))) * 100 <= length(text) AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) * 100 >= length(text) * 45, false)::INT) AS acceptable
        FROM documents GROUP BY lang""",
    "date_spans": """
        SELECT id, abs(datediff('day', strptime(d[1], '%d/%m/%Y')::DATE, strptime(d[2], '%d/%m/%Y')::DATE)) AS days
        FROM (SELECT id, regexp_extract_all(coalesce(gold, ''), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') AS d FROM question_bank) WHERE len(d) = 2""",
    "article_headings": f"""
        SELECT id, line_no::INT AS line_no, regexp_extract(line, '{_ART}', 1)::INT AS article, regexp_matches(rtrim(regexp_replace(line, '\\r$', '')), '[.!?]["''»)]*$') AS complete
        FROM {S.lines(_V, 'id')} WHERE regexp_matches(line, '{_ART}')""",
    "phase_queries": f"""
        SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '\\btotales\\b', 'total', 'g'), '\\bprimera fase\\b', 'fase i', 'g'), '\\bsegunda fase\\b', 'fase ii', 'g'),
               '\\btercera fase\\b', 'fase iii', 'g'), '\\bcuarta fase\\b', 'fase iv', 'g'), '\\bquinta fase\\b', 'fase v', 'g') AS rewritten
        FROM (SELECT id, {S.norm('query')} AS n FROM queries) WHERE regexp_matches(n, '\\bfase\\b')""",
    "paraphrase_edit": f"""
        SELECT id, round(1 - levenshtein(a, b) / greatest(length(a), length(b), 1), 6) AS edit_ratio
        FROM (SELECT id, regexp_replace({S.norm('query')}, '[^a-z0-9 ]', '', 'g') AS a, regexp_replace({S.norm('parafrasis')}, '[^a-z0-9 ]', '', 'g') AS b FROM queries WHERE parafrasis IS NOT NULL)""",
}

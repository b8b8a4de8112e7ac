"""Queries of positional answers and answer checks, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.operators import articles as A
from tamizal.plans import sql as S
from tamizal.sources.tables import lines, table, vacantes


def article_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Every article of vacantes: its heading's place, how many lines and pages it goes on, and the digest of all its lines."""
    v = vacantes(spark, folder, "seq", "source", "page", "text")
    a = A.article_texts(lines(v, "source", "page", "seq"))
    return a.select("source", "article", "page", "seq", "line_no", "pages", "lines", F.md5("whole").alias("md5"))


_SPAN = r"inscripciones para ([^.\n]+?) van del ([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}) al ([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}) en la sede ([^.\n]+)[.]"


def schedule_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The dates that the documents' sentences about enrolment give bank questions, where they name one row of the schedule."""
    d = table(spark, folder, "documents").where("text is not null")
    parts = [F.regexp_extract_all("text", F.lit(_SPAN), F.lit(i)) for i in (1, 2, 3, 4)]
    found = d.select(F.explode(F.arrays_zip(*(x.alias(n) for x, n in zip(parts, ("way", "first", "last", "place"))))).alias("x")).select("x.*").distinct()
    rows = found.select(F.concat_ws(" ", "way", "place").alias("heading"), F.lit("inscripciones").alias("item"), F.array("first", "last").alias("dates"))
    aliases = spark.createDataFrame([("inscripciones", x) for x in ("inscribirme", "inscripcion", "inscripciones", "inscribirse")], "item string, alias string")
    return A.date_cells(table(spark, folder, "question_bank").select("id", "query"), rows, aliases)


def verified_cells(spark: SparkSession, folder: str) -> DataFrame:
    """By system, answers of the form `row: N vacantes (column)` and those whose row and number stand in the contexts."""
    form = r"^([^:]+): ([0-9]+) vacantes \((.*)\)$"
    r = table(spark, folder, "runs").where(F.col("answer").rlike(form)).select("system", F.regexp_extract("answer", form, 1).alias("row"), F.regexp_extract("answer", form, 2).alias("n"), F.coalesce(F.array_join("contexts", " "), F.lit("")).alias("context"))
    ok = F.contains("context", "row") & F.array_contains(F.regexp_extract_all("context", F.lit("[0-9]+"), F.lit(0)), F.col("n"))
    return r.groupBy("system").agg(F.count("*").alias("answers"), F.sum(ok.cast("int")).alias("verified"))


def variant_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean seconds by category and system, a row for each pair that has runs with a time."""
    bank = table(spark, folder, "question_bank").select("id", "category")
    r = table(spark, folder, "runs").where("not isnan(elapsed_s)").select("id", "system", "elapsed_s").join(bank, "id")
    return r.groupBy("category", "system").agg(F.round(F.avg("elapsed_s"), 9).alias("mean"))


def blind_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order in which a rater sees the first answers of each system: seeded, the same on every engine with MD5."""
    r = table(spark, folder, "runs").where("attempt = 1").select("id", "system").distinct()
    return A.seeded_order(r, ("system",), ("id", "system"), 11)


def quantitative_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose composite rows make a quantitative table: how many numeric rows."""
    from tamizal.operators.tables import cells

    v = vacantes(spark, folder, "source", "text").where("source is not null")
    rows = lines(v, "id", "source").where(F.col("line").startswith("VACANTES | ")).withColumn("row", F.concat_ws(":", "id", "line_no"))
    return A.quantitative(cells(rows, ("source", "row"), "line"), ("source",), "row").select("source", "numeric", F.length("lines").alias("size"), F.md5("lines").alias("md5"))


QUERIES = {f.__name__: f for f in (article_extract, schedule_cells, verified_cells, variant_means, blind_order, quantitative_tables)}

_HEAD = "^\\s*(?i:Art[íiÍ]culo)\\s+([0-9]+)\\s*[°º]?\\s*[.:–—]?\\s*\\p{Lu}"
_F = "'(?:^|[;|])\\s*([^:;|]{2,80}?)\\s*:\\s*([^;|]+)'"

_WAY, _FIRST, _LAST, _PLACE = (f"unnest(regexp_extract_all(text, '{_SPAN}', {i}))" for i in (1, 2, 3, 4))

ORACLES = {
    "schedule_cells": f"""WITH r AS (SELECT DISTINCT way || ' ' || place AS heading, a, b FROM (SELECT {_WAY} AS way, {_FIRST} AS a, {_LAST} AS b, {_PLACE} AS place FROM documents WHERE text IS NOT NULL)),
        q AS (SELECT id, {S.norm('query')} AS q FROM question_bank), m AS (SELECT id, q, heading, a, b, count(*) OVER (PARTITION BY id) AS n FROM q, r WHERE regexp_matches(q, '(^| )(inscribirme|inscripcion|inscripciones|inscribirse)( |$)')
            AND list_has_all(string_split(q, ' '), list_filter(string_split({S.norm('heading')}, ' '), lambda t: t NOT IN ('examen', 'de', 'del', ''))))
        SELECT id, 'inscripciones' AS item, heading, CASE WHEN regexp_matches(q, '\\b(hasta|ultimo|finaliza|cierra)\\b') THEN b WHEN regexp_matches(q, '\\b(desde|inicia|empieza|comienza)\\b') THEN a ELSE 'Del ' || a || ' al ' || b END AS answer FROM m WHERE n = 1""",
    "article_extract": f"""WITH l AS (SELECT *, CASE WHEN regexp_matches(line, '{_HEAD}') THEN struct_pack(page := page, seq := seq, line_no := line_no::INT, article := regexp_extract(line, '{_HEAD}', 1)::INT) END AS head
        FROM {S.lines('(SELECT DISTINCT id, source, page, seq, text FROM vacantes)', 'source, page, seq')} WHERE source IS NOT NULL AND page IS NOT NULL),
        o AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY source ORDER BY page, seq, line_no ROWS UNBOUNDED PRECEDING) AS at_ FROM l)
        SELECT source, at_.article AS article, at_.page AS page, at_.seq AS seq, at_.line_no AS line_no, count(DISTINCT o.page) AS pages, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY o.page, o.seq, o.line_no)) AS md5 FROM o WHERE at_ IS NOT NULL GROUP BY source, at_""",
    "quantitative_tables": f"""WITH r AS (SELECT source, id, line_no, line FROM {S.lines('(SELECT DISTINCT id, source, text FROM vacantes)', 'source, id')} WHERE source IS NOT NULL AND starts_with(line, 'VACANTES | ')),
        v AS (SELECT source, id, line_no, {S.strip('a')} AS label, {S.strip('b')} AS value, i FROM (SELECT source, id, line_no, unnest(regexp_extract_all(line, {_F}, 1)) AS a, unnest(regexp_extract_all(line, {_F}, 2)) AS b, unnest(range(len(regexp_extract_all(line, {_F}, 1)))) AS i FROM r)),
        n AS (SELECT source, id, line_no, count(*) FILTER (regexp_full_match(value, '[0-9]+([.,][0-9]+)?')) AS numbers, string_agg(label || ': ' || value, '; ' ORDER BY i) AS text FROM v WHERE label <> '' AND value <> '' GROUP BY ALL)
        SELECT source, count(*) FILTER (numbers >= 2) AS numeric, length(string_agg(text, chr(10)) FILTER (numbers >= 2)) AS size, md5(string_agg(text, chr(10) ORDER BY id || ':' || line_no) FILTER (numbers >= 2)) AS md5 FROM n GROUP BY source HAVING count(*) FILTER (numbers >= 2) >= greatest(2, 0.5 * count(*))""",
    "verified_cells": """WITH r AS (SELECT system, regexp_extract(answer, '^([^:]+): ([0-9]+) vacantes \\((.*)\\)$', 1) AS row_, regexp_extract(answer, '^([^:]+): ([0-9]+) vacantes \\((.*)\\)$', 2) AS n, coalesce(array_to_string(contexts, ' '), '') AS c
        FROM runs WHERE regexp_matches(answer, '^([^:]+): ([0-9]+) vacantes \\((.*)\\)$')) SELECT system, count(*) AS answers, sum((contains(c, row_) AND list_contains(regexp_extract_all(c, '[0-9]+'), n))::INT) AS verified FROM r GROUP BY system""",
    "variant_means": "SELECT category, system, round(avg(elapsed_s), 9) AS mean FROM runs r JOIN question_bank b ON b.id = r.id WHERE NOT isnan(elapsed_s) GROUP BY category, system",
    "blind_order": "SELECT id, system, row_number() OVER (PARTITION BY system ORDER BY md5('11:' || id || ':' || system), id) AS place FROM (SELECT DISTINCT id, system FROM runs WHERE attempt = 1)",
}

"""Queries over serialized tables and segments, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamizal.functions import text as T
from tamizal.operators import segments as G
from tamizal.operators import table_language as Q
from tamizal.operators import tables as B
from tamizal.plans import sql as S
from tamizal.session import materialize
from tamizal.sources.tables import lines, spread, table, vacantes

_ROW = r"^(Tabla [0-9]+ — fila [0-9]+:|VACANTES \| )"


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the table rows among the lines of vacantes; a table is one source's rows, an entity its Programa."""
    v = vacantes(spark, folder, "source", "text").where("source is not null")
    rows = lines(v, "id", "source").where(F.col("line").rlike(_ROW)).withColumn("f", T.fields(F.col("line")))
    # the row's entity from its own fields, before they are spread
    rows = rows.withColumn("entity", F.array_min(F.transform(F.filter("f", lambda x: x["label"] == "Programa"), lambda x: x["value"]))).where("entity is not null")
    f = rows.select("source", "id", "line_no", "entity", F.posexplode("f").alias("place", "x"))
    label = F.col("x.label")
    return f.select("source", "id", "line_no", "place", label.alias("label"), T.group_of(label).alias("grp"), T.item_of(label).alias("item"), F.col("x.value").alias("value"), T.number(F.col("x.value")).alias("number"), "entity")


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    """The one number of each source, programme and column, where all rows agree."""
    return B.unique_reading(_cells(spark, folder), ("source", "entity", "label"))


def entity_infer(spark: SparkSession, folder: str) -> DataFrame:
    """The column of each source's tables that names the rows."""
    return B.entity_labels(_cells(spark, folder), ("source",), ("id", "line_no"))


def table_cell(spark: SparkSession, folder: str) -> DataFrame:
    """Unique numbers by source, programme and column."""
    return _readings(spark, folder)


def column_superlative(spark: SparkSession, folder: str) -> DataFrame:
    """The programmes with the greatest number of each source and column, ties included."""
    return B.superlative(_readings(spark, folder), ("source", "label"))


def column_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Rows above zero and their sum, by source and column."""
    return B.nonzero_sum(_readings(spark, folder), ("source", "label"))


def column_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Difference of the first and the last programme in name order, in each source and column."""
    r = _readings(spark, folder)
    ends = r.groupBy("source", "label").agg(F.min("entity").alias("first_entity"), F.max("entity").alias("last_entity")).where("first_entity <> last_entity")
    r = r.join(ends, ["source", "label"])
    return B.compare(r, ("source", "label"), "entity", F.col("first_entity"), F.col("last_entity"))


def reverse_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Programmes with exactly each number, by source and column."""
    return B.reverse_lookup(_readings(spark, folder), ("source", "label"), "entity", F.col("number"))


def group_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Of every table row the total of each column group."""
    return B.group_totals(_cells(spark, folder), ("id", "line_no"))


def _asked_cells(spark: SparkSession, folder: str) -> DataFrame:
    return _cells(spark, folder).select(F.col("source").alias("tbl"), F.struct("id", "line_no").alias("row"), "place", "entity", "label", "number", "value")


def candidate_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions made of the tables' headers, rows and values."""
    return Q.candidate_questions(_asked_cells(spark, folder))


def _table_questions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The made questions and those of the bank, and the cells they are put to."""
    c = materialize(_asked_cells(spark, folder), "table_cells")
    return Q.candidate_questions(c).unionByName(_bank(spark, folder)), c


def _bank(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "question_bank").select(F.concat(F.lit("bank|"), "id").alias("key"), "query")


def bank_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The bank's questions among those of table_answers; no answer depends on what else is asked, so the made ones aren't put."""
    return Q.table_answers(_bank(spark, folder), _asked_cells(spark, folder), "key")


def column_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Made and bank questions read as ones about a column: cells, comparisons, superlatives, lists, sums."""
    q, c = _table_questions(spark, folder)
    return Q.column_readings(Q.Asked(q, c, "key", "query", False)).select(F.col("k").alias("key"), "kind", "label", "subject", "number")


def aggregate_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The same read as aggregates: rows with a value, comparisons and sums of rows, sums of columns, summary rows, groups of rows."""
    q, c = _table_questions(spark, folder)
    return Q.aggregate_readings(Q.Asked(q, c, "key", "query", True)).select(F.col("k").alias("key"), "kind", "label", "subject", "number")


def table_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answer of each question that the tables answer: an aggregate if there is one, else a column's."""
    q, c = _table_questions(spark, folder)
    return Q.table_answers(q, c, "key").select("key", "kind", "label", "subject", "number")


def schedule_days(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of customers with exactly two: the days between, from dates written day/month/year."""
    o = table(spark, folder, "orders").select("o_custkey", F.date_format("o_orderdate", "d/M/yyyy").alias("d"))
    two = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("b")).where("n = 2")
    return two.select("o_custkey", T.days_between(F.col("a"), F.col("b")).alias("days"))


def chunk_200_20(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every document: 200 words, 20 shared."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(G.chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return d.select("doc_id", "chunk_no", F.length("chunk").alias("size"), F.md5("chunk").alias("md5"))


def line_filter_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Segments without their serialized rows: characters left."""
    return vacantes(spark, folder, "text").where("text is not null").select("id", F.length(G.without_bar_lines(F.col("text"))).alias("left"))


def furniture_repeat3(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that stand, digits apart, on three or more pages of a document."""
    v = vacantes(spark, folder, "document_id", "page", "text").where("document_id is not null")
    return G.furniture(lines(v, "document_id", "page"), "document_id", "page", "line")


def table_like_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of lines that look like table rows, in every segment."""
    return G.table_like_groups(vacantes(spark, folder, "text"), "id", "text")


def page_regroup(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's text from its segments in order, as digest."""
    v = vacantes(spark, folder, "seq", "source", "page", "text").where("source is not null")
    return G.page_texts(v).select("source", "page", "segments", F.md5("text").alias("md5"))


def serialize_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with cells, serialized with their headers."""
    v = vacantes(spark, folder, "table_no", "row_no", "cells", "headers").where("size(cells) > 0")
    return v.select("id", G.serialize_row(F.concat(F.lit("Tabla "), "table_no", F.lit(" — fila "), "row_no"), F.col("headers"), F.col("cells")).alias("row"))


def syllabus_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Heading lines of the syllabi among the documents."""
    return table(spark, folder, "documents").select("doc_id", F.explode(G.headings(F.col("text"), "TEMARIO ")).alias("heading"))


def clause_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered clauses of each logged answer, every attempt counted for itself."""
    return table(spark, folder, "runs").where("answer is not null").select("id", "system", "attempt", F.size(G.clauses(F.col("answer"))).alias("clauses")).where("clauses > 0").distinct()


def section_ends(spark: SparkSession, folder: str) -> DataFrame:
    """For each article line of a source, the place of the next one."""
    v = vacantes(spark, folder, "seq", "source", "text").where("source is not null")
    l = lines(v, "source", "seq").where(T.is_article_heading(F.col("line")))  # noqa: E741
    l = l.groupBy("source", "seq").agg(F.count("*").alias("articles"))  # noqa: E741
    return G.next_boundary(l, ("source",), "seq", F.lit(True))


def rare_acronyms(spark: SparkSession, folder: str) -> DataFrame:
    """Acronyms that stand once in all documents, with their document."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(F.filter(F.split("text", "[^\\p{L}]+"), lambda w: w.rlike("^[A-Z]{3,6}$"))).alias("acronym"))
    return d.groupBy("acronym").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").drop("n")


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    """For each bank question the document of its category with the strictly highest word overlap; ties give none."""
    q = table(spark, folder, "question_bank").select("id", "category", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("t"))
    d = spread(table(spark, folder, "documents").select("doc_id", "text", "category").where("text is not null and category is not null")).select("doc_id", "category", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))
    s = q.join(d, ["category", "t"]).groupBy("id", "doc_id").agg(F.count("*").alias("score"))
    best = s.withColumn("place", F.rank().over(Window.partitionBy("id").orderBy(F.desc("score")))).where("place = 1")
    return best.groupBy("id").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("score").alias("score")).where("n = 1 and score >= 5").drop("n")


def tpch_group_share(spark: SparkSession, folder: str) -> DataFrame:
    """Line items by ship year, return flag and status with subtotals, over the whole fact table."""
    l = table(spark, folder, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("decimal(18,2)").alias("quantity"))  # noqa: E741
    return l.rollup("year", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("quantity").cast("double").alias("quantity"))


QUERIES = {
    f.__name__: f
    for f in (
        entity_infer, table_cell, column_superlative, column_sum, column_comparison, reverse_lookup, group_totals, candidate_questions, column_questions, aggregate_questions, table_answers, schedule_days, chunk_200_20, line_filter_bars, furniture_repeat3,
        table_like_islands, page_regroup, serialize_rows, syllabus_headings, clause_counts, section_ends, rare_acronyms, document_scores, tpch_group_share,
    )
}

_V = "(SELECT DISTINCT id, seq, source, page, document_id, text, table_no, row_no, cells, headers FROM vacantes)"
_F = "'(?:^|[;|])\\s*([^:;|]{2,80}?)\\s*:\\s*([^;|]+)'"
_CELLS = f"""
    raw AS (SELECT source, id, line_no::INT AS line_no, regexp_replace(line, '^\\s*Tabla\\s+[0-9]+\\s*[—-]\\s*fila\\s+[0-9]+\\s*:\\s*', '') AS body FROM {S.lines(_V, 'source, id')} WHERE source IS NOT NULL AND regexp_matches(line, '{_ROW}')),
    parts AS (SELECT source, id, line_no, unnest(regexp_extract_all(body, {_F}, 1)) AS a, unnest(regexp_extract_all(body, {_F}, 2)) AS b, unnest(range(len(regexp_extract_all(body, {_F}, 1)))) AS place FROM raw),
    named AS (SELECT source, id, line_no, place, {S.strip('a')} AS label, {S.strip('b')} AS value FROM parts),
    c AS (SELECT *, CASE WHEN contains(label, '/') THEN {S.strip("regexp_extract(label, '^(.*)/', 1)")} ELSE '' END AS grp, {S.strip("split_part(label, '/', -1)")} AS item,
          CASE WHEN regexp_full_match(value, '[0-9]{{1,18}}') THEN value::BIGINT END AS number, min(CASE WHEN label = 'Programa' THEN value END) OVER (PARTITION BY source, id, line_no) AS entity
          FROM named WHERE label <> '' AND value <> '' QUALIFY entity IS NOT NULL),
    reading AS (SELECT source, entity, label, max(number) AS number FROM c WHERE number IS NOT NULL GROUP BY ALL HAVING min(number) = max(number))"""
_ARTICLE = "^\\s*(?i:Art[íiÍ]culo)\\s+([0-9]+)\\s*[°º]?\\s*[.:–—]?\\s*\\p{Lu}"

# the query language by brute force: every question against every header and row
_NOT = "', '".join
_MADE = f"""
    x AS (SELECT source AS tbl, id, line_no, place, entity, label, grp, item, number, {S.norm('entity')} AS name, {S.norm('label')} AS nlabel, regexp_matches({S.norm('entity')}, '^(sub)?total\\b') AS summary FROM c),
    num AS (SELECT * FROM x WHERE number IS NOT NULL AND nlabel NOT IN ('{_NOT(B.ROW_KEYS)}')),
    l AS (SELECT label, {S.norm('label')} AS l, min(entity) AS a, max(entity) AS b, max(number)::VARCHAR AS n FROM x WHERE number IS NOT NULL GROUP BY label),
    w AS (SELECT t AS w FROM (SELECT DISTINCT entity, unnest(string_split(name, ' ')) AS t FROM x WHERE number IS NOT NULL) WHERE length(t) > 3 AND t NOT IN ('{_NOT(Q.QUERY_NOISE + Q.SMALL)}') GROUP BY t ORDER BY count(*) DESC, t DESC LIMIT 1),
    made AS (SELECT 'most|' || label AS key, '¿Qué programa tiene más vacantes en ' || l || '?' AS query FROM l UNION ALL SELECT 'least|' || label, '¿Qué programa tiene menos vacantes en ' || l || '?' FROM l
        UNION ALL SELECT 'list|' || label, '¿En qué carreras hay vacantes por ' || l || '?' FROM l UNION ALL SELECT 'sum|' || label, '¿Cuántas vacantes hay por ' || l || '?' FROM l
        UNION ALL SELECT 'exact|' || label, '¿Qué programa tiene exactamente ' || n || ' vacantes en ' || l || '?' FROM l UNION ALL SELECT 'cell|' || label, '¿Cuántas vacantes de ' || l || ' tiene ' || a || '?' FROM l
        UNION ALL SELECT 'versus|' || label, '¿Quién tiene más ' || l || ', ' || a || ' o ' || b || '?' FROM l UNION ALL SELECT 'both|' || label, '¿Cuánto suman ' || a || ' y ' || b || ' en ' || l || '?' FROM l
        UNION ALL SELECT 'difference|' || label, '¿Qué diferencia hay entre ' || a || ' y ' || b || ' en ' || l || '?' FROM l
        UNION ALL SELECT 'group_most|' || label, '¿Qué ' || w || ' tiene más ' || l || '?' FROM l, w UNION ALL SELECT 'group_sum|' || label, '¿Cuánto suman todas las ' || w || ' en ' || l || '?' FROM l, w
        UNION ALL SELECT 'columns|' || entity, '¿Cuánto suman ' || {S.norm('g')} || ' y ' || {S.norm('h')} || ' en ' || entity || '?' FROM (SELECT entity, min(grp) AS g, max(grp) AS h FROM x WHERE number IS NOT NULL AND grp <> '' GROUP BY entity) WHERE g <> h)"""


def _stem_list(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({x}, ' '), lambda t: t <> ''), lambda t: t[1:6]))"


def _meaning(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({S.norm(x)}, ' '), lambda t: t <> '' AND t NOT IN ('{_NOT(B.LABEL_NOISE)}')), lambda t: t[1:6]))"


def _language(aggregate: bool) -> str:
    """Questions with the headers, tables and rows they name, and what they match; shared by both readings."""
    text = f"regexp_replace({S.norm('query')}, '\\btotales\\b', 'total', 'g')"
    if not aggregate:
        for word, numeral in T.ORDINALS.items():
            text = f"regexp_replace({text}, '\\b{word} fase\\b', 'fase {numeral}', 'g')"
    total = f"CASE WHEN regexp_matches(q, '{Q.SUM}') THEN ['total'] ELSE [] END" if aggregate else "[]"
    gate = "true" if aggregate else f"regexp_matches(q, '{Q.GATE}')"
    inside = "len(tokens) >= 2 AND list_has_all(asked, tokens)" if aggregate else "false"
    small, noise = _NOT(Q.SMALL), _NOT(Q.QUERY_NOISE + Q.SMALL)
    return f"""
    q AS (SELECT key AS k, q, list_distinct(list_concat({_stem_list('q')}, {total})) AS stems FROM (SELECT DISTINCT key, {text} AS q FROM (SELECT * FROM made UNION ALL SELECT 'bank|' || id, query FROM question_bank) WHERE query IS NOT NULL) WHERE {gate}),
    head AS (SELECT label, list_filter({_meaning('item')}, lambda t: t <> 'total') AS core, {_meaning('grp')} AS g, list_contains({_meaning('item')}, 'total') AS has_total FROM (SELECT DISTINCT label, item, grp FROM num)),
    score AS (SELECT k, label, 2 * len(core) + CASE WHEN len(g) > 0 AND list_has_all(stems, g) THEN len(g) ELSE 0 END + (has_total AND list_contains(stems, 'total'))::INT AS score FROM q, head
        WHERE CASE WHEN len(core) > 0 THEN list_has_all(stems, core) ELSE has_total AND list_contains(stems, 'total') AND list_has_all(stems, g) END),
    points AS (SELECT k, tbl, sum(p) AS p FROM (SELECT k, tbl, count(*) AS p FROM (SELECT DISTINCT tbl, label FROM num WHERE NOT summary) JOIN score USING (label) GROUP BY ALL
        UNION ALL SELECT k, tbl, 2 * count(*) FROM q, (SELECT DISTINCT tbl, id, line_no, name FROM x WHERE NOT summary AND length(name) > 3) WHERE contains(' ' || q || ' ', ' ' || name || ' ') GROUP BY ALL) GROUP BY ALL),
    tables AS (SELECT k, tbl FROM points QUALIFY p = max(p) OVER (PARTITION BY k)),
    here AS (SELECT k, list(DISTINCT stem) AS heads FROM tables JOIN (SELECT DISTINCT tbl, unnest({_stem_list('nlabel')}) AS stem FROM x WHERE NOT summary) USING (tbl) GROUP BY k),
    asks AS (SELECT k, q, list_filter(string_split(q, ' '), lambda t: t <> '' AND t NOT IN ('{noise}') AND NOT list_contains(coalesce(heads, []), t[1:6])) AS asked FROM q LEFT JOIN here USING (k)),
    names AS (SELECT k, name, count(*) AS n, list_distinct(list_filter(string_split(name, ' '), lambda t: t <> '' AND t NOT IN ('{small}'))) AS tokens FROM tables JOIN (SELECT DISTINCT tbl, id, line_no, name FROM x WHERE NOT summary) USING (tbl) GROUP BY ALL),
    hits AS (SELECT *, sum(CASE WHEN list_contains(tokens, asked[1]) THEN n ELSE 0 END) OVER (PARTITION BY k) AS alone FROM names JOIN asks USING (k)),
    said AS (SELECT k, name FROM hits WHERE name <> '' AND (contains(' ' || q || ' ', ' ' || name || ' ') OR len(asked) > 0 AND list_has_all(tokens, asked) AND (len(list_distinct(asked)) >= 2 OR alone = 1) OR {inside})),
    row_named AS (SELECT a.k, a.name FROM said a WHERE NOT EXISTS (SELECT 1 FROM said b WHERE b.k = a.k AND b.name <> a.name AND contains(b.name, a.name))),
    m AS (SELECT k, tbl, id, line_no, place, summary, entity, name, label, number, score FROM tables JOIN num USING (tbl) JOIN score USING (k, label)),
    many AS (SELECT q.k, q.q, q.stems, count(name) AS names FROM q LEFT JOIN row_named USING (k) GROUP BY ALL),
    cell AS (SELECT k, name, any_value(label) AS label, any_value(number) AS number, min(entity) AS entity FROM (SELECT * FROM m JOIN row_named USING (k, name) WHERE NOT summary QUALIFY score = max(score) OVER (PARTITION BY k, name)) GROUP BY k, name HAVING count(DISTINCT (label, number)) = 1)"""


_SUBJECT = "array_to_string(list_sort(list_distinct(list(entity))), '; ')"
_COLUMN = f"""{_language(False)},
    top AS (SELECT m.*, count(DISTINCT label) OVER (PARTITION BY k) AS labels FROM (SELECT m.* FROM m JOIN many USING (k) WHERE names = 0 AND NOT summary QUALIFY score = max(score) OVER (PARTITION BY k)) m),
    col AS (SELECT k, q, label, name, arg_max(struct_pack(entity := entity, number := number), struct_pack(tbl := tbl, id := id, line_no := line_no, place := place)) AS r FROM top JOIN q USING (k) WHERE labels = 1 GROUP BY ALL),
    last AS (SELECT k, q, label, r.entity AS entity, r.number AS number, regexp_matches(q, '{Q.ANY_EXTREME}') AS ext FROM col),
    win AS (SELECT * FROM last WHERE ext QUALIFY CASE WHEN regexp_matches(q, '{Q.MOST}') THEN number = max(number) OVER (PARTITION BY k) ELSE number = min(number) OVER (PARTITION BY k) END),
    fill AS (SELECT k, q, any_value(label) AS label, {_SUBJECT} AS subject, sum(number)::BIGINT AS number FROM last WHERE NOT ext AND number > 0 GROUP BY k, q),
    found AS (SELECT k, 'column_comparison' AS kind, any_value(label) AS label, {_SUBJECT} AS subject, max(number) - min(number) AS number FROM cell JOIN many USING (k)
        WHERE names = 2 AND regexp_matches(q, '{Q.DIFFERENCE}') AND regexp_matches(q, '{Q.BETWEEN}') GROUP BY k HAVING count(*) = 2 AND count(DISTINCT label) = 1
        UNION ALL SELECT k, 'column_cell', label, entity, number FROM cell JOIN many USING (k) WHERE names = 1
        UNION ALL SELECT k, 'column_superlative', any_value(label), {_SUBJECT}, any_value(number) FROM win GROUP BY k
        UNION ALL SELECT k, 'column_list', label, subject, number FROM fill WHERE regexp_matches(q, '{Q.LIST}')
        UNION ALL SELECT k, 'column_sum', label, subject, number FROM fill JOIN head USING (label) WHERE NOT regexp_matches(q, '{Q.LIST}') AND regexp_matches(q, '\\bcuant\\w*\\b') AND len(core) > 0)"""
_TOTALS = "SELECT k, tbl, id, line_no, grp, coalesce(arg_min(number, place) FILTER (list_contains(string_split({n}, ' '), 'total')), sum(number))::BIGINT AS total FROM {rows} JOIN x USING (tbl, id, line_no) WHERE number IS NOT NULL AND grp <> '' GROUP BY ALL"
_AGGREGATE = f"""{_language(True)},
    exact AS (SELECT *, regexp_extract(q, '{Q.EXACTLY}', 1) AS exact, regexp_matches(q, '{Q.SUM}') AS sums, regexp_matches(q, '{Q.ANY_EXTREME}') AS ext FROM many),
    rtop AS (SELECT m.*, exact::BIGINT AS exact, count(DISTINCT label) OVER (PARTITION BY k) AS labels FROM (SELECT m.*, e.exact FROM m JOIN exact e USING (k) WHERE NOT summary AND e.exact <> '' QUALIFY score = max(score) OVER (PARTITION BY k)) m),
    rest AS (SELECT * FROM exact WHERE exact = ''),
    multi AS (SELECT k, q, sums, any_value(label) AS label, {_SUBJECT} AS subject, sum(number)::BIGINT AS number, max(struct_pack(n := number, e := entity)) AS most, min(struct_pack(n := number, e := entity)) AS least, regexp_matches(q, '{Q.ANY_EXTREME}') AND regexp_matches(q, '\\bo\\b') AS versus
        FROM cell JOIN rest USING (k) WHERE names >= 2 GROUP BY k, q, sums, names HAVING count(*) = names AND count(DISTINCT label) = 1),
    its AS (SELECT k, q, stems, min(struct_pack(tbl := tbl, id := id, line_no := line_no, entity := entity)) AS r FROM row_named JOIN rest USING (k) JOIN tables USING (k) JOIN x USING (tbl, name) WHERE names = 1 AND sums GROUP BY ALL),
    own AS (SELECT k, q, stems, r.tbl AS tbl, r.id AS id, r.line_no AS line_no, r.entity AS subject FROM its),
    grps AS (SELECT t.*, o.q, o.subject, list_contains(o.stems, (string_split({S.norm('grp')}, ' ')[1])[1:6]) AS said FROM ({_TOTALS.format(n=S.norm('item'), rows='own')}) t JOIN own o USING (k)),
    per AS (SELECT k, tbl, id, line_no, q, subject, count(*) FILTER (said) AS groups, count(*) AS of_, sum(total) FILTER (said) AS total, array_to_string(list_sort(list(DISTINCT grp) FILTER (said)), '; ') AS label FROM grps GROUP BY ALL),
    grand AS (SELECT tbl, id, line_no, arg_min(struct_pack(label := label, number := number), place) AS g FROM x WHERE grp = '' AND list_contains(string_split(nlabel, ' '), 'total') GROUP BY ALL),
    rep AS (SELECT k, subject, p.label, w, count(*) AS n, sum(number)::BIGINT AS number FROM (SELECT *, unnest(list_distinct(list_transform(list_filter(string_split(q, ' '), lambda t: length(t) > 4 AND ends_with(t, 's')), lambda t: t[1:-2]))) AS w FROM per WHERE groups = 1) p
        JOIN x ON x.tbl = p.tbl AND x.id = p.id AND x.line_no = p.line_no AND x.grp = p.label WHERE number IS NOT NULL AND list_contains(string_split({S.norm('x.item')}, ' '), w) AND NOT list_contains(string_split(x.nlabel, ' '), 'total') GROUP BY k, subject, p.label, w HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY w) = 1),
    stem AS (SELECT DISTINCT k, name, unnest(list_transform(tokens, lambda t: t[1:6])) AS stem FROM names),
    often AS (SELECT k, stem FROM stem GROUP BY ALL HAVING count(DISTINCT name) >= 2),
    word AS (SELECT k, (list_filter(asked, lambda t: length(t) > 3 AND list_contains(stems_, t[1:6]))[1])[1:6] AS stem FROM asks JOIN (SELECT k, list(stem) AS stems_ FROM often GROUP BY k) USING (k)),
    member AS (SELECT DISTINCT m.* FROM m JOIN stem USING (k, name) JOIN word USING (k, stem) WHERE NOT summary),
    each_ AS (SELECT k, name, any_value(label) AS label, any_value(number) AS number, min(entity) AS entity FROM (SELECT * FROM member QUALIFY score = max(score) OVER (PARTITION BY k, tbl, id, line_no, name)) GROUP BY k, tbl, id, line_no, name HAVING count(DISTINCT (label, number)) = 1),
    reading_ AS (SELECT k, name, count(DISTINCT (label, number)) AS n, any_value(label) AS label, any_value(number) AS number, min(entity) AS entity FROM each_ GROUP BY k, name),
    grp_ AS (SELECT r.*, q, sums, ext FROM reading_ r JOIN rest USING (k) WHERE names = 0 AND regexp_matches(q, '\\b(todas|todos|suman|sumando|mas|menos|mayor|menor)\\b') AND k IN (SELECT k FROM reading_ GROUP BY k HAVING max(n) = 1 AND count(DISTINCT label) = 1)),
    best_ AS (SELECT * FROM grp_ WHERE ext QUALIFY CASE WHEN regexp_matches(q, '{Q.MOST}') THEN number = max(number) OVER (PARTITION BY k) ELSE number = min(number) OVER (PARTITION BY k) END),
    found AS (SELECT k, 'aggregate_reverse' AS kind, any_value(label) AS label, {_SUBJECT} AS subject, any_value(number) AS number FROM rtop WHERE labels = 1 AND number = exact GROUP BY k
        UNION ALL SELECT k, 'aggregate_comparison', label, CASE WHEN regexp_matches(q, '{Q.MOST}') THEN most.e ELSE least.e END, CASE WHEN regexp_matches(q, '{Q.MOST}') THEN most.n ELSE least.n END FROM multi WHERE versus AND most.n > least.n
        UNION ALL SELECT k, 'aggregate_sum_rows', label, subject, number FROM multi WHERE NOT versus AND sums
        UNION ALL SELECT k, 'aggregate_sum_columns', label, subject, CASE WHEN groups = of_ AND g.number IS NOT NULL THEN g.number ELSE total END::BIGINT FROM per LEFT JOIN grand USING (tbl, id, line_no) WHERE groups >= 2
        UNION ALL SELECT k, 'aggregate_sum_columns', label, subject, number FROM rep
        UNION ALL SELECT k, 'aggregate_group_superlative', any_value(label), {_SUBJECT}, any_value(number) FROM best_ GROUP BY k
        UNION ALL SELECT k, 'aggregate_group_sum', any_value(label), {_SUBJECT}, sum(number)::BIGINT FROM grp_ WHERE NOT ext AND (sums OR regexp_matches(q, '\\b(todas|todos)\\b')) GROUP BY k)"""

ORACLES = {
    "candidate_questions": f"WITH {_CELLS}, {_MADE} SELECT key, query FROM made",
    "column_questions": f"WITH {_CELLS}, {_MADE}, {_COLUMN} SELECT k AS key, kind, label, subject, number FROM found",
    "aggregate_questions": f"WITH {_CELLS}, {_MADE}, {_AGGREGATE} SELECT k AS key, kind, label, subject, number FROM found",
    "table_answers": f"""SELECT key, kind, label, subject, number FROM (SELECT * FROM (WITH {_CELLS}, {_MADE}, {_COLUMN} SELECT k AS key, kind, label, subject, number FROM found) UNION ALL SELECT * FROM (WITH {_CELLS}, {_MADE}, {_AGGREGATE} SELECT k AS key, kind, label, subject, number FROM found))
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY list_position(['{_NOT(Q.KINDS)}'], kind), label, subject) = 1""",
    "entity_infer": f"""WITH {_CELLS}, f AS (SELECT source, id, line_no, label, arg_min(value, place) AS value FROM c GROUP BY ALL),
        p AS (SELECT source, label, count(*) AS n, count(*) FILTER (regexp_matches(value, '\\p{{L}}{{3,}}') AND NOT regexp_full_match(value, '[0-9]{{1,18}}')) AS texty,
              count(DISTINCT {S.norm('value')}) FILTER (regexp_matches(value, '\\p{{L}}{{3,}}') AND NOT regexp_full_match(value, '[0-9]{{1,18}}')) AS d FROM f GROUP BY ALL),
        s AS (SELECT source, count(DISTINCT (id, line_no)) AS rows_ FROM c GROUP BY source)
        SELECT source, label AS entity_label FROM p JOIN s USING (source) WHERE rows_ >= 2 AND n >= 0.5 * rows_ AND texty >= 0.6 * n AND texty > 0 AND d / texty >= 0.5 QUALIFY row_number() OVER (PARTITION BY source ORDER BY d / texty DESC, label) = 1""",
    "table_cell": f"WITH {_CELLS} SELECT * FROM reading",
    "column_superlative": f"WITH {_CELLS} SELECT source, entity, label, number FROM reading QUALIFY number = max(number) OVER (PARTITION BY source, label)",
    "column_sum": f'WITH {_CELLS} SELECT source, label, count(*) AS "rows", sum(number) AS total FROM reading WHERE number > 0 GROUP BY ALL',
    "column_comparison": f"""WITH {_CELLS}, e AS (SELECT source, label, min(entity) AS x, max(entity) AS y FROM reading GROUP BY ALL HAVING min(entity) <> max(entity))
        SELECT a.source, a.label, a.number AS first, b.number AS second, abs(a.number - b.number) AS difference FROM e JOIN reading a ON a.source = e.source AND a.label = e.label AND a.entity = x JOIN reading b ON b.source = e.source AND b.label = e.label AND b.entity = y""",
    "reverse_lookup": f'WITH {_CELLS} SELECT source, label, number, count(*) AS "rows", min(entity) AS first_entity, max(entity) AS last_entity FROM reading GROUP BY source, label, number',
    "group_totals": f"""WITH {_CELLS}, n AS (SELECT *, list_contains(string_split({S.norm('item')}, ' '), 'total') AS own FROM c WHERE grp <> '' AND number IS NOT NULL)
        SELECT id, line_no, grp, coalesce(arg_min(number, place) FILTER (own), sum(number)) AS total, max(own::INT) AS has_total, count(*) AS columns FROM n GROUP BY ALL""",
    "schedule_days": "SELECT o_custkey, datediff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days FROM orders GROUP BY o_custkey HAVING count(*) = 2",
    "chunk_200_20": """WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[\\s\\p{Z}\\x{85}\\x0b]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, list_filter(list_transform(range(0, len(w), 180), lambda i: array_to_string(w[i + 1:i + 200], ' ')), lambda x: length(x) > 20) AS cs FROM w),
        e AS (SELECT doc_id, unnest(cs) AS chunk, unnest(range(len(cs))) AS chunk_no FROM c) SELECT doc_id, chunk_no::INT AS chunk_no, length(chunk) AS size, md5(chunk) AS md5 FROM e""",
    "line_filter_bars": f"SELECT id, length(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, '|')), chr(10))) AS \"left\" FROM {_V} WHERE text IS NOT NULL",
    "furniture_repeat3": f"""WITH l AS (SELECT document_id, page, regexp_replace({S.norm('line')}, '[0-9]+', '#', 'g') AS signature FROM {S.lines(_V, 'document_id, page')} WHERE document_id IS NOT NULL)
        SELECT document_id, signature, count(DISTINCT page) AS pages FROM l WHERE signature <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 3""",
    "table_like_islands": f"""WITH l AS (SELECT id, line_no FROM {S.lines(_V, 'id')} WHERE regexp_matches({S.strip('line')}, '\\t|\\s{{2,}}')), i AS (SELECT *, line_no - row_number() OVER (PARTITION BY id ORDER BY line_no) AS g FROM l)
        SELECT id, min(line_no)::INT AS first_line, count(*) AS lines FROM i GROUP BY id, g HAVING count(*) >= 2""",
    "page_regroup": f"SELECT lower(trim(source, ' ')) AS source, page, count(*) AS segments, md5(string_agg(text, chr(10) ORDER BY seq, text)) AS md5 FROM {_V} WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY ALL",
    "serialize_rows": f"""WITH r AS (SELECT id, table_no, row_no, unnest(cells) AS c, unnest(range(len(cells))) AS i, headers FROM {_V} WHERE len(cells) > 0),
        p AS (SELECT id, table_no, row_no, i, c, CASE WHEN coalesce(trim(headers[i + 1], ' '), '') <> '' THEN headers[i + 1] WHEN i = 0 THEN 'Item' ELSE 'Dato ' || i END AS h FROM r WHERE coalesce(trim(c, ' '), '') <> '')
        SELECT id, 'Tabla ' || table_no || ' — fila ' || row_no || ': ' || string_agg(h || ': ' || c, ' | ' ORDER BY i) AS row FROM p GROUP BY id, table_no, row_no""",
    "syllabus_headings": f"SELECT DISTINCT doc_id, {S.strip('line')} AS heading FROM {S.lines('documents', 'doc_id')} WHERE starts_with({S.strip('line')}, 'TEMARIO ') AND length({S.strip('line')}) <= 90",
    # a mark is a word of its own before one that begins with a letter
    "clause_counts": """WITH w AS (SELECT DISTINCT id, system, attempt, answer, list_filter(regexp_split_to_array(answer, '\\s+'), lambda t: t <> '') AS w FROM runs WHERE answer IS NOT NULL),
        n AS (SELECT id, system, attempt, len(list_filter(range(1, len(w)), lambda i: regexp_full_match(w[i], '[0-9]+(\\.[0-9]+)*[.)]|[a-z]\\)') AND regexp_matches(w[i + 1], '^\\p{L}')))::INT AS clauses FROM w)
        SELECT DISTINCT id, system, attempt, clauses FROM n WHERE clauses > 0""",
    "section_ends": f"""WITH a AS (SELECT source, seq, count(*) AS articles FROM {S.lines(_V, 'source, seq')} WHERE source IS NOT NULL AND regexp_matches(line, '{_ARTICLE}') GROUP BY ALL)
        SELECT source, seq, articles, lead(seq) OVER (PARTITION BY source ORDER BY seq) AS ends FROM a""",
    "rare_acronyms": "SELECT acronym, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda w: regexp_full_match(w, '[A-Z]{3,6}'))) AS acronym FROM documents WHERE text IS NOT NULL) GROUP BY acronym HAVING count(*) = 1",
    "document_scores": f"""WITH q AS (SELECT id, category, unnest(list_distinct({S.tokens('query')})) AS t FROM question_bank), d AS (SELECT doc_id, category, unnest(list_distinct({S.tokens('text')})) AS t FROM documents WHERE text IS NOT NULL AND category IS NOT NULL),
        s AS (SELECT q.id, d.doc_id, count(*) AS score FROM q JOIN d ON d.category = q.category AND d.t = q.t GROUP BY ALL), b AS (SELECT * FROM s QUALIFY score = max(score) OVER (PARTITION BY id))
        SELECT id, any_value(doc_id) AS doc_id, any_value(score) AS score FROM b GROUP BY id HAVING count(*) = 1 AND any_value(score) >= 5""",
    "tpch_group_share": "SELECT year(l_shipdate) AS year, l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem GROUP BY ROLLUP (year(l_shipdate), l_returnflag, l_linestatus)",
}

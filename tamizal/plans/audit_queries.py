"""Queries of candidates, gates, audits and table shapes, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.functions import predicates as P
from tamizal.functions import text as T
from tamizal.operators import articles as A
from tamizal.operators import evalstats as E
from tamizal.operators import retrieval as R
from tamizal.operators import segments as G
from tamizal.operators import tables as B
from tamizal.plans import eval_queries as EQ
from tamizal.plans import retrieval_queries as RQ
from tamizal.plans import sql as S
from tamizal.plans import table_queries as TQ
from tamizal.session import standing
from tamizal.sources import sinks as K
from tamizal.sources.tables import lines, spread, table, vacantes


def answer_atoms(spark: SparkSession, folder: str) -> DataFrame:
    """The numbers of each bank answer in one form, as multiset."""
    atoms = table(spark, folder, "question_bank").where("gold is not null").select("id", F.explode(T.number_atoms(F.col("gold"))).alias("atom"))
    return atoms.groupBy("id", "atom").agg(F.count("*").alias("times"))


def question_gates(spark: SparkSession, folder: str) -> DataFrame:
    """The gates that each query passes."""
    return table(spark, folder, "queries").select("id", F.array_join(P.gates(F.col("query")), ",").alias("gates")).where("gates <> ''")


def fact_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """By system and status, how the answers' facts agree with the bank's; an answer's source matches if a context names the bank's."""
    bank = table(spark, folder, "question_bank").select("id", "category", "gold", "source")
    r = table(spark, folder, "runs").select("id", "system", "attempt", "query", "answer", "contexts").dropDuplicates(["id", "system", "attempt"]).join(bank, "id")
    resolved = F.coalesce(F.trim("answer") != "", F.lit(False))
    matches = F.coalesce(F.exists("contexts", lambda c: F.contains(c, F.col("source"))), F.lit(False))
    status = P.agreement_status(F.col("category"), resolved, matches, P.fact_agrees(F.col("category"), F.col("query"), F.col("gold"), F.col("answer")))
    return r.groupBy("system", status.alias("status")).agg(F.count("*").alias("runs"))


def override_simulation(spark: SparkSession, folder: str) -> DataFrame:
    """By true category, what reversing the router's verdict on strong evidence mends and spoils."""
    bank = table(spark, folder, "question_bank").select("id", "category")
    r = table(spark, folder, "runs").select("id", "system", "attempt", "router", "pred_category", "ood_override").dropDuplicates(["id", "system", "attempt"]).join(bank, "id")
    by_rule = F.coalesce(F.col("router").startswith("rule:"), F.lit(False))
    return E.override_simulation(r.withColumn("after", P.reversed_verdict(F.col("pred_category"), F.col("ood_override.category"), F.col("ood_override.best_score"), by_rule)), "category", "pred_category", "after")


def router_macro(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and macro-F1 of the rules over the labels of the truth."""
    q = table(spark, folder, "queries").where("categoria_correcta is not null").select("categoria_correcta", P.rule_text(F.col("query")).alias("q")).select("categoria_correcta", P.rule_route(F.col("q")).alias("rule"))
    per = E.precision_recall(q, "categoria_correcta", "rule").where("support > 0")
    right = F.coalesce((F.col("categoria_correcta") == F.col("rule")).cast("int"), F.lit(0))
    return q.agg(F.count("*").alias("queries"), F.round(F.avg(right), 6).alias("accuracy")).crossJoin(per.agg(F.round(F.avg("f1"), 5).alias("macro_f1")))


def complete_systems(spark: SparkSession, folder: str) -> DataFrame:
    """Of each system the bank questions it ran and whether these are all; others are dropped from paired comparisons."""
    bank = table(spark, folder, "question_bank").select("id")
    return table(spark, folder, "runs").join(bank, "id", "left_semi").groupBy("system").agg(F.countDistinct("id").alias("n")).withColumn("complete", F.col("n") == bank.count())


def page_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source, pages with table rows and no prose, as a set difference."""
    v = vacantes(spark, folder, "source", "page", "extraction").where("source is not null and page is not null")
    kind = F.col("extraction").endswith("table_row")
    sets = v.groupBy("source").agg(F.collect_set(F.when(kind, F.col("page"))).alias("tables"), F.collect_set(F.when(~kind, F.col("page"))).alias("prose"))
    return sets.select("source", F.array_join(F.array_sort(F.array_except("tables", "prose")), ",").alias("pages")).where("pages <> ''")


def ruled_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of each source with two or more rows and columns."""
    v = vacantes(spark, folder, "source", "table_no", "cells").where("source is not null and size(cells) > 0")
    return G.ruled_tables(v, ("source", "table_no"), "cells")


def table_like_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of lines that look like table rows, in every segment."""
    return G.table_like_rows(vacantes(spark, folder, "text"), "id", "text").select("id", "line_no", "first_line", F.array_join("cells", "|").alias("cells"))


def table_passages(spark: SparkSession, folder: str) -> DataFrame:
    """A passage for each segment with cells."""
    v = vacantes(spark, folder, "category", "source", "cells", "headers")
    return G.table_passages(v, ("id",), F.col("category"), F.col("source"), "headers", "cells")


def merged_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of each source that are named by the same column, as one."""
    v = vacantes(spark, folder, "source", "text").where("source is not null")
    rows = lines(v, "id", "source").where(F.col("line").rlike("^Tabla [0-9]+ — fila [0-9]+:")).withColumn("tbl", F.regexp_extract("line", "^Tabla ([0-9]+)", 1).cast("int"))
    return B.merged_tables(B.cells(rows, ("source", "tbl", "id", "line_no"), "line"), "source", "tbl", ("id", "line_no"))


def article_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Questions made of the articles in vacantes."""
    return G.article_candidates(lines(vacantes(spark, folder), "id"), ("id", "line_no"), "line").select("id", "line_no", "article", "query")


def line_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the documents with the capital heading before them."""
    l = lines(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").withColumn("line", T.strip(F.col("line")))  # noqa: E741
    return G.line_candidates(l, ("doc_id",), "line_no", "line", F.col("line").rlike("^\\p{Lu}[\\p{Lu} ]{5,}$"), F.col("line").rlike("\\p{L}{3}"))


def dispatched_answers(spark: SparkSession, folder: str) -> DataFrame:
    """For each bank question the answer of its category's resolver, else that of the first other: tables and article headings."""
    q = table(spark, folder, "question_bank").select(F.col("id").alias("key"), "category")
    tables = TQ.bank_answers(spark, folder).select(F.substr("key", F.lit(6)).alias("key"), F.lit("VACANTES").alias("category"), F.concat_ws(" ", "kind", "number").alias("answer"))
    articles = RQ.article_anchor(spark, folder).select(F.col("id").alias("key"), F.lit("REGLAMENTO").alias("category"), F.col("segment").alias("answer"))
    return A.dispatch(q, tables.unionByName(articles))


def rebuilt_states(spark: SparkSession, folder: str) -> DataFrame:
    """The states of documents after a rebuild of their workspaces."""
    return K.rebuilt_states(table(spark, folder, "workspace_documents").select("id", "status"), vacantes(spark, folder, "document_id", "text"))


def invalid_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    """Workspaces that aren't well formed, as their documents show them: how many, by reason."""
    w = table(spark, folder, "workspace_documents").groupBy(F.col("workspace_id").alias("id")).agg(F.min("filename").alias("name"), F.min("pdf_tool").alias("description"))
    return K.invalid_workspaces(w)


def page_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments made anew of vacantes: rows of cells serialized, prose in chunks; texts as digests."""
    v = vacantes(spark, folder, "text", "table_no", "row_no", "cells", "headers")
    s = G.page_segments(v, v.where("coalesce(size(cells), 0) <= 0"), ("id",))
    return s.select("id", "kind", "table_no", "row_no", "chunk_no", F.md5("text").alias("md5"))


def retrieve_all6(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest documents of each category for every fiftieth query, and the six best of these."""
    d = table(spark, folder, "documents").where("category is not null").select("doc_id", "category", "text")
    (rows,) = standing(d, "category_vectors", lambda df: (spread(df).select(F.col("doc_id").alias("k"), "category", R.hashed_vector(F.col("text")).alias("v")),))
    asked = table(spark, folder, "queries").where("id % 50 = 0 and query is not null").select((-F.col("id")).cast("bigint").alias("k"), R.hashed_vector(F.col("query")).alias("v"))
    near = R.dense_top_k(rows, asked, k=3, key="k", vector="v", part="category", every=True).select((-F.col("query")).cast("int").alias("id"), "k", "score").join(rows.select("k", "category"), "k")
    return R.merge_parts(near, "id", "category", "k", "score").select("id", F.col("k").alias("doc_id"), "category", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        answer_atoms, question_gates, fact_agreement, override_simulation, router_macro, complete_systems, page_differences, ruled_tables, table_like_cells, table_passages, merged_tables, article_candidates,
        line_candidates, dispatched_answers, rebuilt_states, invalid_workspaces, page_segments, retrieve_all6,
    )
}

_V = "(SELECT DISTINCT id, source, page, extraction, category, text, table_no, cells, headers, document_id FROM vacantes)"
_N = S.norm("query")
_ART = "^\\s*(?i:Art[íiÍ]culo)\\s+([0-9]+)\\s*[°º]?\\s*[.:–—]?\\s*\\p{Lu}"
_D = "regexp_extract_all(coalesce({}, ''), '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}')"
_I = "list_transform(regexp_extract_all(coalesce({}, ''), '[0-9]+'), lambda i: regexp_replace(i, '^0+([0-9])', '\\1'))"
_NAMED = "regexp_extract({}, 'articulo\\s+0*([0-9]+)', 1)"

_GATED = ", ".join(f"CASE WHEN regexp_matches({_N}, '{pattern}') THEN '{name}' END" for name, pattern in P.GATES)

ORACLES = {
    "answer_atoms": """SELECT id, atom, count(*) AS times FROM (SELECT id, CASE WHEN contains(a, '.') THEN rtrim(rtrim(a, '0'), '.') ELSE a END AS atom FROM (
        SELECT id, regexp_replace(replace(unnest(regexp_extract_all(gold, '[0-9]+(?:[.,][0-9]+)?')), ',', '.'), '^0+([0-9])', '\\1') AS a FROM question_bank WHERE gold IS NOT NULL)) GROUP BY ALL""",
    "question_gates": f"SELECT id, gates FROM (SELECT id, concat_ws(',', {_GATED}) AS gates FROM queries) WHERE gates <> ''",
    "fact_agreement": f"""WITH r AS (SELECT r.system, r.query, r.answer, r.contexts, b.category, b.gold, b.source, {_D.format('b.gold')} AS want, {_D.format('r.answer')} AS got FROM {EQ._RUN} r JOIN question_bank b ON b.id = r.id),
        f AS (SELECT *, coalesce(CASE WHEN len(want) > 0 THEN CASE WHEN contains({S.norm('query')}, 'hasta') THEN list_contains(got, want[-1]) WHEN contains({S.norm('query')}, 'desde') THEN list_contains(got, want[1]) ELSE list_has_all(got, want) END
              WHEN category = 'VACANTES' THEN len({_I.format('gold')}) > 0 AND list_contains({_I.format('answer')}, {_I.format('gold')}[-1])
              WHEN category = 'REGLAMENTO' THEN {_NAMED.format(S.fold('query'))} <> '' AND {_NAMED.format(S.fold('answer'))} = {_NAMED.format(S.fold('query'))} ELSE false END, false) AS agrees,
              coalesce(len(list_filter(contexts, lambda c: contains(c, source))) > 0, false) AS matches, coalesce(trim(answer, ' ') <> '', false) AS resolved FROM r)
        SELECT system, CASE WHEN category = 'FUERA_DE_DOMINIO' THEN 'not_applicable' WHEN NOT resolved THEN 'not_resolved' WHEN NOT matches THEN 'other_source' WHEN NOT agrees THEN 'other_fact' ELSE 'agrees' END AS status, count(*) AS runs FROM f GROUP BY ALL""",
    "override_simulation": f"""WITH r AS (SELECT b.category, r.pred_category AS x, CASE WHEN r.pred_category = 'FUERA_DE_DOMINIO' AND NOT coalesce(starts_with(router, 'rule:'), false) AND ood_override.best_score >= 0.5 THEN ood_override.category ELSE r.pred_category END AS y FROM {EQ._RUN} r JOIN question_bank b ON b.id = r.id),
        g AS (SELECT category, coalesce(x = category, false) AS x, coalesce(y = category, false) AS y FROM r)
        SELECT category, count(*) AS rows, count(*) FILTER (x) AS right_before, count(*) FILTER (y) AS right_after, count(*) FILTER (NOT x AND y) AS mended, count(*) FILTER (x AND NOT y) AS spoilt FROM g GROUP BY category""",
    "router_macro": f"""WITH r AS (SELECT categoria_correcta AS t, rule AS g FROM {EQ._ROUTED} WHERE categoria_correcta IS NOT NULL), l AS (SELECT DISTINCT t AS label FROM r),
        f AS (SELECT label, round(coalesce(2 * h / nullif(s + u, 0), 0), 6) AS f1 FROM (SELECT label, count(*) FILTER (t = label) AS s, count(*) FILTER (g = label) AS u, count(*) FILTER (t = label AND g = label) AS h FROM l, r GROUP BY label))
        SELECT (SELECT count(*) FROM r) AS queries, (SELECT round(avg(coalesce(t = g, false)::INT), 6) FROM r) AS accuracy, (SELECT round(avg(f1), 5) FROM f) AS macro_f1""",
    "complete_systems": "SELECT system, count(DISTINCT id) AS n, count(DISTINCT id) = (SELECT count(*) FROM question_bank) AS complete FROM runs WHERE id IN (SELECT id FROM question_bank) GROUP BY system",
    "page_differences": f"""SELECT source, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM (SELECT source, page FROM {_V} WHERE source IS NOT NULL AND page IS NOT NULL GROUP BY ALL HAVING bool_and(ends_with(extraction, 'table_row'))) GROUP BY source""",
    "ruled_tables": f"""SELECT source, table_no, count(*) AS rows, max(len(cells)) AS columns FROM {_V} WHERE source IS NOT NULL AND len(cells) > 0 AND len(list_filter(cells, lambda c: trim(regexp_replace(coalesce(c, ''), '[\\s\\p{{Z}}]+', ' ', 'g')) <> '')) > 0
        GROUP BY ALL HAVING count(*) >= 2 AND max(len(cells)) >= 2""",
    "table_like_cells": f"""WITH l AS (SELECT id, line_no, {S.strip('line')} AS line FROM {S.lines(_V, 'id')} WHERE regexp_matches({S.strip('line')}, '\\t|\\s{{2,}}')), i AS (SELECT *, line_no - row_number() OVER (PARTITION BY id ORDER BY line_no) AS g FROM l)
        SELECT id, line_no::INT AS line_no, first_line::INT AS first_line, array_to_string(regexp_split_to_array(line, '\\t|\\s{{2,}}'), '|') AS cells FROM (SELECT *, count(*) OVER (PARTITION BY id, g) AS n, min(line_no) OVER (PARTITION BY id, g) AS first_line FROM i) WHERE n >= 2""",
    "table_passages": f"""WITH r AS (SELECT id, category, source, unnest(cells) AS c, unnest(range(len(cells))) AS i, headers FROM {_V} WHERE len(cells) > 0),
        p AS (SELECT id, category, source, i, c, CASE WHEN coalesce(trim(headers[i + 1], ' '), '') <> '' THEN headers[i + 1] WHEN i = 0 THEN 'Item' ELSE 'Dato ' || i END AS h FROM r WHERE coalesce(trim(c, ' '), '') <> ''),
        t AS (SELECT id, concat_ws(' | ', category, source, string_agg(h || ': ' || c, '; ' ORDER BY i)) AS passage FROM p GROUP BY id, category, source) SELECT id, passage FROM t WHERE length(passage) >= 20""",
    "merged_tables": f"""WITH raw AS (SELECT source, id, line_no, regexp_extract(line, '^Tabla ([0-9]+)', 1)::INT AS tbl, regexp_replace(line, '^\\s*Tabla\\s+[0-9]+\\s*[—-]\\s*fila\\s+[0-9]+\\s*:\\s*', '') AS body FROM {S.lines(_V, 'source, id')} WHERE source IS NOT NULL AND regexp_matches(line, '^Tabla [0-9]+ — fila [0-9]+:')),
        c AS (SELECT * EXCLUDE (a, b), {S.strip('a')} AS label, {S.strip('b')} AS value FROM (SELECT source, tbl, id, line_no, unnest(regexp_extract_all(body, {TQ._F}, 1)) AS a, unnest(regexp_extract_all(body, {TQ._F}, 2)) AS b, unnest(range(len(regexp_extract_all(body, {TQ._F}, 1)))) AS place FROM raw) WHERE {S.strip('a')} <> '' AND {S.strip('b')} <> ''),
        f AS (SELECT source, tbl, id, line_no, label, arg_min(value, place) AS value FROM c GROUP BY ALL), p AS (SELECT source, tbl, label, count(*) AS n, count(*) FILTER (t) AS texty, count(DISTINCT {S.norm('value')}) FILTER (t) AS d FROM (SELECT *, regexp_matches(value, '\\p{{L}}{{3,}}') AND NOT regexp_full_match(value, '[0-9]{{1,18}}') AS t FROM f) GROUP BY ALL),
        s AS (SELECT source, tbl, count(DISTINCT (id, line_no)) AS m FROM c GROUP BY ALL),
        e AS (SELECT source, tbl, label AS entity_label, m FROM p JOIN s USING (source, tbl) WHERE m >= 2 AND n >= 0.5 * m AND texty >= 0.6 * n AND texty > 0 AND d / texty >= 0.5 QUALIFY row_number() OVER (PARTITION BY source, tbl ORDER BY d / texty DESC, label) = 1)
        SELECT source, entity_label, sum(m)::BIGINT AS rows, count(*) AS tables FROM e GROUP BY ALL""",
    "line_candidates": f"""WITH l AS (SELECT doc_id, line_no::INT AS line_no, {S.strip('line')} AS line FROM {S.lines('documents', 'doc_id')}), h AS (SELECT *, regexp_matches(line, '^\\p{{Lu}}[\\p{{Lu}} ]{{5,}}$') AS head FROM l),
        c AS (SELECT *, last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM h)
        SELECT doc_id, line_no, heading, line AS item FROM c WHERE NOT head AND heading IS NOT NULL AND regexp_matches(line, '\\p{{L}}{{3}}')""",
    "dispatched_answers": f"""WITH a AS (SELECT split_part(key, '|', 2) AS key, 'VACANTES' AS category, kind || ' ' || number AS answer, 2 AS turn FROM ({TQ.ORACLES['table_answers']}) WHERE starts_with(key, 'bank|') UNION ALL SELECT id, 'REGLAMENTO', segment, 4 FROM ({RQ.ORACLES['article_anchor']}))
        SELECT key, a.category, answer FROM a JOIN question_bank b ON b.id = a.key QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN b.category = a.category THEN 0 ELSE turn END) = 1""",
    "rebuilt_states": f"SELECT id, CASE WHEN status = 'ready' AND id NOT IN (SELECT document_id FROM {_V} WHERE document_id IS NOT NULL AND trim(text, ' ') <> '') THEN 'error' ELSE status END AS status FROM workspace_documents",
    "invalid_workspaces": """SELECT id, reason FROM (SELECT workspace_id AS id, CASE WHEN NOT coalesce(regexp_full_match(workspace_id, '[0-9a-f]{32}'), false) THEN 'id' WHEN NOT length(trim(coalesce(min(filename), ''), ' ')) BETWEEN 1 AND 120 THEN 'name'
        WHEN NOT length(trim(coalesce(min(pdf_tool), ''), ' ')) BETWEEN 1 AND 800 THEN 'description' END AS reason FROM workspace_documents GROUP BY workspace_id) WHERE reason IS NOT NULL""",
    "page_segments": f"""WITH v AS (SELECT DISTINCT id, text, table_no, row_no, cells, headers FROM vacantes), r AS (SELECT id, table_no, row_no, unnest(cells) AS c, unnest(range(len(cells))) AS i, headers FROM v WHERE len(cells) > 0),
        p AS (SELECT id, table_no, row_no, i, c, CASE WHEN coalesce(trim(headers[i + 1], ' '), '') <> '' THEN headers[i + 1] WHEN i = 0 THEN 'Item' ELSE 'Dato ' || i END AS h FROM r WHERE coalesce(trim(c, ' '), '') <> ''),
        w AS (SELECT id, list_filter(string_split(regexp_replace(text, '[\\s\\p{{Z}}\\x{{85}}\\x0b]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM v WHERE text IS NOT NULL AND coalesce(len(cells), 0) = 0),
        c AS (SELECT id, list_filter(list_transform(range(0, len(w), 180), lambda i: array_to_string(w[i + 1:i + 200], ' ')), lambda x: length(x) > 20) AS cs FROM w)
        SELECT id, 'table_row' AS kind, table_no, row_no, NULL::INT AS chunk_no, md5('Tabla ' || table_no || ' — fila ' || row_no || ': ' || string_agg(h || ': ' || c, ' | ' ORDER BY i)) AS md5 FROM p GROUP BY id, table_no, row_no
        UNION ALL SELECT id, 'prose_chunk', NULL, NULL, chunk_no::INT, md5(chunk) FROM (SELECT id, unnest(cs) AS chunk, unnest(range(len(cs))) AS chunk_no FROM c)""",
    "retrieve_all6": f"""WITH {RQ._hashed_sql(100_000_000, "(SELECT doc_id, category, text FROM documents WHERE category IS NOT NULL)")},
        parts AS (SELECT d.id, d.doc_id, c.category, d.score FROM dense d JOIN documents c ON c.doc_id = d.doc_id QUALIFY row_number() OVER (PARTITION BY d.id, c.category ORDER BY d.score DESC, d.doc_id) <= 3)
        SELECT id, doc_id, category, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM parts QUALIFY rank <= 6""",
}

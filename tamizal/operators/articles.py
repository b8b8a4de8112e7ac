"""Positional answers: an article's whole text, date cells, outlines, quantitative tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions import text as T
from tamizal.operators.evalstats import running
from tamizal.operators.segments import next_boundary


def article_texts(lines: DataFrame) -> DataFrame:
    """source, article, page, seq, line_no of its heading, text, pages and lines of each article, and whole, its lines as they stand.

    lines: source, page, seq, line_no, line. An article goes on, also over pages,
    until the next heading. Lines look back for their heading inside their page
    only; what a page inherits comes from one row for each page, so no task orders a source's lines.
    """
    head = F.when(T.is_article_heading(F.col("line")), F.struct("page", "seq", "line_no", F.regexp_extract("line", T.ARTICLE_START, 1).cast("int").alias("article")))
    l = lines.where("source is not null and page is not null").withColumn("head", head)  # noqa: E741
    here = Window.partitionBy("source", "page").orderBy("seq", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("own", F.last("head", ignorenulls=True).over(here))  # noqa: E741
    last = l.groupBy("source", "page").agg(F.max(F.col("head")).alias("last"))
    before = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    inherited = last.select("source", "page", F.last("last", ignorenulls=True).over(before).alias("inherited"))
    owned = l.join(inherited, ["source", "page"]).withColumn("at", F.coalesce("own", "inherited")).where("at is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", "line_no", "line"))), lambda x: x["line"]), "\n")
    whole = owned.groupBy("source", "at").agg(text.alias("text"), F.countDistinct("page").alias("pages"), F.count("*").alias("lines"))
    return whole.select("source", F.col("at.article").alias("article"), F.col("at.page").alias("page"), F.col("at.seq").alias("seq"), F.col("at.line_no").alias("line_no"), T.drop_trailing_artifact(T.cut_at_next_heading(F.col("text"))).alias("text"), F.col("text").alias("whole"), "pages", "lines")


def date_cells(questions: DataFrame, rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, item and answer of the questions that name one row of a schedule: its item by an alias, and all words of its heading.

    questions: id, query. rows: heading, item, dates (array of day/month/year). aliases: item, alias, in
    normal form. A question about the end gets the last date, about the beginning
    the first, otherwise two dates are a span. More than one row gives no answer.
    """
    q = questions.select("id", T.norm(F.col("query")).alias("asked"))
    words = F.split("asked", " ")
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    named = q.select("id", "asked", F.explode(F.array_distinct(runs)).alias("alias")).join(F.broadcast(aliases), "alias").select("id", "asked", "item").distinct()
    heading = F.filter(F.split(T.norm(F.col("heading")), " "), lambda t: ~t.isin("examen", "de", "del", ""))
    near = named.join(rows.select("heading", "item", "dates", heading.alias("terms")), "item").where((F.size("terms") > 0) & (F.size(F.array_except("terms", F.split("asked", " "))) == 0) & (F.size("dates") > 0))
    one = near.groupBy("id").agg(F.count("*").alias("n"), F.first(F.struct("asked", "item", "heading", "dates")).alias("r")).where("n = 1").select("id", "r.*")
    answer = (
        F.when(F.col("asked").rlike(r"\b(hasta|ultimo|finaliza|cierra)\b"), F.element_at("dates", -1))
        .when(F.col("asked").rlike(r"\b(desde|inicia|empieza|comienza)\b"), F.element_at("dates", 1))
        .when(F.size("dates") == 2, F.concat(F.lit("Del "), F.element_at("dates", 1), F.lit(" al "), F.element_at("dates", 2)))
        .otherwise(F.element_at("dates", 1))
    )
    return one.select("id", "item", "heading", answer.alias("answer"))


def days_apart(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """key and the absolute days between the answers of two date questions."""
    a, b = first.select(key, F.col("answer").alias("a")), second.select(key, F.col("answer").alias("b"))
    return a.join(b, key).select(key, T.days_between(F.col("a"), F.col("b")).alias("days")).where("days is not null")


def outline(rows: DataFrame, by: tuple[str, ...], order: str, text: str, parent: Column, numbered: str = r"^[0-9]+(\.[0-9]+)*[.)]?\s") -> DataFrame:
    """by, order of each parent row, its text, and the numbered headings under it up to the next parent."""
    p = next_boundary(rows.withColumn("parent_", parent), by, order, F.col("parent_")).where("parent_")
    items = rows.where(F.col(text).rlike(numbered)).select(*by, F.col(order).alias("at_"), F.col(text).alias("item_"))
    # a child's parent is the last one before it: carried forward, not searched pairwise
    w = Window.partitionBy(*by).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    both = items.withColumn("kind_", F.lit(1)).unionByName(p.select(*by, F.col(order).alias("at_"), F.lit(None).cast("string").alias("item_"), F.lit(0).alias("kind_")))
    child = both.withColumn("owner_", F.last(F.when(F.col("kind_") == 0, F.col("at_")), ignorenulls=True).over(w)).where("kind_ = 1 and owner_ is not null and at_ > owner_")
    lists = child.groupBy(*by, F.col("owner_").alias(order)).agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", "item_"))), lambda x: x["item_"]).alias("items"))
    return p.select(*by, order, text).join(lists, [*by, order])


def quantitative(c: DataFrame, tbl: tuple[str, ...], row: str) -> DataFrame:
    """tbl and lines of the tables with two or more numeric rows (two numbers or more each) that are half of all rows; cells: tbl, row, place, label, value."""
    number = F.col("value").rlike("^[0-9]+(?:[.,][0-9]+)?$")
    r = c.groupBy(*tbl, row).agg(F.sum(number.cast("int")).alias("numbers"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label", "value"))), lambda x: F.concat(x["label"], F.lit(": "), x["value"])), "; ").alias("line"))
    t = r.groupBy(*tbl).agg(F.count("*").alias("rows"), F.sum((F.col("numbers") >= 2).cast("int")).alias("numeric"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("numbers") >= 2, F.struct(row, "line")))), lambda x: x["line"]), "\n").alias("lines"))
    return t.where("numeric >= 2 and numeric >= 0.5 * rows").select(*tbl, "numeric", "lines")


def source_page_hits(runs: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """key and whether one of the contexts (array of struct source, page) is the expected source and page."""
    e = expected.select(key, F.col("source").alias("want_source"), F.col("page").alias("want_page"))
    return runs.join(e, key).select(key, F.exists("contexts", lambda c: (c["source"] == F.col("want_source")) & (c["page"] == F.col("want_page"))).alias("hit"))


def seeded_order(df: DataFrame, by: tuple[str, ...], keys: tuple[str, ...], seed: int) -> DataFrame:
    """df with place: a shuffle within by that only seed and keys decide; ranges of the order are numbered in many tasks."""
    order = F.md5(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)))
    return running(df.withColumns({"order_": order, "one_": F.lit(1)}), by, ("order_", *keys), "one_").withColumnRenamed("upto", "place").drop("order_", "one_")


def event_date(dates: Column, asked: Column) -> Column:
    """The one date of a schedule item, or the one a question in normal form asks for: the last or the first; null where several remain."""
    return F.when(F.size(dates) == 1, F.element_at(dates, 1)).when((F.size(dates) > 1) & asked.rlike(r"\b(ultimo|hasta|finaliza|cierra|cierre)\b"), F.element_at(dates, -1)).when((F.size(dates) > 1) & asked.rlike(r"\b(primer|desde|inicia|abren|empieza)\b"), F.element_at(dates, 1))


def topic_sections(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """key, row and text of the questions whose quoted topic is the heading of exactly one row (row, heading, text)."""
    q = questions.select("key", T.norm(T.quoted_topic(F.col("query"))).alias("topic")).where("topic <> ''")
    hit = q.join(rows.select("row", T.norm(F.col("heading")).alias("topic"), "text"), "topic")
    return hit.groupBy("key").agg(F.count("*").alias("n"), F.first(F.struct("row", "text")).alias("r")).where("n = 1").select("key", "r.row", "r.text")


# fixed values: the categories whose resolvers are tried after the routed one's
CATEGORY_ORDER = ("CRONOGRAMA", "VACANTES", "TEMARIO", "REGLAMENTO")


def dispatch(questions: DataFrame, answers: DataFrame, key: str = "key", routed: str = "category") -> DataFrame:
    """key, category and answer: of each question's answers (key, category, answer) that of its routed category, else that of the first in order."""
    order = F.array_position(F.array(*(F.lit(c) for c in CATEGORY_ORDER)), F.col("category"))
    both = questions.select(key, F.col(routed).alias("routed")).join(answers.select(key, "category", "answer"), key).where(order > 0)
    turn = F.when(F.col("category").eqNullSafe(F.col("routed")), 0).otherwise(order)
    return both.groupBy(key).agg(F.min_by(F.struct("category", "answer"), F.struct(turn, "answer")).alias("x")).select(key, "x.category", "x.answer")

"""Questions over serialized tables, answered only where the answer is unique.

A table is rows (tbl, row, entity) with cells (tbl, row, entity, label, grp, item,
value, number). Every operator ends in a uniqueness guard: where two readings
remain there is no row in the result instead of a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions import text as T
from tamizal.operators.retrieval import ranked

# fixed values: words of a header that say nothing about its subject
LABEL_NOISE = "de del la el vacantes vacante proceso general estudios programa".split()
#: Cells of these labels name a row's place, not a quantity.
ROW_KEYS = ("programa de estudios", "programa", "facultad", "area", "sede", "item")


def cells(rows: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    """keys, place, label, grp, item, value, number: every labelled value of serialized rows."""
    f = rows.select(*keys, F.posexplode(T.fields(F.col(text))).alias("place", "f"))
    label = F.col("f.label")
    return f.select(*keys, "place", label.alias("label"), T.group_of(label).alias("grp"), T.item_of(label).alias("item"), F.col("f.value").alias("value"), T.number(F.col("f.value")).alias("number"))


def entity_labels(c: DataFrame, tbl: tuple[str, ...], row: tuple[str, ...]) -> DataFrame:
    """tbl and label: the column that names the rows, mostly text and with the most distinct values; tables of one row have none."""
    first = c.groupBy(*tbl, *row, "label").agg(F.min_by("value", "place").alias("value"))
    texty = F.col("value").rlike("\\p{L}{3,}") & T.number(F.col("value")).isNull()
    per = first.groupBy(*tbl, "label").agg(F.count("*").alias("n"), F.sum(texty.cast("int")).alias("texty"), F.countDistinct(F.when(texty, T.norm(F.col("value")))).alias("distinct"))
    size = c.select(*tbl, *row).distinct().groupBy(*tbl).agg(F.count("*").alias("rows"))
    ok = per.join(size, list(tbl)).where("rows >= 2 and n >= 0.5 * rows and texty >= 0.6 * n and texty > 0").withColumn("score", F.col("distinct") / F.col("texty")).where("score >= 0.5")
    return ranked(ok, list(tbl), [F.desc("score"), F.asc("label")], 1).select(*tbl, F.col("label").alias("entity_label"))


def _core(label: Column) -> Column:
    """The stems of a header's words, whole noise words left out before they are cut."""
    words = F.filter(F.split(T.norm(label), " "), lambda t: (t != "") & ~F.array_contains(F.array(*(F.lit(x) for x in LABEL_NOISE)), t))
    return F.array_distinct(F.transform(words, lambda t: F.substring(t, 1, 6)))


def label_score(label: Column, query_stems: Column) -> Column:
    """How well a query's stems name a header path; null if they don't.

    The item's own words must all be asked for; a bare total needs the word
    total, and without own words the group must be named. Words of the item
    count twice, of a named group once, an asked total once.
    """
    item, group = _core(T.item_of(label)), _core(T.group_of(label))
    has_total = F.array_contains(item, "total")
    core = F.filter(item, lambda t: t != "total")
    within = lambda a: F.size(F.array_except(a, query_stems)) == 0
    asked_total = F.array_contains(query_stems, "total")
    n, g = F.size(core), F.size(group)
    points = 2 * n + F.when((g > 0) & within(group), g).otherwise(0) + F.when(has_total & asked_total, 1).otherwise(0)
    fails = (has_total & (n == 0) & ~asked_total) | ((n > 0) & ~within(core)) | ((n == 0) & ~has_total) | ((g > 0) & (n == 0) & ~within(group))
    return F.when(~fails, points)


def unique_cell(candidates: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, label and number of the best-scored cell, where the best score belongs to one label and number only."""
    best = candidates.withColumn("top", F.max("score").over(Window.partitionBy(*by))).where("score = top")
    one = best.groupBy(*by).agg(F.countDistinct("label", "number").alias("readings"), F.first("label").alias("label"), F.first("number").alias("number"))
    return one.where("readings = 1").drop("readings")


def unique_reading(c: DataFrame, by: tuple[str, ...], number: str = "number") -> DataFrame:
    """by and number, for those with one reading only."""
    one = c.where(F.col(number).isNotNull()).groupBy(*by).agg(F.min(number).alias("low"), F.max(number).alias("number"))
    return one.where("low = number").drop("low")


def superlative(readings: DataFrame, by: tuple[str, ...], most: bool = True) -> DataFrame:
    """All rows that share the greatest (or least) number of their by."""
    order = F.desc("number") if most else F.asc("number")
    return readings.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(order))).where("place = 1").drop("place")


def nonzero_sum(readings: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """By by: how many rows have a number above zero, and their sum."""
    return readings.where("number > 0").groupBy(*by).agg(F.count("*").alias("rows"), F.sum("number").alias("total"))


def compare(readings: DataFrame, by: tuple[str, ...], entity: str, a: Column, b: Column) -> DataFrame:
    """by, both numbers and their absolute difference, where both rows have a reading."""
    x = readings.where(F.col(entity) == a).select(*by, F.col("number").alias("first"))
    y = readings.where(F.col(entity) == b).select(*by, F.col("number").alias("second"))
    return x.join(y, list(by)).withColumn("difference", F.abs(F.col("first") - F.col("second")))


def reverse_lookup(readings: DataFrame, by: tuple[str, ...], entity: str, value: Column) -> DataFrame:
    """By by: the entities with exactly this number, in order."""
    return readings.where(F.col("number") == value).groupBy(*by, "number").agg(F.count("*").alias("rows"), F.min(entity).alias("first_entity"), F.max(entity).alias("last_entity"))


def group_totals(c: DataFrame, row: tuple[str, ...]) -> DataFrame:
    """Of every row and group of columns: its own total column if there is one, else the sum of its columns."""
    n = c.where("grp <> '' and number is not null")
    own = F.array_contains(F.split(T.norm(F.col("item")), " "), "total")
    return n.groupBy(*row, "grp").agg(F.coalesce(F.min_by("number", F.when(own, F.col("place"))), F.sum("number")).alias("total"), F.max(own.cast("int")).alias("has_total"), F.count("*").alias("columns"))


def grand_totals(c: DataFrame, row: tuple[str, ...]) -> DataFrame:
    """Of every row its grand total: as written, as the sum of its groups' totals, the repaired one, and whether they agree."""
    grand = c.where((F.col("grp") == "") & F.array_contains(F.split(T.norm(F.col("label")), " "), "total")).groupBy(*row).agg(F.min_by(F.struct("number", "label"), "place").alias("g"))
    sums = group_totals(c, row).groupBy(*row).agg(F.sum("total").alias("parts"))
    both = sums.join(grand, list(row), "left").select(*row, "parts", F.col("g.label").alias("label"), F.col("g.number").alias("written"))
    return both.withColumn("total", F.coalesce("written", F.when(F.col("label").isNotNull(), F.col("parts")))).withColumn("consistent", F.col("written") == F.col("parts"))


def merged_tables(c: DataFrame, source: str, table: str, row: tuple[str, ...]) -> DataFrame:
    """source, entity_label and rows: the tables of a source whose rows are named by the same column count as one."""
    named = entity_labels(c, (source, table), row)
    return c.select(source, table, *row).distinct().join(named, [source, table]).groupBy(source, "entity_label").agg(F.count("*").alias("rows"), F.countDistinct(table).alias("tables"))

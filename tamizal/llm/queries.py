"""The queries of this subpackage, over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.llm import boilerplate, bpe, confusables, mojibake, packing, percentiles, pii, qa_pairs
from tamizal.session import materialize
from tamizal.sources.tables import spread

PROBS = (0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table's columns, over all cores where its files make fewer partitions than that."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows.select(*columns)) if columns else rows


def _day_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.summarize(_table(spark, folder, "runs"), ["run_day", "pred_category"], "elapsed_s")


def _periods(day: Column) -> Column:
    """The periods that a day belongs to."""
    return F.array(
        F.struct(F.lit("day").alias("period"), day.alias("begins")),
        F.struct(F.lit("month").alias("period"), F.trunc(day, "month").alias("begins")),
        F.struct(F.lit("all").alias("period"), F.lit(None).cast("date").alias("begins")),
    )


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of elapsed_s by pred_category for each day, month and over all days: months from the days' summaries, all days from the months'."""
    parts = ["pred_category", "tail", "levels", "n", "err"]
    days = materialize(_day_summaries(spark, folder), "days")
    months = materialize(percentiles.merge_tree(days.select(F.trunc("run_day", "month").alias("month"), *parts), ["month", "pred_category"]), "months")
    whole = percentiles.merge_tree(months.select(*parts), ["pred_category"])
    kinds = (("day", days, F.col("run_day")), ("month", months, F.col("month")), ("all", whole, F.lit(None).cast("date")))
    every = [df.select(F.lit(name).alias("period"), begins.alias("begins"), *parts) for name, df, begins in kinds]
    return percentiles.percentiles(every[0].unionByName(every[1]).unionByName(every[2]), PROBS)


def p1_day_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of elapsed_s by run_day and pred_category."""
    return percentiles.percentiles(_day_summaries(spark, folder), PROBS)


def p1_rank_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Of each percentile of p1_percentiles, the values counted and whether its true rank lies within the stated bound, by counting all runs anew.

    Each value is held against the percentiles of its group and period, of which there are as many as PROBS.
    """
    found = materialize(p1_percentiles(spark, folder), "percentiles")
    runs = _table(spark, folder, "runs", "run_day", "pred_category", "elapsed_s").where("elapsed_s is not null and not isnan(elapsed_s)")
    each = runs.select("pred_category", F.col("elapsed_s").alias("v"), F.explode(_periods(F.col("run_day"))).alias("p")).select("p.*", "pred_category", "v")
    lists = found.groupBy("period", "begins", "pred_category").agg(F.collect_list(F.struct("q", "value", "n", "rank_error")).alias("found"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("period", "begins", "pred_category")]
    pairs = each.alias("e").join(lists.alias("l"), same[0] & same[1] & same[2]).select("e.period", "e.begins", "e.pred_category", "v", F.explode("l.found").alias("f"))
    ranks = pairs.groupBy("period", "begins", "pred_category", "f").agg(F.sum((F.col("v") < F.col("f.value")).cast("long")).alias("below"), F.sum((F.col("v") <= F.col("f.value")).cast("long")).alias("upto"))
    target = F.greatest(F.lit(1), F.ceil(F.round(F.col("f.q") * F.col("f.n"), 9)))
    within = (F.col("below") + 1 - F.col("f.rank_error") <= target) & (target <= F.col("upto") + F.col("f.rank_error"))
    return ranks.select("period", "begins", "pred_category", "f.q", "f.n", within.alias("within"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Vacantes ids whose text holds wrongly decoded characters."""
    return mojibake.damaged_keys(_table(spark, folder, "vacantes", "id", "text"))


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The damaged vacantes with the text as it was, as far as it can be restored."""
    return mojibake.repaired(_table(spark, folder, "vacantes", "id", "text")).where("damaged").select("id", "text").dropDuplicates(["id"])


def _repeated(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.repeated_lines(_table(spark, folder, "vacantes", "id", "text", "source"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of vacantes that stand in a large share of their source."""
    return _repeated(spark, folder)


def p3_near(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of vacantes that are other wordings of a line that stands, with these, in a large share of the source."""
    return boilerplate.near_lines(_table(spark, folder, "vacantes", "id", "text", "source"))


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Each vacantes id with its text freed of the lines repeated within its source."""
    return boilerplate.without_repeated(_table(spark, folder, "vacantes", "id", "text"), _repeated(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs whose answer is no proper reply to its query, with the type of the defect."""
    return qa_pairs.defects(_table(spark, folder, "runs"), topic="pred_category")


def _spellings(spark: SparkSession, folder: str, tbl: str) -> DataFrame:
    """The rows of a table whose text is spelled in several ways; damaged texts form no pairs, so those among them go."""
    if tbl == "queries":
        return confusables.spelled_differently(_table(spark, folder, "queries"), "id", "query")
    vacantes = _table(spark, folder, "vacantes", "id", "text")
    rows = confusables.spelled_differently(vacantes, "id", "text")
    damaged = mojibake.damaged_keys(vacantes, only=rows.select(F.col("key").alias("id")))
    return materialize(rows.join(damaged.select(F.col("id").alias("key")), "key", "left_anti"), "sound")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of queries and pairs of vacantes that read the same but are spelled with other characters; damaged texts form none."""
    found = [confusables.pairs(_spellings(spark, folder, tbl)).select(F.lit(tbl).alias("tbl"), "key_a", "key_b") for tbl in ("queries", "vacantes")]
    return found[0].unionByName(found[1])


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Of each query and segment whose text is spelled in several ways, its class: the least key of those that read the same, and how many there are."""
    found = [confusables.classes(_spellings(spark, folder, tbl)).withColumn("tbl", F.lit(tbl)) for tbl in ("queries", "vacantes")]
    return found[0].unionByName(found[1])


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every text of queries and vacantes."""
    asked = _table(spark, folder, "queries").select(F.lit("queries").alias("tbl"), F.col("id").cast("string").alias("key"), F.col("query").alias("text"))
    segments = _table(spark, folder, "vacantes", "id", "text").select(F.lit("vacantes").alias("tbl"), F.col("id").alias("key"), "text").distinct()
    return confusables.with_form(asked.unionByName(segments), "text", "form").select("tbl", "key", "form")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_corpus(_table(spark, folder, "documents", "doc_id", "text"))


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of every document's text as its ids give it back."""
    return bpe.decode_corpus(p6_ids(spark, folder)).select("doc_id", F.md5("text").alias("md5"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's parts and their containers, for each capacity of context_windows."""
    return packing.pack(bpe.count_tokens(_table(spark, folder, "documents", "doc_id", "text")), _table(spark, folder, "context_windows"))


def p7_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used and their fill, for each capacity of context_windows."""
    return packing.summary(p7_containers(spark, folder), _table(spark, folder, "context_windows"))


def p7_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Of each capacity: all documents, whether every token is in a container, and how many containers overflow or documents are divided though they fit."""
    sizes = materialize(bpe.count_tokens(_table(spark, folder, "documents", "doc_id", "text")), "tokens")
    windows = _table(spark, folder, "context_windows")
    found = packing.audit(packing.pack(sizes, windows), sizes, windows)
    return found.select("window_name", "items", (F.col("held") == F.col("tokens")).alias("complete"), "overflowing", "divided")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents in which an item of personal information begins, by kind."""
    return pii.find(_table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "line_no", "kind").distinct()


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every item of personal information with its place and kind."""
    return pii.find(_table(spark, folder, "documents", "doc_id", "text"))


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with typed placeholders for its personal information."""
    return pii.find(_table(spark, folder, "documents", "doc_id", "text"), redact=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_percentiles, p1_day_percentiles, p1_rank_bounds, p2_found, p2_repaired, p3_found, p3_near, p3_cleaned, p4_found, p5_found, p5_classes, p5_forms, p6_ids, p6_decoded, p7_containers, p7_summary, p7_audit, p8_found, p8_items, p8_redacted)
}

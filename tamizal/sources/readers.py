"""Readers: segments, runs, page files, CSV banks, uploads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SEGMENT = "id string, seq bigint, text string, source string, page int, category string, extraction string, table_no int, row_no int, chunk_no int, workspace_id string, document_id string, cells array<string>, headers array<string>"
RUN = "id string, system string, query string, answer string, contexts array<string>, phase string, router string, pred_category string, ood_override struct<category:string,best_score:double>, verbalizer string, error string, elapsed_s double"


def read_segments(spark: SparkSession, folder: str, categories: Sequence[str]) -> DataFrame:
    """Segments of the categories, from a table partitioned by category; a category that isn't there gives no rows."""
    return spark.read.schema(SEGMENT).parquet(folder).where(F.col("category").isin(list(categories)))


def read_index_json(spark: SparkSession, folder: str, categories: Sequence[str]) -> DataFrame:
    """Segments from one JSON array file for each category; a missing file is skipped, not an error."""
    names = [f"{folder}/{c}.json" for c in categories]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [n for n in names if jvm.org.apache.hadoop.fs.Path(n).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(n))]
    if not there:
        return spark.createDataFrame([], SEGMENT)
    return spark.read.schema(SEGMENT).json(there, multiLine=True)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs from JSON lines; of lines with one id and system the last counts, by file and place in it. Broken lines are left out."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")).where(F.trim("value") != "")
    rows = raw.select(F.from_json("value", RUN).alias("r"), "file", "place").where("r.id is not null")
    return rows.groupBy("r.id", "r.system").agg(F.max_by("r", F.struct("file", "place")).alias("r")).select("r.*")


def read_pages_json(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One JSON file for each page, with the page number from its name (page_12.json); fails if there is none."""
    pages = spark.read.schema(schema).json(glob, multiLine=True).select("*", F.regexp_extract("_metadata.file_name", "page_0*([0-9]+)", 1).cast("int").alias("page_no"))
    if pages.isEmpty():
        raise FileNotFoundError(glob)
    return pages


def read_bank_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV bank with a header; a byte-order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_text_layers(spark: SparkSession, glob: str) -> DataFrame:
    """file, page (from 1) and text of extracted text layers, pages cut at form feeds."""
    from tamizal.operators.segments import split_pages

    raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(split_pages(F.col("value"))).alias("at", "text"))
    return raw.select("file", (F.col("at") + 1).alias("page"), "text")


def read_pdf_pages(spark: SparkSession, glob: str, extract, schema: str = "file string, page int, text string") -> DataFrame:
    """Pages of PDF files through an extractor: a function of (name, bytes) that yields (page, text), or none if it fails."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            rows = [(name, page, text) for name, content in zip(pdf["name"], pdf["content"]) for page, text in extract(name, bytes(content)) or ()]
            yield pd.DataFrame(rows, columns=["file", "page", "text"])

    return spark.read.format("binaryFile").load(glob).select(F.col("_metadata.file_name").alias("name"), "content").mapInPandas(run, schema)


def validate_uploads(uploads: DataFrame, known: DataFrame, most_bytes: int = 50 << 20, most_pages: int = 500) -> DataFrame:
    """uploads (name, content, pages) with sha256 and verdict: accepted, or why not. The first of equal new files is taken, by name.

    known: sha256 of the documents already there.
    """
    u = uploads.withColumn("sha256", F.sha2("content", 256))
    seen = known.select("sha256", F.lit(True).alias("known")).distinct()
    first = u.groupBy("sha256").agg(F.min("name").alias("first_name"))
    checked = u.join(seen, "sha256", "left").join(first, "sha256")
    magic: Column = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    verdict = (
        F.when(~magic, "no_pdf").when(F.length("content") > most_bytes, "too_large").when(F.col("pages") > most_pages, "too_many_pages")
        .when(F.col("known").isNotNull() | (F.col("name") != F.col("first_name")), "duplicate").otherwise("accepted")
    )
    return checked.select("name", "pages", "sha256", verdict.alias("verdict"))


def freeze_mismatches(spark: SparkSession, glob: str, sealed: DataFrame) -> DataFrame:
    """Files whose digest differs from the sealed one (name, sha256), or that are missing or new."""
    now = spark.read.format("binaryFile").load(glob).select(F.col("_metadata.file_name").alias("name"), F.sha2("content", 256).alias("now"))
    return sealed.join(now, "name", "full").where(~F.col("sha256").eqNullSafe(F.col("now")))


def one_to_one(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Both sides joined on a key that must be unique on each; other columns get the suffixes. Fails on a repeated key."""
    def unique(df: DataFrame, suffix: str) -> DataFrame:
        named = df.select(key, *(F.col(c).alias(c + suffix) for c in df.columns if c != key))
        from pyspark.sql import Window

        n = F.count("*").over(Window.partitionBy(key))
        return named.withColumn("n_", n).withColumn(key, F.when(F.col("n_") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast(dict(df.dtypes)[key]))).drop("n_")

    return unique(left, suffixes[0]).join(unique(right, suffixes[1]), key)


def intake_status(accepted: DataFrame, ocr_pages: str = "ocr_pages", consent: str = "consent") -> DataFrame:
    """accepted uploads with status: those with pages to be recognized wait for consent or are recognized, the others are processed."""
    needs = F.coalesce(F.col(ocr_pages), F.lit(0)) > 0
    return accepted.withColumn("status", F.when(needs & ~F.coalesce(F.col(consent), F.lit(False)), "awaiting_ocr_consent").when(needs, "processing_ocr").otherwise("processing"))


def paired(a: DataFrame, b: DataFrame, key: str, equal: str) -> DataFrame:
    """Rows of two runs with one key, columns suffixed _a and _b; fails where the column equal differs."""
    both = one_to_one(a, b, key)
    same = F.col(f"{equal}_a").eqNullSafe(F.col(f"{equal}_b"))
    return both.withColumn(f"{equal}_a", F.when(same, F.col(f"{equal}_a")).otherwise(F.raise_error(F.concat(F.lit(f"{equal} differs for "), F.col(key).cast("string"))).cast(dict(both.dtypes)[f"{equal}_a"])))

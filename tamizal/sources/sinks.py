"""Writers: indexes, manifests, review sheets, resumable logs, retention."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_atomically(df: DataFrame, path: str) -> None:
    """Write a new version of the table beside the present one and turn the pointer to it; read with read_replaced.

    The pointer is one file that is replaced by a rename that overwrites, so a reader finds the old version or the new one at any moment.
    The version before stays for those who still read it; older ones go.
    """
    spark = df.sparkSession
    before = _version(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
    write_bytes(spark, f"{path}/next-{version}", version.encode())
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = overwrite
    context.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/next-{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT"), how)
    _, fs = _fs(spark, path)
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def read_replaced(spark: SparkSession, path: str) -> DataFrame:
    """The present version of a table that replace_atomically writes."""
    version = _version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{version}")


def _version(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, f"{path}/CURRENT")
    return read_bytes(spark, f"{path}/CURRENT").decode() if fs.exists(p) else None


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file whole or not at all: beside its place first, then renamed."""
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(p, True)
    out.write(bytearray(content))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    fs.rename(p, target)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """The content of a small file."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0]["content"])


def write_index(segments: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Segments partitioned by category; refuses an existing folder unless told otherwise."""
    segments.repartition("category").write.mode(mode).partitionBy("category").parquet(f"{folder}/segments")


def write_search_index(index: tuple[DataFrame, DataFrame], vectors: DataFrame, folder: str) -> None:
    """The tables of a search index: tokens of texts and weights of terms by part, and vectors; refuses an existing folder."""
    texts, terms = index
    texts.write.partitionBy("part").parquet(f"{folder}/texts")
    terms.write.partitionBy("part").parquet(f"{folder}/terms")
    vectors.write.parquet(f"{folder}/vectors")


def rebuilt_states(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """documents (id, status) with the status after a rebuild: a ready document without a readable segment (document_id, text) is in error, the rebuild goes on."""
    readable = segments.where("trim(text) <> ''").select(F.col("document_id").alias("id"), F.lit(1).alias("readable")).distinct()
    return documents.join(readable, "id", "left").withColumn("status", F.when((F.col("status") == "ready") & F.col("readable").isNull(), "error").otherwise(F.col("status"))).drop("readable")


def invalid_workspaces(workspaces: DataFrame) -> DataFrame:
    """id and reason of workspaces (id, name, description) that aren't well formed: id of 32 hexadecimal digits, name of 1 to 120 characters, description of 1 to 800."""
    size = lambda c, most: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))).between(1, most)
    reason = F.when(~F.coalesce(F.col("id").rlike("^[0-9a-f]{32}$"), F.lit(False)), "id").when(~size("name", 120), "name").when(~size("description", 800), "description")
    return workspaces.select("id", reason.alias("reason")).where("reason is not null")


def rebuild_tenants(segments: DataFrame, folder: str) -> None:
    """Replace the partitions of the workspaces present in segments and leave all others."""
    segments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").parquet(folder)


def next_versions(manifest: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """manifest with the index version of each rebuilt workspace (workspace_id, segment_count) raised by one."""
    new = rebuilt.select("workspace_id", F.col("segment_count").alias("new_count"))
    m = manifest.join(new, "workspace_id", "full")
    return m.select("workspace_id", (F.coalesce("index_version", F.lit(0)) + F.col("new_count").isNotNull().cast("int")).alias("index_version"), F.coalesce("new_count", "segment_count").alias("segment_count"))


def manifest_row(segments: DataFrame) -> DataFrame:
    """Counts and an order-independent digest of a segment table."""
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256)
    parts = segments.groupBy("category").agg(F.count("*").alias("segments"), F.countDistinct("source").alias("sources"), F.sum(F.length("text")).alias("characters"), F.sum(F.xxhash64("id", "text").cast("decimal(38,0)")).alias("sum_hash"))
    rows = parts.withColumn("d", F.concat_ws(":", "category", "segments", "sum_hash"))
    return rows.agg(F.sum("segments").alias("segments"), F.sum("characters").alias("characters"), digest.alias("digest"))


def append_pending(todo: DataFrame, done_path: str, key: list[str], work) -> int:
    """Do only what isn't done yet and append it; work maps rows to rows. Returns how many there were to do."""
    spark = todo.sparkSession
    p, fs = _fs(spark, done_path)
    if fs.exists(p):
        todo = todo.join(spark.read.parquet(done_path).select(*key), key, "left_anti")
    run = uuid.uuid4().hex
    # written first and counted then, so the work is done once and what is counted is what is there
    work(todo).withColumn("run_", F.lit(run)).write.mode("append").partitionBy("run_").parquet(done_path)
    p, fs = _fs(spark, f"{done_path}/run_={run}")
    return spark.read.parquet(f"{done_path}/run_={run}").count() if fs.exists(p) else 0


def drop_expired(spark: SparkSession, folder: str, column: str, today: datetime.date, days: int = 7) -> list[str]:
    """Delete the day partitions of a log that are as old as the retention (at least a day) or older."""
    root, fs = _fs(spark, folder)
    limit = today - datetime.timedelta(days=max(1, days))
    gone = []
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith(f"{column}=") and datetime.date.fromisoformat(name.split("=", 1)[1]) <= limit:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def review_sheet(outcomes: DataFrame, key: str, system: str, value: str, systems: list[str]) -> DataFrame:
    """One row for each key with a column for each of the systems."""
    return outcomes.groupBy(key).pivot(system, systems).agg(F.first(value))


def extraction_audit(pages: DataFrame, low: float = 0.5) -> DataFrame:
    """Of each page (page, cells array<struct<text, confidence>>): cells, mean confidence, and how many are below low."""
    known = F.filter("cells", lambda c: c["confidence"].isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, c: s + c["confidence"])
    return pages.select("page", F.size("cells").alias("cells"), F.round(F.try_divide(total, F.size(known)), 4).alias("mean_confidence"), F.size(F.filter(known, lambda c: c["confidence"] < low)).alias("low"))

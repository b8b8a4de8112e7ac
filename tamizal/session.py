"""Session helpers: where intermediate tables go and how they are read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table that are broadcast at most.
SENT_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a local shell) a folder of this
    machine is used instead, which is right as long as the master is local.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and {master} needs a folder that all executors share")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="tamizal-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a Parquet table into the shared folder and return a scan of it.

    Cuts the lineage like ``checkpoint()``, survives the loss of executors, and
    stays columnar and compressed. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamizal-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.parquet(path)


def sent(df: DataFrame, name: str = "sent") -> DataFrame:
    """df as a written table that, where it has few rows, goes to what it is joined with, which isn't moved then."""
    out = materialize(df, name)
    return F.broadcast(out) if out.count() <= SENT_ROWS else out


_STANDING: dict[tuple, tuple[DataFrame, ...]] = {}


def standing(source: DataFrame, name: str, build) -> tuple[DataFrame, ...]:  # noqa: ANN001
    """The tables that build(source) gives, written once in a session for the source's files as they are now, then only read.

    A file that is added, taken away or written anew makes the tables be built again. A source that doesn't come from files is built each time.
    """
    spark = source.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    for f in sorted(source.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(files))
    if not files or key not in _STANDING:
        tables = tuple(materialize(df, name) for df in build(source))
        if not files:
            return tables
        _STANDING[key] = tables
    return _STANDING[key]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have gone first
        pass

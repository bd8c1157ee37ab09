"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only when nothing names one
    (tests on one machine) is a folder of our own made and set; with executors on other
    machines that would lose data, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


_MADE: dict[str, list[str]] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/quire-{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none when it does not exist."""
    if not exists(spark, path):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return [f.getPath().getName() for f in found]


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it exists; False when it does. Of two callers the file system lets one through,
    where it creates files atomically (HDFS and its like; an object store needs conditional writes)."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    try:
        stream = files.create(place, False)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException" and not files.exists(place):
            raise
        return False
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has made so far, and say how many.

    Results are lazy and read these tables: call it once they are written elsewhere.
    """
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        delete(spark, path)
    return len(made)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder.

    It outlives lost executors, and unlike a checkpointed RDD it is read by column and
    has a size the optimizer can see.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

"""Session helpers shared by all operators: table reading, lineage cutting, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster sets it.

    Only where it is unset (tests on one machine) a folder of our own is chosen and noted in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="loomspark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Whether Spark removes the shuffle files of an execution at its end.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage: a lost executor costs at most the stages since the last written table, and a step that feeds
    several later ones runs once. Parquet keeps column pruning and size statistics, which an RDD checkpoint loses.
    What was shuffled for the table is removed when it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_RELEASE, before) if before is not None else spark.conf.unset(_RELEASE)
    return spark.read.schema(df.schema).parquet(path)


def write_counted(df: DataFrame, path: str) -> int:
    """Write ``df`` as Parquet and hold what is read back against what was written; rows lost on the way are an error."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    wrote, there = seen.get["rows"], df.sparkSession.read.parquet(path).count()
    if wrote != there:
        raise RuntimeError(f"{path}: {wrote} rows were written, {there} are there")
    return there


#: Tables this process has written and not removed.
_WRITTEN: list[str] = []


def written(path: str) -> str:
    """Notes a folder that :func:`clear` removes."""
    _WRITTEN.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`materialize` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loom-" in path:
            _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that :func:`materialize` has written in this process, once the results are written."""
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())

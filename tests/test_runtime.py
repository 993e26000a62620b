import time

from pyspark.sql import functions as F

from loomspark.runtime import discard, materialize


def _shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They go without the driver's garbage being collected; the session's own setting stays as it was."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key, None), _shuffle_files(spark)
    made = materialize(spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 10
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(key, None) == setting and made.count() == 997
    discard(made)

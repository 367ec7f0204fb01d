"""Session settings and tables in the shared scratch folder."""

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores="*", shuffle_partitions=8, app="plyclock"):
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small test tables would otherwise be merged into one or two tasks.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .getOrCreate()
    )


@functools.cache
def _own_scratch_dir():
    return tempfile.mkdtemp(prefix="plyclock-")


def scratch_path(spark):
    """A new path in the shared scratch folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a local one is
    made only when the session names none, which is the case in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_scratch_dir()
    return f"{folder}/{uuid.uuid4().hex}"


def scratch_table(spark, table):
    """Write a table to the shared scratch folder and read it back.

    This cuts the lineage in a way that survives lost executors.
    """
    path = scratch_path(spark)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)

"""Helpers shared by the corpus operators."""

import functools
import tempfile
import uuid

from pyspark.sql import functions as F


@functools.cache
def _own_folder():
    return tempfile.mkdtemp(prefix="corpus-")


def shared_folder(spark):
    """A new path under the folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that names none, as in tests, gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_folder()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of an execution at its end.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(table, compression="zstd"):
    """Write a table to the shared folder and read it back, which cuts lineage.

    Nothing comes back to the shuffles of the writing, so their files go with its end.
    """
    spark = table.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        table.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    read = spark.read.schema(table.schema).parquet(path)
    read.stored_at = path
    return read


def release(*tables):
    """Remove the files of tables made by ``stored`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod3(column="doc_id"):
    """The remainder that sets documents aside for testing: 1 means held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def surely_least(hashed, wanted, size):
    """Whether a 64-bit hash is low enough to be among the ``wanted`` least of ``size`` rows.

    Lets through all that are among them and about as many more: the bound stands a
    dozen standard deviations above what is expected of ``wanted`` distinct hashes.
    """
    share = F.lit(2.0 * wanted + 200) / size
    return F.col(hashed) / F.lit(2.0 ** 64) + 0.5 <= share


def with_row_key(table, name):
    """Add a key that tells equal rows apart."""
    return table.withColumn(name, F.monotonically_increasing_id())


def free_name(table, wanted):
    """A column name that clashes with none of the table, whatever the case."""
    taken = {c.lower() for c in table.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_slices(texts, chars=4_000_000):
    """Cut an Arrow column of texts into slices of about so many bytes each.

    A text is never cut: one longer than that makes a slice of its own.  Slices are
    copies: ``ascii_lower`` of pyarrow 23 returns zeros for an array whose first value does
    not start its buffer.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > chars:
            ends.append((start, i))
            start, total = i, 0
        total += size
    if start < len(sizes):
        ends.append((start, len(sizes)))
    for a, b in ends:
        yield a, pa.concat_arrays([texts.slice(a, b - a), texts.slice(0, 0)])


def give_back():
    """Return what this process has freed to the system.

    Workers live on between tasks, and what they keep counts against their executor.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    # Only glibc has it.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ranked(table, *order, name="id"):
    """Write the table in this order and number its rows from 0, without a single task.

    Only the number of rows of every sorted part, one per task, comes to the driver.
    """
    at = free_name(table, "_at")
    held = stored(table.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    sizes = dict(held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(total)]
        total += sizes[p]
    start = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    numbered = held.withColumn(name, (start + F.col(at).bitwiseAND((1 << 33) - 1)).cast("long")).drop(at)
    numbered.stored_at = held.stored_at
    return numbered

"""Writers.  Every one of them writes from all tasks in parallel.

An output is a folder of part files; the readers in ``plyclock.sources`` take
folders, so nothing needs to be squeezed through one task into one file.
"""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from plyclock.operators.top5 import extremes_text
from plyclock.schemas import MOVE_COLUMNS


def write_table(table, path, mode="errorifexists"):
    """Parquet, the native form."""
    table.write.mode(mode).parquet(path)


def write_pairs(pairs, path, mode="errorifexists"):
    """Header-less ``key,value`` text."""
    pairs.write.mode(mode).csv(path)


def write_extremes_text(extremes, path, values="times", mode="errorifexists"):
    """``(key parts,[a, b, c, d, e])`` text."""
    extremes_text(extremes, values).write.mode(mode).text(path)


def write_moves(moves, path, fmt="parquet", partition_by=None, mode="errorifexists"):
    """The enriched moves table in its fixed column order.

    Columns the table does not have are skipped.  ``partition_by`` lays the
    Parquet output out in folders, by month for example; the rows of a folder are brought
    together first, and a large folder split again by their bytes, so the number of files
    goes by the data and not by the number of tasks.
    """
    known = [c for c in MOVE_COLUMNS if c in moves.columns]
    layout = [c for c in (partition_by or []) if c not in known]
    table = moves.select(*known, *layout)
    if partition_by:
        table = table.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = table.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def quarantine(tagged, path, mode="errorifexists"):
    """Write the good and the bad rows of a tagged table apart, in one pass over it.

    Returns ``(good, bad, counts)``: both read back from ``path``, each from its own
    folder, and the number of good and bad rows, counted while writing.  ``tagged`` is
    what the typed readers return under ``on_bad="tag"``.
    """
    counts = Observation()
    is_bad = F.size("bad") > 0
    observed = tagged.withColumn("is_bad", is_bad).observe(
        counts, F.count_if(~F.col("is_bad")).alias("good"), F.count_if(F.col("is_bad")).alias("bad"))
    observed.write.mode(mode).partitionBy("is_bad").parquet(path)
    held = tagged.sparkSession.read.schema(observed.schema).parquet(path)
    return (held.filter(~F.col("is_bad")).drop("is_bad", "bad", "raw"),
            held.filter("is_bad").drop("is_bad"), dict(counts.get))

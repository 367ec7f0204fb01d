"""Readers for the jobs' own text outputs."""

from pyspark.sql import functions as F

# Separator and brackets of the published five-move text form.
FIELD_SEPARATOR = r"\s*,\s*|\s+"
BRACKETS = "[]()"


def read_pairs(spark, path, schema):
    """A folder of header-less ``key,value`` part files.

    ``schema`` names and types the two fields; marker and checksum files are
    skipped by Spark's file listing.
    """
    return spark.read.schema(schema).csv(path)


def read_extremes_text(spark, path):
    """A folder (or list of folders) of ``(game player rating,[a, b, c, d, e])`` lines."""
    return parse_extremes_text(spark.read.text(path), "value")


def parse_extremes_text(lines, column="value"):
    """Split five-move lines; numbers that do not parse become NULL."""
    part = F.split(F.trim(F.col(column)), FIELD_SEPARATOR)

    def field(i):
        return F.translate(F.try_element_at(part, F.lit(i + 1)), BRACKETS, "")

    return lines.select(
        field(0).alias("game_id"),
        field(1).alias("player"),
        field(2).try_cast("int").alias("rating"),
        F.array(*[field(i).try_cast("double") for i in range(3, 8)]).alias("times"),
    )

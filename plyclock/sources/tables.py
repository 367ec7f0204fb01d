"""Readers for the moves and game-info tables."""

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyclock.functions import clock_base, clock_increment, parse_score, strict_cast
from plyclock.schemas import GAME_INFO, MOVES


def read_raw(spark, path, fmt="csv"):
    """Every column of an export; text columns for CSV, no type inference.

    Of a list of paths the CSV headers must agree, and Parquet schemas are merged.
    """
    several = isinstance(path, list) and len(path) > 1
    if fmt == "csv":
        return spark.read.option("header", True).option("enforceSchema", not several).csv(path)
    return spark.read.option("mergeSchema", several).format(fmt).load(path)


def pick(table, columns):
    """Select logical columns given as {name: position or header}.

    Entries whose position lies beyond the table are an error, like any other
    unknown column.
    """
    def source(where):
        if isinstance(where, int):
            if where >= len(table.columns):
                raise ValueError(f"no column at position {where} in {table.columns}")
            where = table.columns[where]
        return table[f"`{where}`"]

    return table.select([source(where).alias(name) for name, where in columns.items()])


def read_moves(spark, path, fmt="csv", columns=None, on_bad="fail", need=None):
    """Moves with types.  See ``typed_moves`` for ``on_bad`` and ``need``.

    CSV columns are found by position unless ``columns`` says otherwise; other
    formats are found by name.
    """
    raw = read_raw(spark, path, fmt)
    return typed_moves(_located(raw, fmt, MOVES, columns), on_bad, need)


def read_game_info(spark, path, fmt="csv", columns=None, on_bad="fail", need=None):
    """One row per game with types.  See ``typed_moves`` for ``on_bad`` and ``need``."""
    raw = read_raw(spark, path, fmt)
    return typed_game_info(_located(raw, fmt, GAME_INFO, columns), on_bad, need)


def _located(raw, fmt, positions, columns):
    if fmt == "csv":
        wanted = {**positions, **(columns or {})}
    else:
        wanted = {name: name for name in positions if name in raw.columns}
        wanted.update(columns or {})
    return pick(raw, wanted)


def typed_moves(raw, on_bad="fail", need=None):
    """Give ``move_no`` and ``move_time`` their types.

    ``on_bad="fail"`` stops the job at the first value that does not parse.
    ``on_bad="quarantine"`` returns ``(good, bad)``, the bad rows untouched.  Only the
    columns in ``need`` decide (default: all that have a check), so a job that reads no
    scores keeps moves without one by leaving the score out.  The other columns stop
    the job where they are used and do not parse, as under "fail".
    ``on_bad="tag"`` returns one table in one pass: values that do not parse are NULL,
    ``bad`` lists the columns they are in, and ``raw`` has such a row's texts.
    ``sinks.quarantine`` writes both kinds of row apart and counts them on the way.
    Columns that already have the type are left alone, so filters on them still
    reach a Parquet scan.
    """
    checks = {
        "move_no": "try_cast(move_no AS INT)",
        "move_time": "try_cast(move_time AS DOUBLE)",
        "centipawn_score": parse_score("centipawn_score", strict=False),
    }
    return _typed(raw, {"move_no": "int", "move_time": "double"}, checks, on_bad, need)


def typed_game_info(raw, on_bad="fail", need=None):
    """Give the two ratings their type and check the time control's shape."""
    control = [part("time_control", strict=False) for part in (clock_base, clock_increment)]
    checks = {
        "white_elo": "try_cast(white_elo AS INT)",
        "black_elo": "try_cast(black_elo AS INT)",
        "time_control": " + ".join(control),
    }
    return _typed(raw, {"white_elo": "int", "black_elo": "int"}, checks, on_bad, need)


def _typed(raw, types, checks, on_bad, need):
    need = set(checks if need is None else need)
    if need - set(checks):
        raise ValueError(f"nothing to check in {sorted(need - set(checks))}")
    current = dict(raw.dtypes)
    types = {n: to for n, to in types.items() if n in current and current[n] != to}
    if on_bad == "fail":
        return raw.withColumns({n: F.expr(strict_cast(n, to, n)) for n, to in types.items()})
    if on_bad not in ("quarantine", "tag"):
        raise ValueError(f"unknown on_bad: {on_bad}")
    parses = [f"({check}) IS NOT NULL" for n, check in checks.items() if n in current and n in need]
    good = " AND ".join(parses) or "true"
    cast = {n: F.expr(f"try_cast({n} AS {to})" if n in need else strict_cast(n, to, n))
            for n, to in types.items()}
    if on_bad == "tag":
        wrong = ", ".join(f"CASE WHEN ({check}) IS NULL THEN '{n}' END"
                          for n, check in checks.items() if n in current and n in need)
        columns = ", ".join(f"`{n}`" for n in raw.columns)
        bad = F.expr(f"array_compact(array({wrong}))" if wrong else "cast(array() AS array<string>)")
        tagged = raw.withColumns({"bad": bad, "raw": F.expr(f"struct({columns})")})
        return tagged.withColumns(cast).withColumn("raw", F.when(F.size("bad") > 0, F.col("raw")))
    return raw.filter(good).withColumns(cast), raw.filter(f"NOT ({good})")


def read_months(spark, paths, read=read_raw, **options):
    """Monthly files or folders as one table with a ``month`` column.

    ``paths`` maps each month to its path, which may hold wildcards; of a list, the last
    part of each path, without an ending, is the month.  ``read`` is any reader of this
    package that keeps the rows of its files, so moves come with their types, and
    ``options`` go to it.  All paths are read by one scan, however many there are, and
    a row's month comes from the file it is in: a filter on it skips the other months'
    files.  CSV files must have the same header (a differing one stops the job) and
    Parquet columns are found by name in the schemas of all months merged.  A path that
    does not exist, or one inside another, is an error.
    """
    if not isinstance(paths, dict):
        names = [os.path.splitext(os.path.basename(p.rstrip("/")))[0] for p in paths]
        if len(set(names)) < len(names):
            raise ValueError(f"months are not distinct: {names}")
        paths = dict(zip(names, paths, strict=True))
    if not paths:
        raise ValueError("no months given")
    month_of, read_from = {}, {}
    for month, path in paths.items():
        for found, readable in _existing(spark, path):
            read_from[found] = readable
            if month_of.setdefault(found, month) != month:
                raise ValueError(f"{found} belongs to {month_of[found]} and to {month}")
    for found in month_of:
        above = found
        while "/" in above:
            above = above.rpartition("/")[0]
            if above in month_of:
                raise ValueError(f"{found} lies inside {above}")
    table = read(spark, sorted(read_from.values()), **options)
    file = F.replace(F.col("_metadata.file_path"), F.lit(":///"), F.lit(":/"))
    known = F.create_map(*[F.lit(x) for kv in month_of.items() for x in kv])
    depths = sorted({p.count("/") + 1 for p in month_of})
    return table.withColumn("month", F.coalesce(*[
        F.try_element_at(known, F.substring_index(file, "/", depth)) for depth in depths]))


def _existing(spark, path):
    """Files or folders that a path, perhaps with wildcards, stands for: as in file metadata, and to read."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if not found:
        raise FileNotFoundError(path)
    paths = [status.getPath() for status in found]
    return [(p.toUri().toString().replace(":///", ":/"), p.toString()) for p in paths]


def append_tables(tables):
    """Bag union of tables by column name, for frames that share no scan."""
    return reduce(DataFrame.unionByName, tables)

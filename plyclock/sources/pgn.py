"""PGN archives as tables: one row per game, then one row per ply."""

from pyspark.sql import functions as F

from plyclock.functions import side_of_move

# A clock time is any decimal number in the movetext.
TIME_PATTERN = r"(\d+\.\d+)"
RESULTS = ["1-0", "0-1", "1/2-1/2", "*"]


def read_pgn(spark, path, newline="\n", id_tag=None):
    """A PGN archive, one row per game.

    The record separator makes Spark split the archive between games, so one
    large file is read by many tasks.  ``newline="\\r\\n"`` reads archives with
    Windows line ends.
    """
    separator = f"{newline}{newline}[Event "
    text = spark.read.option("lineSep", separator).text(path)
    if newline != "\n":
        text = text.select(F.replace("value", F.lit(newline), F.lit("\n")).alias("value"))
    return pgn_games(text, "value", id_tag)


def pgn_games(records, column="value", id_tag=None):
    """Headers and movetext of game records.

    ``id_tag`` names the header that identifies a game; without it the id is the SHA-256
    of the whole record, so copies of a record are one game listed several times.
    """
    text = F.col(column)
    game_id = header(text, id_tag) if id_tag else F.sha2(text.cast("binary"), 256)
    named = {"white": "White", "black": "Black", "result": "Result", "white_elo": "WhiteElo",
             "black_elo": "BlackElo", "time_control": "TimeControl", "date": "Date"}
    return records.filter(F.length(F.trim(text)) > 0).select(
        game_id.alias("game_id"),
        *[header(text, tag).alias(name) for name, tag in named.items()],
        movetext(text).alias("movetext"),
    )


def header(text, tag):
    """Value of one ``[Tag "value"]`` line, NULL when it is missing."""
    value = F.regexp_extract(text, rf'(?m)^\[{tag} "([^"]*)"', 1)
    return F.nullif(value, F.lit(""))


def movetext(text):
    """All that follows the headers' blank line, joined to one line."""
    after = F.regexp_replace(text, r"\A(?s:.*?)\n\n", "")
    # A semicolon outside braces opens a comment up to the end of its line.
    after = F.regexp_replace(after, r"(\{[^}]*\})|;[^\n]*", "$1")
    return F.trim(F.regexp_replace(after, r"\s+", " "))


def first_ply(text):
    """Ply number of the first move in a piece of movetext.

    ``7.`` opens White's move 7 (ply 13) and ``7...`` Black's (ply 14).  Text
    that opens with no number starts at ply 1.
    """
    number = F.regexp_extract(text, r"^\s*(\d+)\.", 1).try_cast("int")
    black = text.rlike(r"^\s*\d+\.\.\.")
    return F.coalesce(2 * number - F.when(black, 0).otherwise(1), F.lit(1))


def _once(value, use):
    """``use`` of an expression that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_variations(text):
    """Movetext less all that stands in round brackets, at any depth; NULL if they do not pair.

    One pass over the brackets and what lies between them, counting the depth.
    """
    part = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), F.lit(0))

    def step(state, word):
        depth, opens, closes = state["depth"], word == "(", word == ")"
        return F.struct(
            (depth + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            (state["broken"] | closes & (depth == 0)).alias("broken"),
            F.when(closes, F.concat(state["out"], F.lit(" "))).when(opens | (depth != 0), state["out"])
            .otherwise(F.concat(state["out"], word)).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("broken"), F.lit("").alias("out"))
    kept = F.aggregate(part, start, step, lambda s: F.when(~s["broken"] & (s["depth"] == 0), s["out"]))
    return F.when(text.rlike("[()]"), kept).otherwise(text)


def main_line(text):
    """The moves of a movetext in order: an array of ``(move, time)``.

    Comments, variations, annotation glyphs and marks, move numbers and the result are
    removed.  ``time`` is the first clock time among the comments that follow the move,
    or empty.  NULL if a variation is not closed or not opened.
    """
    # Of a comment only its first time stays, so brackets in comments do not count.
    plain = F.regexp_replace(text, rf"\{{[^}}]*?{TIME_PATTERN}[^}}]*\}}", " {$1} ")
    plain = F.regexp_replace(plain, r"\{(?!\d+\.\d+\})[^}]*\}", " ")
    plain = _once(plain, without_variations)
    plain = F.regexp_replace(plain, r"\$\d+|[!?]+", " ")
    plain = F.regexp_replace(plain, r"(?<![\d.{])\d+\.+(?!\d)", " ")
    return _once(plain, _words)


def _words(plain):
    # A comment before the first move is taken whole, and gives an empty move.
    word = F.lit(r"\{[^}]*\}|([^\s{}]+)\s*(?:\{([^}]*)\})?")
    both = F.arrays_zip(
        F.regexp_extract_all(plain, word, F.lit(1)).alias("move"),
        F.regexp_extract_all(plain, word, F.lit(2)).alias("time"))
    return F.filter(both, lambda w: (w["move"] != "") & ~w["move"].isin(RESULTS))


def broken_games(games, text="movetext"):
    """The games whose movetext has a bracket without a partner, as they are."""
    return games.filter(F.col(text).isNotNull() & main_line(F.col(text)).isNull())


def _plies(games, game_id, text, on_bad):
    # A column of its own, so that the check below does not take the movetext apart again.
    lines = games.select(
        F.col(game_id).alias("game_id"),
        first_ply(F.col(text)).alias("_first"),
        F.col(text).isNotNull().alias("_given"),
        main_line(F.col(text)).alias("_line"),
    )
    line = F.col("_line")
    if on_bad == "fail":
        line = F.when(line.isNull() & F.col("_given"), F.raise_error(
            F.concat(F.lit("unbalanced variation in game "), F.col("game_id").cast("string")))).otherwise(line)
    elif on_bad != "skip":
        raise ValueError(f"unknown on_bad: {on_bad}")
    numbered = lines.select("game_id", "_first", F.posexplode(line).alias("_pos", "_ply"))
    return numbered.selectExpr("game_id", "_first + _pos AS move_no", "_ply.move", "_ply.time")


def clock_times(games, game_id="game_id", text="movetext", on_bad="fail"):
    """One row per clock time: ``(game_id, move_no, move_time)``.

    A time belongs to the move of the main line that it follows; a move without one
    has no row, and the times of variations are left out.  A row may be a whole game
    or any run of its moves, because numbering starts at the ply its text opens with;
    long games can therefore be cut into several rows.  A game whose brackets do not pair
    stops the job, or with ``on_bad="skip"`` gives no rows; ``broken_games`` lists those.
    """
    return _plies(games, game_id, text, on_bad).filter("time <> ''").selectExpr(
        "game_id", "move_no", "double(time) AS move_time")


def pgn_moves(games, game_id="game_id", text="movetext", on_bad="fail"):
    """One row per move of the main line: ``(game_id, move_no, side, move)``.

    For ``on_bad`` see ``clock_times``.
    """
    return _plies(games, game_id, text, on_bad).selectExpr(
        "game_id", "move_no", f"{side_of_move('move_no')} AS side", "move")

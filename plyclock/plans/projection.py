"""The driver's tables seen as chess games.

``customer`` gives one game per row and ``lineitem`` joined to ``orders`` gives
its moves, numbered within a customer by order and line.
"""

from pyspark.sql import functions as F

GAME_INFO = """
SELECT c_custkey AS game_id,
       concat('w', c_custkey) AS white,
       concat('b', c_custkey) AS black,
       CASE c_custkey % 3 WHEN 0 THEN '1-0' WHEN 1 THEN '0-1' ELSE '1/2-1/2' END AS result,
       CAST(1000 + (c_custkey * 37) % 1500 AS INT) AS white_elo,
       CAST(1000 + (c_custkey * 53) % 1500 AS INT) AS black_elo,
       CASE WHEN c_custkey % 50 = 7 THEN '0+12'
            WHEN c_custkey % 5 = 0 THEN '60+0'
            WHEN c_custkey % 5 = 1 THEN '180+2'
            WHEN c_custkey % 5 = 2 THEN '300+5'
            WHEN c_custkey % 5 = 3 THEN '600+10'
            ELSE '900+0' END AS time_control
FROM {customer}
"""

# Lines are numbered within each order, and each order starts at the number of
# lines its customer has in earlier orders.  That running sum is taken within
# blocks of 2^16 consecutive order keys, and over the blocks' totals, so that no
# task has to see all orders of one customer.
MOVES = """
WITH sized AS (
  SELECT o_orderkey, o_custkey, o_orderdate, n
  FROM {orders}
  JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey)
    ON l_orderkey = o_orderkey
  WHERE o_custkey IS NOT NULL
  DISTRIBUTE BY o_custkey, shiftright(o_orderkey, 16)),
blocks AS (
  SELECT o_custkey, block, sum(sum(n)) OVER (
           PARTITION BY o_custkey ORDER BY block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_block
  FROM (SELECT o_custkey, shiftright(o_orderkey, 16) AS block, n FROM sized)
  GROUP BY o_custkey, block),
starts AS (
  SELECT o_orderkey, o_custkey, o_orderdate,
         coalesce(before_block, 0) + coalesce(before_order, 0) AS start
  FROM (SELECT *, sum(n) OVER (
                 PARTITION BY o_custkey, block ORDER BY o_orderkey
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_order
        FROM (SELECT *, shiftright(o_orderkey, 16) AS block FROM sized))
  LEFT JOIN blocks USING (o_custkey, block)),
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         l_quantity - 1 AS move_time,
         concat(substr('abcdefgh', CAST(l_partkey % 8 + 1 AS INT), 1), l_suppkey % 8 + 1) AS move,
         CASE WHEN l_partkey % 97 = 0 THEN '#+3'
              WHEN l_partkey % 97 = 1 THEN '#-2'
              ELSE concat(if(score > 0, '+', ''), score) END AS centipawn_score
  FROM (SELECT *, (l_partkey * 31 + l_suppkey) % 801 - 400 AS score FROM {lineitem})),
numbered AS (
  SELECT l_orderkey, move_time, move, centipawn_score, row_number() OVER (
           PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line
  FROM lines),
plies AS (
  SELECT o_custkey AS game_id, CAST(start + line AS INT) AS move_no, move, move_time,
         centipawn_score, month(o_orderdate) AS month
  FROM numbered JOIN starts ON l_orderkey = o_orderkey)
SELECT game_id,
       concat(CASE WHEN move_no % 2 = 1 THEN 'w' ELSE 'b' END, game_id) AS player,
       move_no, move, move_time, centipawn_score, month
FROM plies
"""


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chess_game_info(spark, sf_dir):
    """``game_id, white, black, result, white_elo, black_elo, time_control``."""
    return spark.sql(GAME_INFO, customer=table(spark, sf_dir, "customer"))


def chess_moves(spark, sf_dir):
    """``game_id, player, move_no, move, move_time, centipawn_score, month``."""
    return spark.sql(
        MOVES,
        lineitem=table(spark, sf_dir, "lineitem"),
        orders=table(spark, sf_dir, "orders"),
    )


def chess_movetext(moves, without_mate_times=False, plies=64):
    """Moves written as PGN movetext, in runs of at most ``plies`` moves.

    Ply numbers are unique within a game, which bounds what is gathered into one
    row.  ``without_mate_times`` prints no clock behind a mate score.
    """
    no = F.col("move_no")
    number = F.concat(
        F.floor((no + 1) / 2).cast("string"),
        F.when(no % 2 == 1, F.lit(".")).otherwise(F.lit("...")),
    )
    # The formatter is slow; plain times come out alike as decimals.
    time = F.expr("concat('{[%emt ', CASE WHEN move_time >= 0 AND move_time < 1e6 "
                  "THEN string(CAST(move_time AS DECIMAL(9, 1))) "
                  "ELSE format_string('%.1f', move_time) END, ']}')")
    if without_mate_times:
        time = F.when(F.col("centipawn_score").contains("#"), F.lit("{}")).otherwise(time)
    text = F.concat_ws(" ", number, F.col("move"), time)
    runs = moves.select(
        "game_id", F.floor((no - 1) / plies).alias("_run"), F.struct(no, text.alias("text")).alias("_m")
    )
    # The moves of a run come from many tasks, so gathering them before the shuffle gains nothing.
    return runs.repartition("game_id", "_run").groupBy("game_id", "_run").agg(
        F.sort_array(F.collect_list("_m")).alias("_moves")
    ).select(
        "game_id", F.concat_ws(" ", F.transform("_moves", lambda m: m["text"])).alias("movetext")
    )

"""What keeps the larger queries from doing the same work several times."""

from frames import info_frame, moves_frame, one_game

from plyclock import operators as ops
from plyclock import sources
from plyclock.plans.jobs import KINDS, run_job, run_jobs
from plyclock.plans.projection import chess_movetext
from plyclock.plans.queries import QUERIES, bind

INFO = [("g1", "anna", "ben", "1-0", 1500, 1600, "60+1"), ("g2", "anna", "ben", "0-1", 1510, 1590, "0+5"),
        ("g2", "anna", "ben", "0-1", 1510, 1590, "0+5"), ("g3", "cleo", "dan", "1-0", 1700, 1400, "60+0")]
MOVES = (one_game(range(20), [5, 5, 0, 0, 7, 9, 9, 9, 1, 2, 3, 4, 9, 9], "g1", "-35")
         + one_game([0, 3, 0, 4] * 4, [2] * 13, "g2", "#+2") + one_game([1, 2], [3], "g3"))


def test_jobs_share_one_reading(spark, tmp_path):
    """All three jobs read each input once, and write what each writes alone."""
    moves_frame(spark, MOVES).write.parquet(str(tmp_path / "moves"))
    info_frame(spark, INFO).write.parquet(str(tmp_path / "info"))

    def counted(name, seen):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        table = spark.read.parquet(str(tmp_path / name))
        return table.mapInArrow(run, table.schema)

    read = {name: spark.sparkContext.accumulator(0) for name in ("moves", "info")}
    paths = run_jobs(spark, KINDS, counted("moves", read["moves"]), counted("info", read["info"]),
                     str(tmp_path / "all"))
    assert {name: seen.value for name, seen in read.items()} == {"moves": len(MOVES), "info": len(INFO)}
    moves, info = (spark.read.parquet(str(tmp_path / name)) for name in ("moves", "info"))
    for kind in KINDS:
        alone = run_job(spark, kind, moves, info, str(tmp_path / "alone"))
        assert set(alone) == set(paths[kind])
        for name, path in alone.items():
            one, other = spark.read.parquet(path), spark.read.parquet(paths[kind][name])
            assert one.schema == other.schema
            rows = [sorted(map(repr, t.collect())) for t in (one, other)]
            assert rows[0] and rows[0] == rows[1], (kind, name)


def test_movetext_is_taken_apart_once(spark, sf_dir):
    """The moves are made once for both sides of the join, and no text is read anew by each use."""
    moves = spark.range(100).selectExpr("id div 25 AS game_id", "int(id % 25) + 1 AS move_no", "'e4' AS move",
                                        "double(id) AS move_time", "'+1' AS centipawn_score")
    times = sources.clock_times(chess_movetext(moves))
    text = times._jdf.queryExecution().optimizedPlan().toString()
    # Four expressions clean the text and two or three extract from it, none repeated.
    assert text.count("regexp_replace(") <= 4 and text.count("regexp_extract_all(") <= 3
    # Times made from text are not taken for a small table.
    attached = ops.attach_times(moves.select("game_id", "move_no"), times)
    assert "BroadcastHashJoin" not in attached._jdf.queryExecution().executedPlan().toString()
    got = {(r.game_id, r.move_no): r.move_time for r in attached.collect()}
    assert got == {(i // 25, i % 25 + 1): float(i) for i in range(100)}
    # Both sides start from moves that were written once.
    whole = bind(QUERIES["attach_times"])(spark, sf_dir)
    assert "lineitem" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lineitem" in f for f in whole.inputFiles())


def test_clock_times_are_printed_as_before(spark):
    values = [0.0, 0.04, 0.05, 0.15, 0.25, 12.0, 49.95, 999999.95, 1e6, 2.5e9, -0.05, -3.0,
              float("nan"), float("inf"), None]
    moves = spark.createDataFrame([(i, 1, "e4", v, "+1") for i, v in enumerate(values)],
                                  "game_id int, move_no int, move string, move_time double, centipawn_score string")
    shown = {r.game_id: r.movetext for r in chess_movetext(moves).collect()}
    direct = moves.selectExpr("game_id", "format_string('1. e4 {[%%emt %.1f]}', move_time) AS movetext")
    assert shown == {r.game_id: r.movetext for r in direct.collect()}

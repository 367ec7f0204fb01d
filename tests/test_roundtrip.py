"""Files in, files out."""

import csv
import glob
import shutil

import pytest
from pyspark.sql import functions as F

from frames import info_frame, moves_frame, one_game, same
from plyclock import operators as ops
from plyclock import schemas, sinks, sources
from plyclock.plans.jobs import KINDS, prepare_moves, run_job
from plyclock.plans.queries import RunningTime


def write_moves_csv(path, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["", *schemas.MOVE_COLUMNS])
        for i, (game, player, ply, time, score) in enumerate(rows):
            out.writerow([i, game, player, ply, "e4", "P", "fen", 0, 0, 0, 0, 0, 0, time, score])


def write_info_csv(path, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow([f"h{i}" for i in range(24)])
        for game, white, black, result, welo, belo, control in rows:
            line = ["-"] * 24
            for name, value in zip(
                ("game_id", "white", "black", "result", "white_elo", "black_elo", "time_control"),
                (game, white, black, result, welo, belo, control),
            ):
                line[schemas.GAME_INFO[name]] = value
            out.writerow(line)


def files_read(table):
    scan = table._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    return scan.selectedPartitions().totalNumberOfFiles()


INFO = [("g1", "anna", "ben", "1-0", 1600, 1500, "600+10"),
        ("g2", "carl", "dora", "1/2-1/2", 1700, 1800, "0+12")]
MOVES = one_game(range(13), range(12)) + [
    (g.replace("g1", "g2"), {"anna": "carl", "ben": "dora"}[p], n, t, "#+3")
    for g, p, n, t, _ in one_game(range(14), range(13))
]


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    write_moves_csv(folder / "moves.csv", MOVES)
    write_info_csv(folder / "info.csv", INFO)
    return str(folder / "moves.csv"), str(folder / "info.csv")


def test_csv_by_position(spark, exports):
    moves = sources.read_moves(spark, exports[0])
    info = sources.read_game_info(spark, exports[1])
    assert dict(moves.dtypes)["move_time"] == "double"
    assert dict(info.dtypes)["white_elo"] == "int"
    got = moves.select("game_id", "player", "move_no", "move_time", "centipawn_score").collect()
    assert sorted(tuple(r) for r in got) == sorted(MOVES)
    assert sorted(tuple(r) for r in info.collect()) == sorted(INFO)


def test_csv_by_header(spark, exports):
    moves = sources.read_moves(spark, exports[0], columns={"move_time": "move_no"})
    assert moves.filter(F.col("move_no") != F.col("move_time")).count() == 0
    with pytest.raises(ValueError, match="position 99"):
        sources.read_moves(spark, exports[0], columns={"move_time": 99})


def test_months_in_one_scan(spark, tmp_path):
    for month in ("jan", "feb"):
        write_moves_csv(tmp_path / f"{month}.csv", MOVES)
    months = sources.read_months(spark, [str(tmp_path / f"{m}.csv") for m in ("jan", "feb")])
    counts = {r["month"]: r["count"] for r in months.groupBy("month").count().collect()}
    assert counts == {"jan": len(MOVES), "feb": len(MOVES)}
    assert sources.append_tables([months, months]).count() == 4 * len(MOVES)
    typed = sources.read_months(
        spark, {"2020-01": str(tmp_path / "jan.csv")}, sources.read_moves)
    assert dict(typed.dtypes)["move_time"] == "double" and typed.first().month == "2020-01"
    with pytest.raises(ValueError):
        sources.read_months(spark, ["a/x.csv", "b/x.csv"])


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_many_months_are_one_scan_that_skips_files(spark, tmp_path, fmt):
    base = spark.createDataFrame([(1, "a b"), (2, "c")], "game_id long, player string").coalesce(1)
    writer = base.write.option("header", True).format(fmt)
    writer.save(str(tmp_path / "seed"))
    paths = {}
    for k in range(120):  # folders and single files, at two depths, with a blank in some names
        month = f"{2010 + k // 12}-{k % 12 + 1:02}"
        to = tmp_path / ("deep er" if k % 2 else "") / month
        if k % 3:
            shutil.copytree(tmp_path / "seed", to)
        else:
            to.parent.mkdir(exist_ok=True)
            to = to.with_suffix(f".{fmt}")
            shutil.copy(next((tmp_path / "seed").glob(f"*.{fmt}")), to)
        paths[month] = str(to)
    months = sources.read_months(spark, paths, fmt=fmt)
    got = {r.month: r["count"] for r in months.groupBy("month").count().collect()}
    assert got == dict.fromkeys(paths, 2)
    whole = months._jdf.queryExecution().executedPlan().toString()
    assert whole.count("FileScan") == 1 and "Union" not in whole
    few = months.filter(F.col("month").isin("2010-02", "2015-07"))
    assert few.groupBy("month").count().count() == 2
    assert files_read(few) == 2 and files_read(months) == 120
    wild = sources.read_months(spark, {"odd": str(tmp_path / "deep er" / "*")}, fmt=fmt)
    assert [tuple(r) for r in wild.groupBy("month").count().collect()] == [("odd", 120)]
    with pytest.raises(FileNotFoundError):
        sources.read_months(spark, {"no": str(tmp_path / "missing")}, fmt=fmt)
    with pytest.raises(ValueError, match="inside"):
        sources.read_months(spark, {"a": paths["2010-02"], "b": str(tmp_path / "deep er")}, fmt=fmt)


def test_months_of_different_headers_stop(spark, tmp_path):
    (tmp_path / "jan.csv").write_text("a,b\n1,2\n")
    (tmp_path / "feb.csv").write_text("b,a\n2,1\n")
    months = sources.read_months(spark, [str(tmp_path / "jan.csv"), str(tmp_path / "feb.csv")])
    with pytest.raises(Exception, match="(?i)header"):
        months.collect()


@pytest.mark.parametrize("text", [False, True])
def test_months_of_job_outputs(spark, exports, tmp_path, text):
    moves, info = sources.read_moves(spark, exports[0]), sources.read_game_info(spark, exports[1])
    paths = {}
    for month in ("January", "February"):
        out = run_job(spark, "Rating", moves, info, str(tmp_path / month), text=text)
        paths[month] = out["FastestMoveTimes"]
    months = (sources.read_months(spark, paths, sources.read_extremes_text) if text
              else sources.read_months(spark, paths, fmt="parquet"))
    counts = {r["month"]: r["count"] for r in months.groupBy("month").count().collect()}
    expected = ops.rating_extremes(info, moves).count()
    assert counts == {"January": expected, "February": expected}


def test_one_reading_of_movetext(spark):
    texts = {
        "clock": "1. e4 {[%emt 0.5]} e5 2. Nf3 {1.5} ({2.75} 2. f4) Nc6 {3.5} 1-0",
        "nested": "1. e4 (1. d4 d5 (1... Nf6 2. c4) 2. c4) e5 2. Nf3! {a (b} Nc6?? $5 *",
        "tight": "{0.1} 12...e5 {say 7.25 or 8.5} 13.Bb5 {} {2.5} 1/2-1/2",
    }
    games = spark.createDataFrame(list(texts.items()), "game_id string, movetext string")
    moves, times = sources.pgn_moves(games), sources.clock_times(games)
    got = {}
    for r in sorted(ops.attach_times(moves, times).collect(), key=lambda r: r.move_no):
        got.setdefault(r.game_id, []).append((r.move_no, r.move, r.move_time))
    assert got["clock"] == [(1, "e4", 0.5), (2, "e5", None), (3, "Nf3", 1.5), (4, "Nc6", 3.5)]
    assert got["nested"] == [(i, m, None) for i, m in enumerate(("e4", "e5", "Nf3", "Nc6"), 1)]
    assert [m[1:] for m in got["tight"]] == [("e5", 7.25), ("Bb5", 2.5)]
    with pytest.raises(Exception, match="unbalanced"):
        sources.pgn_moves(games.selectExpr("game_id", "'1. e4 (1. d4' AS movetext")).collect()


def test_variations_at_any_depth(spark):
    deep = "1. e4 " + "(1. d4 {0.5} " * 50 + "d5" + " )" * 50 + " {2.5} e5 (1... c5) *"
    rows = [("deep", deep), ("open", "1. e4 (1. d4"), ("closed", "1. e4 ) e5"), ("turned", "1. e4 )( e5"),
            ("none", None), ("blank", ""), ("comment", "1. e4 {:-) 1.5} e5")]
    games = spark.createDataFrame(rows, "game_id string, movetext string")
    moves = sources.pgn_moves(games, on_bad="skip").collect()
    assert sorted((r.game_id, r.move_no, r.move) for r in moves) == [
        ("comment", 1, "e4"), ("comment", 2, "e5"), ("deep", 1, "e4"), ("deep", 2, "e5")]
    times = sources.clock_times(games, on_bad="skip").collect()
    assert sorted((r.game_id, r.move_no, r.move_time) for r in times) == [("comment", 1, 1.5), ("deep", 1, 2.5)]
    assert {r.game_id for r in sources.broken_games(games).collect()} == {"open", "closed", "turned"}
    with pytest.raises(Exception, match="unbalanced variation in game turned"):
        sources.clock_times(games.filter("game_id = 'turned'")).collect()


def test_comments_to_the_end_of_a_line(spark):
    record = '[Event "x"]\n\n1. e4 ; a (comment\ne5 {x; y 1.5} 2. Nf3 *'
    games = sources.pgn_games(spark.createDataFrame([(record,)], "value string"))
    assert [r.move for r in sources.pgn_moves(games).collect()] == ["e4", "e5", "Nf3"]
    assert [(r.move_no, r.move_time) for r in sources.clock_times(games).collect()] == [(2, 1.5)]


def test_pairs_text(spark, tmp_path):
    info, moves = info_frame(spark, INFO), moves_frame(spark, MOVES)
    values = ops.outcome_values(ops.player_game_totals(info, moves, ("outcome",)))
    path = str(tmp_path / "avg")
    sinks.write_pairs(values, path)
    back = sources.read_pairs(spark, path, schemas.OUTCOME_VALUES)
    key = lambda r: (r.outcome, str(r.value))
    assert same([tuple(r) for r in sorted(values.collect(), key=key)],
                [tuple(r) for r in sorted(back.collect(), key=key)])


def test_lists_text(spark, tmp_path):
    info, moves = info_frame(spark, INFO), moves_frame(spark, MOVES)
    lists = ops.rating_extremes(info, moves)
    path = str(tmp_path / "fast")
    sinks.write_extremes_text(lists, path)
    lines = [l for f in glob.glob(path + "/part-*") for l in open(f).read().split("\n") if l]
    assert "(g1 anna 1600,[0.0016666666666666668, 0.0033333333333333335, 0.005, " \
           "0.006666666666666667, 0.008333333333333333])" in lines
    back = sources.read_extremes_text(spark, path)
    key = lambda r: r.player
    assert same([tuple(r) for r in sorted(lists.collect(), key=key)],
                [tuple(r) for r in sorted(back.collect(), key=key)])


def test_broken_list_text_gives_null(spark):
    lines = spark.createDataFrame(
        [("(g1 anna x,[1.0, oops, 3.0, 4.0, 5.0])",), ("(g1 anna 1500,[1.0, 2.0])",)], "value string")
    got = sources.parse_extremes_text(lines).collect()
    assert got[0].rating is None and got[0].times == [1.0, None, 3.0, 4.0, 5.0]
    assert got[1].times == [1.0, 2.0, None, None, None]


def test_tagged_rows_are_written_apart_in_one_pass(spark, tmp_path):
    rows = [("g", "a", str(i), "x" if i % 4 == 0 else "1.5", None if i % 6 == 0 else "+3") for i in range(1, 25)]
    raw = spark.createDataFrame(
        rows, "game_id string, player string, move_no string, move_time string, centipawn_score string")
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    tagged = sources.typed_moves(raw.mapInArrow(run, raw.schema), on_bad="tag")
    good, bad, counts = sinks.quarantine(tagged, str(tmp_path / "moves"))
    assert seen.value == len(rows)
    wrong = {int(r[2]): [c for c, is_bad in (("move_time", r[3] == "x"), ("centipawn_score", r[4] is None)) if is_bad]
             for r in rows}
    assert {r.move_no: list(r.bad) for r in bad.collect()} == {n: w for n, w in wrong.items() if w}
    assert all(r.raw.move_time == ("x" if r.move_no % 4 == 0 else "1.5") for r in bad.collect())
    assert sorted(r.move_no for r in good.collect()) == [n for n, w in wrong.items() if not w]
    assert counts == {"good": good.count(), "bad": bad.count()} and dict(good.dtypes)["move_time"] == "double"
    none, all_good, counts = sinks.quarantine(
        sources.typed_moves(raw, on_bad="tag", need=("move_no",)).filter("move_no < 0"), str(tmp_path / "none"))
    assert (none.count(), all_good.count(), counts) == (0, 0, {"good": 0, "bad": 0})


def test_files_by_month_do_not_grow_with_tasks(spark, tmp_path):
    rows = [(f"g{i}", "a", i, 1.0, "+1") for i in range(400)]
    moves = moves_frame(spark, rows).selectExpr("*", "move_no % 5 AS month").repartition(40)
    sinks.write_moves(moves, str(tmp_path / "out"), partition_by=["month"])
    assert len(list((tmp_path / "out").glob("month=*/*.parquet"))) <= 10
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_score_lists_text(spark):
    info, moves = info_frame(spark, INFO[:1]), moves_frame(spark, MOVES)
    text = ops.extremes_text(ops.score_extremes(info, moves), "moves")
    assert sorted(r.value for r in text.collect())[0].startswith(
        "(g1 anna,[(0.0016666666666666668,10.0), (0.0033333333333333335,10.0), ")


def test_moves_table(spark, tmp_path):
    moves = moves_frame(spark, MOVES).withColumn("month", F.lit("jan"))
    sinks.write_moves(moves, str(tmp_path / "p"), partition_by=["month"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.columns == ["game_id", "player", "move_no", "move_time", "centipawn_score", "month"]
    assert back.count() == len(MOVES)
    sinks.write_moves(moves, str(tmp_path / "c"), fmt="csv")
    names = {n: n for n in schemas.MOVES if n != "move"}
    raw = sources.read_raw(spark, str(tmp_path / "c"))
    again = sources.typed_moves(raw.select(*names))
    assert sorted(tuple(r) for r in again.select(
        "game_id", "player", "move_no", "move_time", "centipawn_score").collect()) == sorted(MOVES)


def game_text(i, newline="\n"):
    return newline.join([
        f'[Event "rated {i}"]', f'[GameNo "{i}"]', '[Date "2020.01.15"]',
        '[White "anna"]', '[Black "ben"]', '[TimeControl "180+2"]', "",
        f"1. e4 {{[%emt 0.0]}} e5 {{[%emt 0.0]}} 2. Nf3 {{[%emt {i}.5]}} ({{2.75}} 2. f4) 1-0",
    ])


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_pgn_archive(spark, tmp_path, newline):
    path = tmp_path / "games.pgn"
    path.write_bytes((newline * 2).join(game_text(i, newline) for i in (1, 2, 3)).encode()
                     + newline.encode())
    games = sources.read_pgn(spark, str(path), newline, id_tag="GameNo")
    rows = {r.game_id: r for r in games.collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["2"].white == "anna" and rows["2"].time_control == "180+2"
    assert rows["2"].white_elo is None
    times = {(r.game_id, r.move_no): r.move_time for r in sources.clock_times(games).collect()}
    assert times[("3", 3)] == 3.5 and (("3", 1) in times)
    moves = sources.pgn_moves(games).filter("game_id = '2'").orderBy("move_no").collect()
    assert [(r.move_no, r.side, r.move) for r in moves] == [
        (1, "w", "e4"), (2, "b", "e5"), (3, "w", "Nf3")]
    unnamed = sources.read_pgn(spark, str(path), newline)
    assert unnamed.select("game_id").distinct().count() == 3


def test_archive_to_analysis(spark, tmp_path):
    class CountMoves:
        """Scorer that numbers the moves of a game."""

        def __init__(self):
            self.seen = 0

        def __call__(self, rows):
            first, self.seen = self.seen + 1, self.seen + len(rows)
            return [f"+{i}" for i in range(first, self.seen + 1)]

    path = tmp_path / "games.pgn"
    path.write_text("\n\n".join(game_text(i) for i in (1, 2)) + "\n")
    games = sources.read_pgn(spark, str(path), id_tag="GameNo")
    moves = sources.pgn_moves(games).join(games.select("game_id", "white", "black"), "game_id")
    moves = moves.selectExpr(
        "game_id", "if(side = 'w', white, black) AS player", "move_no", "move")
    sinks.write_moves(
        prepare_moves(moves, sources.clock_times(games), CountMoves), str(tmp_path / "m"))
    back = sources.read_moves(spark, str(tmp_path / "m"), "parquet")
    assert back.columns == ["game_id", "player", "move_no", "move", "move_time", "centipawn_score"]
    rows = [tuple(r) for r in back.filter("game_id = '2'").orderBy("move_no").collect()]
    assert rows == [("2", "anna", 1, "e4", 0.0, "+1"), ("2", "ben", 2, "e5", 0.0, "+2"),
                    ("2", "anna", 3, "Nf3", 2.5, "+3")]
    info = games.selectExpr("game_id", "white", "black", "'1-0' AS result", "1500 AS white_elo",
                            "1500 AS black_elo", "time_control")
    rel = {r.game_id: r.rel_time for r in ops.relative_moves(info, back).collect()}
    assert rel == {"1": 1.5 / 180, "2": 2.5 / 180}


def test_attach_and_reconcile(spark):
    moves = spark.createDataFrame([("g1", 1), ("g1", 2), ("g2", 1)], "game_id string, move_no int")
    times = spark.createDataFrame(
        [("g1", 1, 0.5), ("g2", 1, 1.0), ("g3", 1, 2.0)],
        "game_id string, move_no int, move_time double")
    attached = {(r.game_id, r.move_no): r.move_time for r in ops.attach_times(moves, times).collect()}
    assert attached == {("g1", 1): 0.5, ("g1", 2): None, ("g2", 1): 1.0}
    counts = {r.game_id: (r.n_moves, r.n_times, r.matches)
              for r in ops.reconcile_times(moves, times).collect()}
    assert counts == {"g1": (2, 1, False), "g2": (1, 1, True), "g3": (0, 1, False)}


@pytest.mark.parametrize("text", [False, True])
def test_jobs(spark, exports, tmp_path, text):
    moves = sources.read_moves(spark, exports[0])
    info = sources.read_game_info(spark, exports[1])
    out = str(tmp_path / "jan")
    paths = {kind: run_job(spark, kind, moves, info, out, text=text) for kind in KINDS}
    names = {kind: set(p) for kind, p in paths.items()}
    assert names["Outcome"] == {"Totals", "AverageMoveTimes", "SumMoveTimes"}
    assert names["Rating"] == {"AllMoveTimes", "AverageMoveTime", "Extremes",
                               "FastestMoveTimes", "SlowestMoveTimes"}
    assert names["Score"] == {"AllMoveTimes", "Extremes", "FastestMoveTimes", "SlowestMoveTimes"}
    every = [p for group in paths.values() for p in group.values()]
    assert len(every) == len(set(every))
    fast = paths["Rating"]["FastestMoveTimes"]
    read = sources.read_extremes_text(spark, fast) if text else spark.read.parquet(fast)
    direct = ops.rating_extremes(info, moves)
    key = lambda r: r.player
    assert same([r.times for r in sorted(read.collect(), key=key)],
                [r.times for r in sorted(direct.collect(), key=key)])
    pairs = paths["Score"]["AllMoveTimes"]
    read = (sources.read_pairs(spark, pairs, schemas.SCORE_VALUES) if text
            else spark.read.parquet(pairs))
    assert read.count() == ops.relative_moves(info, moves).count()
    with pytest.raises(ValueError):
        run_job(spark, "Other", moves, info, out)


@pytest.mark.parametrize("kind", KINDS)
def test_jobs_read_their_inputs_once(spark, tmp_path, kind):
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
    run_job(spark, kind, counted("moves", read["moves"]), counted("info", read["info"]), str(tmp_path / "out"))
    assert {name: seen.value for name, seen in read.items()} == {"moves": len(MOVES), "info": len(INFO)}


def test_fold_keeps_state_across_batches(spark):
    rows = [(f"g{g}", n, float(g + n)) for g in range(5) for n in range(1, 80)]
    moves = spark.createDataFrame(rows, "game_id string, move_no int, move_time double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        folded = ops.score_moves(moves.repartition(6), RunningTime, ("move_time",), "score")
        got = {(r.game_id, r.move_no): float(r.score) for r in folded.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected, total = {}, {}
    for game, n, time in sorted(rows, key=lambda r: (r[0], r[1])):
        total[game] = total.get(game, 0.0) + time
        expected[(game, n)] = total[game]
    assert got == expected

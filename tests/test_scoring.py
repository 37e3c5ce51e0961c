import pytest
from pyspark.sql import functions as F

from tenfold.functions import throws as T
from tenfold.operators import scoring

GAMES = {
    "perfect": (T.PERFECT_GAME, [30, 60, 90, 120, 150, 180, 210, 240, 270, 300]),
    "spares": (["5/"] * 9 + ["5/5"], [15 * i for i in range(1, 11)]),
    "nines": (["9-"] * 10, [9 * i for i in range(1, 11)]),
    "gutter": (["--"] * 10, [0] * 10),
    "pending": (["X"], [None]),
    "pending2": (["X", "X"], [None, None]),
    "J": (["X", "5-", "-7", "4-"], [15, 20, 27, 31]),
    "V": (["8-", "3-", "71", "8o1"], [8, 11, 19, 28]),
    "P": (["X", "4/", "9-", "6-"], [20, 39, 48, 54]),
    "T": (["61", "1/", "8-", "3"], [7, 25, 33, None]),
    "skips_unreadable": (["X", "?1", "5-"], [15, None, None]),
}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(g, i + 1, t) for g, (texts, _) in GAMES.items() for i, t in enumerate(texts)]
    frames = spark.createDataFrame(rows, "game string, frame int, text string")
    return scoring.score(scoring.parse(frames), ["game"]).cache()


def test_cumulative(scored):
    got = {}
    for r in scored.orderBy("game", "frame").collect():
        got.setdefault(r.game, []).append(r.cumulative)
    assert got == {g: c for g, (_, c) in GAMES.items()}


def test_totals(scored):
    t = {r.game: (r.total, r.provisional_total) for r in scoring.totals(scored, ["game"]).collect()}
    assert t["T"] == (33, 36)
    assert t["pending"] == (None, None)
    assert t["gutter"] == (0, 0)


def test_split_mark(scored):
    assert [r.frame for r in scored.filter("game = 'V' AND split").collect()] == [4]


@pytest.mark.parametrize(
    "text,frame,rolls",
    [("4/", 1, [4, 6]), ("-/", 1, [0, 10]), ("X7/", 10, [10, 7, 3]), ("9/X", 10, [9, 1, 10]), ("?1", 1, None), ("77", 1, None), ("/", 1, None), ("o", 1, None), (" 8o1 ", 1, [8, 1]), ("", 1, []), (None, 1, []), ("123", 1, [1, 2, 3]), ("XX", 1, [10, 10])],
)
def test_parse(spark, text, frame, rolls):
    r = scoring.parse(spark.createDataFrame([(frame, text)], "frame int, text string")).first()
    assert (r.rolls if r.readable else None) == rolls


def test_strict_bonus_waits_for_unreadable_frame(spark):
    rows = [("a", i + 1, t) for i, t in enumerate(["X", "?1", "5-"])]
    f = scoring.parse(spark.createDataFrame(rows, "game string, frame int, text string"))
    assert [r.cumulative for r in scoring.score(f, ["game"], strict_bonus=True).orderBy("frame").collect()] == [None, None, None]


@pytest.mark.parametrize("repair", [True, False])
def test_cross_check(spark, repair):
    f = spark.createDataFrame([("a", 1, "X", 16, 20), ("a", 2, "5-", 20, 20)], "game string, frame int, text string, printed int, printed_total int")
    p = scoring.players(f, ["game"], repair).first()
    assert p.mismatched_frames == [1] and p.repaired_frames == ([1] if repair else [])
    assert p.frames[0].printed == (15 if repair else 16) and p.frames[0].printed_raw == 16
    assert p.total_agrees and p.agreement == 0.5


def test_nothing_to_check(spark):
    f = spark.createDataFrame([("a", 1, "", None, None)], "game string, frame int, text string, printed int, printed_total int")
    p = scoring.players(f, ["game"]).first()
    assert p.agreement == 1.0 and p.total is None and p.provisional_total is None and p.total_agrees is None


def test_small_functions(spark):
    d = spark.createDataFrame([("8o1",)], "t string")
    r = d.select(T.shown(F.col("t")).alias("s"), T.whole_number(F.lit(" 12 ")).alias("n"), T.whole_number(F.lit("-1")).alias("m"), T.seconds(F.lit(42), F.lit(25.0)).alias("x"), T.seconds(F.lit(42), F.lit(0.0)).alias("y")).first()
    assert (r.s, r.n, r.m, r.x, r.y) == ("(8)1", 12, None, 1.68, None)


def test_scaffold(spark):
    r = scoring.scaffold(spark.createDataFrame([("p0.f1.throws", "X"), ("p3.f10.score", "99")], "key string, text string")).collect()
    assert len(r) == 40
    assert {(x.player, x.frame, x.throws, x.score) for x in r if x.throws or x.score} == {(0, 1, "X", ""), (3, 10, "", "99")}


def test_scaffold_of_several_boards(spark):
    readings = [(0, "p0.f1.throws", "X"), (5, "p0.f1.throws", "9/"), (5, "p3.f10.score", "99"), (None, "p1.f2.throws", "-")]
    r = scoring.scaffold(spark.createDataFrame(readings, "board int, key string, text string"), board=["board"]).collect()
    assert len(r) == 120
    assert {(x.board, x.player, x.frame, x.throws, x.score) for x in r if x.throws or x.score} == {(0, 0, 1, "X", ""), (5, 0, 1, "9/", ""), (5, 3, 10, "", "99"), (None, 1, 2, "-", "")}

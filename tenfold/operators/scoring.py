"""Scores of games: one row a frame in, windows over a game's frames, never a row-by-row loop.

`keys` name the columns of a game; a game has at most ten frames, so its windows are of bounded size
and a game costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenfold.functions import throws


def parse(frames: DataFrame) -> DataFrame:
    """Adds tokens, rolls, split, readable, played and complete to rows of frame and text; null text is blank."""
    marks = throws.tokens(F.coalesce("text", F.lit("")))
    p = frames.withColumn("tokens", marks).withColumn("_p", throws.parsed(F.col("tokens")))
    p = p.withColumn("readable", F.col("_p.readable")).withColumn("rolls", F.when(F.col("readable"), F.col("_p.rolls")).otherwise(F.array().cast("array<int>")))
    p = p.withColumn("split", throws.split(F.col("tokens"))).withColumn("played", F.size("rolls") > 0)
    return p.withColumn("complete", throws.complete(F.col("rolls"), F.col("frame"))).drop("_p")


def _points(strict_bonus: bool) -> Column:
    roll = lambda i: F.get("rolls", F.lit(i))
    ahead = lambda i: F.get("ahead", F.lit(i))
    blocked = F.col("blocked") if strict_bonus else F.lit(False)
    early = (
        F.when(roll(0) == 10, F.when(~blocked, 10 + ahead(1) + ahead(2)))
        .when(roll(0) + roll(1) == 10, F.when(~blocked, 10 + ahead(2)))
        .when(F.size("rolls") >= 2, roll(0) + roll(1))
    )
    whole = F.aggregate("rolls", F.lit(0), lambda a, x: a + x)
    return F.when(F.col("played"), F.when(F.col("frame") < throws.FRAMES, early).otherwise(F.when(F.col("complete"), whole)))


def score(frames: DataFrame, keys: list[str], strict_bonus: bool = False) -> DataFrame:
    """Adds frame_score and cumulative to parsed frames, null from the first frame on that is not settled.

    An unreadable frame has no rolls, so the bonus of a strike or spare before it comes from the
    frame after it; with `strict_bonus` such a frame stays open instead.
    """
    order = Window.partitionBy(*keys).orderBy("frame")
    ahead = F.flatten(F.collect_list("rolls").over(order.rowsBetween(0, Window.unboundedFollowing)))
    blocked = F.coalesce(F.max(~F.col("readable")).over(order.rowsBetween(1, 2)), F.lit(False))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    s = frames.withColumn("ahead", ahead).withColumn("blocked", blocked).withColumn("_points", _points(strict_bonus))
    settled = F.min(F.col("_points").isNotNull()).over(so_far)
    s = s.withColumn("frame_score", F.when(settled, F.col("_points")))
    return s.withColumn("cumulative", F.when(settled, F.sum("_points").over(so_far).cast("int"))).drop("ahead", "blocked", "_points")


def _sums() -> list[Column]:
    """The last settled sum of a game's frames, and the pins of an open frame in play."""
    open_ = F.col("cumulative").isNull() & F.col("played")
    pins = F.aggregate("rolls", F.lit(0), lambda a, x: a + x)
    first, second = F.get("rolls", F.lit(0)), F.get("rolls", F.lit(1))
    credit = F.when((first == 10) | F.coalesce(first + second == 10, F.lit(False)), 0).otherwise(pins)
    return [F.max_by("cumulative", F.when(F.col("cumulative").isNotNull(), F.col("frame"))).alias("total"), F.min_by(credit, F.when(open_, F.col("frame"))).alias("_more")]


def _with_shown(sums: DataFrame) -> DataFrame:
    base = F.coalesce("total", F.lit(0)) + F.coalesce("_more", F.lit(0))
    return sums.withColumn("provisional_total", F.when(F.col("total").isNotNull() | (base != 0), base)).drop("_more")


def totals(scored: DataFrame, keys: list[str]) -> DataFrame:
    """total and provisional_total of each game: the last settled sum, and with the pins of an open frame in play."""
    return _with_shown(scored.groupBy(*keys).agg(*_sums()))


def cross_check(scored: DataFrame, repair: bool = True) -> DataFrame:
    """Adds checked, mismatched and repaired to frames with printed totals; a repaired printed total becomes the computed one, printed_raw stays."""
    checked = F.col("printed").isNotNull() & F.col("cumulative").isNotNull()
    c = scored.withColumn("printed_raw", F.col("printed")).withColumn("checked", checked)
    c = c.withColumn("mismatched", F.col("checked") & (F.col("printed") != F.col("cumulative")))
    c = c.withColumn("mismatched", F.coalesce("mismatched", F.lit(False))).withColumn("repaired", F.col("mismatched") & F.lit(repair))
    return c.withColumn("printed", F.when(F.col("repaired"), F.col("cumulative")).otherwise(F.col("printed")))


def player_rows(scored: DataFrame, keys: list[str], repair: bool = True) -> DataFrame:
    """A row a game from scored frames with printed totals: nested frames, totals, mismatches and agreement, in one aggregation."""
    checked = cross_check(scored, repair)
    frame = F.struct("frame", "text", "rolls", "split", "complete", "readable", "frame_score", "cumulative", "printed", "printed_raw")
    which = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("frame")))).alias(f"{c}_frames")
    kept = [F.max("printed_total").alias("printed_total")] if "printed_total" in scored.columns else []
    p = checked.groupBy(*keys).agg(F.array_sort(F.collect_list(frame)).alias("frames"), *kept, F.sum(F.col("checked").cast("int")).alias("checked"), which("mismatched"), which("repaired"), *_sums())
    return _with_shown(p).withColumn("agreement", throws.agreement(F.col("checked"), F.size("mismatched_frames")))


def agreed(players: DataFrame) -> DataFrame:
    """Adds computed_total, and whether printed_total, never repaired, is that; null where either is missing."""
    return players.withColumn("computed_total", F.col("provisional_total")).withColumn("total_agrees", F.col("printed_total") == F.col("provisional_total"))


def players(frames: DataFrame, keys: list[str], repair: bool = True, strict_bonus: bool = False) -> DataFrame:
    """`player_rows`, `agreed`, from frame, text, printed and printed_total (of any of a game's rows)."""
    return agreed(player_rows(score(parse(frames), keys, strict_bonus), keys, repair))


def scaffold(readings: DataFrame, players: int = 4, board: list[str] | None = None) -> DataFrame:
    """player, frame, throws and score of every cell of a board from readings (key, text); a missing one is blank.

    With the key columns `board`, of every board that has a reading.
    """
    board = board or []
    spark = readings.sparkSession
    grid = spark.range(players).select(F.col("id").cast("int").alias("player"), F.explode(F.sequence(F.lit(1), F.lit(throws.FRAMES))).alias("frame"))
    key = lambda what: F.format_string(f"p%d.f%d.{what}", "player", "frame")
    if board:
        grid = readings.select(*board).distinct().crossJoin(F.broadcast(grid))
    for what in ("throws", "score"):
        r = readings.select(F.col("key").alias(f"_{what}"), F.col("text").alias(what), *(F.col(k).alias(f"_{k}") for k in board))
        on = key(what) == F.col(f"_{what}")
        for k in board:
            on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        grid = grid.join(r, on, "left").drop(f"_{what}", *(f"_{k}" for k in board)).withColumn(what, F.coalesce(what, F.lit("")))
    return grid

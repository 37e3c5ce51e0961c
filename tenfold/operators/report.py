"""Sinks: nested JSON, flat CSV, a text table, and accuracy figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.functions.throws import FRAMES, seconds, shown

CELL = 7


def flat(players: DataFrame, label: str) -> DataFrame:
    """The 24 columns of the CSV report, strings, nulls as blanks, a row a player."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def at(i: int):
        return F.get(F.filter("frames", lambda f: f["frame"] == i), F.lit(0))

    columns = [blank(F.col(label)).alias("player")]
    columns += [blank(at(i)["text"]).alias(f"f{i}_throws") for i in range(1, FRAMES + 1)]
    columns += [blank(at(i)["cumulative"]).alias(f"f{i}_total") for i in range(1, FRAMES + 1)]
    columns += [blank(F.col("provisional_total")).alias("total_shown"), blank(F.col("printed_total")).alias("total_printed"), blank(F.col("total_agrees")).alias("totals_agree")]
    return players.select(*columns)


def write_csv(players: DataFrame, label: str, path: str) -> None:
    flat(players, label).write.option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def body(label: str):
    """A player's initial, frames, totals and checks as one struct."""
    frame = lambda f: F.struct(
        f["frame"].alias("frame"), f["text"].alias("throws"), f["rolls"].alias("rolls"), f["split"].alias("split"), f["complete"].alias("complete"),
        f["frame_score"].alias("frame_score"), f["cumulative"].alias("running_total"), f["printed"].alias("printed_total"),
    )
    return F.struct(
        F.col(label).cast("string").alias("initial"), F.transform("frames", frame).alias("frames"), F.col("total").alias("total_settled"), F.col("provisional_total").alias("total_shown"),
        F.col("printed_total").alias("total_printed"), F.col("total_agrees"), F.col("mismatched_frames"), F.col("repaired_frames"), F.round("agreement", 4).alias("frame_agreement"),
    )


def nested(players: DataFrame, label: str) -> DataFrame:
    """initial and json: each player's `body`, nulls written out."""
    return players.select(F.col(label).cast("string").alias("initial"), F.to_json(body(label), {"ignoreNullFields": "false"}).alias("json"))


def document(video: DataFrame, quality: DataFrame, players: DataFrame, transitions: DataFrame, titles: DataFrame, label: str, order: str | None = None) -> DataFrame:
    """One row, json: source, scoreboard, quality and timeline; players by `order`, by default their label.

    video has file, width, height, fps and n_frames; titles lane and bowler.  A board has four
    players and a bounded timeline, so one row holds them.
    """
    source = video.select(F.struct(
        "file", F.format_string("%dx%d", "width", "height").alias("resolution"), F.round("fps", 3).alias("fps"), F.col("n_frames").alias("frames"),
        F.coalesce(seconds(F.col("n_frames"), F.col("fps")), F.lit(0.0)).alias("duration_s"),
    ).alias("source"), F.col("fps").alias("_fps"))
    people = players.agg(F.array_sort(F.collect_list(F.struct(F.col(order or label).alias("at"), body(label).alias("player")))).alias("_p")).select(F.transform("_p", lambda p: p["player"]).alias("players"))
    board = titles.crossJoin(people).select(F.struct("lane", F.col("bowler").alias("bowler_up"), "players").alias("scoreboard"))
    figures = quality.select(F.struct(
        F.col("frames_total").alias("frames_sampled"), F.col("frames_with_board").alias("frames_with_scoreboard"), F.round("detection_rate", 4).alias("detection_rate"),
        F.col("frames_occluded").alias("frames_with_occlusion"), F.round("mean_glyph_confidence", 4).alias("mean_glyph_confidence"),
        F.col("frames_checked").alias("frames_cross_checked"), F.round("rules_agreement", 4).alias("scoring_rule_agreement"),
    ).alias("quality"))
    line = F.struct(F.col("frame_index").alias("frame"), "key", F.col("old").alias("from"), F.col("new").alias("to"))
    times = transitions.agg(F.array_sort(F.collect_list(line)).alias("_t"))
    whole = source.crossJoin(board).crossJoin(figures).crossJoin(times)
    timeline = F.transform("_t", lambda t: F.struct(t["frame"].alias("frame"), seconds(t["frame"], F.col("_fps")).alias("time_s"), t["key"].alias("cell"), t["from"].alias("from"), t["to"].alias("to")))
    return whole.select(F.to_json(F.struct("source", "scoreboard", "quality", timeline.alias("timeline")), {"ignoreNullFields": "false"}).alias("json"))


def centred(text, width: int = CELL):
    """Text in the middle of a cell, the odd space to the left of an even cell's text and to the right otherwise, as str.center does."""
    n = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    left = F.floor(n / 2) + F.when((n % 2 == 1) & F.lit(width % 2 == 1), 1).otherwise(0)
    return F.concat(F.repeat(F.lit(" "), left.cast("int")), text, F.repeat(F.lit(" "), (n - left).cast("int")))


def text_rows(players: DataFrame, label: str) -> DataFrame:
    """label, throws_line and totals_line: a player's two lines of the text table."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    one = lambda c: F.array_join(F.transform("frames", c), "|")
    head = F.concat(F.lit(" "), F.rpad(F.when(blank(F.col(label)) == "", "?").otherwise(blank(F.col(label))), 3, " "), F.lit(" |"))
    first = F.concat(head, one(lambda f: centred(shown(f["text"]))), F.lit("|"), centred(blank(F.col("provisional_total"))))
    second = F.concat(F.lit("     |"), one(lambda f: centred(blank(f["cumulative"]))), F.lit("|" + " " * CELL))
    return players.select(F.col(label).alias("player"), first.alias("throws_line"), second.alias("totals_line"))


def text_table(players: DataFrame, label: str, lane: str = "", bowler: str = "", order: str | None = None) -> str:
    """The board as fixed-width text, players by `order`; a board has a handful of rows."""
    head = "     |" + "|".join(str(i).center(CELL) for i in range(1, FRAMES + 1)) + "|" + "TTL".center(CELL)
    rule = "-" * len(head)
    lines = [f"Lane {lane or '?'}".ljust(12) + f"Now bowling: {bowler or '?'}", rule, head, rule]
    for r in text_rows(players.orderBy(order or label), label).collect():
        lines += [r.throws_line, r.totals_line, rule]
    return "\n".join(lines)


def accuracy(readings: DataFrame, truth: DataFrame) -> DataFrame:
    """right, total and accuracy of cells of `truth` (key, text), a missing reading counting as blank."""
    both = truth.select("key", F.col("text").alias("want")).join(readings.select("key", "text"), "key", "left")
    return both.agg(F.count_if(F.coalesce("text", F.lit("")) == F.col("want")).alias("right"), F.count("*").alias("total")).withColumn("accuracy", F.try_divide(F.col("right").cast("double"), F.col("total")))


def errors(readings: DataFrame, truth: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent wrong readings: error ("want -> got") and its count."""
    both = truth.select("key", F.col("text").alias("want")).join(readings.select("key", "text"), "key", "left").withColumn("got", F.coalesce("text", F.lit("")))
    wrong = both.filter("got <> want").groupBy(F.concat_ws(" -> ", "want", "got").alias("error")).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "error").limit(top)

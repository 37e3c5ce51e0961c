"""Whole jobs on frames of a board: its document, a preview of one frame, and a bank of templates.

Pixels are read once, into a table of detections in the shared folder; all that follows is relational.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.functions.throws import whole_number
from tenfold.operators import calibrate, fusion, geometry, matching, report, scoring, vision
from tenfold.operators.vision import BOARD, Layout
from tenfold.sources import shared

TITLES = ["title.lane", "title.bowler"]


class Result(NamedTuple):
    """Tables of a board: readings, its players, changes in order, lane and bowler, and figures."""

    readings: DataFrame
    players: DataFrame
    timeline: DataFrame
    titles: DataFrame
    quality: DataFrame


def detected(frames: DataFrame, layout: Layout = BOARD) -> DataFrame:
    """Detections of frames (frame_index, image) as a table; ValueError if there is no board in any."""
    path = shared.folder(frames.sparkSession, "detections")
    vision.read_boards(frames, layout).write.parquet(path)
    found = frames.sparkSession.read.parquet(path)
    if found.filter("ok").isEmpty():
        raise ValueError("no frame shows a board")
    return found


def title_observations(found: DataFrame, bank: DataFrame, layout: Layout = BOARD) -> DataFrame:
    """Observations of lane and bowler in all frames with a board, a blank where nothing could be read; confidence 1."""
    marks = found.filter("ok").select("frame_index", F.explode("title").alias("g")).select("frame_index", "g.ix", "g.cx", F.col("g.bitmap").alias("vec"))
    marks = marks.withColumn("glyph_id", F.concat_ws("/", "frame_index", "ix"))
    named = marks.drop("vec").join(matching.nearest(marks.select("glyph_id", "vec"), bank), "glyph_id")
    read = found.filter("ok").select("frame_index").join(matching.titles(named, ["frame_index"], layout.width), "frame_index", "left")
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(k.split(".")[1], F.lit("")).alias("text")) for k in TITLES))).alias("t")
    return read.select("frame_index", pairs).select("t.key", "frame_index", "t.text", F.lit(1.0).alias("confidence"), F.col("frame_index").alias("pos"))


def finished(observations: DataFrame, counts: DataFrame, repair: bool = True) -> Result:
    """The result of observations (key, frame_index, text, confidence, pos) of a board's cells and titles.

    Titles are voted on as cells are, but their changes are no part of the timeline.
    """
    readings = fusion.vote(observations, fusion.tail_cutoff(observations))
    timeline = fusion.transitions(observations.filter(~F.col("key").isin(TITLES))).orderBy("frame_index", "key")
    grid = scoring.scaffold(readings.select("key", "text"))
    side = readings.select(F.regexp_extract("key", r"^p(\d+)\.(initial|total)$", 1).alias("p"), F.regexp_extract("key", r"\.(\w+)$", 1).alias("role"), "text").filter("p <> ''")
    side = side.groupBy(F.col("p").cast("int").alias("player")).agg(F.max(F.when(F.col("role") == "initial", F.col("text"))).alias("initial"), F.max(F.when(F.col("role") == "total", whole_number(F.col("text")))).alias("printed_total"))
    frames = grid.select("player", "frame", F.col("throws").alias("text"), whole_number(F.col("score")).alias("printed"))
    scored = scoring.score(scoring.parse(frames), ["player"])
    players = scoring.player_rows(scored, ["player"], repair).join(side, "player", "left").withColumn("initial", F.coalesce("initial", F.lit("")))
    titles = readings.agg(*(F.coalesce(F.max(F.when(F.col("key") == k, F.col("text"))), F.lit("")).alias(k.split(".")[1]) for k in TITLES))
    quality = fusion.quality(counts, readings, scoring.cross_check(scored, repair))
    return Result(readings, scoring.agreed(players).orderBy("player"), timeline, titles, quality)


def extract(frames: DataFrame, bank: DataFrame, repair: bool = True, layout: Layout = BOARD) -> Result:
    """The result of all frames; ValueError if no frame shows a board."""
    found = detected(frames, layout)
    both = vision.observations(found, bank).unionByName(title_observations(found, bank, layout))
    path = shared.folder(frames.sparkSession, "observations")
    both.write.parquet(path)
    counts = fusion.counters(found.select("frame_index", "ok", (F.size("occluders") > 0).alias("occluded")))
    return finished(frames.sparkSession.read.parquet(path), counts, repair)


def document(result: Result, video: DataFrame) -> DataFrame:
    """The nested report of a result as one row of JSON; `video` as `frames.described` gives it."""
    return report.document(video, result.quality, result.players, result.timeline, result.titles, "initial", "player")


def summary(result: Result) -> str:
    """The text table and, below it, the figures; a board has a handful of rows."""
    t, q = result.titles.first(), result.quality.first()
    lines = [report.text_table(result.players, "initial", t.lane, t.bowler, "player"), ""]
    lines.append(f"board in {q.frames_with_board} of {q.frames_total} frames ({q.detection_rate:.0%}), {q.frames_occluded} partly hidden")
    lines.append(f"mean confidence {q.mean_glyph_confidence:.3f}; {q.rules_agreement:.1%} of {q.frames_checked} printed sums agree")
    return "\n".join(lines)


def preview(frames: DataFrame, at: int, bank: DataFrame | None = None, layout: Layout = BOARD) -> tuple[DataFrame, DataFrame]:
    """The detection of one frame, and all its cells, hidden or not: key, glyphs (their number), box, and with a bank text and confidence."""
    found = vision.read_boards(frames.filter(F.col("frame_index") == at), layout)
    cells = vision.cell_rows(found)
    out = cells.select("frame_index", "key", "box", F.size("glyphs").alias("glyphs"))
    if bank is not None:
        marks = vision.glyph_rows(cells).withColumn("glyph_id", F.concat_ws("/", "key", "ix"))
        named = marks.drop("vec").join(matching.nearest(marks.select("glyph_id", "vec"), bank), "glyph_id")
        out = out.join(matching.with_blanks(matching.cells(named, ["frame_index", "key"]), cells, ["frame_index", "key"]), ["frame_index", "key"])
    return found, out.orderBy("key")


def collected(found: DataFrame, most: int | None = None) -> DataFrame:
    """frame_index, key, ix, cx, vec, role and pos of all marks in cells that can be seen and in titles, of the first `most` frames with a board."""
    boards = found.filter("ok")
    if most is not None:
        boards = boards.orderBy("frame_index").limit(most)
    over = boards.select("frame_index", F.explode("occluders").alias("box"))
    cells = geometry.visible(vision.cell_rows(boards), over, ["frame_index"])
    inside = cells.select("frame_index", "key", "role", F.explode("glyphs").alias("g"))
    titles = boards.select("frame_index", F.lit("title").alias("key"), F.lit("title").alias("role"), F.explode("title").alias("g"))
    marks = inside.unionByName(titles).select("frame_index", "key", "role", "g.ix", "g.cx", F.col("g.bitmap").alias("vec"))
    return marks.withColumn("pos", F.struct("frame_index", "key", "ix"))


def clustered(found: DataFrame, folder: str, typed: DataFrame | None = None, **limits) -> DataFrame:
    """Clusters of all marks as a table in `folder`, with the labels (cluster_id, label) that were typed for them before."""
    spark = found.sparkSession
    clusters = calibrate.clusters(collected(found), **limits)
    typed = typed if typed is not None else spark.createDataFrame([], "cluster_id int, label string")
    calibrate.carried_labels(clusters, typed).write.mode("overwrite").parquet(f"{folder}/clusters")
    return spark.read.parquet(f"{folder}/clusters")


def bank_of(folder: str, typed: DataFrame) -> DataFrame:
    """The bank of the clusters in `folder` that have a label."""
    return calibrate.bank(typed.sparkSession.read.parquet(f"{folder}/clusters").drop("label"), typed)

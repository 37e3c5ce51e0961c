"""Frames as rows: metadata, systematic samples, point lookups, segments, image files and banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenfold.functions.throws import seconds


def images(spark: SparkSession, path: str) -> DataFrame:
    """frame_index and image (BGR bytes) of image files; the number in a file's name is its frame.

    FileNotFoundError if there is no such path, ValueError if it holds no image that can be read.
    """
    from pyspark.errors import AnalysisException

    try:
        f = spark.read.format("image").option("dropInvalid", True).load(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no frames at {path}") from e
    found = f.select(F.regexp_extract("image.origin", r"(\d+)\.[^./]+$", 1).cast("int").alias("frame_index"), "image").filter("frame_index IS NOT NULL")
    if found.isEmpty():
        raise ValueError(f"no readable frame at {path}")
    return found


def described(frames: DataFrame, path: str, fps: float) -> DataFrame:
    """file, width, height, fps, n_frames and duration_s of a table of frames; sizes are those of its first frame."""
    size = frames.agg(F.min_by(F.struct("image.width", "image.height"), "frame_index").alias("s"))
    p = probed(frames, "frame_index", path, fps)
    return p.crossJoin(size).select(F.regexp_extract("path", "([^/]+)/*$", 1).alias("file"), "s.width", "s.height", "fps", "n_frames", "duration_s")


def probed(frames: DataFrame, index: str, path: str, fps: float) -> DataFrame:
    """path, n_frames, fps and duration_s of a table of frames; without a frame rate 25 is taken."""
    fps = fps or 25.0
    n = frames.agg(F.coalesce(F.max(index) + 1, F.lit(0)).cast("int").alias("n_frames"))
    return n.select(F.lit(path).alias("path"), "n_frames", F.lit(float(fps)).alias("fps"), seconds(F.col("n_frames"), F.lit(float(fps))).alias("duration_s"))


def sampled(frames: DataFrame, index: str, every: int = 2, start: int = 0, limit: int | None = None) -> DataFrame:
    """Every n-th frame from `start` on, the first `limit` of them; a limit of 0 gives none."""
    kept = frames.filter((F.col(index) >= start) & ((F.col(index) - start) % max(1, every) == 0))
    return kept if limit is None else kept.orderBy(index).limit(limit)


def one(frames: DataFrame, index: str, at: int) -> DataFrame:
    """The frame with an index; IndexError if there is none."""
    found = frames.filter(F.col(index) == at)
    if found.isEmpty():
        raise IndexError(f"no frame {at}")
    return found


def segments(spark: SparkSession, parts: list[tuple[str, int]]) -> DataFrame:
    """segment, kind, start and end (exclusive) of segments laid end to end."""
    s = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(parts)], "segment int, kind string, n long")
    end = F.sum("n").over(Window.orderBy("segment"))
    return s.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).drop("n")


def in_segments(frames: DataFrame, parts: list[tuple[str, int]], index: str = "frame_index") -> DataFrame:
    """Frames with the segment they fall in and its kind, "past_end" after the last; segments are a short list."""
    s = segments(frames.sparkSession, parts)
    inside = (F.col(index) >= F.col("start")) & (F.col(index) < F.col("end"))
    return frames.join(F.broadcast(s), inside, "left").withColumn("kind", F.coalesce("kind", F.lit("past_end")))


def clip(spark: SparkSession, parts: list[tuple[str, int]], late: str = "late", occluded: str = "inset", board: tuple[str, ...] = ("board", "inset")) -> DataFrame:
    """frame_index, kind, has_board, late and occluded of every frame of a clip of segments."""
    f = in_segments(spark.range(sum(n for _, n in parts)).withColumnRenamed("id", "frame_index"), parts)
    has: Column = F.lit(False)
    for b in board:
        has = has | F.col("kind").startswith(b)
    return f.select(F.col("frame_index").cast("int"), "kind", has.alias("has_board"), F.col("kind").endswith(late).alias("late"), F.col("kind").startswith(occluded).alias("occluded"))


def bank_from(spark: SparkSession, pairs: list[tuple[str, list[float]]]) -> DataFrame:
    """A bank of (label, vector) pairs."""
    return spark.createDataFrame([(i, label, [float(x) for x in vec]) for i, (label, vec) in enumerate(pairs)], "template_id int, label string, vec array<float>")


def write_bank(bank: DataFrame, path: str) -> None:
    bank.select("template_id", "label", "vec").write.mode("overwrite").parquet(path)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """A bank written before; FileNotFoundError with a hint if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select("template_id", "label", "vec")
    except AnalysisException as e:
        raise FileNotFoundError(f"no template bank at {path}; calibrate one first") from e

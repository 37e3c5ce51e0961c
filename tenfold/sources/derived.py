"""Inputs of the board's operators derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["user_id", "game"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def throws(events: DataFrame) -> DataFrame:
    """user_id, game, frame, text and printed_off (what a printed total is wrong by) from the events of each user, ten a game."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    mark = lambda n: F.when(n == 0, "-").otherwise(n.cast("string"))
    e = events.select("event_id", "user_id", "event_type", "value").withColumn("rn", rn)
    e = e.withColumn("r1", F.col("event_id") % 11).withColumn("z", F.round(F.col("value") * 100).cast("long") % 1000)
    e = e.withColumn("r2", F.when(F.col("r1") < 10, F.col("z") % (11 - F.col("r1")))).withColumn("frame", (F.col("rn") % 10 + 1).cast("int"))
    spare = F.col("r1") + F.col("r2") == 10
    extra = F.col("z") % 11
    tenth = F.when(F.col("r1") == 10, F.when(extra == 10, "XX").otherwise(F.concat(mark(extra), F.lit("-")))).when(spare, mark(F.col("z") % 10)).otherwise("")
    first = F.when(F.col("r1") == 10, "X").otherwise(F.concat(mark(F.col("r1")), F.when((F.col("r1") > 0) & (F.col("event_type") == "signup"), "o").otherwise("")))
    second = F.when(F.col("r1") == 10, "").when(spare, "/").otherwise(mark(F.col("r2")))
    text = F.concat(F.when(F.col("event_id") % 23 == 0, "?").otherwise(""), first, second, F.when(F.col("frame") == 10, tenth).otherwise(""))
    off = F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)
    return e.select("user_id", F.floor(F.col("rn") / 10).cast("int").alias("game"), "frame", text.alias("text"), off.alias("printed_off"))


def observations(events: DataFrame) -> DataFrame:
    """key, frame_index, text, confidence, pos: users as cells, hours as frames, event types as readings."""
    return events.select(
        F.col("user_id").alias("key"),
        F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("frame_index"),
        F.col("event_type").alias("text"),
        (F.col("event_id") % 100 / 100.0).alias("confidence"),
        F.col("event_id").alias("pos"),
    )


def glyphs(embeddings: DataFrame, every: int = 17) -> tuple[DataFrame, DataFrame]:
    """Vectors as glyphs, and as a bank those with vec_id below 30."""
    bank = embeddings.filter("vec_id < 30").select(F.col("vec_id").alias("template_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"))
    rest = embeddings.filter("vec_id >= 30").select(F.col("vec_id").alias("glyph_id"), F.col("embedding").alias("vec"))
    return rest, bank


def boxes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and occluders with integer boxes, 40 events a frame, three occluders in every frame."""
    frame = F.floor(F.col("event_id") / 40).cast("int").alias("frame_index")
    box = lambda x, y, w, h: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))
    i = F.col("event_id")
    cells = events.select("event_id", frame, box(i * 37 % 1300, i * 53 % 480, 60 + i % 80, 20 + i % 40).alias("box"))
    some = events.filter("event_id % 40 IN (3, 17, 29)").select(frame, box(i * 29 % 1000, i * 31 % 300, 150 + i % 300, 80 + i % 150).alias("box"))
    return cells, some

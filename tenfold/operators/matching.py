"""Glyphs against labelled templates, and glyphs into the text of a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenfold.functions.arrays import mean_distance

FARTHEST, LEAST_CONFIDENCE, UNKNOWN = 0.28, 0.35, "?"
#: Templates up to this estimated size are broadcast; a larger bank meets the glyphs in blocks of about that size.
BROADCAST = 64 << 20


def _pairs(glyphs: DataFrame, bank: DataFrame, most: int) -> DataFrame:
    """Each glyph with each template: the bank broadcast if it is small, else blocks of glyphs with blocks of templates, which a join by block deals to tasks."""
    size = int(str(bank._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # Catalyst knows none
        size = bank.agg(F.sum(F.size("template") * 4).cast("long")).first()[0] or 0
    if size <= most:
        return glyphs.crossJoin(F.broadcast(bank))
    blocks, parts = -(-size // most), int(glyphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    g = glyphs.withColumn("_g", some("glyph_id", parts)).withColumn("_b", each(blocks))
    b = bank.withColumn("_b", some("template_id", blocks)).withColumn("_g", each(parts))
    return g.join(b, ["_g", "_b"])


def nearest(glyphs: DataFrame, bank: DataFrame, farthest: float | None = FARTHEST, most: int = BROADCAST) -> DataFrame:
    """glyph_id, label, confidence, distance from glyphs (glyph_id, vec) and a bank (template_id, label, vec).

    Distance is the mean absolute difference; the nearest template wins, the smallest template_id on
    ties.  Confidence is the margin to the nearest template of another label, in relation to both;
    without another label that distance is 1.  Beyond `farthest` the label is "?" with confidence 0.
    """
    bank = bank.select("template_id", "label", F.col("vec").alias("template"))
    pairs = _pairs(glyphs.select("glyph_id", "vec"), bank, most).select("glyph_id", "label", "template_id", mean_distance(F.col("vec"), F.col("template")).alias("d"))
    by_label = pairs.groupBy("glyph_id", "label").agg(F.min(F.struct("d", "template_id")).alias("m"))
    rank = Window.partitionBy("glyph_id").orderBy("m")
    r = by_label.withColumn("_other", F.coalesce(F.lead("m.d").over(rank), F.lit(1.0))).withColumn("_n", F.row_number().over(rank)).filter("_n = 1")
    best, other = F.col("m.d"), F.col("_other")
    r = r.withColumn("distance", best).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (other - best) / (other + best + 1e-6))))
    if farthest is not None:
        far = best > farthest
        r = r.withColumn("label", F.when(far, UNKNOWN).otherwise(F.col("label"))).withColumn("confidence", F.when(far, 0.0).otherwise(F.col("confidence")))
    return r.select("glyph_id", "label", "confidence", "distance")


def cells(predictions: DataFrame, keys: list[str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Text and mean confidence of each cell from cx, ix, label, confidence: labels left to right, doubtful ones "?" and counted as 0."""
    doubtful = (F.col("confidence") < least) | (F.col("label") == UNKNOWN)
    p = predictions.withColumn("_l", F.when(doubtful, UNKNOWN).otherwise(F.col("label"))).withColumn("_c", F.when(doubtful, 0.0).otherwise(F.col("confidence")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cx", "ix", "_l"))), lambda x: x["_l"]), "")
    return p.groupBy(*keys).agg(text.alias("text"), F.avg("_c").alias("confidence"))


def with_blanks(found: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that were visible but held no glyph are surely blank: text "" and confidence 1."""
    return visible.select(*keys).join(found, keys, "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def titles(predictions: DataFrame, keys: list[str], width: float, least: float = LEAST_CONFIDENCE, edge: float = 0.125) -> DataFrame:
    """lane and bowler: labels left and right of the first column's edge; doubtful ones are left out."""
    p = predictions.filter((F.col("confidence") >= least) & (F.col("label") != UNKNOWN))
    left = F.col("cx") < edge * width
    join = lambda where: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("cx", "ix", "label")))), lambda x: x["label"]), "")
    return p.groupBy(*keys).agg(join(left).alias("lane"), join(~left).alias("bowler"))

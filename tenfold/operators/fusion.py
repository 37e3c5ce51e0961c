"""Many readings of a cell become one value and a list of changes.

Rows are observations: key, frame_index, text, confidence, and pos, their order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR, LEAST_SHARE, TAIL, PERSIST = 0.1, 0.30, 12, 2


def tail_cutoff(frames: DataFrame, tail: int = TAIL) -> DataFrame:
    """cutoff: the first of the last `tail` distinct frame_index values over all cells, 0 if there are none."""
    last = frames.select("frame_index").distinct().orderBy(F.desc("frame_index")).limit(tail)
    return last.agg(F.coalesce(F.min("frame_index"), F.lit(0)).alias("cutoff"))


def vote(observations: DataFrame, cutoff: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """key, text, confidence, share, n_observations, first_seen: the text with the largest weight in the tail.

    A reading weighs 0.1 and its confidence.  A cell without a reading in the tail votes with all.
    Ties go to the text seen first in the window; where the winner's share is below `least_share`
    and there are others, the latest text wins.  The cutoff is one row, so it is broadcast.

    Weights are added in order of arrival, and a cell's from the heaviest text down: in another order
    their last digits differ, which decides between texts of equal weight.
    """
    o = observations.crossJoin(F.broadcast(cutoff)).withColumn("_in", F.col("frame_index") >= F.col("cutoff"))
    order = Window.partitionBy("key", "text").orderBy("pos", "frame_index", "confidence")
    far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one shuffle of readings: each text's running sums over the tail and over all, the choice of window after that
    def sums(where, suffix):
        c = lambda x: F.when(where, x)
        return {
            f"w{suffix}": F.sum(c(F.col("confidence") + FLOOR)).over(far),
            f"c{suffix}": F.avg(c(F.col("confidence"))).over(far),
            f"a{suffix}": F.min(c(F.col("pos"))).over(far),
            f"z{suffix}": F.max(c(F.col("pos"))).over(far),
        }

    whole = {"n": F.count("*").over(far), "first_seen": F.first("frame_index").over(far), "_next": F.lead(F.lit(True)).over(order)}
    by_text = o.withColumns(sums(F.col("_in"), "_tail") | sums(F.lit(True), "_all") | whole).filter(F.col("_next").isNull())
    cell = Window.partitionBy("key")
    tail = F.max(F.col("w_tail").isNotNull()).over(cell)
    b = by_text.withColumn("_tail", tail)
    for x in "wcaz":
        b = b.withColumn(x, F.when(F.col("_tail"), F.col(f"{x}_tail")).otherwise(F.col(f"{x}_all")))
    b = b.withColumn("n_observations", F.sum("n").over(cell)).filter(F.col("w").isNotNull())
    heavy = cell.orderBy(F.desc("w"), "a")
    total = F.sum("w").over(heavy.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    b = b.withColumn("share", F.col("w") / total).withColumn("_texts", F.count("*").over(cell))
    b = b.withColumn("_heavy", F.row_number().over(heavy)).withColumn("_late", F.row_number().over(cell.orderBy(F.desc("z"))))
    unclear = F.max(F.when(F.col("_heavy") == 1, F.col("share") < least_share)).over(cell) & (F.col("_texts") > 1)
    b = b.withColumn("_unclear", unclear).filter(F.when(F.col("_unclear"), F.col("_late") == 1).otherwise(F.col("_heavy") == 1))
    return b.select("key", "text", F.col("c").alias("confidence"), "share", "n_observations", "first_seen")


def transitions(observations: DataFrame, persist: int = PERSIST) -> DataFrame:
    """key, frame_index, onset, old, new: changes of a cell's value that lasted `persist` readings.

    frame_index is the reading that confirmed the change, onset the run's first.  A cell starts blank.
    """
    order = Window.partitionBy("key").orderBy("pos")
    change = F.when(F.col("text").eqNullSafe(F.lag("text").over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    o = observations.withColumn("_change", change).withColumn("_run", F.sum("_change").over(order))
    run = Window.partitionBy("key", "_run").orderBy("pos")
    o = o.withColumn("_n", F.row_number().over(run)).withColumn("onset", F.first("frame_index").over(run)).filter(F.col("_n") == persist)
    o = o.withColumn("old", F.lag("text", 1, "").over(order)).filter(F.col("old") != F.col("text"))
    return o.select("key", "frame_index", "onset", "old", F.col("text").alias("new"))


def runs(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """start and end (exclusive) positions of rows in a row with a true flag; `order` counts up by one."""
    by = Window.partitionBy(*keys).orderBy(order)
    island = rows.filter(F.col(flag)).withColumn("_island", F.col(order) - F.row_number().over(by))
    return island.groupBy(*keys, "_island").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("_island")


def first_seen(observations: DataFrame) -> DataFrame:
    """key, text and the frame_index at which the text was first read."""
    return observations.groupBy("key", "text").agg(F.min("frame_index").alias("first_seen"))


def noted(frames: DataFrame) -> DataFrame:
    """Board frames, each once."""
    return frames.select("frame_index").distinct()


def counters(frames: DataFrame) -> DataFrame:
    """frames_total, frames_with_board, frames_occluded and last_board_frame from frame_index, ok and occluded."""
    return frames.agg(
        F.count("*").alias("frames_total"),
        F.count_if("ok").alias("frames_with_board"),
        F.count_if(F.col("ok") & F.col("occluded")).alias("frames_occluded"),
        F.max(F.when(F.col("ok"), F.col("frame_index"))).alias("last_board_frame"),
    )


def quality(counts: DataFrame, readings: DataFrame, checks: DataFrame) -> DataFrame:
    """One row of metrics from counters, readings (key, text, confidence) and checks (checked, mismatched).

    The mean confidence covers readings that are not blank, titles too; cell_confidence covers cells alone.
    """
    filled = F.col("text") != ""
    r = readings.agg(
        F.coalesce(F.avg(F.when(filled, F.col("confidence"))), F.lit(0.0)).alias("mean_glyph_confidence"),
        F.coalesce(F.avg(F.when(filled & ~F.col("key").startswith("title."), F.col("confidence"))), F.lit(0.0)).alias("cell_confidence"),
    )
    c = checks.agg(F.count_if("checked").alias("frames_checked"), F.count_if("mismatched").alias("_bad"))
    q = counts.crossJoin(r).crossJoin(c)
    q = q.withColumn("detection_rate", F.coalesce(F.try_divide(F.col("frames_with_board").cast("double"), F.col("frames_total")), F.lit(0.0)))
    return q.withColumn("rules_agreement", F.coalesce(F.try_divide((F.col("frames_checked") - F.col("_bad")).cast("double"), F.col("frames_checked")), F.lit(1.0))).drop("_bad")

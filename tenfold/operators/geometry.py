"""Boxes, rows and columns of a board as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.functions.arrays import overlap

COVERED = 0.35


def visible(cells: DataFrame, occluders: DataFrame, on: list[str], covered: float = COVERED) -> DataFrame:
    """Cells (box) of which no occluder (box) of the same frame covers more than `covered`."""
    o = occluders.select(*on, F.col("box").alias("_over"))
    keys = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in on]
    covers = overlap(F.col("c.box"), F.col("o._over")) > covered
    for k in keys:
        covers = k & covers
    return cells.alias("c").join(o.alias("o"), covers, "left_anti")


def board_cells(edges: DataFrame, players: int = 4, frames: int = 10) -> DataFrame:
    """All cells of boards with col_edges (13) and row_edges (9): key, role, player, frame and box; other columns stay."""
    b = edges.withColumn("player", F.explode(F.sequence(F.lit(0), F.lit(players - 1))))
    col, row = (lambda i: F.element_at("col_edges", i + 1)), (lambda i: F.element_at("row_edges", i + 1))
    p2 = F.col("player") * 2
    throw_top, throw_end, score_end = row(p2), row(p2 + 1), row(p2 + 2)

    def cell(role, key, left, right, top, end, frame):
        box = F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (end - top).alias("h"))
        return F.struct(key.alias("key"), F.lit(role).alias("role"), frame.cast("int").alias("frame"), box.alias("box"))

    name = lambda what: F.concat(F.lit("p"), F.col("player"), F.lit(f".{what}"))
    of = lambda f, what: F.concat(F.lit("p"), F.col("player"), F.lit(".f"), f, F.lit(f".{what}"))
    numbers = F.sequence(F.lit(1), F.lit(frames))
    cells = F.concat(
        F.array(cell("initial", name("initial"), col(F.lit(0)), col(F.lit(1)), throw_top, throw_end, F.lit(None))),
        F.transform(numbers, lambda f: cell("throws", of(f, "throws"), col(f), col(f + 1), throw_top, throw_end, f)),
        F.transform(numbers, lambda f: cell("score", of(f, "score"), col(f), col(f + 1), throw_end, score_end, f)),
        F.array(cell("total", name("total"), col(F.lit(frames + 1)), col(F.lit(frames + 2)), throw_end, score_end, F.lit(None))),
    )
    return b.withColumn("_cell", F.explode(cells)).select("*", "_cell.*").drop("_cell", "col_edges", "row_edges")


def fitted_line(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """slope and intercept of the least-squares line of each group."""
    return points.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def median_gap(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Median difference of neighbours in each group."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys).orderBy(order)
    g = points.withColumn("_gap", F.col(order) - F.lag(order).over(by)).filter(F.col("_gap").isNotNull())
    return g.groupBy(*keys).agg(F.median("_gap").alias("median_gap"))

"""Expressions over the marks of one frame; all are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAMES = 10


def stripped(text: Column) -> Column:
    """Without white space at either end (trim alone removes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Marks in order; an "o" belongs to the digit before it, white space is no mark."""
    return F.filter(F.regexp_extract_all(stripped(text), F.lit(r"(?s)([0-9]o|.)"), F.lit(1)), lambda t: ~t.rlike(r"^\s$"))


def pins(token: Column) -> Column:
    """Pins that one mark stands for; null for a spare mark and all that is no mark."""
    return F.when(token == "X", 10).when(token == "-", 0).when(token.rlike("^[0-9]o?$"), F.substring(token, 1, 1).cast("int"))


def whole_number(text: Column) -> Column:
    """A number of ASCII digits alone, else null."""
    t = stripped(text)
    return F.when(t.rlike("^[0-9]+$"), t.cast("int"))


def split(marks: Column) -> Column:
    """Whether any mark is circled, readable or not."""
    return F.coalesce(F.exists(marks, lambda t: t.endswith("o")), F.lit(False))


def parsed(marks: Column) -> Column:
    """rolls, standing and readable from a fold over the marks: pins stand until a rack is cleared."""
    start = F.struct(F.array().cast("array<int>").alias("rolls"), F.lit(10).alias("standing"), F.lit(True).alias("readable"))

    def step(at: Column, t: Column) -> Column:
        fell = F.when(t == "/", F.when(F.size(at["rolls"]) > 0, at["standing"])).otherwise(pins(t))
        left = F.when(t == "/", 0).when((fell == 10) & (at["standing"] == 10), 0).otherwise(at["standing"] - fell)
        return F.struct(
            F.when(fell.isNull(), at["rolls"]).otherwise(F.concat(at["rolls"], F.array(fell))).alias("rolls"),
            F.when(left == 0, 10).otherwise(F.coalesce(left, at["standing"])).cast("int").alias("standing"),
            (at["readable"] & fell.isNotNull() & (F.coalesce(left, F.lit(0)) >= 0)).alias("readable"),
        )

    return F.aggregate(marks, start, step)


def complete(rolls: Column, frame: Column) -> Column:
    """Whether a frame has all its rolls; the tenth earns a third by a strike or a spare."""
    n, first, second = F.size(rolls), F.get(rolls, F.lit(0)), F.get(rolls, F.lit(1))
    tenth = F.when((first == 10) | (first + second == 10), n >= 3).otherwise(n >= 2)
    return F.coalesce(F.when(n <= 0, False).when(frame < FRAMES, (first == 10) | (n >= 2)).otherwise(tenth), F.lit(False))


def shown(text: Column) -> Column:
    """Marks as displayed, circled digits in parentheses."""
    return F.array_join(F.transform(tokens(text), lambda t: F.when(t.endswith("o"), F.concat(F.lit("("), F.regexp_replace(t, "o$", ""), F.lit(")"))).otherwise(t)), "")


def seconds(frame: Column, fps: Column) -> Column:
    """Time of a frame to hundredths, null without a frame rate."""
    return F.round(frame / F.nullif(fps, F.lit(0).cast("double")), 2)


def agreement(checked: Column, wrong: Column) -> Column:
    """Share of checked frames that agree, 1 if none could be checked."""
    return F.coalesce(F.try_divide((checked - wrong).cast("double"), checked.cast("double")), F.lit(1.0))


PERFECT_GAME = ["X"] * 9 + ["XXX"]

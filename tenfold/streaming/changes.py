"""Changes of cells as readings arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOUND = "key string, frame_index long, old string, new string"
STATE = "current string, value string, length int"


def transitions(observations: DataFrame, persist: int = 2) -> DataFrame:
    """key, frame_index, old, new of a stream of key, frame_index, text, pos: changes that lasted `persist` readings.

    Readings of a cell arrive in order from one micro-batch to the next and are sorted by pos within
    one.  The state of a cell is its value and its latest run, however long the stream.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, value, length = state.get if state.exists else ("", None, 0)
        found = []
        for r in pd.concat(batches).sort_values("pos").itertuples(index=False):
            value, length = (value, length + 1) if r.text == value else (r.text, 1)
            if length == persist and value != current:
                found.append((key[0], r.frame_index, current, value))
                current = value
        state.update((current, value, length))
        yield pd.DataFrame(found, columns=["key", "frame_index", "old", "new"])

    o = observations.selectExpr("cast(key as string) as key", "cast(frame_index as long) as frame_index", "cast(text as string) as text", "cast(pos as long) as pos")
    return o.groupBy("key").applyInPandasWithState(step, FOUND, STATE, "append", GroupStateTimeout.NoTimeout)


def counts(frames: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Readings of each kind in each window of event time (ts, text), late ones up to `delay`."""
    from pyspark.sql import functions as F

    return frames.withWatermark("ts", delay).groupBy(F.window("ts", window), "text").count()


def run(stream: DataFrame, folder: str) -> DataFrame:
    """All that is there now, through the stream's plan, as a table in `folder`; started again, it goes on where it stopped."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")

"""Rules over live streams: the same meanings as in batch, state kept per stream.

``step_monitor`` keeps the last time of each stream and reports rows that go
back, repeat or leave a long gap.  ``windowed_counts`` are tumbling counts with
a watermark, late rows beyond it being dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "stream string, ts double, check_name string, gap_sec double"


def step_monitor(events: DataFrame, stream: str, seconds: str, order: str, gap_threshold: float = 0.5) -> DataFrame:
    """Findings as rows arrive; rows of one batch are taken in ``order``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("o", kind="stable")
        out = []
        for ts in rows["t"]:
            if pd.isna(ts):
                continue
            if last is not None:
                gap = ts - last
                name = "check_monotonic_timestamps" if gap < 0 else "check_duplicate_timestamps" if gap == 0 else "check_large_timestamp_gaps" if gap > gap_threshold else None
                if name:
                    out.append((key[0], ts, name, gap))
            last = ts
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["stream", "ts", "check_name", "gap_sec"])

    slim = events.select(F.col(stream).cast("string").alias("stream"), F.col(seconds).cast("double").alias("t"), F.col(order).alias("o"))
    return slim.groupBy("stream").applyInPandasWithState(step, OUTPUT, "last double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", key, "n")

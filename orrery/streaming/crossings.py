"""The crossing counter over a stream: one small state per particle, in the order of its frames.

Rows of a particle are put in the order of their frame within each micro-batch; rows that come
later than a frame already counted are left out and counted as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.crossings import OUTSIDE, decided


def crossings(stream: DataFrame, key: str, order: str, z: str, lower: float, upper: float, delta: float = 5.0) -> DataFrame:
    """(key, n, late): updated totals of every particle that has new rows."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at"), decided(F.col(z), lower, upper, delta).alias("status"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last, n, late = state.get if state.exists else (OUTSIDE, None, 0, 0)
        new = pd.concat(list(parts)).sort_values("at", kind="stable")
        for at, value in zip(new["at"], new["status"]):
            if last is not None and at <= last:
                late += 1
                continue
            last = int(at)
            if not pd.isna(value):
                value = int(value)
                n += OUTSIDE not in (value, status) and value != status
                status = value
        state.update((status, last, int(n), late))
        yield pd.DataFrame({"key": [key[0]], "n": [int(n)], "late": [late]})

    return rows.groupBy("key").applyInPandasWithState(step, "key long, n long, late long", "status int, last long, n long, late long", "update", GroupStateTimeout.NoTimeout)


def windowed_means(stream: DataFrame, time: str, value: str, width: str, lateness: str, by: str | None = None) -> DataFrame:
    """Mean of a value by time window, with a watermark that bounds what is kept for late rows."""
    keys = [F.window(time, width)] + ([F.col(by)] if by else [])
    return stream.withWatermark(time, lateness).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))

"""Streaming forms of the folds: idempotent replay, running as-of state, windowed counts with late events.

A late event changes earlier as-of answers, so results are upserts that are computed anew, never final appends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship


def suppress_repeats(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Each (keys) once within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def running_status(stream: DataFrame, key: str, day: str, status: str) -> DataFrame:
    """(key, day, status, outcome) after each batch: the state of a key is its last day with the statuses seen on it, of
    bounded size; earlier days that arrive late change nothing of the latest answer."""
    ship(stream.sparkSession)

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, lo, hi = state.get if state.exists else (None, None, None)
        for f in frames:
            for d, s in zip(f[day], f[status]):
                if last is None or d > last:
                    last, lo, hi = d, s, s
                elif d == last:
                    lo, hi = min(lo, s), max(hi, s)
        state.update((last, lo, hi))
        yield pd.DataFrame({key: [group[0]], day: [last], "status": [lo if lo == hi else "unknown"], "outcome": ["resolved" if lo == hi else "conflict"]})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = f"{key} {kinds[key]}, {day} {kinds[day]}, status string, outcome string"
    return stream.groupBy(key).applyInPandasWithState(fold, out, f"last {kinds[day]}, lo string, hi string", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, kind: str, window: str, delay: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n"))

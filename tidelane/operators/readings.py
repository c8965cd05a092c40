"""Readings of moving recorders: one row per (vehicle, pass, time)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that belong to a pass and have a finite time, reduced to the needed columns (so the scan reads no others)."""
    t = F.col("time_seconds")
    return df.where(F.col("vehicle_id").isNotNull() & F.col("pass_no").isNotNull() & (F.abs(t) < float("inf"))).select(
        "vehicle_id", "pass_no", "time_seconds", "event_id", *columns
    )


def first_deliveries(starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Rows sorted by (group, time, event_id): true at the first delivery of each reading."""
    first = np.ones(len(times), bool)
    if len(times) > 1:
        first[1:] = times[1:] != times[:-1]
        first[starts] = True
    return first


def group_numbers(starts: np.ndarray, n: int) -> np.ndarray:
    number = np.zeros(n, np.int64)
    number[starts[1:]] = 1
    return np.cumsum(number)

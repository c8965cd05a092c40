"""Speed fields and filtered levels from a stream of readings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_cell_means(readings: DataFrame, late: str = "10 minutes", step: str = "60 seconds", dx: float = 200.0) -> DataFrame:
    """Count and sum of speeds (millionths) per location, window and cell; closed when the watermark has passed.

    Deliveries again within the watermark (same vehicle, pass and time) count once.
    """
    usable = readings.where("vehicle_id is not null and x_meters is not null and velocity is not null and not isnan(velocity)")
    once = usable.withColumn("global_time", F.col("global_time").cast("timestamp")).withWatermark("global_time", late).dropDuplicates(["vehicle_id", "pass_no", "global_time"])
    keyed = once.withColumn("x_index", F.floor(F.col("x_meters") / dx)).withColumn("v_um", F.floor(F.col("velocity") * 1e6 + 0.5).cast("long"))
    cells = keyed.groupBy(F.window("global_time", step).alias("w"), "location", "x_index").agg(F.count("*").alias("n"), F.sum("v_um").alias("sum_um"))
    return cells.select(F.col("w.start").alias("start"), "location", "x_index", "n", "sum_um")


def stream_cell_levels(cells: DataFrame, drift: float = 0.05, noise: float = 4.0) -> DataFrame:
    """Per location and cell a level of the speed that every window's mean pulls on, as a filter without a flow model would.

    cells: what stream_cell_means gives. The state kept between batches is three numbers for each cell: its level, the level's
    variance, which grows by `drift` a second, and the window it is of; a mean of n readings has variance noise / n. Rows out:
    location, x_index, start, speed and variance, for each new window. Windows at or before the state's are passed over.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        level, variance, last = state.get if state.exists else (None, 0.0, 0.0)
        out = []
        for pdf in batches:
            for start, n, total in sorted(zip(pdf["start"], pdf["n"], pdf["sum_um"])):
                at, seen = start.timestamp(), total / n / 1e6
                if level is None:
                    level, variance = seen, noise / n
                elif at > last:
                    variance += drift * (at - last)
                    gain = variance / (variance + noise / n)
                    level, variance = level + gain * (seen - level), (1 - gain) * variance
                else:
                    continue
                last = at
                out.append((*key, start, level, variance))
        if level is not None:
            state.update((level, variance, last))
        yield pd.DataFrame(out, columns=["location", "x_index", "start", "speed", "variance"])

    return cells.groupBy("location", "x_index").applyInPandasWithState(
        run, "location string, x_index long, start timestamp, speed double, variance double", "level double, variance double, last double", "append", GroupStateTimeout.NoTimeout
    )

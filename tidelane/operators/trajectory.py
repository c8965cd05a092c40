"""Trajectory tables: time and space origin, trips, sampling, steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative_time(rows: DataFrame, milliseconds: str) -> DataFrame:
    """time_seconds and time_minutes since the earliest row. The minimum is one number, joined as such: a window
    without partitions would bring all rows into one task."""
    start = rows.agg(F.min(milliseconds).alias("_start"))
    seconds = (F.col(milliseconds) - F.col("_start")) / 1000.0
    return rows.crossJoin(F.broadcast(start)).withColumn("time_seconds", seconds).withColumn("time_minutes", seconds / 60.0).drop("_start")


def unique_trips(rows: DataFrame, vehicle: str, order: list[str], place: str, drop: float, block: int = 3_600_000) -> DataFrame:
    """Ids used again: a vehicle whose place falls by more than `drop` starts a new trip (id_0, id_1, ...).

    order[0] is a number (milliseconds). A vehicle's rows are cut into blocks of it; only one row per block, with its
    ends and its number of new trips, is brought together by vehicle, so a vehicle with many rows isn't one task's.
    """
    rows = rows.withColumn("_b", F.floor(F.col(order[0]) / block))
    by = Window.partitionBy(vehicle, "_b").orderBy(*order)
    back = lambda now, before: F.coalesce(now - before < -drop, F.lit(False)).cast("int")
    rows = rows.withColumn("_back", back(F.col(place), F.lag(place).over(by)))
    key = F.struct(*order)
    ends = rows.groupBy(vehicle, "_b").agg(F.min_by(place, key).alias("_first"), F.max_by(place, key).alias("_last"), F.sum("_back").alias("_inside"))
    over = Window.partitionBy(vehicle).orderBy("_b")
    ends = ends.withColumn("_edge", back(F.col("_first"), F.lag("_last").over(over)))
    before = F.sum(F.col("_inside") + F.col("_edge")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inside")
    rows = rows.withColumn("_trips", F.sum("_back").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(ends.select(F.col(vehicle).alias("_v"), F.col("_b").alias("_w"), before.alias("_before")), (F.col(vehicle) == F.col("_v")) & (F.col("_b") == F.col("_w")))
    trip = F.concat(F.col(vehicle), F.lit("_"), (F.col("_trips") + F.col("_before")).cast("string"))
    return rows.withColumn(vehicle, trip).drop("_b", "_back", "_trips", "_before", "_v", "_w")


def clip(rows: DataFrame, x_limits: tuple[float, float] | None = None, t_limits: tuple[float, float] | None = None) -> DataFrame:
    """Open interval in space, half-open in time; what remains counts from the limits' lower ends."""
    if x_limits:
        low, high = x_limits
        rows = rows.where((F.col("x_meters") > low) & (F.col("x_meters") < high)).withColumn("x_meters", F.col("x_meters") - low)
    if t_limits:
        start, end = t_limits
        rows = rows.where((F.col("time_seconds") >= start) & (F.col("time_seconds") < end)).withColumn("time_seconds", F.col("time_seconds") - start)
    return rows


def within(rows: DataFrame, start: float, end: float) -> DataFrame:
    """Rows strictly after `start` and before `end` seconds, their times counted from the first that is left.

    Refused if none is left. Rows without time are left out.
    """
    inside = rows.where((F.col("time_seconds") > start) & (F.col("time_seconds") < end))
    first = inside.agg(F.min("time_seconds").alias("_first")).first()[0]
    if first is None:
        raise ValueError("no trajectories between these times")
    return inside.withColumn("time_seconds", F.col("time_seconds") - F.lit(first))


def without_last_edge(rows: DataFrame) -> DataFrame:
    """Rows inside the domain that their own largest time and place span, without those on its edge (and without place or time)."""
    x, t = rows.agg(F.max("x_meters"), F.max("time_seconds")).first()
    if x is None or t is None:
        return rows.limit(0)
    return clip(rows.where("x_meters is not null and time_seconds is not null"), (0.0, x), (0.0, t))


def share(identifier: Column, seed: int) -> Column:
    """A number in [0, 2^32) that depends on the identifier and seed alone."""
    return F.conv(F.substring(F.md5(F.concat(identifier.cast("string"), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("long")


def sample_vehicles(rows: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """All rows of a fraction of the vehicles; the choice needs no shuffle and is the same in every run."""
    return rows.where(share(F.col("vehicle_id"), seed) < int(fraction * 2**32))


def thin_out(rows: DataFrame, every_ms: int, seed: int = 0, offset_ms: int = 3000) -> DataFrame:
    """The first reading of each vehicle in each window of every_ms, windows shifted by 0 to 3 s per vehicle.

    window_ms is the start of the window; the other columns are those of the reading itself.
    """
    shift = F.floor(share(F.col("vehicle_id"), seed + 1) / F.lit(2.0**32) * offset_ms).cast("long")
    ms = F.floor(F.col("time_seconds") * 1000 + 0.5).cast("long")
    keyed = rows.withColumn("window_ms", F.floor((ms + shift) / every_ms).cast("long") * every_ms - shift)
    first = F.min_by(F.struct("time_seconds", "event_id", "x_meters", "velocity"), F.struct("time_seconds", "event_id"))
    return keyed.groupBy("vehicle_id", "pass_no", "window_ms").agg(first.alias("r")).select("vehicle_id", "pass_no", "window_ms", "r.*")


def with_cells(rows: DataFrame, dt: float, dx: float) -> DataFrame:
    return rows.withColumn("t_index", F.floor(F.col("time_seconds") / dt)).withColumn("x_index", F.floor(F.col("x_meters") / dx))


def micro(column: str) -> Column:
    """A double as whole millionths: sums of these are exact in any order."""
    return F.floor(F.col(column) * 1e6 + 0.5).cast("long")


def mean_micro(column: Column) -> Column:
    """The rounded mean of whole millionths."""
    return F.floor(F.sum(column) / F.count(column).cast("double") + 0.5).cast("long")


def discretise(rows: DataFrame, dt: float, dx: float, cells: int) -> DataFrame:
    """One row per pass and step: last time and place in the step, mean speed (micro m/s), cell of the last place."""
    usable = rows.where("time_seconds is not null and x_meters is not null and velocity is not null and not isnan(velocity)")
    keyed = usable.withColumn("t_index", F.floor(F.col("time_seconds") / dt)).withColumn("v_um", micro("velocity"))
    steps = keyed.groupBy("vehicle_id", "pass_no", "t_index").agg(
        F.max("time_seconds").alias("time_seconds"),
        F.max_by("x_meters", F.struct("time_seconds", "event_id")).alias("x_meters"),
        mean_micro(F.col("v_um")).alias("v_um"),
    )
    return steps.withColumn("x_index", F.floor(F.col("x_meters") / dx)).where((F.col("x_index") >= 0) & (F.col("x_index") < cells))


def boundary_steps(steps: DataFrame, cells: int) -> DataFrame:
    """Steps in the first or last cell, as observations of their own: the id gets a suffix, the flag is set."""
    return steps.where(F.col("x_index").isin(0, cells - 1)).select(
        F.concat("vehicle_id", F.lit("_boundary")).alias("vehicle_id"), "pass_no", "t_index", "time_seconds", "x_meters", "v_um", "x_index",
        F.lit(True).alias("is_boundary_information"),
    )


def probe_observations(rows: DataFrame, probe_share: float, boundary_share: float, dt: float, dx: float, cells: int, seed: int = 0) -> DataFrame:
    """What an experiment may see: steps of sampled probe vehicles, and boundary cells of another sample."""
    steps = discretise(rows, dt, dx, cells)
    probes = sample_vehicles(steps, probe_share, seed).select(
        "vehicle_id", "pass_no", "t_index", "time_seconds", "x_meters", "v_um", "x_index", F.lit(False).alias("is_boundary_information")
    )
    edges = boundary_steps(sample_vehicles(steps, boundary_share, seed + 7), cells)
    return probes.unionByName(edges).dropDuplicates(["vehicle_id", "pass_no", "t_index"])


@dataclass(frozen=True)
class ProbeData:
    """What an experiment starts from: all trajectories, what it may see of them, the grid and the field of all of them."""

    trajectories: DataFrame
    observations: DataFrame
    steps: int
    cells: int
    field: DataFrame


def prepare_probe_data(rows: DataFrame, start: float, end: float, probe_share: float, boundary_share: float, dt: float, dx: float, seed: int = 0) -> ProbeData:
    """Rows of a data set, strictly between two times, cut to their domain, sampled, and gathered into a field.

    Refused if no row is left. The field has every cell of every step; see cell_means and dense_grid.
    """
    from tidelane.operators.fields import cell_means, dense_grid

    kept = without_last_edge(within(rows, start, end))
    x, t = kept.agg(F.max("x_meters"), F.max("time_seconds")).first()
    cells, steps = int(x // dx) + 1, int(t // dt) + 1
    seen = probe_observations(kept, probe_share, boundary_share, dt, dx, cells, seed)
    field = dense_grid(cell_means(kept, ["velocity"], dt, dx), cells, "mean_velocity_um")
    return ProbeData(kept, seen, steps, cells, field)

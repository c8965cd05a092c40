"""Irregular readings onto a regular grid by compact-kernel weighted local polynomial regression (problem 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.operators.grouped import floats, longs, map_sorted_groups, time_blocks
from tidelane.operators.readings import first_deliveries, group_numbers, usable_rows

KEYS = ["vehicle_id", "pass_no", "block"]
GRID_SCHEMA = (
    "vehicle_id string, pass_no bigint, t_index bigint, time_seconds double, x_meters double, velocity double, "
    "n_usable bigint, effective_support double, status string"
)


def local_polynomial(sums: np.ndarray, products: np.ndarray, degree: int) -> np.ndarray:
    """Value at 0 of the weighted least squares polynomial, for many points at once.

    sums[k] is the sum of w*u^k, products[k] of w*u^k*y. Where the points carry no polynomial of this degree
    (too few distinct times), the next lower degree is taken; NaN where there is no weight at all.
    """
    n = sums.shape[1]
    value = np.full(n, np.nan)
    todo = sums[0] > 0
    for d in range(degree, -1, -1):
        rows = np.flatnonzero(todo)
        if not len(rows):
            break
        normal = np.stack([sums[i : i + d + 1, rows] for i in range(d + 1)]).transpose(2, 0, 1)
        spread = np.prod(np.diagonal(normal, axis1=1, axis2=2), axis=1)
        fits = np.linalg.det(normal) > 1e-6 * spread
        take = rows[fits]
        value[take] = np.linalg.solve(normal[fits], products[: d + 1, take].T[..., None])[:, 0, 0]
        todo[take] = False
    return value


def _grid(table: pa.Table, starts: np.ndarray, step: float, bandwidth: float, degree: int, min_support: float) -> pa.Table:
    n = table.num_rows
    group = group_numbers(starts, n)
    time = floats(table, "time_seconds")
    lo, hi = longs(table, "lo")[starts], longs(table, "hi")[starts]  # the frame row sorts first: its time is null
    frame = np.isnan(time)
    first = first_deliveries(starts, time) & ~frame
    x, v = floats(table, "x_meters"), floats(table, "velocity")
    usable = np.flatnonzero(first & ~np.isnan(x) & ~np.isnan(v))
    count = np.where(lo >= 0, hi - lo + 1, 0)
    cell_group = np.repeat(np.arange(len(starts)), count)
    t_index = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    centre = (t_index + 0.5) * step

    # One sorted axis for all groups: each has its own stretch, wider than any block with its context.
    base = lo * step - bandwidth - step
    stretch = count.max(initial=0) * step + 4 * (bandwidth + step)
    on_axis = group[usable] * stretch + (time[usable] - base[group[usable]])
    at = cell_group * stretch + (centre - base[cell_group])
    left = np.searchsorted(on_axis, at - bandwidth, "left")
    near = np.searchsorted(on_axis, at + bandwidth, "right") - left

    point = np.repeat(np.arange(len(at)), near)
    reading = usable[np.arange(near.sum()) - np.repeat(np.cumsum(near) - near, near) + np.repeat(left, near)]
    u = (time[reading] - centre[point]) / bandwidth
    w = np.maximum(1 - u * u, 0)
    total = lambda y: np.bincount(point, y, minlength=len(at))
    powers = [w * u**k for k in range(2 * degree + 1)]
    sums = np.stack([total(p) for p in powers])
    support = np.divide(sums[0] ** 2, total(w * w), out=np.zeros(len(at)), where=sums[0] > 0)
    both_sides = (total((u <= 0) & (w > 0)) > 0) & (total((u >= 0) & (w > 0)) > 0)
    fit = {c: local_polynomial(sums, np.stack([total(p * y[reading]) for p in powers[: degree + 1]]), degree) for c, y in (("x", x), ("v", v))}

    period = np.floor(time[reading] / step).astype(np.int64)
    n_usable = np.bincount(point[period == t_index[point]], minlength=len(at))
    enough = (support >= min_support) & both_sides
    status = np.where(n_usable > 0, "observed", np.where(enough, "filled", "missing"))
    shown = (n_usable > 0) | enough
    rows = table.take(pa.array(starts[cell_group]))
    hide = lambda y: pa.array(y, mask=~shown | np.isnan(y))
    return pa.table(
        {
            "vehicle_id": rows["vehicle_id"], "pass_no": rows["pass_no"], "t_index": t_index, "time_seconds": centre,
            "x_meters": hide(fit["x"]), "velocity": hide(np.maximum(fit["v"], 0)), "n_usable": n_usable.astype(np.int64),
            "effective_support": support, "status": status,
        }
    )


def regular_grid(
    trajectories: DataFrame,
    step: float = 5.0,
    bandwidth: float = 15.0,
    degree: int = 1,
    min_support: float = 2.0,
    block_seconds: float = 3600.0,
) -> DataFrame:
    """One row for every period of `step` seconds of each pass, from its first reading to its last.

    x_meters and velocity are local polynomial estimates at the period's middle with weights 1-(dt/bandwidth)^2.
    status: `observed` - the period holds a usable reading (x_meters and velocity neither null nor NaN);
    `filled` - it holds none, but readings on both sides within the bandwidth give an effective support
    (sum w)^2 / sum w^2 of at least min_support; `missing` - anything less, with null estimates.

    Rows without vehicle_id, pass_no or time are left out. Deliveries of one reading (same pass and time) count
    once, with the values of the smallest event_id. A pass with unusable readings only gives `missing` rows; an
    empty table gives none. Extra columns are ignored. bandwidth must be at least step.

    Passes are cut into blocks of block_seconds with `bandwidth` seconds of context, so a pass of any length is
    spread over tasks; the period range of each block comes from a pre-aggregated minimum and maximum per pass.
    """
    if bandwidth < step or block_seconds % step:
        raise ValueError("bandwidth must be at least step, and block_seconds a multiple of step")
    rows = usable_rows(trajectories, ["x_meters", "velocity"])
    per_block = int(block_seconds / step)
    extent = rows.groupBy("vehicle_id", "pass_no").agg(
        F.floor(F.min("time_seconds") / step).alias("first"), F.floor(F.max("time_seconds") / step).alias("last")
    )
    frames = extent.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / per_block), F.floor(F.col("last") / per_block)))).select(
        "vehicle_id", "pass_no", "block", F.greatest("first", F.col("block") * per_block).alias("lo"),
        F.least("last", (F.col("block") + 1) * per_block - 1).alias("hi"),
    )
    blocks = time_blocks(rows, F.col("time_seconds"), block_seconds, bandwidth, "block", "own").drop("own")
    return map_sorted_groups(
        blocks.unionByName(frames, allowMissingColumns=True),
        KEYS,
        ["time_seconds", "event_id"],
        lambda table, starts: _grid(table, starts, step, bandwidth, degree, min_support),
        GRID_SCHEMA,
    )


def empty_periods(trajectories: DataFrame, step: float = 5.0) -> DataFrame:
    """The periods without usable reading: those rows of the grid that are filled or missing."""
    return regular_grid(trajectories, step).where("n_usable = 0").select("vehicle_id", "pass_no", "t_index")

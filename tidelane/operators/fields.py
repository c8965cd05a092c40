"""Space-time fields: cell means, dense grids, filling and smoothing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.grouped import map_sorted_groups, time_blocks
from tidelane.operators.trajectory import mean_micro, micro, with_cells

CELL = ["location", "t_index", "x_index"]


def valid_headways(rows: DataFrame) -> DataFrame:
    """Without headway codes; tables that lack the columns pass unchanged."""
    if not {"space_headway", "time_headway"} <= set(rows.columns):
        return rows
    return rows.where((F.col("space_headway") > 0) & (F.col("time_headway") <= 9999))


def per_vehicle(rows: DataFrame, columns: list[str], dt: float, dx: float) -> DataFrame:
    """Mean of each vehicle in each cell (millionths), over its readings that have all the columns."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(c)
    keyed = with_cells(rows.where(good & F.col("x_meters").isNotNull() & F.col("vehicle_id").isNotNull()), dt, dx)
    return keyed.groupBy(*CELL, "vehicle_id").agg(*[mean_micro(micro(c)).alias(c) for c in columns], F.count("*").alias("n"))


def cell_means(rows: DataFrame, columns: list[str], dt: float, dx: float) -> DataFrame:
    """Mean per cell of the vehicles' means (millionths), so a vehicle reporting often counts once."""
    per = per_vehicle(rows, columns, dt, dx)
    return per.groupBy(*CELL).agg(*[mean_micro(F.col(c)).alias(f"mean_{c}_um") for c in columns], F.count("*").alias("n_vehicles"))


def headway_fields(rows: DataFrame, dt: float, dx: float) -> DataFrame:
    """Density and flow (millionths) as reciprocals of mean headways, from readings with valid headways."""
    means = cell_means(valid_headways(rows), ["velocity", "space_headway", "time_headway"], dt, dx)
    inverse = lambda c: F.floor(F.try_divide(F.lit(1e12), F.col(c).cast("double")) + 0.5).cast("long")
    return means.select(*CELL, F.col("mean_velocity_um").alias("speed_um"), inverse("mean_space_headway_um").alias("density_um"), inverse("mean_time_headway_um").alias("flow_um"))


def weighted_fields(rows: DataFrame, dt: float, dx: float) -> DataFrame:
    """Mean speed over readings weighted by 1/n of their vehicle, arrivals into the cell, readings, share of the step.

    An arrival is a reading whose cell lies beyond that of the vehicle's reading before (-1 before the first). Passes are cut
    into blocks of an hour, of which the last cell is carried on. Rows without vehicle, pass, time or place are left out.
    """
    good = rows.where("vehicle_id is not null and x_meters is not null and velocity is not null and not isnan(velocity)")
    keyed = with_cells(good, dt, dx).withColumn("v_um", micro("velocity"))
    of_pass, by_block = ["vehicle_id", "pass_no"], ["vehicle_id", "pass_no", "_b"]
    keyed = keyed.withColumn("_b", F.floor(F.col("time_seconds") / 3600))
    ends = keyed.groupBy(*by_block).agg(F.max_by("x_index", F.struct("time_seconds", "event_id")).alias("_last"))
    ends = ends.select(*by_block, F.lag("_last").over(Window.partitionBy(*of_pass).orderBy("_b")).alias("_before"))
    before = F.coalesce(F.lag("x_index").over(Window.partitionBy(*by_block).orderBy("time_seconds", "event_id")), "_before", F.lit(-1))
    keyed = keyed.join(ends, by_block).withColumn("arrival", (F.col("x_index") > before).cast("long"))
    per = keyed.groupBy(*CELL, "vehicle_id", "pass_no").agg(mean_micro(F.col("v_um")).alias("v_um"), F.count("*").alias("n"), F.sum("arrival").alias("a"))
    cells = per.groupBy(*CELL).agg(mean_micro(F.col("v_um")).alias("mean_velocity_um"), F.sum("a").alias("arrivals"), F.sum("n").alias("n_readings"))
    step = cells.groupBy("location", "t_index").agg(F.sum("n_readings").alias("_all"))
    return cells.join(step, ["location", "t_index"]).withColumn("share_um", F.floor(F.col("n_readings") * 1e6 / F.col("_all") + 0.5).cast("long")).drop("_all")


def dense_grid(field: DataFrame, cells: int, value: str, block: int = 1000) -> DataFrame:
    """Every cell of every step from a location's first observed step to its last; null where nothing was seen."""
    extent = field.groupBy("location").agg(F.min("t_index").alias("a"), F.max("t_index").alias("b"))
    blocks = extent.withColumn("_s", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block)))).repartition("location", "_s")
    ends = F.sequence(F.greatest("a", F.col("_s") * block), F.least("b", (F.col("_s") + 1) * block - 1))
    steps = blocks.select("location", F.explode(ends).alias("t_index"))
    grid = steps.withColumn("x_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    return grid.join(field.select(*CELL, value), CELL, "left")


def forward_fill(grid: DataFrame, value: str, start: int, block: int = 1000) -> DataFrame:
    """The last known value of the cell at or before each step, `start` before any.

    Each cell's steps are cut into blocks; the last value of each block is carried on over blocks, of which a cell
    has few, so neither window sees a cell's whole history at once.
    """
    rows = grid.withColumn("_b", F.floor(F.col("t_index") / block))
    inside = Window.partitionBy("location", "x_index", "_b").orderBy("t_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_v", F.last(value, ignorenulls=True).over(inside))
    ends = rows.groupBy("location", "x_index", "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("t_index"))).alias("_end"))
    over = Window.partitionBy("location", "x_index").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(over)).drop("_end")
    filled = F.coalesce("_v", "_carried", F.lit(start))
    return rows.join(ends, ["location", "x_index", "_b"], "left").withColumn(value, filled).drop("_b", "_v", "_carried")


def nearest_fill(grid: DataFrame, value: str, block: int = 1000) -> DataFrame:
    """Missing cells take the value of the nearest observed cell (steps and cells count alike), ties by earlier
    step, then lower cell. Null only where a location has no observed cell at all.

    grid: a row for every cell of every step between a location's first and last. The nearest observed steps of each
    cell, before and after, are found first: within blocks of steps, of which the ends are carried over. A missing cell then
    looks at those of its own step's cells only, two for each, so no step is compared with another however wide a gap is.
    """
    of_cell, by_block = ["location", "x_index"], ["location", "x_index", "_b"]
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("t_index").alias("t"), F.col(value).alias("v")))
    rows = grid.select(*CELL, value).withColumn("_b", F.floor(F.col("t_index") / block)).withColumn("_s", seen)
    up = Window.partitionBy(*by_block).orderBy("t_index").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by_block).orderBy(F.col("t_index").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.last("_s", ignorenulls=True).over(up)).withColumn("_n", F.last("_s", ignorenulls=True).over(down))
    ends = rows.groupBy(*by_block).agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"))
    over = Window.partitionBy(*of_cell)
    before, after = (over.orderBy(b).rowsBetween(Window.unboundedPreceding, -1) for b in (F.col("_b").asc(), F.col("_b").desc()))
    ends = ends.select(*by_block, F.last("_last", ignorenulls=True).over(before).alias("_pb"), F.last("_first", ignorenulls=True).over(after).alias("_nb"))
    rows = rows.join(ends, by_block).select(*CELL, value, F.coalesce("_p", "_pb").alias("p"), F.coalesce("_n", "_nb").alias("n"))
    steps = rows.groupBy("location", "t_index").agg(F.collect_list(F.struct(F.col("x_index").alias("x"), "p", "n")).alias("near"), F.collect_list(F.struct(F.col("x_index").alias("x"), F.col(value).alias("v"))).alias("cells"))
    cells = steps.withColumn("c", F.explode("cells"))

    def candidate(at: Column, side: str) -> Column:
        dt, dx, s = at[side]["t"] - F.col("t_index"), at["x"] - F.col("c.x"), at[side]
        return F.when(s.isNotNull(), F.struct((dt * dt + dx * dx).alias("d"), s["t"].alias("t"), at["x"].alias("x"), s["v"].alias("v")))

    nearest = F.array_min(F.flatten(F.transform("near", lambda at: F.array(candidate(at, "p"), candidate(at, "n")))))
    return cells.select("location", "t_index", F.col("c.x").alias("x_index"), F.when(F.col("c.v").isNotNull(), F.col("c.v")).otherwise(nearest["v"]).alias(value))


def rolling_means(field: DataFrame, value: str, steps: int, cells: int, block: int = 2000) -> DataFrame:
    """Mean over the last `steps` steps of a cell, then over the last `cells` cells of a step, by index value.

    Windows run over blocks of steps with the context they need, not over a cell's whole history.
    """
    blocks = time_blocks(field.select(*CELL, value), F.col("t_index"), block, steps, "_b", "_own")
    in_time = Window.partitionBy("location", "x_index", "_b").orderBy("t_index").rangeBetween(-(steps - 1), 0)
    mean = lambda c, w: F.floor(F.sum(c).over(w) / F.count(c).over(w).cast("double") + 0.5).cast("long")
    first = blocks.withColumn("_m", mean(value, in_time)).where("_own").drop("_b", "_own")
    in_space = Window.partitionBy("location", "t_index").orderBy("x_index").rangeBetween(-(cells - 1), 0)
    return first.withColumn("smooth_um", mean("_m", in_space)).select(*CELL, "smooth_um")


def coarsen(field: DataFrame, value: str, by_t: int, by_x: int, cells: int) -> DataFrame:
    """Block means; cells beyond the last whole block in space are left out, missing values don't count."""
    whole = cells // by_x * by_x
    return (
        field.where(F.col("x_index") < whole)
        .groupBy("location", F.floor(F.col("t_index") / by_t).alias("t_index"), F.floor(F.col("x_index") / by_x).alias("x_index"))
        .agg(mean_micro(F.col(value)).alias(value))
    )


@dataclass(frozen=True)
class Smoothing:
    """Kernel lengths in seconds and metres, the waves' speeds, and where and how sharply one passes into the other.

    reach_t, reach_x: steps and cells to either side that the kernel covers; its weights are not below `least`. gaussian: weights
    fall with the squares of the distances, as a normal density does, instead of exponentially.
    """

    tau: float = 60.0
    delta: float = 200.0
    v_cong: float = -15 / 3.6
    v_free: float = 70 / 3.6
    v_threshold: float = 60 / 3.6
    width: float = 20 / 3.6
    reach_t: int = 100
    reach_x: int = 100
    least: float = 1e-8
    gaussian: bool = False

    def kernel(self, dt: float, dx: float, cells: int, wave: float) -> np.ndarray:
        """Weights by steps -reach_t .. reach_t (rows) and cells -(cells - 1) .. cells - 1 (columns) from the point."""
        t = np.arange(-self.reach_t, self.reach_t + 1)[:, None] * dt
        steps = np.arange(-(cells - 1), cells)[None, :]
        along, across = (t - steps * dx / wave) / self.tau, steps * dx / self.delta
        away = 0.5 * (along * along + across * across) if self.gaussian else np.abs(along) + np.abs(across)
        weight = np.maximum(np.exp(-away), self.least)
        return np.where(np.abs(steps) <= self.reach_x, weight, 0.0)


def _correlated(values: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum over a [steps + 2 * reach, cells] table of the kernel's weight by step and cell from each inner point."""
    cells, reach = values.shape[1], kernel.shape[0] // 2
    near = np.lib.stride_tricks.sliding_window_view(values, 2 * reach + 1, axis=0)  # [steps, cells, window]
    by_shift = near.reshape(-1, 2 * reach + 1) @ kernel  # [steps * cells, shift of cells]
    by_shift = by_shift.reshape(len(near), cells, 2 * cells - 1)
    out = np.zeros((len(near), cells))
    for x in range(cells):  # the cell seen at place y lies y - x cells on
        out[:, x] = by_shift[:, np.arange(cells), np.arange(cells) - x + cells - 1].sum(1)
    return out


def adaptive_smoothing(field: DataFrame, dt: float, dx: float, value: str, cells: int, rules: Smoothing = Smoothing(), block: int = 256) -> DataFrame:
    """Speeds blended from a congested and a free-flow kernel mean of the observations around, for every row of the field.

    field: location, t_index, x_index (0 .. cells - 1; others are left out) and values in millionths, null where nothing was
    observed; of repeated rows the last by value counts. speed is null where no observation lies within the kernel. Equal
    wave speeds far above traffic's make the smoothing isotropic.

    A step is one array of `cells` values; blocks of steps with reach_t steps around them are smoothed as matrices, so the
    work grows with the steps, not with pairs of cells.
    """
    if rules.reach_t > block:
        block = rules.reach_t
    inside = field.where(F.col("x_index").between(0, cells - 1) & F.col("t_index").isNotNull()).select(*CELL, value)
    steps = inside.groupBy("location", "t_index").agg(F.collect_list(F.struct("x_index", value)).alias("c"))
    steps = steps.select("location", "t_index", F.col("c.x_index").alias("x"), F.transform("c", lambda c: c[value] / F.lit(1e6)).alias("v"))
    blocks = time_blocks(steps, F.col("t_index"), block, rules.reach_t, "_b", "_own")
    congested, free = (rules.kernel(dt, dx, cells, wave) for wave in (rules.v_cong, rules.v_free))

    def smooth(table: pa.Table, starts: np.ndarray) -> pa.Table:
        parts = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            rows = table.slice(a, b - a).combine_chunks()
            first = rows["_b"][0].as_py() * block - rules.reach_t
            x, v = rows["x"].combine_chunks(), rows["v"].combine_chunks()
            at = np.repeat(rows["t_index"].to_numpy() - first, np.diff(x.offsets.to_numpy()))
            cell, speed = x.flatten().to_numpy(), pa.compute.fill_null(v.flatten(), np.nan).to_numpy()
            data = np.full((block + 2 * rules.reach_t, cells), np.nan)
            order = np.argsort(speed, kind="stable")[::-1]  # an observation is written after what is missing
            data[at[order], cell[order]] = speed[order]
            known, filled = (~np.isnan(data)).astype(float), np.nan_to_num(data)
            with np.errstate(invalid="ignore", divide="ignore"):
                slow, fast = (_correlated(filled, k) / np.where((n := _correlated(known, k)) > 0, n, np.nan) for k in (congested, free))
            w = 0.5 * (1 + np.tanh((rules.v_threshold - np.fmin(slow, fast)) / rules.width))
            out = w * slow + (1 - w) * fast
            own = np.repeat(rows["_own"].to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy()))
            spot = np.unique(np.stack([at[own], cell[own]]), axis=1)
            found = out[spot[0] - rules.reach_t, spot[1]]
            names = pa.array([rows["location"][0].as_py()] * len(found), pa.string())
            parts.append(pa.table({"location": names, "t_index": spot[0] + first, "x_index": spot[1], "speed": pa.array(found, from_pandas=True)}))
        return pa.concat_tables(parts)

    return map_sorted_groups(blocks, ["location", "_b"], ["t_index"], smooth, "location string, t_index bigint, x_index bigint, speed double", rows_per_call=1000)


def upsample(coarse: DataFrame, value: str, by_t: int, by_x: int) -> DataFrame:
    """The cells of every coarse cell (by_t steps by by_x cells each), interpolated linearly between the coarse cells' centres.

    Each coarse value reaches up to the centres of the coarse cells around it, with a weight that falls linearly; missing ones
    don't count, so beyond the outermost centres values stay level. Null where none is known around.
    """

    def reached(index: str, by: int) -> Column:
        return F.sequence(F.ceil((F.col(index) - 0.5) * by - 0.5 + 1e-9), F.ceil((F.col(index) + 1.5) * by - 0.5 - 1e-9) - 1)

    rows = coarse.select(*CELL, F.col(value).alias("_v")).withColumn("_t", F.explode(reached("t_index", by_t))).withColumn("_x", F.explode(reached("x_index", by_x)))
    away_t, away_x = (F.abs((F.col(fine) + 0.5) / by - 0.5 - F.col(index)) for fine, by, index in (("_t", by_t, "t_index"), ("_x", by_x, "x_index")))
    weight = F.when(F.col("_v").isNotNull(), (1 - away_t) * (1 - away_x))
    own = (F.floor(F.col("_t") / by_t) == F.col("t_index")) & (F.floor(F.col("_x") / by_x) == F.col("x_index"))
    sums = rows.withColumn("_w", weight).groupBy("location", "_t", "_x").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n"), F.max(own).alias("_own"))
    return sums.where("_own").select("location", F.col("_t").alias("t_index"), F.col("_x").alias("x_index"), F.try_divide("_s", "_n").alias(value))


def moving_average(field: DataFrame, value: str, around: int, block: int = 2000) -> DataFrame:
    """Mean over `around` steps before and after in each cell; beyond a cell's ends its end value counts again."""
    blocks = time_blocks(field.select(*CELL, value), F.col("t_index"), block, around, "_b", "_own")
    by = Window.partitionBy("location", "x_index", "_b").orderBy("t_index")
    near = by.rowsBetween(-around, around)
    ahead, behind = F.row_number().over(by) - 1, F.count("*").over(by.rowsBetween(0, Window.unboundedFollowing)) - 1
    inside = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lacking_before, lacking_after = F.greatest(around - ahead, F.lit(0)), F.greatest(around - behind, F.lit(0))
    total = F.sum(value).over(near) + lacking_before * F.first(value).over(inside) + lacking_after * F.last(value).over(inside)
    mean = F.floor(total / F.lit(2 * around + 1).cast("double") + 0.5).cast("long")
    return blocks.withColumn("smooth_um", mean).where("_own").select(*CELL, "smooth_um")

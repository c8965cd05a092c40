"""Measurements for the estimators: set-based, one group-by instead of a filter per time step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.functions.diagrams import COLUMNS as M
from tidelane.functions.diagrams import DEFAULTS
from tidelane.operators.trajectory import mean_micro, micro


def observations(discretised: DataFrame, cells: int) -> DataFrame:
    """Distinct usable observations (location, t_index, x_index, v_um) of a discretised table."""
    good = (F.col("t_index") >= 0) & F.col("x_index").between(0, cells - 1) & F.col("velocity").isNotNull() & ~F.isnan("velocity")
    return discretised.where(good).select("obs_id", "location", "t_index", "x_index", micro("velocity").alias("v_um")).distinct()


def _served(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Each observation once for every step whose window t + first .. t + last holds it."""
    return rows.withColumn("step", F.explode(F.sequence(F.col("t_index") - last, F.col("t_index") - first)))


def step_measurements(rows: DataFrame) -> DataFrame:
    """Mean speed and count per cell of the observations of a step and the next; variance goes with 1/n."""
    grouped = _served(rows, 0, 1).groupBy("location", "step", "x_index").agg(mean_micro(F.col("v_um")).alias("v_um"), F.count("*").alias("n"))
    return grouped.withColumn("relative_variance", 1.0 / F.col("n"))


def flow_weighted(rows: DataFrame) -> DataFrame:
    """Mean weighted by speed over density, which takes the space mean for the time mean."""
    d = DEFAULTS["mobile_triangular_low"]
    served = _served(rows, 0, 1).withColumn("v", F.col("v_um") / 1e6).where("v > 0.1")
    served = served.withColumn("r", d.density(F.col("v"), M))
    mean = F.sum(F.col("v") * F.col("v") / F.col("r")) / F.sum(F.col("v") / F.col("r"))
    return served.groupBy("location", "step", "x_index").agg(F.floor(mean * 1e3 + 0.5).cast("long").alias("v_milli"))


def clipped(rows: DataFrame, v_max: float) -> DataFrame:
    """Mean of the observations two steps around, within 0 and v_max."""
    mean = F.least(F.greatest(mean_micro(F.col("v_um")), F.lit(0)), F.lit(int(v_max * 1e6)))
    return _served(rows, -2, 2).groupBy("location", "step", "x_index").agg(mean.alias("v_um"))

"""Queries of the general data problems (2, 4, 5) and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators.dependency_fill import fill_missing
from tidelane.operators.regular_grid import empty_periods, regular_grid
from tidelane.operators.spikes import implausible_values
from tidelane.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return empty_periods(table(spark, sf_dir, "trajectories"))


def p2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid, its estimates in whole centimetres (and per second), so that the order of sums can't show."""
    whole = lambda c, k: (F.floor(F.col(c) * k + 0.5) / k).alias(c)
    return regular_grid(table(spark, sf_dir, "trajectories")).select(
        "vehicle_id", "pass_no", "t_index", "time_seconds", whole("x_meters", 100), whole("velocity", 100), "n_usable", whole("effective_support", 10_000), "status"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_values(table(spark, sf_dir, "trajectories")).select("event_id", "field").distinct()


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_values(table(spark, sf_dir, "trajectories"))


def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_missing(table(spark, sf_dir, "flow_data"), table(spark, sf_dir, "discretized_trajectories"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_filled(spark, sf_dir).select("table_name", "row_id", "field")


QUERIES = {"p2_found": p2_found, "p2_grid": p2_grid, "p4_found": p4_found, "p4_flags": p4_flags, "p5_found": p5_found, "p5_filled": p5_filled}

ORACLE = {
    "p2_found": """
        WITH readings AS (
          SELECT vehicle_id, pass_no, CAST(floor(time_seconds / 5) AS BIGINT) AS t_index,
                 max(CASE WHEN x_meters IS NULL OR isnan(x_meters) OR velocity IS NULL OR isnan(velocity) THEN 0 ELSE 1 END) AS usable
          FROM trajectories
          WHERE vehicle_id IS NOT NULL AND pass_no IS NOT NULL AND time_seconds IS NOT NULL
          GROUP BY ALL),
        extent AS (SELECT vehicle_id, pass_no, min(t_index) AS a, max(t_index) AS b FROM readings GROUP BY ALL),
        periods AS (SELECT vehicle_id, pass_no, unnest(range(a, b + 1)) AS t_index FROM extent)
        SELECT vehicle_id, pass_no, t_index
        FROM periods LEFT JOIN readings USING (vehicle_id, pass_no, t_index)
        WHERE coalesce(usable, 0) = 0
    """,
    "p2_grid": """
        WITH readings AS (SELECT vehicle_id, pass_no, time_seconds, arg_min(r, event_id).x AS x, arg_min(r, event_id).v AS v
          FROM (SELECT *, {'x': x_meters, 'v': velocity} AS r FROM trajectories WHERE vehicle_id IS NOT NULL AND pass_no IS NOT NULL AND time_seconds IS NOT NULL)
          GROUP BY ALL),
        extent AS (SELECT vehicle_id, pass_no, CAST(floor(min(time_seconds) / 5) AS BIGINT) AS a, CAST(floor(max(time_seconds) / 5) AS BIGINT) AS b FROM readings GROUP BY ALL),
        periods AS (SELECT vehicle_id, pass_no, unnest(range(a, b + 1)) AS t_index FROM extent),
        usable AS (SELECT * FROM readings WHERE x IS NOT NULL AND v IS NOT NULL AND NOT isnan(x) AND NOT isnan(v)),
        near AS (SELECT vehicle_id, pass_no, t_index, x, v, (time_seconds - (t_index + 0.5e0) * 5) / 15e0 AS u, CAST(floor(time_seconds / 5) AS BIGINT) = t_index AS own
          FROM periods LEFT JOIN usable USING (vehicle_id, pass_no) WHERE abs(time_seconds - (t_index + 0.5e0) * 5) <= 15),
        weighted AS (SELECT *, greatest(1 - u * u, 0) AS w FROM near),
        sums AS (SELECT vehicle_id, pass_no, t_index, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * w) AS ww, sum(w * x) AS x0, sum(w * u * x) AS x1, sum(w * v) AS v0, sum(w * u * v) AS v1,
          count(*) FILTER (WHERE own) AS n_usable, bool_or(u <= 0 AND w > 0) AND bool_or(u >= 0 AND w > 0) AS both_sides FROM weighted GROUP BY ALL),
        fitted AS (SELECT vehicle_id, pass_no, t_index, coalesce(n_usable, 0) AS n_usable, coalesce(both_sides, false) AS both_sides, CASE WHEN s0 > 0 THEN s0 * s0 / ww ELSE 0 END AS support,
          CASE WHEN s0 * s2 - s1 * s1 > 1e-6 * s0 * s2 THEN (s2 * x0 - s1 * x1) / (s0 * s2 - s1 * s1) WHEN s0 > 0 THEN x0 / s0 END AS x,
          CASE WHEN s0 * s2 - s1 * s1 > 1e-6 * s0 * s2 THEN (s2 * v0 - s1 * v1) / (s0 * s2 - s1 * s1) WHEN s0 > 0 THEN v0 / s0 END AS v
          FROM periods LEFT JOIN sums USING (vehicle_id, pass_no, t_index)),
        judged AS (SELECT *, CASE WHEN n_usable > 0 THEN 'observed' WHEN support >= 2 AND both_sides THEN 'filled' ELSE 'missing' END AS status FROM fitted)
        SELECT vehicle_id, pass_no, t_index, (t_index + 0.5e0) * 5 AS time_seconds, CASE WHEN status <> 'missing' THEN floor(x * 100 + 0.5e0) / 100 END AS x_meters,
          CASE WHEN status <> 'missing' THEN floor(greatest(v, 0) * 100 + 0.5e0) / 100 END AS velocity, n_usable, floor(support * 10000 + 0.5e0) / 10000 AS effective_support, status FROM judged
    """,
    "p5_found": """
        SELECT DISTINCT 'flow_data' AS table_name, cell_id AS row_id, 'speed' AS field FROM flow_data
        WHERE speed IS NULL OR isnan(speed) OR speed < 0 OR speed > 60 OR (speed = 0 AND flow > 0 AND NOT isnan(flow)) OR (speed > 1.5 AND flow = 0)
        UNION ALL
        SELECT DISTINCT 'discretized_trajectories', obs_id, 't_index' FROM discretized_trajectories WHERE t_index IS NULL OR t_index < 0
        UNION ALL
        SELECT DISTINCT 'discretized_trajectories', obs_id, 'x_index' FROM discretized_trajectories WHERE x_index IS NULL OR x_index NOT BETWEEN 0 AND 44
    """,
}

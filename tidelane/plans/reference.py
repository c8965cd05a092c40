"""Queries of the reconstruction engine's own operators, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions.diagrams import COLUMNS as M
from tidelane.functions.diagrams import DEFAULTS, FAMILIES, ConvexSpeed, ModifiedSecondOrder, SecondOrder, diagram
from tidelane.operators import fields, metrics, roads, stencils
from tidelane.operators import measurements as ms
from tidelane.operators import trajectory as tr
from tidelane.session import table
from tidelane.sources.traffic import SITE_LIMITS, camera_trajectories

DT, DX, CELLS = 5.0, 200.0, 45
STATE = ["location", "t_index"]
QUERIES = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def um(c: Column) -> Column:
    """To whole millionths."""
    return F.floor(c * 1e6 + 0.5).cast("long")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct readings of known vehicles (deliveries again are one, with the smallest event_id)."""
    rows = table(spark, sf_dir, "trajectories").where("vehicle_id is not null and pass_no is not null")
    value = F.min_by(F.struct("location", "x_meters", "velocity", "space_headway", "time_headway"), "event_id")
    return rows.groupBy("vehicle_id", "pass_no", "time_seconds").agg(F.min("event_id").alias("event_id"), value.alias("r")).select("vehicle_id", "pass_no", "time_seconds", "event_id", "r.*")


_READ = """
    readings AS (SELECT vehicle_id, pass_no, time_seconds, min(event_id) AS event_id, arg_min(r, event_id).location AS location,
        arg_min(r, event_id).x AS x_meters, arg_min(r, event_id).v AS velocity, arg_min(r, event_id).sh AS space_headway, arg_min(r, event_id).th AS time_headway
      FROM (SELECT *, {'location': location, 'x': x_meters, 'v': velocity, 'sh': space_headway, 'th': time_headway} AS r FROM trajectories)
      WHERE vehicle_id IS NOT NULL AND pass_no IS NOT NULL GROUP BY vehicle_id, pass_no, time_seconds)"""
_MEAN = "CAST(floor(sum({c}) / CAST(count({c}) AS DOUBLE) + 0.5) AS BIGINT)"
_UM = "CAST(floor({c} * 1e6 + 0.5e0) AS BIGINT)"
_UMD = "floor({c} * 1e6 + 0.5e0)"
_CELL = f"CAST(floor(time_seconds / {DT}e0) AS BIGINT) AS t_index, CAST(floor(x_meters / {DX}e0) AS BIGINT) AS x_index"
_STEPS = f"""
    steps AS (SELECT *, CAST(floor(x_meters / {DX}e0) AS BIGINT) AS x_index FROM (
      SELECT vehicle_id, pass_no, CAST(floor(time_seconds / {DT}e0) AS BIGINT) AS t_index, max(time_seconds) AS time_seconds, any_value(location) AS location,
        arg_max(x_meters, {{'t': time_seconds, 'e': event_id}}) AS x_meters, {_MEAN.format(c="v_um")} AS v_um
      FROM (SELECT *, {_UM.format(c="velocity")} AS v_um FROM readings WHERE time_seconds IS NOT NULL AND x_meters IS NOT NULL AND velocity IS NOT NULL AND NOT isnan(velocity))
      GROUP BY vehicle_id, pass_no, CAST(floor(time_seconds / {DT}e0) AS BIGINT)) WHERE floor(x_meters / {DX}e0) BETWEEN 0 AND {CELLS - 1})"""
_SHARE = "('0x' || substr(md5(vehicle_id || '#{seed}'), 1, 8))::BIGINT"


def _camera_sql(location: str, lanes: str, low: float, high: float, shown: str) -> str:
    return f"""
    WITH base AS (SELECT DISTINCT * FROM ngsim_raw),
    site AS (SELECT CAST(vehicle_id AS VARCHAR) AS vehicle_id, global_time AS global_ms, local_y / 3.28084e0 AS x_meters, local_x AS y_meters, v_vel / 3.28084e0 AS velocity,
        space_headway / 3.28084e0 AS space_headway, time_headway, CAST(lane_id AS INTEGER) AS lane_id
      FROM base WHERE regexp_replace(lower(trim(location)), '[ _]+', '-', 'g') = '{location}' AND lane_id IN ({lanes})),
    timed AS (SELECT *, (global_ms - (SELECT min(global_ms) FROM site)) / 1000e0 AS time_seconds FROM site),
    back AS (SELECT *, CASE WHEN x_meters - lag(x_meters) OVER w < -100e0 THEN 1 ELSE 0 END AS b FROM timed WINDOW w AS (PARTITION BY vehicle_id ORDER BY global_ms, x_meters)),
    trips AS (SELECT *, vehicle_id || '_' || CAST(sum(b) OVER (PARTITION BY vehicle_id ORDER BY global_ms, x_meters ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS trip FROM back)
    SELECT {shown} trip AS vehicle_id, global_ms, x_meters - {low}e0 AS x_meters, y_meters, velocity, space_headway, time_headway, lane_id, time_seconds FROM trips
    WHERE x_meters > {low}e0 AND x_meters < {high}e0"""


@query(_camera_sql("us-101", "1, 2, 3", 20, 620, ""))
def camera_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera_trajectories(table(spark, sf_dir, "ngsim_raw"), "us-101", [1, 2, 3]).select(
        "vehicle_id", "global_ms", "x_meters", "y_meters", "velocity", "space_headway", "time_headway", "lane_id", "time_seconds"
    )


@query(" UNION ALL ".join(f"SELECT * FROM ({_camera_sql(name, '1, 2, 3, 4, 5, 6, 7, 8', int(low), int(high), f"'{name}' AS location,")})" for name, (low, high) in SITE_LIMITS.items()))
def camera_load_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load of every site with study limits, lanes 1 to 8 (camera_load: one site and three lanes, as its SQL has it).

    time_seconds begins at each site's first record, and vehicle_id is one trip within its site.
    """
    raw, out = table(spark, sf_dir, "ngsim_raw"), None
    for location in SITE_LIMITS:
        part = camera_trajectories(raw, location, list(range(1, 9))).select(
            F.lit(location).alias("location"), "vehicle_id", "global_ms", "x_meters", "y_meters", "velocity", "space_headway", "time_headway", "lane_id", "time_seconds"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""
    WITH {_READ}, w AS (SELECT *, CAST(floor({_SHARE.format(seed=1)} / 4294967296e0 * 3000) AS BIGINT) AS s, CAST(floor(time_seconds * 1000 + 0.5e0) AS BIGINT) AS ms
      FROM readings WHERE {_SHARE.format(seed=0)} < 429496729)
    SELECT vehicle_id, pass_no, CAST(floor((ms + s) / 3000.0) AS BIGINT) * 3000 - s AS window_ms, min(time_seconds) AS time_seconds,
      arg_min(event_id, {{'t': time_seconds, 'e': event_id}}) AS event_id FROM w GROUP BY vehicle_id, pass_no, CAST(floor((ms + s) / 3000.0) AS BIGINT) * 3000 - s
""")
def thinned_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tr.sample_vehicles(readings(spark, sf_dir), 0.1)
    return tr.thin_out(rows, 3000).select("vehicle_id", "pass_no", "window_ms", "time_seconds", "event_id")


@query(f"WITH {_READ}, {_STEPS} SELECT vehicle_id, pass_no, t_index, time_seconds, x_meters, v_um, x_index FROM steps")
def discretised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.discretise(readings(spark, sf_dir), DT, DX, CELLS)


@query(f"""
    WITH {_READ}, {_STEPS}
    SELECT vehicle_id, pass_no, t_index, v_um, x_index, false AS is_boundary_information FROM steps WHERE {_SHARE.format(seed=0)} < 858993459
    UNION ALL
    SELECT vehicle_id || '_boundary', pass_no, t_index, v_um, x_index, true FROM steps WHERE x_index IN (0, {CELLS - 1}) AND {_SHARE.format(seed=7)} < 2147483648
""")
def probe_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tr.probe_observations(readings(spark, sf_dir), 0.2, 0.5, DT, DX, CELLS)
    return rows.select("vehicle_id", "pass_no", "t_index", "v_um", "x_index", "is_boundary_information")


_WITHIN = f"""
    inside AS (SELECT *, time_seconds - (SELECT min(time_seconds) FROM readings WHERE time_seconds > 600 AND time_seconds < 7200) AS t FROM readings WHERE time_seconds > 600 AND time_seconds < 7200)"""


@query(f"WITH {_READ}, {_WITHIN} SELECT event_id, CAST(floor(t * 1000 + 0.5e0) AS BIGINT) AS ms FROM inside")
def strict_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings strictly between two times, counted from the first of them; refused if there is none."""
    return tr.within(readings(spark, sf_dir), 600.0, 7200.0).select("event_id", F.floor(F.col("time_seconds") * 1000 + 0.5).cast("long").alias("ms"))


@query(f"""
    WITH {_READ}, {_WITHIN}, top AS (SELECT max(x_meters) AS x, max(t) AS t FROM inside),
    kept AS (SELECT i.*, i.t AS seconds FROM inside i, top WHERE i.x_meters > 0 AND i.x_meters < top.x AND i.t >= 0 AND i.t < top.t),
    steps AS (SELECT *, CAST(floor(x_meters / {DX}e0) AS BIGINT) AS x_index FROM (
      SELECT vehicle_id, pass_no, CAST(floor(seconds / {DT}e0) AS BIGINT) AS t_index, arg_max(x_meters, {{'t': seconds, 'e': event_id}}) AS x_meters, {_MEAN.format(c="v_um")} AS v_um
      FROM (SELECT *, {_UM.format(c="velocity")} AS v_um FROM kept WHERE velocity IS NOT NULL AND NOT isnan(velocity)) GROUP BY vehicle_id, pass_no, CAST(floor(seconds / {DT}e0) AS BIGINT))),
    size AS (SELECT CAST(floor(max(x_meters) / {DX}e0) AS BIGINT) AS last FROM kept)
    SELECT vehicle_id, pass_no, t_index, v_um, x_index, false AS is_boundary_information FROM steps WHERE {_SHARE.format(seed=0)} < 858993459
    UNION ALL
    SELECT vehicle_id || '_boundary', pass_no, t_index, v_um, x_index, true FROM steps, size WHERE x_index IN (0, last) AND {_SHARE.format(seed=7)} < 2147483648
""")
def prepared_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an experiment over a part of the time may see: the whole preparation."""
    data = tr.prepare_probe_data(readings(spark, sf_dir), 600.0, 7200.0, 0.2, 0.5, DT, DX)
    return data.observations.select("vehicle_id", "pass_no", "t_index", "v_um", "x_index", "is_boundary_information")


@query("""SELECT obs_id, CAST(row_number() OVER (PARTITION BY location ORDER BY -x_meters, obs_id) - 1 AS INTEGER) AS cell
    FROM (SELECT DISTINCT obs_id, location, x_meters FROM discretized_trajectories WHERE x_meters IS NOT NULL AND NOT isnan(x_meters))""")
def ranked_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations numbered along their road, the other way round."""
    rows = table(spark, sf_dir, "discretized_trajectories").where("x_meters is not null and not isnan(x_meters)").select(F.col("obs_id").alias("edge_id"), "location", "x_meters").distinct()
    return roads.ranked(rows, "x_meters", "location", southbound=True, width=200.0).select(F.col("edge_id").alias("obs_id"), "cell")


_MEANS = f"""
    per AS (SELECT location, t_index, x_index, vehicle_id, {_MEAN.format(c="v_um")} AS v_um FROM (
        SELECT *, {_CELL}, {_UM.format(c="velocity")} AS v_um FROM readings WHERE velocity IS NOT NULL AND NOT isnan(velocity) AND x_meters IS NOT NULL)
      GROUP BY location, t_index, x_index, vehicle_id),
    means AS (SELECT location, t_index, x_index, {_MEAN.format(c="v_um")} AS mean_velocity_um, count(*) AS n_vehicles FROM per GROUP BY location, t_index, x_index)"""


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.cell_means(readings(spark, sf_dir), ["velocity"], DT, DX)


@query(f"WITH {_READ}, {_MEANS} SELECT * FROM means")
def cell_mean_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir)


@query(f"""
    WITH {_READ}, per AS (SELECT location, t_index, x_index, vehicle_id, {_MEAN.format(c="v")} AS v, {_MEAN.format(c="sh")} AS sh, {_MEAN.format(c="th")} AS th FROM (
        SELECT *, {_CELL}, {_UM.format(c="velocity")} AS v, {_UM.format(c="space_headway")} AS sh, {_UM.format(c="time_headway")} AS th FROM readings
        WHERE velocity IS NOT NULL AND NOT isnan(velocity) AND x_meters IS NOT NULL AND space_headway > 0 AND time_headway <= 9999 AND NOT isnan(space_headway) AND NOT isnan(time_headway))
      GROUP BY location, t_index, x_index, vehicle_id),
    means AS (SELECT location, t_index, x_index, {_MEAN.format(c="v")} AS v, {_MEAN.format(c="sh")} AS sh, {_MEAN.format(c="th")} AS th FROM per GROUP BY location, t_index, x_index)
    SELECT location, t_index, x_index, v AS speed_um, CAST(floor(1e12 / nullif(CAST(sh AS DOUBLE), 0) + 0.5e0) AS BIGINT) AS density_um, CAST(floor(1e12 / nullif(CAST(th AS DOUBLE), 0) + 0.5e0) AS BIGINT) AS flow_um FROM means
""")
def headway_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.headway_fields(readings(spark, sf_dir), DT, DX)


@query(f"""
    WITH {_READ}, keyed AS (SELECT *, {_CELL}, {_UM.format(c="velocity")} AS v_um FROM readings WHERE x_meters IS NOT NULL AND velocity IS NOT NULL AND NOT isnan(velocity)),
    moved AS (SELECT *, CASE WHEN x_index > coalesce(lag(x_index) OVER (PARTITION BY vehicle_id, pass_no ORDER BY time_seconds, event_id), -1) THEN 1 ELSE 0 END AS arrival FROM keyed),
    per AS (SELECT location, t_index, x_index, vehicle_id, pass_no, {_MEAN.format(c="v_um")} AS v_um, count(*) AS n, sum(arrival) AS a FROM moved GROUP BY location, t_index, x_index, vehicle_id, pass_no),
    cells AS (SELECT location, t_index, x_index, {_MEAN.format(c="v_um")} AS mean_velocity_um, CAST(sum(a) AS BIGINT) AS arrivals, CAST(sum(n) AS BIGINT) AS n_readings FROM per GROUP BY location, t_index, x_index)
    SELECT *, CAST(floor(n_readings * 1e6 / sum(n_readings) OVER (PARTITION BY location, t_index) + 0.5e0) AS BIGINT) AS share_um FROM cells
""")
def weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.weighted_fields(readings(spark, sf_dir), DT, DX)


_DENSE = f"""
    per AS (SELECT location, t_index, x_index, vehicle_id, {_MEAN.format(c="v_um")} AS v_um FROM (
        SELECT *, CAST(floor(time_seconds / {DT}e0) AS BIGINT) AS t_index, CAST(floor(x_meters / {DX}e0) AS BIGINT) AS x_index, {_UM.format(c="velocity")} AS v_um FROM readings WHERE velocity IS NOT NULL AND NOT isnan(velocity) AND x_meters IS NOT NULL)
      GROUP BY location, t_index, x_index, vehicle_id),
    means AS (SELECT location, t_index, x_index, {_MEAN.format(c="v_um")} AS v_um FROM per GROUP BY location, t_index, x_index),
    extent AS (SELECT location, min(t_index) AS a, max(t_index) AS b FROM means GROUP BY location),
    grid AS (SELECT location, t_index, unnest(range(0, {CELLS})) AS x_index FROM (SELECT location, unnest(range(a, b + 1)) AS t_index FROM extent)),
    dense AS (SELECT location, t_index, x_index, v_um FROM grid LEFT JOIN means USING (location, t_index, x_index))"""


def _step_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.cell_means(readings(spark, sf_dir), ["velocity"], DT, DX).select("location", "t_index", "x_index", F.col("mean_velocity_um").alias("v_um"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.dense_grid(_step_means(spark, sf_dir), CELLS, "v_um")


@query(f"WITH {_READ}, {_DENSE} SELECT location, t_index, x_index, CAST(v_um AS DOUBLE) AS v_um FROM dense")
def dense_speed_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).withColumn("v_um", F.col("v_um").cast("double"))


@query(f"""WITH {_READ}, {_DENSE}
    SELECT location, t_index, x_index, coalesce(last_value(v_um IGNORE NULLS) OVER (PARTITION BY location, x_index ORDER BY t_index ROWS UNBOUNDED PRECEDING), 25000000) AS v_um FROM dense
""")
def forward_filled_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.forward_fill(_dense(spark, sf_dir), "v_um", 25_000_000)


_FLOW = """
    flow_field AS (SELECT location, t_index, x_index, max(CASE WHEN speed BETWEEN 0 AND 60 AND NOT (speed = 0 AND flow > 0) THEN CAST(floor(speed * 1e6 + 0.5e0) AS BIGINT) END) AS v_um,
      CASE WHEN max(CASE WHEN isnan(density) THEN NULL ELSE density END) IS NOT NULL THEN greatest(max(CASE WHEN isnan(density) THEN NULL ELSE density END), 0.001e0) END AS rho,
      max(CASE WHEN speed BETWEEN 0 AND 60 THEN speed END) AS speed FROM flow_data GROUP BY location, t_index, x_index)"""


def _flow_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow_data without repeated rows: null where speed or density is missing; a density of 0 counts as 0.001 vehicles a metre."""
    s, k = F.col("speed"), F.max(F.when(~F.isnan("density"), F.col("density")))
    good = (s >= 0) & (s <= 60) & ~F.coalesce((s == 0) & (F.col("flow") > 0), F.lit(False))
    return table(spark, sf_dir, "flow_data").groupBy("location", "t_index", "x_index").agg(
        F.max(F.when(good, um(s))).alias("v_um"),
        F.when(k.isNotNull(), F.greatest(k, F.lit(0.001))).alias("rho"),
        F.max(F.when((s >= 0) & (s <= 60), s)).alias("speed"),
    )


@query(f"""WITH {_FLOW},
    missing AS (SELECT location, t_index, x_index FROM flow_field WHERE v_um IS NULL),
    known AS (SELECT location, t_index AS ot, x_index AS ox, v_um AS ov FROM flow_field WHERE v_um IS NOT NULL)
    SELECT location, t_index, x_index, v_um FROM flow_field WHERE v_um IS NOT NULL
    UNION ALL
    SELECT location, t_index, x_index, arg_min(ov, {{'d': (ot - t_index) * (ot - t_index) + (ox - x_index) * (ox - x_index), 't': ot, 'x': ox}}) FROM missing JOIN known USING (location) GROUP BY location, t_index, x_index
""")
def nearest_filled_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.nearest_fill(_flow_field(spark, sf_dir).select("location", "t_index", "x_index", "v_um"), "v_um")


@query(f"""WITH {_FLOW},
    first AS (SELECT location, t_index, x_index, CAST(floor(sum(v_um) OVER w / CAST(count(v_um) OVER w AS DOUBLE) + 0.5e0) AS BIGINT) AS m FROM flow_field
      WINDOW w AS (PARTITION BY location, x_index ORDER BY t_index RANGE BETWEEN 5 PRECEDING AND CURRENT ROW))
    SELECT location, t_index, x_index, floor(sum(m) OVER w / CAST(count(m) OVER w AS DOUBLE) + 0.5e0) AS smooth_um FROM first
    WINDOW w AS (PARTITION BY location, t_index ORDER BY x_index RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def rolling_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.rolling_means(_flow_field(spark, sf_dir), "v_um", 6, 3).withColumn("smooth_um", F.col("smooth_um").cast("double"))


@query(f"""WITH {_FLOW} SELECT location, CAST(floor(t_index / 4.0) AS BIGINT) AS t_index, CAST(floor(x_index / 2.0) AS BIGINT) AS x_index, CAST({_MEAN.format(c="v_um")} AS DOUBLE) AS v_um
    FROM flow_field WHERE x_index < 44 GROUP BY location, CAST(floor(t_index / 4.0) AS BIGINT), CAST(floor(x_index / 2.0) AS BIGINT)""")
def coarse_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.coarsen(_flow_field(spark, sf_dir), "v_um", 4, 2, CELLS).withColumn("v_um", F.col("v_um").cast("double"))


@query(f"""WITH {_READ}, {_DENSE}, filled AS (SELECT location, t_index, x_index, coalesce(last_value(v_um IGNORE NULLS) OVER (PARTITION BY location, x_index ORDER BY t_index ROWS UNBOUNDED PRECEDING), 25000000) AS v FROM dense),
    n AS (SELECT *, row_number() OVER w - 1 AS a, count(*) OVER (PARTITION BY location, x_index) - row_number() OVER w AS z, first_value(v) OVER p AS f, last_value(v) OVER p AS l,
      sum(v) OVER (PARTITION BY location, x_index ORDER BY t_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM filled
      WINDOW w AS (PARTITION BY location, x_index ORDER BY t_index), p AS (PARTITION BY location, x_index ORDER BY t_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT location, t_index, x_index, CAST(floor((s + greatest(3 - a, 0) * f + greatest(3 - z, 0) * l) / 7e0 + 0.5e0) AS BIGINT) AS smooth_um FROM n""")
def moving_average_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.moving_average(fields.forward_fill(_dense(spark, sf_dir), "v_um", 25_000_000), "v_um", 3)


_ASM = """
    met AS (SELECT g.location, g.t_index, g.x_index, o.v_um / 1e6 AS v, (g.t_index - o.t_index) * 60e0 AS a, (g.x_index - o.x_index) * 200e0 AS b
      FROM flow_field g JOIN flow_field o ON g.location = o.location AND abs(g.t_index - o.t_index) <= 100 AND o.v_um IS NOT NULL),
    weighted AS (SELECT location, t_index, x_index, v, greatest(exp(-abs(a - b / {c}) / 60e0 - abs(b) / 200e0), 1e-8) AS wc, greatest(exp(-abs(a - b / {f}) / 60e0 - abs(b) / 200e0), 1e-8) AS wf FROM met),
    sums AS (SELECT location, t_index, x_index, sum(wc * v) / sum(wc) AS vc, sum(wf * v) / sum(wf) AS vf FROM weighted GROUP BY location, t_index, x_index)
    SELECT location, t_index, x_index, CAST(floor((0.5e0 * (1 + tanh(({t} - least(vc, vf)) / {w})) * vc + (1 - 0.5e0 * (1 + tanh(({t} - least(vc, vf)) / {w}))) * vf) * 1e3 + 0.5e0) AS BIGINT) AS speed_milli FROM sums"""
_BLEND = dict(t=f"({60 / 3.6!r}::DOUBLE)", w=f"({20 / 3.6!r}::DOUBLE)")


def _smoothed(spark: SparkSession, sf_dir: str, v_cong: float, v_free: float) -> DataFrame:
    field = _flow_field(spark, sf_dir)
    out = fields.adaptive_smoothing(field, 60.0, DX, "v_um", CELLS, fields.Smoothing(v_cong=v_cong, v_free=v_free))
    return out.select("location", "t_index", "x_index", F.floor(F.col("speed") * 1e3 + 0.5).cast("long").alias("speed_milli"))


@query(f"WITH {_FLOW}, {_ASM.format(c=f'({-15 / 3.6!r}::DOUBLE)', f=f'({70 / 3.6!r}::DOUBLE)', **_BLEND)}")
def adaptive_smoothed_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoothed(spark, sf_dir, -15 / 3.6, 70 / 3.6)


@query(f"WITH {_FLOW}, {_ASM.format(c='1e6', f='1e6', **_BLEND)}")
def isotropic_smoothed_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoothed(spark, sf_dir, 1e6, 1e6)


_GAUSS = "greatest(exp(-0.5e0 * (((a - b / {w}) / 120e0) * ((a - b / {w}) / 120e0) + (b / 400e0) * (b / 400e0))), 1e-8)"
_AWAY = "abs((t + 0.5e0) / 4 - 0.5e0 - t_index)", "abs((x + 0.5e0) / 2 - 0.5e0 - x_index)"


@query(f"""WITH {_FLOW},
    coarse AS (SELECT location, CAST(floor(t_index / 4.0) AS BIGINT) AS t_index, CAST(floor(x_index / 2.0) AS BIGINT) AS x_index, {_MEAN.format(c="v_um")} AS v_um FROM flow_field WHERE x_index < 44 GROUP BY ALL),
    met AS (SELECT g.location, g.t_index, g.x_index, o.v_um / 1e6 AS v, (g.t_index - o.t_index) * 240e0 AS a, (g.x_index - o.x_index) * 400e0 AS b
      FROM coarse g JOIN coarse o ON g.location = o.location AND abs(g.t_index - o.t_index) <= 3 AND abs(g.x_index - o.x_index) <= 3 AND o.v_um IS NOT NULL),
    sums AS (SELECT location, t_index, x_index, sum(wc * v) / sum(wc) AS vc, sum(wf * v) / sum(wf) AS vf
      FROM (SELECT *, {_GAUSS.format(w=f'({-15 / 3.6!r}::DOUBLE)')} AS wc, {_GAUSS.format(w=f'({70 / 3.6!r}::DOUBLE)')} AS wf FROM met) GROUP BY location, t_index, x_index),
    smooth AS (SELECT location, t_index, x_index, 0.5e0 * (1 + tanh(({_BLEND['t']} - least(vc, vf)) / {_BLEND['w']})) * vc + (1 - 0.5e0 * (1 + tanh(({_BLEND['t']} - least(vc, vf)) / {_BLEND['w']}))) * vf AS v FROM sums),
    placed AS (SELECT location, t_index, x_index, v FROM coarse LEFT JOIN smooth USING (location, t_index, x_index)),
    spread AS (SELECT *, unnest(range(t_index * 4 - 4, t_index * 4 + 8)) AS t FROM placed), wide AS (SELECT *, unnest(range(x_index * 2 - 2, x_index * 2 + 4)) AS x FROM spread),
    weighted AS (SELECT *, CASE WHEN v IS NOT NULL THEN (1 - {_AWAY[0]}) * (1 - {_AWAY[1]}) END AS w, floor(t / 4.0) = t_index AND floor(x / 2.0) = x_index AS own FROM wide WHERE {_AWAY[0]} < 1 AND {_AWAY[1]} < 1)
    SELECT location, t AS t_index, x AS x_index, floor(sum(w * v) / sum(w) * 1e3 + 0.5e0) AS speed_milli FROM weighted GROUP BY location, t, x HAVING bool_or(own)""")
def upsampled_smooth_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed with a normal kernel on a coarse grid, and interpolated back onto the fine one."""
    coarse = fields.coarsen(_flow_field(spark, sf_dir), "v_um", 4, 2, CELLS)
    rules = fields.Smoothing(tau=120.0, delta=400.0, reach_t=3, reach_x=3, gaussian=True)
    fine = fields.upsample(fields.adaptive_smoothing(coarse, 4 * 60.0, 2 * DX, "v_um", CELLS // 2, rules), "speed", 4, 2)
    return fine.select("location", "t_index", "x_index", F.floor(F.col("speed") * 1e3 + 0.5).cast("double").alias("speed_milli"))


@query(f"WITH {_FLOW} SELECT location, count(v_um) AS n, CAST(floor(var_pop(v_um / 1e6) * 1e3 + 0.5e0) AS BIGINT) AS variance_milli, CAST(floor(avg(v_um / 1e6) * 1e3 + 0.5e0) AS BIGINT) AS mean_milli FROM flow_field GROUP BY location")
def field_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v_um") / 1e6
    return _flow_field(spark, sf_dir).groupBy("location").agg(
        F.count("v_um").alias("n"), F.floor(F.var_pop(v) * 1e3 + 0.5).cast("long").alias("variance_milli"), F.floor(F.avg(v) * 1e3 + 0.5).cast("long").alias("mean_milli")
    )


@query(f"""WITH {_FLOW}, first AS (SELECT location, t_index, x_index, v_um, CAST(floor(sum(v_um) OVER w / CAST(count(v_um) OVER w AS DOUBLE) + 0.5e0) AS BIGINT) AS m FROM flow_field
      WINDOW w AS (PARTITION BY location, x_index ORDER BY t_index RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)),
    smooth AS (SELECT location, t_index, x_index, v_um, floor(sum(m) OVER w / CAST(count(m) OVER w AS DOUBLE) + 0.5e0) AS s FROM first WINDOW w AS (PARTITION BY location, t_index ORDER BY x_index RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT location, count(v_um - s) AS n, CAST(floor(var_pop((v_um - s) / 1e6) * 1e3 + 0.5e0) AS BIGINT) AS variance_milli, CAST(floor(var_pop(v_um / 1e6) * 1e3 + 0.5e0) AS BIGINT) AS field_variance_milli FROM smooth GROUP BY location""")
def residual_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a field's variance is left beside an estimate of it (here the rolling mean)."""
    field = _flow_field(spark, sf_dir).select("location", "t_index", "x_index", "v_um")
    met = field.join(fields.rolling_means(field, "v_um", 6, 3), fields.CELL)
    out = metrics.variances(met, "location", F.col("v_um") / 1e6, F.col("smooth_um") / 1e6)
    milli = lambda c: F.floor(F.col(c) * 1e3 + 0.5).cast("long")
    return out.select("location", "n", milli("residual").alias("variance_milli"), milli("field").alias("field_variance_milli"))


@query(f"""WITH {_READ}, {_STEPS}, observed AS (SELECT DISTINCT vehicle_id FROM steps WHERE {_SHARE.format(seed=0)} < 858993459)
    SELECT vehicle_id, pass_no, t_index, v_um FROM steps WHERE vehicle_id NOT IN (SELECT vehicle_id FROM observed)""")
def hidden_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = tr.discretise(readings(spark, sf_dir), DT, DX, CELLS)
    return metrics.hidden_vehicles(steps, tr.sample_vehicles(steps, 0.2)).select("vehicle_id", "pass_no", "t_index", "v_um")


@query(f"""WITH {_READ}, {_MEANS}, joined AS (SELECT m.location, p.v_um, m.mean_velocity_um AS field_um FROM per p JOIN means m USING (location, t_index, x_index) WHERE t_index >= 0 AND x_index >= 0),
    sq AS (SELECT location, CAST(floor(((v_um - field_um)::DOUBLE / 1e6) * ((v_um - field_um)::DOUBLE / 1e6) * 1e6 + 0.5e0) AS BIGINT) AS s FROM joined)
    SELECT location, count(*) AS n, CAST(floor(sqrt(sum(s)::BIGINT / 1e6 / count(*)) * 3600 + 0.5e0) AS BIGINT) AS rmse_kmh_milli FROM sq GROUP BY location""")
def trajectory_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vehicle's mean against its cell's, as a window over the cell (the per-vehicle means are made once)."""
    per = fields.per_vehicle(readings(spark, sf_dir), ["velocity"], DT, DX).withColumnRenamed("velocity", "v_um")
    return metrics.root_mean_square(metrics.squared_errors_in_cell(per), ["location"])


_OBSERVED = """
    observed AS (SELECT DISTINCT obs_id, location, t_index, x_index, CAST(floor(velocity * 1e6 + 0.5e0) AS BIGINT) AS v_um FROM discretized_trajectories
      WHERE t_index >= 0 AND x_index BETWEEN 0 AND 44 AND velocity IS NOT NULL AND NOT isnan(velocity))"""


@query(f"""WITH {_OBSERVED}, served AS (SELECT *, unnest([t_index - 1, t_index]) AS step FROM observed)
    SELECT location, step, x_index, {_MEAN.format(c="v_um")} AS v_um, count(*) AS n, 1.0 / count(*) AS relative_variance FROM served GROUP BY location, step, x_index""")
def step_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.step_measurements(ms.observations(table(spark, sf_dir, "discretized_trajectories"), CELLS))


@query(f"""WITH {_OBSERVED}, served AS (SELECT *, unnest([t_index - 1, t_index]) AS step, v_um / 1e6 AS v FROM observed),
    dense AS (SELECT location, step, x_index, v, CASE WHEN v <= (0.56e0 / 0.0186e0) THEN 0.127e0 / (1e0 + v / (0.56e0 / (0.127e0 - 0.0186e0))) ELSE (0.0186e0 / 2) END AS r FROM served WHERE v > 0.1)
    SELECT location, step, x_index, CAST(floor(sum(v * v / r) / sum(v / r) * 1e3 + 0.5e0) AS BIGINT) AS v_milli FROM dense GROUP BY location, step, x_index""")
def flow_weighted_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.flow_weighted(ms.observations(table(spark, sf_dir, "discretized_trajectories"), CELLS))


@query(f"""WITH {_OBSERVED}, served AS (SELECT *, unnest(range(t_index - 2, t_index + 3)) AS step FROM observed)
    SELECT location, step, x_index, least(greatest({_MEAN.format(c="v_um")}, 0), 30000000) AS v_um FROM served GROUP BY location, step, x_index""")
def clipped_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.clipped(ms.observations(table(spark, sf_dir, "discretized_trajectories"), CELLS), 30.0)


@query("""SELECT model, count(*) FILTER (WHERE data.probe_fraction = 0.05) AS share_05, count(*) FILTER (WHERE data.probe_fraction = 0.1) AS share_10,
    count(*) FILTER (WHERE data.probe_fraction = 0.2) AS share_20, count(*) FILTER (WHERE data.probe_fraction = 0.3) AS share_30,
    count(*) FILTER (WHERE data.probe_fraction NOT IN (0.05, 0.1, 0.2, 0.3)) AS share_other FROM experiment_runs WHERE data.probe_fraction IS NOT NULL GROUP BY model""")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_report(table(spark, sf_dir, "experiment_runs"), [0.05, 0.1, 0.2, 0.3])


@query("""
    WITH m AS (SELECT DISTINCT model FROM experiment_runs WHERE model IS NOT NULL), f AS (SELECT DISTINCT data.probe_fraction AS share FROM experiment_runs WHERE data.probe_fraction IS NOT NULL),
    s AS (SELECT DISTINCT seed FROM experiment_runs WHERE seed IS NOT NULL), done AS (SELECT model, data.probe_fraction AS share, seed, count(*) AS n FROM experiment_runs GROUP BY ALL)
    SELECT model, share, seed, coalesce(n, 0) AS n_runs FROM m CROSS JOIN f CROSS JOIN s LEFT JOIN done USING (model, share, seed)
""")
def sweep_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of the models, probe shares and seeds in use, with the number of runs made of it."""
    return metrics.sweep_coverage(table(spark, sf_dir, "experiment_runs").select("model", F.col("data.probe_fraction").alias("share"), "seed"))


@query("""SELECT run_id, kalman.q AS kalman_q, kalman.n_particles::DOUBLE AS kalman_n_particles, fourdvar.n_windows::DOUBLE AS fourdvar_n_windows, fourdvar.iterations::DOUBLE AS fourdvar_iterations,
    CASE WHEN len(e) > 0 THEN e[1] END AS first_error, CASE WHEN len(e) > 1 THEN e[2] END AS second_error, CASE WHEN len(e) > 2 THEN e[3] END AS third_error
    FROM (SELECT *, list_filter([rmse, grid_rmse, hidden_rmse], lambda x: x IS NOT NULL AND NOT isnan(x)) AS e FROM experiment_runs)
    WHERE model = 'ekf' OR model = 'lwr_ekf'""")
def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings and errors of the filters' runs as columns: fields of structs, and places of a list that may be shorter."""
    runs = metrics.runs_where(table(spark, sf_dir, "experiment_runs"), model=["ekf", "lwr_ekf"])
    out = metrics.settings_as_columns(runs, ["kalman", "fourdvar"], ["rmse", "grid_rmse", "hidden_rmse"], ["first_error", "second_error", "third_error"])
    return out.select("run_id", *[F.col(c).cast("double").alias(c) for c in out.columns if c != "run_id"])


@query("""
    WITH r AS (SELECT seed, model, CASE model WHEN 'lwr_ekf' THEN 'filter' WHEN 'isotropic' THEN 'smooth' ELSE model END || '-' || coalesce(flow.family, 'none') AS label,
        CASE WHEN isnan(rmse) THEN NULL ELSE CAST(floor(rmse * 1e4 + 0.5e0) AS BIGINT) END AS e FROM experiment_runs),
    kept AS (SELECT * FROM r WHERE e IS NULL OR e <= 300000 ),
    g AS (SELECT label, model, count(*) AS n_runs, count(DISTINCT seed) AS n_seeds, sum(e) AS s, count(e) AS n, sum(e * e) AS ss FROM kept GROUP BY label, model)
    SELECT label, n_runs, n_seeds, CAST(floor(s / n::DOUBLE + 0.5e0) AS BIGINT) AS mean_e4, CAST(floor(sqrt((ss - s::DOUBLE * s / n) / nullif(n - 1, 0)) + 0.5e0) AS BIGINT) AS std_e4,
      CAST(floor(sum(s) OVER (PARTITION BY model) / sum(n) OVER (PARTITION BY model)::DOUBLE + 0.5e0) AS BIGINT) AS model_mean_e4 FROM g
""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_statistics(table(spark, sf_dir, "experiment_runs"), {"lwr_ekf": "filter", "isotropic": "smooth"})


@query(f"""WITH {_FLOW} SELECT location, t_index, x_index FROM flow_field WHERE v_um > 20000000 INTERSECT SELECT location, t_index + 1, x_index FROM flow_field WHERE v_um <= 20000000
    EXCEPT SELECT location, t_index, x_index FROM flow_field WHERE x_index = 0""")
def recovering_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, cell = _flow_field(spark, sf_dir), ["location", "t_index", "x_index"]
    slow = f.where("v_um <= 20000000").select("location", F.col("t_index") + 1, "x_index")
    return f.where("v_um > 20000000").select(*cell).intersect(slow).subtract(f.where("x_index = 0").select(*cell)).toDF(*cell)


# ---- fundamental diagrams over the densities and speeds of flow_data

_DIAGRAM_SQL = {
    "greenshields": ("30e0 * r * (1 - r / 0.2e0)", "30e0 * (1 - r / 0.2e0)", "0.2e0 * (1 - v / 30e0)"),
    "triangular": ("CASE WHEN r <= 0.06e0 THEN 30e0 * r ELSE 1.8e0 / 0.14e0 * (0.2e0 - r) END", "CASE WHEN r <= 0.06e0 THEN 30e0 ELSE 1.8e0 / 0.14e0 * (0.2e0 / r - 1) END", "CASE WHEN v <= 30e0 THEN 0.2e0 / (1 + v / (1.8e0 / 0.14e0)) ELSE 0.03e0 END"),
    "three_parameter": ("0.4e0 * (sqrt(10e0) + (sqrt(50e0) - sqrt(10e0)) * r / 0.2e0 - sqrt(1 + pow(10e0 * (r / 0.2e0 - 0.3e0), 2)))", "NULL::DOUBLE", "NULL::DOUBLE"),
    "quadratic_linear": ("CASE WHEN r < 0.06e0 THEN 30e0 * r * (1 - r / 0.2e0) ELSE 1.8e0 * (1 - r / 0.2e0) END", "CASE WHEN r < 0.06e0 THEN 30e0 * (1 - r / 0.2e0) ELSE 1.8e0 * (1 / r - 5e0) END", "CASE WHEN v > 21e0 THEN 0.2e0 * (1 - v / 30e0) ELSE 0.2e0 / (1 + v / 9e0) END"),
    "other_quadratic_linear": ("CASE WHEN r < 0.05e0 THEN 30e0 * r * (1 - r / 0.1e0) ELSE 4e0 * (0.2e0 - r) END", "CASE WHEN r < 0.05e0 THEN 30e0 * (1 - r / 0.1e0) ELSE 4e0 * (0.2e0 / r - 1) END", "CASE WHEN v > 15e0 THEN 0.1e0 * (1 - v / 30e0) ELSE 0.2e0 / (1 + v / 4e0) END"),
    "zero": ("0e0 * r", "r", "v"),
    "power_law": ("30e0 * r * (1 - pow(r / 0.2e0, 1.5e0))", "30e0 * (1 - pow(r / 0.2e0, 1.5e0))", "0.2e0 * pow(greatest(30e0 - v, 0) / 30e0, 1 / 1.5e0)"),
    "del_castillo": ("r * 30e0 * (1 - exp(1 - exp(least(-5e0 / 30e0 * (1 - 0.2e0 / r), 10))))", "30e0 * (1 - exp(1 - exp(least(-5e0 / 30e0 * (1 - 0.2e0 / r), 10))))", "0.2e0 / (1 + 6e0 * ln(greatest(1 - ln(greatest(1 - v / 30e0, 1e-6)), 1e-6)))"),
    "congested": ("CASE WHEN r < 0.1e0 THEN 1.5e0 ELSE 30e0 * r * (1 - r / 0.2e0) END", "CASE WHEN r < 0.1e0 THEN 1.5e0 / greatest(r, 0.05e0) ELSE 30e0 * (1 - r / 0.2e0) END", "CASE WHEN v > 15e0 THEN 1.5e0 / v ELSE 0.2e0 * (1 - v / 30e0) END"),
    "piecewise_quadratic": ("CASE WHEN r < 0.06e0 THEN 30e0 * r * (1 - r / (0.06e0 / (1 - 1.4e0 / 1.8e0))) ELSE 1.4e0 / 0.0196e0 * (r - 0.2e0) * (0.12e0 - 0.2e0 - r) END", "CASE WHEN r < 0.06e0 THEN 30e0 * (1 - r / (0.06e0 / (1 - 1.4e0 / 1.8e0))) ELSE 1.4e0 / 0.0196e0 * (r - 0.2e0) * (0.12e0 - 0.2e0 - r) / r END", "CASE WHEN v > 1.4e0 / 0.06e0 THEN 0.06e0 / (1 - 1.4e0 / 1.8e0) * (1 - v / 30e0) ELSE 0.2e0 / (1 + v / 30e0 * 0.2e0 / 0.06e0) END"),
}


def _milli(c: Column | None) -> Column:
    return F.lit(None).cast("double") if c is None else F.floor(c * 1e5 + 0.5).cast("double")


def _diagram_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d, rows = diagram(name), _flow_field(spark, sf_dir)
        r, v = F.col("rho") + 1e-7, F.col("speed") + 1e-7
        flow, velocity, density = _milli(d.flow(r, M)), _milli(d.velocity and d.velocity(r, M)), _milli(d.density and d.density(v, M))
        known, seen = F.col("rho").isNotNull(), F.col("speed").isNotNull()
        return rows.select("location", "t_index", "x_index", F.when(known, flow).alias("flow_e5"), F.when(known, velocity).alias("velocity_e5"), F.when(seen, density).alias("density_e5"))

    run.__name__ = f"diagram_{name}"
    q, v, r = (f"floor(({s}) * 1e5 + 0.5e0)" for s in _DIAGRAM_SQL[name])
    query(f"""WITH {_FLOW}, s AS (SELECT location, t_index, x_index, rho + 1e-7 AS r, speed + 1e-7 AS v FROM flow_field)
        SELECT location, t_index, x_index, CASE WHEN r IS NOT NULL THEN {q} END AS flow_e5, CASE WHEN r IS NOT NULL THEN {v} END AS velocity_e5, CASE WHEN v IS NOT NULL THEN {r} END AS density_e5 FROM s""")(run)


for _name in FAMILIES:
    _diagram_query(_name)


# Each named parameter set as SQL: flow of r, speed of r, density of v (constants of the sets; the families' formulas).
def _greenshields_sql(v: str, j: str) -> tuple[str, str, str]:
    return f"{v} * r * (1 - r / {j})", f"{v} * (1 - r / {j})", f"{j} * (1 - v / {v})"


def _triangular_sql(c: str, q: str, j: str, free: str | None = None) -> tuple[str, str, str]:
    back = f"({q} / ({j} - {c}))"
    return (
        f"CASE WHEN r <= {c} THEN {q} / {c} * r ELSE {back} * ({j} - r) END", f"CASE WHEN r <= {c} THEN {q} / {c} ELSE {back} * ({j} / r - 1) END",
        f"CASE WHEN v <= {q} / {c} THEN {j} / (1 + v / {back}) ELSE {free or f'({c} / 2)'} END",
    )


def _quadratic_linear_sql(v: str, j: str, c: str) -> tuple[str, str, str]:
    q = f"({v} * {c})"
    return (
        f"CASE WHEN r < {c} THEN {v} * r * (1 - r / {j}) ELSE {q} * (1 - r / {j}) END",
        f"CASE WHEN r < {c} THEN {v} * (1 - r / {j}) ELSE {q} * (1 / r - 1 / {j}) END",
        f"CASE WHEN v > {v} * (1 - {c} / {j}) THEN {j} * (1 - v / {v}) ELSE {j} / (1 + v / ({q} / {j})) END",
    )


_DIAGRAM_SQL |= {
    "ngsim_greenshields": _greenshields_sql("32.9e0", "0.0611e0"), "ngsim_triangular": _triangular_sql("0.038e0", "0.493e0", "0.096e0"),
    "ngsim_quadratic_linear": _quadratic_linear_sql("32.9e0", "0.096e0", "0.038e0"), "mobile_triangular_low": _triangular_sql("0.0186e0", "0.56e0", "0.127e0"),
    "mobile_triangular": _triangular_sql("0.022e0", "0.63e0", "0.094e0", "0.018e0"), "mobile_quadratic_linear": _quadratic_linear_sql("29.05e0", "0.094e0", "0.022e0"),
    "mobile_greenshields": _greenshields_sql("29.05e0", "0.094e0"),
}
for _name in DEFAULTS:
    _diagram_query(_name)


# ---- one step of each scheme on the states of flow_data (a state: the 45 cells of a location and step)

_GS = "30e0 * {r} * (1 - {r} / 0.2e0)"
_ARZ_STATE = f"""{_FLOW}, st AS (SELECT location, t_index, x_index, rho, rho * (speed + (30e0 - 30e0 * (1 - rho / 0.2e0))) AS q FROM flow_field),
    fl AS (SELECT *, 30e0 - 30e0 * (1 - rho / 0.2e0) AS h, q / greatest(rho, 1e-6) AS w FROM st),
    f AS (SELECT *, q - rho * h AS f1, q * q / greatest(rho, 1e-6) - q * h AS f2, greatest(abs(w - h - rho * 150e0), abs(w - h)) AS a,
      (rho * (30e0 * (1 - rho / 0.2e0)) + rho * h - q) / 5e0 AS src FROM fl),
    n AS (SELECT *, {{sides}} FROM f WINDOW w AS (PARTITION BY location, t_index ORDER BY x_index))"""


def _next(c: str, f: str) -> str:
    """A neighbour's value, the own one beyond an end; null if the neighbour's is unknown."""
    return f"CASE WHEN {f}(x_index) OVER w IS NULL THEN {c} ELSE {f}({c}) OVER w END"


def _known(*columns: str) -> str:
    return " AND ".join(f"{x} IS NOT NULL" for c in columns for x in (c, f"{c}_l", f"{c}_r"))


_EDGE = ", ".join(f"{_next(c, 'lag')} AS {c}_l, {_next(c, 'lead')} AS {c}_r" for c in ("rho", "q", "f1", "f2", "a"))
_SIDES = f"{_next('rho', 'lag')} AS rho_l, {_next('rho', 'lead')} AS rho_r"
_WHOLE = _known("rho")
_ARZ_OUT = f"""SELECT location, t_index, x_index,
    CASE WHEN {_known("rho", "q")} THEN floor((rho - 5e0 / 200e0 * ((0.5e0 * (f1 + f1_r) - 0.5e0 * {{ao}} * (rho_r - rho)) - (0.5e0 * (f1_l + f1) - 0.5e0 * {{ai}} * (rho - rho_l)))) * 1e6 + 0.5e0) END AS rho_next,
    CASE WHEN {_known("rho", "q")} THEN floor((q - 5e0 / 200e0 * ((0.5e0 * (f2 + f2_r) - 0.5e0 * {{ao}} * (q_r - q)) - (0.5e0 * (f2_l + f2) - 0.5e0 * {{ai}} * (q - q_l))) + 5e0 * src) * 1e6 + 0.5e0) END AS q_next FROM n"""
ARZ = SecondOrder(FAMILIES["greenshields"], 5.0)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow_field(spark, sf_dir).select("location", "t_index", "x_index", "rho")


def _arz_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rho")
    return _flow_field(spark, sf_dir).select("location", "t_index", "x_index", "rho", ARZ.q(r, F.col("speed"), M).alias("q"))


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded to millionths; as doubles, since some are null."""
    return df.select("location", "t_index", "x_index", *[um(F.col(c)).cast("double").alias(c) for c in columns])


@query(f"""WITH {_FLOW}, ds AS (SELECT *, CASE WHEN rho <= 0.1e0 THEN {_GS.format(r="rho")} ELSE 1.5e0 END AS d, CASE WHEN rho <= 0.1e0 THEN 1.5e0 ELSE {_GS.format(r="rho")} END AS s FROM flow_field),
    n AS (SELECT *, {_SIDES}, {_next('s', 'lead')} AS s_r, {_next('d', 'lag')} AS d_l FROM ds WINDOW w AS (PARTITION BY location, t_index ORDER BY x_index))
    SELECT location, t_index, x_index, CASE WHEN {_WHOLE} THEN {_UMD.format(c="(rho - 5e0 / 200e0 * (least(d, s_r) - least(d_l, s)))")} END AS rho_next FROM n""")
def godunov_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(stencils.godunov_step(_states(spark, sf_dir), STATE, FAMILIES["greenshields"], DT, DX), "rho_next")


@query(f"""WITH {_FLOW}, ds AS (SELECT *, CASE WHEN rho <= 0.1e0 THEN {_GS.format(r="rho")} ELSE 1.5e0 END AS d, CASE WHEN rho <= 0.1e0 THEN 1.5e0 ELSE {_GS.format(r="rho")} END AS s,
      CASE WHEN rho <= 0.1e0 THEN 30e0 * (1 - 2 * rho / 0.2e0) ELSE 0 END AS dd, CASE WHEN rho <= 0.1e0 THEN 0 ELSE 30e0 * (1 - 2 * rho / 0.2e0) END AS dss FROM flow_field),
    n AS (SELECT *, {_SIDES}, lag(x_index) OVER w IS NULL AS first, lead(x_index) OVER w IS NULL AS last, lead(dss) OVER w AS dsr, lag(dd) OVER w AS ddl,
      d <= ({_next('s', 'lead')}) AS od, ({_next('d', 'lag')}) <= s AS idm FROM ds WINDOW w AS (PARTITION BY location, t_index ORDER BY x_index))
    SELECT location, t_index, x_index, CASE WHEN {_WHOLE} THEN {_UMD.format(c="CASE WHEN NOT first AND idm THEN 0.025e0 * ddl ELSE 0e0 END")} END AS sub,
      CASE WHEN {_WHOLE} THEN {_UMD.format(c="(1 - 0.025e0 * ((CASE WHEN od THEN dd WHEN last THEN dss ELSE 0 END) - (CASE WHEN NOT idm THEN dss WHEN first THEN dd ELSE 0 END)))")} END AS diag,
      CASE WHEN {_WHOLE} THEN {_UMD.format(c="CASE WHEN NOT last AND NOT od THEN -0.025e0 * dsr ELSE 0e0 END")} END AS super FROM n""")
def godunov_jacobian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(stencils.godunov_jacobian(_states(spark, sf_dir), STATE, FAMILIES["greenshields"], DT, DX), "sub", "diag", "super")


@query(f"""WITH {_FLOW}, n AS (SELECT *, {_GS.format(r="rho")} AS f, {_SIDES} FROM flow_field WINDOW w AS (PARTITION BY location, t_index ORDER BY x_index))
    SELECT location, t_index, x_index, CASE WHEN {_WHOLE} THEN {_UMD.format(c=f"(0.5e0 * (rho_r + rho_l) - 5e0 / 400e0 * ({_GS.format(r='rho_r')} - {_GS.format(r='rho_l')}))")} END AS rho_next FROM n""")
def lax_friedrichs_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(stencils.lax_friedrichs_step(_states(spark, sf_dir), STATE, FAMILIES["greenshields"], DT, DX), "rho_next")


@query(f"""WITH {_FLOW}, v AS (SELECT *, sign(0.1e0 - rho) * 18e0 AS v FROM flow_field),
    n AS (SELECT *, {_SIDES}, lag(v) OVER w AS l, lead(v) OVER w AS r, lag(x_index) OVER w IS NULL OR lead(x_index) OVER w IS NULL AS edge FROM v WINDOW w AS (PARTITION BY location, t_index ORDER BY x_index))
    SELECT location, t_index, x_index, CASE WHEN {_WHOLE} THEN {_UMD.format(c="CASE WHEN edge THEN 0e0 ELSE 0.5e0 + 0.0125e0 * l END")} END AS sub, CASE WHEN {_WHOLE} THEN {_UMD.format(c="CASE WHEN edge THEN 1e0 ELSE 0e0 END")} END AS diag,
      CASE WHEN {_WHOLE} THEN {_UMD.format(c="CASE WHEN edge THEN 0e0 ELSE 0.5e0 - 0.0125e0 * r END")} END AS super,
      CASE WHEN {_WHOLE} THEN {_UMD.format(c="CASE WHEN edge THEN 0e0 ELSE 0.0125e0 * 0.2e0 * (least(r, 0) - least(l, 0)) END")} END AS bias FROM n""")
def affine_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelane.functions.diagrams import triangular

    return _whole(stencils.affine_coefficients(_states(spark, sf_dir), STATE, triangular(0.1, 1.8, 0.2), DT, DX), "sub", "diag", "super", "bias")


_VV = "({v}) * (({v}) - 30e0)"


@query(f"""WITH {_FLOW}, ds AS (SELECT location, t_index, x_index, speed AS v FROM flow_field),
    f AS (SELECT *, {_VV.format(v="greatest(v, 15e0)")} AS d, {_VV.format(v="least(v, 15e0)")} AS s FROM ds),
    n AS (SELECT *, {_next('s', 'lead')} AS s_r, {_next('d', 'lag')} AS d_l, {_next('v', 'lag')} AS v_l, {_next('v', 'lead')} AS v_r FROM f WINDOW w AS (PARTITION BY location, t_index ORDER BY x_index))
    SELECT location, t_index, x_index, CASE WHEN {_known("v")} THEN {_UMD.format(c="(v - 5e0 / 200e0 * (greatest(d, s_r) - greatest(d_l, s)))")} END AS v_next FROM n""")
def convex_speed_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flow_field(spark, sf_dir).select("location", "t_index", "x_index", F.col("speed").alias("v"))
    return _whole(stencils.convex_godunov_step(rows, STATE, lambda v, m: v * (v - 30.0), 15.0, DT, DX), "v_next")


CONVEX = ConvexSpeed(2.0, ((-1.0, 0.2), (0.5, -0.3), (2.0, -1.6)))
_CONVEX = "(0.5e0 * 2e0 * ({v} / 40e0) * ({v} / 40e0) + greatest(-1e0 * ({v} / 40e0) + 0.2e0, 0.5e0 * ({v} / 40e0) + -0.3e0, 2e0 * ({v} / 40e0) + -1.6e0))"


@query(f"""WITH {_FLOW}, f AS (SELECT location, t_index, x_index, speed AS v, {_CONVEX.format(v=f"greatest(speed, {CONVEX.v_c!r}::DOUBLE)")} AS d, {_CONVEX.format(v=f"least(speed, {CONVEX.v_c!r}::DOUBLE)")} AS s FROM flow_field),
    n AS (SELECT *, {_next('s', 'lead')} AS s_r, {_next('d', 'lag')} AS d_l, {_next('v', 'lag')} AS v_l, {_next('v', 'lead')} AS v_r FROM f WINDOW w AS (PARTITION BY location, t_index ORDER BY x_index))
    SELECT location, t_index, x_index, CASE WHEN {_known("v")} THEN {_UMD.format(c="(v - 5e0 / 200e0 * (greatest(d, s_r) - greatest(d_l, s)))")} END AS v_next FROM n""")
def piecewise_speed_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flow_field(spark, sf_dir).select("location", "t_index", "x_index", F.col("speed").alias("v"))
    return _whole(stencils.convex_godunov_step(rows, STATE, CONVEX.flow, CONVEX.v_c, DT, DX), "v_next")


@query(f"WITH {_ARZ_STATE.format(sides=_EDGE)} {_ARZ_OUT.format(ao='greatest(a, a_r)', ai='greatest(a_l, a)')}")
def rusanov_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(stencils.second_order_step(_arz_states(spark, sf_dir), STATE, ARZ, DT, DX), "rho_next", "q_next")


_RAMPED = "CASE x_index WHEN 10 THEN 1.1e0 WHEN 30 THEN 0.9e0 END"
_FACE = "(0.5e0 * (f1_l + f1) - 0.5e0 * greatest(a_l, a) * (rho - rho_l))"


@query(f"""WITH {_ARZ_STATE.format(sides=_EDGE + f", {_RAMPED} AS ratio")},
    o AS (SELECT *, coalesce({_FACE} * ratio, {_FACE}) AS i1, coalesce({_FACE} * ratio * (q_l / greatest(rho_l, 1e-6)), 0.5e0 * (f2_l + f2) - 0.5e0 * greatest(a_l, a) * (q - q_l)) AS i2 FROM n)
    SELECT location, t_index, x_index, CASE WHEN {_known("rho", "q")} THEN floor((rho - 5e0 / 200e0 * ((0.5e0 * (f1 + f1_r) - 0.5e0 * greatest(a, a_r) * (rho_r - rho)) - i1)) * 1e6 + 0.5e0) END AS rho_next,
      CASE WHEN {_known("rho", "q")} THEN floor((q - 5e0 / 200e0 * ((0.5e0 * (f2 + f2_r) - 0.5e0 * greatest(a, a_r) * (q_r - q)) - i2) + 5e0 * src) * 1e6 + 0.5e0) END AS q_next FROM o""")
def ramps_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step with an on-ramp at cell 10 and an off-ramp at cell 30."""
    ramps = spark.createDataFrame([(10, 1.1), (30, 0.9)], "x_index bigint, ratio double")
    return _whole(stencils.second_order_step(_arz_states(spark, sf_dir), STATE, ARZ, DT, DX, ramps=ramps), "rho_next", "q_next")


@query(f"WITH {_ARZ_STATE.format(sides=_EDGE)} {_ARZ_OUT.format(ao='40e0', ai='40e0')}")
def second_order_lax_friedrichs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(stencils.second_order_step(_arz_states(spark, sf_dir), STATE, ARZ, DT, DX, "lax_friedrichs"), "rho_next", "q_next")


_PAIRS = """pr AS (SELECT location, t_index, x_index, rho AS rl, q AS ql, h AS hl, w AS wl, f1 AS fl1, f2 AS fl2, rho_r AS r, q_r AS qr, 30e0 - 30e0 * (1 - rho_r / 0.2e0) AS h, q_r / rho_r AS w, f1_r AS g1, f2_r AS g2 FROM n WHERE nxt IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stencils.Cells(STATE)
    rows = _arz_states(spark, sf_dir)
    return rows.select(
        "location", "t_index", "x_index", F.col("rho").alias("rho_l"), F.col("q").alias("q_l"), F.lead("rho").over(c.by).alias("rho_r"), F.lead("q").over(c.by).alias("q_r"), F.lead("x_index").over(c.by).alias("_next")
    ).where("_next is not null").drop("_next")


@query(f"""WITH {_ARZ_STATE.format(sides=_EDGE + ", lead(x_index) OVER w AS nxt")}, {_PAIRS},
    g AS (SELECT *, w - h AS v, wl - hl AS vl, greatest(abs(wl) + hl, abs(w) + h) AS reach, least(wl - hl - 150e0 * rl, w - h - 150e0 * r) AS lo, greatest(wl - hl, w - h) AS hi,
      rl IS NOT NULL AND r IS NOT NULL AND ql IS NOT NULL AND qr IS NOT NULL AS known FROM pr)
    SELECT location, t_index, x_index, CASE WHEN known THEN {_UMD.format(c="(0.5e0 * (fl1 + g1) - 20e0 * (r - rl))")} END AS lf_rho, CASE WHEN known THEN {_UMD.format(c="(0.5e0 * (fl1 + g1) - 0.5e0 * reach * (r - rl))")} END AS llf_rho,
      CASE WHEN known THEN {_UMD.format(c="(CASE WHEN lo >= 0 THEN fl1 WHEN hi <= 0 THEN g1 ELSE (hi * fl1 - lo * g1 + lo * hi * (r - rl)) / (CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END) END)")} END AS hll_rho,
      CASE WHEN known THEN {_UMD.format(c="(0.5e0 * (fl2 + g2) - 20e0 * (qr - ql))")} END AS lf_q, CASE WHEN known THEN {_UMD.format(c="(0.5e0 * (fl2 + g2) - 0.5e0 * reach * (qr - ql))")} END AS llf_q,
      CASE WHEN known THEN {_UMD.format(c="(CASE WHEN lo >= 0 THEN fl2 WHEN hi <= 0 THEN g2 ELSE (hi * fl2 - lo * g2 + lo * hi * (qr - ql)) / (CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END) END)")} END AS hll_q FROM g""")
def interface_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(stencils.interface_fluxes(_pairs(spark, sf_dir), ARZ, DT, DX), "lf_rho", "llf_rho", "hll_rho", "lf_q", "llf_q", "hll_q")


@query(f"""WITH {_ARZ_STATE.format(sides=_EDGE + ", lead(x_index) OVER w AS nxt")}, {_PAIRS},
    a AS (SELECT *, wl - hl AS vl, w - h AS v, 150e0 * rl AS dl, 150e0 * r AS d, (rl + r) / 2e0 AS m, (ql + qr) / 2e0 AS qm FROM pr),
    b AS (SELECT *, qm / m - (30e0 - 30e0 * (1 - m / 0.2e0)) - 150e0 * m AS s1, v AS s2, r * v - rl * vl AS j1, qr * v - ql * vl AS j2, w + d AS k, vl - dl AS lo, v - d AS hi,
      rl IS NOT NULL AND r IS NOT NULL AND ql IS NOT NULL AND qr IS NOT NULL AS known FROM a),
    c AS (SELECT *, CASE WHEN abs(k - wl) < 1e-9 THEN 0e0 ELSE (j2 - wl * j1) / (k - wl) END AS z, CASE WHEN lo < 0 AND hi > 0 THEN -lo / (hi - lo) WHEN s1 < 0 THEN 1e0 ELSE 0e0 END AS f, CASE WHEN s2 < 0 THEN 1e0 ELSE 0e0 END AS g FROM b)
    SELECT location, t_index, x_index, CASE WHEN known THEN {_UMD.format(c="s1")} END AS s1, CASE WHEN known THEN {_UMD.format(c="s2")} END AS s2,
      CASE WHEN known THEN {_UMD.format(c="(f * (j1 - z) + g * z)")} END AS left_rho, CASE WHEN known THEN {_UMD.format(c="((1 - f) * (j1 - z) + (1 - g) * z)")} END AS right_rho,
      CASE WHEN known THEN {_UMD.format(c="(f * (j2 - z * k) + g * (z * k))")} END AS left_q, CASE WHEN known THEN {_UMD.format(c="((1 - f) * (j2 - z * k) + (1 - g) * (z * k))")} END AS right_q FROM c""")
def riemann_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(stencils.riemann_waves(_pairs(spark, sf_dir), ARZ), "s1", "s2", "left_rho", "right_rho", "left_q", "right_q")


_WENO_ALL = "((A1 * (2 * {0} - 7 * {1} + 11 * {2}) / 6 + A2 * (5 * {2} - {1} + 2 * {3}) / 6 + A3 * (2 * {2} + 5 * {3} - {4}) / 6) / (A1 + A2 + A3))"


def _weno_sql(u: list[str]) -> str:
    w1 = f"(0.1e0 / pow(1e-16 + 13e0 / 12e0 * pow({u[0]} - 2 * {u[1]} + {u[2]}, 2) + 0.25e0 * pow({u[0]} - 4 * {u[1]} + 3 * {u[2]}, 2), 2))"
    w2 = f"(0.6e0 / pow(1e-16 + 13e0 / 12e0 * pow({u[1]} - 2 * {u[2]} + {u[3]}, 2) + 0.25e0 * pow({u[1]} - {u[3]}, 2), 2))"
    w3 = f"(0.3e0 / pow(1e-16 + 13e0 / 12e0 * pow({u[2]} - 2 * {u[3]} + {u[4]}, 2) + 0.25e0 * pow(3 * {u[2]} - 4 * {u[3]} + {u[4]}, 2), 2))"
    return f"floor({_WENO_ALL.format(*u).replace('A1', w1).replace('A2', w2).replace('A3', w3)} * 1e6 + 0.5e0)"


@query(f"""WITH {_FLOW}, n AS (SELECT *, lag(rho, 2) OVER w AS a, lag(rho, 1) OVER w AS b, rho AS c, lead(rho, 1) OVER w AS d, lead(rho, 2) OVER w AS e FROM flow_field WINDOW w AS (PARTITION BY location, t_index ORDER BY x_index))
    SELECT location, t_index, x_index, {_weno_sql(list("abcde"))} AS face_right, {_weno_sql(list("edcba"))} AS face_left FROM n""")
def weno_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(stencils.weno_faces(_states(spark, sf_dir), STATE, "rho"), "face_right", "face_left")


@query(f"""WITH {_FLOW}, y AS (SELECT *, least(greatest(rho / 0.2e0, 1e-6), 1 - 1e-6) AS y FROM flow_field)
    SELECT location, t_index, x_index, CASE WHEN rho IS NOT NULL THEN floor(25e0 * pow(y, 0.2e0) / pow(1 - y, 0.1e0) * 1e5 + 0.5e0) END AS h_e5,
      CASE WHEN rho IS NOT NULL THEN floor(2.5e0 * (2 - y) * pow(y, 0.2e0) / pow(1 - y, 1.1e0) * 1e5 + 0.5e0) END AS rdh_e5,
      CASE WHEN rho IS NOT NULL THEN floor(1.4976e0 * (sqrt(1 + pow(10e0 / 3, 2)) + (sqrt(1 + pow(20e0 / 3, 2)) - sqrt(1 + pow(10e0 / 3, 2))) * y - sqrt(1 + pow(10 * (y - 1e0 / 3), 2))) / y * 1e5 + 0.5e0) END AS v_e5 FROM y""")
def modified_hesitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, r = ModifiedSecondOrder(rho_max=0.2), F.col("rho")
    return _states(spark, sf_dir).select("location", "t_index", "x_index", *[F.when(r.isNotNull(), _milli(c)).alias(n) for n, c in (("h_e5", m.h(r, M)), ("rdh_e5", m.r_dh(r, M)), ("v_e5", m.v_eq(r, M)))])


_PAIRED = """paired AS (SELECT location, a.t_index, (a.v_um - b.v_um) / 1e6 AS gap FROM flow_field a JOIN flow_field b USING (location, x_index)
      WHERE a.t_index = b.t_index + 1 AND x_index BETWEEN 0 AND 44 AND a.v_um IS NOT NULL AND b.v_um IS NOT NULL)"""


@query(f"""WITH {_FLOW}, {_PAIRED}, scored AS (SELECT location, t_index, sum(0.5e0 * (gap * gap / 9e0 + ln(2 * pi() * 9e0))) AS nll, count(*) AS c FROM paired GROUP BY location, t_index)
    SELECT location, floor(avg(nll) * 1e4 + 0.5e0) / 1e4 AS mean_nll, count(*) AS n_steps, CAST(sum(c) AS BIGINT) AS n_cells FROM scored GROUP BY location""")
def step_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean negative log-likelihood of each corridor's speeds under a normal model of the step before: A12 on real states.

    Over the cells known in both steps; n_steps and n_cells say how many pairs of steps and cells that are.
    """
    f = _flow_field(spark, sf_dir).where(F.col("x_index").between(0, CELLS - 1))
    speeds = F.map_from_entries(F.collect_list(F.struct("x_index", F.col("v_um") / 1e6)))
    cells = F.sequence(F.lit(0), F.lit(CELLS - 1)).cast("array<bigint>")
    arrays = f.groupBy(*STATE).agg(speeds.alias("_v")).select(*STATE, F.transform(cells, lambda i: F.try_element_at("_v", i)).alias("v"))
    unit = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda j: F.when(i == j, 9.0).otherwise(0.0)))
    before = arrays.select("location", (F.col("t_index") + 1).alias("t_index"), F.col("v").alias("mean"), unit.alias("covariance"))
    out = metrics.negative_log_likelihood(arrays.withColumnRenamed("v", "values"), before, ["location"])
    return out.select("location", (F.floor(F.col("mean_nll") * 1e4 + 0.5) / 1e4).alias("mean_nll"), "n_steps", "n_cells")

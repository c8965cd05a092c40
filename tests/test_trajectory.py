import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.functions.diagrams import ARRAYS, ConvexSpeed
from tidelane.operators import fields
from tidelane.operators.trajectory import clip, prepare_probe_data, sample_vehicles, thin_out, unique_trips, within, without_last_edge


def test_trips_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for v in ("a", "b", "c"):
        x, trip, before = 0.0, 0, None
        for k in range(200):
            x = 5.0 if rng.random() < 0.06 and x > 150 else x + float(rng.uniform(0, 30))
            trip += before is not None and x - before < -100
            before = x
            rows.append((v, k * 500, x))
            want[v, k * 500] = f"{v}_{trip}"
    df = spark.createDataFrame(rows, "vehicle_id string, ms bigint, x double").withColumn("id", F.col("vehicle_id"))
    for block in (700, 5000, 10**9):
        got = {(r.id, r.ms): r.vehicle_id for r in unique_trips(df, "vehicle_id", ["ms", "x"], "x", 100.0, block).collect()}
        assert got == want
    assert unique_trips(df.limit(0), "vehicle_id", ["ms", "x"], "x", 100.0).count() == 0


def test_limits_sampling_and_thinning(spark):
    rows = [(i, f"v{i % 40}", 0, i * 0.5, float(i), 10.0) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, vehicle_id string, pass_no bigint, time_seconds double, x_meters double, velocity double")
    cut = clip(df, (10.0, 20.0), (6.0, 9.0)).orderBy("event_id").collect()
    assert [(r.x_meters, r.time_seconds) for r in cut] == [(2.0, 0.0), (3.0, 0.5), (4.0, 1.0), (5.0, 1.5), (6.0, 2.0), (7.0, 2.5)]
    some = sample_vehicles(df, 0.4)
    ids = {r.vehicle_id for r in some.collect()}
    assert 5 < len(ids) < 30 and some.count() == 10 * len(ids)
    thin = thin_out(df, 60_000).collect()
    assert all(0 <= r.time_seconds * 1000 - r.window_ms < 60_000 for r in thin) and len({(r.vehicle_id, r.window_ms) for r in thin}) == len(thin)


def test_moving_average_repeats_the_ends(spark):
    values = np.array([4, 9, 2, 7, 7, 1, 30, 5])
    df = spark.createDataFrame([("l", t, 0, int(v)) for t, v in enumerate(values)], "location string, t_index bigint, x_index bigint, v bigint")
    padded = np.pad(values, 2, mode="edge")
    want = [int(np.floor(padded[k : k + 5].mean() + 0.5)) for k in range(len(values))]
    for block in (3, 1000):
        assert [r.smooth_um for r in fields.moving_average(df, "v", 2, block).orderBy("t_index").collect()] == want


def test_strict_window_counts_from_its_first_row_and_refuses_none(spark):
    df = spark.createDataFrame([(float(t), 10.0 * t) for t in range(6)] + [(None, 1.0)], "time_seconds double, x_meters double")
    got = within(df, 1.0, 4.0)
    assert sorted((r.time_seconds, r.x_meters) for r in got.collect()) == [(0.0, 20.0), (1.0, 30.0)]
    assert [(r.time_seconds, r.x_meters) for r in without_last_edge(got).collect()] == [(0.0, 20.0)]
    for start, end in ((1.0, 2.0), (50.0, 60.0)):
        with pytest.raises(ValueError):
            within(df, start, end)
    assert without_last_edge(df.limit(0)).count() == 0


def test_prepared_data_has_a_whole_grid(spark):
    rows = [(10 * v + k, f"v{v}", 0, 5.0 * k, 40.0 * k + v, 8.0, "l") for v in range(40) for k in range(1, 20)]
    df = spark.createDataFrame(rows, "event_id long, vehicle_id string, pass_no long, time_seconds double, x_meters double, velocity double, location string")
    data = prepare_probe_data(df, 0.0, 1e6, 0.3, 0.5, 5.0, 200.0)
    assert data.field.count() == data.steps * data.cells == 18 * 4
    seen = {r.vehicle_id for r in data.observations.where("not is_boundary_information").collect()}
    assert 0 < len(seen) < 40


@pytest.mark.parametrize("q, lines", [(2.0, ((-1.0, 0.2), (0.5, -0.3), (2.0, -1.6))), (0.1, ((-3.0, 1.0), (3.0, -1.0))), (1.0, ((-0.4, 0.0),))])
def test_least_flow_of_a_convex_speed_law(q, lines):
    c = ConvexSpeed(q, lines)
    v = np.linspace(-400, 400, 400_001)
    flow = c.flow(v, ARRAYS)
    assert abs(v[flow.argmin()] - c.v_c) < 3e-3
    with pytest.raises(ValueError):
        ConvexSpeed(0.0, lines)

"""Diagrams, steps, fields and reports against independent computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.functions.diagrams import ARRAYS, COLUMNS, DEFAULTS, FAMILIES, SecondOrder, diagram, greenshields, triangular
from tidelane.operators import fields, metrics, stencils

KEY = ["location", "t_index"]
ARZ = SecondOrder(FAMILIES["greenshields"], 5.0)


def states(spark, n=3, cells=12, seed=0):
    rng = np.random.default_rng(seed)
    rho = rng.uniform(0.01, 0.19, (n, cells))
    v = rng.uniform(5, 25, (n, cells))
    q = ARZ.q(rho, v, ARRAYS)
    rows = [("l", t, x, float(rho[t, x]), float(q[t, x])) for t in range(n) for x in range(cells)]
    return spark.createDataFrame(rows, "location string, t_index bigint, x_index bigint, rho double, q double"), rho, q


def grid_of(df, column, n=3):
    rows = df.select("t_index", "x_index", column).collect()
    out = np.full((n, max(r.x_index for r in rows) + 1), np.nan)
    for r in rows:
        out[r.t_index, r.x_index] = np.nan if r[2] is None else r[2]
    return out


@pytest.mark.parametrize("name", list(FAMILIES))
def test_columns_equal_arrays_and_inverses_invert(spark, name):
    d = diagram(name)
    r = np.linspace(0.002, 0.195, 60)
    df = spark.createDataFrame([(float(x),) for x in r], "r double")
    for formula in (d.flow, d.velocity, d.d_flow, d.d_velocity):
        if formula:
            got = [x[0] for x in df.select(formula(F.col("r"), COLUMNS)).collect()]
            assert np.allclose(got, formula(r, ARRAYS) * np.ones_like(r), rtol=1e-12)
    if d.density and name not in ("zero", "piecewise_quadratic", "other_quadratic_linear"):  # the last two have no exact inverse
        v = np.linspace(0.5, 0.9 * d.v_max, 40)
        inside = d.density(v, ARRAYS)
        assert np.allclose(d.velocity(inside, ARRAYS), v, rtol=1e-6)


def test_named_sets_and_unknown_names():
    assert len(DEFAULTS) == 7
    with pytest.raises(ValueError):
        diagram("none")


def face_values(u, x):
    """A cell and the one after it, end cells repeated, for the interface before cell x."""
    n = len(u)
    return u[max(x - 1, 0)], u[min(x, n - 1)]


def godunov_by_cell(r, d, dt, dx):
    flow, top = (lambda x: float(d.flow(np.float64(x), ARRAYS))), float(d.flow(np.float64(d.rho_c), ARRAYS))
    face = []
    for x in range(len(r) + 1):
        a, b = face_values(r, x)
        face.append(min(flow(a) if a <= d.rho_c else top, top if b <= d.rho_c else flow(b)))
    return np.array([r[x] - dt / dx * (face[x + 1] - face[x]) for x in range(len(r))])


def second_order_by_cell(r, q, dt, dx, solver, ramps=None):
    out = np.zeros((2, len(r) + 1))
    for x in range(len(r) + 1):
        (a, b), (qa, qb) = face_values(r, x), face_values(q, x)
        fa, fb = ARZ.flux(a, qa, ARRAYS), ARZ.flux(b, qb, ARRAYS)
        alpha = max(abs(s) for u in ((a, qa), (b, qb)) for s in ARZ.speeds(*u, ARRAYS)) if solver == "rusanov" else dx / dt
        out[:, x] = [(fa[k] + fb[k]) / 2 - alpha / 2 * (v - u) for k, (u, v) in enumerate(((a, b), (qa, qb)))]
    into = out[:, :-1].copy()
    for x, ratio in (ramps or {}).items():
        into[0, x] = out[0, x] * ratio
        into[1, x] = into[0, x] * (ARZ.v(r[x - 1], q[x - 1], ARRAYS) + ARZ.h(r[x - 1], ARRAYS))
    return r - dt / dx * (out[0, 1:] - into[0]), q - dt / dx * (out[1, 1:] - into[1]) + dt * ARZ.source(r, q, ARRAYS)


def test_steps_equal_numpy_and_conserve_mass(spark):
    df, rho, q = states(spark)
    d = FAMILIES["greenshields"]
    got = grid_of(stencils.godunov_step(df, KEY, d, 5, 200), "rho_next")
    assert all(np.allclose(got[t], godunov_by_cell(rho[t], d, 5, 200), atol=1e-14) for t in range(3))
    ramps = spark.createDataFrame([(4, 1.2), (8, 0.8)], "x_index bigint, ratio double")
    for solver, entries in (("rusanov", None), ("lax_friedrichs", None), ("rusanov", {4: 1.2, 8: 0.8})):
        got = stencils.second_order_step(df, KEY, ARZ, 1.0, 200, solver, ramps=ramps if entries else None)
        for t in range(3):
            r, p = second_order_by_cell(rho[t], q[t], 1.0, 200, solver, entries)
            assert np.allclose(grid_of(got, "rho_next")[t], r, atol=1e-13) and np.allclose(grid_of(got, "q_next")[t], p, atol=1e-12)
    ring = stencils.second_order_step(df, KEY, ARZ, 1.0, 200, wrap=True)
    assert np.allclose(grid_of(ring, "rho_next").sum(1), rho.sum(1))
    with pytest.raises(ValueError):
        stencils.second_order_step(df, KEY, ARZ, 1.0, 200, "upwind")


def test_unknown_cells_make_their_neighbours_unknown_only(spark):
    df, rho, _ = states(spark)
    d = FAMILIES["greenshields"]
    whole = grid_of(stencils.godunov_step(df, KEY, d, 5, 200), "rho_next")
    holed = df.withColumn("rho", F.when(~((F.col("t_index") == 1) & F.col("x_index").isin(0, 6)), F.col("rho")))
    got = grid_of(stencils.godunov_step(holed, KEY, d, 5, 200), "rho_next")
    lost = np.zeros_like(whole, bool)
    lost[1, [0, 1, 5, 6, 7]] = True
    assert np.isnan(got[lost]).all() and np.array_equal(got[~lost], whole[~lost])


def test_jacobian_is_the_derivative_and_affine_form_is_the_step(spark):
    df, rho, _ = states(spark)
    d = greenshields(30, 0.2)
    bands = {c: grid_of(stencils.godunov_jacobian(df, KEY, d, 5, 200), c) for c in ("sub", "diag", "super")}
    numeric = np.stack([(godunov_by_cell(rho[0] + 1e-7 * e, d, 5, 200) - godunov_by_cell(rho[0] - 1e-7 * e, d, 5, 200)) / 2e-7 for e in np.eye(12)], 1)
    assert np.allclose(np.diag(numeric), bands["diag"][0], atol=1e-6)
    assert np.allclose(np.diag(numeric, -1), bands["sub"][0, 1:], atol=1e-6) and np.allclose(np.diag(numeric, 1), bands["super"][0, :-1], atol=1e-6)
    t = triangular(0.1, 1.8, 0.2)
    step = grid_of(stencils.lax_friedrichs_step(df, KEY, t, 5, 200), "rho_next")
    parts = {c: grid_of(stencils.affine_coefficients(df, KEY, t, 5, 200), c) for c in ("sub", "diag", "super", "bias")}
    left, right = np.roll(rho, 1, 1), np.roll(rho, -1, 1)
    got = parts["sub"] * left + parts["diag"] * rho + parts["super"] * right + parts["bias"]
    assert np.allclose(got[:, 1:-1], step[:, 1:-1], atol=1e-14) and np.allclose(got[:, [0, -1]], rho[:, [0, -1]])


def test_weno_is_exact_for_quadratics(spark):
    u = [[0.1 + 0.01 * x + 0.002 * x * x for x in range(12)], [3.0] * 12]
    df = spark.createDataFrame([("l", t, x, u[t][x]) for t in range(2) for x in range(12)], "location string, t_index bigint, x_index bigint, rho double")
    right, left = (grid_of(stencils.weno_faces(df, KEY, "rho"), c, 2) for c in ("face_right", "face_left"))
    face = lambda x: 0.1 + 0.01 * x + 0.002 * (x * x - 1 / 12)  # noqa: E731  cell means of that quadratic
    assert np.allclose(right[0, 2:-2], [face(x + 0.5) for x in range(2, 10)], atol=1e-4) and np.allclose(left[0, 2:-2], [face(x - 0.5) for x in range(2, 10)], atol=1e-4)
    assert np.allclose(right[1, 2:-2], 3.0) and np.isnan(right[:, [0, 1, -2, -1]]).all()


def test_waves_carry_the_jump_and_stand_still_without_one(spark):
    _, rho, q = states(spark, n=2)
    rows = [(i, *map(float, (rho[0, i], q[0, i], rho[1, i], q[1, i]))) for i in range(12)]
    same = (12, 0.05, 0.05 * ARZ.q(1.0, 20.0, ARRAYS), 0.05, 0.05 * ARZ.q(1.0, 20.0, ARRAYS))
    r, w = 0.1, 25.0  # w of the right state equal to the left's plus its own change: the two vectors fall together
    d = float(ARZ.r_dh(np.float64(r), ARRAYS))
    parallel = (13, 0.08, 0.08 * (w + d), r, r * w)
    rows += [same, parallel, (14, None, 1.0, 0.1, 1.0)]
    got = stencils.riemann_waves(spark.createDataFrame(rows, "i int, rho_l double, q_l double, rho_r double, q_r double"), ARZ).orderBy("i").toPandas()
    for row, out in zip(rows[:14], got.itertuples()):
        a, b = ARZ.flux(*row[1:3], ARRAYS), ARZ.flux(*row[3:5], ARRAYS)
        assert np.allclose([out.left_rho + out.right_rho, out.left_q + out.right_q], [b[0] - a[0], b[1] - a[1]], atol=1e-9)
        assert out.s1 <= out.s2 + 20
    assert np.allclose(got.loc[12, ["left_rho", "right_rho", "left_q", "right_q"]].astype(float), 0)
    assert got.loc[14, ["s1", "left_rho", "right_q"]].isna().all()
    slow = got[(got["s1"] > 0) & (got["s2"] > 0) & (got["left_rho"] == 0)]
    assert (slow["left_q"] == 0).all()


def smoothed_by_pairs(rows, dt, dx, s):
    out = {}
    seen = [(t, x, v) for t, x, v in rows if v is not None]
    for t, x, _ in rows:
        mean = []
        for wave in (s.v_cong, s.v_free):
            near = [(max(np.exp(-abs((t - a) * dt - (x - b) * dx / wave) / s.tau - abs(x - b) * dx / s.delta), s.least), v) for a, b, v in seen if abs(t - a) <= s.reach_t and abs(x - b) <= s.reach_x]
            mean.append(sum(w * v for w, v in near) / sum(w for w, _ in near) if near else None)
        if mean[0] is not None:
            w = 0.5 * (1 + np.tanh((s.v_threshold - min(mean)) / s.width))
            out[t, x] = w * mean[0] + (1 - w) * mean[1]
    return out


def test_smoothing_equals_all_pairs_whatever_the_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(t, x, float(rng.integers(1, 30)) if rng.random() < 0.2 and not 30 <= t < 60 else None) for t in range(90) for x in range(7) if rng.random() < 0.95]
    df = spark.createDataFrame([("l", t, x, None if v is None else int(v * 1e6)) for t, x, v in rows], "location string, t_index bigint, x_index bigint, v bigint").withColumn("speed", F.lit("clash"))
    for s in (fields.Smoothing(reach_t=8, reach_x=3), fields.Smoothing(reach_t=100)):
        want = smoothed_by_pairs(rows, 60.0, 200.0, s)
        for block in (10, 256):
            got = {(r.t_index, r.x_index): r.speed for r in fields.adaptive_smoothing(df, 60.0, 200.0, "v", 7, s, block).collect()}
            assert set(got) == {(t, x) for t, x, _ in rows}
            assert all(got[k] is None if k not in want else abs(got[k] - want[k]) < 1e-9 for k in got)
    assert fields.adaptive_smoothing(df.limit(0), 60.0, 200.0, "v", 7).count() == 0


def test_nearest_fill_over_a_wide_gap(spark):
    df = spark.range(3400 * 45).select(F.lit("l").alias("location"), (F.col("id") / 45).cast("long").alias("t_index"), (F.col("id") % 45).alias("x_index"))
    df = df.withColumn("v", F.when((F.col("t_index") < 100) | (F.col("t_index") >= 3300), F.col("t_index") * 100 + F.col("x_index")))
    got = fields.nearest_fill(df, "v").where("t_index in (1000, 1699, 1700, 2500)").collect()
    assert {(r.t_index, r.x_index): r.v for r in got} == {(t, x): (99 if t < 1700 else 3300) * 100 + x for t in (1000, 1699, 1700, 2500) for x in range(45)}


def test_forward_fill_and_nearest_fill_over_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [("l", t, x, int(rng.integers(1, 99)) if rng.random() < 0.08 else None) for t in range(120) for x in range(6)]
    df = spark.createDataFrame(rows, "location string, t_index bigint, x_index bigint, v bigint")
    want, last = {}, {}
    for _, t, x, v in rows:
        last[x] = v if v is not None else last.get(x, 7)
        want[t, x] = last[x]
    assert {(r.t_index, r.x_index): r.v for r in fields.forward_fill(df, "v", 7, block=10).collect()} == want
    known = [(t, x, v) for _, t, x, v in rows if v is not None]
    near = {(t, x): min(((t - a) ** 2 + (x - b) ** 2, a, b, v) for a, b, v in known)[3] for _, t, x, v in rows}
    assert {(r.t_index, r.x_index): r.v for r in fields.nearest_fill(df, "v", block=7).collect()} == near
    none = fields.nearest_fill(df.withColumn("v", F.lit(None).cast("long")), "v", block=9)
    assert none.where("v is not null").count() == 0 and none.count() == len(rows)


def test_metrics(spark):
    steps = spark.createDataFrame([("l", 0, 0, 10_000_000), ("l", 0, 1, 20_000_000), ("l", 1, 0, 30_000_000)], "location string, t_index bigint, x_index bigint, v_um bigint")
    field = spark.createDataFrame([("l", 0, 0, 11_000_000), ("l", 0, 1, 19_000_000), ("l", 1, 0, 29_000_000), ("l", 1, 1, 31_000_000)], "location string, t_index bigint, x_index bigint, field_um bigint")
    assert metrics.root_mean_square(metrics.squared_errors(steps, field), ["location"]).first().rmse_kmh_milli == 3600
    truth = spark.createDataFrame([("l", 0, [1.0, 2.0]), ("l", 1, [0.0, 0.0])], "location string, t_index bigint, values array<double>")
    model = spark.createDataFrame([("l", t, [0.0, 0.0], [[2.0, 0.5], [0.5, 1.0]]) for t in (0, 1)], "location string, t_index bigint, mean array<double>, covariance array<array<double>>")
    cov = np.array([[2.0, 0.5], [0.5, 1.0]])
    each = [0.5 * (np.array(v) @ np.linalg.inv(cov) @ np.array(v) + np.log(np.linalg.det(2 * np.pi * cov))) for v in ([1.0, 2.0], [0.0, 0.0])]
    assert metrics.negative_log_likelihood(truth, model, ["location"]).first().mean_nll == pytest.approx(np.mean(each))
    assert metrics.parameter_sweep(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).count() == 6
    logs = metrics.unlogged(spark.createDataFrame([(0.0, 5)], "log_rho double, n int"))
    assert logs.columns == ["rho", "n"] and logs.first().rho == 1.0


def test_likelihood_counts_steps_with_missing_cells(spark):
    nan = float("nan")
    truth = spark.createDataFrame([("l", 0, [1.0, None]), ("l", 1, [nan, 3.0]), ("l", 2, [None, None]), ("m", 0, [None, 1.0])], "location string, t_index bigint, values array<double>")
    model = spark.createDataFrame([("l", t, [0.0, 1.0], [[2.0, 0.5], [0.5, 1.0]]) for t in range(3)] + [("m", 0, [1.0, None], [[2.0, 0.5], [0.5, 1.0]])], "location string, t_index bigint, mean array<double>, covariance array<array<double>>")
    got = {r.location: r for r in metrics.negative_log_likelihood(truth, model, ["location"]).collect()}
    each = [0.5 * (1.0 / 2.0 + np.log(2 * np.pi * 2.0)), 0.5 * (4.0 / 1.0 + np.log(2 * np.pi * 1.0))]
    assert got["l"].mean_nll == pytest.approx(np.mean(each)) and (got["l"].n_steps, got["l"].n_cells) == (2, 2)
    assert got["m"].mean_nll is None and (got["m"].n_steps, got["m"].n_cells) == (0, 0)


def test_step_likelihood_scores_every_pair_of_steps_with_a_common_cell(spark, small):
    from tidelane.plans import reference

    field = reference._flow_field(spark, small).where("v_um is not null")
    pairs = field.alias("a").join(field.alias("b"), F.expr("a.location = b.location and a.x_index = b.x_index and a.t_index = b.t_index + 1"))
    want = {r.location: (r.s, r.c) for r in pairs.groupBy("a.location").agg(F.count_distinct("a.t_index").alias("s"), F.count("*").alias("c")).collect()}
    assert {r.location: (r.n_steps, r.n_cells) for r in reference.step_likelihood(spark, small).collect()} == want


def test_upsampling_is_linear_between_centres(spark):
    plane = lambda t, x: 2.0 * t + 5.0 * x
    coarse = spark.createDataFrame([("l", t, x, plane(4 * t + 1.5, 2 * x + 0.5)) for t in range(3, 8) for x in range(4)], "location string, t_index bigint, x_index bigint, v double")
    got = {(r.t_index, r.x_index): r.v for r in fields.upsample(coarse, "v", 4, 2).collect()}
    assert set(got) == {(t, x) for t in range(12, 32) for x in range(8)}
    assert all(abs(v - plane(min(max(t, 13.5), 29.5), min(max(x, 0.5), 6.5))) < 1e-9 for (t, x), v in got.items())
    holed = {(r.t_index, r.x_index): r.v for r in fields.upsample(coarse.withColumn("v", F.when(F.col("t_index") != 5, F.col("v"))), "v", 4, 2).collect()}
    assert set(holed) == set(got) and holed[12, 0] == got[12, 0] and holed[21, 0] is not None

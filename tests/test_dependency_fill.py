import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tidelane.operators.dependency_fill import DependencyTree, _guesses, fill_indices, fill_speeds, fit_trees

FLOW = "cell_id bigint, location string, t_index bigint, x_index bigint, speed double, density double, flow double"
STEPS = "obs_id bigint, t_index bigint, vehicle_id string, pass_no bigint, location string, time_seconds double, x_meters double, velocity double, x_index bigint"


def test_tree_and_posterior_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, 3000)
    b = np.where(rng.random(3000) < 0.8, a, rng.integers(0, 3, 3000))
    c = np.where(rng.random(3000) < 0.7, b, rng.integers(0, 3, 3000))
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(a, b, c)], "a long, b long, c long")
    (tree,) = fit_trees(df, {"a": 3, "b": 3, "c": 3})
    assert {frozenset(e) for e in tree.edges} == {frozenset((0, 1)), frozenset((1, 2))}
    got = tree.posterior(np.array([[-1, -1, 2], [-1, 1, 0], [-1, -1, -1]]), 0)
    ab, bc = tree.joint(0, 1) + 0.1, tree.joint(1, 2) + 0.1
    prior = tree.joint(0, 1).sum(1) + 0.1

    def brute(known):
        p = np.zeros(3)
        for i, j, k in itertools.product(range(3), repeat=3):
            if all(known[n] in (-1, s) for n, s in ((1, j), (2, k))):
                p[i] += prior[i] * ab[i, j] / ab[i].sum() * bc[j, k] / bc[j].sum()
        return p / p.sum()

    for row, known in zip(got, ([-1, -1, 2], [-1, 1, 0], [-1, -1, -1])):
        assert np.allclose(row, brute(known))
    assert isinstance(tree, DependencyTree)


def test_speeds_in_every_notation_are_filled_and_standing_is_left(spark):
    rows = [(i, "l", i // 10, i % 10, 10.0 + i % 10, 0.05, 0.05 * (10 + i % 10)) for i in range(400)]
    for k, bad in ((11, None), (22, math.nan), (33, -1.0), (44, 9999.99), (55, 0.0)):
        rows[k] = (*rows[k][:4], bad, *rows[k][5:])
    rows[66] = (66, "l", 6, 6, 0.0, 0.19, 0.0)
    rows += [rows[11], rows[12]]
    df = spark.createDataFrame(rows, FLOW).withColumn("block", F.lit("clash")).withColumn("state", F.lit(1))
    got = {r.row_id: r for r in fill_speeds(df).collect()}
    assert sorted(got) == [11, 22, 33, 44, 55]
    assert all(abs(got[k].value - (10 + k % 10)) <= 1 and got[k].filled for k in got)
    assert fill_speeds(spark.createDataFrame([], FLOW)).count() == 0
    assert [r.value for r in fill_speeds(spark.createDataFrame([(1, None, None, None, None, None, None)], FLOW)).collect()] == [None]


def test_indices_are_filled_from_the_pass(spark):
    rows = [(i, 10 + i, "v", 0, "l", 5.0 * (10 + i) + 2, 100.0 * i + 50, 20.0, (100 * i + 50) // 200) for i in range(60)]
    for k, t in ((5, None), (17, -1), (30, -(2**63))):
        rows[k] = (k, t, "v", 0, "l", None, *rows[k][6:])
    for k, x in ((8, None), (21, 999), (40, -1)):
        rows[k] = (*rows[k][:6], None, 20.0, x)
    rows.append((100, None, None, None, None, None, None, None, None))
    rows.append(rows[5])
    got = {(r.row_id, r.field): r for r in fill_indices(spark.createDataFrame(rows, STEPS)).collect()}
    assert set(got) == {(5, "t_index"), (17, "t_index"), (30, "t_index"), (8, "x_index"), (21, "x_index"), (40, "x_index"), (100, "t_index"), (100, "x_index")}
    for k in (5, 17, 30):
        assert got[k, "t_index"].value == 10 + k
    for k in (8, 21, 40):
        assert abs(got[k, "x_index"].value - (100 * k + 50) // 200) <= 1
    assert not got[100, "t_index"].filled and got[100, "t_index"].value is None
    assert fill_indices(spark.createDataFrame([], STEPS)).count() == 0


def test_nearest_rows_of_a_pass_whatever_the_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"v{rng.integers(3)}" if rng.random() > 0.1 else None, 0, ("t", "x")[rng.integers(2)], float(rng.normal()) if rng.random() > 0.4 else None, float(rng.integers(0, 300)) if rng.random() > 0.1 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "row_id long, vehicle_id string, pass_no long, kind string, y double, s double")
    for width in (7.0, 1e6):
        got = {r.row_id: (r.p and (r.p.s, r.p.y), r.n and (r.n.s, r.n.y)) for r in _guesses(df, {"t": width, "x": width}).collect()}
        for k, v, _, kind, _, s in rows:
            same = [] if v is None or s is None else [(r[5], r[0], r[4]) for r in rows if r[1] == v and r[3] == kind and r[4] is not None and r[5] is not None and r[0] != k]
            low, high = max((r for r in same if r[:2] < (s, k)), default=None), min((r for r in same if r[:2] > (s, k)), default=None)
            assert got[k] == (low and (low[0], low[2]), high and (high[0], high[2]))


def test_far_indices_and_many_locations(spark):
    # times run 100 steps behind the indices, so no index is near the row's own time
    rows = [(i, 100 + i, "v", 0, f"l{i % 300}", 5.0 * i + 2, 100.0 * i + 50, 20.0, i // 2) for i in range(600)]
    rows[40] = (40, None, *rows[40][2:])
    got = fill_indices(spark.createDataFrame(rows, STEPS), cells=1000).collect()
    assert [(r.row_id, r.value) for r in got] == [(40, 140.0)]


def test_blocks_of_steps_don_t_show_in_speeds(spark):
    rows = [(i, "l", i // 10, i % 10, float(5 + (i // 10) % 17), 0.05, None) for i in range(800)]
    rows = [(*r[:4], None, *r[5:]) if r[0] % 7 == 0 else r for r in rows]
    df = spark.createDataFrame(rows, FLOW)
    one = {r.row_id: r.value for r in fill_speeds(df).collect()}
    assert one == {r.row_id: r.value for r in fill_speeds(df, steps_per_block=3).collect()} and len(one) == sum(r[4] is None for r in rows)

import math

import numpy as np
import pytest
from conftest import trajectory_rows

from tidelane.operators.regular_grid import local_polynomial, regular_grid


def rows_of(df):
    return {(r.vehicle_id, r.pass_no, r.t_index): r for r in df.collect()}


def test_straight_motion_is_recovered_and_gaps_are_marked(spark):
    rows = [(i, "a", 0, float(t), 100 + 20.0 * t, 20.0, 1.0, 1.0, 0) for i, t in enumerate([1, 3, 6, 8, 11, 13, 22, 24, 90])]
    got = rows_of(regular_grid(trajectory_rows(spark, rows, extra=True)))
    assert sorted(t for _, _, t in got) == list(range(0, 19))
    assert got["a", 0, 0].status == "observed" and got["a", 0, 3].status == "filled" and got["a", 0, 10].status == "missing"
    assert got["a", 0, 3].x_meters == pytest.approx(100 + 20 * 17.5) and got["a", 0, 10].x_meters is None
    assert got["a", 0, 18].n_usable == 1 and got["a", 0, 3].n_usable == 0


def test_a_long_pass_over_several_blocks_equals_one_block(spark):
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 2000, 300))
    t = t[(t < 300) | (t > 900)]  # a gap over a block's edge
    rows = [(i, "a", 0, float(x), float(x * 3), 3.0, 1.0, 1.0, 0) for i, x in enumerate(t)]
    one = rows_of(regular_grid(trajectory_rows(spark, rows), block_seconds=3600.0))
    cut = rows_of(regular_grid(trajectory_rows(spark, rows), block_seconds=100.0))
    assert one.keys() == cut.keys()
    for k in one:
        assert one[k].status == cut[k].status and one[k].effective_support == pytest.approx(cut[k].effective_support)


def test_nulls_nan_repeats_and_empty(spark):
    rows = [
        (5, "a", 0, 1.0, None, 3.0, 0.0, 0.0, 0), (6, "a", 0, 1.0, 9.0, 3.0, 0.0, 0.0, 0),  # delivered again: the first stands
        (7, "a", 0, 6.0, 5.0, math.nan, 0.0, 0.0, 0), (8, None, None, 7.0, 5.0, 1.0, 0.0, 0.0, 0), (9, "b", 1, None, 5.0, 1.0, 0.0, 0.0, 0),
        (10, "c", None, 7.0, 5.0, 1.0, 0.0, 0.0, 0),
    ]
    got = rows_of(regular_grid(trajectory_rows(spark, rows)))
    assert {k: r.status for k, r in got.items()} == {("a", 0, 0): "missing", ("a", 0, 1): "missing"}
    assert regular_grid(trajectory_rows(spark, [])).count() == 0


def test_polynomial_falls_back_where_times_coincide():
    sums = np.array([[2.0, 0.0], [1.0, 0.0], [0.5, 0.0]])  # two points at u = 0.5; none at all
    got = local_polynomial(sums, np.array([[8.0, 0.0], [4.0, 0.0]]), 1)
    assert got[0] == 4.0 and np.isnan(got[1])


def test_infinite_times_are_left_out(spark):
    rows = [(1, "a", 0, 1.0, 5.0, 2.0, 1.0, 1.0, 0), (2, "a", 0, float("inf"), 6.0, 2.0, 1.0, 1.0, 0), (3, "a", 0, float("-inf"), 6.0, 2.0, 1.0, 1.0, 0), (4, "a", 0, 8.0, 7.0, 2.0, 1.0, 1.0, 0)]
    assert [r.t_index for r in regular_grid(trajectory_rows(spark, rows)).orderBy("t_index").collect()] == [0, 1]

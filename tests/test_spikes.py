import math
import tracemalloc

import numpy as np
from conftest import trajectory_rows

from tidelane.operators.spikes import SpikeRules, filter_groups, implausible_values, kalman_innovations


def drive(n=80, v=lambda i: 20 + 0.3 * math.sin(i * 1.7), sh=lambda i: 40 + 0.4 * math.sin(i * 1.3), vehicle="a", first=0):
    rows, x = [], 0.0
    for i in range(n):
        speed, gap = v(i), sh(i)
        true = speed if speed is not None and not math.isnan(speed) and 0 <= speed < 50 else 20.0
        x += 2 * true
        rows.append([first + i, vehicle, 0, 2.0 * i, x, speed, gap, round(gap / max(true, 0.3), 3) if gap and true > 0.5 else 9999.99, int(x // 200)])
    return rows


def found(spark, rows, extra=False):
    return {(r.event_id, r.field, r.reason) for r in implausible_values(trajectory_rows(spark, [tuple(r) for r in rows], extra)).collect()}


def test_spikes_up_to_three_long_are_found_and_a_new_level_is_not(spark):
    rows = drive()
    for k in (20, 40, 41, 42):
        rows[k][5] = 35.0
    got = found(spark, rows, extra=True)
    assert {(k, "velocity", "spike") for k in (20, 40, 41, 42)} == {g for g in got if g[1] == "velocity"}
    level = drive(sh=lambda i: 40 + 0.4 * math.sin(i) + (25 if i >= 40 else 0))
    assert found(spark, level) == set()


def test_braking_and_standing_are_not_flagged(spark):
    course = [20.0] * 30 + [16, 12, 8, 4, 1, 0, 0, 0, 0, 0, 2, 6, 10, 14, 18] + [20.0] * 30
    rows = drive(len(course), v=lambda i: course[i] + 0.05 * math.sin(i * 2.1) * (course[i] > 0), sh=lambda i: 8 + course[i] + 0.1 * math.sin(i * 1.9))
    assert {g for g in found(spark, rows) if g[1] == "velocity"} == set()


def test_frozen_and_impossible_values_but_no_codes(spark):
    rows = drive()
    for k in range(30, 38):
        rows[k][6] = rows[30][6]
    rows[10][5], rows[11][6], rows[12][7] = -3.0, 6553.5, 655.35
    rows[50][6] = rows[50][7] = 0.0
    rows[60][7] = 9999.99
    rows[5][5], rows[6][5] = None, math.nan
    got = found(spark, rows)
    assert {(k, "space_headway", "frozen") for k in range(31, 38)} <= got
    assert {(10, "velocity", "impossible"), (11, "space_headway", "impossible"), (12, "time_headway", "impossible")} <= got
    assert not any(g[0] in (5, 6, 50, 60) for g in got)


def test_coarse_recorder_may_repeat(spark):
    rows = drive(v=lambda i: float(round(20 + 2 * math.sin(i / 9))))
    assert {g for g in found(spark, rows) if g[1] == "velocity"} == set()


def test_tiny_empty_and_repeated_input(spark):
    assert found(spark, []) == set()
    one = [[1, "a", 0, 1.0, 5.0, -1.0, None, None, None], [2, "a", 0, 1.0, 5.0, 70.0, None, None, None], [3, None, None, 1.0, 5.0, -1.0, None, None, None]]
    assert found(spark, one) == {(1, "velocity", "impossible")}


def test_blocks_don_t_change_the_result(spark):
    rows = drive(400)
    for k in (99, 100, 101, 250):
        rows[k][5] = 35.0
    df = trajectory_rows(spark, [tuple(r) for r in rows])
    one = {(r.event_id, r.field) for r in implausible_values(df).collect()}
    cut = {(r.event_id, r.field) for r in implausible_values(df, block_seconds=200.0).collect()}
    assert one == cut and (250, "velocity") in one


def test_long_and_short_groups_give_what_each_gives_alone_within_little_memory():
    rules, rng = SpikeRules(), np.random.default_rng(1)
    lengths = np.array([3000, *rng.integers(0, 40, 400)])
    group = np.repeat(np.arange(len(lengths)), lengths)
    y = rng.normal(20, 1, len(group)).round(1)
    y[rng.random(len(y)) < 0.05] = np.nan
    wait, fresh = np.full(len(y), 2.0), np.zeros(len(y), bool)
    noise, drift = np.full(len(lengths), 0.5), np.full(len(lengths), 0.1)
    tracemalloc.start()
    (ahead, behind) = filter_groups([y, y], [wait, wait], [fresh, fresh], [noise, noise], [drift, drift], [False, True], group, len(lengths), rules)
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    for k in (0, 1, 7, 100):
        rows = np.flatnonzero(group == k)
        if len(rows):
            args = wait[rows][:, None], fresh[rows][:, None], noise[:1], drift[:1], rules
            for got, want in zip(ahead, kalman_innovations(y[rows][:, None], *args)):
                assert np.array_equal(got[rows], want[:, 0])
            for got, want in zip(behind, kalman_innovations(y[rows][::-1][:, None], *args)):
                assert np.array_equal(got[rows], want[::-1, 0])


def test_innovations_vanish_exactly_where_values_repeat():
    rng = np.random.default_rng(2)
    y = np.repeat(rng.normal(20, 3, 300).round(2), rng.integers(1, 12, 300))
    y[rng.random(len(y)) < 0.1] = np.nan
    column = lambda a: np.asarray(a)[:, None]
    still = kalman_innovations(column(y), column(np.full(len(y), 1.0)), column(np.zeros(len(y), bool)), np.array([0.02]), np.array([0.01]), SpikeRules())[2][:, 0]
    at = np.flatnonzero(~np.isnan(y))
    assert np.array_equal(still[at[1:]] > 0, y[at[1:]] == y[at[:-1]])


def test_frozen_values_don_t_hide_a_spike_after_them(spark):
    rows = drive(120, sh=lambda i: 40 + 8 * math.sin(i / 12))
    for k in range(40, 60):
        rows[k][6] = rows[40][6]
    rows[64][6] = 90.0
    got = found(spark, rows)
    assert {(k, "space_headway", "frozen") for k in range(41, 60)} | {(64, "space_headway", "spike")} == {g for g in got if g[1] == "space_headway"}

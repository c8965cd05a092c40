import itertools
import time

from conftest import trajectory_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelane.llm.stays import collapse_stays, segment


def brute(cells, sizes, penalty, cost):
    """Least cost over all splits of the runs, by trying every one."""
    n, best = len(cells), None
    for cuts in itertools.product((0, 1), repeat=max(n - 1, 0)):
        bounds = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        total = 0.0
        for a, b in zip(bounds, bounds[1:]):
            if any(c != cells[a] for c in cells[a:b:2]) or (b - a) % 2 == 0 or any(abs(c - cells[a]) > 1 for c in cells[a:b]):
                total = None
                break
            total += penalty + sum(cost * s for c, s in zip(cells[a:b], sizes[a:b]) if c != cells[a])
        if total is not None and (best is None or total < best):
            best = total
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 4)), min_size=1, max_size=9))
def test_segments_cost_no_more_than_any_split(runs):
    runs = [r for k, r in enumerate(runs) if k == 0 or r[0] != runs[k - 1][0]]
    cells, sizes = [c for c, _ in runs], [s for _, s in runs]
    cost = 0.0
    for a, b in segment(cells, sizes, 1.0, 0.75):
        assert cells[a] == cells[b]
        cost += 1.0 + sum(0.75 * s for c, s in zip(cells[a : b + 1], sizes[a : b + 1]) if c != cells[a])
    assert abs(cost - brute(cells, sizes, 1.0, 0.75)) < 1e-9


def stays(spark, cells, **options):
    rows = [(100 - i, "a", 0, float(i), 0.0, 1.0, 1.0, 1.0, c) for i, c in enumerate(cells)]
    out = collapse_stays(trajectory_rows(spark, rows, extra=True), **options).orderBy("start_seconds").collect()
    return [(r.space_index, r.n_readings, r.n_disturbed, r.duration_seconds) for r in out]


def test_brief_disturbances_belong_to_the_stay(spark):
    assert stays(spark, [3, 3, 4, 3, 3]) == [(3, 5, 1, 4.0)]
    assert stays(spark, [3, 3, 4, 4, 3, 3]) == [(3, 6, 2, 5.0)]
    assert stays(spark, [3, 3, 4, 4, 4, 3]) == [(3, 2, 0, 1.0), (4, 3, 0, 2.0), (3, 1, 0, 0.0)]
    assert stays(spark, [3, 5, 3]) == [(3, 1, 0, 0.0), (5, 1, 0, 0.0), (3, 1, 0, 0.0)]
    assert stays(spark, [3, 3, 4]) == [(3, 2, 0, 1.0), (4, 1, 0, 0.0)]
    assert stays(spark, [3, None, 3, None, 4, 3]) == [(3, 4, 1, 5.0)]


def test_blocks_don_t_cut_stays(spark):
    cells = [1] * 50 + [2] * 3 + [1] * 40 + [2, 1] * 5 + [3] * 20
    assert stays(spark, cells) == stays(spark, cells, block_seconds=10.0)


def test_repeats_nulls_and_empty(spark):
    rows = [(5, "a", 0, 1.0, 0.0, 1.0, 1.0, 1.0, 7), (4, "a", 0, 1.0, 0.0, 1.0, 1.0, 1.0, 7), (6, "a", 0, 2.0, 0.0, 1.0, 1.0, 1.0, 7), (7, None, None, 3.0, 0.0, 1.0, 1.0, 1.0, 7)]
    got = collapse_stays(trajectory_rows(spark, rows)).collect()
    assert [(r.first_event, r.last_event, r.n_readings) for r in got] == [(4, 6, 2)]
    assert collapse_stays(trajectory_rows(spark, [])).count() == 0
    assert collapse_stays(trajectory_rows(spark, rows).withColumn("space_index", F.lit(None).cast("long"))).count() == 0


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 4)), min_size=1, max_size=25), st.integers(1, 9))
def test_blocks_and_their_ends_give_what_one_block_gives(spark, runs, width):
    cells = [c for c, n in runs for _ in range(n)]
    assert stays(spark, cells) == stays(spark, cells, block_seconds=float(width))


def test_a_long_flickering_recorder_takes_seconds():
    cells = [k % 2 for k in range(300_000)]
    begin = time.time()
    out = segment(cells, [1] * len(cells), 1.0, 0.75)
    assert time.time() - begin < 5 and len(out) == 2

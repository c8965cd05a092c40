"""Runs of (nearly) identical consecutive events, by optimal segmentation (problem 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.grouped import floats, longs, map_sorted_groups
from tidelane.operators.readings import first_deliveries, group_numbers, usable_rows

#: A finished stay (done), or a run that may be part of one with runs of other blocks; opens: no stay goes on before it.
PIECE_SCHEMA = (
    "vehicle_id string, pass_no bigint, space_index bigint, e0 bigint, e1 bigint, n bigint, n_disturbed bigint, t0 double, t1 double, "
    "done boolean, opens boolean"
)
NO_CELL = np.iinfo(np.int64).min


def segment(cells: list[int], sizes: list[int], penalty: float, dissimilarity: float) -> list[tuple[int, int]]:
    """Split runs into segments of least total cost; returns the (first, last) run of each segment.

    A segment costs `penalty`, and each of its events in a cell next to the segment's costs `dissimilarity`.
    A segment begins and ends in its own cell, and its cell stands directly before and after each run of a cell
    next to it. Of equally cheap splits the one with the longer earlier segment is taken.

    From the last run to the first: all ends that a segment from run i + 2 can have are ends of one from run i, each at the same
    additional cost, so only the best of them is kept and every other pruned; one comparison a run is left.
    """
    n = len(cells)
    ahead, end = [0.0] * (n + 2), list(range(n + 2))  # least cost of what follows run i inside and after its segment; its end
    after = 0.0  # least cost of all runs from i + 1 on
    for i in range(n - 1, -1, -1):
        ahead[i] = after
        if i + 2 < n and cells[i + 2] == cells[i] and abs(cells[i + 1] - cells[i]) == 1:
            longer = dissimilarity * sizes[i + 1] + ahead[i + 2]
            if longer <= after:
                ahead[i], end[i] = longer, end[i + 2]
        after = penalty + ahead[i]
    out, i = [], 0
    while i < n:
        out.append((i, end[i]))
        i = end[i] + 1
    return out


def _may_join(cells: np.ndarray, sizes: np.ndarray, limit: float) -> np.ndarray:
    """For each run: may it lie inside a segment of the cell before and after it? Costlier than two boundaries it may not."""
    inside = np.zeros(len(cells), bool)
    if len(cells) < 3:
        return inside
    inside[1:-1] = (cells[2:] == cells[:-2]) & (np.abs(cells[1:-1] - cells[:-2]) == 1) & (sizes[1:-1] <= limit)
    return inside


def _merged(table: pa.Table, group: np.ndarray, cells: np.ndarray, penalty: float, dissimilarity: float, split: bool) -> pa.Table:
    """Stays of the runs (or single readings) of each group; with `split` only between places that no stay spans."""
    sizes, t0, t1, e0, e1 = (table[c].to_numpy() for c in ("n", "t0", "t1", "e0", "e1"))
    new = np.ones(len(cells), bool)  # readings of a run, and runs cut at a block's edge, are one
    new[1:] = (group[1:] != group[:-1]) | (cells[1:] != cells[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(cells)][: len(first)] - 1
    size = np.add.reduceat(sizes, first) if len(first) else sizes[:0]
    cell, owner = cells[first], group[first]
    bounds = np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)] if len(owner) else np.zeros(1, int)
    cell_list, size_list = cell.tolist(), size.tolist()
    inside = _may_join(cell, size, 2 * penalty / dissimilarity)
    a, b, done, opens = [], [], [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        low, high = lo, hi
        if split:  # runs lo and hi - 1 may go on in other blocks; between k and k + 1 nothing spans if neither lies inside
            hard = np.flatnonzero(~inside[lo + 1 : hi - 2] & ~inside[lo + 2 : hi - 1]) + lo + 1 if hi - lo >= 4 else ()
            low, high = (int(hard[0]) + 1, int(hard[-1]) + 1) if len(hard) else (hi, hi)
            for k in (*range(lo, low), *range(high, hi)):
                a.append(k), b.append(k), done.append(False), opens.append(k == high)
        for i, j in segment(cell_list[low:high], size_list[low:high], penalty, dissimilarity):
            a.append(low + i), b.append(low + j), done.append(True), opens.append(False)
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    total = np.r_[0, np.cumsum(size)]
    count = total[b + 1] - total[a]
    length = b - a + 1
    member = np.repeat(a - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum()) if len(a) else a
    which = np.repeat(np.arange(len(a)), length)
    own = np.bincount(which, np.where(cell[member] == cell[a][which], size[member], 0), minlength=len(a)).astype(np.int64)
    at = pa.array(first[a])
    return pa.table(
        {
            "vehicle_id": table["vehicle_id"].take(at), "pass_no": table["pass_no"].take(at), "space_index": cell[a], "e0": e0[first[a]], "e1": e1[last[b]],
            "n": count, "n_disturbed": count - own, "t0": t0[first[a]], "t1": t1[last[b]], "done": pa.array(done, pa.bool_()), "opens": pa.array(opens, pa.bool_()),
        }
    )


def _pieces(table: pa.Table, starts: np.ndarray, penalty: float, dissimilarity: float) -> pa.Table:
    """Finished stays and open runs of each block of a pass, from its readings."""
    time = floats(table, "time_seconds")
    cells = longs(table, "space_index", NO_CELL)
    keep = np.flatnonzero(first_deliveries(starts, time) & (cells != NO_CELL))
    event, at = table["event_id"].to_numpy()[keep], pa.array(keep)
    readings = pa.table(
        {"vehicle_id": table["vehicle_id"].take(at), "pass_no": table["pass_no"].take(at), "n": np.ones(len(keep), np.int64), "t0": time[keep], "t1": time[keep], "e0": event, "e1": event}
    )
    return _merged(readings, group_numbers(starts, table.num_rows)[keep], cells[keep], penalty, dissimilarity, True)


def _joined(table: pa.Table, starts: np.ndarray, penalty: float, dissimilarity: float) -> pa.Table:
    """Stays of open runs that were brought together."""
    return _merged(table, group_numbers(starts, table.num_rows), table["space_index"].to_numpy(), penalty, dissimilarity, False)


def collapse_stays(
    trajectories: DataFrame, penalty: float = 1.0, dissimilarity: float = 0.75, block_seconds: float = 1800.0
) -> DataFrame:
    """One row for each stay of a pass in a cell: its readings, those away from the cell, its start and duration.

    The readings of a pass, in order of time, are split so that the sum of a penalty per stay and a dissimilarity
    per reading in an adjoining cell is least. With 2/3 < dissimilarity/penalty < 1, one or two readings in an
    adjoining cell with the same cell before and after belong to that cell's stay, three are a stay of their own.

    Readings without space_index are left aside, rows without vehicle_id, pass_no or time too. Deliveries of one
    reading are one, with the smallest event_id. A single reading is a stay of duration 0. An empty table gives no
    rows; extra columns are ignored.

    A pass is cut into blocks of time. Within a block, all stays between its first and its last place that no stay can span
    (no run there may lie inside another cell's stay) are final. Only the few runs at a block's ends go on to the
    neighbouring blocks' ends, so a pass is never brought together as a whole; without any such place for hours, as where a
    recorder flickers at every reading, its runs are, and cost one comparison each.
    """
    rows = usable_rows(trajectories, ["space_index"]).withColumn("block", F.floor(F.col("time_seconds") / block_seconds))
    pieces = map_sorted_groups(rows, ["vehicle_id", "pass_no", "block"], ["time_seconds", "event_id"], lambda t, s: _pieces(t, s, penalty, dissimilarity), PIECE_SCHEMA)
    by_pass = Window.partitionBy("vehicle_id", "pass_no").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    open_runs = pieces.where("not done").withColumn("part", F.sum(F.col("opens").cast("long")).over(by_pass))
    joined = map_sorted_groups(open_runs, ["vehicle_id", "pass_no", "part"], ["t0"], lambda t, s: _joined(t, s, penalty, dissimilarity), PIECE_SCHEMA)
    return pieces.where("done").unionByName(joined).select(
        "vehicle_id", "pass_no", "space_index", F.col("e0").alias("first_event"), F.col("e1").alias("last_event"), F.col("n").alias("n_readings"),
        "n_disturbed", F.col("t0").alias("start_seconds"), (F.col("t1") - F.col("t0")).alias("duration_seconds"),
    )

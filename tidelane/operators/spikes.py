"""Implausible spikes, frozen and impossible values, by a Kalman filter per source (problem 4)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.operators.grouped import floats, map_sorted_groups, time_blocks
from tidelane.operators.readings import first_deliveries, group_numbers, usable_rows

KEYS = ["vehicle_id", "pass_no", "block"]
FLAG_SCHEMA = "event_id bigint, vehicle_id string, pass_no bigint, field string, value double, reason string, innovation double"


@dataclass(frozen=True)
class SpikeRules:
    """threshold: standardised innovation from which a reading is withheld, in both directions of time.

    max_spike: readings after which a new level is accepted. min_frozen: readings in a row without any innovation of
    their own that count as frozen; vanishing: the variance, as a share of the measurement's, below which there is none.
    limits: the largest value that can occur on a road; below 0 none can. standing: the headway code.
    """

    threshold: float = 4.0
    max_spike: int = 3
    min_frozen: int = 6
    vanishing: float = 1e-12
    max_velocity: float = 60.0
    max_space_headway: float = 1000.0
    max_time_headway: float = 100.0
    standing: float = 9999.99
    moving: float = 1.0
    repeats: float = 0.2


def group_median(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Lower median of each group, NaN where a group has no value."""
    order = np.lexsort((values, group))
    count = np.bincount(group, minlength=groups)
    at = np.cumsum(count) - count + np.maximum(count - 1, 0) // 2
    found = np.full(groups, np.nan)
    found[count > 0] = values[order][at[count > 0]]
    return found


def kalman_innovations(y: np.ndarray, dt: np.ndarray, fresh: np.ndarray, noise: np.ndarray, drift: np.ndarray, rules: SpikeRules):
    """Level filter over many series side by side; arrays are [time, series], NaN for no reading.

    Returns innovations, their scales, and for how many readings in a row the variance of what is new in the innovations
    has vanished. A reading with |innovation| > threshold * scale doesn't update the level; after max_spike such
    readings in a row the next is taken as the new level. `fresh` marks rows at which a series starts anew. The scale is at
    least the recent innovations', so a changing course widens it. A part 1 - gain of an innovation stays in the next one
    whatever is read; what is new is the rest, and a reading that merely repeats the last has none.
    """
    steps, series = y.shape
    level, spread = np.full(series, np.nan), np.zeros(series)
    withheld, recent, gap = np.zeros(series), np.zeros(series), np.zeros(series)
    remains, still = np.zeros(series), np.zeros(series, np.int64)
    innovations, scales, stills = np.zeros((steps, series)), np.ones((steps, series)), np.zeros((steps, series), np.int32)
    for t in range(steps):
        begun = np.isnan(level) | fresh[t]
        value = y[t]
        gap = gap + dt[t]
        here = ~np.isnan(value)
        start = here & begun
        update = here & ~begun
        expected = spread + drift * np.minimum(gap, 60.0)
        error = np.where(update, value - level, 0.0)
        scale = np.sqrt(np.maximum(expected + noise, recent))
        innovations[t], scales[t] = error, scale
        new = error - remains
        still = np.where(update & (new * new <= rules.vanishing * noise), still + 1, np.where(here | begun, 0, still))
        stills[t] = np.where(here, still, 0)
        far = update & (np.abs(error) > rules.threshold * scale)
        withheld = np.where(far, withheld + 1, np.where(here, 0, withheld))
        anew = start | (far & (withheld > rules.max_spike))
        good = update & ~far
        gain = np.where(good, expected / (expected + noise), 0.0)
        level = np.where(anew, value, np.where(good, level + gain * error, np.where(fresh[t] & ~here, np.nan, level)))
        spread = np.where(anew, noise, np.where(good, (1 - gain) * expected, spread))
        recent = np.where(good, 0.6 * recent + 0.4 * error * error, np.where(start, 0.0, recent))
        withheld = np.where(anew, 0, withheld)
        remains = np.where(anew, 0.0, np.where(update, (1 - gain) * error, remains))
        gap = np.where(anew | good, 0.0, gap)
    return innovations, scales, stills


def filter_groups(y: list[np.ndarray], wait: list[np.ndarray], fresh: list[np.ndarray], noise: list[np.ndarray], drift: list[np.ndarray], backwards: list[bool], group: np.ndarray, groups: int, rules: SpikeRules):
    """kalman_innovations over series of rows in order of group: for each series its innovations, scales and stills by row.

    noise and drift are by group. Groups of like length (within a factor of 4) are laid side by side, so that one long group
    among short ones doesn't take its length times their number.
    """
    length = np.bincount(group, minlength=groups)
    begin = np.cumsum(length) - length
    row = np.arange(len(group)) - begin[group]
    place = [length[group] - 1 - row if b else row for b in backwards]
    out = [(np.zeros(len(group)), np.ones(len(group)), np.zeros(len(group), np.int32)) for _ in y]
    kind = np.frexp(length)[1] // 2
    for k in np.unique(kind[length > 0]):
        members = np.flatnonzero((kind == k) & (length > 0))
        at = np.flatnonzero(kind[group] == k)
        column, deep = np.searchsorted(members, group[at]), int(length[members].max())

        def laid(columns: list[np.ndarray], empty: float | bool) -> np.ndarray:
            grid = np.full((deep, len(columns), len(members)), empty)
            for n, c in enumerate(columns):
                grid[place[n][at], n, column] = c[at]
            return grid.reshape(deep, -1)

        got = kalman_innovations(laid(y, np.nan), laid(wait, 0.0), laid(fresh, False), np.concatenate([n[members] for n in noise]), np.concatenate([d[members] for d in drift]), rules)
        for n in range(len(y)):
            for into, grid in zip(out[n], got):
                into[at] = grid.reshape(deep, len(y), -1)[place[n][at], n, column]
    return out


def coarse_step(value: np.ndarray, group: np.ndarray, groups: int, unit: float) -> np.ndarray:
    """The step of recorders that report (almost) only multiples of 100 units, else 0."""
    known = ~np.isnan(value)
    step = 100 * unit
    on_step = known & (np.abs(value / step - np.round(value / step)) < 1e-6)
    total = np.bincount(group[known], minlength=groups)
    return np.where((total > 0) & (np.bincount(group[on_step], minlength=groups) >= 0.9 * total), step, 0.0)


def source_noise(y: np.ndarray, time: np.ndarray, group: np.ndarray, groups: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each series' measurement variance and drift per second, from medians that spikes don't move."""
    at = np.flatnonzero(~np.isnan(y))
    v, t, g = y[at], time[at], group[at]
    noise, drift = np.full(groups, np.nan), np.full(groups, np.nan)
    if len(at) > 1:
        same = g[1:] == g[:-1]
        rate = np.diff(v) ** 2 / np.maximum(np.diff(t), 0.1)
        drift = group_median(rate[same], g[1:][same], groups) / 0.455
    if len(at) > 2:
        same = g[2:] == g[:-2]
        part = np.diff(t)[:-1] / np.maximum(t[2:] - t[:-2], 1e-9)
        bend = np.abs(v[1:-1] - (v[:-2] * (1 - part) + v[2:] * part))
        noise = (group_median(bend[same], g[1:-1][same], groups) * 1.4826 / 1.22) ** 2
    noise = np.where(np.isnan(noise), 4 * floor**2, noise)
    drift = np.where(np.isnan(drift), floor**2, drift)
    return np.maximum(noise, floor**2), np.maximum(drift, floor**2 / 4)


def frozen(still: np.ndarray, value: np.ndarray, group: np.ndarray, time: np.ndarray, x: np.ndarray, v: np.ndarray, rules: SpikeRules, unit: float) -> np.ndarray:
    """Rows of a moving vehicle in a long stretch of vanished innovations, unless they vanish so for its recorder anyway.

    still: for how many readings they have, at each row; the reading before the first of these opens the stretch.
    """
    found = np.zeros(len(value), bool)
    at = np.flatnonzero(~np.isnan(value))
    if len(at) < rules.min_frozen:
        return found
    y, g = value[at], group[at]
    new = still[at] == 0
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(at)])
    long = np.repeat(length >= rules.min_frozen, length)
    if not long.any():
        return found
    groups = int(group.max()) + 1
    total = lambda m: np.bincount(g, m, minlength=groups)
    outside = total(~long)
    repeats = total(~new & ~long) / np.maximum(outside, 1)
    coarse_value = np.abs(y / (10 * unit) - np.round(y / (10 * unit))) < 1e-6
    coarse = (repeats > rules.repeats) | ((total(coarse_value & ~long) >= 0.9 * outside) & (outside > 0)) | (outside == 0)
    for a, n in zip(first[length >= rules.min_frozen], length[length >= rules.min_frozen]):
        if coarse[g[a]]:
            continue
        rows = at[a : a + n]
        known = rows[~np.isnan(x[rows])]
        if len(known) > 1 and time[known[-1]] > time[known[0]]:
            speed = (x[known[-1]] - x[known[0]]) / (time[known[-1]] - time[known[0]])
        else:
            speed = np.median(v[rows][~np.isnan(v[rows])]) if (~np.isnan(v[rows])).any() else 0.0
        found[rows[1:]] = speed > rules.moving
    return found


def _flags(table: pa.Table, starts: np.ndarray, rules: SpikeRules) -> pa.Table:
    time = floats(table, "time_seconds")
    keep = np.flatnonzero(first_deliveries(starts, time))
    group = group_numbers(starts, table.num_rows)[keep]
    time, groups = time[keep], len(starts)
    x, v, sh, th = (floats(table, c)[keep] for c in ("x_meters", "velocity", "space_headway", "time_headway"))
    own = table["own"].to_numpy(zero_copy_only=False)[keep]
    event = table["event_id"].to_numpy()[keep]

    alone = (sh == 0) & (th == 0)
    standing = np.abs(th - rules.standing) < 0.005
    raw = {"velocity": v, "space_headway": np.where(alone, np.nan, sh), "time_headway": np.where(alone | standing, np.nan, th)}
    limit = {"velocity": rules.max_velocity, "space_headway": rules.max_space_headway, "time_headway": rules.max_time_headway}
    impossible = {f: (y < 0) | (y > limit[f]) for f, y in raw.items()}
    fine = {f: np.where(impossible[f], np.nan, y) for f, y in raw.items()}
    v, sh, th = fine["velocity"], fine["space_headway"], fine["time_headway"]

    # Scales on which each field scatters evenly; a standing vehicle's time headway is infinite, so its inverse is 0.
    log = lambda y: np.log(np.maximum(y, 0.05))
    inverse = lambda y: 1 / (np.maximum(y, 0) + 0.5)
    with np.errstate(invalid="ignore", divide="ignore"):
        speed = np.maximum(v, 0.3)
        before, after = np.r_[0, np.arange(len(x) - 1)], np.r_[np.arange(1, len(x)), len(x) - 1]
        inner = (group[before] == group) & (group[after] == group) & (time[after] > time[before])
        travelled = np.where(inner, (x[after] - x[before]) / np.where(inner, time[after] - time[before], 1), np.nan)
        series = {
            "velocity": (v, travelled, 0.15),
            "space_headway": (log(sh), log(th * speed), 0.02),
            "time_headway": (np.where(standing, 0.0, inverse(th)), inverse(sh / speed), 0.012),
        }

    names, length = list(series), np.bincount(group, minlength=groups)
    begin = np.cumsum(length) - length
    wait = np.diff(time, prepend=time[:1])
    wait[begin[length > 0]] = 0
    wait_back = np.r_[wait[1:], 0.0]
    wait_back[(begin + length - 1)[length > 0]] = 0

    unit = {f: 0.001 if f == "time_headway" else 0.01 for f in names}
    noise = []
    for f in names:
        y, _, floor = series[f]
        step = coarse_step(fine[f], group, groups, unit[f])
        if f != "velocity":  # a step of the value, on the scale of its logarithm or inverse
            known = ~np.isnan(fine[f])
            step = step / np.maximum(np.nan_to_num(group_median(fine[f][known], group[known], groups), nan=1.0), 1.0)
        noise.append(source_noise(y, time, group, groups, np.maximum(floor, 0.5 * step)))
    fresh = [np.zeros(len(time), bool), alone, alone]
    spread, drift = [n for n, _ in noise], [d for _, d in noise]
    ways, y = [False] * 3 + [True] * 3, [series[f][0] for f in names]
    found_by = filter_groups(y * 2, [wait] * 3 + [wait_back] * 3, fresh * 2, spread * 2, drift * 2, ways, group, groups, rules)
    stuck = {f: frozen(found_by[k][2], fine[f], group, time, x, fine["velocity"], rules, unit[f]) for k, f in enumerate(names)}
    # Frozen readings tell nothing, so they are withheld, too: groups that have any are filtered anew, the others not.
    again = np.unique(group[np.logical_or.reduce([stuck[f] for f in names])])
    rows = np.flatnonzero(np.isin(group, again))
    told = [np.where(stuck[f], np.nan, v)[rows] for f, v in zip(names, y)]
    anew = filter_groups(
        told * 2, [wait[rows]] * 3 + [wait_back[rows]] * 3, [f[rows] for f in fresh] * 2, [n[again] for n in spread] * 2, [d[again] for d in drift] * 2,
        ways, np.searchsorted(again, group[rows]), len(again), rules,
    )
    for old, new in zip(found_by, anew):
        old[0][rows], old[1][rows] = new[0], new[1]

    found = []
    for k, field in enumerate(names):
        (ahead, scale, _), (behind, scale_behind, _) = found_by[k], found_by[k + 3]
        z = np.where(np.sign(ahead) == np.sign(behind), np.minimum(np.abs(ahead) / scale, np.abs(behind) / scale_behind), 0.0)
        # What another field says of the same reading: where it agrees, the vehicle did do that.
        y, other, _ = series[field]
        confirmed = np.abs(y - other) < 0.4 * np.minimum(np.abs(ahead), np.abs(behind))
        if field == "space_headway":  # closing up on the vehicle ahead while standing
            confirmed |= (standing | (v <= rules.moving)) & (ahead < 0)
        spike = (z > rules.threshold) & ~confirmed & ~np.isnan(fine[field]) & ~stuck[field]
        reason = np.where(impossible[field], "impossible", np.where(stuck[field], "frozen", "spike"))
        rows = np.flatnonzero(own & (impossible[field] | spike | stuck[field]))
        at = pa.array(keep[rows])
        found.append(
            pa.table(
                {
                    "event_id": event[rows], "vehicle_id": table["vehicle_id"].take(at), "pass_no": table["pass_no"].take(at),
                    "field": pa.array([field] * len(rows), pa.string()), "value": raw[field][rows], "reason": pa.array(reason[rows].tolist(), pa.string()), "innovation": z[rows],
                }
            )
        )
    return pa.concat_tables(found).combine_chunks()


def implausible_values(
    trajectories: DataFrame, rules: SpikeRules = SpikeRules(), block_seconds: float = 3600.0, context: float = 300.0
) -> DataFrame:
    """One row for each reading and field (velocity, space_headway, time_headway) that is not what the vehicle did.

    Per pass of a vehicle, a Kalman filter follows each field forwards and backwards, with noise and drift from
    that pass' own readings. reason `spike`: the innovation exceeds the threshold, to the same side, seen from
    before and from after, and no other field of the reading bears it out; `frozen`: the variance of what is new in the
    innovations vanishes over min_frozen readings of a moving vehicle whose recorder doesn't otherwise repeat values;
    `impossible`: negative or beyond what occurs on a road, which no state of the model gives. Flagged values don't
    update the filter by which spikes are found: frozen ones are found first, and withheld when it runs again.

    Headway codes (both 0; standing), null and NaN are never flagged. Rows without vehicle_id, pass_no or time are
    left out; deliveries of one reading are one, with the values and id of the smallest event_id. A pass of one or
    two readings can only have impossible values; an empty table gives no rows; extra columns are ignored.

    Passes are cut into time blocks with `context` seconds around them, so a long pass is spread over tasks.
    """
    rows = usable_rows(trajectories, ["x_meters", "velocity", "space_headway", "time_headway"])
    blocks = time_blocks(rows, F.col("time_seconds"), block_seconds, context, "block", "own")
    return map_sorted_groups(blocks, KEYS, ["time_seconds", "event_id"], lambda t, s: _flags(t, s, rules), FLAG_SCHEMA)

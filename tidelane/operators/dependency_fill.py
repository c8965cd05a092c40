"""Missing values from similar records by a Chow-Liu dependency tree (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.grouped import time_blocks
from tidelane.session import cut_lineage


@dataclass
class DependencyTree:
    """A tree over discrete fields. tables[i, j] is the joint count of field i (rows) and j, with i < j."""

    fields: list[str]
    states: list[int]
    tables: dict[tuple[int, int], np.ndarray]
    edges: list[tuple[int, int]]

    def joint(self, i: int, j: int) -> np.ndarray:
        return self.tables[i, j] if i < j else self.tables[j, i].T

    def posterior(self, codes: np.ndarray, target: int) -> np.ndarray:
        """P(target | the known fields) for each row; codes are [rows, fields], -1 where missing.

        Messages pass from the leaves towards the target: a known field sends the column of its conditional
        table, a missing one sums it over what its own neighbours sent.
        """
        near: dict[int, list[int]] = {k: [] for k in range(len(self.fields))}
        for i, j in self.edges:
            near[i].append(j)
            near[j].append(i)

        def message(child: int, parent: int) -> np.ndarray:
            joint = self.joint(parent, child) + 0.1
            given = joint / joint.sum(1, keepdims=True)  # P(child | parent)
            belief = np.ones((len(codes), self.states[child]))
            for k in near[child]:
                if k != parent:
                    belief *= message(k, child)
            known = codes[:, child] >= 0
            out = np.empty((len(codes), self.states[parent]))
            out[known] = given[:, codes[known, child]].T
            out[~known] = belief[~known] @ given.T
            # What lies behind a known field says nothing more about its parent.
            return out / out.sum(1, keepdims=True)

        any_pair = max((k for k in self.tables if target in k), key=lambda k: self.tables[k].sum(), default=None)  # that which most rows know
        prior = np.ones(self.states[target]) if any_pair is None else self.joint(target, any_pair[0] + any_pair[1] - target).sum(1) + 0.1
        belief = np.tile(prior / prior.sum(), (len(codes), 1))
        for k in near[target]:
            belief *= message(k, target)
        return belief / belief.sum(1, keepdims=True)


#: The number of states of a code column, or the ascending cuts between the states of a column of values.
Field = int | list[float]


def _codes(batch: pa.RecordBatch, name: str, field: Field) -> np.ndarray:
    """States of a column, -1 for missing."""
    if isinstance(field, int):
        return pa.compute.fill_null(batch[name], -1).to_numpy(zero_copy_only=False).astype(np.int64)
    value = pa.compute.fill_null(batch[name].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    return np.where(np.isnan(value), -1, np.searchsorted(np.array(field, float), value, "right"))


def _states(field: Field) -> int:
    return field if isinstance(field, int) else len(field) + 1


def fit_trees(rows: DataFrame, fields: dict[str, Field], group: str | None = None, groups: int = 1) -> list[DependencyTree]:
    """The spanning tree of most mutual information over coded fields, for each group.

    group: a column 0 .. groups - 1. All rows count, for each pair those in which both are known. Every task adds up its
    own tables; what reaches the driver is groups * sum(states_i * states_j) numbers at most, whatever the input.
    """
    names, states = list(fields), [_states(f) for f in fields.values()]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {p: np.zeros(groups * states[p[0]] * states[p[1]], np.int64) for p in pairs}
        for batch in batches:
            codes = [_codes(batch, n, f) for n, f in fields.items()]
            g = batch[group].to_numpy(zero_copy_only=False).astype(np.int64) if group else np.zeros(batch.num_rows, np.int64)
            for i, j in pairs:
                both = (codes[i] >= 0) & (codes[j] >= 0)
                total[i, j] += np.bincount((g[both] * states[i] + codes[i][both]) * states[j] + codes[j][both], minlength=len(total[i, j]))
        for k, p in enumerate(pairs):
            cells = np.flatnonzero(total[p])
            if len(cells):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k)), pa.array(cells), pa.array(total[p][cells])], names=["pair", "cell", "n"])

    columns = names + [group] if group else names
    counts = rows.select(*columns).mapInArrow(count, "pair bigint, cell bigint, n bigint").groupBy("pair", "cell").agg(F.sum("n").alias("n")).toPandas()
    all_tables = []
    for k, (i, j) in enumerate(pairs):
        table, own = np.zeros(groups * states[i] * states[j]), counts[counts["pair"] == k]
        table[own["cell"].to_numpy(np.int64)] = own["n"].to_numpy()
        all_tables.append(table.reshape(groups, states[i], states[j]))
    return [_spanning_tree(names, states, {p: t[g] for p, t in zip(pairs, all_tables)}) for g in range(groups)]


def _spanning_tree(names: list[str], states: list[int], tables: dict[tuple[int, int], np.ndarray]) -> DependencyTree:
    weight = {}
    for pair, table in tables.items():
        joint = table / max(table.sum(), 1)
        product = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight[pair] = float(np.where(joint > 0, joint * np.log(joint / product), 0).sum())
    edges, inside = [], {0}
    while len(inside) < len(names):  # greatest spanning tree; ties by field order
        best = max(((weight[min(i, j), max(i, j)], -i, -j) for i in inside for j in range(len(names)) if j not in inside), default=None)
        edges.append((-best[1], -best[2]))
        inside.add(-best[2])
    return DependencyTree(names, states, tables, edges)


def fill_states(rows: DataFrame, fields: dict[str, Field], trees: list[DependencyTree], target: str, keep: list[str], group: str | None = None) -> DataFrame:
    """For rows whose target is missing: its likeliest state and that state's probability, beside columns `keep`."""
    at = list(fields).index(target)
    kept = rows.where(F.coalesce(F.col(target), F.lit(-1)) < 0).select(*dict.fromkeys([*keep, *([group] if group else []), *fields]))
    types = ", ".join(f"`{n}` {t}" for n, t in kept.select(*keep).dtypes)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.stack([_codes(batch, n, f) for n, f in fields.items()], axis=1)
            g = batch[group].to_numpy(zero_copy_only=False) if group else np.zeros(batch.num_rows, np.int64)
            state, sure = np.zeros(len(codes), np.int64), np.zeros(len(codes))
            for k, tree in enumerate(trees):
                own = g == k
                if own.any():
                    belief = tree.posterior(codes[own], at)
                    state[own], sure[own] = belief.argmax(1), belief.max(1)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keep], pa.array(state), pa.array(sure)], names=[*keep, "state", "probability"])

    return kept.mapInArrow(fill, f"{types}, state bigint, probability double")


def _number(column: str) -> Column:
    return F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))


def _bin(value: Column, states: int) -> Column:
    """Whole units, 0 .. states - 1, the ends open; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(states - 1))).cast("long")


def _quantiles(rows: DataFrame, columns: list[str], n: int = 24) -> dict[str, list[float]]:
    """Ascending cuts between about equally many values of each column, from all rows."""
    shares = [k / n for k in range(1, n)]
    found = rows.agg(*[F.percentile_approx(c, shares, 1000).alias(c) for c in columns]).first()
    return {name: sorted(set(found[name] or [])) for name in columns}


#: Labels that are states of their own, the most frequent first; any others share one more state.
MOST_LABELS = 255


def _labels(rows: DataFrame, column: str) -> list[str]:
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).count()
    return [r[0] for r in counts.orderBy(F.desc("count"), column).limit(MOST_LABELS).collect()]


def _label(column: str, known: list[str]) -> Column:
    codes = F.create_map(*[F.lit(x) for k, name in enumerate(known) for x in (name, k)]) if known else F.create_map(F.lit(""), F.lit(0))
    return F.when(F.col(column).isNotNull(), F.coalesce(F.try_element_at(codes, F.col(column)), F.lit(len(known)))).cast("long")


def _medians(coded: DataFrame, code: str, value: str) -> Column | None:
    """The median of the values of each state, as a map Column; None if nothing is known."""
    rows = coded.where(F.col(code).isNotNull()).groupBy(code).agg(F.percentile_approx(value, 0.5).alias("m")).collect()
    return F.create_map(*[F.lit(x) for r in rows for x in (int(r[code]), float(r["m"]))]) if rows else None


def fill_speeds(flow_data: DataFrame, max_speed: float = 60.0, steps_per_block: int = 1440) -> DataFrame:
    """Every missing speed of flow_data, filled from records of the same location, cell and time.

    Missing: null, NaN, negative or beyond max_speed, 0 while the row's own flow is not, more than walking pace
    while it is 0. Speed (by metre per second), density, flow, flow per density (by quantiles), the speeds a step before and
    after in the cell, location and cell are coded; the tree gives the likeliest speed bin, whose median is the value. filled
    is always true: a record without any known field gets the commonest bin. If no speed at all is known, value is null.

    Duplicate rows (same cell_id) are one; a null cell_id is kept as its own row. Empty tables give no rows; extra
    columns are ignored. A cell of a location is cut into blocks of time with a step of context, so no task holds a whole
    location and the blocks don't show in the result.
    """
    s, q, k = _number("speed"), _number("flow"), _number("density")
    missing = s.isNull() | (s < 0) | (s > max_speed) | ((s == 0) & (q > 0)) | ((s > 1.5) & (q == 0))
    rows = flow_data.select(
        F.col("cell_id").alias("row_id"), "location", "t_index", "x_index",
        F.when(~F.coalesce(missing, F.lit(False)), s).alias("speed"), q.alias("flow"), k.alias("density"),
    )
    rows = rows.withColumn("ratio", F.try_divide("flow", "density")).withColumn("cell", F.col("x_index").cast("double"))
    cuts = _quantiles(rows, ["density", "flow", "ratio", "cell"], 64)
    known, speeds = _labels(rows, "location"), int(max_speed) + 1
    blocks = time_blocks(rows, F.coalesce("t_index", F.lit(0)), steps_per_block, 1, "block", "own")
    near = Window.partitionBy("location", "x_index", "block").orderBy("t_index", "row_id")
    blocks = blocks.withColumn("again", F.coalesce(F.lag("row_id").over(near) == F.col("row_id"), F.lit(False))).where("not again")
    beside = lambda f, step: F.when(f("t_index").over(near) == F.col("t_index") + step, f("speed").over(near))
    coded = cut_lineage(
        blocks.withColumn("before", beside(F.lag, -1)).withColumn("after", beside(F.lead, 1)).where("own").select(
            "row_id", "speed", _bin(F.col("speed"), speeds).alias("c_speed"), "ratio", "density", "flow",
            _bin(F.col("before"), speeds).alias("c_before"), _bin(F.col("after"), speeds).alias("c_after"), _label("location", known).alias("c_location"), "cell",
        )
    )
    fields = {"c_speed": speeds, "ratio": cuts["ratio"], "density": cuts["density"], "flow": cuts["flow"], "c_before": speeds, "c_after": speeds, "c_location": len(known) + 1, "cell": cuts["cell"]}
    trees = fit_trees(coded, fields)
    decode = _medians(coded, "c_speed", "speed")
    value = F.lit(None).cast("double") if decode is None else F.try_element_at(decode, F.col("state").cast("int"))
    return fill_states(coded, fields, trees, "c_speed", ["row_id"]).select(
        F.lit("flow_data").alias("table_name"), "row_id", F.lit("speed").alias("field"), value.alias("value"), F.lit(True).alias("filled"), "probability"
    )


#: Distances up to NEAR steps are states of their own, farther ones share a state with others up to twice as far.
NEAR, FAR = 8, 24
OFFSETS = 2 * (NEAR + FAR) + 1


def _offset(d: Column) -> Column:
    """The state of a distance in whole steps, to either side."""
    m = F.abs(d)
    far = NEAR + 1 + F.least(F.greatest(F.floor(F.log2(m.cast("double"))) - 3, F.lit(0)), F.lit(FAR - 1))
    return (NEAR + FAR + F.when(m <= NEAR, d).otherwise(F.signum(d.cast("double")) * far)).cast("long")


def _guesses(rows: DataFrame, blocks: dict[str, float]) -> DataFrame:
    """y and s of the nearest other rows of the same pass and kind with a lower (p) and a higher (n) s that know y.

    A pass is cut into blocks of s; what lies beyond a block's ends is carried over the blocks, of which only one row each
    is brought together by pass. Rows without pass or s have neither, and no part in the windows. Of repeated rows (same
    row_id, pass and s) one is kept.
    """
    placed = F.col("vehicle_id").isNotNull() & F.col("pass_no").isNotNull() & F.col("s").isNotNull()
    width = F.when(F.col("kind") == "t", F.lit(blocks["t"])).otherwise(F.lit(blocks["x"]))
    key, by_block = ["vehicle_id", "pass_no", "kind"], ["vehicle_id", "pass_no", "kind", "_b"]
    inside = rows.where(placed).withColumn("_b", F.floor(F.col("s") / width))
    known = F.when(F.col("y").isNotNull(), F.struct("y", "s"))
    sorted_up = Window.partitionBy(*by_block).orderBy(F.col("s").asc(), F.col("row_id").asc())
    again = F.coalesce(F.lag("row_id").over(sorted_up) == F.col("row_id"), F.lit(False))
    inside = inside.withColumn("_again", again).where("not _again").drop("_again")
    up = sorted_up.rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by_block).orderBy(F.col("s").desc(), F.col("row_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("p", F.last(known, ignorenulls=True).over(up)).withColumn("n", F.last(known, ignorenulls=True).over(down))
    order = F.when(F.col("y").isNotNull(), F.struct("s", "row_id"))
    ends = inside.groupBy(*by_block).agg(F.min_by(known, order).alias("_first"), F.max_by(known, order).alias("_last"))
    over = Window.partitionBy(*key)
    before, after = (over.orderBy(b).rowsBetween(Window.unboundedPreceding, -1) for b in (F.col("_b").asc(), F.col("_b").desc()))
    ends = ends.select(*by_block, F.last("_last", ignorenulls=True).over(before).alias("_p"), F.last("_first", ignorenulls=True).over(after).alias("_n"))
    met = inside.join(ends, by_block).withColumn("p", F.coalesce("p", "_p")).withColumn("n", F.coalesce("n", "_n")).drop("_b", "_p", "_n")
    none = F.lit(None).cast("struct<y: double, s: double>")
    alone = F.when(F.col("row_id").isNull(), F.monotonically_increasing_id())  # rows without id are all kept
    others = rows.where(~F.coalesce(placed, F.lit(False))).withColumn("_alone", alone).dropDuplicates(["row_id", "kind", "_alone"]).drop("_alone")
    return met.unionByName(others.withColumn("p", none).withColumn("n", none))


def fill_indices(discretized: DataFrame, cells: int = 45, step: float = 5.0, cell_metres: float = 200.0) -> DataFrame:
    """Every missing t_index and x_index of discretized_trajectories, filled from the pass and the row itself.

    Missing: null, negative, or an x_index of no cell. The index is coded by its distance from where the row's own time (or
    position) would put it or, where that is unknown, from where the nearest rows of the pass do, times by position and
    positions by time. Coded fields beside it: the distance between the two, which of them it counts from and the place
    inside the step, the width of the gap, speed and location. Rows that know their own time count twice in the tree, with and
    without it. The tree gives the likeliest distance, far ones as the median of their bin; a row with neither time nor
    neighbours is listed with filled = false and a null value.

    Duplicate rows (same obs_id) are one; rows without obs_id are kept; those without vehicle or pass have no neighbours.
    Empty tables give no rows; extra columns are ignored. Passes of any length are cut into blocks.
    """
    rows = discretized.select("obs_id", "t_index", "x_index", "vehicle_id", "pass_no", "location", _number("time_seconds").alias("time"), _number("x_meters").alias("x"), _number("velocity").alias("v"))
    t_known = F.when(F.col("t_index") >= 0, F.col("t_index"))
    x_known = F.when((F.col("x_index") >= 0) & (F.col("x_index") < cells), F.col("x_index"))
    at, place = F.coalesce("time", (t_known + 0.5) * step), F.coalesce("x", (x_known + 0.5) * cell_metres)
    record = lambda kind, known, own, width, y, s: F.struct(F.lit(kind).alias("kind"), known.alias("known"), F.floor(F.col(own) / width).alias("own"), F.lit(width).alias("width"), y.alias("y"), s.alias("s"))
    both = F.array(record("t", t_known, "time", step, at, place), record("x", x_known, "x", cell_metres, place, at))
    stacked = rows.select(F.col("obs_id").alias("row_id"), "vehicle_id", "pass_no", "location", "v", F.explode(both).alias("r")).select("row_id", "vehicle_id", "pass_no", "location", "v", "r.*")
    found = _guesses(stacked, {"t": 1000.0, "x": 3600.0})
    p, n, s = F.col("p"), F.col("n"), F.col("s")
    pace = F.greatest(F.coalesce("v", F.lit(15.0)), F.lit(2.0))
    pace = F.when(F.col("kind") == "t", 1.0 / pace).otherwise(pace)
    guess = F.coalesce(p["y"] + (s - p["s"]) * F.try_divide(n["y"] - p["y"], n["s"] - p["s"]), p["y"] + (s - p["s"]) * pace, n["y"] - (n["s"] - s) * pace)
    speeds, places = _quantiles(discretized.select(_number("velocity").alias("v")), ["v"])["v"], _labels(discretized, "location")
    found = cut_lineage(
        found.select(
            "row_id", "kind", "known", "own", "v", _label("location", places).alias("c_location"),
            (F.when(guess.isNotNull(), F.greatest(guess, F.lit(0.0))) / F.col("width")).alias("guess"), ((n["y"] - p["y"]) / F.col("width")).alias("gap"),
        )
    )
    shown = found.withColumn("hidden", F.explode(F.when(F.col("own").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))))
    own, by_guess = F.when(~F.col("hidden"), F.col("own")), F.floor("guess")
    base = F.coalesce(own, by_guess)
    coded = shown.select(
        "row_id", (F.when(F.col("kind") == "t", 0).otherwise(2) + F.col("hidden").cast("int")).cast("long").alias("tree"),
        base.alias("base"), (F.col("hidden") == F.col("own").isNull()).alias("as_given"), (F.col("known") - base).cast("double").alias("d"),
        _offset(F.col("known") - base).alias("c_target"), _offset(by_guess - own).alias("c_away"), _bin((F.col("guess") - by_guess) * 8, 8).alias("c_part"),
        F.when(base.isNotNull(), F.coalesce(_bin(F.col("gap"), 12), F.lit(12))).cast("long").alias("c_gap"), "v", "c_location",
    )
    fields = {"c_target": OFFSETS, "c_away": OFFSETS, "c_part": 8, "c_gap": 13, "v": speeds, "c_location": len(places) + 1}
    trees = fit_trees(coded, fields, "tree", 4)
    decode = _medians(coded.withColumn("_state", F.col("tree") * OFFSETS + F.col("c_target")), "_state", "d")
    filled = fill_states(coded.where("as_given"), fields, trees, "c_target", ["row_id", "base", "tree"], "tree")
    state = (F.col("tree") * OFFSETS + F.col("state")).cast("int")
    away = F.lit(0.0) if decode is None else F.coalesce(F.try_element_at(decode, state), F.lit(0.0))
    value = F.when(F.col("base").isNotNull(), F.greatest(F.col("base") + F.round(away), F.lit(0.0)))
    value = F.when((F.col("tree") >= 2) & value.isNotNull(), F.least(value, F.lit(float(cells - 1)))).otherwise(value)
    field = F.when(F.col("tree") < 2, "t_index").otherwise("x_index")
    return filled.select(
        F.lit("discretized_trajectories").alias("table_name"), "row_id", field.alias("field"), value.alias("value"), value.isNotNull().alias("filled"), "probability"
    )


def fill_missing(flow_data: DataFrame, discretized: DataFrame) -> DataFrame:
    """One row for each missing value of both tables, with the value filled in; see fill_speeds and fill_indices."""
    return fill_speeds(flow_data).unionByName(fill_indices(discretized))

"""Errors of estimates against trajectories and fields, and reports over experiment runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hidden_vehicles(full: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows of vehicles that no observation names. An id with a suffix is another id."""
    return full.join(observed.select("vehicle_id").distinct(), "vehicle_id", "left_anti")


def squared_errors(steps: DataFrame, field: DataFrame) -> DataFrame:
    """Each step of a trajectory with the squared distance of its speed from the field's (micro units in, m/s out)."""
    met = steps.where("t_index >= 0 and x_index >= 0").join(field.select("location", "t_index", "x_index", "field_um"), ["location", "t_index", "x_index"])
    gap = (F.col("v_um") - F.col("field_um")).cast("double") / 1e6
    return met.withColumn("squared", gap * gap)


def squared_errors_in_cell(per_vehicle: DataFrame) -> DataFrame:
    """Each vehicle's mean in a cell with its squared distance from the mean over the cell's vehicles."""
    cell = Window.partitionBy("location", "t_index", "x_index")
    mean = F.floor(F.sum("v_um").over(cell) / F.count("v_um").over(cell).cast("double") + 0.5).cast("long")
    gap = (F.col("v_um") - mean).cast("double") / 1e6
    return per_vehicle.where("t_index >= 0 and x_index >= 0").withColumn("squared", gap * gap)


def variances(rows: DataFrame, by: str, field: Column, estimate: Column) -> DataFrame:
    """Population variances of a field and of what an estimate leaves of it, over rows that have both (n of them)."""
    return rows.groupBy(by).agg(F.count(field - estimate).alias("n"), F.var_pop(field - estimate).alias("residual"), F.var_pop(field).alias("field"))


def root_mean_square(errors: DataFrame, by: list[str]) -> DataFrame:
    """n, and the root mean square error in km/h (thousandths, whole): sums of whole numbers don't depend on order."""
    whole = F.floor(F.col("squared") * 1e6 + 0.5).cast("long")
    grouped = errors.groupBy(*by).agg(F.count("*").alias("n"), F.sum(whole).alias("_s"))
    return grouped.withColumn("rmse_kmh_milli", F.floor(F.sqrt(F.col("_s") / 1e6 / F.col("n")) * 3600 + 0.5).cast("long")).drop("_s")


def negative_log_likelihood(truth: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Mean negative log-likelihood a step per key of truth (t_index, values array) under predicted (mean array,
    covariance array of arrays), with the steps and cells it is over.

    A step is scored over the cells known in both arrays, by the marginal normal of these; null and NaN are unknown. A
    step without such a cell isn't scored; a key without such a step has no steps and a null mean.
    """

    def score(pdf):
        import pandas as pd

        total, cells, factors = [], 0, {}
        for values, mean, cov in zip(pdf["values"], pdf["mean"], pdf["covariance"]):
            gap = np.asarray(values, float) - np.asarray(mean, float)
            known = np.flatnonzero(~np.isnan(gap))
            if not len(known):
                continue
            gap, cells = gap[known], cells + len(known)
            key_of = known.tobytes(), np.stack(cov).tobytes()  # steps often share a model
            if key_of not in factors:
                factors.clear()
                factors[key_of] = np.linalg.cholesky(np.stack(cov)[np.ix_(known, known)])
            chol = factors[key_of]
            z = np.linalg.solve(chol, gap)
            total.append(0.5 * (z @ z + len(gap) * np.log(2 * np.pi)) + np.log(np.diag(chol)).sum())
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in key), len(total), cells, float(np.sum(total))]], columns=[*key, "n", "cells", "nll"])

    joined = truth.join(predicted, [*key, "t_index"]).withColumn("_block", F.floor(F.col("t_index") / 1000))
    types = ", ".join(f"{n} {t}" for n, t in joined.select(*key).dtypes)
    parts = joined.groupBy(*key, "_block").applyInPandas(score, f"{types}, n long, cells long, nll double")
    steps = F.sum("n")
    return parts.groupBy(*key).agg((F.sum("nll") / F.nullif(steps, F.lit(0))).alias("mean_nll"), steps.alias("n_steps"), F.sum("cells").alias("n_cells"))


def run_report(runs: DataFrame, shares: list[float]) -> DataFrame:
    """Runs per model as a table of counts by probe share, with a column for all other shares; runs without a share are left out."""
    rows = runs.select("model", F.col("data.probe_fraction").alias("share")).where("share is not null")
    names = {s: f"share_{int(round(s * 100)):02d}" for s in shares}
    shown = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("share")), F.lit("share_other"))
    counts = rows.withColumn("_shown", shown).groupBy("model").pivot("_shown", [*names.values(), "share_other"]).count()
    return counts.select("model", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in (*names.values(), "share_other")])


def runs_where(runs: DataFrame, **values: list) -> DataFrame:
    """Runs whose columns have one of the given values."""
    for name, allowed in values.items():
        runs = runs.where(F.col(name).isin(allowed))
    return runs


def settings_as_columns(runs: DataFrame, structs: list[str], errors: list[str], names: list[str]) -> DataFrame:
    """Fields of the structs as columns <struct>_<field>, and the known errors, in order, as columns of their own."""
    fields = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in structs for f in runs.schema[s].dataType.names]
    known = F.filter(F.array(*[F.col(e) for e in errors]), lambda e: e.isNotNull() & ~F.isnan(e))
    return runs.select("run_id", *fields, known.alias("_e")).select("*", *[F.get("_e", F.lit(k)).alias(n) for k, n in enumerate(names)]).drop("_e")


def sweep_coverage(runs: DataFrame, limit: int = 1000) -> DataFrame:
    """Every combination of the values in use of each column, with the number of runs made of it.

    The values are settings, not data: more than `limit` of a column are refused. Null values make no combination.
    """
    names, grid = runs.columns, None
    for name in names:
        values = runs.select(name).where(F.col(name).isNotNull()).distinct()
        if values.limit(limit + 1).count() > limit:
            raise ValueError(f"too many values of {name}")
        grid = values if grid is None else grid.crossJoin(values)
    made = runs.groupBy(*names).agg(F.count("*").alias("n_runs"))
    return grid.join(made, names, "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))


def run_statistics(runs: DataFrame, labels: dict[str, str], worst: float = 30.0) -> DataFrame:
    """Per model and flow family: runs, distinct seeds, mean and spread of the error, and the label they're shown under.

    Runs above `worst` are left out, those without an error stay (and count). Ordered by the model's mean error.
    """
    shown = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("model")), F.col("model"))
    rmse = F.when(~F.isnan("rmse"), F.col("rmse"))
    rows = runs.withColumn("e", F.floor(rmse * 1e4 + 0.5).cast("long")).where(~F.coalesce(F.col("e") > worst * 1e4, F.lit(False)))
    family = F.coalesce("flow.family", F.lit("none"))
    label = F.concat_ws("-", shown, family)
    stats = rows.select("seed", "e", "model", label.alias("label")).groupBy("label", "model").agg(
        F.count("*").alias("n_runs"), F.count_distinct("seed").alias("n_seeds"), F.sum("e").alias("s"), F.count("e").alias("n"), F.sum(F.col("e") * F.col("e")).alias("ss")
    )
    by = Window.partitionBy("model")
    mean = F.floor(F.col("s") / F.col("n") + 0.5).cast("long")
    spread = F.sqrt((F.col("ss") - F.col("s").cast("double") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0)))
    model_mean = F.floor(F.sum("s").over(by) / F.sum("n").over(by) + 0.5).cast("long")
    return stats.select("label", "n_runs", "n_seeds", mean.alias("mean_e4"), F.floor(spread + 0.5).cast("long").alias("std_e4"), model_mean.alias("model_mean_e4")).orderBy("model_mean_e4", "label")


def unlogged(runs: DataFrame) -> DataFrame:
    """Columns log_<name> replaced by exp of themselves under <name>; the rest as it is."""
    return runs.select(*[F.exp(c).alias(c[4:]) if c.startswith("log_") else F.col(c) for c in runs.columns])


def parameter_sweep(spark, choices: dict[str, list]) -> DataFrame:
    """One row per combination of parameter values (a few settings each)."""
    out = None
    for name, values in choices.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)
    return out

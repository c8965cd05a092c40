"""A reproducible sample that only grows: consistent weighted Poisson sampling (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 32


def identifier_hash(identifier: Column, seed: str) -> Column:
    """A whole number from 0 to 2^32 - 1 that depends on the identifier and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), identifier.cast("string"))), 1, 8), 16, 10).cast("bigint")


def weighted_sample(weights: DataFrame, identifier: str, weight: str, per_unit: int, seed: str = "s1", stored: DataFrame | None = None) -> DataFrame:
    """Each identifier with its running-maximum weight, and whether it is in the sample.

    weights: whole non-negative weights, several rows per identifier allowed (the largest counts: a weight as of
    some moment never exceeds the running maximum later). stored: (identifier, max_weight) kept from an earlier
    run, whose weights also count, so that a corrected or deleted record never lowers an inclusion probability.
    An identifier is selected when hash < max_weight * per_unit, that is with probability
    min(1, max_weight * per_unit / 2^32). All arithmetic is on whole numbers, so neither order nor partitioning
    of the rows matters. per_unit is a fixed parameter: taken from the data it would change as they grow.

    A null identifier counts nowhere; null or negative weights count as 0 and are never selected. Kept weights of another
    seed or constant are refused, as is a constant below 1, by which nobody could be selected.
    """
    if per_unit < 1:
        raise ValueError("the share for each unit of weight is too small")
    if stored is not None and {"seed", "per_unit"} <= set(stored.columns):
        if not stored.where(~(F.col("seed").eqNullSafe(F.lit(seed)) & F.col("per_unit").eqNullSafe(F.lit(per_unit)))).isEmpty():
            raise ValueError("weights kept under another seed or constant")
    rows = weights.select(F.col(identifier).alias("id"), F.greatest(F.coalesce(F.col(weight).cast("bigint"), F.lit(0)), F.lit(0)).alias("w"))
    if stored is not None:
        rows = rows.unionByName(stored.select(F.col(identifier).alias("id"), F.coalesce(F.col("max_weight"), F.lit(0)).alias("w")))
    top = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("w").alias("max_weight"))
    bound = F.least(F.col("max_weight"), F.lit((1 << HASH_BITS) // per_unit + 1)) * F.lit(per_unit)
    return top.select(
        F.col("id").alias(identifier), "max_weight", identifier_hash(F.col("id"), seed).alias("id_hash")
    ).withColumn("selected", F.col("id_hash") < bound)


def store_weights(sample: DataFrame, identifier: str, per_unit: int, path: str, seed: str = "s1") -> None:
    """Keep the running-maximum weights of a sample, with the seed and constant they are compared under, for later runs' `stored`."""
    kept = sample.select(identifier, "max_weight", F.lit(seed).alias("seed"), F.lit(per_unit).cast("bigint").alias("per_unit"))
    kept.write.mode("errorifexists").parquet(path)


def driving_weights(trajectories: DataFrame) -> DataFrame:
    """Each vehicle's whole seconds driven, summed over its passes: it never falls as readings are added.

    Passes are reduced by minimum and maximum before the shuffle, so a vehicle with a third of all rows sends
    one row per pass and task. Repeated rows change nothing. Rows without vehicle_id count nowhere; a vehicle
    whose times are all null has weight 1, as has one with a single reading.
    """
    t = F.col("time_seconds")
    passes = trajectories.where(F.col("vehicle_id").isNotNull()).groupBy("vehicle_id", "pass_no").agg(
        F.min(F.when(~F.isnan(t), t)).alias("a"), F.max(F.when(~F.isnan(t), t)).alias("b")
    )
    seconds = F.coalesce(F.floor(F.col("b") - F.col("a")), F.lit(0)) + 1
    return passes.groupBy("vehicle_id").agg(F.sum(seconds).cast("bigint").alias("weight"), F.count("*").alias("n_passes"))


def per_second(share_per_hour: float) -> int:
    """The constant for weights in seconds, so that an hour gives the probability share_per_hour."""
    return int(share_per_hour * (1 << HASH_BITS) / 3600)


def vehicle_sample(trajectories: DataFrame, share_per_hour: float = 1.0, seed: str = "s1", stored: DataFrame | None = None) -> DataFrame:
    """The vehicles and whether they are in the sample; an hour of driving gives the probability share_per_hour."""
    return weighted_sample(driving_weights(trajectories), "vehicle_id", "weight", per_second(share_per_hour), seed, stored)

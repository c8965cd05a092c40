import pytest
from conftest import trajectory_rows
from pyspark.sql import functions as F

from tidelane.llm.stable_sample import per_second, store_weights, vehicle_sample, weighted_sample


def chosen(df):
    return {r.vehicle_id for r in df.where("selected").collect()}


def test_same_in_every_layout_and_growing(spark, small):
    rows = spark.read.parquet(f"{small}/trajectories.parquet")
    whole = vehicle_sample(rows, 4.0)
    assert chosen(whole) == chosen(vehicle_sample(rows.repartition(7).orderBy(F.rand()), 4.0)) == chosen(vehicle_sample(rows.union(rows), 4.0))
    before: set = set()
    for hour in (6, 7, 9, 12, 24):
        early = vehicle_sample(rows.where(F.col("ingested_at") <= F.lit(f"2025-03-0{3 + hour // 24} {hour % 24:02d}:00:00").cast("timestamp_ntz")), 4.0)
        assert before <= chosen(early)
        before = chosen(early)
    assert before <= chosen(whole) and chosen(whole)


def test_stored_weights_keep_what_corrections_would_drop(spark):
    ids = spark.createDataFrame([(f"v{i}", 50) for i in range(500)], "vehicle_id string, weight bigint")
    per_unit = 2**32 // 200
    first = weighted_sample(ids, "vehicle_id", "weight", per_unit)
    share = first.where("selected").count() / 500
    assert 0.15 < share < 0.35
    lower = ids.withColumn("weight", F.lit(1))
    kept = weighted_sample(lower, "vehicle_id", "weight", per_unit, stored=first.select("vehicle_id", "max_weight"))
    assert chosen(first) == chosen(kept)
    assert chosen(weighted_sample(lower, "vehicle_id", "weight", per_unit)) < chosen(first)


def test_nulls_ties_extremes_and_empty(spark):
    ids = spark.createDataFrame([(None, 5), ("a", None), ("b", -3), ("c", 2**62), ("c", 1), ("d", 2**62)], "vehicle_id string, weight bigint").withColumn("w", F.lit("x")).withColumn("id", F.lit("y"))
    got = {r.vehicle_id: r.selected for r in weighted_sample(ids, "vehicle_id", "weight", 1000).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": True}
    assert vehicle_sample(trajectory_rows(spark, [])).count() == 0


def test_weights_are_kept_with_their_seed_and_constant(spark, tmp_path, small):
    rows = spark.read.parquet(f"{small}/trajectories.parquet")
    with pytest.raises(ValueError):
        vehicle_sample(rows, 1e-7)
    sample, path = vehicle_sample(rows), str(tmp_path / "weights")
    store_weights(sample, "vehicle_id", per_second(1.0), path)
    kept = spark.read.parquet(path)
    assert chosen(vehicle_sample(rows, stored=kept)) == chosen(sample)
    for options in ({"share_per_hour": 2.0}, {"seed": "s2"}):
        with pytest.raises(ValueError):
            vehicle_sample(rows, stored=kept, **options)

"""Raw camera tables, per-vehicle files, road graphs and run tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators.trajectory import clip, relative_time, unique_trips

# Unit conversions and the study areas (metres) of the camera sites.
FEET_PER_METRE = 3.28084
METRES_PER_MILE = 1609.34
MPH_PER_MS = 2.23694
SITE_LIMITS = {"us-101": (20.0, 620.0), "i-80": (30.0, 480.0)}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by suffix; anything else is refused."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"neither CSV nor Parquet: {path}")


def normalise_camera(raw: DataFrame, location: str, lanes: list[int]) -> DataFrame:
    """Lower-case names, distinct rows, metres and seconds, one location and a set of lanes.

    Location is compared without regard to case, blanks and underscores. y_meters stays in feet, as the sources
    keep it. A row with null lane or location is left out.
    """
    rows = raw.toDF(*[c.lower() for c in raw.columns]).dropDuplicates()
    spelled = F.regexp_replace(F.lower(F.trim("location")), "[ _]+", "-")
    return rows.where((spelled == location) & F.col("lane_id").isin(lanes)).select(
        F.col("vehicle_id").cast("string").alias("vehicle_id"),
        F.timestamp_millis("global_time").alias("global_time"),
        F.col("global_time").alias("global_ms"),
        (F.col("local_y") / FEET_PER_METRE).alias("x_meters"),
        F.col("local_x").alias("y_meters"),
        (F.col("v_vel") / FEET_PER_METRE).alias("velocity"),
        (F.col("space_headway") / FEET_PER_METRE).alias("space_headway"),
        "time_headway",
        F.col("lane_id").cast("int").alias("lane_id"),
    )


def camera_trajectories(raw: DataFrame, location: str, lanes: list[int], min_drop: float = 100.0) -> DataFrame:
    """The full load: normalise, seconds since the first record, one id per trip, clip to the site, shift the origin."""
    low, high = SITE_LIMITS[location]
    rows = relative_time(normalise_camera(raw, location, lanes), "global_ms")
    rows = unique_trips(rows, "vehicle_id", ["global_ms", "x_meters"], "x_meters", min_drop)
    return clip(rows, x_limits=(low, high))


def read_vehicle_files(spark: SparkSession, folder: str, xmin: float, xmax: float, raw: bool = False) -> DataFrame:
    """One CSV per vehicle, named after it; headers may have blanks (unix time, postmile in miles, speed in mph)."""
    rows = spark.read.csv(f"{folder}/*.csv", header=True, inferSchema=True).withColumn(
        "vehicle_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    )
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    if raw:
        return rows.withColumn("global_time", F.timestamp_seconds("unixtime"))
    seconds = F.col("unix time").cast("double")
    rows = rows.select(
        "vehicle_id", F.timestamp_seconds(seconds).alias("global_time"), F.round(seconds * 1000).cast("long").alias("global_ms"),
        (F.col("postmile") * METRES_PER_MILE).alias("x_meters"), (F.col("speed") / MPH_PER_MS).alias("velocity"),
    )
    return clip(relative_time(rows, "global_ms"), x_limits=(xmin, xmax))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file with their data as maps; keys are resolved to attribute names."""
    data = "data ARRAY<STRUCT<_VALUE: STRING, _key: STRING>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    names = read("key", "_id STRING, `_attr.name` STRING").select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name"))
    lookup = names.agg(F.map_from_entries(F.collect_list(F.struct("k", "name"))).alias("names"))  # a file's few keys

    def attributes(rows: DataFrame) -> DataFrame:
        return rows.crossJoin(F.broadcast(lookup)).withColumn(
            "attributes", F.map_from_entries(F.transform(F.coalesce("data", F.array()), lambda d: F.struct(F.coalesce(F.element_at("names", d["_key"]), d["_key"]), d["_VALUE"])))
        ).drop("data", "names")

    nodes = attributes(read("node", f"_id STRING, {data}")).withColumnRenamed("_id", "node_id")
    edges = attributes(read("edge", f"_source STRING, _target STRING, _id STRING, {data}")).select(
        F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("_id").alias("edge_id"), "attributes"
    )
    return nodes, edges


def load_dataset(spark: SparkSession, name: str, path: str, lanes: list[int] | None = None, x_limits: tuple[float, float] = (0.0, float("inf"))) -> DataFrame:
    """Trajectories of a data set by name: a camera site of SITE_LIMITS (one table), or `vehicles` (a folder of one CSV per
    vehicle). Any other name is refused."""
    if name in SITE_LIMITS:
        return camera_trajectories(read_table(spark, path), name, lanes or list(range(1, 9)))
    if name == "vehicles":
        return read_vehicle_files(spark, path, *x_limits)
    raise ValueError(f"no data set {name!r}")


def append_runs(runs: DataFrame, path: str) -> None:
    """Add experiment runs (configuration structs and errors) to the runs table."""
    runs.write.mode("append").parquet(path)

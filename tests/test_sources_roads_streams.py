import math

import pytest
from pyspark.sql import functions as F

from tidelane.operators import roads
from tidelane.operators.roads import albers
from tidelane.sources.traffic import append_runs, camera_trajectories, load_dataset, read_graphml, read_table, read_vehicle_files
from tidelane.streaming.grid import stream_cell_levels, stream_cell_means

GRAPH = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="y"/><key id="d1" for="node" attr.name="x"/>
<key id="d2" for="edge" attr.name="highway"/><key id="d3" for="edge" attr.name="geometry"/><graph edgedefault="directed">
{nodes}{edges}</graph></graphml>"""
NODES = {"1": (0, 0), "2": (0, 1), "3": (0, 2), "4": (0, 3), "5": (1, 0.5), "6": (1, 2.5), "7": (2, 2.5), "11": (9, 3), "12": (9, 0)}
EDGES = [("1", "2", "motorway"), ("2", "3", "motorway"), ("3", "4", "motorway"), ("5", "2", "motorway_link"), ("3", "6", "motorway_link"), ("6", "7", "primary"), ("11", "12", "motorway")]


@pytest.fixture
def graph(spark, tmp_path):
    nodes = "".join(f'<node id="{k}"><data key="d0">{y}</data><data key="d1">{x}</data></node>\n' for k, (x, y) in NODES.items())
    edges = "".join(f'<edge source="{a}" target="{b}" id="{i}"><data key="d2">{h}</data></edge>\n' for i, (a, b, h) in enumerate(EDGES))
    path = tmp_path / "road.graphml"
    path.write_text(GRAPH.format(nodes=nodes, edges=edges))
    n, e = read_graphml(spark, str(path))
    n = n.select("node_id", F.col("attributes")["x"].cast("double").alias("x"), F.col("attributes")["y"].cast("double").alias("y"))
    return n, e.select("edge_id", "source", "target", F.col("attributes")["highway"].alias("highway"))


def test_graph_is_read_and_categorised(graph):
    nodes, edges = graph
    assert nodes.count() == len(NODES) and edges.count() == len(EDGES)
    n, e = roads.categorise(nodes, edges)
    kinds = {r.edge_id: r.category for r in e.collect()}
    assert kinds == {"0": "motorway", "1": "motorway", "2": "motorway", "3": "on_ramp", "4": "off_ramp", "5": "off_ramp", "6": "motorway"}
    flags = {r.node_id: r.category for r in n.collect()}
    assert flags["5"] == "on_ramp" and flags["6"] == "off_ramp" and flags["7"] == "off_ramp" and flags["1"] == "motorway"


def test_components_directions_and_ends(graph):
    nodes, edges = graph
    labels = roads.components(nodes, edges)
    assert {r.node_id: r.component for r in labels.collect()} == {**{k: "1" for k in "1234567"}, "11": "11", "12": "11"}
    way = {r.component: r.north for r in roads.directions(nodes, edges, labels).collect()}
    assert way["1"] > 0 > way["11"]
    _, e = roads.categorise(nodes, edges)
    follows = roads.line_graph(e)
    assert {(r.a, r.b) for r in follows.collect()} >= {("0", "1"), ("1", "2"), ("1", "4"), ("4", "5"), ("3", "1")}
    kept = roads.clean_ends(e.select("edge_id", "category"), follows.where("a <> '6'"))
    assert {r.edge_id for r in kept.collect()} >= {"0", "1", "2"}
    assert {r.node_id for r in roads.reach(e.select(F.lit("0").alias("node_id")).limit(1), follows).collect()} == {"1", "2", "4", "5"}


def test_shared_ramp_nodes_lines_projection_and_ramp_cells(spark):
    nodes = spark.createDataFrame([("5", 0.0, 0.0, "other")], "node_id string, x double, y double, category string")
    edges = spark.createDataFrame([("0", "3", "5", True, False), ("1", "5", "4", False, True)], "edge_id string, source string, target string, is_off_ramp boolean, is_on_ramp boolean")
    n, e = roads.part_shared_ramps(nodes, edges)
    assert {r.node_id for r in n.collect()} == {"5", "-5"} and {r.edge_id: r.source for r in e.collect()} == {"0": "3", "1": "-5"}
    line = spark.createDataFrame([("a", "LINESTRING (0 0, 30 40, 30 100)")], "edge_id string, wkt string").withColumn("points", roads.points(F.col("wkt")))
    parts = roads.split_lines(line, 50.0).orderBy("part").collect()
    assert [(r.n_parts, r.length) for r in parts] == [(3, 110.0)] * 3 and parts[1].start_m == pytest.approx(110 / 3)
    # Equal area: the map's area per degree is the ellipsoid's; on the central meridian x is 0.
    step, points = 1e-4, [(-122.0, 37.5), (-122.0 + 1e-4, 37.5), (-122.0, 37.5 + 1e-4), (-120.0, 37.5)]
    x, y = albers(F.col("lon"), F.col("lat"))
    p = [(r.x, r.y) for r in spark.createDataFrame(points, "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()]
    area = abs((p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) - (p[2][0] - p[0][0]) * (p[1][1] - p[0][1]))
    e2, lat = 2 / 298.257222101 - 1 / 298.257222101**2, math.radians(37.5)
    w = 1 - e2 * math.sin(lat) ** 2
    true = 6378137.0**2 * (1 - e2) / w**2 * math.cos(lat) * math.radians(step) ** 2
    assert area == pytest.approx(true, rel=1e-4) and p[3][0] == pytest.approx(0.0, abs=1e-6)
    cells = spark.createDataFrame([("on_ramp", 450.0), ("off_ramp", -150.0), ("motorway", 300.0), ("off_ramp", 1000.0)], "category string, x_meters double")
    assert {(r.kind, r.x_index) for r in roads.ramp_cells(cells, 0.0, 200.0, 5).collect()} == {("on_ramp", 2), ("off_ramp", 0)}


def test_camera_and_vehicle_files(spark, tmp_path, small):
    raw = spark.read.parquet(f"{small}/ngsim_raw.parquet")
    got = camera_trajectories(raw.toDF(*[c.upper() for c in raw.columns]), "us-101", [1, 2, 3, 4])
    low = got.agg(F.min("x_meters"), F.max("x_meters")).first()
    assert low[0] > 0 and low[1] < 600
    for name, start in (("veh1", 0), ("veh2", 7)):
        (tmp_path / f"{name}.csv").write_text("unix time, postmile, speed\n" + "".join(f"{1000 + start + i},{20 + i * 0.01},{60 + i}\n" for i in range(5)))
    files = read_vehicle_files(spark, str(tmp_path), 20 * 1609.34, 21 * 1609.34)
    rows = files.orderBy("vehicle_id", "time_seconds").collect()
    assert {r.vehicle_id for r in rows} == {"veh1", "veh2"} and len(rows) == 8
    assert rows[0].time_seconds == 1.0 and rows[0].velocity == pytest.approx(61 / 2.23694)
    with pytest.raises(ValueError):
        read_table(spark, "x.json")
    runs = spark.read.parquet(f"{small}/experiment_runs.parquet")
    append_runs(runs, str(tmp_path / "runs"))
    append_runs(runs, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).select("data.dx_meters").count() == 2 * runs.count()


def test_streamed_cells_equal_the_batch(spark, tmp_path, small):
    source = spark.read.parquet(f"{small}/trajectories.parquet").where("vehicle_id is not null").orderBy("global_time")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = stream_cell_means(stream, late="1 minute").writeStream.format("memory").queryName("cells").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("cells").agg(F.sum("n")).first()[0]
    good = source.where("x_meters is not null and velocity is not null and not isnan(velocity)").dropDuplicates(["vehicle_id", "pass_no", "global_time"])
    assert got == good.count()
    cells = spark.table("cells").select("start", "location", "x_index", "n", "sum_um")
    cells.coalesce(1).write.parquet(str(tmp_path / "cells"))
    again = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "cells"))
    q = stream_cell_levels(again).writeStream.format("memory").queryName("states").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("states").toPandas()
    assert len(out) == cells.count()
    batch = cells.orderBy("start").toPandas()
    for (location, cell), g in list(out.groupby(["location", "x_index"]))[:20]:
        level, variance, last = None, 0.0, 0.0
        own = batch[(batch["location"] == location) & (batch["x_index"] == cell)]
        for start, n, total, speed in zip(own["start"], own["n"], own["sum_um"], g.sort_values("start")["speed"]):
            seen, at = total / n / 1e6, start.timestamp()
            prior = variance + 0.05 * (at - last) if level is not None else float("inf")
            gain = 1.0 if level is None else prior / (prior + 4.0 / n)
            level, variance, last = seen if level is None else level + gain * (seen - level), 4.0 / n if level is None else (1 - gain) * prior, at
            assert abs(level - speed) < 1e-9


def test_camera_load_of_every_site_and_lane(spark, small):
    from tidelane.plans import reference

    small = small.replace("sf0.001", "sf0.01")  # the smallest with both sites
    got = reference.QUERIES["camera_load_all"](spark, small).persist()
    raw = spark.read.parquet(f"{small}/ngsim_raw.parquet").distinct()
    site = F.regexp_replace(F.lower(F.trim("location")), "[ _]+", "-")
    x, limits = F.col("local_y") / 3.28084, {"us-101": (20.0, 620.0), "i-80": (30.0, 480.0)}
    rows = None
    for name, (low, high) in limits.items():
        part = raw.where((site == name) & F.col("lane_id").between(1, 8) & (x > low) & (x < high)).select(F.lit(name).alias("location"), F.col("lane_id").cast("int").alias("lane_id"))
        rows = part if rows is None else rows.union(part)
    count = lambda df: {(r.location, r.lane_id): r["count"] for r in df.groupBy("location", "lane_id").count().collect()}
    assert count(got) == count(rows) and {k[0] for k in count(got)} == set(limits) and max(k[1] for k in count(got)) > 3
    known = ["global_ms", "x_meters", "velocity", "lane_id"]
    assert reference.camera_load(spark, small).select(*known).exceptAll(got.where("location = 'us-101'").select(*known)).count() == 0


def test_long_chains_and_many_parts_are_labelled(spark):
    edges = [(f"{k:04d}", f"{k + 1:04d}") for k in range(200) if k % 67] + [("a3", "a1"), ("a2", "a3"), ("a2", "a2")]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    want = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = roads.components(spark.createDataFrame([(n,) for n in nodes], "node_id string"), spark.createDataFrame(edges, "source string, target string"))
    assert {r.node_id: r.component for r in got.collect()} == want


def test_places_along_a_line_and_ranks(spark):
    line = spark.createDataFrame([("r", [(0.0, 0.0), (30.0, 40.0), (30.0, 100.0)])], "component string, points array<struct<x: double, y: double>>")
    starts = spark.createDataFrame([("a", "r", 30.0, 70.0), ("b", "r", 0.0, 0.0), ("c", "r", 34.0, 37.0), ("d", "r", 30.0, 500.0), ("e", "none", 1.0, 1.0), ("f", "r", 0.0, 0.0)], "edge_id string, component string, x double, y double")
    placed = roads.along(starts, line)
    assert {r.edge_id: r.x_meters and round(r.x_meters, 6) for r in placed.collect()} == {"a": 80.0, "b": 0.0, "c": 50.0, "d": 110.0, "e": None, "f": 0.0}
    for width in (10.0, 1e6):
        cells = roads.ranked(placed.where("x_meters is not null"), "x_meters", "component", width=width)
        assert {r.edge_id: r.cell for r in cells.collect()} == {"b": 0, "f": 1, "c": 2, "a": 3, "d": 4}
        back = roads.ranked(placed.where("x_meters is not null"), "x_meters", "component", southbound=True, width=width)
        assert {r.edge_id: r.cell for r in back.collect()} == {"d": 0, "a": 1, "c": 2, "b": 3, "f": 4}


def test_cleaned_graph_keeps_whole_edges_and_their_nodes(spark, graph):
    nodes, edges = roads.categorise(*graph)
    n, e = roads.clean_graph(nodes.where("node_id <> '1'"), edges)
    assert {r.edge_id for r in e.collect()} == {"1", "2", "3", "4", "6"} and {r.node_id for r in n.collect()} == {"2", "3", "4", "5", "6", "11", "12"}
    assert {r.edge_id for r in roads.clean_graph(nodes, edges, extended=True)[1].collect()} == {"0", "1", "2", "3", "4", "5", "6"}
    ways = roads.directions(*graph, roads.components(*graph))
    assert roads.main_component(ways).first()[0] == "1" and roads.main_component(ways, north=False).first()[0] == "11"


def test_data_sets_by_name(spark, tmp_path, small):
    path = f"{small}/ngsim_raw.parquet"
    assert load_dataset(spark, "us-101", path, [1, 2, 3]).count() == camera_trajectories(spark.read.parquet(path), "us-101", [1, 2, 3]).count()
    with pytest.raises(ValueError):
        load_dataset(spark, "a86", path)

"""Road graphs as two tables: categories, splitting, components, line graph, ramp cells.

nodes: node_id, x, y. edges: edge_id, source, target, highway, wkt. Ids are strings.
"""

from __future__ import annotations

from math import cos, log, radians, sin, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.session import cut_lineage

MOTORWAY = ["motorway", "['motorway_link', 'motorway']"]
# California Albers (EPSG:3310) on the GRS 80 ellipsoid.
SEMI_AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLELS, ORIGIN, FALSE_NORTHING = (34.0, 40.5), (0.0, -120.0), -4_000_000.0


def albers(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """Equal-area conic coordinates in metres."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = sqrt(e2)

    def q_of(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_of(p: float) -> float:
        return cos(p) / sqrt(1 - e2 * sin(p) ** 2)

    p1, p2 = (radians(p) for p in PARALLELS)
    n = (m_of(p1) ** 2 - m_of(p2) ** 2) / (q_of(sin(p2)) - q_of(sin(p1)))
    c = m_of(p1) ** 2 + n * q_of(sin(p1))
    rho0 = SEMI_AXIS * sqrt(c - n * q_of(sin(radians(ORIGIN[0])))) / n
    s = F.sin(F.radians(latitude))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = SEMI_AXIS / n * F.sqrt(c - n * q), n * F.radians(longitude - ORIGIN[1])
    return rho * F.sin(theta), rho0 - rho * F.cos(theta) + FALSE_NORTHING


def reach(start: DataFrame, steps: DataFrame, hops: int | None = None) -> DataFrame:
    """Nodes reached from start (node_id) along steps (a, b), the start included only if a path leads back to it.

    Without `hops` until nothing new is found; each round joins only the nodes found in the last one.
    """
    frontier = cut_lineage(start.select("node_id").distinct())
    found, k = frontier.limit(0), 0
    while (hops is None or k < hops) and not frontier.isEmpty():
        ahead = frontier.join(steps, frontier["node_id"] == steps["a"]).select(F.col("b").alias("node_id")).distinct()
        frontier = cut_lineage(ahead.join(found, "node_id", "left_anti"))
        found = cut_lineage(found.unionByName(frontier))
        k += 1
    return found


def categorise(nodes: DataFrame, edges: DataFrame, hops: int = 10) -> tuple[DataFrame, DataFrame]:
    """Flags and a category (motorway, on_ramp, off_ramp, other) for nodes and edges.

    A ramp that leaves the motorway is an off-ramp, one that enters it an on-ramp; both are extended hop by hop
    over other roads, without motorway nodes and without nodes that both would reach.
    """
    e = edges.withColumn("is_motorway", F.coalesce("highway", F.lit("unknown")).isin(MOTORWAY)).withColumn("is_ramp", ~F.col("is_motorway"))
    ends = lambda df, *cs: df.select(F.explode(F.array(*cs)).alias("node_id")).distinct()
    motorway = ends(e.where("is_motorway"), "source", "target").withColumn("is_motorway_node", F.lit(True))
    off_nodes = ends(e.where("is_ramp"), "source").join(motorway, "node_id", "left_semi").withColumn("is_off_ramp", F.lit(True))
    on_nodes = ends(e.where("is_ramp"), "target").join(motorway, "node_id", "left_semi").withColumn("is_on_ramp", F.lit(True))
    flag = lambda df, ids, key, name: df.join(ids.select(F.col("node_id").alias(key), F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    e = flag(flag(e, motorway, "source", "_sm"), motorway, "target", "_tm")
    e = e.withColumn("is_off_ramp", F.col("is_ramp") & F.col("_sm") & ~F.col("_tm")).withColumn("is_on_ramp", F.col("is_ramp") & F.col("_tm") & ~F.col("_sm"))
    e = cut_lineage(e)
    forward, backward = e.select(F.col("source").alias("a"), F.col("target").alias("b")), e.select(F.col("target").alias("a"), F.col("source").alias("b"))
    off, on = ends(e.where("is_off_ramp"), "target"), ends(e.where("is_on_ramp"), "source")
    for _ in range(hops):
        grown_off = off.union(off.join(forward, off["node_id"] == forward["a"]).select("b")).distinct()
        grown_on = on.union(on.join(backward, on["node_id"] == backward["a"]).select("b")).distinct()
        common = grown_off.intersect(grown_on).union(motorway.select("node_id"))
        new_off, new_on = (cut_lineage(g.join(common, "node_id", "left_anti")) for g in (grown_off, grown_on))
        if new_off.count() == off.count() and new_on.count() == on.count() and new_off.exceptAll(off).isEmpty() and new_on.exceptAll(on).isEmpty():
            break
        off, on = new_off, new_on
    n = nodes
    for ids, name in ((motorway, "is_motorway"), (off_nodes, "is_off_ramp"), (on_nodes, "is_on_ramp"), (off, "is_extended_off_ramp"), (on, "is_extended_on_ramp")):
        n = flag(n, ids, "node_id", name)
    n = n.withColumn(
        "category",
        F.when(F.col("is_on_ramp") | F.col("is_extended_on_ramp"), "on_ramp").when(F.col("is_off_ramp") | F.col("is_extended_off_ramp"), "off_ramp")
        .when(F.col("is_motorway"), "motorway").otherwise("other"),
    )
    e = flag(flag(e, off, "source", "is_extended_off_ramp"), on, "target", "is_extended_on_ramp").drop("_sm", "_tm")
    e = e.withColumn(
        "category",
        F.when(F.col("is_motorway"), "motorway").when(F.col("is_on_ramp") | F.col("is_extended_on_ramp"), "on_ramp")
        .when(F.col("is_off_ramp") | F.col("is_extended_off_ramp"), "off_ramp").otherwise("other"),
    )
    return n, e


def part_shared_ramps(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node that ends an off-ramp and starts an on-ramp becomes two: the on-ramp then starts at "-<id>"."""
    shared = edges.where("is_off_ramp").select(F.col("target").alias("node_id")).intersect(edges.where("is_on_ramp").select(F.col("source").alias("node_id")))
    copies = nodes.join(shared, "node_id", "left_semi").withColumn("node_id", F.concat(F.lit("-"), "node_id")).withColumn("category", F.lit("on_ramp"))
    named = shared.withColumnRenamed("node_id", "source").withColumn("_shared", F.lit(True))
    moved = F.when(F.col("is_on_ramp") & F.col("_shared"), F.concat(F.lit("-"), "source")).otherwise(F.col("source"))
    return nodes.unionByName(copies), edges.join(named, "source", "left").withColumn("source", moved).drop("_shared")


def points(wkt: Column) -> Column:
    """The coordinates of a WKT LINESTRING as an array of (x, y)."""
    inside = F.regexp_extract(wkt, r"\(([^()]*)\)", 1)
    return F.transform(F.split(inside, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))


def split_lines(edges: DataFrame, longest: float, line: str = "points") -> DataFrame:
    """Each edge cut into ceil(length / longest) equal parts: part, n_parts, start and end distance along it."""
    p = F.col(line)
    gap = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    legs = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), gap)
    rows = edges.withColumn("length", F.aggregate(legs, F.lit(0.0), lambda a, b: a + b))
    rows = rows.withColumn("n_parts", F.greatest(F.ceil(F.col("length") / longest), F.lit(1)).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    share = F.col("length") / F.col("n_parts")
    return rows.withColumn("start_m", F.col("part") * share).withColumn("end_m", (F.col("part") + 1) * share)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): weakly connected components, named by the smallest id in each.

    Each round a label hears of its neighbours' smallest, passes that on to the node it is named after, and then jumps to that
    node's own label; so long chains shrink by a factor each round, and rounds grow with the logarithm of the longest path.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = cut_lineage(both.union(both.select("b", "a")).where("a <> b").distinct())
    labels = cut_lineage(nodes.select("node_id", F.col("node_id").alias("component")))
    while True:
        heard = both.join(labels, both["a"] == labels["node_id"]).groupBy(F.col("b").alias("node_id")).agg(F.min("component").alias("_m"))
        met = labels.join(heard, "node_id", "left").select("node_id", "component", F.least("component", F.coalesce("_m", "component")).alias("_n"))
        passed = met.groupBy(F.col("component").alias("node_id")).agg(F.min("_n").alias("_p"))
        lower = met.join(passed, "node_id", "left").select("node_id", "component", F.least("_n", F.coalesce("_p", "_n")).alias("_n"))
        named = lower.select(F.col("node_id").alias("_at"), F.col("_n").alias("_j"))
        jumped = lower.join(named, lower["_n"] == named["_at"], "left").select("node_id", "component", F.least("_n", F.coalesce("_j", "_n")).alias("_n"))
        new = cut_lineage(jumped)
        changed = not new.where("_n <> component").isEmpty()
        labels = new.select("node_id", F.col("_n").alias("component"))
        if not changed:
            return labels


def main_component(ways: DataFrame, north: bool = True) -> DataFrame:
    """Of `directions`, the component that leads furthest north (or south)."""
    order = F.col("north").desc() if north else F.col("north").asc()
    return ways.orderBy(order, "component").limit(1).select("component")


def directions(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per component the sum of its edges' (dy, dx): northbound components have a large north."""
    a = nodes.select(F.col("node_id").alias("source"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node_id").alias("target"), F.col("x").alias("bx"), F.col("y").alias("by"))
    rows = edges.join(a, "source").join(b, "target").join(labels.withColumnRenamed("node_id", "source"), "source")
    return rows.groupBy("component").agg(F.sum(F.col("by") - F.col("ay")).alias("north"), F.sum(F.col("bx") - F.col("ax")).alias("east"))


def line_graph(edges: DataFrame) -> DataFrame:
    """Edges that follow one another: (a, b) are edge ids."""
    after = edges.select(F.col("edge_id").alias("b"), F.col("source").alias("_at"))
    return edges.select(F.col("edge_id").alias("a"), F.col("target").alias("_at")).join(after, "_at").drop("_at")


def along(starts: DataFrame, lines: DataFrame, by: str = "component") -> DataFrame:
    """x_meters: where on the line of its component the point nearest to (x, y) lies, from the line's begin.

    lines: one row per component with its vertices in order, points (array of x, y). A line is a road's course, of as many
    vertices as it has bends, however much drives on it; it is compared as one array. Without a line x_meters is null.
    """
    p = F.col("points")
    legs = F.arrays_zip(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))).alias("a"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))).alias("b"))
    measured = lines.select(by, F.transform(legs, lambda leg: F.struct(leg["a"].alias("a"), leg["b"].alias("b"), F.hypot(leg["b"]["x"] - leg["a"]["x"], leg["b"]["y"] - leg["a"]["y"]).alias("d"))).alias("_legs"))
    measured = measured.withColumn(
        "_legs",
        F.transform("_legs", lambda leg, i: leg.withField("from", F.aggregate(F.slice("_legs", 1, i), F.lit(0.0), lambda total, one: total + one["d"]))),
    )

    def nearest(leg: Column) -> Column:
        dx, dy = leg["b"]["x"] - leg["a"]["x"], leg["b"]["y"] - leg["a"]["y"]
        share = F.try_divide((F.col("x") - leg["a"]["x"]) * dx + (F.col("y") - leg["a"]["y"]) * dy, dx * dx + dy * dy)
        share = F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        off = F.hypot(F.col("x") - leg["a"]["x"] - share * dx, F.col("y") - leg["a"]["y"] - share * dy)
        return F.struct(off.alias("off"), (leg["from"] + share * leg["d"]).alias("at"))

    return starts.join(measured, by, "left").withColumn("x_meters", F.array_min(F.transform("_legs", nearest))["at"]).drop("_legs")


def ranked(cells: DataFrame, order: str, by: str, southbound: bool = False, width: float = 10_000.0) -> DataFrame:
    """Cells numbered from 0 along each road (`by`), by edge_id where they start together; the other way round southbound.

    A road is cut into stretches of `width`; cells are numbered inside theirs, and the stretches' numbers of cells, one row
    each, are added up along the road.
    """
    at = -F.col(order) if southbound else F.col(order)
    rows = cells.withColumn("_at", at).withColumn("_s", F.floor(F.col("_at") / width))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_s").orderBy("_at", "edge_id")) - 1)
    before = Window.partitionBy(by).orderBy(F.col("_s").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, "_s").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    counts = counts.select(F.col(by).alias("_by"), F.col("_s").alias("_k"), "_before")
    met = rows.join(counts, rows[by].eqNullSafe(counts["_by"]) & rows["_s"].eqNullSafe(counts["_k"]))
    return met.withColumn("cell", (F.col("_n") + F.col("_before")).cast("int")).drop("_at", "_s", "_n", "_by", "_k", "_before")


def clean_graph(nodes: DataFrame, edges: DataFrame, extended: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without roads of category other (and, unless `extended`, extended ramps); edges keep both their ends,
    nodes at least one of their edges. Both come from categorise."""
    kept = edges.where("category <> 'other'")
    if not extended:
        kept = kept.where("not (coalesce(is_extended_on_ramp, false) or coalesce(is_extended_off_ramp, false))")
    for end in ("source", "target"):
        kept = kept.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    used = kept.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return nodes.join(used, "node_id", "left_semi"), kept.select(*edges.columns)


def clean_ends(cells: DataFrame, follows: DataFrame) -> DataFrame:
    """Cells (edge_id, category) without what lies beyond the motorway's dead ends: everything after its last and
    before its first cells, but not those cells."""
    kinds = cells.select("edge_id", "category")
    inner = follows.join(kinds.where("category = 'motorway'").select(F.col("edge_id").alias("a")), "a", "left_semi").join(
        kinds.where("category = 'motorway'").select(F.col("edge_id").alias("b")), "b", "left_semi"
    )
    motorway = kinds.where("category = 'motorway'").select("edge_id")
    last = motorway.join(inner.select(F.col("a").alias("edge_id")), "edge_id", "left_anti").withColumnRenamed("edge_id", "node_id")
    first = motorway.join(inner.select(F.col("b").alias("edge_id")), "edge_id", "left_anti").withColumnRenamed("edge_id", "node_id")
    beyond = reach(last, follows).union(reach(first, follows.select(F.col("b").alias("a"), F.col("a").alias("b")))).distinct()
    return cells.join(beyond.withColumnRenamed("node_id", "edge_id"), "edge_id", "left_anti")


def ramp_cells(cells: DataFrame, x_min: float, dx: float, n_cells: int) -> DataFrame:
    """(kind, x_index) of the ramps inside the grid; the quotient is cut off towards 0."""
    index = ((F.col("x_meters") - x_min) / dx).cast("int")
    return cells.where(F.col("category").isin("on_ramp", "off_ramp")).select(F.col("category").alias("kind"), index.alias("x_index")).where((F.col("x_index") >= 0) & (F.col("x_index") < n_cells - 1))



"""Points, polygons and clusters as column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.functions.columns import all_of

CELL = 60
#: Where in a cell its middle is taken to be, east and north: off the middle, so that no corner with the decimals that surveys write falls on one.
MIDDLE_X, MIDDLE_Y = 0.487162531, 0.512649377


@dataclass(frozen=True)
class Polygon:
    """rings of (lon, lat); a point in an odd number of rings is inside. Lower ranks win."""

    name: str
    rank: int
    rings: tuple[tuple[tuple[float, float], ...], ...]

    def box(self) -> tuple[float, float, float, float]:
        xs, ys = [x for r in self.rings for x, _ in r], [y for r in self.rings for _, y in r]
        return min(xs), min(ys), max(xs), max(ys)


def inside(polygon: Polygon, lon: Column, lat: Column) -> Column:
    """Half-open ray cast over the polygon's edges, behind a test of its box."""
    crossings = F.lit(0)
    for ring in polygon.rings:
        for (x1, y1), (x2, y2) in zip(ring, (*ring[1:], ring[0]), strict=True):
            if y1 != y2:
                spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
                crossings = crossings + F.when(spans & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1), 1).otherwise(0)
    w, s, e, n = polygon.box()
    return lon.between(w, e) & lat.between(s, n) & (crossings % 2 == 1)


def jurisdiction(polygons: list[Polygon], lon: Column, lat: Column, otherwise: Column) -> Column:
    """The name of the first polygon (by rank, then as listed) that holds the point."""
    return F.coalesce(*[F.when(inside(p, lon, lat), p.name) for p in sorted(polygons, key=lambda p: p.rank)], otherwise)


def in_box(box: tuple[float, float, float, float]) -> Column:
    """Closed overlap of rows' boxes (west, south, east, north) with a box."""
    w, s, e, n = box
    return all_of([F.col("west") <= e, F.col("east") >= w, F.col("south") <= n, F.col("north") >= s])


def pixels(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Web Mercator pixels at a zoom."""
    world = F.pow(F.lit(2.0), zoom) * 256
    y = F.log((1 + F.sin(F.radians(lat))) / (1 - F.sin(F.radians(lat)))) / (4 * math.pi)
    return (lon + 180) / 360 * world, (0.5 - y) * world


def cluster_pyramid(points: DataFrame, kind: str, zooms: range = range(9, 16)) -> DataFrame:
    """zoom, cx, cy, lat, lon, n, dominant: points by cells of 60 pixels; the most common kind, the smallest of equals.

    Cells are aggregated by kind before the shuffle, so that a crowded cell is a few rows.
    """
    at = points.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    x, y = pixels(F.col("lon"), F.col("lat"), F.col("zoom"))
    cells = at.select("zoom", F.floor(x / CELL).alias("cx"), F.floor(y / CELL).alias("cy"), "lat", "lon", F.col(kind).alias("kind"))
    by_kind = cells.groupBy("zoom", "cx", "cy", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("lat").alias("slat"), F.sum("lon").alias("slon"))
    return by_kind.groupBy("zoom", "cx", "cy").agg(
        F.round(F.sum("slat") / F.sum("n"), 6).alias("lat"), F.round(F.sum("slon") / F.sum("n"), 6).alias("lon"), F.sum("n").alias("n"), F.max_by("kind", F.struct(F.col("n"), -F.col("kind"))).alias("dominant")
    )


def shoelace(ring: Column) -> Column:
    """The signed area of a closed or open ring, an array of (x, y) structs."""
    pairs = F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("q"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]) / 2)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """The centre of a ring; the mean of its points where it has no area."""
    q = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    area = shoelace(ring)

    def along(axis: str) -> Column:
        terms = F.zip_with(ring, q, lambda a, b: (a[axis] + b[axis]) * (a["x"] * b["y"] - b["x"] * a["y"]))
        mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(ring)
        return F.when(F.abs(area) > 1e-12, F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / (area * 6)).otherwise(mean)

    return along("x"), along("y")


def edge_table(spark: SparkSession, polygons: list[Polygon]) -> DataFrame:
    """place, rank, shape, x1, y1, x2, y2: a row an edge of each ring, holes too. For polygons that come as data, features.edges_of() gives the same columns."""
    rows = [(p.name, p.rank, k, *map(float, (*a, *b))) for k, p in enumerate(polygons) for ring in p.rings for a, b in zip(ring, (*ring[1:], ring[0]), strict=True) if a != b]
    return spark.createDataFrame(rows, "place string, rank int, shape long, x1 double, y1 double, x2 double, y2 double")


def cell_cover(edges: DataFrame, cell: float, each: bool = True) -> DataFrame:
    """cx, cy, shapes: the square cells that polygons of the edge table cover, with the shapes of each, by rank and name.

    A shape lists, for a cell that its border passes, the edges that do (level ones cross no row and are left out), where they cross the column of the cell's middle (ups), and whether the middle is inside (odd = 1); a
    cell wholly inside has no edges. What a point asks of an edge is worked out here, once a cell. alike is how many equal polygons a shape stands for, as the edge table tells in a column of that name, else one. Without
    `each`, those that hold a cell wholly are one shape there, the first of them, with the sum of alike. Edges are cut by rows of cells, so that no step sees more than a polygon's edges in one row.
    """
    at = lambda v: F.floor(v / cell)
    edges = edges if "alike" in edges.columns else edges.withColumn("alike", F.lit(1).cast("long"))
    shape = ["place", "rank", "shape", "alike"]
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cy", F.explode(F.sequence(at(low), at(high))))
    on = lambda y: F.try_divide((F.col("x2") - F.col("x1")) * (y - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1")
    flat = F.col("y1") == F.col("y2")
    from_x = F.when(flat, F.col("x1")).otherwise(on(F.greatest(low, F.col("cy") * cell)))
    to_x = F.when(flat, F.col("x2")).otherwise(on(F.least(high, (F.col("cy") + 1) * cell)))
    # a hair wider, so that rounding leaves no cell out
    touched = F.sequence(at(F.least(from_x, to_x) - cell * 1e-6), at(F.greatest(from_x, to_x) + cell * 1e-6))
    dx, dy, middle_x = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), (F.col("cx") + MIDDLE_X) * cell
    # nulls are not collected
    edge = F.when(~flat, F.struct(low.alias("low"), high.alias("high"), "x1", "y1", dx.alias("dx"), dy.alias("dy")))
    up = F.when((F.col("x1") > middle_x) != (F.col("x2") > middle_x), F.try_divide(dy * (middle_x - F.col("x1")), dx) + F.col("y1"))
    border = rows.withColumn("cx", F.explode(touched)).groupBy(*shape, "cx", "cy").agg(F.collect_list(edge).alias("edges"), F.collect_list(up).alias("ups"))
    middle = (F.col("cy") + MIDDLE_Y) * cell
    across = rows.filter((F.col("y1") > middle) != (F.col("y2") > middle)).groupBy(*shape, "cy").agg(F.sort_array(F.collect_list(on(middle))).alias("xs"))
    odd = lambda x: F.size(F.filter("xs", lambda xi: xi > x)) % 2
    met = border.join(across, [*shape, "cy"], "left").withColumn("odd", F.coalesce(odd((F.col("cx") + MIDDLE_X) * cell), F.lit(0)))
    spans = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda k: F.struct(F.ceil(F.get("xs", k) / cell - MIDDLE_X).alias("a"), F.floor(F.get("xs", k + 1) / cell - MIDDLE_X).alias("b")))
    within = across.select(*shape, "cy", F.explode(F.filter(spans, lambda s: s["a"] <= s["b"])).alias("s")).select(*shape, "cy", F.explode(F.sequence("s.a", "s.b")).alias("cx"))
    inner = within.join(border.select(*shape, "cx", "cy"), [*shape, "cx", "cy"], "left_anti")
    if not each:
        inner = inner.groupBy("cx", "cy").agg(F.min(F.struct("rank", "place", "shape")).alias("s"), F.sum("alike").alias("alike")).select("cx", "cy", "s.*", "alike")
    none = {c: F.array().cast(border.schema[c].dataType).alias(c) for c in ("edges", "ups")}
    every = met.select(*shape, "cx", "cy", *none, "odd").unionByName(inner.select(*shape, "cx", "cy", *none.values(), F.lit(1).alias("odd")))
    return every.groupBy("cx", "cy").agg(F.array_sort(F.collect_list(F.struct("rank", "place", "shape", "odd", "edges", "ups", "alike"))).alias("shapes"))


def locate(points: DataFrame, edges: DataFrame, key: str = "id", cell: float = 0.02) -> DataFrame:
    """key and place of points (key, lon, lat) in a polygon of the edge table, of several that with the least rank, then name."""
    return _held(points, edges, key, cell, False, _if_any(lambda found: F.struct(found[0]["place"].alias("place"))))


def locate_counted(points: DataFrame, edges: DataFrame, key: str = "id", cell: float = 0.02) -> DataFrame:
    """key, place as locate() gives it, and holders, how many polygons of the edge table hold the point; each of those that are alike counts."""
    holders = lambda found: F.aggregate(found, F.lit(0).cast("long"), lambda n, s: n + s["alike"])
    return _held(points, edges, key, cell, False, _if_any(lambda found: F.struct(found[0]["place"].alias("place"), holders(found).alias("holders"))))


def locate_all(points: DataFrame, edges: DataFrame, key: str = "id", cell: float = 0.02) -> DataFrame:
    """key, place, rank and shape of points in each polygon of the edge table that holds them; of those that the table has as one, alike, in that one."""
    return _held(points, edges, key, cell, True, lambda found: F.transform(found, lambda s: F.struct(s["place"].alias("place"), s["rank"].alias("rank"), s["shape"].alias("shape"))))


def _if_any(answer):
    """answer(found) as the only row of found that is not empty. What is found is worked out once, which a filter on it would do again."""
    return lambda found: F.transform(F.filter(F.array(found), lambda f: F.size(f) > 0), answer)


def _held(points: DataFrame, edges: DataFrame, key: str, cell: float, each: bool, answers) -> DataFrame:
    """key and the rows answers(found), where found are the shapes that hold a point, by rank and name; those around its whole cell are one shape, unless each is asked for.

    A point meets the one row of its cell. Cells inside a polygon answer without a look at an edge; in a border's cell the edges there are crossed from the cell's middle to the point, along
    the row and up or down the column, and each crossing turns inside to outside. Points are joined once and not grouped again; where a crowded cell makes the join uneven, Spark splits its
    points (adaptive skew join), as each needs the same row.
    """
    lon, lat = F.col("lon"), F.col("lat")
    cover = cell_cover(edges, cell, each)
    placed = points.select(key, "lon", "lat").withColumn("cx", F.floor(lon / cell)).withColumn("cy", F.floor(lat / cell))
    mx, my = (F.col("cx") + MIDDLE_X) * cell, (F.col("cy") + MIDDLE_Y) * cell

    def crossed(e: Column) -> Column:
        at_lat = e["dx"] * (lat - e["y1"]) / e["dy"] + e["x1"]
        return (e["low"] <= lat) & (e["high"] > lat) & ((lon < at_lat) != (mx < at_lat))

    passed = lambda s: F.size(F.filter(s["edges"], crossed)) + F.size(F.filter(s["ups"], lambda y: (lat < y) != (my < y)))
    holds = lambda s: (s["odd"] + passed(s)) % 2 == 1
    return placed.join(cover, ["cx", "cy"]).select(key, F.inline(answers(F.filter("shapes", holds))))


def clipped(shapes: DataFrame, vertices: DataFrame, edges: DataFrame | None, share: float = 0.1, least: int = 8, box: tuple[float, float, float, float] | None = None, cell: float = 0.02) -> DataFrame:
    """name, kept, inside and vertices of shapes (name, lon, lat of an inner point, or null) whose outline is in vertices (name, seq, lon, lat).

    Kept are those whose inner point lies in the mask of the edge table, and straddlers: with enough vertices, and enough of all of theirs, inside. Without a mask, those whose inner point lies in the box
    (west, south, east, north) are, and no vertex counts as inside.
    """
    if edges is None:
        if box is None:
            raise ValueError("neither a mask nor a box")
        w, s, e, n = box
        count = vertices.groupBy("name").agg(F.count(F.lit(1)).alias("vertices"))
        kept = F.coalesce(F.col("lon").between(w, e) & F.col("lat").between(s, n), F.lit(False))
        return shapes.join(count, "name", "left").select("name", kept.alias("kept"), F.lit(0).cast("long").alias("inside"), F.coalesce("vertices", F.lit(0)).alias("vertices"))
    corner = vertices.withColumn("id", F.struct("name", "seq"))
    found = locate(corner, edges, cell=cell).select("id", F.lit(True).alias("in"))
    counts = corner.join(found, "id", "left").groupBy("name").agg(F.count("in").alias("inside"), F.count(F.lit(1)).alias("vertices"))
    inner = locate(shapes.filter("lon is not null and lat is not null").withColumnRenamed("name", "id"), edges, cell=cell).select(F.col("id").alias("name"), F.lit(True).alias("point"))
    met = shapes.select("name").join(counts, "name", "left").join(inner, "name", "left")
    n, v = F.coalesce("inside", F.lit(0)), F.coalesce("vertices", F.lit(0))
    kept = F.col("point").isNotNull() | ((n >= least) & (n >= v * share) & (v > 0))
    return met.select("name", kept.alias("kept"), n.alias("inside"), v.alias("vertices"))


def viewport_clusters(points: DataFrame, kind: str, zoom: int, box: tuple[float, float, float, float], mask: Column | None = None) -> DataFrame:
    """The clusters of one zoom of the points in a closed box (west, south, east, north) that the mask lets through."""
    w, s, e, n = box
    seen = points.filter(F.col("lon").between(w, e) & F.col("lat").between(s, n) & (F.lit(True) if mask is None else mask))
    return cluster_pyramid(seen, kind, range(zoom, zoom + 1))


@dataclass(frozen=True)
class Zone:
    """A Lambert conformal conic zone on GRS80 in US survey feet: origin, two standard parallels (degrees), false easting (metres)."""

    lat_0: float
    lon_0: float
    lat_1: float
    lat_2: float
    x_0: float = 600_000.0


#: The state's plane zones (fixed values).
ZONES = {"north": Zone(39.6666666666667, -82.5, 41.7, 40.4333333333333), "south": Zone(38.0, -82.5, 40.0333333333333, 38.7333333333333)}
_A, _E2, _FOOT = 6378137.0, 0.006694380022900788, 0.3048006096012192


def zone_of(name: str) -> Zone:
    """By name or code, 3734 for the north and 3735 for the south; ValueError for any other."""
    key = {"3734": "north", "3735": "south", "epsg:3734": "north", "epsg:3735": "south"}.get(str(name).lower(), str(name).lower())
    if key not in ZONES:
        raise ValueError(f"no zone {name!r}: north (3734) or south (3735)")
    return ZONES[key]


def _cone(z: Zone) -> tuple[float, float, float]:
    """The cone's constant, its scale in metres and the radius of the origin."""
    e = math.sqrt(_E2)
    m = lambda p: math.cos(p) / math.sqrt(1 - _E2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(x) for x in (z.lat_0, z.lat_1, z.lat_2))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    scale = _A * m(p1) / (n * t(p1) ** n)
    return n, scale, scale * t(p0) ** n


def to_feet(lon: Column, lat: Column, zone: Zone) -> tuple[Column, Column]:
    """Degrees as plane feet."""
    n, scale, rho_0 = _cone(zone)
    e, p = math.sqrt(_E2), F.radians(lat)
    t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), e / 2)
    rho, theta = F.pow(t, n) * scale, (F.radians(lon) - math.radians(zone.lon_0)) * n
    return (rho * F.sin(theta) + zone.x_0) / _FOOT, (rho_0 - rho * F.cos(theta)) / _FOOT


def to_degrees(x: Column, y: Column, zone: Zone, rounds: int = 6) -> tuple[Column, Column]:
    """Plane feet as degrees; the latitude is iterated."""
    n, scale, rho_0 = _cone(zone)
    e = math.sqrt(_E2)
    east, north = x * _FOOT - zone.x_0, rho_0 - y * _FOOT
    t = F.pow(F.sqrt(east * east + north * north) / scale, 1 / n)
    better = lambda p, _: math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), e / 2))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), math.pi / 2 - 2 * F.atan(t), better)
    return F.degrees(F.atan2(east, north) / n) + zone.lon_0, F.degrees(p)


def largest_ring(rings: Column) -> Column:
    """The ring of the largest area among those of at least three points; null without any."""
    usable = F.filter(rings, lambda r: F.size(r) >= 3)
    best = F.array_max(F.transform(usable, lambda r, i: F.struct(F.abs(shoelace(r)).alias("area"), (-i).alias("i"))))
    return F.when(best["area"] > 0, F.try_element_at(usable, 1 - best["i"]))


def measured(rings: Column, square_feet_an_acre: float = 43_560.0) -> Column:
    """x and y (the centre of the largest ring), square_feet (holes subtracted, by their winding) and acres of plane rings; null without a ring that has an area."""
    best = largest_ring(rings)
    total = F.abs(F.aggregate(F.filter(rings, lambda r: F.size(r) >= 3), F.lit(0.0), lambda s, r: s + shoelace(r)))

    def reduced(r: Column) -> Column:
        x, y = ring_centroid(r)
        return F.struct(x.alias("x"), y.alias("y"), total.alias("square_feet"), F.round(total / square_feet_an_acre, 4).alias("acres"))

    return F.when(best.isNotNull(), F.transform(F.array(best), reduced)[0])

"""Polygons from GeoJSON files as rows, their boxes and edges, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.operators.spatial import in_box
from civlake.scratch import stashed

_FEATURE = "struct<properties:map<string,string>,bbox:array<double>,geometry:struct<type:string,coordinates:string>>"
_RINGS = "array<array<array<double>>>"


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, seq (from 0, in the file's order), properties, parts, west, south, east and north of the features at a path.

    A file is one collection, read by one task, or with `lines` a feature a line, read in pieces; a collection whose first and last line hold no feature, as collection_lines() gives it, may be read so too, and seq then
    has gaps. parts are polygons of rings of (x, y), the first ring of each its outline and the others holes; a feature without a polygon has none and no box. The box is the one given, else that of all corners.
    """
    if lines:
        rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.trim("value", F.lit(", \t\r")).alias("line"))
        # a piece has fewer lines than bytes, so that its first byte and a line's place in it order the whole file
        first = rows.groupBy("file", "block").agg(F.min("row").alias("first"))
        features = rows.filter(F.startswith("line", F.lit("{")) & ~F.col("line").rlike(r'^\{\s*"type"\s*:\s*"FeatureCollection"'))
        found = features.join(F.broadcast(first), ["file", "block"]).select("file", (F.col("block") + F.col("row") - F.col("first")).alias("seq"), F.from_json("line", _FEATURE).alias("f"))
    else:
        rows = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", True).json(path)
        found = rows.select(F.col("_metadata.file_name").alias("file"), F.posexplode("features").alias("seq", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    several = F.when(kind == "Polygon", F.array(F.from_json(text, _RINGS))).when(kind == "MultiPolygon", F.from_json(text, f"array<{_RINGS}>"))
    corner = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    parts = F.transform(several, lambda rings: F.transform(rings, lambda ring: F.transform(ring, corner)))
    found = found.select("file", F.col("seq").cast("long").alias("seq"), F.col("f.properties").alias("properties"), F.col("f.bbox").alias("given"), parts.alias("parts"))
    corners = F.flatten(F.flatten("parts"))
    ends = {"west": (F.array_min, "x"), "south": (F.array_min, "y"), "east": (F.array_max, "x"), "north": (F.array_max, "y")}
    box = [F.when(F.size("given") == 4, F.col("given")[k]).otherwise(end(_axis(corners, axis))).alias(name) for k, (name, (end, axis)) in enumerate(ends.items())]
    return found.select("file", "seq", "properties", "parts", *box)


def _axis(corners, axis: str):
    return F.transform(corners, lambda p: p[axis])


def edges_of(features: DataFrame, place, rank, once: bool = False) -> DataFrame:
    """place, rank, shape, x1, y1, x2, y2: a row an edge of every ring of features, as locate() takes them; rings close by themselves.

    With `once`, features whose parts are equal are one: the one of the least rank, then place, with `alike`, how many they are, as locate_counted() counts them. These are written, so that the file is read once.
    """
    shapes, told = features.select(place.alias("place"), rank.alias("rank"), F.xxhash64("file", "seq").alias("shape"), "parts"), ["place", "rank", "shape"]
    if once:
        # the hash in front decides nearly all comparisons of parts when they are sorted
        equal = shapes.groupBy(F.xxhash64("parts").alias("hash"), "parts").agg(F.min(F.struct("rank", "place", "shape")).alias("s"), F.count(F.lit(1)).alias("alike"))
        shapes, told = stashed(equal.select("s.*", "alike", "parts"), "outlines"), [*told, "alike"]
    rings = shapes.select(*told, F.explode(F.flatten("parts")).alias("ring")).filter(F.size("ring") >= 3)
    pairs = F.arrays_zip(F.col("ring").alias("p"), F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)).alias("q"))
    return rings.select(*told, F.explode(pairs).alias("e")).select(*told, F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2")).filter("x1 != x2 or y1 != y2")


def corners_of(features: DataFrame, name) -> DataFrame:
    """name, seq, lon, lat: a row a corner of every ring of features, as clipped() takes them."""
    return features.select(name.alias("name"), F.posexplode(F.flatten(F.flatten("parts"))).alias("seq", "p")).select("name", "seq", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def in_viewport(features: DataFrame, box: tuple[float, float, float, float], most: int = 3000) -> DataFrame:
    """The first features, in the file's order, whose box meets a box (west, south, east, north), at most so many."""
    return features.filter(in_box(box)).orderBy("file", "seq").limit(most)


def collection_lines(features: DataFrame, ordered: bool = False) -> DataFrame:
    """Lines of one collection of features (seq, properties, parts) in the order of seq; `ordered` if they stand so already, by partitions and in them, which saves the sort of their outlines."""
    pair = lambda p: F.array(p["x"], p["y"])
    rings = F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, pair)))
    single = F.size("parts") == 1
    kind, shape = F.when(single, "Polygon").otherwise("MultiPolygon"), F.when(single, F.to_json(rings[0])).otherwise(F.to_json(rings))
    body = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json("properties"), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}}"))
    # as a literal: under a join Spark would drop the order of the features
    first = features.agg(F.min("seq")).first()[0]
    inner = features.select(F.lit(1).alias("k"), "seq", F.concat(F.when(F.col("seq") > F.lit(first), ",").otherwise(""), body).alias("line"))
    ends = features.sparkSession.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "k int, line string").select("k", F.lit(0).cast("long").alias("seq"), "line")
    if ordered:
        return ends.filter("k = 0").unionByName(inner).unionByName(ends.filter("k = 2")).select("line")
    return ends.unionByName(inner).orderBy("k", "seq").select("line")

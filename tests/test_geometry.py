"""Polygons from files and the cell index against a plain ray test, and exact selection against sorting."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civlake.operators import spatial
from civlake.sources import features


def rings(rng, x, y, r, n):
    return [(x + r * rng.uniform(0.5, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.5, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def plain(shapes, lon, lat):
    """Of each point the shapes that hold it, by a ray to the east."""
    out = [set() for _ in lon]
    for k, parts in shapes.items():
        odd = np.zeros(len(lon), int)
        for ring in parts:
            for (x1, y1), (x2, y2) in zip(ring, (*ring[1:], ring[0]), strict=True):
                if y1 != y2:
                    odd += ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
        for i in np.flatnonzero(odd % 2):
            out[i].add(k)
    return out


@pytest.mark.parametrize("cell", [0.05, 0.3, 5.0])
def test_cells_find_what_a_ray_finds(spark, tmp_path, cell):
    rng = random.Random(6)
    shapes = {}
    for k in range(60):
        x, y, r = rng.uniform(-2, 2), rng.uniform(-1, 1), rng.uniform(0.05, 1)
        shapes[k] = [rings(rng, x, y, r, 500), rings(rng, x, y, r / 3, 40)]
    shapes[60] = [[(-1, -1), (1, -1), (1, 1), (-1, 1)], [(-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5)]]  # level and upright edges
    shapes[61] = [[(-1.9, 0.2), (-1.9, 0.2001), (1.9, 0.2001), (1.9, 0.2)]]  # a sliver through many cells
    close = lambda ring: [*map(list, ring), list(ring[0])]
    told = [{"type": "Feature", "properties": {"NAME": f"P{k}", "RANK": k % 4}, "geometry": {"type": "Polygon", "coordinates": [close(r) for r in parts]}} for k, parts in shapes.items()]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": told}))
    found = features.read_features(spark, str(tmp_path / "a.json"))
    edges = features.edges_of(found, F.col("properties")["NAME"], F.col("properties")["RANK"].cast("int"))
    lon = np.array([rng.uniform(-3, 3) for _ in range(1500)] + [0.7] * 500)
    lat = np.array([rng.uniform(-2, 2) for _ in range(1500)] + [rng.uniform(-1.2, 1.2) for _ in range(500)])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))], "id long, lon double, lat double").repartition(3)
    want = plain(shapes, lon, lat)
    got = [set() for _ in lon]
    for r in spatial.locate_all(points, edges, cell=cell).collect():
        got[r["id"]].add(int(r["place"][1:]))
    assert got == want and sum(map(len, want)) > 1000
    best = {r["id"]: r["place"] for r in spatial.locate(points, edges, cell=cell).collect()}
    assert best == {i: min((k % 4, f"P{k}") for k in s)[1] for i, s in enumerate(want) if s}


def test_cells_inside_hold_no_edges_and_border_cells_few(spark):
    ring = tuple((math.cos(2 * math.pi * k / 5000), math.sin(2 * math.pi * k / 5000)) for k in range(5000))
    cover = spatial.cell_cover(spatial.edge_table(spark, [spatial.Polygon("disc", 0, (ring,))]), 0.05)
    sizes = [len(r["shapes"][0]["edges"]) for r in cover.collect()]
    assert sum(s == 0 for s in sizes) > 1000 and max(sizes) < 100 and 5000 < sum(sizes) < 6000


def test_features_of_all_kinds(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]
    hole = [[0.5, 0.25], [0.5, 0.75], [1, 0.75], [0.5, 0.25]]
    told = [
        {"type": "Feature", "properties": {"NAME": "a"}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
        {"type": "Feature", "properties": {"NAME": "b"}, "bbox": [-9, -8, 9, 8], "geometry": {"type": "MultiPolygon", "coordinates": [[square], [[[5, 5], [6, 5], [6, 7.5]]]]}},
        {"type": "Feature", "properties": {"NAME": "c"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [[[5, 5], [6, 5], [6, 7.5]]]]}},
        {"type": "Feature", "properties": None, "geometry": None},
        {"type": "Feature", "properties": {"NAME": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "one.json").write_text(json.dumps({"type": "FeatureCollection", "features": told}))
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps(f) for f in told))
    whole = features.read_features(spark, str(tmp_path / "one.json"))
    boxes = [tuple(r) for r in whole.orderBy("seq").select("west", "south", "east", "north").collect()]
    assert boxes == [(0, 0, 2, 1), (-9, -8, 9, 8), (0, 0, 6, 7.5), (None,) * 4, (None,) * 4]
    by_line = features.read_features(spark, str(tmp_path / "lines.jsonl"), lines=True)
    assert [tuple(r) for r in by_line.orderBy("seq").select("west", "south", "east", "north").collect()] == boxes
    seen = features.in_viewport(whole, (2, 1, 3, 3), 2)
    assert [r["properties"]["NAME"] for r in seen.collect()] == ["a", "b"]  # an edge that touches counts; c is beyond the most
    edges = features.edges_of(whole, F.col("properties")["NAME"], F.lit(0))
    points = spark.createDataFrame([(1, 0.7, 0.6), (2, 0.6, 0.3), (3, 0.55, 0.4), (4, 5.9, 5.1), (5, 9.0, 9.0)], "id long, lon double, lat double")
    held = {i: sorted(r["place"] for r in spatial.locate_all(points, edges, cell=0.3).collect() if r["id"] == i) for i in range(1, 6)}
    assert held == {1: ["b", "c"], 2: ["a", "b", "c"], 3: ["b", "c"], 4: ["b", "c"], 5: []}
    lines = [r["line"] for r in features.collection_lines(whole.filter("parts is not null")).collect()]
    again = json.loads("".join(lines))
    assert [f["geometry"]["type"] for f in again["features"]] == ["Polygon", "MultiPolygon", "MultiPolygon"] and again["features"][0]["geometry"]["coordinates"][0] == [[float(v) for v in p] for p in square]


def test_a_clip_without_a_mask_goes_by_the_box(spark):
    shapes = spark.createDataFrame([("in", 0.5, 0.5), ("edge", 1.0, 0.0), ("out", 2.0, 0.5), ("unknown", None, None)], "name string, lon double, lat double")
    corners = spark.createDataFrame([("in", 0, 0.1, 0.1), ("unknown", 0, 0.2, 0.2), ("unknown", 1, 0.3, 0.3)], "name string, seq int, lon double, lat double")
    got = {r["name"]: tuple(r)[1:] for r in spatial.clipped(shapes, corners, None, box=(0, 0, 1, 1)).collect()}
    assert got == {"in": (True, 0, 1), "edge": (True, 0, 0), "out": (False, 0, 0), "unknown": (False, 0, 2)}
    with pytest.raises(ValueError, match="neither"):
        spatial.clipped(shapes, corners, None)


def test_selection_is_the_sorted_value_for_any_values(spark, monkeypatch):
    from civlake.operators import ranking

    rng = random.Random(1)
    rows = []
    for k in range(30):
        for _ in range(rng.choice([1, 2, 7, 100, 900])):
            rows.append((k, "x" if k % 2 else "y", rng.choice([rng.random() * 1e-9, rng.random() * 1e12, -rng.random(), float(rng.randrange(3)), None, 10.0 ** rng.randrange(-300, 300)])))
    rows += [(99, "x", None)] * 5 + [(98, "x", 4.0)] * 2000 + [(98, "x", 5.0)] * 2001
    df = spark.createDataFrame(rows, "k int, c string, v double").repartition(3)
    want = {}
    for key in {r[:2] for r in rows}:
        values = sorted(r[2] for r in rows if r[:2] == key and r[2] is not None)
        if values:
            want[key] = values[len(values) // 2]
    for ordered, parts in ((4096, 32), (5, 8)):
        monkeypatch.setattr(ranking, "ORDERED", ordered)
        monkeypatch.setattr(ranking, "PARTS", parts)
        assert {tuple(r)[:2]: r["upper_median"] for r in ranking.upper_median(df, ["k", "c"], "v").collect()} == want
    tenth = {tuple(r)[:2]: r["v10"] for r in ranking.selected(df, ["k", "c"], "v", lambda n: F.lit(10).cast("long"), "v10").collect()}
    assert (98, "x") in tenth and tenth[98, "x"] == 4.0 and all(sum(r[:2] == key and r[2] is not None for r in rows) > 10 for key in tenth)
    assert ranking.upper_median(df.limit(0), ["k"], "v").collect() == []

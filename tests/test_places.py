"""The nearest place against brute force."""

import math
import random

from convolens.sources.contacts import nearest_place

SCHEMA = "lat double, lon double, city string, admin string, country_code string"


def half(a, b):
    y, x, v, u = map(math.radians, (*a, *b))
    return math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2


def test_nearer_place_outside_the_cells(spark):
    g = spark.createDataFrame([(68.01, 20.5, "Far", "", "SE"), (69.5, 22.1, "Near", "", "NO"), (10.0, -179.9, "East", "", "FJ"), (10.0, 178.2, "West", "", "FJ")], SCHEMA)
    p = spark.createDataFrame([(1, 69.5, 20.5), (2, 10.0, 179.9), (3, None, None)], "k long, lat double, lon double")
    assert {r.k: r.place.split()[0] for r in nearest_place(p, g, "k").collect()} == {1: "Near", 2: "East"}


def test_dense_gazetteer(spark):
    r = random.Random(3)
    spot = lambda: (r.choice([r.uniform(-90, 90), r.uniform(60, 90)]), r.choice([r.uniform(-180, 180), r.uniform(178, 180), r.uniform(-180, -178)]))
    places = [(*spot(), f"p{i}", "", "XX") for i in range(1500)]
    points = [(i, *spot()) for i in range(400)] + [(400, 90.0, 0.0), (401, -90.0, 5.0), (402, 0.0, 180.0), (403, 0.0, -180.0)]
    got = {x.k: x.place.split()[0] for x in nearest_place(spark.createDataFrame(points, "k long, lat double, lon double"), spark.createDataFrame(places, SCHEMA), "k").collect()}
    at = {c: (y, x) for y, x, c, *_ in places}
    assert got.keys() == {k for k, *_ in points}
    for k, *p in points:
        assert half(p, at[got[k]]) <= min(half(p, q) for q in at.values()) + 1e-15

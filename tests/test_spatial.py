"""Tiles and the packed index against plain versions of the whole."""

import math
import random
import time

import numpy as np
import pytest

from rillmark.operators import scattered, spatial


def plain_smooth(cells, nx, ny, sigma):
    radius = int(4.0 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    held = np.zeros((2, nx, ny))
    for (x, y), z in cells.items():
        held[:, x, y] = z, 1
    for axis in (1, 2):
        n = held.shape[axis]
        held = sum(k * held.take(np.clip(np.arange(n) + d, 0, n - 1), axis=axis) for d, k in zip(range(-radius, radius + 1), w, strict=True))
    return {(x, y): held[0, x, y] / held[1, x, y] for x in range(nx) for y in range(ny) if held[1, x, y] > 0}


@pytest.mark.parametrize(("nx", "ny", "sigma", "tile"), [(23, 17, 1.2, 5), (40, 9, 0.5, 8), (12, 30, 3.0, 1), (6, 5, 4.0, 256)])
def test_tiles_smooth_as_the_whole_grid(spark, nx, ny, sigma, tile):
    r = random.Random(nx)
    cells = {(x, y): r.gauss(0, 1) for x in range(nx) for y in range(ny) if r.random() < 0.4 and x < nx - 8}
    rows = [(x, y, z, "other") for (x, y), z in cells.items()] + [(0, 0, None, "none"), (-1, 3, 9.0, "outside"), (nx, 0, 9.0, "outside")]
    cells_df = spark.createDataFrame([r for r in rows if not (r[2] is None and (0, 0) in cells)], "ix int, iy int, z double, tx string").repartition(3)
    got = {(r.ix, r.iy): r.z for r in spatial.smoothed(cells_df, nx, ny, sigma, tile=tile).collect()}
    want = plain_smooth(cells, nx, ny, sigma)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_a_million_cells_are_smoothed_in_seconds(spark):
    grid = spark.range(1_000_000).selectExpr("cast(id % 1000 AS int) AS ix", "cast(id div 1000 AS int) AS iy", "rand(3) AS z")
    began = time.time()
    assert spatial.smoothed(grid, 1000, 1000, 2.0).count() == 1_000_000
    assert time.time() - began < 60


def plain_nearest(points, targets):
    out = {}
    for key, x, y in points:
        best = min(((math.sqrt((x - a) ** 2 + (y - b) ** 2), label) for label, a, b in targets), default=(None, None)) if x is not None and y is not None else (None, None)
        out[key] = (best[1], best[0])
    return out


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_nearest_equals_brute_force(spark, chunk):
    r = random.Random(3)
    at = lambda: (r.gauss(0, 1) * r.choice([1, 1, 100]), float(r.randint(-3, 3)))
    targets = [(f"t{i}", *at()) for i in range(200)] + [(f"u{i}", 0.5, 0.5) for i in range(40)] + [("s1", 1.0, 0.0), ("s2", -1.0, 0.0)]
    points = [(i, *at()) for i in range(300)] + [(1000, 0.0, 0.0), (1001, 1e6, -1e6), (1002, 0.5, 0.5), (1003, None, 1.0), (1004, 0.25, None)]
    points_df = spark.createDataFrame([(*p, None) for p in points], "id long, x double, y double, distance string").repartition(3)
    odd = [("v", None, 1.0), ("w", math.nan, 1.0), (None, 0.0, 0.0)]
    targets_df = spark.createDataFrame([(*t, "z") for t in targets + odd], "station string, x double, y double, key string").repartition(2)
    if chunk == 7:
        targets, targets_df = targets[:60], spark.createDataFrame([(*t, "z") for t in targets[:60] + odd], "station string, x double, y double, key string")
        chunk = 25
    got = {q.id: (q.station, q.distance) for q in spatial.nearest(points_df, targets_df, "id", "station", chunk).collect()}
    assert got == plain_nearest(points, targets)
    assert {(q.station, q.distance) for q in spatial.nearest(points_df, targets_df.limit(0), "id", "station").collect()} == {(None, None)}


def test_an_index_of_a_million_targets():
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.normal(size=(700_000, 2)), rng.normal(size=(300_000, 2)) * 0.001 + 5])
    packed = spatial.Packed(xy, np.arange(len(xy)))
    points = np.vstack([rng.normal(size=(3000, 2)) * 3, rng.normal(size=(500, 2)) * 1000])
    began = time.time()
    number, distance = packed.nearest(points)
    assert time.time() - began < 30
    for i in range(0, len(points), 70):
        apart = np.sqrt(((xy - points[i]) ** 2).sum(axis=1))
        assert distance[i] == apart.min() and number[i] == apart.argmin()


def test_hull_holds_all_points():
    rng = np.random.default_rng(2)
    for xy in (rng.normal(size=(3000, 2)), rng.random((50, 2)), np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]), np.array([[1.0, 1.0]]), np.array([[x, y] for x in range(5) for y in range(5)], float)):
        corners = scattered.hull(xy)
        assert {tuple(c) for c in corners} <= {tuple(p) for p in xy}
        if len(corners) > 2:
            assert all((scattered._left(a, b, xy) >= -1e-9).all() for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True))


@pytest.mark.parametrize("tile", [40, 20_000])
def test_tiles_interpolate_as_whole_triangulations(spark, tile):
    rng = np.random.default_rng(7)
    surveys = {1: rng.random((400, 2)), 2: np.vstack([rng.normal(size=(150, 2)), rng.normal(size=(100, 2)) * 0.01 + 3]), 3: np.array([[0.0, 0.0], [1.0, 2.0]]), 4: np.array([[float(i), 2.0 * i] for i in range(6)])}
    points, targets, want = [], [], {}
    for k, xy in surveys.items():
        z = np.sin(xy[:, 0] * 3) + xy[:, 1]
        at = np.vstack([rng.random((60, 2)) * 1.6 - 0.3, xy[:5], rng.normal(size=(10, 2)) * 5])
        points += [(k, *map(float, p), float(v)) for p, v in zip(xy, z, strict=True)]
        targets += [(k, 1000 * k + i, *map(float, p)) for i, p in enumerate(at)]
        want |= {1000 * k + i: v for i, v in enumerate(scattered.interpolate(xy, z, at))}
    points += [(1, *map(float, surveys[1][0]), points[0][3]), (1, None, 1.0, 1.0), (1, 0.5, 0.5, None)]
    targets += [(9, 9000, 0.0, 0.0), (1, 9001, None, 0.5)]
    points_df = spark.createDataFrame(points, "scan int, x double, y double, z double").repartition(3)
    targets_df = spark.createDataFrame(targets, "scan int, id long, x double, y double").repartition(2)
    got = {r.id: r.z for r in scattered.scattered(points_df, targets_df, "scan", tile).collect()}
    assert got.keys() == want.keys() | {9000, 9001} and got[9000] is None and got[9001] is None
    assert all(got[i] == pytest.approx(v, rel=1e-6, abs=1e-9) for i, v in want.items())


def test_a_survey_of_a_million_points_is_interpolated(spark):
    points = spark.range(1_000_000).selectExpr("1 AS scan", "rand(1) AS x", "rand(2) AS y").selectExpr("*", "2 * x - 3 * y AS z")
    targets = spark.range(2000).selectExpr("1 AS scan", "id", "rand(5) AS x", "rand(6) AS y")
    began = time.time()
    off = scattered.scattered(points, targets, "scan").selectExpr("max(abs(z - (2 * x - 3 * y))) AS off", "count(z) AS n").first()
    assert off.n == 2000 and off.off < 0.02 and time.time() - began < 300


def test_targets_share_triangulations():
    rng = np.random.default_rng(11)
    xy = rng.normal(size=(200, 2))
    z, at = np.sin(xy[:, 0] * 3) + xy[:, 1], rng.normal(size=(5000, 2))
    began = time.time()
    got, settled = scattered.Local(xy, z).at(at)
    assert time.time() - began < 15 and settled.all()  # one by one, 33 ms each before
    assert got[:200] == pytest.approx(scattered.interpolate(xy, z, at[:200]), rel=1e-9)


def test_targets_at_one_place_are_settled_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    points = spark.createDataFrame([(k, *map(float, p)) for k in (1, 2) for p in rng.random((50, 3))], "scan int, x double, y double, z double")
    targets = spark.range(6000).selectExpr("cast(1 + id % 2 AS int) AS scan", "id", "cast(id % 7 AS float) / 8 AS x", "id % 5 / 8D AS y", "0 AS z")
    monkeypatch.setattr(scattered, "TARGETS", 100)
    asked = spark.sparkContext.accumulator(0)

    class Counted(scattered.Local):
        def at(self, targets):
            asked.add(len(targets))
            return super().at(targets)

    monkeypatch.setattr(scattered, "Local", Counted)
    got = scattered.scattered(points, targets, "scan").collect()
    assert len({r.id for r in got}) == len(got) == 6000 and all(r.z is not None for r in got)
    assert len({(r.scan, r.x, r.y, r.z) for r in got}) == 70 and asked.value == 70

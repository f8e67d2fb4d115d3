"""The area of a union against integration over many meridians."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from marshlight.functions import constants as K
from marshlight.functions import geo
from marshlight.operators import footprint


def star(lon, lat, size, corners):
    angles = sorted(random.uniform(0, 2 * math.pi) for _ in range(corners))
    ring = [(lon + size * random.uniform(0.3, 1) * math.cos(a), lat + size * random.uniform(0.3, 1) * math.sin(a)) for a in angles]
    return [*ring, ring[0]]


def brute(polygons, samples=40_000):
    """Sum over meridians of the length that any polygon covers there, by the even-odd rule for each."""
    xs = [x for p in polygons for r in p for x, _ in r]
    low, width = min(xs), max(xs) - min(xs)
    total = 0.0
    for x in low + (np.arange(samples) + 0.5) * width / samples:
        spans = []
        for p in polygons:
            ys = sorted(y1 + (y2 - y1) * (x - x1) / (x2 - x1) for r in p for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False) if (x1 <= x) != (x2 <= x))
            spans += list(zip(ys[::2], ys[1::2], strict=True))
        reach = -90.0
        for a, b in sorted(spans):
            if b > reach:
                total += math.sin(math.radians(b)) - math.sin(math.radians(max(a, reach)))
                reach = b
    return total * math.radians(width / samples) * K.EARTH_RADIUS_KM**2


def table(spark, polygons):
    listed = [([[[{"lon": float(x), "lat": float(y)} for x, y in r] for r in p] for p in polygons[k : k + 2]],) for k in range(0, len(polygons), 2)]
    return spark.createDataFrame(listed, f"polygons {geo.POLYGONS}")


@pytest.mark.parametrize(("most", "cell"), [(512, 0.25), (30, 0.4)])
def test_random_polygons(spark, most, cell):
    """Stars and polygons with holes, some given twice; with few edges allowed a cell is split again and again."""
    random.seed(most)
    polygons = [[star(random.uniform(-121.5, -120.9), random.uniform(37.4, 37.9), random.choice([0.02, 0.1, 0.25]), random.randint(3, 9))] for _ in range(24)]
    square = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]
    polygons += [[square(-121.9, 37.5, 0.3), square(-121.8, 37.6, 0.1)[::-1]], [square(-121.9, 37.5, 0.3), square(-121.8, 37.6, 0.1)], [square(-121.85, 37.62, 0.2)]] + polygons[:3]
    got = footprint.footprint_area(table(spark, polygons), cell, most).first()[0]
    assert got == pytest.approx(brute(polygons, 8_000), rel=2e-4)


def test_many_on_one_spot(spark):
    """More polygons on one spot than a cell may hold: those that cover it settle it."""
    square = lambda d: [(-121.0 - d, 37.6 - d), (-120.9 + d, 37.6 - d), (-120.9 + d, 37.7 + d), (-121.0 - d, 37.7 + d), (-121.0 - d, 37.6 - d)]
    polygons = [[square(k / 4000)] for k in range(60)] * 2
    got = footprint.footprint_area(table(spark, polygons), 0.25, 40).first()[0]
    side = math.radians(0.1 + 2 * 59 / 4000)
    want = side * (math.sin(math.radians(37.7 + 59 / 4000)) - math.sin(math.radians(37.6 - 59 / 4000))) * K.EARTH_RADIUS_KM**2
    assert got == pytest.approx(want, rel=1e-9)


def test_edges(spark):
    assert footprint.footprint_area(table(spark, [])).first()[0] == 0.0
    flat = [[[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]], [[(5.0, 1.0), (5.0, 2.0), (5.0, 1.0), (5.0, 1.0)]]]
    assert footprint.footprint_area(table(spark, flat)).first()[0] == 0.0
    one = [[[(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1), (-0.1, -0.1)]]]  # over four cells
    assert footprint.footprint_area(table(spark, one)).first()[0] == pytest.approx(math.radians(0.2) * 2 * math.sin(math.radians(0.1)) * K.EARTH_RADIUS_KM**2, rel=1e-9)


def test_only_polygons_of_cells_that_are_split_are_kept(spark, monkeypatch):
    """What overlapping polygons write shrinks from split to split; neither a piece for every cell nor those of a settled cell are kept."""
    kept, stored = [], footprint.stored

    def noted(rows, label):
        out = stored(rows, label)
        kept.append((label, out.count()))
        return out

    monkeypatch.setattr(footprint, "stored", noted)
    square = lambda x, y: [(x, y), (x + 0.2, y), (x + 0.2, y + 0.2), (x, y + 0.2), (x, y)]
    polygons = [[square(-121.4 + i / 200, 37.6 + j / 200)] for i in range(20) for j in range(20)]
    got = footprint.footprint_area(table(spark, polygons), 0.25, 40).first()[0]
    side = 0.2 + 19 / 200
    assert got == pytest.approx(math.radians(side) * (math.sin(math.radians(37.6 + side)) - math.sin(math.radians(37.6))) * K.EARTH_RADIUS_KM**2, rel=1e-9)
    edges = [n for label, n in kept if "many" not in label and "cells" not in label]
    assert sum(edges) < 12 * len(polygons)


def test_a_ring_that_goes_round_twice_covers_nothing(spark):
    """By the even-odd rule; also where no edge of it lies inside a cell."""
    square = [(-121.4, 37.6), (-120.9, 37.6), (-120.9, 38.1), (-121.4, 38.1)]
    assert footprint.footprint_area(table(spark, [[[*square, *square, square[0]]]]), 0.25).first()[0] == pytest.approx(0, abs=1e-9)

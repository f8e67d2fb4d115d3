"""The ground that polygons cover together: the area of their union, without comparing pairs of them."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marshlight.functions import constants as K
from marshlight.functions import geo
from marshlight.functions.text import let
from marshlight.session import stored

#: Degrees of a cell, edges that one cell is swept with, into how many columns and rows a cell with more is split, and how often.
CELL, MOST_EDGES, PARTS, SPLITS = 0.25, 512, 4, 10
_KM2 = K.EARTH_RADIUS_KM**2
EDGE = ("x1", "y1", "x2", "y2", "way")


def _edge(*values: Column) -> Column:
    return F.struct(*(v.alias(n) for v, n in zip(values, EDGE, strict=True)))


def _edges(shapes: DataFrame) -> DataFrame:
    """(es): a polygon's edges from west to east. ``way``: 1 if the ring goes to the east here, -1 to the west. Edges that go due north
    or south bound nothing on their own and are left out."""
    rings = F.filter(F.transform("p", lambda r, i: F.when(i == 0, geo.orient(r, True)).otherwise(geo.orient(r, False))), lambda r: F.size(r) > 3)
    pairs = F.flatten(F.transform(rings, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(F.get(r, i).alias("a"), F.get(r, i + 1).alias("b")))))
    east = lambda e: _edge(e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"], F.lit(1))
    west = lambda e: _edge(e["b"]["lon"], e["b"]["lat"], e["a"]["lon"], e["a"]["lat"], F.lit(-1))
    es = F.transform(F.filter(pairs, lambda e: e["a"]["lon"] != e["b"]["lon"]), lambda e: F.when(e["a"]["lon"] < e["b"]["lon"], east(e)).otherwise(west(e)))
    return shapes.filter("polygons is not null").select(F.explode("polygons").alias("p")).select(es.alias("es")).filter(F.size("es") > 0)


def _cut(es: Column, west: Column, east: Column) -> Column:
    """Edges cut at two meridians; those that have no length there go."""

    def cut(e: Column) -> Column:
        slope = (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
        y1 = F.when((e["x1"] >= west) | (e["y1"] == e["y2"]), e["y1"]).otherwise(e["y1"] + slope * (west - e["x1"]))
        y2 = F.when((e["x2"] <= east) | (e["y1"] == e["y2"]), e["y2"]).otherwise(e["y1"] + slope * (east - e["x1"]))
        return _edge(F.greatest(e["x1"], west), y1, F.least(e["x2"], east), y2, e["way"])

    return F.transform(F.filter(es, lambda e: (e["x1"] < east) & (e["x2"] > west)), cut)


def _flat(es: Column, south: Column, north: Column) -> Column:
    """Edges wholly under a cell on its southern side and those wholly over it on its northern: polygons that differ only elsewhere are equal here."""

    def flat(e: Column) -> Column:
        at = lambda y: _edge(e["x1"], y, e["x2"], y, e["way"])
        return F.when(F.greatest(e["y1"], e["y2"]) <= south, at(south)).when(F.least(e["y1"], e["y2"]) >= north, at(north)).otherwise(e)

    return F.transform(es, flat)


def _share(es: Column, south: Column, north: Column, cell: float) -> Column:
    """Of a polygon without an edge inside a cell the part of the cell's width that it covers, 0 to 1 by the even-odd rule, else null."""
    inside = F.exists(es, lambda e: (F.greatest(e["y1"], e["y2"]) > south) & (F.least(e["y1"], e["y2"]) < north))
    under = F.aggregate(es, F.lit(0.0), lambda total, e: total + F.when(F.greatest(e["y1"], e["y2"]) <= south, e["way"] * (e["x2"] - e["x1"])).otherwise(0.0))
    return let(F.when(~inside, F.abs(under) / cell), lambda n: F.when(F.abs(n - F.round(n)) < 1e-9, F.pmod(F.round(n), F.lit(2.0))).otherwise(n))


def _in_cells(rows: DataFrame, cell: float, of_cells: bool) -> DataFrame:
    """(ix, iy, es, share): a row for each cell in which a polygon has ground or ends, with its edges there. ``of_cells``: rows are polygons in cells that are
    ``PARTS`` times as wide. A polygon stays one row, so what it covers is known without a shuffle."""
    number = lambda x: F.floor(x / cell)
    least = lambda *names: F.array_min(F.transform("es", lambda e: F.least(*(e[n] for n in names)) if len(names) > 1 else e[names[0]]))
    most = lambda *names: F.array_max(F.transform("es", lambda e: F.greatest(*(e[n] for n in names)) if len(names) > 1 else e[names[0]]))

    def numbers(low: Column, high: Column, parent: str) -> Column:
        low, high = number(low), number(high)
        if of_cells:
            low, high = (F.least(F.greatest(n, F.col(parent) * PARTS), F.col(parent) * PARTS + (PARTS - 1)) for n in (low, high))
        return F.sequence(low, high)

    kept = ["py"] if of_cells else []
    rows = rows.withColumnsRenamed({"ix": "px", "iy": "py"}) if of_cells else rows
    columns = F.transform(numbers(least("x1"), most("x2"), "px"), lambda ix: F.struct(ix.alias("ix"), _cut(F.col("es"), ix * cell, (ix + 1) * cell).alias("es")))
    rows = rows.select(*kept, F.explode(columns).alias("c")).select(*kept, "c.ix", "c.es")

    def part(iy: Column) -> Column:
        south, north = iy * cell, (iy + 1) * cell
        return let(_flat(F.col("es"), south, north), lambda es: F.struct(iy.alias("iy"), es.alias("es"), _share(es, south, north, cell).alias("share")))

    cells = F.transform(numbers(least("y1", "y2"), most("y1", "y2"), "py"), part)
    return rows.select("ix", F.explode(cells).alias("c")).select("ix", "c.iy", "c.es", "c.share").filter("share is null or share > 0")


def _under(x: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Square kilometres between the equator and straight lines from latitude y1 to y2 over x degrees of longitude."""
    a, b = np.radians(y1), np.radians(y2)
    rise = b - a
    level = np.abs(rise) < 1e-9
    mean = np.where(level, np.sin((a + b) / 2), (np.cos(a) - np.cos(b)) / np.where(level, 1, rise))
    return _KM2 * np.radians(x) * mean


def union_area(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, poly: np.ndarray, south: float, north: float) -> float:
    """Area covered between two parallels by polygons given by their edges (x1 < x2), each by the even-odd rule.

    Slabs lie between the meridians of all ends and crossings, so in a slab no edge crosses another: the edges of a polygon, from
    south to north, are the sides of what it covers, and joined intervals stay joined throughout the slab.
    """
    slope = (y2 - y1) / (x2 - x1)
    lift = y1 - slope * x1
    with np.errstate(divide="ignore", invalid="ignore"):
        crossing = (lift[None, :] - lift[:, None]) / (slope[:, None] - slope[None, :])
        levels = np.concatenate([(south - lift) / slope, (north - lift) / slope])
    fits = (crossing > np.maximum(x1[:, None], x1[None, :])) & (crossing < np.minimum(x2[:, None], x2[None, :]))
    own = np.concatenate([(levels[: len(x1)] > x1) & (levels[: len(x1)] < x2), (levels[len(x1) :] > x1) & (levels[len(x1) :] < x2)])
    xs = np.unique(np.concatenate([x1, x2, crossing[fits], levels[own]]))
    total = 0.0
    for a, b in zip(xs[:-1], xs[1:], strict=True):
        on = np.flatnonzero((x1 <= a) & (x2 >= b))
        if not len(on):
            continue
        low, high = np.clip(slope[on] * a + lift[on], south, north), np.clip(slope[on] * b + lift[on], south, north)
        order = np.lexsort((slope[on] * ((a + b) / 2) + lift[on], poly[on]))
        low, high, owner = low[order], high[order], poly[on][order]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        nth = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        bottom = np.flatnonzero((nth % 2 == 0) & np.append(owner[1:] == owner[:-1], False))
        l1, l2, u1, u2 = low[bottom], high[bottom], low[bottom + 1], high[bottom + 1]
        middle, upper = l1 + l2, u1 + u2
        rank = np.lexsort((upper, middle))
        reach = np.maximum.accumulate(upper[rank])
        begins = np.append(True, middle[rank][1:] > reach[:-1])
        starts = np.flatnonzero(begins)
        for s, e in zip(starts, np.append(starts[1:], len(rank)), strict=True):
            top = rank[s:e][np.argmax(upper[rank[s:e]])]
            total += float(_under(b - a, u1[top], u2[top]) - _under(b - a, l1[rank[s]], l2[rank[s]]))
    return total


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def area(rows: pd.DataFrame) -> float:
        south, cell = float(rows["iy"].iloc[0]) * float(rows["cell"].iloc[0]), float(rows["cell"].iloc[0])
        return union_area(*(rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2")), rows["poly"].to_numpy(), south, south + cell)

    for batch in batches:
        done = []
        for key, rows in batch.groupby(["cell", "ix", "iy"], sort=False):
            if held and tuple(held[0][["cell", "ix", "iy"]].iloc[0]) != key:
                done.append(area(pd.concat(held)))
                held = []
            held.append(rows)
        yield pd.DataFrame({"area": done}, dtype=float)
    if held:
        yield pd.DataFrame({"area": [area(pd.concat(held))]})


def footprint_area(shapes: DataFrame, cell: float = CELL, most_edges: int = MOST_EDGES) -> DataFrame:
    """One row, footprint_sq_km: the area of the union of all polygons of ``shapes`` (polygons) on the sphere, edges being straight in degrees.

    The plane is cut into cells of ``cell`` degrees, and each cell is swept by itself with the edges in it. A cell with more than
    ``most_edges`` is split in 16, and again, in Spark: one polygon that covers a part settles it, polygons that are equal there
    count once, and those outside of it leave it, so a task holds a bounded number of edges however many polygons lie on one
    another. Of polygons only those in cells that are still to be split move or are written.
    """
    rows, areas, leaves = stored(_edges(shapes), "footprint"), [], []
    for split in range(SPLITS + 1):
        parts = _in_cells(rows, cell, split > 0)
        whole = F.coalesce(F.bool_or(F.col("share") == 1), F.lit(False))
        cells = stored(parts.groupBy("ix", "iy").agg(F.sum(F.size("es")).alias("n"), whole.alias("whole")), "footprint-cells")
        areas.append(cells.filter("whole").select((F.radians(F.lit(cell)) * (F.sin(F.radians((F.col("iy") + 1) * cell)) - F.sin(F.radians(F.col("iy") * cell))) * _KM2).alias("area")))
        many = F.col("n") > (most_edges if split < SPLITS else 1 << 62)
        of = lambda which, parts=parts, cells=cells: parts.join(cells.filter(~F.col("whole") & which).select("ix", "iy"), ["ix", "iy"], "left_semi").select("ix", "iy", "es")
        leaves.append(of(~many).select(F.lit(cell).alias("cell"), "ix", "iy", "es"))
        if cells.filter(~F.col("whole") & many).isEmpty():
            break
        rows, cell = stored(of(many).distinct(), "footprint"), cell / PARTS
    every = functools.reduce(DataFrame.unionByName, [_swept(functools.reduce(DataFrame.unionByName, leaves)), *areas])
    return every.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("footprint_sq_km"))


def _swept(leaves: DataFrame) -> DataFrame:
    rows = leaves.repartition("cell", "ix", "iy").sortWithinPartitions("cell", "ix", "iy")
    rows = rows.withColumn("poly", F.monotonically_increasing_id()).select("cell", "ix", "iy", "poly", F.inline("es"))
    return rows.mapInPandas(_sweep, "area double")

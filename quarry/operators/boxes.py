"""The smallest box around each point, by a grid whose cells are as fine as points and boxes are dense.

Space is quartered again and again (Z-order codes of LEVELS bits a side); a cell is split as long as it holds more than its share of points
and box corners. At most n / limit cells of a level are split, which is CELLS at most, so the tree's split cells (LEVELS * CELLS numbers at
most) are known to every task. A box is laid over the tree from the top: where it covers a whole cell it stops there, and only the
smallest such box of a cell counts; where it covers a part of a leaf it is a candidate for the points in that leaf, which meet them by area, smallest
first, and leave with the first that holds them. Only where more points than a cell's share lie within 2**-LEVELS of the range of each other is a leaf crowded.

A null or non-finite coordinate has no container; a box with such a side, or with a side that ends before it begins, holds nothing. Sides belong to the box. Of boxes
of one area the smallest id wins. Points at one place are looked up once. Empty tables give an empty result or points without box.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.scratch import cut, spend

LEVELS, ROUND, CELLS, LEAST = 28, 7, 16_384, 500
SIDE = 1 << LEVELS


def _finite(*names: str) -> Column:
    good = F.lit(True)
    for n in names:
        good = good & (F.abs(n) < float("inf"))
    return good


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of v, a nought between any two."""
    v = v.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << shift)) & mask
    return v


class Grid:
    """Columns and rows of the finest cells over the range of the points, and the tree of cells once `split` is known."""

    def __init__(self, bounds, split: list[np.ndarray] | None = None):
        self.bounds, self.low, self.high = bounds, np.array(bounds[:2]), np.array(bounds[2:])
        self.split, self.sets = split, [set(cells.tolist()) for cells in split or ()]

    def steps(self, values: np.ndarray, axis: int) -> np.ndarray:
        """The column (axis 0) or row of values within the range; never falls as values grow, so comparing steps is safe."""
        half = self.high[axis] / 2 - self.low[axis] / 2  # halves, as the range of doubles may overflow
        part = (values / 2 - self.low[axis] / 2) / half if half > 0 else np.zeros(len(values))
        return np.clip(np.floor(part * SIDE), 0, SIDE - 1).astype(np.int64)

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _spread(self.steps(x, 0)) | (_spread(self.steps(y, 1)) << 1)

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The name of the leaf that each code lies in: its level, then its code at that level."""
        level = np.zeros(len(codes), np.int64)
        for k, cells in enumerate(self.split):  # a split cell lies in split cells, so their number is the level
            if not len(cells):
                break
            up = codes >> 2 * (LEVELS - k)
            level += cells[np.minimum(np.searchsorted(cells, up), len(cells) - 1)] == up
        return (level << 2 * LEVELS) | (codes >> 2 * (LEVELS - level))

    def spans(self, low: np.ndarray, high: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last steps that sides reach; one beyond the range where a side reaches all of it. A side that lies outside is (SIDE, -1)."""
        first = np.where(low <= self.low[axis], -1, self.steps(low, axis))
        last = np.where(high >= self.high[axis], SIDE, self.steps(high, axis))
        outside = (high < self.low[axis]) | (low > self.high[axis])
        return np.where(outside, SIDE, first), np.where(outside, -1, last)

    def laid(self, left: int, right: int, low: int, high: int) -> list[tuple[int, bool]]:
        """(cell, whole) for a box from step left to right and from low to high: the cells that it covers whole, none inside another, and leaves that it covers in part."""
        out, todo = [], [(0, 0, 0, 0)] if left <= right and low <= high else []
        while todo:
            level, code, column, row = todo.pop()
            size = SIDE >> level
            x, y = column * size, row * size
            if left > x + size - 1 or right < x or low > y + size - 1 or high < y:
                continue
            whole = left < x and right > x + size - 1 and low < y and high > y + size - 1
            if whole or level == LEVELS or code not in self.sets[level]:
                out.append(((level << 2 * LEVELS) | code, whole))
            else:
                todo += [(level + 1, code * 4 + q, column * 2 + (q & 1), row * 2 + (q >> 1)) for q in range(4)]
        return out


def _coded(grid: Grid, names, name: str, of):
    def run(batches):
        for b in batches:
            x, y = (b.column(n).to_numpy(zero_copy_only=False) for n in names)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of(grid, grid.codes(x, y)))], names=[*b.schema.names, name])

    return run


def _lay(grid: Grid):
    def run(batches):
        for b in batches:
            x0, y0, x1, y1 = (b.column(n).to_numpy(zero_copy_only=False) for n in ("x0", "y0", "x1", "y1"))
            nth, cells, whole = [], [], []
            for k, box in enumerate(zip(*(v.tolist() for v in (*grid.spans(x0, x1, 0), *grid.spans(y0, y1, 1))))):
                for cell, w in grid.laid(*box):
                    nth.append(k), cells.append(cell), whole.append(w)
            taken = b.take(pa.array(nth, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells, pa.int64()), pa.array(whole, pa.bool_())], names=[*b.schema.names, "cell", "whole"])

    return run


#: Points that a task holds against one stretch of boxes, and boxes of the first stretch.
POINTS, STRETCH = 1 << 15, 32


def _first_box(points: pa.Table, boxes: pa.Table) -> pa.Table:
    """x, y, box of the points of a leaf that a box of it holds. Boxes come by area, so a point is done with the first that holds it; no pair is kept."""
    names = ["x", "y", "box"]
    if not len(points) or not len(boxes):
        return pa.Table.from_arrays([points.column("x").slice(0, 0), points.column("y").slice(0, 0), boxes.column("box").slice(0, 0)], names=names)
    held = boxes.column("box").combine_chunks()
    keys = pa.Table.from_arrays(held.flatten(), names=[str(k) for k in range(held.type.num_fields)])
    order = pc.sort_indices(keys, sort_keys=[(k, "ascending") for k in keys.column_names])
    left, low, right, high = (boxes.column(c).to_numpy()[order.to_numpy()] for c in ("x0", "y0", "x1", "y1"))
    xs, ys = points.column("x").to_numpy(), points.column("y").to_numpy()
    found = np.full(len(xs), -1)
    for p in range(0, len(xs), POINTS):
        todo, begin, stretch = np.arange(p, min(p + POINTS, len(xs))), 0, STRETCH
        while len(todo) and begin < len(left):
            s = slice(begin, begin + stretch)
            x, y = xs[todo, None], ys[todo, None]
            hit = (x >= left[s]) & (x <= right[s]) & (y >= low[s]) & (y <= high[s])
            met = hit.any(axis=1)
            found[todo[met]] = begin + hit[met].argmax(axis=1)
            todo, begin = todo[~met], begin + stretch
            stretch = max(STRETCH, STRETCH * POINTS // max(1, len(todo)))  # so many comparisons at once, for fewer points more boxes
    some = pa.array(np.flatnonzero(found >= 0))
    return pa.Table.from_arrays([points.column("x").take(some), points.column("y").take(some), held.take(order.take(pa.array(found[found >= 0])))], names=names)


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + list(more))


def split_cells(codes: DataFrame, limit: int) -> list[np.ndarray]:
    """For each level the codes of its split cells, sorted, from codes (code): those that hold more than limit of them.

    A few levels at a time; the next few take only what lies in a split cell of the last, at most CELLS of them.
    """
    split: list[np.ndarray] = []
    while len(split) < LEVELS:
        levels = range(len(split), min(len(split) + ROUND, LEVELS))
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("code", 2 * (LEVELS - k)).alias("cell")) for k in levels]))
        counts = codes.select(cells.alias("c")).groupBy("c.level", "c.cell").agg(F.count("*").alias("n"))
        found = counts.filter(F.col("n") > limit).select("level", "cell").toPandas()
        split += [np.sort(found.cell[found.level == k].to_numpy(np.int64)) for k in levels]
        if not len(split[-1]):
            return split + [np.zeros(0, np.int64)] * (LEVELS - len(split))
        last = codes.sparkSession.createDataFrame([(int(c),) for c in split[-1]], "last long")
        codes = codes.join(F.broadcast(last), F.shiftright("code", 2 * (LEVELS - len(split) + 1)) == F.col("last"), "left_semi")
    return split


def smallest_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """x, y and, where a box holds the point, box: (area, id, and the other columns of boxes), for each place of points (x, y double).

    boxes: id, x0, y0, x1, y1 (double) and any columns that can be compared. Places of which no box is known are left out.
    """
    others = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1", "id")]
    sound = boxes.filter(_finite("x0", "y0", "x1", "y1") & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    area = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")
    sound = sound.select("x0", "y0", "x1", "y1", F.struct(area, "id", *others).alias("box"))
    places = cut(points.select("x", "y").filter(_finite("x", "y")).distinct(), "places")
    b = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).first()
    grid = Grid([v or 0.0 for v in b[:4]])
    within = F.col("x0").between(b[0], b[2]) & F.col("y0").between(b[1], b[3])  # never true where there are no points
    both = places.unionByName(sound.filter(within).select(F.col("x0").alias("x"), F.col("y0").alias("y")))
    coded = both.mapInArrow(_coded(grid, ("x", "y"), "code", lambda g, c: c), _ddl(both, "code long"))
    grid = Grid(grid.bounds, split_cells(coded.select("code"), max(LEAST, -(-both.count() // CELLS))))
    laid = cut(sound.mapInArrow(_lay(grid), _ddl(sound, "cell long", "whole boolean")), "laid")
    at = cut(places.mapInArrow(_coded(grid, ("x", "y"), "cell", lambda g, c: g.leaves(c)), _ddl(places, "cell long")), "places-in-leaves")
    # the smallest box over whole cells, handed down: a row for each cell at most, so for a few times LEVELS * CELLS
    best = laid.filter("whole").groupBy("cell").agg(F.min("box").alias("box"))
    leaf = at.select("cell").distinct().withColumn("level", F.shiftright("cell", 2 * LEVELS).cast("int"))
    above = F.expr(f"transform(sequence(0, level), k -> shiftleft(cast(k as bigint), {2 * LEVELS}) | shiftright(cell & {4**LEVELS - 1}L, 2 * (level - k)))")
    known = leaf.select(F.col("cell").alias("leaf"), F.explode(above).alias("cell")).join(best, "cell").groupBy("leaf").agg(F.min("box").alias("box"))
    everywhere = [F.lit(float(v)).alias(c) for c, v in (("x0", "-inf"), ("y0", "-inf"), ("x1", "inf"), ("y1", "inf"))]
    held = laid.filter("not whole").drop("whole").unionByName(known.select(*everywhere, "box", F.col("leaf").alias("cell")))
    out = cut(at.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(_first_box, _ddl(places, f"box {held.schema['box'].dataType.simpleString()}")), "smallest-box")
    spend(places, laid, at)
    return out

"""Which points lie within a radius of each other, by boxes of counted points instead of pairs of points.

Equal points are one point with a weight. Points are put into boxes on nested grids. Two boxes whose farthest corners are within the radius
are near as a whole, two whose nearest ones are not have nothing in common, and both need no point; only what
is left is cut into smaller boxes, until few enough pairs of points are left to compare. So however many points a
place holds, only boxes that the radius cuts through are looked into.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.scratch import written

#: Pairs of points of two boxes that are compared one by one.
LEAF = 1 << 20
#: Halvings of the boxes below the size at which all points of a box are within the radius.
DEEPEST = 24


def length(component: Callable[[int], Column], size: int) -> Column:
    """Of a vector given by its components; always summed in one order, so that bounds hold in spite of rounding."""
    return F.sqrt(sum((component(j) * component(j) for j in range(size)), F.lit(0.0)))


def distance(a: Column, b: Column, size: int) -> Column:
    return length(lambda j: F.get(a, j) - F.get(b, j), size)


class Grid(NamedTuple):
    """Nested boxes: at level 0 there are two in each direction, at level cells a box's points are all within eps."""

    eps: float
    unit: float
    cells: int
    size: int

    def at(self, z: Column, level: int) -> Column:
        """The box of a point; halving is exact, so boxes nest whatever the rounding of z / unit."""
        return F.transform(z, lambda v: F.floor(v / self.unit * 2.0 ** (level - self.cells)))


def grid_for(eps: float, *tables: DataFrame) -> Grid:
    """The grid for the radius and all points (column z: an array of numbers, all of one length) of some tables."""
    size, most = 1, 0.0
    for t in tables:
        r = t.agg(F.max(F.size("z")).alias("size"), F.max(F.array_max(F.transform("z", lambda v: F.abs(v)))).alias("most")).first()
        size, most = max(size, r["size"] or 1), max(most, r["most"] or 0.0)
    unit, cells = eps / size**0.5 * (1 - 1e-9), 0
    while unit * 2.0**cells <= most:
        cells += 1
    return Grid(eps, unit, cells, size)


def boxes(points: DataFrame, grid: Grid, level: int, side: str) -> DataFrame:
    """side, parent, low and high corner of its points, m (points) and w (their weight) of each box."""
    above = F.transform(F.col(side), lambda v: F.floor(v / 2)) if level else F.array().cast("array<bigint>")
    corner = lambda f: F.array(*[f(F.get("z", j)) for j in range(grid.size)])
    out = points.groupBy(grid.at(F.col("z"), level).alias(side)).agg(corner(F.min).alias(f"low_{side}"), corner(F.max).alias(f"high_{side}"), F.count("*").alias(f"m_{side}"), F.sum("n").alias(f"w_{side}"))
    return out.withColumn(f"parent_{side}", above)


class Meeting(NamedTuple):
    """whole: level, a, b, w_b: boxes of which every point of a is within the radius of every point of b.
    leaf: level, a, b: boxes whose points are to be compared. levels: those that occur."""

    grid: Grid
    whole: DataFrame
    leaf: DataFrame
    levels: int


def meet(left: DataFrame, right: DataFrame, grid: Grid) -> Meeting:
    """Boxes of left and right (tables of pid, z, n) that are or may be within the radius. Each pair of points within it is in
    exactly one pair of boxes."""
    spark = left.sparkSession
    undecided = spark.createDataFrame([([], [])], "parent_a array<bigint>, parent_b array<bigint>")
    found = []
    for level in range(grid.cells + DEEPEST + 1):
        pairs = undecided.join(boxes(left, grid, level, "a"), "parent_a").join(boxes(right, grid, level, "b"), "parent_b")
        gap = lambda j: F.greatest(F.get("low_a", j) - F.get("high_b", j), F.get("low_b", j) - F.get("high_a", j), F.lit(0.0))
        reach = lambda j: F.greatest(F.get("high_a", j) - F.get("low_b", j), F.get("high_b", j) - F.get("low_a", j))
        state = F.when(length(reach, grid.size) <= grid.eps, "whole").when((F.col("m_a") * F.col("m_b") <= LEAF) | F.lit(level == grid.cells + DEEPEST), "leaf").otherwise("cut")
        found.append(written(pairs.where(length(gap, grid.size) <= grid.eps).select(F.lit(level).alias("level"), "a", "b", "w_b", state.alias("state"))))
        undecided = found[-1].where("state = 'cut'").select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"))
        if undecided.isEmpty():
            break
    every = found[0]
    for t in found[1:]:
        every = every.unionByName(t)
    return Meeting(grid, every.where("state = 'whole'").drop("state"), every.where("state = 'leaf'").drop("state", "w_b"), len(found))


def by_box(points: DataFrame, meeting: Meeting, side: str) -> DataFrame:
    """The points with level and side for each level of boxes."""
    each = F.array(*[F.struct(F.lit(i).alias("level"), meeting.grid.at(F.col("z"), i).alias(side)) for i in range(meeting.levels)])
    return points.withColumn("box", F.explode(each)).select(*points.columns, "box.level", f"box.{side}")


def compared(left: DataFrame, right: DataFrame, meeting: Meeting) -> DataFrame:
    """a, b: the pids of points within the radius whose boxes had to be looked into, and the other columns of right."""
    of = lambda t, side: by_box(t.withColumnsRenamed({"pid": f"pid_{side}", "z": "z"}), meeting, side).withColumnRenamed("z", f"z_{side}")
    pairs = meeting.leaf.join(of(left.select("pid", "z"), "a"), ["level", "a"]).join(of(right, "b"), ["level", "b"])
    more = [c for c in right.columns if c not in ("pid", "z")]
    return pairs.where(distance(F.col("z_a"), F.col("z_b"), meeting.grid.size) <= meeting.grid.eps).select(F.col("pid_a").alias("a"), F.col("pid_b").alias("b"), *more)


def near_counts(left: DataFrame, right: DataFrame, grid: Grid) -> DataFrame:
    """pid, n_near: the weight of the points of right within the radius of each point of left that has any."""
    m = meet(left, right, grid)
    whole = m.whole.groupBy("level", "a").agg(F.sum("w_b").alias("n_near"))
    of_boxes = by_box(left.select("pid", "z"), m, "a").join(whole, ["level", "a"]).select("pid", "n_near")
    of_points = compared(left, right, m).select(F.col("a").alias("pid"), F.col("n").alias("n_near"))
    return of_boxes.unionByName(of_points).groupBy("pid").agg(F.sum("n_near").alias("n_near"))


def near_groups(left: DataFrame, right: DataFrame, grid: Grid) -> DataFrame:
    """pid, c, n: how much weight of each value c of right lies within the radius of each point of left."""
    m = meet(left, right, grid)
    inside = by_box(right, m, "b").groupBy("level", "b", "c").agg(F.sum("n").alias("n"))
    whole = m.whole.join(inside, ["level", "b"]).groupBy("level", "a", "c").agg(F.sum("n").alias("n"))
    of_boxes = by_box(left.select("pid", "z"), m, "a").join(whole, ["level", "a"]).select("pid", "c", "n")
    of_points = compared(left, right, m).select(F.col("a").alias("pid"), "c", "n")
    return of_boxes.unionByName(of_points).groupBy("pid", "c").agg(F.sum("n").alias("n"))


def near_edges(points: DataFrame, grid: Grid) -> DataFrame:
    """u, v: edges between pids that join just those points that are linked by steps within the radius.

    A box that is near as a whole to any other is one group with it, so its points get an edge each to one of
    them, and two such boxes one edge between those."""
    m = meet(points, points, grid)
    first = by_box(points.select("pid", "z"), m, "a").groupBy("level", "a").agg(F.min("pid").alias("first"))
    heads = m.whole.join(first, ["level", "a"]).join(first.select("level", F.col("a").alias("b"), F.col("first").alias("v")), ["level", "b"]).select(F.col("first").alias("u"), "v")
    grouped = m.whole.select("level", "a").distinct().join(first, ["level", "a"])
    members = by_box(points.select("pid", "z"), m, "a").join(grouped, ["level", "a"]).select(F.col("pid").alias("u"), F.col("first").alias("v"))
    cell = points.select("pid", grid.at(F.col("z"), grid.cells).alias("cell"))
    head = cell.groupBy("cell").agg(F.min("pid").alias("v"))
    looked = compared(points, points, m).select("a", "b").join(cell.join(head, "cell").select(F.col("pid").alias("a"), F.col("v").alias("u")), "a")
    looked = looked.join(cell.join(head, "cell").select(F.col("pid").alias("b"), "v"), "b").select("u", "v")  # points of a cell are within the radius
    of_cell = cell.join(head, "cell").select(F.col("pid").alias("u"), "v")
    return written(heads.unionByName(members).unionByName(looked).unionByName(of_cell).distinct())


def groups(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that edges (u, v; symmetric or not) lead to, for each node that has an edge (one to
    itself counts).

    Large-star and small-star steps in turn (Kiveris et al., "Connected Components in MapReduce and Beyond"): each is a minimum, combined
    before it is shuffled, and a join of tables."""
    nodes = written(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    stars = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        # done when each node has one edge, and none that is an edge's end begins one
        seen = stars.select(F.col("u").alias("node"), F.lit(1).alias("k")).unionByName(stars.select(F.col("v").alias("node"), F.lit(2).alias("k")).distinct())
        if seen.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))

"""Quadtrees over the unit square, built from counts of cell prefixes instead of by recursion.

A node of level l is (l, ix, iy): the l leading bits of a point's coordinates. Counting the sample's
points under every prefix tells which nodes are split. A leaf's name lists the quadrants from the root,
0 NW, 1 NE, 2 SW, 3 SE; the root alone has the empty name. So a name is a number in base 4, points have
one of `depth` digits, and a leaf holds a range of these: a point's leaf is the last one that begins at its
number or before. Of a small tree the leaves' beginnings are broadcast and searched; of a large one they
are sorted among the points, in one shuffle.

Split policies:
  capacity   a node with more than `capacity` sample points is split
  siblings   and so is one that has a sibling with more
  width      a node is split if it has more, or is wider than the mean of the different leaf widths of
             the capacity tree
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Internal nodes of a tree whose leaves (a number, a level and a name each) are broadcast, and which the
#: driver may hold; larger trees stay distributed.
BROADCAST_NODES = 200_000
#: Levels by whose cells points and leaves of a large tree meet, and the parts of each such cell.
MEET_LEVELS, MEET_PARTS = 6, 8
KINDS = ("capacity", "siblings", "width")


def fine(v: Column, depth: int) -> Column:
    """A coordinate's cell at the deepest level; 1.0 falls into the last."""
    return F.least(F.floor(v * float(1 << depth)), F.lit((1 << depth) - 1).cast("long"))


def prefix_counts(sample: DataFrame, depth: int) -> DataFrame:
    """level, ix, iy, cnt of every node with sample points. Points are summed by their deepest cells
    first, so what is multiplied by levels is cells, not points."""
    cells = sample.groupBy(fine(F.col("x"), depth).alias("fx"), fine(F.col("y"), depth).alias("fy")).agg(F.count("*").alias("n"))
    each = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    up = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    return each.groupBy("level", up("fx").alias("ix"), up("fy").alias("iy")).agg(F.sum("n").alias("cnt"))


#: Steps that part the 30 low bits of a number by blank ones: shift to the left by, and bits that stay.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def number(fx: np.ndarray, fy: np.ndarray, depth: int) -> np.ndarray:
    """The number of cells of a level: their names in base 4."""
    wide = lambda v: reduce(lambda x, step: (x << step[0] | x) & step[1], _SPREAD, v)
    return wide((1 << depth) - 1 - fy.astype(np.int64)) << 1 | wide(fx.astype(np.int64))


def number_of(fx: Column, fy: Column, last: Column) -> Column:
    """number() as a column; last: the largest fy of the level."""
    wide = lambda v: reduce(lambda x, step: F.shiftleft(x, step[0]).bitwiseOR(x).bitwiseAND(F.lit(step[1])), _SPREAD, v)
    return F.shiftleft(wide(last - fy), 1).bitwiseOR(wide(fx.cast("long")))


@dataclass
class QuadTree:
    #: level, ix, iy of internal nodes from level `full` on
    nodes: DataFrame
    depth: int
    #: every node above this level is internal
    full: int
    n_nodes: int
    levels: int

    #: A circle touching a cell from outside makes it a candidate.
    closed = True

    @property
    def internal(self) -> int:
        return self.n_nodes + (4**self.full - 1) // 3

    @cached_property
    def leaves(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """Beginnings (sorted), levels and names of the leaves, empty ones included; None for a large tree."""
        if self.internal > BROADCAST_NODES:
            return None
        rows = self.nodes.select("level", "ix", "iy").toPandas()  # BROADCAST_NODES rows at most
        level, code = rows["level"].to_numpy(np.int64), np.zeros(len(rows), np.int64)
        for k in np.unique(level):
            here = level == k
            code[here] = number(rows["ix"].to_numpy()[here], rows["iy"].to_numpy()[here], int(k))
        inner = {int(k): np.sort(code[level == k]) for k in np.unique(level)}
        begin, at = [], []
        parents = np.arange(1)
        for k in range(max(self.levels, self.full) + 1):
            if k < self.full:
                parents = np.arange(4 ** (k + 1))
                continue
            split = np.isin(parents, inner.get(k, np.empty(0, np.int64)))
            begin.append(parents[~split] << 2 * (self.depth - k))
            at.append(np.full(int((~split).sum()), k))
            parents = (parents[split][:, None] * 4 + np.arange(4)).ravel()
        begin, at = np.concatenate(begin), np.concatenate(at)
        order = np.argsort(begin)
        begin, at = begin[order], at[order]
        names = pa.array([np.base_repr(int(b >> 2 * (self.depth - k)), 4).zfill(int(k)) if k else "" for b, k in zip(begin, at)], pa.string())
        return begin, at.astype(np.int32), names

    def located(self, points: DataFrame) -> DataFrame:
        """Adds level and cell (the name) of the leaf to points."""
        return self._searched(points) if self.leaves is not None else self._merged(points)

    def _searched(self, points: DataFrame) -> DataFrame:
        shared, depth = points.sparkSession.sparkContext.broadcast(self.leaves), self.depth  # 3 * BROADCAST_NODES + 1 leaves at most
        schema = to_arrow_schema(points.schema).append(pa.field("level", pa.int32())).append(pa.field("cell", pa.string()))
        ix, iy, side = points.columns.index("x"), points.columns.index("y"), 1 << depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin, level, names = shared.value
            for batch in batches:
                fx, fy = (np.minimum(np.floor(batch.column(i).to_numpy(zero_copy_only=False) * float(side)).astype(np.int64), side - 1) for i in (ix, iy))
                found = np.searchsorted(begin, number(fx, fy, depth), "right") - 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(level[found]), names.take(pa.array(found))], schema=schema)

        return points.mapInArrow(run, StructType([*points.schema.fields, StructField("level", IntegerType()), StructField("cell", StringType())]))

    def _merged(self, points: DataFrame) -> DataFrame:
        """Leaves and points by number; a point's leaf is the last one before it. They meet by cells of a
        shallow level, each in parts, so a crowded cell is many tasks; leaves go to all parts they reach."""
        depth, top = self.depth, min(MEET_LEVELS, self.depth)
        shift = 2 * (depth - top)
        leaves = self._leaf_rows().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(MEET_PARTS - 1))))
        reach = F.sequence(F.shiftright("begin", shift), F.shiftright(F.col("begin") + F.expr(f"shiftleft(1L, 2 * ({depth} - level))") - 1, shift))
        leaves = leaves.select(F.explode(reach).alias("meet"), "part", "begin", "level", F.lit(True).alias("leaf"), F.lit(None).cast(points.schema).alias("row"))
        own = points.select(F.struct("*").alias("row")).withColumn("begin", number_of(fine(F.col("row.x"), depth), fine(F.col("row.y"), depth), F.lit((1 << depth) - 1).cast("long")))
        part = F.pmod(F.xxhash64("row"), F.lit(MEET_PARTS)).cast("int")
        own = own.select(F.shiftright("begin", shift).alias("meet"), part.alias("part"), "begin", F.lit(None).cast("int").alias("level"), F.lit(False).alias("leaf"), "row")
        order = Window.partitionBy("meet", "part").orderBy("begin", F.desc("leaf")).rowsBetween(Window.unboundedPreceding, 0)
        found = leaves.unionByName(own).withColumn("level", F.last("level", True).over(order)).where(~F.col("leaf"))
        digits = F.conv(F.expr(f"shiftright(begin, 2 * ({depth} - level))").cast("string"), 10, 4)
        return found.select("row.*", "level", F.lpad(F.when(F.col("level") > 0, digits).otherwise(""), F.col("level"), F.lit("0")).alias("cell"))

    def _leaf_rows(self) -> DataFrame:
        """begin, level of the leaves: children of internal nodes that are not internal."""
        spark, whole = self.nodes.sparkSession, 4**self.full
        own = self.nodes.select("level", number_of(F.col("ix"), F.col("iy"), F.expr("shiftleft(1L, cast(level as int)) - 1")).alias("code"))
        child = own.select((F.col("level") + 1).alias("level"), F.explode(F.array(*((F.col("code") * 4 + k) for k in range(4)))).alias("code"))
        shallow = spark.range(whole).select(F.lit(self.full).alias("level"), F.col("id").alias("code"))
        leaves = child.unionByName(shallow).join(own, ["level", "code"], "left_anti")
        return leaves.select(F.expr(f"shiftleft(code, 2 * ({self.depth} - level))").alias("begin"), F.col("level").cast("int").alias("level"))

    def assign(self, points: DataFrame) -> DataFrame:
        return self.located(points).drop("level")

    def rects(self, cells: DataFrame) -> DataFrame:
        return name_rects(cells)

    def cell_at(self, x: float, y: float) -> str:
        """The leaf that holds one point."""
        if self.leaves is None:
            return self.assign(self.nodes.sparkSession.createDataFrame([(x, y)], "x double, y double")).first().cell
        begin, _, names = self.leaves
        fx, fy = (np.array([min(int(v * (1 << self.depth)), (1 << self.depth) - 1)]) for v in (x, y))
        return names[int(np.searchsorted(begin, number(fx, fy, self.depth), "right")[0]) - 1].as_py()

    def width(self, cell: str) -> float:
        return 0.5 ** len(cell)

    def close(self) -> None:
        """Gives up what a large tree holds in the cluster's memory."""
        self.nodes.unpersist()


def name_rects(cells: DataFrame) -> DataFrame:
    """Adds x0, y0 and ds to rows whose cell is a quadtree name."""
    # the root's name has no digit; its one step finds none
    levels = F.sequence(F.lit(1), F.greatest(F.length("cell"), F.lit(1)))
    digit = lambda k: F.substring(F.col("cell"), k, F.lit(1))
    total = lambda *digits: F.aggregate(levels, F.lit(0.0), lambda a, k: a + F.when(digit(k).isin(*digits), F.pow(F.lit(0.5), k)).otherwise(0.0))
    return cells.withColumns({"x0": total("1", "3"), "y0": total("0", "1"), "ds": F.pow(F.lit(0.5), F.length("cell"))})


def leaf_widths(internal: DataFrame, any_internal: bool) -> list[float]:
    """The different widths of a tree's leaves, empty ones included: a level has a leaf if an internal
    node above has a child that is not internal."""
    if not any_internal:
        return [1.0]
    children = internal.where(F.col("level") > 0).groupBy((F.col("level") - 1).alias("level"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy")).agg(F.count("*").alias("k"))
    open_ = internal.join(children, ["level", "ix", "iy"], "left").where(F.coalesce("k", F.lit(0)) < 4)
    return sorted(0.5 ** (r.level + 1) for r in open_.select("level").distinct().collect())


def build(sample: DataFrame, capacity: int, kind: str = "capacity", depth: int = 20) -> QuadTree:
    """A tree from a sample of points. No node below level `depth` is made, so points that coincide end
    in one leaf; an empty sample gives a single leaf."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    if capacity < 1 or not 1 <= depth <= 30:
        raise ValueError("capacity is at least 1, depth from 1 to 30")
    counts, n, levels = _held(prefix_counts(sample, depth).where((F.col("level") < depth) & (F.col("cnt") > capacity)).select("level", "ix", "iy"))
    full, nodes = 0, counts
    if kind == "siblings" and n:
        # the four children of the parent of a node that overflows
        both = F.explode(F.array(F.lit(0), F.lit(1)))
        four = counts.where(F.col("level") > 0).select("level", F.shiftright("ix", 1).alias("px"), F.shiftright("iy", 1).alias("py")).distinct()
        four = four.withColumn("dx", both).withColumn("dy", both).select("level", (F.col("px") * 2 + F.col("dx")).alias("ix"), (F.col("py") * 2 + F.col("dy")).alias("iy"))
        nodes, n, _ = _held(counts.where(F.col("level") == 0).unionByName(four))
        counts.unpersist()
    if kind == "width":
        widths = leaf_widths(counts, n > 0)
        mean = sum(widths) / len(widths)
        full = sum(1 for level in range(depth) if 0.5**level > mean)
        nodes = counts.where(F.col("level") >= full)
        n = nodes.count()
    return QuadTree(nodes, depth, full, n, max(levels, full))


def _held(nodes: DataFrame) -> tuple[DataFrame, int, int]:
    """Nodes (level, ix, iy), their number, and the levels that have any. Few are brought to the driver,
    and are a local table from then on; many stay in the cluster's memory until the tree is closed."""
    spark = nodes.sparkSession
    nodes = nodes.select(F.col("level").cast("int").alias("level"), F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"))
    rows = nodes.limit(BROADCAST_NODES + 1).toArrow()
    if rows.num_rows <= BROADCAST_NODES:
        top = max(rows.column("level").to_pylist(), default=-1)
        return spark.createDataFrame(rows, nodes.schema) if rows.num_rows else spark.createDataFrame([], nodes.schema), rows.num_rows, top + 1
    nodes = nodes.persist()
    stats = nodes.agg(F.count("*").alias("n"), F.max("level").alias("top")).first()
    return nodes, stats.n, stats.top + 1


def shape(tree: QuadTree) -> dict[str, int]:
    """internal nodes, leaves (empty ones included) and levels."""
    internal = tree.internal
    return {"internal": internal, "leaves": 3 * internal + 1, "levels": tree.levels}


def preorder_bits(tree: QuadTree) -> str:
    """1 for an internal node, 0 for a leaf, in preorder NW, NE, SW, SE; for looking at small trees."""
    if tree.n_nodes > BROADCAST_NODES:
        raise ValueError("too many nodes to write as one string")
    inner = {(r.level, r.ix, r.iy) for r in tree.nodes.collect()}
    out, work = [], [(0, 0, 0)]
    while work:
        level, ix, iy = work.pop()
        if level < tree.full or (level, ix, iy) in inner:
            out.append("1")
            work += [(level + 1, 2 * ix + dx, 2 * iy + dy) for dx, dy in ((1, 0), (0, 0), (1, 1), (0, 1))]
        else:
            out.append("0")
    return "".join(out)

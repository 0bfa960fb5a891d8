"""Reading and writing points, cells, neighbours, trees and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convene.operators.grid import Grid
from convene.operators.quadtree import QuadTree, preorder_bits
from convene.operators.summary import QuerySummary

POINT = "id bigint, x double, y double"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated id, x, y without a header; a malformed line is an error when it is read."""
    rows = spark.read.schema(POINT).option("sep", "\t").option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    bad = F.col("id").isNull() | F.col("x").isNull() | F.col("y").isNull()
    return rows.withColumn("id", F.when(bad, F.raise_error(F.lit("a point line lacks a value")).cast("bigint")).otherwise(F.col("id")))


def read_parquet(spark: SparkSession, path: str, id: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id).cast("bigint").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def in_domain(points: DataFrame) -> DataFrame:
    """Points as they are; one outside the unit square, or without coordinates, is an error when met."""
    outside = ~F.coalesce(F.col("x").between(0, 1) & F.col("y").between(0, 1), F.lit(False))
    said = F.concat(F.lit("a point lies outside the unit square: id "), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    return points.withColumn("x", F.when(outside, F.raise_error(said).cast("double")).otherwise(F.col("x")))


def normalised(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Coordinates scaled from a box to the unit square, both axes alike, so that distances keep their order."""
    side = max(x1 - x0, y1 - y0)
    if not side > 0:
        raise ValueError("the box has no area")
    return points.withColumns({"x": (F.col("x") - x0) / side, "y": (F.col("y") - y0) / side})


def write_text(points: DataFrame, path: str, decimals: int = 15) -> None:
    number = lambda c: F.format_string(f"%.{decimals}f", F.col(c))
    points.select(F.concat_ws("\t", F.col("id").cast("string"), number("x"), number("y"))).write.mode("overwrite").text(path)


def write_sorted(queries: DataFrame, path: str) -> None:
    """Query points by x, then id, with their rank, as text; a query set is small by contract."""
    number = lambda c: F.format_string("%.15f", F.col(c))
    ranked = queries.select(F.row_number().over(Window.orderBy("x", "id")).alias("rn"), "id", "x", "y")
    ranked.coalesce(1).sortWithinPartitions("rn").select(F.concat_ws("\t", F.col("rn").cast("string"), F.col("id").cast("string"), number("x"), number("y"))).write.mode("overwrite").text(path)


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    """rn, id, x, y of query points by x."""
    return spark.read.schema(f"rn int, {POINT}").option("sep", "\t").option("mode", "FAILFAST").csv(path)


def write_cells(celled: DataFrame, path: str) -> None:
    """Points with their cells, as Parquet in cell order, so that a filter on cells skips row groups."""
    celled.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(path)


def write_cell_table(celled: DataFrame, name: str, buckets: int) -> None:
    """Points with their cells as a table in buckets of cells: later joins on cells need no shuffle."""
    celled.write.mode("overwrite").bucketBy(buckets, "cell").sortBy("cell").saveAsTable(name)


def write_cell_text(celled: DataFrame, path: str) -> None:
    """One bzip2 line for each cell: the cell, then id, x, y of each point. For exchange only: a cell's
    points meet in one row."""
    point = F.concat_ws("\t", F.col("id").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"))
    # dealt by number: a cell's rows are few in bytes for what their compression takes, and tasks are not to be merged
    dealt = celled.repartition(int(celled.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell")
    lines = dealt.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("id", point.alias("p")))).alias("ps"))
    lines.select(F.concat_ws("\t", F.col("cell").cast("string"), F.array_join(F.transform("ps", lambda s: s["p"]), "\t"))).write.mode("overwrite").option("compression", "bzip2").text(path)


def read_cell_text(spark: SparkSession, path: str) -> DataFrame:
    """cell (string), id, x, y from lines of write_cell_text()."""
    # each point is a row of its own text: a row that kept its whole line would make work grow with a cell's square
    point = F.lit(r"[^\t]++\t[^\t]++\t[^\t]++")
    line = F.substring("value", F.instr("value", "\t") + 1, F.length("value"))
    celled = F.transform(F.regexp_extract_all(line, point, F.lit(0)), lambda p: F.struct(F.substring_index("value", "\t", 1).alias("cell"), p.alias("p")))
    rows = spark.read.text(path).select(F.inline(celled))
    at = lambda j: F.element_at(F.split("p", "\t"), j)
    return rows.select("cell", at(1).cast("bigint").alias("id"), at(2).cast("double").alias("x"), at(3).cast("double").alias("y"))


def write_histogram(hist: DataFrame, path: str) -> None:
    hist.select(F.concat_ws("\t", F.col("cell").cast("string"), F.col("cnt").cast("string"))).write.mode("overwrite").text(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cell string, cnt bigint").option("sep", "\t").option("emptyValue", "").option("nullValue", "\0").csv(path)


def write_candidate_cells(cells: DataFrame, path: str) -> None:
    cells.select(F.col("cell").cast("string")).write.mode("overwrite").text(path)


def read_candidate_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("cell"))


def write_summary(spark: SparkSession, s: QuerySummary, path: str) -> None:
    spark.createDataFrame([(s.n, s.xmin, s.xmax, s.ymin, s.ymax, s.xc, s.yc, s.sumdist)], "n bigint, xmin double, xmax double, ymin double, ymax double, xc double, yc double, sumdist double").write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str) -> QuerySummary:
    return QuerySummary(**spark.read.schema("n bigint, xmin double, xmax double, ymin double, ymax double, xc double, yc double, sumdist double").json(path).first().asDict())


def write_summary_text(spark: SparkSession, s: QuerySummary, path: str) -> None:
    """One line of seven tab-separated numbers: xmin, xmax, ymin, ymax, xc, yc, sumdist."""
    spark.createDataFrame([(s.line(),)], "value string").write.mode("overwrite").text(path)


def read_summary_text(spark: SparkSession, path: str, n: int) -> QuerySummary:
    """A summary of n query points; the line doesn't say how many."""
    return QuerySummary(n, *(float(v) for v in spark.read.text(path).first().value.split("\t")))


def write_neighbours(nearest: DataFrame, path: str) -> None:
    """id and distance (10 decimals) of ranked neighbours, one a line, nearest first; k rows."""
    line = F.concat_ws("\t", F.col("id").cast("string"), F.format_string("%.10f", F.col("dist")))
    nearest.coalesce(1).sortWithinPartitions("rank").select(line).write.mode("overwrite").text(path)


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """id, dist from lines of any number of pairs, as written for one list or for many cells' lists."""
    parts = F.split(F.trim("value"), "\t", -1)
    count = (F.size(parts) / 2).cast("int")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    at = lambda j: F.element_at("p", F.col("k") * 2 + 1 + j)
    return rows.select(at(0).cast("bigint").alias("id"), at(1).cast("double").alias("dist"))


def append_times(spark: SparkSession, seconds: dict[str, float], path: str) -> None:
    """One more row (time, seconds of each phase) in a folder of JSON lines."""
    row = spark.createDataFrame([(seconds,)], "seconds map<string,double>").select(F.current_timestamp().alias("time"), "seconds")
    row.coalesce(1).write.mode("append").json(path)


def write_prepared(prepared, path: str) -> None:
    """Points with their cells, sorted by them, the histogram, and the index, in folders of a path."""
    spark = prepared.celled.sparkSession
    write_cells(prepared.celled, f"{path}/cells")
    # the written cells are counted, not the points once more
    counts = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.count("*").alias("cnt"))
    counts.write.mode("overwrite").parquet(f"{path}/histogram")
    if isinstance(prepared.index, Grid):
        spark.createDataFrame([(prepared.index.n,)], "n int").write.mode("overwrite").json(f"{path}/grid")
    else:
        write_tree(prepared.index, f"{path}/tree")


def read_prepared(spark: SparkSession, path: str, partitioning: str):
    """What write_prepared() wrote; partitioning: gd or qt."""
    from convene.plans.engine import Prepared

    index = Grid(spark.read.schema("n int").json(f"{path}/grid").first().n) if partitioning == "gd" else read_tree(spark, f"{path}/tree")
    return Prepared(spark.read.parquet(f"{path}/cells"), index.rects(spark.read.parquet(f"{path}/histogram")), index)


def write_tree(tree: QuadTree, path: str) -> None:
    full = F.lit(tree.full)
    spark = tree.nodes.sparkSession
    head = spark.createDataFrame([(-1, tree.depth, tree.full)], "level int, ix bigint, iy bigint")
    tree.nodes.select("level", "ix", "iy").unionByName(head).withColumn("full", full).write.mode("overwrite").parquet(path)


def read_tree(spark: SparkSession, path: str) -> QuadTree:
    rows = spark.read.parquet(path)
    head = rows.where(F.col("level") == -1).first()
    nodes = rows.where(F.col("level") >= 0).select("level", "ix", "iy")
    stats = nodes.agg(F.count("*").alias("n"), F.max("level").alias("top")).first()
    return QuadTree(nodes, int(head.ix), int(head.iy), stats.n, max(int(head.iy), stats.top + 1 if stats.n else 0))


def write_tree_bits(tree: QuadTree, path: str) -> None:
    """The tree as a line of 1 (internal) and 0 (leaf) in preorder NW, NE, SW, SE; small trees only."""
    tree.nodes.sparkSession.createDataFrame([(preorder_bits(tree),)], "value string").write.mode("overwrite").text(path)


def read_tree_bits(spark: SparkSession, path: str, depth: int) -> QuadTree:
    """A tree from its line, whose deepest cells are of a level."""
    bits, nodes, work = spark.read.text(path).first().value, [], [(0, 0, 0)]
    for bit in bits:
        level, ix, iy = work.pop()
        if bit == "1":
            nodes.append((level, ix, iy))
            work += [(level + 1, 2 * ix + dx, 2 * iy + dy) for dx, dy in ((1, 0), (0, 0), (1, 1), (0, 1))]
    frame = spark.createDataFrame(nodes, "level int, ix bigint, iy bigint")
    return QuadTree(frame, depth, 0, len(nodes), max((n[0] for n in nodes), default=-1) + 1)

"""The engine's operators and whole queries over the test tables, each with DuckDB SQL for its rows."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convene.functions import geometry as g
from convene.operators import candidates, kernel, prune, quadtree, sampling, summary, topk
from convene.operators.grid import Grid
from convene.plans import testbed
from convene.plans.engine import Config, brute_force, gknn, histogram, prepare, run, within_tangents
from convene.plans.registry import ORACLES, QUERIES
from convene.sources import points as io
from convene.sources.shared import shared_path

K, N, CAPACITY, DEPTH, STEP, CELL_WIDTH = 10, 20, 40, 12, 1e-4, 0.05
T, Q, E = testbed.SQL["orders"], testbed.SQL["supplier"], testbed.SQL["events"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


_points = testbed.points


def _events_tree(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, quadtree.QuadTree]:
    events = _points(spark, sf_dir, "events")
    return events, quadtree.build(events, CAPACITY, kind, DEPTH)


# ---- projections, filters, summaries


@query(f"SELECT * FROM ({T}) WHERE x BETWEEN 0.25::DOUBLE AND 0.5::DOUBLE AND y BETWEEN 0.25::DOUBLE AND 0.5::DOUBLE")
def points_crop_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "orders").where(g.in_box("x", "y", 0.25, 0.25, 0.5, 0.5))


@query(f"SELECT count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM ({Q})")
def query_mbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.box(_points(spark, sf_dir, "supplier"))


@query(
    f"WITH q AS ({Q}), c AS (SELECT avg(x) AS xc, avg(y) AS yc FROM q) SELECT round(any_value(xc), 6) AS xc, round(any_value(yc), 6) AS yc, round(sum(sqrt((x-xc)*(x-xc)+(y-yc)*(y-yc))), 6) AS sumdist FROM q, c"
)
def query_centroid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _points(spark, sf_dir, "supplier")
    mean = F.broadcast(q.agg(F.avg("x").alias("xc"), F.avg("y").alias("yc")))
    return q.crossJoin(mean).agg(r6(F.first("xc"), "xc"), r6(F.first("yc"), "yc"), r6(F.sum(g.distance("x", "y", "xc", "yc")), "sumdist"))


_TRACE = f"""
    WITH RECURSIVE q AS MATERIALIZED ({Q}), step(iter, x, y, move) AS (
        SELECT 0, avg(x), avg(y), 0::DOUBLE FROM q
        UNION ALL
        SELECT iter + 1, s.x - {STEP}::DOUBLE * gx, s.y - {STEP}::DOUBLE * gy, sqrt(({STEP}::DOUBLE*gx)*({STEP}::DOUBLE*gx) + ({STEP}::DOUBLE*gy)*({STEP}::DOUBLE*gy))
        FROM step s, LATERAL (
            SELECT sum((s.x - q.x) / nullif(sqrt((s.x-q.x)*(s.x-q.x)+(s.y-q.y)*(s.y-q.y)), 0)) AS gx,
                   sum((s.y - q.y) / nullif(sqrt((s.x-q.x)*(s.x-q.x)+(s.y-q.y)*(s.y-q.y)), 0)) AS gy FROM q
        ) WHERE iter < {{most}}
    )
    SELECT CAST(iter AS INTEGER) AS iter, round(s.x, 6) AS x, round(s.y, 6) AS y, round(move, 6) AS move,
        round((SELECT sum(sqrt((s.x-q.x)*(s.x-q.x)+(s.y-q.y)*(s.y-q.y))) FROM q), 6) AS sumdist
    FROM step s WHERE iter > 0
"""


@query(f"SELECT x AS xc, y AS yc, move, sumdist FROM ({_TRACE.format(most=1)})")
def query_descent_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _points(spark, sf_dir, "supplier")
    mean = F.broadcast(q.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")))
    d = F.nullif(g.distance("mx", "my", "x", "y"), F.lit(0.0))
    slope = q.crossJoin(mean).agg(F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum((F.col("mx") - F.col("x")) / d).alias("gx"), F.sum((F.col("my") - F.col("y")) / d).alias("gy"))
    moved = slope.select((F.col("mx") - STEP * F.col("gx")).alias("xc"), (F.col("my") - STEP * F.col("gy")).alias("yc"), (STEP * F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)).alias("move"))
    return q.crossJoin(F.broadcast(moved)).agg(r6(F.first("xc"), "xc"), r6(F.first("yc"), "yc"), r6(F.first("move"), "move"), r6(F.sum(g.distance("x", "y", "xc", "yc")), "sumdist"))


@query(_TRACE.format(most=5))
def query_descent_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.trace(_points(spark, sf_dir, "supplier"), STEP, 5)
    return rows.select("iter", *(r6(c, c) for c in ("x", "y", "move", "sumdist")))


@query(f"SELECT CAST(row_number() OVER (ORDER BY x, id) AS INTEGER) AS rn, id, x, y FROM ({Q})")
def query_sorted_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "supplier").select(F.row_number().over(Window.orderBy("x", "id")).alias("rn"), "id", "x", "y")


@query(f"SELECT id, x, y FROM ({T}) WHERE ((((id % 1073741824) * 2654435761) % 4294967296) // 65536) % 100 < 20")
def sample_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.by_id(_points(spark, sf_dir, "orders"), 20)


# ---- grid

_CELL = f"least(CAST(floor(y/{CELL_WIDTH}::DOUBLE) AS BIGINT), {N - 1})*{N} + least(CAST(floor(x/{CELL_WIDTH}::DOUBLE) AS BIGINT), {N - 1})"
_GRID = f"SELECT id, x, y, {_CELL} AS cell FROM ({T})"
_GRID_HIST = f"SELECT cell, count(*) AS cnt, (cell % {N})*{CELL_WIDTH}::DOUBLE AS x0, CAST(floor(cell/{N}) AS BIGINT)*{CELL_WIDTH}::DOUBLE AS y0, {CELL_WIDTH}::DOUBLE AS ds FROM ({_GRID}) GROUP BY cell"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Grid(N).assign(_points(spark, sf_dir, "orders"))


@query(_GRID)
def grid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query(f"SELECT cell, count(*) AS cnt FROM ({_GRID}) GROUP BY cell")
def grid_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("cnt"))


@query(f"SELECT cell, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM ({_GRID}) GROUP BY cell")
def grid_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_sort(F.collect_list("id"))
    return _grid(spark, sf_dir).groupBy("cell").agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))


@query(f"SELECT cell, round(x0, 6) AS x0, round(y0, 6) AS y0, ds FROM ({_GRID_HIST})")
def grid_cell_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(_grid(spark, sf_dir), Grid(N)).select("cell", r6("x0", "x0"), r6("y0", "y0"), "ds")


# ---- quadtrees

_SIDE = 1 << DEPTH
_FINE = f"least(CAST(floor(x*{_SIDE}) AS BIGINT), {_SIDE - 1}) AS fx, least(CAST(floor(y*{_SIDE}) AS BIGINT), {_SIDE - 1}) AS fy"
_COUNTS = f"SELECT l, fx >> ({DEPTH}-l) AS ix, fy >> ({DEPTH}-l) AS iy, count(*) AS cnt FROM (SELECT {_FINE} FROM ({E})), (SELECT unnest(generate_series(0, {DEPTH})) AS l) GROUP BY ALL"
_OVER = f"SELECT l, ix, iy FROM ({_COUNTS}) WHERE cnt > {CAPACITY} AND l < {DEPTH}"
_INNER = {
    "capacity": _OVER,
    "siblings": f"""SELECT l, ix, iy FROM ({_OVER}) WHERE l = 0 UNION
        SELECT l, (ix >> 1)*2 + dx, (iy >> 1)*2 + dy FROM ({_OVER}), (VALUES (0),(1)) a(dx), (VALUES (0),(1)) b(dy) WHERE l > 0""",
}
_WIDTHS = f"""SELECT DISTINCT pow(0.5, i.l + 1) AS w FROM ({_OVER}) i LEFT JOIN (SELECT l - 1 AS l, ix >> 1 AS ix, iy >> 1 AS iy, count(*) AS k FROM ({_OVER}) WHERE l > 0 GROUP BY ALL) c USING (l, ix, iy) WHERE coalesce(k, 0) < 4"""
_FULL = f"(SELECT count(*) FROM (SELECT unnest(generate_series(0, {DEPTH - 1})) AS l) WHERE pow(0.5, l) > coalesce((SELECT avg(w) FROM ({_WIDTHS})), 1))"


def _tree_sql(kind: str, points: str = E) -> str:
    """id, x, y, level, cell of points in the events' tree of a kind."""
    inner = _INNER.get(kind, _OVER)
    full = _FULL if kind == "width" else "0"
    return f"""
        SELECT id, x, y, level, coalesce(list_aggregate(list_transform(generate_series(1, level), lambda k:
            CAST(2*(1 - ((fy >> ({DEPTH}-k)) & 1)) + ((fx >> ({DEPTH}-k)) & 1) AS VARCHAR)), 'string_agg', ''), '') AS cell
        FROM (
            SELECT p.id, p.x, p.y, p.fx, p.fy, greatest({full}, coalesce(max(i.l) + 1, 0))::BIGINT AS level
            FROM (SELECT id, x, y, {_FINE} FROM ({points})) p CROSS JOIN (SELECT unnest(generate_series(0, {DEPTH - 1})) AS l) s
            LEFT JOIN ({inner}) i ON i.l = s.l AND i.ix = p.fx >> ({DEPTH}-s.l) AND i.iy = p.fy >> ({DEPTH}-s.l)
            GROUP BY ALL
        )
    """


_NAME_RECT = """coalesce(list_sum(list_transform(generate_series(1, len(cell)), lambda k: CASE WHEN {low} THEN pow(0.5, k) ELSE 0 END)), 0)"""
_QT_HIST = f"""SELECT cell, count(*) AS cnt, {_NAME_RECT.format(low="cell[k] IN ('1', '3')")} AS x0, {_NAME_RECT.format(low="cell[k] IN ('0', '1')")} AS y0, pow(0.5, len(cell)) AS ds FROM ({_tree_sql("capacity")}) GROUP BY cell"""


def _quadtree_assign(kind: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        events, tree = _events_tree(spark, sf_dir, kind)
        return tree.located(events).select("id", "cell", F.col("level").cast("bigint").alias("level"))

    return f


for _kind in quadtree.KINDS:
    QUERIES[f"quadtree_assign_{_kind}"] = _quadtree_assign(_kind)
    ORACLES[f"quadtree_assign_{_kind}"] = f"SELECT id, cell, level FROM ({_tree_sql(_kind)})"


@query(f"SELECT cell, count(*) AS cnt FROM ({_tree_sql('capacity')}) GROUP BY cell")
def quadtree_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, tree = _events_tree(spark, sf_dir, "capacity")
    return tree.assign(events).groupBy("cell").agg(F.count("*").alias("cnt"))


@query(f"SELECT cell, x0, y0, ds FROM ({_QT_HIST})")
def quadtree_cell_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, tree = _events_tree(spark, sf_dir, "capacity")
    return histogram(tree.assign(events), tree).select("cell", "x0", "y0", "ds")


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS kind, n AS internal, 3*n + 1 AS leaves FROM (SELECT count(*) AS n FROM (SELECT l, ix, iy FROM ({_INNER.get(k, _OVER)}) WHERE l >= {_FULL if k == 'width' else '0'}))"
        if k != "width"
        else f"SELECT '{k}' AS kind, n AS internal, 3*n + 1 AS leaves FROM (SELECT (SELECT count(*) FROM ({_OVER}) WHERE l >= f) + CAST((pow(4, f) - 1)/3 AS BIGINT) AS n FROM (SELECT {_FULL} AS f))"
        for k in quadtree.KINDS
    )
)
def quadtree_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for kind in quadtree.KINDS:
        shape = quadtree.shape(_events_tree(spark, sf_dir, kind)[1])
        rows.append((kind, shape["internal"], shape["leaves"]))
    return spark.createDataFrame(rows, "kind string, internal bigint, leaves bigint")


@query(f"SELECT avg(w) AS width, count(*) AS widths FROM (SELECT DISTINCT w FROM ({_WIDTHS}))")
def quadtree_leaf_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the different widths of the capacity tree's leaves."""
    tree = _events_tree(spark, sf_dir, "capacity")[1]
    widths = quadtree.leaf_widths(tree.nodes, tree.n_nodes > 0)
    return spark.createDataFrame([(w,) for w in widths], "w double").agg(F.avg("w").alias("width"), F.count("*").alias("widths"))


# ---- first cells

_MEAN_STEP = f"""SELECT m.n, m.xmin, m.xmax, m.ymin, m.ymax, s.x AS xc, s.y AS yc, (SELECT sum(sqrt((s.x-q.x)*(s.x-q.x)+(s.y-q.y)*(s.y-q.y))) FROM ({Q}) q) AS sumdist
    FROM (SELECT count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, avg(x) AS ax, avg(y) AS ay FROM ({Q})) m,
    LATERAL (SELECT m.ax - {STEP}::DOUBLE * sum((m.ax - x) / nullif(sqrt((m.ax-x)*(m.ax-x)+(m.ay-y)*(m.ay-y)), 0)) AS x,
                    m.ay - {STEP}::DOUBLE * sum((m.ay - y) / nullif(sqrt((m.ax-x)*(m.ax-x)+(m.ay-y)*(m.ay-y)), 0)) AS y FROM ({Q})) s"""


def _pr(x: str, y: str, x0: str, y0: str, x1: str, y1: str) -> str:
    dx, dy = f"greatest({x0} - {x}, 0::DOUBLE, {x} - {x1})", f"greatest({y0} - {y}, 0::DOUBLE, {y} - {y1})"
    return f"sqrt({dx}*{dx} + {dy}*{dy})"


def _rr(a: str, b: tuple[str, str, str, str]) -> str:
    dx = f"greatest({b[0]} - ({a}x0+{a}ds), {a}x0 - {b[1]}, 0::DOUBLE)"
    dy = f"greatest({b[2]} - ({a}y0+{a}ds), {a}y0 - {b[3]}, 0::DOUBLE)"
    return f"sqrt({dx}*{dx} + {dy}*{dy})"


def _candidate_sql(hist: str, how: str, closed: bool, own: str) -> str:
    """The candidate cells' histogram rows."""
    if how == "mbr":
        rounds = f"""SELECT h.cell, h.cnt, h.x0, h.y0, h.ds, min(b.t) AS t FROM hist h JOIN box b
            ON h.x0 <= b.x1 AND h.x0 + h.ds >= b.x0 AND h.y0 <= b.y1 AND h.y0 + h.ds >= b.y0 GROUP BY ALL"""
    else:
        d = _pr("c.xc", "c.yc", "h.x0", "h.y0", "(h.x0+h.ds)", "(h.y0+h.ds)")
        first = f"ceil(({d} - 0.5::DOUBLE*w.w)/(0.25::DOUBLE*w.w))" if closed else f"floor(({d} - 0.5::DOUBLE*w.w)/(0.25::DOUBLE*w.w)) + 1"
        rounds = f"SELECT h.cell, h.cnt, h.x0, h.y0, h.ds, CASE WHEN h.cell = w.own THEN 0 ELSE greatest(0, {first}) END AS t FROM hist h, c, w"
    return f"""
        WITH RECURSIVE c AS MATERIALIZED ({_MEAN_STEP}), hist AS MATERIALIZED ({hist}), w AS ({own}), box(t, x0, y0, x1, y1) AS (
            SELECT 0, xmin, ymin, xmax, ymax FROM c
            UNION ALL
            SELECT t + 1, 0.9::DOUBLE*x0, 0.9::DOUBLE*y0, least(1::DOUBLE, 1.1::DOUBLE*greatest(x1, 0.001::DOUBLE)), least(1::DOUBLE, 1.1::DOUBLE*greatest(y1, 0.001::DOUBLE)) FROM box WHERE t < {candidates.BOX_ROUNDS - 1}
        ), rounds AS ({rounds}), running AS (SELECT t, sum(n) OVER (ORDER BY t) AS n FROM (SELECT t, sum(cnt) AS n FROM rounds GROUP BY t))
        SELECT cell, cnt, x0, y0, ds FROM rounds WHERE t <= coalesce((SELECT min(t) FROM running WHERE n >= {K}), (SELECT max(t) FROM running))
    """


_OWN_GRID = f"SELECT {_CELL.replace('floor(y', 'floor(yc').replace('floor(x', 'floor(xc')} AS own, {CELL_WIDTH}::DOUBLE AS w FROM c"
_OWN_QT = f"SELECT cell AS own, pow(0.5, len(cell)) AS w FROM ({_tree_sql('capacity', 'SELECT 0 AS id, xc AS x, yc AS y FROM c')})"
_CANDIDATES = {
    (p, how): _candidate_sql(_GRID_HIST if p == "gd" else _QT_HIST, how, p == "qt", _OWN_GRID if p == "gd" else _OWN_QT)
    for p, how in product(("gd", "qt"), ("mbr", "centroid"))
}


def _first_cells(spark: SparkSession, sf_dir: str, partitioning: str, how: str):
    """(points, cells, histogram, candidates, summary, query set)"""
    q = _points(spark, sf_dir, "supplier")
    s = summary.summarize(q, STEP)
    if partitioning == "gd":
        index, celled = Grid(N), _grid(spark, sf_dir)
    else:
        events, index = _events_tree(spark, sf_dir, "capacity")
        celled = index.assign(events)
    hist = histogram(celled, index)
    return celled, index, hist, candidates.candidates(hist, s, index, K, how), s, q


def _cand(partitioning: str, how: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _first_cells(spark, sf_dir, partitioning, how)[3].select("cell", "cnt")

    return f


for _p, _h in _CANDIDATES:
    QUERIES[f"cand_{_p}_{_h}"] = _cand(_p, _h)
    ORACLES[f"cand_{_p}_{_h}"] = f"SELECT cell, cnt FROM ({_CANDIDATES[_p, _h]})"


# ---- distances and sums

_NATION = testbed.SQL["nation"]


@query(f"SELECT cell, q.id AS qid, round({_pr('q.x', 'q.y', 'x0', 'y0', '(x0+ds)', '(y0+ds)')}, 6) AS dist FROM ({_GRID_HIST}) h, ({_NATION}) q")
def point_rect_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.broadcast(_points(spark, sf_dir, "nation").select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy")))
    hist = histogram(_grid(spark, sf_dir), Grid(N))
    d = g.point_rect_distance("qx", "qy", "x0", "y0", F.col("x0") + F.col("ds"), F.col("y0") + F.col("ds"))
    return hist.crossJoin(q).select("cell", "qid", r6(d, "dist"))


@query(f"SELECT cell, round({_rr('', ('m.xmin', 'm.xmax', 'm.ymin', 'm.ymax'))}, 6) AS dist FROM ({_GRID_HIST}) h, (SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM ({Q})) m")
def rect_rect_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.broadcast(summary.box(_points(spark, sf_dir, "supplier")))
    d = g.rect_rect_distance("x0", "y0", F.col("x0") + F.col("ds"), F.col("y0") + F.col("ds"), "xmin", "ymin", "xmax", "ymax")
    return histogram(_grid(spark, sf_dir), Grid(N)).crossJoin(box).select("cell", r6(d, "dist"))


_SUMS = "SELECT t.id, sum(sqrt((t.x-q.x)*(t.x-q.x)+(t.y-q.y)*(t.y-q.y))) AS dist, sum(abs(t.x-q.x)) AS dx FROM ({t}) t, ({q}) q GROUP BY t.id"


def _sums_sql(t: str = T, q: str = Q) -> str:
    return _SUMS.format(t=t, q=q)


@query(f"SELECT id, round(dist, 6) AS dist FROM ({_sums_sql()})")
def sumdist_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    qx, qy = summary.collect_query(_points(spark, sf_dir, "supplier"))
    return kernel.arrow_sums(_points(spark, sf_dir, "orders"), qx, qy).select("id", r6("dist", "dist"))


@query(f"SELECT id, round(dx, 6) AS sumdx FROM ({_sums_sql()})")
def sumdx_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    qx, _ = summary.collect_query(_points(spark, sf_dir, "supplier"))
    return kernel.arrow_x_sums(_points(spark, sf_dir, "orders"), qx).select("id", r6("sumdx", "sumdx"))


# ---- pruning


def _local_sql(p: str, how: str = "centroid") -> str:
    """id, dist of the k nearest in the candidate cells."""
    points = _GRID if p == "gd" else _tree_sql("capacity")
    inside = f"SELECT id, x, y FROM ({points}) WHERE cell IN (SELECT cell FROM ({_CANDIDATES[p, how]}))"
    return f"SELECT id, dist FROM ({_sums_sql(inside)}) ORDER BY round(dist, 9), id LIMIT {K}"


def _reason_sql(p: str) -> str:
    hist = _GRID_HIST if p == "gd" else _QT_HIST
    h1 = f"c.n * {_pr('c.xc', 'c.yc', 'x0', 'y0', '(x0+ds)', '(y0+ds)')} - c.sumdist"
    h2 = f"c.n * {_rr('', ('c.xmin', 'c.xmax', 'c.ymin', 'c.ymax'))}"
    h3 = f"(SELECT sum({_pr('q.x', 'q.y', 'h.x0', 'h.y0', '(h.x0+h.ds)', '(h.y0+h.ds)')}) FROM ({Q}) q)"
    return f"""SELECT CASE WHEN {h1} > b.best + 1e-9 THEN 'h1' WHEN {h2} > b.best + 1e-9 THEN 'h2' WHEN {h3} > b.best + 1e-9 THEN 'h3' ELSE 'keep' END AS reason,
            count(*) AS cells, CAST(sum(cnt) AS BIGINT) AS points
        FROM ({hist}) h, ({_MEAN_STEP}) c, (SELECT max(dist) AS best FROM ({_local_sql(p)})) b
        WHERE cell NOT IN (SELECT cell FROM ({_CANDIDATES[p, "centroid"]})) GROUP BY ALL"""


def _local(celled: DataFrame, chosen: DataFrame, q: DataFrame) -> DataFrame:
    return topk.top(kernel.sums(celled.join(chosen.select("cell"), "cell", "left_semi"), q), K)


def _prune_reason(p: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        celled, _, hist, chosen, s, q = _first_cells(spark, sf_dir, p, "centroid")
        best = _local(celled, chosen, q).agg(F.max("dist")).first()[0]
        rest = hist.join(chosen.select("cell"), "cell", "left_anti")
        return prune.reasons(rest, *summary.collect_query(q), s, best).groupBy("reason").agg(F.count("*").alias("cells"), F.sum("cnt").alias("points"))

    return f


for _p in ("gd", "qt"):
    QUERIES[f"prune_reason_{_p}"] = _prune_reason(_p)
    ORACLES[f"prune_reason_{_p}"] = _reason_sql(_p)


_BEST = f"(SELECT max(dist) AS best FROM ({_local_sql('gd')}))"


def _best(spark: SparkSession, sf_dir: str):
    celled, _, _, chosen, s, q = _first_cells(spark, sf_dir, "gd", "centroid")
    return celled, s, q, _local(celled, chosen, q).agg(F.max("dist")).first()[0]


@query(f"SELECT id FROM ({T}) t, ({_MEAN_STEP}) c, {_BEST} b WHERE c.n * sqrt((t.x-c.xc)*(t.x-c.xc)+(t.y-c.yc)*(t.y-c.yc)) - c.sumdist <= b.best + 1e-9")
def point_prune_h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    celled, s, _, best = _best(spark, sf_dir)
    return celled.where(prune.near_centre(s, best)).select("id")


@query(f"SELECT id, round(dist, 6) AS dist FROM ({_sums_sql()}), {_BEST} b WHERE dx <= b.best + 1e-9")
def point_prune_sumdx(spark: SparkSession, sf_dir: str) -> DataFrame:
    celled, _, q, best = _best(spark, sf_dir)
    return kernel.arrow_sums(celled, *summary.collect_query(q), sweep_below=best).select("id", r6("dist", "dist"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY round(dist, 9), id) AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM ({_local_sql('gd')})")
def local_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    celled, _, _, chosen, _, q = _first_cells(spark, sf_dir, "gd", "centroid")
    return topk.ranked(_local(celled, chosen, q)).select("rank", "id", r6("dist", "dist"))


_LEFT = f"SELECT * FROM ({_sums_sql(f'SELECT * FROM ({T}) WHERE x <= 0.6::DOUBLE')}) ORDER BY round(dist, 9), id LIMIT {K}"
_RIGHT = f"SELECT * FROM ({_sums_sql(f'SELECT * FROM ({T}) WHERE x >= 0.4::DOUBLE')}) ORDER BY round(dist, 9), id LIMIT {K}"


@query(
    f"SELECT CAST(row_number() OVER (ORDER BY round(dist, 9), id) AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM (SELECT id, min(dist) AS dist FROM (SELECT * FROM ({_LEFT}) UNION ALL SELECT * FROM ({_RIGHT})) GROUP BY id) ORDER BY rank LIMIT {K}"
)
def merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of two overlapping halves of the plane, with ids in common; only points that may be in a list are summed."""
    t, q = _points(spark, sf_dir, "orders"), _points(spark, sf_dir, "supplier")
    known = summary.collect_query(q)
    lists = [topk.top(kernel.sums(within_tangents(t.where(half), *known, K), q, known), K) for half in (F.col("x") <= 0.6, F.col("x") >= 0.4)]
    return topk.ranked(topk.merge(K, *lists)).select("rank", "id", r6("dist", "dist"))


# ---- whole queries


def _top_sql(t: str = T, q: str = Q, k: int = K) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY round(dist, 9), id) AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM ({_sums_sql(t, q)}) ORDER BY rank LIMIT {k}"


@query(_top_sql())
def gknn_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brute_force(_points(spark, sf_dir, "orders"), _points(spark, sf_dir, "supplier"), K).select("rank", "id", r6("dist", "dist"))


def _gknn(config: Config, t: str = "orders", q: str = "supplier"):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gknn(_points(spark, sf_dir, t), _points(spark, sf_dir, q), config).select("rank", "id", r6("dist", "dist"))

    return f


def _add_gknn(name: str, t: str = "orders", q: str = "supplier", k: int = K, **options) -> None:
    QUERIES[name] = _gknn(Config(k=k, n=N, capacity=CAPACITY, depth=DEPTH, step=STEP, **options), t, q)
    ORACLES[name] = _top_sql(testbed.SQL[t], testbed.SQL[q], k)


for _p, _m, _h in product(("gd", "qt"), ("bf", "ps"), ("mbr", "centroid")):
    _add_gknn(f"gknn_{_p}_{_m}_{_h}", partitioning=_p, mode=_m, candidates=_h)
_add_gknn("gknn_noheur", heuristics=False)
_add_gknn("gknn_fast_sums", fast_sums=True, mode="ps", kernel="arrow")
_add_gknn("gknn_siblings", partitioning="qt", split="siblings")
_add_gknn("gknn_width", partitioning="qt", split="width")
_add_gknn("gknn_corners", q="corners")
_add_gknn("gknn_events", t="events", partitioning="qt", k=100)


@query(f"SELECT string_agg(id::VARCHAR || chr(9) || printf('%.6f', dist), chr(9) ORDER BY rank) AS line FROM ({_top_sql()})")
def gknn_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.formatted(QUERIES["gknn_gd_bf_centroid"](spark, sf_dir), 6)


_PRUNED = f"SELECT reason, cells, points FROM ({_reason_sql('gd')})"


@query(f"""
    SELECT CAST(c.n + coalesce(sum(cells), 0) AS BIGINT) AS num_cells, c.n AS candidate_cells,
        {", ".join(f"CAST(coalesce(sum(cells) FILTER (reason = '{h}'), 0) AS BIGINT) AS {h}_success" for h in ("h1", "h2", "h3"))},
        CAST(coalesce(sum(cells) FILTER (reason <> 'h1'), 0) AS BIGINT) AS h1_fail,
        CAST(coalesce(sum(cells) FILTER (reason IN ('h3', 'keep')), 0) AS BIGINT) AS h2_fail,
        CAST(coalesce(sum(cells) FILTER (reason = 'keep'), 0) AS BIGINT) AS h3_fail,
        CAST(coalesce(sum(cells) FILTER (reason = 'keep'), 0) AS BIGINT) AS cells_proc,
        CAST(coalesce(sum(points) FILTER (reason = 'keep'), 0) AS BIGINT) AS points_left
    FROM ({_PRUNED}), (SELECT count(*) AS n FROM ({_CANDIDATES["gd", "centroid"]})) c GROUP BY c.n
""")
def gknn_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = run(_points(spark, sf_dir, "orders"), _points(spark, sf_dir, "supplier"), Config(k=K, n=N, step=STEP))
    counted = prune.counters(done.reasons, done.candidate_cells.count())
    out = spark.createDataFrame(counted.collect(), counted.schema)  # one row
    done.close()
    return out


_KEPT = f"""SELECT h.cell FROM ({_GRID_HIST}) h, ({_MEAN_STEP}) c, {_BEST} b
    WHERE cell NOT IN (SELECT cell FROM ({_CANDIDATES["gd", "centroid"]}))
      AND c.n * {_pr('c.xc', 'c.yc', 'x0', 'y0', '(x0+ds)', '(y0+ds)')} - c.sumdist <= b.best + 1e-9
      AND c.n * {_rr('', ('c.xmin', 'c.xmax', 'c.ymin', 'c.ymax'))} <= b.best + 1e-9
      AND (SELECT sum({_pr('q.x', 'q.y', 'h.x0', 'h.y0', '(h.x0+h.ds)', '(h.y0+h.ds)')}) FROM ({Q}) q) <= b.best + 1e-9"""


@query(f"""
    SELECT count(*) AS points, count(*) FILTER (h4) AS h4_left, count(*) FILTER (NOT h4) AS h4_cut,
        count(*) FILTER (h4 AND dx <= best + 1e-9) AS sumdx_left, count(*) FILTER (h4 AND dx > best + 1e-9) AS sumdx_cut
    FROM (
        SELECT s.dx, b.best, c.n * sqrt((t.x-c.xc)*(t.x-c.xc)+(t.y-c.yc)*(t.y-c.yc)) - c.sumdist <= b.best + 1e-9 AS h4
        FROM ({_GRID}) t JOIN ({_sums_sql()}) s USING (id), ({_MEAN_STEP}) c, {_BEST} b WHERE t.cell IN ({_KEPT})
    )
""")
def gknn_point_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the bounds on points fare in the cells that the bounds on cells keep."""
    q = _points(spark, sf_dir, "supplier")
    done = run(_points(spark, sf_dir, "orders"), q, Config(k=K, n=N, step=STEP))
    kept = done.kept_points if done.kept_points is not None else _points(spark, sf_dir, "orders").limit(0)
    counted = prune.point_counters(kept, summary.collect_query(q)[0], done.summary, done.best)
    out = spark.createDataFrame(counted.collect(), counted.schema)  # one row
    done.close()
    return out


# ---- prepared points


def _prepartitioned(partitioning: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Points are written with their cells once; the query reads these."""
        path, config = shared_path(spark, "prepared"), Config(k=K, n=N, capacity=CAPACITY, depth=DEPTH, step=STEP, partitioning=partitioning)
        io.write_prepared(prepare(_points(spark, sf_dir, "orders"), config), path)
        return gknn(None, _points(spark, sf_dir, "supplier"), config, prepared=io.read_prepared(spark, path, partitioning)).select("rank", "id", r6("dist", "dist"))

    return f


for _p, _name in (("gd", "gknn_prepartitioned"), ("qt", "gknn_prepartitioned_qt")):
    QUERIES[_name], ORACLES[_name] = _prepartitioned(_p), _top_sql()


# ---- files: each is written and read again


@query(f"SELECT id, round(x, 12) AS x, round(y, 12) AS y FROM ({T})")
def file_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "points")
    io.write_text(_points(spark, sf_dir, "orders"), path)
    return io.read_text(spark, path).select("id", F.round("x", 12).alias("x"), F.round("y", 12).alias("y"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY x, id) AS INTEGER) AS rn, id, round(x, 12) AS x, round(y, 12) AS y FROM ({Q})")
def file_sorted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "sorted")
    io.write_sorted(_points(spark, sf_dir, "supplier"), path)
    return io.read_sorted(spark, path).select("rn", "id", F.round("x", 12).alias("x"), F.round("y", 12).alias("y"))


@query(f"SELECT n, {', '.join(f'round({c}, 6) AS {c}' for c in ('xmin', 'xmax', 'ymin', 'ymax', 'xc', 'yc', 'sumdist'))} FROM ({_MEAN_STEP})")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, s = shared_path(spark, "summary"), summary.summarize(_points(spark, sf_dir, "supplier"), STEP)
    io.write_summary_text(spark, s, path)
    again = io.read_summary_text(spark, path, s.n)
    rows = spark.createDataFrame([(again.n, again.xmin, again.xmax, again.ymin, again.ymax, again.xc, again.yc, again.sumdist)], "n bigint, xmin double, xmax double, ymin double, ymax double, xc double, yc double, sumdist double")
    return rows.select("n", *(r6(c, c) for c in rows.columns[1:]))


@query(f"SELECT cell::VARCHAR AS cell, id, x, y FROM ({_GRID})")
def file_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "cells")
    io.write_cell_text(_grid(spark, sf_dir), path)
    return io.read_cell_text(spark, path)


@query(f"SELECT cell::VARCHAR AS cell, count(*) AS cnt FROM ({_GRID}) GROUP BY cell")
def file_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "histogram")
    io.write_histogram(_grid(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("cnt")), path)
    return io.read_histogram(spark, path)


@query(f"SELECT cell::VARCHAR AS cell FROM ({_CANDIDATES['gd', 'centroid']})")
def file_candidate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "candidates")
    io.write_candidate_cells(_first_cells(spark, sf_dir, "gd", "centroid")[3], path)
    return io.read_candidate_cells(spark, path)


@query(f"SELECT id, cell FROM ({_tree_sql('siblings')})")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points placed by a tree that was read from its line of bits."""
    path = shared_path(spark, "tree")
    events, tree = _events_tree(spark, sf_dir, "siblings")
    io.write_tree_bits(tree, path)
    return io.read_tree_bits(spark, path, DEPTH).assign(events).select("id", "cell")


@query(_top_sql())
def file_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "neighbours")
    io.write_neighbours(gknn(_points(spark, sf_dir, "orders"), _points(spark, sf_dir, "supplier"), Config(k=K, n=N, step=STEP)), path)
    return topk.ranked(io.read_neighbours(spark, path)).select("rank", "id", r6("dist", "dist"))

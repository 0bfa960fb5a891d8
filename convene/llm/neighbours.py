"""Exact nearest neighbours by a block matrix join with int8 tiles.

Rows are dealt by a hash into blocks of candidates, and the queries among them into strips, packed as int8
codes with a scale and an error for each vector; the original vectors don't travel with them. Every strip
meets every block in an equi-join on the block's number. A tile multiplies the codes; the quantisation
errors bound how far an approximate inner product lies from the true one:

    |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|

where q', c' are the vectors that the codes stand for. A candidate whose upper bound is under the k-th
largest lower bound, in its tile or over all tiles of the query, can't be among the k nearest. The
survivors' vectors are fetched by a join on their numbers, the products are computed again in double
precision, and heaps keep the best. So the result is exact, and its recall is one.

Equal vectors are one class, by a hash of 128 bits, which is compared once, as a query and as a candidate.
Of a class only the k + 1 smallest ids can be among anyone's k nearest. A class finds its k + 1 nearest
rows, its own included; a query row takes these without itself.

Only strips are copied, once for each block of `BLOCK_BYTES` of codes; blocks are written once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convene.llm.common import cut, discard, lean_batches

#: Bytes of codes in a block of candidates, and in a strip of queries; rows of a tile's product.
BLOCK_BYTES, STRIP_BYTES, QUERY_STEP, CANDIDATE_STEP = 8 << 20, 1 << 18, 256, 8192
#: Heaps that a task holds at once.
HEAPS = 20_000

_PACKED = "dim int, place long, ids binary, codes binary, scales binary, errors binary, norms binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows, scales, lengths of the errors (rounded up), lengths of the rows."""
    x = x.astype(np.float64)
    # the largest component becomes 127; lengths are taken of scaled rows, so no square leaves the range
    scale = np.abs(x).max(1, initial=0) / 127
    scale[scale == 0] = 1
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    error = _length(x - codes * scale[:, None])
    return codes, scale, error * (1 + 1e-9), _length(x)


def _length(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, initial=0)
    top[top == 0] = 1
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def _packed(table: pa.Table) -> pa.Table:
    """One row of a block's numbers, codes and bounds, by number."""
    order = np.argsort(table.column("row").to_numpy(), kind="stable")
    ids = table.column("row").to_numpy()[order]
    x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
    cells = [ids.astype("<i8"), *quantise(x)]
    fields = [pa.field("dim", pa.int32()), pa.field("place", pa.int64())] + [pa.field(c.split()[0], pa.binary()) for c in _PACKED.split(", ")[2:]]
    return pa.Table.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([table.column("place")[0].as_py()]), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], schema=pa.schema(fields))


class Block:
    def __init__(self, row: dict, prefix: str = ""):
        get = lambda name: row[f"{prefix}{name}"]
        self.ids = np.frombuffer(get("ids"), "<i8")
        codes = np.frombuffer(get("codes"), np.int8).reshape(len(self.ids), -1)
        # whole numbers up to 127: float32 products are exact up to 1,040 dimensions, float64 beyond
        self.kind = np.float32 if codes.shape[1] <= 1040 else np.float64
        self.codes = codes
        self.scales, self.errors, self.norms = (np.frombuffer(get(c), np.float64) for c in ("scales", "errors", "norms"))
        self.decoded = self.scales * np.sqrt(np.einsum("ij,ij->i", codes, codes, dtype=np.float64))


def tile(queries: Block, candidates: Block, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, low, high) of the pairs that may be among a query's k nearest: numbers, and
    bounds of the product."""
    for start in range(0, len(queries.ids), QUERY_STEP):
        part = slice(start, start + QUERY_STEP)
        own = queries.ids[part]
        codes = queries.codes[part].astype(queries.kind)
        floor = np.full(len(own), -np.inf)
        held: list[tuple[np.ndarray, ...]] = []
        best = np.full((len(own), 0), -np.inf)
        for at in range(0, len(candidates.ids), CANDIDATE_STEP):
            some = slice(at, at + CANDIDATE_STEP)
            near = (codes @ candidates.codes[some].astype(candidates.kind).T).astype(np.float64) * queries.scales[part, None] * candidates.scales[some]
            bound = (queries.errors[part, None] * candidates.norms[some] + queries.decoded[part, None] * candidates.errors[some]) * (1 + 1e-9)
            # the double-precision sums round too
            bound += 1e-13 * queries.norms[part, None] * candidates.norms[some]
            low = near - bound
            best = np.concatenate([best, low if low.shape[1] <= k else np.partition(low, -k, 1)[:, -k:]], 1)
            if best.shape[1] > k:
                best = np.partition(best, -k, 1)[:, -k:]
            if best.shape[1] == k:
                floor = best.min(1)
            q, c = np.nonzero(near + bound >= floor[:, None])
            held.append((q, candidates.ids[some][c], low[q, c], (near + bound)[q, c]))
        q, c, low, high = (np.concatenate(x) for x in zip(*held))
        fits = high >= floor[q]
        yield own[q[fits]], c[fits], low[fits], high[fits]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, block_bytes: int = BLOCK_BYTES, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """Each query's k largest inner products: query_id, rank (from 1), vec_id, score. Ties go to the
    smaller id.

    vectors: vec_id and embedding; is_query: an expression on vec_id that says which rows are queries.
    Null ids and vectors that are null, empty, all zero, or hold null or non-finite components take no
    part. Every row is a candidate of every query but itself, and a query of its own: rows that share a
    vec_id, or are alike in all, too. Vectors of different dimension are not compared; those of floats
    and of any other numbers are compared in double precision. Fewer candidates than k: all of them. No
    query, no row. Other columns are ignored."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    valid = lean_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where(
        F.col("vec_id").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    more = k + 1
    cls = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")]
    is_query = F.coalesce(is_query, F.lit(False))
    rows = cut(valid.select("vec_id", is_query.alias("query"), *cls), "vector-rows")
    grouped = valid.select("embedding", is_query.alias("query"), *cls).groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.max("query").alias("query"))
    classes = cut(grouped.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "vector-classes")
    per = classes.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("query").cast("long")).alias("q"))
    parts = lambda c, size: F.greatest(F.lit(1).cast("long"), F.ceil(F.col(c) * F.col("dim") / size))
    sizes = cut(per.select("dim", parts("n", block_bytes).alias("blocks"), parts("q", strip_bytes).alias("strips")), "vector-sizes")
    dealt = classes.join(F.broadcast(sizes), "dim")  # a row for each dimension
    pack = lambda df, n: df.select("dim", F.pmod("h2", F.col(n)).alias("place"), "row", "embedding").groupBy("dim", "place").applyInArrow(_packed, _PACKED)
    candidates, strips = cut(pack(dealt, "blocks"), "vector-blocks"), cut(pack(dealt.where("query"), "strips"), "vector-strips")
    columns = [c.split()[0] for c in _PACKED.split(", ")[2:]]
    spread = strips.join(F.broadcast(sizes), "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("place"), *(F.col(c).alias(f"q_{c}") for c in columns))
    tiles = spread.join(candidates, ["dim", "place"])
    schema = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["dim"], row["place"]) != current:
                    current, block = (row["dim"], row["place"]), Block(row)
                for found in tile(Block(row, "q_"), block, more):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

    met = cut(tiles.mapInArrow(run, "query long, row long, low double, high double"), "vector-pairs")
    # the least of the k + 1 largest lower bounds over all tiles; tasks keep no more of a query
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
    floor = met.select("query", "low").withColumn("place", place).where(F.col("place") <= more).groupBy("query").agg(F.min("low").alias("low"), F.count("*").alias("n"))
    floor = cut(floor.select("query", F.when(F.col("n") == more, F.col("low")).otherwise(float("-inf")).alias("floor")), "vector-floors")
    left = met.join(floor, "query").where(F.col("high") >= F.col("floor")).select("query", "row")
    member = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    members = cut(rows.select("h1", "h2", "vec_id").withColumn("place", member).where(F.col("place") <= more).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vector-members")
    c = classes.join(members, ["h1", "h2"]).select("row", F.col("embedding").alias("c_vector"), "ids")
    q = classes.where("query").select(F.col("row").alias("query"), F.col("embedding").alias("q_vector"))
    # summed in order, so that equal vectors score alike wherever they lie
    score = F.aggregate(F.zip_with("q_vector", "c_vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = left.join(c, "row").join(q, "query").select("query", score.alias("score"), "ids")
    hits = scored.mapInArrow(lambda batches: _heaped(batches, more), _HITS).groupBy("query").applyInArrow(lambda t: _merged(t, more), "query long, hits array<struct<score:double,vec_id:long>>")
    squared = F.aggregate(F.transform("embedding", lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, x: s + x)
    of_class = classes.where("query").select("h1", "h2", F.col("row").alias("query"), squared.alias("own"))
    nearest_rows = cut(hits.join(of_class, "query").select("h1", "h2", "hits", "own"), "vector-nearest")
    # the class side is written: many rows of one class can be split in the join
    asked = rows.where("query").select(F.col("vec_id").alias("query_id"), "h1", "h2").join(nearest_rows, ["h1", "h2"])
    itself = F.struct(F.col("query_id").alias("vec_id"), F.col("own").alias("score"))
    asked = asked.withColumn("at", F.array_position(F.transform("hits", lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))), itself))
    others = F.filter("hits", lambda x, i: (i + 1 != F.col("at")) & (i < F.when(F.col("at") > 0, more).otherwise(k)))
    listed = asked.select("query_id", F.posexplode(others).alias("rank", "hit"))
    discard(sizes, candidates, strips, met, floor, members)
    return listed.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


_HITS = "query long, score double, vec_id long"


def _push(heap: list, item: tuple[float, int], most: int) -> bool:
    if len(heap) < most:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)
    else:
        return False
    return True


def _heaped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The best (score, id) of each query among a task's classes."""
    heaps: dict[int, list] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(q, s, -c) for q, heap in heaps.items() for s, c in heap]
        heaps.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], names=["query", "score", "vec_id"])

    for batch in batches:
        for q, s, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            heap = heaps.setdefault(q, [])
            for c in ids:
                if not _push(heap, (s, -c), most):
                    break
        if len(heaps) > HEAPS:
            yield from flush()
    yield from flush()


def _merged(hits: pa.Table, most: int) -> pa.Table:
    """A query's heaps of all tasks as one list, best first."""
    heap: list = []
    for s, c in zip(hits.column("score").to_pylist(), hits.column("vec_id").to_pylist()):
        _push(heap, (s, -c), most)
    found = [{"score": s, "vec_id": -c} for s, c in sorted(heap, reverse=True)]
    kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
    return pa.table({"query": hits.column("query").slice(0, 1).combine_chunks(), "hits": pa.array([found], kind)})

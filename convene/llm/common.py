"""Helpers shared by the corpus operators: tables, shared storage, Arrow batches, hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset and all runs in one
    process, as in tests, a folder beside the warehouse; a cluster without one is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that a lost executor costs
    no more than the tasks it held and nothing above is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of cut() from shared storage, when all that was read from them is itself written."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(conf).delete(path, True)


#: Rows of an Arrow batch; with long documents, Spark's default of 10,000 can be gigabytes.
BATCH_ROWS = 2000


def lean_batches(df: DataFrame) -> DataFrame:
    """df as it is; from now on its session hands Python batches of at most BATCH_ROWS rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def spaced(text: Column) -> Column:
    """A text with tabs, vertical tabs, form feeds and carriage returns as spaces. translate() goes
    character by character, so only texts that hold one are put through it."""
    blank = "\t\r\x0b\x0c"
    odd = F.contains(text, F.lit(blank[0]))
    for c in blank[1:]:
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.translate(text, blank, " " * len(blank))).otherwise(text)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of a column hold at most `limit` bytes in each, or one row."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        ends = _ends(batch.column(column))
        while at < n:
            base = ends[at]
            to = int(np.searchsorted(ends, base + limit, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


def _ends(column: pa.Array) -> np.ndarray:
    """Offsets of a string or binary column, one more than it has rows."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and each row's offsets in them (null: no bytes)."""
    ends = _ends(column).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    ends = ends - ends[0]
    if column.null_count and len(raw):  # a null may own bytes
        keep = np.repeat(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends))
        if not keep.all():
            lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
            raw, ends = raw[keep], np.concatenate([[0], np.cumsum(lengths)])
    return raw, ends


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


#: Bits of the largest map of buckets that is broadcast: 64 of them a row of two numbers, 2^19 rows at most.
MOST_MAP_BITS = 1 << 25


def near_buckets(rows: DataFrame, column: Column, wanted: DataFrame, most_bits: int = MOST_MAP_BITS) -> DataFrame:
    """Rows whose `column` (a bigint) may be a value of the one-column table `wanted`: all that are, and
    about one in 16 others. A map of hash buckets, 16 bits for each wanted value, is broadcast as long as
    it stays under `most_bits`. Beyond that it keeps this size, unless most of it would be full, and rows
    that it lets through meet `wanted` in a shuffled join, which lets no other row through."""
    name, bits = wanted.columns[0], 1 << 14
    count = wanted.count()
    while bits < 16 * count:
        bits *= 2
    if bits > most_bits:
        near = _in_buckets(rows, column, wanted, most_bits) if count <= most_bits else rows
        # a semi join would be pushed below the map
        return near.join(wanted.select(F.col(name).alias("near__")).distinct(), column == F.col("near__")).drop("near__")
    return _in_buckets(rows, column, wanted, bits)


def _in_buckets(rows: DataFrame, column: Column, wanted: DataFrame, bits: int) -> DataFrame:
    """Rows whose `column` falls into one of `bits` hash buckets that a value of `wanted` falls into."""
    name = wanted.columns[0]
    bucket = F.pmod(F.xxhash64(F.col(name)), F.lit(bits))
    words = wanted.select(bucket.alias("b")).groupBy(F.shiftright("b", 6).alias("w__")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits__"))
    own = F.pmod(F.xxhash64(column), F.lit(bits))
    joined = rows.join(F.broadcast(words), F.shiftright(own, 6) == F.col("w__"))
    return joined.where(F.getbit("bits__", own.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("w__", "bits__")


def only_rows(rows: DataFrame, number: str, wanted: DataFrame) -> DataFrame:
    """Rows whose number (a bigint, in runs) is in the one-column frame `wanted`. A bitmap of the numbers,
    64 to a row, is broadcast as long as it stays under MOST_MAP_BITS, so the rows stay where they are;
    beyond that both sides meet in a shuffled semi join."""
    name = wanted.columns[0]
    words = wanted.groupBy(F.shiftright(name, 6).alias("w__")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("bits__"))
    words = cut(words, "row-bits")
    if words.count() * 64 > MOST_MAP_BITS:
        return rows.join(wanted, F.col(number) == wanted[name], "left_semi")
    joined = rows.join(F.broadcast(words), F.shiftright(number, 6) == F.col("w__"))
    return joined.where(F.getbit("bits__", F.col(number).bitwiseAND(F.lit(63)).cast("int")) == 1).drop("w__", "bits__")


#: Rows of a few numbers that make a task worth its start.
TASK_ROWS = 250_000
#: Edges that one task's union-find takes on, in some 300 MB.
UNITE_ROWS = 1_000_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than so many short rows are worth."""
    return df.coalesce(max(1, min(shuffle_parts(df.sparkSession), -(-rows // TASK_ROWS))))


class Forest:
    """Union-find over any keys."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (to := up.get(root, root)) != root:
            root = to
        while (to := up.get(x, x)) != root:
            up[x] = root
            x = to
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the graph with edges (a, b) of bigints; root is the least node
    that it is connected to.

    UNITE_ROWS edges or fewer are one task's work, a union-find. Of more, large-star and small-star steps by
    turns: every step hangs nodes on the least node near them, until nothing moves; a chain of n nodes
    takes about log n rounds. Each round is written to shared storage."""
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= UNITE_ROWS:
        return now.coalesce(1).mapInArrow(_united, "node long, root long")
    mark = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (new.n, new.h) == mark or not new.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = (new.n, new.h)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the small sides are written, so that the joins can split a hot node's edges
        least = cut(few_tasks(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), new.n), "edges-least")
        # large star: neighbours above a node hang on the least node beside it
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(few_tasks(large.where(F.col("a") != F.col("b")), new.n), "edges-large")
        discard(now, least)
        # small star: the neighbours below a node, and the node, hang on the least of them
        under = cut(few_tasks(large.groupBy("a").agg(F.min("b").alias("m")), new.n), "edges-under")
        small = large.join(under, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(under.select("a", F.col("m").alias("b")))
        now = cut(few_tasks(few_tasks(small.where(F.col("a") != F.col("b")), new.n).distinct(), new.n), "edges-small")
        discard(large, under)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node of its tree) of all edges of a task."""
    forest, nodes = Forest(), set()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes.update((a, b))
            forest.join(a, b)
    found = sorted(nodes)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([forest.find(x) for x in found], pa.int64())], names=["node", "root"])

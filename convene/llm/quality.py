"""Text quality from compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained, one on texts labelled 1 and one on texts labelled 0. A text is cut into
blocks, so that its own earlier words can't take the dictionaries' place, and every block is compressed
with both. The difference of the sizes, over the bytes of text, is positive where the good dictionary
fits better. A logistic fit on labelled texts that trained no dictionary turns it, with the log length
and the compressed share, into a probability.

The fit uses a bounded sample of labelled rows: at most `dictionary_docs` for each label and dictionary,
and `calibration_docs` for each label, taken by a hash of doc_id; of rows that share a doc_id, the one
with the least text hash. A dictionary's documents give `DICTIONARY_BLOCKS` blocks each, which are cut on
the executors. Everything else reads all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convene.llm.common import lean_batches

BLOCK = 1024
DICTIONARY_BYTES = 112 << 10
DICTIONARY_DOCS = 2000
CALIBRATION_DOCS = 2000
#: Blocks that one document gives to a dictionary, spread evenly over it.
DICTIONARY_BLOCKS = 16
LEVEL = 3


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, bytes]
    weights: tuple[float, float, float, float]


def fold(column: str | Column, folds: int) -> Column:
    """crc32 of a column as text, modulo a number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


@lru_cache(4)
def _compressors(dictionaries: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for d in dictionaries:
        data = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT if d[:4] != b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_FULLDICT)
        data.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def features(dictionaries: tuple[bytes, bytes], text: bytes) -> tuple[float, float, float]:
    """Size difference in hundredths of the text, log of its length, share left by the good dictionary."""
    bad, good = _compressors(dictionaries)
    sizes = [0, 0]
    for i in range(0, len(text), BLOCK):
        block = text[i : i + BLOCK]
        sizes[0] += len(bad.compress(block))
        sizes[1] += len(good.compress(block))
    n = max(1, len(text))
    return 100 * (sizes[0] - sizes[1]) / n, math.log1p(len(text)), sizes[1] / n


def _feature_rows(dictionaries: tuple[bytes, bytes], texts: list[str | None]) -> np.ndarray:
    return np.array([features(dictionaries, (t or "").encode("utf-8", "surrogatepass")) for t in texts]).reshape(-1, 3)


def sample_blocks(text: str) -> list[bytes]:
    """The blocks that a text gives to a dictionary."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = range(0, len(raw), BLOCK)
    return [raw[i : i + BLOCK] for i in starts[:: max(1, -(-len(starts) // DICTIONARY_BLOCKS))]]


def _dictionary(samples: list[list[bytes]]) -> bytes:
    blocks = [b for s in sorted(samples) for b in s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the samples are the dictionary
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic fit (constant first), by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, dictionary_docs: int = DICTIONARY_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Model:
    """Learn from labels (doc_id, quality in 0 and 1; others ignored) of documents for which
    `held_out`, an expression on doc_id, is false."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out).select("doc_id", "quality").distinct()
    ids = None
    for label in (0, 1):
        some = known.where(F.col("quality") == label).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(dictionary_docs + calibration_docs)
        ids = some if ids is None else ids.unionByName(some)
    chosen = ids.select("doc_id", F.col("quality").alias("label"), (F.pmod(F.xxhash64("h"), F.lit(dictionary_docs + calibration_docs)) < dictionary_docs).alias("train"))
    # at most 2 * (dictionary_docs + calibration_docs) ids are broadcast, and as many texts are left
    held = lean_batches(docs).select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id")
    rows = held.groupBy("doc_id").agg(F.min_by(F.struct("text", "label", "train"), F.xxhash64("text")).alias("r")).select("r.*")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [sample_blocks(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.list_(pa.binary())), batch.column(1)], names=["blocks", "label"])

    samples = {0: [], 1: []}
    for r in rows.where("train").select("text", F.col("label").cast("int")).mapInArrow(blocks, "blocks array<binary>, label int").toLocalIterator():
        samples[r.label].append([bytes(b) for b in r.blocks])
    dictionaries = (_dictionary(samples[0]), _dictionary(samples[1]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _feature_rows(dictionaries, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, k]) for k in range(3)), batch.column(1)], names=["a", "b", "c", "label"])

    got = rows.where(~F.col("train")).select("text", F.col("label").cast("int")).mapInArrow(measure, "a double, b double, c double, label int").collect()
    x, y = np.array([r[:3] for r in got]).reshape(-1, 3), np.array([r.label for r in got], float)
    order = np.lexsort((y, *x.T))
    if len(set(y)) < 2:  # nothing to tell apart: the share of label 1, smoothed
        n = [len(samples[0]) + (y == 0).sum(), len(samples[1]) + (y == 1).sum()]
        return Model(dictionaries, (math.log((n[1] + 1) / (n[0] + 1)), 0.0, 0.0, 0.0))
    return Model(dictionaries, tuple(float(v) for v in logistic(x[order], y[order])))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted and size_difference for every row of docs (doc_id, text). Texts of any
    length are compressed whole, block by block. A null text scores as an empty one; repeated rows, and
    equal texts, score alike; other columns are ignored; an empty table gives no row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("size_difference", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 112 KB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = np.array(m.weights)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                f = _feature_rows(m.dictionaries, batch.column(1).to_pylist())
                p = 1 / (1 + np.exp(-np.clip(w[0] + f @ w[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(f[:, 0] / 100)], schema=schema)

    return lean_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, size_difference double")

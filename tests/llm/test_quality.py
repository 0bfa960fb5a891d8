import math
import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from convene.llm import quality


def test_fold(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    for r in df.select("doc_id", quality.fold("doc_id", 5).alias("f")).collect():
        assert r.f == zlib.crc32(str(r.doc_id).encode()) % 5


def _texts():
    rng = random.Random(5)
    good = ["river", "stone", "evening", "walked", "slowly", "garden", "window", "letter"]
    bad = ["BUY!!", "$$$", "click|here", "###", "w1n", "fr33", ">>>", "%%%"]
    return [(i, " ".join(rng.choices(good if i % 3 else bad, k=rng.randint(5, 400))), int(i % 3 > 0)) for i in range(900)]


def test_held_out_accuracy(spark):
    rows = _texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, ""), (5001, "", ""), (None, "river", "")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5000, None), (77777, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, quality.fold("doc_id", 5) == 0, 200, 100)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) + 3
    held = [(q, got[i].predicted) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[5000].score == got[5001].score


def test_no_or_one_label(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(2, None)]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(False))
        assert [0 < r.score < 1 for r in quality.score(docs, model).collect()] == [True, True]
        assert quality.score(docs.limit(0), model).count() == 0


def test_scores_by_plain_compression(spark):
    """Sizes from compressors of one use and the logistic curve, for each document; weights where the
    penalised likelihood is flat."""
    rows = _texts()[:300]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "river " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(False), 60, 60)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}

    def sizes(raw, dictionary):
        data = zstandard.ZstdCompressionDict(dictionary)
        one = lambda b: len(zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))
        return sum(one(raw[k : k + 1024]) for k in range(0, len(raw), 1024))

    for r in docs.collect():
        raw = (r.text or "").encode()
        bad, good = (sizes(raw, d) for d in model.dictionaries)
        n = max(1, len(raw))
        z = np.dot(model.weights, [1, 100 * (bad - good) / n, math.log1p(len(raw)), good / n])
        assert math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-max(-30, min(30, z)))), abs_tol=1e-9)
        assert math.isclose(got[r.doc_id].size_difference, (bad - good) / n, abs_tol=1e-12)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200) > 0).astype(float)
    w, ones = quality.logistic(x, y), np.c_[np.ones(200), x]
    assert np.abs(ones.T @ (y - 1 / (1 + np.exp(-ones @ w))) - 1e-3 * w).max() < 1e-6


def test_repeated_ids_count_once(spark):
    rows = _texts()[:120]
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    schema = "doc_id long, text string"
    once = quality.fit(spark.createDataFrame([(i, t) for i, t, _ in rows], schema), labels, F.lit(False), 30, 20)
    again = quality.fit(spark.createDataFrame([(i, t) for i, t, _ in rows for _ in range(5)], schema), labels, F.lit(False), 30, 20)
    assert once == again

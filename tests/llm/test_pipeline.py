import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from convene.llm import common, ngram_join, packing
from tests.llm.test_ngram_join import brute
from tests.llm.test_templates import by_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    for df in stages[1:-1]:
        assert all(r.n_chars == len(r.text) for r in df.collect())


def test_language_keeps_texts_in_known_languages(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
    assert all(any(c.isalpha() for c in t) for _, t in after)


def test_line_dedup_equals_sql(stages):
    want = [(d, t) for d, t, _, n in by_sql(rows(stages[1])) if not n or t.strip()]
    assert rows(stages[2]) == sorted(want)


def test_one_of_each_group_stays(stages):
    before = rows(stages[2])
    want = {d for d, _, c in brute(before) if d == c}
    assert {d for d, _ in rows(stages[3])} == want


def test_mixture(stages):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before, taken = stages[3].collect(), Counter()
    for r in stages[4].collect():
        taken[r.source] += words(r.text)
    sizes = Counter()
    for r in before:
        sizes[r.source] += words(r.text)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)


def test_packing(stages):
    t = Tokenizer.from_file(packing.public_byte_bpe())
    ids = Counter()
    for r in stages[4].collect():
        got = [*t.encode(r.text, add_special_tokens=False).ids, 0]
        ids[r.doc_id, len(got), zlib.crc32(np.array(got[:1024], "<u4").tobytes()) if len(got) >= 1024 else 0] += len(got)
    pieces = stages[5].collect()
    assert sum(r.length for r in pieces) == sum(ids.values())
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert all(f <= 1024 for f in fill.values()) and sum(f < 1024 for f in fill.values()) <= 1


def test_run_is_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(p.run(spark, SF)) == key(stages[-1])
    assert ngram_join.PERCENT == 80


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_near_duplicates_with_shared_or_null_ids(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, words(0)), (2, words(0) + " end"), (2, words(1)), (None, words(2)), (None, words(2) + " end"), (3, words(3)), (3, words(3) + " end"), (None, words(3) + " last"), (4, words(4)), (4, words(4)), (5, None), (5, None), (6, None), (6, ""), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, (r.text or "-").split()[:1]) for r in p.ngram_jaccard(spark, docs, SF).collect()]
    want = [(1, ["w0x0"]), (2, ["w1x0"]), (None, ["w2x0"]), (3, ["w3x0"]), (4, ["w4x0"]), (5, ["-"]), (6, ["-"]), (6, ["-"]), (7, [])]
    assert sorted(got, key=str) == sorted(want, key=str)


EXTRA = ["score", "lang_pred", "known", "id__", "th__", "gone__", "part__", "size__", "taken__", "key__", "row", "plan", "n", "idx", "cls", "n_dropped", "n_lines", "own"]


def test_columns_of_any_name(spark):
    """Extra columns named like helpers come through every stage as they are."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "mo", "te", "su") for b in ("lan", "dor", "vik")]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choices(words, k=rng.randint(8, 30))) for _ in range(3)] + ["All rights reserved."]
        rows.append((i, "\n".join(lines), "aa" if i % 4 else None, f"s{i % 3}" if i % 5 else None, 0, *range(i, i + len(EXTRA))))
    rows += [(60, rows[0][1] + " more", "aa", "s1", 0, *range(60, 60 + len(EXTRA)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in EXTRA))
    before = docs
    for name, stage in p.STAGES[:-1]:
        out = p.cut(stage(spark, before, SF), f"test-{name}")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(tuple(r)[5:] == tuple(range(r.doc_id, r.doc_id + len(EXTRA))) for r in got), name
        assert all(r.n_chars == len(r.text) for r in got) or name in ("language_id", "ngram_jaccard"), name
        assert {r.source for r in got} <= {None, "s0", "s1", "s2"}, name
        before = out
    assert all(r.lang == "aa" for r in before.collect())
    assert p.pack(spark, before, SF).agg({"length": "sum"}).first()[0] > 0


def test_null_and_empty_columns(spark):
    rows = [(None, None, None, None, None), (1, None, None, "a", None), (2, "", "aa", None, 0), (None, "one two three four five six", None, None, 5), (3, "one two three four five six", "aa", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    learned = docs.unionByName(spark.createDataFrame([(i, "one two three four five six seven", "aa", "a", 1) for i in range(10, 30)], docs.schema))
    assert ids(p.language_id(spark, learned, SF)) == [(False, 3), *((False, i) for i in range(10, 30)), (True, 0)]
    assert ids(p.line_dedup(spark, docs, SF)) == [(False, 1), (False, 2), (False, 3), (True, 0), (True, 0)]
    assert ids(p.ngram_jaccard(spark, docs, SF)) == [(False, 1), (False, 2), (False, 3), (True, 0)]
    assert set(ids(p.mixing_weights(spark, docs, SF))) <= {(False, 3), (True, 0)}
    assert p.pack(spark, docs, SF).count() >= 5


def test_unknown_languages_go(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["haus", "strasse", "gehen", "nicht", "licht"], k=20)), "de", "s", 0) for i in range(60)]
    rows += [(100, "qwx zzkk vvorp xylq brrm " * 9 + "haus", None, "s", 0), (101, "haus gehen licht", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.language_id(spark, docs, SF).collect()} == {*range(60), 101}


def test_planted_cases(spark):
    """Exact and near copies and a long passage of two documents are caught; clean documents stay."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    clean = {i: "\n".join(text(40) for _ in range(6)) for i in range(40)}
    passage = text(70)
    docs = dict(clean)
    docs[100], docs[101] = clean[0], clean[1].replace(" ", " added ", 1)
    docs[102], docs[103] = clean[2] + "\n" + passage + "\n" + text(60), passage + "\n" + "\n".join(text(40) for _ in range(8))
    rows = [(i, t, "aa", f"s{i % 4}", len(t)) for i, t in docs.items()]
    before = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lined = p.cut(p.line_dedup(spark, p.cut(p.language_id(spark, before, SF), "planted-1"), SF), "planted-2")
    texts = {r.doc_id: r.text for r in lined.collect()}
    assert passage in texts[102] and passage not in texts[103] and all(texts[i] == clean[i] for i in clean)
    left = {r.doc_id for r in p.ngram_jaccard(spark, lined, SF).collect()}
    assert left == {*clean, 102, 103}


def test_rows_by_number(spark, monkeypatch):
    rows = spark.range(0, 3000, numPartitions=7).select(F.monotonically_increasing_id().alias("n"), "id")
    every = [r.n for r in rows.collect()]
    wanted = sorted(random.Random(2).sample(every, 900))
    picked = spark.createDataFrame([(n,) for n in wanted], "kept long")
    assert sorted(r.n for r in common.only_rows(rows, "n", picked).collect()) == wanted
    assert common.only_rows(rows, "n", picked.limit(0)).count() == 0
    monkeypatch.setattr(common, "MOST_MAP_BITS", 1)
    assert sorted(r.n for r in common.only_rows(rows, "n", picked).collect()) == wanted

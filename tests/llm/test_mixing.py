import random
import re

import pytest

from pyspark.sql import DataFrame, GroupedData

from convene.llm import mixing, queries, templates

SCHEMA = "doc_id long, text string, source string, size string"


def targets(sizes, share=1.5, most=2.0):
    """By repeated resharing, as the words have it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    got, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            got[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if got[s] >= most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                open_.discard(s)
    return got


@pytest.mark.parametrize("n", [1, 2, 40, 3000])
def test_targets_and_takes(spark, n):
    rng = random.Random(n)
    sources = ["b", "a", "c", "é", None, "z", "aa"]
    rows = [(i, rng.choice(["w ", "x\t\n", "é\r", "q\x0b\x0c"]) * rng.choice([0, 1, 3, 17, 300]), rng.choice(sources if i % 3 else ["b"]), "s") for i in range(n)]
    rows += rows[: n // 10] + [(None, "null id text", "a", ""), (7, None, "a", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, fan=8).collect()
    assert len(got) == len(rows)
    sizes, words = {}, {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    by_size = {}
    for s, v in sizes.items():
        by_size.setdefault((v, round(want[s], 6)), []).append(s)
    taken, target = {}, {}
    for r in got:
        key = (r.source_size, round(r.target, 6))
        assert key in by_size
        assert 0 <= r.taken <= 2 * r.size
        taken[key] = taken.get(key, 0) + r.taken
    for key, names in by_size.items():
        assert abs(taken[key] - len(names) * key[1]) <= len(names) + 1e-6 * sum(sizes.values())
    part = [r for r in got if r.size and r.taken % r.size]
    assert len(part) <= len(sizes)
    again = mixing.mix(df.repartition(5), fan=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_share_is_kept_on_average(spark):
    rows = [(i, "w " * (1 + i % 5), "a", "") for i in range(400)] + [(1000 + i, "w", "b", "") for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    runs = [{r.doc_id: r.taken / r.size for r in mixing.mix(df, seed=s).collect() if r.doc_id < 1000} for s in range(12)]
    mean = [sum(r[i] for r in runs) / 12 for i in range(400)]
    overall = sum(mean) / 400
    assert abs(overall - runs[0][0]) <= 1 and len({tuple(sorted(r.items())) for r in runs}) > 1
    first, last = sum(mean[:200]) / 200, sum(mean[200:]) / 200
    assert abs(first - last) < 0.12


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, "", "a", ""), (2, None, None, "")], SCHEMA)
    assert mixing.mix(df.limit(0)).count() == 0
    assert sorted((r.doc_id, r.size, r.taken) for r in mixing.mix(df).collect()) == [(1, 0, 0), (2, 0, 0)]


@pytest.mark.parametrize("n", [1, 3, 50, 900])
def test_targets_of_many_sources(spark, n):
    rng = random.Random(n)
    sizes = {(None if i == 5 else f"{'é' if i % 3 else 'a'}{i:03d}"): rng.choice([0, 1, 7, 1000, 10**6, 10**9]) for i in range(n)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    got = {r.source: r.target for r in mixing.source_targets(df, 1.5, 2.0, (3, 1, 2)).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 16)
    df = spark.createDataFrame([(1, "a b c", "s", "")] * 333 + [(2, "d", "t", "")], SCHEMA)
    got = mixing.mix(df, fan=8).collect()
    assert sorted(r.doc_id for r in got) == [1] * 333 + [2]
    assert abs(sum(r.taken for r in got) - 1500) <= 2


def test_taken_rows_keep_their_columns(spark):
    names = ["id__", "th__", "size__", "taken__", "part__", "row", "plan"]
    docs = spark.createDataFrame([(i, f"w{i} x y z", "a", *range(7)) for i in range(30)], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    mixed = mixing.mix(docs)
    got = mixing.take(docs, mixed)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(tuple(r)[3:] == tuple(range(7)) for r in rows)
    assert sum(len(r.text.split()) for r in rows) == sum(r.taken for r in mixed.collect()) == 180


def test_native_in_all_jobs(spark, monkeypatch):
    """No step of the two native operators, written in between or not, goes through Python."""

    def refuse(*_, **__):
        raise AssertionError("Python on the main path")

    for kind, names in ((DataFrame, ("mapInArrow", "mapInPandas", "toPandas")), (GroupedData, ("applyInArrow", "applyInPandas", "applyInPandasWithState"))):
        for owner in {kind, type(spark.range(1)), type(spark.range(1).groupBy("id"))}:
            for name in names:
                if hasattr(owner, name):
                    monkeypatch.setattr(owner, name, refuse)
    sf = "/root/testdata/sf0.001"
    for df in (queries.op9_mixing(spark, sf), queries.op4_lines(spark, sf)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
    assert templates.MIN_DOCS == 8

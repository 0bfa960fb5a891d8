import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from convene.llm import queries, templates
from convene.llm.common import near_buckets

SCHEMA = "doc_id long, text string, n_lines string, extra int"


def by_sql(rows):
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("d", documents)
    con.execute("CREATE VIEW documents AS SELECT doc_id, CAST(text AS VARCHAR) AS text FROM d")
    return con.execute(templates.SQL).fetchall()


def run(spark, rows):
    out = templates.drop_lines(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    return out.select("doc_id", "text", "n_lines", "n_dropped").collect()


def test_templates_across_documents(spark):
    rows = []
    for i in range(20):
        lines = [f"{chr(97 + i)} has its own words", f"page {i} of 20 printed at 10:{i:02d}", "All rights reserved.", "", f"report by user u{chr(97 + i)} on the shared service today", f"{i}"]
        rows.append((i, "\n".join(lines), "x", 1))
    rows += [(None, "All rights reserved.\nkept", "x", 1), (50, None, "x", 1), (51, "", "x", 1), (52, "\n\n", "x", 1), (3, rows[3][1], "x", 1), (60, "tab\tand  blanks \r\n" + "word " * 30000, "x", 1)]
    found = run(spark, rows)
    got = {(r.doc_id, r.n_lines): r for r in found}
    assert got[0, 6].text == rows[0][1]  # the first place of each template stays
    assert got[5, 6].text == "f has its own words\n\n5" and got[5, 6].n_dropped == 3
    assert got[None, 2].text == "kept"
    assert got[50, 0].text is None and got[51, 1].text == "" and got[52, 3].text == "\n\n"
    assert got[60, 2].text == rows[-1][1]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, by_sql(rows)))


def test_clean_lines_stay(spark):
    words = [f"{a}{b}" for a in ("ka", "mo", "te", "su", "ri") for b in ("lan", "dor", "vik", "sen", "pol")]
    rows = [(i, "the old man " + " ".join(words[(i * 7 + k * (i + 3)) % 25] for k in range(6)), "x", 0) for i in range(40)]
    assert all(r.n_dropped == 0 for r in run(spark, rows))


def test_seven_documents_are_too_few(spark):
    rows = [(i, "All rights reserved.\n" * 5, "x", 0) for i in range(7)]
    assert all(r.n_dropped == 0 for r in run(spark, rows))
    rows.append((9, "All rights reserved.", "x", 0))
    got = {r.doc_id: r.n_dropped for r in run(spark, rows)}
    assert got == {0: 4, 9: 1} | dict.fromkeys(range(1, 7), 5)


def test_empty(spark):
    assert run(spark, []) == []


def test_several_templates_in_a_leaf(spark):
    names = [f"{a}{b}" for a in ("ka", "mo", "te", "su", "ri") for b in ("lan", "dor", "vik", "sen", "pol", "ban", "mir", "tul", "gor", "zed")]
    rows = [(i, "This page was printed from the main site", "x", 0) for i in range(100)]
    rows += [(100 + i, f"This page was written by {n} last week", "x", 0) for i, n in enumerate(names)]
    rows += [(200 + i, f"This page was moved {n} {names[-i]} {names[i // 2]} {i}", "x", 0) for i, n in enumerate(names[:7])]
    got = run(spark, rows)
    assert {r.doc_id: r.n_dropped for r in got} == {d: int(d not in (0, 100) and d < 200) for d, *_ in rows}
    said = templates.recurring(spark.createDataFrame(rows, SCHEMA)).groupBy("template").count().collect()
    assert {r.template: r["count"] for r in said} == {rows[0][1]: 99, "This page was written by <*> last week": 49}
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, by_sql(rows)))


def test_long_passages_of_two_documents(spark):
    words = lambda k, n: " ".join(f"w{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n))
    passage = words(0, 55)
    own = lambda k: "\n".join(words(k, 40) for _ in range(1)) + "\n" + words(k + 1, 41)
    rows = [(1, own(2) + "\n" + passage, "x", 0), (2, own(5) + "\n" + passage + "\n" + own(8) + "\n" + own(11), "x", 0)]
    rows += [(3, words(20, 60) + "\nend", "x", 0), (4, words(20, 60) + "\nother end", "x", 0)]  # a copy stays whole
    rows += [(5, words(15, 49), "x", 0), (6, words(15, 49) + "\n" + own(17) + "\n" + own(22), "x", 0)]  # 49 words are no passage
    found = run(spark, rows)
    got = {r.doc_id: r for r in found}
    assert {d: r.n_dropped for d, r in got.items()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}
    assert got[2].text == own(5) + "\n" + own(8) + "\n" + own(11)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, by_sql(rows)))


def test_documents_of_very_many_lines(spark):
    """Lines go in linear time: a quadratic search would take hours here."""
    lines = [str(i).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(40_000)]
    rows = [(d, "\n".join(x for line in lines[: 40_000 if d < 2 else 10] for x in ("All rights reserved.", line)), "x", 0) for d in range(9)]
    got = {r.doc_id: r.n_dropped for r in run(spark, rows)}
    assert got == {0: 39_999, 1: 40_010} | dict.fromkeys(range(2, 9), 20)


def test_clashing_names(spark):
    rows = [(d, "All rights reserved.", 1, 2, 3, 4, 5) for d in range(9)]
    names = ["id__", "th__", "gone", "row", "idx"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = templates.drop_lines(docs)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_dropped"]
    assert sorted(tuple(r)[2:] for r in out.collect()) == sorted([(1, 2, 3, 4, 5, 1, 0)] + [(1, 2, 3, 4, 5, 1, 1)] * 8)


def test_map_of_buckets_or_join(spark):
    rows, wanted = spark.range(5000).select(F.col("id"), (F.col("id") % 500 - 250).alias("key")), spark.createDataFrame([(k,) for k in (-250, -7, 0, 33, 33)], "w long")
    exact = sorted(r.id for r in rows.collect() if r.key in (-250, -7, 0, 33))
    by_map = sorted(r.id for r in near_buckets(rows, F.col("key"), wanted).collect())
    assert set(exact) <= set(by_map) and len(by_map) < len(exact) + 600
    assert sorted(r.id for r in near_buckets(rows, F.col("key"), wanted, 1).collect()) == exact


def shuffled(spark, run):
    """Bytes and rows that run() shuffles."""
    sc = spark.sparkContext._jsc.sc()
    no = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, no, None)
        return {s.stageId(): (s.shuffleWriteBytes(), s.shuffleWriteRecords()) for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return tuple(map(sum, zip(*(v for k, v in stages().items() if k not in before))))


def test_lines_alone_in_their_leaf_are_not_dealt_out(spark):
    """A copied line that no other one votes with is known by its hash: its text stays where it is."""
    dice = random.Random(7)
    lines = [" ".join("".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(1000)) for _ in range(60)]
    rows = [(2 * i + d, line, "x", 0) for i, line in enumerate(lines) for d in (0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = []
    moved, _ = shuffled(spark, lambda: found.extend(templates.recurring(docs, texts=False).collect()))
    assert sorted((r.doc_id, r.idx, r.rare) for r in found) == [(2 * i + 1, 0, True) for i in range(60)]
    assert moved < 0.3 * sum(map(len, lines))
    said = templates.recurring(docs).collect()
    assert sorted((r.doc_id, r.template) for r in said) == [(2 * i + 1, line) for i, line in enumerate(lines)]


def test_lines_of_signs_and_votes_of_false_buckets(spark):
    """Lines without letters never recur, alone in their leaf or not; SQL agrees on leaves of one line,
    of several that fit one template, and of several that stay as they are."""
    rows = []
    for i in range(24):
        lines = ["--- === ---", "12 34 56", "+ + a" if i % 2 else "+ + +", "- - - - +" if i % 3 else "- - - - *", "one line alone here"]
        lines += [f"{w} {w} {w} {i} said {chr(97 + i)}" for w in ("ka", "mo", "te")] + [f"some kind of {('red', 'green', 'blue')[i % 3]} {('cat', 'dog', 'cow')[i % 3]} {('x', 'y', 'z')[i % 3]}"]
        rows.append((i, "\n".join(lines), "x", 0))
    found = run(spark, rows)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, by_sql(rows)))


def test_map_of_buckets_goes_before_the_join(spark):
    rows, wanted = spark.range(20_000).select(F.col("id"), (F.col("id") % 4000).alias("key")), spark.createDataFrame([(k,) for k in (5, 7, 33, 33)], "w long")
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        found = []
        _, moved = shuffled(spark, lambda: found.extend(near_buckets(rows, F.col("key"), wanted, 256).collect()))
    finally:
        spark.conf.set(key, old)
    assert sorted(r.id for r in found) == [i for i in range(20_000) if i % 4000 in (5, 7, 33)]
    assert found[0].asDict().keys() == {"id", "key"} and moved < 2000


def test_native(spark):
    plan = queries.op4_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

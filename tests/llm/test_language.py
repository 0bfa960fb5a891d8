import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convene.llm import language, quality


def _brute(text):
    """n-grams of one text by plain loops: (length, characters)."""
    out, word = [], ""
    for c in f" {text or ''} ".lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            w = f" {word} "
            out += [w[i : i + 3] for i in range(len(w) - 2)] + [w[i : i + 4] for i in range(len(w) - 3)]
        word = ""
    return sorted(out)


def test_grams_by_brute_force():
    rng = random.Random(1)
    texts = [None, "", " ", "1 2", "a", "É", "ab cd", "it's", "x1y"] + ["".join(rng.choices("abÉß 1'\n中😀", k=rng.randint(1, 60))) for _ in range(300)]
    h, ends = language.grams(texts)
    name = {}
    for i, t in enumerate(texts):
        want = _brute(t)
        assert ends[i + 1] - ends[i] == len(want), repr(t)
        one, e = language.grams([t])
        assert sorted(one) == sorted(h[ends[i] : ends[i + 1]])
        for g in set(want):
            got = set(language.grams([g.strip() if g.strip() == g[1:-1] else g])[0].tolist())
            name[g] = got
    assert len(set(language.grams(["abc"])[0].tolist())) == 5


WORDS = {"aa": ["haus", "strasse", "gehen", "nicht", "licht"], "bb": ["maison", "rue", "aller", "jamais", "lumiere"], "cc": ["casa", "calle", "andar", "nunca", "luz"]}


def test_learn_and_predict(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        lang = sorted(WORDS)[i % 3]
        words = rng.choices(WORDS[lang], k=rng.randint(3, 80)) + rng.choices(WORDS["aa"], k=1)
        rows.append((i, " ".join(words), lang, "x"))
    extra = [(1000, None, "aa", ""), (1001, "12 34!", "aa", ""), (1002, "", None, ""), (1003, "ЖЖЖЖЖ", None, ""), (None, "casa calle casa", None, "")]
    docs = spark.createDataFrame(rows + extra + rows[:2], "doc_id long, text string, lang string, score string")
    model = language.learn(docs, quality.fold("doc_id", 4) == 2, 100)
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) + len(extra) + 2
    by = {r.doc_id: r for r in got}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(by[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003].lang_pred in WORDS and by[1003].score == 0 and by[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got)


def test_many_languages(spark):
    """More languages than a machine word has bits."""
    rng = random.Random(4)
    alphabet = [chr(0x4E00 + i) for i in range(700)]
    rows = [(i, " ".join("".join(rng.choices(alphabet[(i % 70) * 10 : (i % 70) * 10 + 10], k=4)) for _ in range(40)), f"l{i % 70:02d}") for i in range(420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(False))
    assert model.table.shape[1] == 2
    got = language.predict(docs, model).collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.99


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(False))
    assert [tuple(r) for r in language.predict(docs, model).collect()] == [(1, "und", 0.0, 0.0)]
    assert language.predict(docs.limit(0), model).count() == 0


def test_sample_is_bounded_at_any_size():
    """Twice the wanted rows are drawn from however many; 62 bits leave no share at 0."""
    for n in (1, 1999, 10**6, 2 * 10**9 + 1, 10**10, 10**14):
        share = language.draw_limit(n, 2000) / 2**language.DRAW_BITS
        assert share == 1 if n <= 4000 else 3900 < share * n < 4100


def test_sample_of_repeated_rows(spark):
    rows = [(i, "ab cd", f"t{i}") for i in range(300)] + [(7, "ab cd", "same")] * 500 + [(i, "x", f"u{i}") for i in range(5)]
    known = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.sample_of(known, 40, {"ab cd": 800, "x": 5}).groupBy("lang").count().collect()
    got = {r.lang: r["count"] for r in got}
    assert got["x"] == 5 and 1 <= got["ab cd"] <= 40  # copies share a hash: they are drawn or left together


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        language.learn(docs, F.lit(False))


def test_filters_by_brute_force(spark):
    """Kept n-grams, hits and decisions from plain counters of strings."""
    rng = random.Random(6)
    rows = []
    for i in range(400):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 40)) + rng.choices(WORDS["aa"], k=i % 2)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(False))
    seen = {x: Counter() for x in sorted(WORDS)}
    for _, text, lang in rows:
        seen[lang].update(_brute(text))
    rates = {}
    for lang, c in seen.items():
        often = {g: n for g, n in c.items() if n >= 3}
        rates[lang] = {g: n / sum(often.values()) for g, n in often.items() if n >= 1e-5 * sum(often.values())}
    kept = {x: {g for g, r in rates[x].items() if r >= 0.25 * max(o.get(g, 0) for o in rates.values())} for x in rates}
    texts = [t for _, t, _ in rows] + ["unseen words qqq www", "haus maison casa"]
    hits, n = language.counts(model, texts)
    for k, text in enumerate(texts):
        own = _brute(text)
        assert n[k] == len(own)
        for i, lang in enumerate(model.languages):
            want = sum(g in kept[lang] for g in own)  # a filter has all that it was given, and few others
            assert want <= hits[k, i] + len(own) * model.false_positive[i] + 1e-9
            assert hits[k, i] <= want + 0.1 * len(own) + 1
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for i, text, _ in rows:
        scores = [sum(g in kept[x] for g in _brute(text)) for x in model.languages]
        top = sorted(scores)[-2:]
        if top[1] - top[0] > 0.2 * len(_brute(text)) + 2:
            assert got[i].lang_pred == model.languages[scores.index(top[1])]


def test_unknown_language_knows_little(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS[sorted(WORDS)[i % 3]], k=30)), sorted(WORDS)[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows + [(1000, "qwx zzkk vvorp xylq " * 5 + "casa", None)], "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(False))
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert got[1000].score > 0 and got[1000].known < model.least_known
    assert all(got[i].known >= model.least_known for i, _, _ in rows)


def test_carried_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "abc", 77.0)], "doc_id long, text string, score double")
    model = language.learn(docs.withColumn("lang", F.lit("aa")), F.lit(False))
    assert language.predict(docs, model).count() == 1
    with pytest.raises(ValueError, match="score"):
        language.predict(docs, model, ("doc_id", "score"))


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "haus gehen " * 300_000, "aa"), (2, "casa luz " * 5, "cc")], "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(False))
    assert [r.lang_pred for r in language.predict(docs, model).orderBy("doc_id").collect()] == ["aa", "cc"]

"""Language identification with bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of its n-grams (3 and 4 characters, word ends included). The filters
share hash functions and are stored sliced: word i of the table holds bit i of every filter. Looking
up an n-gram is the AND of a few words, which gives the set of all languages that have it as a bit
mask. Counts of the mask's bits over a text, corrected for each filter's false-positive rate, decide.

Learning takes a bounded sample, at most `sample_docs` documents of each language by a hash of their
row, and keeps the n-grams that are neither rare in a language nor far more frequent in another one
(words of one language turn up in documents of others). An n-gram makes up `LEAST_SHARE` of a language's
at least, so no more than 1 / `LEAST_SHARE` of a language reach the driver, whatever the texts' length;
more than `MOST_LANGUAGES` values of lang are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from convene.llm.common import cut, discard, lean_batches, mix, small_batches

SAMPLE_DOCS = 2000
MOST_LANGUAGES = 1000
#: Rows are drawn by this many bits of a hash, so a sample is as large from 10^10 rows as from 10^4.
DRAW_BITS = 62
HASHES = 3
#: Bits of a language's filter for each of the n-grams of the fullest language.
BITS_PER_GRAM = 16
LEAST_COUNT, LEAST_SHARE, OF_HIGHEST = 3, 1e-5, 0.25
#: A text is in none of the languages if it knows fewer of its n-grams than this part of what all but
#: one in `STRANGE` sample documents know at least.
KNOWN_PART, STRANGE = 0.25, 100
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (bits, words of 64 languages), uint64
    false_positive: np.ndarray  # rate of each language's filter
    fallback: int  # the language with most documents
    least_known: float = 0.0  # share of a text's n-grams that its language knows, at least


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and where each text's begin and end (one longer).

    Letters are lower-cased, all else parts words; an n-gram lies in a word with a blank at each end."""
    joined, ends = [], [0]
    for t in texts:
        code = np.frombuffer(f" {t or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        joined.append(code)
        ends.append(ends[-1] + len(code))
    code = np.concatenate(joined) if joined else np.empty(0, np.uint32)
    letter = _letters()[code]
    if len(code) < 3:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    keep = letter.copy()  # of a run of other characters, the first and the last stay as blanks
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    place = np.flatnonzero(keep)
    code = np.where(letter[place], code[place], 32).astype(np.uint64)
    letter = letter[place]
    if len(code) < 3:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    with np.errstate(over="ignore"):
        a, b, c = code[:-2], code[1:-1], code[2:]
        three = letter[1:-1]
        h3 = mix(a | b << np.uint64(21) | c << np.uint64(42))
        four = letter[1:-2] & letter[2:-1] if len(code) > 3 else np.empty(0, bool)
        h4 = mix(mix(a[:-1] | b[:-1] << np.uint64(21) | c[:-1] << np.uint64(42)) + code[3:]) if len(code) > 3 else np.empty(0, np.uint64)
    # an n-gram belongs to the text that its second character lies in
    at3, at4 = place[1:-1][three], place[1:-2][four] if len(code) > 3 else np.empty(0, np.int64)
    at, h = np.concatenate([at3, at4]), np.concatenate([h3[three], h4[four]])
    order = np.argsort(at, kind="stable")
    return h[order], np.searchsorted(at[order], ends)


def draw_limit(rows: int, wanted: int) -> int:
    """A hash of DRAW_BITS bits under this is drawn, for twice the wanted number of rows."""
    return min(1 << DRAW_BITS, (2 * wanted << DRAW_BITS) // max(1, rows) + 1)


def sample_of(known: DataFrame, sample_docs: int, sizes: dict[str, int]) -> DataFrame:
    """lang, text of at most `sample_docs` rows of each language: those with the least hashes of doc_id
    and text. The draw leaves about twice as many for the ranking."""
    limits = known.sparkSession.createDataFrame([(x, draw_limit(n, sample_docs)) for x, n in sizes.items()], "lang string, limit long")
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - DRAW_BITS)
    few = known.join(F.broadcast(limits), "lang").withColumn("h", drawn).where(F.col("h") < F.col("limit"))  # MOST_LANGUAGES rows
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    return few.withColumn("place", place).where(F.col("place") <= sample_docs).select("lang", "text")


def learn(docs: DataFrame, held_out: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from text and non-null lang of docs (doc_id, text, lang) for which `held_out` is not
    true. No such document: a model without languages, which calls all texts unknown."""
    known = lean_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out, F.lit(False))).select("doc_id", "lang", "text")
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    sizes = {r.lang: r.n for r in counted}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((1, 1), np.uint64), np.zeros(0), -1)
    number = {x: i for i, x in enumerate(languages)}
    sample = cut(sample_of(known, sample_docs, sizes), "language-sample")
    schema = pa.schema([("lang", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), lang, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)
            held.clear()

        for batch in small_batches(batches, "text"):
            h, ends = grams(batch.column("text").to_pylist())
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                held.setdefault(number[lang], []).append(h[ends[i] : ends[i + 1]])
            if sum(len(p) for parts in held.values() for p in parts) > 4_000_000:
                yield from flush()
        yield from flush()

    counts_ = cut(sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "language-grams")
    totals = F.broadcast(counts_.groupBy("lang").agg(F.sum("n").alias("total")))  # a row for each language
    found = counts_.join(totals, "lang").where(F.col("n") >= LEAST_SHARE * F.col("total")).select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).toPandas()
    found = found.sort_values(["gram", "lang"])
    highest = found.groupby("gram")["rate"].transform("max").to_numpy()
    kept = found["rate"].to_numpy() >= OF_HIGHEST * highest
    gram, lang = found["gram"].to_numpy().view(np.uint64)[kept], found["lang"].to_numpy()[kept]
    most = int(max(1, np.bincount(lang, minlength=1).max(initial=1)))
    bits = 1 << (BITS_PER_GRAM * most - 1).bit_length()
    table = np.zeros((bits, -(-len(languages) // 64)), np.uint64)
    for place in _places(gram, bits):
        np.bitwise_or.at(table, (place, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    model = Model(languages, table, fill**HASHES, max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i)))
    # what texts of the languages know of themselves tells what texts of none do not
    usual = predict(sample, model, ("lang",)).where((F.col("lang") == F.col("lang_pred")) & (F.col("score") > 0)).agg(F.percentile_approx("known", 1.0 / STRANGE, 10_000)).first()[0]
    discard(sample, counts_)
    return replace(model, least_known=KNOWN_PART * (usual or 0.0))


def _places(gram: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = mix(gram) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            yield ((gram + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


def counts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the corrected number of its n-grams in each language's filter, and their total."""
    h, ends = grams(texts)
    mask = None
    for place in _places(h, len(model.table)):
        mask = model.table[place] if mask is None else mask & model.table[place]
    n = np.diff(ends)
    out = np.zeros((len(texts), len(model.languages)))
    for i in range(len(model.languages)):
        hit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        total = np.concatenate([[0], np.cumsum(hit.astype(np.int64))])
        out[:, i] = total[ends[1:]] - total[ends[:-1]]
    wrong = model.false_positive
    return np.maximum(0, (out - n[:, None] * wrong) / np.maximum(1e-9, 1 - wrong)), n


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry`, lang_pred, score and known for every row of docs (text, and what is carried).

    Null texts and texts without a letter are `und` with score 0. The score grows from a half to one
    with the lead of the best language over the next; it is 0 where no language has an n-gram of the
    text (the language with most documents is then the prediction). `known` is the share of the text's
    n-grams that the predicted language has. Ties go to the language that sorts first. Texts of any
    length are counted whole. Repeated rows get repeated results, an empty table none; other columns are
    ignored, and carried ones with a result's name are refused."""
    results = {"lang_pred": "string", "score": "double", "known": "double"}
    if clash := sorted(set(carry) & set(results)):
        raise ValueError(f"rename these columns before they are carried: {', '.join(clash)}")
    given = lean_batches(docs).select(*carry, *(() if "text" in carry else ("text",)))
    out, schema = given.select(*carry).schema, to_arrow_schema(given.select(*carry).schema)
    for name, kind in results.items():
        out, schema = out.add(name, kind), schema.append(pa.field(name, pa.string() if kind == "string" else pa.float64()))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_LANGUAGES filters of 1 / LEAST_SHARE n-grams at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in small_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            zero = np.zeros(len(texts))
            if not m.languages:
                best, score, has, share = zero.astype(int), zero, zero.astype(bool), zero
            else:
                hits, n = counts(m, texts)
                has = n > 0
                best = np.where(hits.max(1) > 0, hits.argmax(1), m.fallback)
                top = hits.max(1)
                second = np.sort(hits, 1)[:, -2] if hits.shape[1] > 1 else zero
                score = np.where(has & (top > 0), 0.5 + 0.5 * (top - second) / np.maximum(top, 1e-9), 0.0)
                share = top / np.maximum(n, 1)
            names = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, has)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(names, pa.string()), pa.array(score), pa.array(share)], schema=schema)

    return given.mapInArrow(run, out)

"""A training corpus from documents: language, line dedup, near-duplicates, mixture, packing.

Every stage takes what its predecessor kept, written as Parquet in between. All but the last return the
columns of documents, extra ones included and unchanged, whatever their names; n_chars follows the text.
Null columns are values like others where a stage doesn't say otherwise. Texts of any length are worked on
whole. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convene.llm import language, mixing, ngram_join, packing, quality, templates
from convene.llm.common import cut, discard, only_rows, table


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text."""
    return docs.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: those without a letter, null texts among them, and
    those whose language knows fewer of their n-grams than its own texts ever do. A null lang becomes the
    predicted one. Of tied languages the one that sorts first is taken; repeated rows are judged alike."""
    model = language.learn(docs, quality.fold("doc_id", 4) == 2)
    judged = language.predict(docs.select("text", F.struct("*").alias("row")), model, ("row",))
    known = judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > 0) & (F.col("known") >= model.least_known))
    return known.select(*((F.coalesce("row.lang", "lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from texts, but for the first place of each; documents of which nothing is left
    go too. Null texts stay null. Rows that share doc_id and text lose the same lines."""
    marks = ("n_lines", "n_dropped")
    own = [c for c in docs.columns if c in marks]  # columns of documents that are named like the operator's
    kept = docs.select(*(c for c in docs.columns if c not in own), *([F.struct(*own).alias(_free("own", docs))] if own else []))
    cleaned = templates.drop_lines(kept)
    left = cleaned.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")).drop(*marks)
    if own:
        left = left.select(*(F.col(_free("own", docs))[c].alias(c) if c in own else F.col(c) for c in docs.columns))
    return _counted(left, docs.columns)


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the least doc_id (null last), of
    those that share it the one with the least text hash, then the least hash of the row. Rows without
    words are in no group; of those that are alike in all, one stays. Rows that share a doc_id but not a
    text stand for themselves."""
    rows = docs.select(F.struct("*").alias("row"))
    # the row's number is its place in a written table, so it is the same whenever it is read
    numbered = cut(rows.select(F.monotonically_increasing_id().alias("n"), F.xxhash64("row.text").alias("th"), F.xxhash64("row").alias("rh"), "row"), "near-rows")
    groups = cut(ngram_join.similar_groups(numbered.select(F.col("n").alias("doc_id"), F.col("row.text").alias("text"))), "near-groups")
    place = F.struct(F.col("row.doc_id").isNull().alias("a"), F.col("row.doc_id").cast("long").alias("d"), "th", "rh", "n").alias("place")
    placed = numbered.select("n", place).join(groups.select(F.col("doc_id").alias("n"), "component_id", "n_shingles"), "n")
    # rows without words are grouped by all that they hold
    group = F.when(F.col("n_shingles") > 0, F.struct(F.col("component_id").alias("g"), F.lit(0).cast("long").alias("h"))).otherwise(F.struct(F.lit(-1).cast("long").alias("g"), F.col("place.rh").alias("h")))
    first = cut(placed.groupBy(group.alias("group")).agg(F.min("place").alias("first")).select(F.col("first.n").alias("kept")), "near-first")
    discard(groups)
    return only_rows(numbered, "n", first).select("row.*")


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources, null among them, reach their weights. Rows
    that share doc_id and text share what they take evenly; documents without words are not taken."""
    return _counted(mixing.take(docs, mixing.mix(docs)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids, one row a piece. Null texts are the end id alone; every row is
    packed by itself, repeated ones too."""
    return packing.pack_documents(docs, packing.public_byte_bpe)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing_weights),
    ("packing", pack),
]

#: SQL can't express tokenizers and random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents. A stage's table goes when the next is written;
    only the last one's input stays, which the result is read from."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, former = cut(stage(spark, docs, sf_dir), f"pipeline-{name}"), held
        held = docs
        if former is not None:
            discard(former)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

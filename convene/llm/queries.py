"""One query per corpus operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convene.llm import html_text, language, matroska, mixing, neighbours, ngram_join, packing, quality, secrets, templates
from convene.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), quality.fold("doc_id", 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out)
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "size_difference")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), quality.fold("doc_id", 4) == 2
    model = language.learn(docs, held_out)
    predicted = language.predict(docs, model)
    return predicted.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.public_byte_bpe)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return found.withColumn("base", F.expr("filter(spans, s -> s.path = '')")).select(
        "doc_id",
        *(F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
        F.expr("cast(size(spans) - size(base) as bigint)").alias("n_decoded"),
        "oversize",
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality": op1_quality, "op2_language": op2_language, "op3_html": op3_html, "op4_lines": op4_lines, "op5_neighbours": op5_neighbours, "op6_ngram_join": op6_ngram_join, "op7_packing": op7_packing, "op8_secrets": op8_secrets, "op9_mixing": op9_mixing, "op10_matroska": op10_matroska}
#: SQL for those that it can express.
ORACLES: dict[str, str] = {
    "op6_ngram_join": ngram_join.SQL,
    "op4_lines": templates.SQL,
    "op5_neighbours": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
            WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
}

"""Point sets from the test tables, as DataFrames and as DuckDB SQL of the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {
    "orders": "o_orderkey AS id, o_totalprice/500000.0D AS x, (datediff(cast(o_orderdate as date), date'1995-01-01')+0.5D)/2405.0D AS y",
    "events": "event_id AS id, value/1000.0D AS x, (unix_micros(cast(ts as timestamp))/1000000.0D - 1704067200.0D)/2600000.0D AS y",
    "supplier": "s_suppkey AS id, 0.4D+0.2D*((s_acctbal+1000.0D)/11001.0D) AS x, 0.4D+0.2D*((s_nationkey+0.5D)/25.0D) AS y",
    "nation": "cast(n_nationkey as bigint) AS id, 0.2D+0.6D*((n_nationkey*7)%25+0.5D)/25.0D AS x, 0.2D+0.6D*((n_nationkey*11)%25+0.5D)/25.0D AS y",
}

SQL = {
    "orders": "SELECT o_orderkey AS id, o_totalprice/500000.0::DOUBLE AS x, (date_diff('day', DATE '1995-01-01', o_orderdate::DATE)+0.5::DOUBLE)/2405.0::DOUBLE AS y FROM orders",
    "events": "SELECT event_id AS id, value/1000.0::DOUBLE AS x, (epoch(ts)-epoch(TIMESTAMP '2024-01-01'))/2600000.0::DOUBLE AS y FROM events",
    "supplier": "SELECT s_suppkey AS id, 0.4::DOUBLE+0.2::DOUBLE*((s_acctbal+1000.0::DOUBLE)/11001.0::DOUBLE) AS x, 0.4::DOUBLE+0.2::DOUBLE*((s_nationkey+0.5::DOUBLE)/25.0::DOUBLE) AS y FROM supplier",
    "nation": "SELECT n_nationkey::BIGINT AS id, 0.2::DOUBLE+0.6::DOUBLE*((n_nationkey*7)%25+0.5::DOUBLE)/25.0::DOUBLE AS x, 0.2::DOUBLE+0.6::DOUBLE*((n_nationkey*11)%25+0.5::DOUBLE)/25.0::DOUBLE AS y FROM nation",
    "corners": "SELECT * FROM (VALUES (0::BIGINT,0.4::DOUBLE,0.4::DOUBLE),(1,0.6,0.4),(2,0.4,0.6),(3,0.6,0.6)) c(id,x,y)",
}


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """id, x, y of a named set: orders (nearly uniform) and events (skewed) to search; supplier, nation
    and corners as query sets."""
    if name == "corners":
        return spark.createDataFrame([(0, 0.4, 0.4), (1, 0.6, 0.4), (2, 0.4, 0.6), (3, 0.6, 0.6)], "id bigint, x double, y double")
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*_split(_SPARK[name]))
    return out.selectExpr("cast(id as bigint) as id", "cast(x as double) as x", "cast(y as double) as y")


def _split(text: str) -> list[str]:
    """Columns of a select list; each ends in its name."""
    out, at = [], 0
    for name in (" AS id", " AS x", " AS y"):
        end = text.index(name, at) + len(name)
        out.append(text[at:end].lstrip(", "))
        at = end
    return out

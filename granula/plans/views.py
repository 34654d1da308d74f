"""Deterministic trajectory views over generic tables, alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granula.operators.ranges import dealt

_ROW = "row_number() OVER (PARTITION BY {frame} ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate)"
_ATOMS = """
    SELECT {conf} AS conf_id, {frame} AS frame, CAST({row} AS BIGINT) AS atom_id,
           CASE WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS type_id, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS surf,
           ((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 1299709) % 25000) / {k} AS x,
           ((l_partkey * 15485863 + l_orderkey * 32452843 + l_linenumber * 49979687) % 25000) / {k} AS y,
           ((l_partkey * 67867967 + l_orderkey * 86028121 + l_linenumber * 122949823) % 25000) / {k} AS z
    FROM {table}"""

ATOMS_SQL = _ATOMS.format(conf="'np' || CAST(l_suppkey // 10 AS VARCHAR)", frame="l_suppkey", row=_ROW.format(frame="l_suppkey"), k="1000.0::DOUBLE", table="lineitem")


def atom_rows(spark: SparkSession, sf: str) -> int:
    """How many atoms there are, from the files' footers."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").count()


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms of a trajectory: a frame a supplier, ten frames a particle.

    Dealt by frame: what joins and groups within frames (the grid, bonds, paths) finds both sides in one
    task, so only the rows of this view cross a shuffle for it.
    """
    table = spark.read.parquet(f"{sf}/lineitem.parquet")
    by_frame = dealt(table.withColumnRenamed("l_suppkey", "frame"), "frame", atom_rows(spark, sf))
    return spark.sql(_ATOMS.format(conf="'np' || CAST(frame DIV 10 AS STRING)", frame="frame", row=_ROW.format(frame="frame"), k="1000.0D", table="{lineitem}"), lineitem=by_frame)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def series_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A series a user: conf_id, line_no from 1, event_type, value."""
    sql = "SELECT user_id AS conf_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_type, value FROM {events}"
    return spark.sql(sql, events=events(spark, sf))

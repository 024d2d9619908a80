"""Queries of the engine by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattika.plans import curation_queries, further_queries, kg_queries, rollout_queries, sample_queries, text_queries

FAMILIES = [kg_queries, curation_queries, rollout_queries, sample_queries, text_queries, further_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg_queries.kg_bgp_minus(spark, sf_dir)


def queries() -> dict:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}

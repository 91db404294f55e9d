"""All core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from anchorspan.queries import domain, problems


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.lift_bed(spark, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.QUERIES | domain.QUERIES

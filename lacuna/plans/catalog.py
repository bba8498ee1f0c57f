"""All named queries. Importing this module fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.plans import checklists, environment, gaps, incremental, regions, scalars, scans, texts  # noqa: F401
from lacuna.plans.standin import Inputs
from lacuna.session import tune


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Listed species of a group without a record in a district and year, most threatened first."""
    return gaps.gap_order(Inputs(tune(spark), folder))

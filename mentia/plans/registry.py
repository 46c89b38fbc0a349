"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mentia.plans import alerts, general, intake, reference

# each module adds its queries to one registry
assert alerts.QUERIES is intake.QUERIES is reference.QUERIES
flagship = reference.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": general.p1_found, "p1_status": general.p1_status, "p6_found": general.p6_found, **reference.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": general.P6_SQL, **reference.SQL}

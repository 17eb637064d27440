"""Registered queries and their SQL, by subject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, files, live, raster, requests, tiles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for module in (requests, catalog, tiles, raster, files, live) for q in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return requests.ORACLE | catalog.ORACLE | tiles.ORACLE | files.ORACLE | raster.oracle() | live.oracle(requests.ORACLE)

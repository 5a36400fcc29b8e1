"""Registry of the corpus operators' queries over the driver's tables, and of the SQL that defines them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("simhash", "token_orc", "mixing", "decontaminate", "quality", "window_lm", "html_text", "line_chunks", "line_crf", "warc",
           "url_cascade", "turn_repair", "token_alignment")


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can express it, the statement it must agree with."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Import the modules of the operators, which register their queries."""
    for module in MODULES:
        import_module(f"tallycast.llm.{module}")

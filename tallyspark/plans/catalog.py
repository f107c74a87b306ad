"""Query registry: one named Spark query per operator, with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the whole
driver tables (through the stand-ins); ``ORACLE[name]`` is the same result in
plain SQL over the raw tables.  Queries without a SQL form (custom parsers,
writes) are registered without an oracle and are checked by unit tests
against hand-derived or brute-force results instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Header offsets and wall times are interpreted in UTC;
            # casts resolve the zone when the DataFrame is analysed, i.e. here.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers itself)."""
    from . import q_advise, q_clean, q_ingest, q_ledger, q_model, q_recur, q_spend, q_text  # noqa: F401

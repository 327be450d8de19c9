"""What all plans share: reading tables, the registry, and fragments of the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries of a module, each with its SQL twin if it has one."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BLANK = r"\t-\r\x1c-\x20\x{85}\p{Z}"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{BLANK}]+')"


def count_of(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"


def share(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END)"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{BLANK}]+', ''), '[{BLANK}]+$', '')"


def matching(x: str, pattern: str) -> str:
    return f"CAST(len(list_filter({x}, lambda q: regexp_matches(q, '{pattern}'))) AS BIGINT)"


def quote(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)

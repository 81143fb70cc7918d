"""Queries by name, each beside the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fanfold.plans import fixtures

QueryBody = Callable[["Inputs"], DataFrame]
QUERIES: dict[str, QueryBody] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The base tables of one folder as attributes, and the frames derived from them by ``fx``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in fixtures.BASE_TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {t: getattr(self, t) for t in fixtures.BASE_TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def fx(self, name: str) -> DataFrame:
        return self.sql(fixtures.SQL[name])


def oracle(body: str, *names: str) -> str:
    """The check's SQL with the derived tables it reads as leading ``WITH`` members."""
    plain = {t: t for t in fixtures.BASE_TABLES}
    members = [f"{n} AS ({fixtures.SQL[n].format(**plain)})" for n in names]
    body = body.strip()
    if not members:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(members)}, {body[5:]}"
    return f"WITH {', '.join(members)} {body}"


def query(name: str, sql: str | None = None, *uses: str) -> Callable[[QueryBody], QueryBody]:
    """Registers a query; ``uses`` names the derived tables its SQL reads."""

    def keep(body: QueryBody) -> QueryBody:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = body
        if sql is not None:
            ORACLES[name] = oracle(sql, *uses)
        return body

    return keep

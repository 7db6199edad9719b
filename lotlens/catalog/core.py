"""Registry of runnable queries and their SQL twins.

A query is ``fn(t)`` where ``t("name")`` gives a carrier view (or a driver table) as a DataFrame. Its SQL twin
may mention any carrier or shared CTE as ``{name}``; the WITH clause is assembled from what is mentioned.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
_NAME = re.compile(r"\{(\w+)\}")


class Query(NamedTuple):
    name: str
    run: Callable
    sql: str | None


CARRIERS: dict[str, str] = {}      # valid unchanged in Spark SQL and DuckDB
SHARED: dict[str, str] = {}        # CTEs used only by SQL twins
QUERIES: dict[str, Query] = {}


def carrier(name: str, sql: str) -> None:
    CARRIERS[name] = sql.strip()


def shared(name: str, sql: str) -> None:
    SHARED[name] = sql.strip()


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql)
        return fn
    return add


class Tables:
    """Carrier views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, partitions: int = 0):
        """partitions: deal the tables' rows round to so many tasks, for files of few row groups; 0 leaves them as read."""
        self.spark, self.dir, self._partitions, self._seen = spark, sf_dir.rstrip("/"), partitions, {}
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sha256(s STRING) RETURNS STRING RETURN sha2(s, 256)")

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
                df = df.repartition(self._partitions) if self._partitions else df
            else:
                sql = CARRIERS[name]
                df = self.spark.sql(sql, **{n: self(n) for n in dict.fromkeys(_NAME.findall(sql))})
            self._seen[name] = df
        return self._seen[name]

    def over(self, name: str, **tables: DataFrame) -> DataFrame:
        """A carrier view over other rows of the tables it reads."""
        return self.spark.sql(CARRIERS[name], **tables)


def oracle_text(sql: str) -> str:
    """SQL twin with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in dict.fromkeys(_NAME.findall(text)):
            if n in TABLES or n in order:
                continue
            body = SHARED.get(n) or CARRIERS.get(n)
            if body is None:
                raise KeyError(f"unknown view {{{n}}}")
            visit(body)
            if n not in order:
                order.append(n)

    visit(sql)
    plain = lambda s: _NAME.sub(r"\1", s).replace("{{", "{").replace("}}", "}")
    ctes = ",\n".join(f"{n} AS (\n{plain(SHARED.get(n) or CARRIERS[n])}\n)" for n in order)
    body = plain(sql.strip())
    if ctes and body.upper().startswith("WITH "):
        body = f"SELECT * FROM ({body}) AS q"
    return (f"WITH {ctes}\n" if ctes else "") + body

"""Query registry: a Spark callable, its output columns, and SQL that must agree."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar import adapters

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Tables:
    """The driver tables of one folder and the model tables derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.raw(name)
        raise AttributeError(name)

    @cached_property
    def bars(self) -> DataFrame:
        return adapters.daily_bars(self.lineitem)

    @cached_property
    def wbars(self) -> DataFrame:
        return adapters.weekly_panel_bars(self.lineitem)

    @cached_property
    def hbars(self) -> DataFrame:
        return adapters.hourly_bars(self.events)

    @cached_property
    def funding(self) -> DataFrame:
        return adapters.funding(self.events)

    @cached_property
    def sessions(self) -> DataFrame:
        return adapters.sessions(self.orders)

    @cached_property
    def flows(self) -> DataFrame:
        return adapters.flows(self.events)

    @cached_property
    def headlines(self) -> DataFrame:
        return adapters.headlines(self.documents)

    @cached_property
    def trades(self) -> DataFrame:
        return adapters.trades(self.orders)

    @cached_property
    def calendar(self) -> DataFrame:
        return adapters.calendar(self.nation, self.region)


@dataclass
class Query:
    name: str
    cols: str
    fn: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, path: str) -> DataFrame:
        df = self.fn(Tables(spark, path))
        return df.select(*[spark_col(c) for c in self.cols.split()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip()
        ctes = resolve(body)
        picked = ", ".join(sql_col(c) for c in self.cols.split())
        head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in ctes)
        q = f"q AS ({body})"
        return f"WITH {head + ', ' if head else ''}{q}\nSELECT {picked} FROM q"


QUERIES: dict[str, Query] = {}
CTES: dict[str, str] = {}

# Column tokens are name:kind. A number rounds a double to that many digits; i, t, d,
# b fix bigint, timestamp, date and boolean; e and a number write a double with that many
# digits behind the first, for sizes that no fixed rounding suits; a bare name passes through.


def spark_col(token: str):
    name, _, kind = token.partition(":")
    c = F.col(name)
    if kind == "":
        return c
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "t":
        return c.cast("timestamp_ntz").alias(name)
    if kind == "d":
        return c.cast("date").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    x = c.cast("double")
    if kind[0] == "e":
        return F.when(~F.isnan(x), F.format_string(f"%.{kind[1:]}e", x)).alias(name)
    return (F.round(F.when(~F.isnan(x), x), int(kind)) + F.lit(0.0)).alias(name)


def sql_col(token: str) -> str:
    name, _, kind = token.partition(":")
    types = {"i": "BIGINT", "t": "TIMESTAMP", "d": "DATE", "b": "BOOLEAN"}
    if kind == "":
        return name
    if kind in types:
        return f"CAST({name} AS {types[kind]}) AS {name}"
    if kind[0] == "e":
        text = f"replace(printf('%.{kind[1:]}e', CAST({name} AS DOUBLE)), 'inf', 'Infinity')"
        return f"CASE WHEN {name} IS NOT NULL THEN {text} END AS {name}"
    return f"round(CAST({name} AS DOUBLE), {kind}) + 0.0::DOUBLE AS {name}"


def cte(name: str, sql: str) -> str:
    CTES[name] = sql
    return name


def resolve(body: str) -> list[str]:
    """CTEs a body needs, dependencies first."""
    done: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if word in CTES and word not in done and word not in stack:
                stack.append(word)
                visit(CTES[word])
                stack.pop()
                done.append(word)

    stack: list[str] = []
    visit(body)
    return done


def query(name: str, cols: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, cols, fn, sql)
        return fn

    return add

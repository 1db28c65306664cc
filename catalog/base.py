"""Registry, table loading and the input views shared by both engines.

A view is one SELECT in the SQL both engines read. Spark runs it over DataFrames, the check
runs it as a common table expression. Views only shape the given tables into an operator's
input; the operators themselves are written twice, in Spark here and in SQL in the check.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.session import spread, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, tuple[object, str]] = {}  # name -> (Spark SQL or function, check SQL)

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Time columns as microseconds and the number inside the JSON text, for the check's side.
_SHAPED = {
    "events": "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props, "
    "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events",
    "orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "epoch_us(o_orderdate) AS o_us, o_orderpriority FROM orders",
    "lineitem": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
    "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
    "epoch_us(l_shipdate) AS l_us FROM lineitem",
}

_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages", "lineitem", "orders", "events"):
        df = spread(df, df.columns[0])
    if name == "events":
        return df.select(
            "event_id",
            F.expr(_MICROS.format(c="ts")).alias("ts_us"),
            "user_id",
            "event_type",
            "value",
            "props",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )
    if name == "orders":
        return df.withColumn("o_us", F.expr(_MICROS.format(c="o_orderdate"))).drop("o_orderdate")
    if name == "lineitem":
        return df.withColumn("l_us", F.expr(_MICROS.format(c="l_shipdate"))).drop("l_shipdate")
    return df


def _needs(text: str) -> list[str]:
    names = dict.fromkeys(re.findall(r"\{(\w+)\}", text))
    return [n for n in names if n in VIEWS or n in BASE]


class Tables:
    """Tables and views of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return table(self.spark, self.dir, name)
        if name in VIEWS:
            text = VIEWS[name][0]
            if callable(text):
                return text(self)
            return self.spark.sql(text, **{n: getattr(self, n) for n in _needs(text)})
        raise AttributeError(name)

    def hold(self, name: str, *columns: str) -> None:
        """Write these columns of a view once, for all that read it in this query."""
        setattr(self, name, staged(getattr(self, name).select(*columns), name))


def _closure(text: str, seen: list[str]) -> list[str]:
    for n in _needs(text):
        if n in VIEWS and n not in seen:
            _closure(VIEWS[n][1], seen)
            seen.append(n)
    return seen


def _plain(text: str) -> str:
    def swap(m: re.Match) -> str:
        n = m.group(1)
        if n in _SHAPED:
            return f"({_SHAPED[n]})"
        return n if n in VIEWS or n in BASE else m.group(0)

    return re.sub(r"\{(\w+)\}", swap, text)


def oracle(text: str) -> str:
    """Expand ``{view}`` names of a check into a WITH list."""
    parts = [f"{n} AS ({_plain(VIEWS[n][1].strip())})" for n in _closure(text, [])]
    body = _plain(text.strip())
    if not parts:
        return body
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + rest[9:].lstrip()
        return "WITH " + ",\n".join(parts) + ",\n" + rest
    return "WITH " + ",\n".join(parts) + "\n" + body


def view(name: str, text, check: str | None = None) -> None:
    """``text`` for both engines, or a Spark text or function beside the check's own text."""
    VIEWS[name] = (text.strip() if isinstance(text, str) else text, check or text)


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` and its check."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracle(sql)
        return fn

    return wrap

"""Numeric facts: cells bound to metric, entity, period and vintage, their selection and exact arithmetic.

A cell is metric x segment x value year (shipping) x report vintage (ordering). Money stays decimal(20,4) until the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(20,4)"
#: Metric, unit and whether it is an expense, whose sign is dropped in presentation.
METRICS = {"gross": ("AUD", False), "discount": ("AUD", True), "net": ("AUD", False), "quantity": ("units", False)}


def cents(c: Column) -> Column:
    return F.round(c, 4).cast(MONEY)


def cells(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """metric, segment, value_year, vintage, value, unit, expense. Aggregated by group before metrics are unpivoted."""
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    wide = rows.groupBy(F.col("c_mktsegment").alias("segment"), F.year("l_shipdate").alias("value_year"), F.year("o_orderdate").alias("vintage")).agg(
        F.sum(cents(F.col("l_extendedprice"))).cast(MONEY).alias("gross"),
        F.sum(-cents(F.col("l_extendedprice") * F.col("l_discount"))).cast(MONEY).alias("discount"),
        F.sum(cents(F.col("l_extendedprice")) - cents(F.col("l_extendedprice") * F.col("l_discount"))).cast(MONEY).alias("net"),
        F.sum(cents(F.col("l_quantity"))).cast(MONEY).alias("quantity"),
    )
    long = wide.unpivot(["segment", "value_year", "vintage"], list(METRICS), "metric", "value")
    unit, expense = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for m, (u, e) in METRICS.items():
        unit, expense = F.when(F.col("metric") == m, u).otherwise(unit), F.when(F.col("metric") == m, e).otherwise(expense)
    return long.select("metric", "segment", "value_year", "vintage", "value", unit.alias("unit"), expense.alias("expense"))


def identity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: its value if all candidates agree, else null with the issue."""
    n = F.count_distinct("value")
    return rows.groupBy(*keys).agg(n.alias("identities"), F.when(n == 1, F.min("value")).alias("value"), F.when(n == 1, "bound").when(n == 0, "missing").otherwise("conflicting").alias("status"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double rounded to six places; null unless b is positive."""
    return F.when(b > 0, F.round(a.cast("double") / b.cast("double"), 6))


def change(rows: DataFrame, keys: list[str], period: str) -> DataFrame:
    """later - earlier of consecutive periods, and its share of a positive base."""
    w = Window.partitionBy(*keys).orderBy(period)
    out = rows.withColumn("earlier", F.lag("value").over(w)).withColumn("earlier_period", F.lag(period).over(w)).filter("earlier is not null")
    diff = (F.col("value") - F.col("earlier")).cast(MONEY)
    return out.select(*keys, period, "earlier_period", "earlier", F.col("value").alias("later"), diff.alias("change"), ratio(diff * 100, F.col("earlier")).alias("percent"), F.when(F.col("earlier") > 0, "base_positive").otherwise("base_not_positive").alias("reason"))

"""Queries over bound cells: selection, change, shares, reconciliation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog.registry import query, read
from quarry.operators import facts as A

CELLS = """
WITH r AS (SELECT c_mktsegment AS segment, year(l_shipdate) AS value_year, year(o_orderdate) AS vintage, CAST(round(l_extendedprice, 4) AS DECIMAL(20, 4)) AS g, CAST(round(l_extendedprice * l_discount, 4) AS DECIMAL(20, 4)) AS d, CAST(round(l_quantity, 4) AS DECIMAL(20, 4)) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
w AS MATERIALIZED (SELECT segment, value_year, vintage, sum(g) AS gross, sum(-d) AS discount, sum(g - d) AS net, sum(q) AS quantity FROM r GROUP BY ALL),
cells AS MATERIALIZED (SELECT 'gross' AS metric, segment, value_year, vintage, CAST(gross AS DECIMAL(20, 4)) AS value, 'AUD' AS unit, FALSE AS expense FROM w UNION ALL SELECT 'discount', segment, value_year, vintage, discount, 'AUD', TRUE FROM w
  UNION ALL SELECT 'net', segment, value_year, vintage, net, 'AUD', FALSE FROM w UNION ALL SELECT 'quantity', segment, value_year, vintage, quantity, 'units', FALSE FROM w),
yearly AS (SELECT metric, segment, value_year, CAST(sum(value) AS DECIMAL(20, 4)) AS value FROM cells GROUP BY ALL)"""


def cells(spark, sf):
    return A.cells(*(read(spark, sf, t) for t in ("lineitem", "orders", "customer")))


def yearly(spark, sf):
    return cells(spark, sf).groupBy("metric", "segment", "value_year").agg(F.sum("value").cast(A.MONEY).alias("value"))


def num(name):
    return F.col(name).cast("double").alias(name)


@query("cells_unpivot", CELLS + "\nSELECT metric, segment, value_year, vintage, CAST(value AS DOUBLE) AS value, unit, expense FROM cells")
def cells_unpivot(spark, sf):
    return cells(spark, sf).select("metric", "segment", "value_year", "vintage", num("value"), "unit", "expense")


@query("cell_select_identity", CELLS + """
SELECT metric, segment, value_year, count(DISTINCT value) AS identities, CAST(CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS DOUBLE) AS value,
  CASE WHEN count(DISTINCT value) = 1 THEN 'bound' WHEN count(DISTINCT value) = 0 THEN 'missing' ELSE 'conflicting' END AS status FROM cells GROUP BY metric, segment, value_year""")
def cell_select_identity(spark, sf):
    """One identity for each measure, segment and year over all report vintages; vintages that differ conflict."""
    return A.identity(cells(spark, sf), ["metric", "segment", "value_year"]).select("metric", "segment", "value_year", "identities", num("value"), "status")


@query("common_vintage", CELLS + """,
v AS (SELECT metric, segment, vintage FROM cells WHERE value_year IN (1997, 1998) GROUP BY ALL HAVING count(DISTINCT value_year) = 2)
SELECT metric, segment, max(vintage) AS vintage FROM v GROUP BY ALL""")
def common_vintage(spark, sf):
    """The latest vintage that reports both requested years: relational division."""
    both = cells(spark, sf).filter(F.col("value_year").isin(1997, 1998)).groupBy("metric", "segment", "vintage").agg(F.count_distinct("value_year").alias("n")).filter("n = 2")
    return both.groupBy("metric", "segment").agg(F.max("vintage").alias("vintage"))


@query("yoy_change", CELLS + """,
l AS (SELECT *, lag(value) OVER w AS earlier, lag(value_year) OVER w AS earlier_period FROM yearly WINDOW w AS (PARTITION BY metric, segment ORDER BY value_year))
SELECT metric, segment, value_year, earlier_period, CAST(earlier AS DOUBLE) AS earlier, CAST(value AS DOUBLE) AS later, CAST(value - earlier AS DOUBLE) AS change,
  CASE WHEN earlier > 0 THEN round(CAST((value - earlier) * 100 AS DOUBLE) / CAST(earlier AS DOUBLE), 6) END AS percent, CASE WHEN earlier > 0 THEN 'base_positive' ELSE 'base_not_positive' END AS reason FROM l WHERE earlier IS NOT NULL""")
def yoy_change(spark, sf):
    return A.change(yearly(spark, sf), ["metric", "segment"], "value_year").select("metric", "segment", "value_year", "earlier_period", num("earlier"), num("later"), num("change"), "percent", "reason")


@query("ordered_difference", CELLS + """
SELECT a.metric, a.segment, CAST(a.value - b.value AS DOUBLE) AS difference FROM yearly a JOIN yearly b ON a.metric = b.metric AND a.segment = b.segment WHERE a.value_year = 1998 AND b.value_year = 1996""")
def ordered_difference(spark, sf):
    """The named first year minus the named second one, in that order."""
    rows = yearly(spark, sf)
    a, b = (rows.filter(F.col("value_year") == y).select("metric", "segment", F.col("value").alias(n)) for y, n in ((1998, "a"), (1996, "b")))
    return a.join(b, ["metric", "segment"]).select("metric", "segment", (F.col("a") - F.col("b")).cast("double").alias("difference"))


@query("cross_basis_gap", CELLS + """
SELECT g.segment, g.value_year, CAST(g.value - n.value AS DOUBLE) AS gap FROM yearly g JOIN yearly n ON g.segment = n.segment AND g.value_year = n.value_year WHERE g.metric = 'gross' AND n.metric = 'net'""")
def cross_basis_gap(spark, sf):
    """Two bases of one period, side by side in one aggregation."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    rows = yearly(spark, sf).filter(F.col("metric").isin("gross", "net")).groupBy("segment", "value_year").agg((pick("gross") - pick("net")).alias("gap"))
    return rows.select("segment", "value_year", num("gap"))


@query("percentage_points", CELLS + """,
s AS (SELECT segment, value_year, round(CAST(-max(CASE WHEN metric = 'discount' THEN value END) AS DOUBLE) / CAST(max(CASE WHEN metric = 'gross' THEN value END) AS DOUBLE) * 100, 6) AS rate FROM yearly GROUP BY ALL),
l AS (SELECT *, rate - lag(rate) OVER (PARTITION BY segment ORDER BY value_year) AS pp FROM s)
SELECT segment, value_year, rate, round(pp, 6) AS points, round(pp * 100, 4) AS basis_points FROM l WHERE pp IS NOT NULL""")
def percentage_points(spark, sf):
    """Change of a rate in percentage points and basis points, never in percent of the rate."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).cast("double")
    rate = yearly(spark, sf).groupBy("segment", "value_year").agg(F.round(-pick("discount") / pick("gross") * 100, 6).alias("rate"))
    pp = F.col("rate") - F.lag("rate").over(Window.partitionBy("segment").orderBy("value_year"))
    return rate.withColumn("pp", pp).filter("pp is not null").select("segment", "value_year", "rate", F.round("pp", 6).alias("points"), F.round(F.col("pp") * 100, 4).alias("basis_points"))


@query("expense_presentation", CELLS + "\nSELECT metric, segment, value_year, CAST(CASE WHEN metric = 'discount' THEN abs(value) ELSE value END AS DOUBLE) AS shown, metric = 'discount' AND value > 0 AS sign_reversed FROM yearly")
def expense_presentation(spark, sf):
    """Expenses as magnitudes; one whose source sign is reversed is flagged."""
    rows = yearly(spark, sf)
    return rows.select("metric", "segment", "value_year", F.when(F.col("metric") == "discount", F.abs("value")).otherwise(F.col("value")).cast("double").alias("shown"), ((F.col("metric") == "discount") & (F.col("value") > 0)).alias("sign_reversed"))


@query("share_and_contribution", CELLS + """,
l AS (SELECT metric, segment, value_year, value, sum(value) OVER (PARTITION BY metric, value_year) AS total, value - lag(value) OVER (PARTITION BY metric, segment ORDER BY value_year) AS delta FROM yearly),
m AS (SELECT *, sum(delta) OVER (PARTITION BY metric, value_year) AS moved FROM l)
SELECT metric, segment, value_year, round(CAST(value AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share, CASE WHEN moved <> 0 THEN round(CAST(delta AS DOUBLE) / CAST(moved AS DOUBLE), 6) END AS contribution FROM m""")
def share_and_contribution(spark, sf):
    of = Window.partitionBy("metric", "value_year")
    delta = F.col("value") - F.lag("value").over(Window.partitionBy("metric", "segment").orderBy("value_year"))
    rows = yearly(spark, sf).withColumn("delta", delta).withColumn("total", F.sum("value").over(of)).withColumn("moved", F.sum("delta").over(of))
    d = lambda c: F.col(c).cast("double")
    return rows.select("metric", "segment", "value_year", F.round(d("value") / d("total"), 6).alias("share"), F.when(F.col("moved") != 0, F.round(d("delta") / d("moved"), 6)).alias("contribution"))


@query("leaders_with_ties", CELLS + """,
led AS (SELECT *, rank() OVER (PARTITION BY metric, value_year ORDER BY round(value, -5) DESC) AS place FROM yearly)
SELECT metric, value_year, segment FROM led WHERE place = 1""")
def leaders_with_ties(spark, sf):
    """The largest segments of each year to the nearest hundred thousand; ties share the lead."""
    order = Window.partitionBy("metric", "value_year").orderBy(F.desc(F.round("value", -5)))
    return yearly(spark, sf).withColumn("place", F.rank().over(order)).filter("place = 1").select("metric", "value_year", "segment")


@query("vintage_compare", CELLS + """
SELECT a.metric, a.segment, a.value_year, a.vintage AS first_vintage, b.vintage AS later_vintage, CAST(b.value - a.value AS DOUBLE) AS restated FROM cells a JOIN cells b USING (metric, segment, value_year) WHERE a.vintage < b.vintage""")
def vintage_compare(spark, sf):
    """One period as two report vintages have it."""
    rows = cells(spark, sf).select("metric", "segment", "value_year", "vintage", "value")
    a, b = rows.withColumnsRenamed({"vintage": "first_vintage", "value": "x"}), rows.withColumnsRenamed({"vintage": "later_vintage", "value": "y"})
    both = a.join(b, ["metric", "segment", "value_year"]).filter("first_vintage < later_vintage")
    return both.select("metric", "segment", "value_year", "first_vintage", "later_vintage", (F.col("y") - F.col("x")).cast("double").alias("restated"))


@query("variants_all", CELLS + "\nSELECT metric, unit, expense, count(*) AS cells, min(value_year) AS first_year, max(value_year) AS last_year FROM cells GROUP BY ALL")
def variants_all(spark, sf):
    """Every variant that is there; none is inferred."""
    return cells(spark, sf).groupBy("metric", "unit", "expense").agg(F.count("*").alias("cells"), F.min("value_year").alias("first_year"), F.max("value_year").alias("last_year"))


@query("direction_premise", CELLS + """,
l AS (SELECT *, lag(value) OVER (PARTITION BY metric, segment ORDER BY value_year) AS earlier FROM yearly)
SELECT metric, segment, value_year, CAST(sign(value - earlier) AS INTEGER) AS direction, CASE WHEN sign(value - earlier) = 1 THEN 'premise_holds' WHEN sign(value - earlier) = 0 THEN 'no_change' ELSE 'premise_fails' END AS rose FROM l WHERE earlier IS NOT NULL""")
def direction_premise(spark, sf):
    """Whether `why did it rise` has a rise to explain."""
    rows = A.change(yearly(spark, sf), ["metric", "segment"], "value_year")
    s = F.sign(F.col("change").cast("double")).cast("int")
    return rows.select("metric", "segment", "value_year", s.alias("direction"), F.when(s == 1, "premise_holds").when(s == 0, "no_change").otherwise("premise_fails").alias("rose"))


@query("claim_operand_match", CELLS + """,
claims AS (SELECT metric, segment, value_year, CASE WHEN value_year % 2 = 0 THEN value ELSE value + 1 END AS claimed FROM yearly)
SELECT c.metric, c.segment, c.value_year, count(y.value) AS matches, CASE WHEN count(y.value) = 0 THEN 'unsupported' WHEN max(CASE WHEN y.metric = c.metric THEN 1 ELSE 0 END) = 1 THEN 'supported' ELSE 'basis_mismatch' END AS verdict
FROM claims c LEFT JOIN yearly y ON y.segment = c.segment AND y.value_year = c.value_year AND y.value = c.claimed GROUP BY ALL""")
def claim_operand_match(spark, sf):
    """Quoted operands against cells by exact decimal equality."""
    rows = yearly(spark, sf)
    claims = rows.select("metric", "segment", "value_year", F.when(F.col("value_year") % 2 == 0, F.col("value")).otherwise(F.col("value") + 1).cast(A.MONEY).alias("value"))
    found = rows.withColumnRenamed("metric", "of")
    both = claims.join(found, ["segment", "value_year", "value"], "left").groupBy("metric", "segment", "value_year").agg(F.count("of").alias("matches"), F.max((F.col("of") == F.col("metric")).cast("int")).alias("same"))
    return both.select("metric", "segment", "value_year", "matches", F.when(F.col("matches") == 0, "unsupported").when(F.col("same") == 1, "supported").otherwise("basis_mismatch").alias("verdict"))


@query("reconcile_identities", CELLS + """,
i AS (SELECT segment, value_year, max(CASE WHEN metric = 'gross' THEN value END) AS g, max(CASE WHEN metric = 'discount' THEN value END) AS d, max(CASE WHEN metric = 'net' THEN value END) + CASE WHEN segment LIKE 'M%' AND value_year % 3 = 0 THEN 1 ELSE 0 END AS n FROM yearly GROUP BY segment, value_year)
SELECT coalesce(segment, 'ALL') AS segment, value_year, bool_and(g + d = n) AS holds, CAST(sum(g + d - n) AS DOUBLE) AS residual FROM i GROUP BY GROUPING SETS ((segment, value_year), (value_year))""")
def reconcile_identities(spark, sf):
    """gross + discount = net, for each segment and for their sum; fails closed on any residue. Some stated net values are one too large."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    wrong = F.when(F.col("segment").startswith("M") & (F.col("value_year") % 3 == 0), 1).otherwise(0)
    rows = yearly(spark, sf).groupBy("segment", "value_year").agg((pick("gross") + pick("discount") - pick("net")).alias("r")).withColumn("r", F.col("r") - wrong)
    each = rows.groupBy("segment", "value_year").agg(F.bool_and(F.col("r") == 0).alias("holds"), F.sum("r").cast("double").alias("residual"))
    whole = rows.groupBy("value_year").agg(F.bool_and(F.col("r") == 0).alias("holds"), F.sum("r").cast("double").alias("residual")).withColumn("segment", F.lit("ALL"))
    return each.unionByName(whole)

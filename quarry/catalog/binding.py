"""Cell binding end to end: printed report rows, their identity, dated columns, typed cells, selection by request, review, reconciliation.

Reports are printed from the facts: a company (segment) and a report year (order year) have a page with a row for each measure, a
column for each value year and one comparison column. Some numbers of a page are misprinted, so that binding has something to refuse.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog.figures import CELLS, cells
from quarry.catalog.registry import query
from quarry.functions import numbers as N
from quarry.functions.text import ascii_words
from quarry.scratch import cut, spend

#: How each measure's row is labelled; the net row names its scope, by the parity of the report year.
LABELS = {"gross": "Gross sales $m", "discount": "Discounts given $m", "quantity": "Units shipped"}
NET = ("Net sales from continuing operations $m", "Net sales including discontinued operations $m")
#: Row identities in the order in which they are tried: measure, label, basis, scope. A row that matches none is rejected.
IDENTITIES = [
    ("gross", "^gross sales", "reported", "continuing"),
    ("net", "^net sales from continuing", "cash", "continuing"),
    ("net", "^net sales including discontinued", "cash", "including_discontinued"),
    ("discount", "^discounts given", "reported", "continuing"),
]
#: The scope that a request without one means.
DEFAULT_SCOPE = "continuing"

_case = " ".join(f"WHEN '{m}' THEN '{x}'" for m, x in LABELS.items())
PRINTED = CELLS + f""",
printed AS (SELECT metric, segment AS company, vintage AS report_year, value_year, CASE WHEN metric = 'net' THEN CASE WHEN vintage % 2 = 0 THEN '{NET[0]}' ELSE '{NET[1]}' END ELSE CASE metric {_case} END END AS label,
  CAST(round(value, 0) AS BIGINT) AS whole, '31 Dec ' || right(CAST(value_year AS VARCHAR), 2) AS header FROM cells),
grid AS (SELECT *, CASE WHEN whole < 0 THEN '(' || format('{{:,}}', -whole) || ')' ELSE format('{{:,}}', whole) END AS raw FROM printed
  UNION ALL SELECT metric, company, report_year, max(value_year), label, max(whole), max('31 Dec ' || right(CAST(value_year AS VARCHAR), 2)) || ' v prior %', '12%' FROM printed GROUP BY metric, company, report_year, label),
page AS (SELECT company, report_year, list_distinct(list(CASE WHEN abs(whole) % 11 = 3 THEN whole + 1 ELSE whole END)) AS native FROM printed GROUP BY ALL),
identified AS (SELECT g.*, CASE {" ".join(f"WHEN metric = '{m}' AND regexp_matches(lower(label), '{p}') THEN '{b}'" for m, p, b, _ in IDENTITIES)} END AS basis,
  CASE {" ".join(f"WHEN metric = '{m}' AND regexp_matches(lower(label), '{p}') THEN '{s}'" for m, p, _, s in IDENTITIES)} END AS scope FROM grid g),
dated AS (SELECT *, CASE WHEN NOT regexp_matches(lower(header), '\\bvs?\\b|%') THEN CAST(report_year // 100 * 100 + CAST(right(header, 2) AS INTEGER) AS INTEGER) END AS yy FROM identified),
period AS (SELECT *, CASE WHEN yy IS NOT NULL THEN CAST(yy AS VARCHAR) || '-12-31' END AS period_end, CASE WHEN regexp_matches(raw, '^(-?[0-9,]+|[(][0-9,]+[)])$') THEN CAST(CASE WHEN raw LIKE '(%' THEN '-' ELSE '' END || regexp_replace(raw, '[,()]', '', 'g') AS BIGINT) END AS value FROM dated),
bound AS (SELECT p.*, CASE WHEN basis IS NULL THEN 'no_identity' WHEN period_end IS NULL THEN 'no_date' WHEN value IS NULL THEN 'not_a_number' WHEN NOT list_contains(native, value) THEN 'not_on_page' ELSE 'bound' END AS status,
  CASE WHEN label LIKE '%$m%' THEN 'AUD million' END AS unit FROM period p JOIN page USING (company, report_year))"""


def printed(spark, sf):
    """The rows of every report as they are printed: a cell's raw text under its column header."""
    label = F.lit(LABELS["gross"])
    for m, x in LABELS.items():
        label = F.when(F.col("metric") == m, x).otherwise(label)
    label = F.when(F.col("metric") == "net", F.when(F.col("vintage") % 2 == 0, NET[0]).otherwise(NET[1])).otherwise(label)
    header = F.concat(F.lit("31 Dec "), F.substring(F.col("value_year").cast("string"), -2, 2))
    return cells(spark, sf).select("metric", F.col("segment").alias("company"), F.col("vintage").alias("report_year"), "value_year", label.alias("label"), F.round("value", 0).cast("bigint").alias("whole"), header.alias("header"))


def grid(rows):
    """Rows with their raw text, and a comparison column for each row, which is no period."""
    shown = F.format_number(F.abs("whole"), 0)
    plain = rows.withColumn("raw", F.when(F.col("whole") < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown))
    compared = rows.groupBy("metric", "company", "report_year", "label").agg(F.max("value_year").alias("value_year"), F.max("whole").alias("whole"), F.concat(F.max("header"), F.lit(" v prior %")).alias("header"), F.lit("12%").alias("raw"))
    return plain.unionByName(compared)


def native(rows):
    """The numbers that a page's own text has, one page a report; some are misprinted."""
    seen = F.when(F.abs("whole") % 11 == 3, F.col("whole") + 1).otherwise(F.col("whole"))
    return rows.groupBy("company", "report_year").agg(F.collect_set(seen).alias("native"))


def identity(column: int):
    """Basis (2) or scope (3) of the first identity that a row matches."""
    out = F.lit(None).cast("string")
    for rule in reversed(IDENTITIES):
        out = F.when((F.col("metric") == rule[0]) & F.lower("label").rlike(rule[1]), rule[column]).otherwise(out)
    return out


def century(header, report_year):
    """The year of a two-digit column date in the report's century; null of a comparison."""
    own = (F.floor(report_year / 100) * 100).cast("int") + F.substring(header, -2, 2).try_cast("int")
    return F.when(~F.lower(header).rlike(ascii_words("\\bvs?\\b|%")), own)


def bound(spark, sf):
    """Every printed cell with its identity, period, value and unit, and the reason if it cannot be bound; a written table."""
    rows = cut(printed(spark, sf), "printed")
    raw = F.when(F.col("raw").rlike("%"), F.lit(None).cast("decimal(20,4)")).otherwise(N.parse_number(F.col("raw")))
    typed = grid(rows).select("*", identity(2).alias("basis"), identity(3).alias("scope"), century(F.col("header"), F.col("report_year")).alias("yy"), raw.cast("bigint").alias("value"))
    typed = typed.withColumn("period_end", F.when(F.col("yy").isNotNull(), F.concat(F.col("yy").cast("string"), F.lit("-12-31"))))
    status = F.when(F.col("basis").isNull(), "no_identity").when(F.col("period_end").isNull(), "no_date").when(F.col("value").isNull(), "not_a_number").when(~F.array_contains("native", F.col("value")), "not_on_page").otherwise("bound")
    unit = F.when(F.contains("label", F.lit("$m")), "AUD million")
    out = cut(typed.join(native(rows), ["company", "report_year"]).select("*", status.alias("status"), unit.alias("unit")), "bound")
    spend(rows)
    return out


@query("row_identity", PRINTED + "\nSELECT DISTINCT metric, company, report_year, label, basis, scope FROM identified")
def row_identity(spark, sf):
    """The basis and scope that a row's label proves for its measure; null where no rule accepts it."""
    return printed(spark, sf).select("metric", "company", "report_year", "label", identity(2).alias("basis"), identity(3).alias("scope")).distinct()


@query("bind_cells", PRINTED + "\nSELECT metric, company, report_year, header, raw, basis, scope, period_end, value, unit, status FROM bound")
def bind_cells(spark, sf):
    """Row by column to typed cells: identity, one date, a strict number that the page's own text has, and a unit."""
    return bound(spark, sf).select("metric", "company", "report_year", "header", "raw", "basis", "scope", "period_end", "value", "unit", "status")


SELECTED = PRINTED + """,
ask AS (SELECT DISTINCT company, metric, y FROM printed CROSS JOIN (SELECT unnest([1995, 1996]) AS y) WHERE metric IN ('gross', 'net', 'discount')),
cand AS (SELECT a.company, a.metric, a.y, b.report_year, b.value, b.unit, b.basis, b.scope, b.period_end FROM ask a LEFT JOIN bound b ON b.company = a.company AND b.metric = a.metric AND b.status = 'bound' AND b.scope = 'continuing' AND b.yy = a.y AND (a.company <> 'BUILDING' OR a.metric <> 'net' OR b.report_year = 1995)),
common AS (SELECT company, metric, max(report_year) AS common_year FROM (SELECT company, metric, report_year FROM cand WHERE report_year IS NOT NULL GROUP BY ALL HAVING count(DISTINCT y) = 2) GROUP BY ALL),
pref AS (SELECT c.*, coalesce(common_year, CASE WHEN max(CASE WHEN report_year = y THEN 1 ELSE 0 END) OVER (PARTITION BY company, metric, y) = 1 THEN y ELSE max(report_year) OVER (PARTITION BY company, metric, y) END) AS preferred FROM cand c LEFT JOIN common USING (company, metric)),
one AS (SELECT company, metric, y, max(preferred) AS report_year, count(DISTINCT CASE WHEN report_year = preferred THEN (value, unit, basis, scope, period_end) END) AS identities, max(CASE WHEN report_year = preferred THEN value END) AS value FROM pref GROUP BY ALL)"""


def selected(spark, sf):
    """One cell for each request (company, measure, year) in the default scope, from one vintage if one reports all years; else the issue.

    The request for the net sales of BUILDING names the report of 1995, which has them in another scope only: nothing may stand in.
    """
    rows = bound(spark, sf)
    years = F.explode(F.array(F.lit(1995), F.lit(1996))).alias("y")
    ask = rows.filter(F.col("metric").isin("gross", "net", "discount")).select("company", "metric").distinct().select("company", "metric", years)
    good = rows.filter((F.col("status") == "bound") & (F.col("scope") == DEFAULT_SCOPE)).select("company", "metric", F.col("yy").alias("y"), "report_year", "value", "unit", "basis", "scope", "period_end")
    named = (F.col("company") == "BUILDING") & (F.col("metric") == "net") & (F.col("report_year") != 1995)
    cand = ask.join(good.filter(~named), ["company", "metric", "y"], "left")
    both = cand.filter("report_year is not null").groupBy("company", "metric", "report_year").agg(F.count_distinct("y").alias("n")).filter("n = 2")
    common = both.groupBy("company", "metric").agg(F.max("report_year").alias("common_year"))
    w = Window.partitionBy("company", "metric", "y")
    own = F.when(F.max((F.col("report_year") == F.col("y")).cast("int")).over(w) == 1, F.col("y")).otherwise(F.max("report_year").over(w))
    pref = cand.join(common, ["company", "metric"], "left").withColumn("preferred", F.coalesce("common_year", own))
    chosen = F.col("report_year") == F.col("preferred")
    return pref.groupBy("company", "metric", "y").agg(F.max("preferred").alias("report_year"), F.count_distinct(F.when(chosen, F.struct("value", "unit", "basis", "scope", "period_end"))).alias("identities"), F.max(F.when(chosen, F.col("value"))).alias("value"))


STATUS_SQL = "CASE WHEN identities = 1 THEN 'bound' WHEN identities = 0 THEN 'missing' ELSE 'conflicting' END"


def status():
    return F.when(F.col("identities") == 1, "bound").when(F.col("identities") == 0, "missing").otherwise("conflicting")


@query("select_cells", SELECTED + f"\nSELECT company, metric, CAST(y AS INTEGER) AS value_year, report_year, identities, CASE WHEN identities = 1 THEN value END AS value, {STATUS_SQL} AS status FROM one")
def select_cells(spark, sf):
    return selected(spark, sf).select("company", "metric", F.col("y").alias("value_year"), "report_year", "identities", F.when(F.col("identities") == 1, F.col("value")).alias("value"), status().alias("status"))


@query("bound_change", SELECTED + f""",
ok AS (SELECT *, {STATUS_SQL} AS status FROM one),
p AS (SELECT a.company, a.metric, a.value AS earlier, b.value AS later, a.report_year = b.report_year AS same_report, a.status = 'bound' AND b.status = 'bound' AS whole FROM ok a JOIN ok b USING (company, metric) WHERE a.y = 1995 AND b.y = 1996)
SELECT company, metric, CASE WHEN whole AND same_report THEN later - earlier END AS change, CASE WHEN whole AND same_report AND earlier > 0 THEN round((later - earlier) * 100.0::DOUBLE / earlier, 6) END AS percent,
  CASE WHEN NOT whole THEN 'unbound operand' WHEN NOT same_report THEN 'incompatible report_year' END AS issue FROM p""")
def bound_change(spark, sf):
    """From request to change: both operands bound, from one vintage, else the issue and no number."""
    rows = cut(selected(spark, sf).withColumn("ok", status() == "bound"), "selected")
    a, b = (rows.filter(F.col("y") == y).select("company", "metric", F.col("value").alias(n), F.col("report_year").alias(n + "_report"), F.col("ok").alias(n + "_ok")) for y, n in ((1995, "earlier"), (1996, "later")))
    both = a.join(b, ["company", "metric"])
    whole, same = F.col("earlier_ok") & F.col("later_ok"), F.coalesce(F.col("earlier_report") == F.col("later_report"), F.lit(False))
    delta = F.col("later") - F.col("earlier")
    percent = F.when(whole & same & (F.col("earlier") > 0), F.round(delta * 100.0 / F.col("earlier"), 6))
    return both.select("company", "metric", F.when(whole & same, delta).alias("change"), percent.alias("percent"), F.when(~whole, "unbound operand").when(~same, "incompatible report_year").alias("issue"))


@query("structural_candidates", PRINTED + "\nSELECT company, metric, count(*) AS rows_scanned, count(*) FILTER (status = 'bound') AS bound FROM bound WHERE company = 'BUILDING' AND metric = 'net' GROUP BY ALL")
def structural_candidates(spark, sf):
    """All rows of one company and measure are candidates, not the best few."""
    rows = bound(spark, sf).filter((F.col("company") == "BUILDING") & (F.col("metric") == "net"))
    return rows.groupBy("company", "metric").agg(F.count("*").alias("rows_scanned"), F.count_if(F.col("status") == "bound").alias("bound"))


REVIEWS = PRINTED + """,
src AS (SELECT company, report_year, metric, header, raw, company || '|' || report_year || '|' || metric || '|' || header || '|' || raw AS text FROM period WHERE value IS NOT NULL),
review AS (SELECT *, sha256(CASE WHEN report_year % 5 = 2 THEN text || '!' ELSE text END) AS seen, CASE WHEN report_year % 3 = 0 THEN 'rejected' ELSE 'approved' END AS verdict, CASE metric WHEN 'quantity' THEN 'crates' ELSE 'AUD million' END AS unit FROM src)"""


@query("reviewed_operands", REVIEWS + """
SELECT company, report_year, metric, header, CASE WHEN verdict <> 'approved' THEN 'not approved' WHEN seen <> sha256(text) THEN 'source text changed' WHEN unit NOT IN ('AUD million', 'AUD billion', 'AUD', 'cents/share', 'AUD/share', 'percent') THEN 'unsupported unit' ELSE 'accepted' END AS outcome FROM review""")
def reviewed_operands(spark, sf):
    """An operand is accepted only if it is approved, its source text is still the one reviewed, and its unit is known."""
    rows = bound(spark, sf).filter("value is not null")
    text = F.concat_ws("|", "company", F.col("report_year").cast("string"), "metric", "header", "raw")
    rows = rows.withColumn("text", text).withColumn("seen", F.sha2(F.when(F.col("report_year") % 5 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256))
    verdict, unit = F.when(F.col("report_year") % 3 == 0, "rejected").otherwise("approved"), F.when(F.col("metric") == "quantity", "crates").otherwise("AUD million")
    outcome = F.when(verdict != "approved", "not approved").when(F.col("seen") != F.sha2("text", 256), "source text changed").when(~unit.isin(*N.UNITS), "unsupported unit").otherwise("accepted")
    return rows.select("company", "report_year", "metric", "header", outcome.alias("outcome"))


KEYS = ["company", "scope", "unit", "report_year", "metric", "basis"]


@query("comparable_pairs", PRINTED + f"""
SELECT {', '.join('a.' + k for k in KEYS)}, a.period_end AS earlier_end, b.period_end AS later_end FROM bound a JOIN bound b ON {' AND '.join(f'a.{k} = b.{k}' for k in KEYS)} AND a.period_end < b.period_end WHERE a.status = 'bound' AND b.status = 'bound'""")
def comparable_pairs(spark, sf):
    """Bound cells that agree in company, scope, unit, vintage, measure and basis, over distinct periods. A report has a few periods."""
    rows = bound(spark, sf).filter("status = 'bound'").select(*KEYS, "period_end")
    ends = rows.groupBy(*KEYS).agg(F.sort_array(F.collect_set("period_end")).alias("ends"))
    pairs = ends.select(*KEYS, "ends", F.posexplode("ends").alias("i", "earlier_end"))
    return pairs.select(*KEYS, "earlier_end", F.explode(F.slice("ends", F.col("i") + 2, F.size("ends"))).alias("later_end"))


LINES = PRINTED + """,
line AS (SELECT company, report_year, metric, label, string_agg(raw, '  ' ORDER BY value_year) AS figures, count(*) AS n FROM grid WHERE raw <> '12%' GROUP BY ALL),
both_readers AS (SELECT *, label || '  ' || figures AS text, CASE WHEN report_year % 7 = 5 THEN label || '  ' || figures || ' 1' ELSE label || '  ' || figures END AS layout FROM line),
taken AS (SELECT *, regexp_extract_all(regexp_extract(text, '^.*?  (.*)$', 1), '[(]?[0-9][0-9,]*[)]?') AS a, list_filter(string_split(regexp_extract(layout, '^.*?  (.*)$', 1), ' '), lambda z: z <> '') AS b FROM both_readers)"""


@query("row_extraction_agreement", LINES + "\nSELECT company, report_year, metric, CAST(len(a) AS INTEGER) AS found, CASE WHEN len(a) <> n THEN 'wrong number of columns' WHEN a <> b THEN 'readers disagree' ELSE 'accepted' END AS outcome, CASE WHEN len(a) = n AND a = b THEN array_to_string(a, ' ') END AS figures FROM taken")
def row_extraction_agreement(spark, sf):
    """Figures of a printed line by two readers, a pattern and a split at spaces; taken only if the columns are all there and both agree."""
    rows = grid(printed(spark, sf)).filter("raw <> '12%'").groupBy("company", "report_year", "metric", "label").agg(F.array_sort(F.collect_list(F.struct("value_year", "raw"))).alias("l"), F.count("*").alias("n"))
    text = F.concat("label", F.lit("  "), F.array_join("l.raw", "  "))
    rows = rows.withColumn("text", text).withColumn("layout", F.when(F.col("report_year") % 7 == 5, F.concat("text", F.lit(" 1"))).otherwise(F.col("text")))
    tail = lambda c: F.regexp_extract(c, "^.*?  (.*)$", 1)
    a, b = F.regexp_extract_all(tail("text"), F.lit("[(]?[0-9][0-9,]*[)]?"), F.lit(0)), F.filter(F.split(tail("layout"), " "), lambda z: z != "")
    rows = rows.withColumn("a", a).withColumn("b", b)
    outcome = F.when(F.size("a") != F.col("n"), "wrong number of columns").when(F.col("a") != F.col("b"), "readers disagree").otherwise("accepted")
    return rows.select("company", "report_year", "metric", F.size("a").alias("found"), outcome.alias("outcome"), F.when(outcome == "accepted", F.array_join("a", " ")).alias("figures"))


@query("statement_bridge", PRINTED + """,
wide AS (SELECT company, report_year, value_year, max(whole) FILTER (metric = 'gross') AS g, max(whole) FILTER (metric = 'discount') AS d, max(whole) FILTER (metric = 'net') AS n FROM printed GROUP BY ALL)
SELECT company, report_year, value_year, 'Gross ' || g || CASE WHEN d < 0 THEN ' less ' || -d ELSE ' plus ' || d END || ' gives ' || n AS bridge, abs(g + d - n) <= 1 AS reconciled FROM wide WHERE g IS NOT NULL AND d IS NOT NULL AND n IS NOT NULL""")
def statement_bridge(spark, sf):
    """A statement's rows as a signed bridge, and whether it adds up to the unit that rounding leaves open."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("whole")))
    wide = printed(spark, sf).groupBy("company", "report_year", "value_year").agg(pick("gross").alias("g"), pick("discount").alias("d"), pick("net").alias("n")).dropna(subset=["g", "d", "n"])
    step = F.when(F.col("d") < 0, F.concat(F.lit(" less "), (-F.col("d")).cast("string"))).otherwise(F.concat(F.lit(" plus "), F.col("d").cast("string")))
    text = F.concat(F.lit("Gross "), F.col("g").cast("string"), step, F.lit(" gives "), F.col("n").cast("string"))
    return wide.select("company", "report_year", "value_year", text.alias("bridge"), (F.abs(F.col("g") + F.col("d") - F.col("n")) <= 1).alias("reconciled"))


@query("segments_to_group", PRINTED + """,
seg AS (SELECT metric, report_year, value_year, company, whole FROM printed),
grp AS (SELECT metric, report_year, value_year, sum(whole) + CASE WHEN value_year % 4 = 1 THEN 5 ELSE 0 END AS stated FROM seg GROUP BY metric, report_year, value_year)
SELECT s.metric, s.report_year, s.value_year, CAST(sum(s.whole) AS BIGINT) AS parts, CAST(max(g.stated) AS BIGINT) AS stated, sum(s.whole) = max(g.stated) AS reconciled FROM seg s JOIN grp g ON g.metric = s.metric AND g.report_year = s.report_year AND g.value_year = s.value_year GROUP BY s.metric, s.report_year, s.value_year""")
def segments_to_group(spark, sf):
    """Segments against the group total that a report states; every fourth year states it wrongly, and is refused."""
    rows = printed(spark, sf).groupBy("metric", "report_year", "value_year").agg(F.sum("whole").alias("parts"))
    stated = F.col("parts") + F.when(F.col("value_year") % 4 == 1, 5).otherwise(0)
    return rows.select("metric", "report_year", "value_year", "parts", stated.alias("stated"), (F.col("parts") == stated).alias("reconciled"))


@query("century_dates", PRINTED + """
SELECT company, report_year, header, yy AS resolved_year, period_end FROM (SELECT DISTINCT company, report_year, header, yy, period_end FROM period)""")
def century_dates(spark, sf):
    """Two-digit column dates in the century of their report; a comparison column has no date."""
    rows = grid(printed(spark, sf)).select("company", "report_year", "header", century(F.col("header"), F.col("report_year")).alias("resolved_year")).distinct()
    return rows.withColumn("period_end", F.when(F.col("resolved_year").isNotNull(), F.concat(F.col("resolved_year").cast("string"), F.lit("-12-31"))))



@query("labelled_alternatives", PRINTED + """
SELECT company, metric, yy AS value_year, count(DISTINCT (basis, scope)) AS variants, string_agg(DISTINCT basis || '/' || scope, ';' ORDER BY basis || '/' || scope) AS labels FROM bound WHERE status = 'bound' GROUP BY company, metric, yy""")
def labelled_alternatives(spark, sf):
    """Every labelled variant of a measure that a page proves, side by side; a missing one is not inferred."""
    name = F.concat_ws("/", "basis", "scope")
    rows = bound(spark, sf).filter("status = 'bound'").groupBy("company", "metric", F.col("yy").alias("value_year")).agg(F.array_sort(F.collect_set(name)).alias("l"))
    return rows.select("company", "metric", "value_year", F.size("l").cast("long").alias("variants"), F.array_join("l", ";").alias("labels"))


@query("accounting_identities", CELLS + """,
cc AS (SELECT metric, segment, value_year, CASE WHEN metric = 'net' AND value_year % 3 = 0 AND segment LIKE 'M%' THEN value + 1 WHEN metric = 'discount' AND value_year % 3 = 1 AND segment LIKE 'B%' THEN -value ELSE value END AS value FROM yearly),
i AS (SELECT segment, value_year, max(value) FILTER (metric = 'gross') AS g, max(value) FILTER (metric = 'discount') AS d, max(value) FILTER (metric = 'net') AS n, max(value) FILTER (metric = 'quantity') AS q FROM cc GROUP BY ALL),
rr AS (SELECT segment, value_year, [('gross_plus_discount', g + d - n), ('net_minus_discount', n - d - g), ('expense_sign', greatest(d, 0)), ('net_at_most_gross', greatest(n - g, 0)), ('quantity_positive', CASE WHEN q > 0 THEN 0 ELSE 1 END)] AS checks FROM i),
u AS (SELECT segment, value_year, unnest(checks) AS x FROM rr)
SELECT segment, value_year, x[1] AS identity, CAST(x[2] AS DOUBLE) AS residual, x[2] = 0 AS holds FROM u""")
def accounting_identities(spark, sf):
    """Five identities of a statement over cells of which some are corrupted; an identity that leaves a residue does not hold."""
    from quarry.catalog.figures import yearly

    wrong_net = (F.col("metric") == "net") & (F.col("value_year") % 3 == 0) & F.col("segment").startswith("M")
    wrong_sign = (F.col("metric") == "discount") & (F.col("value_year") % 3 == 1) & F.col("segment").startswith("B")
    rows = yearly(spark, sf).withColumn("value", F.when(wrong_net, F.col("value") + 1).when(wrong_sign, -F.col("value")).otherwise(F.col("value")))
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).cast("decimal(24,4)")
    wide = rows.groupBy("segment", "value_year").agg(pick("gross").alias("g"), pick("discount").alias("d"), pick("net").alias("n"), pick("quantity").alias("q"))
    g, d, n, q = map(F.col, "gdnq")
    none = F.lit(0).cast("decimal(24,4)")
    checks = [("gross_plus_discount", g + d - n), ("net_minus_discount", n - d - g), ("expense_sign", F.greatest(d, none)), ("net_at_most_gross", F.greatest(n - g, none)), ("quantity_positive", F.when(q > 0, 0).otherwise(1))]
    long = wide.select("segment", "value_year", F.explode(F.array(*[F.struct(F.lit(k).alias("identity"), r.cast("double").alias("residual")) for k, r in checks])).alias("x"))
    return long.select("segment", "value_year", "x.identity", "x.residual", (F.col("x.residual") == 0).alias("holds"))

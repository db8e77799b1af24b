"""Planning queries: entities, intent, measures, guards, operations, scopes and requests over conversation turns; the streamed follow-up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog.registry import query, read
from quarry.functions import text as X
from quarry.plans import intent as P
from quarry.plans.rules import among, anyof, changed, every, first, flag, found, has, quoted, size

#: Questions that every rule set can be tried on, as the corpus turns carry invented words.
QUESTIONS = [
    "What does NIM mean?", "Why did operating expenses change?", "Give me a summary", "Compare CBA and NAB", "Reconcile cash profit", "Should I buy ANZ?", "Calculate the change in total assets",
    "2024 minus 2023 dividend per share", "Convert EPS to USD", "housing loans growth", "LCR and CET1 for NAB in FY24", "What was CBA cash profit in FY2025?", "CBA FY2024 and NAB FY2025 net interest margin",
    "What was profit in 2025?", "What is my account balance?", "What will profit be next year?", "CBA statutory NPAT minus cash profit in FY2025", "How much did CBA operating expenses grow from FY2024 to FY2025?",
    "Subtract FY2024 total assets from FY2025 total assets for NAB", "cash profit less operating expenses", "later LCR minus earlier LCR", "What was CBA cash earnings per share in the 2024 annual report?",
    "CBA cash profit from continuing operations and including discontinued operations, both scopes, as originally reported in FY2024 and FY2025", "NAB half year dividend per share", "CBA total assets as at 30 September 2025",
    "CBA total assets at 30 June 2025", "What is the difference between cash profit and cash flow?", "Explain not a later restatement of NAB profit", "interim dividend of CBA", "diluted EPS for NAB 2025", "effective tax rate CBA",
    "Please could you tell me commbank proift in FY25?", "how much money did CBA make in FY2025?", "What was income from continuing operations only, discontinued operations only profit", "Where is CBA investing, and how much?",
    "What are the risks and the outlook for NAB?", "How did CBA perform in 2025? Give an overview of results", "Which industries does NAB lend to?", "Is it good that staff costs fell?", "Define NIM and CET1", "gross loans and customer deposits of CBA and NAB in 2024 and 2025",
    "What drove the change in CBA net profit in FY2025 and why did credit impairment rise?", "What was CBA total loans in 2025?", "CBA income statement operating income", "NAB net interest income 2024, basic statutory EPS", "percentage change in NIM for CBA, not a percent", "What is NIM?",
    "What was CBA cash profit in FY2025?", "And NAB?", "What was CBA total assets in FY2025?", "What about FY2024?", "And the weather?",
    "In FY2025, what was the cash profit of CBA?", "CBA cash earnings FY2025", "NAB cash profit in FY2025", "CBA cash profit in FY2024", "CBA NIM and CET1 in FY2025", "In FY2025: CET1 and net interest margin of Commonwealth Bank of Australia",
]
#: Pairs of those questions, a base and a rewording; the third and fourth pair ask for something else.
FAMILIES = [(QUESTIONS.index(a), QUESTIONS.index(b)) for a, b in (
    ("What was CBA cash profit in FY2025?", "In FY2025, what was the cash profit of CBA?"), ("What was CBA cash profit in FY2025?", "CBA cash earnings FY2025"), ("What was CBA cash profit in FY2025?", "NAB cash profit in FY2025"), ("What was CBA cash profit in FY2025?", "CBA cash profit in FY2024"),
    ("CBA NIM and CET1 in FY2025", "In FY2025: CET1 and net interest margin of Commonwealth Bank of Australia"))]
ASKED = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT -1, CAST(i AS BIGINT), q FROM (SELECT unnest(range(%d)) AS i, unnest([%s]) AS q)" % (len(QUESTIONS), ", ".join(map(quoted, QUESTIONS)))
NORM = f"""WITH t0 AS (SELECT conv_id, turn, coalesce(text, '') AS raw, array_to_string(regexp_extract_all(lower(text), '[a-z]+|[0-9]+'), ' ') AS s FROM ({ASKED})),
t1 AS (SELECT *, {P.TEXTS['a'].sql} AS a, {P.TEXTS['r'].sql} AS r, {P.TEXTS['e'].sql} AS e FROM t0),
t2 AS (SELECT *, regexp_replace(lower(a), '-', ' ', 'g') AS low, list_sort(list_distinct({P.YEARS.sql})) AS years FROM t1),
t AS (SELECT *, {P.TAGGED.sql} AS tags, {P.NAMED.sql} AS entities FROM t2)"""


def asked(spark, sf):
    """User turns and the fixed questions with the texts, years, measures and entities that rules read."""
    turns = read(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    fixed = spark.createDataFrame([(-1, i, q) for i, q in enumerate(QUESTIONS)], "conv_id long, turn long, text string")
    rows = turns.unionByName(fixed).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("raw"), X.norm(F.col("text")).alias("s"))
    rows = rows.select("*", *[v.column().alias(n) for n, v in P.TEXTS.items()])
    rows = rows.select("*", F.regexp_replace(F.lower("a"), "-", " ").alias("low"), F.array_sort(F.array_distinct(P.YEARS.column())).alias("years"))
    return rows.select("*", P.TAGGED.column().alias("tags"), P.NAMED.column().alias("entities"))


def plan_query(name: str, doc: str, **columns):
    """A query with a column for each rule value; a list is joined by commas."""
    lists = {n for n, v in columns.items() if v in (P.TAGGED, P.NAMED, P.YEARS) or v.sql.startswith(("list_filter", "regexp_extract_all"))}
    shown = ", ".join(f"array_to_string({v.sql}, ',') AS {n}" if n in lists else f"{v.sql} AS {n}" for n, v in columns.items())

    def run(spark, sf):
        made = [(F.array_join(v.column(), ",") if n in lists else v.column()).alias(n) for n, v in columns.items()]
        return asked(spark, sf).select("conv_id", "turn", *made)

    run.__name__, run.__doc__ = name, doc
    return query(name, f"{NORM} SELECT conv_id, turn, {shown} FROM t")(run)


INTENT_CASCADE = plan_query("intent_cascade", "The first intent that matches.", intent=P.INTENT)


@query("metric_tags", f"{NORM} SELECT conv_id, turn, unnest(tags) AS tag FROM t")
def metric_tags(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", F.explode("tags").alias("tag"))


plan_query("guard_first_match", "The first scope guard that applies.", reason=first(P.GUARDS))
plan_query("operation_plan", "Arithmetic asked for: kind, operand order, whether in percent, and whether expenses show as magnitudes.", kind=first(P.OPERATIONS, "none"), operands=first(P.ORDERS), **P.FLAGS)

ORIGINAL = has("originally (?:reported|published)|original (?:fy ?[0-9]{4} )?report")
REPORT = has("\\b(?:fy ?)?20[0-9]{2} (?:profit announcement|results report|annual report|report)\\b")


@query("plan_entities", f"""{NORM} SELECT conv_id, turn, array_to_string(entities, ',') AS entities, array_to_string(years, ',') AS years, CASE WHEN len(years) = 1 AND {(ORIGINAL | REPORT).sql} THEN years[1] END AS report_year,
  {has('annual report').sql} AS annual_only, {P.AMBIGUOUS.sql} AS ambiguous FROM t""")
def plan_entities(spark, sf):
    """What a question names: entities, value years, a report vintage if it names one, and whether its profit is ambiguous."""
    vintage = F.when((F.size("years") == 1) & (ORIGINAL | REPORT).column(), F.get("years", F.lit(0)))
    return asked(spark, sf).select("conv_id", "turn", F.array_join("entities", ",").alias("entities"), F.array_join("years", ",").alias("years"), vintage.alias("report_year"), has("annual report").column().alias("annual_only"), P.AMBIGUOUS.column().alias("ambiguous"))


plan_query("plan_behaviour", "Answer, clarify or abstain, with the reason.", behaviour=first(P.BEHAVIOUR, "answer"))

#: Concepts that a question without a named measure may mean, by words that stand for them.
CONCEPTS = [("nim", has("\\bmargin\\b")), ("cash_profit", has("\\b(?:earn|make|made) money\\b|\\bcash result\\b")), ("operating_expenses", has("\\b(?:costs?|spending)\\b")), ("gross_loans", has("\\blending\\b|\\bloans?\\b")), ("customer_deposits", has("\\bdeposits?\\b")), ("cet1", has("\\bcapital\\b")), ("lcr", has("\\bliquidity\\b")), ("dividend_per_share", has("\\bdividends?\\b"))]


def nearest_concept(name: str):
    """The concept is the first in the list whose words the question has; a measure that is no concept never is."""
    at = next((i for i, (n, _) in enumerate(CONCEPTS) if n == name), None)
    if at is None:
        return has("^$") & ~has("^$")
    return CONCEPTS[at][1] & ~anyof([t for _, t in CONCEPTS[:at]]) if at else CONCEPTS[at][1]


INTERIM = has("half year|six months|half yearly|\\bh ?[12]\\b|quarter|march|december")
plan_query(
    "semantic_fallback_plan",
    "The named measures, else the nearest concept by its words; and whether an explanation prefers annual comparisons.",
    metrics=every([(n, t | (size("tags", "=", 0) & nearest_concept(n))) for n, t in P.MEASURES]),
    annual_explanation=flag(~INTERIM & has("\\bfy ?[0-9]|annual|year|prior")),
)

VINTAGE = "\\b(?:fy ?)?(20[0-9]{2}) (?:profit announcement|results(?: publication| report)?|annual report|report|disclosures|publication|accounts)|\\b(?:report|publication|disclosures) (?:for|of|from) (?:fy ?)?(20[0-9]{2})"
EXPLICIT = found(VINTAGE, "s", 0)


@query("report_vintage", f"""{NORM}, v AS (SELECT *, list_distinct([regexp_extract(x, '20[0-9]{{2}}') FOR x IN {EXPLICIT.sql}]) AS named, {P.INTENT.sql} AS intent FROM t)
SELECT conv_id, turn, CASE WHEN len(named) = 1 THEN named[1] WHEN len(years) = 1 AND (intent IN ('define', 'explain') OR contains(s, 'original')) THEN years[1] END AS vintage, {P.restrictions('CBA').sql} AS cba_restriction, {P.restrictions('NAB').sql} AS nab_restriction FROM v""")
def report_vintage(spark, sf):
    """The report that a question wants: one that it names, else its only year for originals, definitions and explanations; and periods that cannot be bound."""
    named = F.array_distinct(F.transform(EXPLICIT.column(), lambda x: F.regexp_extract(x, "20[0-9]{2}", 0)))
    rows = asked(spark, sf).withColumn("named", named).withColumn("intent", P.INTENT.column())
    own = (F.size("years") == 1) & (F.col("intent").isin("define", "explain") | F.contains("s", F.lit("original")))
    vintage = F.when(F.size("named") == 1, F.get("named", F.lit(0))).when(own, F.get("years", F.lit(0)))
    return rows.select("conv_id", "turn", vintage.alias("vintage"), *[P.restrictions(n).column().alias(f"{n.lower()}_restriction") for n in P.YEAR_END])


# requests ----------------------------------------------------------------------------------------------------------

ENTITY = "|".join(p for _, p in P.ENTITIES)
MARKED = changed("s", (f"({ENTITY})", "|$1"))
#: Segments of a question, each from one mention of an entity to the next, with the years in it.
SEGMENTS_SQL = f"""{NORM}, g AS (SELECT conv_id, turn, years AS all_years, entities, unnest(string_split({MARKED.sql}, '|')[2:]) AS segment FROM t),
n AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(segment, {quoted('^' + p)}) THEN {quoted(e)}" for e, p in P.ENTITIES)} END AS entity, regexp_extract_all(segment, '\\b(?:fy ?)?(20[0-9]{{2}})\\b', 1) AS own FROM g),
b AS (SELECT conv_id, turn, entity, any_value(all_years) AS all_years, list_sort(list_distinct(flatten(list(own)))) AS own FROM n GROUP BY ALL),
bound AS (SELECT *, count(*) OVER q > 1 AND len(all_years) > 1 AND min(len(own)) OVER q > 0 AS near FROM b WINDOW q AS (PARTITION BY conv_id, turn))"""


def bound_years(spark, sf):
    """conv_id, turn, entity, value_years and near: the years that stand by each entity, if all have some, else all years."""
    parts = F.slice(F.split(MARKED.column(), "\\|"), 2, 1_000_000)
    rows = asked(spark, sf).select("conv_id", "turn", F.col("years").alias("all_years"), F.explode(parts).alias("segment"))
    entity = P.first_match(F.col("segment"), [(e, "^" + p) for e, p in P.ENTITIES], None)
    rows = rows.withColumn("entity", entity).withColumn("own", F.regexp_extract_all("segment", F.lit("\\b(?:fy ?)?(20[0-9]{2})\\b"), F.lit(1)))
    per = rows.groupBy("conv_id", "turn", "entity").agg(F.first("all_years").alias("all_years"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("own"))
    q = Window.partitionBy("conv_id", "turn")
    near = (F.count("*").over(q) > 1) & (F.size("all_years") > 1) & (F.min(F.size("own")).over(q) > 0)
    return per.withColumn("near", near).withColumn("value_years", F.when(F.col("near"), F.col("own")).otherwise(F.col("all_years")))


@query("entity_year_binding", SEGMENTS_SQL + " SELECT conv_id, turn, entity, near, array_to_string(CASE WHEN near THEN own ELSE all_years END, ',') AS value_years FROM bound")
def entity_year_binding(spark, sf):
    """Years bound to the entity in whose segment they stand; the full cross product unless every entity has its own."""
    return bound_years(spark, sf).select("conv_id", "turn", "entity", "near", F.array_join("value_years", ",").alias("value_years"))


ANY_MENTION = "|".join(f"(?:{p})" for p in P.MENTIONS.values())
FOCUS = changed("s", (f"({ANY_MENTION})", "|$1"))
SCOPED = " ".join(f"WHEN tag = '{t}' AND len(list_filter(parts, z -> regexp_matches(z, '^(?:{p})'))) > 0 THEN array_to_string(list_filter(parts, z -> regexp_matches(z, '^(?:{p})')), ' ')" for t, p in P.MENTIONS.items()).replace("z ->", "lambda z:")
REQUESTS_SQL = SEGMENTS_SQL + f""",
w AS (SELECT conv_id, turn, s, unnest(CASE WHEN len(tags) = 0 OR {P.INTENT.sql} IN ('explain', 'reconcile') THEN [NULL] ELSE tags END) AS tag, string_split({FOCUS.sql}, '|')[2:] AS parts, {P.INTENT.sql} AS intent FROM t WHERE {first(P.BEHAVIOUR, 'answer').sql} = 'answer'),
f AS (SELECT *, CASE {SCOPED} ELSE s END AS focus FROM w),
sc AS (SELECT *, CASE WHEN tag NOT IN ('cash_profit', 'statutory_npat', 'basic_cash_eps') OR tag IS NULL THEN [NULL]
   WHEN contains(focus, 'continuing operations') AND contains(focus, 'including discontinued') AND regexp_matches(focus, 'both|two scopes') THEN ['continuing', 'including_discontinued']
   WHEN regexp_matches(focus, 'including discontinued|after discontinued') THEN ['including_discontinued'] WHEN contains(focus, 'continuing operations') THEN ['continuing']
   WHEN contains(s, 'entire') AND contains(s, 'group') AND tag = 'statutory_npat' THEN ['including_discontinued'] ELSE [NULL] END AS scopes FROM f),
y AS (SELECT conv_id, turn, entity, CASE WHEN near THEN own ELSE all_years END AS value_years FROM bound),
u AS (SELECT sc.conv_id, sc.turn, entity, tag, intent, value_years, unnest(scopes) AS scope, contains(s, 'original') AND len(value_years) > 1 AS branched FROM sc JOIN y ON y.conv_id = sc.conv_id AND y.turn = sc.turn),
br AS (SELECT conv_id, turn, entity, tag, intent, value_years, scope, unnest(CASE WHEN branched THEN value_years ELSE [NULL] END) AS report_year FROM u),
requests AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY entity, report_year NULLS FIRST, tag NULLS FIRST, scope NULLS FIRST) AS nth, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM br)"""


def requests(spark, sf):
    """One row for each request of a question that is answered: entity x report branch x measure x scope, numbered; n: how many there are."""
    rows = asked(spark, sf).withColumn("intent", P.INTENT.column()).filter(first(P.BEHAVIOUR, "answer").column() == "answer")
    nothing = F.array(F.lit(None).cast("string"))
    wide = F.when((F.size("tags") == 0) | F.col("intent").isin("explain", "reconcile"), nothing).otherwise(F.col("tags"))
    rows = rows.select("conv_id", "turn", "s", "intent", F.explode(wide).alias("tag"), F.slice(F.split(FOCUS.column(), "\\|"), 2, 1_000_000).alias("parts"))
    focus = F.col("s")
    for tag, pattern in P.MENTIONS.items():
        near = F.filter("parts", lambda z, p=pattern: z.rlike(f"^(?:{p})"))
        focus = F.when((F.col("tag") == tag) & (F.size(near) > 0), F.array_join(near, " ")).otherwise(focus)
    rows = rows.withColumn("focus", focus)
    kept, with_all = F.array(F.lit("continuing")), F.array(F.lit("including_discontinued"))
    scopes = (
        F.when(F.col("tag").isNull() | ~F.col("tag").isin(*P.MENTIONS), nothing)
        .when(F.contains("focus", F.lit("continuing operations")) & F.contains("focus", F.lit("including discontinued")) & F.col("focus").rlike("both|two scopes"), F.concat(kept, with_all))
        .when(F.col("focus").rlike("including discontinued|after discontinued"), with_all)
        .when(F.contains("focus", F.lit("continuing operations")), kept)
        .when(F.contains("s", F.lit("entire")) & F.contains("s", F.lit("group")) & (F.col("tag") == "statutory_npat"), with_all)
        .otherwise(nothing)
    )
    rows = rows.select("conv_id", "turn", "s", "intent", "tag", F.explode(scopes).alias("scope")).join(bound_years(spark, sf).select("conv_id", "turn", "entity", "value_years"), ["conv_id", "turn"])
    branch = F.when(F.contains("s", F.lit("original")) & (F.size("value_years") > 1), F.col("value_years")).otherwise(nothing)
    rows = rows.withColumn("report_year", F.explode(branch))
    order = [F.asc("entity"), F.asc_nulls_first("report_year"), F.asc_nulls_first("tag"), F.asc_nulls_first("scope")]
    q = Window.partitionBy("conv_id", "turn")
    return rows.withColumn("nth", F.row_number().over(q.orderBy(*order))).withColumn("n", F.count("*").over(q))


@query("request_list", REQUESTS_SQL + " SELECT conv_id, turn, nth, entity, tag, scope, intent, report_year, array_to_string(value_years, ',') AS value_years, n <= 12 AS accepted FROM requests")
def request_list(spark, sf):
    """The requests of each question; one with more than twelve is asked to be split, none is cut silently."""
    return requests(spark, sf).select("conv_id", "turn", F.col("nth").cast("long").alias("nth"), "entity", "tag", "scope", "intent", "report_year", F.array_join("value_years", ",").alias("value_years"), (F.col("n") <= 12).alias("accepted"))


@query("request_cross_product", NORM + """,
q AS (SELECT conv_id, turn, unnest(tags) AS tag FROM t),
x AS (SELECT conv_id, turn, tag, n_name AS entity, row_number() OVER (PARTITION BY conv_id, turn ORDER BY tag, n_name) AS nth FROM q CROSS JOIN nation)
SELECT conv_id, turn, tag, entity, nth <= 12 AS accepted FROM x""")
def request_cross_product(spark, sf):
    """Every metric asked for, for every entity; beyond twelve requests a question is told so, not cut silently."""
    names = read(spark, sf, "nation").agg(F.array_sort(F.collect_list("n_name")).alias("names"))  # one row: the list of entities
    rows = asked(spark, sf).select("conv_id", "turn", F.explode("tags").alias("tag")).crossJoin(F.broadcast(names)).select("conv_id", "turn", "tag", F.explode("names").alias("entity"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("tag", "entity"))
    return rows.withColumn("nth", nth).select("conv_id", "turn", "tag", "entity", (F.col("nth") <= 12).alias("accepted"))


# routes ------------------------------------------------------------------------------------------------------------

#: The patterns by which a question's route is told, in this section and in the rewriting below.
KNOWN = size("tags", ">", 0) | has("\\b(?:profit|npat|earnings|net income)\\b")
CONCEPTUAL = ~size("years", ">", 1) & ~has("\\b(?:calculate|by how much|how much|percentage change|grew|growth|increased|decreased)\\b") & has("^(?:define\\b|what (?:does|do)\\b.*mean|what is meant\\b|(?:does|do)\\b.{0,160}\\b(?:mean|refer to|represent)\\b|(?:what is|what s|explain) (?:the )?(?:difference|distinction)\\b|(?:is|are)\\b.*(?:same as|equivalent|same thing)|how (?:does|do)\\b.*differ)|\\bdefinition of\\b")
DEFINITION = CONCEPTUAL | has("\\bdefin(?:e|ition)\\b|\\bmeaning\\b|\\bstands? for\\b|\\bwhat\\b.*\\bmean\\b") | (KNOWN & has("^what (?:is|are)\\b") & ~has("\\b(?:fy ?)?20[0-9]{2}\\b|\\b(?:cba|nab|commonwealth|national australia)\\b") & ~has("\\b(?:change|growth|amount|value|figure|total)\\b"))
NARRATIVE_WORDS = has("\\b(?:why|mean[a-z]*|defin[a-z]*|explain[a-z]*|reason[a-z]*|driv[a-z]*|factor[a-z]*|cause[a-z]*|prove[a-z]*|telling|imply|indicate|suggest|contribut[a-z]*|better|best|good|bad|enough|healthy|sustainable|same|equivalent|distinction|summari[a-z]*|summary|overview|strategy|outlook|reconcil[a-z]*)\\b")
HOW = has("\\bhow\\b") & ~has("\\bhow (?:much|many|far)\\b|\\b(?:change[a-z]*|grow[a-z]*|grew|rise|rose|increase[a-z]*|decrease[a-z]*|fall|fell|mov[a-z]*)\\b")
NUMERIC = KNOWN & ~DEFINITION & ~NARRATIVE_WORDS & ~HOW
SUBJECTS = [("operating_expenses", has("\\boperating (?:expenses?|costs?)\\b")), ("impairment", has("\\b(?:credit impairment|loan impairment|credit loss) (?:charges?|expenses?)\\b")), ("net_interest_income", has("\\bnet interest income\\b")), ("other_income", has("\\bother operating income\\b")), ("staff", has("\\b(?:staff|personnel) (?:expenses?|costs?)\\b")), ("technology", has("\\b(?:information technology|it|technology)(?: services?)? (?:expenses?|costs?)\\b"))]
WHY = has("\\bwhy\\b|\\breasons?\\b|\\bdrivers?\\b|\\bfactors?\\b|\\bexplain\\b")
SUBJECT_LIST = every([(n, t & WHY) for n, t in SUBJECTS])
plan_query("route_predicates", "Which route a question may take.", numeric=flag(NUMERIC), definition=flag(DEFINITION), known_measure=flag(KNOWN), explained_subjects=SUBJECT_LIST, whole_loans=flag(has("^(?:what (?:was|were|is|are) )?(?:cba|nab)(?: s)? total loans(?: (?:at the end of|at the end|in|for|as at) (?:the )?(?:fy ?)?20[0-9]{2})?$")))

FUTURE = has("\\bwill\\b.*\\b(?:profit|earnings|earn|pay|dividend|be)\\b", "nowill") | has("\\b(?:predict[a-z]*|forecast[a-z]*|projected|expected|next year|future)\\b")
NOWILL = changed("s", ("\\bwill you\\b", "you"))


@query("reporting_limit", f"{NORM}, w AS (SELECT *, {NOWILL.sql} AS nowill FROM t) SELECT conv_id, turn, CASE WHEN {FUTURE.sql} THEN 'prediction' WHEN {P.OUTSIDE.sql} THEN 'outside_years' END AS reporting_limit FROM w")
def reporting_limit(spark, sf):
    """Why a period cannot be reported: a prediction, which a polite `will you` is not, or a year outside the reports."""
    rows = asked(spark, sf).withColumn("nowill", NOWILL.column())
    return rows.select("conv_id", "turn", F.when(FUTURE.column(), "prediction").when(P.OUTSIDE.column(), "outside_years").alias("reporting_limit"))


#: Measures that are named and not supported, with the reason.
EXCLUSIONS = P.GUARDS[4:]
plan_query("excluded_terms", "Unsupported terms of a question, all of them; whether it is conceptual; and whether it names both entities.", excluded=every(EXCLUSIONS), conceptual=flag(CONCEPTUAL), cross_entity=flag(size("entities", "=", 2)))
STATEMENT = has("\\b(?:income statements?|statements? of (?:profit (?:or|and) loss|comprehensive income))\\b")
BASIS = anyof([among(n) for n in ("operating_income", "operating_expenses", "credit_impairment", "nim")])
plan_query("statement_basis", "Whether a named accounting statement fixes the basis of a measure.", basis=first([("mixed_basis", STATEMENT & has("\\bcash\\b|\\badjusted\\b|\\bunderlying\\b")), ("one_at_a_time", STATEMENT & BASIS & size("tags", ">", 1)), ("statutory", STATEMENT & BASIS)]))

#: Broad topics by their words.
INVEST = has("\\binvest(?:ing|ment|ments|ed|s)?\\b|\\bput(?:ting)? (?:more )?money\\b")
STRATEGY = has("\\bstrateg(?:y|ies|ic)\\b|\\bpriorit(?:y|ies|ise|ize|ising|izing)\\b|\\bfocus(?:ed|ing)?\\b|\\binitiatives?\\b")
SPENDING = has("\\bspend(?:ing|s)?\\b|\\bown (?:business|operations|investment)\\b|\\btechnology\\b|\\bdigital\\b|\\bartificial intelligence\\b|\\bai\\b|\\bcyber[a-z0-9]*\\b")
LENDING = has("\\blend(?:ing|s)?\\b|\\bloans?\\b|\\bfinanc(?:ing|e)\\b|\\bcredit exposure\\b")
SECTOR, PORTFOLIO = has("\\bsectors?\\b|\\bindustr(?:y|ies)\\b"), has("\\bcategor(?:y|ies)\\b|\\btypes?\\b|\\bwhere\\b|\\bportfolio\\b")
GENERAL = has("\\brisks?\\b|\\bchallenges?\\b|\\bopportunities\\b|\\boutlook\\b|\\bsustainab[a-z]*\\b|\\bscams?\\b|\\bfraud\\b|\\bprivacy\\b|\\bfinancial crime\\b")
PERFORMANCE = has("\\bfinancial performance\\b|\\b(?:financial|earnings|results?) (?:highlights?|overview|summary)\\b|\\b(?:major|key|notable|significant|important) (?:financial )?(?:changes?|results?|developments?)\\b|\\bhow (?:did|has|have)\\b.{0,65}\\bperform(?:ed)?\\b|\\b(?:overview|summary|summarise|summarize|review)\\b.{0,65}\\b(?:results|performance|earnings)\\b") & size("tags", "=", 0)
NARRATIVE = INVEST | STRATEGY | SPENDING | (LENDING & SECTOR) | (LENDING & size("tags", "=", 0) & PORTFOLIO) | GENERAL | PERFORMANCE
TOPICS = first([("none", ~NARRATIVE), ("performance", PERFORMANCE), ("spending+lending", INVEST & ~(SPENDING | LENDING | STRATEGY)), ("general", LENDING & ~SPENDING & has("\\bimpairment\\b|\\bcredit losses\\b|\\barrears\\b|\\bdelinquen[a-z]*\\b")), ("lending", LENDING & ~SPENDING), ("spending", SPENDING), ("general", GENERAL)], "strategy")
plan_query("narrative_topics", "The topics of a broad question, whether it compares, and whether it asks for an amount.", topics=TOPICS, comparative=flag(has("\\bmore\\b|\\bmost\\b|\\blargest\\b|\\bbiggest\\b|\\brank(?:ing)?\\b|\\bhigher\\b|\\bincreas[a-z]*\\b|\\bgrew\\b|\\bgrowth\\b|\\bcompar[a-z]*\\b")), amount=flag(has("\\bhow much\\b|\\bamounts?\\b|\\bcalculate\\b|\\bpercent(?:age)?\\b|\\bby how much\\b|\\bfigures?\\b")), technology_costs=flag(has("\\binformation technology\\b|\\btechnology (?:services? )?(?:expenses?|costs?|bill)\\b|\\bit (?:services? )?(?:expenses?|costs?|bill)\\b")))

REASONING = has("\\bwhy\\b|\\bexplain\\b|\\breasons?\\b|\\bdrivers?\\b|what (?:factors|drove|caused)|what\\b.*\\bmean\\b|\\bhow (?:did|has|have|does)\\b|\\bdid\\b.*\\b(?:reduce|cut|lower|invest|spend|prioritise|prioritize|focus)\\b|\\bwhat (?:is|are|was|were)\\b.*\\bdoing\\b")
PREMISE = has("\\b(?:did|was|were|has|have|does)\\b.*\\b(?:fall|fell|fallen|rise|rose|risen|drop|dropped|declin[a-z]*|grow|grew|grown|increas[a-z]*|decreas[a-z]*|reduc[a-z]*|cut|lower[a-z]*|rais[a-z]*|chang[a-z]*|higher|improv[a-z]*)\\b")
plan_query(
    "tool_choice",
    "Which of the bounded tools a question goes to; rules stand in for a model's choice, whose fallback is the existing route.",
    tool=first([("refuse", anyof([t for _, t in P.GUARDS])), ("define", DEFINITION), ("numeric", NUMERIC), ("narrative", NARRATIVE), ("reason", REASONING), ("check_premise", PREMISE)], "existing"),
    table_allowed=flag(~WHY & has("\\binvest[a-z]*\\b|\\bspend[a-z]*\\b") & ~has("\\bforecast[a-z]*\\b|\\bwill\\b")),
)
plan_query("reasoning_premise", "Whether a question asks for reasons, or whether it assumes a direction.", reasoning=flag(REASONING & ~NUMERIC), premise=flag(PREMISE), narrative=flag(has("\\bwhy\\b|\\bexplain\\b|\\bdefine\\b|\\bdefinition\\b|what (?:factors|drove|caused|does.*mean)")))
plan_query("early_guards", "The older guards: operations that a plain lookup cannot do, and whether it is a direct lookup.", unsupported=first([("ordered_arithmetic", has("\\bminus\\b|\\bsubtract\\b|\\bdivided by\\b|\\bratio of\\b|\\bsum of\\b|\\bmultipl(?:y|ied)\\b|\\bcagr\\b|\\bannuali[sz]ed\\b", "low")), ("conversion", has("\\bconvert\\b|\\busd\\b|\\bus dollars\\b|\\bnzd\\b", "low")), ("ranking", has("\\bwhich (?:bank|company).*(?:higher|larger|bigger|better)|\\brank\\b", "low"))]), direct_lookup=flag(has("^(?:what (?:was|were|is|are)|how much)\\b") & KNOWN))

# rewriting ---------------------------------------------------------------------------------------------------------

#: Spelling repairs; nothing else is corrected.
SPELLING = {"proift": "profit", "proft": "profit", "profitt": "profit", "statutroy": "statutory", "statutry": "statutory", "earings": "earnings", "intrest": "interest", "divident": "dividend", "cusotmer": "customer", "depostis": "deposits"}
REPAIRS = [*[(f"(?i)\\b{wrong}\\b", right) for wrong, right in SPELLING.items()], ("(?i)\\bcommbank\\b", "CBA"), ("(?i)\\bFY *([0-9]{2})\\b", "FY20$1"), ("(?i)\\bwhat'?s\\b", "what is"), ("(?i)^ *(?:(?:hey|hi)[, ]+)?(?:please +)?(?:(?:can|could|would) you +)?(?:please +)?(tell|show|give|list|what|how|compare|calculate|explain|define)\\b", "$1"), ("(?i)\\bhow much money (?:did|does|has) (CBA|NAB) (?:make|made|earn|earned)\\b", "What was $1 profit"), ("(?i)\\bpay shareholders per share\\b", "report as dividend per share"), ("(?i)\\bdividend did (CBA|NAB) pay per share\\b", "$1 dividend per share")]
REWRITTEN = changed("a", *REPAIRS)
REPAIRED = every([(f"r{i}", has(p, "a")) for i, (p, _) in enumerate(REPAIRS)])
MOVED = has("\\b(?:grow|grew|growth|rise|rose|fall|fell|increase|decrease|move|moved|change|compare)\\b")
PRIOR = size("years", "=", 1) & has("2025") & KNOWN & MOVED & ~has("\\b(?:why|explain|reason|driver|factor|mean|define|forecast|predict|will)[a-z]*\\b") & ~has("\\b(?:quarter|half year|six months|calendar|monthly|signed|subtract|minus)\\b")
plan_query("query_rewrite", "A question with spelling, aliases, short years and politeness put right, the repairs made, and whether the year before is implied.", rewritten=REWRITTEN, repairs=REPAIRED, prior_year_implied=flag(PRIOR))

FOCUSED = changed("a", ("(?i)\\b(?:Commonwealth Bank(?: of Australia)?|National Australia Bank|CBA|NAB)(?:'s)?\\b", " "), ("(?i)\\b(?:FY *)?20[0-9]{2}\\b", " "), ("(?i)\\b(?:original(?:ly)?|published|report|reports|disclosures|financial year)\\b", " "), ("(?i)Give the source and unit[.]?|Include the unit and reporting basis[.]?", " "), ("[ \\t\\n\\r\\f\\x0B]+", " "), ("^ | $", ""))
plan_query("semantic_focus", "A question without entities, years and words about the report: what is left to match against concepts.", focus=FOCUSED)

#: Other names of measures, brought to one.
CANON = [("(?i)\\b(?:NPAT|net profit(?: after tax)?) +on (?:a |the )?cash basis\\b", "cash profit"), ("(?i)\\b(?:NPAT|net profit(?: after tax)?) +on (?:a |the )?statutory basis\\b", "statutory net profit after tax"), ("(?i)\\bcash +(?:NPAT|net profit(?: after tax)?|profit)\\b", "cash profit"), ("(?i)\\bstatutory +(?:NPAT|net profit(?: after tax)?|profit|earnings)", "statutory net profit after tax"), ("(?i)\\b(?:basic cash (?:earnings per share|EPS)|cash basic (?:earnings per share|EPS))\\b", "basic cash EPS"), ("(?i)\\b(?:revenue|operating revenue|net operating income|total operating income)\\b", "total operating income"), ("(?i)\\b(?:costs of running the bank|operating costs)\\b", "operating expenses"), ("(?i)\\b(?:loan.loss expense|credit.loss charge)\\b", "credit impairment charge"), ("(?i)\\b(?:total lending outstanding|total loans and acceptances)\\b", "gross loans and acceptances"), ("(?i)\\b(?:money deposited by customers|deposits from customers)\\b", "customer deposits"), ("(?i)\\b(?:all group assets|balance.sheet total of assets)\\b", "total assets"), ("(?i),? +(?:rather than|instead of|not) +(?:a |the )?(?:single[ -]day(?:'s)?|daily)\\b[^.!?]*[.!?]? *$", "")]
FLOWS = has("cash flows?|cash accounting|cash (?:that )?(?:flowed|flowing|coming|comes|came) (?:in|into)") & among("cash_profit") & ~has("calculate|subtract|minus|quantify|work out|by how much")
plan_query("alias_canonical", "A question with measures under one name and negated targets gone, and how its concept is read.", canonical=changed("a", *CANON), reading=first([("cash_flow_contrast", FLOWS), ("reporting_basis", has("statutory") & has("accounting standards|reporting basis"))]))


@query("mixed_route_split", f"""{NORM}, m AS (SELECT *, regexp_extract(low, '^(.*?),? and (why|explain|what (?:factors|drove|caused))\\b(.*)$', ['numeric_part', 'cue', 'rest']) AS x FROM t)
SELECT conv_id, turn, x.numeric_part AS numeric_part, trim(x.cue || x.rest) AS narrative_part FROM m WHERE x.numeric_part <> ''""")
def mixed_route_split(spark, sf):
    """A figure asked for together with its reasons, as two questions."""
    form = "^(.*?),? and (why|explain|what (?:factors|drove|caused))\\b(.*)$"
    part = lambda i: F.regexp_extract("low", form, i)
    rows = asked(spark, sf).withColumn("numeric_part", part(1)).filter("numeric_part <> ''")
    return rows.select("conv_id", "turn", "numeric_part", F.btrim(F.concat(part(2), part(3))).alias("narrative_part"))


@query("supported_remainder", f"""{NORM}, x AS (SELECT *, regexp_replace(s, '{"|".join(["net interest income", "(?:interim|final) dividend", "(?:diluted|statutory) (?:eps|earnings per share)", "effective tax rate"])}', '', 'g') AS left_over FROM t)
SELECT conv_id, turn, CASE WHEN left_over <> s AND regexp_matches(s, '\\band\\b') AND len(entities) = 1 AND len(years) = 1 AND NOT regexp_matches(s, '\\b(?:compare|difference|change|growth|why|ratio|minus|plus|sum|divided?|subtract|calculate|explain|versus|vs)\\b')
  THEN trim(regexp_replace(regexp_replace(left_over, '\\band (in|for|fy)\\b', '\\1', 'g'), ' +', ' ', 'g')) END AS remainder FROM x""")
def supported_remainder(spark, sf):
    """What is left of a plain list when its unsupported members are blanked out; calculations and prose are never cut."""
    left = F.regexp_replace("s", "net interest income|(?:interim|final) dividend|(?:diluted|statutory) (?:eps|earnings per share)|effective tax rate", "")
    plain = F.col("s").rlike("\\band\\b") & (F.size("entities") == 1) & (F.size("years") == 1) & ~F.col("s").rlike("\\b(?:compare|difference|change|growth|why|ratio|minus|plus|sum|divided?|subtract|calculate|explain|versus|vs)\\b")
    tidy = F.btrim(F.regexp_replace(F.regexp_replace(left, "\\band (in|for|fy)\\b", "$1"), " +", " "))
    return asked(spark, sf).select("conv_id", "turn", F.when((left != F.col("s")) & plain, tidy).alias("remainder"))


@query("scope_resolution", NORM + """ SELECT conv_id, turn, CASE WHEN len(years) > 0 THEN array_to_string(years, ',') ELSE '2025' END AS year, CASE WHEN len(years) > 0 THEN 'named' ELSE 'filter' END AS origin,
  CASE WHEN len(entities) > 0 THEN array_to_string(entities, ',') ELSE 'CBA' END AS entity, CASE WHEN len(entities) > 0 THEN 'named' ELSE 'filter' END AS entity_origin FROM t""")
def scope_resolution(spark, sf):
    """Years and entities named in the question win over the filter's."""
    pick = lambda c, default: (F.when(F.size(c) > 0, F.array_join(c, ",")).otherwise(default), F.when(F.size(c) > 0, "named").otherwise("filter"))
    year, entity = pick("years", "2025"), pick("entities", "CBA")
    return asked(spark, sf).select("conv_id", "turn", year[0].alias("year"), year[1].alias("origin"), entity[0].alias("entity"), entity[1].alias("entity_origin"))


# answers over parts ------------------------------------------------------------------------------------------------


@query("answer_status", """
WITH c AS (SELECT o_custkey, count(*) AS parts, count(*) FILTER (o_orderstatus = 'F') AS claims, count(*) FILTER (o_totalprice < 0) AS issues FROM orders GROUP BY o_custkey)
SELECT o_custkey, parts, CASE WHEN parts > 0 AND claims = parts AND issues = 0 THEN 'source_bound_answer' WHEN claims > 0 THEN 'partial_answer' ELSE 'unable_to_verify' END AS status FROM c""")
def answer_status(spark, sf):
    """Parts with and without claims make the status of an answer; orders stand for parts, filled ones for claims."""
    rows = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("parts"), F.count_if(F.col("o_orderstatus") == "F").alias("claims"), F.count_if(F.col("o_totalprice") < 0).alias("issues"))
    return rows.select("o_custkey", "parts", P.status(F.col("parts"), F.col("claims"), F.col("issues")).alias("status"))


@query("citations_first", """SELECT user_id, event_type, min(event_id) AS event_id, count(DISTINCT round(value, 2)) AS quotes, CASE event_type WHEN 'purchase' THEN 'checked' WHEN 'click' THEN 'pending' ELSE 'unknown' END AS label FROM events GROUP BY ALL""")
def citations_first(spark, sf):
    """Citations of one place as one: the first wins, its distinct quotes are counted, and its status has a label or the default."""
    label = F.when(F.col("event_type") == "purchase", "checked").when(F.col("event_type") == "click", "pending").otherwise("unknown")
    rows = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count_distinct(F.round("value", 2)).alias("quotes"))
    return rows.withColumn("label", label)


@query("excerpt_render", "SELECT conv_id, md5(string_agg(role || ': ' || left(text, 200), chr(10) ORDER BY turn)) AS rendered FROM conversations GROUP BY conv_id")
def excerpt_render(spark, sf):
    line = F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, 200))
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return rows.select("conv_id", F.md5(F.array_join("l.line", "\n")).alias("rendered"))


FOLLOW_UP = """
WITH u AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN length(text) < 60 AND previous IS NOT NULL THEN previous || ' ' || text ELSE text END AS resolved FROM u"""


@query("followup_stream", FOLLOW_UP)
def followup_stream(spark, sf):
    """Follow-ups resolved over a stream of conversations, with state by conversation; run to its end."""
    from quarry.streaming.followup import resolve_all

    return resolve_all(spark, f"{sf}/conversations.parquet")


def _round_trip_sql() -> str:
    from quarry.catalog.registry import ORACLES

    return f"SELECT CAST(query AS VARCHAR) AS query, CAST(id AS VARCHAR) AS id, rank, round(1.0 / rank, 9) AS score, 'quarry' AS tag FROM ({ORACLES['bm25_topk']})"


@query("trec_roundtrip", _round_trip_sql())
def trec_roundtrip(spark, sf):
    """A run written to files in six-field form and read back."""
    from quarry.catalog.retrieval import bm25_topk
    from quarry.scratch import fresh_path
    from quarry.sources import trec

    path = fresh_path(spark, "run")
    trec.write_run(bm25_topk(spark, sf), path, "quarry")
    return trec.read_run(spark, path)

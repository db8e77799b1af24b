"""Question planning as ordered rules: intent, measures, guards, operations, scopes. Fixed values are rules on normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import ascii_words
from quarry.plans.rules import Test, among, anyof, changed, every, first, flag, found, has, size

#: Entities with the names they go by.
ENTITIES = [("CBA", "\\b(?:cba|commonwealth bank(?: of australia)?)\\b"), ("NAB", "\\b(?:nab|national australia bank)\\b")]
#: Intents in the order in which they are tried, on text without negated restatements.
INTENTS = [
    ("define", "\\bdefin|meaning|glossary|stand for|what does .* mean"),
    ("reconcile", "reconcil|\\bbridge\\b|non cash adjustments|reclassif|restat|moved between|different.*comparative|comparative.*different|original.*comparative"),
    ("explain", "\\bwhy\\b|\\breasons?\\b|what (?:made|drove|caused)|factors|drivers|explain|influenc|affect|squeez|pressure.*attribute"),
    ("summary", "summary|summari|snapshot|roundup|\\bbrief\\b"),
    ("compare", "compar|change|growth|grew|improv|worsen|\\bmove|versus|\\bvs\\b"),
]
#: Measures by pattern. `e` is the normalised text in which cash earnings per share are no cash earnings.
TAGS = [
    ("basic_cash_eps", has("earnings per share|\\beps\\b") | has("earnings.*(?:each|per|ordinary).*share|per.share earnings|before dilution")),
    ("dividend_per_share", has("dividend.*per share|\\bdps\\b|annual dividend|full year dividend") | has("(?:ordinary|annual|whole year|full year).*dividend|dividend.*(?:share|whole year|full year)")),
    ("nim", has("net interest margin|\\bnim\\b")),
    ("gross_loans", has("gross loans|loans and acceptances|\\bglas\\b")),
    ("customer_deposits", has("customer deposits|customer funding")),
    ("total_assets", has("total assets|balance sheet assets") | has("total (?:group |consolidated |bank )?assets|total asset balance")),
    ("cet1", has("\\bcet ?1\\b|common equity tier (?:1|one)")),
    ("lcr", has("liquidity coverage|\\blcr\\b")),
    ("operating_income", has("(?:total|net) operating income|operating revenue") | has("(?:total|net) (?:operating )?income")),
    ("operating_expenses", has("operating expenses|operating costs")),
    ("credit_impairment", has("(?:credit|loan) impairment|impairment (?:charge|expense)")),
    ("cash_profit", has("cash (?:profit|net profit)|net profit.*cash basis") | has("cash earnings", "e")),
    ("statutory_npat", has("statutory.*(?:profit|npat)|(?:profit|npat).*statutory|net profit attributable")),
]
#: Earnings per share are no aggregate profit unless that is named as well.
PER_SHARE_ONLY = TAGS[0][1] & ~has("cash profit|(?:total|aggregate) cash earnings|statutory")
MEASURES = [(n, t & ~PER_SHARE_ONLY if n == "cash_profit" else t) for n, t in TAGS]
LABELS = {"statutory_npat": "statutory net profit attributable to owners", "cash_profit": "cash profit cash earnings", "basic_cash_eps": "basic cash earnings per share", "dividend_per_share": "dividend per share", "gross_loans": "gross loans and acceptances", "customer_deposits": "customer deposits", "total_assets": "total assets", "cet1": "common equity tier 1 capital ratio CET1", "lcr": "liquidity coverage ratio", "nim": "net interest margin", "operating_income": "total net operating income", "operating_expenses": "operating expenses", "credit_impairment": "credit loan impairment charge"}
PROFIT = has("\\b(?:profit|npat|earnings)\\b")
#: Guards in order, with the reason that each gives.
GUARDS = [
    ("discontinued_only", PROFIT & has("\\b(?:discontinued operations only|only (?:the )?discontinued operations|from (?:the )?discontinued operations)\\b")),
    ("outside_corpus", has("\\b(?:westpac|anz|bhp|tesla)\\b")),
    ("cross_company", has("\\b(?:cba|commbank|commonwealth(?: bank)?)\\b") & has("\\b(?:nab|national australia(?: bank)?)\\b")),
    ("segment_lending", has("\\b(?:housing|home|mortgage)\\b") & has("\\b(?:loans?|lending)\\b")),
    ("market_price", has("\\b(?:share|stock) price\\b|market cap")),
    ("lending_segment", has("\\b(?:housing|home|mortgage|business|personal) (?:loans?|lending)\\b")),
    ("impairment_component", has("\\b(?:individually|collectively) assessed\\b")),
    ("interest_income", has("\\bnet interest income\\b")),
    ("other_profit", has("\\b(?:profit before|pre tax profit|profit margin|gross profit|operating profit|ebitda|ebit)\\b")),
    ("other_balance", has("\\b(?:capitalised|capitalized) software\\b|effective tax rate|cash and cash equivalents")),
    ("other_eps", has("\\b(?:diluted|statutory) (?:eps|earnings per share)\\b")),
    ("dividend_instalment", has("\\b(?:interim|final) dividend\\b")),
    ("dividends_paid", has("dividends? paid|pay in dividends|total dividend (?:payments|paid)")),
    ("other_basis", has("risk weighted assets|average (?:total )?assets|net loans|loan loss (?:allowance|provision)")),
]
#: What a plan does before it answers.
OUTSIDE = has("\\b(?:19[0-9]{2}|20(?:[013-9][0-9]|2[0-36-9]))\\b")
AMBIGUOUS = has("\\bprofit\\b") & ~has("cash|statutory|net profit|operating profit|reconcil|difference|both")
NO_ENTITY = ~has("|".join(p for _, p in ENTITIES) + "|commonwealth")
BEHAVIOUR = [
    ("abstain:outside_corpus", has("\\b(?:anz|westpac|bhp|tesla)\\b")),
    ("abstain:personal", has("\\bmy\\b.*\\b(?:account|balance|savings|loan)\\b")),
    ("abstain:year", OUTSIDE),
    ("abstain:future", has("predict|forecast.*profit|next year.*profit|will.*profit")),
    ("clarify:basis", AMBIGUOUS & ~anyof([has(INTENTS[0][1], "r"), has(INTENTS[1][1], "r")])),
    ("clarify:entity", NO_ENTITY & ~has(INTENTS[0][1], "r")),
]
#: Arithmetic.
REQUESTED = has("calculate|quantify|work out|by how much|how much.*(?:grew|grow|rise|rose|fell|fall|increase|decrease)|how far|difference|movement|change|increase in|minus|subtract|less the", "low")
PROSE = has("^ *(?:why|explain)|what (?:made|factors|caused)", "low") & ~has("calculate|quantify|work out", "low")
ASKED = REQUESTED & ~PROSE
BOTH_PROFITS = among("cash_profit") & among("statutory_npat") & size("years", "=", 1)
SUBTRACTION = has("\\bminus\\b|\\bsubtract\\b|\\bless\\b", "low")
ORDERED = has("20[0-9]{2}.*\\b(?:minus|less)\\b.*20[0-9]{2}|subtract .*20[0-9]{2}.* from .*20[0-9]{2}", "low")
LATER_FIRST, EARLIER_FIRST = has("(?:later|newer).*\\b(?:minus|less)\\b.*(?:earlier|older)", "low"), has("(?:earlier|older).*\\b(?:minus|less)\\b.*(?:later|newer)", "low")
STATUTORY_FIRST, CASH_FIRST = has("statutory.*(?:minus|less|exceeds).*cash", "low"), has("cash.*(?:minus|less|exceeds).*statutory", "low")
OPERATIONS = [
    ("unsupported", has("\\bdivided by\\b|\\bratio of\\b|\\bsum of\\b|\\bmultipl(?:y|ied)\\b|\\bcagr\\b|\\bannualis?ed\\b", "low")),
    ("unsupported", has("\\bconvert\\b|\\busd\\b|\\bus dollars\\b|\\bnzd\\b", "low")),
    ("unsupported", has("\\bwhich (?:bank|company).*(?:higher|larger|bigger|better)|\\brank\\b", "low")),
    ("profit_gap", ASKED & BOTH_PROFITS & (STATUTORY_FIRST | CASH_FIRST)),
    ("unsupported", ASKED & BOTH_PROFITS),
    ("unsupported", SUBTRACTION & size("tags", ">", 1)),
    ("year_difference", SUBTRACTION & (ORDERED | LATER_FIRST | EARLIER_FIRST)),
    ("unsupported", SUBTRACTION),
    ("change", ASKED),
]
ORDERS = [
    ("statutory_npat,cash_profit", ASKED & BOTH_PROFITS & STATUTORY_FIRST),
    ("cash_profit,statutory_npat", ASKED & BOTH_PROFITS & CASH_FIRST),
    ("named_years", SUBTRACTION & ~size("tags", ">", 1) & ORDERED),
    ("later_first", SUBTRACTION & ~size("tags", ">", 1) & LATER_FIRST),
    ("earlier_first", SUBTRACTION & ~size("tags", ">", 1) & EARLIER_FIRST),
]
RELATIVE = has("percent(?:age)? (?:change|growth|increase)|growth (?:rate|percent)|percentage", "low") & ~has("not (?:a )?percent|no percent", "low")
MAGNITUDE = ~has("signed (?:change|values|deductions)|source.signed|preserve.*sign", "low")
#: Where a measure is mentioned, for the scope that stands near it.
MENTIONS = {"cash_profit": "cash (?:profit|earnings)", "statutory_npat": "statutory (?:profit|net profit)|statutory accounts", "basic_cash_eps": "(?:basic )?cash eps|earnings per share"}
#: Periods that are no financial year of an entity, in order.
PART_YEAR = has("half year|halfyear|\\bh ?[12]\\b|six months|interim|\\bq ?[1-4]\\b")
MONTH = "\\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\b"
YEAR_END = {"CBA": "jun", "NAB": "sep"}


def other_month(entity: str) -> Test:
    """A month that does not end the entity's financial year."""
    months = [m for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec") if m != YEAR_END[entity]]
    longer = {"jan": "uary", "feb": "ruary", "mar": "ch", "apr": "il", "jun": "e", "jul": "y", "aug": "ust", "sep": "tember", "oct": "ober", "nov": "ember", "dec": "ember"}
    return has("\\b(?:" + "|".join(f"{m}(?:{longer[m]})?" if m in longer else m for m in months) + ")\\b")


def restrictions(entity: str):
    """Why a question's period cannot be bound for the entity, if so."""
    return first([("part_year", PART_YEAR), ("other_month", other_month(entity)), ("other_day", has("\\b(?:[0-24-9]|[0-2][0-9]|3[1-9]) (?:jun(?:e)?|sep(?:tember)?)\\b"))])


def first_match(text: Column, rules, default: str | None) -> Column:
    out = F.lit(default).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(ascii_words(pattern)), name).otherwise(out)
    return out


def status(parts: Column, claims: Column, issues: Column) -> Column:
    """Answer status: whole when every part has claims and nothing is amiss, partial when any claim stands."""
    return F.when((parts > 0) & (claims == parts) & (issues == 0), "source_bound_answer").when(claims > 0, "partial_answer").otherwise("unable_to_verify")


#: Texts of a question beside its normalised text s: ascii as it stands, lower without hyphens, for routing, without per-share earnings.
TEXTS = {
    "a": changed("raw", ("[^\\x00-\\x7F]+", "_")),
    "r": changed("s", ("\\bnot (?:a )?(?:later )?restatement\\b", "")),
    "e": changed("s", ("cash earnings per share", "earnings per share")),
}
INTENT = first([(n, has(p, "r")) for n, p in INTENTS], "find")
YEARS = found("\\b(?:fy ?)?(20[0-9]{2})\\b", "s", 1)
TAGGED, NAMED = every(MEASURES), every([(n, has(p)) for n, p in ENTITIES])
FLAGS = {"relative_percent": flag(RELATIVE), "expense_magnitude": flag(MAGNITUDE)}

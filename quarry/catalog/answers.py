"""Answers from bound cells and ranked evidence: claims, paragraphs, contexts, routes, refusals, retrieval by request, its evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog.binding import PRINTED, SELECTED, STATUS_SQL, bound, grid, native, printed, selected, status
from quarry.catalog.evaluation import JUDGED, QTF, RUN, judged, run_of
from quarry.catalog.planning import DEFINITION, FAMILIES, NARRATIVE, NORM, NUMERIC, REASONING, REQUESTS_SQL, asked, requests
from quarry.catalog.registry import query, read
from quarry.catalog.retrieval import DENSE, RRF, aliased, bm25_sql, dense_run, documents, label_best, label_lexical, passages, qtf_best, vectors
from quarry.catalog.structure import BLOCKS, blocks, headed
from quarry.functions.text import ascii_words, bag
from quarry.operators import lexical as L
from quarry.plans import intent as P
from quarry.plans.rules import Test, first
from quarry.scratch import cut

# answers ---------------------------------------------------------------------------------------------------------------


@query("answer_paragraphs", SELECTED + f""",
ok AS (SELECT *, {STATUS_SQL} AS status FROM one),
sentence AS (SELECT company, metric, y, CASE WHEN status = 'bound' THEN metric || ' was ' || value || ' AUD million in ' || y || ' (FY' || report_year || ' report).' ELSE metric || ' in ' || y || ': ' || status || '.' END AS text, CASE WHEN status = 'bound' AND report_year <> y THEN 'Comparative from the FY' || report_year || ' report.' END AS note FROM ok)
SELECT company, string_agg(text, ' ' ORDER BY metric, y) AS body, coalesce(string_agg(DISTINCT note, ' ' ORDER BY note), '') AS notes FROM sentence GROUP BY company""")
def answer_paragraphs(spark, sf):
    """A sentence for each requested cell, what is missing said plainly, and each qualification once."""
    rows = selected(spark, sf).withColumn("status", status())
    year, report = F.col("y").cast("string"), F.col("report_year").cast("string")
    said = F.when(F.col("status") == "bound", F.concat("metric", F.lit(" was "), F.col("value").cast("string"), F.lit(" AUD million in "), year, F.lit(" (FY"), report, F.lit(" report)."))).otherwise(F.concat("metric", F.lit(" in "), year, F.lit(": "), "status", F.lit(".")))
    note = F.when((F.col("status") == "bound") & (F.col("report_year") != F.col("y")), F.concat(F.lit("Comparative from the FY"), report, F.lit(" report.")))
    per = rows.withColumn("text", said).withColumn("note", note).groupBy("company").agg(F.array_sort(F.collect_list(F.struct("metric", "y", "text")))["text"].alias("l"), F.array_sort(F.collect_set("note")).alias("n"))
    return per.select("company", F.array_join("l", " ").alias("body"), F.array_join("n", " ").alias("notes"))


@query("claim_sentences", PRINTED + """
SELECT company || ' ' || metric || ': ' || value || ' ' || unit || '; annual ending ' || period_end || ', ' || basis || ', ' || CASE scope WHEN 'continuing' THEN 'continuing operations' ELSE 'including discontinued operations' END || '.' AS claim,
  company || ':' || report_year || ':' || metric AS source_id FROM bound WHERE status = 'bound'""")
def claim_sentences(spark, sf):
    """A claim for each bound cell in fixed words, with the unit that proves it."""
    scope = F.when(F.col("scope") == "continuing", "continuing operations").otherwise("including discontinued operations")
    claim = F.concat("company", F.lit(" "), "metric", F.lit(": "), F.col("value").cast("string"), F.lit(" "), "unit", F.lit("; annual ending "), "period_end", F.lit(", "), "basis", F.lit(", "), scope, F.lit("."))
    return bound(spark, sf).filter("status = 'bound'").select(claim.alias("claim"), F.concat_ws(":", "company", F.col("report_year").cast("string"), "metric").alias("source_id"))


CONTEXT = BLOCKS + """,
child AS (SELECT page_id, pos, heading_pos, length(text) AS size FROM h WHERE tag = 'p' AND heading_pos IS NOT NULL),
parent AS (SELECT page_id, heading_pos, sum(size) AS parent_size, count(*) AS members FROM child GROUP BY ALL),
hit AS (SELECT c.*, parent_size, members, row_number() OVER (PARTITION BY page_id ORDER BY size DESC, pos) AS rn FROM child c JOIN parent USING (page_id, heading_pos)),
top AS (SELECT * FROM hit WHERE rn <= 4),
used AS (SELECT page_id, sum(size) AS direct FROM top GROUP BY page_id)"""


@query("assembled_context", CONTEXT + """
SELECT DISTINCT t.page_id, t.heading_pos, CASE WHEN direct - own + parent_size <= 3000 THEN 'parent' ELSE 'children' END AS kind, CASE WHEN direct - own + parent_size <= 3000 THEN members ELSE mine END AS pieces
FROM top t JOIN used USING (page_id) JOIN (SELECT page_id, heading_pos, sum(size) AS own, count(*) AS mine FROM top GROUP BY ALL) m ON m.page_id = t.page_id AND m.heading_pos = t.heading_pos""")
def assembled_context(spark, sf):
    """The best four hits of a page; a parent takes the place of the children that it contains where the budget still holds."""
    child = headed(spark, sf).filter("tag = 'p' and heading_pos is not null").select("page_id", "pos", "heading_pos", F.char_length("text").alias("size"))
    sections = Window.partitionBy("page_id", "heading_pos")
    ranked = child.withColumn("parent_size", F.sum("size").over(sections)).withColumn("members", F.count("*").over(sections)).withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("size"), "pos"))).filter("rn <= 4")
    per = ranked.groupBy("page_id", "heading_pos").agg(F.sum("size").alias("own"), F.count("*").alias("mine"), F.max("parent_size").alias("parent_size"), F.max("members").alias("members"))
    direct = F.sum("own").over(Window.partitionBy("page_id"))
    fits = direct - F.col("own") + F.col("parent_size") <= 3000
    return per.select("page_id", "heading_pos", F.when(fits, "parent").otherwise("children").alias("kind"), F.when(fits, F.col("members")).otherwise(F.col("mine")).alias("pieces"))


@query("expanded_context", CONTEXT + """,
by_parent AS (SELECT page_id, heading_pos, parent_size, members, min(rn) AS rn FROM hit GROUP BY ALL), seq AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rn) AS k FROM by_parent),
walk AS (WITH RECURSIVE w AS (SELECT page_id, k, CASE WHEN parent_size <= 2500 THEN parent_size ELSE 0 END AS used, CASE WHEN parent_size <= 2500 THEN 1 ELSE 0 END AS taken FROM seq WHERE k = 1
  UNION ALL SELECT s.page_id, s.k, w.used + CASE WHEN w.used + s.parent_size <= 2500 THEN s.parent_size ELSE 0 END, w.taken + CASE WHEN w.used + s.parent_size <= 2500 THEN 1 ELSE 0 END FROM w JOIN seq s ON s.page_id = w.page_id AND s.k = w.k + 1) SELECT * FROM w)
SELECT page_id, CAST(used AS BIGINT) AS used, CAST(taken AS BIGINT) AS taken, k - taken AS omitted FROM walk JOIN (SELECT page_id, max(k) AS k FROM seq GROUP BY page_id) USING (page_id, k)""")
def expanded_context(spark, sf):
    """Parents of the hits under one shared budget in hit order; those that do not fit are listed as omitted."""
    from quarry.operators import coverage as C

    child = headed(spark, sf).filter("tag = 'p' and heading_pos is not null").select("page_id", "pos", "heading_pos", F.char_length("text").cast("long").alias("size"))
    ranked = child.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("size"), "pos")))
    parents = ranked.groupBy("page_id", "heading_pos").agg(F.min("rn").alias("rank"), F.sum("size").alias("size"))
    pages = parents.groupBy("page_id").agg(F.collect_list(F.struct("rank", "size", F.col("heading_pos").alias("id"))).alias("items"))
    kept = pages.withColumn("ids", C.greedy_keep(F.col("items"), 2500))
    used = F.aggregate(F.filter("items", lambda x: F.array_contains(F.col("ids"), x["id"].cast("long"))), F.lit(0).cast("long"), lambda n, x: n + x["size"])
    return kept.select("page_id", used.alias("used"), F.size("ids").cast("long").alias("taken"), (F.size("items") - F.size("ids")).cast("long").alias("omitted"))


def _cascade():
    """The order in which a question's routes are tried; the first that applies takes it."""
    unsupported = first(P.OPERATIONS, "none")
    arithmetic = Test(lambda: unsupported.column() == "unsupported", f"({unsupported.sql} = 'unsupported')")
    rules = [*[(f"refuse:{n}", t) for n, t in P.GUARDS], *[(n, t) for n, t in P.BEHAVIOUR if n.startswith("abstain")], ("refuse:arithmetic", arithmetic), ("definition", DEFINITION), *[(n, t) for n, t in P.BEHAVIOUR if n.startswith("clarify")], ("numeric+narrative", NUMERIC & REASONING), ("numeric", NUMERIC), ("narrative", NARRATIVE), ("reasoning", REASONING)]
    return first(rules, "research")


ROUTE = _cascade()


@query("route_cascade", f"{NORM} SELECT conv_id, turn, {ROUTE.sql} AS route FROM t")
def route_cascade(spark, sf):
    """Guards, refusals, clarifications and routes in one order: some twenty steps, the first that applies decides."""
    return asked(spark, sf).select("conv_id", "turn", ROUTE.column().alias("route"))


@query("refusal_payload", f"""{NORM}, p AS (SELECT conv_id, turn, {first(P.BEHAVIOUR, 'answer').sql} AS behaviour FROM t)
SELECT conv_id, turn, split_part(behaviour, ':', 1) AS status, split_part(behaviour, ':', 2) AS reason, '{{"status":"' || split_part(behaviour, ':', 1) || '","reason":"' || split_part(behaviour, ':', 2) || '","claims":[]}}' AS payload FROM p WHERE behaviour <> 'answer'""")
def refusal_payload(spark, sf):
    """What a question gets that is not answered: a status, a reason and no claims."""
    rows = asked(spark, sf).select("conv_id", "turn", F.split(first(P.BEHAVIOUR, "answer").column(), ":").alias("b")).filter(F.get("b", F.lit(0)) != "answer")
    rows = rows.select("conv_id", "turn", F.get("b", F.lit(0)).alias("status"), F.get("b", F.lit(1)).alias("reason"))
    return rows.withColumn("payload", F.to_json(F.struct("status", "reason", F.array().cast("array<string>").alias("claims"))))


@query("evidence_cards", BLOCKS + """
SELECT page_id, 'card-' || row_number() OVER (PARTITION BY page_id ORDER BY pos) AS card, pos, strlen(text) AS bytes, md5(text) AS quote FROM b WHERE tag = 'p' AND length(text) >= 40""")
def evidence_cards(spark, sf):
    """Quotable paragraphs of a page as numbered cards."""
    rows = blocks(spark, sf).filter((F.col("tag") == "p") & (F.char_length("text") >= 40))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("string")
    return rows.select("page_id", F.concat(F.lit("card-"), nth).alias("card"), "pos", F.octet_length("text").cast("long").alias("bytes"), F.md5("text").alias("quote"))


@query("contract_answer", SELECTED + f""",
ok AS (SELECT *, {STATUS_SQL} AS status FROM one)
SELECT company, metric, count(*) FILTER (status = 'bound') AS claims, bool_or(status = 'bound' AND report_year <> y) AS comparative_disclosed, CASE WHEN count(*) FILTER (status = 'bound') = 2 AND count(DISTINCT report_year) = 1 THEN 'source_bound_answer' WHEN count(*) FILTER (status = 'bound') > 0 THEN 'partial_answer' ELSE 'unable_to_verify' END AS status FROM ok GROUP BY ALL""")
def contract_answer(spark, sf):
    """The answer to two years of a measure as its contract allows: whole only with both cells from one report, and a comparative vintage disclosed."""
    rows = selected(spark, sf).withColumn("ok", status() == "bound")
    per = rows.groupBy("company", "metric").agg(F.count_if("ok").alias("claims"), F.bool_or(F.col("ok") & F.coalesce(F.col("report_year") != F.col("y"), F.lit(False))).alias("comparative_disclosed"), F.count_distinct("report_year").alias("reports"))
    whole = F.when((F.col("claims") == 2) & (F.col("reports") == 1), "source_bound_answer").when(F.col("claims") > 0, "partial_answer").otherwise("unable_to_verify")
    return per.select("company", "metric", "claims", "comparative_disclosed", whole.alias("status"))


@query("repaired_drafts", PRINTED + """,
d AS (SELECT company, report_year, metric, header, value, CASE WHEN value % 5 = 0 THEN value + 1 ELSE value END AS first_try, CASE WHEN value % 10 = 0 THEN value + 1 ELSE value END AS second_try FROM bound WHERE status = 'bound')
SELECT company, report_year, metric, header, CASE WHEN first_try = value THEN 'accepted' WHEN second_try = value THEN 'accepted_after_repair' ELSE 'fallback' END AS outcome FROM d""")
def repaired_drafts(spark, sf):
    """Draft, check, one repair, check again, else the deterministic answer. A rule stands in for the model, and errs now and then."""
    rows = bound(spark, sf).filter("status = 'bound'")
    one, two = F.when(F.col("value") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")), F.when(F.col("value") % 10 == 0, F.col("value") + 1).otherwise(F.col("value"))
    return rows.select("company", "report_year", "metric", "header", F.when(one == F.col("value"), "accepted").when(two == F.col("value"), "accepted_after_repair").otherwise("fallback").alias("outcome"))


@query("growth_leaders", PRINTED.split(",\nprinted AS")[0] + """,
gl AS (SELECT metric, segment, value_year, value - lag(value) OVER w1 AS rise, lag(value) OVER w1 AS base FROM yearly WINDOW w1 AS (PARTITION BY metric, segment ORDER BY value_year)),
gr AS (SELECT *, CASE WHEN base > 0 THEN round(CAST(rise AS DOUBLE) / CAST(base AS DOUBLE), 9) END AS rate FROM gl WHERE rise IS NOT NULL),
gk AS (SELECT *, rank() OVER (PARTITION BY metric, value_year ORDER BY rise DESC) AS by_rise, rank() OVER (PARTITION BY metric, value_year ORDER BY rate DESC NULLS LAST) AS by_rate FROM gr)
SELECT metric, value_year, segment, by_rise = 1 AS largest_rise, by_rate = 1 AND rate IS NOT NULL AS fastest_growth FROM gk WHERE by_rise = 1 OR (by_rate = 1 AND rate IS NOT NULL)""")
def growth_leaders(spark, sf):
    """Of each measure and year, the segments with the largest absolute rise and with the fastest growth from a positive base; ties share."""
    from quarry.catalog.figures import yearly

    w, of = Window.partitionBy("metric", "segment").orderBy("value_year"), Window.partitionBy("metric", "value_year")
    rows = yearly(spark, sf).withColumn("base", F.lag("value").over(w)).withColumn("rise", F.col("value") - F.col("base")).filter("rise is not null")
    rows = rows.withColumn("rate", F.when(F.col("base") > 0, F.round(F.col("rise").cast("double") / F.col("base").cast("double"), 9)))
    rows = rows.withColumn("largest_rise", F.rank().over(of.orderBy(F.desc("rise"))) == 1).withColumn("fastest_growth", (F.rank().over(of.orderBy(F.desc_nulls_last("rate"))) == 1) & F.col("rate").isNotNull())
    return rows.filter("largest_rise or fastest_growth").select("metric", "value_year", "segment", "largest_rise", "fastest_growth")


@query("review_queue", PRINTED + """,
c AS (SELECT g.*, CASE WHEN raw = '12%' THEN 'percent' WHEN raw LIKE '(%' THEN 'negative' ELSE 'plain' END AS category, CASE WHEN raw = '12%' THEN 'not_checked' WHEN list_contains(native, whole) THEN 'on_page' ELSE 'not_on_page' END AS page_check FROM grid g JOIN page USING (company, report_year))
SELECT company, report_year, category, page_check, count(*) AS cells, CAST(count(*) FILTER (page_check = 'not_on_page') AS BIGINT) AS queued, min(CASE WHEN page_check = 'not_on_page' THEN metric || ' ' || header END) AS first_queued FROM c GROUP BY company, report_year, category, page_check""")
def review_queue(spark, sf):
    """Cells by category and page check, and what goes to review."""
    rows = cut(printed(spark, sf), "printed")
    category = F.when(F.col("raw") == "12%", "percent").when(F.col("raw").startswith("("), "negative").otherwise("plain")
    found = F.when(F.col("raw") == "12%", "not_checked").when(F.array_contains("native", F.col("whole")), "on_page").otherwise("not_on_page")
    rows = grid(rows).join(native(rows), ["company", "report_year"]).withColumn("category", category).withColumn("page_check", found)
    bad = F.col("page_check") == "not_on_page"
    return rows.groupBy("company", "report_year", "category", "page_check").agg(F.count("*").alias("cells"), F.count_if(bad).alias("queued"), F.min(F.when(bad, F.concat_ws(" ", "metric", "header"))).alias("first_queued"))


@query("conditional_summary", """
SELECT event_type, count(*) AS n, round(avg(CASE WHEN value >= 5 THEN value END), 6) AS mean_of_counted, CAST(sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS BIGINT) AS violations, round(count(*) FILTER (value >= 50)::DOUBLE / nullif(count(*) FILTER (value >= 5), 0), 6) AS share_of_counted FROM events GROUP BY event_type""")
def conditional_summary(spark, sf):
    """Means that leave nulls out, sums of violations, and shares over a conditional denominator."""
    counted = F.col("value") >= 5
    rows = read(spark, sf, "events").groupBy("event_type")
    share = F.round(F.count_if(F.col("value") >= 50) / F.nullif(F.count_if(counted), F.lit(0)), 6)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.when(counted, F.col("value"))), 6).alias("mean_of_counted"), F.count_if(F.col("value") < 1).alias("violations"), share.alias("share_of_counted"))


# retrieval by request --------------------------------------------------------------------------------------------------

@query("contrast_candidates", DENSE + """,
f AS (SELECT d.query, d.id, d.score FROM dense d JOIN documents x ON x.doc_id = d.id WHERE regexp_matches(x.text, '[0-9]') AND regexp_matches(lower(x.text), '\\b(?:and|und|et|y)\\b')),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM f) SELECT query, id, score, rank FROM r WHERE rank <= 2""")
def contrast_candidates(spark, sf):
    """Passages that match both patterns of a contrast, by dense score, the best two."""
    texts = read(spark, sf, "documents").filter(F.col("text").rlike("[0-9]") & F.lower("text").rlike(ascii_words("\\b(?:and|und|et|y)\\b"))).select(F.col("doc_id").alias("id"))
    return L.top(dense_run(spark, sf).join(texts, "id", "left_semi"), 2).select("query", "id", "score", "rank")


METHODS = RRF + """,
arms AS (SELECT 'bm25' AS method, query, id, score FROM s UNION ALL SELECT 'dense', query, id, score FROM dense UNION ALL SELECT 'hybrid', query, id, score FROM fused),
mr AS (SELECT *, CAST(row_number() OVER (PARTITION BY method, query ORDER BY score DESC, id) AS INTEGER) AS rank FROM arms)"""


@query("retrieval_methods", METHODS + " SELECT method, query, id, score, rank FROM mr WHERE rank <= 5")
def retrieval_methods(spark, sf):
    """The same questions by each method: lexical, dense and fused, from one lexical and one dense run."""
    lexical, dense = cut(label_lexical(spark, sf), "lexical"), cut(dense_run(spark, sf), "dense")
    fused = L.rrf(L.top(lexical, 40).unionByName(L.top(dense, 40)))
    out = None
    for name, rows in (("bm25", lexical), ("dense", dense), ("hybrid", fused)):
        best = L.top(rows, 5).select(F.lit(name).alias("method"), "query", "id", "score", "rank")
        out = best if out is None else out.unionByName(best)
    return out


THREE = RRF.replace("UNION ALL SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM dense) WHERE rank <= 40)", "UNION ALL SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM dense) WHERE rank <= 40 UNION ALL SELECT query, id, rank FROM (SELECT lq.query, e.vec_id AS id, row_number() OVER (PARTITION BY lq.query ORDER BY e.vec_id) AS rank FROM lq JOIN embeddings e ON e.label = lq.query) WHERE rank <= 40)")


@query("three_list_fusion", THREE + ", tr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused) SELECT query, id, score, rank FROM tr WHERE rank <= 20")
def three_list_fusion(spark, sf):
    """Reciprocal ranks over three lists: text, vectors and the label."""
    labels = vectors(spark, sf).select(F.col("label").cast("long").alias("query"), "id").withColumn("score", F.lit(0.0))
    lists = label_best(spark, sf, 40).unionByName(L.top(dense_run(spark, sf), 40)).unionByName(L.top(labels, 40))
    return L.top(L.rrf(lists), 20).select("query", "id", "score", "rank")


@query("retrieval_service", f"""{NORM}, p AS (SELECT conv_id, turn, {ROUTE.sql} AS route, s FROM t), q AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS nth, * FROM p WHERE route IN ('narrative', 'reasoning', 'research') AND conv_id = -1)
SELECT conv_id, turn, route, md5(s) AS cache_key FROM q""")
def retrieval_service(spark, sf):
    """The planned questions that go to retrieval, each under the key of its normalised words, so that a question is encoded once."""
    rows = asked(spark, sf).withColumn("route", ROUTE.column()).filter(F.col("route").isin("narrative", "reasoning", "research") & (F.col("conv_id") == -1))
    return rows.select("conv_id", "turn", "route", F.md5("s").alias("cache_key"))


@query("query_cache", NORM + ", k AS (SELECT md5(s) AS cache_key, min(conv_id) AS conv_id, count(*) AS uses FROM t GROUP BY 1) SELECT cache_key, uses, conv_id % 2 = 0 AS cached FROM k")
def query_cache(spark, sf):
    """Questions by content key, how often each is asked, and whether its vector is at hand: only the others are encoded."""
    rows = asked(spark, sf).groupBy(F.md5("s").alias("cache_key")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("uses"))
    return rows.select("cache_key", "uses", (F.col("conv_id") % 2 == 0).alias("cached"))


@query("indexed_hits", QTF + RUN + " SELECT r.query, r.id, r.rank FROM run r WHERE r.rank <= 10 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = r.id AND d.lang = 'en' AND d.n_chars >= 200)")
def indexed_hits(spark, sf):
    """Hits that an index has under a filter: a semi join."""
    index = read(spark, sf, "documents").filter("lang = 'en' and n_chars >= 200").select(F.col("doc_id").alias("id"))
    return run_of(spark, sf).filter("rank <= 10").join(index, "id", "left_semi").select("query", "id", F.col("rank").cast("long").alias("rank"))


@query("selected_passages", QTF + """,
r AS (SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT query, id, rank, md5(left(text, 300)) AS quote FROM r JOIN documents ON doc_id = id WHERE rank <= 4""")
def selected_passages(spark, sf):
    """The four passages that a reader is shown, quoted as they stand; the ranking stands in for a model's choice."""
    best = qtf_best(spark, sf, 4).select("query", "id", "rank")
    return best.join(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select("query", "id", "rank", F.md5(F.substring("text", 1, 300)).alias("quote"))


@query("fresh_evaluation", QTF + JUDGED + RUN + """,
x AS (SELECT j.query, j.gain, r.rank, d.lang FROM judged j LEFT JOIN run r ON r.query = j.query AND r.id = j.id LEFT JOIN documents d ON d.doc_id = r.id),
t AS (SELECT r.query, count(*) FILTER (d.lang = 'en') * 1.0 / count(*) AS purity FROM run r JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 5 GROUP BY r.query)
SELECT x.query, max(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS hit_5, coalesce(round(max(CASE WHEN rank <= 5 THEN 1.0 / rank END), 6), 0)::DOUBLE AS mrr_5, round(count(*) FILTER (rank <= 5) * 1.0 / count(*), 6)::DOUBLE AS coverage, round(max(purity), 6)::DOUBLE AS scope_purity FROM x LEFT JOIN t ON t.query = x.query GROUP BY x.query""")
def fresh_evaluation(spark, sf):
    """Hit and reciprocal rank within five, how much of the evidence those five cover, and how pure their scope is."""
    run = run_of(spark, sf, 5)
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    purity = run.join(docs, "id").groupBy("query").agg(F.round(F.count_if(F.col("lang") == "en") / F.count("*"), 6).alias("scope_purity"))
    rows = judged(spark, sf).join(run, ["query", "id"], "left")
    per = rows.groupBy("query").agg(F.max(F.when(F.col("rank").isNotNull(), 1).otherwise(0)).alias("hit_5"), F.coalesce(F.round(1.0 / F.min("rank"), 6), F.lit(0.0)).alias("mrr_5"), F.round(F.count("rank") / F.count("*"), 6).alias("coverage"))
    return per.join(purity, "query", "left")


#: Subjects that a question may name and the words by which a text is about them.
SUBJECT_PAIRS = [
    ("net_interest_income", "\\bnet interest income\\b", "\\bnet interest income\\b"),
    ("cost_to_income", "\\bcost to income\\b", "\\bcost to income\\b|\\bexpense to income\\b"),
    ("return_on_equity", "\\b(?:return on (?:average )?equity|roe)\\b", "\\breturn on (?:average )?equity\\b|\\broe\\b"),
    ("capital", "\\b(?:capital position|capital strength|capital adequacy|capital ratio|cet ?1|tier [12])\\b", "\\b(?:capital (?:position|adequacy|ratio|buffer)|cet ?1|common equity tier|tier [12] capital|regulatory capital)\\b"),
    ("profit", "\\b(?:cash profit|statutory profit|net profit|npat|profit|cash earnings)\\b", "\\b(?:profit|npat|cash earnings)\\b"),
    ("dividend", "\\b(?:dividend|dividends)\\b", "\\bdividends?\\b"),
    ("loans", "\\b(?:loans?|lending)\\b", "\\bloans?\\b|\\blending\\b"),
    ("deposits", "\\bcustomer deposits\\b", "\\bcustomer deposits\\b|\\bdeposits from customers\\b"),
    ("staff_costs", "\\b(?:staff|personnel) (?:costs?|expenses?)\\b", "\\b(?:staff|personnel) (?:costs?|expenses?)\\b|\\bwage[a-z]*\\b|\\bsalar[a-z]*\\b"),
    ("operating_costs", "\\boperating (?:costs?|expenses?)\\b", "\\boperating (?:costs?|expenses?)\\b"),
    ("impairment", "\\b(?:credit|loan) impairment\\b", "\\b(?:credit|loan) impairment\\b"),
    ("amortisation", "\\b(?:software|intangible)\\b.*\\bamorti[sz][a-z]*\\b|\\bamorti[sz][a-z]*\\b.*\\b(?:software|intangible)\\b", "\\b(?:software|intangible)\\b.*\\bamorti[sz][a-z]*\\b|\\bamorti[sz][a-z]*\\b.*\\b(?:software|intangible)\\b"),
]
RESTRICTED = "\\bkmp\\b|key management personnel|related parties|non executive directors|group executives"
#: Passages that every question is held against.
PASSAGES = ["cash profit rose by 5 percent", "loans to key management personnel", "gross loans and lending grew", "operating expenses were higher due to wages", "net interest income increased", "download the app for profit tips", "the cet1 capital ratio improved", "credit impairment charges fell", "dividends per share", "customer deposits and deposits from customers", "nothing of the kind"]


@query("evidence_relevance", NORM + """,
x AS (SELECT t.conv_id, t.turn, t.s, nth, passage FROM t CROSS JOIN (SELECT unnest(range(%d)) AS nth, unnest([%s]) AS passage) WHERE t.conv_id = -1)
SELECT conv_id, turn, CAST(nth AS INTEGER) AS nth, CASE WHEN (%s) AND NOT (%s) THEN 'other_subject' WHEN regexp_matches(s, '\\bloans?\\b|\\blending') AND regexp_matches(passage, '%s') AND NOT regexp_matches(s, '%s') THEN 'related_party'
  WHEN regexp_matches(s, '\\b(?:profit|npat|cash earnings)\\b') AND regexp_matches(passage, '\\b(?:app|application|download|device)\\b') AND NOT regexp_matches(passage, '\\b(?:profit|npat|cash earnings)\\b.{0,80}[0-9]') THEN 'footnote' ELSE 'allowed' END AS reason FROM x"""
% (len(PASSAGES), ", ".join(f"'{p}'" for p in PASSAGES), " OR ".join(f"regexp_matches(s, '{q}')" for _, q, _ in SUBJECT_PAIRS), " OR ".join(f"(regexp_matches(s, '{q}') AND regexp_matches(passage, '{t}'))" for _, q, t in SUBJECT_PAIRS), RESTRICTED, RESTRICTED))
def evidence_relevance(spark, sf):
    """Whether a passage may speak to a question: about a subject that it names, no related party for a total, no footnote of an app for profit."""
    held = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(p).alias("passage")) for i, p in enumerate(PASSAGES)])
    rows = asked(spark, sf).filter("conv_id = -1").select("conv_id", "turn", "s", F.explode(held).alias("x")).select("conv_id", "turn", "s", "x.*")
    named, met = F.lit(False), F.lit(False)
    for _, q, t in SUBJECT_PAIRS:
        named, met = named | F.col("s").rlike(q), met | (F.col("s").rlike(q) & F.col("passage").rlike(t))
    related = F.col("s").rlike("\\bloans?\\b|\\blending") & F.col("passage").rlike(RESTRICTED) & ~F.col("s").rlike(RESTRICTED)
    footnote = F.col("s").rlike("\\b(?:profit|npat|cash earnings)\\b") & F.col("passage").rlike("\\b(?:app|application|download|device)\\b") & ~F.col("passage").rlike("\\b(?:profit|npat|cash earnings)\\b.{0,80}[0-9]")
    return rows.select("conv_id", "turn", "nth", F.when(named & ~met, "other_subject").when(related, "related_party").when(footnote, "footnote").otherwise("allowed").alias("reason"))


FOLLOW = NORM + """,
f AS (SELECT *, lag(a) OVER o AS previous, lag(entities) OVER o AS before_entities, lag(years) OVER o AS before_years FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, previous IS NOT NULL AND length(a) < 60 AND regexp_matches(a, '(?i)^(?:and|what about|how about)\\b') AS inherits FROM f)"""


@query("followup_rules", FOLLOW + """
SELECT conv_id, turn, inherits, CASE WHEN inherits AND len(entities) = 1 AND len(before_entities) = 1 THEN regexp_replace(previous, '(?i)\\b(?:CBA|Commonwealth Bank(?: of Australia)?|NAB|National Australia Bank)\\b', entities[1], 'g')
  WHEN inherits AND len(years) = 1 AND len(before_years) = 1 THEN regexp_replace(previous, '20[0-9]{2}', years[1], 'g') ELSE a END AS resolved FROM g""")
def followup_rules(spark, sf):
    """`And X?` after a question with one entity or one year asks the same of X; anything else stands alone."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = asked(spark, sf)
    for name, c in (("previous", "a"), ("before_entities", "entities"), ("before_years", "years")):
        rows = rows.withColumn(name, F.lag(c).over(order))
    inherits = F.col("previous").isNotNull() & (F.char_length("a") < 60) & F.col("a").rlike(ascii_words("(?i)^(?:and|what about|how about)\\b"))
    rows = rows.withColumn("inherits", inherits)
    entity = F.regexp_replace("previous", F.lit(ascii_words("(?i)\\b(?:CBA|Commonwealth Bank(?: of Australia)?|NAB|National Australia Bank)\\b")), F.get("entities", F.lit(0)))
    year = F.regexp_replace("previous", F.lit("20[0-9]{2}"), F.get("years", F.lit(0)))
    one = lambda c: (F.size(c) == 1) & (F.size("before_" + c) == 1)
    return rows.select("conv_id", "turn", "inherits", F.when(F.col("inherits") & one("entities"), entity).when(F.col("inherits") & one("years"), year).otherwise(F.col("a")).alias("resolved"))


_PAIRS = ", ".join(f"({i}, {base}, {variant})" for i, (base, variant) in enumerate(FAMILIES))


@query("wording_families", REQUESTS_SQL + f""",
sig AS (SELECT turn, md5(string_agg(DISTINCT entity || '/' || coalesce(tag, '-') || '/' || coalesce(scope, '-') || '/' || array_to_string(value_years, '+'), ';' ORDER BY entity || '/' || coalesce(tag, '-') || '/' || coalesce(scope, '-') || '/' || array_to_string(value_years, '+'))) AS signature FROM requests WHERE conv_id = -1 GROUP BY turn)
SELECT CAST(pair AS INTEGER) AS pair, coalesce(x.signature = y.signature, FALSE) AS same FROM (VALUES {_PAIRS}) v(pair, base, variant) LEFT JOIN sig x ON x.turn = base LEFT JOIN sig y ON y.turn = variant""")
def wording_families(spark, sf):
    """A rewording must lead to the same set of requests; a question about something else must not."""
    part = F.concat_ws("/", "entity", F.coalesce("tag", F.lit("-")), F.coalesce("scope", F.lit("-")), F.array_join("value_years", "+"))
    sig = cut(requests(spark, sf).filter("conv_id = -1").groupBy("turn").agg(F.md5(F.array_join(F.array_sort(F.collect_set(part)), ";")).alias("signature")), "signatures")
    pairs = spark.createDataFrame([(i, b, v) for i, (b, v) in enumerate(FAMILIES)], "pair int, base long, variant long")
    rows = pairs.join(sig.select(F.col("turn").alias("base"), F.col("signature").alias("one")), "base", "left").join(sig.select(F.col("turn").alias("variant"), F.col("signature").alias("two")), "variant", "left")
    return rows.select("pair", F.coalesce(F.col("one") == F.col("two"), F.lit(False)).alias("same"))


@query("outcome_classes", SELECTED + f""",
ok AS (SELECT *, {STATUS_SQL} AS status FROM one),
j AS (SELECT metric AS category, CASE WHEN status <> 'bound' THEN 'refused' WHEN metric = 'discount' AND value >= 0 THEN 'wrong_sign' WHEN metric = 'net' AND report_year <> y THEN 'comparative' ELSE 'passed' END AS outcome FROM ok)
SELECT category, outcome, count(*) AS cases FROM j GROUP BY ALL""")
def outcome_classes(spark, sf):
    """Each case judged by the rule of its category, and how often each outcome came up."""
    rows = selected(spark, sf).withColumn("ok", status() == "bound")
    outcome = F.when(~F.col("ok"), "refused").when((F.col("metric") == "discount") & (F.col("value") >= 0), "wrong_sign").when((F.col("metric") == "net") & (F.col("report_year") != F.col("y")), "comparative").otherwise("passed")
    return rows.groupBy(F.col("metric").alias("category"), outcome.alias("outcome")).agg(F.count("*").alias("cases"))


@query("bm25_bonuses", bm25_sql(aliased, 1.2, 0.75) + """,
z AS (SELECT s.query, s.id, round(s.score + CASE WHEN d.lang = 'en' THEN 0.75 ELSE 0 END + CASE WHEN regexp_matches(d.text, '[0-9]') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(lower(d.text), '\\b(?:because|due|driven)\\b') THEN 8 ELSE 0 END, 6) AS score FROM s JOIN documents d ON d.doc_id = s.id WHERE d.n_chars >= 200),
zr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM z) SELECT query, id, score, rank FROM zr WHERE rank <= 10""")
def bm25_bonuses(spark, sf):
    """Lexical scores within a section filter, with what the primary role, an amount and a driver add."""
    bonus = F.when(F.col("lang") == "en", 0.75).otherwise(0.0) + F.when(F.col("text").rlike("[0-9]"), 5.0).otherwise(0.0) + F.when(F.lower("text").rlike(ascii_words("\\b(?:because|due|driven)\\b")), 8.0).otherwise(0.0)
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), bag(F.col("text")).alias("words"), F.when(F.col("n_chars") >= 200, bonus).alias("bonus"))
    return L.best(docs, passages(spark, sf, bag), 10, 1.2, 0.75)

"""Evaluation queries over a BM25 run and judgements made from shared passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.registry import query
from quarry.catalog.retrieval import QTF, aliased, bm25_best, bm25_sql, documents, passages, plain_sql, qtf_best, top_sql
from quarry.functions.text import bag, bag_counts, plain_counts, plain_tokens
from quarry.operators import evaluation as E
from quarry.operators import index as I
from quarry.operators import ledger as G
from quarry.operators import lexical as L
from quarry.scratch import cut, fresh_path, spend

SHINGLE = 8


def judged(spark, sf):
    """query, id, gain: 2 where the document contains the passage, 1 where they share a shingle of eight words; lang and source of the document. A written table."""
    return E.shared_grams(documents(spark, sf, plain_tokens), passages(spark, sf, plain_tokens), SHINGLE, "lang", "source")


JUDGED = f""",
jd AS (SELECT DISTINCT id, array_to_string(words[i:i + {SHINGLE - 1}], ' ') AS gram FROM (SELECT id, words, unnest(range(1, len(words) - {SHINGLE - 2})) AS i FROM d)),
jq AS (SELECT DISTINCT query, array_to_string(words[i:i + {SHINGLE - 1}], ' ') AS gram FROM (SELECT query, words, unnest(range(1, len(words) - {SHINGLE - 2})) AS i FROM q)),
met AS (SELECT DISTINCT query, id FROM jd JOIN jq USING (gram)),
judged AS (SELECT m.query, m.id, CASE WHEN contains(x.text, b.text) THEN 2 ELSE 1 END AS gain FROM met m JOIN documents x ON x.doc_id = m.id JOIN benchmark b ON b.item_id = m.query)"""


@query("passage_judgements", QTF + JUDGED + "\nSELECT query, id, gain FROM judged")
def passage_judgements(spark, sf):
    return judged(spark, sf).select("query", "id", "gain")


def run_of(spark, sf, k=100):
    """The best k of each query; a written table."""
    return qtf_best(spark, sf, k).filter("score > 0").select("query", "id", "rank")


RUN = """,
run AS (SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 100)"""
PER_QUERY = RUN + """,
seen AS (SELECT r.query, r.rank, coalesce(j.gain, 0) AS gain FROM run r LEFT JOIN judged j ON j.query = r.query AND j.id = r.id),
got AS (SELECT query, min(CASE WHEN gain > 0 THEN rank END) AS first, sum(CASE WHEN rank <= 1 THEN gain / log2(rank + 1) ELSE 0 END) AS d1,
               sum(CASE WHEN rank <= 3 THEN gain / log2(rank + 1) ELSE 0 END) AS d3, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) AS d5 FROM seen GROUP BY query),
placed AS (SELECT query, gain, row_number() OVER (PARTITION BY query ORDER BY gain DESC, id) AS place FROM judged),
ideal AS (SELECT query, sum(CASE WHEN place <= 1 THEN gain / log2(place + 1) ELSE 0 END) AS b1, sum(CASE WHEN place <= 3 THEN gain / log2(place + 1) ELSE 0 END) AS b3,
                 sum(CASE WHEN place <= 5 THEN gain / log2(place + 1) ELSE 0 END) AS b5 FROM placed GROUP BY query),
pq AS (SELECT i.query, coalesce(1.0 / first, 0.0) AS mrr, coalesce(d1, 0) / b1 AS ndcg_1, coalesce(d3, 0) / b3 AS ndcg_3, coalesce(d5, 0) / b5 AS ndcg_5,
              CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END AS hit_1, CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END AS hit_3, CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END AS hit_5
       FROM ideal i LEFT JOIN got g ON g.query = i.query)"""
METRICS = ["mrr", "ndcg_1", "ndcg_3", "ndcg_5", "hit_1", "hit_3", "hit_5"]
ROUNDED = ", ".join(f"round({m}, 6)::DOUBLE AS {m}" for m in METRICS)
AVERAGES = ", ".join(f"round(avg({m}), 6)::DOUBLE AS {m}" for m in METRICS)


def per_query(spark, sf, good=None):
    """Metrics of every judged query; a written table. good: judgements that are at hand."""
    run, own = run_of(spark, sf), judged(spark, sf) if good is None else None
    out = cut(E.per_query(run, own if good is None else good), "per-query")
    spend(run, own)
    return out


@query("mrr_ndcg_hit", QTF + JUDGED + PER_QUERY + f"\nSELECT query, {ROUNDED} FROM pq")
def mrr_ndcg_hit(spark, sf):
    return per_query(spark, sf).select("query", *[F.round(m, 6).alias(m) for m in METRICS])


@query("metrics_by_subset_grouping_sets", QTF + JUDGED + PER_QUERY + f""",
kinds AS (SELECT query, CASE WHEN max(gain) = 2 THEN 'known' ELSE 'inferred' END AS kind FROM judged GROUP BY query)
SELECT CASE WHEN grouping(kind) = 1 THEN 'all_answerable' ELSE kind END AS subset, count(*) AS questions, {AVERAGES} FROM pq JOIN kinds USING (query) GROUP BY GROUPING SETS ((kind), ())""")
def metrics_by_subset(spark, sf):
    """One pass for overlapping subsets: known (some document has the whole passage), inferred, and all."""
    good = judged(spark, sf)
    kinds = good.groupBy("query").agg(F.when(F.max("gain") == 2, "known").otherwise("inferred").alias("kind"))
    rows = per_query(spark, sf, good).join(kinds, "query")
    out = rows.rollup("kind").agg(F.grouping("kind").alias("g"), F.count("*").alias("questions"), *E.means(rows, METRICS))
    return out.select(F.when(F.col("g") == 1, "all_answerable").otherwise(F.col("kind")).alias("subset"), "questions", *METRICS)


@query("binary_ndcg", QTF + JUDGED + RUN + """,
hits AS (SELECT r.query, sum(1 / log2(r.rank + 1)) AS dcg FROM run r JOIN judged j ON j.query = r.query AND j.id = r.id WHERE r.rank <= 5 GROUP BY r.query),
n AS (SELECT query, least(count(*), 5) AS n FROM judged GROUP BY query),
best AS (SELECT query, sum(1 / log2(i + 1)) AS best FROM (SELECT query, unnest(range(1, n + 1)) AS i FROM n) GROUP BY query)
SELECT best.query, round(coalesce(dcg, 0) / best, 6)::DOUBLE AS ndcg FROM best LEFT JOIN hits ON hits.query = best.query""")
def binary_ndcg(spark, sf):
    """Binary gains over the best five; the ideal is bounded by the positives there are."""
    good = judged(spark, sf).select("query", "id")
    hits = run_of(spark, sf, 5).join(good, ["query", "id"]).groupBy("query").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = good.groupBy("query").agg(F.least(F.count("*"), F.lit(5)).cast("int").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return n.join(hits, "query", "left").select("query", F.round(F.coalesce("dcg", F.lit(0.0)) / best, 6).alias("ndcg"))


@query("refusal_rate", QTF + """,
best AS (SELECT q.query, coalesce(max(score), 0) AS top FROM q LEFT JOIN s ON s.query = q.query GROUP BY q.query)
SELECT k, count(*) AS questions, round(avg(CASE WHEN top < 20 * k THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS refused FROM best CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) GROUP BY k""")
def refusal_rate(spark, sf):
    """How many questions a score gate refuses, at three gates."""
    asked = passages(spark, sf, plain_tokens).select("query")
    best = asked.join(qtf_best(spark, sf, 1).select("query", F.col("score").alias("top")), "query", "left").fillna(0.0, ["top"])
    rows = best.select("query", "top", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k"))
    return rows.groupBy("k").agg(F.count("*").alias("questions"), F.round(F.avg(F.when(F.col("top") < 20 * F.col("k"), 1.0).otherwise(0.0)), 6).alias("refused"))


@query("scorecard", QTF + JUDGED + PER_QUERY + """,
src AS (SELECT pq.query, first_value(x.lang) OVER (PARTITION BY pq.query ORDER BY j.gain DESC, j.id) AS lang, hit_5 FROM pq JOIN judged j ON j.query = pq.query JOIN documents x ON x.doc_id = j.id),
one AS (SELECT DISTINCT query, lang, hit_5 FROM src)
SELECT lang AS category, CAST(sum(hit_5) AS BIGINT) AS passed, count(*) AS total FROM one GROUP BY lang""")
def scorecard(spark, sf):
    """Passes and totals by category: the language of a question's best judged document."""
    good = judged(spark, sf)
    best = good.groupBy("query").agg(F.min_by("lang", F.struct(-F.col("gain"), "id")).alias("category"))
    return per_query(spark, sf, good).join(best, "query").groupBy("category").agg(F.sum("hit_5").cast("long").alias("passed"), F.count("*").alias("total"))


@query("arm_selection", QTF + JUDGED + PER_QUERY + """,
arms AS (SELECT 'top_1' AS arm, 1 AS depth, avg(hit_1) AS recall, avg(ndcg_1) AS ndcg, avg(mrr) AS mrr, count(*) FILTER (hit_1 = 0) AS missed FROM pq UNION ALL SELECT 'top_3', 3, avg(hit_3), avg(ndcg_3), avg(mrr), count(*) FILTER (hit_3 = 0) FROM pq UNION ALL SELECT 'top_5', 5, avg(hit_5), avg(ndcg_5), avg(mrr), count(*) FILTER (hit_5 = 0) FROM pq)
SELECT arm, depth, missed, round(recall, 6)::DOUBLE AS recall, round(ndcg, 6)::DOUBLE AS ndcg FROM arms ORDER BY missed, round(recall, 6) DESC, round(ndcg, 6) DESC, round(mrr, 6) DESC, depth, arm LIMIT 1""")
def arm_selection(spark, sf):
    """The best arm by six keys in turn: misses, recall, gain, reciprocal rank, depth, name; one row, as that is what selection means."""
    rows = per_query(spark, sf).agg(*[F.avg(m).alias(m) for m in METRICS], *[F.count_if(F.col(f"hit_{k}") == 0).alias(f"missed_{k}") for k in (1, 3, 5)])
    one = lambda k: F.struct(F.lit(f"top_{k}").alias("arm"), F.lit(k).alias("depth"), F.col(f"missed_{k}").alias("missed"), F.round(f"hit_{k}", 6).alias("recall"), F.round(f"ndcg_{k}", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))
    arms = rows.select(F.explode(F.array(*map(one, (1, 3, 5)))).alias("a")).select("a.*")
    return arms.orderBy("missed", F.desc("recall"), F.desc("ndcg"), F.desc("mrr"), "depth", "arm").limit(1).drop("mrr")


@query("evidence_recall_groups", QTF + JUDGED + RUN + """,
grp AS (SELECT j.query, x.source, count(*) AS alternatives, count(r.id) AS found, min(r.rank) AS first FROM judged j JOIN documents x ON x.doc_id = j.id LEFT JOIN run r ON r.query = j.query AND r.id = j.id GROUP BY j.query, x.source)
SELECT query, count(*) AS groups, count(first) AS met, round(count(first) / count(*), 6)::DOUBLE AS recall, coalesce(round(1.0 / min(first), 6), 0)::DOUBLE AS rr, count(first) = count(*) AS complete FROM grp GROUP BY query""")
def evidence_recall_groups(spark, sf):
    """Each source is an evidence group; any judged document of it in the run meets it."""
    rows = judged(spark, sf).join(run_of(spark, sf), ["query", "id"], "left")
    groups = rows.groupBy("query", "source").agg(F.min("rank").alias("first"))
    n, met = F.count("*"), F.count("first")
    return groups.groupBy("query").agg(n.alias("groups"), met.alias("met"), F.round(met / n, 6).alias("recall"), F.coalesce(F.round(1.0 / F.min("first"), 6), F.lit(0.0)).alias("rr"), (met == n).alias("complete"))


@query("metamorphic_signature", QTF + """,
v AS (SELECT query, words AS base, CASE WHEN query % 3 = 1 THEN list_append(list_reverse(words), 'not') ELSE list_reverse(words) END AS variant FROM q)
SELECT query, md5(array_to_string(list_sort(base), ' ')) = md5(array_to_string(list_sort(variant), ' ')) AS same, md5(array_to_string(list_sort(base), ' ')) AS signature FROM v""")
def metamorphic_signature(spark, sf):
    """A rewording that keeps the words has the same canonical signature, one that adds a word (every third here) has not."""
    asked = passages(spark, sf, plain_tokens)
    variant = F.when(F.col("query") % 3 == 1, F.concat(F.reverse("words"), F.array(F.lit("not")))).otherwise(F.reverse("words"))
    sign = lambda c: F.md5(F.array_join(F.array_sort(c), " "))
    return asked.select("query", (sign(F.col("words")) == sign(variant)).alias("same"), sign(F.col("words")).alias("signature"))


def arms(spark, sf):
    """Runs of two rankers under one schema, for comparisons."""
    a = bm25_best(spark, sf, 10).withColumn("arm", F.lit("set"))
    return a.unionByName(qtf_best(spark, sf, 10).withColumn("arm", F.lit("weighed")))


@query("arm_overlap", "WITH a AS (" + top_sql(bm25_sql(aliased, 1.5, 0.75), 10) + "), b AS (" + top_sql(QTF, 10) + """), u AS (SELECT query, id FROM a UNION ALL SELECT query, id FROM b),
n AS (SELECT query, id, count(*) AS arms FROM u GROUP BY ALL) SELECT query, CAST(sum(CASE WHEN arms = 2 THEN 1 ELSE 0 END) AS BIGINT) AS shared, count(*) AS distinct_docs FROM n GROUP BY query""")
def arm_overlap(spark, sf):
    """How much two arms agree on their best ten."""
    rows = arms(spark, sf)
    both = rows.groupBy("query", "id").agg(F.countDistinct("arm").alias("arms"))
    return both.groupBy("query").agg(F.sum(F.when(F.col("arms") == 2, 1).otherwise(0)).alias("shared"), F.count("*").alias("distinct_docs"))


#: Arms: how texts are indexed, and k1 and b of their ranking; the simplest first.
CORPORA = {"plain": (plain_counts, plain_tokens, plain_sql), "aliased": (bag_counts, bag, aliased)}
METHODS = {"steep": (1.5, 0.75), "flat": (0.9, 0.4)}
ARMS = [(c, m) for m in METHODS for c in CORPORA]
#: Scored beside the chosen arm on the reserved questions.
BASELINES = [("plain", "steep"), ("aliased", "steep")]


def arm_rows(spark, sf, arms, questions):
    """G.ROWS of the arms: the best ten of each judged question, from one index for each corpus that all its arms and phases share."""
    runs = None
    for corpus, method in arms:
        counts, words, _ = CORPORA[corpus]
        asked = passages(spark, sf, words).join(questions, "query", "left_semi").select(F.struct("query").alias("request"), F.lit(I.ALL).alias("scope"), "words")
        best, blocks = I.search(spark, I.of_table(spark, f"{sf}/documents.parquet", "doc_id", "text", counts, ("lang", "source")), asked, 10, *METHODS[method])
        spend(blocks)
        run = best.select(F.lit(corpus).alias("corpus"), F.lit(method).alias("method"), "request.query", "id", "rank")
        runs = run if runs is None else runs.unionByName(run)
    first = runs.join(questions, ["query", "id"]).groupBy("corpus", "method", "query").agg(F.min("rank").alias("first"))
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("corpus"), F.lit(m).alias("method")) for c, m in arms]))
    asked = questions.select("query").distinct().select("query", every.alias("arm")).select("query", "arm.*")
    return asked.join(first, ["corpus", "method", "query"], "left").select("corpus", "method", F.col("query").cast("long").alias("query"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("first") <= 5, 1.0).otherwise(0.0).alias("hit"))


def _arm_sql(corpus, method):
    return f"SELECT '{corpus}' AS corpus, '{method}' AS method, query, id, rank FROM ({top_sql(bm25_sql(CORPORA[corpus][2], *METHODS[method]), 10)})"


_pairs = lambda arms: ", ".join(f"('{c}', '{m}', {n})" for n, (c, m) in enumerate(arms))


@query("phased_arms", QTF + JUDGED + f""",
runs AS ({" UNION ALL ".join(_arm_sql(c, m) for c, m in ARMS)}),
arm(corpus, method, nth) AS (VALUES {_pairs(ARMS)}),
firsts AS (SELECT corpus, method, query, min(rank) AS first FROM runs JOIN judged USING (query, id) GROUP BY ALL),
scored AS (SELECT CASE WHEN md5(query::VARCHAR) < '8' THEN 'development' ELSE 'reserved' END AS phase, a.corpus, a.method, nth, j.query, coalesce(1.0 / first, 0)::DOUBLE AS mrr, CASE WHEN first <= 5 THEN 1 ELSE 0 END::DOUBLE AS hit
  FROM (SELECT DISTINCT query FROM judged) j CROSS JOIN arm a LEFT JOIN firsts USING (corpus, method, query)),
mean AS (SELECT phase, corpus, method, nth, round(avg(mrr), 6) AS mrr, round(avg(hit), 6) AS hit FROM scored GROUP BY ALL),
pick AS (SELECT corpus, method FROM mean WHERE phase = 'development' ORDER BY mrr DESC, hit DESC, nth LIMIT 1),
late AS (SELECT m.* FROM mean m WHERE phase = 'reserved' AND ((corpus, method) IN (SELECT corpus, method FROM pick) OR (corpus, method) IN (VALUES {", ".join(f"('{c}', '{m}')" for c, m in BASELINES)}))),
last AS (SELECT corpus, method FROM late ORDER BY mrr DESC, hit DESC, nth LIMIT 1)
SELECT s.phase, s.corpus, s.method, s.query::BIGINT AS query, round(s.mrr, 6) AS mrr, s.hit, (s.corpus, s.method) IN (SELECT corpus, method FROM pick) AS chosen FROM scored s WHERE phase = 'development'
UNION ALL SELECT s.phase, s.corpus, s.method, s.query::BIGINT, round(s.mrr, 6), s.hit, (s.corpus, s.method) IN (SELECT corpus, method FROM last) FROM scored s JOIN late USING (phase, corpus, method)""")
def phased_arms(spark, sf):
    """All arms on the development questions, then the chosen one and the baselines on the reserved ones; each phase is scored once, in a ledger."""
    own = judged(spark, sf)
    questions = own.filter("gain > 0").select("query", "id", F.when(F.md5(F.col("query").cast("string")) < "8", "development").otherwise("reserved").alias("phase"))
    configuration = f"{list(CORPORA)} {METHODS} {SHINGLE}"
    ledger = G.Ledger(fresh_path(spark, "ledger"), configuration)
    of = lambda phase: questions.filter(F.col("phase") == phase).select("query", "id")
    G.score(spark, ledger, "development", lambda: arm_rows(spark, sf, ARMS, of("development")), ARMS)
    later = list(dict.fromkeys([G.chosen(spark, ledger, "development"), *BASELINES]))
    G.score(spark, ledger, "reserved", lambda: arm_rows(spark, sf, later, of("reserved")), ARMS)
    spend(own)
    return G.results(spark, ledger, ["development", "reserved"]).withColumn("mrr", F.round("mrr", 6))

"""Retrieval queries. Stated query sets: all benchmark passages, or the first vector of each label with its document's text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.registry import query, read
from quarry.functions.text import bag, plain_tokens, stem_words
from quarry.operators import lexical as L
from quarry.scratch import cut, in_blocks, spend

TOKENS_SQL = "regexp_extract_all(lower({t}), '[a-z]+[0-9]*|[0-9]+(?:[.,][0-9]+)*')"
ALIAS_SQL = "flatten([CASE x WHEN 'nim' THEN ['net','interest','margin'] WHEN 'npat' THEN ['net','profit','after','tax'] WHEN 'eps' THEN ['earnings','per','share'] WHEN 'dps' THEN ['dividend','per','share'] WHEN 'cet1' THEN ['common','equity','tier','1'] WHEN 'lcr' THEN ['liquidity','coverage','ratio'] ELSE [] END FOR x IN {k}])"
PLAIN_SQL = "regexp_extract_all(lower({t}), '[a-z0-9]+')"
STEM_SQL = """flatten([CASE WHEN x LIKE 'invest%' THEN ['invest'] WHEN x LIKE 'strateg%' THEN ['strategy'] WHEN x LIKE 'priorit%' THEN ['priority'] WHEN x LIKE 'technolog%' THEN ['technology']
  WHEN x LIKE 'modernis%' OR x LIKE 'moderniz%' THEN ['modern'] WHEN x LIKE 'digit%' THEN ['digital'] WHEN x = 'genai' THEN ['generative', 'ai']
  WHEN x LIKE '%s' AND length(x) > 4 THEN [left(x, length(x) - 1)] ELSE [x] END
  FOR x IN regexp_extract_all(lower({t}), '[a-z]+') IF x NOT IN ('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','with')])"""


def aliased(t: str) -> str:
    k = TOKENS_SQL.format(t=t)
    return f"list_concat({k}, {ALIAS_SQL.format(k=k)})"


def bm25_sql(words, k1, b, weigh=False, floor=True, docs="documents", key="doc_id", queries="SELECT item_id AS query, text FROM benchmark", scope="") -> str:
    """CTEs d, s (query, id, score): the oracle's BM25."""
    mean = "greatest(avg(len(words)), 1)" if floor else "avg(len(words))"
    return f"""
WITH d AS (SELECT {key} AS id, {words("text")} AS words FROM {docs} {scope}),
q AS (SELECT query, {words("text")} AS words FROM ({queries})),
c AS (SELECT count(*) AS n, {mean} AS mean FROM d),
tf AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(words) AS length, unnest(words) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
a AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest(words) AS term FROM q) GROUP BY ALL),
s AS (SELECT a.query, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * length / mean)) * {"qtf" if weigh else "1"}), 6) AS score
      FROM tf JOIN df USING (term) JOIN a USING (term) CROSS JOIN c GROUP BY a.query, tf.id)"""


def top_sql(cte: str, k: int, source: str = "s", extra: str = "") -> str:
    return f"{cte}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM {source})\nSELECT query, id, score, rank{extra} FROM r WHERE rank <= {k}"


def plain_sql(t):
    return PLAIN_SQL.format(t=t)


def stem_sql(t):
    return STEM_SQL.format(t=t)


def documents(spark, sf, words):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), words(F.col("text")).alias("words"), "lang", "source", "text")


def passages(spark, sf, words):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query"), words(F.col("text")).alias("words"), "text")


def bm25_best(spark, sf, k, **more):
    """The k best of each passage. more: columns of documents that L.best knows."""
    return L.best(documents(spark, sf, bag).withColumns(more), passages(spark, sf, bag), k, 1.5, 0.75)


@query("bm25_topk", top_sql(bm25_sql(aliased, 1.5, 0.75), 20))
def bm25_topk(spark, sf):
    return bm25_best(spark, sf, 20)


def qtf_best(spark, sf, k):
    return L.best(documents(spark, sf, plain_tokens), passages(spark, sf, plain_tokens), k, 0.9, 0.4, weigh_query=True, floor_length=False)


QTF = bm25_sql(plain_sql, 0.9, 0.4, weigh=True, floor=False)


@query("bm25_qtf", top_sql(QTF, 100))
def bm25_qtf(spark, sf):
    return qtf_best(spark, sf, 100).filter("score > 0")


FIELDED = bm25_sql(stem_sql, 1.2, 0.75) + """,
g AS (SELECT 2 AS w UNION ALL SELECT 3),
dg AS (SELECT DISTINCT id, w, array_to_string(words[i:i + w - 1], ' ') AS gram FROM (SELECT id, w, words, unnest(range(1, len(words) - w + 2)) AS i FROM d, g)),
qg AS (SELECT DISTINCT query, w, array_to_string(words[i:i + w - 1], ' ') AS gram FROM (SELECT query, w, words, unnest(range(1, len(words) - w + 2)) AS i FROM q, g)),
bonus AS (SELECT query, id, sum(2 * w) AS bonus FROM dg JOIN qg USING (w, gram) GROUP BY ALL),
f AS (SELECT s.query, s.id, round(s.score + coalesce(bonus, 0), 6) AS score FROM s LEFT JOIN bonus b ON b.query = s.query AND b.id = s.id)"""


@query("bm25_fielded", top_sql(FIELDED, 20, "f"))
def bm25_fielded(spark, sf):
    docs, asked = documents(spark, sf, stem_words), passages(spark, sf, stem_words)
    scored = L.bm25(docs, asked, 1.2, 0.75).join(L.ngram_bonus(docs, asked), ["query", "id"], "left")
    return L.top(scored.withColumn("score", F.round(F.col("score") + F.coalesce("bonus", F.lit(0)), 6)), 20).select("query", "id", "score", "rank")


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def label_queries(spark, sf):
    """The first vector of each label: as many rows as there are labels."""
    return vectors(spark, sf).groupBy("label").agg(F.min(F.struct("id", "v")).alias("q")).select(F.col("label").cast("long").alias("query"), F.col("q.id").alias("qid"), F.col("q.v").alias("v"))


def dense_run(spark, sf):
    return L.dense_scores(vectors(spark, sf).select("id", "v"), label_queries(spark, sf).select("query", "v"))


DENSE = """
WITH lq AS (SELECT CAST(label AS BIGINT) AS query, min(vec_id) AS qid FROM embeddings GROUP BY label),
dense AS (SELECT query, c.vec_id AS id, round(list_sum([p[1]::DOUBLE * p[2]::DOUBLE FOR p IN list_zip(q.embedding, c.embedding)]), 6) AS score
          FROM lq JOIN embeddings q ON q.vec_id = qid CROSS JOIN embeddings c)"""


@query("dense_topk", top_sql(DENSE, 20, "dense"))
def dense_topk(spark, sf):
    return L.top(dense_run(spark, sf), 20).select("query", "id", "score", "rank")


def label_texts(spark, sf, docs):
    """The distinct words of each label's first document."""
    first = label_queries(spark, sf).select("query", F.col("qid").alias("id"))
    return docs.join(F.broadcast(first), "id").select("query", F.array_distinct("words").alias("words"))  # a row for each label


def label_lexical(spark, sf):
    docs = documents(spark, sf, bag)
    return L.bm25(docs, label_texts(spark, sf, docs), 1.5, 0.75)


def label_best(spark, sf, k):
    """What L.top(label_lexical(...), k) has, scored where documents are read; a written table."""
    docs = documents(spark, sf, bag)
    asked = cut(label_texts(spark, sf, docs), "asked")  # a row for each label
    best = L.best(docs.select("id", "words"), asked, k, 1.5, 0.75)
    spend(asked)
    return best


LABEL_TEXTS = "SELECT CAST(label AS BIGINT) AS query, text FROM (SELECT label, min(vec_id) AS qid FROM embeddings GROUP BY label) JOIN documents ON doc_id = qid"
BOTH = bm25_sql(aliased, 1.5, 0.75, queries=LABEL_TEXTS) + "," + DENSE.replace("WITH", "", 1)


def fused(spark, sf, depth=40):
    lists = label_best(spark, sf, depth).unionByName(L.top(dense_run(spark, sf), depth))
    return L.rrf(lists)


RRF = BOTH + """,
lists AS (SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 40
          UNION ALL SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM dense) WHERE rank <= 40),
fused AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY ALL)"""


@query("hybrid_rrf", top_sql(RRF, 20, "fused"))
def hybrid_rrf(spark, sf):
    return L.top(fused(spark, sf), 20).select("query", "id", "score", "rank")


BOOSTED = RRF + """,
boosted AS (SELECT f.query, f.id, round(f.score + CASE WHEN d.lang = o.lang THEN 0.08 ELSE -0.04 END + CASE WHEN d.source = o.source THEN 0.04 ELSE 0 END - CASE WHEN d.n_chars < 200 THEN 0.005 ELSE 0 END, 9) AS score
            FROM fused f JOIN lq USING (query) JOIN documents o ON o.doc_id = lq.qid JOIN documents d ON d.doc_id = f.id)"""


@query("hybrid_typed_boost", top_sql(BOOSTED, 20, "boosted"))
def hybrid_typed_boost(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    own = label_queries(spark, sf).select("query", F.col("qid").alias("id")).join(docs, "id").select("query", F.col("lang").alias("qlang"), F.col("source").alias("qsource"))
    rows = fused(spark, sf).join(docs, "id").join(own, "query")
    boost = F.when(F.col("lang") == F.col("qlang"), 0.08).otherwise(-0.04) + F.when(F.col("source") == F.col("qsource"), 0.04).otherwise(0.0) - F.when(F.col("n_chars") < 200, 0.005).otherwise(0.0)
    return L.top(rows.select("query", "id", F.round(F.col("score") + boost, 9).alias("score")), 20).select("query", "id", "score", "rank")


WEIGHED = BOTH + """,
w AS (SELECT s.query, s.id, d.lang AS branch, round(s.score + 10 * coalesce(e.score, 0) + CASE WHEN v.label = s.query THEN 2 ELSE 0 END, 6) AS score
      FROM s JOIN documents d ON d.doc_id = s.id LEFT JOIN dense e ON e.query = s.query AND e.id = s.id LEFT JOIN embeddings v ON v.vec_id = s.id),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM w),
b AS (SELECT *, row_number() OVER (PARTITION BY query, branch ORDER BY score DESC, id) AS nth FROM p WHERE rank <= 30)
SELECT query, branch, id, score, CAST(rank AS INTEGER) AS rank FROM b WHERE nth <= 3"""


@query("weighted_sum_rank", WEIGHED)
def weighted_sum_rank(spark, sf):
    """Lexical + 10 x dense + 2 for an equal label; of the best 30, three of each branch."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("branch"))
    dense = dense_run(spark, sf).withColumnRenamed("score", "dense")
    rows = label_lexical(spark, sf).join(docs, "id").join(dense, ["query", "id"], "left").join(vectors(spark, sf).select("id", "label"), "id", "left")
    score = F.round(F.col("score") + 10 * F.coalesce("dense", F.lit(0.0)) + F.when(F.col("label") == F.col("query"), 2).otherwise(0), 6)
    best = L.top(rows.withColumn("score", score), 30).withColumn("both", F.struct("query", "branch"))
    return L.top(best.withColumnRenamed("rank", "place"), 3, by="both").select("query", "branch", "id", "score", F.col("place").alias("rank"))


ROUND = bm25_sql(aliased, 1.5, 0.75) + """,
b AS (SELECT s.query, s.id, d.lang AS branch, row_number() OVER (PARTITION BY s.query, d.lang ORDER BY score DESC, s.id) AS rank FROM s JOIN documents d ON d.doc_id = s.id),
i AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY rank, branch, id) AS position FROM b WHERE rank <= 5)
SELECT query, CAST(position AS INTEGER) AS position, id FROM i"""


@query("round_robin_langs", ROUND)
def round_robin_langs(spark, sf):
    return L.interleave(bm25_best(spark, sf, 5, of=F.col("lang")).withColumnRenamed("of", "branch"))


SCOPED = bm25_sql(aliased, 1.5, 0.75, docs="(SELECT d.* FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang = 'en' AND coalesce(quality, 1) = 1)")


@query("scoped_topk_prefilter", top_sql(SCOPED, 10))
def scoped_topk_prefilter(spark, sf):
    """Scope and quality gate before ranking: statistics and ranks are of the scope alone."""
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    docs = documents(spark, sf, bag).filter("lang = 'en'").join(labels, "id", "left").filter("coalesce(quality, 1) = 1")
    return L.best(docs.select("id", "words"), passages(spark, sf, bag), 10, 1.5, 0.75)


DISTINCT = bm25_sql(aliased, 1.5, 0.75) + """,
u AS (SELECT s.query, s.id, s.score, row_number() OVER (PARTITION BY s.query, md5(d.text) ORDER BY s.score DESC, s.id) AS copy FROM s JOIN documents d ON d.doc_id = s.id),
o AS (SELECT query, id, score FROM u WHERE copy = 1)"""


@query("distinct_body_topk", top_sql(DISTINCT, 10, "o"))
def distinct_body_topk(spark, sf):
    return bm25_best(spark, sf, 10, once=F.md5("text"))


WINDOWS = top_sql(QTF, 20).replace("SELECT query, id, score, rank FROM r", ", pool AS (SELECT query, id FROM r") + """),
spans AS (SELECT p.query, p.id, list_distinct(q.words) AS asked, d.words[i:i + 63] AS span FROM pool p JOIN q ON q.query = p.query JOIN (SELECT id, words, unnest(range(1, greatest(len(words), 1) + 1, 32)) AS i FROM d) d ON d.id = p.id),
w AS (SELECT query, id, max(len(list_intersect(asked, list_distinct(span)))) / max(len(asked))::DOUBLE AS score FROM spans GROUP BY ALL),
v AS (SELECT query, id, round(score, 6) AS score FROM w)"""
WINDOWS = top_sql(WINDOWS.replace("rank <= 20),\n", "rank <= 20),\n"), 5, "v").replace(", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM v)\nSELECT query, id, score, rank FROM r", ", r2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM v)\nSELECT query, id, score, rank FROM r2")


@query("rerank_windows", WINDOWS)
def rerank_windows(spark, sf):
    """A stand-in for a cross-encoder: the best share of query words in any window of 64 words, windows half overlapping, over the best 20."""
    docs, asked = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), passages(spark, sf, plain_tokens)
    pool = cut(qtf_best(spark, sf, 20).select("query", "id").join(docs, "id"), "pool")  # texts of hits alone are cut into words again
    rows = pool.select("query", "id", plain_tokens(F.col("text")).alias("words")).join(asked.select("query", F.array_distinct("words").alias("asked")), "query")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(32))
    best = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect("asked", F.slice("words", i, 64)))))
    return L.top(rows.select("query", "id", F.round(best / F.size("asked"), 6).alias("score")), 5).select("query", "id", "score", "rank")


CONCEPT = """
WITH part AS (SELECT label, unnest(range(64)) AS i, embedding FROM embeddings),
mean AS (SELECT label, i, round(avg(embedding[i + 1]::DOUBLE), 12) AS x FROM part GROUP BY ALL),
len AS (SELECT label, sqrt(sum(x * x)) AS n FROM mean GROUP BY label),
sim AS (SELECT e.vec_id, m.label, round(sum(e.embedding[m.i + 1]::DOUBLE * m.x) / max(l.n), 6) AS score FROM embeddings e CROSS JOIN mean m JOIN len l ON l.label = m.label GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS next FROM sim)
SELECT vec_id, CASE WHEN score >= 0.36 AND round(score - next, 6) >= 0.025 THEN label END AS concept, score, round(score - next, 6) AS margin FROM r WHERE rank = 1"""


@query("concept_margin", CONCEPT)
def concept_margin(spark, sf):
    """The nearest label centroid of each vector; no concept below a score of 0.36 or a lead of 0.025."""
    rows = vectors(spark, sf)
    part = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 12).alias("x"))
    centres = part.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(F.col("label").alias("concept"), F.col("c.x").alias("c"))
    centres = centres.withColumn("n", F.sqrt(L.dot(F.col("c"), F.col("c"))))  # as many rows as labels
    against = lambda block: rows.select("id", "v").crossJoin(F.broadcast(block)).select("id", "concept", F.round(L.dot(F.col("v"), F.col("c")) / F.col("n"), 6).alias("score"))
    scored = in_blocks(centres, "concept", L.BLOCK, against)
    best = scored.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "concept"))).alias("all"))
    score, second = -F.col("all")[0]["minus"], -F.get("all", F.lit(1))["minus"]
    margin = F.round(score - second, 6)
    return best.select(F.col("id").alias("vec_id"), F.when((score >= 0.36) & (margin >= 0.025), F.col("all")[0]["concept"]).alias("concept"), score.alias("score"), margin.alias("margin"))

"""Retrieval within scopes: every request against the statistics of its own scope, from an index that is written once."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.registry import query, read
from quarry.catalog.retrieval import DENSE, LABEL_TEXTS, aliased, dense_run, label_queries, passages, plain_sql
from quarry.functions.text import bag, bag_counts, plain_tokens
from quarry.operators import index as I
from quarry.operators import lexical as L
from quarry.scratch import cut

FACETS = ("lang", "source")


def corpus_index(spark, sf):
    return I.of_table(spark, f"{sf}/documents.parquet", "doc_id", "text", bag_counts, FACETS)


def scoped_sql(queries: str, scopes: str, k1=1.5, b=0.75) -> str:
    """CTEs up to s (query, scope, id, score): BM25 of every query in every scope by the scope's own statistics."""
    return f"""
WITH x AS (SELECT doc_id AS id, {aliased("text")} AS words, lang, source FROM documents),
m AS ({scopes}),
q AS (SELECT query, {aliased("text")} AS words FROM ({queries})),
c AS (SELECT scope, count(*) AS n, greatest(avg(len(words)), 1) AS mean FROM x JOIN m USING (id) GROUP BY scope),
tf AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(words) AS length, unnest(words) AS term FROM x) GROUP BY ALL),
df AS (SELECT scope, term, count(*) AS df FROM tf JOIN m USING (id) GROUP BY ALL),
a AS (SELECT DISTINCT query, unnest(words) AS term FROM q),
s AS (SELECT a.query, m.scope, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * length / mean))), 6) AS score
      FROM a JOIN tf USING (term) JOIN m ON m.id = tf.id JOIN df ON df.scope = m.scope AND df.term = a.term JOIN c ON c.scope = m.scope GROUP BY a.query, m.scope, tf.id)"""


EVERY_SCOPE = "SELECT id, 'lang=' || lang AS scope FROM x WHERE lang IS NOT NULL UNION ALL SELECT id, 'source=' || source FROM x WHERE source IS NOT NULL"


def scope_names(spark, sf):
    """Every language and every source: as many rows as there are values."""
    names = F.array_compact(F.array(*[I.scope_of(f, F.col(f)) for f in FACETS]))
    return read(spark, sf, "documents").select(F.explode(names).alias("scope")).distinct()


def scoped_search(spark, sf, k: int):
    """Every passage in every scope: the k best of each request, and the blocks that it skipped."""
    asked = passages(spark, sf, bag).select("query", "words").crossJoin(scope_names(spark, sf))  # a stated query set in every scope
    return I.search(spark, corpus_index(spark, sf), asked.select(F.struct("query", "scope").alias("request"), "scope", "words"), k)


@query("request_retrieval", scoped_sql("SELECT item_id AS query, text FROM benchmark", EVERY_SCOPE) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query, scope ORDER BY score DESC, id) AS depth FROM s),
i AS (SELECT query, id, scope, depth, row_number() OVER (PARTITION BY query ORDER BY depth, scope, id) AS position FROM r WHERE depth <= 4)
SELECT query, scope, id, CAST(depth AS INTEGER) AS depth, CAST(position AS INTEGER) AS position FROM i""")
def request_retrieval(spark, sf):
    """One retrieval for each request (a passage in a language or a source), all at once, then interleaved by depth."""
    from pyspark.sql import Window

    best, _ = scoped_search(spark, sf, 4)
    place = F.row_number().over(Window.partitionBy("request.query").orderBy("rank", "request.scope", "id"))
    return best.withColumn("position", place).select("request.query", "request.scope", "id", F.col("rank").alias("depth"), "position")


@query("skipped_blocks")
def skipped_blocks(spark, sf):
    """For each scope: its requests, the blocks that they met, and how many of these were never scored. The layout has no counterpart in SQL."""
    _, blocks = scoped_search(spark, sf, 4)
    return blocks.groupBy("request.scope").agg(F.count("*").alias("requests"), F.sum("blocks").alias("blocks"), F.sum("skipped").alias("skipped"))


def share_of_words(pool, docs, asked):
    """query, branch, id, score: the best share of a query's words in any window of 64 words, windows half overlapping."""
    rows = pool.join(docs, "id").join(asked, "query")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(32))
    best = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect("asked", F.slice("words", i, 64)))))
    return rows.select("query", "branch", "id", F.round(best / F.size("asked"), 6).alias("score"))


BRANCHES = scoped_sql(LABEL_TEXTS, "SELECT id, lang AS scope FROM x WHERE lang IS NOT NULL") + "," + DENSE.replace("WITH", "", 1) + f""",
arm AS (SELECT 'bm25' AS method, query, scope AS branch, id, score FROM s UNION ALL SELECT 'dense', d.query, x.lang, d.id, d.score FROM dense d JOIN x ON x.id = d.id WHERE x.lang IS NOT NULL),
ra AS (SELECT *, row_number() OVER (PARTITION BY method, query, branch ORDER BY score DESC, id) AS rank FROM arm),
hy AS (SELECT query, branch, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ra WHERE rank <= 40 GROUP BY ALL),
pool AS (SELECT query, branch, id FROM (SELECT *, row_number() OVER (PARTITION BY query, branch ORDER BY score DESC, id) AS rank FROM hy) WHERE rank <= 20),
lw AS (SELECT query, list_distinct({plain_sql("text")}) AS asked FROM ({LABEL_TEXTS})),
pw AS (SELECT doc_id AS id, {plain_sql("text")} AS words FROM documents WHERE doc_id IN (SELECT id FROM pool)),
sp AS (SELECT id, words[i:i + 63] AS span FROM (SELECT id, words, unnest(range(1, greatest(len(words), 1) + 1, 32)) AS i FROM pw)),
re AS (SELECT pool.query, branch, pool.id, round(max(len(list_intersect(asked, list_distinct(span)))) / max(len(asked))::DOUBLE, 6) AS score FROM pool JOIN sp ON sp.id = pool.id JOIN lw ON lw.query = pool.query GROUP BY ALL),
al AS (SELECT method, query, branch, id, score FROM arm UNION ALL SELECT 'hybrid', query, branch, id, score FROM hy UNION ALL SELECT 'hybrid_rerank', query, branch, id, score FROM re),
de AS (SELECT *, row_number() OVER (PARTITION BY method, query, branch ORDER BY score DESC, id) AS depth FROM al)
SELECT method, query, branch, id, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY method, query ORDER BY depth, branch, id) AS INTEGER) AS position FROM de WHERE depth <= 5"""


@query("branch_retrieval", BRANCHES)
def branch_retrieval(spark, sf):
    """Each method within each branch (a language, by its own statistics), then interleaved over branches by depth.

    Methods: lexical, dense, both fused by reciprocal rank, and the fused best 20 ranked again by a scorer of windows.
    """
    from pyspark.sql import Window

    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("branch"), "text")
    first = label_queries(spark, sf).select("query", F.col("qid").alias("id")).join(docs, "id").select("query", "text")
    texts = cut(first, "label-texts")  # as many rows as labels
    branches = docs.select("branch").filter("branch is not null").distinct()
    asked = texts.select("query", bag(F.col("text")).alias("words")).crossJoin(branches)
    best, _ = I.search(spark, corpus_index(spark, sf), asked.select(F.struct("query", "branch").alias("request"), I.scope_of("lang", F.col("branch")).alias("scope"), "words"), 40)
    lexical = best.select("request.query", "request.branch", "id", "score")
    dense = dense_run(spark, sf).join(docs.filter("branch is not null").select("id", "branch"), "id")

    def ranked(rows, k, as_="rank"):
        best = L.top(rows.withColumn("both", F.struct("query", "branch")), k, by="both")
        return best.select("query", "branch", "id", "score", F.col("rank").alias(as_))

    lists = cut(ranked(lexical, 40).withColumn("method", F.lit("bm25")).unionByName(ranked(dense, 40).withColumn("method", F.lit("dense"))), "branch-lists")
    hybrid = lists.groupBy("query", "branch", "id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))
    words = docs.select("id", plain_tokens(F.col("text")).alias("words"))
    again = share_of_words(ranked(hybrid, 20).select("query", "branch", "id"), words, texts.select("query", F.array_distinct(plain_tokens(F.col("text"))).alias("asked")))
    out = lists.filter("rank <= 5").select("method", "query", "branch", "id", F.col("rank").alias("depth"))
    for name, rows in (("hybrid", hybrid), ("hybrid_rerank", again)):
        out = out.unionByName(ranked(rows, 5, "depth").select(F.lit(name).alias("method"), "query", "branch", "id", "depth"))
    place = F.row_number().over(Window.partitionBy("method", "query").orderBy("depth", "branch", "id"))
    return out.withColumn("position", place)

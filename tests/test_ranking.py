"""The best documents and judgements, task by task, against scoring everything."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.catalog import ORACLES, QUERIES
from quarry.operators import evaluation, lexical

WORDS = [f"w{i}" for i in range(12)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    pick = random.Random(5)
    texts = [pick.choices(WORDS, [2**-i for i in range(12)], k=pick.randint(0, 9)) for _ in range(120)] + [None, [], ["z"]]
    rows = [(i, t, pick.choice(["a", "b", None]), None if t is None else " ".join(t), None if i % 4 == 0 else float(i % 3)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, words array<string>, of string, once string, bonus double").repartition(5).localCheckpoint()
    asked = spark.createDataFrame([(q, pick.choices(WORDS, k=q)) for q in range(7)] + [(9, ["nowhere"]), (10, None)], "query long, words array<string>")
    return docs, asked.localCheckpoint()


@pytest.mark.parametrize("k", [1, 3, 500])
@pytest.mark.parametrize("weigh", [False, True])
def test_best_is_the_top_of_all_scores(spark, corpus, k, weigh, monkeypatch):
    docs, asked = corpus
    monkeypatch.setattr(lexical, "BLOCK", 3)
    full = docs.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))  # a text that is missing counts as a document, not in the mean
    want = lexical.top(lexical.bm25(full.filter("id <> 120"), asked, 0.9, 0.4, weigh), k).select("query", "id", "score", "rank")
    got = lexical.best(docs.select("id", "words").filter("id <> 120"), asked, k, 0.9, 0.4, weigh)
    assert rows_of(got) == rows_of(want)


def test_best_apart_once_and_with_what_is_added(spark, corpus, monkeypatch):
    docs, asked = corpus
    docs = docs.filter("id <> 120")
    monkeypatch.setattr(lexical, "HELD", 40)  # a few documents at once
    scored = lexical.bm25(docs.select("id", "words"), asked, 1.5, 0.75).join(docs.select("id", "of", "once", "bonus"), "id")
    want = lexical.top(scored.withColumn("both", F.struct("query", "of")), 2, by="both").select("query", "of", "id", "score", "rank")
    assert rows_of(lexical.best(docs.select("id", "words", "of"), asked, 2, 1.5, 0.75).select("query", "of", "id", "score", "rank")) == rows_of(want)
    single = scored.groupBy("query", "once", "score").agg(F.min("id").alias("id"))
    assert rows_of(lexical.best(docs.select("id", "words", "once"), asked, 4, 1.5, 0.75)) == rows_of(lexical.top(single, 4).select("query", "id", "score", "rank"))
    added = scored.filter("bonus is not null").withColumn("score", F.round(F.col("score") + F.col("bonus"), 6))
    assert rows_of(lexical.best(docs.select("id", "words", "bonus"), asked, 4, 1.5, 0.75)) == rows_of(lexical.top(added, 4).select("query", "id", "score", "rank"))


TEXTS = ["alpha beta gamma nim", None, "", "alpha alpha 7", "beta " * 9 + "alpha", "one two three four five six seven eight nine", "x one two three four five six seven eight", None, "beta " * 9 + "alpha", "because 7 gamma " * 20, "Alpha"]
ASKED = ["alpha beta beta", "one two three four five six seven eight", "nothing here", "gamma because nim", None]
RANKED = "bm25_topk bm25_qtf round_robin_langs scoped_topk_prefilter distinct_body_topk refusal_rate arm_overlap bm25_bonuses selected_passages indexed_hits trec_roundtrip passage_judgements mrr_ndcg_hit metrics_by_subset_grouping_sets binary_ndcg scorecard arm_selection evidence_recall_groups fresh_evaluation".split()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(ASKED)), "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", RANKED)
def test_missing_and_empty_texts_are_counted_as_sql_has_them(spark, odd, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    show = lambda rows: sorted(tuple(f"{float(v):.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(QUERIES[name](spark, odd).select(*columns).collect()) == show(cursor.fetchall())


def test_a_document_is_one_row_between_the_steps_and_a_task_gives_few(spark, odd, monkeypatch):
    written = {}

    def spied(df, name, by=None, real=lexical.cut):
        out = real(df, name, by)
        written[name] = out.count()
        return out

    monkeypatch.setattr(lexical, "cut", spied)
    QUERIES["bm25_topk"](spark, odd)
    assert written["postings"] == len(TEXTS)


def test_shared_grams_are_compared_word_by_word(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK", 2)
    pick = random.Random(3)
    word = lambda n: pick.choices("abc", k=n)
    docs = [(i, w, " ".join(w)) for i, w in enumerate(word(pick.randint(0, 12)) for _ in range(60))] + [(60, None, None)]
    asked = [(i, w, " ".join(w)) for i, w in enumerate(word(n) for n in (0, 2, 3, 4, 6, 8))]
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = [(q, i, 2 if p in t else 1) for i, w, t in docs[:-1] for q, a, p in asked if grams(w) & grams(a)]
    kind = "array<string>, text string"
    got = evaluation.shared_grams(spark.createDataFrame(docs, f"id long, words {kind}").repartition(3), spark.createDataFrame(asked, f"query long, words {kind}"), 3)
    assert rows_of(got) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["hybrid_rrf", "hybrid_typed_boost", "three_list_fusion"])
def test_label_queries_leave_a_row_for_each_document_too(spark, monkeypatch, name):
    written = {}

    def spied(df, name, by=None, real=lexical.cut):
        out = real(df, name, by)
        written[name] = out.count()
        return out

    monkeypatch.setattr(lexical, "cut", spied)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert written["postings"] == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()

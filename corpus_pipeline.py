"""The corpus pipeline: toxic documents out, common lines out, one of each near-duplicate group, repeated passages out, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, with n_chars
following the text. A stage decides over every document that its predecessor kept.

Of every stage: whole texts of any length are read; a null or empty text is an ordinary document, which no stage drops; an empty
table gives an empty result; columns that the stage does not know are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import chunk_dedup, jaccard, line_dedup, pack, toxicity
from quarry.llm.common import cut, free_names, own_columns, prepare, spend, table

#: None: fitting a classifier and packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def _with_text(changed: DataFrame, text: str, docs: DataFrame) -> DataFrame:
    """The columns of docs from changed, with text in the text's place and n_chars counted anew."""
    out = changed.withColumn("text", F.col(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*own_columns(docs))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    Repeated rows and rows with equal texts share a score and a verdict; a null doc_id has no label and is scored like any other.
    """
    prepare(spark)
    sample = toxicity.training_rows(docs, table(spark, sf_dir, "labels"))
    model = toxicity.learn(sample)
    spend(sample)
    return toxicity.score(docs, model).filter(F.col(toxicity.score_name(docs)) < 0.5).select(*own_columns(docs))


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten documents or more share.

    Each row is a document of its own, repeated rows and rows that share a doc_id or have none included. A null text becomes empty.
    """
    prepare(spark)
    return _with_text(line_dedup.drop_common_lines(docs), line_dedup.added_names(docs)[0], docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    A null id comes after all others; of rows with equal ids the one whose text has the smallest hash stays, and of rows with equal
    ids and texts any one. Rows without words are components of their own and all stay.
    """
    prepare(spark)
    rows = jaccard.component_rows(docs, width=5, percent=80).filter("comp is not null")
    found = cut(rows.groupBy("comp", "doc_id", "version").agg(F.count("*").alias("n")), "near-copies")
    keeper = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("k"))
    stays = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("version") == F.col("k.version"))
    doc, version = free_names(docs, "__doc", "__version")
    named = found.join(keeper, "comp").select(F.col("doc_id").alias(doc), F.col("version").alias(version), "n", stays.alias("stays"))
    marked = cut(named.filter("not stays or n > 1"), "near-copies-marked")
    spend(found)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(version))
    left = docs.join(marked.filter("not stays").select(doc, version).hint("merge"), same, "left_anti")
    repeated = marked.filter("stays").select(doc, version)
    if not repeated.isEmpty():
        once = left.join(repeated.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(repeated.hint("merge"), same, "left_anti").unionByName(once)
    return left.select(*own_columns(docs))


def drop_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that a document with a smaller id has.

    Rows that share a doc_id keep their passages from each other; a row without doc_id keeps all; a text that is all copies ends empty.
    """
    prepare(spark)
    return _with_text(chunk_dedup.drop_repeats(docs), "text", docs)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    Repeated rows are packed each for itself; a null text is the one piece that holds the end mark; a null doc_id is carried along.
    """
    prepare(spark)
    pieces = pack.tokenized_pieces(docs)
    return pack.pack(cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("best_fit_packing", pack_sequences),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote goes when the next one has written its own; the last stage reads its pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        spend(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    spend(docs)
    return packed

"""Line dedup: explode normalised lines, hash, count documents per hash, drop lines over a threshold, reassemble by position.

Only hashes are shuffled by line; a text moves at most once, to meet the keys that its own document loses. A line that a
third of the documents share is counted after partial aggregation, and the join that brings the verdict back may be split
by the engine, as it has no aggregate of raw rows above it.

Defined cases: every row is a document of its own, so repeated rows and rows that share a doc_id count separately; null or
empty text is one empty line and has no key to lose; a text of any length is split as a whole; a null doc_id is an ordinary
value, but rows without one are told apart by their texts only; extra columns are kept as they are, whatever their names: where
one is called like an added column, the added one gets underscores at its end (see added_names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, cut, fold_ascii, free_names, own_columns, spend, table


def line_key(line: Column) -> Column:
    return fold_ascii(F.btrim(line, F.lit(SPACE)))


def key_hash(line: Column) -> Column:
    """128 bits of a line's key: no line goes because of another whose 64-bit hash happens to be the same."""
    return F.unhex(F.md5(line_key(line)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def added_names(docs: DataFrame) -> list[str]:
    """What drop_common_lines calls its kept text, number of lines and number of dropped lines for these docs."""
    return free_names(docs, "kept_text", "n_lines", "n_dropped")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped added; lines whose key is in min_docs documents or more are gone.

    A text moves only to meet the keys that its own document loses; documents are told apart by doc_id and the hash of the text.
    """
    text, n_lines, n_dropped = added_names(docs)
    lines, lost, doc, version = free_names(docs, "__lines", "__lost", "__doc", "__version")
    long_enough = F.filter(lines, lambda x: F.char_length(F.btrim(x, F.lit(SPACE))) >= min_points)
    keyed = docs.select(F.col("doc_id").alias(doc), F.xxhash64("text").alias(version), lines_of(F.col("text")).alias(lines))
    hashed = cut(keyed.select(doc, version, F.explode(F.array_distinct(F.transform(long_enough, key_hash))).alias("key")), "line-keys")
    common = hashed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("key")
    common = cut(common, "line-common")
    # merge joins at every size: a hot key's rows can be split, and the plan does not change as tables outgrow a broadcast
    losses = cut(hashed.join(common.hint("merge"), "key").groupBy(doc, version).agg(F.collect_set("key").alias(lost)), "line-losses")
    spend(hashed, common)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(version))
    joined = docs.join(losses.hint("merge"), same, "left").withColumn(lines, lines_of(F.col("text")))
    stays = F.filter(lines, lambda x: (F.char_length(F.btrim(x, F.lit(SPACE))) < min_points) | ~F.array_contains(lost, key_hash(x)))
    kept = F.when(F.col(lost).isNull(), F.col(lines)).otherwise(stays)
    return (
        joined.withColumn("kept" + lines, kept)
        .withColumn(text, F.array_join("kept" + lines, "\n"))
        .withColumn(n_lines, F.size(lines).cast("long"))
        .withColumn(n_dropped, (F.size(lines) - F.size("kept" + lines)).cast("long"))
        .select(*own_columns(docs), text, n_lines, n_dropped)
    )


def op4_line_dedup(spark, sf_dir):
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT row, doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.k = c.k
GROUP BY row, doc_id
"""

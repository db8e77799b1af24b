"""Functions on hand-written rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarry.functions import numbers as N
from quarry.functions import text as X


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_strict_numbers(spark):
    texts = ["1,234.5", "(1,234)", "12%", "-", "", "908,812)", "1 234", "-7", "1,23", None]
    assert values(spark, texts, N.parse_number) == [Decimal("1234.5"), Decimal(-1234), Decimal(12), None, None, None, None, Decimal(-7), None, None]


def test_classes(spark):
    texts = ["1,234", "( 12 )%", "5 and 6", "", " ", "-", "n/a", "908,812)"]
    assert values(spark, texts, N.classify) == ["numeric_scalar", "numeric_scalar", "uncheckable_numeric_text", "empty", "empty", "placeholder_not_zero", "non_numeric_text", "uncheckable_numeric_text"]


def test_column_dates(spark):
    texts = ["30 Jun 25", "Sep 2025", "Feb 24", "Jun 25 vs Jun 24 %", "total", "31 Feb 24"]
    got = values(spark, texts, N.column_date)
    assert got[:5] == ["2025-06-30", "2025-09-30", "2024-02-29", None, None]


def test_number_sets(spark):
    assert values(spark, ["rose 1,200 to (30) and 1,200.0"], N.number_set) == [[Decimal(-30), Decimal(1200)]]


@pytest.mark.parametrize("value,shown", [("1234567.5", "1,234,567.5"), ("-1000", "-1,000"), ("999", "999"), ("0.05", "0.05")])
def test_thousands(spark, value, shown):
    assert values(spark, [value], lambda c: N.thousands(c.cast("decimal(20,4)"))) == [shown]


def test_tokens(spark):
    assert values(spark, ["NIM rose 1.5 in FY24"], X.tokens) == [["nim", "rose", "1.5", "in", "fy24", "net", "interest", "margin"]]
    assert values(spark, ["CET1 up"], X.norm) == ["cet 1 up"]
    assert values(spark, ["The investing GenAI strategies banks"], X.stem_words) == [["invest", "generative", "ai", "strategy", "bank"]]
    assert values(spark, ["a b a b c"], lambda c: X.ngrams(F.split(c, " "), 2)) == [["a b", "b a", "b c"]]


def test_label_key(spark):
    assert values(spark, ["Net profit² (cash basis), total"], X.label_key) == ["netprofittotal"]

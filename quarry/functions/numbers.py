"""Numeric text: strict parsing, classes of cells, number sets, column dates, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import ascii_words

#: Numeric grammars. Blank and dash are never zero.
STRICT = "^(-?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?|[(]([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?[)])%?$"
LOOSE = "^(([-+\u2212][ \\t\u00a0]?)?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)([.][0-9]+)?[ \\t\u00a0]*%?|[(][ \\t\u00a0]*([0-9]{1,3}(,[0-9]{3})+|[0-9]+)([.][0-9]+)?[ \\t\u00a0]*%?[ \\t\u00a0]*[)][ \\t\u00a0]*%?)$"
SIGNED = "[(][0-9][0-9,]*(?:[.][0-9]+)?[)]|[-+]?[0-9][0-9,]*(?:[.][0-9]+)?"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNITS = {"AUD million": ("AUD", "1000000"), "AUD billion": ("AUD", "1000000000"), "AUD": ("AUD", "1"), "cents/share": ("AUD/share", "0.01"), "AUD/share": ("AUD/share", "1"), "percent": ("percent", "1")}


def parse_number(text: Column) -> Column:
    """decimal(20,4) of a strict literal, null of anything else."""
    t = F.btrim(text)
    bare = F.regexp_replace(t, "[%,()]", "")
    value = F.expr("null").cast("decimal(20,4)")
    signed = F.when(t.startswith("("), F.concat(F.lit("-"), bare)).otherwise(bare)
    return F.when(t.rlike(STRICT), signed.try_cast("decimal(20,4)")).otherwise(value)


def classify(text: Column) -> Column:
    t = F.btrim(text)
    return (
        F.when(t.rlike(LOOSE) & (F.length(t) - F.length(F.regexp_replace(t, "%", "")) <= 1), "numeric_scalar")
        .when(t.rlike("[0-9]"), "uncheckable_numeric_text")
        .when(t == "", "empty")
        .when(t.isin("-", "\u2013", "\u2014"), "placeholder_not_zero")
        .otherwise("non_numeric_text")
    )


def loose_number(text: Column) -> tuple[Column, Column]:
    """(decimal(20,4) or null, whether a percentage) of a cell by the looser grammar: a sign apart, a unicode minus, a percent sign in or out of parentheses."""
    t = F.btrim(text)
    bare = F.regexp_replace(t, "[^0-9.]", "").try_cast("decimal(20,4)")
    percent = F.contains(text, F.lit("%"))
    once = F.length(text) - F.length(F.regexp_replace(text, "%", "")) <= 1
    return F.when(t.rlike(LOOSE) & once, F.when(t.rlike("^[-(\u2212]"), -bare).otherwise(bare)), percent


def number_set(text: Column) -> Column:
    """Distinct signed numbers in prose as normalised decimals, sorted."""
    raw = F.regexp_extract_all(text, F.lit(SIGNED), F.lit(0))

    def value(x):
        bare = F.regexp_replace(x, "[,()+]", "")
        return F.when(x.startswith("("), F.concat(F.lit("-"), bare)).otherwise(bare).try_cast("decimal(38,6)")

    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, value), lambda v: v.isNotNull())))


def column_date(text: Column) -> Column:
    """ISO date of a column header such as `30 Jun 25` or `Sep 2025` (then the month's last day); null of comparisons."""
    form = "(?:([0-9]{1,2}) +)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* +(20[0-9]{2}|[0-9]{2})\\b"
    low = F.lower(text)
    day, month, year = (F.regexp_extract(low, ascii_words(form), i) for i in (1, 2, 3))
    number = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, 1):
        number = F.when(month == m, i).otherwise(number)
    full = F.when(F.length(year) == 2, year.try_cast("int") + 2000).otherwise(year.try_cast("int"))
    first = F.try_make_date(full, number, F.lit(1)) if hasattr(F, "try_make_date") else F.make_date(full, number, F.lit(1))
    date = F.when(day == "", F.last_day(first)).otherwise(F.date_add(first, day.try_cast("int") - 1))
    return F.when(low.rlike(ascii_words("\\bvs?\\b|%")) | (month == ""), F.lit(None).cast("string")).otherwise(F.date_format(date, "yyyy-MM-dd"))


def unit_scale(unit: Column) -> tuple[Column, Column]:
    """(dimension, scale) of a unit name; nulls for an unknown one."""
    dimension, scale = F.lit(None).cast("string"), F.lit(None).cast("decimal(20,4)")
    for name, (d, s) in UNITS.items():
        dimension = F.when(unit == name, d).otherwise(dimension)
        scale = F.when(unit == name, F.lit(s).cast("decimal(20,4)")).otherwise(scale)
    return dimension, scale


def thousands(value: Column) -> Column:
    """A decimal with thousands separators and as many decimals as it has, none rounded."""
    text = F.abs(value).cast("string")
    whole, rest = F.regexp_extract(text, "^([0-9]+)", 1), F.regexp_extract(text, "([.][0-9]*?)0*$", 1)
    grouped = F.reverse(F.regexp_replace(F.regexp_replace(F.reverse(whole), "([0-9]{3})", "$1,"), ",$", ""))
    return F.concat(F.when(value < 0, "-").otherwise(""), grouped, F.when(rest == ".", "").otherwise(rest))

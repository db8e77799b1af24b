"""Rules over a question's texts that read the same as a column and as SQL.

A Test holds for a row or not; Tests combine with &, | and ~. first() is an ordered cascade, every() the list of all that hold. Each
gives a Column for Spark and an expression for DuckDB, so one rule table serves the query and its oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import ascii_words


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Test:
    column: Callable[[], Column]
    sql: str

    def __and__(self, other: Test) -> Test:
        return Test(lambda: self.column() & other.column(), f"({self.sql} AND {other.sql})")

    def __or__(self, other: Test) -> Test:
        return Test(lambda: self.column() | other.column(), f"({self.sql} OR {other.sql})")

    def __invert__(self) -> Test:
        return Test(lambda: ~self.column(), f"(NOT {self.sql})")


def has(pattern: str, of: str = "s") -> Test:
    """The text column `of` matches the pattern somewhere. Patterns use what Java and RE2 read alike."""
    return Test(lambda: F.col(of).rlike(ascii_words(pattern)), f"regexp_matches({of}, {quoted(pattern)})")


def among(name: str, of: str = "tags") -> Test:
    """The array column `of` holds the name."""
    return Test(lambda: F.array_contains(F.col(of), name), f"list_contains({of}, {quoted(name)})")


def size(of: str, compare: str, n: int) -> Test:
    """The array column `of` has a size that compares (=, >, <) with n."""
    test = {"=": lambda: F.size(of) == n, ">": lambda: F.size(of) > n, "<": lambda: F.size(of) < n}[compare]
    return Test(test, f"len({of}) {compare} {n}")


def anyof(tests) -> Test:
    out, *rest = tests
    for t in rest:
        out = out | t
    return out


@dataclass(frozen=True)
class Value:
    column: Callable[[], Column]
    sql: str


def first(arms: list[tuple[str, Test]], default: str | None = None) -> Value:
    """The name of the first test that holds."""

    def column() -> Column:
        out = F.lit(default).cast("string")
        for name, test in reversed(arms):
            out = F.when(test.column(), name).otherwise(out)
        return out

    cases = " ".join(f"WHEN {t.sql} THEN {quoted(n)}" for n, t in arms)
    return Value(column, f"CASE {cases} ELSE {'NULL' if default is None else quoted(default)} END")


def every(arms: list[tuple[str, Test]]) -> Value:
    """The names of all tests that hold, in their order."""
    cases = ", ".join(f"CASE WHEN {t.sql} THEN {quoted(n)} END" for n, t in arms)
    return Value(lambda: F.array_compact(F.array(*[F.when(t.column(), F.lit(n)) for n, t in arms])), f"list_filter([{cases}], lambda z: z IS NOT NULL)")


def flag(test: Test) -> Value:
    return Value(test.column, test.sql)


def found(pattern: str, of: str, group: int = 0) -> Value:
    """All matches (of a group), in order."""
    return Value(lambda: F.regexp_extract_all(of, F.lit(ascii_words(pattern)), F.lit(group)), f"regexp_extract_all({of}, {quoted(pattern)}, {group})")


def changed(of: str, *steps: tuple[str, str]) -> Value:
    """The text after replacing every match of each pattern in turn; a replacement names groups as $1."""

    def column() -> Column:
        out = F.col(of)
        for pattern, by in steps:
            out = F.regexp_replace(out, ascii_words(pattern), by)
        return out

    sql = of
    for pattern, by in steps:
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(by.replace('$', chr(92)))}, 'g')"
    return Value(column, sql)

"""Text functions as column expressions; every one stays in the JVM and has a DuckDB twin in the catalogue."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations and the words that a search for them also means.
ALIASES = {"nim": "net interest margin", "npat": "net profit after tax", "eps": "earnings per share", "dps": "dividend per share", "cet1": "common equity tier 1", "lcr": "liquidity coverage ratio"}
#: Word beginnings that stand for one stem.
STEMS = {"invest": "invest", "strateg": "strategy", "priorit": "priority", "technolog": "technology", "modernis": "modern", "moderniz": "modern", "digit": "digital"}
#: Words without weight in prose search.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: Patterns that mean the same in Java, RE2 and Python.
TOKEN = "[a-z]+[0-9]*|[0-9]+(?:[.,][0-9]+)*"
PLAIN_TOKEN = "[a-z0-9]+"
RUN = "[a-z]+|[0-9]+"
#: Between a letter, digit or underscore of ASCII and anything else. Java's own boundary takes all letters of Unicode for parts of a word, SQL's does not.
BOUNDARY = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"


def ascii_words(pattern: str) -> str:
    """The pattern with word boundaries that Java finds where SQL finds them, in texts of any language."""
    return pattern.replace("\\b", BOUNDARY)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    """Words with digits and numbers with separators, then the words that abbreviations stand for."""
    plain = found(text, TOKEN)
    expanded = F.flatten(F.transform(F.filter(plain, lambda t: t.isin(*ALIASES)), lambda t: F.split(_pick(t, ALIASES), " ")))
    return F.concat(plain, expanded)


def bag(text: Column) -> Column:
    """The same words as tokens() has, abbreviations followed by what they stand for: for ranking, where order does not matter; none for a null."""
    out = lambda t: F.when(t.isin(*ALIASES), F.split(F.concat(t, F.lit(" "), _pick(t, ALIASES)), " ")).otherwise(F.array(t))
    return F.flatten(F.transform(F.coalesce(found(text, TOKEN), F.array().cast("array<string>")), out))


def bag_counts(lowered: str) -> Counter:
    """What bag() has, counted, in plain Python for tasks that hold whole texts."""
    out = Counter(re.findall(TOKEN, lowered))
    for short, meaning in ALIASES.items():
        if n := out.get(short):
            for word in meaning.split():
                out[word] += n
    return out


def plain_counts(lowered: str) -> Counter:
    """What plain_tokens() has, counted."""
    return Counter(re.findall(PLAIN_TOKEN, lowered))


def _pick(t: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(t == k, v).otherwise(out)
    return out


def plain_tokens(text: Column) -> Column:
    return found(text, PLAIN_TOKEN)


def norm(text: Column) -> Column:
    """Runs of letters and runs of digits, space-joined: cet1 becomes cet 1."""
    return F.array_join(found(text, RUN), " ")


def stem(t: Column) -> Column:
    out = F.when(t.endswith("s") & (F.length(t) > 4), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)
    for beginning, meaning in reversed(STEMS.items()):
        out = F.when(t.startswith(beginning), F.lit(meaning)).otherwise(out)
    return out


def stem_words(text: Column) -> Column:
    """Alphabetic words without stop words, stemmed; genai is two words."""
    kept = F.filter(found(text, "[a-z]+"), lambda t: ~t.isin(*STOP))
    return F.flatten(F.transform(kept, lambda t: F.when(t == "genai", F.array(F.lit("generative"), F.lit("ai"))).otherwise(F.array(stem(t)))))


def squash(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))


def ngrams(words: Column, width: int) -> Column:
    """Distinct word n-grams."""
    n = F.size(words) - (width - 1)
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(n >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def gram_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of the word n-grams, repeats included, empty for fewer words than width. The last two bits are the width (3 at most, 0 for more)."""
    n = F.size(words) - (width - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, width)).bitwiseAND(F.lit(-4)) + (width if width < 4 else 0))
    return F.when(n >= 1, grams).otherwise(F.array().cast("array<bigint>"))


def label_key(text: Column) -> Column:
    """A label without superscripts, parentheses and anything but letters and digits, for row matching."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(text, "¹²³⁰⁴⁵⁶⁷⁸⁹", "")), "\\([^()]*\\)", ""), "[^a-z0-9]+", "")


def compact(text: Column) -> Column:
    """Compatibility form, no white space, case folded."""
    import pandas as pd

    def run(values):
        import unicodedata

        return values.map(lambda v: None if v is None else "".join(unicodedata.normalize("NFKC", v).split()).casefold())

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}  # the engine reads these, and this module's are texts
    return F.pandas_udf(run, "string")(text)

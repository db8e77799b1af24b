"""The element tree of pages: every element with its number, the last number inside it, its parent and its path.

Numbers count from 0 in reading order, so an element is inside another if its number lies between the other's and the other's last: an
ancestor test is an interval join on the page. Pages are read batch by batch; nothing leaves the task of its page but rows.

Rules, a part of the standard's: void elements hold nothing; scripts and styles hold text only; a start tag ends what CLOSES says, as far
up as its barrier; an end tag closes the innermost element of its name and all inside it, and is ignored where none is open.
Null and empty pages have no elements; what a cut page leaves open ends with the page.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and rules of the HTML standard.
VOID = "area base br col embed hr img input link meta source track wbr".split()
RAW = ("script", "style")
BLOCK = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
#: For start tags: the elements that they end, and the elements that these are not looked for beyond.
CLOSES = {
    **{tag: (("p",), ("table", "td", "th", "caption", "button")) for tag in BLOCK},
    "li": (("li", "p"), ("ul", "ol", "table")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
#: Comments, raw elements whole, and tags. {end}: how the engine writes the end of the text.
TOKEN = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b{_ATTRIBUTES}>.*?(?:</{t}\s*>|{{end}})" for t in RAW) + rf"|</?[a-z][a-z0-9]*\b{_ATTRIBUTES}>"
_TOKEN = re.compile(TOKEN.replace("{end}", r"\Z"))
_NAME = re.compile("</?([a-zA-Z][a-zA-Z0-9]*)")


def tree(html: str) -> tuple[list[str], list[int], list[int], list[str]]:
    """Tags, parents (-1: none), last numbers inside, and paths of the elements of a page."""
    tags, parents, last, paths, stack = [], [], [], [], []

    def leave(depth: int):
        for n in stack[depth:]:
            last[n] = len(tags) - 1
        del stack[depth:]

    for found in _TOKEN.finditer(html):
        token = found.group()
        if token.startswith("<!"):
            continue
        tag = _NAME.match(token).group(1).lower()
        if token.startswith("</"):
            depth = next((d for d in range(len(stack) - 1, -1, -1) if tags[stack[d]] == tag), None)
            if depth is not None:
                leave(depth)
            continue
        ends, barrier = CLOSES.get(tag, ((), ()))
        if ends:
            above = next((d + 1 for d in range(len(stack) - 1, -1, -1) if tags[stack[d]] in barrier), 0)
            leave(next((d for d in range(above, len(stack)) if tags[stack[d]] in ends), len(stack)))
        parent = stack[-1] if stack else -1
        parents.append(parent)
        paths.append(f"{paths[parent]}/{tag}" if stack else tag)
        tags.append(tag)
        last.append(len(tags) - 1)
        if tag not in VOID and tag not in RAW:
            stack.append(len(tags) - 1)
    leave(0)
    return tags, parents, last, paths


def _batches(batches):
    for batch in batches:
        ids, columns = [], ([], [], [], [], [])
        for k, html in enumerate(batch.column(1).to_pylist()):
            tags, parents, last, paths = tree(html or "")
            ids.append(np.full(len(tags), k))
            for column, values in zip(columns, (range(len(tags)), last, parents, tags, paths)):
                column.extend(values)
        if columns[0]:
            types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), *(pa.array(c, t) for c, t in zip(columns, types))], names=["page_id", "node", "last", "parent", "tag", "path"])


def elements(pages: DataFrame) -> DataFrame:
    """page_id, node, last, parent (null at the top), tag and path of every element of pages (page_id, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_batches, "page_id long, node int, last int, parent int, tag string, path string")
    return rows.withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))


def within(nodes: DataFrame, inner: list[str], outer: list[str]) -> DataFrame:
    """page_id, node, tag, path of the elements named inner, with around: the elements named outer that each lies in, outermost first."""
    blocks = nodes.filter(F.col("tag").isin(inner)).select("page_id", "node", "tag", "path")
    holders = nodes.filter(F.col("tag").isin(outer)).select(F.col("page_id").alias("page"), F.col("node").alias("first"), "last", F.col("tag").alias("holder"))
    met = blocks.join(holders, (F.col("page_id") == F.col("page")) & (F.col("node") > F.col("first")) & (F.col("node") <= F.col("last")), "left")
    around = F.array_sort(F.collect_list(F.when(F.col("holder").isNotNull(), F.struct("first", "holder"))))["holder"]
    return met.groupBy("page_id", "node", "tag", "path").agg(around.alias("around"))

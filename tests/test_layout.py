"""Element trees against the standard library's parser, boxes against brute force, contexts against a fold in plain Python."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quarry.operators import boxes, context, elements

PAGES = [
    (1, "<body><nav><ul><li><a>x</a><li>y<ul><li>z</ul></ul></nav><article><p>a<p>b<div>c<p>d</div></p>e</article></body>"),
    (2, "<table><tr><td><p>1<td>2<tr><th>3</table><p>after"),
    (3, "<!-- <p>no</p> --><script>if (a < b) '<p>'</script><style>p{}</style><img src='>'><br/><p title=\"a>b\">t"),
    (4, "</p></div><P>Big<H2>Two</h2></P><b><i>crossed</b></i><p>"),
    (5, "<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select><p>cut <a hre"),
    (6, ""),
    (7, None),
    (8, "no tags < at all > &amp;"),
    (9, "<ul><li><table><tr><td><li>in a cell</table><li>out"),
]


class Standard(HTMLParser):
    """The tree by the standard library's tokens, elements as (tag, parent, all inside)."""

    def __init__(self, html):
        super().__init__()
        self.open, self.found = [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        ends, barrier = elements.CLOSES.get(tag, ((), ()))
        within = []
        for n in reversed(self.open):
            if self.found[n][0] in barrier:
                break
            within.append(n)
        ended = [n for n in within if self.found[n][0] in ends]
        if ended:
            del self.open[self.open.index(min(ended)):]
        for n in self.open:
            self.found[n][2].append(len(self.found))
        self.found.append((tag, self.open[-1] if self.open else None, []))
        if tag not in elements.VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        named = [n for n in self.open if self.found[n][0] == tag]
        if named:
            del self.open[self.open.index(named[-1]):]


def standard(pages):
    rows = set()
    for page, html in pages:
        found = Standard(html or "").found
        for n, (tag, parent, inside) in enumerate(found):
            up, path = parent, [tag]
            while up is not None:
                path.append(found[up][0])
                up = found[up][1]
            rows.add((page, n, max(inside, default=n), parent, tag, "/".join(reversed(path))))
    return rows


def test_elements_as_the_standard_parser_has_them(spark):
    rows = spark.createDataFrame(PAGES, "page_id long, html string")
    assert {tuple(r) for r in elements.elements(rows).collect()} == standard(PAGES)


def test_elements_of_all_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert {tuple(r) for r in elements.elements(rows).collect()} == standard([(r.page_id, r.html) for r in rows.select("page_id", "html").collect()])


def test_elements_within(spark):
    nodes = elements.elements(spark.createDataFrame(PAGES, "page_id long, html string"))
    got = {(r.page_id, r.node): r.around for r in elements.within(nodes, ["li"], ["nav", "ul"]).collect()}
    assert got[(1, 3)] == ["nav", "ul"] and got[(1, 7)] == ["nav", "ul", "ul"] and got[(9, 1)] == ["ul"]


def test_elements_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    assert elements.within(elements.elements(none), ["p"], ["nav"]).count() == 0


# boxes


def smallest(points, held):
    out = {}
    for x, y in points:
        fit = [((x1 - x0) * (y1 - y0), i) for i, x0, y0, x1, y1 in held if x0 <= x <= x1 and y0 <= y <= y1]
        if fit:
            out[x, y] = min(fit)[1]
    return out


def boxed(spark, points, held):
    p = spark.createDataFrame(points, "x double, y double")
    b = spark.createDataFrame(held, "id long, x0 double, y0 double, x1 double, y1 double")
    return {(r.x, r.y): r.box.id for r in boxes.smallest_box(p, b).collect()}


@pytest.mark.parametrize("least", [1, 20, 10**6])
def test_boxes_as_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(boxes, "LEAST", least)
    r = random.Random(least)
    points = [(r.random() * 100, r.random() * 100) for _ in range(200)] + [(50 + r.random() / 1000, 50 + r.random() / 1000) for _ in range(300)]
    points += [(float(r.randrange(5)), float(r.randrange(5))) for _ in range(100)]  # repeated places, on the sides of boxes
    held = [(k, x := r.uniform(-10, 100), y := r.uniform(-10, 100), x + r.random() * 20, y + r.random() * 20) for k in range(150)]
    held += [(1000 + k, float(k % 3), 0.0, float(k % 3 + 2), 4.0) for k in range(12)]  # ties of area
    held += [(2000, -1e9, -1e9, 1e9, 1e9), (2001, 2.0, 2.0, 2.0, 2.0), (2002, 0.0, 0.0, 100.0, 100.0), (2003, 50.0, 50.0, 50.0005, 50.0005)]
    assert boxed(spark, points, held) == smallest(points, held)


@pytest.mark.parametrize("points, stretch", [(7, 2), (1 << 15, 32)])
def test_a_leaf_gives_a_row_for_each_point(monkeypatch, points, stretch):
    """However many boxes hold a point, the leaf keeps no pair of the two."""
    import pyarrow as pa

    monkeypatch.setattr(boxes, "POINTS", points)
    monkeypatch.setattr(boxes, "STRETCH", stretch)
    r = random.Random(points)
    at = [(float(x), float(y)) for x, y in {(r.randrange(12), r.randrange(12)) for _ in range(90)}]
    held = [(k, x := float(r.randrange(10)), y := float(r.randrange(10)), x + r.randrange(5), y + r.randrange(5)) for k in range(70)]
    r.shuffle(held)
    rows = [{"x0": x0, "y0": y0, "x1": x1, "y1": y1, "box": {"area": (x1 - x0) * (y1 - y0), "id": i}} for i, x0, y0, x1, y1 in held]
    got = boxes._first_box(pa.Table.from_pylist([{"x": x, "y": y} for x, y in at]), pa.Table.from_pylist(rows)).to_pylist()
    assert len(got) == len(smallest(at, held)) and {(g["x"], g["y"]): g["box"]["id"] for g in got} == smallest(at, held)


def test_boxes_that_hold_nothing(spark):
    inf, nan = float("inf"), float("nan")
    points = [(1.0, 1.0), (None, 1.0), (nan, 1.0), (inf, 1.0)]
    held = [(1, 2.0, 0.0, 0.0, 2.0), (2, None, 0.0, 9.0, 9.0), (3, -inf, 0.0, 9.0, 9.0), (4, 0.0, 0.0, 3.0, nan)]
    assert boxed(spark, points, held) == {}
    assert boxed(spark, points, [*held, (5, 0.0, 0.0, 2.0, 2.0)]) == {(1.0, 1.0): 5}
    assert boxed(spark, [], [(1, 0.0, 0.0, 1.0, 1.0)]) == {} and boxed(spark, [(1.0, 1.0)], []) == {}


def test_boxes_over_a_wide_range(spark):
    points = [(-1.7e308, 0.0), (1.7e308, 0.0), (1e-300, 0.0), (0.0, 0.0)]
    held = [(1, -1.0, -1.0, 1.0, 1.0), (2, 1e308, 0.0, 1.7e308, 0.0)]
    assert boxed(spark, points, held) == {(0.0, 0.0): 1, (1e-300, 0.0): 1, (1.7e308, 0.0): 2}


def test_no_cell_is_crowded():
    r = random.Random(5)
    import numpy as np

    x, y = (np.array([r.random() ** 6 for _ in range(20_000)]) for _ in range(2))
    grid = boxes.Grid([x.min(), y.min(), x.max(), y.max()])
    codes, limit = grid.codes(x, y), 100
    grid.split = []
    for k in range(boxes.LEVELS):
        cells, n = np.unique(codes >> 2 * (boxes.LEVELS - k), return_counts=True)
        grid.split.append(cells[n > limit])
    assert np.unique(grid.leaves(codes), return_counts=True)[1].max() <= limit


# contexts

SCHEMA = "request long, stage int, place int, id string, units array<int>, size long, barred boolean"


def folded(events, budget):
    kept, left = [], []
    for stage, _, name, units, size, barred in sorted(events, key=lambda e: e[:3]):
        units = units or []
        if stage == 3:
            if set(units) <= {u for r in kept for u in r[1]}:
                continue
            trial, put = [], False
            for r in kept:
                if r[1] and set(r[1]) <= set(units):
                    trial += [] if put else [(name, units, size)]
                    put = True
                else:
                    trial.append(r)
            trial += [] if put else [(name, units, size)]
        else:
            if any(r[0] == name for r in kept):
                continue
            trial = [*kept, (name, units, size)]
        if barred:
            left.append((name, "quarantine"))
        elif sum(r[2] for r in trial) > budget:
            left.append((name, "budget"))
        else:
            kept = trial
    return [r[0] for r in kept], left, sum(r[2] for r in kept)


CASES = {
    "an item too large is skipped and the next one tried": [(1, 1, "a", [1], 6, False), (1, 2, "b", [2], 9, False), (1, 3, "c", [3], 4, False)],
    "order decides": [(1, 1, "c", [3], 4, False), (1, 2, "b", [2], 6, False), (1, 3, "a", [1], 6, False)],
    "a parent replaces both of its children where the first stood": [(1, 1, "a", [1], 3, False), (1, 2, "x", [9], 2, False), (1, 3, "b", [2], 3, False), (3, 1, "p", [1, 2, 4], 8, False)],
    "a parent too large": [(1, 1, "a", [1], 3, False), (3, 1, "p", [1, 2], 11, False), (3, 2, "p", [1, 2], 11, False)],
    "a parent that is covered": [(1, 1, "a", [1], 3, False), (1, 2, "b", [2], 3, False), (3, 1, "p", [1, 2], 6, False)],
    "a parent none of whose children fitted": [(1, 1, "a", [1], 20, False), (3, 1, "p", [1, 2], 10, False)],
    "barred wins": [(1, 1, "a", [1], 30, True), (2, 1, "n", [2], 3, False), (3, 1, "p", [1, 2], 4, True)],
    "repeated hits and notes": [(1, 1, "a", [1], 3, False), (1, 2, "a", [1], 3, False), (2, 1, "a", [1], 3, False)],
    "without units": [(1, 1, "a", None, 3, False), (3, 1, "p", [1], 3, None), (3, 2, "q", [], 3, False)],
}


def test_folds_as_plain_python(spark):
    cases = list(CASES.values())
    r = random.Random(3)
    for _ in range(60):
        hits = [(1, k, f"t{t}", [t], 1 + t % 5, t % 11 == 7) for k, t in enumerate(r.sample(range(24), 6))]
        notes = [(2, k, f"t{e[3][0] + 1}", [e[3][0] + 1], 2, False) for k, e in enumerate(hits)]
        cases.append(hits + notes + [(3, k, f"p{e[3][0] // 3}", [e[3][0] // 3 * 3 + d for d in range(3)], 5 + e[3][0] % 4, False) for k, e in enumerate(hits)])
    rows = spark.createDataFrame([(n, *e) for n, events in enumerate(cases) for e in r.sample(events, len(events))], SCHEMA)
    got = {x.request: ([k.id for k in x.kept], [tuple(o) for o in x.left], x.used) for x in context.fold(rows.repartition(5), ["request"], 10).collect()}
    for n, events in enumerate(cases):
        assert got[n] == folded(events, 10), events
    assert got[1] != got[0] and got[2][0] == ["p", "x"]


def test_no_events(spark):
    assert context.fold(spark.createDataFrame([], SCHEMA), ["request"], 10).count() == 0


def test_scopes_take_turns(spark):
    hits = spark.createDataFrame([(1, "a", d, f"a{d}") for d in (1, 2, 3)] + [(1, "b", 1, "b1"), (2, "c", 2, "c2")], "request long, scope string, depth int, id string")
    got = context.zipped(hits, ["request"], "scope", "depth").orderBy("request", "place").select(F.collect_list("id")).first()[0]
    assert sorted(got) == sorted(["a1", "b1", "a2", "a3", "c2"])
    assert [r.id for r in context.zipped(hits, ["request"], "scope", "depth").filter("request = 1").orderBy("place").collect()] == ["a1", "b1", "a2", "a3"]

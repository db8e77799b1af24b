"""Streams: restarts, replays, corruption, late and interleaved turns, expiry."""

import datetime as dt
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.catalog import ORACLES, QUERIES
from quarry.scratch import scoped
from quarry.streaming import extraction, turns, vector_store
from quarry.streaming.files import drain, stream_of
from quarry.streaming.vector_store import Refused, Store, append, load, verified


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


# vectors by content


def encoder(seen):
    def encode(texts):
        seen.append(sorted(r.text for r in texts.collect()))
        return texts.select("content_hash", F.array(F.char_length("text").cast("long")).alias("vector"))

    return encode


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text string")


@pytest.fixture
def store(spark, tmp_path):
    return Store("file://" + str(tmp_path / "store"), "array<long>")


def test_only_new_texts_are_computed_and_a_replay_adds_nothing(spark, store):
    seen = []
    encode = encoder(seen)
    assert load(spark, store).collect() == []
    assert append(store, "s", texts(spark, "a", "bb", "a", None), 0, encode)
    assert append(store, "s", texts(spark, "bb", "ccc", ""), 1, encode)
    assert append(store, "other", texts(spark, "ccc", "dddd"), 0, encode)  # a batch number is its stream's own
    assert seen == [["", "a", "bb"], ["ccc"], ["dddd"]]
    before = as_set(load(spark, store))
    assert not append(store, "s", texts(spark, "bb", "ccc", ""), 1, encode) and len(seen) == 3
    assert as_set(load(spark, store)) == before and len(before) == 5
    assert [tuple(r) for r in verified(spark, store).orderBy("part").collect()] == [(0, 3, True), (1, 1, True), (2, 1, True)]


def test_a_part_without_a_commit_is_written_anew(spark, store):
    def broken(rows):
        encoder([])(rows).write.parquet(f"{store.folder}/parts/part=0")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        append(store, "s", texts(spark, "a"), 0, broken)
    assert load(spark, store).collect() == []
    seen = []
    assert append(store, "s", texts(spark, "a", "b"), 0, encoder(seen)) and seen == [["a", "b"]]
    assert load(spark, store).count() == 2


def test_corruption_is_refused_and_the_sound_prefix_named(spark, store):
    for k in range(3):
        append(store, "s", texts(spark, f"text {k}"), k, encoder([]))
    (part,) = glob.glob(store.folder[7:] + "/parts/part=1/*.parquet")
    whole = open(part, "rb").read()
    with open(part, "wb") as f:
        f.write(whole.replace(whole[20:24], bytes(x ^ 1 for x in whole[20:24]), 1))
    for crc in glob.glob(os.path.dirname(part) + "/.*.crc"):
        os.remove(crc)
    with pytest.raises(Refused, match="part 1"):
        load(spark, store)
    assert [r.sound for r in verified(spark, store).orderBy("part").collect()] == [True, False, False]
    with open(part, "wb") as f:
        f.write(whole)
    assert load(spark, store).count() == 3
    (commit,) = glob.glob(store.folder[7:] + "/commits/000000000000/*.json")
    row = open(commit).read()
    with open(commit, "w") as f:
        f.write(row.replace('"rows":1', '"rows":2'))
    for crc in glob.glob(os.path.dirname(commit) + "/.*.crc"):
        os.remove(crc)
    with pytest.raises(Refused, match="part 0"):
        append(store, "s", texts(spark, "more"), 9, encoder([]))  # the chain alone shows it


def test_store_as_the_sink_of_a_stream(spark, store, tmp_path):
    come, seen = str(tmp_path / "come"), []
    for part in (["a", "b"], ["b", "c"], []):
        texts(spark, *part).coalesce(1).write.mode("append").parquet(come)
        drain(stream_of(spark, come, "text string").writeStream.foreachBatch(vector_store.sink(store, "s", encoder(seen))), str(tmp_path / "checkpoint"))
    assert seen[:2] == [["a", "b"], ["c"]] and load(spark, store).count() == 3


# pages


GOOD = "<html><head><title>T &amp; U</title><script>var x = '<p>'</script></head><body><h1>H</h1><p>a<p>b<a href='/x'>x</a><a name=y>y</a></body></html>"


def pages(spark, path, rows):
    spark.createDataFrame([(i, "u", h) for i, h in rows], extraction.PAGES).coalesce(1).write.mode("append").parquet(path)


def test_structure_and_failures(spark):
    assert extraction.structure(GOOD) == {"title": "T &amp; U", "headings": 1, "paragraphs": 2, "links": 1}
    rows = spark.createDataFrame([(1, "u", GOOD), (2, "u", None), (3, "u", "<html>"), (4, "u", " "), (None, "u", GOOD)], extraction.PAGES)
    got = {r.page_id: (r.status, r.error) for r in extraction.converted(rows).collect()}
    assert got == {1: ("converted", None), 2: ("failed", "ValueError: the page is empty"), 3: ("failed", "ValueError: the page is cut off"), 4: ("failed", "ValueError: the page is empty"), None: ("converted", None)}


ODD = [
    "<html><title>a &amp; b &am; c &amp</title><p></html>",
    "<html><title>x &#39 y&lt</title><h1 id=a>b</h1></html>",
    "<HTML><TITLE>T</TITLE><P>a</P></HTML>",
    "<html><!-- <p> <a href='x'> </html> --><a class=c href='y'>z</a><p\n>",
    "<script>var x = '<h2>'</script></html>",
    "<html><title>a</title><title>b</title></html>",
    "<html><title lang=x>a</title></html>",
    "\n",
    "\u2003 ",
    None,
]


def test_a_title_keeps_references_as_they_are_written():
    assert extraction.structure(ODD[0])["title"] == "a &amp; b &am; c &amp"
    assert extraction.structure("<html>\n<body>\n<title>x &#39 &#x27; y&lt</title></html>")["title"] == "x &#39 &#x27; y&lt"


def test_odd_pages_are_what_sql_says(spark, tmp_path):
    pages(spark, str(tmp_path / "pages.parquet"), list(enumerate(ODD)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cursor = con.execute(ORACLES["page_extraction"])
    columns = [c[0] for c in cursor.description]
    got = QUERIES["page_extraction"](spark, str(tmp_path)).select(*columns)
    assert as_set(got) == sorted(cursor.fetchall(), key=repr)


def test_extraction_stops_and_goes_on(spark, tmp_path):
    come, flag = str(tmp_path / "pages"), str(tmp_path / "flag")
    batches = [[(k * 10 + i, GOOD if i % 3 else "<html>") for i in range(5)] for k in range(3)]

    def convert(html):
        if os.path.exists(flag):
            raise SystemExit("the worker goes down")  # not a fault of the page, so not caught with it
        return extraction.structure(html)

    out = "file://" + str(tmp_path / "out")
    pages(spark, come, batches[0])
    assert extraction.extract(spark, come, out, convert, 1).count() == 5
    open(flag, "w").close()
    pages(spark, come, batches[1])
    with pytest.raises(Exception):  # noqa: B017
        extraction.extract(spark, come, out, convert, 1)
    os.remove(flag)
    pages(spark, come, batches[2])
    got = as_set(extraction.extract(spark, come, out, convert, 1))
    assert got == as_set(extraction.extract(spark, come, "file://" + str(tmp_path / "once"), convert)) and len(got) == 15
    assert sum(r[1] == "failed" for r in got) == 6
    assert as_set(extraction.extract(spark, come, out, convert, 1)) == got


# turns


def minute(n):
    return dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=n)


def run_turns(spark, tmp_path, batches, lateness="3 minutes", idle_ms=turns.IDLE_MS):
    """Rows after each batch; a batch is (conv, turn, text, entities, minute)."""
    come, seen = str(tmp_path / "come"), []
    for batch in [*batches, [(None, 0, "", [], 10**6)]]:
        spark.createDataFrame([(c, t, a, e, [], minute(m)) for c, t, a, e, m in batch], turns.TURNS).coalesce(1).write.mode("append").parquet(come)
        with scoped(spark, turns.STATE):
            out = turns.in_order(stream_of(spark, come, turns.TURNS), lateness, idle_ms)
            drain(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), str(tmp_path / "checkpoint"))
        seen.append(sorted((r.conv_id, r.turn, r.previous, r.before_entities) for r in spark.read.schema(turns.OUT).parquet(str(tmp_path / "out")).collect() if r.conv_id is not None))
    return seen


def test_late_and_interleaved_turns_end_in_order(spark, tmp_path):
    rows = [(c, t, f"{c}.{t}", [f"E{t}"], 1 + 2 * t + c) for c in (1, 2) for t in range(6)]
    batches = [[], [], [], [], []]
    for r in rows:
        batches[min(4, max(0, r[1] + (-1 if r[1] % 2 else 0)))].append(r)  # odd turns come one batch early, before even ones
    batches[0], batches[1] = batches[0][::-1], batches[1]
    batches[2], late = batches[2][1:], batches[2][:1]
    batches[3] += late  # and one comes a batch late
    seen = run_turns(spark, tmp_path, batches, "9 minutes")
    assert seen[-1] == sorted((c, t, f"{c}.{t - 1}" if t else None, [f"E{t - 1}"] if t else None) for c in (1, 2) for t in range(6))
    assert len(seen[-2]) < 12 and any(seen[:-1])  # turns go as soon as the watermark has passed them


def test_a_conversation_is_forgotten_when_idle(spark, tmp_path):
    batches = [[(1, 0, "first", ["CBA"], 1), (2, 0, "other", [], 1)], [(1, 1, "soon after", [], 5)], [(1, 2, "much later", [], 500)]]
    seen = run_turns(spark, tmp_path, batches, idle_ms=60 * 60 * 1000)
    assert seen[-1] == [(1, 0, None, None), (1, 1, "first", ["CBA"]), (1, 2, None, None), (2, 0, None, None)]


def test_follow_ups_replace_one_entity_or_year(spark):
    from quarry.catalog.streams import ENTITY

    cases = [
        ("And NAB?", ["NAB"], [], "What was CBA cash profit in FY2025?", ["CBA"], ["2025"], "What was NAB cash profit in FY2025?"),
        ("What about 2024?", [], ["2024"], "CBA profit FY2025", ["CBA"], ["2025"], "CBA profit FY2024"),
        ("And NAB?", ["NAB"], [], None, None, None, "And NAB?"),
        ("And NAB?", ["NAB"], [], "Compare CBA and NAB", ["CBA", "NAB"], [], "And NAB?"),
        ("NAB deposits FY2024", ["NAB"], ["2024"], "CBA profit FY2025", ["CBA"], ["2025"], "NAB deposits FY2024"),
    ]
    rows = spark.createDataFrame([c[:6] for c in cases], "a string, entities array<string>, years array<string>, previous string, before_entities array<string>, before_years array<string>")
    assert [r[0] for r in rows.select(turns.resolved(ENTITY)[1]).collect()] == [c[6] for c in cases]

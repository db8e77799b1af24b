"""The pipeline's stages on a small corpus, each against what plain Python says of its own input."""

import random

import corpus_pipeline as P
import pytest

from quarry.llm import chunk_dedup, jaccard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, texts = prose(70), []
    for i in range(240):
        t = prose(90)
        if i % 6 == 0:
            t += " rotten beastly " + prose(5)
        if i % 12 == 1:
            t = "The same first line\n" + t
        if i % 40 == 2 and i % 6:
            t = prose(30) + " " + passage + " " + prose(30)
        texts.append(t)
    texts[50] = texts[49]
    texts[52] = texts[51] + " end"
    texts[53], texts[55] = None, ""
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240) if i % 4], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = {r.doc_id: r.text for r in docs.collect()}
    assert {i for i in before if i % 6 == 0} == set(before) - set(after["toxicity"])
    first_line = {i: t for i, t in after["line_dedup"].items() if t and "same first line" in t}
    assert not first_line and set(after["line_dedup"]) == set(after["toxicity"])
    assert set(after["line_dedup"]) - set(after["jaccard_join"]) == {50, 52}
    changed = {i for i in after["substring_dedup"] if after["substring_dedup"][i] != after["jaccard_join"][i]}
    holders = sorted(i for i in after["jaccard_join"] if i % 40 == 2)
    assert changed == set(holders[1:])
    packed = P.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, null ids, and two texts under one id."""
    w = [f"w{i}" for i in range(60)]
    near, other, third = " ".join(w), " ".join(w[:-1]), " ".join(f"y{i}" for i in range(40))
    rows = [(3, near), (3, near), (5, other), (5, third), (None, near), (None, "a b c d e f g"), (None, "a b c d e f g"), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, near), (5, third), (None, "a b c d e f g"), (9, ""), (9, ""), (None, None)], key=str)


def test_stages_keep_columns_of_any_name_and_empty_tables(spark, folder):
    """Columns called like those that operators add, a dotted one, and no rows at all."""
    kinds = "doc_id long, text string, score double, kept_text double, n_lines int, `__lines` string, `__doc` string, `a.b` int, n_chars long"
    one, two = "first line\n" + " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, one, 0.3, 0.4, 2, "l", "d", 5, 9), (None, two, 0.3, 0.4, 2, "l", "d", 5, 9), (3, None, 0.3, 0.4, 2, "l", "d", 5, 9), (3, "", 0.3, 0.4, 2, "l", "d", 5, 9)]
    docs, none = spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        found = got.collect()
        assert len(found) == 4 and {tuple(r)[2:8] for r in found} == {(0.3, 0.4, 2, "l", "d", 5)}, name
        assert {(r.doc_id, r.text or "") for r in found} == {(i, t or "") for i, t, *_ in rows}
        assert stage(spark, none, folder).count() == 0
    assert P.STAGES[-1][1](spark, none, folder).count() == 0


def test_run_equals_stages(spark, folder):
    rows = P.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(range(240)) - {i for i in range(240) if i % 6 == 0} - {50, 52}
    assert max(r.offset + r.length for r in rows) <= 1024


def test_operators_are_the_ones_of_the_queries():
    assert P.jaccard is jaccard and P.chunk_dedup is chunk_dedup and [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "substring_dedup", "best_fit_packing"]

"""Every registered query of the folder on the smallest tables: names and types of its columns, and what its contract fixes."""

import os
import zlib

import pytest

from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op3_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_graph_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_substring_dedup": {"doc_id": "bigint", "start": "int", "stop": "int", "keeper": "bigint", "kept": "boolean"},
    "op8_warc_revisits": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op9_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_exact_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op11_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op12_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op13_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: QUERIES[name](spark, SF) for name in COLUMNS}


def docs_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(results, name):
    kinds = dict(results[name].dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]


def test_packing(spark, results):
    rows, docs = results["op1_best_fit_packing"].collect(), docs_of(spark)
    assert {r.doc_id for r in rows} == set(docs) and max(r.offset + r.length for r in rows) <= 1024
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length


def test_shards(spark, results):
    rows, docs = results["op3_sharding"].collect(), docs_of(spark)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all(r["size"] == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    own = {}
    for r in rows:
        own.setdefault(r.shard, []).append(r.slot)
    assert set(own) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in own.values())
    place = {}
    for r in rows:
        assert place.setdefault(docs[r.doc_id], r.shard) == r.shard


def test_toxicity(spark, results):
    rows, docs = results["op5_toxicity"].collect(), docs_of(spark)
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_encoding(spark, results):
    import hashlib

    import public_tokenizers

    from quarry.llm import bpe

    encode = bpe.encoding(public_tokenizers.path(bpe.VOCABULARY)).encode_ordinary
    docs = docs_of(spark)
    for r in results["op9_byte_bpe"].collect():
        ids = encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_joined_components(spark, results):
    """Against all pairs of whole texts."""
    import re

    sets = {}
    for i, t in docs_of(spark).items():
        w = re.findall("[^\\x20\\x09-\\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    order = sorted(sets)
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in results["op2_jaccard_join"].collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in order}

"""The queries of this folder: name -> callable, and name -> DuckDB SQL where SQL can say the same."""

from quarry.llm import ann, bpe, chunk_dedup, jaccard, line_dedup, merkle, pack, shard, spelling, token_files, topk, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": pack.op1_best_fit_packing,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_sharding": shard.op3_sharding,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_graph_neighbours": ann.op6_graph_neighbours,
    "op7_substring_dedup": chunk_dedup.op7_substring_dedup,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_token_files": token_files.op12_token_files,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op4_line_dedup": line_dedup.SQL,
    "op8_warc_revisits": warc.SQL,
    "op10_exact_topk": topk.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op13_merkle_manifest": merkle.SQL,
}

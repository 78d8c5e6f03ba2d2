"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from loam.llm.filter_audit import op12_filter_interaction_audit
from loam.llm.knn import op10_voronoi_knn
from loam.llm.line_crf import op6_crf_line_rules
from loam.llm.merkle import op11_merkle_manifest
from loam.llm.ngram_join import op2_ngram_jaccard_join
from loam.llm.oracles import FILTER_AUDIT, KNN, MERKLE, NGRAM_JOIN, URL_FILTER, WARC
from loam.llm.packing import op8_length_bucket_packing
from loam.llm.pieces import op3_sentencepiece_codec
from loam.llm.quality_fm import op1_quality_fm
from loam.llm.secrets import op7_guess_cost_secrets
from loam.llm.sharding import op4_jump_hash_shards
from loam.llm.tokenfiles import op5_rans_token_files
from loam.llm.urls import op9_url_redirect_filter
from loam.llm.warc import op13_warc_archives

QUERIES = {
    "op1_quality_fm": op1_quality_fm,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_sentencepiece_codec": op3_sentencepiece_codec,
    "op4_jump_hash_shards": op4_jump_hash_shards,
    "op5_rans_token_files": op5_rans_token_files,
    "op6_crf_line_rules": op6_crf_line_rules,
    "op7_guess_cost_secrets": op7_guess_cost_secrets,
    "op8_length_bucket_packing": op8_length_bucket_packing,
    "op9_url_redirect_filter": op9_url_redirect_filter,
    "op10_voronoi_knn": op10_voronoi_knn,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_warc_archives": op13_warc_archives,
}

#: The others have a crc32, a tokenizer or a trained model, which DuckDB can't express; tests/llm/ holds them against
#: brute force, exact round trips or held-out labels.
ORACLES: dict[str, str] = {"op2_ngram_jaccard_join": NGRAM_JOIN, "op9_url_redirect_filter": URL_FILTER, "op10_voronoi_knn": KNN, "op11_merkle_manifest": MERKLE, "op12_filter_interaction_audit": FILTER_AUDIT, "op13_warc_archives": WARC}

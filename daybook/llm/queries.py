"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from daybook.llm.bitslice import OP8_SQL, op8_bitsliced_topk
from daybook.llm.classifier import op10_quality_classifier
from daybook.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from daybook.llm.jaccard import OP6_SQL, op6_ngram_jaccard
from daybook.llm.line_dedup import OP11_SQL, op11_line_dedup
from daybook.llm.mixing import OP5_SQL, op5_mix_sources
from daybook.llm.neighbours import op3_adaptive_neighbours
from daybook.llm.packing import op4_pack_mixture
from daybook.llm.pitman_yor import op1_pitman_yor
from daybook.llm.secret_scan import op2_secret_scan
from daybook.llm.suffixes import op9_suffix_dedup
from daybook.llm.token_files import op7_token_files
from daybook.llm.zone_clusters import OP12_SQL, op12_centroid_clusters

QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_secret_scan": op2_secret_scan,
    "op3_adaptive_neighbours": op3_adaptive_neighbours,
    "op4_pack_mixture": op4_pack_mixture,
    "op5_mix_sources": op5_mix_sources,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_token_files": op7_token_files,
    "op8_bitsliced_topk": op8_bitsliced_topk,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_line_dedup": op11_line_dedup,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op5_mix_sources": OP5_SQL,
    "op6_ngram_jaccard": OP6_SQL,
    "op8_bitsliced_topk": OP8_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_centroid_clusters": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}

"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import (
    bpe,
    bytenet,
    fingerprint,
    hardnegatives,
    hostpaths,
    jaccard,
    language,
    merkle,
    mixing,
    phrases,
    quality,
    ring,
    substrings,
    twins,
)

QUERIES = {
    "op1_quartile_digest": fingerprint.op1_quartile_digest,
    "op2_hyperdimensional": language.op2_hyperdimensional,
    "op3_segment_tree_bpe": bpe.op3_segment_tree_bpe,
    "op4_host_paths": hostpaths.op4_host_paths,
    "op5_weak_supervision": quality.op5_weak_supervision,
    "op6_interval_expansion": substrings.op6_interval_expansion,
    "op7_count_tree_join": jaccard.op7_count_tree_join,
    "op8_bounded_ring": ring.op8_bounded_ring,
    "op9_phrase_automata": phrases.op9_phrase_automata,
    "op10_subset_sum_mix": mixing.op10_subset_sum_mix,
    "op11_byte_network": bytenet.op11_byte_network,
    "op12_pointer_jumping": merkle.op12_pointer_jumping,
    "op13_threshold_negatives": hardnegatives.op13_threshold_negatives,
}

ORACLES: dict[str, str] = dict(twins.ORACLES)

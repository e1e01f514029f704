"""The query of each operator, over the whole of its table."""

from __future__ import annotations

from . import bpe, conversations, html, langid, lines, mixing, multiset, pii, repeats, sharding, simhash, spelling, urls
from .common import read

QUERIES = {
    "op1_mix_sources": lambda spark, d: mixing.taken(read(spark, d, "documents")),
    "op2_ring_shards": lambda spark, d: sharding.shards(read(spark, d, "documents")),
    "op3_url_words": lambda spark, d: urls.verdicts(read(spark, d, "pages")),
    "op4_consensus_text": lambda spark, d: html.texts(read(spark, d, "pages")),
    "op5_string_kernel_language": lambda spark, d: langid.languages(read(spark, d, "documents")),
    "op6_random_field_pii": lambda spark, d: pii.found_spans(read(spark, d, "documents")),
    "op7_transducer_bpe": lambda spark, d: bpe.encoded(read(spark, d, "documents")),
    "op8_line_rules": lambda spark, d: lines.verdicts(read(spark, d, "documents")),
    "op9_simhash_groups": lambda spark, d: simhash.groups_of(read(spark, d, "documents")),
    "op10_multiset_fingerprints": lambda spark, d: multiset.edits(read(spark, d, "documents")),
    "op11_suffix_array_dedup": lambda spark, d: repeats.digests(read(spark, d, "documents")),
    "op12_block_table_repair": lambda spark, d: conversations.repaired(read(spark, d, "conversations")),
    "op13_spelling_variants": lambda spark, d: spelling.variants(read(spark, d, "documents")),
}

ORACLE = {
    "op1_mix_sources": mixing.ORACLE,
}

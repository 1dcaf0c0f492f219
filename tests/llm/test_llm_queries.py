"""Registered queries: those with SQL against it, the schemas of all."""

import pytest

from groundsift.llm.queries import ORACLES, QUERIES
from oracle import check, duck

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2_toxicity": "doc_id held_out score predicted",
    "op3_simhash": "doc_id fingerprint component_id", "op4_langid": "doc_id held_out lang_pred score",
    "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op6_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7_mixing": "doc_id source epoch block place slot", "op8_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_substring_dedup": "doc_id start_byte end_byte other_id", "op10_embeddings": "vec_id n_links component_id kept",
    "op11_top_k": "query_id rank vec_id score", "op12_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    verdict, _, _ = check(spark, duck(FOLDER), name, FOLDER)
    assert verdict.startswith("ok") and "EMPTY" not in verdict


def test_columns_of_all_queries(spark):
    assert set(COLUMNS) == set(QUERIES)
    for name, columns in COLUMNS.items():
        assert set(columns.split()) <= set(QUERIES[name](spark, FOLDER).columns), name

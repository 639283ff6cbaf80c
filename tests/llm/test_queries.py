"""The registered queries over the sample tables."""

import zlib

import pytest

from hostweave.llm import _support as S
from hostweave.llm import queries

COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted", "op2_language_id": "doc_id held_out lang_pred score", "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op5_simhash": "doc_id fingerprint component_id", "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op8_embedding_near_dedup": "vec_id n_links component_id kept",
    "op9_token_binary": "doc_id start n_tokens ids_crc32", "op10_substring_dedup": "doc_id n_words n_removed kept_sha256",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    assert rows and list(rows[0].asDict()) == COLUMNS[name].split()
    key = "vec_id" if name.startswith("op8") else "doc_id"
    want = {r[0] for r in S.table(spark, sf, "embeddings" if key == "vec_id" else "documents").select(key).collect()}
    assert {r[key] for r in rows} == want and (len(rows) == len(want) or name.startswith("op7"))
    if "held_out" in COLUMNS[name]:
        folds, fold = (5, 0) if name.startswith("op1") else (4, 2)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)


def test_a_null_doc_id_is_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id bigint")
    assert [r[0] for r in df.select(queries._held_out(5, 0)).collect()][0] is False

"""The registered queries of this part: whole tables, one row per document, and their SQL."""

import pytest

from chirrup.llm import queries
from compare import differences, types

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op3_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op4_decontamination": {"doc_id", "item_id"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op7_repeated_spans": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op8_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op9_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op11_vector_codes": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
    "op12_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
}


def test_all_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.ORACLE) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert differences(df, con, queries.ORACLE[name]) + types(df, con, queries.ORACLE[name]) == []


@pytest.mark.parametrize("name", ["op1_language", "op5_toxicity", "op8_personal_data"])
def test_a_row_for_every_document(spark, con, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert COLUMNS[name] <= set(df.columns)
    ids = [r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()]
    assert sorted(r["doc_id"] for r in df.collect()) == sorted(ids)


def test_personal_data_digests_are_those_of_the_patterns(spark, con):
    import hashlib

    from test_personal_data import brute

    from chirrup.llm.personal_data import LABELS

    got = {r["doc_id"]: r["base_sha256"] for r in queries.op8_personal_data(spark, SMALL).collect()}
    for i, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        spans = ",".join(f"{LABELS[p + 1]}:{a}:{b}" for a, p, b in brute(text))
        assert got[i] == hashlib.sha256(spans.encode()).hexdigest()

"""Queries against their SQL on the small tables, and the result columns of all."""

import pytest

from paperlake.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE[name])


COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op4_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}, "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, "op7_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op8_quality": {"doc_id", "held_out", "score", "predicted"},
}


def test_columns(spark, sf_dir):
    assert {n: COLUMNS[n] <= set(QUERIES[n](spark, sf_dir).columns) for n in ("op4_fingerprints", "op5_mixing")} == {"op4_fingerprints": True, "op5_mixing": True}
    assert len({n.split("_")[0] for n in QUERIES}) == 10

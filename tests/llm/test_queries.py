"""Registered training-data queries: their SQL, and the columns and rows they promise."""

import pytest

from tests.oracle import rows_of, rows_of_sql
from vaakya.llm import queries

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, SMALL)) == rows_of_sql(queries.oracle_sql()[name], SMALL)


COLUMNS = {
    "op1": "doc_id held_out score predicted",
    "op3": "doc_id held_out lang_pred score",
    "op4": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7": "doc_id keep_id group_size kept text_sha256",
    "op8": "doc_id held_out score predicted",
    "op10": "doc_id n_shingles component_id",
}


def test_promised_columns(spark):
    for name, query in queries.queries().items():
        have = dict(query(spark, SMALL).dtypes)
        assert set(COLUMNS.get(name.split("_")[0], "doc_id").split()) <= set(have), name


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names

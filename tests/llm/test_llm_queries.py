import pytest

from millrace.llm import queries

COLUMNS = {
    "p1_found": {"row_id": "bigint", "defect": "string"}, "p2_found": {"chunk_id_a": "string", "chunk_id_b": "string"}, "p3_found": {"field": "string", "row_id": "bigint"},
    "p4_found": {"unit_id": "bigint", "line_no": "int"}, "p5_found": {"unit_id": "bigint", "kind": "string"}, "p6_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p8_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        keys = [tuple(r)[:2] if name in ("p2_found", "p3_found", "p4_found", "p5_found") else r[0] for r in rows]
        assert len(keys) == len(set(keys))


def test_sql_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_mix_takes_all_listed_text(spark, folder):
    shares = queries.p7_shares(spark, folder).collect()
    assert sum(r["planned_tokens"] for r in shares) >= 0.9 * sum(r["available_tokens"] for r in shares)

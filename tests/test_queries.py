"""Queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["tokenize", "synonym_expand", "asm_similarity_topn", "score_quantiles", "duplicate_group_size", "keyword_entropy", "stack_similarity_max", "session_fold", "report_serde", "level1_tables", "dump_tables", "level0_groups", "test_cases", "eval_grid", "recommend_answers"]


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    want = con.sql(entry.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in want)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())

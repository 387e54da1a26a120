"""Each query of the text engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from glossloom.plans import document_queries, more_queries, step_queries
from glossloom.plans import queries as text_queries

QUERIES = text_queries.queries() | more_queries.queries() | document_queries.queries() | step_queries.queries()
ORACLES = text_queries.oracle_sql() | more_queries.oracle_sql() | document_queries.oracle_sql() | step_queries.oracle_sql()
SF = "/root/testdata/sf0.001"


def rows(names, data):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = text_queries.doc_units_by_lang(spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan
    assert "Python" not in plan


@pytest.mark.parametrize("name", ["doc_units_by_lang", "doc_plain_units", "html_text_units", "translatable_breakdown", "tm_dedupe_ratio", "plain_rebuild"])
def test_a_text_is_cut_and_trimmed_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    tables = 3 if name == "translatable_breakdown" else 1
    # plain_rebuild has the expressions of all formats in one plan, of which a line runs one
    assert plan.count("trim(") <= (18 if name == "plain_rebuild" else 2) * tables
    assert plan.count("split(text") <= 2 * tables and plan.count("regexp_extract_all(html") <= 2


def test_doc_rebuild_matches_sql_for_all_letters_and_null_texts(spark, tmp_path):
    from glossloom.functions.text import NEW_CAPITALS

    letters = [c for c in map(chr, range(0x110000)) if c.upper() != c or c.lower() != c or c in NEW_CAPITALS]
    texts = [None, "", "ß\r\n\n ßa", *[f"{c}b" for c in letters]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.file: r.sha for r in QUERIES["doc_rebuild"](spark, str(tmp_path)).collect()}
    want = dict(c.execute(ORACLES["doc_rebuild"]).fetchall())
    assert {texts[k]: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k, "no row") != want.get(k, "no row")} == {}
    assert len(got) == len(texts) - 1

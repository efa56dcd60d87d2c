"""Registered queries against their SQL in DuckDB, at the smallest size."""

import duckdb
import pytest

from siltstone.llm import queries

DIR = "/root/testdata/sf0.001"


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    df, rel = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLE[name])
    assert plain(df.columns, df.collect()) == plain(rel.columns, rel.fetchall())


def test_columns_that_sql_can_state(spark):
    """Sizes and base columns of the queries that SQL cannot express as a whole."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    word = r"[^\x20\x09-\x0D]+"
    sql = f"SELECT doc_id, len(regexp_extract_all(text, '{word}'))::BIGINT AS size, sum(len(regexp_extract_all(text, '{word}'))) OVER (PARTITION BY source)::BIGINT AS source_size FROM documents"
    rel = con.sql(sql)
    df = queries.QUERIES["op1_mix_sources"](spark, DIR).select("doc_id", "size", "source_size")
    assert plain(df.columns, df.collect()) == plain(rel.columns, rel.fetchall())
    sql = f"""SELECT doc_id, len(regexp_extract_all(text, '{word}'))::BIGINT AS n_words, length(array_to_string(regexp_extract_all(text, '{word}'), ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM documents)"""
    rel = con.sql(sql)
    df = queries.QUERIES["op2_quality_rules"](spark, DIR).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines")
    assert plain(df.columns, df.collect()) == plain(rel.columns, rel.fetchall())

"""Every registered query of the core catalogue against its SQL in DuckDB, and operators on small inputs."""

from random import Random

import duckdb
import pytest

from jobs import queries as job_queries  # noqa: F401  registers
from siltstone import catalogue, catalogue_index, catalogue_sources  # noqa: F401  all register
from siltstone.functions import text as T
from siltstone.operators import diff as D
from siltstone.operators import graph as G

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    rel = duck.sql(catalogue.ORACLE[name])
    assert plain(df.columns, df.collect()) == plain(rel.columns, rel.fetchall())


def test_the_review_document_has_every_changed_file(spark):
    """Not only those of some keys: all files of two snapshots that changed."""
    changed = spark.read.parquet(f"{DIR}/part.parquet").filter("p_partkey % 4 <> 2").selectExpr("concat('m', p_partkey, '.py') as path")
    got = catalogue.QUERIES["review_document"](spark, DIR).filter("part = 'file'")
    assert sorted(r.name for r in got.collect()) == sorted(r.path for r in changed.collect())


def test_boundary_equals_the_sequential_scan(spark):
    r = Random(6)
    for _ in range(3):
        edges = [(i, f"n{r.randint(0, 12)}", f"n{r.randint(0, 12)}") for i in range(25)]
        kept, have = [], {"n0", "n1"}
        for i, a, b in edges:
            if a in have or b in have:
                kept.append(i)
                have |= {a, b}
        df = spark.createDataFrame(edges, "seq long, src string, dst string")
        got, stubs = G.boundary(df, spark.createDataFrame([("n0",), ("n1",)], "node string"))
        assert sorted(x.seq for x in got.collect()) == kept and {x.node for x in stubs.collect()} == have - {"n0", "n1"}


def test_swapped_snapshots_swap_added_and_removed(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, h string")
    b = spark.createDataFrame([(2, "y"), (3, "w"), (4, "v")], "k int, h string")
    assert {tuple(r) for r in D.snapshot_diff(a, b, ["k"], "h").collect()} == {(1, "removed"), (3, "modified"), (4, "added")}
    assert {tuple(r) for r in D.snapshot_diff(b, a, ["k"], "h").collect()} == {(1, "added"), (3, "modified"), (4, "removed")}


def test_redaction(spark):
    rows = [("db_password = 'hunter22'",), ('api_key: "abcdef" x',), ("token = 'short'",), ("k AKIA" + "A" * 16 + " end",), ("-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----",)]
    got = [(r.t, r.n) for r in T.redact(spark.createDataFrame(rows, "t string"), "t", "n").collect()]
    assert got == [("db_password = '[REDACTED]'", 1), ('api_key: "[REDACTED]" x', 1), ("token = 'short'", 0), ("k [REDACTED] end", 1), ("[REDACTED]", 1)]

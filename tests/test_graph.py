"""Graph operators against sequential definitions on random inputs."""

from random import Random

import pytest

from siltstone.operators import graph as G
from siltstone.operators import keyed as K
from siltstone.plans import index as I


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 4), (3, 16), (4, 7)])
def test_budget_fold_equals_the_loop(spark, seed, parts):
    r = Random(seed)
    rows = [(r.randint(0, 9), r.choice((r.randint(0, 12), r.randint(0, 90))), f"k{i}") for i in range(120)]
    if seed == 4:  # sizes that fall along the order bring a misfit in every range
        rows = [(i, 200 - i, f"k{i:03}") for i in range(120)]
    limit, left, kept = 700, 700, set()
    for _, n, k in sorted(rows, key=lambda x: (x[0], x[2])):
        if n <= left:
            left -= n
            kept.add(k)
    got = G.budget_fold(spark.createDataFrame(rows, "o int, n long, k string"), ["o"], "n", "k", limit, parts)
    assert {x.k for x in got.collect() if x.kept} == kept and got.count() == len(rows)


def test_budget_fold_of_nothing_and_of_what_all_fits(spark):
    none = spark.createDataFrame([], "o int, n long, k string")
    assert G.budget_fold(none, ["o"], "n", "k", 5).collect() == []
    some = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (0, 9, "c")], "o int, n long, k string")
    assert {tuple(x) for x in G.budget_fold(some, ["o"], "n", "k", 5).collect()} == {("a", True), ("b", True), ("c", False)}
    assert all(x.kept for x in G.budget_fold(some, ["o"], "n", "k", 99).collect())


def scan(edges, have):
    kept, have, start = [], set(have), set(have)
    for i, a, b in edges:
        if a in have or b in have:
            kept.append(i)
            have |= {a, b}
    return kept, have - start


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_boundary_equals_the_sequential_scan_of_random_graphs(spark, seed):
    r = Random(seed)
    edges = [(i, f"n{r.randint(0, 25)}", f"n{r.randint(0, 25)}") for i in range(60)]
    got, stubs = G.boundary(spark.createDataFrame(edges, "seq long, src string, dst string"), spark.createDataFrame([("n0",), ("n1",), ("n99",)], "node string"))
    kept, outside = scan(edges, {"n0", "n1", "n99"})
    assert sorted(x.seq for x in got.collect()) == kept and {x.node for x in stubs.collect()} == outside


def test_boundary_joins_only_edges_of_nodes_that_changed(spark, caplog):
    """A chain in order is admitted link by link; a node's edges are joined when its time falls, not in every round."""
    edges = [(i, f"c{i}", f"c{i + 1}") for i in range(6)] + [(100 + i, f"far{i}", f"far{i + 1}") for i in range(200)]
    with caplog.at_level("INFO"):
        got, stubs = G.boundary(spark.createDataFrame(edges, "seq long, src string, dst string"), spark.createDataFrame([("c0",)], "node string"))
    assert got.count() == 6 and stubs.count() == 6
    assert [int(m.message.split()[1]) for m in caplog.records if m.message.startswith("boundary")] == [6]


def innermost(spans, path, at):
    best = None
    for i, (p, a, b) in enumerate(spans):
        if p == path and a <= at <= b and (best is None or (a, (-b[0], -b[1]), -i) > best[0]):
            best = ((a, (-b[0], -b[1]), -i), i)
    return best and best[1]


@pytest.mark.parametrize("block", [4096, 3])
def test_locate_equals_the_definition(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    r, spans = Random(block), []
    place = lambda: (r.randint(1, 25), r.randint(0, 3))
    for _ in range(160):
        a, b = sorted((place(), place()))
        spans.append((r.choice(("p", "q")), a, b))
    rows = [(p, *a, *b, "function", i + 1, f"s{i}") for i, (p, a, b) in enumerate(spans)] + [("p", 1, 0, 30, 0, "module", 0, "m")]
    symbols = spark.createDataFrame(rows, "path string, start_line int, start_character int, end_line int, end_character int, kind string, sym_ord int, symbol_id string")
    points = [(r.choice(("p", "q", "none")), *place()) for _ in range(200)]
    got = I.locate(spark.createDataFrame([(*x, i) for i, x in enumerate(points)], "path string, line int, character int, i int"), symbols)
    want = {}
    for i, (path, line, character) in enumerate(points):
        at = innermost(spans, path, (line, character))
        want[i] = (f"s{at}", *spans[at][1]) if at is not None else ("m", 1, 0) if path == "p" else (None, None, None)
    assert {x.i: (x.symbol_id, x.span_line, x.span_character) for x in got.collect()} == want


def test_a_file_of_many_spans_and_points_is_swept_once(spark):
    n = 100_000
    flat = spark.range(n).selectExpr("'f' as path", "cast(id + 1 as int) as start_line", "0 as start_character", "cast(id + 1 as int) as end_line", "9 as end_character", "'function' as kind", "cast(id as int) as sym_ord", "concat('s', id) as symbol_id")
    points = spark.range(n).selectExpr("'f' as path", "cast(id + 1 as int) as line", "5 as character")
    got = I.locate(points, flat)
    assert got.filter("symbol_id = concat('s', line - 1)").count() == n

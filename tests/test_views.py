"""Architecture, differences and highlights against brute force."""

from random import Random

import pytest

from siltstone.plans import architecture as A
from siltstone.plans import marts as M
from siltstone.plans import panes as P


def reach(edges, nodes):
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            out[a] |= out[b]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_layers_of_random_graphs(spark, seed):
    r = Random(seed)
    nodes = [f"n{i:02}" for i in range(16)]
    edges = sorted({(r.choice(nodes), r.choice(nodes)) for _ in range(20)})
    df = spark.createDataFrame([(a, b, "imports") for a, b in edges] + [("n00", "n01", "calls")], "src string, dst string, kind string")
    members, links = A.architecture(df, spark.createDataFrame([(n,) for n in nodes], "symbol_id string"))
    to = reach(edges, nodes)
    want = {n: min(m for m in nodes if m in to[n] and n in to[m]) for n in nodes}
    got = {x.module: x for x in members.collect()}
    assert {n: x.component for n, x in got.items()} == want and all(x.size == sum(c == x.component for c in want.values()) for x in got.values())
    between = [(want[a], want[b]) for a, b in edges if want[a] != want[b]]
    assert {(x.src, x.dst): x.imports for x in links.collect()} == {p: between.count(p) for p in between}
    layer = dict.fromkeys(want.values(), 0)
    for _ in nodes:
        for a, b in between:
            layer[a] = max(layer[a], layer[b] + 1)
    assert {x.component: x.layer for x in got.values()} == layer


def test_an_architecture_without_imports(spark):
    members, links = A.architecture(spark.createDataFrame([], "src string, dst string, kind string"), spark.createDataFrame([("a",), ("b",)], "symbol_id string"))
    assert {tuple(x) for x in members.collect()} == {("a", "a", 1, 0), ("b", "b", 1, 0)} and links.collect() == []


def least(a, b):
    """Lines that go and come at least, by dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[j - 1]))
        row = new
    return row[-1]


def test_scripts_are_shortest_and_lead_from_one_text_to_the_other():
    r = Random(4)
    for _ in range(300):
        a, b = ("\n".join(r.choice("abcd") for _ in range(r.randint(1, 12))) for _ in range(2))
        got = P.script(a, b)
        assert "\n".join(t for op, _, _, t in got if op != "+") == a and "\n".join(t for op, _, _, t in got if op != "-") == b
        assert [o for op, o, _, _ in got if op != "+"] == list(range(1, a.count("\n") + 2)) and [n for op, _, n, _ in got if op != "-"] == list(range(1, b.count("\n") + 2))
        assert sum(op != " " for op, *_ in got) == least(a.split("\n"), b.split("\n"))


def test_scripts_of_long_and_of_missing_texts(spark):
    lines = [f"l{i}" for i in range(4000)]
    got = P.script("\n".join(lines), "\n".join(lines[1000:2000] + ["new"] + lines[2500:]))
    assert [sum(op == x for op, *_ in got) for x in "-+ "] == [1500, 1, 2500]
    df = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, None, "x"), (3, "x", None), (4, None, None), (5, "s\nt", "s\nt"), (6, "", "")], "i int, old string, new string")
    got = {r.i: [tuple(x) for x in r.lines] for r in P.line_diff(df, "old", "new").collect()}
    assert got == {1: [(" ", 1, 1, "a"), ("-", 2, None, "b"), ("+", None, 2, "c")], 2: [("+", None, 1, "x")], 3: [("-", 1, None, "x")], 4: [], 5: [(" ", 1, 1, "s"), (" ", 2, 2, "t")], 6: [(" ", 1, 1, "")]}


def test_runs_cover_each_character_with_its_labels(spark):
    r = Random(8)
    texts = {"a": "naïve ünit\n\nlast line here", "b": "x" * 30}
    files = spark.createDataFrame(list(texts.items()), "path string, source string")
    place = lambda: (r.randint(1, 4), r.randint(0, 14))
    spans = []
    for _ in range(60):
        a, b = sorted((place(), place()))
        spans.append((r.choice("abc"), *a, *b, r.choice(["call", "name", "type", "own", None])))
    got = P.highlight_runs(files, spark.createDataFrame(spans, "path string, start_line int, start_character int, end_line int, end_character int, label string")).collect()
    seen = {}
    for x in got:
        raw = texts[x.path].split("\n")[x.line - 1].encode()
        assert x.start_character < x.end_character <= len(raw) and x.labels == sorted(set(x.labels))
        assert x.text.encode("utf-8", "ignore") == raw[x.start_character : x.end_character] or "�" in x.text  # a span may cut a character
        for i in range(x.start_character, x.end_character):
            assert (x.path, x.line, i) not in seen
            seen[x.path, x.line, i] = x.labels
    want = {}
    for path, a, b, c, d, label in spans:
        for n, line in enumerate(texts.get(path, "").encode().split(b"\n") if path in texts else [], 1):
            for i in range(len(line)):
                if label and (a, b) <= (n, i) < (c, d):
                    want.setdefault((path, n, i), set()).add(label)
    assert seen == {k: sorted(v) for k, v in want.items()}


def test_postings_find_what_a_scan_finds_and_read_only_their_folders(spark, tmp_path):
    r = Random(2)
    rows = [(f"s{i}", "".join(r.choice("abAB.") for _ in range(r.randint(0, 9)))) for i in range(300)] + [("same", "aBa.b"), ("same2", "aBa.b"), ("none", None)]
    symbols, path = spark.createDataFrame(rows, "symbol_id string, qualname string"), str(tmp_path / "p")
    M.write_postings(symbols, path)
    for text in ("aba", "Ba.b", "bbbb", "zzz", "ab", "", "%_."):
        got = [tuple(x) for x in M.search_postings(spark, path, text).collect()]
        assert got == [tuple(x) for x in M.search(symbols, text).collect()] == sorted(((s, q) for s, q in rows if q is not None and text.lower() in q.lower()), key=lambda x: (len(x[1]), x[1], x[0]))
    plan = M.search_postings(spark, path, "aba")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "In(gram" in plan or "EqualTo(gram" in plan

"""Source facts, the index of a snapshot and artifact documents on small inputs."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph as G
from siltstone.operators import keyed as K
from siltstone.plans import index as I
from siltstone.plans.review import review_document
from siltstone.sources import artifacts as A
from siltstone.sources import revisions as R
from siltstone.sources import snapshot as S
from siltstone.sources.brace_facts import BraceFacts
from siltstone.sources.python_facts import PythonFacts

PYTHON = """import os
from .models import Item as It, shape
from __future__ import annotations


@logged
@retry(times=3)
class Box(Base):
    def open(self, x):
        def inner():
            return ü(x)
        return connect(x).execute(f"{query(x)}").fetchone()
"""


def short(f):
    return [(s["kind"], s["qualname"], s["span"][0], s["span"][2]) for s in f.symbols]


def calls(f):
    return [(o.split(":")[-1], n, m) for o, n, m, _ in f.calls]


def test_python_facts():
    f = PythonFacts("shop.box", PYTHON)
    assert short(f) == [("class", "Box", 6, 12), ("method", "Box.open", 9, 12), ("function", "Box.open.inner", 10, 11)]
    assert f.symbols[0]["signature"] == "@logged" and f.symbols[0]["parent"] == "python:shop.box"
    assert f.targets == ["os", "shop.models"] and [(n, full) for _, n, full in f.names] == [("Item", "shop.models.Item"), ("shape", "shop.models.shape")]
    got = calls(f)
    # a receiver is read for its call and as its part: depth d comes 2**d times
    assert got.count(("Box.open", "connect", False)) == 4 and got.count(("Box.open", "execute", True)) == 2 and got.count(("Box.open", "fetchone", True)) == 1
    assert got.count(("Box.open", "query", False)) == 2 and got[-2:] == [("Box", "logged", False), ("Box", "retry", False)]
    assert next(s for _, n, _, s in f.calls if n == "ü") == (11, 19, 11, 21)  # columns are bytes
    assert sorted(set(calls(PythonFacts("m", PYTHON, repeats=False)))) == sorted(set(calls(PythonFacts("m", PYTHON)))) and len(calls(PythonFacts("m", PYTHON, repeats=False))) == len(set(got))


def test_python_relative_import_above_the_top_and_in_a_package():
    assert PythonFacts("a", "from ... import x\n").targets == [""]
    assert PythonFacts("a.b", "from . import x\nfrom .. import y\n").targets == ["a", ""]


SCRIPT = """import { Order, type Item as I } from "../models.ts";
import fs from "fs";
export class Service extends Base {
  @Input() name: string;
  private repo = new Repo();
  handler = () => { tick(); };
  sign(a: string): void;
  sign(a: any) { return `it's ${mark(a)}`; }
  static async create(input: { a: string }): Promise<Order> {
    if (check(input)) { return /it's\\/x/.test(input.a); }
    return this.repo.find(input).map((r) => parse(r));
  }
}
export const top = async <T>(a: T): Promise<{ b: string }> => wrap<T>(a)
interface Shape { area(): number }
let plain = compute(1), other = function () { return inner(); }
// ignored() /* too */
plain?.run?.("x")
"""


def test_script_facts():
    f = BraceFacts("typescript", "src/app/service", SCRIPT)
    assert short(f) == [("class", "Service", 3, 13), ("method", "Service.sign", 8, 8), ("method", "Service.create", 9, 12), ("function", "top", 14, 14), ("class", "Shape", 15, 15), ("function", "other", 16, 16)]
    assert f.targets == ["src/models"] and [x[1:] for x in f.names] == [("Order", "src/models.Order"), ("Item", "src/models.Item")]
    assert calls(f) == [
        ("Service", "Input", False), ("Service", "Repo", False), ("Service", "tick", False), ("Service.sign", "mark", False), ("Service.create", "check", False), ("Service.create", "test", True),
        ("Service.create", "find", True), ("Service.create", "map", True), ("Service.create", "find", True), ("Service.create", "parse", False), ("top", "wrap", False),
        ("src/app/service", "compute", False), ("other", "inner", False), ("src/app/service", "run", True),
    ]


GO = """package main

import (
	"fmt"
	st "app/store"
)

type Alias = string
type (
	A interface{ Foo() }
	B int
)

func (s *Server) Run(ctx Context) (int, error) {
	defer s.db.Close()
	if err := s.check(ctx); err != nil {
		return 0, fmt.Errorf("x {")
	}
	go func() { work() }()
	return New(1).Do(), nil
}

func New[T any](n int) *Server {
	return &Server{name: `raw "`}
}
"""


def test_go_facts():
    f = BraceFacts("go", "cmd/main", GO)
    assert short(f) == [("class", "A", 9, 12), ("class", "B", 9, 12), ("method", "Server.Run", 14, 21), ("function", "New", 23, 25)]
    assert f.targets == ["fmt", "app/store"]
    assert calls(f) == [("Server.Run", n, m) for n, m in [("Close", True), ("check", True), ("Errorf", True), ("work", False), ("New", False), ("Do", True), ("New", False)]]


@pytest.mark.parametrize("language", ["typescript", "javascript", "go"])
@pytest.mark.parametrize("text", ["", "{", "}}}", "((", "`${", "func", "class", "const", "type", "import", "a.b(", "'x", "/*", "new", "export default function ()", "@", "const x = {", "func (", "type (", "x = (a) =>", "퟿ ü.é(1)"])
def test_broken_text_ends(language, text):
    BraceFacts(language, "m", text)


def test_scan_orders_by_components_and_keeps_what_does_not_parse(spark, tmp_path):
    for path, text in {"a/x.py": b"def f():\n    g()\n", "a-b/y.py": b"def g(:\n", "a/__init__.py": b"", "b/z.ts": b"function h() { return 1 }\n", "skip/no.py": b"x", "bad.go": b"package \xff\n", "note.md": b"#"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(text)
    files = S.files(S.scan(spark, str(tmp_path), ["skip"]))
    got = files.orderBy("file_ord").select("path", "language", "module").collect()
    assert [tuple(r) for r in got] == [("a/__init__.py", "python", "a"), ("a/x.py", "python", "a.x"), ("a-b/y.py", "python", "a-b.y"), ("b/z.ts", "typescript", "b/z"), ("bad.go", "go", "bad")]
    facts = S.facts(files)
    assert {r.path for r in facts.filter("not parsed").collect()} == {"a-b/y.py"}
    assert files.filter("path = 'bad.go'").first().source == "package �\n"


def sources(spark, files):
    return S.files(spark.createDataFrame(list(files.items()), "path string, content string"))


def test_index_of_a_small_project(spark):
    files = sources(spark, {
        "app/a.py": "from app.b import go\n\n\ndef start():\n    go(1)\n    {}.get(2)\n    nowhere()\n",
        "app/b.py": "from app.c import far\n\n\ndef go(x):\n    return far(x)\n",
        "app/c.py": "def far(x):\n    return last(x)\n\n\ndef last(x):\n    return x\n",
    })
    x = I.build(files, ["./app/a.py", "nothing"], hops=1)
    assert {(r.entry, r.matched) for r in x.entries.collect()} == {("./app/a.py", True), ("nothing", False)}
    assert {r.path for r in x.files.collect()} == {"app/a.py", "app/b.py"}
    assert {r.symbol_id for r in x.symbols.filter("not in_slice").collect()} == {"python:app.c", "python:app.c:far", "python:app.c:last"}  # far, once admitted, admits last
    assert x.stats.first().asDict() == {"files_scanned": 3, "slice_symbols": 4, "boundary_symbols": 3, "edges": 5, "unresolved_calls": 2}
    refs = {(r.path, r.start_line, r.symbol_id) for r in x.references.collect()}
    assert refs == {("app/a.py", 5, "python:app.b:go"), ("app/a.py", 1, "python:app.b:go"), ("app/b.py", 5, "python:app.c:far"), ("app/b.py", 1, "python:app.c:far")}
    d = json.loads(I.document(x, {"id": "p", "root": "/p", "head_commit": "c"}, 1).first().json)
    assert [f["path"] for f in d["index"]["files"]] == ["app/a.py", "app/b.py"] and d["slice"]["hop_limit"] == 1 and d["index"]["resolution"] == {"python": "generic"}
    assert "site" in d["index"]["edges"][0] and "site" not in d["index"]["edges"][-1] and "parent" not in d["index"]["symbols"][0]
    with pytest.raises(ValueError):
        I.build(files, ["none"])


def test_byte_budget_drops_files_from_the_slice(spark):
    files = sources(spark, {"a.py": "def f():\n    g()\n", "b.py": "def g():\n    pass\n" + "#" * 500 + "\n"})
    x = I.build(files, ["a.py"], 2, max_source_bytes=100)
    assert [r.path for r in x.files.collect()] == ["a.py"] and [r.path for r in x.dropped.collect()] == ["b.py"]
    assert {r.symbol_id for r in x.symbols.filter("not in_slice").collect()} == {"python:b:g"}


RULES = {"type": "object", "required": ["artifact_id", "index"], "additionalProperties": False, "properties": {
    "artifact_id": {"type": "string", "pattern": "^art_"}, "title": {"type": "string"}, "index": {"type": "object"}, "inputs": {"type": "object"}, "repository": {"type": "object"},
    "concepts": {"type": "array", "maxItems": 2, "items": {"$ref": "#/$defs/item"}}, "changes": {"type": "object"}, "db_password": {"type": "string"}},
    "$defs": {"item": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "minLength": 2}, "level": {"enum": ["low", "high"]}}}}}


def artifact(**more):
    at = {"start_line": 1, "start_character": 0, "end_line": 2, "end_character": 0}
    index = {
        "files": [{"path": "a.py", "sha256": "1", "source": "x\ny"}],
        "symbols": [{"symbol_id": "s", "path": "a.py", "content_hash": "1", "in_slice": True}, {"symbol_id": "stub", "path": "far.py", "content_hash": "1", "in_slice": False}],
        "edges": [], "references": [],
    }
    concepts = [{"id": "c1", "evidence": [{"path": "a.py", "symbol_id": "s", "range": at}]}, {"id": "c2", "evidence": [{"path": "far.py", "symbol_id": "stub", "range": at}]}]
    return {"artifact_id": "art_1", "title": "T</script>", "repository": {"head_commit": "h"}, "index": index, "concepts": concepts, **more}


def docs(spark, *found):
    return spark.createDataFrame([(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(found)], "id string, json string")


def test_check_reports_rules_first_then_integrity(spark):
    bad = artifact(changes={"stale_items": ["c1", "gone"]})
    bad["index"] = {**bad["index"], "edges": [{"from": "s", "to": "q"}]}
    wrong = {"artifact_id": "x", "concepts": [{"id": "a", "level": "mid"}, {}], "odd": 1}
    got = {(r.id, r.location, r.message) for r in A.check(docs(spark, artifact(), bad, wrong, "{"), RULES).collect()}
    assert got == {
        ("1", "index", "edges[0].to q not in symbols"), ("1", "changes.stale_items", "unknown id gone"),
        ("2", "(root)", "'index' is a required property"), ("2", "(root)", "additional property 'odd' is not allowed"), ("2", "artifact_id", "'x' does not match '^art_'"),
        ("2", "concepts/0/id", "'a' is too short"), ("2", "concepts/0/level", "'mid' is not one of ['low', 'high']"), ("2", "concepts/1", "'id' is a required property"),
        ("3", "(root)", "not JSON: JSONDecodeError"),
    }


def shuffled(spark):
    """Rows that all stages of the session wrote to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def breaches(doc):
    """What integrity must say of a document, one name after another."""
    index, out = doc["index"], []
    files, symbols = {f["path"]: f for f in index["files"]}, {x["symbol_id"]: x for x in index["symbols"]}
    for x in symbols.values():
        if x.get("in_slice") and x["path"] not in files:
            out.append(("index", f"in_slice symbol {x['symbol_id']} has no source file {x['path']}"))
        if x.get("parent") and x["parent"] not in symbols:
            out.append(("index", f"symbol {x['symbol_id']} parent {x['parent']} not in symbols"))
    for i, e in enumerate(index["edges"]):
        out += [("index", f"edges[{i}].{end} {e[end]} not in symbols") for end in ("from", "to") if e[end] not in symbols]
    for i, r in enumerate(index["references"]):
        out += [("index", f"references[{i}].path {r['path']} not in files")] * (r["path"] not in files) + [("index", f"references[{i}].symbol_id {r['symbol_id']} not in symbols")] * (r["symbol_id"] not in symbols)
    for i, x in enumerate(doc["findings"]):
        for k, p in enumerate(x["evidence"]):
            at, symbol = f"findings[{i}].evidence[{k}]", symbols.get(p.get("symbol_id"))
            if p.get("symbol_id") and not symbol:
                out.append((at, f"symbol_id {p['symbol_id']} not in index.symbols"))
            if p["path"] not in files:
                out += [(at, f"path {p['path']} not in index.files")] * (not symbol or bool(symbol.get("in_slice")))
                continue
            n, r = files[p["path"]]["source"].count("\n") + 1, p.get("range", {})
            if r.get("start_line", 1) > n or r.get("end_line", 1) > n:
                out.append((at, f"range L{r['start_line']}-L{r['end_line']} out of bounds for {p['path']} ({n} lines)"))
    known = {x["id"] for x in doc["flows"] + doc["concepts"]}
    return out + [("changes.stale_items", f"unknown id {x}") for x in doc["changes"]["stale_items"] if x not in known]


def test_integrity_of_documents_small_and_large(spark):
    """With repeated symbols and files (the last counts), stubs and absent fields; nothing is shuffled or written for it."""
    r = random.Random(5)

    def made(n):
        name = lambda p: f"{p}{r.randint(0, n + n // 4)}"
        at = lambda a: {"start_line": a, "start_character": 0, "end_line": a + 1, "end_character": 0}
        pointer = lambda: {"path": name("f"), **({"symbol_id": name("s")} if r.random() < 0.8 else {}), **({"range": at(r.randint(1, 5))} if r.random() < 0.8 else {})}
        symbols = [{"symbol_id": name("s"), "path": name("f"), **({"parent": r.choice(["", name("s")])} if r.random() < 0.5 else {}), **({"in_slice": r.random() < 0.5} if r.random() < 0.9 else {})} for _ in range(n)]
        index = {"files": [{"path": name("f"), "source": "x\n" * r.randint(0, 5)} for _ in range(n)], "symbols": symbols, "edges": [{"from": name("s"), "to": name("s")} for _ in range(n)], "references": [{"path": name("f"), "symbol_id": name("s")} for _ in range(n)]}
        return {"index": index, "findings": [{"evidence": [pointer() for _ in range(3)]} for _ in range(n)], "flows": [{"id": name("i")} for _ in range(n)], "concepts": [{"id": "c"}], "changes": {"stale_items": ["c", *(name("i") for _ in range(n))]}}

    found = [made(n) for n in (0, 1, 2, 5, 30, 400)]
    of, before = A.parsed(docs(spark, *found, "{")), shuffled(spark)
    got = [tuple(x) for x in A.integrity(of).collect()]
    assert shuffled(spark) == before
    assert sorted(got) == sorted((str(i), *x) for i, d in enumerate(found) for x in breaches(d)) and len(got) > 500


def test_changes_make_items_stale(spark):
    new = artifact()
    new["index"] = {**new["index"], "symbols": [{"symbol_id": "s", "path": "a.py", "content_hash": "2", "in_slice": True}]}
    got = json.loads(A.changes(A.parsed(docs(spark, artifact())), A.parsed(docs(spark, new))).first().json)
    assert got == {"changes": {"previous_head_commit": "h", "files": [], "symbols": [{"symbol_id": "s", "change": "modified"}], "stale_items": ["c1"]}, "reinvestigate": ["s"], "reusable": ["c2"], "previous_artifact_id": "art_1"}


def test_render_redacts_gates_and_escapes(spark):
    d = docs(spark, artifact(db_password="x", inputs={"note": "token = 'abcdefgh'"}), "{")
    template = "<!-- template-version: 1.2 --><title>@T@</title><script>@D@</script>"
    rows = {r.id: r for r in A.render(d, template, A.check(d, RULES), "@T@", "@D@").collect()}
    assert rows["1"].status == "invalid" and rows["1"].html is None and rows["1"].errors == ["(root): not JSON: JSONDecodeError"]
    page = rows["0"].html
    assert rows["0"].status == "ok" and rows["0"].redactions == 2 and rows["0"].n_bytes == len(page.encode())
    assert "<title>T&lt;/script&gt;</title>" in page and '"title":"T<\\/script>"' in page and '"template_version":"1.2"' in page and "token = '[REDACTED]'" in page
    with pytest.raises(ValueError):
        A.render(d, "no place", A.check(d, RULES), "@T@", "@D@")


def test_documents_written_and_read_again(spark, tmp_path):
    A.write_text(docs(spark, artifact()).withColumnRenamed("json", "value"), str(tmp_path / "out"))
    got = A.read(spark, str(tmp_path / "out")).collect()
    assert len(got) == 1 and json.loads(got[0].json) == artifact()


def test_definition_answers_become_references(spark):
    files = sources(spark, {"a.py": "class A:\n    def f(self):\n        return B\n", "b.py": "class B:\n    pass\n\n\nclass C:\n    B = 1\n"})
    facts = S.facts(files)
    symbols = S.symbols(facts)
    asked = G.cut(I.usage_requests(facts, symbols).selectExpr("monotonically_increasing_id() as request", "*")).filter("name = 'B' and path = 'a.py'")
    n = asked.first().request
    # the first answer lies in C, whose name differs; the second is B
    answers = spark.createDataFrame([(n, 0, "b.py", 6, 4), (n, 1, "b.py", 1, 6), (n, 2, "none.py", 1, 0)], "request long, answer int, path string, line int, character int")
    got = I.usage_references(asked, answers, symbols).collect()
    assert [(r.path, r.start_line, r.start_character, r.symbol_id) for r in got] == [("a.py", 3, 15, "python:b:B")]
    points = spark.createDataFrame([("b.py", 2, 4), ("b.py", 3, 0), ("no.py", 1, 0)], "path string, line int, character int")
    assert {(r.path, r.line, r.symbol_id) for r in I.locate(points, symbols).collect()} == {("b.py", 2, "python:b:B"), ("b.py", 3, "python:b"), ("no.py", 1, None)}


def test_revisions_and_review(spark, tmp_path):
    root = str(tmp_path)
    git = lambda *w: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@example.org", *w], check=True, capture_output=True)
    assert R.head(root) == "unversioned"
    git("init", "-q")
    for name, text in {"keep.py": "def a():\n    pass\n\n\ndef b():\n    pass\n", "gone.py": "def g():\n    pass\n", "note.md": "x"}.items():
        (tmp_path / name).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "one")
    base = R.head(root)
    assert len(base) == 40
    (tmp_path / "keep.py").write_text("def a():\n    return 1\n\n\ndef c():\n    pass\n")
    (tmp_path / "gone.py").unlink()
    (tmp_path / "new.go").write_text("package x\n\nfunc N() {\n}\n")
    git("add", "-N", "new.go")
    assert R.head(root).startswith(f"worktree:{base}:")
    changed = R.changed_files(spark, root, base)
    assert {tuple(r) for r in changed.collect()} == {("keep.py", "modified"), ("gone.py", "removed"), ("new.go", "added")}
    before, after = S.facts(S.files(R.base_files(changed, root, base))), S.facts(S.files(S.scan(spark, root)))
    got = {(r.symbol_id, r.change) for r in R.review(changed, before, after).collect()}
    assert got == {("python:keep:a", "modified"), ("python:keep:b", "removed"), ("python:keep:c", "added"), ("python:gone:g", "removed"), ("go:new:N", "added")}


def test_files_with_errors_keep_their_sound_statements():
    text = "import a\n\n\ndef f(:\n    pass\n\n\nclass C:\n    def run(self):\n        x = = 1\n        return go(x)\n\n    def rest(self):\n        return 2\n\n\nz = (1,\n\ndef last():\n    pass\n"
    f = PythonFacts("m", text)
    assert not f.whole and f.targets == ["a"]
    assert [(k, q, a) for k, q, a, _ in short(f)] == [("class", "C", 8), ("method", "C.run", 9), ("method", "C.rest", 13), ("function", "last", 19)]
    assert ("C.run", "go", False) in calls(f)
    assert PythonFacts("m", "def f():\n    return 1\n").whole and not PythonFacts("m", "(((").whole


def test_a_service_that_answers_and_one_that_failed(spark):
    files = sources(spark, {"a.py": "from b import go\n\n\ndef start():\n    go(1)\n    return Shape\n", "b.py": "def go(x):\n    return x\n\n\nclass Shape:\n    def go(self):\n        pass\n"})
    definitions = spark.createDataFrame([("a.py:5:4", 0, "b.py", 1, 4), ("a.py:6:11", 0, "b.py", 5, 6)], "request string, answer int, path string, line int, character int")
    answers = spark.createDataFrame([("python", "srv", False)], "language string, service string, failed boolean")
    x = I.build(files, ["a.py"], 1, definitions=definitions, answers=answers)
    assert {(r.src, r.dst, r.resolution) for r in x.edges.filter("kind = 'calls'").collect()} == {("python:a:start", "python:b:go", "lsp")}  # two symbols are named go
    assert {(r.start_line, r.symbol_id) for r in x.references.collect()} >= {(5, "python:b:go"), (6, "python:b:Shape")}
    assert json.loads(I.document(x, {"id": "p"}, 1).first().json)["index"]["resolution"] == {"python": "lsp:srv"}
    failed = spark.createDataFrame([("python", "srv", True)], "language string, service string, failed boolean")
    y = I.build(files, ["a.py"], 1, definitions=definitions, answers=failed)
    assert y.edges.filter("kind = 'calls'").count() == 0 and [tuple(r) for r in y.tiers.collect()] == [("python", "generic")]


def test_changed_files_are_entries_after_those_named(spark):
    changed = spark.createDataFrame([("b.py", "modified"), ("a.py", "added"), ("c.py", "removed")], "path string, change string")
    assert [r.entry for r in I.entry_table(spark, ["x"], changed).orderBy("entry_ord").collect()] == ["x", "a.py", "b.py"]
    with pytest.raises(ValueError):
        I.build(sources(spark, {"c.py": ""}), [], changed=changed.filter("change = 'removed'"))


def test_lineage_of_a_circle_ends(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x")]
    got = {tuple(r) for r in A.lineage(spark.createDataFrame(rows, "artifact_id string, previous string")).collect()}
    assert got == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2), ("d", "gone", 1), ("x", "y", 1), ("y", "x", 1)}


def test_lineage_shuffles_artifacts_and_no_pairs(spark):
    rows = [(c * 100 + i, c * 100 + i - 1 if i else None) for c in range(20) for i in range(64)]
    of, before = spark.createDataFrame(rows, "artifact_id long, previous long"), shuffled(spark)
    assert A.lineage(of).count() == 20 * 64 * 63 // 2
    assert shuffled(spark) - before < 25 * len(rows)


@pytest.mark.parametrize("several", [False, True])
def test_lineage_equals_a_search(spark, several):
    """Chains, trees, circles, ways into circles and ids that lead to themselves; with several previous ids an artifact too."""
    r = random.Random(4)
    links = [(i, r.randint(0, i - 1) if i % 9 else r.randint(0, 60)) for i in range(1, 50)] + [(0, 0), (70, 99), (71, 71), (72, 71)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)]
    links += [(i, r.randint(0, 60)) for i in range(0, 50, 3)] if several else []
    want = set()
    for a in {a for a, _ in links}:
        steps, layer, n = {}, {a}, 0
        while layer:
            n += 1
            layer = {q for p, q in links if p in layer} - set(steps) - ({a} if n > 1 else set())
            steps |= {x: n for x in layer}
            layer -= {a}
        want |= {(a, x, n) for x, n in steps.items()}
    got = [tuple(x) for x in A.lineage(spark.createDataFrame(links, "artifact_id long, previous long")).collect()]
    assert sorted(got) == sorted(want)


def test_notice_only_where_nothing_changed(spark):
    same, other = artifact(), artifact()
    other["index"] = {**other["index"], "files": [{"path": "a.py", "sha256": "2", "source": "x\ny"}]}
    before, after = docs(spark, same, same), docs(spark, same, other)
    assert [r.id for r in A.notice(A.changes(A.parsed(before), A.parsed(after))).collect()] == ["0"]


def test_pointers_of_steps_branches_and_flows(spark):
    e = lambda s: [{"symbol_id": s, "path": "a.py"}]
    flow = {"id": "f", "evidence": e("own"), "steps": [{"evidence": e("s0"), "branches": [{"evidence": e("b0")}, {}]}, {}]}
    of = A.parsed(docs(spark, artifact(flows=[{}, flow], concepts=[], lessons={"predict": [{"id": "p", "evidence": e("l")}]})))
    got = {(r.part, r.part_pos, r.item, r.location, r.symbol_id) for r in A.evidence(of).collect()}
    assert got == {("flows", 1, "f", "flows[1].steps[0].evidence[0]", "s0"), ("flows", 1, "f", "flows[1].steps[0].branches[0].evidence[0]", "b0"), ("lessons.predict", 0, "p", "lessons.predict[0].evidence[0]", "l")}
    assert {r.symbol_id for r in A.item_evidence(of).collect()} == {"own", "s0", "b0", "l"}


def git_tree(tmp_path):
    root = tmp_path / "shop"
    root.mkdir()
    git = lambda *w: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *w], check=True, capture_output=True)
    git("init", "-q")
    return root, git


def test_review_document_field_by_field(spark, tmp_path):
    """The whole document of a made tree: a changed, a removed and an added file, one beside them and one that is excluded."""
    root, git = git_tree(tmp_path)
    old = {"b.py": "from a import one\n\n\ndef two():\n    return one()\n\n\ndef old():\n    pass\n", "gone.py": "def lost():\n    pass\n", "a.py": "def one():\n    return 1\n", "far.py": "from b import two\n\n\ndef three():\n    return two()\n", "skip/x.py": "def s():\n    pass\n"}
    for name, text in old.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "one")
    base = R.head(str(root))
    new = {"b.py": "from a import one\n\n\ndef two():\n    return one() + 1\n\n\ndef two():\n    return 'ü'\n", "c.py": "def fresh():\n    {}.get(1)\n", "skip/x.py": "def s():\n    return 2\n"}
    for name, text in new.items():
        (root / name).write_text(text)
    (root / "gone.py").unlink()
    git("add", "-N", "c.py")
    doc = json.loads(review_document(spark, str(root), base, ["far.py"], 0, ["skip"]).first().json)
    assert doc.pop("generated_at")[-6:] == "+00:00"
    assert doc["repository"] == {"id": "shop", "root": str(root), "head_commit": R.head(str(root)), "base_commit": base}
    assert doc["changes"] == {
        "previous_head_commit": base,
        "files": [{"path": "b.py", "change": "modified", "base_source": old["b.py"]}, {"path": "c.py", "change": "added"}, {"path": "gone.py", "change": "removed", "base_source": old["gone.py"]}, {"path": "skip/x.py", "change": "modified", "base_source": old["skip/x.py"]}],
        "symbols": [{"symbol_id": "python:b:old", "change": "removed"}, {"symbol_id": "python:b:two", "change": "modified"}, {"symbol_id": "python:c:fresh", "change": "added"}, {"symbol_id": "python:gone:lost", "change": "removed"}, {"symbol_id": "python:skip.x:s", "change": "removed"}],
    }
    # skip/x.py changed, so it is an entry though no scan reads it
    assert doc["slice"] == {"entry_points": ["far.py", "b.py", "c.py", "skip/x.py"], "hop_limit": 0, "file_count": 3, "excludes": ["skip"], "truncations": []}
    index = doc["index"]
    assert index["resolution"] == {"python": "generic"}
    assert [(f["path"], f["language"], f["source"]) for f in index["files"]] == [("b.py", "python", new["b.py"]), ("c.py", "python", new["c.py"]), ("far.py", "python", old["far.py"])]
    at = lambda *x: dict(zip(("start_line", "start_character", "end_line", "end_character"), x, strict=True))
    # two stands where it was first defined, with its last definition; stubs come as the calls, then the imports lead to them
    assert [(s["symbol_id"], s["in_slice"], s["range"]) for s in index["symbols"]] == [
        ("python:b", True, at(1, 0, 10, 0)), ("python:b:two", True, at(8, 0, 9, 15)), ("python:c", True, at(1, 0, 3, 0)), ("python:c:fresh", True, at(1, 0, 2, 13)),
        ("python:far", True, at(1, 0, 6, 0)), ("python:far:three", True, at(4, 0, 5, 16)), ("python:a:one", False, at(1, 0, 2, 12)), ("python:a", False, at(1, 0, 3, 0))]
    # the name two stands for two symbols, so its calls lead nowhere
    assert index["edges"] == [
        {"from": "python:b:two", "to": "python:a:one", "kind": "calls", "resolution": "name_match", "site": {"path": "b.py", "range": at(5, 11, 5, 14)}},
        {"from": "python:b", "to": "python:a", "kind": "imports", "resolution": "exact"}, {"from": "python:far", "to": "python:b", "kind": "imports", "resolution": "exact"}]
    assert index["references"] == [
        {"path": "b.py", "range": at(5, 11, 5, 14), "symbol_id": "python:a:one"}, {"path": "b.py", "range": at(1, 14, 1, 17), "symbol_id": "python:a:one"}, {"path": "far.py", "range": at(1, 14, 1, 17), "symbol_id": "python:b:two"}]
    assert doc["stats"] == {"files_scanned": 4, "slice_symbols": 6, "boundary_symbols": 2, "edges": 3, "unresolved_calls": 2, "resolution": {"python": "generic"}}
    assert set(doc) == {"repository", "changes", "slice", "index", "stats"}


def test_files_and_symbols_of_a_cut_slice_stand_by_length(spark):
    files = sources(spark, {"a.py": "def f():\n    g()\n    pass\n", "b.py": "def g():\n    pass\n", "c.py": "def h():\n    f()\n" + "#" * 200})
    x = I.build(files, ["a.py"], 2, max_source_bytes=100)
    doc = json.loads(I.document(x, {"id": "p"}, 2).first().json)
    assert [f["path"] for f in doc["index"]["files"]] == ["b.py", "a.py"] and doc["slice"]["truncations"] == ["file dropped from slice (size budget): c.py (217 bytes)"]
    assert [s["symbol_id"] for s in doc["index"]["symbols"]] == ["python:b", "python:b:g", "python:a", "python:a:f", "python:c:h"]


def test_parts_make_the_document(spark):
    """A document written in parts, an entry a row, is the document in one row: lists in order, quotes and brackets in texts, files dropped."""
    files = sources(spark, {"a.py": "def f():\n    g(']\"[')\n    pass\n", "b.py": "def g():\n    pass\n", "c.py": "def h():\n    f()\n" + "#" * 200})
    changes = spark.createDataFrame([("b.py", "added", None), ("a.py", "modified", "[x\ny]")], "path string, change string, base_source string"), spark.createDataFrame([("b.py", "python:b:g", "added")], "path string, symbol_id string, change string")
    x = I.build(files, ["a.py", "b.py"], 2, max_source_bytes=100)
    of = (x, {"id": "p", "base_commit": "b"}, 2, ["skip"], changes)
    whole, parts = json.loads(I.document(*of).first().json), I.parts(*of)
    made = json.loads(parts.pop("").first().json)
    for place, entries in parts.items():
        section, name = place.split(".")
        assert made[section][name] == []
        made[section][name] = [json.loads(r.json) for r in entries.orderBy("slot").collect()]
    assert whole.pop("generated_at") and made.pop("generated_at")
    assert made == whole and whole["slice"]["file_count"] == 2 and len(whole["slice"]["truncations"]) == 1 and len(whole["changes"]["files"]) == 2
    assert list(made["index"]) == list(whole["index"])


def answers_of(spark, *rows):
    return spark.createDataFrame(list(rows), "request string, answer int, path string, line int, character int")


def test_usages_are_asked_for_in_the_slice_alone(spark):
    """600 usages in a file outside the slice leave the budget to the slice's own."""
    files = sources(spark, {"a.py": "from z import T\n" + "T\n" * 600, "z.py": "class T:\n    pass\n\n\ndef f():\n    return T\n"})
    service = spark.createDataFrame([("python", "srv", False)], "language string, service string, failed boolean")
    x = I.build(files, ["z.py"], 0, definitions=answers_of(spark, ("z.py:6:11", 0, "z.py", 1, 6)), answers=service)
    assert [(r.path, r.start_line, r.symbol_id) for r in x.references.collect()] == [("z.py", 6, "python:z:T")]


def test_a_usage_of_the_symbol_it_stands_in_is_a_reference(spark):
    """Only a target that begins at the usage's own place is none."""
    files = sources(spark, {"a.py": "def f():\n    return f\n"})
    service = spark.createDataFrame([("python", "srv", True, "usages")], "language string, service string, failed boolean, failed_in string")
    x = I.build(files, ["a.py"], 0, definitions=answers_of(spark, ("a.py:2:11", 0, "a.py", 1, 4)), answers=service)
    assert [(r.start_line, r.symbol_id) for r in x.references.collect()] == [(2, "python:a:f")]
    # a service that failed while it was asked for usages keeps its tier and what it found
    assert [tuple(r) for r in x.tiers.collect()] == [("python", "lsp:srv")]


def test_blocked_calls_are_unresolved(spark):
    files = sources(spark, {"a.py": "def get():\n    pass\n\n\ndef f(x):\n    x.get()\n    get()\n"})
    facts = S.facts(files)
    got = {(r.is_member, r.target) for r in I.resolve_calls(S.listed(facts, "calls"), S.symbols(facts)).collect()}
    assert got == {(True, None), (False, "python:a:get")}


def test_executors_read_hidden_names_and_excluded_folders_are_not_looked_into(spark, tmp_path):
    tree = {"pkg/__init__.py": "a = 1\n", "_own/.x.py": "", ".hidden/y.go": "package y\n", "node_modules/x/a.js": "x", "web/node_modules/b.js": "x", "gen/a_pb2.py": "x", "gen/b.py": "b", "big/m.ts": "z" * 5000, "note.md": "n"}
    for path, text in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = S.scan(spark, str(tmp_path), ["*_pb2.py"])
    assert {r.path: bytes(r.content).decode() for r in got.collect()} == {p: t for p, t in tree.items() if p not in ("node_modules/x/a.js", "web/node_modules/b.js", "gen/a_pb2.py", "note.md")}
    looked = []

    class Store:
        def get_file_info(self, selector):
            looked.append(selector.base_dir)
            return tree_source.fs.LocalFileSystem().get_file_info(selector)

    from siltstone.sources import tree as tree_source

    found, real = [], tree_source.file_system
    try:
        tree_source.file_system = lambda root: (Store(), root)
        found = [p for p, _ in tree_source.listed(str(tmp_path), ["py", "ts", "go", "js"], S.DEFAULT_EXCLUDES + ["gen"])]
    finally:
        tree_source.file_system = real
    assert found == [".hidden/y.go", "_own/.x.py", "big/m.ts", "pkg/__init__.py"] and not any("node_modules" in x or x.endswith("gen") for x in looked)


def test_files_are_dealt_to_tasks_by_size(spark, tmp_path):
    from siltstone.sources.tree import TreeReader

    for i in range(9):
        (tmp_path / f"m{i}.py").write_text("x" * 100_000)
    reader = TreeReader({"root": str(tmp_path), "partitionBytes": "450000", "extensions": "py", "excludes": ""})
    assert [len(p.paths) for p in reader.partitions()] == [3, 3, 3]
    (tmp_path / "m1.py").unlink()  # gone since it was listed
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 8


def test_broken_python_is_read_in_time_that_grows_with_its_lines():
    import time

    took = []
    for n in (1000, 8000):
        text = "class A:\n    def f(self):\n" + "".join(f"        print 'x{i}'\n        go{i}(1)\n" for i in range(n))
        start = time.perf_counter()
        f = PythonFacts("m", text)
        took.append(time.perf_counter() - start)
        assert not f.whole and len(f.calls) == n and [s["span"] for s in f.symbols] == [(1, 0, 2 * n + 2, f.calls[-1][3][3] + 3), (2, 4, 2 * n + 2, f.calls[-1][3][3] + 3)]
    assert took[1] < 30 * took[0] + 1


def test_clauses_of_a_broken_statement_are_read_each():
    text = "if a(1):\n    x = = 1\n    b(2)\nelif c(3):\n    d(4)\nelse:\n    print 'y'\n    e(5)\n@deco\ndef f(\n    q,\n):\n    return (\n        g(6)\n    )\n    z z\ntry:\n    h(7)\nexcept E as x:\n    i(8)\nfoo(\n"
    f = PythonFacts("m", text)
    assert [(o, n, s[:2]) for o, n, _, s in f.calls] == [("python:m", "a", (1, 3)), ("python:m", "b", (3, 4)), ("python:m", "c", (4, 5)), ("python:m", "d", (5, 4)), ("python:m", "e", (8, 4)), ("python:m:f", "g", (14, 8)), ("python:m:f", "deco", (9, 1)), ("python:m", "h", (18, 4)), ("python:m", "i", (20, 4))]
    assert [(s["qualname"], s["span"]) for s in f.symbols] == [("f", (9, 0, 16, 8))]


def test_strict_checks_of_ranges_and_hashes(spark):
    import hashlib

    from siltstone.sources import strict as ST

    source = "añb\n\nlast"
    raw = source.encode().split(b"\n")
    at = lambda a, b, c, d: {"start_line": a, "start_character": b, "end_line": c, "end_character": d}
    text = lambda a, b, c, d: (raw[a - 1][b:d] if a == c else b"\n".join([raw[a - 1][b:], *raw[a : c - 1], raw[c - 1][:d]]))
    of = lambda r: "sha256:" + hashlib.sha256(text(*r)).hexdigest()
    ranges = [(1, 0, 1, 4), (1, 1, 3, 2), (2, 0, 2, 0), (3, 0, 3, 4), (1, 3, 2, 0)]
    good = [{"path": "p", "range": at(*r), "content_hash": of(r)} for r in ranges]
    beyond = {"path": "p", "range": at(9, 0, 9, 1), "content_hash": of((1, 0, 1, 1))}
    doc = {"index": {"files": [{"path": "p", "source": source}]}, "concepts": [{"id": "c", "evidence": [*good, beyond, {"path": "q", "range": at(1, 0, 1, 1), "content_hash": "x"}]}], "flows": [{"id": "c", "steps": []}]}
    bad = {**doc, "concepts": [{"id": "c", "evidence": [{**x, "content_hash": "sha256:0"} for x in good]}], "findings": [{"id": f"f{i % 5}", "severity": "warning"} for i in range(6)]}
    got = sorted((r.id, r.location, r.message) for r in ST.strict(A.parsed(docs(spark, doc, bad))).collect())
    assert [r for r in got if r[0] == "0"] == []
    assert [r[1:] for r in got] == [*((f"concepts[0].evidence[{i}]", f"content_hash is not that of p L{r[0]}-L{r[2]}") for i, r in enumerate(ranges)), ("findings", "6 warning findings, published are at most 5"), ("findings", "id f0 is given 2 times")]


def test_documents_keep_their_kind_of_id(spark):
    of = docs(spark, artifact(), artifact(extra=1)).selectExpr("cast(id as long) as id", "json")
    assert {(r.id, r.location) for r in A.check(of, RULES).collect()} == {(1, "(root)")}
    assert A.redact(of).schema["id"].dataType.typeName() == "long"


def test_files_of_one_split_are_parsed_by_several_tasks(spark):
    rows = spark.range(0, 400, 1, 1).selectExpr("concat('m', id, '.py') as path", "concat('def f', id, '(): pass') as content")
    facts = S.unwritten_facts(S.files(rows))
    tasks = facts.select(F.spark_partition_id().alias("task"), F.size("symbols").alias("n")).collect()
    assert len(tasks) == 400 and {r.n for r in tasks} == {1}
    assert len({r.task for r in tasks}) >= 4


def test_first_rows_of_a_long_key_are_ranked_in_pieces(spark):
    rows = spark.range(0, 6000, 1, 3).selectExpr("if(id % 3 = 0, 'a', if(id % 3 = 1, null, concat('k', id % 30))) as k", "id * 7919 % 6007 as o", "id")
    kept = K.first_per_key(rows, ["k"], ["o"], 1500)
    assert kept.columns == rows.columns
    want = {}
    for r in rows.orderBy("o").collect():
        want.setdefault(r.k, []).append(r.id)
    assert sorted(r.id for r in kept.collect()) == sorted(i for ids in want.values() for i in ids[:1500])
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "_k_piece" in plan  # no window over a whole key's rows


def test_facts_of_all_kinds_keep_their_places(spark):
    """Lists, empty ones among them, come back as they were read, file by file."""
    rows = [("a.py", "import os\nfrom b import c\n\n\ndef f(x):\n    return x.g()\n"), ("b.py", ""), ("c.py", "c.d(e)\n")]
    facts = {r.path: r for r in S.facts(S.files(spark.createDataFrame(rows, "path string, content string"))).collect()}
    for path, source in rows:
        own, of = facts[path], PythonFacts(path[0], source)
        assert own.parsed and own.targets == of.targets
        assert [tuple(x) for x in own.calls] == [(*c[:3], *c[3]) for c in of.calls] and [tuple(x) for x in own.usages] == [(*u[:2], *u[2]) for u in of.usages]
        assert [tuple(x) for x in own.names] == [(*n[1:], *n[0]) for n in of.names]
        assert [{k: v for k, v in x.asDict().items() if not k.startswith(("start_", "end_"))} for x in own.symbols] == [{k: v for k, v in s.items() if k != "span"} for s in of.symbols]
        assert [(x.start_line, x.start_character, x.end_line, x.end_character) for x in own.symbols] == [s["span"] for s in of.symbols]


def test_facts_asked_for_alone_are_those_of_all(spark):
    """Some relations are parsed without the others, which are no columns then; what they hold stays the same."""
    rows = [
        ("a.py", "import os\nif os:\n    try:\n        from b import c\n    except E:\n        def g(): pass\n    finally:\n        import d\n\n\n@t.u(1)\nclass K:\n    async def f(self, x=lambda: y()):\n        with x as z:\n            def h(): return z.w()\n"),
        ("b.py", "def a():\n    return 1\n\n\ndef b(:\n    pass\n\n\nclass D:\n    def run(self):\n        x = = 2\n        import e\n        return a()\n"),
        ("c.ts", "import { q } from './a';\nexport const m = (a: T) => `x${b.map(() => { const g = () => 1; return g(); })}`;\nclass A { open() { return /a[/]/.test(q) / 2; } }\n"),
        ("d/x.go", 'package d\n\nimport "app/e"\n\nfunc (b *Box) Open() int {\n\treturn e.Make(b) / 2 // no\n}\n'),
    ]
    of = S.files(spark.createDataFrame(rows, "path string, content string"))
    known = {r.path: r for r in S.facts(of).collect()}
    assert all(len(r.symbols) > 0 for r in known.values())
    for only in (["symbols"], ["targets"], ["names", "targets"], ["calls"], ["calls", "symbols"], ["usages"], []):
        some = S.facts(of, only=only)
        assert [c for c in some.columns if c in S.RELATIONS] == [c for c in known["a.py"].__fields__ if c in only]
        assert {r.path: r for r in some.collect()} == {p: type(r)(**{c: r[c] for c in some.columns}) for p, r in known.items()}
    with pytest.raises(ValueError):
        S.facts(of, only=["symbol"])


def test_facts_without_texts_keep_their_relations(spark):
    """Texts are not written where relations alone are read; the module's last line is still known."""
    rows = [("a.py", "import os\n\n\ndef f(): pass\n"), ("b/c.ts", "import { q } from './a';\n\nexport const m = (a: T) => q(a)"), ("d.go", "")]
    of = S.files(S.spread(spark.createDataFrame(rows, "path string, content string")))
    whole, bare = S.facts(of), S.unwritten_facts(of, text=False, dealt=True)
    assert "source" not in bare.columns and {r.path: r.n_lines for r in bare.collect()} == {p: x.count("\n") + 1 for p, x in rows}
    assert sorted(map(str, S.symbols(bare).collect())) == sorted(map(str, S.symbols(whole).collect()))
    assert sorted(map(str, S.listed(bare, "usages").collect())) == sorted(map(str, S.listed(whole, "usages").collect()))
    assert bare._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_imports_alone_are_read_without_what_follows_them(monkeypatch):
    """Nothing behind the last import is walked through, and no text is hashed for symbols that are not asked for."""
    from siltstone.sources import brace_facts

    text = "import { a } from './x';\nif (b) { import('c'); }\nimport d from './y';\n" + "class K { open() { return a.b(c); } }\n" * 20
    for language, source in (("typescript", text), ("go", 'package p\n\nimport "app/x"\n\n' + "func F(a int) int {\n\treturn g(a)\n}\n" * 20)):
        whole, seen = BraceFacts(language, "app/m", source), []
        monkeypatch.setattr(brace_facts, "digest", lambda x, seen=seen: seen.append(x) or x)
        monkeypatch.setattr(BraceFacts, "_read", lambda self, parts, n, scope, owner, seen=seen: seen.append(parts) if parts[0][1] > self.last else None)
        some = BraceFacts(language, "app/m", source, only=["targets", "names"])
        assert (some.targets, some.names) == (whole.targets, whole.names) and whole.targets
        assert not seen
        monkeypatch.undo()

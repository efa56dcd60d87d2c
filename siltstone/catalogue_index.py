"""Registered queries of definition services, reviews, references, documents and their checks, over texts made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.catalogue_sources import AROUND, GO, OTHER, PYTHON, STUBS, P, _artifacts, _chain, _python, _render, _slice, _snapshot
from siltstone.functions import text as T
from siltstone.operators import diff as D
from siltstone.operators import graph as G
from siltstone.plans import architecture as AM
from siltstone.plans import index as I
from siltstone.plans import marts as M
from siltstone.plans import panes as V
from siltstone.registry import query
from siltstone.sources import artifacts as A
from siltstone.sources import revisions as R
from siltstone.sources import snapshot as S
from siltstone.sources import store, tree
from siltstone.sources import strict as ST

# definition services and tiers


def _calls_of_helpers(t):
    """Answers for each call of a helper: first a place in the class, whose name differs, then the helper's own."""
    rows = t("part").select(F.expr("concat('m', p_partkey, '.py:7:15')").alias("request"), F.expr(f"concat('m', {OTHER}, '.py')").alias("path"))
    places = F.array(*(F.struct(F.lit(a).alias("answer"), F.lit(n).alias("line"), F.lit(c).alias("character")) for a, n, c in ((0, 6, 8), (1, 10, 4))))
    return rows.select("request", "path", F.explode(places).alias("x")).select("request", "x.answer", "path", "x.line", "x.character")


@query(f"WITH {P} SELECT 'm' || k || '.py:7:15' AS request, 'python:m' || o || ':helper' || o AS target FROM p, known WHERE o <= top")
def location_targets(t):
    facts = _python(t, "symbols", "calls")
    asked = S.listed(facts, "calls").withColumn("request", I.call_request()).filter("name like 'helper%'").select("request", "name")
    return I.resolve_locations(asked, _calls_of_helpers(t), S.symbols(facts)).filter("target is not null").select("request", "target")


def _tiers(t):
    """Python's service answers; Go's fails."""
    return t("part").sparkSession.createDataFrame([("python", "pysrv", False), ("go", "gosrv", True)], "language string, service string, failed boolean")


def _two_languages(t):
    part = t("part")
    python = part.filter("p_partkey % 2 = 0").select(F.expr("concat('m', p_partkey, '.py')").alias("path"), _render(PYTHON, "p_partkey", other="p_partkey").alias("content"))
    go = part.filter("p_partkey % 2 = 1").select(F.expr("concat('m', p_partkey, '/x.go')").alias("path"), _render(GO, "p_partkey", other="p_partkey").alias("content"))
    return S.facts(S.files(python.union(go)), only=["symbols", "calls"])


@query("SELECT language, tier FROM (VALUES ('python', 'lsp:pysrv', 0), ('go', 'generic', 1)) v(language, tier, r) WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey % 2 = r)")
def resolution_tiers(t):
    return I.served(_two_languages(t), _tiers(t))


@query("SELECT 'python:m' || p_partkey || ':C' || p_partkey || '.run' AS enclosing, 'python:m' || p_partkey || ':helper' || p_partkey AS target, 'lsp' AS resolution FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'go:m' || p_partkey || '/x:Box' || p_partkey || '.Open', 'go:m' || p_partkey || '/x:Make' || p_partkey, 'name_match' FROM part WHERE p_partkey % 2 = 1")
def tiered_calls(t):
    """Calls that lead somewhere: by the service's answers in Python, by names in Go, whose service failed."""
    facts, answers = _two_languages(t), t("part").select(F.expr("concat('m', p_partkey, '.py:7:15')").alias("request"), F.lit(0).alias("answer"), F.expr("concat('m', p_partkey, '.py')").alias("path"), F.lit(10).alias("line"), F.lit(4).alias("character"))
    found = I.tiered_calls(S.listed(facts, "calls"), S.symbols(facts), I.served(facts, _tiers(t)), answers)
    return found.filter("target is not null").select("enclosing", "target", "resolution")


@query("SELECT 'm' || p_partkey || '.py' AS path, 11::INTEGER AS start_line, 15 + length(p_partkey::VARCHAR) AS start_character, 'python:m' || p_partkey || ':C' || p_partkey || '.run' AS symbol_id FROM part")
def usage_references(t):
    """The service's answers for the usages of `run`, of all that are asked for."""
    facts = _python(t, "symbols", "usages")
    symbols = S.symbols(facts)
    asked = I.usage_requests(facts, symbols, most=1 << 30).withColumn("request", I.call_request())
    answers = t("part").select(F.expr("concat('m', p_partkey, '.py:11:', 15 + length(cast(p_partkey as string)))").alias("request"), F.lit(0).alias("answer"), F.expr("concat('m', p_partkey, '.py')").alias("path"), F.lit(6).alias("line"), F.lit(8).alias("character"))
    return I.usage_references(asked, answers, symbols).select("path", "start_line", F.col("start_character").cast("long"), "symbol_id")


@query(f"WITH {P} SELECT 'python' AS language, least(sum(3 + (o <= top)::INTEGER), 500)::BIGINT AS asked FROM p, known HAVING count(*) > 0")
def usage_budget(t):
    """Of each file the usages of its class, of `run` and of a helper that there is, in a budget of 500 requests."""
    facts = _python(t, "symbols", "usages")
    return I.usage_requests(facts, S.symbols(facts)).groupBy("language").agg(F.count("*").alias("asked"))


@query(f"WITH {P} SELECT 'm' || k || '.py' AS path, 'python:m' || o || ':helper' || o AS symbol_id FROM p, known WHERE o <= top")
def import_name_references(t):
    facts = _python(t, "symbols", "names")
    return I.name_references(facts, S.symbols(facts)).select("path", "symbol_id")


@query("SELECT 'python:m' || p_partkey || e AS enclosing, name, n::BIGINT AS copies FROM part, LATERAL (VALUES (':C' || p_partkey || '.run', 'self', 1), (':C' || p_partkey || '.run', 'x', 2), (':C' || p_partkey || '.run', 'helper' || (p_partkey % 100 + 1), 1), (':helper' || p_partkey, 'y', 2), (':helper' || p_partkey, 'run', 1), (':helper' || p_partkey, 'C' || p_partkey, 2)) v(e, name, n)")
def usages(t):
    return S.listed(_python(t, "usages", once=True), "usages").groupBy("enclosing", "name").agg(F.count("*").alias("copies"))


DECORATED = "@mark{key}\n@other.tag(level({key}))\ndef f{key}():\n    pass\n\n\ndef mark{key}(f):\n    return f\n"


@query("SELECT 'python:m' || p_partkey || ':f' || p_partkey AS enclosing, name, m AS is_member FROM part, LATERAL (VALUES ('mark' || p_partkey, false), ('tag', true), ('level', false)) v(name, m)")
def decorator_calls(t):
    return S.listed(_snapshot(t, DECORATED, "concat('m', p_partkey, '.py')", ["calls"], once=True), "calls").select("enclosing", "name", "is_member").distinct()


BROKEN = "def a{key}():\n    return 1\n\n\ndef b{key}(:\n    pass\n\n\nclass D{key}:\n    def run(self):\n        x = = 2\n        return a{key}()\n"


@query("SELECT 'python:m' || p_partkey || q AS symbol_id, a::INTEGER AS start_line, b::INTEGER AS end_line, false AS parsed FROM part, LATERAL (VALUES (':a' || p_partkey, 1, 2), (':D' || p_partkey, 9, 12), (':D' || p_partkey || '.run', 10, 12)) v(q, a, b)")
def broken_files(t):
    """Files with errors keep what the statements without one define."""
    facts = _snapshot(t, BROKEN, "concat('m', p_partkey, '.py')", ["symbols"])
    return S.symbols(facts).filter("kind <> 'module'").join(facts.select("path", "parsed"), "path").select("symbol_id", "start_line", "end_line", "parsed")


SAME = "export const make{key} = (a: number) => a;\nexport const use{key} = () => make{key}(1);\n"


@query("SELECT language || ':m' || p_partkey || ':use' || p_partkey AS src, language || ':m' || p_partkey || ':make' || p_partkey AS dst FROM part, LATERAL (VALUES ('typescript'), ('javascript')) v(language)")
def calls_within_a_language(t):
    """Equal names in two languages are each unique in theirs."""
    part = t("part")
    rows = [part.select(F.expr(f"concat('m', p_partkey, '.{e}')").alias("path"), _render(SAME, "p_partkey").alias("content")) for e in ("ts", "js")]
    facts = S.facts(S.files(rows[0].union(rows[1])), only=["symbols", "calls"])
    found = I.resolve_calls(S.listed(facts, "calls"), S.symbols(facts)).filter("target is not null")
    return found.select(F.col("enclosing").alias("src"), F.col("target").alias("dst"))


# entries and reviews


@query("""WITH e(entry) AS (VALUES ('m7.py'), ('./m9.py'), ('C11.run'), ('helper12'), ('python:m13:C13'), ('nothing')), f AS (SELECT entry, p_partkey AS k FROM e JOIN part ON ltrim(entry, './') = 'm' || p_partkey || '.py'),
 s AS (SELECT p_partkey AS k, q FROM part, LATERAL (VALUES (''), (':C' || p_partkey), (':C' || p_partkey || '.run'), (':helper' || p_partkey)) v(q))
 SELECT entry, 'python:m' || k || q AS symbol_id FROM f JOIN s USING (k) UNION ALL SELECT entry, 'python:m' || k || q FROM e JOIN s ON q <> '' AND (entry = replace(q, ':', '') OR entry = 'python:m' || k || q) WHERE entry NOT IN (SELECT entry FROM f)""")
def entry_ends(t):
    """Entries by path, by the end of a path, by qualified name and by id."""
    facts = _python(t, "symbols")
    symbols = S.symbols(facts)
    entries = facts.sparkSession.createDataFrame([(e,) for e in ("m7.py", "./m9.py", "C11.run", "helper12", "python:m13:C13", "nothing")], "entry string")
    return I.match_symbols(entries, facts, symbols, symbols)


@query("SELECT 'm' || s_suppkey || '.py' AS entry, 1::INTEGER AS after_named, 'm' || s_suppkey || '.py' AS place FROM supplier WHERE s_suppkey % 3 <> 0")
def review_entries(t):
    """The changed files that are still there, as entries of the index."""
    changed = t("supplier").select(F.expr("concat('m', s_suppkey, '.py')").alias("path"), F.expr("element_at(array('removed', 'added', 'modified'), cast(s_suppkey % 3 + 1 as int))").alias("change"))
    entries = I.entry_table(changed.sparkSession, [], changed)
    return entries.select("entry", F.col("entry_ord.g").alias("after_named"), F.col("entry_ord.path").alias("place"))


@query("WITH near AS (SELECT p_partkey AS k FROM part WHERE EXISTS (SELECT 1 FROM (VALUES (5), (84)) v(e) WHERE abs(p_partkey - e) <= 1)) SELECT 'm' || k || '.py' AS path FROM near")
def review_slice(t):
    """The slice one hop about a review's files; the removed one is no entry."""
    changed = t("part").filter("p_partkey in (5, 84, 120)").select(F.expr("concat('m', p_partkey, '.py')").alias("path"), F.expr("if(p_partkey = 120, 'removed', 'modified')").alias("change"))
    return I.build(_chain(t), [], 1, changed=changed).files.select("path")


#: A later snapshot: of four files one changes a function, one goes, one stays and one comes.
LATER = PYTHON.replace("run(y)", "run(y + 1)")


def _two_snapshots(t):
    """(changed, before, after) of two snapshots, changes by path and hash."""
    part = t("part").select(F.expr("concat('m', p_partkey, '.py')").alias("path"), _render(PYTHON, "p_partkey", other=OTHER).alias("old"), _render(LATER, "p_partkey", other=OTHER).alias("new"), (F.col("p_partkey") % 4).alias("r"))
    before = S.facts(S.files(part.filter("r <> 3").select("path", F.col("old").alias("content"))))
    after = S.facts(S.files(part.filter("r <> 1").select("path", F.expr("if(r = 0, new, old)").alias("content"))))
    return D.snapshot_diff(before, after, ["path"], "sha256"), before, after


CHANGED = """SELECT 'm' || p_partkey || '.py' AS path, ['modified', 'removed', '', 'added'][p_partkey % 4 + 1] AS change, p_partkey AS k FROM part WHERE p_partkey % 4 <> 2"""


@query(f"""WITH c AS ({CHANGED}) SELECT path, change, NULL AS symbol_id, CASE WHEN change <> 'added' THEN 'import os' END AS base FROM c
 UNION ALL SELECT path, change, 'python:m' || k || ':' || q, NULL FROM c, LATERAL (VALUES ('C' || k, change <> 'modified'), ('C' || k || '.run', change <> 'modified'), ('helper' || k, true)) v(q, there) WHERE there""")
def review_changes(t):
    """Changed files with the first line of their text at the base, and changed symbols."""
    files, symbols = R.review_changes(*_two_snapshots(t))
    rows = files.select("path", "change", F.lit(None).cast("string").alias("symbol_id"), F.split("base_source", "\n")[0].alias("base"))
    return rows.union(symbols.select("path", "change", "symbol_id", F.lit(None).cast("string")))


@query(f"""WITH c AS ({CHANGED}), e AS (SELECT path FROM c WHERE change <> 'removed')
 SELECT 'file' AS part, path AS name, change FROM c UNION ALL SELECT 'symbol', 'python:m' || k || ':' || q, change FROM c, LATERAL (VALUES ('C' || k, change <> 'modified'), ('C' || k || '.run', change <> 'modified'), ('helper' || k, true)) v(q, there) WHERE there
 UNION ALL SELECT 'entry', path, NULL FROM e UNION ALL SELECT 'slice', path, NULL FROM e""")
def review_document(t):
    """The changes, entries and files of a review's document without hops, written in parts and read back from their JSON."""
    changed, before, after = _two_snapshots(t)
    index = I.build(after, [], 0, max_source_bytes=1 << 40, changed=changed, facts=after)
    parts = I.parts(index, {"id": "parts", "base_commit": "b"}, 0, changes=R.review_changes(changed, before, after))
    held = {place: G.written(of, "document") for place, of in parts.items()}

    def rows(part, place, kind, name="x.path", change="cast(null as string)"):
        entry = F.from_json(F.concat(F.lit("["), "json", F.lit("]")), f"array<{kind}>")
        return held[place].select(F.explode(entry).alias("x")).select(F.lit(part).alias("part"), F.expr(name).alias("name"), F.expr(change).alias("change"))

    out = rows("file", "changes.files", "struct<path:string,change:string>", change="x.change")
    out = out.union(rows("symbol", "changes.symbols", "struct<symbol_id:string,change:string>", "x.symbol_id", "x.change"))
    return out.union(rows("entry", "slice.entry_points", "string", "x")).union(rows("slice", "index.files", "struct<path:string>"))


@query("SELECT 'm' || p_partkey || '.py' AS path, 3::BIGINT AS symbols, 'sha256:' || sha256(replace(replace(replace(CASE WHEN p_partkey % 10 = 0 THEN '" + LATER.replace("\n", "' || chr(10) || '") + "' ELSE '" + PYTHON.replace("\n", "' || chr(10) || '") + "' END, '{key}', p_partkey::VARCHAR), '{other}', (" + OTHER + ")::VARCHAR), chr(13), '')) AS sha256, (SELECT count(*) FROM part WHERE p_partkey % 10 <> 0)::BIGINT AS known, (SELECT count(*) FROM part WHERE p_partkey % 10 = 0)::BIGINT AS computed FROM part")
def fact_store(t):
    """Facts of a second snapshot, in which every tenth file changed, from the store that the first one filled."""
    part = t("part").select(F.expr("concat('m', p_partkey, '.py')").alias("path"), _render(PYTHON, "p_partkey", other=OTHER).alias("old"), _render(LATER, "p_partkey", other=OTHER).alias("new"), (F.col("p_partkey") % 10).alias("r"))
    path = f"{G.shared_dir(part.sparkSession)}/store-{uuid.uuid4().hex}"
    store.facts(S.files(part.select("path", F.col("old").alias("content"))), path)
    found = store.facts(S.files(part.select("path", F.expr("if(r = 0, new, old)").alias("content"))), path)
    return found.rows.select("path", F.size("symbols").cast("long").alias("symbols"), "sha256", F.lit(found.known).cast("long").alias("known"), F.lit(found.computed).cast("long").alias("computed"))


@query(f"""WITH c AS (SELECT c.*, {OTHER.replace('p_partkey', 'k')} AS o FROM ({CHANGED}) c), whole AS (SELECT path, change, k, q, n, text FROM c, LATERAL (VALUES ('C' || k, 1, 'class C' || k || ':'), ('C' || k, 2, '    def run(self, x):'), ('C' || k, 3, '        return helper' || o || '(x)'),
 ('C' || k || '.run', 1, 'def run(self, x):'), ('C' || k || '.run', 2, '        return helper' || o || '(x)'), ('helper' || k, 1, 'def helper' || k || '(y):'), ('helper' || k, 2, '    return C' || k || '().run(y)')) v(q, n, text) WHERE change <> 'modified')
 SELECT path, 'python:m' || k || ':' || q AS symbol_id, change, CASE change WHEN 'added' THEN '+' ELSE '-' END AS op, CASE WHEN change = 'removed' THEN n END AS old_line, CASE WHEN change = 'added' THEN n END AS new_line, text FROM whole
 UNION ALL SELECT path, 'python:m' || k || ':helper' || k, change, op, x, y, text FROM c, LATERAL (VALUES (' ', 1, 1, 'def helper' || k || '(y):'), ('-', 2, NULL, '    return C' || k || '().run(y)'), ('+', NULL, 2, '    return C' || k || '().run(y + 1)')) v(op, x, y, text) WHERE change = 'modified'""")
def diff_view(t):
    """The lines of all changed symbols of two snapshots."""
    changed, before, after = _two_snapshots(t)
    return V.diff_view(R.review(changed, before, after), before, after)


CIRCLES = "import m{next}\nimport m{far}\n"


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS k FROM supplier), e AS (SELECT x.k AS a, y.k AS b FROM s x JOIN s y ON y.k <> x.k AND (y.k = x.k // 4 * 4 + (x.k + 1) % 4 OR (x.k % 8 = 0 AND y.k = x.k + 4))),
 r(a, b) AS (SELECT k, k FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), comp AS (SELECT x.a AS k, min('python:m' || x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
 links AS (SELECT DISTINCT p.component AS a, q.component AS b FROM e JOIN comp p ON p.k = e.a JOIN comp q ON q.k = e.b WHERE p.component <> q.component), l(c, n) AS (SELECT component, 0::BIGINT FROM comp UNION SELECT links.a, n + 1 FROM l JOIN links ON links.b = l.c)
 SELECT 'python:m' || k AS module, component, count(*) OVER (PARTITION BY component)::BIGINT AS size, (SELECT max(n) FROM l WHERE c = component)::BIGINT AS layer FROM comp""")
def architecture_map(t):
    """Files, one a supplier, that import each other in circles of four, some circles another."""
    of = {"next": "s_suppkey div 4 * 4 + (s_suppkey + 1) % 4", "far": "if(s_suppkey % 8 = 0, s_suppkey + 4, s_suppkey)"}
    facts = S.facts(S.files(t("supplier").select(F.expr("concat('m', s_suppkey, '.py')").alias("path"), _render(CIRCLES, "s_suppkey", **of).alias("content"))))
    symbols = S.symbols(facts)
    return AM.architecture(I.import_edges(facts, symbols), symbols.filter("kind = 'module'"))[0]


@query("""WITH h AS (SELECT l_orderkey AS k, l_linenumber AS a, l_linenumber + 1 + l_suppkey % 5 AS b, l_returnflag AS label FROM lineitem), p AS (SELECT DISTINCT k, x FROM (SELECT k, a AS x FROM h UNION ALL SELECT k, b FROM h)),
 r AS (SELECT k, x AS a, lead(x) OVER (PARTITION BY k ORDER BY x) AS b FROM p)
 SELECT 'o' || r.k AS path, r.a::BIGINT AS a, r.b::BIGINT AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, repeat('x', (r.b - r.a)::INTEGER) AS text FROM r JOIN h ON h.k = r.k AND h.a <= r.a AND h.b >= r.b GROUP BY r.k, r.a, r.b""")
def highlight_runs(t):
    """A line an order, its items' highlights overlapping."""
    files = t("orders").select(F.expr("concat('o', o_orderkey)").alias("path"), F.lit("x" * 20).alias("source"))
    spans = t("lineitem").selectExpr("concat('o', l_orderkey) as path", "1 as start_line", "cast(l_linenumber as int) as start_character", "1 as end_line", "cast(l_linenumber + 1 + l_suppkey % 5 as int) as end_character", "l_returnflag as label")
    runs = V.highlight_runs(files, spans)
    return runs.select("path", F.col("start_character").cast("long").alias("a"), F.col("end_character").cast("long").alias("b"), F.array_join("labels", ",").alias("labels"), "text")


# graphs of an index


def _calls(t):
    facts = _python(t, "symbols", "calls")
    return I.call_edges(I.tiered_calls(S.listed(facts, "calls"), S.symbols(facts), I.served(facts, None), None))


def _imports(t):
    facts = _python(t, "targets")
    return I.import_edges(facts, facts)


@query(f"WITH {P} SELECT 'python:m' || k || ':C' || k || '.run' AS src, 'python:m' || o || ':helper' || o AS dst, 1::BIGINT AS sites FROM p, known WHERE o <= top UNION ALL SELECT 'python:m' || k || ':helper' || k, 'python:m' || k || ':C' || k, 2 FROM p")
def call_graph(t):
    return M.call_graph(_calls(t))


@query(f"WITH {P} SELECT 'python:m' || k AS src, 'python:m' || o AS dst, 1::BIGINT AS sites FROM p, known WHERE o <= top AND o <> k")
def import_graph(t):
    return M.import_graph(_imports(t))


@query(f"WITH {P} SELECT 'python:m' || o || ':helper' || o AS symbol_id, 'python:m' || k || ':C' || k || '.run' AS caller, 1::BIGINT AS sites FROM p, known WHERE o <= top AND o % 10 = 0")
def callers(t):
    wanted = t("part").filter("p_partkey % 10 = 0").select(F.expr("concat('python:m', p_partkey, ':helper', p_partkey)").alias("symbol_id"))
    return M.callers(_calls(t), wanted)


@query("SELECT 'python:m' || p_partkey || ':helper' || p_partkey AS symbol_id, 'python:m' || p_partkey || ':C' || p_partkey AS callee, 2::BIGINT AS sites FROM part WHERE p_partkey % 10 = 0")
def callees(t):
    wanted = t("part").filter("p_partkey % 10 = 0").select(F.expr("concat('python:m', p_partkey, ':helper', p_partkey)").alias("symbol_id"))
    return M.callees(_calls(t), wanted)


@query(f"""WITH RECURSIVE {AROUND}, {STUBS} SELECT 'python:m' || k || ':f' || k AS symbol_id FROM t WHERE k NOT IN (SELECT k FROM near)""")
def slice_stubs(t):
    """Symbols outside the slice that kept calls lead to."""
    return _slice(t).symbols.filter("not in_slice").select("symbol_id")


# snapshots of a folder


def _write_files(root: str):
    """What writes rows (path, content) as files under root, wherever the rows are."""

    def write(rows) -> None:
        store, base = tree.file_system(root)
        for r in rows:
            store.create_dir(f"{base}/{r.path.rpartition('/')[0]}")
            with store.open_output_stream(f"{base}/{r.path}") as f:
                f.write(r.content.encode())

    return write


@query("SELECT 'a/m' || s_suppkey || '.py' AS path, 'a.m' || s_suppkey AS module, 'sha256:' || sha256('x' || s_suppkey || chr(10)) AS sha256 FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'b/k' || s_suppkey || '/__init__.py', 'b.k' || s_suppkey, 'sha256:' || sha256('x' || s_suppkey || chr(10)) FROM supplier WHERE s_suppkey % 5 = 1")
def folder_scan(t):
    """A folder of files, one a supplier, written by tasks: packages' own files too, others in folders that are left out or
    of no known language."""
    supplier = t("supplier")
    spark, place = supplier.sparkSession, "element_at(array('a/m{}.py', 'b/k{}/__init__.py', 'skip/m{}.py', 'a/node_modules/m{}.js', 'a/m{}.txt'), cast(s_suppkey % 5 + 1 as int))"
    root = f"{G.shared_dir(spark)}/folder-{uuid.uuid4().hex}"
    spark.createDataFrame([("",)], "x string").coalesce(1).write.text(root)
    rows = supplier.select(F.expr(f"replace({place}, '{{}}', cast(s_suppkey as string))").alias("path"), F.expr("concat('x', s_suppkey, '\n')").alias("content"))
    rows.foreachPartition(_write_files(tree.resolved(spark, root)))
    return S.files(S.scan(spark, root, ["skip"])).select("path", "module", "sha256")


# documents


@query("SELECT id, part, i::INTEGER AS part_pos, 'findings[' || i || '].evidence[0]' AS location, symbol_id, path FROM (SELECT l_orderkey AS id, 'findings' AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'p' || l_partkey, 's' || l_suppkey) - 1 AS i, 's' || (l_suppkey + l_linenumber % 2) AS symbol_id, 'p' || l_partkey AS path FROM lineitem)")
def evidence_pointers(t):
    return A.evidence(A.parsed(_artifacts(t))).select("id", "part", "part_pos", "location", "symbol_id", "path")


def _documents(t, hash_of: str = "s_suppkey"):
    """An artifact a supplier k. Its symbol's file is missing for odd k, its parent for k of three, its reference's symbol for
    k of five; one stale id of seven is unknown."""
    json = f"""concat('{{"artifact_id":"art_', s_suppkey, '","title":"Parts & ', s_suppkey, '","repository":{{"head_commit":"h"}},"index":{{"files":[{{"path":"', if(s_suppkey % 2 = 0, 'p', 'q'), s_suppkey, '","sha256":"1","source":"a"}}],"symbols":[{{"symbol_id":"s', s_suppkey, '","path":"p', s_suppkey, '","content_hash":"', cast({hash_of} as string), '",', if(s_suppkey % 3 = 0, concat('"parent":"none', s_suppkey, '",'), ''), '"in_slice":true}}],"edges":[],"references":[{{"path":"p', s_suppkey, '","symbol_id":"', if(s_suppkey % 5 = 0, 'z', 's'), s_suppkey, '"}}]}},"concepts":[{{"id":"c', s_suppkey, '","evidence":[{{"symbol_id":"s', s_suppkey, '","path":"p', s_suppkey, '"}}]}}],"changes":{{"stale_items":["c', s_suppkey, '"', if(s_suppkey % 7 = 0, ',"gone"', ''), ']}}}}')"""
    return t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.expr(json).alias("json"))


GAPS = """SELECT s_suppkey::VARCHAR AS id, 'index' AS location, 'in_slice symbol s' || s_suppkey || ' has no source file p' || s_suppkey AS message FROM supplier WHERE s_suppkey % 2 = 1
 UNION ALL SELECT s_suppkey::VARCHAR, 'index', 'symbol s' || s_suppkey || ' parent none' || s_suppkey || ' not in symbols' FROM supplier WHERE s_suppkey % 3 = 0
 UNION ALL SELECT s_suppkey::VARCHAR, 'index', 'references[0].path p' || s_suppkey || ' not in files' FROM supplier WHERE s_suppkey % 2 = 1
 UNION ALL SELECT s_suppkey::VARCHAR, 'index', 'references[0].symbol_id z' || s_suppkey || ' not in symbols' FROM supplier WHERE s_suppkey % 5 = 0
 UNION ALL SELECT s_suppkey::VARCHAR, 'concepts[0].evidence[0]', 'path p' || s_suppkey || ' not in index.files' FROM supplier WHERE s_suppkey % 2 = 1
 UNION ALL SELECT s_suppkey::VARCHAR, 'changes.stale_items', 'unknown id gone' FROM supplier WHERE s_suppkey % 7 = 0"""


@query(GAPS)
def artifact_gaps(t):
    return A.integrity(A.parsed(_documents(t)))


RULES = {
    "type": "object", "required": ["artifact_id", "index"],
    "properties": {"artifact_id": {"type": "string", "pattern": "[02468]$"}, "title": {"type": "string", "maxLength": 9}, "index": {"type": "object", "properties": {"files": {"type": "array", "maxItems": 1}}}},
}


@query(f"""WITH gaps AS ({GAPS}), bad AS (SELECT s_suppkey::VARCHAR AS id, 'artifact_id' AS location, '''art_' || s_suppkey || ''' does not match ''[02468]$''' AS message FROM supplier WHERE s_suppkey % 2 = 1
 UNION ALL SELECT s_suppkey::VARCHAR, 'title', '''Parts & ' || s_suppkey || ''' is too long' FROM supplier WHERE s_suppkey > 9)
 SELECT id, location, message FROM bad UNION ALL SELECT id, location, message FROM gaps WHERE id NOT IN (SELECT id FROM bad)""")
def gate_order(t):
    """Breaches of the rules, and integrity only for documents without any."""
    return A.check(_documents(t), RULES)


@query("SELECT s_suppkey::VARCHAR AS id, 's' || s_suppkey AS reinvestigate, 'c' || s_suppkey AS stale, 'art_' || s_suppkey AS previous FROM supplier WHERE s_suppkey % 4 = 0")
def changes_document(t):
    """What the changes document of each changed artifact names, read back from its JSON."""
    before, after = _documents(t), _documents(t, "if(s_suppkey % 4 = 0, -1, s_suppkey)")
    kind = "changes struct<stale_items:array<string>>, reinvestigate array<string>, previous_artifact_id string"
    rows = A.changes(A.parsed(before), A.parsed(after)).select("id", F.from_json("json", kind).alias("d"))
    return rows.select("id", F.explode("d.reinvestigate").alias("reinvestigate"), F.col("d.changes.stale_items")[0].alias("stale"), F.col("d.previous_artifact_id").alias("previous"))


@query("SELECT s_suppkey::VARCHAR AS id, 'no changes: artifact is up to date' AS notice FROM supplier WHERE s_suppkey % 4 <> 0")
def up_to_date_notice(t):
    before, after = _documents(t), _documents(t, "if(s_suppkey % 4 = 0, -1, s_suppkey)")
    return A.notice(A.changes(A.parsed(before), A.parsed(after)))


SECRETS = """concat('{"note":"', if(s_suppkey % 2 = 0, 'token = \\\\"', 'tokens \\\\"'), 'abcdef', s_suppkey, '\\\\"","db_password":"', s_acctbal, '","keys":{"api_key":["a","', s_name, '"],"content_hash":"', s_suppkey, '"}}')"""


@query("""SELECT s_suppkey::VARCHAR AS id, '{"note":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'token = \\"[REDACTED]' ELSE 'tokens \\"abcdef' || s_suppkey END || '\\"","db_password":"[REDACTED]","keys":{"api_key":["[REDACTED]","[REDACTED]"],"content_hash":"' || s_suppkey || '"}}' AS json, (3 + (s_suppkey % 2 = 0)::INT)::BIGINT AS redactions FROM supplier""")
def redact_keys(t):
    """Strings under keys that name a secret, and secrets in others."""
    return A.redact(t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.expr(SECRETS).alias("json")))


@query("""WITH p AS (SELECT s_suppkey::VARCHAR AS id, '<!-- template-version: 1.0 --><title>Parts &amp; ' || s_suppkey || '</title>{"title":"Parts & ' || s_suppkey || '","note":"<\\/b>","inputs":{"template_version":"1.0"}}' AS html FROM supplier) SELECT id, 'ok' AS status, 0::BIGINT AS redactions, strlen(html)::BIGINT AS n_bytes, html FROM p""")
def rendered_documents(t):
    docs = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.expr("""concat('{"title":"Parts & ', s_suppkey, '","note":"</b>"}')""").alias("json"))
    breaches = docs.select("id", F.lit("").alias("location"), F.lit("").alias("message")).filter("false")
    return A.render(docs, "<!-- template-version: 1.0 --><title>@T@</title>@D@", breaches, "@T@", "@D@").select("id", "status", "redactions", "n_bytes", "html")


@query("SELECT doc_id, 1::BIGINT AS n, (length(text) - length(replace(text, chr(10), '')) + 3)::BIGINT AS n_lines FROM (SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, '(?i)password|passwd|secret|api_?key|access_key|token|credential|AKIA|sk-|_live_|_test_|gh[po]_|AIza|xox|eyJ|BEGIN'))")
def line_shift(t):
    """A key of four lines becomes one mark, so the lines after it move up by three."""
    plain = t("documents").filter(~F.col("text").rlike("(?i)password|passwd|secret|api_?key|access_key|token|credential|AKIA|sk-|_live_|_test_|gh[po]_|AIza|xox|eyJ|BEGIN"))
    key = "-----BEGIN PRIVATE KEY-----\nabc\ndef\n-----END PRIVATE KEY-----"
    return T.redact(plain.select("doc_id", F.concat(F.lit(f"x\n{key}\n"), "text").alias("text")), "text", "n").select("doc_id", "n", T.line_count(F.col("text")).alias("n_lines"))


STRICT = """concat('{"index":{"files":[{"path":"p","sha256":"1","source":"n', s_suppkey, '\\\\nü', s_name, '\\\\nend"}]},"concepts":[{"id":"c', if(s_suppkey % 3 = 0, 1, s_suppkey + 2), '","evidence":[{"path":"p","range":{"start_line":1,"start_character":1,"end_line":2,"end_character":4},"content_hash":"sha256:',
 sha2(concat(if(s_suppkey % 2 = 0, cast(s_suppkey as string), 'x'), '\\nü', substring(s_name, 1, 2)), 256), '"}]},{"id":"c1","evidence":[{"path":"p","range":{"start_line":', if(s_suppkey % 5 = 0, 3, 2), ',"start_character":0,"end_line":2,"end_character":9}}]}],"findings":[', array_join(transform(sequence(1, cast(s_suppkey % 7 + 1 as int)), i -> concat('{"id":"f', i, '","severity":"blocking"}')), ','), ']}')"""


@query("""SELECT s_suppkey::VARCHAR AS id, 'concepts[0].evidence[0]' AS location, 'content_hash is not that of p L1-L2' AS message FROM supplier WHERE s_suppkey % 2 = 1
 UNION ALL SELECT s_suppkey::VARCHAR, 'concepts[1].evidence[0]', 'range begins after its end: L3-L2' FROM supplier WHERE s_suppkey % 5 = 0
 UNION ALL SELECT s_suppkey::VARCHAR, 'concepts', 'id c1 is given 2 times' FROM supplier WHERE s_suppkey % 3 = 0
 UNION ALL SELECT s_suppkey::VARCHAR, 'findings', (s_suppkey % 7 + 1) || ' blocking findings, published are at most 3' FROM supplier WHERE s_suppkey % 7 + 1 > 3""")
def strict_checks(t):
    """An artifact a supplier, with a wrong hash, a range the wrong way round, an id given twice or too many findings."""
    docs = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.expr(STRICT).alias("json"))
    return ST.strict(A.parsed(docs))


@query("SELECT 'p' || p_partkey AS symbol_id, p_name AS qualname FROM part WHERE contains(lower(p_name), 'ot r')")
def posting_search(t):
    """Names that have a text, from the postings of its grams."""
    part = t("part")
    path = f"{G.shared_dir(part.sparkSession)}/postings-{uuid.uuid4().hex}"
    M.write_postings(part.select(F.expr("concat('p', p_partkey)").alias("symbol_id"), F.col("p_name").alias("qualname")), path)
    return M.search_postings(part.sparkSession, path, "oT R")


# facts and resolution that no other query reaches

COMMON = "def f{key}(x):\n    x.get()\n    get()\n"


@query("SELECT 'python:m' || p_partkey || ':f' || p_partkey AS enclosing, m AS is_member, CASE WHEN NOT m THEN 'python:common:get' END AS target FROM part, LATERAL (VALUES (true), (false)) v(m)")
def blocked_calls(t):
    """A name too common for a member call to be matched by it, though one function has it: the plain call is matched."""
    part = t("part").select(F.expr("concat('m', p_partkey, '.py')").alias("path"), _render(COMMON, "p_partkey").alias("content"))
    one = part.sparkSession.createDataFrame([("common.py", "def get():\n    pass\n")], "path string, content string")
    facts = S.facts(S.files(part.union(one)), only=["symbols", "calls"])
    return I.resolve_calls(S.listed(facts, "calls"), S.symbols(facts)).select("enclosing", "is_member", "target")


PHANTOM = "export function run{key}() {\n  return list.map(() => { const g{key} = () => 1; return g{key}(); }).filter(h{key});\n}\n"


@query("SELECT 'typescript:m' || p_partkey || ':' || q AS symbol_id, 'typescript:m' || p_partkey || o AS parent, a::INTEGER AS start_line FROM part, LATERAL (VALUES ('run' || p_partkey, '', 1), ('g' || p_partkey, ':run' || p_partkey, 2), ('run' || p_partkey || '.g' || p_partkey, ':run' || p_partkey, 2)) v(q, o, a)")
def receiver_symbols(t):
    """What a receiver's callback defines stands once in its scope and once without one, as receivers are read twice."""
    return S.symbols(_snapshot(t, PHANTOM, "concat('m', p_partkey, '.ts')", ["symbols"])).filter("kind <> 'module'").select("symbol_id", "parent", "start_line")


UNWALKED = ("class A{key} extends B{key} {\n  x = d{key};\n}\nconst v: T{key} = w{key};\n", "package p\n\ntype X{key} = Y{key}\n\ntype S{key} struct {\n\tn Z{key}\n}\n")


@query("SELECT CASE l WHEN 'go' THEN 'go:m' ELSE 'typescript:m' END || p_partkey || q AS enclosing, name FROM part, LATERAL (VALUES ('ts', ':A' || p_partkey, 'x'), ('ts', ':A' || p_partkey, 'd' || p_partkey), ('ts', '', 'w' || p_partkey), ('go', ':S' || p_partkey, 'n'), ('go', ':S' || p_partkey, 'Z' || p_partkey)) v(l, q, name)")
def unwalked_parts(t):
    """Usages in classes and declarations: what a class extends, a variable's type and a type's other name are none."""
    rows = [t("part").select(F.expr(f"concat('m', p_partkey, '.{e}')").alias("path"), _render(text, "p_partkey").alias("content")) for e, text in zip(("ts", "go"), UNWALKED, strict=True)]
    return S.listed(S.facts(S.files(rows[0].union(rows[1])), only=["usages"]), "usages").select("enclosing", "name")


@query("SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 40 = 0 THEN 'ok' ELSE 'invalid' END AS status, least(30, s_suppkey % 40)::BIGINT AS shown FROM supplier")
def render_gate(t):
    """Documents with breaches are not rendered; the first thirty are shown."""
    docs = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.lit('{"title":"t"}').alias("json"), (F.col("s_suppkey") % 40).cast("int").alias("n"))
    breaches = docs.filter("n > 0").select("id", F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda i: i.cast("string"))).alias("location"), F.lit("wrong").alias("message"))
    pages = A.render(docs.select("id", "json"), "<title>@T@</title>@D@", breaches, "@T@", "@D@")
    return pages.select("id", "status", F.size("errors").cast("long").alias("shown"))


@query("SELECT 'a' || s_suppkey || '.json' AS file, 'art_' || s_suppkey AS artifact_id, s_name AS title FROM supplier")
def artifact_files(t):
    """Artifacts read from files, one a supplier, with line breaks within."""
    supplier = t("supplier")
    spark, root = supplier.sparkSession, f"{G.shared_dir(supplier.sparkSession)}/artifacts-{uuid.uuid4().hex}"
    spark.createDataFrame([("",)], "x string").coalesce(1).write.text(root)
    rows = supplier.select(F.expr("concat('a', s_suppkey, '.json')").alias("path"), F.expr("""concat('{\n "artifact_id": "art_', s_suppkey, '",\n "title": "', s_name, '"\n}\n')""").alias("content"))
    rows.foreachPartition(_write_files(tree.resolved(spark, root)))
    found = A.parsed(A.read(spark, f"{root}/*.json"))
    return found.select(F.element_at(F.split("id", "/"), -1).alias("file"), "a.artifact_id", "a.title")

"""Registered queries of source snapshots and artifacts. Their inputs are made from the tables: program text by part and
supplier, artifacts by order, so that SQL can state what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import keyed as K
from siltstone.plans import index as I
from siltstone.registry import query
from siltstone.sources import artifacts as A
from siltstone.sources import snapshot as S


def _render(sql: str, key: str, **words: str):
    """A text with {key} and words filled in, as a concat that Spark and DuckDB both read."""
    out = sql.replace("\n", "\\n")
    for name, value in {"key": key, **words}.items():
        out = out.replace("{" + name + "}", f"\x01{value}\x01")
    return F.concat(*(F.expr(f"cast({x} as string)") if i % 2 else F.lit(x.replace("\\n", "\n")) for i, x in enumerate(out.split("\x01")) if x))


PYTHON = "import os\nfrom m{other} import helper{other}\n\n\nclass C{key}:\n    def run(self, x):\n        return helper{other}(x)\n\n\ndef helper{key}(y):\n    return C{key}().run(y)\n"
SCRIPT = "import { make{other} } from './m{other}';\n\nexport class Box{key} {\n  open(a: number): number {\n    return make{other}(a);\n  }\n}\nexport const make{key} = (a: number) => new Box{key}();\n"
GO = 'package m{key}\n\nimport "app/m{other}"\n\ntype Box{key} struct {\n\tn int\n}\n\nfunc (b *Box{key}) Open() int {\n\treturn Make{other}(b)\n}\n\nfunc Make{key}() *Box{key} {\n\treturn nil\n}\n'
OTHER = "p_partkey % 100 + 1"


def _snapshot(t, text: str, path: str, only=S.RELATIONS, once: bool = False):
    """Facts, without the texts, of one file a part: written, unless a query reads them once."""
    rows = t("part").select(F.expr(path).alias("path"), _render(text, "p_partkey", other=OTHER).alias("content"))
    return (S.unwritten_facts if once else S.facts)(S.files(S.spread(rows)), only=only, text=False, dealt=True)


def _python(t, *only: str, once: bool = False):
    return _snapshot(t, PYTHON, "concat('m', p_partkey, '.py')", only or S.RELATIONS, once)


P = f"p AS (SELECT p_partkey AS k, {OTHER} AS o FROM part), known AS (SELECT max(k) AS top FROM p)"


@query("""SELECT 'python:m' || p_partkey || q AS symbol_id, kind, a::INTEGER AS start_line, b::INTEGER AS end_line, 'python:m' || p_partkey || parent AS parent, signature FROM part,
 LATERAL (VALUES (':C' || p_partkey, 'class', 5, 7, '', 'class C' || p_partkey), (':C' || p_partkey || '.run', 'method', 6, 7, ':C' || p_partkey, 'def run(self, x)'), (':helper' || p_partkey, 'function', 10, 11, '', 'def helper' || p_partkey || '(y)'), ('', 'module', 1, 12, NULL, 'module m' || p_partkey)) v(q, kind, a, b, parent, signature)""")
def python_symbols(t):
    return S.symbols(_python(t, "symbols", once=True)).select("symbol_id", "kind", "start_line", "end_line", "parent", "signature")


@query(f"""WITH {P} SELECT 'python:m' || k || e AS enclosing, name, m AS is_member, n::BIGINT AS copies FROM p,
 LATERAL (VALUES (':C' || k || '.run', 'helper' || o, false, 1), (':helper' || k, 'C' || k, false, 2), (':helper' || k, 'run', true, 1)) v(e, name, m, n)""")
def call_sites(t):
    return S.listed(_python(t, "calls", once=True), "calls").groupBy("enclosing", "name", "is_member").agg(F.count("*").alias("copies"))


@query(f"""WITH {P} SELECT 'python:m' || k || ':C' || k || '.run' AS src, 'python:m' || o || ':helper' || o AS dst, 1::BIGINT AS sites FROM p, known WHERE o <= top
 UNION ALL SELECT 'python:m' || k || ':helper' || k, 'python:m' || k || ':C' || k, 2 FROM p""")
def call_edges(t):
    facts = _python(t, "symbols", "calls")
    calls = I.resolve_calls(S.listed(facts, "calls"), S.symbols(facts)).filter("target is not null")
    return calls.groupBy(F.col("enclosing").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("sites"))


def _imports(facts):
    modules = facts.select("language", "module", "file_ord").distinct()
    return I.resolve_imports(S.listed(facts, "targets"), modules).select("src", "dst")


@query(f"WITH {P} SELECT 'python:m' || k AS src, 'python:m' || o AS dst FROM p, known WHERE o <= top AND o <> k")
def python_imports(t):
    return _imports(_python(t, "targets"))


@query(f"WITH {P} SELECT 'typescript:app/m' || k AS src, 'typescript:app/m' || o AS dst FROM p, known WHERE o <= top AND o <> k")
def script_imports(t):
    return _imports(_snapshot(t, SCRIPT, "concat('app/m', p_partkey, '.ts')", ["targets"]))


@query(f"WITH {P} SELECT 'go:m' || k || '/x' AS src, 'go:m' || o || '/x' AS dst FROM p, known WHERE o <= top AND o <> k")
def go_imports(t):
    return _imports(_snapshot(t, GO, "concat('m', p_partkey, '/x.go')", ["targets"]))


@query("""SELECT 'typescript:app/m' || p_partkey || ':' || q AS symbol_id, kind, a::INTEGER AS start_line, b::INTEGER AS end_line FROM part, LATERAL (VALUES ('Box' || p_partkey, 'class', 3, 7), ('Box' || p_partkey || '.open', 'method', 4, 6), ('make' || p_partkey, 'function', 8, 8)) v(q, kind, a, b)""")
def script_symbols(t):
    return S.symbols(_snapshot(t, SCRIPT, "concat('app/m', p_partkey, '.ts')", ["symbols"], once=True)).filter("kind <> 'module'").select("symbol_id", "kind", "start_line", "end_line")


@query("""SELECT 'go:m' || p_partkey || '/x:' || q AS symbol_id, kind, a::INTEGER AS start_line, b::INTEGER AS end_line FROM part, LATERAL (VALUES ('Box' || p_partkey, 'class', 5, 7), ('Box' || p_partkey || '.Open', 'method', 9, 11), ('Make' || p_partkey, 'function', 13, 15)) v(q, kind, a, b)""")
def go_symbols(t):
    return S.symbols(_snapshot(t, GO, "concat('m', p_partkey, '/x.go')", ["symbols"], once=True)).filter("kind <> 'module'").select("symbol_id", "kind", "start_line", "end_line")


CHAIN = "def f{key}():\n    return f{below}()\n"
LINKS = "c AS (SELECT p_partkey AS k, p_partkey % 10 <> 0 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey - 1) AS calls FROM part)"


def _chain(t):
    """Functions, one a part, that each call the one below; every tenth calls none that there is."""
    return S.files(t("part").select(F.expr("concat('m', p_partkey, '.py')").alias("path"), _render(CHAIN, "p_partkey", below="if(p_partkey % 10 = 0, 'x', cast(p_partkey - 1 as string))").alias("content")))


def _slice(t):
    """The slice about two files."""
    return I.build(_chain(t), ["m75.py", "m146.py"], 2)


#: Of each entry k the files k - 2 to k + 2 are in; functions that kept calls lead to, one after another, are stubs.
AROUND = f"{LINKS}, near AS (SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM (VALUES (75), (146)) v(e) WHERE abs(k - e) <= 2))"


#: The calls in their files' order, and of each function the first file that leads to it from the slice, one call after another.
STUBS = """e AS (SELECT k AS i, k AS a, k - 1 AS b FROM c WHERE calls), r(k, t) AS (SELECT k, '' FROM near UNION SELECT x.k, x.p FROM (SELECT CASE WHEN e.a = r.k THEN e.b ELSE e.a END AS k, 'm' || e.a || '.py' AS p, r.t AS t FROM r JOIN e ON r.k IN (e.a, e.b)) x WHERE x.p > x.t),
 t AS (SELECT k, min(t) AS t FROM r GROUP BY k)"""


@query(f"""WITH RECURSIVE {AROUND}, {STUBS}, held AS (SELECT DISTINCT e.i FROM e JOIN t ON t.k IN (e.a, e.b) WHERE t.t < 'm' || e.a || '.py')
 SELECT (SELECT count(*) FROM c)::BIGINT AS files_scanned, 2 * (SELECT count(*) FROM near)::BIGINT AS slice_symbols, (SELECT count(*) FROM t WHERE k NOT IN (SELECT k FROM near))::BIGINT AS boundary_symbols, (SELECT count(*) FROM held)::BIGINT AS edges, (SELECT count(*) FROM c WHERE NOT calls)::BIGINT AS unresolved_calls""")
def slice_stats(t):
    return _slice(t).stats


@query(f"WITH {AROUND} SELECT 'python:m' || k || q AS symbol_id FROM near, LATERAL (VALUES (''), (':f' || k)) v(q)")
def slice_symbols(t):
    return _slice(t).symbols.filter("in_slice").select("symbol_id")


@query(f"WITH {AROUND}, x AS (SELECT 'm' || k || '.py' AS path, 'def f' || k || '():' || chr(10) || '    return f' || CASE WHEN k % 10 = 0 THEN 'x' ELSE (k - 1)::VARCHAR END || '()' || chr(10) AS source FROM near) SELECT path, source, 'sha256:' || sha256(source) AS sha256, 'python' AS language, 'generic' AS tier FROM x")
def index_document(t):
    """The files of the document, read back from its JSON, each with its language's tier."""
    doc = I.document(_slice(t), {"id": "parts", "root": "/parts", "head_commit": "none"}, 2)
    kind = "index struct<resolution:map<string,string>,files:array<struct<path:string,language:string,sha256:string,source:string>>>"
    rows = doc.select(F.from_json("json", kind).alias("d")).select("d.index.resolution", F.explode("d.index.files").alias("f"))
    return rows.select("f.path", "f.source", "f.sha256", "f.language", F.col("resolution")[F.col("f.language")].alias("tier"))


def _artifacts(t):
    """One artifact an order: its parts are files, its suppliers symbols, with edges, pointers and findings between them."""
    c = F.col
    line = t("lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("xs"))

    def part(x):
        name = lambda prefix, key: F.concat(F.lit(prefix), key.cast("string"))
        n, s = x["l_linenumber"], x["l_suppkey"]
        return F.struct(n.alias("n"), name("p", x["l_partkey"]).alias("path"), name("s", s).alias("s"), name("s", s + n % 2).alias("to"), (n % 4 + 1).cast("int").alias("line"), x["l_returnflag"].alias("l_returnflag"))

    rows = line.select("id", F.array_sort(F.transform("xs", part)).alias("xs"))  # names are made after the numbers are shuffled
    of = lambda f: F.transform("xs", f)
    place = lambda x: F.struct(x["line"].alias("start_line"), F.lit(4).alias("start_character"), x["line"].alias("end_line"), F.lit(9).alias("end_character"))
    pointer = lambda x: F.array(F.struct(x["to"].alias("symbol_id"), x["path"].alias("path"), place(x).alias("range")))
    index = F.struct(
        of(lambda x: F.struct(x["path"].alias("path"), F.lit("a\nb\nc").alias("source"))).alias("files"),
        of(lambda x: F.struct(x["s"].alias("symbol_id"), x["path"].alias("path"), F.lit(True).alias("in_slice"))).alias("symbols"),
        of(lambda x: F.struct(x["s"].alias("from"), x["to"].alias("to"))).alias("edges"),
    )
    findings = of(lambda x: F.struct(F.concat(F.lit("f"), x["n"].cast("string")).alias("id"), F.when(x["l_returnflag"] == "R", "blocking").otherwise("warning").alias("severity"), F.concat(F.lit(" late \n  "), x["s"]).alias("claim"), pointer(x).alias("evidence")))
    return rows.select("id", F.to_json(F.struct(F.concat(F.lit("art_"), c("id").cast("string")).alias("artifact_id"), index.alias("index"), findings.alias("findings"))).alias("json"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, 's' || l_suppkey AS s, 's' || (l_suppkey + l_linenumber % 2) AS t, 'p' || l_partkey AS path, l_linenumber % 4 + 1 AS line FROM lineitem),
 x AS (SELECT l.*, row_number() OVER (PARTITION BY id ORDER BY n, path, s) - 1 AS i FROM l), missing AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = x.id AND l.s = x.t))
 SELECT id, 'index' AS location, 'edges[' || i || '].to ' || t || ' not in symbols' AS message FROM missing
 UNION ALL SELECT id, 'findings[' || i || '].evidence[0]', 'symbol_id ' || t || ' not in index.symbols' FROM missing
 UNION ALL SELECT id, 'findings[' || i || '].evidence[0]', 'range L4-L4 out of bounds for ' || path || ' (3 lines)' FROM x WHERE line = 4""")
def artifact_integrity(t):
    return A.integrity(A.parsed(_artifacts(t)))


@query("SELECT l_orderkey AS id, 'p' || l_partkey || ':' || (l_linenumber % 4 + 1) || ':5: [' || CASE WHEN l_returnflag = 'R' THEN 'BLOCKING' ELSE 'WARNING' END || '] late s' || l_suppkey AS value FROM lineitem")
def artifact_quickfix(t):
    return A.quickfix(A.parsed(_artifacts(t))).select("id", "value")


@query("""WITH l AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem) SELECT l_partkey, l_linenumber, CASE WHEN l_linenumber IN (5, 6, 7) THEN 'python:m' || l_partkey || ':C' || l_partkey || CASE WHEN l_linenumber > 5 THEN '.run' ELSE '' END ELSE 'python:m' || l_partkey END AS symbol_id
 FROM l JOIN part ON l_partkey = p_partkey""")
def symbol_at(t):
    facts = _python(t)
    points = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select("l_partkey", "l_linenumber").distinct()
    points = points.select("*", F.expr("concat('m', l_partkey, '.py')").alias("path"), F.col("l_linenumber").alias("line"), F.lit(8).alias("character"))
    return I.locate(points, S.symbols(facts)).select("l_partkey", "l_linenumber", "symbol_id")


@query("SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS utf16 FROM documents")
def utf16_columns(t):
    """The column after the whole text, taken as one line."""
    return t("documents").select("doc_id", K.utf16_column(F.concat("text", F.lit(".")), F.octet_length("text")).alias("utf16"))

"""The registered queries of the snapshot, graph and artifact operators with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import diff as D
from siltstone.operators import graph as G
from siltstone.operators import keyed as K
from siltstone.plans import marts as M
from siltstone.registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

# scans, manifests, scalars


@query("SELECT doc_id, 'sha256:' || sha256(text) AS sha256, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS chars, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents")
def file_manifest(t):
    c = F.col("text")
    return t("documents").select("doc_id", T.sha256_text(c).alias("sha256"), F.octet_length(c).cast("long").alias("n_bytes"), F.length(c).cast("long").alias("chars"), T.line_count(c).alias("n_lines"))


@query("SELECT page_id, url FROM pages WHERE NOT (list_has_any(string_split(url, '/'), ['en', 'node_modules']) OR regexp_matches(url, '^.*page=.&ref=.*$'))")
def exclude_filter(t):
    return t("pages").filter(~T.excluded(F.col("url"), ["en", "node_modules", "*page=?&ref=*"])).select("page_id", "url")


@query("SELECT p_partkey, path, CASE regexp_extract(path, '[.]([A-Za-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' END AS language FROM (SELECT p_partkey, 'src/' || p_partkey || '.' || (['py', 'ts', 'js', 'go', 'md'])[1 + p_partkey % 5] AS path FROM part)")
def extension_language(t):
    path = F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ("py", "ts", "js", "go", "md"))), (1 + F.col("p_partkey") % 5).cast("int")))
    return t("part").select("p_partkey", path.alias("path")).withColumn("language", T.language_of(F.col("path")))


# keyed operators


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def symbol_dedup_last(t):
    return K.dedup_last(t("conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "text")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def span_dedup_first(t):
    return K.dedup_first(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 500")
def usage_capped(t):
    return K.first_per_key(t("events").select("event_type", "event_id"), ["event_type"], ["event_id"], 500)


NAMES = "SELECT p_partkey, p_type, p_name || p_brand || p_size AS name FROM part"
CALLS = f"calls AS (SELECT l_orderkey, l_linenumber, l_returnflag, n.p_type, n.name FROM lineitem JOIN ({NAMES}) n ON l_partkey = p_partkey), one AS (SELECT name, min(p_partkey) AS target FROM ({NAMES}) GROUP BY name HAVING count(*) = 1)"


def _resolved(t):
    part = t("part").select("p_partkey", "p_type", F.concat("p_name", "p_brand", F.col("p_size").cast("string")).alias("name"))
    calls = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").join(part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    blocked = (F.col("l_returnflag") == "R") & (F.col("p_type") == "PROMO")
    return K.resolve_unique(calls.drop("l_partkey"), part, ["name"], "p_partkey", blocked)


@query(f"WITH {CALLS} SELECT l_orderkey, l_linenumber, c.name, target FROM calls c JOIN one o ON o.name = c.name WHERE NOT (l_returnflag = 'R' AND p_type = 'PROMO')")
def unique_name_resolve(t):
    return _resolved(t).filter("target is not null").select("l_orderkey", "l_linenumber", "name", "target")


@query(f"WITH {CALLS} SELECT p_type, count(*)::BIGINT AS calls, count(*) FILTER (WHERE target IS NULL OR (l_returnflag = 'R' AND p_type = 'PROMO'))::BIGINT AS unresolved FROM calls c LEFT JOIN one o ON o.name = c.name GROUP BY p_type")
def unresolved_count(t):
    return _resolved(t).groupBy("p_type").agg(F.count("*").alias("calls"), F.count_if(F.col("target").isNull()).alias("unresolved"))


@query("WITH s AS (SELECT 1000 * k AS a, 1000 * k + 999 AS b, k AS span FROM range(0, 1000) r(k) UNION ALL SELECT 100 * k, 100 * k + 99, 100000 + k FROM range(0, 10000) r(k) WHERE k % 3 = 0) SELECT event_id, span FROM events JOIN s ON event_id BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY a DESC, b, span) = 1")
def innermost_interval(t):
    points = t("events").select("event_id")
    r = points.sparkSession.range
    wide = r(1000).select((1000 * F.col("id")).alias("a"), (1000 * F.col("id") + 999).alias("b"), F.col("id").alias("span"))
    spans = wide.union(r(10000).filter("id % 3 = 0").selectExpr("100 * id", "100 * id + 99", "100000 + id"))
    # spans never cross a thousand, so that is the part that both sides share
    part = lambda df, c: df.withColumn("part", F.expr(f"{c} div 1000"))
    return K.innermost(part(points, "event_id"), part(spans, "a"), "part", ["event_id"], ["a"], ["b"], "span", "span").filter("span is not null").select("event_id", "span")


URLS = "SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') AS path FROM pages"


def _paths(t):
    return t("pages").select(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^https?://", "").alias("path")).distinct()


@query(f"WITH u AS ({URLS}), m AS (SELECT DISTINCT string_split(path, '/')[1] AS module FROM u UNION SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') FROM u WHERE path LIKE '%/fr/%'), e AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM u) SELECT path, max_by(module, length(module)) AS resolved FROM e JOIN m ON m.module = array_to_string(string_split(path, '/')[1:n], '/') GROUP BY path")
def import_longest_prefix(t):
    u = _paths(t)
    modules = u.select(F.split("path", "/")[0].alias("module")).union(u.filter("path like '%/fr/%'").select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/"))).distinct()
    return K.longest_prefix(u, modules, "path", "module", "/")


@query(f"WITH u AS ({URLS}), m AS (SELECT DISTINCT string_split(path, '/')[-1] AS dir FROM u) SELECT path, dir AS resolved FROM u JOIN m ON path = dir OR suffix(path, '/' || dir) QUALIFY row_number() OVER (PARTITION BY path ORDER BY dir) = 1")
def import_directory_suffix(t):
    u = _paths(t)
    modules = u.select(F.element_at(F.split("path", "/"), -1).alias("dir")).distinct().withColumn("module", F.col("dir"))
    return K.directory_suffix(u, modules, "path", "module", "dir", "module")


@query(f"WITH u AS ({URLS}) SELECT DISTINCT a.path AS src, b.c_name AS dst FROM u a JOIN customer b ON 'Customer#' || lpad(regexp_extract(a.path, '/([0-9]+)', 1), 9, '0') = b.c_name")
def import_exact(t):
    key = F.concat(F.lit("Customer#"), F.lpad(F.regexp_extract("path", r"/([0-9]+)", 1), 9, "0"))
    return _paths(t).select(F.col("path").alias("src"), key.alias("dst")).join(t("customer").select(F.col("c_name").alias("dst")), "dst").select("src", "dst").distinct()


# graph


EDGES = """edges AS (SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation),
 adj AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"""
HOPS = f"WITH RECURSIVE {EDGES}, r(node, hop) AS (SELECT 'r:0', 0 UNION SELECT adj.b, r.hop + 1 FROM r JOIN adj ON adj.a = r.node WHERE r.hop < 2), hops AS (SELECT node, min(hop)::BIGINT AS hop FROM r GROUP BY node)"


def _edges(t):
    e = lambda df, a, x, b, y: df.select(F.concat(F.lit(f"{a}:"), F.col(x).cast("string")).alias("src"), F.concat(F.lit(f"{b}:"), F.col(y).cast("string")).alias("dst"))
    return e(t("customer"), "c", "c_custkey", "n", "c_nationkey").union(e(t("supplier"), "s", "s_suppkey", "n", "s_nationkey")).union(e(t("nation"), "n", "n_nationkey", "r", "n_regionkey"))


def _hops(t):
    e = _edges(t)
    return G.khop(G.adjacency(e), e.sparkSession.createDataFrame([("r:0",)], "node string"), 2)


@query(f"WITH {EDGES} SELECT a, b FROM adj")
def adjacency(t):
    return G.adjacency(_edges(t))


@query(f"{HOPS} SELECT node, hop FROM hops")
def khop_bfs(t):
    return _hops(t)


@query(f"{HOPS} SELECT o_orderkey, hop FROM orders JOIN hops ON node = 'c:' || o_custkey")
def khop_slice_rows(t):
    return t("orders").select("o_orderkey", F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("node")).join(_hops(t), "node").select("o_orderkey", "hop")


@query("WITH e(entry) AS (VALUES ('FRANCE'), ('Customer#000000007'), ('nothing')), a AS (SELECT entry, 'n:' || n_nationkey AS node FROM e JOIN nation ON n_name = entry) SELECT * FROM a UNION ALL SELECT entry, 'c:' || c_custkey FROM e JOIN customer ON c_name = entry WHERE entry NOT IN (SELECT entry FROM a)")
def entry_match(t):
    n, c = t("nation"), t("customer")
    entries = n.sparkSession.createDataFrame([("FRANCE",), ("Customer#000000007",), ("nothing",)], "entry string")
    named = n.select(F.col("n_name").alias("name"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("node"))
    return G.match_entries(entries, named, c.select(F.col("c_name").alias("name"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node")))


BUDGET = 20_000


@query(f"""WITH RECURSIVE o AS (SELECT s_suppkey AS id, s_nationkey * 37 + 11 AS bytes, row_number() OVER (ORDER BY length(s_name), s_suppkey) AS rn FROM supplier),
 f(rn, acc, kept, id) AS (SELECT 0::BIGINT, 0::BIGINT, false, NULL::BIGINT UNION ALL SELECT o.rn, CASE WHEN f.acc + o.bytes <= {BUDGET} THEN f.acc + o.bytes ELSE f.acc END, f.acc + o.bytes <= {BUDGET}, o.id FROM f JOIN o ON o.rn = f.rn + 1)
 SELECT id AS s_suppkey, kept FROM f WHERE id IS NOT NULL""")
def budget_fold(t):
    items = t("supplier").select("s_suppkey", F.length("s_name").alias("chars"), F.col("s_suppkey").alias("ord"), (F.col("s_nationkey") * 37 + 11).cast("long").alias("bytes"))
    return G.budget_fold(items, ["chars", "ord"], "bytes", "s_suppkey", BUDGET)


STUBS = """WITH RECURSIVE e(i, a, b) AS (SELECT o_orderkey, 'c' || o_custkey, 'd' || (o_custkey * 7 % 211) FROM orders WHERE o_orderstatus = 'F'),
 b0(x) AS (SELECT DISTINCT a FROM e WHERE a IN ('c1', 'c2', 'c4', 'c5')), u AS (SELECT i, a AS x, b AS y FROM e UNION ALL SELECT i, b, a FROM e),
 r(x, t) AS (SELECT x, (-1)::BIGINT FROM b0 UNION SELECT u.y, u.i FROM r JOIN u ON u.x = r.x AND u.i > r.t), t AS (SELECT x, min(t) AS t FROM r GROUP BY x)"""


def _boundary(t):
    e = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("d"), (F.col("o_custkey") * 7 % 211).cast("string")).alias("dst"))
    return G.boundary(e, e.filter(F.col("src").isin("c1", "c2", "c4", "c5")).select(F.col("src").alias("node")).distinct())


@query(f"{STUBS} SELECT x AS node, t FROM t WHERE t >= 0")
def boundary_stubs(t):
    return _boundary(t)[1]


@query(f"{STUBS} SELECT DISTINCT u.i AS seq FROM u JOIN t ON t.x = u.x WHERE t.t < u.i")
def boundary_edges(t):
    return _boundary(t)[0].select("seq")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def reference_stubs(t):
    refs = t("lineitem").filter("l_returnflag = 'A'").select("l_partkey").distinct()
    return D.orphans(refs, t("part").filter("p_size < 25"), "l_partkey", "p_partkey")


# differences


SNAPSHOTS = "a AS (SELECT doc_id, source, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 3), b AS (SELECT doc_id, source, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 2)"
CHANGE = "CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change"


def _snapshots(t):
    d = t("documents").select("doc_id", "source", "text")
    return d.filter("doc_id % 11 <> 3").select("doc_id", "source", F.sha2("text", 256).alias("h")), d.filter("doc_id % 7 <> 2").select("doc_id", "source", F.sha2(F.expr("if(doc_id % 5 = 0, text || '!', text)"), 256).alias("h"))


@query(f"WITH {SNAPSHOTS} SELECT doc_id, {CHANGE} FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h")
def symbol_diff(t):
    return D.snapshot_diff(*_snapshots(t), ["doc_id"], "h")


@query(f"WITH {SNAPSHOTS} SELECT doc_id, source, {CHANGE} FROM a FULL JOIN b USING (doc_id, source) WHERE a.h IS DISTINCT FROM b.h AND source IN ('src1', 'src2', 'src3')")
def review_diff(t):
    a, b = _snapshots(t)
    changed = a.sparkSession.createDataFrame([("src1",), ("src2",), ("src3",)], "source string")
    return D.snapshot_diff(a.join(changed, "source", "left_semi"), b.join(changed, "source", "left_semi"), ["doc_id", "source"], "h")


DIFF = f"{SNAPSHOTS}, d AS (SELECT doc_id, {CHANGE} FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h), ev AS (SELECT DISTINCT conv_id AS item, (conv_id * 13 + turn * 7) % 1000 AS doc_id FROM conversations)"


def _evidence(t):
    return t("conversations").select(F.col("conv_id").alias("item"), ((F.col("conv_id") * 13 + F.col("turn") * 7) % 1000).alias("doc_id")).distinct()


@query(f"WITH {DIFF} SELECT item, list_sort(list(doc_id)) AS evidence FROM ev GROUP BY item")
def evidence_set(t):
    return _evidence(t).groupBy("item").agg(F.array_sort(F.collect_set("doc_id")).alias("evidence"))


@query(f"WITH {DIFF} SELECT DISTINCT item FROM ev SEMI JOIN d USING (doc_id)")
def stale_items(t):
    return D.stale_split(_evidence(t), symbol_diff(t), "item", "doc_id")[0]


@query(f"WITH {DIFF} SELECT DISTINCT item FROM ev WHERE item NOT IN (SELECT item FROM ev SEMI JOIN d USING (doc_id))")
def reusable_items(t):
    return D.stale_split(_evidence(t), symbol_diff(t), "item", "doc_id")[1]


@query(f"WITH {DIFF} SELECT change, count(*)::BIGINT AS n FROM d GROUP BY change")
def change_summary(t):
    return symbol_diff(t).groupBy("change").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
 SELECT a.o_orderkey AS artifact_id, b.o_orderkey AS ancestor, a.rn - b.rn AS steps FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.rn < a.rn""")
def artifact_lineage(t):
    from pyspark.sql import Window

    from siltstone.sources import artifacts as A

    previous = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("previous")
    return A.lineage(t("orders").select(F.col("o_orderkey").alias("artifact_id"), previous))


# validation


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)")
def orphan_reference(t):
    return D.orphans(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), t("part").filter("p_size <> 7"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_evidence(t):
    return D.orphans(t("labels").select("doc_id"), t("documents").filter("lang = 'en'"), "doc_id", "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def orphan_parent(t):
    return D.orphans(t("orders").select("o_orderkey", "o_custkey"), t("customer").filter("c_mktsegment <> 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query(f"WITH {EDGES}, known AS (SELECT src FROM edges WHERE src NOT LIKE 'c:1%' UNION SELECT dst FROM edges WHERE dst LIKE 'r:%'), ends AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT node, count(*)::BIGINT AS n FROM ends WHERE node NOT IN (SELECT src FROM known) GROUP BY node")
def orphan_edge(t):
    e = _edges(t)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node"))
    known = e.filter("src not like 'c:1%'").select(F.col("src").alias("node")).union(e.filter("dst like 'r:%'").select("dst"))
    return D.orphans(ends, known, "node", "node").groupBy("node").agg(F.count("*").alias("n"))


@query("SELECT doc_id, end_line, n_lines FROM (SELECT doc_id, (n_chars // 200)::BIGINT AS end_line, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents) WHERE end_line > n_lines")
def line_out_of_bounds(t):
    return t("documents").select("doc_id", F.expr("n_chars div 200").alias("end_line"), T.line_count(F.col("text")).alias("n_lines")).filter("end_line > n_lines")


@query("SELECT 'chars_match' AS rule, count(*) FILTER (WHERE NOT n_chars = length(text))::BIGINT AS n FROM documents UNION ALL SELECT 'known_language', count(*) FILTER (WHERE NOT lang IN ('en', 'de'))::BIGINT FROM documents UNION ALL SELECT 'least_length', count(*) FILTER (WHERE NOT length(text) >= 80)::BIGINT FROM documents UNION ALL SELECT 'source_pattern', count(*) FILTER (WHERE NOT regexp_matches(source, '^src[0-9]$'))::BIGINT FROM documents")
def schema_rules(t):
    c = F.col
    rules = {"chars_match": c("n_chars") == F.length("text"), "known_language": c("lang").isin("en", "de"), "least_length": F.length("text") >= 80, "source_pattern": c("source").rlike("^src[0-9]$")}
    return D.violations(t("documents"), rules)


@query("SELECT 'conversations[' || conv_id || '].turns[' || i || ']' AS location, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)")
def evidence_locations(t):
    nested = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    rows = nested.select("conv_id", F.posexplode("turns").alias("i", "x"))
    return rows.select(F.concat(F.lit("conversations["), F.col("conv_id").cast("string"), F.lit("].turns["), F.col("i").cast("string"), F.lit("]")).alias("location"), F.col("x.text").alias("text"))


# redaction and rendering


PASS = rf"(\b[A-Za-z_]*{T.SECRET_NAME}[A-Za-z_]*)(\s*[:=]\s*)"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i){PASS}"[^''"\n]{{6,}}"', '\1\2"[REDACTED]"', 'g'), '(?i){PASS}''[^''"\n]{{6,}}''', '\1\2''[REDACTED]''', 'g') AS text FROM documents""")
def redact_assignments(t):
    return t("documents").select("doc_id", T.redact_assignments(F.col("text"))[0].alias("text"))


def _counted() -> str:
    """Each step counts its pattern in what the steps before it left."""
    steps = [(f"(?i){PASS}\"[^''\"\\n]{{6,}}\"", "\\1\\2\"[REDACTED]\""), (f"(?i){PASS}''[^''\"\\n]{{6,}}''", "\\1\\2''[REDACTED]''"), *((p, "[REDACTED]") for p in T.VALUE_PATTERNS.values())]
    sql = "SELECT doc_id, text, 0::BIGINT AS n FROM documents"
    for pattern, to in steps:
        sql = f"SELECT doc_id, regexp_replace(text, '{pattern}', '{to}', 'g') AS text, n + len(regexp_extract_all(text, '{pattern}')) AS n FROM ({sql})"
    return f"SELECT doc_id, n::BIGINT AS n FROM ({sql})"


@query(_counted())
def redaction_counts(t):
    return T.redact(t("documents").select("doc_id", "text"), "text", "n").select("doc_id", "n")


@query("SELECT page_id, replace(html, '</', '<\\/') AS html, strlen(replace(html, '</', '<\\/'))::BIGINT AS n_bytes FROM pages")
def island_escape(t):
    return t("pages").select("page_id", T.island(F.col("html")).alias("html")).withColumn("n_bytes", F.octet_length("html").cast("long"))


@query("SELECT page_id, CASE WHEN strlen(html) > 5000 THEN 'refuse' WHEN strlen(html) > 2500 THEN 'warn' ELSE 'ok' END AS status FROM pages")
def size_gate(t):
    return t("pages").select("page_id", T.size_class(F.octet_length("html"), 2500, 5000).alias("status"))


@query(r"SELECT l.doc_id, d.source || ':' || (l.doc_id % 90 + 1) || ':' || (l.doc_id % 17 + 1) || ': [' || CASE WHEN toxic = 1 THEN 'BLOCKING' WHEN quality = 0 THEN 'WARNING' ELSE 'SPOTLIGHT' END || '] ' || trim(regexp_replace(d.text, '\s+', ' ', 'g')) AS line FROM labels l JOIN documents d USING (doc_id)")
def quickfix_lines(t):
    rows = t("labels").join(t("documents").select("doc_id", "source", "text"), "doc_id")
    severity = F.expr("case when toxic = 1 then 'blocking' when quality = 0 then 'warning' else 'spotlight' end")
    line = T.quickfix_line(F.col("source"), F.col("doc_id") % 90 + 1, F.col("doc_id") % 17, severity, F.col("text"))
    return rows.select("doc_id", line.alias("line"))


# marts


@query(f"WITH {EDGES} SELECT node, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node")
def fan_in_out(t):
    return M.fan(_edges(t))


@query(f"WITH {EDGES} SELECT count(*)::BIGINT AS edges, count(DISTINCT src)::BIGINT AS sources, count(DISTINCT dst)::BIGINT AS targets FROM edges")
def index_stats(t):
    return M.stats(_edges(t))


@query(f"""WITH RECURSIVE {EDGES}, s AS (SELECT src AS symbol_id, dst AS parent FROM edges), r(symbol_id, ancestor, depth) AS (SELECT symbol_id, symbol_id, 0::BIGINT FROM s UNION SELECT r.symbol_id, s.parent, r.depth + 1 FROM r JOIN s ON s.symbol_id = r.ancestor)
 SELECT symbol_id, ancestor, depth FROM r""")
def symbol_tree(t):
    return M.symbol_tree(_edges(t).select(F.col("src").alias("symbol_id"), F.col("dst").alias("parent")))


@query("SELECT 'p' || p_partkey AS symbol_id, coalesce(n, 0)::BIGINT AS refs, coalesce(o, 0)::BIGINT AS paths FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(DISTINCT l_orderkey) AS o FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON l_partkey = p_partkey")
def backlinks(t):
    refs = t("lineitem").filter("l_returnflag = 'R'").select(F.expr("'p' || l_partkey").alias("symbol_id"), F.col("l_orderkey").alias("path"))
    return M.find_references(refs, t("part").select(F.expr("'p' || p_partkey").alias("symbol_id")))


@query("SELECT p_partkey AS symbol_id, p_name AS qualname FROM part WHERE contains(lower(p_name), 're')")
def symbol_search(t):
    return M.search(t("part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("qualname")), "Re")

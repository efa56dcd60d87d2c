"""Artifact documents: reading, integrity, what a new index makes stale, redaction, rendering, quickfix lines.

An artifact is one JSON document a row: (id, json). Its relations are explodes of the parsed document, keyed by the id,
so many artifacts are checked in the same joins. Only work on arbitrary keys (the rule document, redaction by key name)
walks a document in Python, by Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import diff as D
from siltstone.operators import graph as G

RANGE = "range:struct<start_line:int,start_character:int,end_line:int,end_character:int>"
EVIDENCE = f"evidence:array<struct<symbol_id:string,path:string,{RANGE},content_hash:string>>"
ITEM = f"array<struct<id:string,{EVIDENCE}>>"
ARTIFACT = (
    "artifact_id string, title string, repository struct<head_commit:string>, "
    "index struct<files:array<struct<path:string,sha256:string,source:string>>,"
    "symbols:array<struct<symbol_id:string,path:string,content_hash:string,parent:string,in_slice:boolean>>,"
    "edges:array<struct<from:string,to:string>>,references:array<struct<path:string,symbol_id:string>>>, "
    f"flows array<struct<id:string,{EVIDENCE},steps:array<struct<{EVIDENCE},branches:array<struct<{EVIDENCE}>>>>>>, "
    f"concepts {ITEM}, invariants {ITEM}, findings array<struct<id:string,severity:string,claim:string,{EVIDENCE}>>, "
    f"lessons struct<predict:{ITEM},localization:{ITEM}>, changes struct<stale_items:array<string>>"
)
WARN_BYTES, MOST_BYTES, SHOWN = 5 * 1024 * 1024, 15 * 1024 * 1024, 30


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, json): the documents at a path, each a file; its path is the id."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("json"))


def parsed(documents: DataFrame) -> DataFrame:
    """documents with `a`, the fields that integrity, differences and quickfix lines need; null where it is no JSON."""
    return documents.withColumn("a", F.from_json("json", ARTIFACT))


def write_text(lines: DataFrame, path: str) -> None:
    """Write (value) rows as text; one document a row where that is what they are."""
    lines.select("value").write.mode("overwrite").text(path)


POINTER = "array<struct<part:string,part_pos:int,item:string,location:string,symbol_id:string,path:string,range:struct<start_line:int,start_character:int,end_line:int,end_character:int>,content_hash:string>>"


def _each(items: Column, f) -> Column:
    """The pointers that f(item, position) gives, in one array; none for null."""
    none = F.array().cast(POINTER)
    return F.coalesce(F.flatten(F.transform(items, f)), none)


def _pointers(part: str, i: Column, item: Column, at: Column, found: Column) -> Column:
    place = lambda e, k: F.struct(F.lit(part).alias("part"), i.alias("part_pos"), item.alias("item"), F.concat(at, F.lit(".evidence["), k.cast("string"), F.lit("]")).alias("location"), e["symbol_id"].alias("symbol_id"), e["path"].alias("path"), e["range"].alias("range"), e["content_hash"].alias("content_hash"))
    return F.coalesce(F.transform(found, place), F.array().cast(POINTER))


def pointers(with_flows: bool = False) -> Column:
    """All pointers of the parsed document `a` in one array. With `with_flows` also those that a flow itself carries, at no location."""
    c, at = F.col, lambda name, i, *before: F.concat(*before, F.lit(f"{name}["), i.cast("string"), F.lit("]"))
    listed = lambda name, items: _each(c(items), lambda x, i: _pointers(name, i, x["id"], at(name, i), x["evidence"]))

    def step(x, i, y, j):
        here = at("steps", j, at("flows", i), F.lit("."))
        below = _each(y["branches"], lambda z, k: _pointers("flows", i, x["id"], at("branches", k, here, F.lit(".")), z["evidence"]))
        return F.concat(_pointers("flows", i, x["id"], here, y["evidence"]), below)

    parts = [_each(c("a.flows"), lambda x, i: _each(x["steps"], lambda y, j: step(x, i, y, j)))]
    parts += [listed(name, f"a.{name}") for name in ("concepts", "invariants", "findings", "lessons.predict", "lessons.localization")]
    if with_flows:
        own = _each(c("a.flows"), lambda x, i: _pointers("flows", i, x["id"], F.lit(""), x["evidence"]))
        parts.append(F.transform(own, lambda p: p.withField("location", F.lit(""))))
    return F.concat(*parts)


def evidence(of: DataFrame, with_flows: bool = False) -> DataFrame:
    """(id, part, part_pos, item, location, symbol_id, path, range, content_hash) of every pointer; part names the list that it stands in."""
    return of.select("id", F.explode(pointers(with_flows)).alias("e")).select("id", "e.*")


def item_evidence(of: DataFrame) -> DataFrame:
    """Pointers that count for an item's freshness: those of `evidence` and those that a flow itself carries."""
    return evidence(of, with_flows=True)


def slim(documents: DataFrame) -> DataFrame:
    """(id, a): parsed documents cut off their text once, with the lines of each index file counted in place of its source."""
    files = F.transform("a.index.files", lambda f: F.struct(f["path"].alias("path"), f["sha256"].alias("sha256"), T.line_count(f["source"]).alias("n_lines")))
    index = F.col("a.index").withField("files", files)
    rows = documents if "a" in documents.columns else parsed(documents)
    return G.written(rows.select("id", F.col("a").withField("index", index).alias("a")), "documents")


def _symbols(of: DataFrame) -> DataFrame:
    """The last of each id in a document: one partial aggregate, no sort."""
    rows = of.select("id", F.posexplode("a.index.symbols").alias("pos", "s"))
    return rows.groupBy("id", F.col("s.symbol_id").alias("symbol_id")).agg(F.max_by("s", "pos").alias("s")).select("id", "symbol_id", "s.path", "s.content_hash", "s.parent", "s.in_slice")


def _files(of: DataFrame) -> DataFrame:
    rows = of.select("id", F.posexplode("a.index.files").alias("pos", "f"))
    return rows.groupBy("id", F.col("f.path").alias("path")).agg(F.max_by("f", "pos").alias("f")).select("id", "path", "f.sha256", "f.n_lines")


def _dealt(rows: Column) -> Column:
    """An array's structs with a key, dealt by it to as many lists as the root of their number."""
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(rows))).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(rows, lambda r: F.pmod(F.hash(r["key"]), n) == i))


def _last(dealt: Column, key: Column, same=Column.__eq__) -> Column:
    """The last struct of a key among those dealt; null where there is none."""
    return F.try_element_at(F.filter(F.get(dealt, F.pmod(F.hash(key), F.size(dealt))), lambda r: same(r["key"], key)), F.lit(-1))


def integrity(of: DataFrame) -> DataFrame:
    """(id, location, message): pointers of the document that lead nowhere. Empty for a sound document.

    A document is a row, so all is looked up within it, and nothing is shuffled or written: what a row names is looked for in the lists
    of its symbols and files, dealt by their keys. All that names a symbol goes through one array, then all that names a file.
    """
    c, lit, text = F.col, F.lit, lambda x: x.cast("string")
    rows = of if "a" in of.columns else parsed(of)
    kind = "array<struct<key:string,location:string,message:string,path:string," + RANGE + ">>"
    some = lambda array, of=kind: F.coalesce(array, F.array().cast(of))
    ask = lambda key, location, message, path=lit(None), range_=lit(None): F.struct(key.alias("key"), location.alias("location"), message.alias("message"), path.cast("string").alias("path"), range_.cast(RANGE.split(":", 1)[1]).alias("range"))
    at = lambda name, i, field, key: F.concat(lit(f"{name}["), text(i), lit(f"].{field} "), key)
    ids = F.concat(*(some(F.transform(f"a.{n}", lambda x: x["id"]), "array<string>") for n in ("flows", "concepts", "invariants")))
    rows = rows.select(
        "id", c("a.index.edges").alias("edges"), c("a.index.references").alias("refs"), c("a.changes.stale_items").alias("stale"), pointers().alias("pointers"),
        F.transform("a.index.symbols", lambda s, i: F.struct(s["symbol_id"].alias("key"), i.alias("pos"), s["path"].alias("path"), s["parent"].alias("parent"), F.coalesce(s["in_slice"], lit(False)).alias("inside"))).alias("symbols"),
        F.transform("a.index.files", lambda f: F.struct(f["path"].alias("key"), T.line_count(f["source"]).alias("n_lines"))).alias("files"),
        F.transform(ids, lambda x: F.struct(x.alias("key"))).alias("items"),
    )
    rows = rows.select("*", _dealt(c("symbols")).alias("by_symbol"), _dealt(c("files")).alias("by_file"), _dealt(c("items")).alias("by_item"))
    rows = rows.withColumn("symbols", F.filter("symbols", lambda s: _last(c("by_symbol"), s["key"], Column.eqNullSafe)["pos"] == s["pos"]))
    # what names a symbol; of a pointer the message waits for its file
    named = F.concat(
        some(F.transform(F.filter("symbols", lambda s: s["parent"] != ""), lambda s: ask(s["parent"], lit("index"), F.concat(lit("symbol "), s["key"], lit(" parent "), s["parent"], lit(" not in symbols"))))),
        some(F.flatten(F.transform("edges", lambda e, i: F.array(*(ask(e[x], lit("index"), F.concat(at("edges", i, x, e[x]), lit(" not in symbols"))) for x in ("from", "to")))))),
        some(F.transform("refs", lambda r, i: ask(r["symbol_id"], lit("index"), F.concat(at("references", i, "symbol_id", r["symbol_id"]), lit(" not in symbols"))))),
        some(F.transform("pointers", lambda p: ask(p["symbol_id"], p["location"], lit(None).cast("string"), p["path"], p["range"]))),
    )
    rows = rows.withColumn("named", F.transform(named, lambda x: x.withField("inside", _last(c("by_symbol"), x["key"])["inside"])))
    lost = F.filter("named", lambda x: x["inside"].isNull() & (x["message"].isNotNull() | x["key"].isNotNull()))
    lost = F.transform(lost, lambda x: F.struct(x["location"].alias("location"), F.coalesce(x["message"], F.concat(lit("symbol_id "), x["key"], lit(" not in index.symbols"))).alias("message")))
    # what names a file; a symbol outside the slice needs none
    asked = F.concat(
        some(F.transform(F.filter("symbols", lambda s: s["inside"]), lambda s: ask(s["path"], lit("index"), F.concat(lit("in_slice symbol "), s["key"], lit(" has no source file "), s["path"])))),
        some(F.transform("refs", lambda r, i: ask(r["path"], lit("index"), F.concat(at("references", i, "path", r["path"]), lit(" not in files"))))),
    )
    stub = lambda array, of: F.transform(array, lambda x: x.withField("stub", of(x)))
    placed = F.transform(F.filter("named", lambda x: x["message"].isNull()), lambda x: F.struct(x["path"].alias("key"), x["location"].alias("location"), x["message"].alias("message"), lit(None).cast("string").alias("path"), x["range"].alias("range"), F.coalesce(~x["inside"], lit(False)).alias("stub")))
    there = F.transform(F.concat(stub(asked, lambda x: lit(False)), placed), lambda x: x.withField("n_lines", _last(c("by_file"), x["key"])["n_lines"]))

    def broken(x):
        first, last = F.coalesce(x["range"]["start_line"], lit(1)), F.coalesce(x["range"]["end_line"], lit(1))
        absent = F.when(x["message"].isNotNull(), x["message"]).when(~x["stub"], F.concat(lit("path "), F.coalesce(x["key"], lit("null")), lit(" not in index.files")))
        beyond = F.when(x["message"].isNull() & ((first > x["n_lines"]) | (last > x["n_lines"])), F.concat(lit("range L"), text(first), lit("-L"), text(last), lit(" out of bounds for "), x["key"], lit(" ("), text(x["n_lines"]), lit(" lines)")))
        return F.struct(x["location"].alias("location"), F.when(x["n_lines"].isNull(), absent).otherwise(beyond).alias("message"))

    wrong = F.filter(F.transform(there, broken), lambda x: x["message"].isNotNull())
    unknown = F.transform(F.filter("stale", lambda k: _last(c("by_item"), k).isNull()), lambda k: F.struct(lit("changes.stale_items").alias("location"), F.concat(lit("unknown id "), k).alias("message")))
    # outer: of an inner explode Spark infers a filter that works all of this out a second time
    found = rows.select("id", F.explode_outer(F.concat(lost, wrong, some(unknown, "array<struct<location:string,message:string>>"))).alias("x"))
    return found.filter("x is not null").select("id", "x.*")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, json): what changed from the artifact to the new index of the same id, the items that it makes stale and those
    that can be used again."""
    c = F.col
    before, after = slim(before), slim(after)
    symbols = D.snapshot_diff(*(_symbols(x).filter("in_slice").select("id", c("symbol_id").alias("key"), c("content_hash").alias("h")) for x in (before, after)), ["id", "key"], "h")
    files = D.snapshot_diff(*(_files(x).select("id", c("path").alias("key"), c("sha256").alias("h")) for x in (before, after)), ["id", "key"], "h")
    touched = symbols.select("id", "key").union(files.select("id", F.concat(F.lit("path:"), "key")))
    kinds = F.array(*(F.lit(k) for k in ("flows", "concepts", "invariants")))
    pointers = item_evidence(before).filter(c("part").isin("flows", "concepts", "invariants"))
    keys = pointers.select("id", "part", "part_pos", F.explode(F.array("symbol_id", F.concat(F.lit("path:"), "path"))).alias("key"))
    hit = D.stale_split(keys, touched, ["id", "part", "part_pos"], ["id", "key"])[0].withColumn("stale", F.lit(True))
    items = reduce(DataFrame.union, [before.select("id", F.lit(k).alias("part"), F.posexplode(f"a.{k}").alias("part_pos", "x")).select("id", "part", "part_pos", c("x.id").alias("item")) for k in ("flows", "concepts", "invariants")])
    items = items.join(hit, ["id", "part", "part_pos"], "left").withColumn("o", F.struct(F.array_position(kinds, c("part")), "part_pos", "item"))
    chosen = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, c("o")))), lambda o: o["item"])
    split = items.groupBy("id").agg(chosen(c("stale").isNotNull()).alias("stale"), chosen(c("stale").isNull()).alias("reusable"))
    listed = lambda df, name: df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(c("key").alias(name), "change"))).alias(f"by_{name}"))
    rows = before.select("id", c("a.repository.head_commit").alias("head"), c("a.artifact_id").alias("artifact"))
    for part in (listed(files, "path"), listed(symbols, "symbol_id"), split):
        rows = rows.join(part, "id", "left")
    some = lambda name, kind: F.coalesce(c(name), F.array().cast(kind))
    changed = some("by_symbol_id", "array<struct<symbol_id:string,change:string>>")
    doc = F.struct(
        F.struct(c("head").alias("previous_head_commit"), some("by_path", "array<struct<path:string,change:string>>").alias("files"), changed.alias("symbols"), some("stale", "array<string>").alias("stale_items")).alias("changes"),
        F.transform(changed, lambda x: x["symbol_id"]).alias("reinvestigate"), some("reusable", "array<string>").alias("reusable"), c("artifact").alias("previous_artifact_id"),
    )
    return rows.select("id", F.to_json(doc).alias("json"))


def notice(changed: DataFrame) -> DataFrame:
    """(id, notice) of the documents of changes() whose files and symbols are all as they were."""
    lists = F.from_json("json", "changes struct<files:array<string>,symbols:array<string>>")
    rows = changed.select("id", lists.alias("c")).filter((F.size("c.changes.files") == 0) & (F.size("c.changes.symbols") == 0))
    return rows.select("id", F.lit("no changes: artifact is up to date").alias("notice"))


def lineage(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, ancestor, steps) of artifacts (artifact_id, previous): all that previous ids lead to, known or not.

    Chains are followed by doubling, so rounds grow with the logarithm of the longest chain. Where an artifact has one
    previous id, a row holds its ancestors in order, and only those whose chain goes on are joined, with those of their
    last; pairs are written nowhere. A chain that comes back to itself ends where it meets an id again.
    """
    c = F.col
    links = artifacts.filter("previous is not null").select("artifact_id", "previous")
    ends = links.groupBy("artifact_id").agg(F.min("previous").alias("first"), F.max("previous").alias("last"))
    goes_on = F.coalesce(c("artifact_id") != c("first"), F.lit(False))
    chains = G.written(ends.select("artifact_id", F.array("first").alias("path"), goes_on.alias("open"), (c("first") != c("last")).alias("several")), "chains")
    if not chains.filter("several").isEmpty():
        G.removed(chains)
        return _pairs(links)
    own = c("artifact_id").cast(links.schema["previous"].dataType)
    while not chains.filter("open").isEmpty():
        last, further = F.element_at("path", -1), chains.select(c("artifact_id").alias("_last"), c("path").alias("_path"), c("open").alias("_open"))
        found = chains.filter("open").withColumn("_last", last).join(further, "_last", "left")
        both = F.concat("path", F.coalesce("_path", F.array().cast(chains.schema["path"].dataType)))
        # what comes after an id that was met is all known, and the artifact itself can only come last
        found = found.withColumn("_met", F.array_remove(F.array_distinct(both), own))
        found = found.select("artifact_id", c("_met").alias("path"), (F.coalesce("_open", F.lit(False)) & (F.size("_met") == F.size("path") + F.size("_path"))).alias("open"))
        before, chains = chains, G.written(chains.filter("not open").select("artifact_id", "path", "open").union(found), "chains")
        G.removed(before)
    return chains.select("artifact_id", F.posexplode("path").alias("steps", "ancestor")).select("artifact_id", "ancestor", (c("steps") + 1).cast("long").alias("steps"))


def _pairs(links: DataFrame) -> DataFrame:
    """lineage() where artifacts have several previous ids: the least steps of each pair. Of the pairs as many steps apart as
    any known, each round goes on from the ancestors."""
    c = F.col
    least = lambda rows: G.written(rows.groupBy("artifact_id", "ancestor").agg(F.min("steps").alias("steps")), "pairs")
    known, span = least(links.select("artifact_id", c("previous").alias("ancestor"), F.lit(1).cast("long").alias("steps"))), 1
    while not known.filter(c("steps") == span).isEmpty():
        ends = known.filter(c("steps") == span).select("artifact_id", c("ancestor").alias("_end"))
        further = ends.join(known.select(c("artifact_id").alias("_end"), "ancestor", (c("steps") + span).alias("steps")), "_end").select("artifact_id", "ancestor", "steps")
        before, known = known, least(known.union(further.filter("artifact_id <> ancestor")))
        G.removed(before)
        span *= 2
    return known


def quickfix(of: DataFrame) -> DataFrame:
    """(id, pos, value): one line for each finding that has evidence, at its first."""
    f = of.select("id", F.posexplode("a.findings").alias("pos", "f")).filter("size(f.evidence) > 0").select("id", "pos", "f", F.expr("f.evidence[0]").alias("e"))
    line = T.quickfix_line(F.col("e.path"), F.col("e.range.start_line"), F.col("e.range.start_character"), F.col("f.severity"), F.coalesce("f.claim", F.lit("")))
    return f.select("id", "pos", line.alias("value"))


# work on arbitrary keys

_KEY = re.compile(rf"(?i)^(?:.*({T.SECRET_KEYS}).*)$")
_VALUES = [re.compile(T.ASSIGNMENT, re.I), *map(re.compile, T.VALUE_PATTERNS.values())]


def redacted(value, key: str | None = None):
    """(value with its secrets replaced, how many): strings by shape, or whole where their key names a secret."""
    if isinstance(value, dict):
        found = {k: redacted(v, k) for k, v in value.items()}
        return {k: v for k, (v, _) in found.items()}, sum(n for _, n in found.values())
    if isinstance(value, list):
        found = [redacted(v, key) for v in value]
        return [v for v, _ in found], sum(n for _, n in found)
    if not isinstance(value, str):
        return value, 0
    if key and _KEY.match(key) and key not in ("content_hash", "sha256"):
        return T.MARK, 1
    total = 0
    for i, p in enumerate(_VALUES):
        value, n = p.subn(rf"\1\2\3{T.MARK}\3" if i == 0 else T.MARK, value)
        total += n
    return value, total


def redact(documents: DataFrame) -> DataFrame:
    """(id, json, redactions): each document with its secrets replaced, by shape or by the key that they stand under."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [redacted(json.loads(x)) for x in b["json"]]
            yield pd.DataFrame({"id": b["id"], "json": [json.dumps(d, ensure_ascii=False, separators=(",", ":")) for d, _ in found], "redactions": [n for _, n in found]})

    return documents.select("id", "json").mapInPandas(clean, f"id {documents.schema['id'].dataType.simpleString()}, json string, redactions long")


def rule_errors(value, rules: dict, root: dict | None = None, at: tuple = ()) -> list[tuple[str, str]]:
    """(location, message) where a value breaks a rule document in JSON Schema's words: $ref, type, enum, const, required,
    properties, additionalProperties, items, and the limits of lengths, numbers, sizes and patterns."""
    root = rules if root is None else root
    if "$ref" in rules:
        rules = reduce(lambda d, k: d[k], rules["$ref"].lstrip("#/").split("/"), root)
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}
    out: list[tuple[str, str]] = []
    say = lambda message: out.append(("/".join(map(str, at)) or "(root)", message))
    kind = rules.get("type")
    if kind and (not isinstance(value, kinds[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        say(f"{value!r} is not of type {kind!r}")
        return out
    if "enum" in rules and value not in rules["enum"]:
        say(f"{value!r} is not one of {rules['enum']!r}")
    if "const" in rules and value != rules["const"]:
        say(f"{rules['const']!r} was expected")
    if isinstance(value, str):
        if len(value) < rules.get("minLength", 0):
            say(f"{value!r} is too short")
        if len(value) > rules.get("maxLength", len(value)):
            say(f"{value!r} is too long")
        if "pattern" in rules and not re.search(rules["pattern"], value):
            say(f"{value!r} does not match {rules['pattern']!r}")
    elif isinstance(value, int | float) and not isinstance(value, bool) and value < rules.get("minimum", value):
        say(f"{value!r} is less than the minimum of {rules['minimum']!r}")
    elif isinstance(value, list):
        if len(value) < rules.get("minItems", 0):
            say(f"{value!r} is too short")
        if len(value) > rules.get("maxItems", len(value)):
            say(f"{value!r} is too long")
        for i, x in enumerate(value if "items" in rules else []):
            out += rule_errors(x, rules["items"], root, (*at, i))
    elif isinstance(value, dict):
        known = rules.get("properties", {})
        for k in rules.get("required", []):
            if k not in value:
                say(f"{k!r} is a required property")
        more = rules.get("additionalProperties", True)
        for k, x in value.items():
            if k in known or isinstance(more, dict):
                out += rule_errors(x, known.get(k, more), root, (*at, k))
            elif more is False:
                say(f"additional property {k!r} is not allowed")
    return out


def check(documents: DataFrame, rules: dict) -> DataFrame:
    """(id, location, message): breaches of the rule document and, for documents without any, of integrity. Text that is
    no JSON is one breach."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["json"], strict=True):
                try:
                    rows += [(key, w, m) for w, m in sorted(rule_errors(json.loads(text), rules))]
                except (TypeError, ValueError) as e:
                    rows.append((key, "(root)", f"not JSON: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["id", "location", "message"])

    broken = G.written(documents.select("id", "json").mapInPandas(find, f"id {documents.schema['id'].dataType.simpleString()}, location string, message string"), "breaches")
    sound = parsed(documents.join(broken.select("id").distinct(), "id", "left_anti"))
    return broken.unionByName(integrity(sound))


def render(documents: DataFrame, template: str, breaches: DataFrame, title_mark: str, data_mark: str, version: str = r"template-version:\s*([0-9.]+)") -> DataFrame:
    """(id, status, redactions, n_bytes, errors, html): each document, redacted, within the template.

    Documents with breaches are `invalid`, with the first 30 of them and no html; those over 15 MiB are `refuse`, over
    5 MiB `warn`. The title is escaped. Raises ValueError where the template has no place for the data.
    """
    if data_mark not in template:
        raise ValueError("the template has no place for the data")
    found = re.search(version, template)
    number = found[1] if found else "unknown"

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html import escape

        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["json"], strict=True):
                doc, n = redacted(json.loads(text))
                doc.setdefault("inputs", {})["template_version"] = number
                payload = json.dumps(doc, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/")
                rows.append((key, n, template.replace(title_mark, escape(doc.get("title") or "Artifact")).replace(data_mark, payload)))
            yield pd.DataFrame(rows, columns=["id", "redactions", "html"])

    errors = breaches.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.concat("location", F.lit(": "), "message"))), 1, SHOWN).alias("errors"))
    good = documents.join(errors, "id", "left_anti").select("id", "json").mapInPandas(fill, f"id {documents.schema['id'].dataType.simpleString()}, redactions long, html string")
    size = F.octet_length("html").cast("long")
    status = T.size_class(size, WARN_BYTES, MOST_BYTES)
    pages = good.select("id", status.alias("status"), "redactions", size.alias("n_bytes"), F.array().cast("array<string>").alias("errors"), F.when(status != "refuse", F.col("html")).alias("html"))
    bad = errors.select("id", F.lit("invalid").alias("status"), F.lit(0).cast("long").alias("redactions"), F.lit(None).cast("long").alias("n_bytes"), "errors", F.lit(None).cast("string").alias("html"))
    return pages.union(bad)

"""The index of a source snapshot: names resolved to symbols, the slice about the entries, and its one JSON document."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import graph as G
from siltstone.operators import keyed as K
from siltstone.sources import snapshot as S

# Member names too common to be matched by name alone.
BLOCKED = {
    "python": [
        "get", "set", "items", "keys", "values", "append", "extend", "add", "pop", "update", "join", "split",
        "strip", "lstrip", "rstrip", "format", "read", "write", "close", "copy", "encode", "decode", "count",
        "index", "sort", "replace", "startswith", "endswith", "lower", "upper", "setdefault", "clear", "remove",
        "insert",
    ],
    "typescript": [
        "get", "set", "map", "filter", "reduce", "forEach", "push", "pop", "slice", "splice", "concat", "join",
        "split", "keys", "values", "entries", "includes", "indexOf", "find", "sort", "replace", "toString", "then",
        "catch", "finally", "add", "delete", "has", "trim", "startsWith", "endsWith", "charAt", "test", "exec",
    ],
    "go": [
        "Error", "String", "Close", "Read", "Write", "Len", "Add", "Get", "Set", "Delete", "Lock", "Unlock", "Done",
        "Err",
    ],
}
BLOCKED["javascript"] = BLOCKED["typescript"]
MAX_SOURCE_BYTES = 4 * 1024 * 1024
SPAN = ["start_line", "start_character", "end_line", "end_character"]


def blocked_call() -> Column:
    """Member calls whose name their language blocks."""
    hit = F.lit(False)
    for language, names in BLOCKED.items():
        hit = hit | ((F.col("language") == language) & F.col("name").isin(names))
    return F.col("is_member") & hit


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with `target`, the only function, method or class of that name in the language; null where unresolved."""
    known = symbols.filter(F.col("kind").isin("function", "method", "class")).select("language", "name", "symbol_id")
    return K.resolve_unique(calls, known, ["language", "name"], "symbol_id", blocked_call())


def resolve_imports(targets: DataFrame, modules: DataFrame) -> DataFrame:
    """(language, path, file_ord, pos, src, dst): a file's first import of each other module.

    A target is a module itself; in Python else its longest dotted prefix that is one; in Go else the first module whose
    folder ends it. Prefixes and path ends are joined by equality.
    """
    c = F.col
    known = modules.groupBy("language", "module").agg(F.min("file_ord").alias("first"))
    of = lambda df, language: df.filter(c("language") == language)
    named = lambda df, language: df.select(F.lit(language).alias("language"), "target", c("resolved").alias("dst"))
    prefixes = named(K.longest_prefix(of(targets, "python").select("target").distinct(), of(known, "python"), "target", "module", "."), "python")
    exact = targets.filter("language <> 'python'").select("language", "target").distinct().join(known.select("language", c("module").alias("target")), ["language", "target"], "left_semi").select("language", "target", c("target").alias("dst"))
    folder = F.when(c("module").contains("/"), F.regexp_replace("module", "/[^/]*$", "")).otherwise(F.lit("."))
    paths = of(targets, "go").select("language", "target").distinct().join(exact, ["language", "target"], "left_anti")
    ends = named(K.directory_suffix(paths.select("target"), of(known, "go").select("module", "first", folder.alias("directory")), "target", "module", "directory", "first"), "go")
    direct = targets.join(prefixes.union(exact).union(ends), ["language", "target"])
    rows = direct.filter(c("dst") != c("module"))
    name = lambda m: F.concat("language", F.lit(":"), m)
    one = rows.groupBy("language", "path", "file_ord", "module", "dst").agg(F.min("pos").alias("pos"))
    return one.select("language", "path", "file_ord", "pos", name(c("module")).alias("src"), name(c("dst")).alias("dst"))


def locate(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points (path, line, character, ...) with `symbol_id`, the innermost symbol that holds each, ends included, and where
    it begins (span_line, span_character); the file's module where none does; null where the file has none."""
    c = F.col
    found = K.innermost(points, symbols.filter("kind <> 'module'").withColumnRenamed("symbol_id", "_symbol"), "path", ["line", "character"], SPAN[:2], SPAN[2:], "sym_ord", "_symbol")
    own = symbols.filter("kind = 'module'").groupBy(c("path").alias("_path")).agg(F.max_by("symbol_id", "sym_ord").alias("_module"), F.max_by("start_line", "sym_ord").alias("_line0"), F.max_by("start_character", "sym_ord").alias("_character0"))
    rows = found.join(own, c("path") == c("_path"), "left").drop("_path")
    at = lambda span, module: F.when(c("_symbol").isNull(), c(module)).otherwise(c(span)).cast("int").alias(span)
    return rows.select(*points.columns, F.coalesce("_symbol", "_module").alias("symbol_id"), at("span_line", "_line0"), at("span_character", "_character0"))


def resolve_locations(requests: DataFrame, definitions: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests (request, name, ...) with `target`: of the answers of a definition service, in order, the first whose symbol
    has the name asked for; and `target_at` (path, line, character), where that begins. definitions: (request, answer,
    path, line, character), character in bytes."""
    named = locate(definitions, symbols.select("path", *SPAN, "kind", "sym_ord", "symbol_id"))
    known = symbols.select("symbol_id", F.col("name").alias("_name")).distinct()
    right = named.join(known, "symbol_id").join(requests.select("request", F.col("name").alias("_name")).distinct(), ["request", "_name"])
    at = F.struct("path", F.col("span_line").alias("line"), F.col("span_character").alias("character"))
    first = right.groupBy("request").agg(F.min_by(F.struct("symbol_id", at.alias("at")), "answer").alias("_first"))
    return requests.join(first, "request", "left").withColumns({"target": F.col("_first.symbol_id"), "target_at": F.col("_first.at")}).drop("_first")


def usage_requests(facts: DataFrame, symbols: DataFrame, most: int = 500) -> DataFrame:
    """Usages in these files (a slice's) that are worth a question to a definition service: names that the language knows, apart
    from names that stand where a symbol of that name begins; at most `most` a language, a budget of requests. Usages
    that are references already are asked for too: the first reference of a span stays, whatever came of it."""
    names = symbols.select("language", "name").distinct()
    start = ["path", "start_line", "start_character", "name"]
    rows = S.listed(facts, "usages").join(names, ["language", "name"], "left_semi").join(symbols.select(*start), start, "left_anti")
    return K.first_per_key(rows, ["language"], ["file_ord", "pos"], most)


def usage_references(requests: DataFrame, definitions: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests that lead to a symbol, with it as symbol_id: other than a module, and not one that begins at the usage's own place."""
    c = F.col
    own = (c("target_at.path") == c("path")) & (c("target_at.line") == c("start_line")) & (c("target_at.character") == c("start_character"))
    found = resolve_locations(requests, definitions, symbols).filter(c("target").isNotNull() & ~own)
    modules = symbols.filter("kind = 'module'").select(c("symbol_id").alias("target"))
    return found.join(modules, "target", "left_anti").drop("target_at").withColumnRenamed("target", "symbol_id")


def numbered(rows: DataFrame, order: list[str], number: str) -> DataFrame:
    """rows with an increasing number along order: written, then a range sort and ids that grow with the partition."""
    held = G.written(rows, "unordered")
    out = G.cut(held.orderBy(*order).withColumn(number, F.monotonically_increasing_id()))
    G.removed(held)
    return out


def match_symbols(entries: DataFrame, files: DataFrame, symbols: DataFrame, last: DataFrame) -> DataFrame:
    """(entry, symbol_id): all symbols of the files an entry names by path or path end; for entries without one, symbols
    by id, qualified name, full name or an end of that after a point."""
    steps = F.split("path", "/")
    ends = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, n, F.size(steps)), "/"))).alias("norm"))
    norm = F.ltrim(F.replace("entry", F.lit("\\"), F.lit("/")), F.lit("./"))
    by_file = entries.withColumn("norm", norm).join(ends, "norm").select("entry", "path").distinct()
    rest = entries.join(by_file.select("entry").distinct(), "entry", "left_anti")
    names = F.split("full_name", "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, n, F.size(names)), "."))
    named = last.select("symbol_id", F.explode(F.array_distinct(F.concat(tails, F.array("symbol_id", "qualname")))).alias("entry")).filter("entry <> ''")
    return by_file.join(symbols.select("path", "symbol_id"), "path").select("entry", "symbol_id").union(rest.join(named, "entry").select("entry", "symbol_id")).distinct()


def served(facts: DataFrame, answers: DataFrame | None) -> DataFrame:
    """(language, tier): `generic`, or the tier of a language's definition service where it answered all calls.

    answers: (language, service, failed) and perhaps failed_in. A service that failed leaves its whole language to the
    generic tier, unless it failed in `usages`: by then calls were answered, and what it found of usages stays.
    """
    languages = facts.select("language").distinct()
    if answers is None:
        return languages.withColumn("tier", F.lit("generic"))
    late = F.col("failed_in") == "usages" if "failed_in" in answers.columns else F.lit(False)
    failed = F.coalesce("failed", F.lit(False)) & ~F.coalesce(late, F.lit(False))
    sound = answers.groupBy("language").agg(F.first("service").alias("service"), F.max(failed).alias("failed")).filter("not failed")
    return languages.join(sound, "language", "left").select("language", F.when(F.col("service").isNotNull(), F.concat(F.lit("lsp:"), "service")).otherwise("generic").alias("tier"))


def call_request() -> Column:
    """The request that asks a definition service for a call: where its name begins."""
    return F.concat_ws(":", "path", "start_line", "start_character")


def tiered_calls(calls: DataFrame, symbols: DataFrame, tiers: DataFrame, definitions: DataFrame | None) -> DataFrame:
    """calls with `target` and `resolution`: by the service's answers where its language has one, by unique names elsewhere."""
    generic = resolve_calls(calls, symbols).withColumn("resolution", F.lit("name_match"))
    if definitions is None:
        return generic
    by_service = tiers.filter("tier <> 'generic'").select("language")
    asked = resolve_locations(calls.join(by_service, "language", "left_semi").withColumn("request", call_request()), definitions, symbols)
    asked = asked.drop("request", "target_at").withColumn("resolution", F.lit("lsp"))
    return generic.join(by_service, "language", "left_anti").unionByName(asked)


def entry_table(spark: SparkSession, entries: list[str], changed: DataFrame | None = None) -> DataFrame:
    """(entry, entry_ord): the entries named, then the files of a review (path, change) that were not removed, in order."""
    named = spark.createDataFrame(list(enumerate(entries)), "pos long, entry string").select("entry", F.struct(F.lit(0).alias("g"), "pos", F.lit("").alias("path")).alias("entry_ord"))
    if changed is None:
        return named
    files = changed.filter("change <> 'removed'").select("path").distinct()
    return named.union(files.select(F.col("path").alias("entry"), F.struct(F.lit(1).alias("g"), F.lit(0).cast("long").alias("pos"), "path").alias("entry_ord")))


@dataclass
class Index:
    """Relations of a slice. `files` come in order of `slot`, and `symbols` of `slot` too: those of the slice by their first
    place, then those that edges and references lead to, as they do. `entries` has every entry with whether it matched;
    `dropped` the files beyond the byte budget; `tiers` how each language's calls were resolved."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    references: DataFrame
    entries: DataFrame
    dropped: DataFrame
    stats: DataFrame
    tiers: DataFrame


ORDER = ["_late", "_rank", "_phase", "file_ord", "pos"]


def _ordered(late: int, phase: int) -> list[Column]:
    """Where rows stand among those of all languages: calls before imports in a language, usages after all."""
    return [F.lit(late).alias("_late"), S.language_rank(F.col("language")).alias("_rank"), F.lit(phase).alias("_phase"), F.col("file_ord"), F.col("pos")]


def call_edges(calls: DataFrame) -> DataFrame:
    """Edges of calls with target and resolution."""
    c = F.col
    site = F.struct("path", F.struct(*SPAN).alias("range"))
    return calls.filter("target is not null").select(*_ordered(0, 0), c("enclosing").alias("src"), c("target").alias("dst"), F.lit("calls").alias("kind"), "resolution", site.alias("site"))


def import_edges(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges between modules, one a file and module, without a place."""
    none = F.lit(None).cast(f"struct<path:string,range:struct<{','.join(f'{x}:int' for x in SPAN)}>>")
    found = resolve_imports(S.listed(facts, "targets"), symbols.select("language", "module", "file_ord").distinct())
    return found.select(*_ordered(0, 1), "src", "dst", F.lit("imports").alias("kind"), F.lit("exact").alias("resolution"), none.alias("site"))


def call_references(calls: DataFrame) -> DataFrame:
    return calls.filter("target is not null").select(*_ordered(0, 0), "path", *SPAN, F.col("target").alias("symbol_id"))


def name_references(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """References of imported names to what they name, the last of that full name."""
    by_full = K.dedup_last(symbols.select("language", "full_name", "symbol_id", "file_ord", "sym_ord"), ["language", "full_name"], ["file_ord", "sym_ord"])
    named = S.listed(facts, "names").join(by_full.select("language", "full_name", "symbol_id"), ["language", "full_name"])
    return named.select(*_ordered(0, 1), "path", *SPAN, "symbol_id")


def build(files: DataFrame, entries: list[str], hops: int = 2, max_source_bytes: int = MAX_SOURCE_BYTES, repeats: bool = True, definitions: DataFrame | None = None, answers: DataFrame | None = None, changed: DataFrame | None = None, facts: DataFrame | None = None) -> Index:
    """Index the slice within `hops` of the entries. Facts are read once and written, or given (of a store); ids keep the
    last of their definitions.

    definitions (request, answer, path, line, character) are the answers of definition services, requests being
    `path:line:character` of a name, and answers (language, service, failed) says which languages have one; the others,
    and those whose service failed, are resolved by names. Usages are asked for in the slice's files alone. changed (path,
    change) adds a review's files to the entries. Raises ValueError without an entry and where none matches anything.
    """
    c = F.col
    wanted = entry_table(files.sparkSession, entries, changed)
    if not entries and wanted.isEmpty():
        raise ValueError("no entry: name one, or a base with changes to files of a known language")
    facts = S.facts(files, repeats) if facts is None else facts
    tiers = G.cut(served(facts, answers if definitions is not None else None))
    symbols = S.symbols(facts)
    last = G.written(K.dedup_last(symbols, ["symbol_id"], ["file_ord", "sym_ord"]), "symbols")
    calls = G.written(tiered_calls(S.listed(facts, "calls"), symbols, tiers, definitions), "calls")
    edges = numbered(call_edges(calls).union(import_edges(facts, symbols)), ORDER, "edge_seq").drop(*ORDER)
    hits = G.cut(match_symbols(wanted.select("entry").distinct(), facts, symbols, last))
    if hits.isEmpty():
        raise ValueError("no entry matches a file or symbol")
    contains = last.filter("parent is not null").select(c("symbol_id").alias("src"), c("parent").alias("dst"))
    neighbours = G.adjacency(edges.select("src", "dst").union(contains))
    seen = G.khop(G.dealt(neighbours, "adjacency", "a") if hops else neighbours, hits.select(c("symbol_id").alias("node")), hops)
    paths = last.join(seen, last["symbol_id"] == seen["node"], "left_semi").select("path").distinct()
    near = facts.join(paths, "path", "left_semi").select("path", F.length("source").alias("chars"), "file_ord", "n_bytes")
    fold = G.budget_fold(near, ["chars", "file_ord"], "n_bytes", "path", max_source_bytes)
    fold = G.cut(fold.join(near, "path"))
    cut_short = not fold.filter("not kept").isEmpty()  # then files stand by their lengths, else as they were read
    slot = F.struct((c("chars") if cut_short else F.lit(0)).alias("chars"), "file_ord").alias("slot")
    held = fold.filter("kept").select("path", slot)
    sliced = facts.join(held, "path").select("path", "language", "sha256", "source", "n_bytes", "file_ord", "slot")
    refs = call_references(calls).union(name_references(facts, symbols)).join(held.select("path"), "path", "left_semi")
    if definitions is not None:
        of_slice = facts.join(held.select("path"), "path", "left_semi").join(tiers.filter("tier <> 'generic'"), "language", "left_semi")
        asked = usage_requests(of_slice, symbols).withColumn("request", call_request())
        used = usage_references(asked, definitions, symbols)
        refs = refs.unionByName(used.select(*_ordered(1, 2), "path", *SPAN, "symbol_id"))
    refs = refs.join(last.select("symbol_id"), "symbol_id", "left_semi").select(F.struct(*ORDER).alias("ref_seq"), "path", *SPAN, "symbol_id")
    spans = G.written(K.dedup_first(refs, ["path", *SPAN], ["ref_seq"]), "references")
    led = refs.groupBy("symbol_id").agg(F.min("ref_seq").alias("ref"))
    own = symbols.join(held, "path").withColumn("slot", F.struct("slot", "sym_ord"))
    inside = G.cut(own.groupBy("symbol_id").agg(F.min("slot").alias("own"), F.max_by(F.struct(*symbols.columns), "slot").alias("s")))
    kept, stubs = G.boundary(edges.select(c("edge_seq").alias("seq"), "src", "dst"), inside.select(c("symbol_id").alias("node")))
    held_edges = edges.join(kept.select(c("seq").alias("edge_seq")), "edge_seq", "left_semi")
    by_edge = stubs.select(c("node").alias("symbol_id"), c("t").alias("edge")).join(held_edges.select(c("edge_seq").alias("edge"), "src"), "edge")
    by_edge = by_edge.select("symbol_id", F.struct("edge", (c("src") != c("symbol_id")).alias("end")).alias("edge"))
    outside = by_edge.join(led, "symbol_id", "full_outer").join(inside.select("symbol_id"), "symbol_id", "left_anti")
    places = lambda n, own, edge, ref: F.struct(F.lit(n).alias("kind"), own.alias("own"), edge.alias("edge"), ref.alias("ref")).alias("slot")
    nothing = lambda like: F.lit(None).cast(like)
    kinds = inside.schema["own"].dataType, by_edge.schema["edge"].dataType, led.schema["ref"].dataType
    rows = inside.select("s.*", F.lit(True).alias("in_slice"), places(0, c("own"), nothing(kinds[1]), nothing(kinds[2])))
    far = places(1, nothing(kinds[0]), c("edge"), F.when(c("edge").isNull(), c("ref")))
    far = F.when(c("edge").isNull(), F.struct(F.lit(2).alias("kind"), nothing(kinds[0]).alias("own"), nothing(kinds[1]).alias("edge"), c("ref").alias("ref"))).otherwise(far).alias("slot")
    out = G.cut(rows.unionByName(last.join(outside, "symbol_id").select(*symbols.columns, F.lit(False).alias("in_slice"), far)))
    counts = facts.agg(F.coalesce(F.sum(F.size("calls")), F.lit(0)).alias("calls"), F.count("*").alias("files_scanned"))
    stats = counts.crossJoin(edges.agg(F.count_if(c("kind") == "calls").alias("resolved"))).crossJoin(held_edges.agg(F.count("*").alias("edges")))
    stats = stats.crossJoin(out.agg(F.count_if("in_slice").alias("slice_symbols"), F.count_if(~c("in_slice")).alias("boundary_symbols")))
    stats = stats.select("files_scanned", "slice_symbols", "boundary_symbols", "edges", (c("calls") - c("resolved")).alias("unresolved_calls"))
    matched = wanted.join(hits.select("entry").distinct().withColumn("_m", F.lit(True)), "entry", "left").select("entry", "entry_ord", F.coalesce("_m", F.lit(False)).alias("matched"))
    dropped = fold.filter("not kept").select("path", "n_bytes", F.struct("chars", "file_ord").alias("slot"))
    return Index(sliced, out, held_edges, spans, matched, dropped, stats, tiers)


def _lists(index: Index, changes: tuple[DataFrame, DataFrame] | None) -> dict[str, tuple[DataFrame, str, Column]]:
    """Of each list in the document, by its place: its rows, the column that they stand in order of, and an entry."""
    c, span = F.col, F.struct(*SPAN).alias("range")
    cut = F.concat(F.lit("file dropped from slice (size budget): "), "path", F.lit(" ("), c("n_bytes").cast("string"), F.lit(" bytes)"))
    found = {
        "slice.entry_points": (index.entries, "entry_ord", c("entry")),
        "slice.truncations": (index.dropped, "slot", cut),
        "index.files": (index.files, "slot", F.struct("path", "language", "sha256", "source")),
        "index.symbols": (index.symbols, "slot", F.struct("symbol_id", "kind", "name", "qualname", "path", span, "content_hash", "signature", F.nullif("parent", F.lit("")).alias("parent"), "in_slice")),
        "index.edges": (index.edges, "edge_seq", F.struct(c("src").alias("from"), c("dst").alias("to"), "kind", "resolution", "site")),
        "index.references": (index.references, "ref_seq", F.struct("path", span, "symbol_id")),
    }
    if changes is not None:
        found["changes.files"] = (changes[0], "path", F.struct("path", "change", "base_source"))
        found["changes.symbols"] = (changes[1].withColumn("slot", F.struct("symbol_id", "path")), "slot", F.struct("symbol_id", "change"))
    return found


def _listed(df: DataFrame, order: str, entry: Column) -> DataFrame:
    """(v): one row with the rows' entries as an array, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), entry.alias("_v"))))
    return df.agg(F.transform(rows, lambda x: x["_v"]).alias("v"))


def _document(row: DataFrame, tiers: DataFrame, lists: Collection[str], repository: dict[str, str], hops: int, excludes: list[str] | None) -> DataFrame:
    """(json) of a row with stats, file_count and the lists, each in the column of its place."""
    c = F.col
    row = row.crossJoin(_listed(tiers.withColumn("slot", S.language_rank(c("language"))), "slot", F.struct("language", "tier")).withColumnRenamed("v", "tiers"))
    tiers, at = F.map_from_entries("tiers"), lambda place: F.col(f"`{place}`").alias(place.split(".")[1])
    parts = [F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("generated_at"), F.struct(*(F.lit(v).alias(k) for k, v in repository.items())).alias("repository")]
    if "changes.files" in lists:
        parts.append(F.struct(F.lit(repository.get("base_commit")).alias("previous_head_commit"), at("changes.files"), at("changes.symbols")).alias("changes"))
    parts += [
        F.struct(at("slice.entry_points"), F.lit(hops).alias("hop_limit"), "file_count", F.array(*(F.lit(e) for e in excludes or [])).cast("array<string>").alias("excludes"), at("slice.truncations")).alias("slice"),
        F.struct(tiers.alias("resolution"), *(at(f"index.{x}") for x in ("files", "symbols", "edges", "references"))).alias("index"),
        F.struct("stats.*", tiers.alias("resolution")).alias("stats"),
    ]
    return row.select(F.to_json(F.struct(*parts)).alias("json"))


def document(index: Index, repository: dict[str, str], hops: int, excludes: list[str] | None = None, changes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(json): the index as one JSON document, for a slice that the byte budget bounds. Absent values are left out.

    repository: id, root, head_commit and, for reviews, base_commit. changes: (files, symbols) of a review, as
    revisions.review_changes gives them.
    """
    row, lists = index.stats.select(F.struct("*").alias("stats")), _lists(index, changes)
    for place, of in lists.items():
        row = row.crossJoin(_listed(*of).withColumnRenamed("v", place))
    return _document(row.withColumn("file_count", F.size("`index.files`")), index.tiers, lists, repository, hops, excludes)


def parts(index: Index, repository: dict[str, str], hops: int, excludes: list[str] | None = None, changes: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """document() in parts, for slices of any size: under "" the document (json) with empty lists, and under the place of each
    list, as `index.files`, its entries (slot, json), one a row, that stand in order of slot. No row holds more than an entry."""
    row, lists = index.stats.select(F.struct("*").alias("stats")), _lists(index, changes)
    row = row.crossJoin(index.files.agg(F.count("*").cast("int").alias("file_count")))
    row = row.select("*", *(F.array().cast("array<string>").alias(place) for place in lists))
    text = lambda entry: F.regexp_extract(F.to_json(F.array(entry)), r"(?s)^\[(.*)\]$", 1)  # noqa: E731  to_json takes no bare string
    entries = {place: df.select(F.col(order).alias("slot"), text(entry).alias("json")) for place, (df, order, entry) in lists.items()}
    return {"": _document(row, index.tiers, lists, repository, hops, excludes), **entries}

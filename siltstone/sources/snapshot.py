"""Source snapshots: files of a folder, and what each file defines, calls, uses and imports.

A file's order is a value of its row (language, extension, path by components), not a numbering, so no stage needs all
files in one task. Each file is read once into nested facts; relations are explodes of those.
"""

from __future__ import annotations

import gc
import itertools
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import graph as G
from siltstone.sources import tree

# Folders that no scan takes, and extensions by language, both in order.
DEFAULT_EXCLUDES = [".git", ".venv", "venv", "__pycache__", "node_modules", ".tox", ".mypy_cache", ".ruff_cache", "build", "dist", ".eggs", "vendor", ".next", "coverage"]
EXTENSIONS = {"python": ["py"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "go": ["go"]}
PLACE = "start_line int, start_character int, end_line int, end_character int"
SYMBOL = f"symbol_id string, kind string, name string, qualname string, {PLACE}, content_hash string, signature string, parent string"
FACTS = (
    "parsed boolean, "
    f"symbols array<struct<{SYMBOL.replace(' string', ':string').replace(' int', ':int')}>>, "
    + ", ".join(f"{c} array<struct<{x}{PLACE.replace(' int', ':int')}>>" for c, x in {"calls": "enclosing:string, name:string, is_member:boolean, ", "usages": "enclosing:string, name:string, ", "names": "name:string, full_name:string, "}.items())
    + ", targets array<string>"
)


#: The relations in a file's facts.
RELATIONS = ("symbols", "calls", "usages", "names", "targets")


def language_rank(language: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in EXTENSIONS)), language)


def scan(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """(path, content) of the source files under root, apart from those that DEFAULT_EXCLUDES or `excludes` name; folders
    that are excluded are not looked into, and files that cannot be read are passed over."""
    return tree.read(spark, root, [e for x in EXTENSIONS.values() for e in x], DEFAULT_EXCLUDES + (excludes or []))


def files(raw: DataFrame) -> DataFrame:
    """(path, language, module, source, sha256, n_bytes, file_ord) of raw (path, content as bytes or text).

    Bytes that are not UTF-8 become U+FFFD; hashes and sizes are those of the decoded text. Files of no known language go.
    """
    path = F.col("path")
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    package = F.when(stem == "__init__", stem).otherwise(F.regexp_replace(stem, "(^|/)__init__$", ""))
    module = F.when(F.col("language") == "python", F.replace(package, F.lit("/"), F.lit("."))).otherwise(stem)
    extension = F.array_position(F.array(*(F.lit(e) for x in EXTENSIONS.values() for e in x)), F.element_at(F.split(path, r"\."), -1))
    rows = raw.select(path, F.make_valid_utf8(F.coalesce(F.col("content").cast("string"), F.lit(""))).alias("source"), T.language_of(path).alias("language")).filter("language is not null")
    return rows.select(
        "path", "language", module.alias("module"), "source", T.sha256_text(F.col("source")).alias("sha256"), F.octet_length("source").cast("long").alias("n_bytes"),
        F.struct(language_rank(F.col("language")).alias("l"), extension.alias("e"), F.split(path, "/").alias("p")).alias("file_ord"),
    )


def _read(language: str, module: str, source: str, repeats: bool, only: list[str]):
    if language == "python":
        from siltstone.sources.python_facts import PythonFacts

        return PythonFacts(module, source, repeats, only)
    from siltstone.sources.brace_facts import BraceFacts

    return BraceFacts(language, module, source, repeats, only)


#: How an entry of a file's facts becomes the values of its struct, in the order of FACTS.
VALUES = {
    "symbols": lambda s: (s["symbol_id"], s["kind"], s["name"], s["qualname"], *s["span"], s["content_hash"], s["signature"], s["parent"]),
    "calls": lambda c: (c[0], c[1], c[2], *c[3]),
    "usages": lambda u: (u[0], u[1], *u[2]),
    "names": lambda n: (n[1], n[2], *n[0]),
}


def _lists(of: list[list[tuple]], kind: pa.ListType) -> pa.Array:
    """Lists of structs from lists of their values: built by columns, as a dict an entry takes as long as parsing."""
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
    columns = list(zip(*itertools.chain.from_iterable(of), strict=True)) or [()] * len(fields)
    offsets = pa.array(itertools.accumulate(map(len, of), initial=0), pa.int32())
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(offsets, values, type=kind)


def _rows(batches: Iterator[pa.RecordBatch], repeats: bool, only: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    gc.freeze()  # what the libraries hold is not gone through again and again while trees come and go
    kind = {field.name: field.type for field in schema}
    values = {what: VALUES[what] for what in only if what in VALUES}
    for batch in batches:
        parsed, targets, out = [], [], {what: [] for what in values}
        sources = batch.column("source")
        for i, (language, module) in enumerate(zip(batch.column("language").to_pylist(), batch.column("module").to_pylist(), strict=True)):
            try:
                f = _read(language, module, sources[i].as_py(), repeats, only)  # one text at a time
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                f = None
            parsed.append(f is not None and f.whole)
            targets.append(f.targets if f else [])
            for what, value in values.items():
                out[what].append([value(x) for x in getattr(f, what)] if f else [])
        new = {"parsed": pa.array(parsed, pa.bool_()), **{what: _lists(x, kind[what]) for what, x in out.items()}}
        if "targets" in kind:
            new["targets"] = pa.array(targets, kind["targets"])
        yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in schema.names], schema=schema)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to tasks by their path: a table of few splits would keep few cores busy."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "path")


def facts(of: DataFrame, repeats: bool = True, only: Collection[str] = RELATIONS, text: bool = True, dealt: bool = False) -> DataFrame:
    """unwritten_facts, written: relations are explodes that read the columns they need. What is read once needs no writing."""
    return G.written(unwritten_facts(of, repeats, only, text, dealt), "facts")


def unwritten_facts(of: DataFrame, repeats: bool = True, only: Collection[str] = RELATIONS, text: bool = True, dealt: bool = False) -> DataFrame:
    """files with nested facts, one row a file, all from one pass over it; where `only` some relations are asked for, the others
    are no columns. Where a file does not parse whole, parsed is false, and the facts are those of the parts that do. Whatever
    reads this parses the files again.

    Files are dealt to tasks by path first, unless they are `dealt` already: parsing takes far longer than reading. Without
    `text` the sources are no column, and n_lines (long) stands for them: relations need no more.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    if unknown := set(only) - set(RELATIONS):
        raise ValueError(f"no such facts: {sorted(unknown)}")
    keys = of.select("path", "language", "module", "file_ord", "source", "sha256", "n_bytes", *([] if text else [T.line_count(F.col("source")).alias("n_lines")]))
    held = [f for f in _parse_datatype_string(FACTS).fields if f.name == "parsed" or f.name in only]
    schema, asked = StructType([*(f for f in keys.schema.fields if text or f.name != "source"), *held]), [r for r in RELATIONS if r in only]
    arrow = to_arrow_schema(schema)
    return (keys if dealt else spread(keys)).mapInArrow(lambda it: _rows(it, repeats, asked, arrow), schema)


def symbols(of: DataFrame) -> DataFrame:
    """All symbols of facts with (file_ord, sym_ord); each file's module comes first, from line 1 to the line after its last break."""
    c = F.col
    lines = c("n_lines") if "n_lines" in of.columns else T.line_count(c("source"))
    own = F.struct(
        F.concat("language", F.lit(":"), "module").alias("symbol_id"), F.lit("module").alias("kind"), F.element_at(F.split("module", F.when(c("language") == "python", F.lit("[.]")).otherwise(F.lit("/"))), -1).alias("name"), F.lit("").alias("qualname"),
        F.lit(1).alias("start_line"), F.lit(0).alias("start_character"), lines.cast("int").alias("end_line"), F.lit(0).alias("end_character"),
        c("sha256").alias("content_hash"), F.concat(F.lit("module "), "module").alias("signature"), F.lit(None).cast("string").alias("parent"),
    )
    rows = of.select("language", "module", "path", "file_ord", F.posexplode(F.concat(F.array(own), "symbols")).alias("sym_ord", "s"))
    full = F.when(c("s.qualname") == "", c("module")).otherwise(F.concat("module", F.lit("."), "s.qualname"))
    return rows.select("language", "module", "path", "file_ord", "sym_ord", "s.*", full.alias("full_name"))


def listed(of: DataFrame, what: str) -> DataFrame:
    """calls, usages, names or targets of facts as rows with their place `pos` in the file's list."""
    rows = of.select("language", "module", "path", "file_ord", F.posexplode(what).alias("pos", "x"))
    return rows.withColumnRenamed("x", "target") if what == "targets" else rows.select("language", "module", "path", "file_ord", "pos", "x.*")

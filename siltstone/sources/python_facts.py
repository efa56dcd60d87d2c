"""Facts of one Python file: definitions, call sites, usages and imports, from the standard library's syntax tree."""

from __future__ import annotations

import ast
import hashlib
import itertools
import re
from collections.abc import Collection, Iterator
from operator import attrgetter

Span = tuple[int, int, int, int]


def digest(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def signature(text: str) -> str:
    """First line without the punctuation that opens a body."""
    return text.split("\n", 1)[0].rstrip(":{ ").rstrip()


def parts_of(node: ast.AST) -> list[ast.AST]:
    """Children that have a place in the text, in its order; those without one (arguments, generators) are seen through."""

    out: list[ast.AST] = []
    _placed(node, out)
    if len(out) > 1 and type(node) not in IN_ORDER:
        out.sort(key=PLACE)
    return out


PLACE = attrgetter("lineno", "col_offset")
#: Nodes whose fields stand in the text's order.
IN_ORDER = {ast.Module, ast.Expr, ast.Assign, ast.Return, ast.If, ast.While, ast.For, ast.Attribute, ast.Subscript, ast.BinOp, ast.BoolOp, ast.Compare, ast.Tuple, ast.List}
#: Fields that hold names, contexts and operators, which have no place.
UNPLACED = {"ctx", "op", "ops", "id", "attr", "type_comment", "type_ignores"}


class Fields(dict):
    """Of a kind of nodes the fields that can hold others with a place."""

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = out = tuple(f for f in kind._fields if f not in UNPLACED)
        return out


FIELDS = Fields()


def _placed(node: ast.AST, out: list[ast.AST]) -> None:
    for field in FIELDS[type(node)]:
        held = getattr(node, field, None)
        for c in held if type(held) is list else (held,):
            if isinstance(c, ast.AST):
                if hasattr(c, "lineno"):
                    out.append(c)
                elif c._fields:
                    _placed(c, out)


def _moved(node: ast.AST, lines: int) -> None:
    """node and all below it, that many lines on."""
    if hasattr(node, "lineno"):
        node.lineno += lines
        node.end_lineno += lines
    elif not node._fields:
        return  # one object stands for all contexts and operators of a kind
    for field in node._fields:
        held = getattr(node, field, None)
        for c in held if isinstance(held, list) else (held,):
            if isinstance(c, ast.AST):
                _moved(c, lines)


#: Words that go on with the statement before them.
GOES_ON = re.compile(r"[ \t\f]*(?:else|elif|except|finally)\b")
NO_START = re.compile(r"\s*(?:[#)\]}]|$)")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t\f"))


def _statements(lines: list[str], a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
    """(indent, ranges of lines): a statement begins on a line with the block's indent that closes nothing and goes on with
    nothing; decorators belong to what follows them."""
    real = [i for i in range(a, b) if not NO_START.match(lines[i])]
    if not real:
        return 0, []
    indent = _indent(lines[real[0]])
    starts, decorated = [], False
    for i in real:
        if _indent(lines[i]) == indent and not GOES_ON.match(lines[i]):
            if not decorated:
                starts.append(i)
            decorated = lines[i].lstrip().startswith("@")
    return indent, list(zip(starts, [*starts[1:], b], strict=True))


def _tree(lines: list[str], a: int, b: int, indent: int) -> list[ast.stmt]:
    """The statements of lines that stand at an indent, in their places; raises SyntaxError."""
    above = 1 if indent else 0
    tree = ast.parse("if 1:\n" * above + "\n".join(lines[a:b]))
    if a != above:
        _moved(tree, a - above)
    return tree.body[0].body if above else tree.body


def _header(lines: list[str], indent: int, most: int = 20) -> tuple[list[ast.stmt], int]:
    """(the statement that lines begin with, with `pass` for a body, the first line after its header); nothing where none of
    the first lines that end in a colon ends a header."""
    ends = (i for i, line in enumerate(lines) if line.split("#")[0].rstrip().endswith(":"))
    for i in itertools.islice(ends, most):
        try:
            return _tree([*lines[:i], f"{lines[i].split('#')[0].rstrip()} pass"], 0, i + 1, indent), i + 1
        except SyntaxError:
            continue
    return [], len(lines)


def _sound(lines: list[str], a: int, b: int) -> list[ast.stmt]:
    """What can be read of a block. Statements are read one by one, and of one with an error its body's in the same way, so
    each line is read about as often as it is deep. A statement of which nothing can be read is `pass`; with a header that cannot be
    read its body goes."""
    indent, found = _statements(lines, a, b)
    out: list[ast.stmt] = []
    for s, e in found:
        try:
            out += _tree(lines, s, e, indent)
            continue
        except SyntaxError:
            pass
        clauses = [s, *(i for i in range(s + 1, e) if _indent(lines[i]) == indent and GOES_ON.match(lines[i])), e]
        for n, (c, d) in enumerate(zip(clauses, clauses[1:], strict=False)):
            held = lines[c:d]
            if n:  # a later clause is read as a condition of its own, in which its words keep their columns
                held[0] = re.sub(r"\b(?:elif|else|except|finally)\b.*", lambda m: "  if" + m[0][4:] if m[0].startswith("elif") else "  if 1:", held[0], count=1)
            head, first = _header(held, indent or 2 * (n > 0))
            if not head:
                out += [] if n else [ast.Pass(lineno=c + 1, col_offset=indent, end_lineno=c + 1, end_col_offset=indent + 4)]
                continue
            for x in head:
                _moved(x, c)
            inner = _sound(lines, c + first, d)
            node = head[-1]
            if inner and hasattr(node, "body"):
                node.body, node.end_lineno, node.end_col_offset = inner, inner[-1].end_lineno, inner[-1].end_col_offset
            out += head
    return out


def parsed(text: str) -> tuple[ast.Module, bool]:
    """The syntax tree and whether it is that of the whole text. Of a text with an error what can be read is kept, in its place."""
    try:
        return ast.parse(text), True
    except SyntaxError:
        lines = text.split("\n")
        return ast.Module(_sound(lines, 0, len(lines)), []), False


DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
#: Of nodes that hold statements, the lists of these in the text's order.
BLOCKS = {
    **dict.fromkeys((ast.If, ast.For, ast.AsyncFor, ast.While), ("body", "orelse")),
    **dict.fromkeys((ast.With, ast.AsyncWith, ast.ExceptHandler, ast.match_case), ("body",)),
    **dict.fromkeys((ast.Try, ast.TryStar), ("body", "handlers", "orelse", "finalbody")),
    ast.Match: ("cases",),
}
#: Facts that statements show without their expressions.
OUTLINE = {"symbols", "targets", "names"}


class PythonFacts:
    """Collects one file's facts. Lines count from 1; columns are UTF-8 bytes from 0. Of `only` some facts, all of these are
    collected; others may be missing.

    With `repeats`, the receiver of a member call is looked through once for the call and once more as its part, so that
    call sites in it come 2**depth times, as counts of unresolved calls expect; without, each comes once.
    """

    def __init__(self, module: str, source: str, repeats: bool = True, only: Collection[str] | None = None):
        self.module, self.repeats, self.raw = module, repeats, source.encode()
        self.begins = [0]
        for line in self.raw.split(b"\n"):
            self.begins.append(self.begins[-1] + len(line) + 1)
        self.symbols: list[dict] = []
        self.calls: list[tuple] = []
        self.usages: list[tuple] = []
        self.targets: list[str] = []
        self.names: list[tuple] = []
        root = f"python:{module}"
        tree, self.whole = parsed(self.raw.decode())
        if only is not None and OUTLINE.issuperset(only):
            self._outline(tree.body, (), root)
            return
        for node in parts_of(tree):
            self._see(node, (), root)

    def _outline(self, nodes: list[ast.AST], scope: tuple, owner: str) -> None:
        """Definitions and imports among statements and below them; no expression holds any."""
        for node in nodes:
            kind = type(node)
            if kind in DEFINITIONS:
                me, inner = self._symbol(node, scope, owner)
                self._outline(node.body, inner, me)
            elif kind is ast.Import:
                self.targets += [a.name for a in node.names]
            elif kind is ast.ImportFrom:
                self._import_from(node)
            else:
                for field in BLOCKS.get(kind, ()):
                    self._outline(getattr(node, field), scope, owner)

    def _text(self, s: Span) -> str:
        return self.raw[self.begins[s[0] - 1] + s[1] : self.begins[s[2] - 1] + s[3]].decode()

    @staticmethod
    def _span(node: ast.AST) -> Span:
        return node.lineno, node.col_offset, node.end_lineno, node.end_col_offset

    def _name_span(self, node: ast.Attribute) -> Span:
        """A member's own name stands at the end of the expression."""
        return node.end_lineno, node.end_col_offset - len(node.attr.encode()), node.end_lineno, node.end_col_offset

    def _see(self, node: ast.AST, scope: tuple, owner: str) -> None:
        kind = type(node)  # the most frequent ones come first
        if kind is ast.Name:
            self.usages.append((owner, node.id, self._span(node)))
        elif kind is ast.Constant:
            pass
        elif kind is ast.Call:
            self._call(node.func, scope, owner)
            if not self.repeats and isinstance(node.func, ast.Attribute):
                self.usages.append((owner, node.func.attr, self._name_span(node.func)))
            for c in parts_of(node):
                if self.repeats or c is not node.func or not isinstance(c, ast.Attribute):
                    self._see(c, scope, owner)
        elif kind is ast.Attribute:
            self.usages.append((owner, node.attr, self._name_span(node)))
            self._see(node.value, scope, owner)
        elif kind is ast.arg or kind is ast.keyword:
            if node.arg:
                at = node.lineno, node.col_offset
                self.usages.append((owner, node.arg, (*at, at[0], at[1] + len(node.arg.encode()))))
            self._inside(node, scope, owner)
        elif kind in DEFINITIONS:
            self._define(node, scope, owner)
        elif kind is ast.Import:
            self.targets += [a.name for a in node.names]
        elif kind is ast.ImportFrom:
            self._import_from(node)
        else:
            self._inside(node, scope, owner)

    def _inside(self, node: ast.AST, scope: tuple, owner: str) -> None:
        for c in parts_of(node):
            self._see(c, scope, owner)

    def _call(self, callee: ast.AST, scope: tuple, owner: str) -> None:
        if isinstance(callee, ast.Name):
            self.calls.append((owner, callee.id, False, self._span(callee)))
        elif isinstance(callee, ast.Attribute):
            self._see(callee.value, (), owner)
            self.calls.append((owner, callee.attr, True, self._name_span(callee)))

    def _symbol(self, node, scope: tuple, owner: str) -> tuple[str, tuple]:
        """A definition's id and the scope within."""
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if scope and scope[-1][0] == "class" else "function"
        qualname = ".".join([*(n for _, n in scope), node.name])
        first = min((d.lineno for d in node.decorator_list), default=node.lineno)
        span = first, node.col_offset, node.end_lineno, node.end_col_offset
        text, me = self._text(span), f"python:{self.module}:{qualname}"
        self.symbols.append({"symbol_id": me, "kind": kind, "name": node.name, "qualname": qualname, "span": span, "content_hash": digest(text), "signature": signature(text), "parent": owner})
        return me, (*scope, ("class" if kind == "class" else "function", node.name))

    def _define(self, node, scope: tuple, owner: str) -> None:
        me, inner = self._symbol(node, scope, owner)
        for c in parts_of(node):
            if c not in node.decorator_list:
                self._see(c, inner, me)
        for d in node.decorator_list:
            if isinstance(d, ast.Name | ast.Attribute):
                self._call(d, scope, me)
            elif isinstance(d, ast.Call):
                self._see(d, scope, me)
            else:
                self._inside(d, scope, me)

    def _import_from(self, node: ast.ImportFrom) -> None:
        if node.module == "__future__":
            return
        base = node.module or ""
        if node.level:
            above = self.module.split(".")
            above = above[: len(above) - node.level] if node.level <= len(above) else []
            base = ".".join([*above, *([base] if base else [])])
        self.targets.append(base)
        for a in node.names:
            if a.name != "*":
                span = a.lineno, a.col_offset, a.lineno, a.col_offset + len(a.name.encode())
                self.names.append((span, a.name, f"{base}.{a.name}" if base else a.name))

"""Facts of one TypeScript, JavaScript or Go file, from its tokens and brackets.

A file is cut into tokens, brackets are matched, and definitions and postfix chains (`a.b(c).d`) are read from the token
list. Text that is not valid in its language gives what its tokens still show; unbalanced brackets end at the file's end.
Columns are UTF-8 bytes.
"""

from __future__ import annotations

import bisect
import posixpath
import re
from collections.abc import Collection
from typing import NamedTuple

from siltstone.sources.python_facts import digest, signature

#: Gaps, then a token or the text's end.
TOKEN = re.compile(
    rb"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*+(?:(?P<name>#?[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<number>\.?\d[\w.]*)"
    rb"|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<mark>=>|\?\.(?!\d)|\.\.\.|:=|[=!]==?|&&|\|\||\?\?|.)|(?P<end>\Z))",
    re.S,
)
REGEX = re.compile(rb"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Groups of TOKEN by their numbers, and marks that are tokens whatever stands about them.
KINDS = {i: name for name, i in TOKEN.groupindex.items()}
MARK, END = TOKEN.groupindex["mark"], TOKEN.groupindex["end"]
PLAIN = set(b"( ) [ ] . , ; : = => + - * < > ! ? & | && || == === != !== ?. ?? ... :=".split())
CLOSE = {b"(": b")", b"[": b"]", b"{": b"}", b"${": b"}"}
CLOSERS = set(CLOSE.values())
OPERATORS = set(b"= == === != !== => , : ? ( [ { ${ && || ?? + - * / % & | ^ ~ ! < > . ?. ... :=".split())
WORDS = set(b"return typeof case in of delete void throw new await yield instanceof else do".split())
RESERVED = WORDS | set(b"if for while switch catch with function class this super null true false undefined import export default const let var try finally break continue interface enum type extends implements async static get set".split())
GO_RESERVED = set(b"break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false".split())
MODIFIERS = set(b"public private protected static async get set readonly abstract override *".split())
TYPED = (b"class", b"interface", b"enum")


#: After these a slash begins a regular expression, and a new line goes on.
OPEN_ENDED = OPERATORS | WORDS
#: Words that begin a script's statements, and a Go file's.
SCRIPT_STARTS = set(b"import export default declare async function class abstract interface enum const type let var".split())
GO_STARTS = set(b"import package func type".split())
BEFORE_REGEX = OPEN_ENDED | {b";", b"}"}
#: What an expression's first name can be followed by, but for a template, if more belongs to it.
GOES_ON = set(b". ?. ( [ ! <".split())
STAYS = OPERATORS - {b"(", b"[", b"{", b"!"}


class Words(dict):
    """The text of each token by its place; empty where there is none."""

    def __missing__(self, i: int) -> bytes:
        return b""


class Token(NamedTuple):
    kind: str
    text: bytes
    start: int
    end: int


def tokens_of(raw: bytes, go: bool) -> list[Token]:
    """Tokens without gaps. Template text is one string token a piece; what stands in ${} is tokens in between."""
    out: list[Token] = []
    stack: list[bytes] = []
    at, add, new = 0, out.append, tuple.__new__  # which makes no call in Python

    def template(a: int) -> int:
        """From a, within a template, to past its end or past the next ${."""
        b = a
        while b < len(raw):
            if raw[b : b + 1] == b"\\":
                b += 2
            elif raw[b : b + 1] == b"`":
                out.append(Token("string", raw[a:b], a, b + 1))
                return b + 1
            elif raw[b : b + 2] == b"${" and not go:
                out.append(Token("string", raw[a:b], a, b))
                out.append(Token("mark", b"${", b, b + 2))
                stack.append(b"${")
                return b + 2
            else:
                b += 1
        return len(raw)

    while at < len(raw):
        for m in TOKEN.finditer(raw, at):
            group = m.lastindex
            if group == END:
                return out
            text = m[group]
            begin, at = m.span(group)
            if group != MARK:
                add(new(Token, (KINDS[group], text, begin, at)))
                continue
            if text in PLAIN:
                add(new(Token, ("mark", text, begin, at)))
                continue
            if text == b"`":
                if go:
                    end = raw.find(b"`", at)
                    at = len(raw) if end < 0 else end + 1
                    out.append(Token("string", raw[begin:at], begin, at))
                else:
                    at = template(at)
                break  # tokens go on from there
            if text == b"/" and not go and (not out or out[-1].text in BEFORE_REGEX) and (x := REGEX.match(raw, begin)):
                at = x.end()
                out.append(Token("string", x[0], begin, at))
                break
            out.append(Token("mark", text, begin, at))
            if text == b"{":
                stack.append(text)
            elif text == b"}" and stack and stack.pop() == b"${":
                at = template(at)
                break
    return out


class BraceFacts:
    """As PythonFacts: symbols, calls, usages, targets and names of one file. Tokens are read whatever their order, so a
    file always counts as read whole. Of `only` some facts, the others may be missing."""

    whole = True

    def __init__(self, language: str, module: str, source: str, repeats: bool = True, only: Collection[str] | None = None):
        self.used = only is None or "usages" in only
        self.defined = only is None or "symbols" in only
        imports = only is not None and {"targets", "names"}.issuperset(only)
        self.language, self.module, self.repeats, self.raw = language, module, repeats, source.encode()
        self.go = language == "go"
        self.reserved = GO_RESERVED if self.go else RESERVED
        self.breaks = [-1, *(m.start() for m in re.finditer(rb"\n", self.raw))]
        self.symbols: list[dict] = []
        self.calls: list[tuple] = []
        self.usages: list[tuple] = []
        self.targets: list[str] = []
        self.names: list[tuple] = []
        self.t = tokens_of(self.raw, self.go)
        texts = [t[1] for t in self.t]
        self._text = Words(enumerate(texts)).__getitem__
        #: Whether a statement or an expression can begin at a token.
        self.opens = [kind == "name" or kind == "string" or text == b"(" or text == b"*" for kind, text, _, _ in self.t]
        #: Past the last token that has to be walked to: where imports alone are asked for, that of the last one.
        self.last = len(texts) if not imports else len(texts) - texts[::-1].index(b"import") if b"import" in texts else 0
        self.within: list[int] = []  # of each token, the innermost bracket that is open before it
        self.classes: set[int] = set()  # the braces that open class bodies
        self.pair = self._pairs()
        self._walk(0, len(self.t), (), f"{language}:{module}")

    def _pairs(self) -> dict[int, int]:
        pair, open_, top, within = {}, [], -1, self.within.append
        for i, (kind, text, _, _) in enumerate(self.t):
            within(top)
            if kind != "mark":
                continue
            if text in CLOSE:
                open_.append(i)
                top = i
            elif text in CLOSERS:
                while open_ and CLOSE[self.t[open_[-1]].text] != text:
                    pair[open_.pop()] = i
                if open_:
                    pair[open_.pop()] = i
                top = open_[-1] if open_ else -1
        pair.update((i, len(self.t)) for i in open_)
        return pair

    # places

    def _place(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_left(self.breaks, offset)
        return line, offset - self.breaks[line - 1] - 1

    def _span(self, a: int, b: int) -> tuple[int, int, int, int]:
        """From token a to the end of token b."""
        return (*self._place(self.t[a].start), *self._place(self.t[min(b, len(self.t) - 1)].end))

    def _named(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name" and self.t[i].text not in self.reserved

    def _new_line(self, i: int) -> bool:
        return i == 0 or self.raw.find(b"\n", self.t[i - 1].end, self.t[i].start) >= 0

    def _begins(self, i: int) -> bool:
        """Whether a statement can begin at token i."""
        before = self._text(i - 1)
        if i == 0 or before in (b";", b"{", b"}", b"export", b"default", b"declare"):
            return True
        return before not in OPEN_ENDED and self._new_line(i)

    def _after(self, i: int) -> int:
        """Past the bracket that opens at i."""
        return min(self.pair.get(i, i) + 1, len(self.t))

    def _statement_end(self, i: int, stop: int) -> int:
        """The last token of the statement that holds token i: a semicolon, or where a new line begins another one."""
        k = i
        while k < stop:
            if self._text(k) == b";":
                return k
            if self._text(k) in CLOSE:
                k = self._after(k)
            else:
                k += 1
            if k < stop and self._text(k) not in STAYS and self._text(k - 1) not in OPEN_ENDED and self._new_line(k):
                return k - 1
        return stop - 1

    def _body_after(self, k: int, stop: int) -> int | None:
        """The brace that opens the body behind parameters that end before k, past a result type; None where there is none."""
        while k < stop:
            text = self._text(k)
            if text == b"{":
                if not self.go and self._text(k - 1) in (b":", b"|", b"&", b"=>", b","):
                    k = self._after(k)
                    continue
                if self.go and self._text(k - 1) in (b"interface", b"struct"):
                    k = self._after(k)
                    continue
                return k
            if text in (b";", b"}", b")", b"]", b"="):
                return None
            if k > 0 and self._new_line(k) and text not in OPERATORS and self._text(k - 1) not in OPERATORS:
                return None
            k = self._after(k) if text in (b"(", b"[") else k + 1
        return None

    def _past_types(self, k: int) -> int:
        """Past type parameters <...> that open at k; k where they do not close."""
        depth, i = 0, k
        while i < len(self.t) and i < k + 200:
            text = self._text(i)
            depth += (text == b"<") - (text == b">")
            if depth == 0:
                return i + 1
            if text in (b";", b")", b"&&", b"||"):
                return k
            i = self._after(i) if text in CLOSE else i + 1
        return k

    # walking

    def _mention(self, i: int, stop: int, owner: str) -> None:
        """Names in types are usages; signatures there are not calls."""
        if self.used:
            self.usages += [(owner, self.t[k].text.decode(), self._span(k, k)) for k in range(i, min(stop, len(self.t))) if self._named(k)]

    def _walk(self, i: int, stop: int, scope: tuple, owner: str) -> None:
        step, opens, last = self._go_statement if self.go else self._script_statement, self.opens, min(stop, self.last)
        while i < last:
            if not opens[i]:
                i += 1
                continue
            if (k := step(i, stop, scope, owner)) is None:
                k = self._expression(i, stop, scope, owner)
            i = k if k > i else i + 1

    def _define(self, kind: str, name: int, a: int, b: int, scope: tuple, owner: str, extra: list[str] | None = None) -> tuple[str, tuple]:
        word = self.t[name].text.decode()
        if kind == "function" and scope and scope[-1][0] == "class":
            kind = "method"
        qualname = ".".join([*(n for _, n in scope), *(extra or []), word])
        if not self.defined:
            return f"{self.language}:{self.module}:{qualname}", (*scope, ("class" if kind == "class" else "function", word))
        text = self.raw[self.t[a].start : self.t[min(b, len(self.t) - 1)].end].decode("utf-8", "replace")
        me = f"{self.language}:{self.module}:{qualname}"
        self.symbols.append({"symbol_id": me, "kind": kind, "name": word, "qualname": qualname, "span": self._span(a, b), "content_hash": digest(text), "signature": signature(text), "parent": owner})
        return me, (*scope, ("class" if kind == "class" else "function", word))

    def _script_statement(self, i: int, stop: int, scope: tuple, owner: str) -> int | None:
        text, before = self._text(i), self._text(i - 1)
        if before in (b".", b"?."):
            return None
        if text in SCRIPT_STARTS and (k := self._script_start(text, i, stop, scope, owner)) is not None:
            return k
        if text == b"*" or (self.t[i].kind == "name" and (text in MODIFIERS or (self._text(i + 1) in (b"(", b"<") and text not in self.reserved))):
            return self._method(i, stop, scope, owner)
        return None

    def _script_start(self, text: bytes, i: int, stop: int, scope: tuple, owner: str) -> int | None:
        if text == b"import" and self._begins(i) and self._text(i + 1) not in (b"(", b"."):
            return self._script_import(i, stop)
        if text in (b"export", b"default", b"declare"):
            return i + 1
        if text in (b"async", b"function") and self._begins(i):
            f = i + (text == b"async")
            n = f + 1 + (self._text(f + 1) == b"*")
            if self._text(f) == b"function" and self._named(n):
                k = self._past_types(n + 1) if self._text(n + 1) == b"<" else n + 1
                body = self._body_after(self._after(k), stop)
                if body is None:
                    return k
                me, inner = self._define("function", n, i, self.pair[body], scope, owner)
                self._walk(k, self._after(body), inner, me)
                return self._after(body)
        if text in (b"class", b"abstract", b"interface", b"enum", b"const") and self._begins(i):
            w = i + (text == b"abstract" or (text == b"const" and self._text(i + 1) == b"enum"))
            if self._text(w) in TYPED and self._named(w + 1):
                body = next((k for k in range(w + 2, stop) if self._text(k) in (b"{", b";")), stop)
                if self._text(body) == b"{":
                    me, inner = self._define("class", w + 1, i, self.pair[body], scope, owner)
                    self.classes.add(body)
                    if self._text(w) == b"interface":
                        self._mention(body + 1, self.pair[body], me)
                    else:
                        self._walk(body + 1, self.pair[body], inner, me)
                    return self._after(body)
        if text == b"type" and self._begins(i) and self._named(i + 1) and self._text(i + 2) in (b"=", b"<"):
            end = self._statement_end(i, stop)
            self._define("class", i + 1, i, end, scope, owner)
            return end + 1
        if text in (b"const", b"let", b"var"):
            return self._declaration(i, stop, scope, owner)
        return None

    def _method(self, i: int, stop: int, scope: tuple, owner: str) -> int | None:
        inside = self.within[i] in self.classes
        before = self._text(i - 1)
        if before not in (b"{", b",", b"}", b";", b"") and not (inside and before == b")") and not self._new_line(i):
            return None
        n = i
        while self._text(n) in MODIFIERS and self._text(n + 1) not in (b"(", b"=", b":", b";", b",", b"}"):
            n += 1
        if n >= stop or self.t[n].kind != "name" or (self._text(n) in self.reserved and self._text(n) not in MODIFIERS):
            return None
        k = n + 1
        if self._text(k) == b"<":
            k = self._past_types(k)
        if self._text(k) != b"(":
            return None
        after = self._after(k)
        body = after if self._text(after) == b"{" else self._body_after(after, stop) if self._text(after) == b":" else None
        if body is None:  # in a class: a signature without a body
            return self._statement_end(after - 1, stop) + 1 if inside and before != b"," else None
        me, inner = self._define("method", n, i, self.pair[body], scope, owner)
        self._walk(k, self._after(body), inner, me)
        return self._after(body)

    def _is_function(self, k: int, stop: int) -> bool:
        k += self._text(k) == b"async"
        if self._text(k) == b"function":
            return True
        if self._text(k) == b"<":
            k = self._past_types(k)
        if self._named(k) and self._text(k + 1) == b"=>":
            return True
        if self._text(k) != b"(":
            return False
        k = self._after(k)
        if self._text(k) == b":":
            while k < stop and self._text(k) not in (b"=>", b";", b"="):
                k = self._after(k) if self._text(k) in CLOSE else k + 1
        return self._text(k) == b"=>"

    def _declaration(self, i: int, stop: int, scope: tuple, owner: str) -> int:
        end = self._statement_end(i, stop)
        last, k = end + 1, i + 1
        while k < last:
            name, v = k, k
            while v < last and self._text(v) not in (b"=", b",", b";", b"of", b"in"):
                v = self._after(v) if self._text(v) in CLOSE else v + 1
            if self._text(v) != b"=":
                k = v + 1
                if self._text(v) in (b"of", b"in"):
                    return k
                continue
            e = v + 1
            while e < last and self._text(e) not in (b",", b";"):
                e = self._after(e) if self._text(e) in CLOSE else e + 1
            if self._is_function(v + 1, last) and self._named(name):
                me, inner = self._define("function", name, i, end, scope, owner)
                self._walk(v + 1, e, inner, me)
            else:
                self._walk(v + 1, e, scope, owner)
            k = e + 1
        return last

    def _script_import(self, i: int, stop: int) -> int:
        k = i + 1
        while k < stop and self.t[k].kind != "string" and self._text(k) != b";":
            k += 1
        if k >= stop or self.t[k].kind != "string":
            return k
        target = self.t[k].text.strip(b"'\"`").decode("utf-8", "replace")
        if target.startswith("."):
            path = posixpath.normpath(posixpath.join("/", posixpath.dirname(self.module), target)).strip("/")
            known = (".ts", ".tsx") if self.language == "typescript" else (".js", ".jsx", ".mjs", ".cjs")
            stem, extension = posixpath.splitext(path)
            path = stem if extension in known else path
            self.targets.append(path)
            for a in range(i + 1, k):
                if self._text(a) == b"{":
                    for n in range(a + 1, min(self.pair[a], k)):
                        first = self._text(n - 1) in (b"{", b",") or (self._text(n - 1) == b"type" and self._text(n - 2) in (b"{", b","))
                        if first and self.t[n].kind == "name" and not (self._text(n) == b"type" and self.t[n + 1].kind == "name" and self._text(n + 1) != b"as"):
                            word = self.t[n].text.decode()
                            self.names.append((self._span(n, n), word, f"{path}.{word}"))
        return k + 1

    def _go_statement(self, i: int, stop: int, scope: tuple, owner: str) -> int | None:
        text = self._text(i)
        if text not in GO_STARTS:
            return None
        if text == b"import" and not scope:
            end = self._after(i + 1) if self._text(i + 1) == b"(" else i + 1 + next((k for k in range(1, 4) if i + k < stop and self.t[i + k].kind == "string"), 1)
            self.targets += [self.t[k].text.strip(b'"`').decode("utf-8", "replace") for k in range(i + 1, min(end, stop)) if self.t[k].kind == "string"]
            return end
        if text == b"package":
            return i + 2
        if text == b"func" and (self._named(i + 1) or (not scope and self._text(i + 1) == b"(")):
            receiver, n = None, i + 1
            if self._text(n) == b"(":
                n = self._after(n)
                inside = self.raw[self.t[i + 1].end : self.t[min(n, len(self.t)) - 1].start].decode("utf-8", "replace").strip()
                receiver = re.sub(r"^\w+\s+(?=[*\w])", "", inside).lstrip("*").strip()
            if not self._named(n):
                return None
            k = self._after(n + 1) if self._text(n + 1) == b"[" else n + 1
            body = self._body_after(self._after(k), stop)
            if body is None:
                return k
            me, inner = self._define("function" if receiver is None else "method", n, i, self.pair[body], scope, owner, [receiver] if receiver else None)
            self._walk(k, self._after(body), inner, me)
            return self._after(body)
        if text == b"type" and (self._named(i + 1) or self._text(i + 1) == b"("):
            group = self._text(i + 1) == b"("
            end = self.pair[i + 1] if group else self._statement_end(i + 1, stop)
            k = i + 1 + group
            while k < end + (not group):
                e = self._statement_end(k, end if group else end + 1)
                if self._named(k) and self._text(k + 1) != b"=":
                    me, _ = self._define("class", k, i, end, scope, owner)
                    self._mention(k + 1, e + 1, me)
                k = max(e, k) + 1
            return end + 1
        return None

    # expressions: a chain is its first part and what follows it; its reading mirrors a tree of calls and members

    def _expression(self, i: int, stop: int, scope: tuple, owner: str) -> int:
        text = self._text(i)
        make = text == b"new" and not self.go
        if not make and self.t[i].kind == "name" and self._text(i + 1) not in GOES_ON and (i + 1 >= stop or self.t[i + 1].kind != "string"):
            if self.used and text not in self.reserved and self._text(i - 1) not in (b".", b"?."):
                self.usages.append((owner, text.decode(), self._span(i, i)))
            return i + 1
        a = i + make
        text = self._text(a)
        starts = self._named(a) or text in (b"this", b"super") or text == b"(" or (a < stop and self.t[a].kind == "string")
        if a >= stop or not starts or (a and self._text(a - 1) in (b".", b"?.")):
            return i + 1
        parts: list[tuple[str, int, int]] = [("group", a, self._after(a)) if text == b"(" else ("name", a, a + 1) if self._named(a) else ("other", a, a + 1)]
        k, made = parts[0][2], False
        while k < stop:
            text = self._text(k)
            if text in (b".", b"?.") and k + 1 < stop and self.t[k + 1].kind == "name":
                parts.append(("member", k + 1, k + 2))
                k += 2
            elif text == b"?." and self._text(k + 1) in (b"(", b"["):
                k += 1
            elif text in (b"(", b"[") and not (self.go and self._new_line(k)):
                kind = "call" if text == b"(" else "index"
                if kind == "call" and make and not made:
                    kind, made = "new", True
                parts.append((kind, k, self._after(k)))
                k = self._after(k)
            elif text == b"." and self._text(k + 1) == b"(":  # a type assertion
                parts.append(("index", k + 1, self._after(k + 1)))
                k = self._after(k + 1)
            elif text == b"!" and not self.go and self._text(k + 1) in (b".", b"(", b"["):
                k += 1
            elif text == b"<" and not self.go and (e := self._past_types(k)) > k and self._text(e) == b"(":
                k = e
            elif self.t[k].kind == "string" and self.raw[self.t[k].start - 1 : self.t[k].start] == b"`" and parts[-1][0] in ("name", "member"):
                parts.append(("call", k, k + 1))
                k += 1
            else:
                break
        if make and not made:
            parts.append(("new", k, k))
        self._read(parts, len(parts), scope, owner)
        return k

    def _read(self, parts: list, n: int, scope: tuple, owner: str) -> None:
        """The chain's first n parts."""
        kind, a, b = parts[n - 1]
        if kind == "name" or kind == "member":
            if self.used:
                self.usages.append((owner, self.t[a].text.decode(), self._span(a, a)))
            if kind == "member":
                self._read(parts, n - 1, scope, owner)
        elif kind in ("call", "new"):
            callee = parts[n - 2]
            if callee[0] == "member" and self.repeats:
                self._read(parts, n - 2, (), owner)
            elif callee[0] == "member":
                self._read(parts, n - 1, scope, owner)
            if callee[0] in ("name", "member"):
                c = callee[1]
                self.calls.append((owner, self.t[c].text.decode(), callee[0] == "member", self._span(c, c)))
            if self.repeats or callee[0] != "member":
                self._read(parts, n - 1, scope, owner)
            self._walk(a + 1, b - 1, scope, owner)
        elif kind == "index":
            self._read(parts, n - 1, scope, owner)
            self._walk(a + 1, b - 1, scope, owner)
        elif kind == "group":
            self._walk(a + 1, b - 1, scope, owner)

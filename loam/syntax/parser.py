"""Nodes of TypeScript with JSX that chunkers and extractors look at: declarations, functions, imports, interfaces, tags.

Statements and declarations are parsed; expressions are only walked for functions and declarations inside; types are
skipped. A node's `pos` has the leading white space and comments, its `start` does not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from loam.syntax.lexer import Lexer, SyntaxProblem, Token


@dataclass
class Node:
    kind: str
    name: str | None
    pos: int
    start: int
    end: int
    extra: dict = field(default_factory=dict)


_ENDS_VALUE = ("word", "number", "string", "regex", "close")
_GOES_ON = frozenset("as in of instanceof satisfies".split())
_MODIFIERS = frozenset("export default declare abstract async public private protected static readonly override".split())
_DOC = re.compile(r"/\*\*(.*?)\*/", re.S)


def doc_text(trivia: str) -> str | None:
    """The last documentation comment of some trivia, without stars, on one line."""
    found = _DOC.findall(trivia)
    if not found:
        return None
    lines = (re.sub(r"^\s*\*?", "", line).strip() for line in found[-1].splitlines())
    return " ".join(line for line in lines if line and not line.startswith("@")) or None


class Parser:
    def __init__(self, text: str, jsx: bool = True):
        lexer = Lexer(text, jsx)
        self.text, self.t, self.nodes = text, lexer.tokens, []
        self._statements(0, len(self.t))
        for tag in lexer.tags:
            self.nodes.append(Node("JsxSelfClosing" if tag.closed else "JsxOpening", tag.name, tag.start, tag.start, tag.end))
        # Pre-order: outer nodes before inner ones, and by place.
        self.nodes.sort(key=lambda n: (n.start, -n.end, n.kind != "VariableStatement"))

    # ------------------------------------------------------------ helpers

    def _is(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].text in texts and self.t[i].kind not in ("string",)

    def _opens(self, i: int, text: str, end: int) -> bool:
        """Whether token i, ahead of `end`, is the opening bracket `text`; only then its pair lies ahead."""
        return i < end and self.t[i].kind == "open" and self.t[i].text == text

    def _ahead(self, before: int, i: int) -> int:
        """i, which has to be beyond `before`: every loop over tokens moves on, or the text can't be parsed."""
        if i <= before:
            raise SyntaxProblem(f"no way on after offset {self.t[before].start}")
        return i

    def _end_of(self, i: int) -> int:
        """Offset where token i - 1 ends."""
        return self.t[i - 1].end

    def _add(self, kind: str, name: str | None, first: int, last: int, **extra) -> None:
        """A node of tokens first..last - 1; a text has no more than a few nodes a token."""
        if len(self.nodes) > 4 * len(self.t):
            raise SyntaxProblem("more nodes than tokens can make")
        self.nodes.append(Node(kind, name, self.t[first].full, self.t[first].start, self._end_of(last), extra))

    def _ends_statement(self, i: int) -> bool:
        """Whether a statement ends ahead of token i because a line does."""
        a, b = self.t[i - 1], self.t[i]
        if not b.newline or a.kind not in _ENDS_VALUE or a.text in ("return",) and a.kind == "word":
            return b.newline and a.kind == "word" and a.text == "return"
        if b.kind == "word":
            return b.text not in _GOES_ON
        return b.kind in ("number", "string", "regex") or b.text in ("{", "++", "--") or b.text == "<" and b.kind == "open"

    # ------------------------------------------------------------ types

    def _type(self, i: int, end: int) -> int:
        """Index after the type that begins at i."""
        while True:
            while self._is(i, "|", "&", "keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract") and i < end:
                i += 1
            if i >= end:
                return i
            t = self.t[i]
            if t.text == "<":  # type parameters of a function type
                i = self._angles(i, end)
                t = self.t[i]
            if t.kind == "open":
                i = t.pair + 1
                if t.text == "(" and self._is(i, "=>"):
                    i = self._type(i + 1, end)
            elif t.text == "-" or t.kind in ("word", "number", "string"):
                i += 1 + (t.text == "-")
                while self._is(i, ".") and i + 1 < end:
                    i += 2
                if self._is(i, "<") and i < end:
                    i = self._angles(i, end)
                if t.kind == "word" and self._is(i, "is") and not self.t[i].newline:
                    i = self._type(i + 1, end)
            else:
                return i
            while i < end and self.t[i].text == "[" and self.t[i].kind == "open" and not self.t[i].newline:
                i = self.t[i].pair + 1
            if i < end and self._is(i, "extends") and not self.t[i].newline:
                i = self._type(i + 1, end)
                if self._is(i, "?"):
                    i = self._type(i + 1, end)
                    if self._is(i, ":"):
                        i = self._type(i + 1, end)
            if i < end and self._is(i, "|", "&"):
                i += 1
                continue
            return i

    def _angles(self, i: int, end: int) -> int:
        """Index after type arguments or parameters in < >; IndexError-free: i itself if they don't close."""
        begin, depth = i, 0
        while i < end:
            t = self.t[i]
            if t.kind == "open" and t.text != "<":
                i = t.pair + 1
                continue
            if t.text == "<" and t.kind == "punct":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif t.text in (";",) or t.kind == "close":
                break
            i += 1
        return begin

    # ------------------------------------------------------------ functions

    def _parameters(self, i: int) -> None:
        """Walks the defaults of a parameter list that opens at i; types are skipped."""
        end = self.t[i].pair
        i += 1
        while i < end:
            if self.t[i].kind == "open":
                self._values(i + 1, self.t[i].pair)
                i = self.t[i].pair + 1
            elif self._is(i, "?", ",", "...") or self.t[i].kind == "word":
                i += 1
            elif self._is(i, ":"):
                i = max(i + 1, self._type(i + 1, end))
            elif self._is(i, "="):
                i = self._expression(i + 1, end, True)
            else:
                i += 1

    def _arrow(self, i: int, end: int) -> int | None:
        """Index of => if an arrow function's parameters begin at i (a name or a bracket), else None."""
        t = self.t[i]
        if t.kind == "word":
            return i + 1 if i + 1 < end and self._is(i + 1, "=>") else None
        if t.text != "(" or t.kind != "open":
            return None
        after = t.pair + 1
        if after < end and self._is(after, ":"):
            after = self._type(after + 1, end)
        return after if after < end and self._is(after, "=>") else None

    def _function(self, i: int, end: int) -> int:
        """From a parameter list (or type parameters) to the end of the body; i if there is no body."""
        if self._is(i, "<"):
            i = self._angles(i, end)
        if not (i < end and self.t[i].text == "(" and self.t[i].kind == "open"):
            return i
        self._parameters(i)
        i = self.t[i].pair + 1
        if i < end and self._is(i, ":"):
            i = self._type(i + 1, end)
        if i < end and self.t[i].text == "{" and self.t[i].kind == "open":
            self._statements(i + 1, self.t[i].pair)
            i = self.t[i].pair + 1
        return i

    # ------------------------------------------------------------ expressions

    def _values(self, i: int, end: int) -> None:
        """Expressions with commas between them, in a bracket."""
        while i < end:
            i = max(i + 1, self._expression(i, end, False, False))

    def _element(self, i: int, end: int) -> None:
        """What stands in a JSX element: expressions in braces, and other elements."""
        while i < end:
            t = self.t[i]
            if t.kind == "open":
                (self._element if t.text == "<" else self._values)(i + 1, t.pair)
                i = t.pair + 1
            else:
                i += 1

    def _object(self, i: int, end: int) -> None:
        """Members of an object literal or class between i and end."""
        while i < end:
            t = self.t[i]
            if t.kind == "open" and t.text == "[":
                self._values(i + 1, t.pair)
                i = t.pair + 1
            elif t.kind == "open" and t.text == "(" or self._is(i, "<"):
                i = max(i + 1, self._function(i, end))
            elif self._is(i, ":", "=", "..."):
                i = max(i + 1, self._expression(i + 1, end, True))
            else:
                i += 1

    def _expression(self, i: int, end: int, comma: bool, lines: bool = True) -> int:
        """Walks an expression; index of what ends it: a semicolon, a comma if `comma`, or a line's end if `lines`."""
        first = i
        while i < end:
            t = self.t[i]
            if i > first and lines and self._ends_statement(i):
                return i
            if t.kind == "close" or t.text == ";" and t.kind == "punct" or comma and t.text == "," and t.kind == "punct":
                return i
            fresh = i == first or self.t[i - 1].kind in ("punct", "open") or self.t[i - 1].text in ("return", "await", "async", "default", "case", "typeof", "void", "new", "in", "of", "throw", "yield")
            start = i
            if t.text == "async" and t.kind == "word" and i + 1 < end and (self._arrow(i + 1, end) or self._is(i + 1, "function")):
                i += 1
                t = self.t[i]
            if fresh and t.text == "<" and t.kind == "punct":
                after = self._angles(i, end)
                if after > i and after < end and self._arrow(after, end):
                    i = after
                    t = self.t[i]
            if t.kind in ("word", "open") and (fresh or i > start) and (at := self._arrow(i, end)):
                if t.kind == "open":
                    self._parameters(i)
                body = at + 1
                if body < end and self.t[body].text == "{" and self.t[body].kind == "open":
                    self._statements(body + 1, self.t[body].pair)
                    i = self.t[body].pair + 1
                else:
                    i = self._expression(body, end, True, lines)
                self._add("ArrowFunction", None, start, i)
            elif t.text == "function" and t.kind == "word":
                i += 1 + self._is(i + 1, "*")
                name = self.t[i].text if i < end and self.t[i].kind == "word" else None
                i = self._function(i + (name is not None), end)
                self._add("FunctionExpression", name, start, i)
            elif t.text == "class" and t.kind == "word" and fresh:
                i = self._class(i, end)
            elif t.text in ("as", "satisfies") and t.kind == "word" and i > first and self.t[i - 1].kind in _ENDS_VALUE:
                i = max(i + 1, self._type(i + 1, end))
            elif t.text == "<" and t.kind == "punct" and self.t[i - 1].kind == "word" and (after := self._angles(i, end)) > i and after < end and self.t[after].text in ("(", "`"):
                i = after
            elif t.kind == "open":
                if t.text == "{" and fresh:
                    self._object(i + 1, t.pair)
                elif t.text == "<":
                    self._element(i + 1, t.pair)
                else:
                    self._values(i + 1, t.pair)
                i = t.pair + 1
            else:
                i += 1
        return i

    def _init(self, i: int, end: int) -> tuple[str, str | None]:
        """Kind of an initializer of tokens i..end - 1, and the text that is called if it is a call."""
        at = i + (self._is(i, "async") and end - i > 1)
        if self.t[at].text == "function" and self.t[at].kind == "word":
            return "FunctionExpression", None
        if self._is(at, "<") and self.t[at].kind == "punct":
            at = self._angles(at, end)
        if at < end and self._arrow(at, end):
            return "ArrowFunction", None
        last = self.t[end - 1]
        if last.text == ")" and last.kind == "close" and last.pair > i:
            callee = last.pair
            if self.t[callee - 1].text == ">" and self.t[callee - 1].kind == "punct":
                depth, k = 0, callee - 1
                while k > i:
                    depth += (self.t[k].text == ">") - (self.t[k].text == "<" and self.t[k].kind == "punct")
                    if not depth:
                        callee = k
                        break
                    k -= 1
            k = callee - 1
            while k >= i:  # names, dots and earlier calls make up what is called
                if self.t[k].kind == "close":
                    k = self.t[k].pair - 1
                elif self.t[k].kind == "word" and self.t[k].text not in ("new", "await", "typeof") or self.t[k].text in (".", "?."):
                    k -= 1
                else:
                    break
            if k < i:
                return "CallExpression", self.text[self.t[i].start : self._end_of(callee)]
        return "Other", None

    # ------------------------------------------------------------ statements

    def _declarators(self, i: int, end: int, first: int, lines: bool = True) -> int:
        """Declarators after const, let or var; `first` is the statement's first token."""
        found = []
        while i < end:
            start = i
            if self.t[i].kind == "open":
                self._values(i + 1, self.t[i].pair)
                i = self.t[i].pair + 1
            else:
                i += 1
            name = self.text[self.t[start].start : self._end_of(i)]
            plain = self.t[start].kind == "word"
            if i < end and self._is(i, "!"):
                i += 1
            if i < end and self._is(i, ":"):
                i = self._type(i + 1, end)
            kind, callee = "None", None
            if i < end and self._is(i, "="):
                begin = i + 1
                i = self._expression(begin, end, True, lines)
                if i > begin:
                    kind, callee = self._init(begin, i)
            found.append(("VariableDeclaration", name, start, i, {"init_kind": kind, "callee": callee, "identifier": plain}))
            if i < end and self._is(i, ",") and self.t[i].kind == "punct":
                i += 1
                continue
            break
        for kind, name, a, b, extra in found:
            self._add(kind, name, a, b, statement=(first, None), **extra)
        return i

    def _class(self, i: int, end: int) -> int:
        while i < end and not (self.t[i].kind == "open" and self.t[i].text == "{"):
            i = self.t[i].pair + 1 if self.t[i].kind == "open" else i + 1
        if i < end:
            self._object(i + 1, self.t[i].pair)
            i = self.t[i].pair + 1
        return i

    def _import(self, i: int, end: int) -> int:
        mark = len(self.nodes)
        if self._is(i, "type") and i + 1 < end and (self.t[i + 1].kind == "word" and not self._is(i + 1, "from") or self._is(i + 1, "{", "*")):
            i += 1
        if i + 1 < end and self.t[i].kind == "word" and self._is(i + 1, "from", ","):
            self._add("ImportDefault", self.t[i].text, i, i + 1, imported="default")
        while i < end:
            t = self.t[i]
            if t.kind == "open" and t.text == "{":
                self._specifiers(i, "ImportSpecifier")
                i = t.pair + 1
            elif self._is(i, "*") and self._is(i + 1, "as") and i + 2 < end and self.t[i + 2].kind == "word":
                self._add("ImportNamespace", self.t[i + 2].text, i, i + 3, imported="*")
                i += 3
            elif t.kind == "string":
                for n in self.nodes[mark:]:
                    n.extra["module"] = t.text[1:-1]
                i += 1
                return i + 1 if i < end and self._is(i, ";") else i
            elif t.text == ";":
                return i + 1
            else:
                i += 1
        return i

    def _specifiers(self, i: int, kind: str) -> None:
        """Names between braces at i; a node's name is the last word of each, `imported` the first."""
        close, k = self.t[i].pair, i + 1
        while k < close:
            stop = k
            while stop < close and not self._is(stop, ","):
                stop += 1
            words = [x for x in range(k, stop) if self.t[x].kind in ("word", "string")]
            if words:
                named = [w for w in words if self.t[w].text != "type"] or words
                self._add(kind, self.t[words[-1]].text, k, stop, imported=self.t[named[0]].text)
            k = stop + 1

    def _exports(self, i: int, end: int, first: int) -> int:
        """`{ A as B }`, `*` or `* as N` behind export, with or without a module; the index after it."""
        mark = len(self.nodes)
        if self._opens(i, "{", end):
            self._specifiers(i, "ExportSpecifier")
            i = self.t[i].pair + 1
        else:
            named = self._is(i + 1, "as") and i + 2 < end and self.t[i + 2].kind in ("word", "string")
            i += 3 if named else 1
            self._add("ExportNamespace" if named else "ExportStar", self.t[i - 1].text if named else None, first, i, imported="*")
        if self._is(i, "from") and i + 1 < end and self.t[i + 1].kind == "string":
            for n in self.nodes[mark:]:
                n.extra["module"] = self.t[i + 1].text[1:-1]
            i += 2
        return i + 1 if i < end and self._is(i, ";") else i

    def _interface(self, i: int, end: int, first: int, level: int) -> int:
        name, i = self.t[i].text, i + 1
        if i < end and self._is(i, "<"):
            i = self._angles(i, end)
        heads = []
        if i < end and self._is(i, "extends"):
            i += 1
            while i < end and not (self.t[i].kind == "open" and self.t[i].text == "{"):
                a = i
                i = max(i + 1, self._type(i, end))
                heads.append(self.text[self.t[a].start : self._end_of(i)])
                i += i < end and self._is(i, ",")
        if not self._opens(i, "{", end):
            raise SyntaxProblem(f"interface {name} has no members in braces")
        close = self.t[i].pair
        self._add("InterfaceDeclaration", name, first, close + 1, extends=heads, top=level == 0, doc=doc_text(self.text[self.t[first].full : self.t[first].start]))
        self._members(i + 1, close, name)
        return close + 1

    def _enum(self, i: int, end: int, first: int, level: int) -> int:
        """An enumeration; its type is the union of its members' values, numbers going on from the one before."""
        name = self.t[i].text if i < end and self.t[i].kind == "word" else None
        while i < end and not (self.t[i].kind == "open" and self.t[i].text == "{"):
            i += 1
        if i >= end:
            return i
        close, values, number = self.t[i].pair, [], 0
        k = i + 1
        while k < close:
            k += 1
            if k < close and self._is(k, "="):
                a = k + 1
                k = self._expression(a, close, True, False)
                said = self.text[self.t[a].start : self._end_of(k)] if k > a else "any"
                number = int(said) + 1 if re.fullmatch(r"-?\d+", said) else number
                values.append(said)
            else:
                values.append(str(number))
                number += 1
            k += k < close and self._is(k, ",")
        self._add("EnumDeclaration", name, first, close + 1, type=" | ".join(values), top=level == 0, doc=doc_text(self.text[self.t[first].full : self.t[first].start]))
        return close + 1

    def _members(self, i: int, end: int, owner: str) -> None:
        """Members of an interface or an object type; those of an inline object type have `owner.member` as owner."""
        while i < end:
            start = i
            while i < end and self._is(i, "readonly") and not self._is(i + 1, ":", "?"):
                i += 1
            if i >= end or self._is(i, ";", ","):
                i += 1
                continue
            t = self.t[i]
            index = t.kind == "open" and t.text == "["
            if t.kind == "open":  # an index signature or a call signature
                i = t.pair + 1
                name = None
            else:
                name = t.text.strip("\"'") if t.kind == "string" else t.text
                i += 1
            optional = i < end and self._is(i, "?")
            i += optional
            if i < end and self._is(i, ":"):
                a = i + 1
                i = max(a, self._type(a, end))
            elif i < end and (self._opens(i, "(", end) or self._is(i, "<")):  # a method
                a = i
                i = self._angles(i, end) if self._is(i, "<") else i
                if not self._opens(i, "(", end):
                    raise SyntaxProblem(f"member {name} has type parameters but no parameters")
                i = self.t[i].pair + 1
                if i < end and self._is(i, ":"):
                    i = self._type(i + 1, end)
            else:
                a = i
            if name and i > start:
                said = self.text[self.t[a].start : self._end_of(i)] if i > a else "any"
                self._add("PropertySignature", name, start, i, owner=owner, type=said, optional=optional, doc=doc_text(self.text[self.t[start].full : self.t[start].start]))
                if i > a and self.t[a].text == "{" and self.t[a].kind == "open" and self.t[a].pair + 1 == i:
                    self._members(a + 1, self.t[a].pair, f"{owner}.{name}")
            elif index and i > a:
                self._add("IndexSignature", None, start, i, owner=owner, type=self.text[self.t[a].start : self._end_of(i)])
            while i < end and not (self._is(i, ";", ",") or self.t[i].newline):
                i += 1
            self._ahead(start, i)

    def _statements(self, i: int, end: int, level: int | None = None) -> None:
        level = 0 if i == 0 and end == len(self.t) else 1
        while i < end:
            first = i
            while i < end and self.t[i].kind == "word" and self.t[i].text in _MODIFIERS and i + 1 < end and (self.t[i + 1].kind == "word" or self._is(i, "default")) and not self._is(i + 1, "=>"):
                i += 1
            t = self.t[i]
            word = t.text if t.kind == "word" else ""
            if word in ("const", "let", "var") and not self._is(i + 1, "enum"):
                mark = len(self.nodes)
                i = self._declarators(i + 1, end, first)
                i += i < end and self._is(i, ";")
                for n in self.nodes[mark:]:
                    if n.extra.get("statement", (None,))[0] == first:
                        n.extra["statement"] = (self.t[first].start, self._end_of(i))
                self._add("VariableStatement", None, first, i)
            elif word == "import" and not self._is(i + 1, "(", "."):
                i = self._import(i + 1, end)
            elif word == "export" and (self._opens(i + 1, "{", end) or self._is(i + 1, "*")) or word == "type" and i > first and (self._opens(i + 1, "{", end) or self._is(i + 1, "*")):
                i = self._exports(i + 1, end, first)
            elif word == "function":
                i += 1 + self._is(i + 1, "*")
                name = self.t[i].text if i < end and self.t[i].kind == "word" else None
                i = self._function(i + (name is not None), end)
                self._add("FunctionDeclaration", name, first, i)
            elif word == "interface" and i + 1 < end and self.t[i + 1].kind == "word":
                i = self._interface(i + 1, end, first, level)
            elif word == "type" and i + 2 < end and self.t[i + 1].kind == "word" and self._is(i + 2, "=", "<"):
                name = self.t[i + 1].text
                i = self._angles(i + 2, end) if self._is(i + 2, "<") else i + 2
                a = i + 1
                i = max(a, self._type(a, end))
                said = self.text[self.t[a].start : self._end_of(i)] if i > a else "any"
                if a < end and self.t[a].text == "{" and self.t[a].kind == "open" and self.t[a].pair + 1 == i:
                    self._members(a + 1, self.t[a].pair, name)
                i += i < end and self._is(i, ";")
                self._add("TypeAlias", name, first, i, type=said, top=level == 0, doc=doc_text(self.text[self.t[first].full : self.t[first].start]))
            elif word == "class":
                name = self.t[i + 1].text if i + 1 < end else None
                i = self._class(i + 1, end)
                self._add("ClassDeclaration", name, first, i)
            elif word in ("if", "while", "for", "switch", "catch", "with") and i + 1 < end:
                i += 1 + self._is(i + 1, "await")
                if self._opens(i, "(", end):
                    inner, close = i + 1, self.t[i].pair
                    if word == "for" and self._is(inner, "const", "let", "var"):
                        inner = self._declarators(inner + 1, close, inner, False)
                    self._values(inner, close)
                    i = close + 1
            elif word in ("return", "throw"):
                i += 1
                if i < end and not (self.t[i].newline and word == "return"):
                    i = self._expression(i, end, False)
            elif word == "enum" or word == "const" and self._is(i + 1, "enum"):
                i = self._enum(i + 1 + (word == "const"), end, first, level)
            elif word in ("case", "default", "else", "do", "try", "finally", "export", "declare", "namespace", "module", "global"):
                i += 1
                if word == "case":
                    while i < end and not (self.t[i].text in ("{", ":") and self.t[i].kind in ("open", "punct")):
                        i += 1
                    i += 1
                elif word in ("namespace", "module"):
                    i += 1
            elif t.kind == "open" and t.text == "{":
                self._statements(i + 1, t.pair)
                i = t.pair + 1
            elif t.text in (";", ":") or t.kind == "close":
                i += 1
            else:
                name, i = i, max(i + 1, self._expression(i, end, False))
                if i == name + 1 and t.kind == "word" and name == first + 2 and self._is(first, "export") and self._is(first + 1, "default"):
                    self._add("ExportAssignment", "default", first, i, imported=t.text)
            self._ahead(first, i)


def nodes_of(text: str, jsx: bool = True) -> list[Node]:
    return Parser(text, jsx).nodes


__all__ = ["Node", "Parser", "SyntaxProblem", "Token", "doc_text", "nodes_of"]

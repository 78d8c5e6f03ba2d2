"""Tokens of TypeScript with JSX: strings, templates, comments, regular expressions, JSX text and tags."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SyntaxProblem(ValueError):
    """A text that cannot be taken apart; the message has the offset."""


@dataclass
class Token:
    kind: str  # word, number, string, regex, punct, open, close; open and close carry the bracket
    text: str
    start: int
    end: int
    full: int  # end of the token before: where leading white space and comments begin
    newline: bool  # a line feed stands before it
    pair: int = -1  # index of the other bracket


@dataclass
class Tag:
    """An opening or self-closing JSX tag; fragments have none."""

    name: str
    start: int
    end: int
    closed: bool


_WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff#@][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?n?|\d[\d_]*\.")
_PUNCT = re.compile(r"=>|\.\.\.|\?\?=|\?\?|\?\.(?!\d)|===|!==|==|!=|<=|>=|&&=|\|\|=|&&|\|\||\*\*=|\*\*|\+\+|--|[-+*/%&|^]=|<<=?|[-+*/%&|^!~<>=?:;,.]")
_TRIVIA = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)
#: Words after which an expression begins, so that / and < open a regular expression or a tag.
_LEADS = frozenset("return typeof case in of delete void throw new else do yield await default extends instanceof".split())


class Lexer:
    def __init__(self, text: str, jsx: bool = True):
        self.text, self.jsx, self.tokens, self.tags = text, jsx, [], []
        self._last = 0
        self._code(0, None)
        self._match()

    def _add(self, kind: str, start: int, end: int) -> None:
        self.tokens.append(Token(kind, self.text[start:end], start, end, self._last, "\n" in self.text[self._last : start]))
        self._last = end

    def _expects_value(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "word":
            return t.text in _LEADS
        return t.kind in ("punct", "open")  # after a closing bracket an operator is likelier

    def _code(self, i: int, until: str | None) -> int:
        """Tokens from i on; up to the closing brace that ends an embedded expression, if `until` is set."""
        text, n, depth = self.text, len(self.text), 0
        while True:
            i = _TRIVIA.match(text, i).end()
            if i >= n:
                if until:
                    raise SyntaxProblem(f"expression is not closed at {i}")
                return i
            c = text[i]
            if c == until and not depth:
                return i
            if c in "([{":
                depth += c == "{"
                self._add("open", i, i + 1)
                i += 1
            elif c in ")]}":
                depth -= c == "}"
                self._add("close", i, i + 1)
                i += 1
            elif c in "\"'":
                i = self._string(i)
            elif c == "`":
                i = self._template(i)
            elif c == "/" and self._expects_value():
                i = self._regex(i)
            elif c == "<" and self.jsx and self._expects_value() and (m := re.compile(r"<(?:>|[A-Za-z_$\u0080-\U0010ffff])").match(text, i)) and not re.compile(r"<\s*\w+\s*(?:,|extends\b)").match(text, i):
                i = self._element(i)
            elif (m := _NUMBER.match(text, i)) and (c.isdigit() or c == "." and i + 1 < n and text[i + 1].isdigit()):
                self._add("number", i, m.end())
                i = m.end()
            elif m := _WORD.match(text, i):
                self._add("word", i, m.end())
                i = m.end()
            elif m := _PUNCT.match(text, i):
                self._add("punct", i, m.end())
                i = m.end()
            else:
                raise SyntaxProblem(f"unexpected {c!r} at {i}")

    def _string(self, i: int) -> int:
        m = re.compile(r"(['\"])(?:\\.|(?!\1)[^\\\n])*\1", re.S).match(self.text, i)
        if not m:
            raise SyntaxProblem(f"string is not closed at {i}")
        self._add("string", i, m.end())
        return m.end()

    def _regex(self, i: int) -> int:
        m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(self.text, i)
        if not m:
            self._add("punct", i, i + 1)
            return i + 1
        self._add("regex", i, m.end())
        return m.end()

    def _template(self, i: int) -> int:
        """A template is a bracket pair of back quotes; its expressions are brackets inside."""
        self._add("open", i, i + 1)
        i += 1
        while True:
            m = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S).match(self.text, i)
            i = m.end()
            if self.text.startswith("${", i):
                self._add("open", i, i + 2)
                i = self._code(i + 2, "}")
                self._add("close", i, i + 1)
                i += 1
            elif self.text.startswith("`", i):
                self._add("close", i, i + 1)
                return i + 1
            else:
                raise SyntaxProblem(f"template is not closed at {i}")

    def _element(self, i: int) -> int:
        """A JSX element is a bracket pair of < and >; only expressions in braces are tokens inside."""
        begin = i
        self._add("open", i, i + 1)
        name = re.compile(r"<\s*([\w$.:-]*)").match(self.text, i)
        i = name.end()
        generic = re.compile(r"<[\w\s,.\[\]|]*>").match(self.text, i)  # type arguments of a tag
        i = generic.end() if generic else i
        attributes = re.compile(r"(?:[\w$:.-]+|=|\s+|\"[^\"]*\"|'[^']*'|/\*.*?\*/|//[^\n]*)*", re.S)
        while True:
            i = attributes.match(self.text, i).end()
            if self.text.startswith("{", i):
                i = self._braces(i)
            elif self.text.startswith("<", i):
                i = self._element(i)
            elif self.text.startswith("/>", i):
                if name[1]:
                    self.tags.append(Tag(name[1], begin, i + 2, True))
                self._add("close", i, i + 2)
                return i + 2
            elif self.text.startswith(">", i):
                if name[1]:
                    self.tags.append(Tag(name[1], begin, i + 1, False))
                i += 1
                break
            else:
                raise SyntaxProblem(f"tag is not closed at {i}")
        while True:
            i = re.compile(r"[^<{]*").match(self.text, i).end()
            if self.text.startswith("{", i):
                i = self._braces(i)
            elif m := re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(self.text, i):
                if m[1] != name[1]:
                    raise SyntaxProblem(f"tag {name[1]!r} is closed by {m[1]!r} at {i}")
                self._add("close", i, m.end())
                return m.end()
            elif self.text.startswith("<", i):
                i = self._element(i)
            else:
                raise SyntaxProblem(f"element {name[1]!r} is not closed at {i}")

    def _braces(self, i: int) -> int:
        self._add("open", i, i + 1)
        i = self._code(i + 1, "}")
        self._add("close", i, i + 1)
        return i + 1

    def _match(self) -> None:
        partner = {")": "(", "]": "[", "}": "{", "`": "`"}
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind == "open":
                stack.append(k)
            elif t.kind == "close":
                want = partner.get(t.text, "<")
                if not stack or self.tokens[stack[-1]].text not in ((want, "${") if want == "{" else (want,)):
                    raise SyntaxProblem(f"unexpected {t.text!r} at {t.start}")
                t.pair = stack.pop()
                self.tokens[t.pair].pair = k
        if stack:
            raise SyntaxProblem(f"bracket is not closed at {self.tokens[stack[-1]].start}")

"""TypeScript and JavaScript source to nodes and edges, by a tokenizer that skips strings, comments, templates and regexes."""

from __future__ import annotations

import re

from .builder import Builder

SUFFIXES = (".tsx", ".ts", ".jsx", ".js", ".mjs", ".cjs")
TEST_NAMES = frozenset(("it", "test", "describe"))
_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<template>`)|(?P<name>[A-Za-z_$#][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\.\.\.|\?\.|[^\s\w])",
    re.S,
)
_MODIFIERS = frozenset(("public", "private", "protected", "static", "readonly", "abstract", "override", "async", "get", "set", "declare", "accessor", "*"))
_NOT_METHODS = frozenset(("if", "for", "while", "switch", "catch", "return", "function", "new"))
_BEFORE_REGEX = frozenset("(,=:[!&|?{};")
_CLOSING = {"(": ")", "{": "}", "[": "]"}


def tokenize(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of each token. A template literal is one string token, whatever it holds."""
    out: list[tuple[str, str, int]] = []
    at, line = 0, 1
    while at < len(source):
        m = _TOKEN.match(source, at)
        end, kind = m.end(), m.lastgroup
        if kind == "template":
            end, kind = _template_end(source, at), "string"
        elif m[0] == "/" and (not out or out[-1][1] in _BEFORE_REGEX or out[-1][1] in ("return", "=>")):
            if r := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(source, at):
                end, kind = r.end(), "string"
        if kind != "skip":
            out.append((kind, source[at:end], line))
        line += source.count("\n", at, end)
        at = end
    return out


def _template_end(source: str, at: int) -> int:
    """The end of a template literal, nested ones in its ${} parts included."""
    at += 1
    depth = 0
    while at < len(source):
        c = source[at]
        if c == "\\":
            at += 1
        elif c == "`":
            if not depth:
                return at + 1
            at = _template_end(source, at) - 1
        elif source.startswith("${", at):
            depth += 1
            at += 1
        elif c == "}" and depth:
            depth -= 1
        elif c == "{" and depth:
            depth += 1
        at += 1
    return at


class Reader:
    def __init__(self, build: Builder, source: str):
        self.build, self.t = build, tokenize(source)
        path = build.rel_path
        for s in SUFFIXES:
            path = path.removesuffix(s)
        self.module = path.replace("/", ".")
        self.last_line = source.count("\n") + 1

    def text(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i][0] if 0 <= i < len(self.t) else ""

    def line(self, i: int) -> int:
        return self.t[i][2] if i < len(self.t) else self.last_line

    def close(self, i: int) -> int:
        """The index of the bracket that closes the one at i."""
        depth = 0
        for j in range(i, len(self.t)):
            if self.t[j][0] == "sign":
                depth += (self.t[j][1] in "({[") - (self.t[j][1] in ")}]")
                if depth == 0:
                    return j
        return len(self.t) - 1

    def until(self, i: int, *signs: str) -> int:
        """The next of these signs outside brackets and angle brackets."""
        angle = 0
        while i < len(self.t):
            if self.t[i][0] == "sign":
                x = self.t[i][1]
                if x in signs and angle <= 0:
                    return i
                angle += (x == "<") - (x == ">")
                if x in "([{":
                    i = self.close(i)
            i += 1
        return i

    def params(self, i: int) -> list[str]:
        """Plain parameter names of the list that opens at i."""
        names, end, fresh = [], self.close(i), True
        j = i + 1
        while j < end:
            if fresh and self.kind(j) == "name" and self.text(j) not in _MODIFIERS:
                names.append(self.text(j))
                fresh = False
            elif self.text(j) == "," and self.kind(j) == "sign":
                fresh = True
            elif self.kind(j) == "sign" and self.text(j) in "([{":
                j = self.close(j)
                fresh = False
            elif self.text(j) in ("...", ":", "="):
                fresh = False
            elif self.text(j) == "<":
                j = self.until(j + 1, ">")
            j += 1
        return names

    def run(self) -> None:
        i = 0
        while i < len(self.t):
            word, quiet = self.text(i), self.text(i - 1) in (".", "?.")
            if self.kind(i) != "name" or quiet:
                i += 1
            elif word == "class" and self.kind(i + 1) == "name":
                i = self.class_(i)
            elif word == "function":
                i = self.function(i)
            elif word == "interface" and self.kind(i + 1) == "name" and self.text(self.until(i + 2, "{")) == "{":
                i = self.interface(i)
            elif word == "type" and self.kind(i + 1) == "name" and self.text(i + 2) in ("=", "<"):
                i = self.alias(i)
            elif word == "import":
                i = self.import_(i)
            elif word == "export" and (self.text(i + 1) in ("*", "{")):
                i = self.import_(i)
            else:
                i += 1

    def declare(self, kind: str, first: int, last: int, name: str, fqn: str, parent: str | None = None, **more) -> str:
        node_id = self.build.node(kind, name=name, fqn=fqn, lines=(self.line(first), self.line(last)), **more)
        self.build.contains(parent or self.build.file_id, node_id)
        return node_id

    def _heads(self, i: int, body: int) -> dict[str, list[str]]:
        """Names behind extends and implements, type arguments left out."""
        heads: dict[str, list[str]] = {}
        word, depth = "", 0
        for j in range(i, body):
            x = self.text(j)
            depth += (x == "<") - (x == ">")
            if x in ("extends", "implements") and not depth:
                word = x
            elif word and not depth and self.kind(j) == "name":
                names = heads.setdefault(word, [])
                if self.text(j - 1) == "." and names:
                    names[-1] += "." + x
                else:
                    names.append(x)
        return heads

    def class_(self, i: int) -> int:
        name, body = self.text(i + 1), self.until(i + 2, "{")
        end, heads, fqn = self.close(body), self._heads(i + 2, body), f"{self.module}.{self.text(i + 1)}"
        node_id = self.declare("Class", i, end, name, fqn, bases=heads.get("extends", []), is_abstract=self.text(i - 1) == "abstract", decorator_names=[])
        for base in heads.get("extends", []):
            self.build.edge("INHERITS", node_id, base, is_mixin=False)
        for face in heads.get("implements", []):
            self.build.edge("IMPLEMENTS", node_id, face, confidence=0.9)
        j = body + 1
        while j < end:
            j = self.member(j, end, name, fqn, node_id)
        return end + 1

    def member(self, j: int, end: int, owner: str, class_fqn: str, class_id: str) -> int:
        """A method if modifiers and a name are followed by parameters and a body; else skipped as a field."""
        marks: set[str] = set()
        while self.text(j) == "@":
            j += 2
            while self.text(j) == ".":
                j += 2
            j = self.close(j) + 1 if self.text(j) == "(" else j
        start = j
        while self.text(j) in _MODIFIERS and self.text(j + 1) not in ("(", "=", ":", ";", "?", "<"):
            marks.add(self.text(j))
            j += 1
        name = self.text(j)
        open_ = j + 1
        if self.text(open_) == "<":
            open_ = self.until(open_ + 1, ">") + 1
        if self.kind(j) in ("name", "string") and self.text(open_) == "(" and name not in _NOT_METHODS:
            params, after = self.params(open_), self.close(open_) + 1
            body = after if self.text(after) == "{" else self._body_after_type(after, end)
            if body < end and self.text(body) == "{":
                last = self.close(body)
                is_async = "async" in marks
                self.declare("Method", start, last, name, f"{class_fqn}.{name}", class_id, signature=f"{'async ' if is_async else ''}{name}({', '.join(params)})",
                             is_async=is_async, is_generator="*" in marks, parameter_names=params, class_fqn=class_fqn, is_static="static" in marks, decorator_names=[])
                return last + 1
            return body + 1
        while j < end and self.text(j) != ";":  # a field, up to its semicolon or the next line's member
            if self.kind(j) == "sign" and self.text(j) in "([{":
                j = self.close(j)
            if self.line(j + 1) > self.line(j) and self.text(j) not in ("=", ",", "|", "&", "=>", "?", ":") and self.text(j + 1) not in (".", "|", "&", "?", "=>", "="):
                break
            j += 1
        return j + 1

    def _body_after_type(self, j: int, end: int) -> int:
        """Past a return type to the body's brace, or to the semicolon of a signature without one."""
        if self.text(j) == ":" and self.text(j + 1) == "{":  # an object type
            j = self.close(j + 1) + 1
        return min(end, self.until(j, "{", ";"))

    def function(self, i: int) -> int:
        name_at = i + 2 if self.text(i + 1) == "*" else i + 1
        if self.kind(name_at) != "name":
            return i + 1
        name, open_ = self.text(name_at), self.until(name_at + 1, "(")
        params, after = self.params(open_), self.close(open_) + 1
        body = after if self.text(after) == "{" else self._body_after_type(after, len(self.t))
        if self.text(body) != "{":
            return body + 1
        end, is_async, fqn = self.close(body), self.text(i - 1) == "async", f"{self.module}.{name}"
        first = i - 1 if is_async else i
        if name in TEST_NAMES or name.startswith("test"):
            self.declare("Test", first, end, name, fqn, test_framework="jest", is_parametrized=False)
        else:
            self.declare("Function", first, end, name, fqn, is_async=is_async, is_generator=self.text(i + 1) == "*", parameter_names=params, decorator_names=[],
                         signature=f"{'async ' if is_async else ''}function {name}({', '.join(params)})")
        return body + 1  # functions within are declarations too

    def interface(self, i: int) -> int:
        body = self.until(i + 2, "{")
        end = self.close(body)
        self.declare("Interface", i, end, self.text(i + 1), f"{self.module}.{self.text(i + 1)}", extends=self._heads(i + 2, body).get("extends", []))
        return end + 1

    def alias(self, i: int) -> int:
        equals = self.until(i + 2, "=")
        end = self.until(equals + 1, ";")
        stop = min(end, len(self.t) - 1)
        self.declare("TypeAlias", i, stop, self.text(i + 1), f"{self.module}.{self.text(i + 1)}", type_expression=" ".join(self.text(j) for j in range(equals + 1, end))[:512])
        return end + 1

    def import_(self, i: int) -> int:
        """import .. from 'm', import 'm', export .. from 'm'; a call import(..) is no statement."""
        if self.text(i + 1) in ("(", "."):
            return i + 1
        names, j, depth = [], i + 1, 0
        while j < len(self.t) and self.text(j) != ";" and not (self.line(j) > self.line(j - 1) and not depth and self.text(j - 1) not in ("import", "from", ",", "}")):
            x = self.text(j)
            depth += (x == "{") - (x == "}")
            if depth and self.kind(j) == "name" and self.text(j - 1) in ("{", ",", "type") and x != "type":
                names.append(x)
            if self.kind(j) == "string" and self.text(j - 1) in ("from", "import"):
                self.build.imports(x.strip("'\"`"), names)
                return j + 1
            j += 1
        return max(j, i + 1)


def parse(build: Builder, source: str) -> None:
    Reader(build, source).run()

"""Declarations, imports, exports and references of TypeScript and JavaScript files.

A tokenizer and a scope-tracking scan, not a full grammar: type-level syntax beyond annotations and decorators' arguments
are scanned as plain tokens, and the expressions of a template as if they were added to it in parentheses. ``extract``
runs it over a table of files in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<template>`)|(?P<name>[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\?\?|\?\.|&&|\|\||\.\.\.|[-+*/%&|^!=<>]=?=?|[{}()\[\];,.:?@#~])", re.S)
_BRANCHES = frozenset(["if", "for", "while", "do", "case", "default", "catch", "else", "?", "&&", "||"])
_NESTING = frozenset(["if", "for", "while", "do", "switch", "catch"])
_KEYWORDS = frozenset("if for while do switch case default catch else return new typeof instanceof in of const let var function class extends implements interface type enum namespace import export from as async await yield throw try finally delete void this super null true false undefined static public private protected readonly override abstract declare get set".split())


def _template_end(source: str, at: int) -> int:
    """The place after the template that starts at ``at``."""
    at += 1
    while at < len(source):
        if source[at] == "\\":
            at += 2
        elif source[at] == "`":
            return at + 1
        elif source.startswith("${", at):
            at = _expression_end(source, at + 2)
        else:
            at += 1
    return len(source)


def _expression_end(source: str, at: int) -> int:
    """The place after the brace that closes a template's expression."""
    depth = 1
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            at += 1
        elif m.lastgroup == "template":
            at = _template_end(source, at)
        else:
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            at = m.end()
            if not depth:
                break
    return at


def tokens(source: str, line: int = 0, start: int = 0) -> list[tuple[str, str, int, int]]:
    """(kind, text, line, place) without white space and comments. The expressions of a template follow it, each in
    parentheses."""
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            at += 1
            continue
        end = _template_end(source, at) if m.lastgroup == "template" else m.end()
        text = source[at:end]
        if m.lastgroup == "template":
            out.append(("string", text, line, start + at))
            inner = 1
            while (inner := text.find("${", inner)) >= 0:
                close = _expression_end(text, inner + 2)
                here, place = line + text.count("\n", 0, inner), start + at + inner
                out += [("op", "+", here, place), ("op", "(", here, place), *tokens(text[inner + 2 : close - 1], here, place + 2), ("op", ")", here, place)]
                inner = close
        elif m.lastgroup not in ("space", "comment"):
            out.append((m.lastgroup, text, line, start + at))
        line += text.count("\n")
        at = end
    return out


class _Scan:
    def __init__(self, path: str, source: str):
        self.path, self.t, self.i = path, tokens(source), 0
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.exports: list[dict] = []
        self.refs: list[dict] = []
        self.diagnostics: list[str] = []
        self.scopes: list[tuple[int, int]] = []
        self.ids: dict[str, str] = {}

    def text(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if 0 <= self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if 0 <= self.i + k < len(self.t) else ""

    def line(self) -> int:
        return self.t[min(self.i, len(self.t) - 1)][2] if self.t else 0

    def close_of(self, at: int) -> int:
        """The place of the bracket that closes the one at ``at`` (the end if none does)."""
        depth = 0
        for k in range(at, len(self.t)):
            if self.t[k][0] == "op":
                if self.t[k][1] in "([{":
                    depth += 1
                elif self.t[k][1] in ")]}":
                    depth -= 1
                    if not depth:
                        return k
        self.diagnostics.append("syntax_error")
        return len(self.t)

    def complexity(self, start: int, end: int) -> tuple[int, int]:
        cyclomatic, cognitive, stack, pending = 1, 0, [], False
        for k in range(start, end):
            text = self.t[k][1]
            before = self.t[k - 1][1] if k else ""
            if text in _BRANCHES and before != "." and not (text == "?" and self.t[min(k + 1, end - 1)][1] in (":", ")", ",")):
                cyclomatic += 1
                cognitive += 1 + sum(stack)
            if text in _NESTING and before != ".":
                pending = True
            if text == "{":
                stack.append(int(pending))
                pending = False
            elif text == "}" and stack:
                stack.pop()
        return cyclomatic, max(1, cognitive)

    def declare(self, name: str, kind: str, owner: list[str], exported: bool, span: tuple[int, int] | None = None) -> None:
        qualified = ".".join([*owner, name])
        space = "type" if kind in ("interface_declaration", "type_alias_declaration") else "value"
        cyclomatic, cognitive = self.complexity(*span) if span else (None, None)
        # What is declared inside a function holds there only.
        scope = f"@scope:{self.scopes[-1][0]}:{self.scopes[-1][1]}" if self.scopes else ""
        self.ids[qualified] = symbol = f"symbol://{self.path}#{space}:{qualified}{scope}"
        self.symbols.append({"id": symbol, "name": name, "qualified": qualified, "kind": kind, "exported": exported, "line": self.line(), "cyclomatic": cyclomatic, "cognitive": cognitive})

    def refer(self, owner: list[str], to: str, kind: str) -> None:
        name = ".".join(owner)
        source = self.ids.get(name, f"symbol://{self.path}#value:{name}") if owner else self.path
        self.refs.append({"from": source, "to": to, "kind": kind, "line": self.line()})

    def bindings(self, end: int) -> list[tuple[str, str, bool]]:
        """(imported, local, type only) of a braced list up to place end."""
        out, k = [], self.i
        while k < end:
            type_only = self.t[k][1] == "type" and self.t[k + 1][0] == "name" and self.t[k + 1][1] != "as"
            k += type_only
            name = self.t[k][1].strip("'\"")
            local = name
            if k + 2 < end and self.t[k + 1][1] in ("as", ":"):
                local, k = self.t[k + 2][1], k + 2
            if re.match(r"[\w$]", name):
                out.append((name, local, type_only))
            while k < end and self.t[k][1] != ",":
                k += 1
            k += 1
        return out

    def run_import(self) -> None:
        line, type_only, pairs = self.line(), False, []
        self.i += 1
        if self.text() == "(":
            if self.kind(1) == "string" and self.text(2) == ")":
                self.imports.append({"specifier": self.text(1)[1:-1], "imported": None, "local": None, "kind": "dynamic", "type_only": False, "line": line})
            return
        if self.text() == "type" and self.text(1) not in ("from", ","):
            type_only, self.i = True, self.i + 1
        if self.text() == "defer":
            self.i += 1
        while self.i < len(self.t) and self.text() not in ("from", ";") and self.kind() != "string":
            if self.text() == "{":
                end = self.close_of(self.i)
                self.i += 1
                pairs += [(a, b, "named", own) for a, b, own in self.bindings(end)]
                self.i = end
            elif self.text() == "*":
                pairs.append(("*", self.text(2), "namespace", False))
                self.i += 2
            elif self.kind() == "name":
                kind = "import_equals" if self.text(1) == "=" else "default"
                pairs.append(("default", self.text(), kind, False))
                if kind == "import_equals" and self.text(2) == "require":
                    self.i += 3
            self.i += 1
        if self.text() == "from":
            self.i += 1
        if self.kind() == "string":
            for a, b, kind, own in pairs or [(None, None, "side_effect", False)]:
                self.imports.append({"specifier": self.text()[1:-1], "imported": a, "local": b, "kind": kind, "type_only": type_only or own, "line": line})

    def run_export(self) -> bool:
        """Handle export lists and stars; True if a declaration follows."""
        line = self.line()
        type_only = self.text(1) == "type" and self.text(2) in ("{", "*")
        k = self.i + 1 + type_only
        word = self.t[k][1] if k < len(self.t) else ""
        if word == "*":
            name = self.t[k + 2][1] if self.t[k + 1][1] == "as" else "*"
            at = next((j for j in range(k, min(k + 6, len(self.t))) if self.t[j][0] == "string"), None)
            if at is not None:
                self.exports.append({"exported": name, "local": "*", "source": self.t[at][1][1:-1], "kind": "star" if name == "*" else "namespace", "type_only": type_only, "line": line})
                self.i = at
            return False
        if word == "{":
            end = self.close_of(k)
            self.i = k + 1
            pairs, source = self.bindings(end), None
            if end + 2 < len(self.t) and self.t[end + 1][1] == "from":
                source = self.t[end + 2][1][1:-1]
            self.exports += [{"exported": b, "local": a, "source": source, "kind": "named", "type_only": type_only or own, "line": line} for a, b, own in pairs]
            self.i = end + (2 if source is not None else 0)
            return False
        if word == "default":
            following = next((self.t[j][1] for j in range(k + 1, min(k + 6, len(self.t))) if self.t[j][0] == "name" and self.t[j][1] not in _KEYWORDS), "default")
            self.exports.append({"exported": "default", "local": following, "source": None, "kind": "default", "type_only": False, "line": line})
            self.i = k
            if self.text(1) not in ("class", "function", "async", "abstract", "interface"):
                return False
        return True

    def heritage(self, owner: list[str], end: int) -> None:
        how = None
        while self.i < end and self.text() != "{":
            if self.text() in ("extends", "implements"):
                how = self.text()
            elif how and self.kind() == "name" and self.text(-1) in ("extends", "implements", ","):
                self.refer(owner, self.text(), "Extends" if how == "extends" else "Implements")
            self.i += 1

    def body(self, owner: list[str], end: int, shadowed: frozenset[str], member: bool = False) -> None:
        """Scan up to place end within owner; names in shadowed are parameters and don't refer outside."""
        exported = False
        while self.i < end:
            text, kind = self.text(), self.kind()
            if text == "import" and not member and self.text(-1) != ".":
                self.run_import()
            elif text == "export":
                exported = self.run_export()
                self.i += 1
                continue
            elif kind == "name" and text in ("class", "interface", "enum", "namespace") and self.kind(1) == "name" and self.text(-1) != ".":
                name = self.text(1) if self.text(1) not in ("extends", "implements") else "default"
                label = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "namespace": "namespace"}[text]
                at = next((j for j in range(self.i, end) if self.t[j][1] == "{"), end)
                close = self.close_of(at) if at < end else end
                self.declare(name, label, owner, exported)
                self.i += 2 if name != "default" else 1
                self.heritage([*owner, name], close)
                self.i += 1
                if text == "enum":
                    while self.i < close:
                        if self.kind() == "name" and self.text(-1) in ("{", ","):
                            self.declare(self.text(), "enum_member", [*owner, name], False)
                        self.i += 1
                else:
                    self.body([*owner, name], close, frozenset(), member=text != "namespace")
                self.i = close
                exported = False
            elif text == "type" and self.kind(1) == "name" and self.text(2) in ("=", "<") and not member:
                self.i += 1
                self.declare(self.text(), "type_alias_declaration", owner, exported)
                exported = False
            elif text == "function" and (self.kind(1) == "name" or self.text(1) in ("*", "(")):
                self.i += 1 + (self.text(1) == "*")
                name = self.text() if self.kind() == "name" else "default"
                if self.kind() == "name" or exported:
                    self.callable_(name, "function_declaration", owner, exported, end, shadowed)
                exported = False
            elif text in ("const", "let", "var", "using") and self.kind(1) in ("name", "op") and not member:
                self.variables("constant" if text == "const" else "variable", owner, exported, end, shadowed)
                exported = False
                continue
            elif member and kind == "name" and self.text(1) in ("(", "<") and text not in _KEYWORDS - {"get", "set", "constructor"} and self.text(-1) in ("{", "}", ";", "async", "static", "public", "private", "protected", "override", "get", "set", "abstract", "*", "readonly", ")"):
                self.callable_(text, "method", owner, False, end, shadowed)
            elif member and kind == "name" and text not in _KEYWORDS and self.text(1) in (":", "=", ";", "?", "!") and self.text(-1) in ("{", "}", ";", "static", "public", "private", "protected", "readonly", "override", "declare", ",", ")"):
                self.declare(text, "property", owner, False)
                if self.text(1) in (":", "?", "!") and (k := 2 if self.text(1) == ":" else 3) and self.kind(k) == "name" and self.text(k) not in _KEYWORDS and self.text(k)[:1].isupper():
                    self.i += k
                    self.refer(owner, self.text(), "TypeOf")
            elif kind == "name":
                self.reference(owner, shadowed)
            elif text == "@" and self.kind(1) == "name":
                self.i += 1
                self.refer(owner, self.text(), "Decorates")
            elif text == "<" and self.kind(1) == "name" and self.text(1)[:1].isupper() and self.text(-1) in ("(", "return", "=>", "=", "?", ":", "&&", ">", ",", "{", "}"):
                self.i += 1
                if self.text() not in shadowed:
                    self.refer(owner, self.text(), "References")
            self.i += 1

    def reference(self, owner: list[str], shadowed: frozenset[str]) -> None:
        if self.text(-1) == "." or self.text() in _KEYWORDS - {"this", "require", "new"}:
            return
        if self.text() == "new":
            if self.kind(1) == "name" and self.text(1) not in shadowed:
                self.i += 1
                self.refer(owner, self.text(), "Instantiates")
            return
        parts, k = [self.text()], 1
        while self.text(k) in (".", "?.") and self.kind(k + 1) == "name":
            parts.append(self.text(k + 1))
            k += 2
        if parts[0] == "require" and self.text(k) == "(" and self.kind(k + 1) == "string" and self.text(k + 2) == ")":
            self.imports.append({"specifier": self.text(k + 1)[1:-1], "imported": "*", "local": None, "kind": "require", "type_only": False, "line": self.line()})
        elif parts[:2] == ["module", "exports"] or parts[0] == "exports" and len(parts) > 1:
            if self.text(k) == "=":
                name = parts[-1] if parts[-1] != "exports" else "default"
                self.exports.append({"exported": name, "local": self.text(k + 1), "source": None, "kind": "common_js", "type_only": False, "line": self.line()})
        elif self.text(k) == "(" and parts[0] not in shadowed and parts != ["this"]:
            self.refer(owner, ".".join(parts), "Calls")
        elif self.text(-1) == ":" and parts[0][:1].isupper() and parts[0] not in shadowed:
            self.refer(owner, ".".join(parts), "TypeOf")
        self.i += k - 1

    def parameters(self, at: int, close: int) -> frozenset[str]:
        return frozenset(self.t[k][1] for k in range(at + 1, close) if self.t[k][0] == "name" and self.t[k - 1][1] in ("(", ",", "{", "...", "public", "private", "protected", "readonly", "override", "[") and self.t[k][1] not in _KEYWORDS)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The places of two tokens in the text."""
        last = len(self.t) - 1
        return (self.t[min(start, last)][3], self.t[min(end, last)][3] + len(self.t[min(end, last)][1])) if self.t else (0, 0)

    def locals_(self, start: int, end: int) -> frozenset[str]:
        """Names between two tokens that are caught errors, loop variables, or values that are no function or class."""
        out = set()
        for k in range(max(start, 1), min(end, len(self.t) - 2)):
            word, name = self.t[k][1], self.t[k + 1]
            if word == "catch" and name[1] == "(" and self.t[k + 2][0] == "name":
                out.add(self.t[k + 2][1])
            elif word in ("const", "let", "var") and name[0] == "name":
                value = [t[1] for t in self.t[k + 2 : k + 6]]
                plain = value[:1] != ["="] or value[1:2] not in (["("], ["async"], ["function"], ["class"]) and "=>" not in value
                if value[:1] and value[0] in ("=", "of", "in", ";", ",") and plain:
                    out.add(name[1])
        return frozenset(out)

    def callable_(self, name: str, kind: str, owner: list[str], exported: bool, end: int, shadowed: frozenset[str]) -> None:
        at = next((j for j in range(self.i, end) if self.t[j][1] == "("), end)
        if at == end:
            return
        close = self.close_of(at)
        brace = next((j for j in range(close, min(end, len(self.t))) if self.t[j][1] in ("{", ";", "}")), end)
        stop = self.close_of(brace) if brace < end and self.t[brace][1] == "{" else brace
        self.declare(name, kind, owner, exported, (close, stop))
        if name == "constructor":
            for k in range(at, close):
                if self.t[k][1] in ("public", "private", "protected", "readonly", "override") and self.t[k + 1][0] == "name" and self.t[k + 1][1] not in _KEYWORDS:
                    self.declare(self.t[k + 1][1], "property", owner, False)
        inner = shadowed | self.parameters(at, close) | self.locals_(brace, stop)
        self.i = at + 1
        self.scopes.append(self.span(brace, stop))
        self.body([*owner, name], stop, inner)
        self.scopes.pop()
        self.i = min(stop, len(self.t)) if stop < len(self.t) and self.t[stop][1] == "}" and brace != stop else stop - 1

    def variables(self, kind: str, owner: list[str], exported: bool, end: int, shadowed: frozenset[str]) -> None:
        self.i += 1
        names = []
        if self.text() in ("{", "["):
            close = self.close_of(self.i)
            k = self.i
            while k < close:
                if self.t[k][0] == "name" and self.t[k + 1][1] in (",", "}", "]", "="):
                    names.append(self.t[k][1])
                k += 1
            self.i = close + 1
        elif self.kind() == "name":
            names.append(self.text())
            self.i += 1
        at = self.i
        depth = 0
        while at < end and not (depth == 0 and (self.t[at][1] in (";", "=") or self.t[at][1] == "}")):
            depth += self.t[at][1] in ("(", "[", "{", "<")
            depth -= self.t[at][1] in (")", "]", "}", ">")
            at += 1
        first = self.t[at + 1][1] if at + 1 < end and self.t[at][1] == "=" else ""
        if first == "async" and at + 2 < end:
            first = self.t[at + 2][1]
        arrow = first == "function" or first == "(" and at + 1 < end and (c := self.close_of(at + 1 + (self.t[at + 1][1] == "async"))) + 1 < len(self.t) and (self.t[c + 1][1] in ("=>", ":")) or at + 2 < end and self.t[at + 2][1] == "=>"
        label = "function_declaration" if arrow else "class_declaration" if first == "class" else kind
        for name in names:
            stop = end
            if arrow:
                brace = next((j for j in range(at, end) if self.t[j][1] == "{"), end)
                stop = self.close_of(brace) if brace < end else end
            self.declare(name, label, owner, exported, (at, min(stop, len(self.t))) if arrow else None)
        if arrow and names:
            opening = next((j for j in range(at, end) if self.t[j][1] == "("), None)
            inner = shadowed | (self.parameters(opening, self.close_of(opening)) if opening is not None else frozenset())
            brace = next((j for j in range(at, end) if self.t[j][1] == "{"), end)
            stop = self.close_of(brace) if brace < end else next((j for j in range(at, end) if self.t[j][1] == ";"), end)
            self.i = at + 1
            self.scopes.append(self.span(at, min(stop, end)))
            self.body([*owner, names[0]], min(stop, end), inner | self.locals_(at, min(stop, end)))
            self.scopes.pop()


def parse_source(path: str, source: str) -> dict[str, list]:
    """symbols, imports, exports, refs and diagnostics of one file."""
    scan = _Scan(path, source)
    try:
        scan.body([], len(scan.t), frozenset())
    except IndexError:
        scan.diagnostics.append("syntax_error")
    return {"symbols": scan.symbols, "imports": scan.imports, "exports": scan.exports, "refs": scan.refs, "diagnostics": sorted(set(scan.diagnostics))}


SCHEMA = (
    "path string, symbols array<struct<id:string,name:string,qualified:string,kind:string,exported:boolean,line:int,cyclomatic:int,cognitive:int>>, "
    "imports array<struct<specifier:string,imported:string,local:string,kind:string,type_only:boolean,line:int>>, "
    "exports array<struct<exported:string,local:string,source:string,kind:string,type_only:boolean,line:int>>, "
    "refs array<struct<from:string,to:string,kind:string,line:int>>, diagnostics array<string>"
)


def extract(files: DataFrame) -> DataFrame:
    """One row per file (path, content) with its records as arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p} | parse_source(p or "", c or "") for p, c in zip(*(batch.column(k).to_pylist() for k in ("path", "content")), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, SCHEMA)

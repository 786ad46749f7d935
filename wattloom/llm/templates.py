"""A sandboxed template language, compiled to closures.

Text outside marks is copied. ``{{ expression }}`` prints a value; ``{% for x in list %}``,
``{% if %} {% elif %} {% else %}``, ``{% set x = expression %}`` and ``{% generation %}`` have matching
``{% end... %}`` (but ``set``); ``{# ... #}`` is a comment; a ``-`` inside a mark strips the white space
on that side. Expressions know literals, names, ``a.b`` and ``a['b']`` on mappings and lists, the usual
operators, ``x if c else y``, ``is defined``, ``is none`` and filters. There are no calls, no attributes
of Python objects and no way to reach either, and names that begin with an underscore are refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """A template that is not valid, or a value it cannot use."""


def escape(text: str) -> str:
    """Text without ``<|``: each ``<``, backslashes, ``|`` gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def header(text: str) -> str:
    """Text in one line and without ``<``."""
    return text.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unheader(text: str) -> str:
    return text.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda v: str(v).strip(),
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "length": len,
    "default": lambda v, other="": other if v is None else v,
    "tojson": lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True),
    "escape": lambda v: escape(str(v)),
    "header": lambda v: header(str(v)),
}

TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<op>==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))",
    re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
MARK = re.compile(r"\{\{-?|\{%-?|\{#")
CLOSE = {"{{": "}}", "{%": "%}", "{#": "#}"}
WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


@dataclass
class Node:
    """A node of the syntax tree: its kind, its children and a plain value."""

    kind: str
    parts: list = field(default_factory=list)
    value: Any = None


def constant(value: Any) -> Node:
    return Node("constant", [], value)


class _Expression:
    """Recursive descent over the tokens of one mark."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastgroup or "", found.group(found.lastgroup or 0)))
            at = found.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        if self.at >= len(self.tokens):
            return False
        kind, text = self.tokens[self.at]
        return kind != "string" and text in texts

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"expected {text!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        text = self.tokens[self.at - 1][1]
        if text.startswith("_"):
            raise TemplateError(f"name {text!r} is not allowed")
        return text

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self) -> Node:
        value = self.binary(0)
        if self.take("if"):
            condition = self.binary(0)
            other = self.expression() if self.take("else") else constant("")
            return Node("choice", [condition, value, other])
        return value

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in", "is", "not"), ("~",), ("+", "-"), ("*", "%"))

    def binary(self, level: int) -> Node:
        if level == len(self.LEVELS):
            return self.filtered()
        if level == 2:
            if self.take("not"):
                return Node("not", [self.binary(2)])
            return self.binary(3)
        left = self.binary(level + 1)
        while self.peek(*self.LEVELS[level]):
            op = self.tokens[self.at][1]
            self.at += 1
            if op == "is":
                refuse = self.take("not")
                test = self.name()
                if test not in ("defined", "none"):
                    raise TemplateError(f"unknown test {test!r}")
                left = Node("is", [left], test)
                left = Node("not", [left]) if refuse else left
            elif op == "not":
                self.need("in")
                left = Node("not", [Node("binary", [left, self.binary(level + 1)], "in")])
            else:
                left = Node("binary", [left, self.binary(level + 1)], op)
        return left

    def filtered(self) -> Node:
        value = self.postfix()
        while self.take("|"):
            name, given = self.name(), [value]
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    given.append(self.expression())
                    if not self.peek(")"):
                        self.need(",")
            value = Node("filter", given, name)
        return value

    def postfix(self) -> Node:
        value = self.atom()
        while True:
            if self.take("."):
                value = Node("item", [value, constant(self.name())])
            elif self.take("["):
                value = Node("item", [value, self.expression()])
                self.need("]")
            else:
                return value

    def atom(self) -> Node:
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.take("-"):
            return Node("binary", [constant(0), self.atom()], "-")
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends too early")
        kind, text = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return constant(int(text))
        if kind == "string":
            self.at += 1
            return constant(
                re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
            )
        if kind == "name" and text in WORDS:
            self.at += 1
            return constant(WORDS[text])
        return Node("name", [], self.name())


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    while at <= len(source):
        found = MARK.search(source, at)
        text = source[at : found.start() if found else len(source)]
        text = text.lstrip() if strip else text
        if found and found[0].endswith("-"):
            text = text.rstrip()
        if text:
            pieces.append(("text", text))
        if not found:
            break
        opening = found[0].rstrip("-")
        ends = source.find(CLOSE[opening], found.end())
        if ends < 0:
            raise TemplateError(f"{opening!r} is not closed")
        inner = source[found.end() : ends]
        strip = inner.endswith("-") and opening != "{#"
        if opening != "{#":
            pieces.append((opening, inner[:-1] if strip else inner))
        at = ends + 2

    position = 0

    def block(*until: str) -> tuple[Node, str, _Expression | None]:
        nonlocal position
        body: list[Node] = []
        while position < len(pieces):
            kind, inner = pieces[position]
            position += 1
            if kind == "text":
                body.append(Node("print", [constant(inner)]))
                continue
            tokens = _Expression(inner)
            if kind == "{{":
                body.append(Node("print", [tokens.expression()]))
                tokens.end()
                continue
            word = tokens.name()
            if word in until:
                return Node("block", body), word, tokens
            if word == "for":
                variable = tokens.name()
                tokens.need("in")
                items = tokens.expression()
                tokens.end()
                inside, _, _ = block("endfor")
                body.append(Node("for", [items, inside], variable))
            elif word == "if":
                body.append(branch(tokens))
            elif word == "set":
                variable = tokens.name()
                tokens.need("=")
                body.append(Node("set", [tokens.expression()], variable))
                tokens.end()
            elif word == "generation":
                tokens.end()
                inside, _, _ = block("endgeneration")
                body.append(Node("generation", [inside]))
            else:
                raise TemplateError(f"unknown statement {word!r}")
        if until:
            raise TemplateError(f"missing {' or '.join(until)}")
        return Node("block", body), "", None

    def branch(tokens: _Expression) -> Node:
        condition = tokens.expression()
        tokens.end()
        then, word, rest = block("elif", "else", "endif")
        if word == "elif":
            return Node("if", [condition, then, Node("block", [branch(rest)])])
        other = block("endif")[0] if word == "else" else Node("block")
        return Node("if", [condition, then, other])

    return block()[0]


def _plus(a: Any, b: Any) -> Any:
    return a + b


OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "~": lambda a, b: _text(a) + _text(b),
    "+": _plus,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b if isinstance(a, int) and isinstance(b, int) else _refuse("*"),
    "%": lambda a, b: a % b if isinstance(a, int) and isinstance(b, int) else _refuse("%"),
}


def _refuse(op: str) -> Any:
    raise TemplateError(f"{op!r} is for whole numbers")


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    if value is None:
        return None
    raise TemplateError("only mappings and lists have items")


def fold(node: Node, known: Mapping[str, Any]) -> Node:
    """The tree with known names and constant parts worked out, dead branches gone, texts joined."""
    if node.kind == "name":
        return constant(known[node.value]) if node.value in known else node
    if node.kind == "for":
        inner = {k: v for k, v in known.items() if k not in (node.value, "loop")}
        return Node("for", [fold(node.parts[0], known), fold(node.parts[1], inner)], node.value)
    if node.kind == "block":
        body: list[Node] = []
        scope = dict(known)
        for part in node.parts:
            part = fold(part, scope)
            for name in _assigned(part):
                scope.pop(name, None)
            if part.kind == "set" and part.parts[0].kind == "constant":
                scope[part.value] = part.parts[0].value
            flat = part.parts if part.kind == "block" else [part]
            for one in flat:
                if one.kind == "print" and one.parts[0].kind == "constant":
                    text = _text(one.parts[0].value)
                    last = body[-1] if body else None
                    if last and last.kind == "print" and last.parts[0].kind == "constant":
                        body[-1] = Node("print", [constant(last.parts[0].value + text)])
                    elif text:
                        body.append(Node("print", [constant(text)]))
                else:
                    body.append(one)
        return Node("block", body)
    new = Node(node.kind, [fold(p, known) for p in node.parts], node.value)
    if new.kind in ("if", "choice") and new.parts[0].kind == "constant":
        return new.parts[1] if new.parts[0].value else new.parts[2]
    if new.kind in ("binary", "filter", "not", "item", "is") and all(
        p.kind == "constant" for p in new.parts
    ):
        return constant(_expression(new)({}))
    return new


def _assigned(node: Node) -> set[str]:
    own = {node.value} if node.kind == "set" else set()
    return own.union(*(_assigned(p) for p in node.parts))


def names(node: Node) -> set[str]:
    """Names a tree reads."""
    own = {node.value} if node.kind == "name" else set()
    return own.union(*(names(p) for p in node.parts))


def _expression(node: Node) -> Callable[[dict], Any]:
    parts = [_expression(p) for p in node.parts]
    value = node.value
    if node.kind == "constant":
        return lambda env: value
    if node.kind == "name":
        return lambda env: env.get(value)
    if node.kind == "item":
        of, key = parts
        return lambda env: _item(of(env), key(env))
    if node.kind == "not":
        (inner,) = parts
        return lambda env: not inner(env)
    if node.kind == "is":
        (inner,) = parts
        return (lambda env: inner(env) is None) if value == "none" else (lambda env: inner(env) is not None)
    if node.kind == "choice":
        condition, then, other = parts
        return lambda env: then(env) if condition(env) else other(env)
    if node.kind == "filter":
        apply = FILTERS[value]
        return lambda env: apply(*(p(env) for p in parts))
    left, right = parts
    if value == "and":
        return lambda env: left(env) and right(env)
    if value == "or":
        return lambda env: left(env) or right(env)
    operator = OPERATORS[value]
    return lambda env: operator(left(env), right(env))


class Output:
    """Rendered text and the spans (start, length) that the model is to learn."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _statement(node: Node) -> Callable[[dict, Output], None]:
    if node.kind == "print":
        if node.parts[0].kind == "constant":
            text = _text(node.parts[0].value)
            return lambda env, out: out.add(text)
        value = _expression(node.parts[0])
        return lambda env, out: out.add(_text(value(env)))
    if node.kind == "block":
        steps = [_statement(p) for p in node.parts]

        def run_block(env: dict, out: Output) -> None:
            for step in steps:
                step(env, out)

        return run_block
    if node.kind == "set":
        name, value = node.value, _expression(node.parts[0])

        def run_set(env: dict, out: Output) -> None:
            env[name] = value(env)

        return run_set
    if node.kind == "if":
        condition = _expression(node.parts[0])
        then, other = map(_statement, node.parts[1:])
        return lambda env, out: then(env, out) if condition(env) else other(env, out)
    if node.kind == "generation":
        inside = _statement(node.parts[0])

        def run_generation(env: dict, out: Output) -> None:
            began = out.length
            inside(env, out)
            out.spans.append((began, out.length - began))

        return run_generation
    items, inside, name = _expression(node.parts[0]), _statement(node.parts[1]), node.value

    def run_for(env: dict, out: Output) -> None:
        every = list(items(env) or ())
        for i, item in enumerate(every):
            loop = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(every) - 1}
            inside({**env, name: item, "loop": loop}, out)

    return run_for


class Template:
    """A compiled template. ``known`` values are folded into it."""

    def __init__(self, source: str, known: Mapping[str, Any] | None = None):
        self.source, self.known = source, dict(known or {})
        self.tree = fold(parse(source), self.known)
        self._run = _statement(self.tree)

    def __reduce__(self):  # closures do not travel; workers compile the source again
        return Template, (self.source, self.known)

    def render(self, **env: Any) -> Output:
        out = Output()
        self._run(dict(env), out)
        return out

    def by_message(self, over: str = "messages") -> tuple[Callable, Callable, Callable]:
        """Closures (before, message, after), whose outputs in a row equal :meth:`render`.

        They let each message be rendered on its own, wherever it is. Needs one loop over ``over``
        at the top that looks at nothing but its own message.
        """
        loops = [i for i, p in enumerate(self.tree.parts) if p.kind == "for"]
        outside = [p for p in self.tree.parts if p.kind != "for"]
        if len(loops) != 1 or any(over in names(p) for p in outside):
            raise TemplateError(f"the template must loop over {over!r} once")
        loop = self.tree.parts[loops[0]]
        if loop.parts[0].kind != "name" or loop.parts[0].value != over:
            raise TemplateError(f"the template must loop over {over!r}")
        if names(loop.parts[1]) - {loop.value} - _assigned(loop.parts[1]):
            raise TemplateError("the loop must read its own message only")
        run, variable = _statement(loop.parts[1]), loop.value

        def message(item: Mapping[str, Any]) -> Output:
            out = Output()
            run({variable: item}, out)
            return out

        def fixed(parts: list[Node]) -> Callable[[], Output]:
            step = _statement(Node("block", parts))

            def run_fixed() -> Output:
                out = Output()
                step({}, out)
                return out

            return run_fixed

        at = loops[0]
        return fixed(self.tree.parts[:at]), message, fixed(self.tree.parts[at + 1 :])

"""A small template language for conversations, compiled to Python closures.

``{{ expression }}`` puts out a value, ``{% for x in xs %} ... {% endfor %}`` repeats (with ``loop.index``, ``loop.first``,
``loop.last``), ``{% if %} ... {% elif %} ... {% else %} ... {% endif %}`` chooses, ``{% set x = expression %}`` names a value,
``{% generation %} ... {% endgeneration %}`` marks what a model is to learn, ``{# ... #}`` is a comment. A ``-`` inside a
delimiter strips the white space outside it. Expressions have strings, whole numbers, true, false, none, names, ``a.b`` and
``a['b']``, ``== != < > <= >= in``, ``and or not``, ``+`` and ``~`` (joins texts) and filters ``a | f``.

Sandboxed: a template sees only the names given to it, reads only items of mappings, and can call nothing but the
filters given to it. A value that is missing is empty.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Unary:
    op: str
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAGS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
_LEXEMES = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([0-9]+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>()\[\].|+~=-]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def _lexemes(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while source[at:].strip():
        found = _LEXEMES.match(source, at)
        if not found:
            raise TemplateError(f"cannot read {source[at:]!r}")
        text, number, name, sign = found.groups()
        if text is not None:
            out.append(("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)))
        elif number is not None:
            out.append(("const", int(number)))
        elif name is not None:
            out.append(("word", name))
        else:
            out.append(("sign", sign))
        at = found.end()
    return out


class _Expression:
    """Reads one expression by precedence: or, and, not, comparisons, joins, filters, items."""

    def __init__(self, source: str):
        self.left, self.source = _lexemes(source)[::-1], source

    def peek(self, kind: str, *values) -> bool:
        return bool(self.left) and self.left[-1][0] == kind and (not values or self.left[-1][1] in values)

    def take(self, kind: str, *values):
        if not self.peek(kind, *values):
            raise TemplateError(f"expected {values or kind} in {self.source!r}")
        return self.left.pop()[1]

    def whole(self):
        value = self.either()
        if self.left:
            raise TemplateError(f"more than an expression: {self.source!r}")
        return value

    def _chain(self, words: tuple, lower: Callable, kind: str = "word"):
        value = lower()
        while self.peek(kind, *words):
            value = Binary(self.left.pop()[1], value, lower())
        return value

    def either(self):
        return self._chain(("or",), self.both)

    def both(self):
        return self._chain(("and",), self.negated)

    def negated(self):
        if self.peek("word", "not"):
            self.left.pop()
            return Unary("not", self.negated())
        return self.compared()

    def compared(self):
        value = self.joined()
        if self.peek("sign", *_COMPARE) or self.peek("word", "in"):
            value = Binary(self.left.pop()[1], value, self.joined())
        return value

    def joined(self):
        return self._chain(("+", "~"), self.filtered, "sign")

    def filtered(self):
        value = self.item()
        while self.peek("sign", "|"):
            self.left.pop()
            value = Filter(self.take("word"), value)
        return value

    def item(self):
        value = self.single()
        while self.peek("sign", ".", "["):
            if self.left.pop()[1] == ".":
                value = Item(value, Const(self.take("word")))
            else:
                value = Item(value, self.either())
                self.take("sign", "]")
        return value

    def single(self):
        if self.peek("const"):
            return Const(self.left.pop()[1])
        if self.peek("sign", "("):
            self.left.pop()
            value = self.either()
            self.take("sign", ")")
            return value
        word = self.take("word")
        return Const(_WORDS[word]) if word in _WORDS else Name(word)


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content): text, out, tag."""
    out, at, strip = [], 0, False
    for tag in _TAGS.finditer(source):
        kind = next(k for k, i in (("out", 2), ("tag", 5), ("note", 8)) if tag.group(i) is not None)
        before, content, after = tag.group(*{"out": (1, 2, 3), "tag": (4, 5, 6), "note": (7, 8, 9)}[kind])
        text = source[at : tag.start()]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if before else text))
        if kind != "note":
            out.append((kind, content.strip()))
        at, strip = tag.end(), bool(after)
    out.append(("text", source[at:].lstrip() if strip else source[at:]))
    return [piece for piece in out if piece != ("text", "")]


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    pieces = _pieces(source)[::-1]

    def body(*ends: str) -> tuple[tuple, str, str]:
        nodes = []
        while pieces:
            kind, content = pieces.pop()
            if kind == "text":
                nodes.append(Output(Const(content)))
            elif kind == "out":
                nodes.append(Output(_Expression(content).whole()))
            else:
                word, _, rest = content.partition(" ")
                if word in ends:
                    return tuple(nodes), word, rest
                nodes.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(nodes), "", ""

    def statement(word: str, rest: str):
        if word == "for":
            found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not found:
                raise TemplateError(f"cannot read for {rest!r}")
            return For(found[1], _Expression(found[2]).whole(), body("endfor")[0])
        if word == "if":
            branches, condition = [], _Expression(rest).whole()
            while True:
                nodes, end, more = body("elif", "else", "endif")
                branches.append((condition, nodes))
                if end == "endif":
                    return If(tuple(branches))
                if end == "else":
                    return If((*branches, (Const(True), body("endif")[0])))
                condition = _Expression(more).whole()
        if word == "set":
            name, equals, value = rest.partition("=")
            if not equals or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"cannot read set {rest!r}")
            return Set(name.strip(), _Expression(value).whole())
        if word == "generation":
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    return body()[0]


def _text(value) -> str:
    return "" if value is None else str(value)


def _apply(op: str, left, right):
    if op == "+" and isinstance(left, int) and isinstance(right, int):
        return left + right
    if op in "+~":
        return _text(left) + _text(right)
    if op == "in":
        return left in right if isinstance(right, (str, tuple, list, Mapping)) and right else False
    try:
        return _COMPARE[op](left, right)
    except TypeError:
        return False


def fold(node, filters: Mapping[str, Callable]):
    """The tree with constant parts worked out: expressions, branches never taken, neighbouring texts."""
    if isinstance(node, tuple):
        nodes: list = []
        for each in node:
            each = fold(each, filters)
            for part in each if isinstance(each, tuple) else (each,):
                constant = isinstance(part, Output) and isinstance(part.value, Const)
                if constant and not _text(part.value.value):
                    continue
                if constant and nodes and isinstance(nodes[-1], Output) and isinstance(nodes[-1].value, Const):
                    part = Output(Const(_text(nodes.pop().value.value) + _text(part.value.value)))
                nodes.append(part)
        return tuple(nodes)
    if isinstance(node, Output):
        return Output(fold(node.value, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, If):
        branches = []
        for condition, body in node.branches:
            condition = fold(condition, filters)
            if isinstance(condition, Const) and not condition.value:
                continue
            branches.append((condition, fold(body, filters)))
            if isinstance(condition, Const):
                break
        if not branches:
            return ()
        return branches[0][1] if isinstance(branches[0][0], Const) else If(tuple(branches))
    if isinstance(node, Unary):
        of = fold(node.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Unary(node.op, of)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"no filter {node.name!r}")
        of = fold(node.of, filters)
        return Const(filters[node.name](_text(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Binary):
        left, right = fold(node.left, filters), fold(node.right, filters)
        if isinstance(left, Const) and node.op in ("and", "or"):
            return right if bool(left.value) == (node.op == "and") else left
        if isinstance(left, Const) and isinstance(right, Const) and node.op not in ("and", "or"):
            return Const(_apply(node.op, left.value, right.value))
        return Binary(node.op, left, right)
    return node


def _value(node, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    """An expression as a closure of the names."""
    if isinstance(node, Const):
        constant = node.value
        return lambda names: constant
    if isinstance(node, Name):
        name = node.name
        return lambda names: names.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(names):
            held = of(names)
            return held.get(key(names)) if isinstance(held, Mapping) else None

        return item
    if isinstance(node, Unary):
        of = _value(node.of, filters)
        return lambda names: not of(names)
    if isinstance(node, Filter):
        of, apply = _value(node.of, filters), filters[node.name]
        return lambda names: apply(_text(of(names)))
    left, right, op = _value(node.left, filters), _value(node.right, filters), node.op
    if op == "and":
        return lambda names: left(names) and right(names)
    if op == "or":
        return lambda names: left(names) or right(names)
    return lambda names: _apply(op, left(names), right(names))


def _body(nodes: tuple, filters, masked: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """Statements as a closure that yields (text, whether it is to be learnt)."""
    steps = []
    for node in nodes:
        if isinstance(node, Output):
            steps.append(_output(_value(node.value, filters), masked))
        elif isinstance(node, Set):
            steps.append(_set(node.name, _value(node.value, filters)))
        elif isinstance(node, Generation):
            steps.append(_body(node.body, filters, True))
        elif isinstance(node, If):
            steps.append(_if([(_value(c, filters), _body(b, filters, masked)) for c, b in node.branches]))
        else:
            steps.append(_for(node.name, _value(node.over, filters), _body(node.body, filters, masked)))

    def run(names):
        for step in steps:
            yield from step(names)

    return steps[0] if len(steps) == 1 else run


def _output(value, masked):
    def put(names):
        yield _text(value(names)), masked

    return put


def _set(name, value):
    def put(names):
        names[name] = value(names)
        return iter(())

    return put


def _if(branches):
    def choose(names):
        for condition, body in branches:
            if condition(names):
                return body(names)
        return iter(())

    return choose


def _for(name, over, body):
    def repeat(names):
        rest = iter(over(names) or ())
        outer = dict(names)
        index, after = 0, next(rest, _for)
        while after is not _for:
            held, after = after, next(rest, _for)
            index += 1
            names[name] = held
            names["loop"] = {"index": index, "first": index == 1, "last": after is _for}
            yield from body(names)
        for key in (name, "loop"):
            names.pop(key, None)
            if key in outer:
                names[key] = outer[key]

    return repeat


def compile_template(source: str, filters: Mapping[str, Callable[[str], str]]) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of the names a template may see; it yields (text, masked) as it goes, so inputs may be streams."""
    run = _body(fold(parse(source), filters), filters, False)
    return lambda **names: run(dict(names))

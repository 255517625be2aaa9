"""A small sandboxed template language: source text to syntax tree, folded constants, Python closures.

    {{ expression }}      output
    {% for m in list %} ... {% endfor %}      with loop.index0, loop.index, loop.first, loop.last
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}  marks what a model is to learn

Expressions: 'text', numbers, true, false, none, names, a.b and a['b'] (mapping keys only), + == != in not and or,
parentheses and |filters without arguments. Nothing can be called, imported or assigned, and attributes of Python objects are
out of reach.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[().|+\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    """kind with its value and parts, e.g. ("add", None, [left, right])."""

    kind: str
    value: Any = None
    parts: list[Node] = field(default_factory=list)


@dataclass
class Output:
    """Rendered text so far and the (begin, end) of generation spans, in code points."""

    emit: Callable[[str], None]
    at: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.emit(text)
        self.at += len(text)


class _Expression:
    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.tokens, at = filters, [], 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((found.lastindex, found[found.lastindex]))
            at = found.end()
        self.at = 0

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in (3, 4) and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", None, [node, self.both()])
        return node

    def both(self) -> Node:
        node = self.inverse()
        while self.take("and"):
            node = Node("and", None, [node, self.inverse()])
        return node

    def inverse(self) -> Node:
        return Node("not", None, [self.inverse()]) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.summed()
        while sign := self.take("==", "!=", "in"):
            node = Node(sign, None, [node, self.summed()])
        return node

    def summed(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("+", None, [node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.single()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
            if kind != 3 or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            node = Node("filter", name, [node])
        return node

    def single(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            node = Node("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        elif kind == 2:
            node = Node("constant", int(text))
        elif text == "(":
            node = self.either()
            self.need(")")
        elif kind == 3:
            node = Node("constant", _WORDS[text]) if text in _WORDS else Node("name", text)
        else:
            raise TemplateError(f"unexpected {text!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
                if kind != 3:
                    raise TemplateError("a key expected after '.'")
                self.at += 1
                node = Node("key", None, [node, Node("constant", text)])
            else:
                node = Node("key", None, [node, self.either()])
                self.need("]")
        return node


def _key(holder: Any, key: Any) -> Any:
    return holder.get(key) if isinstance(holder, dict) else None


_OPERATIONS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "key": _key,
    "in": lambda a, b: a in b if isinstance(b, (str, list, tuple)) else False,
    "+": lambda a, b: a + b if type(a) is type(b) is int else _text(a) + _text(b),
}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def parse(source: str, filters: dict[str, Callable]) -> Node:
    """The syntax tree of a template."""
    root = Node("block")
    open_blocks: list[tuple[str, Node, Node]] = [("", root, root)]  # (closing word, owner, where children go)

    def fail(word: str):
        raise TemplateError(f"unexpected {{% {word} %}}")

    at = 0
    for tag in _TAG.finditer(source):
        place = open_blocks[-1][2]
        if tag.start() > at:
            place.parts.append(Node("text", source[at: tag.start()]))
        at = tag.end()
        if tag[1] is not None:
            place.parts.append(Node("output", None, [_Expression(tag[1], filters).whole()]))
            continue
        word, _, rest = tag[2].strip().partition(" ")
        if word == "for":
            found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not found:
                fail(tag[2].strip())
            body = Node("block")
            place.parts.append(Node("for", found[1], [_Expression(found[2], filters).whole(), body]))
            open_blocks.append(("endfor", place.parts[-1], body))
        elif word == "generation":
            body = Node("block")
            place.parts.append(Node("generation", None, [body]))
            open_blocks.append(("endgeneration", place.parts[-1], body))
        elif word == "if":
            body = Node("block")
            place.parts.append(Node("if", None, [_Expression(rest, filters).whole(), body]))
            open_blocks.append(("endif", place.parts[-1], body))
        elif word in ("elif", "else"):
            closing, owner, _ = open_blocks.pop()
            if closing != "endif" or len(owner.parts) % 2:
                fail(word)
            body = Node("block")
            owner.parts += [_Expression(rest, filters).whole() if word == "elif" else Node("constant", True), body]
            if word == "else":
                owner.value = "closed"
            elif owner.value == "closed":
                fail(word)
            open_blocks.append(("endif", owner, body))
        elif word and word == open_blocks[-1][0]:
            open_blocks.pop()
        else:
            fail(word)
    if len(open_blocks) > 1:
        raise TemplateError(f"{open_blocks[-1][0]} missing")
    if at < len(source):
        root.parts.append(Node("text", source[at:]))
    return root


def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """The same tree with constant parts computed, dead branches dropped and neighbouring texts joined."""
    parts = [fold(p, filters) for p in node.parts]
    fixed = [p.value for p in parts] if parts and all(p.kind == "constant" for p in parts) else None
    if node.kind in _OPERATIONS and fixed:
        return Node("constant", _OPERATIONS[node.kind](*fixed))
    if node.kind == "filter" and fixed:
        return Node("constant", filters[node.value](_text(fixed[0])))
    if node.kind == "not" and fixed:
        return Node("constant", not fixed[0])
    if node.kind in ("and", "or") and parts[0].kind == "constant":
        return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
    if node.kind == "output" and fixed:
        return Node("text", _text(fixed[0]))
    if node.kind == "if":
        kept: list[Node] = []
        for test, body in zip(parts[::2], parts[1::2]):
            if test.kind == "constant" and not test.value:
                continue
            if test.kind == "constant" and not kept:
                return body
            kept += [test, body]
            if test.kind == "constant":
                break
        return Node("if", None, kept) if kept else Node("block")
    if node.kind == "block":
        flat: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "block" else [p]:
                if q.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + q.value)
                elif q.kind != "text" or q.value:
                    flat.append(q)
        return Node("block", None, flat)
    return Node(node.kind, node.value, parts)


def _value(node: Node, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    """A closure that computes an expression."""
    if node.kind == "constant":
        fixed = node.value
        return lambda scope: fixed
    if node.kind == "name":
        name = node.value
        return lambda scope: scope.get(name)
    parts = [_value(p, filters) for p in node.parts]
    if node.kind == "filter":
        apply, inner = filters[node.value], parts[0]
        return lambda scope: apply(_text(inner(scope)))
    if node.kind == "not":
        inner = parts[0]
        return lambda scope: not inner(scope)
    left, right = parts
    if node.kind == "and":
        return lambda scope: left(scope) and right(scope)
    if node.kind == "or":
        return lambda scope: left(scope) or right(scope)
    operation = _OPERATIONS[node.kind]
    return lambda scope: operation(left(scope), right(scope))


def _with_last(items: Iterable) -> Iterable[tuple[Any, bool]]:
    """Items with a flag for the last one, looking one ahead, so a stream needn't fit in memory."""
    stream = iter(items)
    for held in stream:
        for item in stream:
            yield held, False
            held = item
        yield held, True


def _plain(step: Callable[[dict, Output], None]) -> Callable[[dict, Output], Iterator[None]]:
    def run(scope: dict, out: Output) -> Iterator[None]:
        step(scope, out)
        return iter(())

    return run


def _writer(node: Node, filters: dict[str, Callable]) -> Callable[[dict, Output], Iterator[None]]:
    """A closure that renders a statement; its iterator pauses after each turn of a loop outside generation spans."""
    if node.kind == "text":
        fixed = node.value
        return _plain(lambda scope, out: out.write(fixed))
    if node.kind == "output":
        value = _value(node.parts[0], filters)
        return _plain(lambda scope, out: out.write(_text(value(scope))))
    if node.kind == "block":
        steps = [_writer(p, filters) for p in node.parts]

        def block(scope: dict, out: Output) -> Iterator[None]:
            for step in steps:
                yield from step(scope, out)

        return block
    if node.kind == "generation":
        body = _writer(node.parts[0], filters)

        def generation(scope: dict, out: Output) -> Iterator[None]:
            begin = out.at
            for _ in body(scope, out):
                pass
            out.spans.append((begin, out.at))
            return iter(())

        return generation
    if node.kind == "if":
        branches = [(_value(t, filters), _writer(b, filters)) for t, b in zip(node.parts[::2], node.parts[1::2])]

        def choose(scope: dict, out: Output) -> Iterator[None]:
            for test, body in branches:
                if test(scope):
                    return body(scope, out)
            return iter(())

        return choose
    items, body, name = _value(node.parts[0], filters), _writer(node.parts[1], filters), node.value

    def loop(scope: dict, out: Output) -> Iterator[None]:
        for k, (item, last) in enumerate(_with_last(items(scope) or ())):
            yield from body({**scope, name: item, "loop": {"index0": k, "index": k + 1, "first": k == 0,
                                                           "last": last}}, out)
            yield

    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None
                     ) -> Callable[[dict, Output], Iterator[None]]:
    """A function of (scope, output) for a template; ``TemplateError`` on anything outside the language.

    Rendering goes on as its iterator is used up, so a caller may pass on what is written so far.
    """
    known = {"trim": str.strip, "upper": str.upper, "lower": str.lower, **(filters or {})}
    return _writer(fold(parse(source, known), known), known)

"""XSLT 1.0 over small XML texts, such as json_to_xml makes of parts: a working subset on Python's library.

Paths: all forward and reverse axes but namespace, name tests, text() and node(), predicates, unions, operators, variables
and the core functions named in FUNCTIONS. Instructions: template (match, name, mode, priority), apply-templates,
call-template, with-param, param, variable, value-of, copy-of, copy, for-each, sort, if, choose, text, element, attribute,
comment; attribute value templates; output methods xml, html and text, without a declaration. Anything else is an error
when the stylesheet is read, not when it runs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import escape
from xml.etree import ElementTree

XSL = "{http://www.w3.org/1999/XSL/Transform}"


class Node:
    """A node of kind root, element, attribute, text or comment; name is `{namespace}local` where it has one."""

    __slots__ = ("kind", "name", "text", "attributes", "children", "parent", "order")

    def __init__(self, kind: str, name: str = "", text: str = "", parent: Node | None = None):
        self.kind, self.name, self.text, self.parent = kind, name, text, parent
        self.attributes: list[Node] = []
        self.children: list[Node] = []
        self.order = 0

    def value(self) -> str:
        if self.kind in ("root", "element"):
            return "".join(c.value() for c in self.children if c.kind != "comment")
        return self.text


def parse(text: str) -> tuple[Node, dict[str, str]]:
    """(root node, prefixes) of an XML text; all prefixes of a text share one table."""
    root = Node("root")
    at, spaces = root, {}
    parser = ElementTree.XMLPullParser(("start", "end", "start-ns"))
    parser.feed(text)
    parser.close()
    stack: list[tuple[Node, ElementTree.Element]] = []
    for event, x in parser.read_events():
        if event == "start-ns":
            spaces[x[0]] = x[1]
        elif event == "start":
            at = Node("element", x.tag, parent=at)
            at.attributes = [Node("attribute", k, v, at) for k, v in x.attrib.items()]
            at.parent.children.append(at)
            stack.append((at, x))
        else:
            node, element = stack.pop()
            # texts are whole only now: before the first child, and after each child
            inner = node.children
            node.children = [Node("text", text=element.text, parent=node)] if element.text else []
            for child, e in zip(inner, list(element), strict=True):
                node.children.append(child)
                if e.tail:
                    node.children.append(Node("text", text=e.tail, parent=node))
            at = node.parent
    for i, n in enumerate(_walk(root)):
        n.order = i
    return root, spaces


def _walk(n: Node) -> Iterator[Node]:
    yield n
    yield from n.attributes
    for c in n.children:
        yield from _walk(c)


# XPath

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<string>"[^"]*"|'[^']*')|(?P<var>\$[\w.-]+(?::[\w.-]+)?)|(?P<axis>[a-z-]+)\s*::|(?P<name>[A-Za-z_][\w.-]*(?::(?:[A-Za-z_][\w.-]*|\*))?)|(?P<op>//|\.\.|!=|<=|>=|[/.@()\[\],|=<>+*-]))""")
Context = tuple[Node, int, int, dict]


def to_string(v) -> str:
    if isinstance(v, list):
        return min(v, key=lambda n: n.order).value() if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else str(int(v)) if v == int(v) and not math.isinf(v) else repr(v)
    return v


def to_number(v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return v
    try:
        text = to_string(v).strip()
        return float(text) if re.fullmatch(r"-?(?:\d+(?:\.\d*)?|\.\d+)", text) else math.nan
    except ValueError:
        return math.nan


def to_boolean(v) -> bool:
    if isinstance(v, float):
        return not math.isnan(v) and v != 0
    return bool(v)


def _compare(a, b, test: Callable) -> bool:
    if isinstance(a, list) and isinstance(b, list):
        return any(test(x.value(), y.value()) for x in a for y in b)
    if isinstance(b, list):
        return _compare(b, a, lambda x, y: test(y, x))
    if isinstance(a, list):
        if isinstance(b, bool):
            return test(bool(a), b)
        return any(test(to_number(x.value()) if isinstance(b, float) else x.value(), b) for x in a)
    if isinstance(a, bool) or isinstance(b, bool):
        return test(to_boolean(a), to_boolean(b))
    if isinstance(a, float) or isinstance(b, float):
        return test(to_number(a), to_number(b))
    return test(a, b)


def _substring(s: str, start: float, length: float = math.inf) -> str:
    first = math.floor(start + 0.5) if not math.isnan(start) else math.nan
    last = first + (math.floor(length + 0.5) if not math.isinf(length) else math.inf)
    return "".join(c for i, c in enumerate(s, 1) if first <= i < last)


def _local(v: list[Node]) -> str:
    return v[0].name.rpartition("}")[2] if v else ""


S, N = to_string, to_number
#: functions of their values; those of the context are in _Paths.call
FUNCTIONS: dict[str, Callable] = {
    "count": lambda v: float(len(v)), "not": lambda v: not to_boolean(v), "boolean": to_boolean, "true": lambda: True, "false": lambda: False, "concat": lambda *v: "".join(map(S, v)), "contains": lambda a, b: S(b) in S(a), "starts-with": lambda a, b: S(a).startswith(S(b)),
    "substring-before": lambda a, b: S(a).partition(S(b))[0] if S(b) in S(a) else "", "substring-after": lambda a, b: S(a).partition(S(b))[2], "substring": lambda s, a, n=math.inf: _substring(S(s), N(a), N(n)), "translate": lambda s, a, b: S(s).translate({ord(c): (S(b)[i] if i < len(S(b)) else None) for i, c in reversed(list(enumerate(S(a))))}),
    "sum": lambda v: float(sum(N(x.value()) for x in v)), "floor": lambda v: float(math.floor(N(v))), "ceiling": lambda v: float(math.ceil(N(v))), "round": lambda v: float(math.floor(N(v) + 0.5)),
}
_OPTIONAL = {"string": S, "number": N, "string-length": lambda v: float(len(S(v))), "normalize-space": lambda v: " ".join(S(v).split()), "name": _local, "local-name": _local}
AXES: dict[str, Callable[[Node], list[Node]]] = {}


def axis(name: str):
    def add(f):
        AXES[name] = f
        return f

    return add


axis("child")(lambda n: n.children)
axis("attribute")(lambda n: n.attributes)
axis("self")(lambda n: [n])
axis("parent")(lambda n: [n.parent] if n.parent else [])
axis("descendant")(lambda n: [x for c in n.children for x in _walk(c) if x.kind != "attribute"])
axis("descendant-or-self")(lambda n: [n, *AXES["descendant"](n)])


@axis("ancestor")
def _ancestors(n: Node) -> list[Node]:
    out = []
    while n.parent:
        n = n.parent
        out.append(n)
    return out


axis("ancestor-or-self")(lambda n: [n, *_ancestors(n)])


def _siblings(n: Node) -> tuple[list[Node], list[Node]]:
    if n.parent is None or n.kind == "attribute":
        return [], []
    i = next(i for i, c in enumerate(n.parent.children) if c is n)
    return n.parent.children[:i][::-1], n.parent.children[i + 1 :]


axis("preceding-sibling")(lambda n: _siblings(n)[0])
axis("following-sibling")(lambda n: _siblings(n)[1])


class _Paths:
    """A parser of one XPath expression into a function of a context (node, position, size, variables)."""

    def __init__(self, text: str, spaces: dict[str, str]):
        self.text, self.spaces, self.tokens, self.at = text, spaces, [], 0
        i = 0
        while i < len(text.rstrip()):
            m = _TOKEN.match(text, i)
            if not m:
                raise ValueError(f"can't read path {text!r} at {i}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            i = m.end()

    def see(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def kind(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("", "")

    def need(self, value: str) -> None:
        if not self.see(value):
            raise ValueError(f"{value} expected in path {self.text!r}")
        self.at += 1

    def whole(self) -> Callable[[Context], object]:
        out = self.binary(0)
        if self.at != len(self.tokens):
            raise ValueError(f"can't read path {self.text!r}")
        return out

    LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"), ("|",))

    def binary(self, level: int) -> Callable:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.see(*self.LEVELS[level]):
            op = self.kind()[1]
            self.at += 1
            left = self.operator(op, left, self.binary(level + 1))
        return left

    @staticmethod
    def operator(op: str, a: Callable, b: Callable) -> Callable:
        if op == "or":
            return lambda c: to_boolean(a(c)) or to_boolean(b(c))
        if op == "and":
            return lambda c: to_boolean(a(c)) and to_boolean(b(c))
        if op == "|":
            return lambda c: sorted({id(n): n for n in [*a(c), *b(c)]}.values(), key=lambda n: n.order)
        if op in ("=", "!="):
            return lambda c: _compare(a(c), b(c), (lambda x, y: x == y) if op == "=" else (lambda x, y: x != y))
        if op in ("<", "<=", ">", ">="):
            order = {"<": lambda x, y: N(x) < N(y), "<=": lambda x, y: N(x) <= N(y), ">": lambda x, y: N(x) > N(y), ">=": lambda x, y: N(x) >= N(y)}[op]
            return lambda c: _compare(a(c), b(c), order)
        calc = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "div": lambda x, y: x / y if y else math.nan if x == 0 or math.isnan(x) else math.copysign(math.inf, x), "mod": lambda x, y: math.fmod(x, y) if y else math.nan}[op]
        return lambda c: calc(N(a(c)), N(b(c)))

    def unary(self) -> Callable:
        if self.see("-"):
            self.at += 1
            inner = self.unary()
            return lambda c: -N(inner(c))
        return self.path()

    def path(self) -> Callable:
        kind, text = self.kind()
        if kind == "number":
            self.at += 1
            number = float(text)
            return lambda c: number
        if kind == "string":
            self.at += 1
            return lambda c: text[1:-1]
        start: Callable | None = None
        if kind == "var":
            self.at += 1
            start = lambda c: c[3][text[1:]]
        elif self.see("("):
            self.need("(")
            start = self.binary(0)
            self.need(")")
        elif kind == "name" and self.kind(1) == ("op", "(") and text not in ("text", "node", "comment"):
            start = self.call(text)
        if start is not None:
            tests = self.predicates()
            first = start
            start = (lambda c: _filter(first(c), tests, c[3])) if tests else first
            if not self.see("/", "//"):
                return start
            steps = []
        elif self.see("/", "//"):
            start = lambda c: [_ancestors(c[0])[-1] if c[0].parent else c[0]]
            if self.see("/") and not (self.kind(1)[0] in ("name", "axis") or self.kind(1)[1] in (".", "..", "@", "*")):
                self.at += 1
                return start
            steps = []
        else:
            start = lambda c: [c[0]]
            steps = [self.step()]
        while self.see("/", "//"):
            if self.see("//"):
                steps.append((AXES["descendant-or-self"], lambda n: True, []))
            self.at += 1
            steps.append(self.step())

        def run(c: Context) -> list[Node]:
            nodes = start(c)
            for walk, test, tests in steps:
                found: dict[int, Node] = {}
                for n in nodes:
                    for x in _filter([x for x in walk(n) if test(x)], tests, c[3]):
                        found[id(x)] = x
                nodes = list(found.values())
            return sorted(nodes, key=lambda n: n.order)

        return run

    def step(self) -> tuple[Callable, Callable, list]:
        if self.see("."):
            self.at += 1
            return AXES["self"], lambda n: True, []
        if self.see(".."):
            self.at += 1
            return AXES["parent"], lambda n: True, []
        name = "child"
        if self.see("@"):
            self.at += 1
            name = "attribute"
        elif self.kind()[0] == "axis":
            name = self.kind()[1]
            self.at += 1
        if name not in AXES:
            raise ValueError(f"no axis {name}")
        return AXES[name], self.test("attribute" if name == "attribute" else "element"), self.predicates()

    def test(self, principal: str) -> Callable[[Node], bool]:
        kind, text = self.kind()
        if self.see("*"):
            self.at += 1
            return lambda n: n.kind == principal
        if kind != "name":
            raise ValueError(f"a name expected in path {self.text!r}")
        self.at += 1
        if self.see("(") and text in ("text", "node", "comment"):
            self.need("(")
            self.need(")")
            return (lambda n: True) if text == "node" else lambda n: n.kind == text
        prefix, colon, local = text.rpartition(":")
        if colon and prefix not in self.spaces:
            raise ValueError(f"unknown prefix {prefix}")
        if local == "*":
            return lambda n: n.kind == principal and n.name.startswith("{" + self.spaces[prefix] + "}")
        full = f"{{{self.spaces[prefix]}}}{local}" if colon else text
        return lambda n: n.kind == principal and n.name == full

    def predicates(self) -> list[Callable]:
        out = []
        while self.see("["):
            self.need("[")
            out.append(self.binary(0))
            self.need("]")
        return out

    def call(self, name: str) -> Callable:
        self.at += 1
        self.need("(")
        args = []
        while not self.see(")"):
            args.append(self.binary(0))
            if not self.see(")"):
                self.need(",")
        self.need(")")
        if name == "position":
            return lambda c: float(c[1])
        if name == "last":
            return lambda c: float(c[2])
        if name == "current":
            return lambda c: c[3].get("", [c[0]])
        if name in _OPTIONAL:
            f = _OPTIONAL[name]
            return lambda c: f(args[0](c) if args else [c[0]])
        if name not in FUNCTIONS:
            raise ValueError(f"no function {name}")
        g = FUNCTIONS[name]
        return lambda c: g(*(a(c) for a in args))


def _filter(nodes, tests: list[Callable], variables: dict):
    for t in tests:
        kept = []
        for i, n in enumerate(nodes, 1):
            v = t((n, i, len(nodes), variables))
            if (v == i) if isinstance(v, float) else to_boolean(v):
                kept.append(n)
        nodes = kept
    return nodes


# stylesheets

Out = list  # of Node


class Stylesheet:
    """A stylesheet, read once; transform() applies it to a text."""

    def __init__(self, text: str):
        root, self.spaces = parse(text)
        top = root.children[0]
        if top.name not in (f"{XSL}stylesheet", f"{XSL}transform"):
            raise ValueError("not a stylesheet")
        self.method, self.named, self.rules, self.globals = "xml", {}, [], []
        for n, e in enumerate(c for c in top.children if c.kind == "element"):
            a = self._attributes(e)
            if e.name == f"{XSL}template":
                body = self._body(e)
                if "name" in a:
                    self.named[a["name"]] = body
                for part in _unions(a["match"]) if "match" in a else []:
                    priority = float(a["priority"]) if "priority" in a else 0.5 if re.search(r"[/\[]", part) and part != "/" else -0.5 if re.fullmatch(r"@?(?:\*|[a-z]+\(\)|\w+:\*)", part) else 0.0
                    self.rules.append((priority, n, a.get("mode"), _Paths(part, self.spaces).whole(), body))
            elif e.name in (f"{XSL}variable", f"{XSL}param"):
                self.globals.append(self._instruction(e))
            elif e.name == f"{XSL}output":
                self.method = a.get("method", "xml")
            elif e.name not in (f"{XSL}strip-space", f"{XSL}preserve-space"):
                raise ValueError(f"{e.name} isn't supported")
        self.rules.sort(key=lambda r: (-r[0], -r[1]))

    @staticmethod
    def _attributes(e: Node) -> dict[str, str]:
        return {a.name: a.text for a in e.attributes}

    def _path(self, text: str) -> Callable:
        return _Paths(text, self.spaces).whole()

    def _template(self, text: str) -> Callable[[Context], str]:
        parts = re.split(r"(\{\{|\}\}|\{[^{}]*\})", text)
        made = [(lambda c, p=p: p[0]) if p in ("{{", "}}") else (lambda c, f=self._path(p[1:-1]): S(f(c))) if p.startswith("{") else (lambda c, p=p: p) for p in parts if p]
        return lambda c: "".join(m(c) for m in made)

    def _body(self, e: Node) -> Callable[[Context, Out], None]:
        made = []
        for c in e.children:
            if c.kind == "text":
                if c.text.strip():
                    made.append(lambda ctx, out, t=c.text: _text(out, t))
            elif c.kind == "element" and c.name != f"{XSL}sort":
                made.append(self._instruction(c))

        def run(c: Context, out: Out) -> None:
            scope = (c[0], c[1], c[2], dict(c[3]))
            for m in made:
                m(scope, out)

        return run

    def _sorts(self, e: Node) -> Callable[[list[Node], dict], list[Node]]:
        keys = []
        for x in e.children:
            if x.name == f"{XSL}sort":
                a = self._attributes(x)
                keys.append((self._path(a.get("select", ".")), a.get("data-type") == "number", a.get("order") == "descending"))

        def run(nodes: list[Node], variables: dict) -> list[Node]:
            for f, numeric, down in reversed(keys):
                def key(n: Node, f=f, numeric=numeric):
                    v = f((n, 1, 1, variables))
                    return (math.isnan(N(v)), N(v)) if numeric else S(v)

                nodes = sorted(nodes, key=key, reverse=down)
            return nodes

        return run

    def _instruction(self, e: Node) -> Callable[[Context, Out], None]:
        a = self._attributes(e)
        if not e.name.startswith(XSL):
            attributes = [(x.name, self._template(x.text)) for x in e.attributes]
            body = self._body(e)

            def literal(c: Context, out: Out) -> None:
                node = Node("element", e.name)
                for k, f in attributes:
                    _attribute(node, k, f(c))
                _fill(node, body, c)
                out.append(node)

            return literal
        kind = e.name[len(XSL) :]
        maker = getattr(self, "_do_" + kind.replace("-", "_"), None)
        if maker is None:
            raise ValueError(f"{kind} isn't supported")
        return maker(e, a)

    def _do_value_of(self, e, a):
        f = self._path(a["select"])
        return lambda c, out: _text(out, S(f(c)))

    def _do_text(self, e, a):
        text = e.value()
        return lambda c, out: _text(out, text)

    def _do_if(self, e, a):
        test, body = self._path(a["test"]), self._body(e)
        return lambda c, out: body(c, out) if to_boolean(test(c)) else None

    def _do_choose(self, e, a):
        cases = [(self._path(self._attributes(x)["test"]) if x.name == f"{XSL}when" else lambda c: True, self._body(x)) for x in e.children if x.kind == "element"]

        def run(c: Context, out: Out) -> None:
            for test, body in cases:
                if to_boolean(test(c)):
                    body(c, out)
                    return

        return run

    def _do_for_each(self, e, a):
        select, body, sort = self._path(a["select"]), self._body(e), self._sorts(e)

        def run(c: Context, out: Out) -> None:
            nodes = sort(select(c), c[3])
            for i, n in enumerate(nodes, 1):
                body((n, i, len(nodes), c[3] | {"": [n]}), out)

        return run

    def _do_variable(self, e, a):
        f, body, name = self._path(a["select"]) if "select" in a else None, self._body(e), a["name"]

        def run(c: Context, out: Out) -> None:
            c[3][name] = f(c) if f else "".join(n.value() for n in _collected(body, c))

        return run

    def _do_param(self, e, a):
        make = self._do_variable(e, a)
        return lambda c, out: c[3].__setitem__(a["name"], c[3]["#" + a["name"]]) if "#" + a["name"] in c[3] else make(c, out)

    def _params(self, e: Node) -> Callable[[Context], dict]:
        made = [(self._attributes(x)["name"], self._do_variable(x, self._attributes(x))) for x in e.children if x.name == f"{XSL}with-param"]

        def run(c: Context) -> dict:
            out = {}
            for name, f in made:
                scope = (c[0], c[1], c[2], dict(c[3]))
                f(scope, [])
                out["#" + name] = scope[3][name]
            return out

        return run

    def _do_call_template(self, e, a):
        params, name = self._params(e), a["name"]

        def run(c: Context, out: Out) -> None:
            self.named[name]((c[0], c[1], c[2], self.start | params(c)), out)

        return run

    def _do_apply_templates(self, e, a):
        select, sort, params = self._path(a.get("select", "node()")), self._sorts(e), self._params(e)
        return lambda c, out: self._apply(sort(select(c), c[3]), a.get("mode"), params(c), out)

    def _do_element(self, e, a):
        name, body = self._template(a["name"]), self._body(e)

        def run(c: Context, out: Out) -> None:
            node = Node("element", self._name(name(c)))
            _fill(node, body, c)
            out.append(node)

        return run

    def _name(self, text: str) -> str:
        prefix, colon, local = text.rpartition(":")
        return f"{{{self.spaces[prefix]}}}{local}" if colon and prefix in self.spaces else text

    def _do_attribute(self, e, a):
        name, body = self._template(a["name"]), self._body(e)
        return lambda c, out: out.append(Node("attribute", self._name(name(c)), "".join(n.value() for n in _collected(body, c))))

    def _do_comment(self, e, a):
        body = self._body(e)
        return lambda c, out: out.append(Node("comment", text="".join(n.value() for n in _collected(body, c))))

    def _do_copy(self, e, a):
        body = self._body(e)

        def run(c: Context, out: Out) -> None:
            n = c[0]
            if n.kind == "element":
                node = Node("element", n.name)
                _fill(node, body, c)
                out.append(node)
            elif n.kind == "root":
                body(c, out)
            elif n.kind == "text":
                _text(out, n.text)
            else:
                out.append(Node(n.kind, n.name, n.text))

        return run

    def _do_copy_of(self, e, a):
        f = self._path(a["select"])

        def run(c: Context, out: Out) -> None:
            v = f(c)
            if isinstance(v, list):
                out.extend(y for x in v for y in (x.children if x.kind == "root" else [x]))
            else:
                _text(out, S(v))

        return run

    def _apply(self, nodes: list[Node], mode: str | None, params: dict, out: Out) -> None:
        for i, n in enumerate(nodes, 1):
            variables = self.start | {"": [n]} | params
            for _, _, m, pattern, body in self.rules:
                if m == mode and any(x is n for at in [n, *_ancestors(n)] for x in pattern((at, 1, 1, variables))):
                    body((n, i, len(nodes), variables), out)
                    break
            else:
                if n.kind in ("root", "element"):
                    self._apply(n.children, mode, {}, out)
                elif n.kind in ("text", "attribute"):
                    _text(out, n.text)

    def transform(self, text: str) -> str:
        root, _ = parse(text)
        self.start: dict = {}
        for g in self.globals:
            g((root, 1, 1, self.start), [])
        out: Out = []
        self._apply([root], None, {}, out)
        if self.method == "text":
            return "".join(n.value() for n in out)
        prefixes = {v: k for k, v in self.spaces.items()}
        return "".join(_write(n, prefixes, frozenset(), self.method) for n in out)


def _unions(pattern: str) -> list[str]:
    out, depth = [""], 0
    for ch in pattern:
        depth += (ch in "[(") - (ch in "])")
        if ch == "|" and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [p.strip() for p in out]


def _text(out: Out, text: str) -> None:
    if text:
        out.append(Node("text", text=text))


def _attribute(node: Node, name: str, value: str) -> None:
    node.attributes = [x for x in node.attributes if x.name != name] + [Node("attribute", name, value)]


def _collected(body: Callable, c: Context) -> Out:
    out: Out = []
    body(c, out)
    return out


def _fill(node: Node, body: Callable, c: Context) -> None:
    for x in _collected(body, c):
        if x.kind == "attribute":
            _attribute(node, x.name, x.text)
        else:
            node.children.append(x)


_VOID = {"area", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}


def _write(n: Node, prefixes: dict[str, str], known: frozenset[str], method: str) -> str:
    if n.kind in ("text", "attribute"):
        return escape(n.text, False)
    if n.kind == "comment":
        return f"<!--{n.text}-->"
    added: list[str] = []

    def name(full: str, element: bool) -> str:
        space, brace, local = full[1:].partition("}") if full.startswith("{") else ("", "", full)
        if not brace:
            return local
        prefix = "xml" if space == "http://www.w3.org/XML/1998/namespace" else prefixes.get(space, "")
        if prefix != "xml" and space not in known and space not in added and (element or prefix):
            added.append(space)
        return f"{prefix}:{local}" if prefix else local

    tag = name(n.name, True)
    attributes = "".join(f' {name(a.name, False)}="{escape(a.text)}"' for a in n.attributes)
    spaces = "".join(f' xmlns{":" + prefixes[s] if prefixes.get(s) else ""}="{escape(s)}"' for s in added)
    inner = "".join(_write(c, prefixes, known | set(added), method) for c in n.children)
    if inner:
        return f"<{tag}{spaces}{attributes}>{inner}</{tag}>"
    if method == "html":
        return f"<{tag}{spaces}{attributes}>" + ("" if tag.lower() in _VOID else f"</{tag}>")
    return f"<{tag}{spaces}{attributes} />"


@lru_cache(maxsize=100)
def stylesheet(text: str) -> Stylesheet:
    return Stylesheet(text)


def transform(xml: str, sheet: str) -> str | None:
    """xml by a stylesheet; null if xml can't be parsed."""
    try:
        return stylesheet(sheet).transform(xml)
    except ElementTree.ParseError:
        return None

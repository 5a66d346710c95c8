"""Selection from JSON values in the JMESPath language, by its public grammar: a precedence parser to closures."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

Select = Callable[[object], object]

_TOKENS = re.compile(
    r"""\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<raw>'(?:[^'\\]|\\.)*')|(?P<literal>`(?:[^`\\]|\\.)*`)|(?P<number>-?\d+)|(?P<op>\[\?|\[\]|\|\||&&|==|!=|<=|>=|[.,:@&(){}\[\]*|<>!]))"""
)
#: fixed values: how strongly what stands after an operator binds
_BINDING = {"|": 1, "||": 2, "&&": 3, "==": 5, "!=": 5, "<": 5, "<=": 5, ">": 5, ">=": 5, "[]": 9, "*": 20, "[?": 21, ".": 40, "!": 45, "{": 50, "[": 55, "(": 60}


def _true(v) -> bool:
    return not (v is None or v is False or v == "" or v == [] or v == {})


def _same(a, b) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _kind(v) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if _number(v) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _to_number(v):
    if _number(v):
        return v
    try:
        return int(v) if isinstance(v, str) and re.fullmatch(r"[+-]?\d+", v) else float(v) if isinstance(v, str) else None
    except ValueError:
        return None


def _ordered(xs, key: Select = lambda x: x, pick=sorted):
    keys = [key(x) for x in xs]
    if not (all(map(_number, keys)) or all(isinstance(k, str) for k in keys)):
        raise ValueError("only numbers or texts have an order")
    return pick(xs, key=key) if xs or pick is sorted else None


FUNCTIONS: dict[str, Callable] = {
    "abs": abs, "avg": lambda xs: sum(xs) / len(xs) if xs else None, "ceil": lambda x: -int(-x // 1), "floor": lambda x: int(x // 1), "sum": sum, "length": len, "keys": lambda o: list(o), "values": lambda o: list(o.values()),
    "contains": lambda a, b: b in a, "starts_with": lambda a, b: a.startswith(b), "ends_with": lambda a, b: a.endswith(b), "join": lambda glue, xs: glue.join(xs), "map": lambda f, xs: [f(x) for x in xs],
    "max": lambda xs: _ordered(xs, pick=max), "min": lambda xs: _ordered(xs, pick=min), "max_by": lambda xs, f: _ordered(xs, f, max), "min_by": lambda xs, f: _ordered(xs, f, min), "sort": lambda xs: _ordered(xs), "sort_by": lambda xs, f: _ordered(xs, f),
    "merge": lambda *os: {k: v for o in os for k, v in o.items()}, "not_null": lambda *xs: next((x for x in xs if x is not None), None), "reverse": lambda x: x[::-1], "to_array": lambda x: x if isinstance(x, list) else [x], "to_string": _text, "to_number": _to_number, "type": _kind,
}


class _Parser:
    def __init__(self, path: str):
        self.path, self.tokens, at = path, [], 0
        text = path.rstrip()
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise ValueError(f"can't read {path!r} at {at}")
            self.tokens.append((m.lastgroup if m.lastgroup != "op" else m.group("op"), m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i][0] if i < len(self.tokens) else None

    def take(self, *kinds: str) -> str:
        if self.peek() not in kinds:
            raise ValueError(f"{self.path!r}: {' or '.join(kinds)} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Select:
        out = self.expression(0)
        if self.peek() is not None:
            raise ValueError(f"{self.path!r}: nothing expected after {self.tokens[self.at - 1][1]!r}")
        return out

    def expression(self, binding: int) -> Select:
        left = self.first()
        while (b := _BINDING.get(self.peek() or "", 0)) > binding:
            left = self.then(left, b)
        return left

    def first(self) -> Select:
        kind = self.peek()
        if kind == "name":
            name = self.take("name")
            return self.call(name) if self.peek() == "(" else self.field(name)
        if kind == "quoted":
            return self.field(json.loads(self.take("quoted")))
        if kind == "raw":
            text = self.take("raw")[1:-1].replace("\\'", "'")
            return lambda v: text
        if kind == "literal":
            value = self.literal(self.take("literal")[1:-1].replace("\\`", "`"))
            return lambda v: value
        if kind == "@":
            self.take("@")
            return lambda v: v
        if kind == "!":
            self.take("!")
            inner = self.expression(_BINDING["!"])
            return lambda v: not _true(inner(v))
        if kind == "&":
            self.take("&")
            inner = self.expression(0)
            return lambda v: inner
        if kind == "(":
            self.take("(")
            inner = self.expression(0)
            self.take(")")
            return inner
        if kind == "{":
            return self.members()
        if kind == "[" and self.peek(1) not in ("number", ":") and not (self.peek(1) == "*" and self.peek(2) == "]"):
            return self.items()
        if kind in ("*", "[", "[]", "[?"):
            return self.then(lambda v: v, _BINDING[kind])
        raise ValueError(f"{self.path!r}: nothing to select")

    @staticmethod
    def literal(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return text

    @staticmethod
    def field(name: str) -> Select:
        return lambda v: v.get(name) if isinstance(v, dict) else None

    def then(self, left: Select, binding: int) -> Select:
        kind = self.peek()
        if kind == ".":
            self.take(".")
            if self.peek() == "*":
                return self.then(left, _BINDING["*"])
            right = self.after_dot(binding)
            return lambda v: None if (x := left(v)) is None else right(x)
        if kind == "*":
            self.take("*")
            return self.projected(lambda v: list(x.values()) if isinstance(x := left(v), dict) else None, binding)
        if kind == "[]":
            self.take("[]")
            return self.projected(lambda v: [z for y in x for z in (y if isinstance(y, list) else [y])] if isinstance(x := left(v), list) else None, binding)
        if kind == "[?":
            self.take("[?")
            test = self.expression(0)
            self.take("]")
            return self.projected(lambda v: [y for y in x if _true(test(y))] if isinstance(x := left(v), list) else None, binding)
        if kind == "[":
            self.take("[")
            if self.peek() == "*":
                self.take("*")
                self.take("]")
                return self.projected(lambda v: x if isinstance(x := left(v), list) else None, _BINDING["*"])
            return self.index(left)
        self.take(kind)
        right = self.expression(binding)
        if kind == "|":
            return lambda v: right(left(v))
        if kind == "||":
            return lambda v: x if _true(x := left(v)) else right(v)
        if kind == "&&":
            return lambda v: right(v) if _true(x := left(v)) else x
        if kind in ("==", "!="):
            return lambda v: _same(left(v), right(v)) == (kind == "==")
        if kind in ("<", "<=", ">", ">="):
            order = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[kind]
            return lambda v: order(a, b) if _number(a := left(v)) and _number(b := right(v)) else None
        raise ValueError(f"{self.path!r}: {kind} isn't expected here")

    def index(self, left: Select) -> Select:
        parts: list[int | None] = [None]
        while self.peek() != "]":
            if self.peek() == ":":
                self.take(":")
                parts.append(None)
            else:
                parts[-1] = int(self.take("number"))
        self.take("]")
        if len(parts) == 1:
            i = parts[0]
            if i is None:
                raise ValueError(f"{self.path!r}: a number expected")
            return lambda v: x[i] if isinstance(x := left(v), list) and -len(x) <= i < len(x) else None
        if len(parts) > 3 or parts[2:] == [0]:
            raise ValueError(f"{self.path!r}: no such slice")
        cut = slice(*parts)
        return self.projected(lambda v: x[cut] if isinstance(x := left(v), list) else None, _BINDING["*"])

    def projected(self, source: Select, binding: int) -> Select:
        kind = self.peek()
        if _BINDING.get(kind or "", 0) < 10:
            right: Select = lambda v: v
        elif kind == ".":
            self.take(".")
            right = self.after_dot(binding)
        else:
            right = self.expression(binding)
        return lambda v: [y for x in xs if (y := right(x)) is not None] if (xs := source(v)) is not None else None

    def after_dot(self, binding: int) -> Select:
        if self.peek() in ("name", "quoted", "*"):
            return self.expression(binding)
        if self.peek() == "{":
            return self.members()
        if self.peek() == "[":
            return self.items()
        raise ValueError(f"{self.path!r}: a name expected after the dot")

    def members(self) -> Select:
        self.take("{")
        pairs = []
        while True:
            key = self.take("name", "quoted")
            key = json.loads(key) if key.startswith('"') else key
            self.take(":")
            pairs.append((key, self.expression(0)))
            if self.take(",", "}") == "}":
                return lambda v: None if v is None else {k: f(v) for k, f in pairs}

    def items(self) -> Select:
        self.take("[")
        out = []
        while True:
            out.append(self.expression(0))
            if self.take(",", "]") == "]":
                return lambda v: None if v is None else [f(v) for f in out]

    def call(self, name: str) -> Select:
        if name not in FUNCTIONS:
            raise ValueError(f"{self.path!r}: no function {name}")
        self.take("(")
        args: list[Select] = []
        while self.peek() != ")":
            args.append(self.expression(0))
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        f = FUNCTIONS[name]

        def run(v):
            try:
                return f(*(a(v) for a in args))
            except (TypeError, AttributeError, ValueError):
                return None

        return run


@lru_cache(maxsize=1000)
def compile_path(path: str) -> Select:
    """A function of a JSON value by a path; ValueError for a path that can't be read.

    A function of the language that is given a value of the wrong type selects null, so that one odd row stops no job.
    """
    return _Parser(path).whole()

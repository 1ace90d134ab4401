"""Scripts of the rule language, a typed subset of CEL, compiled to columns. What is not supported fails when it is compiled.

Supported: literals, names with dots, ``map["k"]`` and list indices, ``? :``, ``&& || !``, comparisons, arithmetic, ``in``, casts
(int, double, string, bool), size, coalesce, nullif, min and max of lists, text methods (zero-based, -1 for not found), map methods
(has, get, getOrDefault, getOrKeep), and the list macros map, filter, exists and all.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import text as T


class ScriptError(ValueError):
    """The script cannot be compiled."""


_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>!?:.,()\[\]{}]))"""
)
_LEVELS = [["||"], ["&&"], ["==", "!=", "<", "<=", ">", ">=", "in"], ["+", "-"], ["*", "/", "%"]]
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}


def tokens(script: str) -> list[tuple[str, str]]:
    found, at = [], 0
    while at < len(script):
        if not script[at:].strip():
            break
        m = _TOKEN.match(script, at)
        if not m:
            raise ScriptError(f"cannot read {script[at:]!r}")
        found.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return [*found, ("end", "")]


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    children: tuple = ()


class _Parser:
    def __init__(self, script: str):
        self.tokens, self.at = tokens(script), 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] in ("op", "name", "end") else ""

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if wanted is not None and token[1] != wanted:
            raise ScriptError(f"expected {wanted!r}, found {token[1]!r}")
        self.at += 1
        return token

    def whole(self) -> Node:
        node = self.ternary()
        if self.tokens[self.at][0] != "end":
            raise ScriptError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def ternary(self) -> Node:
        node = self.binary(0)
        if self.peek() == "?" and self.tokens[self.at][0] == "op":
            self.take()
            yes = self.ternary()
            self.take(":")
            return Node("if", None, (node, yes, self.ternary()))
        return node

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.unary()
        node = self.binary(level + 1)
        while self.tokens[self.at][0] in ("op", "name") and self.peek() in _LEVELS[level]:
            op = self.take()[1]
            node = Node("op", op, (node, self.binary(level + 1)))
        return node

    def unary(self) -> Node:
        if self.tokens[self.at] in (("op", "!"), ("op", "-")):
            op = self.take()[1]
            return Node("unary", op, (self.unary(),))
        return self.postfix()

    def arguments(self, end: str) -> tuple[Node, ...]:
        items = []
        while self.peek() != end:
            items.append(self.ternary())
            if self.peek() == ",":
                self.take()
            elif self.peek() != end:
                raise ScriptError(f"expected {end!r}")
        self.take(end)
        return tuple(items)

    def postfix(self) -> Node:
        node = self.primary()
        while self.tokens[self.at][0] == "op" and self.peek() in (".", "[", "("):
            op = self.take()[1]
            if op == "[":
                node = Node("index", None, (node, self.ternary()))
                self.take("]")
            elif op == "(":
                if node.kind != "name":
                    raise ScriptError("only names can be called")
                node = Node("call", node.value, self.arguments(")"))
            else:
                kind, name = self.take()
                if kind != "name":
                    raise ScriptError(f"unexpected {name!r} after a dot")
                if self.tokens[self.at] == ("op", "("):
                    self.take()
                    node = Node("method", name, (node, *self.arguments(")")))
                else:
                    node = Node("field", name, (node,))
        return node

    def primary(self) -> Node:
        kind, value = self.take()
        if kind == "number":
            return Node("literal", float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "text":
            return Node("literal", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m.group(1), m.group(1)), value[1:-1]))
        if kind == "name":
            return Node("literal", {"true": True, "false": False, "null": None}[value]) if value in ("true", "false", "null") else Node("name", value)
        if value == "(":
            node = self.ternary()
            self.take(")")
            return node
        if value == "[":
            return Node("list", None, self.arguments("]"))
        raise ScriptError(f"unexpected {value!r}")


def parse(script: str) -> Node:
    return _Parser(script).whole()


def _path(node: Node) -> str | None:
    if node.kind == "name":
        return node.value
    if node.kind == "field" and (base := _path(node.children[0])):
        return f"{base}.{node.value}"
    return None


def _literal(node: Node):
    if node.kind != "literal":
        raise ScriptError("a literal is needed here")
    return node.value


Bindings = dict[str, "Column | Callable | str | int | float | bool"]


def compile_node(node: Node, names: Bindings) -> Column:
    c = lambda n: compile_node(n, names)
    match node.kind:
        case "literal":
            return F.lit(node.value)
        case "list":
            return F.array(*map(c, node.children))
        case "name" | "field":
            path = _path(node)
            if path in names:
                bound = names[path]
                return bound if isinstance(bound, Column) else F.lit(bound)
            if node.kind == "field" and _path(node.children[0]) in names:
                return F.try_element_at(c(node.children[0]), F.lit(node.value))
            raise ScriptError(f"unknown name {path!r}; known are {sorted(names)}")
        case "index":
            base, at = node.children
            return F.try_element_at(c(base), c(at)) if not (at.kind == "literal" and isinstance(at.value, int)) else F.get(c(base), F.lit(at.value))
        case "if":
            test, yes, no = map(c, node.children)
            return F.when(test, yes).otherwise(no)
        case "unary":
            return ~c(node.children[0]) if node.value == "!" else -c(node.children[0])
        case "op":
            if node.value == "+" and is_text(node):
                return F.concat(*[c(n).cast("string") for n in node.children])
            return _operator(node.value, *map(c, node.children))
        case "call":
            return _call(node.value, node.children, names)
        case "method":
            return _method(node.value, node.children[0], node.children[1:], names)
    raise ScriptError(f"cannot compile {node.kind}")


def _operator(op: str, a: Column, b: Column) -> Column:
    made = {
        "||": lambda: a | b, "&&": lambda: a & b, "==": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b), "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
        "in": lambda: F.coalesce(F.array_contains(b, a), F.lit(False)), "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "+": lambda: a + b,
    }
    return made[op]()


_TEXT_METHODS = {"lowerAscii", "upperAscii", "trim", "charAt", "join", "replace", "replaceRegex", "substring", "get", "getOrDefault", "getOrKeep"}
_TEXT_NAMES = {"match_key", "match_value", "feature.source", "feature.source_layer", "feature.osm_type"}


def is_text(node: Node) -> bool:
    """Whether an expression gives text: ``+`` joins if either side does."""
    match node.kind:
        case "literal":
            return isinstance(node.value, str)
        case "name" | "field":
            return _path(node) in _TEXT_NAMES or (node.kind == "field" and (_path(node.children[0]) or "").endswith("tags"))
        case "index":
            return node.children[1].kind == "literal" and isinstance(node.children[1].value, str)
        case "if":
            return is_text(node.children[1]) or is_text(node.children[2])
        case "op":
            return node.value == "+" and any(map(is_text, node.children))
        case "call":
            return node.value == "string" or (node.value in ("coalesce", "nullif") and any(map(is_text, node.children)))
        case "method":
            return node.value in _TEXT_METHODS
    return False


def _call(name: str, args: tuple[Node, ...], names: Bindings) -> Column:
    if callable(names.get(name)) and not isinstance(names[name], Column):
        return names[name](*[_literal(a) for a in args])
    c = [compile_node(a, names) for a in args]
    made = {
        "int": lambda x: x.try_cast("bigint"), "double": lambda x: x.try_cast("double"), "string": lambda x: x.cast("string"), "bool": lambda x: x.try_cast("boolean"),
        "size": lambda x: F.size(x) if args[0].kind in ("list",) or _is_list(args[0]) else F.length(x),
        "coalesce": lambda *x: F.coalesce(*x), "nullif": lambda a, b: F.nullif(a, b), "min": lambda x: F.array_min(x), "max": lambda x: F.array_max(x),
    }
    if name not in made:
        raise ScriptError(f"unknown function {name!r}")
    return made[name](*c)


def _is_list(node: Node) -> bool:
    return node.kind == "list" or (node.kind == "method" and node.value in ("split", "map", "filter"))


def _method(name: str, target: Node, args: tuple[Node, ...], names: Bindings) -> Column:
    path = _path(target)
    bound = names.get(f"{path}.{name}") if path else None
    if bound is not None and callable(bound) and not isinstance(bound, Column):
        return bound(*[_literal(a) for a in args])
    if name in ("map", "filter", "exists", "all") and len(args) == 2 and args[0].kind == "name":
        body = lambda x: compile_node(args[1], names | {args[0].value: x})
        return {"map": F.transform, "filter": F.filter, "exists": F.exists, "all": F.forall}[name](compile_node(target, names), body)
    x = compile_node(target, names)
    a = [compile_node(v, names) for v in args]
    made = {
        "lowerAscii": lambda: F.lower(x), "upperAscii": lambda: F.upper(x), "trim": lambda: F.trim(x), "charAt": lambda: T.char_at(x, a[0]),
        "indexOf": lambda: T.index_of(x, _literal(args[0])), "lastIndexOf": lambda: T.last_index_of(x, _literal(args[0])), "join": lambda: F.array_join(x, _literal(args[0]) if args else ""),
        "replace": lambda: F.replace(x, a[0], a[1]) if len(a) == 2 else T.replace_first(x, _literal(args[0]), _literal(args[1]), _literal(args[2])),
        "replaceRegex": lambda: F.regexp_replace(x, a[0], a[1]), "split": lambda: F.split(x, T._quoted(_literal(args[0])), _literal(args[1]) if len(args) > 1 else -1),
        "substring": lambda: T.part_of(x, _literal(args[0]), _literal(args[1])) if len(args) > 1 else F.substring(x, _literal(args[0]) + 1, 1 << 30),
        "startsWith": lambda: x.startswith(a[0]), "endsWith": lambda: x.endswith(a[0]), "contains": lambda: x.contains(a[0]), "matches": lambda: F.rlike(x, a[0]), "size": lambda: F.size(x) if _is_list(target) else F.length(x),
        "has": lambda: F.coalesce(F.map_contains_key(x, a[0]), F.lit(False)) if len(a) == 1 else F.coalesce(F.try_element_at(x, a[0]).isin(*a[1:]), F.lit(False)),
        "get": lambda: F.try_element_at(x, a[0]), "getOrDefault": lambda: F.coalesce(F.try_element_at(x, a[0]), a[1]), "getOrKeep": lambda: F.coalesce(F.try_element_at(x, a[0]), a[0]),
    }
    if name not in made:
        raise ScriptError(f"unknown method {name!r}")
    return made[name]()


def compile_script(script: str, names: Bindings) -> Column:
    """The column of a script over the names bound to columns, values or functions of literals."""
    return compile_node(parse(script), names)


_WRAPPED = re.compile(r"^\s*\$\{(.*)\}\s*$", re.S)


def script_of(value) -> str | None:
    """The inside of ``${ ... }``, if the value is such a text."""
    found = _WRAPPED.match(value) if isinstance(value, str) else None
    return found.group(1).strip() if found else None

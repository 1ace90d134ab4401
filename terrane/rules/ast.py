"""Rules over tags: a small predicate tree that compiles to columns.

Logic is two-valued: a leaf over a missing tag is false, never null. A rule also says which tags made it match: AND gives all keys
of its children, OR those of the first child that holds, NOT gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_KEYS = "array()"


class Rule:
    def test(self) -> Column:
        raise NotImplementedError

    def keys(self) -> Column:
        """array<string> of the keys that made the rule match; to be read only where it does."""
        return F.array().cast("array<string>")

    def simplified(self) -> Rule:
        return self

    def partial(self, known: dict[str, str]) -> Rule:
        """The rule with the parts decided that the known source, source_layer or geometry decide; used to skip files before reading."""
        return self

    def __and__(self, other: Rule) -> Rule:
        return And((self, other))

    def __or__(self, other: Rule) -> Rule:
        return Or((self, other))

    def __invert__(self) -> Rule:
        return Not(self)


@dataclass(frozen=True)
class Const(Rule):
    value: bool

    def test(self) -> Column:
        return F.lit(self.value)


TRUE, FALSE = Const(True), Const(False)


@dataclass(frozen=True)
class And(Rule):
    children: tuple[Rule, ...]

    def test(self) -> Column:
        result = F.lit(True)
        for child in self.children:
            result = result & child.test()
        return result

    def keys(self) -> Column:
        return F.concat(*[c.keys() for c in self.children]) if self.children else super().keys()

    def simplified(self) -> Rule:
        flat: list[Rule] = []
        for child in self.children:
            small = child.simplified()
            flat += small.children if isinstance(small, And) else [small]
        if FALSE in flat:
            return FALSE
        flat = list(dict.fromkeys(c for c in flat if c != TRUE))
        return TRUE if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))

    def partial(self, known):
        return And(tuple(c.partial(known) for c in self.children)).simplified()


@dataclass(frozen=True)
class Or(Rule):
    children: tuple[Rule, ...]

    def test(self) -> Column:
        result = F.lit(False)
        for child in self.children:
            result = result | child.test()
        return result

    def keys(self) -> Column:
        chosen = None
        for child in self.children:
            chosen = F.when(child.test(), child.keys()) if chosen is None else chosen.when(child.test(), child.keys())
        return super().keys() if chosen is None else F.coalesce(chosen, super().keys())

    def simplified(self) -> Rule:
        flat: list[Rule] = []
        for child in self.children:
            small = child.simplified()
            flat += small.children if isinstance(small, Or) else [small]
        if TRUE in flat:
            return TRUE
        flat = list(dict.fromkeys(c for c in flat if c != FALSE))
        return FALSE if not flat else flat[0] if len(flat) == 1 else Or(tuple(flat))

    def partial(self, known):
        return Or(tuple(c.partial(known) for c in self.children)).simplified()


@dataclass(frozen=True)
class Not(Rule):
    child: Rule

    def test(self) -> Column:
        return ~self.child.test()

    def simplified(self) -> Rule:
        inner = self.child.simplified()
        if isinstance(inner, Const):
            return Const(not inner.value)
        if isinstance(inner, Not):
            return inner.child
        if isinstance(inner, Or):
            return And(tuple(Not(c) for c in inner.children)).simplified()
        if isinstance(inner, And):
            return Or(tuple(Not(c) for c in inner.children)).simplified()
        if isinstance(inner, TagIn) and inner.values == ("",):
            return TagPresent(inner.key)
        return Not(inner)

    def partial(self, known):
        return Not(self.child.partial(known)).simplified()


@dataclass(frozen=True)
class TagIn(Rule):
    """The tag has one of the values; ``%`` stands for any run of characters, ``\\%`` for itself, the empty value for a missing tag."""

    key: str
    values: tuple[str, ...]
    typed: str | None = None

    def _value(self) -> Column:
        value = F.try_element_at(F.col("tags"), F.lit(self.key))
        if self.typed:
            from terrane.functions.parse import convert

            value = convert(value, self.typed).cast("string")
        return value

    def test(self) -> Column:
        value = self._value()
        plain = [v.replace("\\%", "%") for v in self.values if v and not _is_pattern(v)]
        result = F.lit(False)
        if plain:
            result = result | F.coalesce(value.isin(*plain), F.lit(False))
        for v in self.values:
            if v and _is_pattern(v):
                result = result | F.coalesce(value.rlike(wildcard_regex(v)), F.lit(False))
        if "" in self.values:
            result = result | value.isNull() | (value == "")
        return F.coalesce(result, F.lit(False))

    def keys(self) -> Column:
        return F.array(F.lit(self.key))

    def simplified(self) -> Rule:
        return TagPresent(self.key) if "%" in self.values else self


@dataclass(frozen=True)
class TagPresent(Rule):
    key: str

    def test(self) -> Column:
        value = F.try_element_at(F.col("tags"), F.lit(self.key))
        return F.coalesce(value != "", F.lit(False))

    def keys(self) -> Column:
        return F.array(F.lit(self.key))


@dataclass(frozen=True)
class GeometryIs(Rule):
    """point, line or polygon; a closed way may be both line and polygon."""

    kind: str

    def test(self) -> Column:
        return {"point": F.col("geom_type") == "point", "line": F.col("can_be_line"), "polygon": F.col("can_be_polygon"), "any": F.lit(True)}[self.kind]

    def partial(self, known):
        if self.kind == "any":
            return TRUE
        if "geometry" not in known or (known["geometry"] != self.kind and {known["geometry"], self.kind} == {"line", "polygon"}):
            return self  # a closed line may be a polygon too
        return Const(known["geometry"] == self.kind)


@dataclass(frozen=True)
class FieldIs(Rule):
    """A fixed column, such as source or source_layer, has one of the values."""

    column: str
    values: tuple[str, ...]

    def test(self) -> Column:
        return F.coalesce(F.col(self.column).isin(*self.values), F.lit(False))

    def partial(self, known):
        return Const(known[self.column] in self.values) if self.column in known else self


@dataclass(frozen=True)
class Script(Rule):
    """A predicate given as a column, from a script."""

    make: object

    def test(self) -> Column:
        return F.coalesce(self.make().cast("boolean"), F.lit(False))


def _is_pattern(value: str) -> bool:
    return "%" in value.replace("\\%", "")


def wildcard_regex(pattern: str) -> str:
    """An anchored regular expression for a pattern with ``%``."""
    out, k = [], 0
    while k < len(pattern):
        if pattern.startswith("\\%", k):
            out.append("%")
            k += 2
            continue
        c = pattern[k]
        out.append(".*" if c == "%" else c if c.isalnum() or c in " _" or not c.isascii() else "\\" + c)
        k += 1
    return "^" + "".join(out) + "$"


def match_all(df: DataFrame, rules: list[tuple[str, Rule]]) -> DataFrame:
    """One row per feature and rule that holds, in the order of the rules: ``rule`` and ``match_keys``.

    All rules are evaluated in one projection over the feature; equal results are joined by OR, as are their rules.
    """
    merged: dict[str, Rule] = {}
    for name, rule in rules:
        merged[name] = Or((merged[name], rule)) if name in merged else rule
    hits = [F.when(rule.simplified().test(), F.struct(F.lit(k).alias("place"), F.lit(name).alias("rule"), rule.keys().alias("match_keys"))) for k, (name, rule) in enumerate(merged.items())]
    return df.withColumn("_hit", F.explode(F.array_compact(F.array(*hits)))).select(*df.columns, F.col("_hit.rule").alias("rule"), F.col("_hit.match_keys").alias("match_keys"))


def match_first(rules: list[tuple[str, Rule]], default: str | None) -> Column:
    """The result of the first rule that holds."""
    chosen = F.lit(default)
    for name, rule in reversed(rules):
        chosen = F.when(rule.simplified().test(), name).otherwise(chosen)
    return chosen


def relevant(rules: list[tuple[str, Rule]], known: dict[str, str]) -> list[tuple[str, Rule]]:
    """The rules that can still hold for a file of which source, layer or geometry are known; none left means the file need not be read."""
    return [(name, small) for name, rule in rules if (small := rule.partial(known).simplified()) != FALSE]


def chosen_layers(layers: list[str], only: list[str] | None = None, exclude: list[str] | None = None, needs: dict[str, list[str]] | None = None) -> list[str]:
    """Layers to build: those asked for and not excluded, and whatever they depend on."""
    wanted = [x for x in layers if (not only or x in only) and x not in (exclude or [])]
    todo = list(wanted)
    while todo:
        for dependency in (needs or {}).get(todo.pop(), []):
            if dependency not in wanted:
                wanted.append(dependency)
                todo.append(dependency)
    return wanted

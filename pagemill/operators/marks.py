"""Rules on the words of a page, as data.

A rule is a tree of marks (so many of these phrases within the first so many characters), of patterns, of other
rules' names, and of all, any and none of several. Rules are evaluated in their order into boolean
columns; a rule may name those before it. Heads of a text are cut once for each window."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from pagemill.functions.text import literal


@dataclass(frozen=True)
class Marks:
    """At least `least` of the phrases stand within the first `window` characters (None: anywhere)."""

    phrases: tuple[str, ...]
    least: int = 1
    window: int | None = None


@dataclass(frozen=True)
class Pattern:
    """The regular expression matches within the first `window` characters (None: anywhere)."""

    regex: str
    window: int | None = None


@dataclass(frozen=True)
class Named:
    name: str


@dataclass(frozen=True)
class All:
    parts: tuple = field(default=())


@dataclass(frozen=True)
class Any:
    parts: tuple = field(default=())


@dataclass(frozen=True)
class Not:
    part: object


Rule = Marks | Pattern | Named | All | Any | Not


def windows(rule: Rule) -> set[int]:
    if isinstance(rule, Marks | Pattern):
        return {rule.window} - {None}
    if isinstance(rule, Not):
        return windows(rule.part)
    return set() if isinstance(rule, Named) else set().union(*map(windows, rule.parts))


def holds_sql(rule: Rule, text) -> str:
    """SQL of a rule; text: gives the column of the first so many characters."""
    if isinstance(rule, Marks):
        found = [f"contains({text(rule.window)}, {literal(p)})" for p in rule.phrases]
        return f"({' OR '.join(found)})" if rule.least <= 1 else f"({' + '.join(f'CAST({f} AS INT)' for f in found)} >= {rule.least})"
    if isinstance(rule, Pattern):
        return f"({text(rule.window)} RLIKE {literal(rule.regex)})"
    if isinstance(rule, Named):
        return f"`{rule.name}`"
    if isinstance(rule, Not):
        return f"(NOT {holds_sql(rule.part, text)})"
    return f"({(' AND ' if isinstance(rule, All) else ' OR ').join(holds_sql(p, text) for p in rule.parts)})"


def with_rules(pages: DataFrame, rules: dict[str, Rule], folded: str = "folded") -> DataFrame:
    """Adds a boolean column for each rule."""
    cuts = sorted(set().union(*map(windows, rules.values())))
    rows = pages.selectExpr("*", *(f"substring({folded}, 1, {w}) AS _head{w}" for w in cuts))
    text = lambda w: folded if w is None else f"_head{w}"
    for level in _levels(rules):
        rows = rows.selectExpr("*", *(f"{holds_sql(rules[name], text)} AS `{name}`" for name in level))
    return rows.drop(*(f"_head{w}" for w in cuts))


def names_in(rule: Rule) -> set[str]:
    if isinstance(rule, Named):
        return {rule.name}
    if isinstance(rule, Marks | Pattern):
        return set()
    return names_in(rule.part) if isinstance(rule, Not) else set().union(*map(names_in, rule.parts))


def _levels(rules: dict[str, Rule]) -> list[list[str]]:
    """Names in groups whose rules only name rules of earlier groups, or columns that are there."""
    left, out, known = dict(rules), [], set()
    while left:
        ready = [n for n, r in left.items() if not (names_in(r) & set(rules)) - known]
        if not ready:
            raise ValueError(f"rules name each other in a circle: {sorted(left)}")
        out.append(ready)
        known |= set(ready)
        for n in ready:
            del left[n]
    return out

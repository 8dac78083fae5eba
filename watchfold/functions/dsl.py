"""The filter language of detection rules, compiled to a Catalyst predicate.

    expression := and ("OR" and)*        and := not ("AND" not)*
    not := "NOT" not | "(" expression ")" | field operator value
    operators: == != > < >= <= =~ CONTAINS, and IN with a list in brackets

A predicate is total: it is true or false for every event, also where the field
is missing, so that NOT is safe.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F
from pyspark.sql.functions import lit

from watchfold.functions.scalars import trim

_TOKEN = re.compile(r"""\s*(?:(?P<str>'[^']*'|"[^"]*")|(?P<op>==|!=|>=|<=|=~|[<>])|(?P<mark>[()\[\],])|(?P<word>[^\s=!<>()\[\],'"]+)|(?P<bad>.))""", re.S)
WORDS = {"AND", "OR", "NOT", "IN", "CONTAINS"}
_COMPARE = {"==", "!=", ">", "<", ">=", "<=", "=~", "CONTAINS", "IN"}


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str | tuple[str, ...]


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    left: object
    right: object
    any: bool


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text) and text[at:].strip():
        m = _TOKEN.match(text, at)
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "bad":
            raise FilterError(f"stray {value!r} in {text!r}")
        if kind == "str":
            value = value[1:-1]
        elif kind == "word" and value in WORDS:
            kind = "op" if value in ("IN", "CONTAINS") else "logic"
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _lex(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *kinds: str, value: str | None = None) -> str:
        kind, got = self.peek()
        if kind not in kinds or value not in (None, got):
            raise FilterError(f"expected {value or ' or '.join(kinds)}, found {got or 'the end'!r}")
        self.at += 1
        return got

    def chain(self, word: str, part: Callable):
        out = part()
        while self.peek() == ("logic", word):
            self.at += 1
            out = Both(out, part(), word == "OR")
        return out

    def either(self):
        return self.chain("OR", lambda: self.chain("AND", self.negation))

    def negation(self):
        if self.peek() == ("logic", "NOT"):
            self.at += 1
            return Not(self.negation())
        if self.peek() == ("mark", "("):
            self.at += 1
            out = self.either()
            self.take("mark", value=")")
            return out
        field, op = self.take("word"), self.take("op")
        return Compare(field, op, self.items() if op == "IN" else self.take("str", "word"))

    def items(self) -> tuple[str, ...]:
        self.take("mark", value="[")
        out = []
        while self.peek() != ("mark", "]"):
            out.append(self.take("str", "word"))
            if self.peek() != ("mark", "]"):
                self.take("mark", value=",")
        self.at += 1
        return tuple(out)


def parse(text: str):
    """The expression's tree; FilterError where the text isn't one whole expression."""
    parser = _Parser(text)
    out = parser.either()
    if parser.peek()[0] != "end":
        raise FilterError(f"unexpected {parser.peek()[1]!r} after the expression")
    _check(out)
    return out


def _check(tree) -> None:
    if isinstance(tree, Both):
        _check(tree.left), _check(tree.right)
    elif isinstance(tree, Not):
        _check(tree.of)
    elif tree.op == "=~":
        java_pattern(tree.value)


def java_pattern(pattern: str) -> str:
    """A pattern for Java with Unicode classes, where $ is the end of the text only; no look-around or back references."""
    if re.search(r"\(\?[=!<]", pattern.replace("(?<name", "")) or re.search(r"(?<!\\)(\\\\)*\\[1-9]", pattern):
        raise FilterError(f"look-around and back references aren't supported: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise FilterError(f"bad pattern {pattern!r}: {e}") from None
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return "(?Ud)" + "".join(out)


def _number(text: Column) -> Column:
    """As a double, else null: no suffixes and no hex, which Spark's cast would take, and no NaN."""
    text = trim(text)
    out = F.when(~text.rlike(r"(?i)([0-9.][fd]\z)|0x"), text.try_cast("double"))
    return F.when(~F.isnan(out), out)


def compile(tree, get: Callable[[str], Column]) -> Column:
    """A tree's predicate; ``get`` gives a path's value as a text column."""
    if isinstance(tree, Both):
        left, right = compile(tree.left, get), compile(tree.right, get)
        return left | right if tree.any else left & right
    if isinstance(tree, Not):
        return ~compile(tree.of, get)
    value, x = tree.value, get(tree.field)
    if tree.op == "==":
        return F.coalesce(x, lit("")) == value
    if tree.op == "!=":
        return F.coalesce(x, lit("")) != value
    if tree.op == "CONTAINS":
        out = F.contains(x, lit(value))
    elif tree.op == "IN":
        out = x.isin(*value) if value else lit(False)
    elif tree.op == "=~":
        out = x.rlike(java_pattern(value))
    else:
        a, b = _number(x), _number(lit(value))
        out = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[tree.op]
    return F.coalesce(out, lit(False))


def predicate(text: str, get: Callable[[str], Column]) -> Column:
    return compile(parse(text), get)

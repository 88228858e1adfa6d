"""A small arithmetic language, compiled to a column.

Numbers, names, + - * /, unary minus and parentheses. NULL goes through every
operator and a division by zero is NULL. Text is never given to the SQL parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of a trial row that a formula may name.
VARIABLES = (
    "primaryLatencySeconds", "totalLatencySeconds", "primaryErrors", "totalErrors", "pathLengthCm",
    "averageSpeedCmPerSecond", "quadrant1TargetSeconds", "quadrant2Seconds", "quadrant3OppositeSeconds", "quadrant4Seconds",
)

_LEXEME = re.compile(r"\s*(?:(?P<number>[0-9.]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>[-+*/()]))")


class FormulaError(ValueError):
    pass


def _lexemes(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        found = _LEXEME.match(text, at)
        if not found:
            raise FormulaError(f"Unexpected character: {text[at:].lstrip()[0]}")
        if found["number"] and found["number"].count(".") > 1 or found["number"] == ".":
            raise FormulaError(f"Not a number: {found['number']}")
        out.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    if not out:
        raise FormulaError("The formula is empty")
    return out


class Formula:
    """Parsed once: ``variables`` it names, ``column`` it makes."""

    _POWER = {"+": 1, "-": 1, "*": 2, "/": 2}

    def __init__(self, text: str):
        self._left = _lexemes(text)[::-1]
        self.variables: set[str] = set()
        self._tree = self._climb(1)
        if self._left:
            raise FormulaError(f"Unexpected: {self._left[-1][1]}")

    def _climb(self, least: int):
        tree = self._atom()
        while self._left and (power := self._POWER.get(self._left[-1][1], 0)) >= least:
            op = self._left.pop()[1]
            tree = (op, tree, self._climb(power + 1))
        return tree

    def _atom(self):
        if not self._left:
            raise FormulaError("The formula ends too soon")
        kind, text = self._left.pop()
        if kind == "number":
            return float(text)
        if kind == "name":
            self.variables.add(text)
            return text
        if text == "-":
            return ("neg", self._atom())
        if text == "(":
            tree = self._climb(1)
            if not self._left or self._left.pop()[1] != ")":
                raise FormulaError("A ) is missing")
            return tree
        raise FormulaError(f"Unexpected: {text}")

    def check(self, allowed: Iterable[str]) -> None:
        if unknown := sorted(self.variables - set(allowed)):
            raise FormulaError(f"Unknown: {', '.join(unknown)}. Known: {', '.join(allowed)}")

    @property
    def column(self) -> Column:
        def build(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            if isinstance(tree, str):
                return F.col(f"`{tree}`").cast("double")
            if tree[0] == "neg":
                return -build(tree[1])
            a, b = build(tree[1]), build(tree[2])
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[tree[0]]()

        return build(self._tree)


def formula_column(text: str, allowed: Iterable[str] = VARIABLES) -> Column:
    parsed = Formula(text)
    parsed.check(allowed)
    return parsed.column

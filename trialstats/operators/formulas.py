"""Model formulas as text, to the design columns of ``ols``.

``parse("y ~ group * pc1 - pc1", {"group": Factor(("a", "b", "c"))})`` gives the outcome and its terms. Names are
columns (in backticks if they aren't plain words); ``+`` adds terms, ``:`` crosses them, ``a * b`` is ``a + b + a:b``, ``-`` takes
terms out, and parentheses group. Terms of fewer variables come first, otherwise in the order of the text.

A factor of k levels is k - 1 contrast columns where the term without it is in the model too (the intercept is the
term without any variable), and k columns of 0 and 1 where it isn't: so a term spans no more than it adds.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialstats.operators.ols import Term

TOKENS = re.compile(r"\s*(?:`([^`]+)`|([A-Za-z_.][\w.]*)|(\d+)|([+\-*:()]))")
Crossed = tuple[str, ...]  # the variables of a term, none for the intercept
CODINGS = ("treatment", "sum", "half")


@dataclass(frozen=True)
class Factor:
    """Levels in order, and how they are coded: ``treatment`` (against the first), ``sum`` (contrasts that add to zero, the last
    level -1) or ``half`` (those times -1/2: two levels are -1/2 and +1/2). A value outside the levels is missing."""

    levels: Sequence
    coding: str = "treatment"
    column: str | None = None

    def __post_init__(self):
        if self.coding not in CODINGS:
            raise ValueError(f"no coding {self.coding}")
        if len(set(self.levels)) != len(self.levels) or len(self.levels) < 2:
            raise ValueError("a factor has two or more distinct levels")

    def columns(self, name: str, full: bool) -> list[tuple[str, Column]]:
        """(name, column) of each design column: all levels, or contrasts of them."""
        value = F.col(f"`{self.column or name}`")
        known = value.isin(list(self.levels))

        def one(weights: Mapping) -> Column:
            """A weight per level, zero for the others, missing outside the levels."""
            out = F.when(~known | known.isNull(), F.lit(None).cast("double"))
            for level, weight in weights.items():
                out = out.when(value == level, float(weight))
            return out.otherwise(0.0)

        if full:
            return [(f"{name}{v}", one({v: 1})) for v in self.levels]
        if self.coding == "treatment":
            return [(f"{name}{v}", one({v: 1})) for v in self.levels[1:]]
        unit = 1.0 if self.coding == "sum" else -0.5
        return [(f"{name}{i + 1}", one({v: unit, self.levels[-1]: -unit})) for i, v in enumerate(self.levels[:-1])]


@dataclass(frozen=True)
class Model:
    outcome: str
    crossed: tuple[Crossed, ...]
    terms: tuple[Term, ...]


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        found = TOKENS.match(text, at)
        if not found:
            raise ValueError(f"cannot read {text[at:]!r}")
        quoted, word, number, sign = found.groups()
        out.append(("name", quoted or word) if quoted or word else ("number", number) if number else ("sign", sign))
        at = found.end()
    return out


def expand(text: str) -> list[Crossed]:
    """The terms of a right side, as variables in the order in which the text first names them."""
    tokens = _tokens(text)
    named = list(dict.fromkeys(value for kind, value in tokens if kind == "name"))
    at = 0

    def ahead(signs: str) -> bool:
        return at < len(tokens) and tokens[at][0] == "sign" and tokens[at][1] in signs

    def together(*groups: list[frozenset]) -> list[frozenset]:
        return list(dict.fromkeys(t for g in groups for t in g))

    def crossing(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
        return together([x | y for x in a for y in b])

    def single() -> list[frozenset]:
        nonlocal at
        if at == len(tokens):
            raise ValueError(f"a term is missing in {text!r}")
        kind, value = tokens[at]
        at += 1
        if kind == "name":
            return [frozenset([value])]
        if (kind, value) == ("number", "1"):
            return [frozenset()]
        if (kind, value) != ("sign", "("):
            raise ValueError(f"{value!r} isn't a term")
        inside = added()
        if not ahead(")"):
            raise ValueError(f"a parenthesis is open in {text!r}")
        at += 1
        return inside

    def crossed() -> list[frozenset]:
        nonlocal at
        out = single()
        while ahead(":"):
            at += 1
            out = crossing(out, single())
        return out

    def multiplied() -> list[frozenset]:
        nonlocal at
        out = crossed()
        while ahead("*"):
            at += 1
            more = crossed()
            out = together(out, more, crossing(out, more))
        return out

    def added() -> list[frozenset]:
        nonlocal at
        out = multiplied()
        while ahead("+-"):
            minus = tokens[at][1] == "-"
            at += 1
            more = multiplied()
            out = [t for t in out if t not in more] if minus else together(out, more)
            if minus and frozenset() in more:
                raise ValueError("a model without an intercept isn't fitted")
        return out

    terms = added()
    if at < len(tokens):
        raise ValueError(f"{tokens[at][1]!r} stands where no term can end in {text!r}")
    ordered = sorted((t for t in terms if t), key=len)  # stable
    return [tuple(v for v in named if v in t) for t in ordered]


def design(crossed: Sequence[Crossed], factors: Mapping[str, Factor] | None = None) -> list[Term]:
    """Design columns of terms; in a crossed term the first variable's columns change fastest."""
    factors = factors or {}
    present = {frozenset(t) for t in crossed} | {frozenset()}
    out = []
    for term in crossed:
        columns: list[tuple[list[str], Column | None]] = [([], None)]
        for name in term:
            if name in factors:
                full = frozenset(term) - {name} not in present
                own = factors[name].columns(name, full)
            else:
                own = [(name, F.col(f"`{name}`").cast("double"))]
            columns = [([*names, n], c if before is None else before * c) for n, c in own for names, before in columns]
        kind = "interaction" if len(term) > 1 else "factor" if term[0] in factors else "numeric"
        out += [Term(":".join(names), column, kind) for names, column in columns]
    return out


def parse(formula: str, factors: Mapping[str, Factor] | None = None) -> Model:
    left, tilde, right = formula.partition("~")
    outcome = _tokens(left)
    if not tilde or len(outcome) != 1 or outcome[0][0] != "name":
        raise ValueError(f"a formula reads: outcome ~ terms, not {formula!r}")
    crossed = expand(right)
    if any(outcome[0][1] in t for t in crossed):
        raise ValueError("the outcome can't be a term")
    return Model(outcome[0][1], tuple(crossed), tuple(design(crossed, factors)))


def models(formulas: Mapping[str, str], factors: Mapping[str, Factor] | None = None) -> tuple[str, dict[str, list[Term]]]:
    """(outcome, terms per model) for ``ols.fit_models``: formulas of one outcome, fitted to the same rows.

    A design column has one name in all of them, so a factor that is coded by contrasts in one and in full in another
    under the same column name is an error.
    """
    parsed = {name: parse(text, factors) for name, text in formulas.items()}
    outcomes = {m.outcome for m in parsed.values()}
    if len(outcomes) != 1:
        raise ValueError(f"one outcome, not {sorted(outcomes)}")
    kept: dict[str, str] = {}
    for model in parsed.values():
        for term in model.terms:
            if kept.setdefault(term.name, str(term.column)) != str(term.column):
                raise ValueError(f"{term.name} has two codings; fit these models apart")
    return outcomes.pop(), {name: list(m.terms) for name, m in parsed.items()}

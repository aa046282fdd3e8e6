"""Feature expressions and boolean population definitions as columns.

Both are texts of tokens parted by ``|``; names may hold the separator, so the
longest known name that fits is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import divide, finite_or

FUNCTIONS: dict[str, Callable[[Column], Column]] = {"ABS": F.abs, "COS": F.cos, "SIN": F.sin, "SQR": lambda x: x * x, "SQRT": F.sqrt}
ARITHMETIC = ("+", "-", "*", "/", "(", ")", *FUNCTIONS)
LOGIC = ("And", "Or", "Not", "(", ")")


def is_number(token: str) -> bool:
    try:
        float(token)
    except ValueError:
        return False
    return True


def tokens(definition: str, names: Sequence[str], operators: Sequence[str], numbers: bool = False, sep: str = "|") -> list[str]:
    """Tokens of ``definition``; an unknown one is an error."""
    known = sorted({*names, *operators}, key=lambda n: (-len(n), n))
    out, at = [], 0
    while at < len(definition):
        hit = next((n for n in known if definition.startswith(n, at) and definition[at + len(n) : at + len(n) + len(sep)] in ("", sep)), None)
        if hit is None:
            hit = definition[at:].split(sep, 1)[0]
            if not (numbers and is_number(hit)):
                raise ValueError(f"unknown token {hit!r} in {definition!r}")
        out.append(hit)
        at += len(hit) + len(sep)
    if not out:
        raise ValueError("empty definition")
    return out


def names_in(definition: str, names: Sequence[str], operators: Sequence[str]) -> list[str]:
    """The names that ``definition`` uses, in order of first use."""
    found = tokens(definition, names, operators, numbers=operators is ARITHMETIC)
    return list(dict.fromkeys(t for t in found if t in set(names)))


def _fold(found: list[str], levels: Sequence[Mapping[str, Callable]], prefix: Mapping[str, Callable], value: Callable[[str], Column]) -> Column:
    """Left-associative ``levels`` of operators, loosest first, over values,
    parentheses and ``prefix`` operators, which take the next operand."""
    rest = list(reversed(found))

    def operand() -> Column:
        if not rest:
            raise ValueError(f"definition ends early: {' '.join(found)}")
        t = rest.pop()
        if t == "(":
            inner = level(0)
            if not rest or rest.pop() != ")":
                raise ValueError(f"missing ) in {' '.join(found)}")
            return inner
        if t in prefix:
            return prefix[t](operand())
        if t in (")", *(o for m in levels for o in m)):
            raise ValueError(f"{t!r} is out of place in {' '.join(found)}")
        return value(t)

    def level(i: int) -> Column:
        if i == len(levels):
            return operand()
        out = level(i + 1)
        while rest and rest[-1] in levels[i]:
            op = levels[i][rest.pop()]
            out = op(out, level(i + 1))
        return out

    out = level(0)
    if rest:
        raise ValueError(f"{rest[-1]!r} is out of place in {' '.join(found)}")
    return out


def feature(definition: str, columns: Mapping[str, Column]) -> Column:
    """The value of an arithmetic definition over named double columns.

    + - * / ( ) and ABS COS SIN SQR SQRT, which need no parentheses. Divisions
    by zero follow IEEE doubles; what isn't finite in the end, null inputs
    included, is NaN.
    """
    found = tokens(definition, list(columns), ARITHMETIC, numbers=True)
    add = {"+": lambda a, b: a + b, "-": lambda a, b: a - b}
    times = {"*": lambda a, b: a * b, "/": divide}
    signs = {"-": lambda a: -a, "+": lambda a: a}
    out = _fold(found, [add, times], FUNCTIONS | signs, lambda t: columns[t] if t in columns else F.lit(float(t)))
    return finite_or(out.cast("double"))


def boolean(definition: str, columns: Mapping[str, Column]) -> Column:
    """The value of an And / Or / Not definition over named boolean columns;
    Not binds most, then And, then Or."""
    found = tokens(definition, list(columns), LOGIC)
    return _fold(found, [{"Or": lambda a, b: a | b}, {"And": lambda a, b: a & b}], {"Not": lambda a: ~a}, lambda t: columns[t])

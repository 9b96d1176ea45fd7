"""Semantics that must hold whatever the runtime's defaults are: rounding, null order, white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as web runtimes understand it; a Java regex class leaves out the no-break spaces.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def round_half_up(x: Column) -> Column:
    """Rounds .5 towards positive infinity, so -2.5 gives -2."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: int, high: int) -> Column:
    """Rounded and held inside [low, high]."""
    return F.greatest(F.lit(low), F.least(F.lit(high), round_half_up(x))).cast("int")


def descending(name: str) -> Column:
    """Descending with nulls first, as the store sorts."""
    return F.col(name).desc_nulls_first()


def ascending(name: str) -> Column:
    """Ascending with nulls last."""
    return F.col(name).asc_nulls_last()


def one_space(text: Column) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def holds(text: Column, token: str) -> Column:
    """Case-insensitive containment with the token taken literally."""
    return F.contains(F.lower(text), F.lit(token.lower()))


def yes(condition: Column) -> Column:
    """Two-valued: an unknown condition is false."""
    return F.coalesce(condition, F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often it is used.

    An expression used several times is copied into the plan as often; a lambda's variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(value: Column, *names: str) -> Column:
    """A generator of one row whose columns are the fields of the struct ``value``, all or those named.

    The optimiser neither copies what a generator gives into later columns nor moves filters below it."""
    return F.inline(F.array(value if not names else F.struct(*(value[n].alias(n) for n in names))))

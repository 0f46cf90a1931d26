"""A predicate algebra over columns, and compilers from settings and facet maps to one Column.

Predicates are functions Column -> Column that are two-valued: a null never passes, and NOT of a failed test passes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def Equal(value) -> Predicate:
    return lambda c: _sure(c == value)


def Max(most) -> Predicate:
    return lambda c: _sure(c <= most)


def Min(least) -> Predicate:
    return lambda c: _sure(c >= least)


def Contains(*items) -> Predicate:
    """An array holds all of the items."""
    return lambda c: reduce(and_, (_sure(F.array_contains(c, i)) for i in items), F.lit(True)) & c.isNotNull()


def IsIn(*items) -> Predicate:
    return lambda c: _sure(c.isin(*items))


def Length(test: Predicate | int) -> Predicate:
    """An array's or map's size passes a predicate, or equals a number."""
    inner = test if callable(test) else Equal(test)
    return lambda c: c.isNotNull() & inner(F.size(c))


def TextLength(test: Predicate | int) -> Predicate:
    inner = test if callable(test) else Equal(test)
    return lambda c: inner(F.length(c))


def DictValue(key, test: Predicate) -> Predicate:
    """A map's value at `key` passes; with key None, any of its values does."""
    if key is None:
        return lambda c: _sure(F.exists(F.map_values(c), test))
    return lambda c: test(F.try_element_at(c, F.lit(key)))


def AND(*tests: Predicate) -> Predicate:
    return lambda c: reduce(and_, (t(c) for t in tests), F.lit(True))


def OR(*tests: Predicate) -> Predicate:
    return lambda c: reduce(or_, (t(c) for t in tests), F.lit(False))


def NOT(test: Predicate) -> Predicate:
    return lambda c: ~test(c)


def where(**tests) -> Column:
    """A conjunction: column=predicate, or column=value."""
    return reduce(and_, ((t if callable(t) else Equal(t))(F.col(c)) for c, t in tests.items()), F.lit(True))


def membership(column: str, value) -> Column:
    """An array column holds the value."""
    return _sure(F.array_contains(F.col(column), value))


MINIMUM = re.compile(r"^(?:genes_)?min_(?P<type>\w+?)(?P<all>_all)?$")


def from_settings(settings: dict[str, float], min_core: int = 3, max_avg_cog: float | None = 0.25, overlap: float | None = None) -> Column:
    """`min_<type>[_all]`: n becomes size(genes_<type>[_all]) >= n; core size and score limits are added, and rows whose
    external overlap reaches `overlap` are excluded if it is given."""
    tests = [Min(min_core)(F.col("n_core"))]
    if max_avg_cog is not None:
        tests.append(Max(max_avg_cog)(F.col("cog_avg")))
    for name, least in settings.items():
        found = MINIMUM.match(name)
        if not found:
            raise ValueError(f"not a minimum: {name}")
        if least > 0:
            tests.append(Length(Min(least))(F.col(f"genes_{found['type']}{found['all'] or ''}")))
    if overlap is not None:
        tests.append(~_sure(F.exists("overlaps", lambda o: (o["kind"] == "total") | (o["fraction"] >= overlap))))
    return reduce(and_, tests)


def from_facets(requirements: dict[str, dict], kinds: dict[str, str], missing_passes: bool = False) -> Column:
    """{column: {type: equal | min | max | contains, value}}; kinds: column -> "array" or "number". An array tested by a
    number is tested by its length. A missing column or value counts as 0 or empty, or passes if `missing_passes`."""
    tests = []
    for name, need in requirements.items():
        kind, value = need["type"], need["value"]
        if name not in kinds:
            if missing_passes:
                continue
            column, is_array = (F.array().cast("array<string>"), True) if isinstance(value, list) else (F.lit(0), False)
        else:
            is_array = kinds[name] == "array"
            column = F.coalesce(F.col(name), F.array().cast("array<string>")) if is_array else F.coalesce(F.col(name), F.lit(0))
        if kind == "contains":
            test = Contains(*(value if isinstance(value, list) else [value]))(column)
        else:
            number = F.size(column) if is_array and not isinstance(value, list) else column
            test = {"equal": Equal, "min": Min, "max": Max}[kind](value)(number)
        tests.append(test | F.col(name).isNull() if missing_passes and name in kinds else test)
    return reduce(and_, tests, F.lit(True))


def parse_requirements(old: dict[str, dict], given: dict[str, tuple[str, str]]) -> dict[str, dict]:
    """Facets typed by a user over earlier ones: numbers replace, lists (split at white space and commas) are united, a
    blank deletes."""
    out = {k: dict(v) for k, v in old.items()}
    for name, (kind, text) in given.items():
        if not text.strip():
            out.pop(name, None)
        elif kind == "contains":
            before = out.get(name, {}).get("value", [])
            out[name] = {"type": kind, "value": list(dict.fromkeys([*before, *re.split(r"[\s,]+", text.strip())]))}
        else:
            out[name] = {"type": kind, "value": float(text)}
    return out


def flip_map(column: Column) -> Column:
    """A map's keys by its values."""
    return F.map_from_arrays(F.map_values(column), F.map_keys(column))

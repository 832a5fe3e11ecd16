"""Aggregate specifications shared by the sampling operators.

An aggregate is ``(func, column, alias)`` with ``func`` one of ``count``,
``sum``, ``avg``, ``min``, ``max``; ``column="*"`` counts rows. Strings such
as ``"sum(amount)"`` are accepted as shorthand (no SQL parsing beyond that).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

FUNCS = ("count", "sum", "avg", "min", "max", "count_distinct", "median", "percentile")
SAMPLEABLE = ("count", "sum", "avg", "min", "max")
_SHORT = re.compile(r"^\s*(\w+)\s*\(\s*(\*|\w+)\s*\)\s*(?:as\s+(\w+))?\s*$", re.I)


@dataclass(frozen=True)
class Agg:
    func: str
    column: str = "*"
    alias: str | None = None
    p: float | None = None  # probability of a ``percentile``

    def __post_init__(self):
        f = self.func.lower()
        if f not in FUNCS:
            raise ValueError(f"unsupported aggregate {self.func!r}; use one of {FUNCS}")
        if self.column == "*" and f != "count":
            raise ValueError(f"{f}(*) is not defined")
        if f == "percentile" and (self.p is None or not 0.0 <= self.p <= 1.0):
            raise ValueError("percentile needs p in [0, 1]")
        object.__setattr__(self, "func", f)

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        if self.func == "percentile":
            from roughcut.operators.sketches import quantile_name
            return f"{quantile_name(self.p)}_{self.column}"
        return f"{self.func}_{'rows' if self.column == '*' else self.column}"

    @property
    def is_quantile(self) -> bool:
        return self.func in ("median", "percentile")

    @property
    def prob(self) -> float:
        return 0.5 if self.func == "median" else float(self.p)

    @property
    def scales(self) -> bool:
        """COUNT and SUM grow with the population; AVG/MIN/MAX do not."""
        return self.func in ("count", "sum")


def as_aggs(aggs) -> list[Agg]:
    out = []
    for a in aggs:
        if isinstance(a, Agg):
            out.append(a)
        elif isinstance(a, str):
            m = _SHORT.match(a)
            if not m:
                raise ValueError(f"cannot read aggregate {a!r}; write e.g. 'sum(amount)'")
            out.append(Agg(m.group(1), m.group(2), m.group(3)))
        else:
            out.append(Agg(*a))
    return out

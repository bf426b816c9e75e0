"""Histogram bin expressions. Each is a closed form over one column, so no range join is needed."""

from __future__ import annotations

from dataclasses import dataclass


def _double(number: float) -> str:
    return f"double('{number!r}')"


@dataclass(frozen=True)
class IntBins:
    """Integer bins whose widths differ by at most one; the wider bins come first."""

    low: int
    high: int
    bins: int
    width: int
    wider: int

    @classmethod
    def over(cls, low: int, high: int, wanted: int) -> IntBins:
        domain = high - low + 1
        bins = min(wanted, domain)
        return cls(low, high, bins, domain // bins, domain % bins)

    def lower(self, index: int) -> int:
        return self.low + index * self.width + min(index, self.wider)

    def upper(self, index: int) -> int:
        return self.lower(index + 1) - 1

    def index_sql(self, value: str) -> str:
        """The bin of an integer SQL expression within the range."""
        # A full-range bigint column has offsets beyond 63 bits; only then pay for decimals.
        wide = self.high - self.low >= 2**63 - 1
        kind = "decimal(38,0)" if wide else "bigint"

        def number(n: int) -> str:
            return f"cast('{n}' as {kind})"

        offset = f"(cast({value} as {kind}) - {number(self.low)})"
        head = self.wider * (self.width + 1)
        tail = f"{self.wider} + ({offset} - {number(head)}) div {number(self.width)}"
        if self.wider == 0:
            return f"int({tail})"
        first = f"{offset} div {number(self.width + 1)}"
        return f"int(if({offset} < {number(head)}, {first}, {tail}))"


@dataclass(frozen=True)
class FloatEdges:
    """Equal-width edges over [low, high]."""

    low: float
    high: float
    bins: int

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.bins

    def edge(self, index: int) -> float:
        return self.low + self.width * index

    def right_closed_sql(self, value: str) -> str:
        """Bin of ``(a, b]`` intervals: how many inner edges lie below the value."""
        inner = [f"int({value} > {_double(self.edge(i))})" for i in range(1, self.bins)]
        return " + ".join(["0", *inner])

    def left_closed_sql(self, value: str) -> str:
        """Bin of ``[a, b)`` intervals by scaling, clamped to the last bin."""
        span = _double(self.high - self.low)
        scaled = f"floor(({value} - {_double(self.low)}) / {span} * {self.bins})"
        return f"least({self.bins - 1}, greatest(0, int({scaled})))"

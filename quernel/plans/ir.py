"""The query: what is read, joined, filtered and summed. Immutable."""

from __future__ import annotations

from dataclasses import dataclass

COMPARISONS = ("<", ">", "=")


class QueryError(ValueError):
    """The text or the query it describes is not valid."""


@dataclass(frozen=True, order=True)
class ColRef:
    """Column `col` of the relation at position `binding` of the FROM list."""

    binding: int
    col: int

    def __str__(self) -> str:
        return f"{self.binding}.{self.col}"

    @property
    def flat(self) -> str:
        """Its name once bindings are joined; unique even in self-joins."""
        return f"b{self.binding}_c{self.col}"


@dataclass(frozen=True)
class Filter:
    column: ColRef
    op: str
    value: int

    def __str__(self) -> str:
        return f"{self.column}{self.op}{self.value}"


@dataclass(frozen=True)
class EquiPred:
    left: ColRef
    right: ColRef

    def __str__(self) -> str:
        return f"{self.left}={self.right}"

    @property
    def sides(self) -> tuple[ColRef, ColRef]:
        return self.left, self.right


@dataclass(frozen=True)
class Query:
    relations: tuple[int, ...]
    predicates: tuple[EquiPred, ...]
    filters: tuple[Filter, ...]
    sums: tuple[ColRef, ...]

    def columns(self) -> list[ColRef]:
        """Every column that is mentioned, once each."""
        seen = [c for p in self.predicates for c in p.sides]
        seen += [f.column for f in self.filters] + list(self.sums)
        return list(dict.fromkeys(seen))

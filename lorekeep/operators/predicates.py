"""Predicates over the log as pushable column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F



@dataclass(frozen=True)
class QueryItem:
    """An event is selected if its type is one of ``types`` (none: any) and it has all ``tags``."""

    types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()

    def column(self) -> Column:
        parts = [F.col("event_type").isin(*self.types)] if self.types else []
        parts += [F.array_contains("tags", t) for t in self.tags]
        return reduce(and_, parts) if parts else F.lit(True)


@dataclass(frozen=True)
class Query:
    """A disjunction of items. No items select nothing; an item without types and tags selects everything."""

    items: tuple[QueryItem, ...] = ()

    @staticmethod
    def all() -> Query:
        return Query((QueryItem(),))

    def __or__(self, other: Query) -> Query:
        return Query(self.items + other.items)

    def types(self) -> tuple[str, ...] | None:
        """The types that any selected event has, for a pushed IN; None if an item admits all."""
        if any(not i.types for i in self.items):
            return None
        return tuple(sorted({t for i in self.items for t in i.types}))

    def column(self) -> Column:
        if not self.items:
            return F.lit(False)
        matched = reduce(or_, [i.column() for i in self.items])
        types = self.types()
        return matched if types is None else F.col("event_type").isin(*types) & matched


@dataclass(frozen=True)
class EventFilter:
    """Literal stream prefixes (any of them) and types (any of them); an empty side admits all."""

    prefixes: tuple[str, ...] = ()
    types: tuple[str, ...] = ()

    def is_all(self) -> bool:
        return not self.prefixes and not self.types

    def column(self) -> Column:
        parts = []
        if self.prefixes:
            parts.append(reduce(or_, [F.startswith(F.col("stream_id"), F.lit(p)) for p in self.prefixes]))
        if self.types:
            parts.append(F.col("event_type").isin(*self.types))
        return reduce(and_, parts) if parts else F.lit(True)

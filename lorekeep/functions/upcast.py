"""Upcasting old payload versions on read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Rung = Callable[[Column], Column]


class LadderError(ValueError):
    """A ladder that can't be built; ``kind`` says why."""

    def __init__(self, kind: str, event_type: str, version: int) -> None:
        super().__init__(f"{kind}: {event_type} version {version}")
        self.kind = kind


@dataclass
class Chain:
    """One upcaster a type; of several the last one registered is used, and an unknown type is an error."""

    by_type: dict[str, Rung] = field(default_factory=dict)

    def register(self, event_type: str, upcast: Rung) -> Chain:
        return Chain({**self.by_type, event_type: upcast})

    def column(self, event_type: Column, payload: Column) -> Column:
        out = F.raise_error(F.concat(F.lit("unknown event type "), event_type)).cast("string")
        for name, upcast in self.by_type.items():
            out = F.when(event_type == name, upcast(payload)).otherwise(out)
        return out


@dataclass
class Ladder:
    """Rungs from a version to the next, by type."""

    rungs: list[tuple[str, int, Rung]] = field(default_factory=list)

    def rung(self, event_type: str, version: int, upcast: Rung) -> Ladder:
        return Ladder([*self.rungs, (event_type, version, upcast)])

    def build(self) -> BuiltLadder:
        by_type: dict[str, dict[int, Rung]] = {}
        for name, version, upcast in self.rungs:
            if version in by_type.setdefault(name, {}):
                raise LadderError("duplicate rung", name, version)
            by_type[name][version] = upcast
        for name, own in by_type.items():
            if 1 not in own:
                raise LadderError("missing base", name, 1)
            for version in own:
                if version > 1 and version - 1 not in own:
                    raise LadderError("dangling version", name, version)
        return BuiltLadder(by_type)


@dataclass
class BuiltLadder:
    by_type: dict[str, dict[int, Rung]]

    def known(self, event_type: Column, version: Column) -> Column:
        """Whether a row can be read: its type has rungs, and its version is at most one past the last."""
        out = F.lit(False)
        for name, own in self.by_type.items():
            out = F.when(event_type == name, version.between(1, max(own) + 1)).otherwise(out)
        return out

    def column(self, event_type: Column, version: Column, payload: Column) -> Column:
        """The payload at the type's newest version; each row climbs only its own rungs."""
        out = F.raise_error(F.concat(F.lit("unknown event type "), event_type)).cast("string")
        for name, own in self.by_type.items():
            climbed = payload
            for k in sorted(own):
                climbed = F.when(version <= k, own[k](climbed)).otherwise(climbed)
            top = max(own) + 1
            wrong = F.raise_error(F.concat(F.lit(f"unknown version of {name}: "), version.cast("string"))).cast("string")
            out = F.when(event_type == name, F.when(version.between(1, top), climbed).otherwise(wrong)).otherwise(out)
        return out

"""Events and commands as dataclasses: what they are called in a log, and how they become payloads.

    words = Vocabulary()

    @words.event(tags=lambda e: [f"account:{e.account}"])
    @dataclass
    class Deposited:
        account: int
        amount: int
"""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Callable
from typing import Any

from lorekeep.operators.commands import Decider, Rejection


def snake_case(name: str) -> str:
    """``OrderPlaced`` and ``HTTPRequest`` as ``order_placed`` and ``http_request``."""
    return re.sub("([a-z0-9])([A-Z])", r"\1_\2", re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", name)).lower()


class Vocabulary:
    def __init__(self) -> None:
        self._kinds: dict[str, type] = {}
        self._names: dict[type, str] = {}
        self._tags: dict[type, Callable[[Any], list[str]]] = {}

    def event(self, name: str | None = None, tags: Callable[[Any], list[str]] | None = None) -> Callable[[type], type]:
        """Registers a dataclass under a name, by default its own."""

        def register(kind: type) -> type:
            own = name or kind.__name__
            if own in self._kinds:
                raise ValueError(f"{own} is registered")
            self._kinds[own], self._names[kind] = kind, own
            if tags:
                self._tags[kind] = tags
            return kind

        return register

    command = event

    def name(self, message: Any) -> str:
        return self._names[type(message)]

    def encoded(self, message: Any) -> dict:
        """event_type, payload (JSON of the fields) and tags, as NEW_EVENT has them."""
        tags = self._tags.get(type(message))
        return {"event_type": self.name(message), "payload": json.dumps(dataclasses.asdict(message)), "tags": tags(message) if tags else []}

    def decoded(self, name: str, payload: str | None) -> Any:
        """The message; an unknown name is an error. Fields that its class doesn't have are ignored."""
        if name not in self._kinds:
            raise LookupError(f"unknown message {name}")
        kind = self._kinds[name]
        fields = {f.name for f in dataclasses.fields(kind)}
        return kind(**{k: v for k, v in json.loads(payload or "{}").items() if k in fields})

    def decider(self, aggregate: type) -> Decider:
        """A decider from a class whose instances are states: a dataclass with ``on_<event>(self, event)``, which changes it, and ``<command>(self, command)``, which returns events, nothing, or a Rejection. Names are in snake case; events without a method change nothing."""

        def apply(state: dict, e: dict) -> dict:
            own, event = aggregate(**state), self.decoded(e["event_type"], e["payload"])
            change = getattr(own, f"on_{snake_case(e['event_type'])}", None)
            if change:
                change(event)
            return dataclasses.asdict(own)

        def decide(state: dict, c: dict) -> list[dict] | Rejection:
            made = getattr(aggregate(**state), snake_case(c["name"]))(self.decoded(c["name"], c["payload"]))
            return made if isinstance(made, Rejection) else [self.encoded(e) for e in made or []]

        return Decider(lambda: dataclasses.asdict(aggregate()), apply, decide)

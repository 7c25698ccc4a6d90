"""A dispatch table on the driver.

Requests have one handler, and stream requests one that yields; notifications
have any number. Behaviours wrap requests in the order given; processors run
before and after the handler, inside the behaviours; error handlers may turn an
error into a response, error actions only see it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import metadata
from lorekeep.repository import Repository
from lorekeep.schema import METADATA

Handler = Callable[[Any], Any]
SEQUENTIAL, SEQUENTIAL_ALL, CONCURRENT = "sequential", "sequential_all", "concurrent"


class NoHandler(LookupError):
    pass


class Mediator:
    def __init__(self) -> None:
        self._requests: dict[type, Handler] = {}
        self._streams: dict[type, Callable[[Any], Iterator]] = {}
        self._notified: dict[type, list[Handler]] = {}
        self._behaviours: list[Callable[[Any, Handler], Any]] = []
        self._before: list[Handler] = []
        self._after: list[Callable[[Any, Any], Any]] = []
        self._recover: list[tuple[type, Callable[[Any, Exception], Any]]] = []
        self._actions: list[Callable[[Any, Exception], None]] = []

    def _register(self, table: dict, kind: type, handler: Callable) -> Mediator:
        if kind in table:
            raise ValueError(f"{kind.__name__} has a handler")
        table[kind] = handler
        return self

    def handle(self, kind: type, handler: Handler) -> Mediator:
        return self._register(self._requests, kind, handler)

    def handle_stream(self, kind: type, handler: Callable[[Any], Iterator]) -> Mediator:
        return self._register(self._streams, kind, handler)

    def on(self, kind: type, handler: Handler) -> Mediator:
        self._notified.setdefault(kind, []).append(handler)
        return self

    def behave(self, wrap: Callable[[Any, Handler], Any]) -> Mediator:
        self._behaviours.append(wrap)
        return self

    def before(self, process: Handler) -> Mediator:
        self._before.append(process)
        return self

    def after(self, process: Callable[[Any, Any], Any]) -> Mediator:
        """process(request, response)."""
        self._after.append(process)
        return self

    def on_error(self, recover: Callable[[Any, Exception], Any], kind: type[Exception] = Exception) -> Mediator:
        """recover returns a response, or raises; of several the first whose kind fits is asked."""
        self._recover.append((kind, recover))
        return self

    def on_error_do(self, act: Callable[[Any, Exception], None]) -> Mediator:
        self._actions.append(act)
        return self

    def send(self, request: Any) -> Any:
        handler = self._requests.get(type(request))
        if handler is None:
            raise NoHandler(type(request).__name__)

        def processed(r: Any) -> Any:
            for process in self._before:
                process(r)
            response = handler(r)
            for process in self._after:
                process(r, response)
            return response

        call: Handler = processed
        for wrap in reversed(self._behaviours):
            call = (lambda inner, outer: lambda r: outer(r, inner))(call, wrap)
        try:
            return call(request)
        except Exception as error:
            for act in self._actions:
                act(request, error)
            for kind, recover in self._recover:
                if isinstance(error, kind):
                    return recover(request, error)
            raise

    def stream(self, request: Any) -> Iterator:
        handler = self._streams.get(type(request))
        if handler is None:
            raise NoHandler(type(request).__name__)
        return handler(request)

    def publish(self, notice: Any, how: str = SEQUENTIAL) -> None:
        """In order, stopping at the first error; or all of them, in order or at the same time, with the first error raised at the end."""
        handlers = self._notified.get(type(notice), [])
        if how == SEQUENTIAL:
            for handler in handlers:
                handler(notice)
            return
        if how == CONCURRENT and handlers:
            with ThreadPoolExecutor(len(handlers)) as pool:
                errors = [f.exception() for f in [pool.submit(h, notice) for h in handlers]]
        else:
            errors = [self._failure(h, notice) for h in handlers]
        for error in errors:
            if error:
                raise error

    @staticmethod
    def _failure(handler: Handler, notice: Any) -> Exception | None:
        try:
            handler(notice)
        except Exception as error:  # noqa: BLE001
            return error
        return None


# Requests over a repository


@dataclass(frozen=True)
class Execute:
    """commands: as Repository.execute takes them."""

    commands: DataFrame


@dataclass(frozen=True)
class Load:
    streams: DataFrame | None = None


@dataclass(frozen=True)
class LoadAt:
    version: int
    streams: DataFrame | None = None


@dataclass(frozen=True)
class LoadUntil:
    time: Any
    streams: DataFrame | None = None


def serving(repository: Repository, mediator: Mediator | None = None) -> Mediator:
    """A mediator whose requests are the repository's calls."""
    out = mediator or Mediator()
    out.handle(Execute, lambda r: repository.execute(r.commands))
    out.handle(Load, lambda r: repository.load(r.streams))
    out.handle(LoadAt, lambda r: repository.load(r.streams, at_version=r.version))
    return out.handle(LoadUntil, lambda r: repository.load(r.streams, until=r.time))


def stamped(correlation_id: str | None = None, causation_id: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """For Repository.stamp: metadata that commands bring with them go before these ids."""

    def stamp(commands: DataFrame) -> DataFrame:
        ours = metadata.of_ids(F.lit(causation_id).cast("string"), F.lit(correlation_id).cast("string"))
        given = F.col("metadata") if "metadata" in commands.columns else F.lit(None).cast(METADATA)
        return commands.withColumn("metadata", metadata.overlay(given, ours))

    return stamp


def saga_dispatcher(mediator: Mediator) -> Callable[[DataFrame], DataFrame]:
    """For Saga.dispatch: its commands go through the mediator, with all that wraps it."""
    return lambda commands: mediator.send(Execute(commands))

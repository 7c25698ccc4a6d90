"""What a store may refuse, and why."""

from __future__ import annotations


class StoreError(Exception):
    pass


class Conflict(StoreError):
    """The stream isn't where the writer expected it."""

    def __init__(self, stream_id: str, actual: int) -> None:
        super().__init__(f"{stream_id} is at version {actual}")
        self.stream_id, self.actual = stream_id, actual


class QueryConflict(StoreError):
    """An event that the writer hasn't seen matches its query."""

    def __init__(self, sequence: int) -> None:
        super().__init__(f"event {sequence} matches")
        self.sequence = sequence


class StreamClosed(StoreError):
    def __init__(self, stream_id: str) -> None:
        super().__init__(f"{stream_id} is closed")
        self.stream_id = stream_id


class Truncated(StoreError):
    """The read would miss events that were cut."""

    def __init__(self, stream_id: str, first: int) -> None:
        super().__init__(f"{stream_id} begins at version {first}")
        self.stream_id, self.first = stream_id, first


class DuplicateStream(StoreError):
    def __init__(self, stream_id: str) -> None:
        super().__init__(f"{stream_id} is in the batch more than once")
        self.stream_id = stream_id


class UnaskedStream(StoreError):
    """The batch holds events of a stream for which it states no expectation."""

    def __init__(self, stream_id: str) -> None:
        super().__init__(f"{stream_id} has events but no expectation")
        self.stream_id = stream_id


class Unavailable(StoreError):
    """Try again later."""


class BadRead(StoreError):
    """A read that a decision rests on is out of order, or holds what it didn't ask for."""


class EventRejected(Exception):
    """A projection can't apply this event."""

    def __init__(self, sequence: int, reason: str) -> None:
        super().__init__(f"event {sequence}: {reason}")
        self.sequence, self.reason = sequence, reason


class LeaseLost(Exception):
    """Another holder has the lease; ``acknowledged`` is the last sequence that this one acknowledged."""

    def __init__(self, name: str, acknowledged: int | None = None) -> None:
        super().__init__(name)
        self.acknowledged = acknowledged

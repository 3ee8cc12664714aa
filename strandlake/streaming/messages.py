"""Messages of a running stream, and who listens to them."""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True, kw_only=True)
class Message:
    sample_name: str
    t: int
    sequence: int

    def to_dict(self) -> dict:
        return {"msg_type": type(self).__name__, **asdict(self)}

    @staticmethod
    def from_dict(row: dict) -> Message:
        kinds = {c.__name__: c for c in (SampleStarted, Interval, DistanceCalc, SampleSaturated, SampleFinished, Error, EndStream)}
        return kinds[row["msg_type"]](**{k: v for k, v in row.items() if k != "msg_type"})


@dataclass(frozen=True, kw_only=True)
class SampleStarted(Message):
    pass


@dataclass(frozen=True, kw_only=True)
class Interval(Message):
    seconds: float

    def rates(self, before: Message | None) -> tuple[float, float]:
        """(k-mers, reads) a second since the message before."""
        t, sequence = (before.t, before.sequence) if before else (0, 0)
        seconds = max(self.seconds, 1e-9)
        return (self.t - t) / seconds, (self.sequence - sequence) / seconds


@dataclass(frozen=True, kw_only=True)
class DistanceCalc(Message):
    delta: int
    distance: float
    stat: float | None


@dataclass(frozen=True, kw_only=True)
class SampleSaturated(Message):
    pass


@dataclass(frozen=True, kw_only=True)
class SampleFinished(Message):
    pass


@dataclass(frozen=True, kw_only=True)
class Error(Message):
    error: str


@dataclass(frozen=True, kw_only=True)
class EndStream(Message):
    pass


@dataclass
class Handlers:
    """Callbacks by message type; those of ``Message`` get all.  A callback that fails does not stop the stream or the others."""

    callbacks: dict[type, list[Callable[[Message], None]]] = field(default_factory=lambda: defaultdict(list))
    failures: list[tuple[Message, Exception]] = field(default_factory=list)

    def on_message(self, kind: type, callback: Callable[..., None], *args, **options) -> None:
        self.callbacks[kind].append(lambda m: callback(m, *args, **options))

    def send(self, message: Message) -> None:
        for kind in type(message).__mro__:
            for callback in self.callbacks.get(kind, ()):
                try:
                    callback(message)
                except Exception as e:  # noqa: BLE001 - kept for the owner to look at
                    self.failures.append((message, e))


class Channel:
    """A named queue of messages between one sender and any number of subscribers, each of which sees all of them in order."""

    def __init__(self, name: str):
        self.name, self.queues = name, {}

    def subscribe(self, name: str) -> deque:
        return self.queues.setdefault(name, deque())

    def unsubscribe(self, name: str) -> None:
        self.queues.pop(name, None)

    def send(self, message: Message) -> None:
        for queue in self.queues.values():
            queue.append(message)

    def forward(self, other: Channel) -> None:
        """Pass what comes on to another channel too."""
        self.queues[f"forward:{other.name}"] = _Forward(other)


class _Forward:
    def __init__(self, channel: Channel):
        self.append = channel.send


class Gauge:
    """A named number that callbacks read while a stream runs."""

    def __init__(self, name: str, value: float = 0):
        self.name, self.value = name, value

    def add(self, by: float = 1) -> None:
        self.value += by


def echo(handlers: Handlers, path: str) -> None:
    """Append every message to a file, a line of JSON each."""

    def write(message: Message) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(message.to_dict()) + "\n")

    handlers.on_message(Message, write)


def every_n(callback: Callable[..., None], n: int) -> Callable[..., None]:
    """A callback that runs at each n-th message."""
    seen = 0

    def run(message: Message, *args, **options) -> None:
        nonlocal seen
        seen += 1
        if seen % n == 0:
            callback(message, *args, **options)

    return run


def at_ticks(callback: Callable[..., None], ticks: list[int]) -> Callable[..., None]:
    """A callback that runs at the messages of these numbers, from 1."""
    wanted, seen = set(ticks), 0

    def run(message: Message, *args, **options) -> None:
        nonlocal seen
        seen += 1
        if seen in wanted:
            callback(message, *args, **options)

    return run

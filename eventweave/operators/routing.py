"""Routes by exact (topic, key): at most one sink and one source each, any number of actors; and the delivery log."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweave.topics import Topic


class RouteConflict(ValueError):
    """A second sink or source for a (topic, key)."""


@dataclass
class Routes:
    """Owners by (topic, key). None as keys stands for all keys of the topic, and conflicts with any other owner of it."""

    what: str
    owners: dict[tuple[Topic, str | None], Any] = field(default_factory=dict)

    def register(self, owner: Any, topic: Topic, keys: list[str] | None) -> None:
        """Adds the keys that the owner lacks; nothing is added if any key has another owner."""
        wanted = [None] if keys is None else list(dict.fromkeys(keys))
        for k in wanted:
            for (t, other), held in self.owners.items():
                if t == topic and held is not owner and (k is None or other is None or k == other):
                    raise RouteConflict(f"{self.what} of ({topic.name}, {k}) is already {held.name}")
        for k in wanted:
            self.owners[topic, k] = owner

    def unregister(self, owner: Any, topic: Topic, keys: list[str] | None) -> None:
        """Takes away only what belongs to the owner."""
        for k in [None] if keys is None else keys:
            if self.owners.get((topic, k)) is owner:
                del self.owners[topic, k]

    def find(self, topic: Topic, key: str) -> Any | None:
        return self.owners.get((topic, key), self.owners.get((topic, None)))


@dataclass(frozen=True)
class Target:
    """One line of the subscription table: sinks come first, then actors of high priority, then the others, each as registered."""

    topic: str
    key: str | None
    name: str
    kind: str
    place: int


def deliver(events: DataFrame, targets: list[Target]) -> DataFrame:
    """Deliveries: one row per event and target, with target, target_kind and target_ord; events without a target give none.

    The subscription table comes from registrations in the program, so its size doesn't depend on the data; it is broadcast.
    """
    spark = events.sparkSession
    table = spark.createDataFrame([(t.topic, t.key, t.name, t.kind, t.place) for t in targets], "r_topic string, r_key string, target string, target_kind string, target_ord bigint")
    on = (events["topic"] == table["r_topic"]) & (table["r_key"].isNull() | (events["key"] == table["r_key"]))
    return events.join(F.broadcast(table), on).drop("r_topic", "r_key")

"""Leakage audit: what a frame derives from, and whether it may leave the enclave zone.

The audit walks frames of this library, which name the frames they derive from; a plain DataFrame names none and counts as
raw data. What a frame names is not taken on trust: its analysed plan is walked too, and whatever relation in it does not
lie within the plan of a named parent (a join, a subquery, another frame put in its place) is raw data as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame

_IDS = count()


class LeakageError(PermissionError):
    """Raw data would reach the untrusted zone."""


@dataclass(frozen=True, eq=False)
class Frame:
    """A DataFrame and the frames it derives from. Without parents it is a source of raw data."""

    df: DataFrame
    name: str = "source"
    parents: tuple[Frame, ...] = ()
    #: Set for the exchange of per-partition statistics, and by nothing else.
    exchange: int | None = None
    id: int = field(default_factory=lambda: next(_IDS))

    def derive(self, step: Callable[[DataFrame], DataFrame], name: str = "map", others: Iterable[Frame] = ()) -> Frame:
        """A frame computed from this one's rows (and others')."""
        return Frame(step(self.df), name, (self, *others))

    def group(self, *keys: str) -> Frame:
        """A frame that shuffles rows by keys: a shuffle of rows hides nothing."""
        return self.derive(lambda d: d.repartition(*keys), "shuffle")

    def union(self, other: Frame) -> Frame:
        return Frame(self.df.unionByName(other.df), "union", (self, other))


def _undeclared(df: DataFrame, parents: Iterable[DataFrame]) -> str | None:
    """A relation that the plan of df reads outside the plans of its parents, if there is one."""
    known = [p._jdf.queryExecution().analyzed() for p in parents]
    stack = [df._jdf.queryExecution().analyzed()]
    while stack:
        node = stack.pop()
        if any(node.fastEquals(p) or node.sameResult(p) for p in known):
            continue
        below = [x.apply(i) for x in (node.children(), node.subqueries(), node.innerChildren()) for i in range(x.size())]
        if not below and not node.nodeName() == "OneRowRelation":
            return node.nodeName()
        stack += [x for x in below if hasattr(x, "subqueries")]
    return None


def as_frame(data: Frame | DataFrame) -> Frame:
    return data if isinstance(data, Frame) else Frame(data)


class LeakageAuditor:
    """Knows the exchanges that carry statistics and the frames declared public; everything else is raw until shown otherwise."""

    def __init__(self) -> None:
        self._statistics: set[int] = set()
        self._public: set[int] = set()

    def register_statistic_exchange(self, frame: Frame) -> Frame:
        """The frame with its exchange marked as one of per-partition statistics."""
        marked = Frame(frame.df, frame.name, frame.parents, exchange=frame.id, id=frame.id)
        self._statistics.add(frame.id)
        return marked

    def declare_public(self, frame: Frame) -> Frame:
        self._public.add(frame.id)
        return frame

    def check_untrusted(self, data: Frame | DataFrame) -> None:
        """Raise LeakageError if raw data reaches the frame by any path that doesn't pass a statistic or public frame."""
        seen: set[int] = set()
        stack = [(as_frame(data), ())]
        while stack:
            frame, path = stack.pop()
            if frame.id in seen or frame.id in self._public:
                continue
            seen.add(frame.id)
            path = (*path, f"{frame.name}#{frame.id}")
            if frame.exchange is not None and frame.exchange in self._statistics:
                continue
            if not frame.parents:
                raise LeakageError(f"raw data of {path[-1]} would reach the untrusted zone by " + " <- ".join(path))
            if found := _undeclared(frame.df, [p.df for p in frame.parents]):
                raise LeakageError(f"raw data of {path[-1]}, whose plan reads {found} besides what it derives from, would reach the untrusted zone by " + " <- ".join(path))
            stack += [(p, path) for p in reversed(frame.parents)]

"""The query builder: an immutable description of a selection, turned into a DataFrame or a scalar."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.keys import MAX_METRIC_LENGTH, Key, check_tags, check_timestamp, entries, entries_of, tag_column

AGGREGATES: dict[str, Callable[[str], Column]] = {"count": lambda _: F.count(F.lit(1)), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Query:
    """A query over the points that ``source`` gives: timestamp, metric, tag columns, value.

    ``bucket`` gives a timestamp's bucket if the source is partitioned by such;
    predicates on time then also select buckets. ``write`` takes (key, value or
    None) for put and remove. Every method returns a new query.
    """

    source: Callable[[], DataFrame]
    tags: tuple[str, ...] = ()
    write: Callable[[Key, float | None], None] | None = None
    bucket: Callable[[int], int] | None = None
    kind: str | None = None
    parameter: Any = None
    filters: tuple[Column, ...] = ()

    def _typed(self, kind: str, parameter: Any) -> Query:
        if self.kind:
            raise EngineError("Query type already set.")
        return replace(self, kind=kind, parameter=parameter)

    def _filtered(self, condition: Column) -> Query:
        return replace(self, filters=(*self.filters, condition))

    def _key(self, timestamp: int, metric: str, tags: Mapping[str, str] | None) -> Key:
        check_tags(self.tags, tags or {})
        return Key(check_timestamp(timestamp), metric, dict(tags or {}))

    # What to look at: one of these, or all points.

    def get(self, timestamp: int, metric: str, tags: Mapping[str, str] | None = None) -> Query:
        """The point of exactly this key. Filters don't apply to it."""
        return self._typed("point", self._key(timestamp, metric, tags))

    def point(self, key: Key) -> Query:
        return self.get(key.timestamp, key.metric, key.tags)

    def range(self, start: Key, end: Key) -> Query:
        """Keys from ``start`` on and before ``end``; none if end comes first."""
        check_tags(self.tags, [*start.tags, *end.tags])
        return self._typed("range", (start, end))

    def where_timestamp_between(self, start: int, end: int) -> Query:
        """Both ends included."""
        return self._typed("between", (start, end))

    # Filters, all of which must hold.

    def where(self, condition: Column) -> Query:
        """Any condition on the key's columns."""
        return self._filtered(condition)

    def _has(self, tag: tuple[str, str]) -> Column:
        check_tags(self.tags, [tag[0]])
        return F.col(tag_column(tag[0])) == tag[1]

    def where_tags_contain(self, tag: tuple[str, str]) -> Query:
        return self._filtered(self._has(tag))

    def where_tags_contain_any_of(self, *tags: tuple[str, str]) -> Query:
        return self._filtered(reduce(or_, map(self._has, tags), F.lit(False)))

    def where_tags_contain_all_of(self, *tags: tuple[str, str]) -> Query:
        return self._filtered(reduce(and_, map(self._has, tags), F.lit(True)))

    def where_metric_is(self, metric: str) -> Query:
        return self._filtered(F.col("metric") == metric)

    def where_metric_is_any_of(self, *metrics: str) -> Query:
        return self._filtered(F.col("metric").isin(*metrics) if metrics else F.lit(False))

    def where_timestamp_is(self, timestamp: int) -> Query:
        return self.where_timestamp_is_any_of(timestamp)

    def where_timestamp_is_any_of(self, *timestamps: int) -> Query:
        if not timestamps:
            return self._filtered(F.lit(False))
        query = self._filtered(F.col("timestamp").isin(*timestamps))
        if self.bucket:
            query = query._filtered(F.col("bucket").isin(*set(map(self.bucket, timestamps))))
        return query

    # Writes.

    def put(self, timestamp: int, metric: str, tags: Mapping[str, str] | None, value: float) -> Query:
        """Write a point, in place of one with the same key."""
        if not 1 <= len(metric) <= MAX_METRIC_LENGTH:
            raise EngineError(f"Invalid metric '{metric}'.")
        return self._typed("put", (self._key(timestamp, metric, tags), float(value)))

    def remove(self, timestamp: int, metric: str, tags: Mapping[str, str] | None = None) -> Query:
        """Delete a point, whether there is one or not."""
        return self._typed("remove", (self._key(timestamp, metric, tags), None))

    # Results.

    def _bounds(self, start: int, end: int) -> Column:
        inside = F.col("timestamp").between(start, end)
        if self.bucket:
            inside &= F.col("bucket").between(self.bucket(start), self.bucket(end))
        return inside

    def _selected(self) -> DataFrame:
        rows = self.source()
        if self.kind == "point":
            key: Key = self.parameter
            same = [F.col(tag_column(t)).eqNullSafe(F.lit(key.tags.get(t))) for t in self.tags]
            return rows.where(reduce(and_, same, self._bounds(key.timestamp, key.timestamp) & (F.col("metric") == key.metric)))
        if self.kind == "between":
            rows = rows.where(self._bounds(*self.parameter))
        if self.kind == "range":
            start, end = self.parameter
            key = F.struct(F.col("timestamp").alias("t"), F.col("metric").alias("m"), entries(self.tags).alias("e"))
            at = lambda k: F.struct(F.lit(k.timestamp).cast("bigint").alias("t"), F.lit(k.metric).alias("m"), entries_of(k.tags).alias("e"))
            rows = rows.where(self._bounds(start.timestamp, end.timestamp)).where((key >= at(start)) & (key < at(end)))
        return reduce(DataFrame.where, self.filters, rows)

    def points(self) -> DataFrame:
        """The points selected, in no particular order."""
        if self.kind in ("put", "remove"):
            raise EngineError("Query type must be aggregable.")
        return self._selected().select("timestamp", "metric", *(tag_column(t) for t in self.tags), "value")

    def execute(self) -> DataFrame | None:
        """The points in key order; for put and remove do it and return None."""
        if self.kind in ("put", "remove"):
            if self.write is None:
                raise EngineError("These points can't be written to.")
            return self.write(*self.parameter)
        if self.kind is None and not self.filters:
            raise EngineError("No query type specified.")
        return self.points().orderBy("timestamp", "metric", entries(self.tags))

    def aggregate(self, name: str) -> DataFrame:
        """One row with one column ``name``. On no points all but count raise when the row is computed."""
        result = AGGREGATES[name]("value")
        if name != "count":
            result = F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("Cannot aggregate on empty range.")).cast("double")).otherwise(result)
        return self.points().agg(result.alias(name))

    def _scalar(self, name: str) -> float | int:
        row = self.points().agg(F.count(F.lit(1)).alias("n"), AGGREGATES[name]("value").alias("x")).first()
        if name != "count" and not row["n"]:
            raise EngineError("Cannot aggregate on empty range.")
        return row["x"]

    def count(self) -> int:
        return self._scalar("count")

    def sum(self) -> float:
        return self._scalar("sum")

    def avg(self) -> float:
        return self._scalar("avg")

    def min(self) -> float:
        return self._scalar("min")

    def max(self) -> float:
        return self._scalar("max")

"""Keys of points: columns, order and text form.

A point is keyed by timestamp, metric and the tags that it has. Tags are flat
nullable string columns named tag_<key>, so that predicates on them reach the
Parquet scan; a null means that the point lacks the tag.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

MAX_TIMESTAMP = 2**63 - 1
MAX_METRIC_LENGTH = 15
NO_ENTRIES = "array<struct<key:string,value:string>>"


@dataclass(frozen=True)
class Key:
    """Key of one point."""

    timestamp: int
    metric: str
    tags: Mapping[str, str] = field(default_factory=dict)

    def __str__(self) -> str:
        tags = ",".join(f"{k}:{v}" for k, v in sorted(self.tags.items()))
        return f"{{{self.timestamp:020d}}}{{{self.metric}}}{{{tags}}}"


def tag_column(key: str) -> str:
    return f"tag_{key}"


def check_tags(declared: Iterable[str], used: Iterable[str]) -> None:
    """Raise for the first tag key that isn't declared."""
    known = set(declared)
    for key in used:
        if key not in known:
            raise EngineError(f"Tag '{key}' is not in the table's tag columns.")


def check_timestamp(timestamp: int) -> int:
    if not 0 <= timestamp <= MAX_TIMESTAMP:
        raise EngineError("Invalid timestamp.")
    return timestamp


def point_schema(tags: Iterable[str]) -> T.StructType:
    """timestamp, metric, one column per tag, value."""
    fields = [T.StructField("timestamp", T.LongType(), False), T.StructField("metric", T.StringType(), False)]
    fields += [T.StructField(tag_column(k), T.StringType()) for k in sorted(tags)]
    return T.StructType([*fields, T.StructField("value", T.DoubleType())])


def key_columns(tags: Iterable[str]) -> list[str]:
    return ["timestamp", "metric", *(tag_column(k) for k in sorted(tags))]


def entries(tags: Iterable[str]) -> Column:
    """The tags that a point has as (key, value) structs by key. Arrays of them order as tag maps do."""
    each = [F.when(F.col(tag_column(k)).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(tag_column(k)).alias("value"))) for k in sorted(tags)]
    return F.filter(F.array(*each), lambda e: e.isNotNull()) if each else F.array().cast(NO_ENTRIES)


def entries_of(tags: Mapping[str, str]) -> Column:
    """The same array for given tags."""
    each = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(tags.items())]
    return F.array(*each) if each else F.array().cast(NO_ENTRIES)


def rendered(tags: Iterable[str]) -> Column:
    """Text form of the key: {20-digit timestamp}{metric}{key:value,...}."""
    pairs = F.array_join(F.transform(entries(tags), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return F.concat(F.lit("{"), F.lpad(F.col("timestamp").cast("string"), 20, "0"), F.lit("}{"), F.col("metric"), F.lit("}{"), pairs, F.lit("}"))


def parsed(text: Column, tags: Iterable[str]) -> list[Column]:
    """Key columns of a text form; null where the text doesn't have that form."""
    part = lambda n: F.regexp_extract(text, r"^\{(\d{20})\}\{([^}]*)\}\{([^}]*)\}$", n)
    held = F.when(part(3) != "", F.str_to_map(part(3), F.lit(","), F.lit(":")))
    columns = [F.try_to_number(part(1), F.lit("9" * 20)).cast("bigint").alias("timestamp"), F.when(part(1) != "", part(2)).alias("metric")]
    return columns + [held[F.lit(k)].alias(tag_column(k)) for k in sorted(tags)]

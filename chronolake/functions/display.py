"""Text forms of results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row

from .keys import Key, tag_column


def value_text(value: float | None) -> str:
    """A stored value: six significant digits, or null for a deletion."""
    return "null" if value is None else format(value, "g")


def scalar_text(value: float | int) -> str:
    """A scalar result: counts as integers, others with six decimals."""
    return str(value) if isinstance(value, int) else f"{value:.6f}"


def entry_text(key: Key, value: float | None) -> str:
    return f"[{key}|{value_text(value)}]"


def row_key(row: Row, tags: Iterable[str]) -> Key:
    return Key(row["timestamp"], row["metric"], {k: row[tag_column(k)] for k in tags if row[tag_column(k)] is not None})


def points_text(points: DataFrame, tags: Sequence[str]) -> str:
    """Ordered points as [entry;entry]. Rows stream to the driver a partition at a time."""
    return f"[{';'.join(entry_text(row_key(r, tags), r['value']) for r in points.toLocalIterator())}]"


def parse_key(text: str) -> Key:
    """Inverse of str(key)."""
    timestamp, metric, tags = text[1:-1].split("}{")
    return Key(int(timestamp), metric, dict(t.split(":", 1) for t in tags.split(",") if t))


def parse_entry(text: str) -> tuple[Key, float | None]:
    """Inverse of entry_text."""
    key, _, value = text[1:-1].rpartition("|")
    return parse_key(key), None if value == "null" else float(value)


def parse_points(text: str) -> list[tuple[Key, float | None]]:
    """Inverse of points_text, as far as six digits hold a value."""
    return [parse_entry(x) for x in text[1:-1].split(";") if x]

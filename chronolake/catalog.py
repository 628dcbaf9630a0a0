"""Databases and tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession

from .errors import EngineError
from .operators.query import Query
from .plans.interpreter import Interpreter, StatementError
from .plans.parser import ParseError, parse
from .sources.changelog import BUCKET, DELETE, ChangeLog
from .sources.files import Files

#: Exit codes of scripts with a parse error and with a runtime error.
EXIT_PARSE, EXIT_RUNTIME = 65, 70


class Table:
    """Points under a name, with declared tag columns."""

    def __init__(self, spark: SparkSession, path: str, name: str, width: int = BUCKET):
        self.name, self.path = name, path
        self.log = ChangeLog(spark, path, width)

    @property
    def tag_columns(self) -> list[str]:
        return self.log.tags

    def set_tag_columns(self, tags: Iterable[str]) -> None:
        self._unlocked()
        self.log.set_tags(tags)

    def _unlocked(self) -> None:
        if self.log.populated:
            raise EngineError(f"Table '{self.name}' holds data; its tag columns can't change.")

    def add_tag_column(self, key: str) -> None:
        self._unlocked()
        if key in self.tag_columns:
            raise EngineError(f"Tag column '{key}' already exists.")
        self.log.set_tags([*self.tag_columns, key])

    def remove_tag_column(self, key: str) -> None:
        self._unlocked()
        if key not in self.tag_columns:
            raise EngineError(f"Tag column '{key}' does not exist.")
        self.log.set_tags(t for t in self.tag_columns if t != key)

    def points(self) -> DataFrame:
        """The live points, with everything written so far."""
        return self.log.points()

    def query(self) -> Query:
        return Query(self.points, tuple(self.tag_columns), self.log.put, self.log.bucket)

    def put_points(self, points: DataFrame, order: Column | None = None, stream: tuple[str, int] | None = None) -> None:
        """Write many points at once; of equal keys the one with the largest ``order`` (default: the later row) wins.

        ``stream`` names a stream and its batch, which is written once.
        """
        self.log.append(points, order, stream=stream)

    def remove_points(self, keys: DataFrame) -> None:
        """Delete many points at once."""
        self.log.append(keys, None, DELETE)

    def flush(self) -> None:
        self.log.flush()

    def compact(self, width: int | None = None) -> None:
        """Keep only the live points, in buckets of ``width`` seconds."""
        self.log.compact(width)

    def compact_by_age(self, now: int) -> None:
        """The same in buckets that widen with age."""
        self.log.compact_by_age(now)

    def cache(self) -> None:
        """Keep the live points at hand until the next write."""
        self.log.cache()

    def vacuum(self) -> None:
        self.log.vacuum()

    def clear(self) -> None:
        self.log.clear()

    def empty(self) -> bool:
        return self.points().isEmpty()


class Database:
    """Tables in a folder of any file system that Spark reads.

    ``on_parse_error`` and ``on_runtime_error`` get the error of a run; without
    them it goes to standard error.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        on_parse_error: Callable[[ParseError], None] | None = None,
        on_runtime_error: Callable[[StatementError], None] | None = None,
    ):
        self.spark, self.path, self.name = spark, path.rstrip("/"), path.rstrip("/").rsplit("/", 1)[-1]
        self.files = Files(spark)
        self.files.make(self.path)
        self._tables = {n: Table(spark, f"{self.path}/{n}", n) for n in self.files.folders(self.path)}
        report = lambda e: print(e, file=sys.stderr)
        self.on_parse_error, self.on_runtime_error = on_parse_error or report, on_runtime_error or report

    def create_table(self, name: str, tags: Iterable[str] = (), width: int = BUCKET) -> Table:
        if name in self._tables:
            raise EngineError(f"Table '{name}' already exists.")
        table = Table(self.spark, f"{self.path}/{name}", name, width)
        table.set_tag_columns(dict.fromkeys(tags))
        self._tables[name] = table
        return table

    def get_table(self, name: str) -> Table:
        if name not in self._tables:
            raise EngineError(f"Table '{name}' does not exist.")
        return self._tables[name]

    def drop_table(self, name: str) -> None:
        self.files.remove(self.get_table(name).path)
        del self._tables[name]

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def clear(self) -> None:
        """Remove all tables."""
        self.files.remove(self.path)
        self.files.make(self.path)
        self._tables = {}

    def flush(self) -> None:
        for table in self._tables.values():
            table.flush()

    def _run(self, text: str) -> tuple[list[str], int]:
        try:
            statements = parse(text)
        except ParseError as e:
            self.on_parse_error(e)
            return [], EXIT_PARSE
        try:
            return Interpreter(self).run(statements), 0
        except StatementError as e:
            self.on_runtime_error(e)
            return [], EXIT_RUNTIME
        finally:
            self.flush()

    def run(self, text: str, out: TextIO | None = None) -> Database:
        """Run statements and print each result on a line, after all have run."""
        for line in self._run(text)[0]:
            print(line, file=out or sys.stdout)
        return self

    def run_file(self, path: str, out: TextIO | None = None) -> Database:
        """Run a .vq script as one batch; exits with 65 or 70 on an error."""
        if not path.endswith(".vq"):
            raise EngineError(f"'{path}' is not a .vq file.")
        lines, code = self._run(Path(path).read_text())
        if code:
            raise SystemExit(code)
        for line in lines:
            print(line, file=out or sys.stdout)
        return self

    def run_prompt(self, source: TextIO | None = None, out: TextIO | None = None) -> Database:
        """Run each line until the end or an empty line."""
        source, out = source or sys.stdin, out or sys.stdout
        while True:
            print("(vq) >> ", end="", file=out, flush=True)
            line = source.readline().rstrip("\n")
            if not line:
                return self
            self.run(line, out)

    def frame(self, text: str) -> DataFrame:
        """The result of one SELECT as a DataFrame; errors are raised."""
        (statement,) = parse(text)
        return Interpreter(self).frame(statement)

"""Statements to effects and results."""

from __future__ import annotations

from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..errors import EngineError
from ..functions.display import points_text, scalar_text
from ..functions.keys import MAX_TIMESTAMP
from ..operators.query import Query
from .lexer import Token
from .syntax import AddTags, All, At, Between, Create, Delete, Drop, Put, RemoveTags, Select, Statement, Tables, Tags

if TYPE_CHECKING:
    from ..catalog import Database, Table


class StatementError(EngineError):
    def __init__(self, token: Token, message: str):
        super().__init__(f"[line {token.line}] Runtime error: {message}")
        self.token, self.message = token, message


def timestamp_of(token: Token) -> int:
    """A fraction is cut off; what is negative or too large is an error."""
    value = int(token.lexeme.split(".")[0])
    if token.lexeme.startswith("-") or value > MAX_TIMESTAMP:
        raise StatementError(token, "Invalid timestamp.")
    return value


def value_of(token: Token) -> float:
    value = float(token.lexeme)
    if value in (float("inf"), float("-inf")):
        raise StatementError(token, "Invalid value.")
    return value


def tags_of(tags: Tags) -> dict[str, str]:
    """Of a tag given twice the first holds."""
    found: dict[str, str] = {}
    for key, value in tags:
        found.setdefault(key.lexeme, value.lexeme)
    return found


class Interpreter:
    """Runs statements against a database, one after the other."""

    def __init__(self, database: Database):
        self.database = database

    def _table(self, token: Token) -> Table:
        try:
            return self.database.get_table(token.lexeme)
        except EngineError as e:
            raise StatementError(token, str(e)) from e

    def select(self, s: Select) -> Query:
        """The query of a SELECT, not yet run."""
        query = self._table(s.table).query().where_metric_is(s.metric.lexeme)
        match s.clause:
            case Between(start, end):
                query = query.where_timestamp_between(timestamp_of(start), timestamp_of(end))
            case At(timestamp):
                query = query.where_timestamp_is(timestamp_of(timestamp))
            case All():
                pass
        for key, value in s.clause.where or ():
            try:
                query = query.where_tags_contain((key.lexeme, value.lexeme))
            except EngineError as e:
                raise StatementError(key, str(e)) from e
        return query

    def frame(self, s: Select) -> DataFrame:
        """The result of a SELECT as a DataFrame."""
        query = self.select(s)
        return query.execute() if s.what == "DATA" else query.aggregate(s.what.lower())

    def run_one(self, s: Statement) -> str | None:
        """Do a statement; the text of its result, if it has one."""
        match s:
            case Select():
                query = self.select(s)
                try:
                    return points_text(query.execute(), query.tags) if s.what == "DATA" else scalar_text(getattr(query, s.what.lower())())
                except EngineError as e:
                    raise StatementError(s.at, str(e)) from e
            case Put(metric, timestamp, value, table, tags):
                target = self._table(table).query()
                try:
                    target.put(timestamp_of(timestamp), metric.lexeme, tags_of(tags), value_of(value)).execute()
                except StatementError:
                    raise
                except EngineError as e:
                    raise StatementError(metric, str(e)) from e
            case Delete(metric, timestamp, table, tags):
                target = self._table(table).query()
                try:
                    target.remove(timestamp_of(timestamp), metric.lexeme, tags_of(tags)).execute()
                except StatementError:
                    raise
                except EngineError as e:
                    raise StatementError(metric, str(e)) from e
            case Create(table, columns):
                self._do(table, lambda: self.database.create_table(table.lexeme, [c.lexeme for c in columns]))
            case Drop(table):
                self._do(table, lambda: self.database.drop_table(table.lexeme))
            case AddTags(columns, table):
                for c in columns:
                    self._do(c, lambda c=c: self._table(table).add_tag_column(c.lexeme))
            case RemoveTags(columns, table):
                for c in columns:
                    self._do(c, lambda c=c: self._table(table).remove_tag_column(c.lexeme))
            case Tables():
                return " ".join(self.database.tables())
        return None

    def _do(self, token: Token, action) -> None:
        try:
            action()
        except StatementError:
            raise
        except EngineError as e:
            raise StatementError(token, str(e)) from e

    def run(self, statements: Iterable[Statement]) -> list[str]:
        """Run all; after an error the statements before it stay done, but give no results."""
        return [text for s in statements if (text := self.run_one(s)) is not None]



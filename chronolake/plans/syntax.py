"""Statements of the language. Tokens stay in the tree, so that errors can name a place."""

from __future__ import annotations

from dataclasses import dataclass

from .lexer import Token

Tags = tuple[tuple[Token, Token], ...]


@dataclass(frozen=True)
class All:
    where: Tags | None = None


@dataclass(frozen=True)
class Between:
    start: Token
    end: Token
    where: Tags | None = None


@dataclass(frozen=True)
class At:
    timestamp: Token
    where: Tags | None = None


@dataclass(frozen=True)
class Select:
    what: str  # DATA, COUNT, AVG, SUM, MIN or MAX
    at: Token  # the token after it, which errors name
    metric: Token
    table: Token
    clause: All | Between | At


@dataclass(frozen=True)
class Put:
    metric: Token
    timestamp: Token
    value: Token
    table: Token
    tags: Tags = ()


@dataclass(frozen=True)
class Delete:
    metric: Token
    timestamp: Token
    table: Token
    tags: Tags = ()


@dataclass(frozen=True)
class Create:
    table: Token
    columns: tuple[Token, ...] = ()


@dataclass(frozen=True)
class Drop:
    table: Token


@dataclass(frozen=True)
class AddTags:
    columns: tuple[Token, ...]
    table: Token


@dataclass(frozen=True)
class RemoveTags:
    columns: tuple[Token, ...]
    table: Token


@dataclass(frozen=True)
class Tables:
    at: Token


Statement = Select | Put | Delete | Create | Drop | AddTags | RemoveTags | Tables

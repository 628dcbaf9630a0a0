"""Tokens to statements."""

from __future__ import annotations

from .lexer import Token, tokenize
from .syntax import AddTags, All, At, Between, Create, Delete, Drop, Put, RemoveTags, Select, Statement, Tables, Tags

SELECT_TYPES = ("DATA", "COUNT", "AVG", "SUM", "MIN", "MAX")


class ParseError(ValueError):
    def __init__(self, token: Token, message: str):
        place = "at end" if token.type == "END_OF_FILE" else f"at '{token.lexeme}'"
        super().__init__(f"[line {token.line}] Parse error {place}: {message}")
        self.token, self.message = token, message


class _Reader:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def next(self) -> Token:
        return self.tokens[self.at]

    def take(self, kind: str, message: str) -> Token:
        if self.next.type != kind:
            raise ParseError(self.next, message)
        self.at += 1
        return self.tokens[self.at - 1]

    def word(self, keyword: str) -> Token:
        return self.take(keyword, f"Expected {keyword}.")

    def metric(self) -> Token:
        return self.take("IDENTIFIER", "Expected metric.")

    def table(self) -> Token:
        return self.take("IDENTIFIER", "Expected table name.")

    def timestamp(self) -> Token:
        return self.take("NUMBER", "Expected timestamp.")

    def listed(self, item):
        found = [item()]
        while self.next.type == "COMMA":
            self.at += 1
            found.append(item())
        return tuple(found)

    def tag_key(self) -> Token:
        return self.take("IDENTIFIER", "Expected tag key.")

    def tag(self) -> tuple[Token, Token]:
        key = self.tag_key()
        self.take("EQUAL", "Expected '='.")
        return key, self.take("IDENTIFIER", "Expected tag value.")

    def optional(self, keyword: str, item):
        if self.next.type != keyword:
            return None
        self.at += 1
        return self.listed(item)


def _select(r: _Reader) -> Select:
    r.word("SELECT")
    what = r.next.type
    if what not in SELECT_TYPES:
        raise ParseError(r.next, "Expected select type.")
    r.at += 1
    at, metric = r.next, r.metric()
    r.word("FROM")
    table = r.table()
    return Select(what, at, metric, table, _clause(r))


def _clause(r: _Reader) -> All | Between | At:
    def where() -> Tags | None:
        return r.optional("WHERE", r.tag)

    kind = r.next.type
    if kind not in ("ALL", "BETWEEN", "AT"):
        raise ParseError(r.next, "Expected select clause.")
    r.at += 1
    if kind == "ALL":
        return All(where())
    if kind == "AT":
        return At(r.timestamp(), where())
    start = r.timestamp()
    r.word("AND")
    return Between(start, r.timestamp(), where())


def _put(r: _Reader) -> Put:
    r.word("PUT")
    metric, timestamp, value = r.metric(), r.timestamp(), r.take("NUMBER", "Expected value.")
    r.word("INTO")
    return Put(metric, timestamp, value, r.table(), r.optional("TAGS", r.tag) or ())


def _delete(r: _Reader) -> Delete:
    r.word("DELETE")
    metric, timestamp = r.metric(), r.timestamp()
    r.word("FROM")
    return Delete(metric, timestamp, r.table(), r.optional("TAGS", r.tag) or ())


def _create(r: _Reader) -> Create:
    r.word("CREATE")
    r.word("TABLE")
    return Create(r.table(), r.optional("TAGS", r.tag_key) or ())


def _drop(r: _Reader) -> Drop:
    r.word("DROP")
    r.word("TABLE")
    return Drop(r.table())


def _change_tags(r: _Reader, verb: str, side: str, kind) -> AddTags | RemoveTags:
    r.word(verb)
    r.word("TAGS")
    columns = r.listed(r.tag_key)
    r.word(side)
    return kind(columns, r.table())


_STATEMENTS = {
    "SELECT": _select,
    "PUT": _put,
    "DELETE": _delete,
    "CREATE": _create,
    "DROP": _drop,
    "ADD": lambda r: _change_tags(r, "ADD", "TO", AddTags),
    "REMOVE": lambda r: _change_tags(r, "REMOVE", "FROM", RemoveTags),
    "TABLES": lambda r: Tables(r.word("TABLES")),
}


def parse(text: str) -> list[Statement]:
    """All statements of a text; raises a ParseError at the first fault. An empty text is a fault."""
    reader, found = _Reader(tokenize(text)), []
    while not found or reader.next.type != "END_OF_FILE":
        statement = _STATEMENTS.get(reader.next.type)
        if statement is None:
            raise ParseError(reader.next, "Expected query base word.")
        found.append(statement(reader))
        reader.take("SEMICOLON", "Expected semicolon.")
    return found

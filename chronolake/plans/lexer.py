"""Text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The words of the language, in upper case only.
KEYWORDS = frozenset("SELECT DATA COUNT AVG SUM MIN MAX FROM ALL BETWEEN AND AT WHERE PUT INTO DELETE CREATE DROP TABLE TABLES ADD REMOVE TAGS TO".split())

_TOKEN = re.compile(
    r"""(?P<space>\s+) | (?P<comment>//[^\n]*) | (?P<word>[A-Za-z_][A-Za-z0-9_]*) | (?P<NUMBER>-?[0-9]+(?:\.[0-9]+)?)
    | (?P<EQUAL>=) | (?P<COMMA>,) | (?P<SEMICOLON>;) | (?P<UNKNOWN>.)""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    type: str  # a keyword, IDENTIFIER, NUMBER, EQUAL, COMMA, SEMICOLON, UNKNOWN or END_OF_FILE
    lexeme: str
    line: int = 0
    column: int = 0

    def __str__(self) -> str:
        return f"Token{{{self.type}, {self.lexeme}, {self.line}, {self.column}}}"


def tokenize(text: str) -> list[Token]:
    """All tokens and END_OF_FILE; lines and columns count from 1."""
    tokens, line, start = [], 1, 0
    for m in _TOKEN.finditer(text):
        kind, lexeme = m.lastgroup, m[0]
        if kind not in ("space", "comment"):
            if kind == "word":
                kind = lexeme if lexeme in KEYWORDS else "IDENTIFIER"
            tokens.append(Token(kind, lexeme, line, m.start() - start + 1))
        elif "\n" in lexeme:
            line += lexeme.count("\n")
            start = m.start() + lexeme.rindex("\n") + 1
    return [*tokens, Token("END_OF_FILE", "", line, len(text) - start + 1)]

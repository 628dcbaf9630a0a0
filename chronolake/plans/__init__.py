"""The text language: lexer, parser, printer and interpreter."""

"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(ValueError):
    """A statement that the dialect rejects; the message names what is wrong."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, number, string, param, op, end
    text: str
    at: int


_RULES = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<number>\d+(?:\.\d+)?(?![\w.]))
      | (?P<word>[^\W\d][\w$]*)
      | (?P<quoted>"(?:[^"]|"")+")
      | (?P<string>'(?:[^']|'')*')
      | (?P<param>(?<!:):[A-Za-z_]\w*)
      | (?P<op><->|<=>|<\#>|::|<>|!=|<=|>=|[-+*/=<>(),.;\[\]])""",
    re.VERBOSE | re.DOTALL,
)


def tokens(text: str) -> list[Token]:
    """Unquoted words in lower case, strings and quoted names without their quotes."""
    out, at = [], 0
    while at < len(text):
        found = _RULES.match(text, at)
        if not found:
            raise SqlError(f"unexpected character {text[at]!r} at {at}")
        kind, raw = found.lastgroup, found.group()
        if kind == "word":
            raw = raw.lower()
        elif kind == "quoted":
            raw = raw[1:-1].replace('""', '"')
        elif kind == "string":
            raw = raw[1:-1].replace("''", "'")
        elif kind == "param":
            raw = raw[1:].lower()
        if kind != "space":
            out.append(Token(kind, raw, at))
        at = found.end()
    return [*out, Token("end", "", len(text))]

"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.errors import SqlError

WORD, NUMBER, STRING, SIGN, END = "word", "number", "string", "sign", "end"

# A sign that touches a digit belongs to the number, so ``a-1`` is two tokens without an operator.
_TOKEN = re.compile(
    r"""[ \t\n\r\f\v]*(?:
    (?P<word>[A-Za-z_][A-Za-z0-9_]*)
  | (?P<number>[+-]?[0-9][0-9.]*)
  | (?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
  | (?P<sign><=|>=|==|!=|&&|\|\||[,.();+\-*/%^~=!<>&|])
  )""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def tokenize(text: str) -> list[Token]:
    """The tokens of a statement, closed by an END token."""
    out, at, end = [], 0, len(text.rstrip(" \t\n\r\f\v"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            bad = text[at:].lstrip(" \t\n\r\f\v")[0]
            raise SqlError("Unterminated string literal" if bad in "'\"" else f"Unexpected character: {bad}")
        kind, body = m.lastgroup, m[m.lastgroup]
        if kind == STRING:
            body = body[1:-1].replace(body[0] * 2, body[0])
        out.append(Token(kind, body))
        at = m.end()
    return [*out, Token(END, "")]

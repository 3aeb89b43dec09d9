"""Words, symbols and literals of the query language, with their places in the text."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A statement that can't be read or makes no sense for this graph."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, int, float, string, param, sym, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


_RULES = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<int>\d+)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<quoted>`[^`]+`)
    |(?P<param>\$[A-Za-z_]\w*)
    |(?P<name>[^\W\d]\w*)
    |(?P<sym><=|>=|<>|!=|->|<-|\.\.|[-+*/%(){}\[\],:;.=<>|])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def lex(text: str) -> list[Token]:
    tokens, at = [], 0
    while at < len(text):
        m = _RULES.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        kind, word = m.lastgroup or "", m.group()
        # "1..3" is a range, not the number "1." and ".3"
        if kind == "string":
            word = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], "\\" + e[1]), word[1:-1], flags=re.S)
        elif kind == "quoted":
            word = word[1:-1]
        elif kind == "param":
            word = word[1:]
        if kind == "float" and word.startswith(".") and tokens and tokens[-1].text == ".":
            raise QueryError(f"unexpected number at {at}")
        if kind != "skip":
            tokens.append(Token(kind, word, at))
        at = m.end()
    tokens.append(Token("end", "", len(text)))
    return tokens

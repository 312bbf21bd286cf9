"""Python's regular expressions as patterns of Spark's (Java) engine.

A pattern is read by Python's own parser and written anew from its tree, so syntax that the two engines read differently (named groups, ``\\Z``,
``{,n}``, brackets and ``&&`` inside sets, literal braces) means what it means in Python. Classes are spelled out, because Java's are
ASCII or differ; ``.`` and ``$`` know ``\\n`` only. What has no equal is refused.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser
from typing import Any

from normslice.errors import NormError

_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_UNICODE = {"digit": r"\p{Nd}", "space": _SPACE, "word": r"\p{L}\p{N}_"}
_ASCII = {"digit": "0-9", "space": r"\x09-\x0D\x20", "word": "A-Za-z0-9_"}
_OPEN = {c.ASSERT: {1: "(?=", -1: "(?<="}, c.ASSERT_NOT: {1: "(?!", -1: "(?<!"}}
_KNOWN = re.IGNORECASE | re.MULTILINE | re.DOTALL | re.VERBOSE | re.UNICODE | re.ASCII


def java(pattern: str) -> str:
    """The pattern for ``rlike``; what it finds is what ``re.search`` finds."""
    try:
        tree = parser.parse(pattern)
    except (re.error, TypeError, OverflowError, RecursionError) as e:
        raise NormError(f"{pattern!r} is no pattern: {e}") from None
    flags = tree.state.flags
    if flags & ~_KNOWN:
        raise NormError(f"{pattern!r}: only the flags a, i, m, s, u, x have a meaning here")
    return _Writer(pattern).sequence(tree, flags)


class _Writer:
    def __init__(self, pattern: str) -> None:
        self._pattern = pattern

    def sequence(self, items: Any, flags: int) -> str:
        return "".join(self.item(op, value, flags) for op, value in items)

    def item(self, op: Any, value: Any, flags: int) -> str:
        if op is c.LITERAL or op is c.NOT_LITERAL:
            one = _literal(value)
            return self._cased(one if op is c.LITERAL else f"[^{one}]", flags)
        if op is c.ANY:
            return r"[\x{0}-\x{10FFFF}]" if flags & re.DOTALL else r"[^\n]"
        if op is c.IN:
            return self._cased(self._set(value, flags), flags)
        if op is c.BRANCH:
            return "(?:" + "|".join(self.sequence(x, flags) for x in value[1]) + ")"
        if op is c.SUBPATTERN:
            group, add, remove, inner = value
            body = self.sequence(inner, (flags | add) & ~remove)
            return f"({body})" if group is not None else f"(?:{body})"
        if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, inner = value
            times = f"{{{low},{'' if high is c.MAXREPEAT else high}}}"
            return f"(?:{self.sequence(inner, flags)}){times}" + {c.MAX_REPEAT: "", c.MIN_REPEAT: "?", c.POSSESSIVE_REPEAT: "+"}[op]
        if op is c.ATOMIC_GROUP:
            return f"(?>{self.sequence(value, flags)})"
        if op in _OPEN:
            return _OPEN[op][value[0]] + self.sequence(value[1], flags) + ")"
        if op is c.GROUPREF:
            return self._cased(f"\\{value}(?:)", flags)  # digits that follow are no part of the number
        if op is c.AT:
            return self._place(value, flags)
        raise NormError(f"{self._pattern!r}: {str(op).lower().replace('_', ' ')} has no equal in Spark's engine")

    @staticmethod
    def _cased(text: str, flags: int) -> str:
        return f"(?i{'' if flags & re.ASCII else 'u'}:{text})" if flags & re.IGNORECASE else text

    @staticmethod
    def _class(name: str, flags: int) -> str:
        return (_ASCII if flags & re.ASCII else _UNICODE)[name]

    def _set(self, members: Any, flags: int) -> str:
        negated, parts = False, []
        for op, value in members:
            if op is c.NEGATE:
                negated = True
            elif op is c.LITERAL:
                parts.append(_literal(value))
            elif op is c.RANGE:
                parts.append(f"{_literal(value[0])}-{_literal(value[1])}")
            else:  # a category, or its complement as a set inside the set
                name = str(value).lower().removeprefix("category_")
                inside = self._class(name.removeprefix("not_"), flags)
                parts.append(f"[^{inside}]" if name.startswith("not_") else inside)
        return f"[{'^' if negated else ''}{''.join(parts)}]"

    def _place(self, at: Any, flags: int) -> str:
        word = f"[{self._class('word', flags)}]"
        if at is c.AT_BEGINNING:
            return r"(?:\A|(?<=\n))" if flags & re.MULTILINE else r"\A"
        if at is c.AT_END:
            return r"(?=\n|\z)" if flags & re.MULTILINE else r"(?=\n?\z)"
        edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        inner = f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))"
        return {c.AT_BEGINNING_STRING: r"\A", c.AT_END_STRING: r"\z", c.AT_BOUNDARY: edge, c.AT_NON_BOUNDARY: inner}[at]


def _literal(code: int) -> str:
    character = chr(code)
    return character if character.isascii() and character.isalnum() else f"\\x{{{code:X}}}"

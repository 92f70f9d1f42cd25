"""Wildcards and regular expressions: translation to Java syntax, validation, required literals."""

from __future__ import annotations

import re

try:  # Python 3.11 and later keep the parser here
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as C
    import sre_parse as parser

# Characters that a wildcard pattern takes literally though a regular expression would not. Fixed values.
_META = set("\\.+()|[]{}^$#")
MAX_CLAUSES = 16
MAX_ALTERNATIVES = 32
MIN_LITERAL = 3


def wildcard(pattern: str) -> str:
    """The anchored regular expression of a wildcard pattern: * any run, ? one character."""
    out = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in _META else c for c in pattern)
    return f"\\A{out}\\z"


def java(pattern: str) -> str | None:
    """The pattern for rlike: Unicode case folding, '.' stops at line feeds only; None if it isn't valid.

    Look-around, back-references and possessive or atomic groups are not part of the language: they make it invalid.
    """
    if re.search(r"\(\?(=|!|<=|<!|>)|(?<!\\)(?:\\\\)*\\[1-9]|\(\?P[=>]|[*+?}]\+", pattern):
        return None
    try:
        re.compile(pattern.replace("\\z", "\\Z"))
    except (re.error, OverflowError, RecursionError):
        return None
    strict_end = re.sub(r"(?<!\\)((?:\\\\)*)\$(?![^\[]*\])", r"\1\\z", pattern)
    return f"(?iud){strict_end}"


def _literal(chars: list[int]) -> list[frozenset[str]]:
    """One clause of one literal, in pieces without k and s (which have Unicode partners beyond ASCII)."""
    text = "".join(map(chr, chars))
    if not text.isascii():
        return []
    return [frozenset([p]) for p in re.split("[kKsS]", text.lower()) if len(p) >= MIN_LITERAL]


def _analyse(parsed: object) -> list[frozenset[str]]:
    clauses: list[frozenset[str]] = []
    run: list[int] = []

    def flush() -> None:
        clauses.extend(_literal(run))
        run.clear()

    for op, arg in parsed:
        if op is C.LITERAL:
            run.append(arg)
            continue
        flush()
        if op is C.SUBPATTERN:
            clauses += _analyse(arg[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            clauses += _analyse(arg[2])
        elif op is C.BRANCH:
            options = [_analyse(b) for b in arg[1]]
            if all(options):
                union = frozenset().union(*(min(o, key=len) for o in options))
                if len(union) <= MAX_ALTERNATIVES:
                    clauses.append(union)
    flush()
    return clauses


def required_literals(pattern: str) -> list[frozenset[str]]:
    """Clauses (any of the literals) of which every match contains one each: a redundant prefilter, maybe empty."""
    try:
        found = _analyse(parser.parse(pattern.replace("\\z", "\\Z")))
    except (re.error, OverflowError, RecursionError):
        return []
    return sorted(set(found), key=sorted)[:MAX_CLAUSES]

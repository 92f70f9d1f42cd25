"""The search language: tokens, predicates, path terms; and the closed set of queries that it compiles to."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

MAX_TERMS = 16
U32 = (1 << 32) - 1
U64 = (1 << 64) - 1
# Unit words of sizes and ages. Fixed values.
SIZE_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "kib": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "mib": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "gib": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "tib": 1 << 40}
AGE_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
KINDS = {"file": False, "dir": True, "directory": True, "folder": True}
ORDERS = {"relevance": "relevance", "recent": "recent", "size": "largest", "largest": "largest"}


class TooManyTerms(ValueError):
    """More than MAX_TERMS terms; searches answer it with no result."""


@dataclass(frozen=True)
class Filter:
    """Metadata predicates; None or empty means no bound. Sizes in bytes, times in epoch seconds, both inclusive."""

    is_dir: bool | None = None
    extensions: tuple[str, ...] = ()
    min_size: int | None = None
    max_size: int | None = None
    min_mtime: int | None = None
    max_mtime: int | None = None

    def __bool__(self) -> bool:
        return self != Filter()


@dataclass(frozen=True)
class Query:
    """kind: prefix, substring, regex or path_terms. text is the pattern of the first three."""

    kind: str
    text: str = ""
    terms: tuple[str, ...] = ()
    filter: Filter = field(default_factory=Filter)


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _tokens(text: str) -> list[str]:
    done: list[str] = []
    word, quoted = "", False
    for c in text:
        if c == '"':
            quoted = not quoted
        elif c.isspace() and not quoted and not ("\\" in word or "/" in word):
            if word:
                done.append(word)
                word = ""
        else:
            word += c
        if len(done) > MAX_TERMS:
            raise TooManyTerms
    return [*done, word] if word else done


def _components(tokens: list[str]) -> tuple[str, ...]:
    terms = tuple(p for t in tokens for p in t.replace("\\", "/").split("/") if p)
    if len(terms) > MAX_TERMS:
        raise TooManyTerms
    return terms


def parse_terms(text: str) -> tuple[str, ...]:
    """Path terms alone: white space separates, quotes and separators keep together, components are terms."""
    return _components(_tokens(text))


def _number(text: str, units: dict[str, int], limit: int) -> int | None:
    digits = len(text) - len(text.lstrip("0123456789"))
    if not digits or text[digits:] not in units or int(text[:digits]) > limit:
        return None
    value = int(text[:digits]) * units[text[digits:]]
    return value if value <= limit else None


def parse_size(text: str) -> int | None:
    return _number(text, SIZE_UNITS, U64)


def parse_age(text: str) -> int | None:
    return _number(text, AGE_UNITS, U32)


def _sized(value: str, at: Filter) -> Filter | None:
    sign = next((s for s in (">=", ">", "<=", "<") if value.startswith(s)), "")
    n = parse_size(value[len(sign) :])
    if n is None:
        return None
    low = {"": n, ">=": n, ">": n + 1 if n < U64 else None}
    high = {"": n, "<=": n, "<": n - 1 if n else None}
    if sign in low:
        at = replace(at, min_size=low[sign])
    return replace(at, max_size=high[sign]) if sign in high else at


def _aged(value: str, at: Filter, now: int) -> Filter | None:
    age = parse_age(value[1:] if value[:1] in ("<", ">") else value)
    if age is None:
        return None
    edge = max(0, now - age)
    return replace(at, max_mtime=edge) if value[0] == ">" else replace(at, min_mtime=edge)


def parse(text: str, now: int) -> Query:
    """A path-term query with its predicates (type:, ext:, size:, modified:); a token that is none is a term."""
    terms: list[str] = []
    at = Filter()
    for token in _tokens(text):
        name, colon, value = ascii_lower(token).partition(":")
        new = None
        if colon and name == "type" and value in KINDS:
            new = replace(at, is_dir=KINDS[value])
        elif colon and name == "ext":
            named = tuple(e for e in (v.lstrip(".") for v in value.split(",")) if e)
            new = replace(at, extensions=at.extensions + named) if named else None
        elif colon and name == "size":
            new = _sized(value, at)
        elif colon and name == "modified" and value:
            new = _aged(value, at, now)
        if new is None:
            terms.append(token)
        else:
            at = new
    found = _components(terms)
    return Query("path_terms", terms=found or ("",) if at else found, filter=at)


def infer_kind(text: str) -> str:
    return "wildcard" if "*" in text or "?" in text else "path_terms"


def to_query(text: str, now: int, kind: str | None = None) -> Query:
    """The query of a request; too many terms become no terms (which match nothing)."""
    from arbordex.functions.regex import wildcard

    kind = kind or infer_kind(text)
    if kind in ("prefix", "substring", "regex"):
        return Query(kind, text)
    if kind == "wildcard":
        return Query("regex", wildcard(text))
    if kind != "path_terms":
        raise ValueError(f"unknown kind of query: {kind!r}")
    try:
        return parse(text, now)
    except TooManyTerms:
        return Query("path_terms")


def parse_order(name: str) -> str:
    if name not in ORDERS:
        raise ValueError(f"unknown order: {name!r}")
    return ORDERS[name]
